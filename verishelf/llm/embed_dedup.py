"""Embedding near-duplicates: PCA-ordered tiles that stop when a cosine can't be reached.

All pairs are compared in blocks, exactly. Unit vectors are turned to their principal axes,
which are ordered by energy; any rotation keeps cosines, so the axes come from a bounded sample.
A tile of pairs sums the products of the leading axes first. What the rest can add is at most
the product of the two suffix norms; pairs that can't reach the threshold are dropped, and a
tile stops when none is left. Survivors are verified in double precision on the input vectors.
Blocks are boxes in the leading axes; a vector is sent to those only that its bound can reach.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verishelf.llm._common import Links, components, cut, drawn, lookup, numbering

#: Slack of the bound in single precision, far over its rounding error.
EPS = 1e-4


def principal_axes(sample: np.ndarray) -> np.ndarray:
    """An orthonormal matrix, its columns ordered by the energy of the sample along them."""
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    return np.linalg.eigh(unit.T @ unit)[1][:, ::-1]


def split_boxes(z: np.ndarray, depth: int) -> list[tuple[int, float]]:
    """Splits (axis, median) in heap order: each of the axis along which the sample's part varies most."""
    nodes: list[tuple[int, float]] = [(0, 0.0)] * (2**depth - 1)
    parts = {0: z}
    for i in range(len(nodes)):
        part = parts.pop(i)
        if len(part):
            k = int(part.var(axis=0).argmax())
            nodes[i] = (k, float(np.median(part[:, k])))
        k, at = nodes[i]
        parts[2 * i + 1], parts[2 * i + 2] = part[part[:, k] <= at], part[part[:, k] > at]
    return nodes


def box_of(nodes: list[tuple[int, float]], z: np.ndarray) -> np.ndarray:
    """The number of the box of each row."""
    at = np.zeros(len(z), dtype=np.int64)
    axis, cutoff = np.array([n[0] for n in nodes], dtype=np.int64), np.array([n[1] for n in nodes])
    for _ in range((len(nodes) + 1).bit_length() - 1):
        at = 2 * at + 1 + (z[np.arange(len(z)), axis[at]] > cutoff[at])
    return at - len(nodes)


@dataclass(frozen=True)
class Blocks:
    """Of the vectors of one length: axes (None: as they are), splits, and per box the reach of its vectors."""

    axes: np.ndarray | None
    nodes: list[tuple[int, float]]
    lead: int
    low: np.ndarray | None = None
    high: np.ndarray | None = None
    tail: np.ndarray | None = None

    def turn(self, x: np.ndarray) -> np.ndarray:
        return x if self.axes is None else x @ self.axes

    def reached(self, z: np.ndarray, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
        """For each box, the rows of z that may have a cosine of threshold with one of its vectors."""
        lead = z[:, : self.lead]
        tail = np.sqrt(np.maximum(0, (z[:, self.lead :] ** 2).sum(axis=1)))
        for k in range(len(self.tail)):
            if np.isfinite(self.tail[k]):
                most = np.maximum(lead * self.low[k], lead * self.high[k]).sum(axis=1) + tail * self.tail[k]
                yield k, np.flatnonzero(most >= threshold - EPS)


def _unit(x: np.ndarray) -> np.ndarray:
    """Vectors of length one; scaled by their largest part first, so that nothing over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def linked_pairs(a: np.ndarray, b: np.ndarray, za: np.ndarray, zb: np.ndarray, threshold: float, same: bool, step: int = 16, tile: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (of a, of b) with cosine >= threshold, tile by tile; same: only i < j.

    a and b are unit vectors, za and zb those along the principal axes in single precision.
    """
    d = a.shape[1]
    tail = lambda z, m: np.sqrt(np.maximum(0, (z[:, m:] ** 2).sum(axis=1)))
    stops = [*range(step, d, step), d]
    ta, tb = [tail(za, m) for m in stops], [tail(zb, m) for m in stops]
    for i in range(0, len(a), tile):
        for j in range(i if same else 0, len(b), tile):
            x, y = za[i : i + tile], zb[j : j + tile]
            rows = cols = None
            for k, m in enumerate(stops):
                lead = slice(stops[k - 1] if k else 0, m)
                if rows is None:
                    part = x[:, lead] @ y[:, lead].T
                    total = part if k == 0 else total + part
                    alive = total >= threshold - EPS - np.outer(ta[k][i : i + tile], tb[k][j : j + tile])
                    n = np.count_nonzero(alive)
                    if n == 0:
                        break
                    if n < alive.size // 16 or m == d:
                        rows, cols = np.nonzero(alive)
                        sums = total[rows, cols]
                else:
                    sums = sums + np.einsum("ij,ij->i", x[rows, lead], y[cols, lead])
                    keep = sums >= threshold - EPS - ta[k][i + rows] * tb[k][j + cols]
                    rows, cols, sums = rows[keep], cols[keep], sums[keep]
                    if not len(rows):
                        break
            if rows is None or not len(rows):
                continue
            rows, cols = rows + i, cols + j
            if same:
                keep = rows < cols
                rows, cols = rows[keep], cols[keep]
            for lo in range(0, len(rows), 65536):
                r, c = rows[lo : lo + 65536], cols[lo : lo + 65536]
                ok = np.einsum("ij,ij->i", a[r], b[c]) >= threshold
                if ok.any():
                    yield r[ok], c[ok]


def embedding_classes(vectors: DataFrame, *, threshold: float = 0.9, block: int = 8192, max_blocks: int = 1 << 14, lead: int = 16, sample: int = 4096, max_axes: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per row of vectors: id_col, n_links, component_id, kept.

    Rows link if the cosine of their vectors is at least the threshold. n_links counts the other
    rows linked directly, component_id is the smallest id over links, nulls left out, and kept
    says whether that is the row's own id. Vectors that are null, empty, zero or hold a null or
    non-finite part link with nothing, and so do vectors of different lengths with each other.
    Equal vectors are folded and counted before any comparison. Other columns don't matter; an
    empty table gives none.

    The folded vectors are dealt to boxes by their leading axes, of about `block` vectors, or more where
    they would be more than max_blocks. A vector goes to those other boxes only whose intervals and suffix
    norms leave it a cosine of the threshold. Each pair of boxes is one task's work; it
    returns, for vectors with links, their number and a spanning forest, never the pairs. Work and shuffled bytes
    are quadratic in the distinct vectors where no box can be ruled out (vectors without any structure), as
    for any exact comparison.

    Axes come from about `sample` vectors of each of the 64 most frequent lengths up to max_axes, boxes from
    those of 1,024 lengths, so the driver's part is bounded; other lengths are compared along the axes as they are, in one box.
    """
    rows = vectors.select(F.col(id_col), F.col(vector_col).cast("array<double>").alias("v"))
    kind = dict(rows.dtypes)[id_col]

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for v in batch.column("v"):
                x = v.values
                x = None if x is None or not len(x) or x.null_count else x.to_numpy()
                keys.append(None if x is None or not np.isfinite(x).all() or not x.any() else np.ascontiguousarray(x, dtype="<f8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary())], names=[id_col, "v"])

    rows = cut(rows.mapInArrow(check, f"`{id_col}` {kind}, v binary"))
    classes = rows.where("v is not null").groupBy("v").agg(F.count("*").alias("m"), F.min(id_col).alias("low"))
    classes = cut(classes.withColumn("d", (F.length("v") / 8).cast("int")))
    node = F.xxhash64(F.lit(numbering(classes, "v")), "v")
    classes = classes.withColumn("node", node)
    frequent = classes.groupBy("d").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1024).collect()
    plans: dict[int, Blocks] = {}
    for r in frequent:
        d, n = r["d"], r["n"]
        depth = min(max_blocks, math.ceil(n / block)) - 1
        depth = depth.bit_length()
        if not depth and (d > max_axes or len(plans) >= 64):
            continue
        picked = drawn(classes.where(F.col("d") == d), min(max(sample, 16 << depth), (1 << 23) // d + 1, max(64, (1 << 19) // len(frequent))), "node", n=n).select("v").orderBy("v").toArrow()
        x = _unit(np.frombuffer(b"".join(picked.column("v").to_pylist()), dtype="<f8").reshape(-1, d)) if picked.num_rows else np.zeros((0, d))
        axes = principal_axes(x) if len(x) and d <= max_axes and len(plans) < 64 else None
        z = x if axes is None else x @ axes
        plans[d] = Blocks(axes, split_boxes(z[:, : min(lead, d)], depth), min(lead, d))
    context = rows.sparkSession.sparkContext
    if any(p.nodes for p in plans.values()):
        first = context.broadcast(plans)

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for d, at, z, plan in _turned(batches, first.value):
                if plan.nodes:
                    box = box_of(plan.nodes, z)
                    for k in np.unique(box).tolist():
                        own = z[box == k]
                        tail = np.sqrt(np.maximum(0, (own[:, plan.lead :] ** 2).sum(axis=1)))[:, None]
                        own = np.concatenate([own[:, : plan.lead], tail], axis=1)
                        axis = np.arange(own.shape[1])
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(axis), d, dtype=np.int32)), pa.array(np.full(len(axis), k)), pa.array(axis), pa.array(own.min(axis=0)), pa.array(own.max(axis=0))], names=["d", "box", "axis", "low", "high"])

        reach = classes.select("d", "v", "node", "m").mapInArrow(measure, "d int, box long, axis long, low double, high double").groupBy("d", "box", "axis").agg(F.min("low").alias("low"), F.max("high").alias("high"))
        low = {d: np.full((len(p.nodes) + 1, p.lead + 1), np.inf) for d, p in plans.items() if p.nodes}
        high = {d: np.full((len(p.nodes) + 1, p.lead + 1), -np.inf) for d, p in plans.items() if p.nodes}
        got = reach.toArrow()
        for d, box, axis, a, b in zip(*(got.column(c).to_pylist() for c in ("d", "box", "axis", "low", "high")), strict=True):
            low[d][box, axis], high[d][box, axis] = a, b
        plans = {d: Blocks(p.axes, p.nodes, p.lead, low[d][:, :-1], high[d][:, :-1], high[d][:, -1]) if p.nodes else p for d, p in plans.items()}
    held = context.broadcast(plans)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["d", "lo", "hi", "first", "node", "m", "v"]
        for d, batch, z, plan in _turned(batches, held.value):
            own = box_of(plan.nodes, z) if plan.nodes else np.zeros(len(z), dtype=np.int64)
            for other, at in plan.reached(z, threshold) if plan.nodes else [(0, np.arange(len(z)))]:
                at = np.union1d(at, np.flatnonzero(own == other))
                lo, hi, take = np.minimum(own[at], other), np.maximum(own[at], other), pa.array(at)
                yield pa.RecordBatch.from_arrays([batch.column("d").take(take), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), pa.array(own[at] == lo), *(batch.column(c).take(take) for c in ("node", "m", "v"))], names=names)

    def compare(table: pa.Table) -> pa.Table:
        d, same = table.column("d")[0].as_py(), table.column("lo")[0].as_py() == table.column("hi")[0].as_py()
        node, m, first = (table.column(c).to_numpy() for c in ("node", "m", "first"))
        x = _unit(np.frombuffer(b"".join(table.column("v").to_pylist()), dtype="<f8").reshape(-1, d))
        z = (held.value[d].turn(x) if d in held.value else x).astype(np.float32)
        a = np.flatnonzero(first)
        b = a if same else np.flatnonzero(~first)
        found, links = np.zeros(len(node), dtype=np.int64), Links(len(node))
        for i, j in linked_pairs(x[a], x[b], z[a], z[b], threshold, same):
            i, j = a[i], b[j]
            found += np.bincount(i, m[j], len(node)).astype(np.int64) + np.bincount(j, m[i], len(node)).astype(np.int64)
            links.join(i, j)
        at = np.flatnonzero(found)
        return pa.table({"node": node[at], "links": found[at], "root": node[links.label[at]]})

    dealt = classes.select("node", "m", "d", "v").mapInArrow(deal, "d int, lo int, hi int, first boolean, node long, m long, v binary")
    found = cut(dealt.groupBy("d", "lo", "hi").applyInArrow(compare, "node long, links long, root long"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    sums = found.groupBy("node").agg(F.sum("links").alias("links"))
    labelled = classes.select("node", "m", "low").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lows = labelled.groupBy("root").agg(F.min("low").alias("lowest"), F.count("*").alias("k"))
    facts = lookup(labelled, lows, "root", "k").join(sums, "node", "left").select("node", "m", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).cast("long").alias("n_links"), F.col("lowest").alias("component_id"))
    linked = lookup(rows.where("v is not null").select(id_col, node.alias("node")), cut(facts), "node", "m")
    alone = rows.where("v is null").select(id_col, F.lit(0).cast("long").alias("n_links"), F.col(id_col).alias("component_id"))
    return linked.select(id_col, "n_links", "component_id").unionByName(alone).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def _turned(batches: Iterator[pa.RecordBatch], plans: dict[int, Blocks]) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray, Blocks]]:
    """The rows of one length of each batch, with their unit vectors along the axes, and the length's plan."""
    for batch in batches:
        lengths = batch.column("d").to_numpy()
        for d in np.unique(lengths).tolist():
            part = batch.take(pa.array(np.flatnonzero(lengths == d)))
            plan = plans.get(d) or Blocks(None, [], d)
            x = _unit(np.frombuffer(b"".join(part.column("v").to_pylist()), dtype="<f8").reshape(-1, d)) if plan.nodes else np.zeros((part.num_rows, 0))
            yield d, part, plan.turn(x) if plan.nodes else x, plan
