"""Benchmark decontamination: a broadcast set of test n-grams, scanned over whole documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verishelf.llm._common import cut, raw_bytes

#: A-Z to a-z; digits, a-z and bytes of non-ASCII characters stay; all else parts words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_P = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


class Windows:
    """The windows of a block of benchmark items, 16 bytes each: sorted hashes, places in the items' word ids, items."""

    def __init__(self, items: list[tuple[str, bytes | None]], n: int):
        self.ids: dict[bytes, int] = {}
        self.names = [item for item, _ in items]
        words = [np.array([self.ids.setdefault(w, len(self.ids) + 1) for w in words_of(text)], dtype=np.uint32) for _, text in items]
        size = np.array([len(w) for w in words], dtype=np.int64)
        begin = np.cumsum(size) - size
        self.flat = np.concatenate([np.zeros(0, dtype=np.uint32), *words])
        owner = np.repeat(np.arange(len(items), dtype=np.int32), size)
        room = np.repeat(begin + size, size) - np.arange(len(self.flat))
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for m in range(1, n + 1):
            at = np.flatnonzero(room >= m) if m == n else begin[size == m]
            if m == n:
                at = at[size[owner[at]] >= n]
            if len(at):
                h = np.concatenate([self._hash(self.flat[some[:, None] + np.arange(m)].astype(np.uint64), m) for some in np.array_split(at, len(at) // 65536 + 1)])
                order = np.argsort(h, kind="stable")
                self.tables[m] = h[order], at[order], owner[at[order]]

    @staticmethod
    def _hash(at: np.ndarray, m: int) -> np.ndarray:
        """at: one row of word ids per window."""
        h = np.zeros(len(at), dtype=np.uint64)
        for j in range(m):
            h = (h * _P) ^ (at[:, j] + (h >> np.uint64(29)))
        return h

    def scan(self, text: bytes | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """The number of words, the hit word spans (merged, end exclusive), the items hit."""
        words = words_of(text)
        get = self.ids.get
        ids = np.fromiter((get(w, 0) for w in words), dtype=np.uint64, count=len(words))
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        mark, hit = np.zeros(len(words) + 1, dtype=np.int64), set()
        for m, (hashes, places, owner) in self.tables.items():
            if len(words) < m:
                continue
            at = np.flatnonzero(known[m:] - known[:-m] == m)
            for lo in range(0, len(at), 65536):
                some = at[lo : lo + 65536]
                rows = ids[some[:, None] + np.arange(m)]
                h = self._hash(rows, m)
                first = np.searchsorted(hashes, h)
                for i in np.flatnonzero(hashes[np.minimum(first, len(hashes) - 1)] == h).tolist():
                    same = slice(first[i], np.searchsorted(hashes, h[i], side="right"))
                    equal = (self.flat[places[same][:, None] + np.arange(m)] == rows[i]).all(axis=1)
                    if equal.any():
                        mark[some[i]] += 1
                        mark[some[i] + m] -= 1
                        hit.update(np.unique(owner[same][equal]).tolist())
        on = np.concatenate([[0], (np.cumsum(mark)[:-1] > 0).astype(np.int8), [0]])
        edge = np.diff(on)
        return len(words), list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True)), {self.names[k] for k in hit}


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, n: int = 10, max_block_chars: int = 16_000_000, keep: list[str] | None = None) -> DataFrame:
    """Where documents hold n consecutive words of a benchmark item.

    docs: text and the columns `keep` (doc_id and text); benchmark: item_id and text; other columns
    are ignored, and columns that are named like the results make way for them. An item of
    fewer than n words, but some, is one window of its own length. Words are compared with A-Z
    lower-cased; everything but ASCII letters, digits and non-ASCII characters parts words.
    Each window hash that is in the set is verified word by word.

    Returns per row of docs: the kept columns, n_words, spans (merged word ranges that are hit),
    items (sorted ids of the items hit). Null and empty texts have no words. Null item ids
    read "null". Repeated rows and items are kept and reported alike; an empty benchmark hits
    nothing, and an empty table gives none.

    The set is broadcast with the scan. Its size is checked: a benchmark of more bytes
    than max_block_chars is cut into blocks by a hash of the item id, each is broadcast in turn
    and the hits are merged, so the worker never holds more than a block: about 5 bytes for each of
    its bytes, and its different words.
    """
    b = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.col("text").cast("binary").alias("t")).where("t is not null")
    total = b.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = -(-total // max_block_chars) or 1
    keep = [c for c in keep or ["doc_id", "text"] if c not in ("n_words", "spans", "items")]
    found = docs.select(
        *keep,
        *([] if "text" in keep else ["text"]),
        F.lit(0).cast("long").alias("n_words"),
        F.expr("cast(array() as array<struct<start:long,end:long>>)").alias("spans"),
        F.expr("cast(array() as array<string>)").alias("items"),
    )
    schema, names = found.schema, found.columns
    for k in range(blocks):
        part = b if blocks == 1 else b.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k)
        windows = docs.sparkSession.sparkContext.broadcast(Windows([(r["item"], bytes(r["t"])) for r in part.toLocalIterator()], n))

        def scan(batches: Iterator[pa.RecordBatch], windows=windows) -> Iterator[pa.RecordBatch]:
            w = windows.value
            for batch in batches:
                got = [w.scan(t) for t in raw_bytes(batch.column("text"))]
                spans, items = [g[1] for g in got], [sorted(g[2]) for g in got]
                if blocks > 1:
                    spans = [_merge(s + [(x["start"], x["end"]) for x in old]) for s, old in zip(spans, batch.column("spans").to_pylist(), strict=True)]
                    items = [sorted({*i, *old}) for i, old in zip(items, batch.column("items").to_pylist(), strict=True)]
                new = [pa.array([g[0] for g in got], pa.int64()), pa.array([[{"start": s, "end": e} for s, e in x] for x in spans], _SPANS), pa.array(items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names) - 3)), *new], names=names)

        found = found.mapInArrow(scan, schema)
        if k + 1 < blocks:
            found = cut(found)
    return found
