"""SimHash near-duplicates: fingerprints dealt out by equal pieces, vantage-point trees in the shards.

Two fingerprints that differ in few bits agree in some piece of theirs, so those that share a
piece's value meet in a shard, and each fingerprint is dealt out once for each piece, however
many there are. In a shard a tree of vantage points partitions the fingerprints by Hamming
distance, leaves out branches by the triangle inequality, and lets a branch see those beyond its
boundary that are within the radius. A piece's value that very many fingerprints share is split
into shards by the top of such a tree; fingerprints near a boundary visit the shards beyond it.

Near copies of the pipeline: fingerprints find loose families this way, and the exact similarity
of shingle sets is then counted within them, see similar_classes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verishelf.llm._common import Links, components, cut, lookup, raw_bytes, slices

_U8, _U64 = np.uint8, np.uint64
_BITS = np.unpackbits(np.arange(256, dtype=_U8)[:, None], axis=1, bitorder="little").astype(np.int64)


# ---- fingerprints ---------------------------------------------------------------------------


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """XXH64 (seed 42) of each k-word shingle; fewer words are one shingle, none give none."""
    if not words:
        return np.zeros(0, dtype=_U64)
    text, f = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= k:
        return np.array([f(text, 42)], dtype=_U64)
    lens = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lens + 1) - 1
    starts = (ends - lens)[: len(words) - k + 1].tolist()
    return np.fromiter((f(text[a:b], 42) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)), dtype=_U64, count=len(starts))


def majority(hashes: np.ndarray) -> int:
    """The 64-bit word whose bits are those set in over half of the hashes."""
    n = len(hashes)
    if not n:
        return 0
    octets = np.ascontiguousarray(hashes).view(_U8).reshape(n, 8)
    if n < 300:
        count = np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        count = np.concatenate([np.bincount(octets[:, i], minlength=256) @ _BITS for i in range(8)])
    return int(np.packbits(count * 2 > n, bitorder="little").view(_U64)[0])


def _mixed(h: np.ndarray, j: int) -> np.ndarray:
    """The j-th further 64-bit hash of each hash (a finalizer with another constant)."""
    h = (h + _U64((0x9E3779B97F4A7C15 * (j + 1)) & (2**64 - 1))) * _U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U64(29))) * _U64(0x94D049BB133111EB)
    return h ^ (h >> _U64(32))


@dataclass(frozen=True)
class Table:
    """Codes meet by the equal `bits` bits of `word` at `shift`; the tree runs over `band_bits` bits of it at `band`."""

    word: int
    shift: int
    bits: int
    band: int
    band_bits: int


@dataclass(frozen=True)
class Scheme:
    """What is linked: `code` gives a text's words of 64 bits; `tables` say which codes meet.

    Links: codes that meet in a table and agree in its band but for `radius` bits, and in the
    words from `verify` on but for `limit` bits. A loose scheme only finds candidates: where more
    codes meet than a shard takes, it links them all.
    """

    n_words: int
    code: Callable[[list[bytes]], list[int]]
    tables: tuple[Table, ...]
    radius: int
    verify: int
    limit: int
    loose: bool = False


def _code3(words: list[bytes]) -> list[int]:
    return [majority(shingle_hashes(words, 3))]


#: 3-word shingles; 64 bits of which 3 may differ, so that one of four quarters is equal.
THREE_BITS = Scheme(1, _code3, tuple(Table(0, k, 16, 0, 64) for k in (0, 16, 32, 48)), 3, 1, 0)


def _family_code(words: list[bytes]) -> list[int]:
    pairs, fives = np.unique(shingle_hashes(words, 2)), np.unique(shingle_hashes(words, 5))
    return [majority(_mixed(pairs, j)) for j in range(8)] + [majority(_mixed(fives, j)) for j in range(2)]


#: Candidates for a similarity of 0.8 on sets of five-word shingles. A pair of Jaccard similarity J has
#: the cosine 2J / (1 + J), and each of its bits differs with probability arccos(cosine) / pi: 0.151
#: at 0.8. 24 bands of 21 bits of two-word shingles: a band agrees but for one bit in 15 of 100
#: cases if an edit is one block, one of 24 in 98 of 100, and in 40 of 100 and nearly always if edits
#: are scattered words, which disturb two-word shingles less (0.093). A half of such a band is equal. 128 bits of
#: five-word shingles then sort out chance: 19 differ on average at 0.8, more in very short texts, 64 by chance.
FAMILIES = Scheme(10, _family_code, tuple(Table(w, 21 * k + h, 10 + (h > 0), 21 * k, 21) for w in range(8) for k in range(3) for h in (0, 10)), 1, 8, 38, loose=True)


def _part(words: np.ndarray, word: int, shift: int, bits: int) -> np.ndarray:
    return words[:, word] >> _U64(shift) & _U64((1 << bits) - 1)


# ---- trees ----------------------------------------------------------------------------------


def build_top(sample: np.ndarray, depth: int) -> list[tuple[int, int]]:
    """A tree of (vantage point, median distance) in heap order, 2^depth leaves below it."""
    nodes: list[tuple[int, int]] = [(0, 0)] * (2**depth - 1)

    def grow(i: int, points: np.ndarray) -> None:
        if i >= len(nodes):
            return
        if len(points):
            point = points[len(points) // 3]
            d = np.bitwise_count(points ^ point)
            cutoff = int(np.median(d))
            cutoff = cutoff - 1 if cutoff == d.max() and cutoff else cutoff
            nodes[i] = (int(point), cutoff)
            grow(2 * i + 1, points[d <= cutoff])
            grow(2 * i + 2, points[d > cutoff])
        else:
            grow(2 * i + 1, points)
            grow(2 * i + 2, points)

    grow(0, np.unique(sample))
    return nodes


def route(nodes: list[tuple[int, int]], words: np.ndarray, radius: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """For each leaf: its number, the indexes of the words there, whether each is at home."""
    out: list[tuple[int, np.ndarray, np.ndarray]] = []
    todo = [(0, np.arange(len(words)), np.ones(len(words), dtype=bool))]
    while todo:
        i, at, home = todo.pop()
        if not len(at):
            continue
        if i >= len(nodes):
            out.append((i - len(nodes), at, home))
            continue
        point, cutoff = nodes[i]
        d = np.bitwise_count(words[at] ^ _U64(point)).astype(np.int64)
        for child, there, own in ((2 * i + 1, d <= cutoff + radius, d <= cutoff), (2 * i + 2, d > cutoff - radius, d > cutoff)):
            todo.append((child, at[there], (home & own)[there]))
    return out


def link_shard(words: np.ndarray, homes: np.ndarray, visitors: np.ndarray, band: np.ndarray, radius: int, verify: int, limit: int, links: Links, leaf: int = 512, block: int = 1 << 20) -> None:
    """Join all pairs of a home and a home or visitor that the scheme links.

    Goes down a vantage-point tree; in a leaf, pairs whose labels are equal already are passed
    over, so that a dense group costs about one row of comparisons for each of its codes.
    """
    todo = [(homes, np.concatenate([homes, visitors]))]
    while todo:
        own, all_ = todo.pop()
        if not len(own) or not len(all_):
            continue
        if len(own) > leaf:
            point = band[own[len(own) // 2]]
            d = np.bitwise_count(band[own] ^ point).astype(np.int64)
            if d.min() < d.max():
                cutoff = min(int(np.median(d)), int(d.max()) - 1)
                e = np.bitwise_count(band[all_] ^ point).astype(np.int64)
                todo.append((own[d <= cutoff], all_[e <= cutoff + radius]))
                todo.append((own[d > cutoff], all_[e > cutoff - radius]))
                continue
        at, many = 0, 1  # one row first: it joins most of a dense group
        while at < len(own):
            rows = own[at : at + many]
            at += len(rows)
            many = min(leaf, max(1, block // len(all_))) if at > 1 else 16
            shown = links.label[rows]
            others = all_[links.label[all_] != shown[0]] if (shown == shown[0]).all() else all_
            if not len(others):
                continue
            near = np.bitwise_count(band[rows][:, None] ^ band[others][None, :]) <= radius
            i, j = np.nonzero(near)
            i, j = rows[i], others[j]
            keep = links.label[i] != links.label[j]
            i, j = i[keep], j[keep]
            for lo in range(0, len(i), block):
                a, b = i[lo : lo + block], j[lo : lo + block]
                ok = np.bitwise_count(words[a][:, verify:] ^ words[b][:, verify:]).sum(axis=1, dtype=np.int64) <= limit
                links.join(a[ok], b[ok])


# ---- Spark ----------------------------------------------------------------------------------


def fingerprints(docs: DataFrame, scheme: Scheme, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs and code: the scheme's words of the text, 8 bytes each, big-endian.

    Null and empty texts have no words, and so the code zero.
    """
    ready = docs.select(*keep, F.col("text").alias("_simhash_text"))
    kinds = dict(ready.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [np.array(scheme.code((t or b"").lower().split()), dtype=">u8").tobytes() for t in raw_bytes(batch.column("_simhash_text"))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(codes, pa.binary())], names=[*keep, "code"])

    return ready.mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), "code binary"]))


def _words(column: pa.Array, n_words: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=">u8").astype(_U64).reshape(-1, n_words)


def link_rows(key: np.ndarray, home: np.ndarray, band: np.ndarray, verify: np.ndarray, radius: int, limit: int, leaf: int = 64) -> np.ndarray:
    """A label for each row: rows of one key that the scheme links get one, the smallest row's number.

    Rows come sorted by key. Keys with up to `leaf` rows are leaves, and compared together; the
    others go down a tree each. Rows that are not at home in their key are not compared with one another.
    """
    links = Links(len(key))
    first, many = _runs(key)
    rank = np.arange(len(key)) - first
    a_, b_, held = [], [], 0
    at = np.flatnonzero((many > 1) & (many <= leaf))
    for k in range(1, leaf):
        at = at[rank[at] + k < many[at]]
        if not len(at):
            break
        near = at[np.bitwise_count(band[at] ^ band[at + k]) <= radius]
        near = near[(home[near] | home[near + k]) & (np.bitwise_count(verify[near] ^ verify[near + k]).sum(axis=1, dtype=np.int64) <= limit)]
        a_.append(near)
        b_.append(near + k)
        held += len(near)
    if held:
        links.join(np.concatenate(a_), np.concatenate(b_))
    for lo in np.unique(first[many > leaf]).tolist():
        rows = np.arange(lo, lo + many[lo])
        link_shard(verify, rows[home[rows]], rows[~home[rows]], band, radius, 0, limit, links)
    return links.label


def link_codes(codes: DataFrame, scheme: Scheme, *, shard_rows: int = 20_000, sample: int = 1 << 18) -> DataFrame:
    """Components of codes. codes: node (long, unique), code (binary, distinct). Returns (node, root).

    Only nodes with a link are returned. Groups of equal codes must have been folded before:
    they are one node here. Each code is dealt out once for each table, by the value of the table's piece. Values are
    counted first: those with over shard_rows codes, and over four times the mean, are at most a quarter of
    all values. Their codes are dealt on to shards by the top of a tree of their own (built from at
    most about `sample` codes for all trees), and to those beyond a boundary as visitors; a loose
    scheme links them to their smallest node instead, with no shuffle. Shards return spanning forests
    (node, smallest node), as many rows at most as they have codes, and no list of pairs.
    """
    tables, radius, n_words, verify, limit = scheme.tables, scheme.radius, scheme.n_words, scheme.verify, scheme.limit
    keys = sum(1 << t.bits for t in tables)
    names = ["key", "home", "node", "band", *(f"v{k}" for k in range(n_words - verify))]
    schema = ", ".join(f"{c} {'boolean' if c == 'home' else 'long'}" for c in names)
    context = codes.sparkSession.sparkContext

    def dealt(tops: dict[int, list[tuple[int, int]]], lows: dict[int, int], wide: bool = True) -> DataFrame:
        held = context.broadcast((tops, lows))

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trees, stars = held.value
            special = np.array(sorted({*trees, *stars}), dtype=np.int64)
            for batch in slices(batches, 5000):
                node, words = batch.column("node").to_numpy(), _words(batch.column("code"), n_words)

                def rows(key: np.ndarray, home: np.ndarray, at: np.ndarray, band: np.ndarray, node: np.ndarray = node, words: np.ndarray = words) -> pa.RecordBatch:
                    columns = [key, home, node[at], band[at].view(np.int64), *(words[at, k].view(np.int64) for k in range(verify, n_words))]
                    return pa.RecordBatch.from_arrays([pa.array(c) for c in (columns if wide else columns[:3])], names=names if wide else names[:3])

                for k, t in enumerate(tables):
                    key = k << 16 | _part(words, t.word, t.shift, t.bits).astype(np.int64)
                    band = _part(words, t.word, t.band, t.band_bits) if t.band_bits < 64 else np.ascontiguousarray(words[:, t.word])
                    hot = np.isin(key, special)
                    cold = np.flatnonzero(~hot)
                    yield rows(key[cold], np.ones(len(cold), dtype=bool), cold, band)
                    for value in np.unique(key[hot]).tolist():
                        at = np.flatnonzero(key == value)
                        if value in stars:  # an edge: from the band's place to the node's
                            low = np.full(len(node), stars[value], dtype=np.int64).view(_U64)
                            yield rows(np.full(len(at), -1), np.ones(len(at), dtype=bool), at, low)
                        else:
                            for shard, there, home in route(trees[value], band[at], radius):
                                yield rows(np.full(len(there), value | shard + 1 << 32), home, at[there], band)

        return codes.select("node", "code").mapInArrow(deal, schema if wide else "key long, home boolean, node long")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, home, node, band, *v in _by_token(batches, names):
            if len(key):
                code = np.stack(v, axis=1).view(_U64) if v else np.zeros((len(key), 0), dtype=_U64)
                label = link_rows(key, home, band.view(_U64), code, radius, limit)
                at = np.flatnonzero(label != np.arange(len(key)))
                yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(node[label[at]])], names=["a", "b"])

    n = codes.count()
    most = max(shard_rows, 4 * n * len(tables) // keys)
    hot = dealt({}, {}, False).groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("low")).where(F.col("n") > most).collect() if n > most else []
    tops: dict[int, list[tuple[int, int]]] = {}
    lows = {r["key"]: r["low"] for r in hot} if scheme.loose else {}
    if hot and not scheme.loose:
        each = max(16, sample // len(hot))
        sizes = {r["key"]: r["n"] for r in hot}
        some = codes.sparkSession.createDataFrame([(k, max(1, m // each)) for k, m in sizes.items()], "key long, every long")
        drawn = dealt({}, {}).join(F.broadcast(some), "key").where(F.pmod(F.xxhash64("node"), F.col("every")) == 0).select("key", "band").toArrow()
        key, band = drawn.column("key").to_numpy(), drawn.column("band").to_numpy().view(_U64)
        tops = {k: build_top(band[key == k], math.ceil(math.log2(m / most)) + 1) for k, m in sizes.items()}
    rows = dealt(tops, lows)
    shards = rows.where("key >= 0") if lows else rows
    edges = shards.repartition("key").sortWithinPartitions("key", "node").mapInArrow(link, "a long, b long")
    if lows:
        edges = edges.unionAll(rows.where("key < 0").select(F.col("node").alias("a"), F.col("band").alias("b")))
    return components(edges)


def simhash_classes(docs: DataFrame, scheme: Scheme = THREE_BITS, *, id_col: str = "doc_id") -> DataFrame:
    """One row per row of docs: id_col, code, component_id.

    Texts whose codes (of one word) the scheme links, directly or over others, share a component;
    component_id is the smallest id_col among them, nulls left out. Equal codes are folded before any pair is
    looked at, so a group of copies costs one code. Null and empty texts all have the code zero
    and are linked like any other. Repeated rows share everything. Other columns don't matter; an empty table gives none.
    """
    prints = cut(fingerprints(docs.select(F.col(id_col), "text"), scheme, [id_col]))
    classes = prints.groupBy("code").agg(F.min(id_col).alias("low"), F.count("*").alias("m"))
    classes = cut(classes.withColumn("node", F.conv(F.hex("code"), 16, -10).cast("long")))
    labelled = classes.join(link_codes(classes, scheme), "node", "left").select("code", "low", "m", F.coalesce("root", "node").alias("root"))
    lows = labelled.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("k"))
    found = cut(lookup(labelled, lows, "root", "k").select("code", "m", "component_id"))
    return lookup(prints, found, "code", "m").select(id_col, "code", "component_id")


# ---- exact similarity -----------------------------------------------------------------------

#: Of each shared shingle's texts, those from the first to the second number are compared with
#: all after them in one round; a round leaves out pairs that the rounds before have connected. Texts
#: with the fewest rarer shingles come first: the least changed of a group of variants, to which most are close.
HUBS = ((0, 2), (2, 16), (16, 1 << 62))


def shingle_set(text: bytes) -> np.ndarray:
    """The sorted hashes of a text's different five-word shingles, letters of ASCII in lower case."""
    return np.unique(shingle_hashes(text.lower().split(), 5))


def _common_shingles(sets: DataFrame, n: int, texts: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several of about `texts` of the n sets have, sorted, and their counts."""
    every = max(1, n // texts)
    picked = sets.where(F.pmod(F.xxhash64(F.lit(2), "node"), F.lit(every)) == 0).select("hashes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(batch.column("hashes").to_pylist()), dtype=np.int64))], names=["token"])

    counts = picked.mapInArrow(run, "token long").groupBy("token").count().where("count > 1")
    least = 1  # a count that at most `most` shingles exceed, from how many there are of each count
    above = 0
    for r in counts.groupBy(F.least("count", F.lit(1000)).alias("c")).agg(F.count("*").alias("k")).orderBy(F.desc("c")).collect():
        above += r["k"]
        if above > most:
            least = r["c"]
            break
    got = counts.where(F.col("count") > least).toArrow()
    token, count = got.column("token").to_numpy().view(_U64), got.column("count").to_numpy()
    order = np.argsort(token)
    return token[order], count[order]


def prefix_of(hashes: np.ndarray, common: tuple[np.ndarray, np.ndarray], num: int, den: int) -> np.ndarray:
    """The rarest shingles of a set, most rare first: two sets of similarity num / den share one there."""
    token, count = common
    rare = np.zeros(len(hashes), dtype=np.int64)
    if len(token):
        at = np.minimum(np.searchsorted(token, hashes), len(token) - 1)
        rare = np.where(token[at] == hashes, count[at], 0)
    n = len(hashes)
    return hashes[np.lexsort((hashes, rare))][: n - -(-num * n // den) + 1 if n else 0]


def _runs(token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of a sorted column: where its run begins, and the run's length."""
    first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    sizes = np.diff(np.concatenate([first, [len(token)]]))
    return np.repeat(first, sizes), np.repeat(sizes, sizes)


def _by_token(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[np.ndarray]]:
    """The columns of batches sorted by the first of them, cut between its values only."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        if now[0][-1] != now[0][0] or (held and held[-1][0][-1] != now[0][0]):
            first = int(np.searchsorted(now[0], now[0][-1]))
            yield [np.concatenate([*(h[i] for h in held), c[:first]]) for i, c in enumerate(now)]
            held = [[c[first:] for c in now]]
        else:
            held.append(now)
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def hub_pairs(token: np.ndarray, node: np.ndarray, size: np.ndarray, pos: np.ndarray, label: np.ndarray, hubs: tuple[int, int], num: int, den: int, block: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of a token whose first is one of its `hubs`, whose labels differ and whose sets can be similar.

    If the token is the first that two sets share, what follows it in the shorter rest bounds
    what they have in common; every similar pair passes at the first one.
    """
    start, many = _runs(token)
    rank, held, a_, b_ = np.arange(len(token)) - start, 0, [], []
    alive = np.flatnonzero(many > hubs[0] + 1)
    k = hubs[0]
    while len(alive) and k < hubs[1]:
        alive = alive[rank[alive] > k]
        hub = start[alive] + k
        both = size[hub] + size[alive]
        ok = (label[hub] != label[alive]) & (den * np.minimum(size[hub], size[alive]) >= num * np.maximum(size[hub], size[alive]))
        ok &= (num + den) * np.minimum(size[hub] - pos[hub], size[alive] - pos[alive]) >= num * both
        a_.append(node[hub[ok]])
        b_.append(node[alive[ok]])
        held += int(ok.sum())
        if held > block:
            yield np.concatenate(a_), np.concatenate(b_)
            held, a_, b_ = 0, [], []
        k += 1
    if held:
        yield np.concatenate(a_), np.concatenate(b_)


def _can_pair(token: np.ndarray, node: np.ndarray, size: np.ndarray, pos: np.ndarray, num: int, den: int, near: int = 16) -> np.ndarray:
    """Rows that hub_pairs may put into a pair; for tokens with more than `near` rows, all of them."""
    at = _runs(token)[1] > near
    for k in range(1, near):
        a = np.flatnonzero(token[k:] == token[:-k]) if len(token) > k else np.zeros(0, dtype=np.int64)
        small, large = np.minimum(size[a], size[a + k]), np.maximum(size[a], size[a + k])
        a = a[(den * small >= num * large) & ((num + den) * np.minimum(size[a] - pos[a], size[a + k] - pos[a + k]) >= num * (small + large))]
        at[a] = at[a + k] = True
    return at


def similar_classes(docs: DataFrame, *, num: int = 4, den: int = 5, id_col: str = "doc_id", sample: int = 20_000, most_common: int = 1 << 18, scheme: Scheme = FAMILIES) -> DataFrame:
    """One row per different set of shingles: node, first (id, t1, t2), m, root, component_id.

    Texts are near copies if the Jaccard similarity of their sets of five-word shingles is num / den or
    more. Equal sets are folded first: m rows of docs have this one, `first` is the smallest of their
    (null, id_col, two hashes of the text). Texts without words have the empty set, and are copies of
    each other. Fingerprints find families of sets that may be similar (see FAMILIES); within these
    every link is by exact count, and none is lost: shingles have one order, and similar sets share
    one of their first. A sample makes that order go from rare to common, so that a template's
    shingles come last; it decides on work alone. Sets linked directly or over others share a root,
    and component_id is the smallest id_col among them, nulls left out.
    """
    ids = docs.select(F.col(id_col), "text").select(F.col(id_col).alias(id_col), "text", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"))
    kind = dict(ids.dtypes)[id_col]

    def prints_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            node, code = [], []
            for t in raw_bytes(batch.column("text")):
                words = (t or b"").lower().split()
                node.append(xxhash.xxh64_intdigest(np.unique(shingle_hashes(words, 5)).tobytes()) - 2**63)
                code.append(np.array(scheme.code(words), dtype=">u8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(id_col), batch.column("t1"), batch.column("t2"), pa.array(node, pa.int64()), pa.array(code, pa.binary())], names=[id_col, "t1", "t2", "node", "code"])

    prints = ids.mapInArrow(prints_of, f"`{id_col}` {kind}, t1 long, t2 long, node long, code binary")
    own = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), "t1", "t2")
    classes = cut(prints.groupBy("node").agg(F.min(own).alias("first"), F.count("*").alias("m"), F.first("code").alias("code")))
    families = link_codes(classes, scheme)
    some = classes.join(families.select("node"), "node", "left_semi").select("node", F.col("first.id").alias("_id"), F.col("first.t1").alias("t1"), F.col("first.t2").alias("t2"))
    some = some.withColumnsRenamed({"t1": "_1", "t2": "_2"})
    wanted = ids.join(some, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("t1") == F.col("_1")) & (F.col("t2") == F.col("_2"))).select("node", "text")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([shingle_set(t or b"").tobytes() for t in raw_bytes(batch.column("text"))], pa.binary())], names=["node", "hashes"])

    sets = cut(wanted.mapInArrow(sets_of, "node long, hashes binary").dropDuplicates(["node"]))
    n_sets = sets.count()
    common = docs.sparkSession.sparkContext.broadcast(_common_shingles(sets, n_sets, sample, most_common))

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hashes = [np.frombuffer(h, dtype=_U64) for h in batch.column("hashes").to_pylist()]
            tokens = [prefix_of(h, common.value, num, den).view(np.int64) for h in hashes]
            many = np.array([len(t) for t in tokens], dtype=np.int64)
            size = np.array([len(h) for h in hashes], dtype=np.int64)
            pos = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *tokens])), *(pa.array(np.repeat(c, many)) for c in (batch.column("node").to_numpy(), size)), pa.array(pos)], names=["token", "node", "size", "pos"])

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["token", "node", "size", "pos"]
        for columns in _by_token(batches, names):
            if len(columns[0]):
                at = _can_pair(*columns, num, den)
                yield pa.RecordBatch.from_arrays([pa.array(c[at]) for c in columns], names=names)

    dealt = sets.mapInArrow(postings, "token long, node long, size long, pos long")
    shared = cut(dealt.repartition("token").sortWithinPartitions("token", "node").mapInArrow(several, "token long, node long, size long, pos long"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ok = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, dtype=_U64), np.frombuffer(y, dtype=_U64)
                ok.append((num + den) * len(np.intersect1d(x, y, assume_unique=True)) >= num * (len(x) + len(y)))
            at = pa.array(np.flatnonzero(ok))
            yield pa.RecordBatch.from_arrays([batch.column("a").take(at), batch.column("b").take(at)], names=["a", "b"])

    edges, roots = None, shared.select("node", F.col("node").alias("root")).limit(0)
    for hubs in HUBS:

        def emit(batches: Iterator[pa.RecordBatch], hubs: tuple[int, int] = hubs) -> Iterator[pa.RecordBatch]:
            for columns in _by_token(batches, ["token", "node", "size", "pos", "label"]):
                for a, b in hub_pairs(*columns, hubs, num, den) if len(columns[0]) else ():
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        labelled = shared.join(roots, "node", "left").select("token", "node", "size", "pos", F.coalesce("root", "node").alias("label"))
        pairs = cut(labelled.repartition("token").sortWithinPartitions("token", "pos", "node").mapInArrow(emit, "a long, b long").distinct())
        if not (many := pairs.count()):
            continue
        x, y = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
        if many <= min(n_sets // 4, 500_000):  # few pairs go to the sets, which stay where they are
            both = x.join(F.broadcast(pairs), "a").join(y.join(F.broadcast(pairs), "b"), ["a", "b"])
        else:
            both = pairs.join(x, "a").join(y, "b")
        found = cut(both.select("a", "b", "x", "y").mapInArrow(check, "a long, b long"))
        if not found.isEmpty():
            edges = found if edges is None else edges.unionAll(found)
            roots = components(edges)
    labels = cut(classes.select("node", "first", "m").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    lows = labels.groupBy("root").agg(F.min("first.id").alias("component_id"), F.count("*").alias("k"))
    return lookup(labels, lows, "root", "k").select("node", "first", "m", "root", "component_id")


def near_copy_classes(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """id_col and component_id of every row of docs; options: see similar_classes."""
    classes = similar_classes(docs, id_col=id_col, **options).select("node", "m", "component_id")
    kind = dict(docs.dtypes)[id_col]

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([xxhash.xxh64_intdigest(shingle_set(t or b"").tobytes()) - 2**63 for t in raw_bytes(batch.column("text"))], pa.int64())], names=[id_col, "node"])

    rows = docs.select(F.col(id_col), "text").mapInArrow(nodes, f"`{id_col}` {kind}, node long")
    return lookup(rows, cut(classes), "node", "m").select(id_col, "component_id")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of near copies: that with the smallest doc_id.

    Near copies: five-word shingles of an exact Jaccard similarity of 0.8 or more, and chains
    of such pairs. Columns stay. Null doc_ids come last in a group; of different texts with the
    smallest doc_id, that of the smaller hash stays, and of repeated rows that with the smaller hash of
    all columns. Texts without words are copies of each other. An empty table gives none.
    """
    best = similar_classes(docs).groupBy("root").agg(F.min("first").alias("w"))
    winners = cut(best.select(F.col("root").alias("_sh_root"), F.col("w.id").alias("_sh_id"), F.col("w.t1").alias("_sh_1"), F.col("w.t2").alias("_sh_2")))
    names = docs.columns
    on = F.col("doc_id").eqNullSafe(F.col("_sh_id")) & (F.xxhash64("text") == F.col("_sh_1")) & (F.xxhash64(F.lit(1), "text") == F.col("_sh_2"))
    kept = docs.join(winners, on)
    if docs.select("doc_id", "text").join(winners, on).groupBy("_sh_root").count().where("count > 1").isEmpty():
        return kept.select(*names)
    plain = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind]
    row = F.struct(*(F.col(f"`{c}`") for c in names))
    return kept.groupBy("_sh_root").agg(F.min_by(row, F.struct(F.xxhash64(*plain), F.xxhash64(F.lit(1), *plain))).alias("row")).select("row.*")
