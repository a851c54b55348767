"""Removal of repeated byte strings: content-defined shards, a two-stage suffix array in each.

Every window of `length` bytes belongs to an anchor: its k-gram of the smallest hash. Equal
windows have equal anchors at equal offsets, so windows that share an anchor meet in a shard
and no others need to. A run of windows with one anchor is a segment. Equal segments are folded
first; the different segments of an anchor are laid end to end and sorted as suffixes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verishelf.llm._common import cut, lookup, raw_bytes, slices

GRAM = 16
#: Bits of a segment's number of windows; a segment has length - GRAM + 1 of them at most.
COUNT_BITS = 20
_U64 = np.uint64
#: Windows of a text that are handled at once; positions fit in 24 bits.
PIECE = 1 << 22


# ---- the suffix array -----------------------------------------------------------------------


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of text, sorted by their first `depth` bytes at least; zeros end strings.

    Two stages. Suffixes smaller than their successors are sorted directly, by eight bytes at a
    time within the groups that are still tied. The rest is induced: buckets (first bytes) are
    scanned in order, and a suffix that is found puts the one before it at the front of its own
    bucket, if that is larger. Within a bucket, runs of its byte come in waves.
    """
    n = len(text)
    step = np.zeros(n, dtype=np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1].astype(np.int16))
    at = np.where(step != 0, np.arange(n, dtype=np.int32), np.int32(n - 1))
    at = np.minimum.accumulate(at[::-1])[::-1]
    small = (step[at] > 0) & (text > 0)
    del at, step

    words = _words(text, depth)
    direct = np.flatnonzero(small).astype(np.int32)
    direct = direct[np.argsort(words[direct], kind="stable")]
    group = np.concatenate([[0], np.cumsum(words[direct[1:]] != words[direct[:-1]])]).astype(np.int32) if len(direct) else np.zeros(0, dtype=np.int32)
    for skip in range(8, depth, 8):
        tied = np.zeros(len(direct), dtype=bool)
        tied[1:] = group[1:] == group[:-1]
        tied[:-1] |= tied[1:]
        slots = np.flatnonzero(tied)
        if not len(slots):
            break
        more = words[direct[slots] + skip]
        order = np.lexsort((more, group[slots]))
        direct[slots] = direct[slots[order]]
        more, same = more[order], group[slots]
        split = np.zeros(len(direct), dtype=bool)
        split[slots[1:]] = (same[1:] != same[:-1]) | (more[1:] != more[:-1])
        split[0] = True
        split[1:] |= group[1:] != group[:-1]
        group = np.cumsum(split, dtype=np.int32)

    begin = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=256))])
    own = np.concatenate([[0], np.cumsum(np.bincount(text[direct], minlength=256))])
    sa, front = np.empty(n, dtype=np.int32), begin[:-1].copy()
    del words

    def put(before: np.ndarray) -> None:
        keys = text[before]
        order = np.argsort(keys, kind="stable")
        before, keys = before[order], keys[order]
        edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])).tolist() + [len(keys)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            c = keys[a]
            sa[front[c] : front[c] + b - a] = before[a:b]
            front[c] += b - a

    sa[: begin[1]] = np.flatnonzero(text == 0)
    for c in range(256):
        if begin[c] == begin[c + 1]:
            continue
        lo = begin[c]
        while c and lo < front[c]:
            hi = front[c]
            before = sa[lo:hi] - 1
            before = before[before >= 0]
            before = before[text[before] == c]
            sa[hi : hi + len(before)] = before
            front[c] = hi + len(before)
            lo = hi
        if c:
            sa[front[c] : begin[c + 1]] = direct[own[c] : own[c + 1]]
        before = sa[begin[c] : begin[c + 1]] - 1
        before = before[before >= 0]
        before = before[text[before] > c]
        if len(before):
            put(before)
    return sa


def _words(text: np.ndarray, depth: int) -> np.ndarray:
    """The eight bytes from each position as a big-endian number; zeros follow the text."""
    padded = np.concatenate([text, np.zeros(depth + 16, dtype=np.uint8)])
    out = np.zeros(len(padded) - 8, dtype=_U64)
    for k in range(8):
        out <<= _U64(8)
        out |= padded[k : k + len(out)]
    return out


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For each position of order but the first: whether `depth` bytes agree with the one before."""
    words, same = _words(text, depth), np.ones(max(0, len(order) - 1), dtype=bool)
    for skip in range(0, depth, 8):
        shift = _U64(8 * max(0, skip + 8 - depth))
        x = words[order + skip] >> shift
        same &= x[1:] == x[:-1]
    return same


def repeated_windows(segments: list[bytes], doc: np.ndarray, start: np.ndarray, count: np.ndarray, length: int) -> np.ndarray:
    """Windows of the segments that also start earlier in another: a mask over all windows in order.

    Segment i holds count[i] windows, which start at start[i] and on in document doc[i].
    """
    text = np.frombuffer(b"\0".join(s.replace(b"\0", b"\xff") for s in segments) + b"\0", dtype=np.uint8)
    sizes = np.array([len(s) for s in segments], dtype=np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    owner = np.repeat(np.arange(len(segments)), count)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    number = np.full(len(text), -1, dtype=np.int32)
    number[begins[owner] + offset] = np.arange(len(owner))
    order = suffix_array(text, length)
    order = order[number[order] >= 0]
    group = np.concatenate([[0], np.cumsum(~common_prefixes(text, order, length))])
    window = number[order]
    by = np.lexsort((start[owner[window]] + offset[window], doc[owner[window]], group))
    window, group = window[by], group[by]
    out = np.zeros(len(owner), dtype=bool)
    out[window[1:][group[1:] == group[:-1]]] = True
    return out


# ---- segments -------------------------------------------------------------------------------


def segments_of(text: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments of a text: first window start, number of windows, anchor hash."""
    firsts, counts, anchors = [], [], []
    for base in range(0, max(0, len(text) - length + 1), PIECE):
        piece = np.frombuffer(text, dtype=np.uint8)[base : base + PIECE + length - 1]
        eight = np.lib.stride_tricks.as_strided(piece, (len(piece) - 7, 8), (1, 1)).copy().view(_U64).ravel()
        h = eight[: len(piece) - GRAM + 1] * _U64(0x9E3779B97F4A7C15) + eight[8 : len(piece) - GRAM + 9]
        h = (h ^ (h >> _U64(32))) * _U64(0xD6E8FEB86659FD93)
        h ^= h >> _U64(29)
        low = (h >> _U64(24) << _U64(24)) | np.arange(len(h), dtype=_U64)
        width, span = length - GRAM + 1, 1
        while span * 2 <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < width:
            low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
        at = (low & _U64(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        firsts.append(first + base)
        counts.append(np.diff(np.concatenate([first, [len(at)]])))
        anchors.append(h[at[first]].view(np.int64))
    if not firsts:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    return np.concatenate(firsts), np.concatenate(counts), np.concatenate(anchors)


def _pack(first: np.ndarray, count: np.ndarray, known: np.ndarray | int = 0) -> np.ndarray:
    return first << COUNT_BITS + 1 | count << 1 | known


def _segments(docs: DataFrame, length: int) -> DataFrame:
    """anchor, print, doc, at (packed): a row for each segment; `known`: it repeats one of its batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = xxhash.xxh64_intdigest
        for batch in slices(batches):
            docs_, texts = batch.column("doc").to_numpy(), raw_bytes(batch.column("text"))
            lo = 0
            while lo < len(texts):
                hi, held = lo, 0
                while hi < len(texts) and held < 1 << 21:
                    held += len(texts[hi] or b"")
                    hi += 1
                parts = [(i, *segments_of(texts[i] or b"", length)) for i in range(lo, hi)]
                lo = hi
                parts = [p for p in parts if len(p[1])]
                if not parts:
                    continue
                first, count, anchor = (np.concatenate([p[k] for p in parts]) for k in (1, 2, 3))
                doc = np.repeat(docs_[[p[0] for p in parts]], [len(p[1]) for p in parts])
                prints = np.fromiter((f(texts[i][a:b]) for i, s, n, _ in parts for a, b in zip(s.tolist(), (s + n + length - 1).tolist(), strict=True)), dtype=_U64, count=len(first)).view(np.int64)
                order = np.lexsort((first, doc, anchor, prints))
                p, a = prints[order], anchor[order]
                known = np.zeros(len(first), dtype=np.int64)
                known[order[1:][(p[1:] == p[:-1]) & (a[1:] == a[:-1])]] = 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.where(known, doc * 31 + first, anchor)), pa.array(anchor), pa.array(prints), pa.array(doc), pa.array(_pack(first, count, known))],
                    names=["key", "anchor", "print", "doc", "at"],
                )

    return docs.mapInArrow(run, "key long, anchor long, print long, doc long, at long")


def _fold(segments: DataFrame) -> DataFrame:
    """doc, at, anchor: segments that repeat an earlier one (anchor null), and the first ones of
    anchors that have several different segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((4, 0), dtype=np.int64)  # the last first segment, and whether its anchor had another before
        last = None
        more_before = False

        def out(doc: np.ndarray, at: np.ndarray, anchor: np.ndarray | None) -> pa.RecordBatch:
            keys = pa.nulls(len(doc), pa.int64()) if anchor is None else pa.array(anchor)
            return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(at), keys], names=["doc", "at", "anchor"])

        for batch in batches:
            anchor, prints, doc, at = (batch.column(c).to_numpy() for c in ("anchor", "print", "doc", "at"))
            known = (at & 1) == 1
            yield out(doc[known], at[known], None)
            anchor, prints, doc, at = anchor[~known], prints[~known], doc[~known], at[~known]
            if not len(anchor):
                continue
            new = np.ones(len(anchor), dtype=bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (prints[1:] != prints[:-1])
            if last is not None:
                new[0] = (anchor[0], prints[0]) != last
            last = (anchor[-1], prints[-1])
            yield out(doc[~new], at[~new], None)
            first = np.concatenate([held, np.stack([anchor[new], prints[new], doc[new], at[new]])], axis=1)
            if not first.shape[1]:
                continue
            same = first[0, 1:] == first[0, :-1]
            several = np.concatenate([[more_before], same]) | np.concatenate([same, [False]])
            yield out(first[2, :-1][several[:-1]], first[3, :-1][several[:-1]], first[0, :-1][several[:-1]])
            held, more_before = first[:, -1:], bool(several[-1])
        if held.shape[1] and more_before:
            yield out(held[2], held[3], held[0])

    return segments.repartition("key").sortWithinPartitions("anchor", "print", "doc", "at").mapInArrow(run, "doc long, at long, anchor long")


def _texts_of(firsts: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """key, print, doc, first, part: the bytes of first segments; where is_hot, two hashes of each window."""
    wanted = firsts.groupBy("doc").agg(F.collect_list(F.struct("anchor", "at", F.col("is_hot").alias("hot"))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "print", "doc", "first", "part"]
        for batch in slices(batches, 100):
            key, prints, doc, first, part, held = [], [], [], [], [], 0
            for d, t, row in zip(batch.column("doc").to_pylist(), raw_bytes(batch.column("text")), batch.column("parts"), strict=True):
                row = row.values
                for anchor, at, is_hot in zip(*(row.field(c).to_pylist() for c in ("anchor", "at", "hot")), strict=True):
                    at, n = at >> COUNT_BITS + 1, at >> 1 & (1 << COUNT_BITS) - 1
                    for s, m in [(at + i, 1) for i in range(n)] if is_hot else [(at, n)]:
                        text = t[s : s + m + length - 1]
                        key.append(xxhash.xxh64_intdigest(text) - 2**63 if is_hot else anchor)
                        prints.append(xxhash.xxh64_intdigest(text, 1) - 2**63 if is_hot else 0)
                        doc.append(d)
                        first.append(s)
                        part.append(None if is_hot else text)
                        held += len(text)
                    if held > 1 << 21:
                        yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (key, prints, doc, first)), pa.array(part, pa.binary())], names=names)
                        key, prints, doc, first, part, held = [], [], [], [], [], 0
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (key, prints, doc, first)), pa.array(part, pa.binary())], names=names)

    return docs.join(wanted, "doc").select("doc", "text", "parts").mapInArrow(run, "key long, print long, doc long, first long, part binary")


def _sorted_shards(parts: DataFrame, length: int, shard_bytes: int) -> DataFrame:
    """doc, first, count: runs of windows that start earlier elsewhere, among first segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, doc, first, part, held = [], [], [], [], 0

        def solve(n: int) -> pa.RecordBatch:
            d, s = np.array(doc[:n], dtype=np.int64), np.array(first[:n], dtype=np.int64)
            count = np.array([len(p) - length + 1 for p in part[:n]], dtype=np.int64)
            mask = repeated_windows(part[:n], d, s, count, length)
            start = np.repeat(s - (np.cumsum(count) - count), count) + np.arange(len(mask))
            at = np.flatnonzero(mask)
            owner = np.repeat(np.arange(n), count)[at]
            edge = np.ones(len(at), dtype=bool)
            edge[1:] = (np.diff(at) != 1) | (np.diff(owner) != 0)
            runs = np.flatnonzero(edge)
            return pa.RecordBatch.from_arrays([pa.array(d[owner[runs]]), pa.array(start[at[runs]]), pa.array(np.diff(np.concatenate([runs, [len(at)]])))], names=["doc", "first", "count"])

        for batch in slices(batches):
            rows = zip(*(batch.column(c).to_pylist() for c in ("key", "doc", "first", "part")), strict=True)
            for k, d, s, p in rows:
                if held > shard_bytes and k != key[-1]:
                    yield solve(len(key))
                    key, doc, first, part, held = [], [], [], [], 0
                key.append(k)
                doc.append(d)
                first.append(s)
                part.append(p)
                held += len(p)
        if key:
            yield solve(len(key))

    return parts.select("key", "doc", "first", "part").repartition("key").sortWithinPartitions("key", "doc", "first").mapInArrow(run, "doc long, first long, count long")


def _repeated_hot(windows: DataFrame) -> DataFrame:
    """doc, first, count: all but the first of equal windows. A window's first place is a group
    minimum, combined where windows are read, so a window that very many texts share meets in no task."""
    place = F.struct("doc", "first")
    places = windows.withColumn("window", F.struct("key", "print")).select("window", "doc", "first")
    lows = places.groupBy("window").agg(F.min(place).alias("low"), F.count("*").alias("m"))
    return lookup(places, cut(lows.where("m > 1")), "window", "m").where(place != F.col("low")).select("doc", "first", F.lit(1).cast("long").alias("count"))


def remove_repeats(docs: DataFrame, *, length: int = 100, shard_bytes: int = 1 << 20, hot_variants: int = 20_000, id_col: str = "doc_id") -> DataFrame:
    """Every byte of a text that lies in a string of `length` bytes which also starts earlier goes.

    Earlier: in a row with a smaller doc_id, or in the same text at an earlier start; matches
    may overlap but never cross texts, and all are judged on the input. Rows are ordered by
    doc_id, nulls last, rows of equal doc_id by a hash of the text and repeated rows one after
    another, each a document of its own. Null texts are empty; texts shorter than `length` stay.
    A length under 16 or over a million bytes is an error.

    Returns per row: id_col, text (null read as empty), removed: an array of (start, end) byte
    ranges, merged and sorted. Other columns are left out; an empty table gives none.

    Equal segments are folded where they are read and again in the shuffle. An anchor with more than
    hot_variants different segments is dealt out window by window, and its equal windows are
    grouped without being sorted; so no shard grows with a frequent string. Which anchors these are is broadcast up
    to 100,000 of them, and joined beyond it.
    """
    if not GRAM <= length < 1 << COUNT_BITS:
        raise ValueError(f"length must be from {GRAM} to {(1 << COUNT_BITS) - 1}")
    base = docs.select(F.col(id_col), F.coalesce("text", F.lit("")).alias("text"))
    kind = dict(base.dtypes)[id_col]
    plain = kind in ("bigint", "int") and not base.groupBy(id_col).count().where(f"count > 1 or `{id_col}` is null").take(1)
    if plain:
        base = base.withColumn("doc", F.col(id_col).cast("long"))
    else:
        by = [F.col(id_col).asc_nulls_last(), F.xxhash64("text")]
        base = base.repartitionByRange(*by).withColumn("pid", F.spark_partition_id())
        base = cut(cut(base).withColumn("doc", F.shiftleft(F.col("pid").cast("long"), 33) + F.row_number().over(Window.partitionBy("pid").orderBy(*by))).drop("pid"))
    # one plan for both joins below, so that the texts are dealt out by doc only once
    keyed = base.select("doc", "text").where("doc is not null")
    folded = cut(_fold(_segments(keyed, length)))
    firsts = folded.where("anchor is not null")
    hot = cut(firsts.groupBy("anchor").count().where(F.col("count") > hot_variants).select("anchor", F.lit(True).alias("hot")))
    n_hot = hot.count()
    if n_hot:
        marked = firsts.join(F.broadcast(hot) if n_hot <= 100_000 else hot, "anchor", "left").withColumn("is_hot", F.coalesce("hot", F.lit(False))).drop("hot")
        parts = cut(_texts_of(marked, keyed, length))
        found = _sorted_shards(parts.where("part is not null"), length, shard_bytes).unionByName(_repeated_hot(parts.where("part is null")))
    else:
        found = _sorted_shards(_texts_of(firsts.withColumn("is_hot", F.lit(False)), keyed, length), length, shard_bytes)
    whole = folded.where("anchor is null").select("doc", F.shiftright("at", COUNT_BITS + 1).alias("first"), F.shiftright("at", 1).bitwiseAND(F.lit((1 << COUNT_BITS) - 1)).cast("long").alias("count"))
    runs = whole.unionByName(found).groupBy("doc").agg(F.collect_list(F.struct("first", "count")).alias("runs"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for runs in batch.column("runs"):
                runs = runs.values
                if runs is None or not len(runs):
                    out.append([])
                    continue
                s = runs.field("first").to_numpy()
                e = s + runs.field("count").to_numpy() + length - 1
                order = np.argsort(s)
                s, e = s[order], np.maximum.accumulate(e[order])
                cutoff = np.flatnonzero(s[1:] > e[:-1])
                out.append([{"start": a, "end": b} for a, b in zip(s[np.concatenate([[0], cutoff + 1])].tolist(), e[np.concatenate([cutoff, [len(e) - 1]])].tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column("text"), pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=[id_col, "text", "removed"])

    if plain:
        joined = keyed.join(runs, "doc", "left").select(F.col("doc").cast(kind).alias(id_col), "text", "runs")
    else:
        joined = base.join(runs, "doc", "left").select(id_col, "text", "runs")
    return joined.mapInArrow(merge, f"`{id_col}` {kind}, text string, removed array<struct<start:long,end:long>>")


def kept_digest(removed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Sizes and a digest of what remove_repeats leaves: n_bytes, n_removed, n_spans, kept_sha256."""
    kind = dict(removed.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, gone, spans, digests = [], [], [], []
            for text, cuts in zip(raw_bytes(batch.column("text")), batch.column("removed").to_pylist(), strict=True):
                h, at = hashlib.sha256(), 0
                for c in cuts:
                    h.update(text[at : c["start"]])
                    at = c["end"]
                h.update(text[at:])
                sizes.append(len(text))
                gone.append(sum(c["end"] - c["start"] for c in cuts))
                spans.append(len(cuts))
                digests.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (sizes, gone, spans)), pa.array(digests, pa.string())], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return removed.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
