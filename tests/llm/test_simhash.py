"""SimHash classes against all pairs."""

import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from verishelf.llm._common import components
from verishelf.llm.simhash import FAMILIES, THREE_BITS, Links, build_top, drop_near_copies, link_codes, link_rows, link_shard, route, simhash_classes


def _fingerprint(text):
    w = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _roots(n, linked):
    root = list(range(n))
    find = lambda x: x if root[x] == x else find(root[x])
    for a in range(n):
        for b in range(a):
            if linked(a, b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(x) for x in range(n)]


def test_classes_match_all_pairs(spark):
    rng = random.Random(3)
    texts = [None, "", " \t", "One", "one", "one two", "ÉÀ b c d", "x" * 100_000]
    for _ in range(25):
        w = [f"w{rng.randint(0, 500)}" for _ in range(rng.choice([30, 200]))]
        texts.append(" ".join(w))
        for _ in range(rng.randint(0, 4)):
            v = list(w)
            v[rng.randrange(len(v))] = "edit"
            texts.append(" ".join(v))
    texts += texts[10:20]
    ids = list(range(100, 100 + len(texts)))
    rng.shuffle(ids)
    df = spark.createDataFrame([(i, t, 0, 0) for i, t in zip(ids, texts)], "doc_id long, text string, code int, root int")
    got = {r["doc_id"]: r for r in simhash_classes(df).collect()}
    prints = [_fingerprint(t) for t in texts]
    roots = _roots(len(texts), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    low = {}
    for i, r in zip(ids, roots):
        low[r] = min(i, low.get(r, i))
    for i, p, r in zip(ids, prints, roots):
        assert got[i]["code"].hex() == f"{p:016x}" and got[i]["component_id"] == low[r]
    assert simhash_classes(df.limit(0)).count() == 0


def test_shards_lose_no_link(spark):
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 2**64, 400, dtype=np.uint64)
    flips = [np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 5), replace=False))) for _ in range(400)]
    codes = np.unique(np.concatenate([codes, codes ^ np.array(flips), codes[:5].repeat(40) ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64))]))
    roots = _roots(len(codes), lambda a, b: int(codes[a] ^ codes[b]).bit_count() <= 3)
    df = spark.createDataFrame([(i, bytes(np.array([c], dtype=">u8").tobytes())) for i, c in enumerate(codes)], "node long, code binary")
    for rows in (10**6, 60, 2):
        got = {r["node"]: r["root"] for r in link_codes(df, THREE_BITS, shard_rows=rows).collect()}
        assert [got.get(i, i) for i in range(len(codes))] == roots
    key = np.sort(rng.integers(0, 4, len(codes)))
    meet = _roots(len(codes), lambda a, b: key[a] == key[b] and int(codes[a] ^ codes[b]).bit_count() <= 3)
    for leaf in (4, 1000):
        none = np.zeros((len(codes), 0), dtype=np.uint64)
        assert link_rows(key, np.ones(len(codes), dtype=bool), codes, none, 3, 0, leaf).tolist() == meet
    links = Links(len(codes))
    for lo, bits in ((0, 32), (32, 32)):
        band = (codes >> np.uint64(lo)) & np.uint64(2**bits - 1)
        for _, at, home in route(build_top(band[::3], 3), band, 1):
            link_shard(codes[:, None], at[home], at[~home], band, 1, 0, 3, links, leaf=8, block=64)
    assert links.label.tolist() == roots


def test_near_copies_go(spark):
    rng = random.Random(4)
    rows, want = [], set()
    for g in range(40):
        w = [f"w{rng.randint(0, 3000)}" for _ in range(150)]
        rows.append((g * 10, " ".join(w), "en"))
        want.add(g * 10)
        for k in range(1, 4):
            v = list(w)
            for _ in range(rng.randint(0, 2)):
                v[rng.randrange(150)] = f"e{rng.randint(0, 99)}"
            rows.append((g * 10 + k, " ".join(v), "en"))
        half = w[:75] + [f"w{rng.randint(0, 3000)}" for _ in range(75)]
        rows.append((g * 10 + 9, " ".join(half), None))
        want.add(g * 10 + 9)
    rows += [rows[0]] * 3 + [(None, rows[5][1], "x"), (7000, None, "x"), (7001, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, root string")
    got = [r["doc_id"] for r in drop_near_copies(df).collect()]
    assert sorted(got) == sorted(want | {7000})
    assert drop_near_copies(df.limit(0)).count() == 0


def test_equal_rows_and_ties_leave_one(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(3, text, "b"), (3, text, "a"), (3, text + " w30", "c"), (9, text, "d"), (None, text, "e"), (None, "other", "f"), (None, "other", "f")]
    for turn in (rows, rows[::-1]):
        df = spark.createDataFrame(turn, "doc_id long, text string, node string")
        first = sorted(map(tuple, drop_near_copies(df.repartition(3)).collect()), key=str) if turn is rows else first
        assert sorted(map(tuple, drop_near_copies(df).collect()), key=str) == first
    assert len(first) == 2 and {r[0] for r in first} == {3, None}


def test_a_loose_scheme_stars_what_a_shard_does_not_take(spark):
    df = spark.createDataFrame([(i, f"{' '.join(f'w{(i // 40) * 1000 + k}' for k in range(20))} e{i}") for i in range(120)], "node long, text string")
    codes = df.select("node", "text").toPandas()
    codes = spark.createDataFrame([(int(n), np.array(FAMILIES.code(t.encode().split()), dtype=">u8").tobytes()) for n, t in zip(codes["node"], codes["text"])], "node long, code binary")
    for rows in (10**6, 30):
        got = {r["node"]: r["root"] for r in link_codes(codes, FAMILIES, shard_rows=rows).collect()}
        assert all(got[i] == got[i // 40 * 40] for i in range(120))


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randint(100, 300), rng.randint(100, 300)) for _ in range(120)] + [(400, x) for x in range(401, 500)] + [(5, 5)]
    frame = spark.createDataFrame(edges, "a long, b long")
    roots = _roots(501, lambda a, b, s={tuple(sorted(e)) for e in edges}: (b, a) in s)
    for one_task in (1 << 20, 0):
        got = {r["node"]: r["root"] for r in components(frame, one_task=one_task).collect()}
        assert all(got.get(i, i) == roots[i] for i in range(501))
    assert components(spark.range(0).select(F.col("id").alias("a"), F.col("id").alias("b"))).count() == 0
