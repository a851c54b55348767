"""Source mixing against plain Python water-filling and queueing."""

import random
import re

from verishelf.llm.mixing import mix_sources


def _targets(sizes, weights=(5, 2, 1), ratio=1.5):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = ratio * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(w[s] for s in free)
        full = {s for s in free if level * w[s] > 2 * sizes[s]}
        for s in full or free:
            out[s] = 2.0 * sizes[s] if full else level * w[s]
        left -= sum(out[s] for s in full)
        free = free - full if full else set()
    return out


def test_mix(spark):
    rng = random.Random(5)
    rows = [(i if i % 50 else None, " ".join("w" * rng.randint(1, 3) for _ in range(int(10 ** rng.uniform(0, 3)))) if i % 17 else [None, "", " \t"][i % 3], rng.choice(["hot"] * 5 + ["a", "b", "é", "Z", None])) for i in range(600)]
    rows += [rows[1]] * 3
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int")
    got = mix_sources(df).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want, took = _targets(sizes), {}
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        took[r["source"]] = took.get(r["source"], 0) + r["taken"]
    for s, n in took.items():
        assert abs(n - want[s]) <= 512, (s, n, want[s])
    assert sum(took.values()) == int(1.5 * sum(sizes.values()))
    assert sorted(map(str, got)) == sorted(map(str, mix_sources(df.repartition(7)).collect()))
    assert mix_sources(df.limit(0)).count() == 0


def test_everything_empty(spark):
    df = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert [r["taken"] for r in mix_sources(df).collect()] == [0, 0]
