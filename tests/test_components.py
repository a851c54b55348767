"""Components over shards of edges."""

import random

from verishelf.operators import registry


def test_components_across_shards(spark, monkeypatch):
    """Chains, a hub and random edges over many small shards: as a plain search finds them; a local graph needs no rounds."""
    rnd = random.Random(7)
    edges = [(f"c{i:04}", f"c{i + 1:04}") for i in range(300) if i % 50 != 49] + [("hub", f"h{i}") for i in range(60)] + [(f"r{rnd.randrange(90):02}", f"r{rnd.randrange(90):02}") for _ in range(60)] + [("z", "z")]
    rnd.shuffle(edges)
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        parent[high] = low
    df = spark.createDataFrame([*edges, (None, "n"), ("n", None)], "a string, b string")
    for size in (7, 40, 250_000):
        monkeypatch.setattr(registry, "SHARD", size)
        got = [(r["node"], r["component"]) for r in registry.components(df).collect()]
        assert sorted(got) == sorted((x, find(x)) for x in parent)
    monkeypatch.setattr(registry, "_fall", None)
    assert registry.components(df).count() == len(parent)
