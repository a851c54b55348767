"""Embedding classes against all pairs."""

import math

import numpy as np
from pyspark.sql import types as T

from verishelf.llm.embed_dedup import Blocks, box_of, embedding_classes, linked_pairs, principal_axes, split_boxes


def test_tiles_find_all_pairs():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 40)) * np.linspace(3, 0.1, 40)
    x = np.concatenate([x, x[:80] + rng.normal(size=(80, 40)) * 0.3, x[:1] + rng.normal(size=(50, 40)) * 0.02])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = (x @ principal_axes(x)).astype(np.float32)
    want = {(i, j) for i, j in zip(*np.nonzero(x @ x.T >= 0.9)) if i < j}
    for tile in (7, 64, 1024):
        got = [(i, j) for a, b in linked_pairs(x, x, z, z, 0.9, True, step=8, tile=tile) for i, j in zip(a.tolist(), b.tolist())]
        assert len(got) == len(set(got)) and set(got) == want


def test_classes(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(150, 16))
    x = np.concatenate([x, x[:40] * 2 + rng.normal(size=(40, 16)) * 0.4, x[:6].repeat(5, axis=0)]).astype(np.float32)
    vecs = [v.tolist() for v in x] + [None, [], [0.0] * 16, [1.0, None] + [0.0] * 14, [float("nan")] * 16, [float("inf")] * 16, [1.0, 0.0], [2.0, 0.0], [3.0e38] * 16, [1.0e-40] * 16]
    ids = rng.permutation(5000)[: len(vecs)].tolist()
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("node", T.StringType())])
    df = spark.createDataFrame([(i, v, "x") for i, v in zip(ids, vecs)], schema)
    good = lambda v: v and None not in v and all(map(math.isfinite, v)) and any(v)
    cos = lambda a, b: float(np.dot(a, b) / math.sqrt(np.dot(a, a)) / math.sqrt(np.dot(b, b)))
    arrays = [np.array(v, dtype=np.float32).astype(float) if good(v) else None for v in vecs]
    links = [[j for j in range(len(vecs)) if j != i and arrays[i] is not None and arrays[j] is not None and len(arrays[i]) == len(arrays[j]) and cos(arrays[i], arrays[j]) >= 0.9] for i in range(len(vecs))]
    seen, root = set(), {}
    for i in range(len(vecs)):
        todo, own = [i], []
        while todo:
            k = todo.pop()
            if k not in seen:
                seen.add(k)
                own.append(k)
                todo += links[k]
        for k in own:
            root[k] = min(ids[o] for o in own)
    want = sorted((ids[i], len(links[i]), root[i], ids[i] == root[i]) for i in range(len(vecs)))
    for options in ({}, {"block": 37}, {"block": 5, "lead": 3}, {"block": 9, "max_axes": 4, "sample": 1}, {"block": 5, "max_blocks": 2}):
        assert sorted(map(tuple, embedding_classes(df, **options).collect())) == want
    assert embedding_classes(df.limit(0)).count() == 0


def test_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(None, [1.0, 2.0]), (4, [1.0, 2.0]), (4, [1.0, 2.0]), (5, [1.0, -2.0])], "vec_id long, embedding array<double>")
    got = sorted(map(str, (tuple(r) for r in embedding_classes(df).collect())))
    assert got == sorted(map(str, [(None, 2, 4, False), (4, 2, 4, True), (4, 2, 4, True), (5, 0, 5, True)]))


def test_boxes_out_of_reach_get_nothing():
    rng = np.random.default_rng(5)
    centres = np.linalg.qr(rng.normal(size=(16, 16)))[0]
    x = np.repeat(centres, 50, axis=0) + rng.normal(size=(800, 16)) * 0.02
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    axes = principal_axes(x)
    z = x @ axes
    nodes = split_boxes(z[:, :12], 4)
    box = box_of(nodes, z)
    tail = np.sqrt(np.maximum(0, (z[:, 12:] ** 2).sum(axis=1)))
    part = lambda f, v: np.array([f(v[box == k], axis=0) if (box == k).any() else np.full(v.shape[1:], -np.inf) for k in range(16)])
    blocks = Blocks(axes, nodes, 12, part(np.min, z[:, :12]), part(np.max, z[:, :12]), part(np.max, tail))
    sent = {k: set(at.tolist()) for k, at in blocks.reached(z, 0.9)}
    for i, j in zip(*np.nonzero(x @ x.T >= 0.9)):
        assert i in sent[box[j]] and j in sent[box[i]]
    assert sum(map(len, sent.values())) < 5 * len(x)
