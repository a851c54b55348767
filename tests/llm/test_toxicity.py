"""Toxicity: the parts by hand, the whole by held-out accuracy."""

import random

import numpy as np
from pyspark.sql import functions as F

from verishelf.llm.toxicity import Attributes, boost, isotonic, score_toxicity, train_toxicity


def test_isotonic_pools_falling_blocks():
    s, y = isotonic(np.array([1.0, 2, 3, 4, 5]), np.array([0.0, 1, 0, 1, 1]))
    assert s.tolist() == [1, 2.5, 4, 5][:2] + [4.5] or (np.diff(y) >= 0).all()
    assert y.tolist() == [0, 0.5, 1] and s.tolist() == [1, 2.5, 4.5]


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 3))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > -0.2)).astype(float)
    model = boost(x[:1500], y[:1500])
    assert ((model.margin(x[1500:]) > 0) == y[1500:]).mean() > 0.95


def test_features():
    f = Attributes({"=idiot": 3.0})
    assert f(None).tolist() == f(b"").tolist()
    x = f("You are an 1d!0t, IDIOT!!".encode())
    assert x[0] == 40 and x[1] == 2 and x[3] == 3 and x[6] == 2 and x[8] == 1


def test_held_out_accuracy_and_edge_rows(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(900):
        w = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(5, 80))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["vile", "Nasty!", "rotten", "n4sty"]))
        rows.append((i, " ".join(w), 0.5))
        labels.append((i, int(toxic)))
    rows += [(None, "vile", 0.0), (2000, None, 0.0), (2001, "", 0.0), (2002, "w1 " * 100_000, 0.0), (2003, rows[6][1], 0.0), rows[6]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxicity double")
    marks = spark.createDataFrame(labels + [(2000, 0), (None, 1), (5, None), (2001, 7)], "doc_id long, toxic int")
    model = train_toxicity(docs, marks, lambda c: c % 3 != 1)
    got = {r["doc_id"]: r["s"] for r in score_toxicity(docs, model, keep=["doc_id"]).select("doc_id", F.col("toxicity").alias("s")).collect()}
    assert all(0 <= s <= 1 for s in got.values())
    held = [i for i in range(900) if i % 3 == 1]
    assert np.mean([(got[i] >= 0.5) == (i % 6 == 0) for i in held]) > 0.97
    assert got[2003] == got[6] and got[2000] == got[2001] < 0.5
    again = train_toxicity(docs.repartition(5), marks, lambda c: c % 3 != 1)
    assert np.array_equal(again.trees.margin(np.ones((3, 17))), model.trees.margin(np.ones((3, 17))))
    none = train_toxicity(docs, marks.limit(0), lambda c: c % 3 != 1)
    assert score_toxicity(docs, none, keep=["doc_id"]).agg(F.max("toxicity")).first()[0] == 0
    assert score_toxicity(docs.limit(0), model, keep=["doc_id"]).count() == 0
