"""The language network: gradients by differences, windows by hand, held-out accuracy."""

import random

import numpy as np
from pyspark.sql import functions as F

from verishelf.llm.lang_id import Network, cut_windows, identify_languages, train_lang_id

ALPHABETS = {"aa": "abcde ", "bb": "abcxyé ", "cc": "mnopß "}


def test_gradients():
    rng = np.random.default_rng(0)
    net = Network.fresh(["a", "b", "c"], 4, 2)
    windows, target = rng.integers(97, 103, (5, 7)).astype(np.uint8), np.array([0, 1, 2, 1, 0])
    _, grads = net.gradients(windows, target)
    for w, g in zip((net.table, net.inner, net.out, net.bias), grads):
        for i in rng.permutation(np.flatnonzero(np.abs(g).ravel() > 1e-4))[:6]:
            at, eps = np.unravel_index(i, w.shape), 1e-2
            old = w[at]
            w[at] = old + eps
            up = net.gradients(windows, target)[0]
            w[at] = old - eps
            down = net.gradients(windows, target)[0]
            w[at] = old
            assert abs((up - down) / (2 * eps) - g[at]) < 2e-3 + 0.05 * abs(g[at])


def test_positions_agree_with_training_pass_and_padding_is_inert():
    net = Network.fresh(["a", "b"], 4, 3)
    rng = np.random.default_rng(1)
    windows = rng.integers(0, 256, (6, 20)).astype(np.uint8)
    loss, _ = net.gradients(windows, np.zeros(6, dtype=int))
    p = net.positions(windows, np.full(6, 20))
    assert abs(-np.log(p[:, 0]).mean() - loss) < 1e-4
    q = net.positions(windows[:, :12], np.full(6, 12))
    assert np.allclose(net.positions(windows, np.full(6, 12))[:12], q, atol=1e-6)
    texts = [b"", b"x" * 500, b"yz"]
    w, sizes, owner = cut_windows(texts)
    assert sizes.tolist() == [192, 192, 116, 2] and owner.tolist() == [1, 1, 1, 2]
    pooled = net.pooled(texts)
    assert pooled[0].sum() == 0 and np.allclose(pooled[1:].sum(axis=1), 1)
    assert len(net.label_positions(texts[1])) == 500


def test_held_out_accuracy_and_edge_rows(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        lang = rng.choice(["aa"] * 6 + ["bb", "cc"])
        rows.append((i, "".join(rng.choice(ALPHABETS[lang]) for _ in range(rng.randint(30, 300))), lang, 0.5))
    rows += [(900, None, "aa", 0.0), (901, "", "aa", 0.0), (902, "12 ... !", "bb", 0.0), (903, "mnop" * 50_000, None, 0.0), rows[0], (None, "xyé xyx cyx", "aa", 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    net = train_lang_id(df, F.col("doc_id") % 4 != 2, steps=120)
    got = {r["doc_id"]: r for r in identify_languages(df.drop("lang"), net, keep=["doc_id"]).collect()}
    held = [r for r in rows[:400] if r[0] % 4 == 2]
    assert np.mean([got[r[0]]["lang_pred"] == r[2] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert [got[i]["lang_pred"] for i in (900, 901, 902, 903, None)] == ["und", "und", "und", "cc", "bb"]
    again = train_lang_id(df.repartition(3), F.col("doc_id") % 4 != 2, steps=5)
    assert np.array_equal(again.table, train_lang_id(df, F.col("doc_id") % 4 != 2, steps=5).table)
    none = train_lang_id(df.limit(0), F.lit(True))
    assert {r["lang_pred"] for r in identify_languages(df, none, keep=["doc_id"]).collect()} == {"und"}
    assert identify_languages(df.limit(0), net, keep=["doc_id"]).count() == 0
