"""The registered queries over a whole small folder of tables, against SQL or a plain version."""

import math
import os
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_simhash import _fingerprint, _roots
from tests.llm.test_suffix_array import _brute
from verishelf.llm import queries as q
from verishelf.llm.lang_id import WINDOW, train_lang_id
from verishelf.llm.toxicity import Attributes, train_toxicity

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def _rows(df):
    names = sorted(df.columns)
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for table in ("conversations", "documents", "pages", "benchmark", "embeddings"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    got = q.queries()[name](spark, SF)
    found = con.execute(q.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    order = [columns.index(c) for c in sorted(got.columns)]
    assert _rows(got) == sorted((tuple(r[i] for i in order) for r in found.fetchall()), key=str)


def _documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def _held(i, parts, part):
    return zlib.crc32(str(i).encode()) % parts == part


def test_language_query(spark):
    docs = _documents(spark)
    held = F.udf(lambda i: _held(i, 4, 2), "boolean")
    net = train_lang_id(docs, ~held("doc_id"))
    blind = train_lang_id(docs.withColumn("lang", F.when(held("doc_id"), "zz").otherwise(F.col("lang"))), ~held("doc_id"))
    assert np.array_equal(net.table, blind.table) and "zz" not in blind.labels
    got = {r["doc_id"]: r for r in q.op2_language_id(spark, SF).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        assert got[i]["held_out"] == _held(i, 4, 2)
        if not any(map(str.isalpha, text or "")):
            assert got[i]["lang_pred"] == "und"
            continue
        t, total = text.encode(), np.zeros(len(net.labels))
        for at in range(0, len(t), WINDOW):
            part = np.frombuffer(t[at : at + WINDOW], dtype=np.uint8)
            total += net.positions(part[None, :], np.array([len(part)]))[:, :, 0].sum(axis=0)
        best = int(total.argmax())
        assert got[i]["lang_pred"] == net.labels[best] and abs(got[i]["score"] - total[best] / len(t)) < 1e-4


def test_toxicity_query(spark):
    docs, labels = _documents(spark), spark.read.parquet(f"{SF}/labels.parquet")
    marks = [(r["doc_id"], r["toxic"]) for r in labels.collect()]
    model = train_toxicity(docs, spark.createDataFrame([m for m in marks if not _held(m[0], 3, 1)], "doc_id long, toxic int"), lambda c: F.lit(True))
    scorer = Attributes(model.lexicon)
    got = {r["doc_id"]: r for r in q.op7_toxicity(spark, SF).collect()}
    for r in docs.collect():
        row = got[r["doc_id"]]
        want = float(model.score(scorer((r["text"] or "").encode())[None, :])[0])
        assert row["held_out"] == _held(r["doc_id"], 3, 1) and abs(row["score"] - want) < 1e-12 and row["predicted"] == int(row["score"] >= 0.7)


def test_repeated_and_conflicting_labels(spark):
    docs = _documents(spark)
    marks = [(i, i % 5 == 0) for i in range(100)]
    extra = [(i, not y) for i, y in marks[:10]]
    frame = lambda rows: spark.createDataFrame([(i, int(y)) for i, y in rows], "doc_id long, toxic int")
    want = train_toxicity(docs, frame(marks[10:]), lambda c: F.lit(True))
    for rows in (marks + extra + marks, extra + marks[::-1]):
        got = train_toxicity(docs, frame(rows).repartition(3), lambda c: F.lit(True))
        assert got.prior == want.prior and got.lexicon == want.lexicon


def test_simhash_and_suffix_queries(spark):
    rows = [(r["doc_id"], r["text"]) for r in _documents(spark).collect()]
    prints = [_fingerprint(t) for _, t in rows]
    roots, low = _roots(len(rows), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3), {}
    for (i, _), r in zip(rows, roots):
        low[r] = min(i, low.get(r, i))
    assert sorted(tuple(r) for r in q.op3_simhash_dedup(spark, SF).collect()) == sorted((i, f"{p:016x}", low[r]) for (i, _), p, r in zip(rows, prints, roots))
    assert sorted(tuple(r) for r in q.op5_suffix_dedup(spark, SF).collect()) == sorted(_brute(rows, 100))


def test_mix_query_is_a_fair_queue(spark):
    word = r"[^\x20\x09-\x0D]+"
    docs = _documents(spark).select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(word)), F.lit(0)).alias("size"), F.xxhash64(F.lit(11), "doc_id", F.xxhash64("text")).alias("u")).collect()
    sources = sorted({r["source"] for r in docs}, key=lambda s: (s is None, s))
    size = {s: sum(r["size"] for r in docs if r["source"] == s) for s in sources}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    budget, full = 1.5 * sum(size.values()), set()
    while True:  # share what is left by weight until no target is above twice its source's size
        rest = budget - sum(2 * size[s] for s in full)
        target = {s: 2 * size[s] if s in full else rest * weight[s] / sum(weight[x] for x in sources if x not in full) for s in sources}
        above = {s for s in sources if s not in full and target[s] > 2 * size[s]}
        if not above:
            break
        full |= above
    packets, upto = [], dict.fromkeys(sources, 0)
    for r in sorted(docs, key=lambda r: (r["u"], r["doc_id"])):
        s = r["source"]
        for again in (0, 1):
            for at in range(0, r["size"], 256):
                n = min(256, r["size"] - at)
                packets.append(((again * size[s] + upto[s] + at + n) / target[s], sources.index(s), again * size[s] + upto[s] + at + n, n, r["doc_id"]))
        upto[s] += r["size"]
    left, taken = math.floor(budget), dict.fromkeys((r["doc_id"] for r in docs), 0)
    for *_, n, i in sorted(packets):
        taken[i] += min(n, left)
        left -= min(n, left)
    got = {r["doc_id"]: r for r in q.op10_mix_sources(spark, SF).collect()}
    assert {i: r["taken"] for i, r in got.items()} == taken
    assert all(got[r["doc_id"]]["size"] == r["size"] and got[r["doc_id"]]["source_size"] == size[r["source"]] and abs(got[r["doc_id"]]["target"] - target[r["source"]]) < 1e-6 * (1 + target[r["source"]]) for r in docs)
