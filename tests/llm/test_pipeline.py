"""The pipeline's stages on a small corpus with planted cases."""

import random

import pytest

pipeline = pytest.importorskip("corpus_pipeline")


def _write(spark, folder, docs, labels, bench):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_planted_cases(spark, tmp_path):
    rng = random.Random(1)
    text = lambda n=60: " ".join(f"w{rng.randint(0, 2000)}" for _ in range(n))
    bench = [(i, text(20)) for i in range(5)]
    docs, labels, toxic = [], [], set()
    for i in range(300):
        t = text()
        if i % 7 == 0:
            toxic.add(i)
            t = t.replace(" ", " vile ", 3)
        docs.append((i, t, "en", f"s{i % 3}"))
        labels.append((i, 1, int(i in toxic)))
    docs += [(1000, docs[1][1], "en", "s0"), (1001, docs[2][1].replace("w", "W", 1) + " end", "en", "s1"), (1002, f"{text()} {bench[2][1]} {text()}", "en", "s2"), (1003, f"{text()} password = hunter2hunter2 {text()}", "en", "s0"), (1004, None, None, None), (1005, "", "en", "s1"), (1003, None, "en", None)]
    _write(spark, str(tmp_path), [(*d, len(d[1] or "")) for d in docs], labels, bench)
    out = pipeline.run(spark, str(tmp_path)).collect()
    got = {r["doc_id"]: r for r in out}
    assert len(got) == len(out)
    assert not toxic & set(got) and not {1000, 1001, 1002, 1004, 1005} & set(got)
    assert "hunter2" not in got[1003]["text"] and "[SECRET:assign]" in got[1003]["text"] and got[1003]["n_chars"] == len(got[1003]["text"])
    assert all(0 < r["taken"] <= 2 * r["size"] for r in out)
    clean = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        clean = stage(spark, clean, str(tmp_path))
        assert clean.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    left = {r["doc_id"] for r in clean.collect()}
    assert {d[0] for d in docs[:300]} - toxic <= left


def test_clashing_columns(spark, tmp_path):
    docs = [(i, f"word{i} " * 5 + f"tail{i}", "en", "s", 9) for i in range(8)] + [(None, "lonely words here", None, None, None)]
    _write(spark, str(tmp_path), docs, [], [(1, "word1 word1 word1")])
    names = ["toxicity", "items", "spans", "n_words", "code", "root", "t1", "size", "taken", "component_id", "pid"]
    now = spark.read.parquet(f"{tmp_path}/documents.parquet").selectExpr("*", *[f"doc_id AS {n}" for n in names])
    for name, stage in pipeline.STAGES[:-1]:
        before, now = now.columns, stage(spark, now, str(tmp_path))
        assert now.columns == before and all(r[n] == r["doc_id"] for r in now.collect() for n in names), name
    assert {r["doc_id"] for r in now.collect()} == {None, *range(8)} - {1}
    assert pipeline.mix(spark, now, str(tmp_path)).count() > 0


def test_empty_tables(spark, tmp_path):
    _write(spark, str(tmp_path), [], [], [])
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_each_copy_has_its_own_share_of_the_mix(spark, tmp_path):
    docs = [(1, "a b c", "en", "s", 5)] * 5 + [(2, "d e", "en", "s", 3), (None, "f", None, None, 1), (None, "f", None, None, 1), (3, "", "en", "t", 0)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, taken long")
    out = pipeline.mix(spark, frame, str(tmp_path)).collect()
    assert sum(r["taken"] for r in out) == int(1.5 * 19) and all(0 < r["taken"] <= 2 * r["size"] for r in out)
    assert len(out) <= 8 and 3 not in {r["doc_id"] for r in out}
