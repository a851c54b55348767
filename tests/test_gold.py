"""Hand labels, ad-hoc records, prompts and cross-validation."""

from pyspark.sql import functions as F

from verishelf.operators import gold as G
from verishelf.operators import textmodel as M


def test_labels(spark):
    rows = [("a", "https://x", "correct", "seen"), ("b", None, "correct", "seen"), ("c", "https://x", "none", " "), ("c", None, "none", "x"), ("d", None, "what", "x")]
    got = sorted(map(tuple, G.url_label_problems(spark.createDataFrame(rows, G.GOLD_URLS)).collect()))
    assert got == [("b", "label and url disagree"), ("c", "label and url disagree"), ("c", "labelled twice"), ("c", "no evidence"), ("d", "unknown label")]
    pairs = spark.createDataFrame([("a", "b", "same"), ("b", "a", "same"), ("c", "c", "same"), ("a", "c", "different"), ("b", "c", "ambiguous")], G.GOLD_PAIRS)
    assert sorted(r["problem"] for r in G.pair_problems(pairs).collect()) == ["given twice", "pair of one row"]
    clean = pairs.where("left < right")
    r = G.pair_quality(clean, spark.createDataFrame([("b", "a"), ("c", "b")], "left string, right string")).first()
    assert (r["tp"], r["fp"], r["fn"], r["precision"], r["recall"]) == (1, 0, 0, 1.0, 1.0)


def test_records_by_hand(spark):
    assert [G.input_name(x) for x in ("My Products (1)", "qa", "??")] == ["my_products_1", "input_qa", "input"]
    one = spark.range(1)
    a, b = one.select(G.adhoc_uid(F.lit("x"), F.lit(None)), G.adhoc_uid(F.lit(None), F.lit("x"))).first()
    assert a.startswith("adhoc:") and a[6:].isdigit() and a != b
    assert one.select(G.allowed_values(F.lit("['A B', \"C's\"]"))).first()[0] == ["A B", "C's"] and one.select(G.allowed_values(F.lit("[]"))).first()[0] == []


def test_prompts(spark):
    rules = spark.createDataFrame([("P", "B", "Close", ["X", "Y"]), ("P", "A", "Open-ended", [])], "module string, characteristic string, open_close string, allowed_values array<string>")
    guide = spark.createDataFrame([("P", "A", "any")], "module string, characteristic string, guideline string")
    assert G.rule_block(rules, guide).first()["block"] == "A: free text — any\nB: X | Y"
    ranked = spark.createDataFrame([("r", 2, False, "u2", "t", None, "a  b"), ("r", 1, False, "u1", "", "9", ""), ("r", 3, True, "u3", "", "", "")], "row_uid string, position int, rejected boolean, url string, title string, gtin string, body_text string")
    assert G.candidate_blocks(ranked).first()["block"] == "[1] u1\ngtin: 9\n\n[2] u2\ntitle: t\ntext: a b"


def test_cross_validation_is_refitting(spark):
    words = ["mint fresh", "mint cool", "cool gel", "brush soft", "brush hard", "soft bristle", "mint soft", "gel fresh", "hard brush tip", "zzz"]
    docs = spark.createDataFrame([(i, t, "AB"[i % 2 if i > 6 else int(i > 2)]) for i, t in enumerate(words)], "doc int, text string, label string").cache()
    got = {r["doc"]: r["pred"] for r in G.cross_validate(docs, 3).collect()}
    folds = M.stratified_folds(docs, "label", "doc", 3).cache()
    for k in range(3):
        train, test = folds.where(F.col("fold") != k), folds.where(F.col("fold") == k)
        counted = M.terms(train, "doc", "text")
        idf = M.idf(M.document_frequencies(counted), train.count())
        cents = M.centroids(M.vectors(counted, idf, "doc"), train, "doc", "label")
        want = M.predict(M.class_scores(M.vectors(M.terms(test, "doc", "text"), idf, "doc"), test, cents, "doc", "label"), "doc", "label").collect()
        assert all(got[r["doc"]] == r["label"] for r in want)


def test_copies_of_a_text_are_fitted_once(spark, monkeypatch, tmp_path):
    from verishelf.plans.queries import all_queries

    taken = []
    own = M.terms
    monkeypatch.setattr(M, "terms", lambda docs, *a, **k: taken.append(docs.count()) or own(docs, *a, **k))
    names = ["hot bolt", "cold ring", "blue plate"]
    part = spark.range(60).selectExpr("id as p_partkey", f"element_at(array('{names[0]}', '{names[1]}', '{names[2]}'), cast(id % 3 + 1 as int)) as p_name", "'Brand#1' as p_brand", "concat('T', cast(id % 3 as string)) as p_type", "1 as p_size")
    part.write.parquet(str(tmp_path / "part.parquet"))
    q = all_queries()
    assert all(r["pred"] == r["truth"] == f"T{r['doc'] % 3}" for r in q["cross_validate"](spark, str(tmp_path)).collect())
    got = q["centroid_predict"](spark, str(tmp_path)).collect()
    assert len(got) == 60 and all(r["label"] == f"T{r['doc'] % 3}" and r["score"] == 1 for r in got)
    assert {r["label"]: r["terms"] > 5 for r in q["class_centroids"](spark, str(tmp_path)).collect()} == {f"T{i}": True for i in range(3)}
    assert q["unseen_classes"](spark, str(tmp_path)).count() == 180
    assert max(taken) == 3


def test_addresses_of_large_keys_are_well_formed(spark, tmp_path):
    from verishelf.plans.queries import all_queries

    keys = spark.createDataFrame([(4, 1), (9, 1), (70004, 1), (70009, 1), (16777214, 1)], "c_custkey long, c_nationkey int")
    keys.write.parquet(str(tmp_path / "customer.parquet"))
    got = dict(all_queries()["url_safety"](spark, str(tmp_path)).collect())
    assert got == {4: True, 9: False, 70004: True, 70009: False, 16777214: True}
