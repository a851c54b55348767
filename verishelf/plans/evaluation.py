"""Registered queries of the text model, calibration, characteristics, reasoning and assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verishelf.functions import vocab
from verishelf.operators import calibrate, gold, match, reason, registry, runs
from verishelf.operators import characteristics as C
from verishelf.operators import textmodel as M
from verishelf.plans.inputs import candidate_pairs, products, table
from verishelf.plans.queries import _SCORED, _TIERS, SQL, _entities, _first_ranked, _identity_idf, _with, query
from verishelf.sources.tables import cut

# ---- text model -----------------------------------------------------------------------------

_GRAMS = """WITH t AS (SELECT {doc} AS doc, {text} AS x FROM {table}),
  z AS (SELECT doc, ' ' || trim(regexp_replace(lower(x), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')) || ' ' AS z FROM t),
  tg AS (SELECT doc, '4:' || substr(z, CAST(i AS BIGINT), 4) AS term, count(*) AS n FROM z, unnest(range(1, greatest(length(z) - 2, 1))) AS r(i) GROUP BY 1, 2),
  idf AS (SELECT term, count(*) AS df, ln(((SELECT count(*) FROM t) + 1.0::DOUBLE) / (count(*) + 1.0::DOUBLE)) + 1 AS idf FROM tg GROUP BY 1)"""


@query(_GRAMS.format(doc="item_id", text="text", table="benchmark") + " SELECT term, df, round(idf, 9) AS idf FROM idf")
def char_ngram_idf(spark, d):
    docs = table(spark, d, "benchmark").select("item_id", "text")
    return M.idf(M.document_frequencies(M.terms(docs, "item_id", "text")), docs.count()).withColumn("idf", F.round("idf", 9))


def _part_docs(spark, d) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("doc"), F.concat_ws(" ", "p_name", "p_brand").alias("text"), F.col("p_type").alias("label"))


_PART = _GRAMS.format(doc="p_partkey", text="p_name || ' ' || p_brand", table="part") + """,
  v0 AS (SELECT doc, term, (1 + ln(n)) * idf AS w FROM tg JOIN idf USING (term)), v AS (SELECT doc, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc)) AS w FROM v0),
  c0 AS (SELECT p_type AS label, term, sum(w) AS w FROM v JOIN part ON p_partkey = doc GROUP BY 1, 2), c AS (SELECT label, term, w / sqrt(sum(w * w) OVER (PARTITION BY label)) AS w FROM c0),
  s AS (SELECT doc, label, sum(v.w * c.w) AS score FROM v JOIN c USING (term) GROUP BY 1, 2),
  r AS (SELECT doc, label, score, row_number() OVER (PARTITION BY doc ORDER BY round(score, 9) DESC, label) AS k FROM s)"""


@query(_PART + " SELECT label, count(*) AS terms, round(sum(w), 6) AS weight FROM c GROUP BY 1")
def class_centroids(spark, d):
    vecs, folded, _, _ = _part_vectors(spark, d)
    return M.centroids(vecs, folded, "text", "label").groupBy("label").agg(F.count("*").alias("terms"), F.round(F.sum("weight"), 6).alias("weight"))


def _part_vectors(spark, d) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Vectors by text, texts with label and copies, idf, and documents: far fewer texts than documents."""
    docs = _part_docs(spark, d)
    folded = cut(M.copies(docs, "text", "label"))
    counted = cut(M.terms(folded.select("text").distinct().withColumn("_t", F.col("text")), "text", "_t"))
    n_docs = folded.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    idf = cut(M.idf(M.weighted_frequencies(counted, folded, "text"), n_docs))
    return cut(M.vectors(counted, idf, "text")), folded, idf, docs


@query(_PART + " SELECT a.doc, a.label, round(a.score, 6) AS score, b.label AS runner_up, round(a.score - b.score, 6) AS gap FROM r a JOIN r b ON a.doc = b.doc AND a.k = 1 AND b.k = 2")
def centroid_predict(spark, d):
    vecs, folded, _, docs = _part_vectors(spark, d)
    best = M.best_labels(vecs, folded.select("text").distinct(), cut(M.centroids(vecs, folded, "text", "label")), "text", "label")
    out = docs.drop("label").join(cut(best), "text")
    return out.select("doc", "label", F.round("score", 6).alias("score"), "runner_up", F.round("gap", 6).alias("gap"))


_NAMES = _GRAMS.format(doc="p_name", text="p_name", table="(SELECT DISTINCT p_name FROM part)") + """,
  v0 AS (SELECT doc, term, (1 + ln(n)) * idf AS w FROM tg JOIN idf USING (term)), v AS (SELECT doc, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc)) AS w FROM v0),
  s AS (SELECT a.doc, b.doc AS other, sum(a.w * b.w) AS score FROM v a JOIN v b ON a.term = b.term AND a.doc <> b.doc GROUP BY 1, 2)"""


@query(_NAMES + " SELECT doc, arg_max(other, (round(score, 9), other)) AS nearest, round(max(score), 6) AS similarity FROM s GROUP BY 1")
def nearest_example(spark, d):
    docs = cut(table(spark, d, "part").select(F.col("p_name").alias("doc"), F.col("p_name").alias("text")).distinct())
    counted = M.terms(docs, "doc", "text")
    vecs = cut(M.vectors(counted, M.idf(M.document_frequencies(counted), docs.count()), "doc"))
    return M.nearest(vecs, vecs, "doc").withColumn("similarity", F.round("similarity", 6))


# ---- evaluation -----------------------------------------------------------------------------


@query("SELECT c_custkey, CAST((row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1) % 5 AS INTEGER) AS fold FROM customer")
def stratified_folds(spark, d):
    return M.stratified_folds(table(spark, d, "customer"), "c_mktsegment", "c_custkey", 5).select("c_custkey", "fold")


_PRED = "p AS (SELECT c_custkey, c_mktsegment AS truth, list_sort((SELECT list(DISTINCT c_mktsegment) FROM customer))[CAST((c_nationkey * c_nationkey + c_custkey) % 5 + 1 AS INTEGER)] AS pred, c_acctbal AS confidence FROM customer)"


def _few(df: DataFrame, column: str, most: int) -> list[str]:
    """The different values of a column in order; more than `most` raise."""
    names = sorted(r[0] for r in df.select(column).distinct().limit(most + 1).collect())
    if len(names) > most:
        raise ValueError(f"{column} has more than {most} values")
    return names


def _predictions(spark, d) -> DataFrame:
    c = table(spark, d, "customer")
    names = _few(c, "c_mktsegment", 100)
    k = ((F.col("c_nationkey").cast("long") * F.col("c_nationkey") + F.col("c_custkey")) % 5 + 1).cast("int")
    return c.select("c_custkey", F.col("c_mktsegment").alias("truth"), F.try_element_at(F.array(*map(F.lit, names)), k).alias("pred"), F.col("c_acctbal").alias("confidence"))


@query(f"WITH {_PRED} SELECT truth, count(*) AS n, count(*) FILTER (truth = pred) AS correct, count(*) FILTER (truth = pred) / count(*) AS rate FROM p GROUP BY 1")
def classifier_report(spark, d):
    return M.accuracy(_predictions(spark, d))


@query(f"WITH {_PRED}, a AS (SELECT truth, count(*) AS n, count(*) FILTER (truth = pred) AS c FROM p GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS n, CAST(sum(c) AS BIGINT) AS correct, sum(c) / sum(n) AS overall, round(avg(c / n), 9) AS macro FROM a")
def overall_accuracy(spark, d):
    return M.overall(_predictions(spark, d)).withColumn("macro", F.round("macro", 9))


@query(f"WITH {_PRED} SELECT truth, pred, count(*) AS n FROM p WHERE truth <> pred GROUP BY 1, 2")
def confusions(spark, d):
    return M.confusions(_predictions(spark, d))


@query(f"WITH {_PRED}, r AS (SELECT *, row_number() OVER (ORDER BY confidence, c_custkey) AS rn, count(*) OVER () AS n FROM p) SELECT CAST((rn * 10 - 1) // n AS INTEGER) AS bucket, count(*) AS n, count(*) FILTER (truth = pred) AS correct FROM r GROUP BY 1")
def confidence_deciles(spark, d):
    b = M.equal_buckets(_predictions(spark, d), ["confidence", "c_custkey"], 10)
    return b.groupBy("bucket").agg(F.count("*").alias("n"), F.count_if(F.col("truth") == F.col("pred")).alias("correct"))


@query(
    """WITH s AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1), o AS (SELECT c_nationkey, row_number() OVER (ORDER BY n DESC, c_nationkey) AS place FROM s),
    r AS (SELECT c_custkey, c_nationkey, place, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS r FROM customer JOIN o USING (c_nationkey))
    SELECT c_custkey, c_nationkey FROM r ORDER BY CASE WHEN r < 1 THEN 0 ELSE 1 END, CASE WHEN r < 1 THEN place ELSE r END, CASE WHEN r < 1 THEN r ELSE place END LIMIT 60"""
)
def stratified_sample(spark, d):
    return M.stratified_sample(table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", "c_custkey", 60, 1)


_CV = _GRAMS.format(doc="p_partkey", text="p_name || ' ' || p_brand", table="part").split(",\n  idf AS")[0] + """,
  f AS (SELECT p_partkey AS doc, p_type AS label, (row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) - 1) % 5 AS fold FROM part), o AS (SELECT i AS part_out FROM range(5) AS r(i)),
  size AS (SELECT part_out, count(*) AS size FROM f, o WHERE fold <> part_out GROUP BY 1), x AS (SELECT part_out, doc, label, fold, term, n FROM tg JOIN f USING (doc), o),
  idf AS (SELECT part_out, term, ln((any_value(size) + 1.0::DOUBLE) / (count(*) + 1.0::DOUBLE)) + 1 AS idf FROM x JOIN size USING (part_out) WHERE fold <> part_out GROUP BY 1, 2),
  v0 AS (SELECT part_out, doc, label, fold, term, (1 + ln(n)) * idf AS w FROM x JOIN idf USING (part_out, term)), v AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY part_out, doc)) AS u FROM v0),
  c0 AS (SELECT part_out, label, term, sum(u) AS w FROM v WHERE fold <> part_out GROUP BY 1, 2, 3), c AS (SELECT part_out, label, term, w / sqrt(sum(w * w) OVER (PARTITION BY part_out, label)) AS w FROM c0),
  s AS (SELECT v.doc, c.label AS pred, sum(u * c.w) AS score FROM v JOIN c ON v.part_out = c.part_out AND v.term = c.term WHERE fold = v.part_out GROUP BY 1, 2)
  SELECT doc, label AS truth, arg_min(pred, (-round(score, 9), pred)) AS pred FROM s JOIN f USING (doc) GROUP BY 1, 2"""


@query(_CV)
def cross_validate(spark, d):
    return gold.cross_validate(_part_docs(spark, d), 5)


@query("SELECT CAST(NULL AS VARCHAR) AS row_uid, CAST(NULL AS VARCHAR) AS problem WHERE false UNION ALL SELECT 'o' || o_orderkey, 'label and url disagree' FROM orders WHERE (o_orderstatus = 'F') <> (o_totalprice > 50000) UNION ALL SELECT 'o' || o_orderkey, 'no evidence' FROM orders WHERE o_orderpriority LIKE '5%'")
def gold_label_checks(spark, d):
    o = table(spark, d, "orders")
    g = o.select(
        F.concat(F.lit("o"), "o_orderkey").alias("row_uid"), F.when(F.col("o_totalprice") > 50000, "https://x.test").alias("url"),
        F.when(F.col("o_orderstatus") == "F", "correct").otherwise("none").alias("label"), F.when(~F.col("o_orderpriority").startswith("5"), "seen").alias("evidence"),
    )
    return gold.url_label_problems(g)


# ---- calibration ----------------------------------------------------------------------------

_LABELLED = "l AS (SELECT doc_id, floor(least(n_chars, 4999) / 50) / 100 AS score, quality = 1 AS correct FROM labels JOIN documents USING (doc_id)), g AS (SELECT score, count(*) AS n, CAST(sum(correct::INT) AS DOUBLE) AS y FROM l GROUP BY 1)"
_CURVE = _LABELLED + """, c AS (SELECT score, sum(n) OVER (ORDER BY score) AS cn, sum(y) OVER (ORDER BY score) AS cy, n, y FROM g),
  m AS (SELECT k.score, i.score AS i, min((j.cy - i.cy + i.y) / (j.cn - i.cn + i.n)) AS low FROM c k JOIN c i ON i.score <= k.score JOIN c j ON j.score >= k.score GROUP BY 1, 2),
  v AS (SELECT score, max(low) AS value FROM m GROUP BY 1)"""


def _labelled(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", (F.floor(F.least("n_chars", F.lit(4999)) / 50) / 100).alias("score"))
    return docs.join(table(spark, d, "labels"), "doc_id").select("doc_id", "score", (F.col("quality") == 1).alias("correct"))


@query(f"WITH {_CURVE} SELECT min(score) AS threshold, round(value, 9) AS value FROM v GROUP BY 2")
def isotonic_fit(spark, d):
    return calibrate.fit_isotonic(_labelled(spark, d)).groupBy(F.round("value", 9).alias("value")).agg(F.min("threshold").alias("threshold"))


@query(f"WITH {_CURVE} SELECT n_nationkey, round(value, 9) AS p FROM (SELECT n_nationkey, greatest(n_nationkey / 30.0::DOUBLE, (SELECT min(score) FROM v)) AS s FROM nation) ASOF JOIN v ON s >= v.score")
def isotonic_predict(spark, d):
    curve = calibrate.curve_of(calibrate.fit_isotonic(_labelled(spark, d)))
    return table(spark, d, "nation").select("n_nationkey", F.round(calibrate.predict(F.col("n_nationkey") / F.lit(30.0), curve), 9).alias("p"))


_BINS = f"WITH {_LABELLED}, b AS (SELECT CAST(least(floor(score * 10), 9) AS INTEGER) AS bin, count(*) AS n, avg(score) AS mean_predicted, avg(correct::INT) AS observed FROM l GROUP BY 1)"


def _scored(spark, d) -> DataFrame:
    return _labelled(spark, d).select(F.col("score").alias("p"), "correct")


@query(_BINS + " SELECT bin, n, round(mean_predicted, 9) AS mean_predicted, round(observed, 9) AS observed FROM b")
def reliability_bins(spark, d):
    return calibrate.reliability(_scored(spark, d)).withColumns({c: F.round(c, 9) for c in ("mean_predicted", "observed")})


@query(_BINS + " SELECT round(sum(abs(mean_predicted - observed) * n) / sum(n), 9) AS ece FROM b")
def calibration_error(spark, d):
    return calibrate.calibration_error(calibrate.reliability(_scored(spark, d))).withColumn("ece", F.round("ece", 9))


@query(f"WITH {_LABELLED} SELECT k / 10.0::DOUBLE AS tau, count(*) FILTER (score >= k / 10.0::DOUBLE) AS selected, count(*) FILTER (score < k / 10.0::DOUBLE) AS abstained, round(coalesce(avg(correct::INT) FILTER (score >= k / 10.0::DOUBLE), 0), 9) AS precision FROM l, range(10) AS r(k) GROUP BY k")
def abstention_curve(spark, d):
    return calibrate.abstention(_scored(spark, d)).withColumn("precision", F.round("precision", 9))


@query(
    f"""WITH {_LABELLED}, f AS (SELECT score, correct, (dense_rank() OVER (ORDER BY doc_id) - 1) % 5 AS fold FROM l),
    h AS (SELECT r.i AS part, score, count(*) AS n, CAST(sum(correct::INT) AS DOUBLE) AS y FROM f, range(5) AS r(i) WHERE fold <> r.i GROUP BY 1, 2), c AS (SELECT *, sum(n) OVER w AS cn, sum(y) OVER w AS cy FROM h WINDOW w AS (PARTITION BY part ORDER BY score)),
    m AS (SELECT k.part, k.score, i.score AS i, min((j.cy - i.cy + i.y) / (j.cn - i.cn + i.n)) AS low FROM c k JOIN c i ON i.part = k.part AND i.score <= k.score JOIN c j ON j.part = k.part AND j.score >= k.score GROUP BY 1, 2, 3),
    v AS (SELECT part, score, max(low) AS value FROM m GROUP BY 1, 2), a AS (SELECT fold, correct, greatest(f.score, lowest) AS s FROM f JOIN (SELECT part, min(score) AS lowest FROM v GROUP BY 1) ON part = fold),
    p AS (SELECT value AS p, correct FROM a ASOF JOIN v ON a.fold = v.part AND a.s >= v.score), b AS (SELECT least(floor(round(p, 9) * 10), 9) AS bin, count(*) AS n, avg(p) AS mean, avg(correct::INT) AS rate FROM p GROUP BY 1)
    SELECT round(sum(abs(mean - rate) * n) / sum(n), 6) AS ece FROM b"""
)
def held_out_error(spark, d):
    judged = calibrate.held_out(_labelled(spark, d), "doc_id", 5)
    return calibrate.calibration_error(calibrate.reliability(judged.withColumn("p", F.round("p", 9)))).withColumn("ece", F.round("ece", 6))


@query(_SCORED + "SELECT row_uid, url, round(weighted, 6) AS score, be AS correct FROM r WHERE be IS NOT NULL")
def harvest_pairs(spark, d):
    return calibrate.harvest(candidate_pairs(spark, d, coded=True, digits=6))


# ---- characteristics ------------------------------------------------------------------------

_RULES = """rules AS (SELECT t.p_type AS module, 'GLOBAL_PACKAGING' AS characteristic, 'Close' AS open_close, ['COLD', 'HOT', 'BLUE', 'RING', 'BOLT'] AS allowed FROM (SELECT DISTINCT p_type FROM part) t
  UNION ALL SELECT p_type, 'GLOBAL_IF_MEDICATED', 'Open-ended', CAST([] AS VARCHAR[]) FROM (SELECT DISTINCT p_type FROM part WHERE p_type < 'M'))"""


def _rules(spark, d) -> DataFrame:
    types = table(spark, d, "part").select(F.col("p_type").alias("module")).distinct()
    closed = types.select("module", F.lit("GLOBAL_PACKAGING").alias("characteristic"), F.lit("Close").alias("open_close"), F.array(*map(F.lit, ("COLD", "HOT", "BLUE", "RING", "BOLT"))).alias("allowed_values"))
    return closed.unionByName(types.where("module < 'M'").select("module", F.lit("GLOBAL_IF_MEDICATED").alias("characteristic"), F.lit("Open-ended").alias("open_close"), F.array().cast("array<string>").alias("allowed_values")))


_VALUES = "x AS (SELECT p_partkey, p_type AS module, ['GLOBAL_PACKAGING', 'GLOBAL_IF_MEDICATED'][CAST(p_partkey % 2 + 1 AS INTEGER)] AS characteristic, upper(replace(p_name, ' ', ' & ')) AS v FROM part)"


def _values(spark, d) -> DataFrame:
    name = F.when(F.col("p_partkey") % 2 == 0, "GLOBAL_PACKAGING").otherwise("GLOBAL_IF_MEDICATED")
    return table(spark, d, "part").select(F.col("p_partkey").alias("row_uid"), F.col("p_type").alias("module"), name.alias("characteristic"), F.replace(F.col("p_name"), F.lit(" "), F.lit("&  ")).alias("value"))


@query(
    f"""WITH {_RULES}, {_VALUES}, y AS (SELECT p_partkey AS row_uid, r.module IS NOT NULL AS applicable, v, open_close = 'Open-ended' OR len(list_filter(string_split(v, ' & '), lambda p: NOT list_contains(allowed, p))) = 0 AS ok FROM x LEFT JOIN rules r ON x.module = r.module AND x.characteristic = r.characteristic)
    SELECT row_uid, applicable, CASE WHEN applicable AND ok THEN v END AS coded, CASE WHEN applicable AND NOT ok THEN v END AS rejected FROM y"""
)
def closed_vocab_validate(spark, d):
    return C.validate(_values(spark, d), _rules(spark, d)).select("row_uid", "applicable", "coded", "rejected")


_MODULES = "m AS (SELECT c_custkey, t[CAST(c_custkey % len(t) + 1 AS INTEGER)] AS truth, t[CAST(c_nationkey % len(t) + 1 AS INTEGER)] AS pred FROM customer, (SELECT list_sort(list(DISTINCT p_type)) AS t FROM part))"


def _modules(spark, d) -> DataFrame:
    names = _few(table(spark, d, "part"), "p_type", 1000)
    pick = lambda c: F.try_element_at(F.array(*map(F.lit, names)), (F.col(c) % len(names) + 1).cast("int"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("row_uid"), pick("c_custkey").alias("truth"), pick("c_nationkey").alias("pred"))


@query(
    f"""WITH {_RULES}, {_MODULES}, s AS (SELECT module, list(characteristic) AS s FROM rules GROUP BY 1), k AS (SELECT len(list_intersect(a.s, b.s)) AS tp, len(b.s) - len(list_intersect(a.s, b.s)) AS fp, len(a.s) - len(list_intersect(a.s, b.s)) AS fn FROM m JOIN s a ON a.module = truth JOIN s b ON b.module = pred)
    SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, count(*) FILTER (fp = 0 AND fn = 0) AS exact_rows, sum(tp) / (sum(tp) + sum(fp)) AS precision, sum(tp) / (sum(tp) + sum(fn)) AS recall FROM k"""
)
def applicability_pr(spark, d):
    m = _modules(spark, d)
    return C.precision_recall(C.applicability(m.select("row_uid", "truth"), m.select("row_uid", "pred"), _rules(spark, d)))


@query(
    """WITH x AS (SELECT p_type AS characteristic, p_name AS a, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) WHEN 2 THEN NULL ELSE 'other' END AS b FROM part)
    SELECT characteristic, count(*) AS applicable, count(b) AS predicted, count(*) FILTER (a = b) AS exact, count(*) FILTER (list_sort(string_split(a, ' ')) = list_sort(string_split(b, ' '))) AS set_equal FROM x GROUP BY 1"""
)
def characteristic_accuracy(spark, d):
    word = lambda i: F.split_part("p_name", F.lit(" "), F.lit(i))
    k = F.col("p_partkey") % 4
    truth = F.concat_ws(" & ", word(1), word(2))
    pred = F.when(k == 0, truth).when(k == 1, F.concat_ws(" & ", word(2), word(1))).when(k == 3, "other")
    return C.accuracy(table(spark, d, "part").select(F.col("p_type").alias("characteristic"), truth.alias("truth"), pred.alias("pred")))


# ---- the whole chain ------------------------------------------------------------------------


def _chain(spark, d) -> DataFrame:
    """Each record with its registry hit, selected page and features, class and gated values."""
    rows = products(spark, d)
    ranked = cut(_first_ranked(spark, d, 2, rows))
    chosen = match.select(ranked)
    best = ranked.select("row_uid", "url", "barcode_exact", "brand_match", "size_match", "count_match", "variant_overlap", "format_consistent", "retailer_domain_match", "negative_flags", "calibrated", F.col("gtin").alias("page_gtin"), F.col("title").alias("page_title"))
    hits = registry.lookup(rows.select("row_uid", "gtin_id", "fp_id", "variant_terms"), _entities(rows), _identity_idf(rows))
    types = table(spark, d, "part").select(F.col("p_partkey").alias("row_index"), F.col("p_type").alias("module"))
    gated = C.gate(rows.join(types, "row_index").select("row_uid", "module"), _rules(spark, d))
    df = rows.select("row_uid", "row_index", "variant_terms", "pack_count", "size_ml", "size_g").join(hits, "row_uid").join(chosen.drop("reason"), "row_uid", "left").join(best, ["row_uid", "url"], "left").join(gated, "row_uid", "left")
    none = F.lit(None).cast("string")
    return df.withColumns(
        {
            "module_source": F.lit("model"), "nearest": none, "nearest_similarity": F.lit(None).cast("double"), "module_runner_up": none, "module_gap": F.lit(None).cast("double"),
            "values_source": F.lit("gate_only"), "rejected": F.create_map().cast("map<string,string>"), "image_sha256": none, "page_jsonld": none, "page_body": F.when(F.col("url").isNotNull(), ""),
            "page_status": F.when(F.col("url").isNotNull(), "ok"),
        }
    )


@query(
    _SCORED
    + _TIERS
    + """, best AS (SELECT row_uid, max(CASE WHEN position = 1 AND NOT rejected THEN url END) AS url, coalesce(max(CASE WHEN position = 1 AND NOT rejected THEN score END), 0) AS confidence,
      coalesce(max(CASE WHEN position = 1 AND NOT rejected THEN score END) - coalesce(max(CASE WHEN position = 2 AND NOT rejected THEN score END), 0), 0) AS gap FROM r GROUP BY row_uid)
    SELECT k.row_uid, t0.id IS NOT NULL OR t1.id IS NOT NULL AS hit, CASE WHEN t0.id IS NOT NULL THEN 'tier0_exact' WHEN t1.id IS NOT NULL THEN 'tier1_ann' END AS tier, coalesce(t0.id, t1.id) AS entity_id,
      best.url, round(confidence, 6) AS confidence, round(gap, 6) AS gap, p_type AS module FROM keyed k LEFT JOIN t0 USING (row_uid) LEFT JOIN t1 USING (row_uid) LEFT JOIN best USING (row_uid) JOIN part ON p_partkey = row_index"""
)
def resolve_products(spark, d):
    """The flagship: identity, registry entity, winning page, score and lead of each record."""
    return _chain(spark, d).select("row_uid", "hit", "tier", "entity_id", "url", F.round("confidence", 6).alias("confidence"), F.round("gap", 6).alias("gap"), "module")


_TWO = "CAST(round(CAST(CAST({0} AS VARCHAR) AS DECIMAL(38, 20)), 2) AS VARCHAR)"
_SAID = (
    _SCORED
    + _TIERS
    + f""", best AS (SELECT row_uid, url, be, hit AS found, want, size_match, count_match, fmt, score FROM r WHERE position = 1 AND NOT rejected), lag AS (SELECT row_uid, score AS second FROM r WHERE position = 2 AND NOT rejected),
    u AS (SELECT k.*, t0.id IS NOT NULL AS h0, t1.id IS NOT NULL AS h1, t1.c AS sim, url, be, found, want, size_match, count_match, fmt, score - coalesce(second, 0) AS gap, p_type, regexp_extract(url, '^https://([^/]*)', 1) AS host,
        CASE WHEN size_ml IS NOT NULL THEN printf('%g', size_ml) || ' ml' WHEN size_g IS NOT NULL THEN printf('%g', size_g) || ' g' END AS phrase
      FROM keyed k LEFT JOIN t0 USING (row_uid) LEFT JOIN t1 USING (row_uid) LEFT JOIN best USING (row_uid) LEFT JOIN lag USING (row_uid) JOIN part ON p_partkey = row_index),
    b AS (SELECT *, NOT h0 AND NOT h1 AND url IS NOT NULL AS page, list_filter([{{'t': 'brand match 1.00', 'c': 'selection.brand_match'}}, {{'t': CASE WHEN size_match IN ('exact', 'unit_converted') THEN 'size ' || size_match || coalesce(' (' || phrase || ')', '') END, 'c': 'selection.size_match'}},
        {{'t': CASE WHEN count_match = 'exact' AND coalesce(pack_count, 0) <> 0 THEN 'pack count ' || pack_count END, 'c': 'selection.count_match'}}, {{'t': CASE WHEN found > 0 THEN 'variant overlap ' || {_TWO.format("(found::DOUBLE / want)")} || ' (' || array_to_string(variant_terms[1:4], ', ') || ')' END, 'c': 'selection.variant_overlap'}},
        {{'t': CASE WHEN fmt THEN 'format consistent' END, 'c': 'selection.format_consistent'}}], lambda x: x.t IS NOT NULL) AS basis, list_filter([CASE WHEN size_match = 'mismatch' THEN 'a size mismatch' END, CASE WHEN count_match = 'mismatch' THEN 'a pack-count mismatch' END], lambda x: x IS NOT NULL) AS marks FROM u)
    SELECT row_uid, concat_ws(' ',
      CASE WHEN h0 OR h1 THEN 'Identity confirmed by ' || CASE WHEN h0 THEN 'exact barcode match' ELSE 'near-duplicate identity match (similarity ' || {_TWO.format("sim")} || ')' END || ' to a previously resolved item; the page and its characteristics are carried from that record without re-examination.'
        WHEN url IS NULL THEN 'No candidate page met the evidence threshold; the module and characteristics are derived from the retailer description alone.'
        WHEN be THEN 'The selected page (' || host || ') publishes EAN ' || barcode || ', equal to the record''s barcode — a decisive identity match.'
        ELSE 'The selected page (' || host || ') was ranked first on ' || array_to_string(list_transform(basis, lambda x: x.t), ', ') || CASE WHEN gap > 0 THEN ', ahead of the runner-up by ' || {_TWO.format("gap")} ELSE '' END || '.'
          || CASE WHEN len(marks) > 0 THEN ' It was demoted for ' || array_to_string(marks, ', ') || ' and still won, so no better candidate was found.' ELSE '' END END,
      'Classified as ' || p_type || ' from the description.', CASE WHEN p_type < 'M' THEN '2' ELSE '1' END || ' characteristic(s) apply to this module; values were not extracted in this run.', CASE WHEN page THEN 'Page evidence used: the page title.' END) AS reasoning,
    concat_ws(',', CASE WHEN h0 THEN 'registry.tier0_exact' WHEN h1 THEN 'registry.tier1_ann' WHEN url IS NULL THEN 'selection.abstained' WHEN be THEN 'selection.url,selection.gtin_exact'
        ELSE concat_ws(',', 'selection.url', array_to_string(list_transform(basis, lambda x: x.c), ','), CASE WHEN gap > 0 THEN 'selection.runner_up_gap' END, CASE WHEN len(marks) > 0 THEN 'selection.demotions' END) END,
      'module.module,characteristics.gate_only', CASE WHEN page THEN 'evidence.fields' END) AS claims FROM b"""
)


@query(_SAID)
def reasoning_text(spark, d):
    return reason.compose(_chain(spark, d)).select("row_uid", "reasoning", F.array_join("claims", ",").alias("claims"))


def _output(spark, d) -> DataFrame:
    raw = products(spark, d)
    cells = {"ITEM_CODE": F.col("item_code"), "NAN_KEY": F.col("nan_key"), "EXTERNAL_CODE": F.col("barcode_raw"), "COUNTRY": F.array_join("countries", ","), "RETAILER_DESC": F.col("desc_raw"), "RETAILER": F.col("retailer_raw"), "BRAND": F.col("brand")}
    sheet = raw.select("row_uid", "row_index", *[c.alias(n) for n, c in cells.items()])
    types = table(spark, d, "part").select(F.concat(F.lit("dev:"), "p_partkey").alias("row_uid"), F.col("p_type").alias("module"), "p_name", "p_partkey")
    value = F.create_map(F.lit("GLOBAL_PACKAGING"), F.when(F.col("p_name").startswith("hot"), "HOT"))
    results = types.select("row_uid", F.concat(F.lit("https://x.test/"), "p_partkey").alias("url"), F.lit("because").alias("reasoning"), "module", value.alias("values"))
    done = types.where("p_partkey % 10 <> 3").select("row_uid")
    return runs.assemble(sheet, results, done)


@query(
    _with("""SELECT row_index, row_index AS "ITEM_CODE", code AS "EXTERNAL_CODE", array_to_string(countries, ',') AS "COUNTRY", desc_raw AS "RETAILER_DESC", CASE WHEN row_index % 10 <> 3 THEN 'https://x.test/' || row_index END AS "PRODUCT_URL",
    CASE WHEN row_index % 10 <> 3 THEN p_type END AS "MODULE", CASE WHEN row_index % 10 <> 3 AND p_name LIKE 'hot%' THEN 'HOT' END AS "GLOBAL_PACKAGING" FROM q JOIN (SELECT p_partkey, p_type FROM part) ON p_partkey = row_index""")
)
def assemble_output(spark, d):
    return _output(spark, d).select("row_index", "ITEM_CODE", "EXTERNAL_CODE", "COUNTRY", "RETAILER_DESC", "PRODUCT_URL", "MODULE", "GLOBAL_PACKAGING")


@query("SELECT count(*) AS rows, count(*) FILTER (p_partkey % 10 = 3) AS blank_rows, count(*) FILTER (p_partkey % 10 <> 3) AS \"MODULE\", count(*) FILTER (p_partkey % 10 <> 3 AND p_name LIKE 'hot%') AS \"GLOBAL_PACKAGING\" FROM part")
def fill_report(spark, d):
    return runs.fill_report(_output(spark, d)).select("rows", "blank_rows", "MODULE", "GLOBAL_PACKAGING")


@query("SELECT 'unknown module' AS problem, count(*) FILTER (p_partkey % 10 = 1) AS n FROM part UNION ALL SELECT 'value not allowed', count(*) FILTER (p_partkey % 10 <> 1 AND p_name NOT LIKE 'hot%') FROM part UNION ALL SELECT 'value does not apply', count(*) FILTER (p_partkey % 10 = 1) FROM part")
def output_violations(spark, d):
    module = F.when(F.col("p_partkey") % 10 == 1, "NONE").otherwise(F.col("p_type"))
    value = F.create_map(F.lit("GLOBAL_PACKAGING"), F.when(F.col("p_name").startswith("hot"), "HOT").otherwise("WARM"))
    results = table(spark, d, "part").select(F.col("p_partkey").alias("row_uid"), module.alias("module"), value.alias("values"))
    return runs.violations(results, _rules(spark, d)).groupBy("problem").agg(F.count("*").alias("n"))


@query(
    """SELECT count(*) AS rows, count(*) FILTER (o_orderstatus = 'F') AS failed, count(*) FILTER (o_orderpriority LIKE '1%') AS tier0, count(*) FILTER (o_orderpriority LIKE '2%') AS tier1, count(*) FILTER (o_orderstatus <> 'F') AS selected,
    count(*) FILTER (o_orderstatus = 'P') AS gtin_confirmed, count(*) FILTER (o_totalprice > 100000) AS adjudicated, count(*) AS with_module FROM orders"""
)
def run_summary(spark, d):
    o = table(spark, d, "orders")
    return runs.run_summary(
        o.select(
            F.when(F.col("o_orderpriority").startswith("1"), "tier0_exact").when(F.col("o_orderpriority").startswith("2"), "tier1_ann").alias("tier"),
            F.when(F.col("o_orderstatus") != "F", "u").alias("url"), (F.col("o_totalprice") > 100000).alias("adjudicated"), F.when(F.col("o_orderstatus") == "P", "gtin_exact").alias("reason"),
            F.lit("m").alias("module"), F.when(F.col("o_orderstatus") == "F", "match").alias("failed_stage"),
        )
    )


@query("WITH l AS (SELECT user_id, arg_max(event_type, event_id) AS stage FROM events GROUP BY 1) SELECT user_id AS row_uid, stage FROM l WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def last_failures(spark, d):
    f = table(spark, d, "events").select(F.col("user_id").alias("row_uid"), F.col("event_id").alias("seq"), F.col("event_type").alias("stage"), F.col("event_type").alias("error_type"))
    return runs.last_failures(f, table(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("row_uid"))).select("row_uid", "stage")


__all__ = ["SQL", "vocab"]
