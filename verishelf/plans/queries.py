"""Registered queries over the driver's tables, each with its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verishelf.functions import pages as P
from verishelf.functions import text as T
from verishelf.functions import urls as U
from verishelf.functions import vocab
from verishelf.operators import match, products, registry, runs
from verishelf.operators import textmodel as M
from verishelf.operators.blocks import round_to
from verishelf.plans.inputs import PRODUCTS_SQL, best_pairs, candidate_pairs, ranked_pairs, raw_products, table
from verishelf.plans.inputs import products as product_rows
from verishelf.sources.tables import cached, check_schema, cut, pending

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _with(body: str) -> str:
    return f"WITH {PRODUCTS_SQL}\n{body}"


# ---- records --------------------------------------------------------------------------------


@query(_with("SELECT row_uid, desc_clean, size_value, size_unit, size_ml, size_g FROM q"))
def normalize_sizes(spark, d):
    return product_rows(spark, d).select("row_uid", "desc_clean", "size_value", "size_unit", "size_ml", "size_g")


@query(_with("SELECT row_uid, CAST(pack_count AS INTEGER) AS pack_count FROM q"))
def parse_counts(spark, d):
    return product_rows(spark, d).select("row_uid", "pack_count")


@query(_with("SELECT row_uid, array_to_string(variant_terms, ' ') AS variants, array_to_string(format_hints, ' ') AS formats FROM q"))
def variant_terms(spark, d):
    return product_rows(spark, d).select("row_uid", F.array_join("variant_terms", " ").alias("variants"), F.array_join("format_hints", " ").alias("formats"))


@query(_with("SELECT row_uid, array_to_string(list_filter(['000000' || 1, 'unit 000' || (row_index % 100)], lambda x: x LIKE 'unit%'), ' ') AS units, CASE WHEN again <> '' THEN 1 ELSE 0 END + CASE WHEN s2 <> '' THEN 1 ELSE 0 END AS repeats FROM q"))
def stripped_junk(spark, d):
    rows = product_rows(spark, d)
    units = F.filter("stripped_junk", lambda x: F.startswith(x, F.lit("unit")))
    repeats = F.filter("stripped_junk", lambda x: x.rlike(r"^(\d+ML|Brand\d+)$"))
    return rows.select("row_uid", F.array_join(units, " ").alias("units"), F.size(repeats).alias("repeats"))


@query(_with("SELECT row_uid, code AS barcode_raw, barcode, corrupt AS barcode_corrupt, valid, brand, brand_owner, array_to_string(countries, ',') AS countries, row_index AS item_code FROM q"))
def barcode_validity(spark, d):
    return product_rows(spark, d).select(
        "row_uid", "barcode_raw", "barcode", "barcode_corrupt", T.barcode_valid(F.col("barcode")).alias("valid"), "brand", "brand_owner", F.array_join("countries", ",").alias("countries"), "item_code"
    )


@query(
    """SELECT o_orderkey, regexp_matches(c, '^\\d{1,3}0{6,}$') AS corrupt, NOT regexp_matches(c, '^\\d{1,3}0{6,}$') AND length(c) IN (8, 12, 13, 14) AS valid
    FROM (SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) || repeat('0', CAST(o_orderkey % 11 AS INTEGER)) AS c FROM orders)"""
)
def barcode_fingerprint(spark, d):
    c = F.concat(F.col("o_orderkey").cast("string"), F.repeat(F.lit("0"), (F.col("o_orderkey") % 11).cast("int")))
    return table(spark, d, "orders").select("o_orderkey", T.barcode_corrupt(c).alias("corrupt"), T.barcode_valid(T.barcode(c)).alias("valid"))


@query("SELECT count(*) AS rows, 0 AS problems FROM part")
def schema_check(spark, d):
    raw = raw_products(spark, d)
    problems = check_schema(raw, raw.columns, ["RETAILER_DESC", "BRAND", "EXTERNAL_CODE"])
    return raw.agg(F.count("*").alias("rows")).withColumn("problems", F.lit(len(problems)))


@query(_with("SELECT row_uid, gtin_id AS key, 'exact_gtin' AS method FROM keyed WHERE gtin_id IS NOT NULL UNION ALL SELECT row_uid, fp_id, 'fingerprint' FROM keyed WHERE fp_id IS NOT NULL"))
def block_keys(spark, d):
    return products.block_keys(product_rows(spark, d))


_KEYS = ", k AS (SELECT row_uid, gtin_id AS key, 'exact_gtin' AS method FROM keyed WHERE gtin_id IS NOT NULL UNION ALL SELECT row_uid, fp_id, 'fingerprint' FROM keyed WHERE fp_id IS NOT NULL)"


@query(_with(_KEYS + " SELECT method, count(*) AS blocks, count(*) FILTER (n > 1) AS multi_row_blocks, CAST(sum(n * (n - 1) // 2) AS BIGINT) AS pairs FROM (SELECT method, key, count(*) AS n FROM k GROUP BY 1, 2) GROUP BY method"))
def block_stats(spark, d):
    return products.block_stats(products.block_keys(product_rows(spark, d)))


@query(_with("SELECT a.row_uid AS left_uid, b.row_uid AS right_uid FROM keyed a JOIN keyed b ON a.fp_id = b.fp_id AND a.row_uid < b.row_uid"))
def blocked_pairs(spark, d):
    return products.blocked_pairs(product_rows(spark, d), "fp_id", "row_uid").select("left_uid", "right_uid")


@query(
    _with(
        """, s AS (SELECT q.*, CASE WHEN CAST(substr(retailer_raw, 10) AS BIGINT) % 2 = 0 THEN 's' || CAST(substr(retailer_raw, 10) AS BIGINT) || '.test' END AS domain,
      array_to_string(list_filter(list_concat([brand], variant_terms, format_hints, [coalesce(CASE WHEN size_value = floor(size_value) THEN CAST(CAST(size_value AS BIGINT) AS VARCHAR) ELSE CAST(size_value AS VARCHAR) END || size_unit, '')]), lambda x: x <> ''), ' ') AS phrase
      FROM q)
    SELECT row_uid, 'S1' AS strategy, '"' || barcode || '"' AS text FROM s WHERE valid UNION ALL SELECT row_uid, 'S2', barcode || ' ' || brand FROM s WHERE valid
    UNION ALL SELECT row_uid, 'S3', phrase FROM s UNION ALL SELECT row_uid, 'S4', 'site:' || domain || ' ' || phrase FROM s WHERE domain IS NOT NULL UNION ALL SELECT row_uid, 'S5', desc_clean FROM s"""
    )
)
def search_queries(spark, d):
    return products.search_queries(product_rows(spark, d))


# ---- registry -------------------------------------------------------------------------------

_VEC = """, t AS (SELECT DISTINCT array_to_string(variant_terms, ' ') AS x FROM keyed WHERE len(variant_terms) > 0),
  tg AS (SELECT x, g, count(*) AS n FROM (SELECT x, '4:' || substr(z, CAST(i AS BIGINT), 4) AS g FROM (SELECT x, ' ' || trim(regexp_replace(lower(x), '[^a-z0-9_]+', ' ', 'g')) || ' ' AS z FROM t), unnest(range(1, length(z) - 2)) AS r(i)) GROUP BY 1, 2),
  idf AS (SELECT g, ln(((SELECT count(*) FROM t) + 1.0::DOUBLE) / (count(*) + 1.0::DOUBLE)) + 1 AS w FROM tg GROUP BY g),
  v0 AS (SELECT x, g, (1 + ln(n)) * w AS w FROM tg JOIN idf USING (g)),
  v AS (SELECT x, g, w / sqrt(sum(w * w) OVER (PARTITION BY x)) AS w FROM v0)"""


def _identity_idf(rows: DataFrame) -> DataFrame:
    texts = cut(rows.where(F.size("variant_terms") > 0).select(F.array_join("variant_terms", " ").alias("text")).distinct())
    return M.idf(M.document_frequencies(M.terms(texts, "text", "text")), texts.count())


def _entities(rows: DataFrame) -> DataFrame:
    """One entity a fingerprint: that of its first record."""
    first = rows.where("fp_id is not null").groupBy("fp_id").agg(F.min_by(F.struct("gtin_id", "variant_terms"), "row_index").alias("f"))
    return first.select(F.col("fp_id").alias("entity_id"), F.array_compact(F.array("fp_id", "f.gtin_id")).alias("block_ids"), F.col("f.variant_terms").alias("variant_terms"))


_TIERS = _VEC + """, e AS (SELECT fp_id, arg_min(gtin_id, row_index) AS gtin_raw, min(row_index) AS i FROM keyed WHERE fp_id IS NOT NULL GROUP BY fp_id),
    e2 AS (SELECT e.fp_id, k.gtin_id, array_to_string(k.variant_terms, ' ') AS x FROM e JOIN keyed k ON k.row_index = e.i),
    t0 AS (SELECT k.row_uid, min(e2.fp_id) AS id FROM keyed k JOIN e2 ON k.gtin_id = e2.gtin_id GROUP BY 1),
    near AS (SELECT k.row_uid, k.fp_id AS id, array_to_string(k.variant_terms, ' ') AS a, e2.x AS b FROM keyed k JOIN e2 ON k.fp_id = e2.fp_id WHERE k.row_uid NOT IN (SELECT row_uid FROM t0) AND len(k.variant_terms) > 0 AND e2.x <> ''),
    cs AS (SELECT a, b, sum(v1.w * v2.w) AS c FROM (SELECT DISTINCT a, b FROM near) JOIN v v1 ON v1.x = a JOIN v v2 ON v2.x = b AND v1.g = v2.g GROUP BY 1, 2),
    t1 AS (SELECT row_uid, id, c FROM near JOIN cs USING (a, b) WHERE round(c, 9) >= 0.75)"""


@query(
    _with(
        _TIERS
        + """ SELECT k.row_uid, t0.id IS NOT NULL OR t1.id IS NOT NULL AS hit, CASE WHEN t0.id IS NOT NULL THEN 'tier0_exact' WHEN t1.id IS NOT NULL THEN 'tier1_ann' END AS tier, coalesce(t0.id, t1.id) AS entity_id, round(CASE WHEN t0.id IS NULL THEN t1.c END, 6) AS similarity
    FROM keyed k LEFT JOIN t0 USING (row_uid) LEFT JOIN t1 USING (row_uid)"""
    )
)
def registry_tier_lookup(spark, d):
    rows = cut(product_rows(spark, d).select("row_uid", "row_index", "gtin_id", "fp_id", "variant_terms"))
    return registry.lookup(rows, _entities(rows), _identity_idf(rows)).withColumn("similarity", F.round("similarity", 6))


@query(
    """WITH b AS (SELECT 'e:' || o_custkey AS entity_id, o_orderkey AS i, 'o:' || o_orderkey AS row_uid, CASE WHEN o_orderstatus <> 'O' THEN o_orderpriority END AS module, o_totalprice AS confidence FROM orders),
    g AS (SELECT entity_id, arg_max(module, i) FILTER (module IS NOT NULL) AS module, arg_max('u' || i, i) AS url, arg_max(confidence, i) AS confidence, list(DISTINCT row_uid) AS m FROM b GROUP BY 1)
    SELECT coalesce(c.entity_id, g.entity_id) AS entity_id, coalesce(g.module, c.module) AS module, coalesce(g.url, c.url) AS resolved_url, coalesce(g.confidence, c.confidence) AS confidence,
      array_to_string(list_sort(list_distinct(list_concat(coalesce(c.m, CAST([] AS VARCHAR[])), coalesce(g.m, CAST([] AS VARCHAR[]))))), ',') AS members
    FROM (SELECT 'e:' || c_custkey AS entity_id, c_mktsegment AS module, 'old' || c_custkey AS url, c_acctbal AS confidence, ['c:' || c_custkey] AS m FROM customer) c FULL JOIN g ON c.entity_id = g.entity_id"""
)
def registry_upsert(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    at = F.timestamp_seconds(F.lit(0))
    none = F.create_map().cast("map<string,string>")
    stored = c.select(
        F.concat(F.lit("e:"), "c_custkey").alias("entity_id"), F.col("c_name").alias("brand"), F.col("c_mktsegment").alias("module"), F.concat(F.lit("old"), "c_custkey").alias("resolved_url"),
        none.alias("characteristics"), F.col("c_acctbal").alias("confidence"), F.array(F.concat(F.lit("c:"), "c_custkey")).alias("member_row_uids"), at.alias("created_at"), at.alias("updated_at"),
    )
    batch = o.select(
        F.concat(F.lit("e:"), "o_custkey").alias("entity_id"), F.concat(F.lit("o:"), "o_orderkey").alias("row_uid"), F.col("o_orderkey").alias("row_index"), F.lit(None).cast("string").alias("brand"),
        F.when(F.col("o_orderstatus") != "O", F.col("o_orderpriority")).alias("module"), F.concat(F.lit("u"), "o_orderkey").alias("resolved_url"), none.alias("characteristics"),
        F.col("o_totalprice").alias("confidence"), F.lit(False).alias("sourced"), F.col("o_orderdate").alias("updated_at"),
    )
    out = registry.upsert(stored, batch)
    return out.select("entity_id", "module", "resolved_url", "confidence", F.array_join("member_row_uids", ",").alias("members"))


@query("SELECT 'p' || p_partkey AS node, 'b' || p_brand || '-' || p_size AS component FROM part UNION ALL SELECT DISTINCT 'b' || p_brand || '-' || p_size, 'b' || p_brand || '-' || p_size FROM part")
def connected_components(spark, d):
    edges = table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("a"), F.concat(F.lit("b"), "p_brand", F.lit("-"), "p_size").alias("b"))
    return registry.components(edges)


@query("SELECT count(*) AS entities, count(*) AS with_module, 0 AS with_characteristics FROM customer")
def registry_summary(spark, d):
    c = table(spark, d, "customer")
    return registry.summary(c.select(F.col("c_custkey").alias("entity_id"), F.col("c_mktsegment").alias("module"), F.create_map().cast("map<string,string>").alias("characteristics")))


# ---- urls and pages -------------------------------------------------------------------------

_URL = r"""u AS (SELECT page_id, url, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS s, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)), '^www\.', '') AS h,
    regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS p, regexp_extract(url, '\?([^#]*)', 1) AS q FROM pages),
  c AS (SELECT page_id, url, h, s || '://' || h || CASE WHEN length(p) > 1 THEN regexp_replace(p, '/+$', '') ELSE p END
      || coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(q, '&'), lambda x: x <> '' AND x NOT LIKE 'utm\_%' ESCAPE '\' AND split_part(x, '=', 1) NOT IN ('ref', 'gclid', 'fbclid', 'sid'))), '&'), ''), '') AS canonical FROM u)"""


@query(f"WITH {_URL} SELECT page_id, canonical, true AS safe FROM c")
def url_canonical(spark, d):
    return table(spark, d, "pages").select("page_id", U.canonical(F.col("url")).alias("canonical"), U.safe(F.col("url")).alias("safe"))


@query(f"WITH {_URL} SELECT canonical, count(*) AS n, min(page_id) AS first_page FROM c GROUP BY 1")
def url_dedup(spark, d):
    return table(spark, d, "pages").groupBy(U.canonical(F.col("url")).alias("canonical")).agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))


@query(
    r"""WITH u AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN 'https://www.buycott.com/upc/' || page_id WHEN 2 THEN 'https://shop.example/en-gb' WHEN 3 THEN 'https://shop.example/search?q=' || page_id WHEN 4 THEN 'https://en.wikipedia.org/wiki/Acme' ELSE 'https://shop.example/acme' END AS url FROM pages)
    SELECT page_id, CASE WHEN page_id % 6 = 1 THEN 'directory' WHEN page_id % 6 IN (2, 5) THEN 'site_root' WHEN page_id % 6 = 3 THEN 'listing_page,site_root' WHEN page_id % 6 = 4 THEN 'non_commerce' ELSE '' END AS flags FROM u"""
)
def url_flags(spark, d):
    k, n = F.col("page_id") % 6, F.col("page_id").cast("string")
    url = (
        F.when(k == 0, F.col("url")).when(k == 1, F.concat(F.lit("https://www.buycott.com/upc/"), n)).when(k == 2, "https://shop.example/en-gb")
        .when(k == 3, F.concat(F.lit("https://shop.example/search?q="), n)).when(k == 4, "https://en.wikipedia.org/wiki/Acme").otherwise("https://shop.example/acme")
    )
    brand = F.when(k == 3, "search").otherwise("ACME")
    return table(spark, d, "pages").select("page_id", F.array_join(U.shape_flags(url, brand), ",").alias("flags"))


_ENTITY = r"replace(replace(replace(replace(replace({0}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '&amp', '&')".replace('\\"', '"')
_TITLE = "trim(regexp_replace(regexp_replace(" + _ENTITY.format(r"regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)") + r", '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"
_BODY = "left(trim(regexp_replace(" + _ENTITY.format(r"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>', ' ', 'g'), '(?is)<style\b.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g')") + r", '\s+', ' ', 'g')), 20000)"


@query(f"SELECT page_id, nullif({_TITLE}, '') AS title FROM pages")
def page_title(spark, d):
    return table(spark, d, "pages").select("page_id", P.page_title(F.col("html")).alias("title"))


@query(f"SELECT page_id, {_BODY} AS body FROM pages")
def page_body_text(spark, d):
    return table(spark, d, "pages").select("page_id", P.body_text(F.col("html")).alias("body"))


@query(f"SELECT page_id, 'sha256:' || left(sha256(html), 16) AS content_hash, length({_BODY}) AS body_chars, 0 AS n_images, CASE WHEN length({_BODY}) < 200 THEN 1 ELSE 0 END AS n_warnings FROM pages")
def page_evidence(spark, d):
    return P.evidence(table(spark, d, "pages")).select("page_id", "content_hash", F.length("body_text").cast("long").alias("body_chars"), F.size("image_urls").alias("n_images"), F.size("parse_warnings").alias("n_warnings"))


@query("SELECT p_partkey, lpad(CAST(p_partkey AS VARCHAR), 13, '0') AS gtin, p_name AS name, p_brand AS brand, 2 AS n_products FROM part")
def jsonld_products(spark, d):
    code = F.lpad(F.col("p_partkey").cast("string"), 13, "0")
    html = F.concat(
        F.lit('<html><script type="application/ld+json">{"@graph":[{"@type":"Organization"},{"@type":["Thing","Product"],"name":"'), "p_name", F.lit('","brand":{"name":"'), "p_brand", F.lit('"},"gtin13":"'), code,
        F.lit('"}]}</script><script type="application/ld+json">{bad</script><script type=\'application/ld+json\'>{"@type":"ProductGroup","gtin":"9"}</script></html>'),
    )
    df = table(spark, d, "part").select("p_partkey", P.jsonld(html).alias("ld"))
    return df.select("p_partkey", P.first_gtin(F.col("ld.products")).alias("gtin"), P.product_name(F.col("ld.products")).alias("name"), P.product_brand(F.col("ld.products")).alias("brand"), F.size("ld.products").alias("n_products"))


# ---- candidates -----------------------------------------------------------------------------


@query(
    """WITH r AS (SELECT l_orderkey AS row_uid, list_position(['S2', 'S3', 'S4', 'S5', 'S1'], 'S' || (l_partkey % 5 + 1)) AS a, l_linenumber AS rank, 'https://s' || l_suppkey % 7 || '.test/p' AS url, l_returnflag = 'A' AS about FROM lineitem),
    f AS (SELECT *, row_number() OVER (PARTITION BY row_uid, url ORDER BY a, rank, about) = 1 AS first FROM r WHERE rank <= 4),
    b AS (SELECT *, coalesce(sum(CASE WHEN first AND NOT about THEN 1 ELSE 0 END) OVER (PARTITION BY row_uid ORDER BY a RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f)
    SELECT row_uid, url, CAST(row_number() OVER (PARTITION BY row_uid ORDER BY about, a, rank, url) AS INTEGER) AS position FROM b WHERE first AND before < 2"""
)
def merge_candidates(spark, d):
    r = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("row_uid"), F.concat(F.lit("S"), F.col("l_partkey") % 5 + 1).alias("strategy"), F.col("l_linenumber").alias("rank"),
        F.concat(F.lit("https://s"), F.col("l_suppkey") % 7, F.lit(".test/p")).alias("url"), (F.col("l_returnflag") == "A").alias("is_about"),
    )
    return products.merge_candidates(r, fetch_budget=2, per_strategy=4).select("row_uid", "url", "position")


_SCORED = _with(
    r""", x AS (SELECT a.row_uid, a.desc_clean, 'https://shop' || b.row_index % 10 || '.example' || CASE b.row_index % 3 WHEN 0 THEN '.co.uk' WHEN 1 THEN '.com' ELSE '.de' END || '/p/' || b.row_index AS url,
      CASE WHEN a.valid AND b.valid THEN a.barcode = b.barcode END AS be,
      (SELECT count(*) FROM (SELECT DISTINCT unnest(list_filter(a.variant_terms, lambda t: length(t) > 2)) AS t) WHERE contains(lower(b.desc_raw), t)) AS hit, len(list_distinct(list_filter(a.variant_terms, lambda t: length(t) > 2))) AS want,
      CASE WHEN a.size_ml IS NOT NULL AND b.size_ml IS NOT NULL THEN CASE WHEN abs(a.size_ml - b.size_ml) < 0.01 THEN CASE WHEN a.size_value = b.size_value THEN 'exact' ELSE 'unit_converted' END ELSE 'mismatch' END
        WHEN a.size_g IS NOT NULL AND b.size_g IS NOT NULL THEN CASE WHEN abs(a.size_g - b.size_g) < 0.01 THEN CASE WHEN a.size_value = b.size_value THEN 'exact' ELSE 'unit_converted' END ELSE 'mismatch' END ELSE 'absent' END AS size_match,
      CASE WHEN a.pack_count IS NULL AND b.pack_count IS NULL THEN 'absent' WHEN coalesce(a.pack_count, 1) = coalesce(b.pack_count, 1) THEN 'exact' ELSE 'mismatch' END AS count_match,
      CASE WHEN a.f <> '' THEN contains(lower(b.desc_raw), trim(a.f)) END AS fmt, CASE b.row_index % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.0 END::DOUBLE AS market
    FROM q a JOIN q b ON a.brand = b.brand AND a.p_size = b.p_size),
    y AS (SELECT *, 0.35::DOUBLE * 1 + 0.3::DOUBLE * CASE WHEN want = 0 THEN 0 ELSE hit::DOUBLE / want END + 0.15::DOUBLE * CASE WHEN fmt THEN 1 ELSE 0 END + 0.1::DOUBLE * 0 + 0.1::DOUBLE * market AS weighted FROM x),
    z AS (SELECT *, CASE WHEN be THEN 1.0::DOUBLE WHEN NOT be THEN 0.0::DOUBLE WHEN size_match = 'mismatch' OR count_match = 'mismatch' THEN greatest(weighted * CASE WHEN size_match = 'mismatch' THEN 0.4::DOUBLE ELSE 1 END * CASE WHEN count_match = 'mismatch' THEN 0.4::DOUBLE ELSE 1 END, 0.01::DOUBLE) ELSE weighted END AS score,
      coalesce(NOT be, false) AS rejected FROM y),
    r AS (SELECT *, row_number() OVER (PARTITION BY row_uid ORDER BY rejected, round(score, 9) DESC, url) AS position FROM z)
    """
)


def _first_ranked(spark, d, k: int, rows=None):
    """The ranked pairs as far as they concern each record's first k usable pages; the first two tell what is selected."""
    return match.rank(match.score(match.features(best_pairs(spark, d, k, rows))))


@query(_SCORED + "SELECT row_uid, url, be AS barcode_exact, size_match, count_match, fmt AS format_consistent, market AS market_signal, round(weighted, 6) AS weighted FROM r")
def match_features(spark, d):
    df = candidate_pairs(spark, d, digits=6)
    return df.select("row_uid", "url", "barcode_exact", "size_match", "count_match", "format_consistent", "market_signal", "weighted")


@query(_SCORED + "SELECT row_uid, url, round(score, 6) AS score, rejected, CAST(position AS INTEGER) AS position FROM r")
def rank_candidates(spark, d):
    return ranked_pairs(spark, d).withColumn("score", round_to(F.col("score"), 6))


@query(
    _SCORED
    + """SELECT row_uid, max(CASE WHEN position = 1 AND NOT rejected THEN url END) AS url, round(coalesce(max(CASE WHEN position = 1 AND NOT rejected THEN score END), 0), 6) AS confidence,
    round(coalesce(max(CASE WHEN position = 1 AND NOT rejected THEN score END) - coalesce(max(CASE WHEN position = 2 AND NOT rejected THEN score END), 0), 0), 6) AS gap,
    coalesce(max(CASE WHEN position = 1 AND NOT rejected THEN be::INT END) = 1, false) AS write_back FROM r GROUP BY row_uid"""
)
def select_best(spark, d):
    return match.select(_first_ranked(spark, d, 2)).select("row_uid", "url", F.round("confidence", 6).alias("confidence"), F.round("gap", 6).alias("gap"), "write_back")


@query(_SCORED + "SELECT row_uid, count(*) AS n FROM r WHERE NOT rejected AND position <= 4 GROUP BY 1")
def adjudication_top_k(spark, d):
    return match.top_k(_first_ranked(spark, d, 4), 4).groupBy("row_uid").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey AS k, avg(CASE WHEN contains('p-' || l_partkey || ' ' || lower(l_returnflag), lower(l_linestatus)) THEN 1.0 ELSE 0.0 END) AS rate FROM lineitem GROUP BY 1")
def brand_signal_rate(spark, d):
    c = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.concat(F.lit("p-"), "l_partkey").alias("url"), F.col("l_returnflag").alias("title"), F.col("l_linestatus").alias("brand"))
    return match.brand_signal(c, "k")


# ---- runs -----------------------------------------------------------------------------------


@query("SELECT event_type AS stage, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def failures_by_stage(spark, d):
    return runs.counts(table(spark, d, "events").select(F.col("event_type").alias("stage")), "stage")


@query(f"WITH {_URL} SELECT regexp_replace(h, ':.*', '') AS host, count(*) FILTER (page_id % 3 = 0) AS ok, count(*) FILTER (page_id % 3 = 1) AS http_error, count(*) FILTER (page_id % 3 = 2) AS timeout FROM u GROUP BY 1")
def domain_outcomes(spark, d):
    k = F.col("page_id") % 3
    f = table(spark, d, "pages").select("url", F.when(k == 0, "ok").when(k == 1, "http_error").otherwise("timeout").alias("status"))
    return runs.outcomes_by_host(f, ("ok", "http_error", "timeout"))


@query(
    """WITH e AS (SELECT user_id, max(epoch(ts)) AS last_at, arg_max(event_type, ts) AS kind FROM events GROUP BY 1)
    SELECT c_custkey, coalesce(1706000000 - floor(e.last_at) <= CASE WHEN kind = 'error' THEN 3600 ELSE 86400 END, false) AS fresh FROM customer LEFT JOIN e ON c_custkey = user_id"""
)
def cache_ttl_lookup(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("c_custkey"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("sec"), F.col("ts").alias("fetched_exact"), "event_type")
    e = e.groupBy("c_custkey").agg(F.max_by("event_type", "fetched_exact").alias("kind"), F.max("sec").alias("fetched_at"))
    c = table(spark, d, "customer").select("c_custkey")
    return cached(c, e, "c_custkey", F.lit(1706000000), F.when(F.col("kind") == "error", 3600).otherwise(86400)).select("c_custkey", "fresh")


@query(
    """SELECT c_custkey AS row_uid FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE props <> '' GROUP BY 1 HAVING count(DISTINCT event_type) = 5)"""
)
def resume_pending(spark, d):
    a = table(spark, d, "events").select(F.col("user_id").alias("row_uid"), F.col("event_type").alias("stage"), F.col("props").alias("payload"))
    return pending(table(spark, d, "customer").select(F.col("c_custkey").alias("row_uid")), a, ("view", "signup", "click", "error", "purchase"))


@query("SELECT event_type AS model, count(*) FILTER (value >= 50) AS calls, count(*) FILTER (value < 50) AS hits, CAST(coalesce(sum(event_id) FILTER (value >= 50), 0) AS BIGINT) AS prompt_tokens, CAST(coalesce(sum(user_id) FILTER (value >= 50), 0) AS BIGINT) AS completion_tokens FROM events GROUP BY 1")
def call_counters(spark, d):
    return runs.call_counters(table(spark, d, "events").select(F.col("event_type").alias("model"), F.col("event_id").alias("prompt_tokens"), F.col("user_id").alias("completion_tokens"), (F.col("value") < 50).alias("from_cache")))


@query(
    """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch(ts) AS at, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY epoch(ts), event_id) AS k FROM events),
    s AS (SELECT event_id, user_id AS engine, k, false AS open, CASE WHEN ok THEN 0 ELSE 1 END AS run, -1.0::DOUBLE AS until FROM e WHERE k = 1
      UNION ALL SELECT e.event_id, e.user_id, e.k, e.at < s.until, CASE WHEN e.at < s.until THEN s.run WHEN e.ok OR s.run = 2 THEN 0 ELSE s.run + 1 END, CASE WHEN e.at >= s.until AND NOT e.ok AND s.run = 2 THEN e.at + 900 ELSE s.until END FROM s JOIN e ON e.user_id = s.engine AND e.k = s.k + 1)
    SELECT event_id, engine, open FROM s"""
)
def breaker_timeline(spark, d):
    from verishelf.streaming.incremental import breaker_timeline as timeline

    return timeline(table(spark, d, "events").select("event_id", F.col("user_id").alias("engine"), F.col("ts").cast("timestamp").cast("double").alias("at"), (F.col("event_type") != "error").alias("ok")))


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from verishelf.plans import checks, evaluation  # noqa: F401  register more

    return dict(Q)


def all_sql() -> dict[str, str]:
    all_queries()
    return dict(SQL)


__all__ = ["all_queries", "all_sql", "query", "vocab"]
