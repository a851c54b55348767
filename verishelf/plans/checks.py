"""Registered queries of the smaller operators: fields, prompts, URLs, matching signals, registry and run records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verishelf.functions import pages as P
from verishelf.functions import text as T
from verishelf.functions import urls as U
from verishelf.operators import characteristics as C
from verishelf.operators import gold, match, reason, registry, runs
from verishelf.operators import textmodel as M
from verishelf.plans.evaluation import _GRAMS, _RULES, _part_vectors, _rules
from verishelf.plans.inputs import products, table
from verishelf.plans.queries import _SCORED, _first_ranked, _with, query
from verishelf.sources import adapters
from verishelf.sources.tables import cache_key, cut, packed_cache
from verishelf.sources.tables import first_rows as first_of

# ---- fields ---------------------------------------------------------------------------------


@query("SELECT p_partkey, replace(replace(upper('global ' || p_type || '/' || p_name), ' ', '_'), '/', '_') AS name FROM part")
def characteristic_names(spark, d):
    raw = F.concat(F.lit(" global "), "p_type", F.lit("/"), "p_name", F.lit(" "))
    return table(spark, d, "part").select("p_partkey", T.characteristic_name(raw).alias("name"))


@query(
    """SELECT o_orderkey, o_orderstatus = 'F' AS flag, CASE WHEN o_orderkey % 3 = 0 THEN 'Close' ELSE 'Open-ended' END AS kind, CASE o_orderkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS n,
    CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN o_orderpriority ELSE 'it''s ' || o_orderstatus END AS last FROM orders"""
)
def sheet_cells(spark, d):
    k = F.col("o_orderkey") % 3
    flag = F.when(F.col("o_orderstatus") == "F", "Y").otherwise("N")
    listed = F.when(k == 0, "[]").when(k == 1, F.concat(F.lit("['"), "o_orderpriority", F.lit("']"))).otherwise(F.concat(F.lit(" ['"), "o_orderpriority", F.lit("', \"it's "), "o_orderstatus", F.lit('"] ')))
    values = gold.allowed_values(listed)
    return table(spark, d, "orders").select("o_orderkey", T.yes_no(flag).alias("flag"), T.open_close(F.when(k == 0, "Close").otherwise("Open-ended")).alias("kind"), F.size(values).alias("n"), F.try_element_at(values, F.lit(-1)).alias("last"))


@query("SELECT doc_id, coalesce(left(text, 60), '') AS repaired FROM documents")
def encoding_repair(spark, d):
    """Texts that were read in the wrong encoding come back as they were."""
    text = F.left(F.coalesce("text", F.lit("")), F.lit(60))
    garbled = F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")
    return table(spark, d, "documents").select("doc_id", T.repair_encoding(garbled).alias("repaired"))


@query("SELECT c_custkey, 'adhoc:' || CAST(CAST('0x' || left(sha256('{\"c0\":\"' || c_name || '\",\"c1\":' || CASE WHEN c_custkey % 2 = 0 THEN '\"' || c_mktsegment || '\"' ELSE 'null' END || '}'), 8) AS BIGINT) AS VARCHAR) AS uid FROM customer")
def adhoc_records(spark, d):
    return table(spark, d, "customer").select("c_custkey", gold.adhoc_uid(F.col("c_name"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment"))).alias("uid"))


@query("SELECT c_custkey AS uid, 'NAME' AS characteristic, c_name AS value FROM customer UNION ALL SELECT c_custkey, 'SEGMENT', CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END FROM customer")
def label_cells(spark, d):
    segment = F.when(F.col("c_custkey") % 4 == 0, "  ").otherwise(F.concat(F.lit(" "), "c_mktsegment"))
    return gold.long_labels(table(spark, d, "customer").select(F.col("c_custkey").alias("uid"), F.col("c_name").alias("NAME"), segment.alias("SEGMENT")), ["NAME", "SEGMENT"], "uid")


@query("SELECT problem, count(*) AS n FROM (SELECT 'pair of one row' AS problem FROM lineitem WHERE l_partkey = l_suppkey UNION ALL SELECT 'given twice' FROM lineitem WHERE l_partkey <> l_suppkey GROUP BY least(l_partkey, l_suppkey), greatest(l_partkey, l_suppkey) HAVING count(*) > 1) GROUP BY 1")
def gold_pair_checks(spark, d):
    pairs = table(spark, d, "lineitem").select(F.col("l_partkey").alias("left"), F.col("l_suppkey").alias("right"), F.lit("same").alias("label"))
    return gold.pair_problems(pairs).groupBy("problem").agg(F.count("*").alias("n"))


@query("WITH p AS (SELECT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b FROM lineitem WHERE l_returnflag = 'A'), q AS (SELECT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b, CASE l_linestatus WHEN 'F' THEN 'same' ELSE 'different' END AS label FROM lineitem WHERE l_linenumber <> 3), c AS (SELECT label = 'same' AS same, EXISTS (SELECT 1 FROM p WHERE p.a = q.a AND p.b = q.b) AS hit FROM q) SELECT count(*) FILTER (hit AND same) AS tp, count(*) FILTER (hit AND NOT same) AS fp, count(*) FILTER (NOT hit AND same) AS fn, count(*) FILTER (hit AND same) / count(*) FILTER (hit) AS precision, count(*) FILTER (hit AND same) / count(*) FILTER (same) AS recall FROM c")
def pair_quality(spark, d):
    li = table(spark, d, "lineitem")
    label = F.when(F.col("l_linenumber") == 3, "ambiguous").when(F.col("l_linestatus") == "F", "same").otherwise("different")
    return gold.pair_quality(li.select(F.col("l_partkey").alias("left"), F.col("l_suppkey").alias("right"), label.alias("label")), li.where("l_returnflag = 'A'").select(F.col("l_suppkey").alias("left"), F.col("l_partkey").alias("right")))


@query("SELECT name, problem FROM (SELECT DISTINCT 'GLOBAL_' || p_type AS name, 'not a column' AS problem FROM part UNION ALL SELECT unnest(['GLOBAL_CONSUMER_LIFESTAGE_CLAIM', 'GLOBAL_IF_MEDICATED', 'GLOBAL_PERCENTAGE_NATURAL_INGREDIENTS', 'GLOBAL_IF_WITH_SENSITIVE_CLAIM', 'GLOBAL_ORAL_CARE_FUNCTION', 'GLOBAL_IF_WITH_FLUORIDE', 'GLOBAL_FLAVOUR_FRAGRANCE_INGREDIENT_GROUP', 'GLOBAL_METHOD_OF_APPLICATION_DISPENSE', 'GLOBAL_PACKAGING_MATERIAL', 'GLOBAL_DESCRIPTIVE_SIZE_OF_TOOTHBRUSH_HEAD_CLAIM', 'GLOBAL_BRISTLE_STRENGTH_CLAIM']), 'not named')")
def guideline_names(spark, d):
    """Names of a guideline sheet against the output's columns; one name has an alias."""
    named = F.when(F.col("p_partkey") % 3 == 0, "GLOBAL PACKAGING").when(F.col("p_partkey") % 3 == 1, "GLOBAL IF WITH INTERSPACE CLAIM").otherwise(F.concat(F.lit("GLOBAL "), "p_type"))
    kinds = table(spark, d, "part").select("p_type").distinct().select(F.concat(F.lit("GLOBAL "), "p_type").alias("n"))
    sheet = table(spark, d, "part").select(named.alias("n")).unionAll(kinds).select(F.lit("M").alias("MODULE NAME"), F.col("n").alias("CHARACTERISTICS NAME"), F.lit("g").alias("Guidelines"))
    return gold.name_problems(gold.guideline_rows(sheet))


@query("SELECT DISTINCT c_mktsegment AS module FROM customer WHERE c_mktsegment NOT IN (SELECT o_orderpriority FROM orders UNION SELECT c_mktsegment FROM customer WHERE c_mktsegment < 'F')")
def orphan_modules(spark, d):
    seg = table(spark, d, "customer").select(F.col("c_mktsegment").alias("module"))
    return gold.orphan_modules(seg, seg.where("module < 'F'"))


_SHAPES = r"""x AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS INTEGER) AS n, CASE (l_orderkey + l_partkey) % 12 WHEN 0 THEN n || ',5 L bottle' WHEN 1 THEN 'v' || n || 'ml ' || n || ' Millilitres' WHEN 2 THEN 'x' || n || '.25KG' WHEN 3 THEN n || 'mlx ' || n || ' oz' WHEN 4 THEN n || ' x 75ml' WHEN 5 THEN n || 'x more 3 pk'
      WHEN 6 THEN 'pack of ' || n || ' 100 gms' WHEN 7 THEN n || '-packs' WHEN 8 THEN 'TwinPack ' || n || ' litre' WHEN 9 THEN n || chr(39) || 's tablets' WHEN 10 THEN 'x ' || n || ' g' ELSE n || ' count x ' || l_linenumber END AS s
    FROM (SELECT *, CAST(l_quantity AS INTEGER) AS n FROM lineitem))"""


@query(
    f"WITH {_SHAPES}" + r""", u AS (SELECT *, 'millilitres|milliliters|millilitre|milliliter|litres|grams|litre|gram|mls|ltr|gms|ml|cl|gm|gr|kg|mg|oz|l|g' AS units FROM x),
    z AS (SELECT *, regexp_extract(' ' || s || ' ', '(?i)[^\w.](\d+(?:[.,]\d+)?)\s*(?:' || units || ')[^a-zA-Z]', 1) AS v, lower(regexp_extract(' ' || s || ' ', '(?i)[^\w.]\d+(?:[.,]\d+)?\s*(' || units || ')[^a-zA-Z]', 1)) AS k,
      regexp_replace(lower(s), '\d+\s*x\s*more', '', 'g') AS c, regexp_replace(lower(s), 'x\s*\d+(\.\d+|\s*(' || units || ')\b)', '', 'g') AS e FROM u)
    SELECT l_orderkey, l_linenumber, l_partkey, n,
      round(replace(nullif(v, ''), ',', '.')::DOUBLE * CASE k WHEN 'l' THEN 1000 WHEN 'litre' THEN 1000 WHEN 'millilitres' THEN 1 WHEN 'ml' THEN 1 END, 6) AS size_ml, round(replace(nullif(v, ''), ',', '.')::DOUBLE * CASE k WHEN 'kg' THEN 1000 WHEN 'oz' THEN 28.349523125 WHEN 'gms' THEN 1 WHEN 'g' THEN 1 END, 6) AS size_g,
      coalesce(TRY_CAST(nullif(regexp_extract(c, '\b(\d+)\s*x\b', 1), '') AS INTEGER), TRY_CAST(nullif(regexp_extract(e, '\bx\s*(\d+)\b', 1), '') AS INTEGER), TRY_CAST(nullif(regexp_extract(s, '(?i)\bpacks?\s+of\s+(\d+)\b', 1), '') AS INTEGER), TRY_CAST(nullif(regexp_extract(s, '(?i)\b(\d+)\s*[-\s]?(?:pack|pk)s?\b', 1), '') AS INTEGER),
        CASE WHEN regexp_matches(s, '(?i)\btwin\s*pack\b') THEN 2 END, TRY_CAST(nullif(regexp_extract(s, '(?i)\b(\d+)''?s\b', 1), '') AS INTEGER), TRY_CAST(nullif(regexp_extract(s, '(?i)\b(\d+)\s*(?:count|ct)\b', 1), '') AS INTEGER)) AS pack_count FROM z"""
)
def parsed_shapes(spark, d):
    """Sizes and counts of descriptions in many shapes, parsed anew in the SQL."""
    n, k = F.col("l_quantity").cast("int"), (F.col("l_orderkey") + F.col("l_partkey")) % 12
    t = n.cast("string")
    shapes = [
        F.concat(t, F.lit(",5 L bottle")), F.concat(F.lit("v"), t, F.lit("ml "), t, F.lit(" Millilitres")), F.concat(F.lit("x"), t, F.lit(".25KG")), F.concat(t, F.lit("mlx "), t, F.lit(" oz")), F.concat(t, F.lit(" x 75ml")), F.concat(t, F.lit("x more 3 pk")),
        F.concat(F.lit("pack of "), t, F.lit(" 100 gms")), F.concat(t, F.lit("-packs")), F.concat(F.lit("TwinPack "), t, F.lit(" litre")), F.concat(t, F.lit("'s tablets")), F.concat(F.lit("x "), t, F.lit(" g")), F.concat(t, F.lit(" count x "), F.col("l_linenumber").cast("string")),
    ]
    desc = F.element_at(F.array(*shapes), (k + 1).cast("int"))
    df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", n.alias("n"), desc.alias("s"))
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "n", F.round(T.size_ml(F.col("s")), 6).alias("size_ml"), F.round(T.size_g(F.col("s")), 6).alias("size_g"), T.pack_count(F.col("s")).alias("pack_count"))


# ---- prompts --------------------------------------------------------------------------------


@query("SELECT doc_id, '<untrusted_evidence>' || chr(10) || regexp_replace(CASE WHEN doc_id % 3 = 0 THEN '</UNTRUSTED_evidence>' WHEN doc_id % 3 = 1 THEN '< b <untrusted_evidence' ELSE '' END || coalesce(left(text, 40), ''), '<(/?untrusted_evidence)', '‹\\1', 'gi') || chr(10) || '</untrusted_evidence>' AS fenced FROM documents")
def fenced_evidence(spark, d):
    k = F.col("doc_id") % 3
    raw = F.concat(F.when(k == 0, "</UNTRUSTED_evidence>").when(k == 1, "< b <untrusted_evidence").otherwise(""), F.coalesce(F.left("text", F.lit(40)), F.lit("")))
    return table(spark, d, "documents").select("doc_id", C.fenced(raw).alias("fenced"))


@query("SELECT p_partkey, '{\"name\": \"' || p_name || '\"}' AS answer, 'Name ' || p_name || ' of ' || p_type || '{' AS prompt FROM part")
def rendered_prompts(spark, d):
    answer = F.concat(F.when(F.col("p_partkey") % 2 == 0, "```json\n").otherwise(""), F.lit('{"name": "'), "p_name", F.lit('"}'), F.when(F.col("p_partkey") % 2 == 0, "\n``` ").otherwise(""))
    return table(spark, d, "part").select("p_partkey", C.strip_fences(answer).alias("answer"), C.render("Name {name} of {kind}{brace}", name=F.col("p_name"), kind=F.col("p_type"), brace=F.lit("{")).alias("prompt"))


@query(
    r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents), p AS (SELECT doc_id, string_split(lower(x), 'tion ') AS s FROM t),
    h AS (SELECT doc_id, CAST(list_sum(list_transform(s[1:i], lambda w: length(w))) + 5 * (i - 1) + 1 AS BIGINT) AS h FROM (SELECT doc_id, s, unnest(range(1, len(s))) AS i FROM p)),
    w AS (SELECT doc_id, 1 AS a, 100 AS b FROM t UNION ALL SELECT doc_id, greatest(h - 20, 1), h + 24 FROM h),
    o AS (SELECT doc_id, a, b, max(b) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM w),
    g AS (SELECT doc_id, a, b, sum(CASE WHEN before IS NULL OR a > before + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY a, b) AS g FROM o),
    m AS (SELECT doc_id, g, min(a) AS a, max(b) AS b FROM g GROUP BY 1, 2), c AS (SELECT doc_id, a, trim(substr(x, CAST(a AS BIGINT), CAST(b - a + 1 AS BIGINT)), ' ') AS c FROM m JOIN t USING (doc_id))
    SELECT doc_id, sha256(left(coalesce(string_agg(c, ' … ' ORDER BY a) FILTER (c <> ''), ''), 1500)) AS digest FROM c GROUP BY 1"""
)
def evidence_excerpts(spark, d):
    body = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select("doc_id", F.sha2(C.excerpt(body, ["tion "], prefix=100, around=20, limit=1500), 256).alias("digest"))


@query(_with("SELECT row_uid, concat_ws(chr(10), 'description: ' || desc_clean, 'brand: ' || brand, 'barcode: ' || barcode, 'size: ' || CASE WHEN size_unit IS NOT NULL THEN CAST(size_value AS VARCHAR) || size_unit END, 'count: ' || pack_count, CASE WHEN len(variant_terms) > 0 THEN 'variant: ' || array_to_string(variant_terms, ', ') END, 'countries: ' || array_to_string(countries, ', ')) AS block FROM q"))
def record_blocks(spark, d):
    return products(spark, d).select("row_uid", gold.record_block().alias("block"))


# ---- urls and pages -------------------------------------------------------------------------

_OCTETS = "a AS (SELECT c_custkey AS k, c_custkey * 37 % 256 AS o1, c_custkey * 91 % 256 AS o2, c_nationkey * 10 % 256 AS o3, c_custkey % 256 AS o4 FROM customer)"


@query(
    f"""WITH {_OCTETS}, n AS (SELECT *, ((CAST(o1 AS BIGINT) * 256 + o2) * 256 + o3) * 256 + o4 AS ip FROM a),
    r AS (SELECT unnest([0, 167772160, 1681915904, 2130706432, 2851995648, 2886729728, 3221225472, 3221225984, 3232235520, 3323068416, 3325256704, 3405803776, 4026531840]) AS lo, unnest([16777215, 184549375, 1686110207, 2147483647, 2852061183, 2887778303, 3221225727, 3221226239, 3232301055, 3323199487, 3325256959, 3405804031, 4294967295]) AS hi)
    SELECT k AS c_custkey, CASE k % 5 WHEN 0 THEN NOT EXISTS (SELECT 1 FROM r WHERE ip BETWEEN lo AND hi) OR ip IN (3221225481, 3221225482) WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false ELSE k % 2 = 0 END AS safe FROM n"""
)
def url_safety(spark, d):
    """Hosts that are addresses in four numbers, as one number, names, this machine, and IPv6 addresses."""
    k = F.col("c_custkey")
    groups = F.concat_ws(":", F.hex(F.shiftright(k, 16).bitwiseAND(65535)), F.hex(k.bitwiseAND(65535)))  # a group holds 16 bits
    quad = F.concat_ws(".", *[x.cast("string") for x in (k * 37 % 256, k * 91 % 256, F.col("c_nationkey") * 10 % 256, k % 256)])
    name = F.when(k % 5 == 0, quad).when(k % 5 == 1, (k + 16777216).cast("string")).when(k % 5 == 2, F.concat(F.lit("h"), k.cast("string"), F.lit(".test"))).when(k % 5 == 3, F.concat(F.lit("h"), k.cast("string"), F.lit(".localhost:80")))
    name = F.coalesce(name, F.when(k % 2 == 0, F.concat(F.lit("[2606:4700::"), groups, F.lit("]"))).otherwise(F.concat(F.lit("[fd00::"), groups, F.lit("]"))))
    return table(spark, d, "customer").select("c_custkey", U.safe(F.concat(F.lit("http://"), name, F.lit("/p"))).alias("safe"))


@query("SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)), '^www\\.', '') AS host FROM pages")
def bare_hosts(spark, d):
    return table(spark, d, "pages").select("page_id", U.bare_host(F.col("url")).alias("host"))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'first ' || page_id ELSE 'A & B' END AS title, url AS image, CAST(page_id AS VARCHAR) || '.50' AS price, CASE WHEN page_id % 2 = 0 THEN 3 ELSE 2 END AS n FROM pages")
def open_graph_tags(spark, d):
    """Either order of attributes, either quotes, a repeated key, references in values."""
    k, url = F.col("page_id").cast("string"), F.col("url")
    page = F.concat(
        F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('<meta property="og:title" content="first '), k, F.lit('"><meta property="og:title" content="second">'))).otherwise('<title>A &amp; <b>B</b></title><meta name="title" content="x">'),
        F.lit("<META content='"), F.replace(url, F.lit("&"), F.lit("&amp;")), F.lit("' data-a=\"<>\" property='og:image'><meta property=og:price:amount content="), k, F.lit(".50>"),
    )
    og = P.open_graph(page)
    return table(spark, d, "pages").select("page_id", P.page_title(page).alias("title"), F.try_element_at(og, F.lit("image")).alias("image"), F.try_element_at(og, F.lit("price:amount")).alias("price"), F.size(og).alias("n"))


@query("SELECT page_id, array_to_string(list_concat(CASE WHEN page_id % 3 = 0 THEN ['og' || page_id || '.jpg'] ELSE CAST([] AS VARCHAR[]) END, CASE WHEN page_id % 4 = 0 THEN ['/a' || page_id || '.png?x=1&y=2'] ELSE ['/a' || page_id || '.png?x=1&y=2', '/b.png'] END), ' ') AS images FROM pages")
def page_images(spark, d):
    k = F.col("page_id").cast("string")
    page = F.concat(
        F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('<meta property="og:image" content="og'), k, F.lit('.jpg">'))).otherwise(""), F.lit('<img alt="logo" src="/a'), k, F.lit(".png?x=1&amp;y=2\"/><img src='/logo.svg'><IMG src=data:image/png;base64,xx><img class=x><img src=/a"), k, F.lit(".png?x=1&#38;y=2>"),
        F.when(F.col("page_id") % 4 == 0, '<img src="/icons/b.png">').otherwise('<img src="/b.png">'),
    )
    return table(spark, d, "pages").select("page_id", F.array_join(P.images(page), " ").alias("images"))


@query("SELECT 'q' || (event_id // 5) AS text, CAST(event_id % 5 + 1 AS INTEGER) AS rank, 'https://x.test/' || event_id AS url, event_type AS engine FROM events")
def search_ranks(spark, d):
    e = table(spark, d, "events").withColumn("text", F.concat(F.lit("q"), F.expr("event_id div 5")))
    one = F.concat(F.lit('{"url":"https://x.test/'), F.col("event_id").cast("string"), F.lit('","title":"t","engine":"'), "event_type", F.lit('"}'))
    packed = e.groupBy("text").agg(F.concat(F.lit('{"results":['), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", one.alias("r")))), lambda x: x["r"]), ","), F.lit("]}")).alias("payload"))
    return adapters.search_results(packed).select("text", "rank", "url", "engine")


@query("SELECT 'q' || (event_id // 5) AS text, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS stray FROM events WHERE event_type NOT IN ('view', 'click') GROUP BY 1")
def stray_engines(spark, d):
    one = F.concat(F.lit('{"engine":"'), "event_type", F.lit('"}'))
    packed = table(spark, d, "events").groupBy(F.concat(F.lit("q"), F.expr("event_id div 5")).alias("text")).agg(F.concat(F.lit('{"results":['), F.array_join(F.collect_list(one), ","), F.lit("]}")).alias("payload"))
    return adapters.stray_engines(packed.withColumn("engines", F.array(F.lit("view"), F.lit("click")))).select("text", F.array_join(F.array_sort("stray"), ",").alias("stray"))


# ---- matching -------------------------------------------------------------------------------

_SIGNALS = """x AS (SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'Acme-X Ltd' ELSE c_mktsegment END AS brand, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE 'S' || (o_custkey % 4) || '.test' END AS domain,
    CASE WHEN o_orderkey % 7 = 0 THEN 'travel size mint' ELSE 'mint' END AS desc_clean,
    'https://' || CASE o_orderkey % 4 WHEN 0 THEN 'www.' WHEN 1 THEN 'shop.' ELSE '' END || 's' || (o_orderkey % 4) || '.test/' || CASE o_orderkey % 6 WHEN 0 THEN 'acmex' WHEN 1 THEN 'search?q=1' WHEN 2 THEN 'en-gb' ELSE 'p/' || lower(c_mktsegment) END AS url,
    CASE o_orderkey % 8 WHEN 0 THEN 'Trial bundle' WHEN 1 THEN 'Travel refill mint' WHEN 2 THEN 'ACME X mint' ELSE 'gel' END AS title FROM orders JOIN customer ON c_custkey = o_custkey)"""


def _signals(spark, d) -> DataFrame:
    k = F.col("o_orderkey")
    df = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    pairs = df.select(
        k.alias("row_uid"),
        F.when(k % 5 == 0, "").when(k % 5 == 1, "Acme-X Ltd").otherwise(F.col("c_mktsegment")).alias("brand"),
        F.when(F.col("o_custkey") % 3 != 0, F.concat(F.lit("S"), (F.col("o_custkey") % 4).cast("string"), F.lit(".test"))).alias("domain"),
        F.when(k % 7 == 0, "travel size mint").otherwise("mint").alias("desc_clean"),
        F.concat(F.lit("https://"), F.when(k % 4 == 0, "www.").when(k % 4 == 1, "shop.").otherwise(""), F.lit("s"), (k % 4).cast("string"), F.lit(".test/"), F.when(k % 6 == 0, "acmex").when(k % 6 == 1, "search?q=1").when(k % 6 == 2, "en-gb").otherwise(F.concat(F.lit("p/"), F.lower("c_mktsegment")))).alias("url"),
        F.when(k % 8 == 0, "Trial bundle").when(k % 8 == 1, "Travel refill mint").when(k % 8 == 2, "ACME X mint").otherwise("gel").alias("title"),
        F.lit(None).cast("string").alias("barcode"), F.lit(None).cast("string").alias("gtin"), F.array(F.lit("mint")).alias("variant_terms"), F.array().cast("array<string>").alias("format_hints"),
        F.lit(None).cast("double").alias("size_value"), F.lit(None).cast("double").alias("size_ml"), F.lit(None).cast("double").alias("size_g"), F.lit(None).cast("int").alias("pack_count"), F.array(F.lit("GB")).alias("countries"), F.lit("").alias("body_text"),
    )
    return match.score(match.features(pairs))


_FLAGGED = f"""{_SIGNALS}, f AS (SELECT *, lower(title || ' ' || url) AS place, lower(split_part(brand, ' ', 1)) AS token, regexp_extract(url, '^https://([^/?#]*)', 1) AS host, string_split(regexp_extract(url, '^https://[^/?#]*/([^?#]*)', 1), '/') AS seg FROM x),
  g AS (SELECT *, CASE WHEN token = '' THEN 0.0 WHEN contains(place, token) OR contains(regexp_replace(place, '[^a-z0-9]', '', 'g'), replace(token, '-', '')) THEN 1.0 ELSE 0.0 END::DOUBLE AS brand_match,
    coalesce(host = lower(domain) OR ends_with(host, '.' || lower(domain)), false) AS own_domain,
    list_sort(list_concat(list_filter(['refill', 'travel', 'bundle', 'trial'], lambda w: contains(lower(title), w) AND NOT contains(lower(desc_clean), w)),
      CASE WHEN contains(url, '/search?') THEN ['listing_page'] ELSE CAST([] AS VARCHAR[]) END, CASE WHEN len(seg) = 1 AND (regexp_matches(seg[1], '^[a-z]{{2}}([-_][a-z]{{2}})?$') OR (token <> '' AND seg[1] IN (token, replace(token, '-', '')))) THEN ['site_root'] ELSE CAST([] AS VARCHAR[]) END)) AS flags FROM f),
  w AS (SELECT *, 0.35::DOUBLE * brand_match + 0.3::DOUBLE * CASE WHEN contains(lower(title), 'mint') THEN 1 ELSE 0 END + 0.1::DOUBLE * own_domain::INT AS weighted FROM g)"""


@query(f"WITH {_FLAGGED} SELECT k AS row_uid, brand_match, own_domain AS retailer_domain_match, array_to_string(flags, ',') AS negative_flags FROM w")
def match_signals(spark, d):
    """Signals of a brand, a retailer's own domain and marks against a page, where each of them varies."""
    return _signals(spark, d).select("row_uid", "brand_match", "retailer_domain_match", F.array_join("negative_flags", ",").alias("negative_flags"))


@query(f"WITH {_FLAGGED} SELECT k AS row_uid, round(CASE WHEN len(flags) = 0 THEN weighted ELSE greatest(weighted * pow(0.6, len(flags)), 0.01) END, 6) AS score, CASE WHEN len(flags) = 0 THEN 'weighted' ELSE 'demoted: ' || array_to_string(list_transform(flags, lambda f: 'negative:' || f), ', ') END AS reason FROM w")
def demoted_scores(spark, d):
    return _signals(spark, d).select("row_uid", F.round("score", 6).alias("score"), "reason")


@query(
    _SCORED
    + """SELECT row_uid, CASE WHEN max(CASE WHEN position = 1 AND NOT rejected THEN score END) >= 0.5 THEN max(CASE WHEN position = 1 AND NOT rejected THEN url END) END AS url,
    coalesce(max(CASE WHEN position = 1 AND NOT rejected THEN score END) >= 0.5 AND count(*) FILTER (NOT rejected) >= 2 AND NOT coalesce(max(CASE WHEN position = 1 AND NOT rejected THEN be::INT END) = 1, false)
      AND max(CASE WHEN position = 1 AND NOT rejected THEN score END) - coalesce(max(CASE WHEN position = 2 AND NOT rejected THEN score END), 0) < 0.15, false) AS adjudicate FROM r GROUP BY row_uid"""
)
def abstained_selections(spark, d):
    """Selections with a threshold for abstention, and which of them a judge should look at."""
    return match.select(_first_ranked(spark, d, 2), tau=0.5).select("row_uid", "url", "adjudicate")


@query(
    _SCORED
    + """, v AS (SELECT row_uid, CAST(split_part(row_uid, ':', 2) AS BIGINT) % 4 AS choice FROM r GROUP BY 1), b AS (SELECT row_uid, max(CASE WHEN position = 1 AND NOT rejected THEN url END) AS url FROM r GROUP BY 1),
    c AS (SELECT r.row_uid, max(url) AS url FROM r JOIN v ON r.row_uid = v.row_uid AND position = choice WHERE NOT rejected GROUP BY 1)
    SELECT b.row_uid, coalesce(c.url, b.url) AS url FROM b LEFT JOIN c ON b.row_uid = c.row_uid"""
)
def judged_selections(spark, d):
    ranked = cut(_first_ranked(spark, d, 4))
    verdicts = ranked.select("row_uid").distinct().select("row_uid", (F.split_part("row_uid", F.lit(":"), F.lit(2)).cast("int") % 4).alias("choice"))
    return match.apply_verdicts(match.select(ranked), ranked, verdicts).select("row_uid", "url")


# ---- text model, characteristics, registry, runs --------------------------------------------

_UNSEEN = _GRAMS.format(doc="p_partkey", text="p_name || ' ' || p_brand", table="part") + """,
  v0 AS (SELECT doc, term, (1 + ln(n)) * idf AS w FROM tg JOIN idf USING (term)), v AS (SELECT doc, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc)) AS w FROM v0),
  nz AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS label, ' ' || lower(split_part(p_name, ' ', 1)) || ' ' AS z FROM part), nt AS (SELECT label, '4:' || substr(z, CAST(i AS BIGINT), 4) AS term, count(*) AS n FROM nz, unnest(range(1, greatest(length(z) - 2, 1))) AS r(i) GROUP BY 1, 2),
  n0 AS (SELECT label, term, (1 + ln(n)) * idf AS w FROM nt JOIN idf USING (term)), nv AS (SELECT label, term, w / sqrt(sum(w * w) OVER (PARTITION BY label)) AS w FROM n0),
  s AS (SELECT doc, label, sum(v.w * nv.w) AS score FROM v JOIN nv USING (term) GROUP BY 1, 2)
  SELECT p_partkey AS doc, l.label, round(coalesce(score, 0), 6) AS score FROM part CROSS JOIN (SELECT DISTINCT label FROM nv) l LEFT JOIN s ON s.doc = p_partkey AND s.label = l.label"""


@query(_UNSEEN)
def unseen_classes(spark, d):
    vecs, folded, idf, docs = _part_vectors(spark, d)
    names = table(spark, d, "part").select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("label")).distinct()
    scores = cut(gold.unseen_scores(vecs, folded.select("text").distinct(), names, idf, "text", "label").withColumn("score", F.round("score", 6)))
    return docs.drop("label").join(scores, "text").select("doc", "label", "score")


@query(f"WITH {_RULES}, s AS (SELECT module, list(characteristic) AS s FROM rules GROUP BY 1) SELECT p_partkey AS row_uid, array_to_string(list_filter(['GLOBAL_PACKAGING', 'GLOBAL_IF_MEDICATED'], lambda c: list_contains(s, c)), ',') AS applicable, 13 AS cells FROM part JOIN s ON module = p_type")
def gated_values(spark, d):
    modules = table(spark, d, "part").select(F.col("p_partkey").alias("row_uid"), F.col("p_type").alias("module"))
    asked = F.filter(F.array(F.lit("GLOBAL_PACKAGING"), F.lit("GLOBAL_IF_MEDICATED")), lambda c: F.array_contains("applicable", c))
    return C.gate(modules, _rules(spark, d)).select("row_uid", F.array_join(asked, ",").alias("applicable"), F.size("values").alias("cells"))


_HITS = "h AS (SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F')"


@query(f"WITH {_HITS} SELECT o_orderkey AS row_uid, 'u' || c_custkey AS url, c_mktsegment AS module, c_acctbal AS confidence, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS packaging FROM h JOIN customer ON o_custkey = c_custkey")
def carried_selections(spark, d):
    """What registry hits take over from their entity, as far as it applies."""
    o = table(spark, d, "orders")
    hits = o.select(F.col("o_orderkey").alias("row_uid"), (F.col("o_orderstatus") == "F").alias("hit"), F.lit("tier0_exact").alias("tier"), F.col("o_custkey").alias("entity_id"))
    stored = F.create_map(F.lit("GLOBAL_PACKAGING"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")), F.lit("GLOBAL_IF_MEDICATED"), F.lit("Y"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("entity_id"), F.concat(F.lit("u"), "c_custkey").alias("resolved_url"), F.col("c_mktsegment").alias("module"), stored.alias("characteristics"), F.col("c_acctbal").alias("confidence"))
    kept = C.from_entity(F.col("values"), F.array(F.lit("GLOBAL_PACKAGING")))
    return runs.hit_selections(hits, c).select("row_uid", "url", "module", "confidence", F.try_element_at(kept, F.lit("GLOBAL_PACKAGING")).alias("packaging"))


@query("SELECT lpad(CAST(k AS VARCHAR), 9, '0') AS node, lpad(CAST(k - k % 50 AS VARCHAR), 9, '0') AS component FROM (SELECT DISTINCT unnest([o_orderkey, o_orderkey + 1]) AS k FROM orders WHERE o_orderkey % 50 <> 49)")
def chained_components(spark, d):
    """Components that are chains of fifty."""
    text = lambda c: F.lpad(c.cast("string"), 9, "0")
    return registry.components(table(spark, d, "orders").where("o_orderkey % 50 <> 49").select(text(F.col("o_orderkey") + 1).alias("a"), text(F.col("o_orderkey")).alias("b")))


@query("SELECT entity_id, updated_at FROM (SELECT c_custkey AS entity_id, epoch(ts) AS updated_at, row_number() OVER (ORDER BY epoch(ts) DESC, c_custkey) AS k FROM customer JOIN events ON event_id = c_custkey) WHERE k <= 12")
def recent_entities(spark, d):
    at = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    e = table(spark, d, "customer").join(table(spark, d, "events"), F.col("event_id") == F.col("c_custkey")).select(F.col("c_custkey").alias("entity_id"), at.alias("updated_at"))
    return registry.recent(e)


@query("SELECT c_custkey AS entity_id, 'r1' AS run_id, 'tier2_retrieval' AS tier, 'c:' || c_custkey AS members, c_acctbal AS confidence, c_custkey % 5 = 0 AS odd FROM customer")
def audit_records(spark, d):
    """The records of a write, and whether an entity has members that aren't row ids."""
    c = table(spark, d, "customer")
    member = F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("c:"), "c_custkey")).otherwise(F.concat(F.lit("c:"), "c_custkey"))
    e = c.select(F.col("c_custkey").alias("entity_id"), F.array(member).alias("member_row_uids"), F.col("c_acctbal").alias("confidence"), F.timestamp_seconds(F.lit(0)).alias("updated_at"))
    bad = registry.check_members(e.where("entity_id % 5 = 0").withColumn("member_row_uids", F.array(F.lit("no id")))).select("entity_id", F.lit(True).alias("odd"))
    return registry.audit(e, "r1").join(bad, "entity_id", "left").select("entity_id", "run_id", "tier", F.array_join("row_uids", ",").alias("members"), "confidence", F.coalesce("odd", F.lit(False)).alias("odd"))


@query("SELECT o_orderkey AS row_uid FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey % 3 <> 0")
def rows_without_values(spark, d):
    value = F.create_map(F.lit("GLOBAL_PACKAGING"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")))
    return runs.values_missing(table(spark, d, "orders").select(F.col("o_orderkey").alias("row_uid"), F.when(F.col("o_orderstatus") == "F", "llm").otherwise("gate_only").alias("source"), value.alias("values")))


@query(
    """SELECT count(*) AS rows, count(*) FILTER (o_orderstatus <> 'F') AS selected, count(*) FILTER (o_orderstatus = 'P') AS gtin_confirmed, count(*) FILTER (o_totalprice > 100000) AS adjudicated, count(*) FILTER (o_orderkey % 2 = 0) AS extracted,
    CAST(2 * count(*) AS BIGINT) AS applicable_cells, count(*) FILTER (o_orderkey % 3 = 0) AS coded_cells, count(*) FILTER (o_orderkey % 5 = 0) AS with_image FROM orders"""
)
def explorer_totals(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(
        F.lit("t").alias("tier"), F.when(F.col("o_orderstatus") != "F", "u").alias("url"), F.when(F.col("o_orderstatus") == "P", "gtin_exact").alias("reason"), (F.col("o_totalprice") > 100000).alias("adjudicated"), F.when(k % 2 == 0, "llm").otherwise("gate_only").alias("values_source"),
        F.array(F.lit("a"), F.lit("b")).alias("applicable"), F.create_map(F.lit("a"), F.when(k % 3 == 0, "v")).alias("values"), F.when(k % 5 == 0, "h").alias("image_sha256"), F.col("o_orderpriority").alias("module"),
    )
    return runs.explorer_summary(rows)[0]


@query(
    """WITH RECURSIVE s AS (SELECT doc_id, list_filter(string_split(replace(coalesce(left(text, 600), ''), chr(10), ' '), '. '), lambda x: x <> '') AS s FROM documents), e AS (SELECT doc_id, i - 1 AS i, s[i] AS t, (i * 7) % 5 AS p FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM s)),
    o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p, i DESC) AS k, sum(length(t) + 1) OVER (PARTITION BY doc_id) - 1 AS whole, coalesce(sum(length(t) + 1) OVER (PARTITION BY doc_id ORDER BY p, i DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e)
    SELECT d.doc_id, coalesce(string_agg(t, ' ' ORDER BY i) FILTER (whole - before <= 200), '') AS kept FROM documents d LEFT JOIN o ON d.doc_id = o.doc_id GROUP BY 1"""
)
def fitted_sentences(spark, d):
    """Whole sentences go, lowest priority first and later ones first, until the rest fits 200 characters."""
    parts = F.filter(F.split(F.replace(F.coalesce(F.left("text", F.lit(600)), F.lit("")), F.lit("\n"), F.lit(" ")), r"\. "), lambda x: x != "")
    said = F.transform(parts, lambda t, i: F.struct(((i + 1) * 7 % 5).alias("priority"), t.alias("text"), F.array().cast("array<string>").alias("claims")))
    return table(spark, d, "documents").select("doc_id", F.array_join(F.transform(reason.fit(said, 200), lambda s: s["text"]), " ").alias("kept"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_size || ' ml' WHEN 1 THEN p_size || '.5 g' END AS phrase FROM part")
def size_phrases(spark, d):
    k, n = F.col("p_partkey") % 3, F.col("p_size").cast("double")
    return table(spark, d, "part").select("p_partkey", F.when(k == 0, n).alias("size_ml"), F.when(k == 1, n + 0.5).alias("size_g")).select("p_partkey", reason.size_phrase().alias("phrase"))


@query("SELECT p_partkey, concat_ws(chr(10), 'name: ' || p_name, CASE WHEN p_partkey % 2 = 0 THEN 'type: ' || p_type END, 'price: ' || CAST(p_partkey AS VARCHAR)) AS text, '<dl><dt>name</dt><dd>' || p_name || ' &lt;&amp;&gt;</dd><dt>url</dt><dd>' || CASE WHEN p_partkey % 2 = 0 THEN '<a rel=\"noopener\" href=\"https://x.test/' || p_partkey || '\">https://x.test/' || p_partkey || '</a>' ELSE 'ftp://x' END || '</dd></dl>' AS html FROM part")
def row_cards(spark, d):
    even = F.col("p_partkey") % 2 == 0
    text = runs.card_text({"name": F.col("p_name"), "type": F.when(even, F.col("p_type")).otherwise(""), "price": F.col("p_partkey")})
    url = F.when(even, F.concat(F.lit("https://x.test/"), F.col("p_partkey").cast("string"))).otherwise("ftp://x")
    html = runs.card_html({"name": F.concat("p_name", F.lit(" <&>")), "none": F.lit(None).cast("string"), "url": url}, ("url",))
    return table(spark, d, "part").select("p_partkey", text.alias("text"), html.alias("html"))


@query("SELECT c_custkey FROM customer WHERE contains(lower(c_name || chr(10) || c_mktsegment), 'customer#0000000') AND contains(lower(c_name || chr(10) || c_mktsegment), 'build') AND c_nationkey = 3")
def filtered_rows(spark, d):
    return runs.filter_rows(table(spark, d, "customer"), " Build CUSTOMER#0000000", ("c_name", "c_mktsegment"), c_nationkey=3).select("c_custkey")


@query("SELECT user_id AS key, arg_max(event_type, (epoch(ts), event_id)) AS payload FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1")
def packed_entries(spark, d):
    cache = table(spark, d, "events").select(F.col("user_id").alias("key"), F.struct(F.unix_micros(F.col("ts").cast("timestamp")), "event_id").alias("fetched_at"), F.col("event_type").alias("payload"))
    used = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("key"))
    return packed_cache(cache, used, "key").select("key", "payload")


@query("SELECT c_custkey, sha256('{\"p0\":\"m1\",\"p1\":\"' || c_name || '\",\"p2\":' || c_nationkey || ',\"p3\":' || CASE WHEN c_custkey % 2 = 0 THEN '[\"a\",\"b\"]' ELSE 'null' END || '}') AS key FROM customer")
def call_keys(spark, d):
    """Keys of model calls: the model, the prompt, its parameters, the hashes of images in order."""
    images = F.when(F.col("c_custkey") % 2 == 0, F.array_sort(F.array(F.lit("b"), F.lit("a"))))
    return table(spark, d, "customer").select("c_custkey", cache_key(F.lit("m1"), F.col("c_name"), F.col("c_nationkey"), images).alias("key"))


@query(f"WITH {_RULES} SELECT module, CASE WHEN module < 'M' THEN 'GLOBAL_IF_MEDICATED: free text — say yes' || chr(10) ELSE '' END || 'GLOBAL_PACKAGING: COLD | HOT | BLUE | RING | BOLT' AS block FROM (SELECT DISTINCT module FROM rules)")
def rule_blocks(spark, d):
    guide = table(spark, d, "part").select(F.col("p_type").alias("module")).distinct().select("module", F.lit("GLOBAL_IF_MEDICATED").alias("characteristic"), F.lit("say yes").alias("guideline"))
    return gold.rule_block(_rules(spark, d), guide)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def first_rows(spark, d):
    """The rows of a trial run: a limit is the feature."""
    ranked = table(spark, d, "orders").select("o_orderkey", "o_totalprice", (-F.col("o_totalprice")).alias("_by"))
    return first_of(ranked, 25, "_by", "o_orderkey").drop("_by")


@query(_SCORED + "SELECT row_uid, string_agg('[' || position || '] ' || r.url || chr(10) || 'title: ' || b.desc_raw || CASE WHEN b.barcode IS NOT NULL THEN chr(10) || 'gtin: ' || b.barcode ELSE '' END, chr(10) || chr(10) ORDER BY position) AS block FROM r JOIN (SELECT desc_raw, barcode, 'https://shop' || row_index % 10 || '.example' || CASE row_index % 3 WHEN 0 THEN '.co.uk' WHEN 1 THEN '.com' ELSE '.de' END || '/p/' || row_index AS url FROM q) b ON b.url = r.url WHERE NOT rejected AND position <= 4 GROUP BY 1")
def judged_blocks(spark, d):
    """What a judge is shown of a record's first pages."""
    return gold.candidate_blocks(_first_ranked(spark, d, 4), 4)


_LOO = _GRAMS.format(doc="n_nationkey", text="n_name || ' of ' || n_regionkey * 111", table="nation").split(",\n  idf AS")[0] + """,
  f AS (SELECT n_nationkey AS doc, 'R' || n_regionkey AS label, row_number() OVER (ORDER BY n_nationkey) - 1 AS fold FROM nation), o AS (SELECT fold AS part_out FROM f), n AS (SELECT count(*) - 1 AS size FROM f),
  x AS (SELECT part_out, doc, label, fold, term, n FROM tg JOIN f USING (doc), o), idf AS (SELECT part_out, term, ln((any_value(size) + 1.0::DOUBLE) / (count(*) + 1.0::DOUBLE)) + 1 AS idf FROM x, n WHERE fold <> part_out GROUP BY 1, 2),
  v0 AS (SELECT part_out, doc, label, fold, term, (1 + ln(n)) * idf AS w FROM x JOIN idf USING (part_out, term)), v AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY part_out, doc)) AS u FROM v0),
  c0 AS (SELECT part_out, label, term, sum(u) AS w FROM v WHERE fold <> part_out GROUP BY 1, 2, 3), c AS (SELECT part_out, label, term, w / sqrt(sum(w * w) OVER (PARTITION BY part_out, label)) AS w FROM c0),
  s AS (SELECT v.doc, c.label AS pred, sum(u * c.w) AS score FROM v JOIN c ON v.part_out = c.part_out AND v.term = c.term WHERE fold = v.part_out GROUP BY 1, 2)
  SELECT doc, label AS truth, arg_min(pred, (-round(score, 9), pred)) AS pred FROM s JOIN f USING (doc) GROUP BY 1, 2"""


@query(_LOO)
def leave_one_out(spark, d):
    docs = table(spark, d, "nation").select(F.col("n_nationkey").alias("doc"), F.concat("n_name", F.lit(" of "), (F.col("n_regionkey") * 111).cast("string")).alias("text"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("label"))
    return gold.leave_one_out(docs)


__all__ = ["query"]
