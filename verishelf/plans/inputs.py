"""The driver's tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verishelf.operators import blocks
from verishelf.operators.products import normalize, read_records, with_keys
from verishelf.operators.match import parse_pages, parse_records
from verishelf.operators.shortlist import shortlist
from verishelf.sources.tables import cut, spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_CODE = r"""CASE p_partkey % 5 WHEN 0 THEN lpad(cast(p_partkey as string), 13, '5') WHEN 1 THEN concat(cast(p_partkey % 9 + 1 as string), '000000000000')
  WHEN 2 THEN lpad(cast(p_partkey as string), 8, '7') WHEN 3 THEN concat(cast(p_partkey as string), '.0') ELSE concat('\'', lpad(cast(p_partkey as string), 12, '6')) END"""
_SIZE = "CASE p_partkey % 6 WHEN 0 THEN concat(' ', p_size, 'ml') WHEN 1 THEN concat(' ', p_size, ' g') WHEN 2 THEN concat(' ', p_size, '.5 cl') WHEN 3 THEN concat(' ', p_size, 'ml ', p_size, 'ML') WHEN 4 THEN concat(' ', p_size, 'kg') ELSE '' END"
_COUNT = "CASE p_partkey % 7 WHEN 0 THEN concat(' pack of ', p_partkey % 5 + 2) WHEN 1 THEN concat(' ', p_partkey % 5 + 2, ' x') WHEN 2 THEN ' twin pack' WHEN 3 THEN concat(' ', p_partkey % 5 + 2, '\\'s') WHEN 4 THEN concat(' ', p_partkey % 5 + 2, ' ct') WHEN 5 THEN ' 2x stronger' ELSE '' END"
_FORMAT = "CASE p_partkey % 4 WHEN 0 THEN ' gel' WHEN 1 THEN ' pump' WHEN 2 THEN ' toothpaste' ELSE '' END"


def raw_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A messy product list from part: every row, all cells as text."""
    brand = "replace(p_brand, '#', '')"
    supplier = "lpad(cast(p_partkey % 10 as string), 9, '0')"
    return table(spark, sf_dir, "part").selectExpr(
        f"concat({brand}, ' ', p_name, {_SIZE}, {_COUNT}, {_FORMAT}, CASE WHEN p_partkey % 9 = 0 THEN concat(' ', {brand}) ELSE '' END, ' unit 000', p_partkey % 100, ' each supplier ', {supplier}) AS RETAILER_DESC",
        f"CASE WHEN p_partkey % 3 = 0 THEN concat({brand}, ' (OWNER', p_size, ')') ELSE {brand} END AS BRAND",
        f"{_CODE} AS EXTERNAL_CODE",
        f"concat('Supplier#', {supplier}) AS RETAILER",
        "CASE WHEN p_partkey % 4 = 0 THEN 'GB, FR' END AS COUNTRY",
        "cast(p_partkey as string) AS ITEM_CODE",
        "cast(null as string) AS NAN_KEY",
        "p_partkey",
    )


def retailers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retailers by raw name, each name once; every other one has a domain."""
    first = table(spark, sf_dir, "supplier").groupBy("s_name").agg(F.min("s_suppkey").alias("s_suppkey"))
    return first.selectExpr("s_name AS retailer_raw", "s_name AS name", "CASE WHEN s_suppkey % 2 = 0 THEN concat('s', s_suppkey, '.test') END AS domain")


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalized and keyed records of the product list, written once: several consumers read each
    column, and the optimizer would otherwise inline the parsers into every one of them."""
    raw = spread(raw_products(spark, sf_dir), "p_partkey")
    return cut(with_keys(cut(normalize(read_records(raw, "dev", F.col("p_partkey"), retailers(spark, sf_dir))))))


def pages_of(products_df: DataFrame) -> DataFrame:
    """A page for each record: its description as title, on one of three markets."""
    end = F.when(F.col("row_index") % 3 == 0, ".co.uk").when(F.col("row_index") % 3 == 1, ".com").otherwise(".de")
    url = F.concat(F.lit("https://shop"), (F.col("row_index") % 10).cast("string"), F.lit(".example"), end, F.lit("/p/"), F.col("row_index").cast("string"))
    return products_df.select(F.col("brand").alias("page_brand"), F.col("_size").alias("page_size"), url.alias("url"), F.col("desc_raw").alias("title"), F.lit("").alias("body_text"), F.col("barcode").alias("gtin"))


#: What match.features reads of a record.
_ROW = ("row_uid", "brand", "barcode", "size_value", "size_ml", "size_g", "pack_count", "_token", "_token_squashed", "_wanted", "_formats", "_countries", "_domain", "_own_marks")


def _candidates(spark: SparkSession, sf_dir: str, rows: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Records (rows, if they are there already) and pages, each parsed once, before they meet by brand and size class."""
    own = products(spark, sf_dir) if rows is None else rows
    own = own.join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_index"), F.col("p_size").alias("_size")), "row_index")
    pages = cut(parse_pages(pages_of(own)).withColumnsRenamed({"page_brand": "brand", "page_size": "_size"}))
    return cut(spread(parse_records(own), "row_uid").select(*_ROW, "_size")), pages


def candidate_pairs(spark: SparkSession, sf_dir: str, coded: bool = False, digits: int | None = None) -> DataFrame:
    """Each record with the pages of its brand and size class, scored, see blocks.scored_pairs; coded: those whose barcodes can be compared."""
    return blocks.scored_pairs(*_candidates(spark, sf_dir, None), ["brand", "_size"], coded=coded, digits=digits)[0]


def ranked_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.ranked_pairs(*_candidates(spark, sf_dir, None), ["brand", "_size"])


def best_pairs(spark: SparkSession, sf_dir: str, k: int, rows: DataFrame | None = None) -> DataFrame:
    """Of all pairs, those that can be among a record's first k usable ones: a block's pairs are as
    many as the square of its records, what these queries return is k a record."""
    own, pages = _candidates(spark, sf_dir, rows)
    return shortlist(own, pages, ["brand", "_size"], k).drop("_size")


#: The same records in SQL, from how the list was made.
PRODUCTS_SQL = r"""
p0 AS (
  SELECT p_partkey AS row_index, 'dev:' || p_partkey AS row_uid, replace(p_brand, '#', '') AS brand, p_name, p_size, p_partkey % 5 + 2 AS k,
    CASE p_partkey % 6 WHEN 0 THEN ' ' || p_size || 'ml' WHEN 1 THEN ' ' || p_size || ' g' WHEN 2 THEN ' ' || p_size || '.5 cl' WHEN 3 THEN ' ' || p_size || 'ml' WHEN 4 THEN ' ' || p_size || 'kg' ELSE '' END AS s1,
    CASE WHEN p_partkey % 6 = 3 THEN ' ' || p_size || 'ML' ELSE '' END AS s2,
    CASE p_partkey % 7 WHEN 0 THEN ' pack of ' || (p_partkey % 5 + 2) WHEN 1 THEN ' ' || (p_partkey % 5 + 2) || ' x' WHEN 2 THEN ' twin pack' WHEN 3 THEN ' ' || (p_partkey % 5 + 2) || '''s' WHEN 4 THEN ' ' || (p_partkey % 5 + 2) || ' ct' WHEN 5 THEN ' 2x stronger' ELSE '' END AS c,
    CASE p_partkey % 4 WHEN 0 THEN ' gel' WHEN 1 THEN ' pump' WHEN 2 THEN ' toothpaste' ELSE '' END AS f,
    CASE WHEN p_partkey % 9 = 0 THEN ' ' || replace(p_brand, '#', '') ELSE '' END AS again,
    ' unit 000' || (p_partkey % 100) || ' each supplier ' || lpad(CAST(p_partkey % 10 AS VARCHAR), 9, '0') AS tail,
    CASE WHEN p_partkey % 3 = 0 THEN 'OWNER' || p_size END AS brand_owner,
    'Supplier#' || lpad(CAST(p_partkey % 10 AS VARCHAR), 9, '0') AS retailer_raw,
    CASE p_partkey % 5 WHEN 0 THEN lpad(CAST(p_partkey AS VARCHAR), 13, '5') WHEN 1 THEN (p_partkey % 9 + 1) || '000000000000' WHEN 2 THEN lpad(CAST(p_partkey AS VARCHAR), 8, '7') WHEN 3 THEN CAST(p_partkey AS VARCHAR) ELSE lpad(CAST(p_partkey AS VARCHAR), 12, '6') END AS code,
    CASE WHEN p_partkey % 4 = 0 THEN ['GB', 'FR'] ELSE ['GB'] END AS countries
  FROM part
), p AS (
  SELECT *, brand || ' ' || p_name || s1 || s2 || c || f || again || tail AS desc_raw, brand || ' ' || p_name || s1 || c || f AS desc_clean,
    regexp_matches(code, '^\d{1,3}0{6,}$') AS corrupt, CASE WHEN NOT regexp_matches(code, '^\d{1,3}0{6,}$') THEN code END AS barcode,
    TRY_CAST(nullif(regexp_extract(s1, '^ (\d+(?:\.\d+)?) ?[a-z]+$', 1), '') AS DOUBLE) AS size_value,
    nullif(regexp_extract(s1, '([a-z]+)$', 1), '') AS u,
    CASE row_index % 7 WHEN 0 THEN k WHEN 1 THEN k WHEN 2 THEN 2 WHEN 3 THEN k WHEN 4 THEN k END AS pack_count,
    CASE WHEN f <> '' THEN [trim(f)] ELSE CAST([] AS VARCHAR[]) END AS format_hints
  FROM p0
), q AS (
  SELECT *, CASE u WHEN 'ml' THEN size_value WHEN 'cl' THEN size_value * 10.0::DOUBLE END AS size_ml, CASE u WHEN 'g' THEN size_value WHEN 'kg' THEN size_value * 1000.0::DOUBLE END AS size_g,
    CASE WHEN u IN ('ml', 'cl') THEN 'ml' WHEN u IN ('g', 'kg') THEN 'g' END AS size_unit,
    coalesce(length(barcode) IN (8, 12, 13, 14), false) AS valid,
    list_filter(list_transform(list_filter(string_split(lower(desc_clean), ' '), lambda t: NOT regexp_matches(t, '^\d+(\.\d+)?$') AND NOT regexp_matches(t, '^\d+(\.\d+)?(ml|cl|kg|g)$')), lambda t: replace(t, '''', '')),
      lambda t: t <> lower(brand) AND t NOT IN ('gel', 'pump', 'toothpaste', 'of', 'pack', 'ct', 'g', 'x')) AS variant_terms
  FROM p
), keyed AS (
  SELECT *, CASE WHEN valid THEN 'gtin:' || left(sha256(barcode), 16) END AS gtin_id,
    CASE WHEN size_unit IS NOT NULL THEN 'fp:' || left(sha256(upper(brand) || '|' || coalesce(printf('%.4f', size_ml), '') || '|' || coalesce(printf('%.4f', size_g), '') || '|' || coalesce(pack_count, 1)), 16) END AS fp_id
  FROM q
)"""
