"""From messy records to typed queries: input reading, normalization, block keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verishelf.functions import text as T
from verishelf.functions import vocab

REQUIRED = ("RETAILER_DESC", "BRAND")
OPTIONAL = ("EXTERNAL_CODE", "RETAILER", "COUNTRY", "ITEM_CODE", "NAN_KEY")


def read_records(table: DataFrame, sheet: str, index: Column, retailers: DataFrame | None = None) -> DataFrame:
    """Typed records of an input table whose columns are all text.

    The two required columns must be there and filled, or it raises; the optional ones have
    defaults. retailers: (retailer_raw, name, domain), a small table that is joined on the left;
    unknown retailers keep their text.
    """
    missing = [c for c in REQUIRED if c not in table.columns]
    if missing:
        raise ValueError(f"the input lacks {missing}")
    cell = lambda c: T.clean_cell(F.col(c)) if c in table.columns else F.lit(None).cast("string")
    filled = lambda c: F.coalesce(cell(c), F.raise_error(F.lit(f"{c} is empty")))
    code = T.external_code(F.col("EXTERNAL_CODE")) if "EXTERNAL_CODE" in table.columns else F.lit(None).cast("string")
    raw = table.select(
        F.concat_ws(":", F.lit(sheet), index.cast("string")).alias("row_uid"),
        index.cast("long").alias("row_index"),
        T.repair_encoding(filled("RETAILER_DESC")).alias("desc_raw"),
        T.brand_name(F.coalesce(cell("BRAND"), F.lit("UNKNOWN"))).alias("brand"),
        T.brand_owner(F.coalesce(cell("BRAND"), F.lit("UNKNOWN"))).alias("brand_owner"),
        code.alias("barcode_raw"),
        T.barcode(code).alias("barcode"),
        T.barcode_corrupt(code).alias("barcode_corrupt"),
        F.coalesce(cell("RETAILER"), F.lit("UNKNOWN")).alias("retailer_raw"),
        T.countries(F.coalesce(cell("COUNTRY"), F.lit("GB"))).alias("countries"),
        (T.int_key(F.col("ITEM_CODE")) if "ITEM_CODE" in table.columns else F.lit(0).cast("long")).alias("item_code"),
        (T.int_key(F.col("NAN_KEY")) if "NAN_KEY" in table.columns else F.lit(0).cast("long")).alias("nan_key"),
    )
    if retailers is None:
        return raw.withColumns({"retailer": F.col("retailer_raw"), "domain": F.lit(None).cast("string")})
    return raw.join(retailers, "retailer_raw", "left").withColumn("retailer", F.coalesce("name", "retailer_raw")).drop("name")


def normalize(rows: DataFrame) -> DataFrame:
    """rows with desc_clean, the parsed tokens and stripped_junk.

    rows: desc_raw, brand, brand_owner, retailer_raw, retailer. The cleaning steps run in this
    order: retailer at the end, "unit N", units of sale, repeated sizes, the repeated brand.
    """
    split = lambda c: F.split(c, r"(?U)\s+")
    retailer = F.transform(T.tokenize(F.concat_ws(" ", "retailer_raw", "retailer")), T.alnum)
    unit = r"(?iU)\bunit\s+\d+\b"
    brand = F.concat(F.lit("(?iU)\\b\\Q"), F.col("brand"), F.lit("\\E\\b"))
    df = rows.withColumns({"_p": split(F.col("desc_raw")), "_r": retailer})
    df = df.withColumn("_n", T.keep_words(F.col("_p"), F.col("_r")))
    df = df.withColumns({"_a": F.array_join(F.slice("_p", F.lit(1), F.col("_n")), " "), "_j1": F.reverse(F.slice("_p", F.col("_n") + 1, F.greatest(F.size("_p") - F.col("_n"), F.lit(0))))})
    df = df.withColumns({"_b": F.regexp_replace("_a", unit, " "), "_j2": F.regexp_extract_all("_a", F.lit(unit), F.lit(0))})
    sale = lambda w: T.alnum(w).isin(*vocab.UNIT_OF_SALE)
    df = df.withColumn("_s", F.transform(split(F.col("_b")), lambda w: F.struct(w.alias("w"), sale(w).alias("sale"))))
    word = lambda x: x["w"]
    df = df.withColumns({"_c": F.array_join(F.transform(F.filter("_s", lambda x: ~x["sale"]), word), " "), "_j3": F.transform(F.filter("_s", lambda x: x["sale"]), word)})
    once, gone = T.without_repeats(F.col("_c"), F.lit(T.SIZE), T.size_key)
    df = df.withColumns({"_d": once, "_j4": gone})
    once, gone = T.without_repeats(F.col("_d"), brand, lambda m: F.lit("brand"))
    long = F.length("brand") >= 3
    df = df.withColumns({"desc_clean": T.collapse(F.when(long, once).otherwise(F.col("_d"))), "_j5": F.when(long, gone).otherwise(F.array().cast("array<string>"))})
    junk = F.filter(F.transform(F.concat("_j1", "_j2", "_j3", "_j4", "_j5"), T.strip), lambda x: x != "")
    desc = F.col("desc_clean")
    df = df.withColumns({f"_size_{k}": c for k, c in T.size_parts(desc).items()})
    unit = F.when(F.col("_size_ml").isNotNull(), "ml").when(F.col("_size_g").isNotNull(), "g")
    return df.withColumns(
        {
            "stripped_junk": junk,
            "size_value": F.when(unit.isNotNull(), F.col("_size_value")),
            "size_unit": unit,
            "size_ml": F.col("_size_ml"),
            "size_g": F.col("_size_g"),
            "pack_count": T.pack_count(desc),
            "format_hints": T.format_hints(desc),
            "variant_terms": T.variant_terms(desc, F.col("brand"), F.col("brand_owner")),
        }
    ).drop("_p", "_r", "_n", "_a", "_b", "_s", "_c", "_d", "_j1", "_j2", "_j3", "_j4", "_j5", "_size_value", "_size_ml", "_size_g")


# ---- block keys -----------------------------------------------------------------------------


def fingerprint() -> Column:
    """Brand, size and count as one key; null without a size."""
    four = lambda c: F.when(F.col(c).isNull(), "").otherwise(F.format_string("%.4f", F.col(c)))
    key = F.concat(F.upper(T.strip(F.col("brand"))), F.lit("|"), four("size_ml"), F.lit("|"), four("size_g"), F.lit("|"), F.coalesce("pack_count", F.lit(1)).cast("string"))
    return F.when(F.col("size_ml").isNotNull() | F.col("size_g").isNotNull(), key)


def entity_id(kind: str, key: Column) -> Column:
    return F.when(key.isNotNull(), F.concat(F.lit(f"{kind}:"), F.left(F.sha2(key, 256), F.lit(16))))


def with_keys(rows: DataFrame) -> DataFrame:
    """rows with gtin_id and fp_id, each null where the row can't have it."""
    gtin = F.when(T.barcode_valid(F.col("barcode")), F.col("barcode"))
    return rows.withColumns({"gtin_id": entity_id("gtin", gtin), "fp_id": entity_id("fp", fingerprint())})


def block_keys(rows: DataFrame) -> DataFrame:
    """row_uid, key, method: one row for each key that a record has."""
    keyed = with_keys(rows)
    one = lambda c, m: F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("key"), F.lit(m).alias("method")))
    return keyed.select("row_uid", F.explode(F.array_compact(F.array(one("gtin_id", "exact_gtin"), one("fp_id", "fingerprint")))).alias("k")).select("row_uid", "k.key", "k.method")


def block_stats(keys: DataFrame) -> DataFrame:
    """Per method: blocks, blocks of several rows, and pairs within blocks (counted, not made)."""
    sizes = keys.groupBy("method", "key").agg(F.count("*").alias("n"))
    return sizes.groupBy("method").agg(
        F.count("*").alias("blocks"), F.count_if(F.col("n") > 1).alias("multi_row_blocks"), F.sum(F.expr("n * (n - 1) div 2")).alias("pairs")
    )


def blocked_pairs(rows: DataFrame, on: str, uid: str) -> DataFrame:
    """Pairs of rows in a block, each once: left_uid < right_uid. As many rows as there are pairs."""
    a, b = rows.select(F.col(on), F.col(uid).alias("left_uid")), rows.select(F.col(on), F.col(uid).alias("right_uid"))
    return a.join(b, on).where("left_uid < right_uid")


# ---- search queries -------------------------------------------------------------------------


def identity_phrase() -> Column:
    size = F.when(F.col("size_value").isNotNull() & F.col("size_unit").isNotNull(), F.concat(T.format_g(F.col("size_value")), F.col("size_unit")))
    return F.array_join(F.filter(F.concat(F.array("brand"), F.col("variant_terms"), F.col("format_hints"), F.array(F.coalesce(size, F.lit("")))), lambda x: x != ""), " ")


def search_queries(rows: DataFrame) -> DataFrame:
    """row_uid, strategy, text: the searches of each record, by what it has."""
    phrase, valid = identity_phrase(), T.barcode_valid(F.col("barcode"))
    one = lambda s, cond, c: F.when(cond, F.struct(F.lit(s).alias("strategy"), c.alias("text")))
    desc = T.strip(F.col("desc_clean"))
    made = F.array_compact(
        F.array(
            one("S1", valid, F.concat(F.lit('"'), F.col("barcode"), F.lit('"'))),
            one("S2", valid, T.strip(F.concat_ws(" ", "barcode", "brand"))),
            one("S3", phrase != "", phrase),
            one("S4", (phrase != "") & F.col("domain").isNotNull(), F.concat(F.lit("site:"), F.col("domain"), F.lit(" "), phrase)),
            one("S5", desc != "", desc),
        )
    )
    return rows.select("row_uid", F.explode(made).alias("q")).select("row_uid", "q.strategy", "q.text")


def merge_candidates(results: DataFrame, *, limit: int = 20, fetch_budget: int = 8, per_strategy: int = 8, order: tuple[str, ...] = vocab.STRATEGY_ORDER) -> DataFrame:
    """The candidate URLs of each record, ranked.

    results: row_uid, strategy, rank, url (canonical), is_about. A strategy counts only if the
    ones before it found fewer product-shaped URLs than the budget. The first strategy that found
    a URL keeps it. Pages about a product come last; the limit is per record.
    """
    at = F.array_position(T.words(order), F.col("strategy"))
    row = Window.partitionBy("row_uid")
    df = results.where(F.col("rank") <= per_strategy).withColumn("_at", at)
    df = df.withColumn("_first", F.row_number().over(Window.partitionBy("row_uid", "url").orderBy("_at", "rank", "is_about")) == 1)
    new = F.when(F.col("_first") & ~F.col("is_about"), 1).otherwise(0)
    before = F.coalesce(F.sum(new).over(row.orderBy("_at").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    df = df.withColumn("_before", before).where(F.col("_first") & (F.col("_before") < fetch_budget))
    df = df.withColumn("position", F.row_number().over(row.orderBy("is_about", "_at", "rank", "url"))).where(F.col("position") <= limit)
    return df.drop("_at", "_first", "_before")
