"""All pairs of a block by bits: equal to the plain matcher, whatever the tiles."""

import random

import pytest
from pyspark.sql import functions as F

from verishelf.operators import blocks, match
from verishelf.plans import inputs

SEEN = ("row_uid", "url", "barcode_exact", "brand_match", "variant_overlap", "size_match", "count_match", "format_consistent", "retailer_domain_match", "market_signal", "n_flags", "is_about", "weighted", "score", "rejected")


def _sides(spark, n_words):
    rnd = random.Random(5)
    words = ["mint", "fresh", "whitening", "travel", "refill", *[f"word{i:02}" for i in range(n_words)]]
    codes = ["5014697056627", "5014697056628", "501469", None, None]
    pick = lambda n: rnd.sample(words, rnd.randint(0, n))
    row = lambda i: (f"q:{i}", rnd.choice(["ACME-X y", "Oral", ""]), rnd.choice(codes), " ".join(pick(2)), pick(5), rnd.choice([["gel"], [], ["gel", "paste"], None]), 50.0, rnd.choice([50.0, 75.0, None]), rnd.choice([None, 50.0]), rnd.choice([None, 1, 2]), rnd.choice([["GB", "FR"], ["DE"], []]), rnd.choice([None, "s1.test"]), rnd.choice([0, 1, None]))
    q = spark.createDataFrame([row(i) for i in range(50)], "row_uid string, brand string, barcode string, desc_clean string, variant_terms array<string>, format_hints array<string>, size_value double, size_ml double, size_g double, pack_count int, countries array<string>, domain string, block int")
    hosts = ["www.s1.test", "shop.co.uk", "acme.de", "x.com", "buycott.com"]
    page = lambda i: (f"https://{rnd.choice(hosts)}/{rnd.choice(['acme-x', 'acmex', 'p/', 'en-gb', 'search?q='])}{i if i % 3 else ''}", " ".join([rnd.choice(["Acme-X", "Oral", ""]), *pick(5), rnd.choice(["50ml", "75 ml", "50g", ""]), rnd.choice(["gel", "pack of 2", ""])]), rnd.choice(codes), i % 3)
    p = spark.createDataFrame(list({r[0]: r for r in map(page, range(70))}.values()), "url string, title string, gtin string, block int").withColumn("body_text", F.lit(""))
    return q, p


@pytest.mark.parametrize("n_words,pairs,pages,longs", [(0, 2_000_000, 16_384, 8), (90, 60, 9, 8), (90, 200, 16_384, 1)])
def test_pairs_by_bits(spark, monkeypatch, n_words, pairs, pages, longs):
    """Few and many words, one and several tiles, and a list that is too long for bits."""
    for name, value in (("TILE_PAIRS", pairs), ("TILE_PAGES", pages), ("MOST_LONGS", longs)):
        monkeypatch.setattr(blocks, name, value)
    q, p = _sides(spark, n_words)
    plain = match.score(match.features(q.join(p, "block"))).withColumn("n_flags", F.size("negative_flags"))
    sides = match.parse_records(q), match.parse_pages(p)
    rows = lambda df, *c: sorted(map(str, df.select(*c).collect()))
    got, _, _ = blocks.scored_pairs(*sides, ["block"])
    assert rows(got, *SEEN) == rows(plain, *SEEN)
    coded, _, _ = blocks.scored_pairs(*sides, ["block"], coded=True)
    assert rows(coded, *SEEN) == rows(plain.where("barcode_exact is not null"), *SEEN)
    kept = ("row_uid", "url", "score", "rejected", "position")
    assert rows(blocks.ranked_pairs(*sides, ["block"]), *kept) == rows(match.rank(plain), *kept)


@pytest.mark.parametrize("class_rows,scored", [(256, 1), (5, 24)])
def test_equal_records_and_pages_are_scored_once(spark, monkeypatch, class_rows, scored):
    """Copies that differ in their names and barcodes only: classes meet, every pair comes out."""
    seen, score = [], blocks._score
    monkeypatch.setattr(blocks, "CLASS_ROWS", class_rows)
    monkeypatch.setattr(blocks, "_score", lambda df, c: seen.append(df.count()) or score(df, c))
    q, p = _sides(spark, 0)
    codes = F.when(F.col("i") % 2 == 0, F.concat(F.lit("50146970566"), F.col("i") + 10))
    q = spark.range(20).withColumnRenamed("id", "i").crossJoin(q.limit(1).drop("row_uid", "barcode", "block")).withColumns({"row_uid": F.concat(F.lit("q:"), "i"), "barcode": codes, "block": F.lit(0)})
    p = spark.range(30).withColumnRenamed("id", "i").crossJoin(p.limit(1).drop("url", "gtin", "block")).withColumns({"url": F.concat(F.lit("https://x.com/p/"), "i"), "gtin": codes, "block": F.lit(0)})
    q, p = q.drop("i"), p.drop("i")
    plain = match.score(match.features(q.join(p, "block"))).withColumn("n_flags", F.size("negative_flags"))
    got, _, _ = blocks.scored_pairs(match.parse_records(q), match.parse_pages(p), ["block"])
    rows = lambda df: sorted(map(str, df.select(*SEEN).collect()))
    assert seen == [scored] and rows(got) == rows(plain) and len(rows(got)) == 600


def test_rounding_is_that_of_decimals(spark):
    values = [0.0046875, 0.1234565, 0.1234564999999, 1.0, 0.0, 1 / 3, 0.35 + 0.3 * 2 / 3, 0.0000005]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert all(r["a"] == r["b"] for r in df.select(blocks.round_to(F.col("x"), 6).alias("a"), F.round("x", 6).alias("b")).collect())


def test_retailers_of_one_name_multiply_no_records(spark, tmp_path):
    for i in range(2):
        spark.createDataFrame([(k + 10 * i, f"Supplier#{k:09}") for k in range(10)], "s_suppkey long, s_name string").write.mode("append").parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(k, "red ring", "Brand#1", 5) for k in range(20)], "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    assert inputs.products(spark, str(tmp_path)).count() == 20
