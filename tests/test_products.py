"""Descriptions, records, keys and searches on hand-worked rows."""

import pytest
from pyspark.sql import functions as F

from verishelf.functions import text as T
from verishelf.operators import products as P

ROWS = [
    # description, brand, retailer, (clean, value, unit, ml, g, count, formats, variants)
    ("acme whitening pump 100ml unit 00000012 e0028", "ACME", "E0028 (GB) SHOPCO", ("acme whitening pump 100ml", 100.0, "ml", 100.0, None, None, ["pump"], ["whitening"])),
    ("dento fresh mouthwash twin pack x 250ml shopco", "DENTO", "SHOPCO", ("dento fresh mouthwash twin pack x 250ml", 250.0, "ml", 250.0, None, 2, ["mouthwash"], ["fresh", "twin"])),
    ("acme gel 2x stronger enamel 75ml 1 count (pack of 3) shopco", "ACME", "SHOPCO", ("acme gel 2x stronger enamel 75ml 1 count (pack of 3)", 75.0, "ml", 75.0, None, 3, ["gel"], ["2x", "stronger", "enamel"])),
    ("acme rinse 0.2% 300ml shopco", "ACME", "SHOPCO", ("acme rinse 0.2% 300ml", 300.0, "ml", 300.0, None, None, ["rinse"], None)),
    ("acme tabs 20 x 1.7 gr shopco", "ACME", "SHOPCO", ("acme tabs 20 x 1.7 gr", 1.7, "g", None, 1.7, 20, [], ["tabs", "gr"])),
    ("acme wash 1 litre shopco", "ACME", "SHOPCO", ("acme wash 1 litre", 1.0, "ml", 1000.0, None, None, [], ["wash", "litre"])),
    ("nûby natural paste 45g shopco", "NÛBY", "SHOPCO", ("nûby natural paste 45g", 45.0, "g", None, 45.0, None, ["paste"], ["natural"])),
    ("acme mint floss acme extra free each shopco", "ACME", "SHOPCO", ("acme mint floss extra free", None, None, None, None, None, ["floss"], ["mint", "extra", "free"])),
    ("acme paste 119g 119g shopco", "ACME", "SHOPCO", ("acme paste 119g", 119.0, "g", None, 119.0, None, ["paste"], [])),
    ("acme paste 119g 119.00 g shopco", "ACME", "SHOPCO", ("acme paste 119g 119.00 g", 119.0, "g", None, 119.0, None, ["paste"], [])),
    ("boots brand brush shopco", "OWN", "SHOPCO", ("boots brand brush", None, None, None, None, None, [], ["boots", "brand", "brush"])),
    ("shopco shopco", "OWN", "SHOPCO", ("", None, None, None, None, None, [], [])),
    ("", "OWN", "SHOPCO", ("", None, None, None, None, None, [], [])),
]


def _rows(spark):
    df = spark.createDataFrame([(f"dev:{i}", i, r[0], r[1], r[2]) for i, r in enumerate(ROWS)], "row_uid string, row_index long, desc_raw string, brand string, retailer_raw string")
    return df.withColumns({"brand_owner": F.lit(None).cast("string"), "retailer": F.lit("SHOPCO")})


def test_golden_descriptions(spark):
    got = P.normalize(_rows(spark)).orderBy("row_index").collect()
    for r, (_, _, _, want) in zip(got, ROWS):
        assert (r["desc_clean"], r["size_value"], r["size_unit"], r["size_ml"], r["size_g"], r["pack_count"], r["format_hints"]) == want[:7], r
        assert want[7] is None or r["variant_terms"] == want[7]
    assert got[0]["stripped_junk"] == ["e0028", "unit 00000012"]


def test_counts_by_rank(spark):
    cases = {"10 x 15ml": 10, "12x wisdom": 12, "x8 heads": 8, "twin pack x 250ml": 2, "3x more": None, "3x more 2 x 5g": 2, "pack of 4": 4, "3 pack": 3, "3-pack": 3, "6's": 6, "5 count": 5, "1 count (pack of 4)": 4, "none": None}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", T.pack_count(F.col("t")).alias("n"))
    assert {r["t"]: r["n"] for r in df.collect()} == cases


def test_cells_and_fields(spark):
    df = spark.createDataFrame([("5014697056627.0",), ("'5014697056627",), ("5010000000000",), ("266611",), ("nan",), (" ",), (None,)], "c string")
    c = T.external_code(F.col("c"))
    got = [tuple(r) for r in df.select(c, T.barcode(c), T.barcode_corrupt(c), T.barcode_valid(T.barcode(c))).collect()]
    gtin = "5014697056627"
    assert got == [(gtin, gtin, False, True), (gtin, gtin, False, True), ("5010000000000", None, True, False), ("266611", "266611", False, False)] + [(None, None, False, False)] * 3
    b = spark.createDataFrame([("ACME (HOLDCO)",), ("ACME",)], "b string").select(T.brand_name(F.col("b")), T.brand_owner(F.col("b"))).collect()
    assert [tuple(x) for x in b] == [("ACME", "HOLDCO"), ("ACME", None)]
    assert spark.range(1).select(T.countries(F.lit("BE, GB,NL"))).first()[0] == ["BE", "GB", "NL"]
    assert spark.range(1).select(T.repair_encoding(F.lit("nÃ»by")), T.repair_encoding(F.lit("nûby")), T.repair_encoding(F.lit("Ã — x"))).first()[:] == ("nûby", "nûby", "Ã — x")


def test_numbers_as_text(spark):
    cases = {100.0: "100", 1.0: "1", 0.5: "0.5", 1e7: "1e+07", 123456.0: "123456", 1234567.0: "1.23457e+06", 1e-5: "1e-05", 0.0001: "0.0001", 33.25: "33.25", 2 / 3: "0.666667", 1234.5678: "1234.57", 0.0: "0"}
    df = spark.createDataFrame([(k,) for k in cases], "v double").select("v", T.format_g(F.col("v")).alias("g"))
    assert {r["v"]: r["g"] for r in df.collect()} == cases


def test_ngrams(spark):
    df = spark.createDataFrame([("Mint",), ("",), ("a",), ("a--b",)], "t string").select(T.char_ngrams(F.col("t")).alias("g"))
    assert [r["g"] for r in df.collect()] == [["4: min", "4:mint", "4:int "], [], [], ["4: a b", "4:a b "]]


def test_keys(spark):
    rows = spark.createDataFrame([("a", " acme ", "5014697056627", 100.0, None, None), ("b", "x", None, None, None, 2)], "row_uid string, brand string, barcode string, size_ml double, size_g double, pack_count int")
    assert rows.select(P.fingerprint()).first()[0] == "ACME|100.0000||1"
    keyed = P.with_keys(rows).collect()
    assert keyed[0]["gtin_id"] == "gtin:00c92a6376b9b27d" and keyed[1]["gtin_id"] is None and keyed[1]["fp_id"] is None
    assert P.block_keys(rows).count() == 2


def test_input_is_checked(spark):
    table = spark.createDataFrame([("acme gel", "ACME (OWN)", "'12345678", "1.0")], "RETAILER_DESC string, BRAND string, EXTERNAL_CODE string, ITEM_CODE string")
    r = P.read_records(table, "qa", F.lit(0)).first()
    assert (r["row_uid"], r["brand"], r["brand_owner"], r["barcode"], r["item_code"], r["countries"], r["retailer"]) == ("qa:0", "ACME", "OWN", "12345678", 1, ["GB"], "UNKNOWN")
    with pytest.raises(ValueError):
        P.read_records(table.drop("BRAND"), "qa", F.lit(0))
    with pytest.raises(Exception, match="RETAILER_DESC is empty"):
        P.read_records(table.withColumn("RETAILER_DESC", F.lit("  ")), "qa", F.lit(0)).collect()


def test_merge_stops_early(spark):
    rows = [("r", "S2", 1, "u1", True), ("r", "S2", 2, "u2", False), ("r", "S3", 1, "u2", False), ("r", "S3", 2, "u3", False), ("r", "S4", 1, "u4", False)]
    df = spark.createDataFrame(rows, "row_uid string, strategy string, rank int, url string, is_about boolean")
    got = [(r["url"], r["strategy"]) for r in P.merge_candidates(df, fetch_budget=2).orderBy("position").collect()]
    assert got == [("u2", "S2"), ("u3", "S3"), ("u1", "S2")]
