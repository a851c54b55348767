"""Hot-key lookups, samples and numbering."""

import pytest
from pyspark.sql import functions as F

from verishelf.llm._common import drawn, lookup, numbering


def test_lookup_with_hot_keys(spark):
    rows = spark.range(6000).select(F.col("id"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") + 100).alias("k"))
    facts = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("low"))
    got = lookup(rows, facts, "k", "n")
    assert got.columns == ["k", "id", "n", "low"] and got.count() == 6000 and got.where("k = 7").agg(F.min("low"), F.max("low"), F.count("*")).first() == (0, 0, 2000)
    few = rows.where("id < 100")
    assert lookup(few, few.groupBy("k").agg(F.count("*").alias("n")), "k", "n").count() == 100
    assert lookup(few.limit(0), few.limit(0).groupBy("k").agg(F.count("*").alias("n")), "k", "n").count() == 0


def test_samples_are_about_as_large_as_asked(spark):
    rows = spark.range(50_000)
    got = drawn(rows, 1000, "id")
    assert 800 < got.count() < 1200 and sorted(r[0] for r in got.collect()) == sorted(r[0] for r in drawn(rows.repartition(7), 1000, "id").collect())
    assert drawn(rows, 60_000, "id").count() == 50_000 and drawn(rows.limit(0), 5, "id").count() == 0


def test_numbers_differ(spark):
    assert numbering(spark.range(1000), "id") == 0
    with pytest.raises(RuntimeError):
        numbering(spark.range(5).unionAll(spark.range(5)), "id")
