"""Windows of hot anchors, and other lengths than the query's."""

import random

import pytest
from pyspark.sql import functions as F

from tests.llm.test_suffix_array import _brute, _texts
from verishelf.llm.suffix_array import _repeated_hot, kept_digest, remove_repeats


def test_equal_hot_windows_keep_their_first_place(spark):
    rows = spark.range(60_000).select(F.lit(1).alias("key"), F.when(F.col("id") % 3 == 0, 2).otherwise(F.col("id")).alias("print"), (F.lit(70_000) - F.col("id")).alias("doc"), F.lit(7).cast("long").alias("first"))
    found = _repeated_hot(rows)
    assert found.count() == 20_000 and found.agg(F.min("doc"), F.max("count")).first() == (10_006, 1)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "MapInArrow" not in plan


def test_other_lengths(spark):
    rng = random.Random(4)
    rows = list(enumerate(_texts(rng))) + [(200, "q" * 50 + "xyz" * 400), (201, "xyz" * 300 + "end")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for length, hot in ((16, 20_000), (16, 2), (400, 20_000), (400, 2)):
        got = kept_digest(remove_repeats(df, length=length, hot_variants=hot))
        assert sorted(tuple(r) for r in got.collect()) == sorted(_brute(rows, length))
    for length in (15, 1 << 20):
        with pytest.raises(ValueError):
            remove_repeats(df, length=length)
