"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verishelf.llm._common import cut

WORD = r"[^\x20\x09-\x0D]+"


def _targets(base: DataFrame, weights: Sequence[float], ratio: float, passes: int) -> DataFrame:
    """One row per source: sid, source_size, target.

    Water-filling in closed form: with sources sorted by cap / weight, the level is the first
    (budget - caps so far) / (weights left) that does not lift its own source above its cap.
    """
    sources = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = Window.orderBy(F.col("source").asc_nulls_last())
    fill = Window.orderBy("full_at", "sid").rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy("full_at", "sid").rowsBetween(0, Window.unboundedFollowing)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("sid") - 1) % len(weights) + 1).cast("int"))
    sources = (
        sources.withColumn("sid", F.row_number().over(turn))
        .withColumn("weight", w)
        .withColumn("cap", F.col("source_size") * float(passes))
        .withColumn("full_at", F.col("cap") / F.col("weight"))
        .withColumn("filled", F.coalesce(F.sum("cap").over(fill), F.lit(0.0)))
        .withColumn("left", F.sum("weight").over(rest))
    )
    total = sources.agg((F.sum("source_size") * float(ratio)).alias("budget"))
    level = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "level"))).over(Window.partitionBy())
    return (
        sources.join(F.broadcast(total))  # one row
        .withColumn("level", (F.col("budget") - F.col("filled")) / F.col("left"))
        .withColumn("at", level["level"])
        .withColumn("target", F.when(F.col("at").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("at") * F.col("weight"))))
        .select("sid", "source", "source_size", "target", "budget")
    )


def mix_sources(
    docs: DataFrame,
    *,
    weights: Sequence[float] = (5, 2, 1),
    ratio: float = 1.5,
    passes: int = 2,
    quantum: int = 256,
    seed: int = 11,
    rows_per_task: int = 250_000,
    max_broadcast_sources: int = 100_000,
    max_sources: int = 5_000_000,
    carry: bool = False,
) -> DataFrame:
    """How many words a mix takes from each document.

    Documents (doc_id, text, source; other columns are ignored) are shuffled within their
    source by a hash of doc_id and text. Each is served in packets of at most `quantum`
    words, for `passes` passes over its source. A packet's virtual finish time is the number
    of its source's words up to its end, divided by the source's target. Packets are sorted
    by it over the whole cluster (range partitions) and taken until the budget of `ratio`
    times all words is used up; the last packet is cut to what is left.

    Targets: the sources in code point order, null last, weigh `weights` in turn; a source's
    target stops at `passes` times its size and the excess goes to the others by weight.

    Returns per row of docs: doc_id, source, size, source_size, target, taken, and text_hash (its
    XXH64) if carry is set. Null texts and
    texts without words have size 0 and take 0; null doc_ids, repeated rows and ties are
    ordinary rows, and equal rows may swap results. An empty table gives an empty result.

    Running totals never gather a source in a task: rows are range-partitioned by (source,
    shuffle key), summed per partition, and the partition sums are added up. Targets are worked out over all
    sources in one task, five numbers each: more than max_sources raise.
    """
    spark = docs.sparkSession
    base = cut(
        docs.select(
            F.col("doc_id"),
            F.col("source"),
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.xxhash64(F.lit(seed), "doc_id", F.xxhash64("text")).alias("u"),
            *([F.xxhash64("text").alias("text_hash")] if carry else []),
        )
    )
    if base.select("source").distinct().count() > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    targets = cut(_targets(base, weights, ratio, passes))
    facts = targets.agg(F.count("*").alias("n"), F.max("budget").alias("budget")).first()
    n = base.count()
    at_once = F.broadcast(targets.drop("budget")) if facts["n"] <= max_broadcast_sources else targets.drop("budget")
    rows = base.join(at_once.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")

    parts = max(1, math.ceil(n / rows_per_task), int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)
    rows = cut(rows.repartitionByRange(parts, "sid", "u", "doc_id").withColumn("pid", F.spark_partition_id()))
    sums = rows.groupBy("pid", "sid").agg(F.sum("size").alias("part_sum"))
    before = F.coalesce(F.sum("part_sum").over(Window.partitionBy("sid").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select("pid", "sid", before.alias("before"))
    run = Window.partitionBy("pid", "sid").orderBy("u", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = cut(rows.join(offsets, ["pid", "sid"]).withColumn("upto", F.col("before") + F.sum("size").over(run)).drop("pid", "before", "u"))

    packets = F.ceil(F.col("size") / F.lit(quantum)).cast("long")
    k, again = F.col("i") % F.col("np"), F.floor(F.col("i") / F.col("np")).cast("long")
    queue = (
        rows.where("size > 0")
        .select("sid", "upto", "size", "source_size", "target", packets.alias("np"))
        .withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("np") * passes - 1)))
        .withColumn("words", F.least(F.lit(quantum).cast("long"), F.col("size") - k * quantum))
        .withColumn("end", again * F.col("source_size") + F.col("upto") - F.col("size") + F.least(F.col("size"), (k + 1) * quantum))
        .select((F.col("end") / F.col("target")).alias("finish"), "sid", "end", "upto", "words")
    )
    queue = cut(queue.repartitionByRange(parts * 2, "finish", "sid", "end").withColumn("pid", F.spark_partition_id()))
    sums = queue.groupBy("pid").agg(F.sum("words").alias("part_sum"))
    before = F.coalesce(F.sum("part_sum").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select("pid", before.alias("before"))
    run = Window.partitionBy("pid").orderBy("finish", "sid", "end").rowsBetween(Window.unboundedPreceding, 0)
    budget = F.lit(math.floor(facts["budget"] or 0)).cast("long")
    served = queue.join(offsets, "pid").withColumn("sum", F.col("before") + F.sum("words").over(run))
    took = F.greatest(F.lit(0).cast("long"), F.least(F.col("words"), budget - (F.col("sum") - F.col("words"))))
    taken = served.groupBy("sid", "upto").agg(F.sum(took).alias("got")).where("got > 0").withColumn("some", F.lit(True))
    rows = rows.withColumn("some", F.col("size") > 0)
    return rows.join(taken, ["sid", "upto", "some"], "left").select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("got", F.lit(0).cast("long")).alias("taken"), *(["text_hash"] if carry else [])
    )
