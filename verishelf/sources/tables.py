"""Reading, writing and caching tables; lineage cuts; global ranks."""

from __future__ import annotations

import hashlib
import math
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from verishelf.sources import workbook


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A product list as text columns; cells may hold line breaks."""
    return spark.read.csv(path, header=True, inferSchema=False, encoding="UTF-8", multiLine=True, escape='"')


def read_xlsx(spark: SparkSession, path: str, sheet: str | int = 0) -> DataFrame:
    """A sheet as text columns, its first row the header. Workbooks are small: one goes through the driver, its
    bytes through Spark, so that any file system works."""
    row = spark.read.format("binaryFile").load(path).select("content").first()
    rows = workbook.read_sheet(bytes(row["content"]), sheet)
    names = [n or "" for n in rows[0]] if rows else []
    if not names or len(set(names)) < len(names) or "" in names:
        raise ValueError("the sheet's first row must name each column once")
    cells = [(*r[: len(names)], *[None] * (len(names) - len(r))) for r in rows[1:]]
    return spark.createDataFrame(cells, StructType([StructField(n, StringType()) for n in names]))


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines; a malformed line fails the read."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def write_jsonl(df: DataFrame, path: str, *order: str, mode: str = "overwrite") -> None:
    (df.orderBy(*order) if order else df).write.mode(mode).json(path)


def write_csv(df: DataFrame, path: str, order: str, columns: tuple[str, ...]) -> None:
    """One file in row order with a header and empty cells for nulls: the shape a person is handed."""
    df.orderBy(order).select(*columns).coalesce(1).write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="", lineSep="\n")


def xlsx_bytes(df: DataFrame, order: str, columns: tuple[str, ...], most: int = 1_000_000) -> bytes:
    """A workbook of one sheet of text cells in row order: the same rows give the same bytes.

    It is made on the driver; more than `most` rows, which no sheet holds, raise.
    """
    rows = df.orderBy(order).select(*[F.col(c).cast("string") for c in columns]).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    return workbook.write_sheet([list(columns), *map(list, rows)])


def write_xlsx(df: DataFrame, path: str, order: str, columns: tuple[str, ...]) -> None:
    """xlsx_bytes as a file of the driver."""
    with open(path, "wb") as f:
        f.write(xlsx_bytes(df, order, columns))


def first_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in an order, for trial runs."""
    return df.orderBy(*order).limit(n)


def check_schema(df: DataFrame, columns: list[str], not_null: list[str], rows: int | None = None) -> list[str]:
    """What is wrong with a table: header, nulls, number of rows. One aggregate."""
    if df.columns != columns:
        return [f"the header is {df.columns}"]
    got = df.agg(F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in not_null]).first()
    return [f"{c} has {got[c]} nulls" for c in not_null if got[c]] + ([f"{got['_n']} rows"] if rows is not None and got["_n"] != rows else [])


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def content_hash(files: dict[str, bytes]) -> str:
    """A hash of named contents that doesn't depend on their order."""
    h = hashlib.sha256()
    for name in sorted(files):
        h.update(name.encode() + b"\0" + files[name] + b"\0")
    return h.hexdigest()


# ---- caches and stages ----------------------------------------------------------------------


def cache_key(*parts: Column) -> Column:
    """A hash of the parts as one JSON text; list the members of a set sorted."""
    return F.sha2(F.to_json(F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts)]), {"ignoreNullFields": "false"}), 256)


def cached(requests: DataFrame, cache: DataFrame, key: str, now: Column, ttl: Column) -> DataFrame:
    """requests with `fresh` and the columns of the newest entry of their key.

    cache: key, fetched_at (seconds) and payload columns. An entry is fresh up to its ttl.
    """
    newest = cache.groupBy(key).agg(F.max_by(F.struct(*[c for c in cache.columns if c != key]), "fetched_at").alias("_e")).select(key, "_e.*")
    out = requests.join(newest, key, "left")
    return out.withColumn("fresh", F.coalesce(now - F.col("fetched_at") <= ttl, F.lit(False)))


def packed_cache(cache: DataFrame, used: DataFrame, key: str) -> DataFrame:
    """The newest entry of each key in use: what a cache must hold to run the same requests offline."""
    newest = cache.groupBy(key).agg(F.max_by(F.struct(*[c for c in cache.columns if c != key]), "fetched_at").alias("_e")).select(key, "_e.*")
    return newest.join(used.select(key).distinct(), key, "left_semi")


def completed(artifacts: DataFrame, stages: tuple[str, ...]) -> DataFrame:
    """row_uid of the rows that have a payload of every stage."""
    own = artifacts.where(F.col("stage").isin(*stages) & (F.coalesce(F.length("payload"), F.lit(0)) > 0))
    return own.groupBy("row_uid").agg(F.count_distinct("stage").alias("n")).where(F.col("n") == len(stages)).select("row_uid")


def pending(rows: DataFrame, artifacts: DataFrame, stages: tuple[str, ...]) -> DataFrame:
    return rows.join(completed(artifacts, stages), "row_uid", "left_anti")


# ---- lineage and ranks ----------------------------------------------------------------------


def cut(df: DataFrame) -> DataFrame:
    """df as read back from the cluster's checkpoint folder; a local session gets one of its own."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        master = spark.sparkContext.master
        if named is None and (not master.startswith("local") or master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir is not set")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="verishelf-"))
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df dealt to all cores by columns if it comes in fewer parts than there are cores; others stay as they are.

    A table of one small file is one part, and all that is parsed from it one task.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *by) if df.rdd.getNumPartitions() < cores else df


def global_rank(df: DataFrame, by: list, name: str, rows_per_task: int = 500_000) -> tuple[DataFrame, int]:
    """df with its 1-based rank in a total order, and the number of rows."""
    first = cut(df)
    n = first.count()
    ranged = cut(first.repartitionByRange(max(1, math.ceil(n / rows_per_task)), *by).withColumn("_pid", F.spark_partition_id()))
    counts = ranged.groupBy("_pid").agg(F.count("*").alias("_c"))  # one row a partition
    before = counts.select("_pid", F.coalesce(F.sum("_c").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    return ranged.join(before, "_pid").withColumn(name, F.col("_b") + F.row_number().over(Window.partitionBy("_pid").orderBy(*by))).drop("_pid", "_b"), n
