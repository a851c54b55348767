"""Helpers shared by the corpus operators: table reads, lineage cuts and components."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the driver's tables, read through Spark so that any file system works."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the cluster's checkpoint folder; set one only on a local master without any."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="verishelf-checkpoint-"))
    else:
        raise ValueError("spark.checkpoint.dir is not set; a cluster needs a folder that all executors share")


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from the written rows."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most that many rows, so that a worker holds little at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def raw_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding it."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def numbering(df: DataFrame, *by: str) -> int:
    """A seed for which xxhash64(seed, *by) differs between all rows of df; they must differ in `by`."""
    for seed in range(8):
        if df.select(F.xxhash64(F.lit(seed), *by).alias("h")).groupBy("h").count().where("count > 1").isEmpty():
            return seed
    raise RuntimeError("rows are repeated")


def drawn(df: DataFrame, most: int, *by: str, n: int | None = None) -> DataFrame:
    """A sample of about `most` rows: those of a small hash of `by`, which should differ between rows.

    The hash is compared with a bound that follows from the number n of rows, so no task sends more
    than its share; the same rows are drawn in every run.
    """
    n = df.count() if n is None else n
    return df if n <= most else df.where(F.pmod(F.xxhash64(F.lit(97), *by), F.lit(1 << 40)) < int((1 << 40) * most / n))


def lookup(rows: DataFrame, facts: DataFrame, key: str, count: str) -> DataFrame:
    """rows joined with facts by key. facts: one row a key, key not null, and `count`: how many rows have it.

    A key with over a two-thousandth of all rows is hot. There are at most two thousand such keys; their
    facts are broadcast, and their rows never meet in a task.
    """
    total = facts.agg(F.sum(count)).first()[0] or 0
    hot = facts.where(F.col(count) > total // 2000)
    if total < 2000 or hot.isEmpty():
        return rows.join(facts, key)
    hot = cut(hot)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(facts.where(F.col(count) <= total // 2000), key)
    return cold.unionByName(rows.join(F.broadcast(hot), key))


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, root of the edges of all batches together."""
    a, b = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for batch in batches:
        a.append(batch.column("a").to_numpy())
        b.append(batch.column("b").to_numpy())
    nodes, at = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    links = Links(len(nodes))
    links.join(at[: len(at) // 2], at[len(at) // 2 :])
    for lo in range(0, len(nodes), 65536):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[lo : lo + 65536]), pa.array(nodes[links.label[lo : lo + 65536]])], names=["node", "root"])


class Links:
    """Union-find over numbers from 0 to n - 1, kept as flat labels: the smallest number linked."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Each a with its b: labels fall to the smallest until none differs."""
        while len(a):
            x, y = self.label[a], self.label[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            down = np.arange(len(self.label))
            np.minimum.at(down, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(hop := down[down], down):
                down = hop
            self.label = down[self.label]


def components(edges: DataFrame, max_rounds: int = 60, one_task: int = 1 << 20) -> DataFrame:
    """Connected components of an undirected graph.

    edges has long columns a and b; self-loops and repeats are harmless and nulls are not
    allowed. Returns (node, root) with root the smallest node of the component, for every
    node of an edge. A graph of at most one_task different edges (16 bytes each) is solved in one
    task, without a shuffle. A larger one alternates the large-star and small-star steps until the edge set
    stands still (a number of rounds that grows with the square of the log of the graph at
    most). Each step is a group minimum, combined map-side, and a join back, which adaptive
    execution may split where a node has very many edges. Each round is checkpointed.
    """
    def prints(df: DataFrame) -> tuple:
        r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
        return (r["n"], r["h"])

    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = prints(now)
    if seen[0] <= one_task:
        return cut(now.coalesce(1).mapInArrow(_solve, "node long, root long"))
    for _ in range(max_rounds):
        both = now.select("a", "b").unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        now = cut(small.select("e.a", "e.b").where("a <> b").distinct())
        if (after := prints(now)) == seen:
            break
        seen = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
