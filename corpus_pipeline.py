"""The corpus pipeline: toxicity, near copies, benchmark passages, secrets, and the mix of sources.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a
DataFrame; all but the last keep the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verishelf.llm._common import cut, ensure_checkpoint_dir, read
from verishelf.llm.decontam import find_contamination
from verishelf.llm.mixing import mix_sources
from verishelf.llm.secrets import redact_secrets
from verishelf.llm.simhash import drop_near_copies
from verishelf.llm.toxicity import score_toxicity, train_toxicity

def _aside(docs: DataFrame, *results: str) -> dict[str, str]:
    """New names for the columns of docs that are called like a stage's results."""
    return {c: f"_own_{c}" for c in docs.columns if c.lower() in results}


#: Documents with this score or more are rejected.
TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under TOXIC; the model learns from all labelled rows."""
    model = train_toxicity(docs, read(spark, sf_dir, "labels"), lambda c: F.lit(True))
    own = _aside(docs, "toxicity")
    scored = score_toxicity(docs.withColumnsRenamed(own), model).where(F.col("toxicity") < TOXIC).drop("toxicity")
    return scored.withColumnsRenamed({new: old for old, new in own.items()})


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: SimHash families, then exact Jaccard similarity 0.8 of five-word shingles."""
    return drop_near_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window. Contaminated ones go whole."""
    own = _aside(docs, "n_words", "spans", "items")
    set_aside = docs.withColumnsRenamed(own)
    found = find_contamination(set_aside, read(spark, sf_dir, "benchmark"), keep=set_aside.columns)
    return found.where(F.size("spans") == 0).drop("n_words", "spans", "items").withColumnsRenamed({new: old for old, new in own.items()})


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by marks."""
    return redact_secrets(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes words of, with size, source_size, target and taken.

    Columns called like the results make way for them. Rows that agree in doc_id and text are
    numbered, so that each has the words taken of one of them.
    """
    docs = docs.drop("size", "source_size", "target", "taken")
    taken = cut(mix_sources(docs.select("doc_id", "text", "source"), carry=True))
    key = taken.select(F.col("doc_id").alias("_mix_id"), F.col("text_hash").alias("_mix_hash"), "size", "source_size", "target", "taken")
    on = F.col("doc_id").eqNullSafe(F.col("_mix_id")) & F.xxhash64("text").eqNullSafe(F.col("_mix_hash"))
    rows = docs
    if not key.groupBy("_mix_id", "_mix_hash").count().where("count > 1").isEmpty():
        key = key.withColumn("_mix_k", F.row_number().over(Window.partitionBy("_mix_id", "_mix_hash").orderBy(F.desc("taken"))))
        rows = docs.withColumn("_mix_j", F.row_number().over(Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.xxhash64(*docs.columns))))
        on = on & (F.col("_mix_j") == F.col("_mix_k"))
    return rows.join(key.where("taken > 0"), on).select(*docs.columns, "size", "source_size", "target", "taken")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_copies),
    ("decontamination", drop_contaminated),
    ("secret_scan", hide_secrets),
    ("source_mix", mix),
]

#: Models, fingerprints and queue order can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
