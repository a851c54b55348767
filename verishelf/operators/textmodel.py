"""Character n-gram TF-IDF: document frequencies, vectors, centroids, neighbours.

Vectors are rows (doc, term, weight). Texts that occur often should be folded before (`texts`),
since vectors and similarities are functions of the text alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verishelf.functions.text import char_ngrams
from verishelf.sources.tables import global_rank


def terms(docs: DataFrame, doc: str, text: str, sizes: tuple[int, ...] = (4,)) -> DataFrame:
    """doc, term, n: counted n-grams of each document; the count is combined before the shuffle."""
    return docs.select(doc, F.explode(char_ngrams(F.col(text), sizes)).alias("term")).groupBy(doc, "term").agg(F.count("*").alias("n"))


def document_frequencies(counted: DataFrame) -> DataFrame:
    return counted.groupBy("term").agg(F.count("*").alias("df"))


def copies(docs: DataFrame, text: str, *by: str) -> DataFrame:
    """text, *by, copies: how many documents have a text. Vectors are functions of the text alone, so what
    is fitted on documents is a sum over their texts, each as often as it occurs."""
    return docs.groupBy(text, *by).agg(F.count("*").alias("copies"))


def weighted_frequencies(counted: DataFrame, folded: DataFrame, doc: str) -> DataFrame:
    """document_frequencies of documents that were folded: counted has a row for each text and term."""
    return counted.join(folded.groupBy(doc).agg(F.sum("copies").alias("copies")), doc).groupBy("term").agg(F.sum("copies").alias("df"))


def idf(df: DataFrame, n_docs: int) -> DataFrame:
    """ln((n + 1) / (df + 1)) + 1 for each term."""
    if n_docs <= 0:
        raise ValueError("no documents")
    return df.select("term", "df", (F.log((F.lit(float(n_docs)) + 1) / (F.col("df").cast("double") + 1)) + 1).alias("idf"))


def vectors(counted: DataFrame, weights: DataFrame, doc: str) -> DataFrame:
    """doc, term, weight of unit length: (1 + ln n) * idf; terms without an idf are dropped."""
    raw = counted.join(weights.select("term", "idf"), "term").select(doc, "term", ((1 + F.log(F.col("n").cast("double"))) * F.col("idf")).alias("weight"))
    return unit(raw, doc)


def unit(raw: DataFrame, key: str) -> DataFrame:
    norm = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy(key)))
    return raw.withColumn("weight", F.when(norm > 0, F.col("weight") / norm).otherwise(F.col("weight")))


def centroids(vecs: DataFrame, labels: DataFrame, doc: str, label: str) -> DataFrame:
    """label, term, weight: unit sums of the labelled vectors, each times its copies if labels has them."""
    n = F.col("copies") if "copies" in labels.columns else F.lit(1)
    sums = vecs.join(labels.select(doc, label, n.alias("_n")), doc).groupBy(label, "term").agg(F.sum(F.col("weight") * F.col("_n")).alias("weight"))
    return unit(sums, label)


def class_scores(vecs: DataFrame, docs: DataFrame, cents: DataFrame, doc: str, label: str) -> DataFrame:
    """doc, label, score for every document and label, 0 without common terms. Labels are few; the
    product with them is made of ids only."""
    dots = vecs.join(cents.withColumnRenamed("weight", "w2"), "term").groupBy(doc, label).agg(F.sum(F.col("weight") * F.col("w2")).alias("score"))
    every = docs.select(doc).withColumn(label, F.explode(F.array_sort(_distinct(cents, label))))
    return every.join(dots, [doc, label], "left").select(doc, label, F.coalesce("score", F.lit(0.0)).alias("score"))


def best_labels(vecs: DataFrame, docs: DataFrame, cents: DataFrame, doc: str, label: str) -> DataFrame:
    """predict(class_scores(..)) without the rows of labels that a document shares no term with.

    A document with fewer than two such labels gets the first of the others by name, with the score 0.
    """
    dots = vecs.join(cents.withColumnRenamed("weight", "w2"), "term").groupBy(doc, label).agg(F.sum(F.col("weight") * F.col("w2")).alias("score"))
    one = F.struct((-F.round("score", 9)).alias("s"), F.col(label).alias("l"), F.col("score").alias("v"))
    top = dots.groupBy(doc).agg(F.slice(F.array_sort(F.collect_list(one)), 1, 2).alias("_top"))
    first = [r[0] for r in cents.select(label).distinct().orderBy(label).limit(3).collect()]
    rest = F.filter(F.array(*map(F.lit, first)), lambda x: ~F.array_contains(F.transform("_top", lambda t: t["l"]), x))
    filled = F.concat("_top", F.transform(rest, lambda x: F.struct(F.lit(0.0).alias("s"), x.alias("l"), F.lit(0.0).alias("v"))))
    none = F.expr(f"cast(array() as {dict(top.dtypes)['_top']})")
    df = docs.select(doc).join(top, doc, "left").withColumn("_top", F.coalesce("_top", none)).withColumn("_top", filled)
    a, b = F.try_element_at("_top", F.lit(1)), F.try_element_at("_top", F.lit(2))
    return df.select(doc, a["l"].alias(label), a["v"].alias("score"), b["l"].alias("runner_up"), (a["v"] - F.coalesce(b["v"], F.lit(0.0))).alias("gap"))


def _distinct(cents: DataFrame, label: str, most: int = 10_000):
    names = [r[0] for r in cents.select(label).distinct().limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"more than {most} labels")
    return F.array(*[F.lit(x) for x in names])


def predict(scores: DataFrame, doc: str, label: str) -> DataFrame:
    """doc, label, score, runner_up, gap: the best label, ties by name, and its lead."""
    key = lambda: F.struct((-F.round("score", 9)).alias("s"), F.col(label).alias("l"))
    best = scores.groupBy(doc).agg(F.min_by(F.struct(label, "score"), key()).alias("b"), F.slice(F.array_sort(F.collect_list(F.struct((-F.round("score", 9)).alias("s"), F.col(label).alias("l"), F.col("score")))), 2, 1).alias("r"))
    second = F.try_element_at("r", F.lit(1))
    return best.select(doc, F.col(f"b.{label}").alias(label), F.col("b.score").alias("score"), second["l"].alias("runner_up"), (F.col("b.score") - F.coalesce(second["score"], F.lit(0.0))).alias("gap"))


def nearest(queries: DataFrame, train: DataFrame, doc: str) -> DataFrame:
    """doc, nearest, similarity: the most similar other training document, ties by the larger id."""
    dots = queries.join(train.select(F.col(doc).alias("other"), "term", F.col("weight").alias("w2")), "term").where(F.col(doc) != F.col("other")).groupBy(doc, "other").agg(F.sum(F.col("weight") * F.col("w2")).alias("similarity"))
    return dots.groupBy(doc).agg(F.max_by(F.struct("other", "similarity"), F.struct(F.round("similarity", 9), F.col("other"))).alias("b")).select(doc, F.col("b.other").alias("nearest"), F.col("b.similarity").alias("similarity"))


def pair_cosines(pairs: DataFrame, left: str, right: str, weights: DataFrame, sizes: tuple[int, ...] = (4,)) -> DataFrame:
    """left, right, cosine of pairs of texts; 0 where nothing is common."""
    every = pairs.select(F.col(left).alias("text")).unionAll(pairs.select(F.col(right).alias("text"))).distinct()
    vecs = vectors(terms(every, "text", "text", sizes), weights, "text")
    a = vecs.select(F.col("text").alias(left), "term", F.col("weight").alias("w1"))
    b = vecs.select(F.col("text").alias(right), "term", F.col("weight").alias("w2"))
    dots = pairs.join(a, left).join(b, [right, "term"]).groupBy(left, right).agg(F.sum(F.col("w1") * F.col("w2")).alias("cosine"))
    return pairs.join(dots, [left, right], "left").withColumn("cosine", F.coalesce("cosine", F.lit(0.0)))


# ---- folds and reports ----------------------------------------------------------------------


def stratified_folds(rows: DataFrame, label: str, order: str, k: int) -> DataFrame:
    """rows with fold: within a label, in order, 0, 1, .., k-1, 0, .."""
    return rows.withColumn("fold", ((F.row_number().over(Window.partitionBy(label).orderBy(order)) - 1) % k).cast("int"))


def accuracy(pairs: DataFrame) -> DataFrame:
    """truth, n, correct, rate per true label."""
    return pairs.groupBy("truth").agg(F.count("*").alias("n"), F.count_if(F.col("truth") == F.col("pred")).alias("correct")).withColumn("rate", F.col("correct") / F.col("n"))


def overall(pairs: DataFrame) -> DataFrame:
    return accuracy(pairs).agg(F.sum("n").alias("n"), F.sum("correct").alias("correct"), (F.sum("correct") / F.sum("n")).alias("overall"), F.avg("rate").alias("macro"))


def confusions(pairs: DataFrame) -> DataFrame:
    return pairs.where("truth <> pred").groupBy("truth", "pred").agg(F.count("*").alias("n"))


def equal_buckets(rows: DataFrame, by: list, buckets: int) -> DataFrame:
    """rows with bucket: bucket b holds the ranks from b * n div buckets on.

    Ranks come from range partitions: rows are sorted within them and the partitions' counts
    added up, so no task sorts the whole table.
    """
    ranked, n = global_rank(rows, by, "rank")
    return ranked.withColumn("bucket", F.expr(f"cast((rank * {buckets} - 1) div {max(1, n)} as int)")).drop("rank")


def stratified_sample(rows: DataFrame, label: str, order: str, target: int, floor: int) -> DataFrame:
    """target rows: first `floor` of each label, then in turns, larger labels first. Labels are few: their sizes are broadcast, over 100,000 raise.

    rows of a label are in `order`; labels in the order of falling size, then name.
    """
    n = F.count("*").over(Window.partitionBy(label))
    r = F.row_number().over(Window.partitionBy(label).orderBy(order)) - 1
    sizes = rows.groupBy(label).agg(F.count("*").alias("_size"))
    if sizes.limit(100_001).count() > 100_000:
        raise ValueError("more than 100000 labels")
    place = sizes.withColumn("_place", F.row_number().over(Window.orderBy(F.desc("_size"), label))).select(label, "_place")  # one row a label
    ranked = rows.withColumns({"_n": n, "_r": r}).join(F.broadcast(place), label)
    early = F.col("_r") < floor
    by = [F.when(early, 0).otherwise(1), F.when(early, F.col("_place")).otherwise(F.col("_r")), F.when(early, F.col("_r")).otherwise(F.col("_place"))]
    return ranked.orderBy(*by).limit(target).drop("_n", "_r", "_place")
