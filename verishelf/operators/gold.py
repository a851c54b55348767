"""Hand labels, ad-hoc records, prompts, and evaluation by refitting."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verishelf.functions.text import characteristic_name, collapse, format_g, strip
from verishelf.functions.vocab import CHARACTERISTIC_ALIASES, CHARACTERISTICS
from verishelf.operators import textmodel as M
from verishelf.sources.tables import cut

GOLD_URLS = "row_uid string, url string, label string, evidence string"
GOLD_PAIRS = "left string, right string, label string"


def url_label_problems(gold: DataFrame) -> DataFrame:
    """row_uid, problem: labels that contradict their url, blank evidence, rows labelled twice."""
    web = F.coalesce(F.col("url").rlike("(?i)^https?://"), F.lit(False))
    kinds = F.array_compact(
        F.array(
            F.when((F.col("label") == "correct") != web, "label and url disagree"),
            F.when(strip(F.coalesce("evidence", F.lit(""))) == "", "no evidence"),
            F.when(~F.col("label").isin("correct", "ambiguous", "none"), "unknown label"),
        )
    )
    twice = gold.groupBy("row_uid").agg(F.count("*").alias("n")).where("n > 1").select("row_uid", F.lit("labelled twice").alias("problem"))
    return gold.select("row_uid", F.explode(kinds).alias("problem")).unionAll(twice)


def pair_problems(pairs: DataFrame) -> DataFrame:
    """left, right, problem: pairs of a row with itself, and pairs given twice in either order."""
    low, high = F.least("left", "right"), F.greatest("left", "right")
    own = pairs.where("left = right").select("left", "right", F.lit("pair of one row").alias("problem"))
    twice = pairs.where("left <> right").groupBy(low.alias("left"), high.alias("right")).agg(F.count("*").alias("n")).where("n > 1").select("left", "right", F.lit("given twice").alias("problem"))
    return own.unionAll(twice)


def labelled_correct(gold: DataFrame) -> DataFrame:
    return gold.where("label = 'correct'")


def pair_quality(pairs: DataFrame, predicted: DataFrame) -> DataFrame:
    """precision and recall of predicted (left, right) pairs against those labelled same; other
    labels but same and different don't count."""
    norm = lambda df: df.select(F.least("left", "right").alias("l"), F.greatest("left", "right").alias("r"), *[c for c in df.columns if c == "label"])
    both = norm(pairs.where("label in ('same', 'different')")).join(norm(predicted).distinct().withColumn("_p", F.lit(True)), ["l", "r"], "left")
    hit, same = F.col("_p").isNotNull(), F.col("label") == "same"
    c = both.agg(F.count_if(hit & same).alias("tp"), F.count_if(hit & ~same).alias("fp"), F.count_if(~hit & same).alias("fn"))
    rate = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), (F.col(a) + F.col(b)).cast("double")), F.lit(0.0))
    return c.withColumns({"precision": rate("tp", "fp"), "recall": rate("tp", "fn")})


# ---- records given by hand ------------------------------------------------------------------


def input_name(stem: str, prefix: str = "input_") -> str:
    """A sheet name from a file's stem; names that stand for built-in sheets get a prefix."""
    name = re.sub(r"[^a-z0-9]+", "_", stem.lower()).strip("_") or "input"
    return prefix + name if name in ("dev", "qa", "adhoc") else name


def adhoc_uid(*cells: Column) -> Column:
    """adhoc:<number> from a hash of the record, so that the same record gets the same id."""
    text = F.to_json(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(cells)]), {"ignoreNullFields": "false"})
    return F.concat(F.lit("adhoc:"), F.conv(F.left(F.sha2(text, 256), F.lit(8)), 16, 10))


def allowed_values(c: Column) -> Column:
    """A list written as text, with either kind of quotes, as an array; anything else fails."""
    text = strip(c)
    inner = F.regexp_replace(text, r"^\[|\]$", "")
    items = F.transform(F.regexp_extract_all(inner, F.lit(r"'((?:[^'\\]|\\.)*)'|\"((?:[^\"\\]|\\.)*)\""), F.lit(0)), lambda x: F.substring(x, F.lit(2), F.length(x) - 2))
    return F.when(text.rlike(r"^\[.*\]$"), items).otherwise(F.raise_error(F.concat(F.lit("not a list: "), F.coalesce(text, F.lit("null")))))


# ---- prompts --------------------------------------------------------------------------------


def _line(name: str, c: Column) -> Column:
    return F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"{name}: "), c))


def record_block() -> Column:
    """A record as lines of text for a model; fields without a value are left out."""
    return F.concat_ws(
        "\n",
        _line("description", F.col("desc_clean")),
        _line("brand", F.col("brand")),
        _line("barcode", F.col("barcode")),
        _line("size", F.concat(F.col("size_value").cast("string"), F.col("size_unit"))),
        _line("count", F.col("pack_count").cast("string")),
        _line("variant", F.array_join("variant_terms", ", ")),
        _line("countries", F.array_join("countries", ", ")),
    )


def candidate_blocks(ranked: DataFrame, k: int = 4, body_chars: int = 600) -> DataFrame:
    """row_uid, block: the first k usable pages of each record as numbered text."""
    top = ranked.where(~F.col("rejected") & (F.col("position") <= k))
    one = F.concat_ws("\n", F.concat(F.lit("["), F.col("position").cast("string"), F.lit("] "), F.col("url")), _line("title", F.col("title")), _line("gtin", F.col("gtin")), _line("text", F.left(collapse(F.col("body_text")), F.lit(body_chars))))
    return top.groupBy("row_uid").agg(F.array_sort(F.collect_list(F.struct("position", one.alias("t")))).alias("b")).select("row_uid", F.array_join(F.transform("b", lambda x: x["t"]), "\n\n").alias("block"))


def rule_block(rules: DataFrame, guidelines: DataFrame) -> DataFrame:
    """module, block: a module's characteristics with their values and guidance."""
    both = rules.join(guidelines, ["module", "characteristic"], "left")
    line = F.concat(F.col("characteristic"), F.lit(": "), F.when(F.col("open_close") == "Close", F.array_join("allowed_values", " | ")).otherwise("free text"), F.coalesce(F.concat(F.lit(" — "), F.col("guideline")), F.lit("")))
    return both.groupBy("module").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("block"))


# ---- refitting ------------------------------------------------------------------------------


def cross_validate(docs: DataFrame, k: int, doc: str = "doc", text: str = "text", label: str = "label") -> DataFrame:
    """doc, truth, pred: each document by a model of the other folds.

    The fold that is left out is a grouping key: counts are replicated to the k - 1 folds that
    they train, and all k models are fitted in the same pass. Frequencies, vectors and
    centroids are those that a model of these folds alone would have.
    """
    return _refitted(M.stratified_folds(docs, label, doc, k), k, doc, text, label)


def _refitted(folded: DataFrame, k: int, doc: str, text: str, label: str) -> DataFrame:
    """cross_validate over given folds from 0 to k - 1. Copies of a text in a fold are folded to one row with their number."""
    texts = cut(folded.groupBy(F.col(text).alias("_text"), label, "fold").agg(F.count("*").alias("copies")))
    counted = cut(M.terms(texts.select("_text").distinct().withColumn("_x", F.col("_text")), "_text", "_x"))
    every = F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    sizes = texts.groupBy("fold").agg(F.sum("copies").alias("n")).withColumn("out", every).where("out <> fold").groupBy("out").agg(F.sum("n").alias("size"))
    in_fold = counted.join(texts.groupBy("_text", "fold").agg(F.sum("copies").alias("copies")), "_text")
    df = in_fold.groupBy("fold", "term").agg(F.sum("copies").alias("c")).withColumn("out", every).where("out <> fold").groupBy("out", "term").agg(F.sum("c").alias("df"))
    idf = df.join(F.broadcast(sizes), "out").select("out", "term", (F.log((F.col("size") + 1.0) / (F.col("df") + 1.0)) + 1).alias("idf"))
    raw = counted.withColumn("out", every).join(idf, ["out", "term"]).withColumn("weight", (1 + F.log(F.col("n").cast("double"))) * F.col("idf")).withColumn("key", F.struct("out", "_text"))
    vecs = cut(M.unit(raw, "key").select("out", "_text", "term", "weight"))
    train = texts.withColumn("out", every).where("out <> fold").groupBy("out", "_text", label).agg(F.sum("copies").alias("copies"))
    sums = vecs.join(train, ["out", "_text"]).groupBy("out", label, "term").agg(F.sum(F.col("weight") * F.col("copies")).alias("weight"))
    cents = M.unit(sums.withColumn("key", F.struct("out", label)), "key")
    asked = vecs.join(texts.select("_text", F.col("fold").alias("out")).distinct(), ["_text", "out"])
    dots = asked.join(cents.select("out", F.col(label).alias("pred"), "term", F.col("weight").alias("w2")), ["out", "term"]).groupBy("out", "_text", "pred").agg(F.sum(F.col("weight") * F.col("w2")).alias("score"))
    best = dots.groupBy(F.col("out").alias("fold"), "_text").agg(F.min_by("pred", F.struct(-F.round("score", 9), F.col("pred"))).alias("pred"))
    least = folded.agg(F.min(label).alias("_first"))  # one row: what a document without known terms gets
    return folded.withColumn("_text", F.col(text)).join(cut(best), ["fold", "_text"], "left").join(F.broadcast(least)).select(doc, F.col(label).alias("truth"), F.coalesce("pred", "_first").alias("pred"))


def leave_one_out(docs: DataFrame, doc: str = "doc", text: str = "text", label: str = "label", *, most: int = 2000) -> DataFrame:
    """doc, truth, pred: each document by a model of all others.

    As many models as documents, all in the one pass of cross_validate with a fold a document; its work
    and rows are the square of their number, so more than `most` raise. Documents are many: use folds then.
    """
    n = docs.limit(most + 1).count()
    if n > most:
        raise ValueError(f"more than {most} documents: cross_validate takes them in folds")
    ranked = docs.withColumn("fold", F.row_number().over(Window.orderBy(doc)) - 1)  # at most `most` rows
    return _refitted(ranked, n, doc, text, label)


def long_labels(table: DataFrame, columns: list[str], uid: str = "row_uid") -> DataFrame:
    """uid, characteristic, value: label columns in long form; blank cells are null."""
    own = [F.when(strip(F.col(c)) != "", strip(F.col(c))).alias(c) for c in columns]
    return table.select(uid, *own).unpivot(uid, columns, "characteristic", "value")


def name_problems(names: DataFrame, column: str = "characteristic") -> DataFrame:
    """name, problem: characteristics that aren't output columns, and output columns that no row names."""
    own = names.select(F.col(column).alias("name")).distinct()
    known = names.sparkSession.createDataFrame([(c,) for c in CHARACTERISTICS], "name string")
    return own.join(known, "name", "left_anti").withColumn("problem", F.lit("not a column")).unionAll(known.join(own, "name", "left_anti").withColumn("problem", F.lit("not named")))


def orphan_modules(guidelines: DataFrame, rules: DataFrame) -> DataFrame:
    """module: those of the guidelines that the rules don't have."""
    return guidelines.select("module").distinct().join(rules.select("module").distinct(), "module", "left_anti")


def guideline_rows(sheet: DataFrame) -> DataFrame:
    """module, characteristic, guideline of a sheet with the columns MODULE NAME, CHARACTERISTICS NAME, Guidelines."""
    return sheet.select(strip(F.col("MODULE NAME")).alias("module"), characteristic_name(F.col("CHARACTERISTICS NAME"), CHARACTERISTIC_ALIASES).alias("characteristic"), F.col("Guidelines").alias("guideline"))


def as_text(number: Column) -> Column:
    """A number in a model's answer as short text."""
    return format_g(number.cast("double"))


def unseen_scores(vecs: DataFrame, docs: DataFrame, names: DataFrame, idf: DataFrame, doc: str, label: str) -> DataFrame:
    """doc, label, score: similarity to the names of classes, for classes without examples.

    names: label. Reported only; nothing is decided by it.
    """
    named = M.vectors(M.terms(names.select(F.col(label), F.col(label).alias("_text")), label, "_text"), idf, label)
    return M.class_scores(vecs, docs, named, doc, label)
