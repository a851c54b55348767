"""Calibration: isotonic fit, step prediction, reliability, abstention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verishelf.sources.tables import cut, global_rank


def harvest(scored: DataFrame) -> DataFrame:
    """row_uid, url, score, correct for pairs whose barcodes can be compared."""
    return scored.where("barcode_exact is not null").select("row_uid", "url", F.col("weighted").alias("score"), F.col("barcode_exact").alias("correct"))


def pool(pairs: DataFrame) -> DataFrame:
    """Distinct scores with their number of pairs and of correct ones."""
    return pairs.groupBy("score").agg(F.count("*").alias("n"), F.sum(F.col("correct").cast("double")).alias("y"))


def fit_isotonic(pairs: DataFrame, *, least: int = 1, max_scores: int = 100_000) -> DataFrame:
    """threshold, value: a rising step function fitted by least squares.

    Scores are pooled in Spark; the driver merges the distinct ones (at most max_scores, or it
    raises: round the scores then) from left to right. Fewer pairs than `least`, or one class
    only, raise too.
    """
    pooled = pool(pairs).orderBy("score").limit(max_scores + 1).collect()
    if len(pooled) > max_scores:
        raise ValueError(f"more than {max_scores} distinct scores")
    n, y = sum(r["n"] for r in pooled), sum(r["y"] for r in pooled)
    if n < least or y in (0, n):
        raise ValueError("too few pairs, or one class only")
    steps: list[list[float]] = []
    for r in pooled:
        steps.append([r["score"], r["y"], r["n"]])
        while len(steps) > 1 and steps[-2][1] / steps[-2][2] > steps[-1][1] / steps[-1][2]:
            last = steps.pop()
            steps[-1] = [steps[-1][0], steps[-1][1] + last[1], steps[-1][2] + last[2]]
    return pairs.sparkSession.createDataFrame([(s, y / n) for s, y, n in steps], "threshold double, value double")


def predict(score: Column, curve: list[tuple[float, float]]) -> Column:
    """The value of the last threshold at or under the score; the first value under all of them.

    The thresholds are one literal array, in which a score's place is found by halving: as many
    comparisons as the logarithm of the curve's length.
    """
    at = F.array(*[F.lit(float(t)) for t, _ in curve])
    values = F.array(*[F.lit(float(v)) for _, v in curve])
    place = F.aggregate(F.array(*[F.lit(1 << k) for k in range(len(curve).bit_length() - 1, -1, -1)]), F.lit(0), lambda n, step: F.when(F.coalesce(F.try_element_at(at, n + step) <= score, F.lit(False)), n + step).otherwise(n))
    return F.when(score.isNotNull(), F.element_at(values, F.greatest(place, F.lit(1))))


def curve_of(fitted: DataFrame, most: int = 100_000) -> list[tuple[float, float]]:
    """The steps of a curve in order. More than `most`, or steps that don't rise, raise."""
    rows = [(r["threshold"], r["value"]) for r in fitted.orderBy("threshold").limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"the curve has more than {most} steps")
    if any(a[0] >= b[0] or a[1] > b[1] for a, b in zip(rows, rows[1:])):
        raise ValueError("the curve must rise")
    return rows


def reliability(scored: DataFrame, bins: int = 10) -> DataFrame:
    """bin, n, mean_predicted, observed: bins of equal width, the last one closed.

    scored: p, correct.
    """
    b = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    return scored.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("mean_predicted"), F.avg(F.col("correct").cast("double")).alias("observed"))


def calibration_error(bins: DataFrame) -> DataFrame:
    return bins.agg((F.sum(F.abs(F.col("mean_predicted") - F.col("observed")) * F.col("n")) / F.sum("n")).alias("ece"))


def abstention(scored: DataFrame, steps: int = 10) -> DataFrame:
    """tau, selected, abstained, precision for tau = 0.0, 0.1, ..: one pass, sums per step."""
    grid = scored.select("p", "correct", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("k")).withColumn("tau", F.col("k") / F.lit(float(steps)))
    on = F.col("p") >= F.col("tau")
    return grid.groupBy("tau").agg(
        F.count_if(on).alias("selected"), F.count_if(~on).alias("abstained"), F.coalesce(F.avg(F.when(on, F.col("correct").cast("double"))), F.lit(0.0)).alias("precision")
    )


def grouped_folds(pairs: DataFrame, group: str, k: int) -> DataFrame:
    """pairs with fold: the dense rank of the group modulo k, so a group is in one fold."""
    groups = pairs.select(group).distinct()
    ranked, _ = global_rank(groups, [group], "_r")
    return pairs.join(ranked, group).withColumn("fold", ((F.col("_r") - 1) % k).cast("int")).drop("_r")


def held_out(pairs: DataFrame, group: str, k: int, *, least: int = 1) -> DataFrame | None:
    """pairs with p: each fold judged by the curve of the others.

    None if there are fewer groups than folds, or a fold's others can't be fitted (fewer than
    `least` pairs, one class only).
    """
    folded = cut(grouped_folds(pairs, group, k))
    sizes = folded.groupBy("fold").agg(F.count("*").alias("n"), F.sum(F.col("correct").cast("double")).alias("y")).collect()
    n, y = sum(r["n"] for r in sizes), sum(r["y"] for r in sizes)
    if len(sizes) < k or any(n - r["n"] < least or y - r["y"] in (0, n - r["n"]) for r in sizes):
        return None
    out = None
    for i in range(k):
        part = folded.where(F.col("fold") == i).withColumn("p", predict(F.col("score"), curve_of(fit_isotonic(folded.where(F.col("fold") != i), least=least))))
        out = part if out is None else out.unionByName(part)
    return out


def held_out_error(pairs: DataFrame, group: str, k: int, *, least: int = 1, bins: int = 10) -> DataFrame:
    """ece: the calibration error of curves on pairs that they haven't seen; null where held_out gives None."""
    judged = held_out(pairs, group, k, least=least)
    if judged is None:
        return pairs.sparkSession.range(1).select(F.lit(None).cast("double").alias("ece"))
    return calibration_error(reliability(judged, bins))


def rising(curve: DataFrame) -> DataFrame:
    """Steps of a stored curve that don't rise."""
    by = Window.orderBy("threshold")
    return curve.withColumn("_v", F.lag("value").over(by)).where("_v > value").drop("_v")
