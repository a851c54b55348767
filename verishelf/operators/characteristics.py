"""Closed-vocabulary characteristics: gate, validation, evaluation."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verishelf.functions.text import collapse
from verishelf.functions.vocab import CHARACTERISTICS


def tidy(value: Column) -> Column:
    """Upper case, parts joined by " & ", empty parts dropped; null if nothing is left."""
    parts = F.filter(F.transform(F.split(F.upper(collapse(value)), r"\s*&\s*"), F.trim), lambda p: p != "")
    return F.when(F.size(parts) > 0, F.array_join(parts, " & "))


def accepted(value: Column, kind: Column, allowed: Column) -> Column:
    """The tidied value if the rule takes it: any for an open rule; each part allowed for a closed one."""
    good = tidy(value)
    return F.when((kind == "Open-ended") | F.forall(F.split(good, " & "), lambda p: F.array_contains(allowed, p)), good)


def validate(values: DataFrame, rules: DataFrame) -> DataFrame:
    """values (row_uid, module, characteristic, value) by the rules: coded, rejected, applicable.

    rules: module, characteristic, open_close, allowed_values. A characteristic without a rule for
    the module doesn't apply and is neither coded nor rejected.
    """
    df = values.join(rules.select("module", "characteristic", "open_close", "allowed_values", F.lit(True).alias("applicable")), ["module", "characteristic"], "left")
    good = accepted(F.col("value"), F.col("open_close"), F.col("allowed_values"))
    on = F.coalesce("applicable", F.lit(False))
    return df.select("row_uid", "module", "characteristic", on.alias("applicable"), F.when(on, good).alias("coded"), F.when(on & good.isNull(), tidy(F.col("value"))).alias("rejected"))


def gate(modules: DataFrame, rules: DataFrame) -> DataFrame:
    """row_uid, module, applicable (in column order), and an all-null value map."""
    order = F.array(*[F.lit(c) for c in CHARACTERISTICS])
    per = rules.groupBy("module").agg(F.collect_set("characteristic").alias("_c")).withColumn("_a", F.filter(order, lambda c: F.array_contains("_c", c))).select("module", "_a")
    empty = F.map_from_arrays(order, F.array_repeat(F.lit(None).cast("string"), len(CHARACTERISTICS)))
    return modules.join(per, "module", "left").select("row_uid", "module", F.coalesce("_a", F.array().cast("array<string>")).alias("applicable"), empty.alias("values"))


def from_entity(stored: Column, applicable: Column) -> Column:
    """An entity's values that apply to the module."""
    return F.map_filter(stored, lambda k, v: F.array_contains(applicable, k) & v.isNotNull())


def applicability(truth: DataFrame, pred: DataFrame, rules: DataFrame) -> DataFrame:
    """row_uid, tp, fp, fn, exact: characteristics of the predicted module against the true one's.

    Rules are joined to distinct module pairs, and the counts to rows.
    """
    pairs = truth.join(pred, "row_uid")
    sets = rules.groupBy("module").agg(F.array_sort(F.collect_set("characteristic")).alias("s"))
    both = (
        pairs.select("truth", "pred").distinct()
        .join(sets.select(F.col("module").alias("truth"), F.col("s").alias("t")), "truth", "left")
        .join(sets.select(F.col("module").alias("pred"), F.col("s").alias("p")), "pred", "left")
    )
    none = F.array().cast("array<string>")
    t, p = F.coalesce("t", none), F.coalesce("p", none)
    size = lambda c: F.size(c).cast("long")
    counts = both.select("truth", "pred", size(F.array_intersect(t, p)).alias("tp"), size(F.array_except(p, t)).alias("fp"), size(F.array_except(t, p)).alias("fn"))
    return pairs.join(counts, ["truth", "pred"]).withColumn("exact", (F.col("fp") == 0) & (F.col("fn") == 0))


def precision_recall(counts: DataFrame) -> DataFrame:
    s = counts.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.count_if("exact").alias("exact_rows"))
    rate = lambda a, b: F.coalesce(F.try_divide(F.col("tp").cast("double"), (F.col(a) + F.col(b)).cast("double")), F.lit(0.0))
    return s.withColumns({"precision": rate("tp", "fp"), "recall": rate("tp", "fn")})


def accuracy(rows: DataFrame) -> DataFrame:
    """Per characteristic: applicable, predicted, exact, set-equal. rows: characteristic, truth, pred;
    a missing prediction is wrong."""
    parts = lambda c: F.array_sort(F.array_distinct(F.split(F.col(c), " & ")))
    return rows.groupBy("characteristic").agg(
        F.count("*").alias("applicable"),
        F.count("pred").alias("predicted"),
        F.count_if(F.col("truth").eqNullSafe(F.col("pred"))).alias("exact"),
        F.count_if(parts("truth").eqNullSafe(parts("pred"))).alias("set_equal"),
    )


def excerpt(body: Column, anchors: list[str], *, prefix: int = 800, around: int = 220, limit: int = 3000) -> Column:
    """The start of a text and the surroundings of each anchor, joined by an ellipsis, cut to the limit.

    Overlapping pieces are one. Works on positions alone, in one expression.
    """
    low = F.lower(body)
    def around_of(anchor: str) -> Column:
        n, last = len(anchor), lambda acc: F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(1 - len(anchor)))
        parts = F.split(low, "\\Q" + anchor.lower() + "\\E", -1)
        starts = F.aggregate(parts, F.array().cast("array<int>"), lambda acc, p: F.concat(acc, F.array(last(acc) + n + F.length(p))))
        hits = F.slice(starts, 1, F.greatest(F.size(starts) - 1, F.lit(0)))
        return F.transform(hits, lambda h: F.struct(F.greatest(h - around, F.lit(1)).alias("a"), (h + n + around - 1).alias("b")))

    spans = F.concat(F.array(F.struct(F.lit(1).alias("a"), F.lit(prefix).alias("b"))), *map(around_of, anchors))
    kind = "array<struct<a:int,b:int>>"
    merged = F.aggregate(
        F.array_sort(spans),
        F.array().cast(kind),
        lambda acc, s: F.when((F.size(acc) > 0) & (s["a"] <= F.try_element_at(acc, F.lit(-1))["b"] + 1), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(acc, F.lit(-1))["a"].alias("a"), F.greatest(F.try_element_at(acc, F.lit(-1))["b"], s["b"]).alias("b")))))
        .otherwise(F.concat(acc, F.array(s)))
        .cast(kind),
    )
    pieces = F.filter(F.transform(merged, lambda s: F.trim(F.substring(body, s["a"], s["b"] - s["a"] + 1))), lambda p: p != "")
    return F.left(F.array_join(pieces, " … "), F.lit(limit))


def neutralise(c: Column) -> Column:
    """Untrusted text can't open or close the fence that it is put in."""
    return F.regexp_replace(c, "(?i)<(?=/?untrusted_evidence)", "‹")


def fenced(c: Column) -> Column:
    return F.concat(F.lit("<untrusted_evidence>\n"), neutralise(F.coalesce(c, F.lit(""))), F.lit("\n</untrusted_evidence>"))


def strip_fences(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(c), r"(?s)^```[a-zA-Z]*\n?|\n?```$", ""))


def render(template: str, **fields: Column) -> Column:
    """A template with {name} places filled in one pass; unknown and missing names raise."""
    pieces = re.split(r"\{(\w+)\}", template)
    if set(pieces[1::2]) != set(fields):
        raise ValueError("the template's places and the fields differ")
    return F.concat(*[F.lit(p) if i % 2 == 0 else fields[p] for i, p in enumerate(pieces)])


def complete_json(prompts: DataFrame, model: Callable[[str], str], fields: dict[str, type | tuple[type, ...]], key: str = "key", *, retry: str | None = "Your answer was refused: {error}. Answer again.", max_calls: int | None = None) -> DataFrame:
    """key, answer, error, calls: answers of an injected model that are JSON objects with these fields and no others.

    An answer that isn't is asked for once more, with the error at the end of the prompt; a second
    bad answer gives a null answer and the error, never free text. Fences around an answer go. Each distinct
    key is asked once; more of them than max_calls / 2 might need more than max_calls calls, and raise before the first.
    """
    asked = prompts.select(key, "prompt").dropDuplicates([key])
    if max_calls is not None and (n := asked.count()) * (2 if retry else 1) > max_calls:
        raise ValueError(f"{n} questions may take more than {max_calls} calls")

    def read(text: str) -> str:
        bare = re.sub(r"(?s)^```[a-zA-Z]*\n?|\n?```$", "", text.strip()).strip()
        value = json.loads(bare)
        if not isinstance(value, dict):
            raise ValueError("not an object")
        if missing := sorted(set(fields) ^ set(value)):
            raise ValueError(f"missing or unknown: {', '.join(missing)}")
        for name, kind in fields.items():
            if not isinstance(value[name], kind) or (isinstance(value[name], bool) and bool not in (kind if isinstance(kind, tuple) else (kind,))):
                raise ValueError(f"{name} has another type")
        return json.dumps(value, sort_keys=True, ensure_ascii=False)

    def one(prompt: str) -> tuple[str | None, str | None, int]:
        try:
            return read(model(prompt)), None, 1
        except ValueError as first:
            if retry is None:
                return None, str(first), 1
            try:
                return read(model(f"{prompt}\n\n{retry.format(error=first)}")), None, 2
            except ValueError as second:
                return None, str(second), 2

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [one(p) for p in f["prompt"]]
            yield pd.DataFrame({key: f[key], "answer": [g[0] for g in got], "error": [g[1] for g in got], "calls": [g[2] for g in got]})

    return asked.mapInPandas(run, f"{key} string, answer string, error string, calls int")


def complete(prompts: DataFrame, model: Callable[[str], str], key: str = "key", cache: DataFrame | None = None, max_calls: int | None = None) -> DataFrame:
    """key, answer: an injected model's answers, from the cache where it has them.

    prompts: key, prompt. Only distinct misses are asked; more of them than max_calls raise
    before the first call.
    """
    asked = prompts.select(key, "prompt").dropDuplicates([key])
    misses = asked if cache is None else asked.join(cache, key, "left_anti")
    if max_calls is not None and (n := misses.count()) > max_calls:
        raise ValueError(f"{n} calls are more than {max_calls}")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({key: f[key], "answer": [model(p) for p in f["prompt"]]})

    fresh = misses.mapInPandas(run, f"{key} string, answer string")
    return fresh if cache is None else fresh.unionByName(cache.join(asked.select(key), key, "left_semi").select(key, "answer"))
