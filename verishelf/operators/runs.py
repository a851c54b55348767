"""Assembly of the output, run summaries, failures, cards and the explorer page."""

from __future__ import annotations

import html
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verishelf.functions import urls as U
from verishelf.functions.vocab import CHARACTERISTICS, OUTPUT_COLUMNS
from verishelf.operators.characteristics import accepted


def violations(results: DataFrame, rules: DataFrame) -> DataFrame:
    """row_uid, problem: results that the output must not hold.

    results: row_uid, module, values (map). A module must have rules, a value must belong to a
    characteristic that applies and be taken by its rule.
    """
    known = rules.select("module").distinct().withColumn("_known", F.lit(True))
    bad_module = results.where("module is not null").join(known, "module", "left_anti").select("row_uid", F.lit("unknown module").alias("problem"))
    long = results.select("row_uid", "module", F.explode("values").alias("characteristic", "value")).where("value is not null")
    on = long.join(rules, ["module", "characteristic"], "left")
    off = on.where("open_close is null").select("row_uid", F.lit("value does not apply").alias("problem"))
    wrong = on.where(F.col("open_close").isNotNull() & ~accepted(F.col("value"), F.col("open_close"), F.col("allowed_values")).eqNullSafe(F.col("value"))).select("row_uid", F.lit("value not allowed").alias("problem"))
    return bad_module.unionAll(off).unionAll(wrong)


def assemble(sheet: DataFrame, results: DataFrame, done: DataFrame) -> DataFrame:
    """The output rows in sheet order: inputs as they were read, outputs only of complete rows.

    sheet: row_uid, row_index and the seven input columns; results: row_uid, url, reasoning,
    module, values; done: row_uid.
    """
    df = sheet.join(results.join(done, "row_uid", "left_semi"), "row_uid", "left")
    out = {"PRODUCT_URL": F.col("url"), "REASONING": F.col("reasoning"), "MODULE": F.col("module")} | {c: F.try_element_at("values", F.lit(c)) for c in CHARACTERISTICS}
    return df.withColumns(out).select("row_index", *OUTPUT_COLUMNS)


def fill_report(output: DataFrame) -> DataFrame:
    """Rows, blank rows, and non-null cells per output column, in one pass."""
    own = OUTPUT_COLUMNS[7:]
    blank = F.lit(True)
    for c in own:
        blank = blank & F.col(c).isNull()
    return output.agg(F.count("*").alias("rows"), F.count_if(blank).alias("blank_rows"), *[F.count(c).alias(c) for c in own])


def last_failures(failures: DataFrame, done: DataFrame) -> DataFrame:
    """The last failure of each row that is still incomplete. failures: row_uid, seq, stage, error_type."""
    last = failures.groupBy("row_uid").agg(F.max_by(F.struct("stage", "error_type"), "seq").alias("f"))
    return last.join(done, "row_uid", "left_anti").select("row_uid", "f.stage", "f.error_type")


def run_summary(rows: DataFrame) -> DataFrame:
    """One row of counters. rows: tier, url, adjudicated, reason, module, failed_stage."""
    return rows.agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("failed_stage").isNotNull()).alias("failed"),
        F.count_if(F.col("tier") == "tier0_exact").alias("tier0"),
        F.count_if(F.col("tier") == "tier1_ann").alias("tier1"),
        F.count_if(F.col("url").isNotNull()).alias("selected"),
        F.count_if(F.col("reason") == "gtin_exact").alias("gtin_confirmed"),
        F.count_if("adjudicated").alias("adjudicated"),
        F.count("module").alias("with_module"),
    )


def counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def outcomes_by_host(fetches: DataFrame, statuses: tuple[str, ...]) -> DataFrame:
    """Per host, the number of fetches of each status. The statuses are given, so one pass is enough."""
    host = F.regexp_replace(U.host(F.col("url")), r"^www\.", "")
    return fetches.groupBy(host.alias("host")).agg(*[F.count_if(F.col("status") == s).alias(s) for s in statuses])


def call_counters(calls: DataFrame) -> DataFrame:
    """calls: model, prompt_tokens, completion_tokens, from_cache."""
    live = ~F.col("from_cache")
    return calls.groupBy("model").agg(
        F.count_if(live).alias("calls"), F.count_if("from_cache").alias("hits"), F.sum(F.when(live, F.col("prompt_tokens")).otherwise(0)).alias("prompt_tokens"), F.sum(F.when(live, F.col("completion_tokens")).otherwise(0)).alias("completion_tokens")
    )


def cards(stages: dict[str, DataFrame]) -> DataFrame:
    """row_uid, card: each row's artifacts as one JSON object, a field for each stage that it has."""
    out = None
    for name, df in stages.items():
        own = df.select("row_uid", F.struct(*[c for c in df.columns if c != "row_uid"]).alias(name))
        out = own if out is None else out.join(own, "row_uid", "full_outer")
    return out.select("row_uid", F.to_json(F.struct(*stages)).alias("card"))


def card_text(fields: dict[str, Column]) -> Column:
    """Fields as lines of text; those without a value are left out."""
    return F.concat_ws("\n", *[F.when(c.isNotNull() & (c.cast("string") != ""), F.concat(F.lit(f"{name}: "), c.cast("string"))) for name, c in fields.items()])


def card_html(fields: dict[str, Column], links: tuple[str, ...] = ()) -> Column:
    """Fields as a definition list; values are escaped, those of `links` are links if they are web addresses."""

    def one(name: str, c: Column) -> Column:
        value = c.cast("string")
        for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            value = F.replace(value, F.lit(old), F.lit(new))
        if name in links:
            value = F.when(value.rlike("^https?://"), F.concat(F.lit('<a rel="noopener" href="'), value, F.lit('">'), value, F.lit("</a>"))).otherwise(value)
        return F.when(value != "", F.concat(F.lit(f"<dt>{html.escape(name)}</dt><dd>"), value, F.lit("</dd>")))

    return F.concat(F.lit("<dl>"), F.concat_ws("", *[one(n, c) for n, c in fields.items()]), F.lit("</dl>"))


def filter_rows(rows: DataFrame, text: str = "", search_in: tuple[str, ...] = (), **facets: str | None) -> DataFrame:
    """rows that hold all words of a text, in any case, in one of the columns, and have the facets' values."""
    place = F.lower(F.concat_ws("\n", *[F.col(c).cast("string") for c in search_in]))
    for word in text.lower().split():
        rows = rows.where(F.contains(place, F.lit(word)))
    for column, value in facets.items():
        rows = rows if value is None else rows.where(F.col(column) == value)
    return rows


def explorer_page(card_table: DataFrame, title: str, most: int = 5_000) -> str:
    """A page of cards, with a search box, that needs no other file. More than `most` raise: a page is for a person."""
    rows = [json.loads(r["card"]) | {"row_uid": r["row_uid"]} for r in card_table.orderBy("row_uid").limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"more than {most} cards")
    data = json.dumps(rows, ensure_ascii=False).replace("</", "<\\/")
    title = html.escape(title)
    return (
        f"<!doctype html><meta charset=utf-8><title>{title}</title><h1>{title}</h1><input id=q placeholder=search><pre id=out></pre>"
        f"<script>const rows={data};const show=()=>{{const q=document.getElementById('q').value.toLowerCase();"
        "document.getElementById('out').textContent=rows.map(r=>JSON.stringify(r,null,1)).filter(t=>t.toLowerCase().includes(q)).join('\\n\\n')};"
        "document.getElementById('q').oninput=show;show()</script>"
    )


def values_missing(values: DataFrame) -> DataFrame:
    """row_uid of complete rows whose characteristics no model has looked at yet.

    values: row_uid, source, values (map).
    """
    return values.where((F.col("source") != "llm") & F.forall(F.map_values("values"), lambda v: v.isNull())).select("row_uid")


def traces(stages: dict[str, DataFrame], run_id: str) -> DataFrame:
    """One JSON object a row for an append-only trace, with the run it belongs to."""
    return cards(stages).select("row_uid", F.to_json(F.struct(F.lit(run_id).alias("run_id"), "row_uid", F.col("card"))).alias("trace"))


def hit_selections(hits: DataFrame, entities: DataFrame) -> DataFrame:
    """Selections that registry hits carry from their entity: url, title, module, values, confidence."""
    own = entities.select("entity_id", F.col("resolved_url").alias("url"), F.col("module"), F.col("characteristics").alias("values"), "confidence")
    return hits.where("hit").join(own, "entity_id").select("row_uid", "entity_id", "tier", "url", "module", "values", "confidence", F.lit("registry").alias("module_source"))


def explorer_summary(rows: DataFrame, top: int = 8) -> tuple[DataFrame, DataFrame]:
    """Counters over all rows, and the most frequent modules.

    rows: tier, url, reason, adjudicated, values_source, applicable, values, image_sha256, module.
    """
    coded = F.size(F.map_filter("values", lambda k, v: v.isNotNull()))
    totals = rows.agg(
        F.count("*").alias("rows"),
        F.count("url").alias("selected"),
        F.count_if(F.col("reason") == "gtin_exact").alias("gtin_confirmed"),
        F.count_if("adjudicated").alias("adjudicated"),
        F.count_if(F.col("values_source") == "llm").alias("extracted"),
        F.sum(F.size("applicable")).alias("applicable_cells"),
        F.sum(coded).alias("coded_cells"),
        F.count("image_sha256").alias("with_image"),
    )
    modules = rows.where("module is not null").groupBy("module").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "module").limit(top)
    return totals, modules
