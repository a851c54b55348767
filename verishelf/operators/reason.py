"""Explanations composed from what is known about a row, with the claims that each sentence makes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verishelf.functions import text as T
from verishelf.functions import urls as U

NONE = "cast(array() as array<string>)"


def two(c: Column) -> Column:
    return F.format_string("%.2f", c)


def _sentence(text: Column, claims: Column, priority: int, when: Column) -> Column:
    return F.when(when & text.isNotNull(), F.struct(F.lit(priority).alias("priority"), text.alias("text"), claims.alias("claims")))


def _cat(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def size_phrase() -> Column:
    return F.when(F.col("size_ml").isNotNull(), _cat(T.format_g(F.col("size_ml")), " ml")).when(F.col("size_g").isNotNull(), _cat(T.format_g(F.col("size_g")), " g"))


def identity_sentences(max_terms: int = 4) -> list[Column]:
    """How the page was chosen: a registry hit, no page, a barcode, or features. One of them holds."""
    hit, again = F.col("hit"), F.col("hit") & (F.col("values_source") == "llm")
    how = F.when(F.col("tier") == "tier0_exact", "exact barcode match").otherwise(_cat("near-duplicate identity match", F.when(F.col("similarity") > 0, _cat(" (similarity ", two(F.col("similarity")), ")")).otherwise("")))
    claim = _cat("registry.", F.col("tier"))
    kept = "carried from that record without re-examination."
    known = _cat("Identity confirmed by ", how, " to a previously resolved item; the page and its characteristics are ", kept)
    read = _cat("Identity confirmed by ", how, " to a previously resolved item; that record had no coded characteristics, so its page was read again to code them.")
    none = F.lit("No candidate page met the evidence threshold; the module and characteristics are derived from the retailer description alone.")

    host, exact = U.bare_host(F.col("url")), F.coalesce("barcode_exact", F.lit(False))
    by_code = _cat("The selected page (", host, ") publishes EAN ", F.col("page_gtin"), ", equal to the record's barcode — a decisive identity match.")
    size_ok = F.col("size_match").isin("exact", "unit_converted")
    count_ok = (F.col("count_match") == "exact") & (F.coalesce("pack_count", F.lit(0)) != 0)
    one = lambda cond, text, claim: F.when(cond, F.struct(text.alias("t"), F.lit(claim).alias("c")))
    basis = F.array_compact(
        F.array(
            one(F.col("brand_match") > 0, _cat("brand match ", two(F.col("brand_match"))), "selection.brand_match"),
            one(size_ok, _cat("size ", F.col("size_match"), F.coalesce(_cat(" (", size_phrase(), ")"), F.lit(""))), "selection.size_match"),
            one(count_ok, _cat("pack count ", F.col("pack_count").cast("string")), "selection.count_match"),
            one(F.col("variant_overlap") > 0, _cat("variant overlap ", two(F.col("variant_overlap")), " (", F.array_join(F.slice("variant_terms", 1, max_terms), ", "), ")"), "selection.variant_overlap"),
            one(F.coalesce("format_consistent", F.lit(False)), F.lit("format consistent"), "selection.format_consistent"),
            one(F.col("retailer_domain_match"), F.lit("the record's own retailer domain"), "selection.retailer_domain_match"),
        )
    )
    said = F.when(F.size(basis) > 0, F.array_join(F.transform(basis, lambda b: b["t"]), ", ")).otherwise(_cat("a score of ", two(F.col("confidence"))))
    ahead, fitted = F.col("gap") > 0, F.col("calibrated") != F.col("confidence")
    marks = F.array_compact(F.concat(F.array(F.when(F.col("size_match") == "mismatch", "a size mismatch"), F.when(F.col("count_match") == "mismatch", "a pack-count mismatch")), F.transform("negative_flags", lambda f: _cat("the '", f, "' flag"))))
    demoted = F.size(marks) > 0
    by_score = _cat(
        "The selected page (", host, ") was ranked first on ", said,
        F.when(ahead, _cat(", ahead of the runner-up by ", two(F.col("gap")))).otherwise(""),
        F.when(fitted, _cat(" (calibrated probability ", two(F.col("calibrated")), ")")).otherwise(""),
        ".",
        F.when(demoted, _cat(" It was demoted for ", F.array_join(marks, ", "), " and still won, so no better candidate was found.")).otherwise(""),
    )
    claims = F.concat(
        F.array(F.lit("selection.url")),
        F.transform(basis, lambda b: b["c"]),
        F.array_compact(F.array(F.when(ahead, "selection.runner_up_gap"), F.when(fitted, "selection.calibrated_prob"), F.when(demoted, "selection.demotions"))),
    )
    some = ~hit & F.col("url").isNotNull()
    return [
        _sentence(read, F.array(claim, F.lit("registry.re_examined")), 100, again),
        _sentence(known, F.array(claim), 100, hit & ~again),
        _sentence(none, F.array(F.lit("selection.abstained")), 100, ~hit & F.col("url").isNull()),
        _sentence(by_code, F.array(F.lit("selection.url"), F.lit("selection.gtin_exact")), 100, some & exact & F.col("page_gtin").isNotNull()),
        _sentence(by_score, claims, 100, some & ~(exact & F.col("page_gtin").isNotNull())),
    ]


def module_sentence(margin: float = 0.05) -> Column:
    stored = F.col("module_source") == "registry"
    like, close = F.col("nearest").isNotNull(), F.col("module_runner_up").isNotNull() & (F.col("module_gap") < margin)
    text = _cat(
        "Classified as ", F.col("module"), " from the description",
        F.when(like, _cat(", which most resembles ", F.col("nearest"), " (similarity ", two(F.col("nearest_similarity")), ")")).otherwise(""),
        F.when(close, _cat(" — a close call against ", F.col("module_runner_up"))).otherwise(""),
        ".",
    )
    claims = F.array_compact(F.array(F.lit("module.module"), F.when(like, "module.nearest_example"), F.when(close, "module.runner_up")))
    text = F.when(stored, _cat("Module ", F.col("module"), " carried from the registry record.")).otherwise(text)
    return _sentence(text, F.when(stored, F.array(F.lit("module.registry"))).otherwise(claims), 90, F.col("module").isNotNull())


def value_sentences() -> list[Column]:
    """Coded values, empty ones, refused ones; characteristics that don't apply are never mentioned."""
    value = lambda n: F.try_element_at("values", n)
    coded = F.filter("applicable", lambda n: value(n).isNotNull())
    empty = F.filter("applicable", lambda n: value(n).isNull() & ~F.array_contains(F.map_keys("rejected"), n))
    refused, source = F.array_sort(F.map_entries("rejected")), F.col("values_source")
    said = lambda items: F.array_join(items, "; ")
    number = F.size("applicable").cast("string")
    return [
        _sentence(_cat("Coded: ", said(F.transform(coded, lambda n: _cat(n, " = ", value(n)))), "."), F.transform(coded, lambda n: _cat("characteristics.", n)), 80, F.size(coded) > 0),
        _sentence(_cat("No evidence for ", F.array_join(empty, ", "), "; left empty."), F.array(F.lit("characteristics.empty")), 60, (F.size(empty) > 0) & (source == "llm")),
        _sentence(
            _cat("The model proposed ", said(F.transform(refused, lambda e: _cat(e["value"], " for ", e["key"]))), ", outside the allowed values, and it was not written."),
            F.array(F.lit("characteristics.rejected")), 70, F.size("rejected") > 0,
        ),
        _sentence(F.lit("A packaging image from the selected page was also examined."), F.array(F.lit("characteristics.image")), 55, F.col("image_sha256").isNotNull()),
        _sentence(_cat(number, " characteristic(s) apply to this module; values were not extracted in this run."), F.array(F.lit("characteristics.gate_only")), 80, (source == "gate_only") & (F.size("applicable") > 0)),
    ]


def evidence_sentence() -> Column:
    """What of the selected page was used. Not for carried pages."""
    body = F.length("page_body")
    parts = F.array_compact(
        F.array(
            F.when(F.col("page_jsonld").isNotNull(), "structured product data (JSON-LD)"),
            F.when(F.coalesce("page_title", F.lit("")) != "", "the page title"),
            F.when(F.coalesce(body, F.lit(0)) > 0, _cat(body.cast("string"), " characters of page text")),
        )
    )
    used = _cat("Page evidence used: ", F.array_join(parts, ", "), ".")
    bare = _cat("The selected page returned no usable text (fetch status: ", F.col("page_status"), ").")
    text, claim = F.when(F.size(parts) > 0, used).otherwise(bare), F.when(F.size(parts) > 0, "evidence.fields").otherwise("evidence.fetch_status")
    return _sentence(text, F.array(claim), 50, F.col("page_status").isNotNull() & (~F.col("hit") | (F.col("values_source") == "llm")))


def fit(sentences: Column, max_chars: int) -> Column:
    """The sentences left after whole ones go, lowest priority first and later ones before earlier,
    until the text fits."""
    placed = F.transform(sentences, lambda s, i: F.struct(s["priority"].alias("p"), (-i).alias("j"), F.length(s["text"]).alias("n")))
    order = F.array_sort(placed)
    total = F.aggregate(order, F.lit(-1), lambda a, s: a + s["n"] + 1)
    state = F.aggregate(
        order,
        F.struct(total.alias("left"), F.lit(0).alias("drop")),
        lambda a, s: F.when(a["left"] > max_chars, F.struct((a["left"] - s["n"] - 1).alias("left"), (a["drop"] + 1).alias("drop"))).otherwise(a),
    )
    gone = F.transform(F.slice(order, 1, state["drop"]), lambda s: -s["j"])
    return F.filter(sentences, lambda s, i: ~F.array_contains(gone, i))


def compose(rows: DataFrame, *, max_chars: int = 1200, margin: float = 0.05, max_terms: int = 4) -> DataFrame:
    """row_uid, reasoning, claims for rows that carry the columns the sentences are made of."""
    said = F.array_compact(F.array(*identity_sentences(max_terms), module_sentence(margin), *value_sentences(), evidence_sentence()))
    df = rows.withColumn("_s", said).withColumn("_s", fit(F.col("_s"), max_chars))
    return df.select("row_uid", F.array_join(F.transform("_s", lambda s: s["text"]), " ").alias("reasoning"), F.flatten(F.transform("_s", lambda s: s["claims"])).alias("claims"))
