"""Carried selections, summaries, long labels, class names, and live adapters with fakes."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from verishelf.functions import text as T
from verishelf.operators import calibrate, gold, runs
from verishelf.operators import characteristics as C
from verishelf.operators import textmodel as M
from verishelf.sources import adapters, tables, workbook


def test_runs(spark):
    v = spark.createDataFrame([("a", "llm", {"k": None}), ("b", "gate_only", {"k": None}), ("c", "gate_only", {"k": "x"}), ("d", "registry", {})], "row_uid string, source string, values map<string,string>")
    assert sorted(r[0] for r in runs.values_missing(v).collect()) == ["b", "d"]
    hits = spark.createDataFrame([("a", True, "tier0_exact", "e"), ("b", False, None, None)], "row_uid string, hit boolean, tier string, entity_id string")
    ents = spark.createDataFrame([("e", "u", "M", {"k": "v"}, 1.0)], "entity_id string, resolved_url string, module string, characteristics map<string,string>, confidence double")
    r = runs.hit_selections(hits, ents).collect()
    assert len(r) == 1 and r[0]["url"] == "u" and r[0]["values"] == {"k": "v"}
    assert '"run_id":"r1"' in runs.traces({"h": hits.select("row_uid", "hit")}, "r1").first()["trace"]
    rows = spark.createDataFrame([("u", "gtin_exact", True, "llm", ["k", "l"], {"k": "v", "l": None}, None, "M"), (None, None, False, "gate_only", [], {}, "s", "N"), (None, None, False, "gate_only", [], {}, None, "N")], "url string, reason string, adjudicated boolean, values_source string, applicable array<string>, values map<string,string>, image_sha256 string, module string")
    totals, modules = runs.explorer_summary(rows, 1)
    assert totals.first()[:] == (3, 1, 1, 1, 1, 2, 1, 1) and [tuple(m) for m in modules.collect()] == [("N", 2)]


def test_labels_and_names(spark):
    t = spark.createDataFrame([("a", " X ", ""), ("b", None, "Y")], "row_uid string, P string, Q string")
    assert sorted(map(str, (tuple(r) for r in gold.long_labels(t, ["P", "Q"]).collect()))) == ["('a', 'P', 'X')", "('a', 'Q', None)", "('b', 'P', None)", "('b', 'Q', 'Y')"]
    assert spark.range(1).select(gold.as_text(F.lit(99.0)), gold.as_text(F.lit(0.5))).first()[:] == ("99", "0.5")
    docs = spark.createDataFrame([(1, "mint paste"), (2, "soft brush")], "doc int, text string")
    counted = M.terms(docs, "doc", "text")
    idf = M.idf(M.document_frequencies(counted), 2)
    names = spark.createDataFrame([("BRUSH",), ("PASTE",)], "label string")
    got = {(r["doc"], r["label"]): r["score"] for r in gold.unseen_scores(M.vectors(counted, idf, "doc"), docs, names, idf, "doc", "label").collect()}
    assert got[(1, "PASTE")] > got[(1, "BRUSH")] == 0 and got[(2, "BRUSH")] > 0


def test_live_adapters(spark):
    q = spark.createDataFrame([("a",), ("a",), ("bad",)], "text string")

    def find(text, limit, engine):
        if text == "bad":
            raise OSError
        return [("https://x.test/1", "t")] * 20

    got = adapters.search(q, find, limit=3, sleep=lambda s: None).collect()
    assert sorted((r["text"], r["rank"] or 0, r["failed"]) for r in got) == [("a", 1, False), ("a", 2, False), ("a", 3, False), ("bad", 0, True)]
    urls = spark.createDataFrame([("https://x.test/a.png",), ("https://x.test/a.gif",), ("http://10.0.0.1/a.png",), ("https://x.test/big.png",)], "url string")
    get = lambda u: ("image/gif" if u.endswith("gif") else "image/png", [b"x" * 9] * (11 if "big" in u else 3))
    assert {r["url"][-9:]: r["status"] for r in adapters.images(urls, get, most_bytes=50).collect()} == {"est/a.png": "ok", "est/a.gif": "bad_type", "0.1/a.png": "blocked", "t/big.png": "too_large"}


def test_search_takes_the_cache_first_and_is_capped(spark):
    q = spark.createDataFrame([("a",), ("b",), ("c",)], "text string")
    cache = spark.createDataFrame([("a", 1, "u", "t", "old", False), ("b", None, None, None, None, True), ("z", 1, "u", "t", "old", False)], "text string, rank int, url string, title string, engine string, failed boolean")
    got = adapters.search(q, lambda text, limit, engine: [(f"https://x.test/{text}", "t")], engines=("e1", "e2"), cache=cache, sleep=lambda s: None).collect()
    assert sorted((r["text"], r["engine"]) for r in got if r["text"] == "a") == [("a", "old")]
    assert {r["engine"] for r in got if r["text"] in "bc"} == {"e1", "e2"}
    with pytest.raises(ValueError):
        adapters.search(q, None, cache=cache, max_calls=5)


def test_engines_take_turns_and_rest():
    r = adapters.Rotation(("a", "b"), failures=2, cooldown=10)
    asked = []
    for t in range(5):
        engine, wait = r.next(t)
        asked.append(engine)
        r.record(engine, engine != "a", t)
    assert asked == ["a", "b", "a", "b", "b"] and r.next(5) == ("b", 0.0)
    r.record("b", False, 5)
    r.record("b", False, 5)
    assert r.next(6) == ("a", 6.0) and r.next(12.5) == ("a", 0.0)


def test_checked_answers(spark):
    asked = []
    answers = {"good": ['```json\n{"n": 1, "s": "x"}\n```'], "late": ["no", '{"n": 2, "s": "y"}'], "never": ['{"n": "1", "s": "y"}', '{"n": true, "s": "y"}'], "more": ['{"n": 1, "s": "", "z": 0}', "[1]"]}
    path = {k: iter(v) for k, v in answers.items()}
    model = lambda prompt: next(path[prompt.split("\n")[0]])
    frame = spark.createDataFrame([(k, k) for k in answers] + [("good", "good")], "key string, prompt string")
    got = {r["key"]: (r["answer"], r["calls"], r["error"]) for r in C.complete_json(frame.coalesce(1), model, {"n": int, "s": str}).collect()}
    assert got["good"] == ('{"n": 1, "s": "x"}', 1, None) and got["late"] == ('{"n": 2, "s": "y"}', 2, None)
    assert got["never"][:2] == (None, 2) and got["more"] == (None, 2, "not an object") and not asked
    with pytest.raises(ValueError):
        C.complete_json(frame, model, {"n": int}, max_calls=7)


def test_workbooks(spark, tmp_path):
    df = spark.createDataFrame([(2, "b & <c>", None), (1, " 007 ", "x\ny")], "i int, a string, b string")
    data = tables.xlsx_bytes(df, "i", ("a", "b"))
    assert data == tables.xlsx_bytes(df.repartition(2), "i", ("a", "b"))
    assert workbook.read_sheet(data) == [["a", "b"], [" 007 ", "x\ny"], ["b & <c>"]]
    path = str(tmp_path / "w.xlsx")
    tables.write_xlsx(df, path, "i", ("a", "b"))
    assert [tuple(r) for r in tables.read_xlsx(spark, path).collect()] == [(" 007 ", "x\ny"), ("b & <c>", None)]
    with pytest.raises(ValueError):
        tables.read_xlsx(spark, path, "other")
    assert [workbook.column_name(n) for n in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"] and all(workbook.column_number(workbook.column_name(n)) == n for n in range(800))
    shared = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as z, zipfile.ZipFile(shared, "w") as out:
        for name in z.namelist():
            body = z.read(name).decode()
            if name.endswith("sheet1.xml"):
                body = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row r="2"><c r="B2" t="s"><v>0</v></c><c r="D2"><v>1.50</v></c><c r="E2" t="b"><v>1</v></c></row></sheetData></worksheet>'
            out.writestr(name, body)
        out.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><r><t>a</t></r><r><t>b</t></r><rPh><t>z</t></rPh></si></sst>')
    assert workbook.read_sheet(shared.getvalue(), "Sheet1") == [[], [None, "ab", None, "1.50", "TRUE"]]


def test_cards_and_filters(spark):
    df = spark.createDataFrame([("a", "Mint <b>", "https://x.test/?a=1&b=2", None), ("b", "gel", "javascript:x", "M")], "row_uid string, name string, url string, module string")
    fields = {c: F.col(c) for c in ("name", "url", "module")}
    rows = df.select(runs.card_text(fields).alias("t"), runs.card_html(fields, ("url",)).alias("h")).collect()
    assert rows[0]["t"] == "name: Mint <b>\nurl: https://x.test/?a=1&b=2"
    assert rows[0]["h"] == '<dl><dt>name</dt><dd>Mint &lt;b&gt;</dd><dt>url</dt><dd><a rel="noopener" href="https://x.test/?a=1&amp;b=2">https://x.test/?a=1&amp;b=2</a></dd></dl>'
    assert "href" not in rows[1]["h"]
    assert [r[0] for r in runs.filter_rows(df, "x.test MINT", ("name", "url")).collect()] == ["a"] and [r[0] for r in runs.filter_rows(df, "", ("name",), module="M").collect()] == ["b"]
    assert [r[0] for r in tables.first_rows(df, 1, "row_uid").collect()] == ["a"]
    cache = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new"), ("unused", 3, "x")], "key string, fetched_at int, payload string")
    assert [tuple(r) for r in tables.packed_cache(cache, cache.where("key = 'k'"), "key").collect()] == [("k", 2, "new")]
    with pytest.raises(ValueError):
        runs.explorer_page(runs.cards({"m": df.select("row_uid", "name")}), "T", most=1)


def test_encodings(spark):
    whole = ["Café – it’s “naïve”", "Žluťoučký kůň", "plain", "it’s fine", "Ã is a letter", "日本"]
    sloppy = lambda t: "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in t.encode())
    rows = [(w, sloppy(w)) for w in whole] + [(w, sloppy(sloppy(w))) for w in whole] + [(w, w.encode().decode("latin-1")) for w in whole] + [(w, w) for w in whole]
    df = spark.createDataFrame(rows, "want string, text string").select("want", T.repair_encoding(F.col("text")).alias("got"))
    assert [r for r in df.collect() if r["want"] != r["got"]] == []


def test_leave_one_out_is_refitting(spark):
    words = ["mint fresh", "mint cool", "cool gel", "brush soft", "brush hard", "soft bristle"]
    docs = spark.createDataFrame([(i, t, "AB"[i > 2]) for i, t in enumerate(words)], "doc int, text string, label string").cache()
    got = {r["doc"]: r["pred"] for r in gold.leave_one_out(docs).collect()}
    for i in range(len(words)):
        train, test = docs.where(F.col("doc") != i), docs.where(F.col("doc") == i)
        counted = M.terms(train, "doc", "text")
        idf = M.idf(M.document_frequencies(counted), train.count())
        cents = M.centroids(M.vectors(counted, idf, "doc"), train, "doc", "label")
        vecs = M.vectors(M.terms(test, "doc", "text"), idf, "doc")
        want = M.predict(M.class_scores(vecs, test, cents, "doc", "label"), "doc", "label").first()
        sparse = M.best_labels(vecs, test, cents, "doc", "label").first()
        assert got[i] == want["label"] == sparse["label"] and abs(want["gap"] - sparse["gap"]) < 1e-9 and want["runner_up"] == sparse["runner_up"]
    with pytest.raises(ValueError):
        gold.leave_one_out(docs, most=3)


def test_held_out_is_null_where_a_fold_cannot_be_fitted(spark):
    rows = [(i, i / 20, i % 3 == 0) for i in range(20)]
    frame = lambda r: spark.createDataFrame(r, "g int, score double, correct boolean")
    assert calibrate.held_out_error(frame(rows), "g", 5).first()[0] > 0
    for few in (rows[:3], [], [(g, s, False) for g, s, _ in rows], [(g, s, g == 4) for g, s, _ in rows]):
        assert calibrate.held_out_error(frame(few), "g", 5).first()[0] is None
    assert calibrate.held_out_error(frame(rows), "g", 5, least=17).first()[0] is None
    curve = [(0.1 * k, 0.2 * k) for k in range(1, 5)]
    got = spark.createDataFrame([(x,) for x in (0.0, 0.1, 0.25, 0.4, 9.0, None)], "s double").select(calibrate.predict(F.col("s"), curve)).collect()
    assert [r[0] for r in got] == [0.2, 0.2, 0.4, 0.8, 0.8, None]


def test_names_and_modules(spark):
    sheet = spark.createDataFrame([(" M ", "GLOBAL IF WITH INTERSPACE CLAIM", "g"), ("N", "GLOBAL PACKAGING", "h"), ("N", "GLOBAL WRONG", "h")], ["MODULE NAME", "CHARACTERISTICS NAME", "Guidelines"])
    rows = gold.guideline_rows(sheet)
    assert [r["characteristic"] for r in rows.collect()] == ["GLOBAL_INTERSPACE_CLAIM", "GLOBAL_PACKAGING", "GLOBAL_WRONG"]
    found = gold.name_problems(rows).collect()
    assert [r["name"] for r in found if r["problem"] == "not a column"] == ["GLOBAL_WRONG"] and sum(r["problem"] == "not named" for r in found) == 11
    assert [r[0] for r in gold.orphan_modules(rows, rows.where("module = 'M'")).collect()] == ["N"]
