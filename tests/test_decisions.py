"""Matching, registry, text model, calibration, characteristics, reasoning, runs, streams."""

import json
import random

import pytest
from pyspark.sql import functions as F

from verishelf.functions.vocab import OUTPUT_COLUMNS, MatchConfig, RegistryConfig, RetrievalConfig
from verishelf.operators import calibrate, match, reason, registry, runs
from verishelf.operators import characteristics as C
from verishelf.operators import textmodel as M
from verishelf.sources import adapters, tables
from verishelf.streaming.incremental import breaker_timeline, new_records, normalize_stream


def test_ranking_of_pages(spark):
    gtin, other = "5014697056627", "5014697056628"
    title = "Acme Whitening Toothpaste 100ml"
    pages = [
        ("https://s.test/p", title, gtin), ("https://buycott.com/x", "Acme", gtin), ("https://a.test/p", title, None), ("https://b.test/p", "Acme Whitening Toothpaste refill 100ml", None),
        ("https://c.test/p", "Acme Whitening Toothpaste 75ml", None), ("https://d.test/p", title + " pack of 4", None), ("https://acme.com/en-gb", "Acme", None), ("https://z.test/p", title, other),
    ]
    q = spark.createDataFrame([("q:0", "ACME", gtin, "acme whitening toothpaste 100ml", ["whitening"], ["toothpaste"], 100.0, 100.0, None, None, ["GB"], None)],
        "row_uid string, brand string, barcode string, desc_clean string, variant_terms array<string>, format_hints array<string>, size_value double, size_ml double, size_g double, pack_count int, countries array<string>, domain string")
    p = spark.createDataFrame(pages, "url string, title string, gtin string").withColumn("body_text", F.lit(""))
    ranked = match.rank(match.score(match.features(q.crossJoin(p))))
    got = ranked.orderBy("position").collect()
    assert [r["url"] for r in got] == [x[0] for x in pages]
    assert [round(r["score"], 6) for r in got] == [1, 1, 0.8, 0.48, 0.32, 0.32, 0.24, 0]
    assert got[-1]["rejected"] and got[1]["negative_flags"] == ["directory"] and got[6]["reason"] == "demoted: negative:site_root"
    s = match.select(ranked).first()
    assert (s["url"], s["gap"], s["write_back"], s["adjudicate"]) == ("https://s.test/p", 0.0, True, False)
    rest = match.rank(match.score(match.features(q.withColumn("barcode", F.lit(None).cast("string")).crossJoin(p))))
    s = match.select(rest, tau=0.9).first()
    assert s["url"] is None and s["confidence"] > 0
    verdict = spark.createDataFrame([("q:0", 2)], "row_uid string, choice int")
    swapped = match.apply_verdicts(match.select(rest), rest, verdict).first()
    assert swapped["judged"] and swapped["url"] == rest.where("position = 2").first()["url"]


def test_configs():
    for bad in (lambda: MatchConfig(brand=0.5), lambda: RetrievalConfig(fetch_budget=30), lambda: RegistryConfig(tau_ann=0)):
        with pytest.raises(ValueError):
            bad()


def test_registry(spark):
    rows = spark.createDataFrame([("a", "g1", "f1", ["mint"]), ("b", None, "f1", ["whitening", "pump"]), ("c", None, "f1", ["herbal"]), ("d", None, "f1", []), ("e", None, None, ["mint"])], "row_uid string, gtin_id string, fp_id string, variant_terms array<string>")
    ents = spark.createDataFrame([("g1", ["g1"], ["mint"]), ("e2", ["f1", "g2"], ["pump", "whitening"])], "entity_id string, block_ids array<string>, variant_terms array<string>")
    texts = spark.createDataFrame([("mint",), ("whitening pump",), ("pump whitening",), ("herbal",)], "text string")
    idf = M.idf(M.document_frequencies(M.terms(texts, "text", "text")), 4)
    got = {r["row_uid"]: (r["hit"], r["tier"], r["entity_id"]) for r in registry.lookup(rows, ents, idf).collect()}
    assert got == {"a": (True, "tier0_exact", "g1"), "b": (True, "tier1_ann", "e2"), "c": (False, None, None), "d": (False, None, None), "e": (False, None, None)}


def test_upsert_and_refresh(spark):
    kinds = "entity_id string, brand string, module string, resolved_url string, characteristics map<string,string>, confidence double, member_row_uids array<string>, created_at timestamp, updated_at timestamp"
    stored = spark.createDataFrame([("e", "B", "M", "u", {"k": "v"}, 1.0, ["s:1"], None, None)], kinds)
    batch = spark.createDataFrame(
        [("e", "s:2", 2, "B", None, "u2", {"k": "w"}, 1.0, False, None), ("e", "s:3", 3, "B", "N", "u3", {"z": "1"}, 1.0, True, None), ("n", "s:4", 4, "C", None, "u4", {}, 1.0, False, None)],
        "entity_id string, row_uid string, row_index long, brand string, module string, resolved_url string, characteristics map<string,string>, confidence double, sourced boolean, updated_at timestamp",
    )
    got = {r["entity_id"]: r for r in registry.upsert(stored, batch).collect()}
    assert got["e"]["module"] == "N" and got["e"]["resolved_url"] == "u3" and got["e"]["characteristics"] == {"z": "1"} and got["e"]["member_row_uids"] == ["s:1", "s:2", "s:3"]
    assert got["n"]["member_row_uids"] == ["s:4"]
    hits = batch.select("entity_id", "row_uid", "row_index", F.lit("X").alias("module"), "characteristics", F.lit(False).alias("sourced")).where("row_uid = 's:2'")
    r = registry.refresh(stored, hits).first()
    assert r["module"] == "M" and r["characteristics"] == {"k": "v"} and r["changed"] and r["member_row_uids"] == ["s:1", "s:2"]
    assert not registry.refresh(stored, hits.withColumn("row_uid", F.lit("s:1"))).first()["changed"]
    assert registry.check_members(stored.withColumn("member_row_uids", F.array(F.lit("58470093")))).count() == 1
    assert registry.audit(stored, "run").first()["run_id"] == "run"


def test_components_of_a_chain(spark):
    edges = [(f"n{i:03}", f"n{i + 1:03}") for i in range(40)] + [("z", "z")]
    got = {r["node"]: r["component"] for r in registry.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got["n040"] == "n000" and got["z"] == "z" and len(got) == 42


def test_text_model(spark):
    docs = spark.createDataFrame([(1, "mint fresh", "A"), (2, "mint cool", "A"), (3, "brush soft", "B"), (4, "", "B")], "doc int, text string, label string")
    counted = M.terms(docs, "doc", "text")
    vecs = M.vectors(counted, M.idf(M.document_frequencies(counted), 4), "doc")
    norms = vecs.groupBy("doc").agg(F.sum(F.col("weight") ** 2).alias("n")).collect()
    assert all(abs(r["n"] - 1) < 1e-9 for r in norms)
    out = {r["doc"]: r for r in M.predict(M.class_scores(vecs, docs, M.centroids(vecs, docs, "doc", "label"), "doc", "label"), "doc", "label").collect()}
    assert out[1]["label"] == "A" and out[3]["label"] == "B" and out[4]["label"] == "A" and out[4]["score"] == 0 and out[4]["runner_up"] == "B"
    assert {r["doc"]: r["nearest"] for r in M.nearest(vecs, vecs, "doc").collect()}[1] == 2
    with pytest.raises(ValueError):
        M.idf(M.document_frequencies(counted), 0)
    rows = spark.createDataFrame([(i, x) for i, x in enumerate("ABAAB")], "i int, l string")
    assert [r["fold"] for r in M.stratified_folds(rows, "l", "i", 2).orderBy("i").collect()] == [0, 0, 1, 0, 1]
    sizes = M.equal_buckets(spark.range(7), ["id"], 3).groupBy("bucket").count().orderBy("bucket").collect()
    assert [r["count"] for r in sizes] == [2, 2, 3]
    sample = M.stratified_sample(spark.createDataFrame([(0, "A"), (1, "A"), (2, "A"), (3, "B")], "i int, l string"), "l", "i", 3, 1)
    assert sorted(r["i"] for r in sample.collect()) == [0, 1, 3]


def _curve(spark, s, y):
    return calibrate.curve_of(calibrate.fit_isotonic(spark.createDataFrame([(a, bool(b)) for a, b in zip(s, y)], "score double, correct boolean")))


def test_isotonic(spark):
    assert [v for _, v in _curve(spark, (0.1, 0.2, 0.8, 0.9), (0, 0, 1, 1))] == [0, 0, 1, 1]
    c = _curve(spark, (0.1, 0.4, 0.5, 0.9), (0, 1, 0, 1))
    assert c == [(0.1, 0.0), (0.4, 0.5), (0.9, 1.0)]
    got = spark.createDataFrame([(0.7,), (0.05,), (1.0,)], "s double").select(calibrate.predict(F.col("s"), c)).collect()
    assert [r[0] for r in got] == [0.5, 0.0, 1.0]
    assert _curve(spark, (0.2, 0.5, 0.8), (1, 0, 0)) == [(0.2, 1 / 3)]
    assert _curve(spark, (0.45, 0.45, 0.9), (0, 1, 1)) == [(0.45, 0.5), (0.9, 1.0)]
    with pytest.raises(ValueError):
        _curve(spark, (0.2, 0.5), (1, 1))
    rng = random.Random(1)
    s = [rng.randint(0, 30) / 30 for _ in range(200)]
    y = [rng.random() < x for x in s]
    curve = _curve(spark, s, y)
    xs = sorted(set(s))
    tot = lambda a, b: [v for u, v in zip(s, y) if a <= u <= b]
    for k in xs:
        want = max(min(sum(tot(i, j)) / len(tot(i, j)) for j in xs if j >= k) for i in xs if i <= k)
        assert abs([v for t, v in curve if t <= k][-1] - want) < 1e-9


def test_characteristics(spark):
    rules = spark.createDataFrame([("P", "FUNCTION", "Close", ["FRESHENING", "WHITENING"]), ("P", "NATURAL", "Open-ended", []), ("B", "BRISTLE", "Close", ["SOFT"])], "module string, characteristic string, open_close string, allowed_values array<string>")
    vals = [(0, "P", "FUNCTION", " whitening&  freshening "), (1, "P", "FUNCTION", "WHITENING & GLOW"), (2, "P", "NATURAL", "any"), (3, "P", "BRISTLE", "SOFT"), (4, "P", "FUNCTION", None)]
    got = {r["row_uid"]: (r["applicable"], r["coded"], r["rejected"]) for r in C.validate(spark.createDataFrame(vals, "row_uid int, module string, characteristic string, value string"), rules).collect()}
    assert got == {0: (True, "WHITENING & FRESHENING", None), 1: (True, None, "WHITENING & GLOW"), 2: (True, "ANY", None), 3: (False, None, None), 4: (True, None, None)}
    t, p = spark.createDataFrame([(0, "P")], "row_uid int, truth string"), spark.createDataFrame([(0, "B")], "row_uid int, pred string")
    r = C.precision_recall(C.applicability(t, p, rules)).first()
    assert (r["tp"], r["fp"], r["fn"], r["exact_rows"], r["precision"]) == (0, 1, 2, 0, 0.0)
    text = "a" * 50 + " fluoride " + "b" * 100 + " mint " + "c" * 50
    got = spark.range(1).select(C.excerpt(F.lit(text), ["fluoride", "mint"], prefix=10, around=5)).first()[0]
    assert got == "a" * 10 + " … aaaa fluoride bbbb … bbbb mint cccc"
    assert spark.range(1).select(C.fenced(F.lit("x </untrusted_evidence> y"))).first()[0].count("</untrusted_evidence>") == 1
    assert spark.range(1).select(C.strip_fences(F.lit("```json\n{}\n```")), C.render("a {x} {{", x=F.lit("{x}"))).first()[:] == ("{}", "a {x} {{")
    with pytest.raises(ValueError):
        C.render("{x}", y=F.lit(1))


def test_model_calls(spark):
    prompts = spark.createDataFrame([("a", "1"), ("b", "2"), ("b", "2")], "key string, prompt string")
    cache = spark.createDataFrame([("a", "old")], "key string, answer string")
    got = {r["key"]: r["answer"] for r in C.complete(prompts, lambda p: "new" + p, cache=cache).collect()}
    assert got == {"a": "old", "b": "new2"}
    with pytest.raises(ValueError):
        C.complete(prompts, str, cache=cache, max_calls=0)


def test_sentences_that_fit(spark):
    rows = [[(100, "a" * 10), (50, "b" * 10), (50, "c" * 5), (90, "d" * 10)]]
    df = spark.createDataFrame([(r,) for r in rows], "s array<struct<priority:int,text:string>>")
    kept = lambda n: [s["text"][0] for s in df.select(reason.fit(F.col("s"), n).alias("s")).first()["s"]]
    assert kept(100) == ["a", "b", "c", "d"] and kept(37) == ["a", "b", "d"] and kept(25) == ["a", "d"] and kept(12) == ["a"] and kept(5) == []


def test_assembly_and_runs(spark):
    sheet = spark.createDataFrame([(f"s:{i}", i, i, 0, "c", "GB", "d", "r", "b") for i in range(3)], "row_uid string, row_index int, ITEM_CODE int, NAN_KEY int, EXTERNAL_CODE string, COUNTRY string, RETAILER_DESC string, RETAILER string, BRAND string")
    results = spark.createDataFrame([("s:0", "u", "because", "P", {"GLOBAL_PACKAGING": "X"}), ("s:1", "u", "because", "P", {})], "row_uid string, url string, reasoning string, module string, values map<string,string>")
    out = runs.assemble(sheet, results, results.where("row_uid = 's:0'").select("row_uid")).orderBy("row_index").collect()
    assert list(out[0].asDict())[1:] == list(OUTPUT_COLUMNS) and out[0]["GLOBAL_PACKAGING"] == "X" and out[1]["MODULE"] is None and out[1]["EXTERNAL_CODE"] == "c"
    cards = {r["row_uid"]: json.loads(r["card"]) for r in runs.cards({"match": results.select("row_uid", "url"), "sheet": sheet.select("row_uid", "BRAND")}).collect()}
    assert cards["s:0"] == {"match": {"url": "u"}, "sheet": {"BRAND": "b"}} and "match" not in cards["s:2"]
    page = runs.explorer_page(runs.cards({"m": results.select("row_uid", F.lit("</script>").alias("t"))}), "T")
    assert page.count("</script>") == 1
    art = spark.createDataFrame([("a", "x", "1"), ("a", "y", "1"), ("b", "x", "1"), ("b", "y", "")], "row_uid string, stage string, payload string")
    assert [r[0] for r in tables.pending(art.select("row_uid").distinct(), art, ("x", "y")).collect()] == ["b"]


def test_tables(spark, tmp_path):
    path = str(tmp_path / "in.csv")
    open(path, "w", encoding="utf-8-sig").write('RETAILER_DESC,BRAND\n"a ""q""\nb",B\n')
    assert tables.read_csv(spark, path).first()[0] == 'a "q"\nb'
    tables.write_csv(spark.createDataFrame([(2, "b"), (1, None)], "i int, t string"), str(tmp_path / "out"), "i", ("i", "t"))
    assert spark.read.text(str(tmp_path / "out")).collect()[1][0] == "1,"
    tables.write_jsonl(spark.createDataFrame([(1,)], "i int"), str(tmp_path / "j"), "i")
    assert tables.read_jsonl(spark, str(tmp_path / "j"), "i int").count() == 1
    assert tables.content_hash({"a": b"1", "b": b"2"}) == tables.content_hash({"b": b"2", "a": b"1"})
    ranked, n = tables.global_rank(spark.range(100).selectExpr("(id * 37) % 100 AS v"), ["v"], "r", rows_per_task=13)
    assert n == 100 and all(r["r"] == r["v"] + 1 for r in ranked.collect())


def test_adapters(spark):
    urls = spark.createDataFrame([("https://a.test/1",), ("https://a.test/2",), ("http://10.0.0.1/",), ("https://b.test/bad",)], "url string")

    def get(url):
        if "bad" in url:
            raise OSError
        return adapters.Answer(404) if url.endswith("2") else adapters.Answer(200, body=[b"<p>", "é".encode()])

    got = {r["url"]: (r["status"], r["html"]) for r in adapters.fetch(urls, get, sleep=lambda s: None).collect()}
    assert got == {"https://a.test/1": ("ok", "<p>é"), "https://a.test/2": ("http_error", ""), "http://10.0.0.1/": ("blocked", None), "https://b.test/bad": ("timeout", None)}
    payload = json.dumps({"results": [{"url": "https://a.test/1", "title": "t", "engine": "x"}, {"url": "u", "title": "t", "engine": "y"}]})
    df = spark.createDataFrame([("q", payload, ["x"])], "text string, payload string, engines array<string>")
    assert [r["rank"] for r in adapters.search_results(df).collect()] == [1, 2] and adapters.stray_engines(df).first()["stray"] == ["y"]


def test_every_hop_is_guarded():
    pages = {
        "https://a.test/in": adapters.Answer(302, "http://169.254.169.254/latest"), "https://a.test/name": adapters.Answer(301, "//inner.test/x"), "https://a.test/far": adapters.Answer(307, "/near"),
        "https://a.test/near": adapters.Answer(200, body=[b"x" * 10]), "https://a.test/loop": adapters.Answer(302, "/loop"), "https://a.test/file": adapters.Answer(302, "file:///etc/passwd"),
        "https://a.test/private": adapters.Answer(200),
    }
    names = {"a.test": ["8.8.8.8", "2606:4700::1111"], "inner.test": ["8.8.8.8", "10.0.0.1"]}
    asked = []

    def get(url):
        asked.append(url)
        return pages[url]

    def resolve(name):
        if name not in names:
            raise OSError
        return names[name]

    go = lambda url, **o: adapters.get_guarded(url, get, resolve=resolve, robots=lambda u: "private" not in u, **o)
    assert go("https://a.test/in") == ("blocked", None, None, "http://169.254.169.254/latest")
    assert go("https://a.test/name")[0] == "blocked" and go("https://a.test/file")[0] == "blocked" and go("https://gone.test/")[0] == "blocked"
    assert go("https://a.test/far") == ("ok", 200, "x" * 10, "https://a.test/near") and go("https://a.test/loop", hops=3)[0] == "redirects"
    assert go("https://a.test/near", most_bytes=9)[0] == "too_large" and go("https://a.test/private")[0] == "robots"
    assert not any(u.startswith(("http://169", "file", "https://inner")) for u in asked) and "https://a.test/private" not in asked


def test_streams(spark, tmp_path):
    rows = [{"row_uid": "s:0", "desc_raw": "acme gel 75ml", "brand": "ACME", "brand_owner": None, "retailer_raw": "R", "retailer": "R", "barcode": "12345678"}]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, rows)))
    schema = "row_uid string, desc_raw string, brand string, brand_owner string, retailer_raw string, retailer string, barcode string"
    out = str(tmp_path / "out")
    normalize_stream(new_records(spark, str(tmp_path / "in"), schema), lambda df, n: df.write.mode("append").parquet(out), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(out).first()["size_ml"] == 75.0
    events = [(i, "e", float(t), ok) for i, (t, ok) in enumerate([(0, True), (1, False), (2, False), (3, False), (4, True), (10, False), (14, False)])]
    got = breaker_timeline(spark.createDataFrame(events, "event_id int, engine string, at double, ok boolean"), failures=3, cooldown=10).orderBy("event_id").collect()
    assert [r["open"] for r in got] == [False, False, False, False, True, True, False]


def test_the_first_pages_are_found_without_all_pairs(spark, monkeypatch):
    from verishelf.operators import shortlist

    monkeypatch.setattr(shortlist, "TILE_ROWS", 7)
    monkeypatch.setattr(shortlist, "TILE_PAGES", 5)
    rnd = random.Random(3)
    words = ["mint", "fresh", "whitening", "travel", "refill"]
    codes = ["5014697056627", "5014697056628", "501469", None, None]
    pick = lambda n: rnd.sample(words, rnd.randint(0, n))
    row = lambda i: (f"q:{i}", rnd.choice(["ACME X", "Oral", ""]), rnd.choice(codes), " ".join(pick(2)), pick(3), rnd.choice([["gel"], [], ["gel", "paste"]]), 50.0, rnd.choice([50.0, 75.0, None]), rnd.choice([None, 50.0]), rnd.choice([None, 1, 2]), rnd.choice([["GB", "FR"], ["DE"], []]), rnd.choice([None, "s1.test"]), i % 2)
    q = spark.createDataFrame([row(i) for i in range(60)], "row_uid string, brand string, barcode string, desc_clean string, variant_terms array<string>, format_hints array<string>, size_value double, size_ml double, size_g double, pack_count int, countries array<string>, domain string, block int")
    hosts = ["www.s1.test", "shop.co.uk", "acme.de", "x.com", "buycott.com"]
    page = lambda i: (f"https://{rnd.choice(hosts)}/{rnd.choice(['acme', 'p/', 'search?q='])}{i if i % 9 else ''}", " ".join([rnd.choice(["Acme-X", "Oral", ""]), *pick(3), rnd.choice(["50ml", "75 ml", "50g", ""]), rnd.choice(["gel", "pack of 2", ""])]), rnd.choice(codes), i % 2)
    p = spark.createDataFrame(list({r[0]: r for r in map(page, range(90))}.values()), "url string, title string, gtin string, block int").withColumn("body_text", F.lit(""))
    rows, pages = match.parse_records(q), match.parse_pages(p)
    ranked = lambda pairs: match.rank(match.score(match.features(pairs)))
    every = ranked(q.join(p, "block"))
    few = tables.cut(ranked(shortlist.shortlist(rows, pages, ["block"], 3)))
    seen = lambda df: sorted((r["row_uid"], r["position"], r["url"], r["score"]) for r in df.where("not rejected and position <= 3").collect())
    assert seen(few) == seen(every) and few.count() < every.count() / 3
    picked = lambda df: sorted(map(str, match.select(df).collect()))
    assert picked(few) == picked(every)
