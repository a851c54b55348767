"""URLs and pages."""

import random

from pyspark.sql import functions as F

from verishelf.functions import pages as P
from verishelf.functions import urls as U


def test_canonical(spark):
    cases = {
        "HTTPS://www.Example.com:443/p/?utm_source=x&b=2&a=1#f": "https://example.com/p?a=1&b=2",
        "http://example.com/": "http://example.com/",
        "https://example.com/p?variant=75ml&gclid=z": "https://example.com/p?variant=75ml",
        "https://example.com/a‑b": "https://example.com/a-b",
        "https://example.com:8080/x?q=a%20b*~&e=": "https://example.com:8080/x?e=&q=a+b%2A~",
        "ftp://example.com/x": None,
        "": None,
        "http:///x": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "u string").select("u", U.canonical(F.col("u")).alias("c"))
    got = {r["u"]: r["c"] for r in df.collect()}
    assert got == cases
    again = spark.createDataFrame([(v,) for v in cases.values() if v], "u string").select("u", U.canonical(F.col("u")).alias("c"))
    assert all(r["u"] == r["c"] for r in again.collect())
    assert spark.range(1).select(U.canonical(F.lit("https://ｅxample.com/①"))).first()[0] == "https://example.com/1"


def test_safety(spark):
    cases = {"http://10.0.0.1/x": False, "http://127.0.0.1": False, "http://8.8.8.8/": True, "https://a.example/": True, "file:///etc": False, "http://192.168.1.1": False, "http://172.20.0.1": False, "http://169.254.1.1": False}
    df = spark.createDataFrame([(k,) for k in cases], "u string").select("u", U.safe(F.col("u")).alias("s"))
    assert {r["u"]: r["s"] for r in df.collect()} == cases
    bad = ["http://[::1]/", "http://[fd00::1]/", "http://127.1/", "http://2130706433/", "http://0x7f.1/", "http://0177.0.0.1/", "http://ⓛocalhost/", "http://a.localhost:80/", "http://localhost./", "http://u:p@10.1.1.1:8080/", "http://999.1.1.1/", "http://100.64.0.1/", "http://[::ffff:10.0.0.1]/", "http://192.0.2.9/"]
    good = ["http://[2606:4700::1111]/", "http://1.1.1.1:8080/", "http://a1.test/", "http://1.a.test/", "http://192.0.0.9/", "http://192.0.1.9/", "http://ⓛocal.test/"]
    df = spark.createDataFrame([(u,) for u in bad + good], "u string").select("u", U.safe(F.col("u")).alias("s"))
    got = {r["u"]: r["s"] for r in df.collect()}
    assert [u for u in bad if got[u]] == [] and [u for u in good if not got[u]] == []
    rng = random.Random(1)
    hosts = [f"{a}.{b}.{rng.choice((0, 2, 51, 100, 113, 7))}.{rng.choice((0, 9, 10, 170, 255))}" for a in range(256) for b in (0, 16, 51, 64, 127, 168, 254, 18, rng.randrange(256))]
    df = spark.createDataFrame([(h,) for h in hosts], "h string").select("h", U.private_host(F.col("h")).alias("p"))
    assert [r["h"] for r in df.collect() if r["p"] == U.is_global(r["h"])] == []


def test_shape(spark):
    cases = {"https://acme.com/en-gb": ["site_root"], "https://acme.com": ["site_root"], "https://s.test/acme": ["site_root"], "https://s.test/acme/p": [], "https://www.buycott.com/x/y": ["directory"], "https://notbuycott.com/x/y": [], "https://s.test/search?q=a": ["listing_page"], "https://en.wikipedia.org/wiki/A": ["non_commerce"]}
    df = spark.createDataFrame([(k,) for k in cases], "u string").select("u", U.shape_flags(F.col("u"), F.lit("ACME Co")).alias("f"))
    assert {r["u"]: r["f"] for r in df.collect()} == cases


def test_evidence(spark):
    long = "word " * 60
    html = [
        f'<html><head><title>A &amp; B\n <b>c</b></title><script type="application/ld+json">{{"@graph":[{{"@type":["X","Product"],"gtin13":" ","gtin":5014697056627,"brand":"Br","name":"N"}}]}}</script></head><body>{long}</body>',
        '<script type="application/ld+json">{oops</script><meta content="T&#x20;1" property="og:title"><meta property="og:title" content="second"><meta property="og:image" content="i.jpg"><img src="/logo.png"><img src="a.png?v=1&amp;w=2"><img src="data:x">',
        "<p>x</p>",
        None,
    ]
    df = spark.createDataFrame([(i, f"https://s.test/{i}", h) for i, h in enumerate(html)], "page_id int, url string, html string")
    rows = P.evidence(df).orderBy("page_id").collect()
    assert rows[0]["title"] == "A & B c" and rows[0]["gtin"] == "5014697056627" and rows[0]["parse_warnings"] == []
    assert rows[1]["title"] == "T 1"
    assert rows[1]["image_urls"] == ["i.jpg", "a.png?v=1&w=2"] and rows[1]["parse_warnings"] == ["unreadable linked data"]
    assert len(rows[2]["parse_warnings"]) == 1 and rows[3]["body_text"] == "" and rows[3]["title"] is None
    failed = P.evidence(df, status=F.lit("http_error"), http_status=F.lit(403)).first()
    assert failed["parse_warnings"][0] == "fetch http_error: HTTP 403"
    assert df.select(P.images(F.col("html"))).collect()[1][0] == ["i.jpg", "a.png?v=1&w=2"]
    assert [r[0] for r in df.select(P.page_title(F.col("html"))).collect()] == ["A & B c", "T 1", None, None]
    b = df.select(P.product_brand(P.jsonld(F.col("html"))["products"])).first()[0]
    assert b == "Br"
