"""Page extraction on written pages and by host consensus."""

from verishelf.llm.html_extract import best_path, extract, extract_pages, host_column, parse

TEXT = "Long words of a paragraph that goes on and on for a while. " * 4


def _own(page):
    root = parse(page)
    best = best_path(root)
    return extract(root, [best[0]]) if best else ""


def test_article_without_what_surrounds_it():
    page = f"""<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{{}}</style><script>var t="</p><article>";</script></head>
    <body><header>Site<h1>Brand</h1></header><nav><ul><li><a href="/a>b">menu</a></ul></nav><!-- <p>no</p> --><div class="ad box">buy</div>
    <article><h1>Head &quo line</h1><p><b>{TEXT}<br><p>a &lt;b&gt; c&amp d&nbsp;e <i>in</i>line &am<p>1 < 2<form>f</form><aside>s</aside><div class="user-comments"><p>{TEXT}</p></div></article>
    <section id="comments"><p>{TEXT}{TEXT}</p></section><div class="cookie-notice">{TEXT}</div><footer>&copy;</footer></body></html>"""
    assert _own(page) == f"Head &quo line {TEXT}a <b> c& d e inline &am 1 < 2"


def test_shapes():
    assert _own(f"<div><div class=menu>{TEXT}</div><div class=content><h2>t</h2><p>{TEXT}<p>{TEXT}</div></div>") == f"t {TEXT}{TEXT}".strip()
    assert _own(TEXT) == TEXT.strip() and _own("<p>x") == "x" and _own("<nav>x</nav>") == "" and _own("") == ""
    assert _own(f"<main><article><header><h1>A</h1>by x</header><div><p>{TEXT}</div></article></main>") == f"A {TEXT}".strip()
    assert _own(f"<article><p>{TEXT}<script>" + "x<p>" * 50_000) == TEXT.strip()
    assert _own("<article>" + "<div>" * 3000 + "deep" + "<b " * 2000) == "deep"
    assert _own("<table><tr><td>a<td>b<tr><td>c</table>") == "a b c"


def test_hosts_agree(spark):
    body = '<div class="side"><p>{0}</p></div><div class="post p-{1}"><p>{2}</p></div>'
    rows = [(i, f"https://h{i % 2}.example/{i}", body.format("s", i, f"{TEXT}{i}"), "x") for i in range(20)]
    rows += [(50, "https://h0.example/50", body.format(TEXT * 3, 9, "short"), "x"), (51, None, None, "x"), (52, "https://h1.example/z", "", "x"), (53, "https://new.example/", "<article>only</article>", "x"), (54, "https://h1.example/q", "<main>else</main>", "x"), rows[3], (None, "https://h0.example/n", rows[0][2], "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, paths string")
    urls = spark.createDataFrame([("https://WWW.a.example:80/x",), ("http://u@b.example?x",), ("nothing",), (None,)], "url string")
    assert [r[0] for r in urls.select(host_column()).collect()] == ["a.example", "b.example", "", ""]
    for hosts in (100, 0):
        got = {r["page_id"]: r["text"] for r in extract_pages(df, max_broadcast_hosts=hosts).collect()}
        assert all(got[i] == f"{TEXT}{i}" for i in range(20))
        assert got[50] == "short" and got[51] == got[52] == "" and got[53] == "only" and got[54] == "else" and got[None] == got[0]
    assert extract_pages(df).count() == len(rows) and extract_pages(df.limit(0)).count() == 0
