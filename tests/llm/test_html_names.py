"""Names of containers that say less than they seem to, and pages of many tags."""

import time

from verishelf.llm.html_extract import best_path, extract, parse

TEXT = "Long words of a paragraph that goes on and on for a while. " * 4


def _own(page):
    root = parse(page)
    best = best_path(root)
    return extract(root, [best[0]]) if best else ""


def test_names_that_say_what_a_page_has():
    side = "<div class='sidebar'><p>side</div>"
    for name in ("content has-sidebar", "post comments-open", "no-comments", "layout-sidebar", "with-cookie-notice", "wrap promo"):
        assert _own(f"<div class='{name}'><article><p>{TEXT}</article>{side}</div>") == TEXT.strip()
    for name in ("content has-sidebar", "post comments-open", "no-comments", "page-banner", "promo"):
        assert _own(f"<div class='{name}'><p>{TEXT}</div>{side}<footer>f</footer>") == TEXT.strip()


def test_what_is_no_article_goes():
    for name in ("sidebar", "user-comments", "cookie-notice", "ad", "leftSidebar", "related", "adverts-2"):
        assert _own(f"<main><p>{TEXT}</p><p>{TEXT}</p><div class='{name}'><p>{TEXT}</div></main>") == f"{TEXT}{TEXT}".strip()
    talk = f"<div id=comments><p>{TEXT * 9}</div>"
    assert _own(f"<div class=story><p>{TEXT}</div>{talk}") == TEXT.strip()
    assert _own(f"<body>{talk}</body>") == (TEXT * 9).strip()  # nothing else is there
    assert _own("<div class=ad><a href=x>only a link</a></div>") == "only a link"


def test_headers_inside_keep_headings_and_paragraphs():
    head = "<div><h2>t</h2><span>bar</span><p>lead</p><p class=byline>by x</p><nav><h3>menu</h3></nav></div>"
    for open_, close in (("<div class='entry-header'>", "</div>"), ("<header>", "</header>"), ("<div id=header>", "</div>")):
        assert _own(f"<article>{open_}{head}{close}<p>{TEXT}</article>") == f"t lead {TEXT}".strip()
        assert _own(f"{open_}{head}{close}<article><p>{TEXT}</article>") == TEXT.strip()


def test_many_tags_take_linear_time():
    began = time.time()
    assert _own("<article>" + "<b>" * 50_000 + "</i>" * 100_000 + TEXT) == TEXT.strip()
    assert _own("<p><table><td>" + "<b>" * 50_000 + "<hr>" * 50_000 + TEXT) == TEXT.strip()
    assert _own("<ul><li>" + "<b>" * 50_000 + "<dd>" * 20_000 + TEXT) == TEXT.strip()
    assert _own("<article>" + f"<p data-x='{'> <p>no' * 14_000}'>" * 5 + TEXT) == TEXT.strip()
    assert time.time() - began < 30


def test_tables_and_lists_close_what_they_must():
    assert _own("<div><ul><li>a<p>b<li>c<ul><li>d</ul>e</ul><dl><dt>f<dd>g<p>h<dt>i</dl></div>") == "a b c d e f g h i"
    assert _own("<table><tr><td>a<table><tr><td>x</table><td>c<tr><td>d</table>") == "a x c d"
