"""Pages with long paths and long attribute values."""

import time

from verishelf.llm.html_extract import best_path, extract, parse

TEXT = "Long words of a paragraph that goes on and on for a while. " * 4


def _own(page):
    root = parse(page)
    best = best_path(root)
    return extract(root, [best[0]]) if best else ""


def test_deep_paths_stay_apart():
    for outer in ("<div>" * 200, "".join(f'<div class="utility-class-{"x" * 60}-{c}">' for c in "abcdefghij")):
        page = f'{outer}<div class="wrap"><div class="left">box</div><div class="mid"><p>{TEXT}</div><div class="right">box</div></div>'
        assert _own(page) == TEXT.strip()
    assert _own("<div>" * 100_000 + TEXT) == TEXT.strip()


def test_long_attribute_values():
    for size in (4000, 6000, 200_000):
        for q in "\"'":
            value = ("a > b < c <p>no</p> " * (size // 20 + 1))[:size]
            assert _own(f"<article><p data-x={q}{value}{q} class=y>{TEXT}</p data-y={q}{value}{q}></article>") == TEXT.strip()
    assert _own(f'<article><p>{TEXT}</p><p title="never closed>x').startswith(TEXT.strip())


def test_unclosed_quotes_take_linear_time():
    began = time.time()
    parse("<b>" + f"<p a=\"{'x' * 6000}" * 2000 + "<p ")
    assert time.time() - began < 30
