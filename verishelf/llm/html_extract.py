"""Main text of web pages: containers are scored, hosts vote on paths, winning paths extract."""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verishelf.llm._common import cut

# Names of HTML elements by what they do to text.
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
CONTAINERS = frozenset("article body center div main section table tbody td tr".split())
CLOSES_P = BLOCKS - {"br", "caption", "html", "body", "option", "optgroup", "tbody", "td", "tfoot", "th", "thead", "tr"}
SKIPPED = frozenset("aside button canvas datalist dialog footer form head header iframe input menu nav noembed noframes noscript object option script select style svg template textarea title".split())
SKIPPED_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog menu menubar navigation search toolbar".split())
SKIPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disclaimer discussion disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination paywall popup promo promoted recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe teaser toc toolbar topbar widget".split()
)
CONTENT_WORDS = frozenset("article articlebody body content entry main page post story text".split())
#: Words of readers' discussions, which may well be longer than the article; and of a paragraph about it.
DISCUSSION_WORDS = frozenset("comment comments commentlist discussion disqus replies reply respond".split())
BYLINE_WORDS = frozenset("author byline credit date dateline meta posted published time timestamp".split())
#: First words of names that say what a page has, not what a container is: has-sidebar, no-comments.
STATE_WORDS = frozenset("has hide is no not show with without".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]{0,5000}\"|'[^']{0,5000}')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^<>]*)>?",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PARTS = re.compile(r"[\s_-]+|(?<=[a-z])(?=[A-Z])")
#: What a start tag closes, and within what: the tags it ends, those beyond which it doesn't look.
_ENDS = {
    **{t: (("p",), (*CONTAINERS, "li", "dd")) for t in CLOSES_P},
    "li": (("li", "p"), ("ul", "ol", "menu")),
    **{t: (("dd", "dt", "p"), ("dl",)) for t in ("dd", "dt")},
    **{t: (("td", "th"), ("table",)) for t in ("td", "th")},
    "tr": (("tr",), ("table",)),
    "option": (("option",), (*CONTAINERS, "li", "dd")),
}


#: Characters of a path that are kept as they are; of a longer one, a hash of all of it follows them.
MAX_PATH = 400
_SPECIAL = re.compile(r"[>\"']")


@dataclass
class Node:
    """skipped: nothing of it is main text. doubt: its name says so ("discussion" if of readers), its text may not.
    header: of it, headings and paragraphs remain inside the main text."""

    tag: str
    path: str
    skipped: bool
    hint: float = 1.0
    children: list = field(default_factory=list)
    score: float = 0.0
    doubt: str = ""
    header: bool = False
    byline: bool = False


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        out.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return out


def _opened(tag: str, attributes: str, parent: Node) -> Node:
    a = _attributes(attributes) if attributes.strip(" /\t\r\n") else {}
    names = [[p for x in _PARTS.split(n) if (p := x.lower().rstrip("0123456789"))] or [""] for n in f"{a.get('class', '')} {a.get('id', '')}".split()]
    parts = {p for n in names for p in n}
    last = {n[-1] for n in names if n[0] not in STATE_WORDS or len(n) == 1}
    skipped = tag in SKIPPED or a.get("role", "").lower() in SKIPPED_ROLES or "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower()
    doubt = ""
    if not skipped and tag not in ("article", "main") and (found := last & SKIPPED_WORDS):
        doubt = "discussion" if found & DISCUSSION_WORDS else "name"
    path = parent.path
    if tag in CONTAINERS:
        classes = sorted({re.sub(r"\d+", "#", n.lower()) for n in a.get("class", "").split()})
        path = f"{path}>{'.'.join([tag, *classes])}"
        if len(path) > MAX_PATH:
            path = f"{path[:MAX_PATH]}~{xxhash.xxh3_128_hexdigest(path.encode('utf-8', 'surrogatepass'))}"
    hint = {"article": 2.0, "main": 1.5}.get(tag, 1.0) * (1.25 if parts & CONTENT_WORDS else 1.0)
    return Node(tag, path, skipped, hint, doubt=doubt, header=tag == "header" or bool(last & {"header", "masthead"}), byline=bool(parts & BYLINE_WORDS))


def _tag_end(page: str, at: int, open_: set[int]) -> int | None:
    """Where the > of a tag is that lies outside quotes. open_: quotes after which there is none."""
    tried = []
    while (m := _SPECIAL.search(page, at)) and m.start() not in open_:
        if m[0] == ">":
            return m.start()
        tried.append(m.start())
        if (at := page.find(m[0], m.end()) + 1) == 0:
            break
    open_.update(tried)
    return None


def parse(page: str) -> Node:
    """A tree of elements and text. Tags left open are closed by what must follow them.

    Takes time in proportion to the page: where each tag is open is known without looking.
    """
    root = Node("body", "", False)
    stack, where = [root], defaultdict(list)
    at, open_, last = 0, set(), page.rfind(">")

    def shut(depth: int) -> None:
        while len(stack) > depth:
            where[stack.pop().tag].pop()

    def deepest(tags: tuple[str, ...]) -> int:
        return max((where[t][-1] for t in tags if where.get(t)), default=0)

    while True:
        m = _TOKEN.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            stack[-1].children.append(html.unescape(text) if "&" in text else text)
        if not m:
            return _settled(root)
        at = m.end()
        long = _tag_end(page, m.end(5), open_) if m[5] and m.end(5) <= last else None
        at = at if long is None else long + 1
        tag = (m[2] or m[5] or "").lower()
        if not tag or tag in ("html", "body"):
            continue
        if m[1] or m[4]:
            if where.get(tag):
                shut(where[tag][-1])
            elif tag in BLOCKS:
                stack[-1].children.append(Node("br", stack[-1].path, False))
            continue
        attributes = m[3] if m[2] else m[6] or "" if long is None else page[m.end(5) : long]
        if tag in _ENDS:
            ends, stops = _ENDS[tag]
            if (depth := deepest(ends)) > deepest(stops):
                shut(depth)
        child = _opened(tag, attributes, stack[-1])
        stack[-1].children.append(child)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
        elif tag not in VOID and not attributes.endswith("/"):
            where[tag].append(len(stack))
            stack.append(child)


def _settled(root: Node) -> Node:
    """Decides the containers in doubt: one goes if its name is that of a menu, a notice and so on,

    unless it holds an article or main element, or, but for readers' discussions, over two thirds of
    the page's text and little of that in links. If nothing were left of the page, all stay.
    """
    order: list[tuple[Node, int, bool]] = []
    todo: list[tuple[Node, int, bool]] = [(root, -1, False)]
    while todo:
        node, above, link = todo.pop()
        if node.skipped:
            continue
        link = link or node.tag == "a"
        order.append((node, above, link))
        todo.extend((c, len(order) - 1, link) for c in node.children if isinstance(c, Node))
    if not any(node.doubt for node, _, _ in order):
        return root
    sizes, links, main = [0] * len(order), [0] * len(order), [False] * len(order)
    for i in range(len(order) - 1, -1, -1):
        node, above, link = order[i]
        own = sum(len(c.strip()) for c in node.children if isinstance(c, str))
        sizes[i] += own
        links[i] += own if link else 0
        if above >= 0:
            sizes[above] += sizes[i]
            links[above] += links[i]
            main[above] = main[above] or main[i] or node.tag in ("article", "main")
    left, gone = 0, [False] * len(order)
    for i, (node, above, _) in enumerate(order):
        stays = main[i] or (node.doubt != "discussion" and 3 * sizes[i] > 2 * sizes[0] and 2 * links[i] < sizes[i])
        node.skipped = bool(node.doubt) and not stays
        gone[i] = node.skipped or (above >= 0 and gone[above])
        left += 0 if gone[i] else sum(len(c.strip()) for c in node.children if isinstance(c, str))
    if not left:
        for node, _, _ in order:
            node.skipped = False
    return root


def _score(root: Node) -> list[Node]:
    """Credits each block's own text, links left out, to the containers above it; returns them."""
    found: list[Node] = []
    todo: list[tuple[Node, Node | None, bool]] = [(root, None, False)]
    up: dict[int, Node | None] = {}
    while todo:
        node, container, link = todo.pop()
        if node.skipped:
            continue
        if node.tag in CONTAINERS:
            up[id(node)], container = container, node
            found.append(node)
        for child in node.children:
            if isinstance(child, Node):
                todo.append((child, container, link or child.tag == "a"))
            elif not link:
                size, target, share = len(child.strip()), container, 1
                while size and target is not None and share < 6:
                    target.score += size / share
                    target, share = up[id(target)], share + 1
    return found


def best_path(root: Node) -> tuple[str, float] | None:
    """The generalised path of the page's best container; of equals, the outermost.

    A page all of whose text is in links has the path of its body, with the score 0.
    """
    scored = [(n.score * n.hint, -i, n.path) for i, n in enumerate(_score(root))]
    best = max(scored)
    return (best[2], best[0]) if best[0] > 0 or extract(root, [""]) else None


def _text(node: Node, out: list[str]) -> None:
    """Appends the text inside node; of headers in it, headings and paragraphs but bylines."""
    todo: list = [(node, False, False)]
    while todo:
        x, inside, header = todo.pop()
        if isinstance(x, str):
            if not header:
                out.append(x)
            continue
        if header and not (x.skipped and not x.header) and (x.tag in HEADINGS or (x.tag == "p" and not x.byline)):
            header = False
        elif inside and x.header:
            header = True
        elif x.skipped and inside:
            continue
        edge = " " if x.tag in BLOCKS else ""
        todo.append((edge, True, False))
        todo.extend((c, True, header) for c in reversed(x.children))
        todo.append((edge, True, False))


def extract(root: Node, paths: list[str]) -> str:
    """The text of the containers on the first path that the page has text on.

    A container's path is longer than those above it, so none lies in another of its path.
    """
    by_path: dict[str, list[Node]] = {}
    todo = [root]
    while todo:
        node = todo.pop()
        if node.skipped:
            continue
        if node.tag in CONTAINERS:
            by_path.setdefault(node.path, []).append(node)
        todo.extend(c for c in reversed(node.children) if isinstance(c, Node))
    for path in paths:
        out: list[str] = []
        for node in by_path.get(path, []):
            _text(node, out)
        if text := " ".join("".join(out).split()):
            return text
    return ""


def host_column(url: str = "url") -> Column:
    """The lower-case host without www., user and port; empty if there is none."""
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?(?:www\.)?([^/?#:]*)", 1), F.lit(""))


def vote_paths(pages: DataFrame, *, kept: int = 4) -> DataFrame:
    """host, paths: the `kept` paths of most votes of each host, most first.

    A page votes for the path of its best container. Votes are added up where pages are read
    and again in the shuffle, so a host with very many pages costs few rows; ties go to the
    higher total score, then to the path in text order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes, scores = Counter(), Counter()
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                if page and (best := best_path(parse(page))):
                    votes[host, best[0]] += 1
                    scores[host, best[0]] += round(best[1])
            keys = list(votes)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([votes[k] for k in keys], pa.int64()), pa.array([scores[k] for k in keys], pa.int64())], names=["host", "path", "votes", "score"])

    cast = pages.select(host_column().alias("host"), "html").mapInArrow(run, "host string, path string, votes long, score long")
    sums = cast.groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.sum("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("votes"), F.desc("score"), "path"))
    top = sums.withColumn("rank", rank).where(F.col("rank") <= kept)
    return top.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "path"))), lambda x: x["path"]).alias("paths"))


def extract_pages(pages: DataFrame, *, max_broadcast_hosts: int = 200_000) -> DataFrame:
    """page_id, url, text: the main text of every page by its host's consensus.

    pages: page_id, url, html; other columns are ignored. The host's paths are tried in the
    order of their votes; a page that has text on none of them is extracted by its own best
    path. Skipped inside: menus, headers (but for their headings and paragraphs), footers, sidebars, notices,
    adverts, forms, scripts, styles, comments; by tag and role always, by name as _settled decides. Character references are decoded, white space is
    one space, blocks are joined by one space, inline tags by nothing.

    Null and empty html give an empty text, pages of any size and depth are read whole; null urls and urls
    without a host vote together; repeated rows vote each; an empty table gives none. The hosts' paths are broadcast if there are at most
    max_broadcast_hosts hosts, and joined by host beyond it.
    """
    ready = pages.select("page_id", "url", "html", host_column().alias("host"))
    winners = cut(vote_paths(pages))
    winners = F.broadcast(winners) if winners.count() <= max_broadcast_hosts else winners
    joined = ready.join(winners, "host", "left").select("page_id", "url", "html", "paths")
    kind = dict(joined.dtypes)["page_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for page, paths in zip(batch.column("html").to_pylist(), batch.column("paths").to_pylist(), strict=True):
                text = ""
                if page:
                    root = parse(page)
                    text = extract(root, paths or [])
                    if not text and (own := best_path(root)):
                        text = extract(root, [own[0]])
                texts.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return joined.mapInArrow(run, f"page_id {kind}, url string, text string")
