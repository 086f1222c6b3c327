"""Main text of web pages by tree scoring.

A tolerant parser builds the page's tree. Blocks that can't be content (menus, page headers and footers, side bars,
notices, adverts, forms, scripts, reader comments) are set aside by element, role or class words. A class name such as
``has-sidebar`` says what stands elsewhere and marks nothing; what holds ``main``, or ``h1`` and paragraphs, or a form around
the page's own header, menu or article, is no side matter; and where the class words would leave no text at all, they
are not believed. Every paragraph left gives points for its length and its commas to its parent, half of them to its
grandparent; a container's points are discounted by the share of its text that stands in links. The best container is
kept with those of its siblings that are not made of links. Its text is taken block by block in page order.

Defined results: null or empty html, and pages without text, give an empty text; unclosed and stray tags are mended
as browsers do for paragraphs, list items and cells; of containers with equal points the first in page order is the best;
repeated rows are extracted alike; an empty table gives an empty one; other columns are ignored. Work is linear in the
page, with no recursion and no limit on its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytescan import trimmed

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<!--|<[!?/]""")
#: One attribute after another, so that no value is taken for a name.
ATTRIBUTE = re.compile(r"""([^\s"'>/=][^\s>/=]*+)\s*+(?:=\s*+("[^"]*"|'[^']*'|[^\s>]++))?""")
#: Attributes that tell what an element is for.
TELLING = frozenset("class id role hidden style aria-hidden".split())

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe noembed noframes xmp svg".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: What opening an element closes, if it is open above the nearest of the elements that stop the search.
CLOSES = {
    "li": ("li", ("ul", "ol", "menu")),
    "dt": ("dt dd", ("dl",)),
    "dd": ("dt dd", ("dl",)),
    "tr": ("tr", ("table",)),
    "td": ("td th", ("tr", "table")),
    "th": ("td th", ("tr", "table")),
    "option": ("option", ("select",)),
}
#: Elements and roles that hold no content.
ASIDE_TAGS = frozenset("nav footer aside form button select dialog menu head title input label fieldset".split())
FORMS = frozenset("form fieldset".split())
#: A form around one of these is the page's frame.
FRAMED = frozenset("article main h1 nav header footer".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of class and id that mark what is not content.
ASIDE_WORDS = frozenset(
    "ad ads adv advert advertisement adverts advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription "
    "comment comments disqus discussion replies respond sidebar side widget widgets related recommended recommendations share sharing social breadcrumb breadcrumbs menu nav navbar navigation footer masthead pagination pager toolbar login signup skip".split()
)
COMMENT_WORDS = frozenset("comment comments disqus replies respond".split())
HEAD_WORDS = frozenset(["header"])
#: Parts of a class name that say that another part stands elsewhere, or nowhere.
ELSEWHERE = frozenset("has no not with without after before above below hide hides show shows".split())
#: Least share of a sibling's text in links for which it goes.
LINKED = 0.5
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = frozenset("p pre td blockquote li dd".split())


class Node:
    __slots__ = ("aside", "children", "inner", "link", "parent", "score", "size", "tag", "why")

    def __init__(self, tag: str, parent: Node | None, why: str = "") -> None:
        self.tag, self.parent, self.why = tag, parent, why
        self.aside = bool(why)
        self.children: list[Node | str] = []
        self.size = self.link = self.inner = 0
        self.score = 0.0


def _named(names: str, wanted: frozenset[str]) -> bool:
    """Whether one of the names (of class or id) is made of a wanted word and of none that puts it elsewhere."""
    for name in names.split():
        parts = set(re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()))
        if parts & wanted and not parts & ELSEWHERE:
            return True
    return False


def _why_aside(tag: str, attributes: str, in_article: bool) -> str:
    """Why an element holds no content: form, tag, comment or word; empty if it may hold some."""
    if tag in FORMS:
        return "form"
    if tag in ASIDE_TAGS or tag == "header" and not in_article:
        return "tag"
    if not attributes or tag in ("html", "body"):
        return ""
    found: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(attributes):
        if name.lower() in TELLING:
            found.setdefault(name.lower(), value[1:-1] if value[:1] in ("'", '"') else value)  # the first counts, as in browsers
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", ""), re.I):
        return "tag"
    if found.get("role", "").lower() in ASIDE_ROLES:
        return "tag"
    names = found.get("class", "") + " " + found.get("id", "")
    if _named(names, COMMENT_WORDS):
        return "comment"
    if tag in ("main", "article"):
        return ""
    return "word" if _named(names, ASIDE_WORDS) or not in_article and _named(names, HEAD_WORDS) else ""


def _settle(root: Node, believe: bool) -> None:
    """Sets aside what is marked and all below it, but for frames of the page; class words only if they are believed."""
    order, work = [], [root]
    while work:
        node = work.pop()
        order.append(node)
        work.extend(c for c in reversed(node.children) if isinstance(c, Node))
    framed, holds = set(), {id(node): set() for node in order}
    for node in reversed(order):
        if node.parent is None:
            continue
        if node.tag in FRAMED or id(node) in framed and node.why not in ("tag", "comment"):
            framed.add(id(node.parent))
        if node.why not in ("tag", "comment"):
            holds[id(node.parent)] |= holds[id(node)] | {node.tag} & {"main", "h1", "p"}
    parts = {k for k, tags in holds.items() if "main" in tags or {"h1", "p"} <= tags}
    for node in order:
        own = node.why == "form" and id(node) not in framed or node.why in ("tag", "comment") or node.why == "word" and believe and id(node) not in parts
        node.aside = own or node.parent is not None and node.parent.aside


def parse(html: str) -> Node:
    root = Node("#page", None)
    stack = [root]
    opened: dict[str, int] = {}
    unclosed: set[str] = set()  # raw elements whose end stands nowhere further on

    def pop_to(k: int) -> None:
        while len(stack) > k:
            opened[stack.pop().tag] -= 1

    at, n, last = 0, len(html), html.rfind(">")
    while at < n:
        if at > last:  # no tag ends any more: text up to a comment or the like, which has no end either
            stack[-1].children.append(re.split("<[!?/]", html[at:], maxsplit=1)[0])
            break
        m = TAG.search(html, at)
        if m is None:
            stack[-1].children.append(html[at:])
            break
        if m.start() > at:
            stack[-1].children.append(html[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            if m[0] == "<!--":
                end = html.find("-->", at)
                at = n if end < 0 else end + 3
            else:
                end = html.find(">", at)
                at = n if end < 0 else end + 1
            continue
        tag = name.lower()
        if m[1] or m[4]:
            if opened.get(tag):
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                pop_to(k)
            elif tag in ("br", "p"):
                stack[-1].children.append(Node("br", stack[-1]))
            continue
        ended = (m[3] or m[6] or "").endswith("/")
        if tag in RAW:
            if tag == "svg" and ended or tag in unclosed:
                continue
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, at)
            if close is None:
                unclosed.add(tag)
            at = close.end() if close else n if tag == "script" else at
            continue
        if tag in BLOCK and opened.get("p"):
            k = len(stack) - 1
            while k and stack[k].tag not in ("p", "td", "th", "table", "button"):
                k -= 1
            if stack[k].tag == "p":
                pop_to(k)
        if tag in CLOSES:
            ends, stops = CLOSES[tag]
            if any(opened.get(t) for t in ends.split()):
                k = len(stack) - 1
                while k and stack[k].tag not in stops and stack[k].tag not in ends.split():
                    k -= 1
                if stack[k].tag in ends.split():
                    pop_to(k)
        if tag in ("html", "body") and opened.get(tag):
            continue
        parent = stack[-1]
        in_article = bool(opened.get("article") or opened.get("main"))
        node = Node(tag, parent, _why_aside(tag, m[3] or m[6] or "", in_article))
        parent.children.append(node)
        if tag not in VOID and not (tag == "math" and ended):
            stack.append(node)
            opened[tag] = opened.get(tag, 0) + 1
    return root


def _clean(text: str) -> str:
    return " ".join(unescape(text).split())


def _score(root: Node) -> list[Node]:
    """Sizes, link sizes and points of all nodes; returns the nodes in page order."""
    order, work = [], [root]
    while work:
        node = work.pop()
        if node.aside:
            continue
        order.append(node)
        work.extend(c for c in reversed(node.children) if isinstance(c, Node))
    inside = {id(root): False}
    for node in order:
        linked = node.tag == "a" or (node.parent is not None and inside[id(node.parent)])
        inside[id(node)] = linked
        own = [_clean(c) for c in node.children if isinstance(c, str)]
        node.inner = sum(map(len, own))
        node.size = node.inner
        node.link = node.inner if linked else 0
        node.score += sum(t.count(",") for t in own)  # commas, for now
    commas = {id(x): x.score for x in order}
    for node in reversed(order):
        if node.parent is not None:
            node.parent.size += node.size
            node.parent.link += node.link
            commas[id(node.parent)] += commas[id(node)] if node.tag not in BLOCK else 0
    for node in order:
        node.score = 25.0 if node.tag in ("article", "main") else 0.0
    for node in order:
        bare = node.tag in ("div", "section", "article", "main", "body", "#page") and node.inner >= 80
        if node.tag in PARAGRAPHS and node.size >= 1 or bare:
            points = (1 + commas[id(node)] + min(node.size / 100, 3)) * (1 - node.link / max(1, node.size))
            up = node if bare else node.parent
            if up is not None:
                up.score += points
                if up.parent is not None:
                    up.parent.score += points / 2
    return order


def _density(node: Node) -> float:
    return node.link / node.size if node.size else 0.0


def _headings(node: Node) -> list[Node]:
    """Headings below a node, at any depth, in page order."""
    out, work = [], [c for c in reversed(node.children) if isinstance(c, Node)]
    while work:
        x = work.pop()
        if x.tag in HEADINGS and not x.aside:
            out.append(x)
        elif not x.aside:
            work.extend(c for c in reversed(x.children) if isinstance(c, Node))
    return out


def _blocks(nodes: list[Node | str]) -> Iterator[str]:
    """Text of each block, in page order."""
    part: list[str] = []
    work: list[Node | str | None] = list(reversed(nodes))
    while work:
        x = work.pop()
        if x is None:
            if text := _clean("".join(part)):
                yield text
            part = []
        elif isinstance(x, str):
            part.append(x)
        elif x.aside:
            part.append(" ")
        elif x.tag == "br":
            part.append(" ")
        elif x.tag == "header":
            work.extend(reversed(_headings(x)))
        else:
            if x.tag in BLOCK:
                work.append(None)
                work.extend(reversed(x.children))
                work.append(None)
            else:
                work.extend(reversed(x.children))
    if text := _clean("".join(part)):
        yield text


def main_text(html: str | None) -> str:
    if not html:
        return ""
    root = parse(html)
    for believe in (True, False):
        _settle(root, believe)
        if text := _best_text(root):
            return text
    return ""


def _best_text(root: Node) -> str:
    order = _score(root)
    if not order:
        return ""
    final = {id(x): x.score * (1 - _density(x)) for x in order}
    best = max(order, key=lambda x: final[id(x)])
    if final[id(best)] <= 0:
        return " ".join(_blocks([root]))
    kept: list[Node | str] = [best]
    if best.parent is not None:
        kept = [x for x in best.parent.children if x is best or isinstance(x, Node) and not x.aside and _density(x) < LINKED]
    return " ".join(_blocks(kept))


def extract(pages: DataFrame) -> DataFrame:
    """Contract of ``op4``: page_id, url, text, n_chars."""
    source = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in source.schema}
    return source.mapInArrow(trimmed(run), f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
