"""Operator 7: main text of web pages by composite text density.

A page is parsed into a tree. Only what HTML itself says is no article text is
cut off: scripts, styles, the head, controls, hidden nodes, menus, headers and
footers of the page, asides, and the landmark roles of the same meaning. For
every other node the composite density relates its characters to its tags and
weighs down linked text:

    C/T * log_b((C / LC) * (T / LT)),   b = (C / nLC) * LC + (LCp / Cp) * C + e

Formatting elements and ``<br>`` are text of their block, neither nodes nor
tags, so that a bold paragraph weighs as much as a plain one. In the formula,
C are characters, T tags, LC linked characters, nLC the others, LT link tags, and
p is the body.

A class or id that names boilerplate (adverts, notices, comments, sharing, ...)
and a form cut nothing off; they are a weight in the score: the densities of
that node and of all within count ``FAINT`` times as much. The weight is not
given to a node that holds ``main``, all articles of the page, or nearly all
text, nor for a name that is only in part such a name if the node holds most of
the text; inside an article such names, and those of its own sections
(``related``, ``discussion``), say nothing. A name counts by its whole, its
first part, or its last part after a place (``left-sidebar``), and not as a
state (``has-sidebar``, ``comments-open``).

The subtree with the largest sum of its children's scores is the core. The
least density on the path from the core up to the body is the threshold: the
other subtrees whose score reaches it give their own largest-sum part. In the
chosen parts all text is kept, whatever its density, but weighted nodes below
the threshold.

Blocks are joined by two line breaks in page order; inside a block white space
(``<br>`` included) becomes one blank; character references are decoded.

Pages are independent, so this is one pass without a shuffle. Result: one row
per page with ``page_id, url, text, n_chars``. Cases: a null or empty page, or
one without text, gives an empty text; broken or unclosed markup is closed as
browsers do for the usual cases; very long and deeply nested pages take time in
proportion to their length, as open elements are looked up by name and nothing
recurses; equal sums go to the first node; repeated rows are extracted alike;
an empty table gives an empty result; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearth.llm.staging import table, text_of

# HTML's elements by their role in the page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small "
    "span strike strong sub sup time tt u var wbr".split())
NEVER = frozenset(
    "script style noscript template head title nav aside footer button select option textarea input "
    "iframe object embed svg canvas audio video map menu dialog datalist".split())
ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre section table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
        "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"},
         "th": {"tr", "table"}, "option": {"select"}}
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
_NAME = (
    r"(?:nav(?:bar|igation)?|menu|breadcrumbs?|masthead|footer|side[_-]?bar|aside|ads?|advert[a-z]*|"
    r"banner|promo[a-z]*|sponsor[a-z]*|cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay|comments?|disqus|"
    r"replies|respond|discussion|share|sharing|social|related|recommended|newsletter|subscribe|sign-?up|login|"
    r"widget|toolbar|pagination|pager|tags)\d*")
_PLACE = r"(?:site|page|main|primary|secondary|left|right|top|bottom|global|mobile|post|article|entry|blog)"
# Of a class or id: wholly a name; partly one; a state of the page or its layout.
NAMED = re.compile(rf"(?:{_PLACE}[_-]+)?{_NAME}(?:[_-]+(?:{_NAME}|\d+))*", re.IGNORECASE)
PARTLY = re.compile(rf"(?:{_PLACE}[_-]+)?{_NAME}(?:[_-].*)?|(?:.*[_-])?header\d*(?:[_-].*)?", re.IGNORECASE)
STATE = re.compile(
    r"(?:has|have|no|not|is|with|without)[_-].*|"
    r".*[_-](?:open|opened|closed?|enabled|disabled|on|off|active|inactive|none|hidden|visible)", re.IGNORECASE)
HEADER = re.compile(r"(?:.*[_-])?header\d*(?:[_-].*)?", re.IGNORECASE)
SECTION = re.compile(r"(?:discussion|related|recommended|tags)\d*(?:[_-].*)?", re.IGNORECASE)  # also parts of an article
KEEPS = frozenset("html body article main".split())
FAINT = 0.005  # what the density of a node named as boilerplate counts


class Node:
    __slots__ = ("tag", "parent", "parts", "cut", "named", "chars", "tags", "linked", "links", "weight", "density",
                 "score", "total", "best", "holds", "sure")

    def __init__(self, tag: str, parent: Node | None, cut: bool = False, named: str = ""):
        self.tag, self.parent, self.cut = tag, parent, cut
        self.named = named  # "whole" or "part" of a name is one of boilerplate
        self.parts: list[Node | str] = []


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", None)
        self.path = [self.root]  # the open elements
        self.depths: dict[str, list[int]] = {}  # of the open elements by tag, the deepest last
        self.off = 0  # how many of them are cut off

    def updatepos(self, i, j):
        return j  # line numbers are not needed

    def _deepest(self, tags) -> int:
        return max((self.depths[t][-1] for t in tags if self.depths.get(t)), default=0)

    def _up_to(self, depth: int) -> None:
        """Close the elements from ``depth`` on."""
        while len(self.path) > depth:
            n = self.path.pop()
            self.depths[n.tag].pop()
            self.off -= n.cut

    def _close(self, tags, scope=frozenset()) -> None:
        """Close the nearest open element of ``tags`` that is inside ``scope``."""
        at = self._deepest(tags)
        if at > self._deepest(scope):
            self._up_to(at)

    def handle_starttag(self, tag, attrs):
        if tag == "html":
            return
        if tag in ENDS_P:
            self._close({"p"}, {"button", "table", "td", "th"})
        if tag in SAME:
            self._close(SAME[tag], SCOPE[tag])
        if tag == "body" and self.path[-1].tag == "head":
            self._up_to(1)
        attrs = dict(attrs)
        cut = self._is_cut(tag, attrs)
        here = self.path[-1]
        if tag in INLINE and tag != "a" and not cut and not self.off:
            if tag == "br":
                here.parts.append(" ")
            return
        node = Node(tag, here, cut, "" if cut else self._named(tag, attrs))
        here.parts.append(node)
        if tag not in VOID:
            self.depths.setdefault(tag, []).append(len(self.path))
            self.path.append(node)
            self.off += cut

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("html", "p", "div", "span", "script", "style"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag == "br":
            self.path[-1].parts.append(" ")
        elif tag not in ("html", "body"):
            self._close({tag}, {"article", "body"} if tag in INLINE or tag == "p" else frozenset())

    def handle_data(self, data):
        if data:
            self.path[-1].parts.append(data)

    def _in_article(self) -> bool:
        return self._deepest(("article", "main")) > 0

    def _is_cut(self, tag: str, attrs: dict) -> bool:
        if tag in KEEPS:
            return False
        if tag in NEVER or "hidden" in attrs or attrs.get("aria-hidden") == "true":
            return True
        if tag == "header":
            return not self._in_article()
        return ((attrs.get("role") or "").lower() in ROLES
                or "display:none" in (attrs.get("style") or "").replace(" ", ""))

    def _named(self, tag: str, attrs: dict) -> str:
        if tag in KEEPS:
            return ""
        if tag == "form":
            return "whole"
        names = f"{attrs.get('class') or ''} {attrs.get('id') or ''}"
        if len(names) < 2 or tag in INLINE or tag == "header":
            return ""
        names = [n for n in names.split() if not STATE.fullmatch(n)]
        if self._in_article():
            names = [n for n in names if not SECTION.fullmatch(n) and not HEADER.fullmatch(n)]
        if any(NAMED.fullmatch(n) for n in names):
            return "whole"
        return "part" if any(PARTLY.fullmatch(n) for n in names) else ""


def parse(html: str) -> Node:
    # A tag that the page breaks off in is dropped: the first one after the last ">".
    closed = html.rfind(">") + 1
    broken = re.compile("<[a-zA-Z/!?]").search(html, closed)
    tree = _Tree()
    tree.feed(html[:broken.start()] if broken else html)
    tree.close()
    return tree.root


def _nodes(root: Node) -> list[Node]:
    """The nodes that are not cut off, parents before children."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        out.append(n)
        todo += [c for c in reversed(n.parts) if isinstance(c, Node) and not c.cut]
    return out


def _children(n: Node) -> list[Node]:
    return [c for c in n.parts if isinstance(c, Node) and not c.cut]


def count(body: Node) -> list[Node]:
    """Characters, tags, links and articles of each node; returns the nodes."""
    order = _nodes(body)
    for n in reversed(order):
        kids = _children(n)
        own = sum(len("".join(p.split())) for p in n.parts if isinstance(p, str))
        n.chars = own + sum(c.chars for c in kids)
        # Unlinked characters outside nodes that are wholly named.
        n.sure = own + sum(c.sure for c in kids if c.tag != "a" and c.named != "whole")
        n.tags = sum(c.tags + 1 for c in kids)
        n.links = sum(c.links + (c.tag == "a") for c in kids)
        n.linked = sum(c.chars if c.tag == "a" else c.linked for c in kids)
        # Outermost articles, and whether there is a main.
        n.holds = (sum(1 if c.tag in ("article", "main") else c.holds[0] for c in kids),
                   any(c.tag == "main" or c.holds[1] for c in kids))
    return order


def weigh(order: list[Node]) -> None:
    """The weight of each node: its own and that of the nodes around it."""
    body = order[0]
    for n in order:
        n.weight = 1.0 if n is body else n.parent.weight
        if n.named:
            spared = (n.holds[1] or n.holds[0] and n.holds[0] == body.holds[0]
                      or not body.holds[0] and n.chars - n.linked > 0.9 * (body.chars - body.linked)
                      or not body.holds[0] and n.named == "part" and 2 * n.sure > body.sure)
            if not spared:
                n.weight *= FAINT


def measure(body: Node) -> None:
    """Densities, scores, sums of the children's scores, and for each node the
    node with the largest sum within it."""
    order = count(body)
    weigh(order)
    ratio = body.linked / max(1, body.chars)
    for n in reversed(order):
        tags = max(1, n.tags)
        base = n.chars / max(1, n.chars - n.linked) * n.linked + ratio * n.chars + math.e
        share = n.chars / max(1, n.linked) * tags / max(1, n.links)
        n.density = n.chars / tags * math.log(share) / math.log(base) if n.chars else 0.0
        n.score = n.density * n.weight
        kids = _children(n)
        n.total = sum(c.score for c in kids) if kids else n.score
        n.best = n
        for c in kids:
            if c.best.total > n.best.total:
                n.best = c.best


def content(root: Node) -> list[Node]:
    """The chosen subtrees in page order, without the weighted nodes below the threshold."""
    body = next((n for n in _nodes(root) if n.tag == "body"), root)
    measure(body)
    n, least = body.best, body.best.density
    while n is not body:
        n = n.parent
        least = min(least, n.density)
    chosen, todo = [], [body]
    while todo:
        n = todo.pop()
        if n is not body and n.score < least:
            continue
        chosen.append(n.best)
        path, m = [], n.best
        while m is not n:
            path.append(m)
            m = m.parent
        for m in reversed(path):
            todo += [c for c in _children(m.parent) if c is not m]
    order = _nodes(body)
    for n in order:
        n.cut = n.weight < 1 and n.score < least and n.parent is not None
    place = {id(n): i for i, n in enumerate(order)}
    return sorted(chosen, key=lambda n: place[id(n)])


def text_blocks(nodes: list[Node]) -> list[str]:
    """The text of the subtrees, one string per block."""
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = " ".join("".join(line).split())
        line.clear()
        if text:
            out.append(text)

    for top in nodes:
        todo: list = [top]
        while todo:
            n = todo.pop()
            if n is None:
                flush()
            elif isinstance(n, str):
                line.append(n)
            elif not n.cut:
                if n.tag not in INLINE:
                    flush()
                    todo.append(None)
                todo += reversed(n.parts)
        if top.tag not in INLINE:
            flush()
    flush()
    return out


def main_text(html: str | None) -> str:
    return "\n\n".join(text_blocks(content(parse(html)))) if html else ""


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for every page."""
    rows = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), text_of(html_col).alias("html"))
    kinds = [f.dataType.simpleString() for f in rows.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
