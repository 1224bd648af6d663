"""Main text of web pages: the maximum-scoring contiguous run of a page's tokens.

A page is a row of tokens: texts and tags. The words of a text score positive and tags negative, with
weights learned from labelled pages; one linear scan finds the run with the highest sum, the content.
Menus, page headers, footers, scripts, styles and hidden parts, told by their elements and attributes,
score nothing and are left out of the run's text. So are forms and parts whose class, id or role names a
sidebar, notice, advert, reader comments or the like, but their words score a little below nothing, and
they count as any other part if they hold most of the page's unlinked words. The rest is joined by blocks.

Defined cases: NULL and empty pages, and pages without words, have an empty text; of equal runs the
first one wins; unclosed and misplaced tags end where HTML lets them end, a cut page at its cut;
`<br>` is white space; rows that repeat give equal rows; an empty table gives an empty result. Extra
columns are ignored.
"""

from __future__ import annotations

import functools
import html
import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from charscape.llm.common import small_batches

TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)"
    r"|</?[a-zA-Z](?:\"[^\"]*\"|'[^']*'|[^'\">])*>?|[^<]+|<", re.S)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")

# Fixed lists of HTML element names.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp noembed noframes".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol "
    "option p pre search section summary table tbody tfoot thead tr ul".split())
CELLS = set("td th br".split())
LEFT_OUT = set(
    "script style noscript template head nav aside footer select button textarea iframe svg "
    "object canvas audio video dialog menu title input option label fieldset search".split())
# An opening tag of the first kind ends an open element of the second kinds.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"},
}
SCOPES = {"ul", "ol", "dl", "table", "select", "article", "section", "div", "body"}
# Class names, ids and roles of parts that are not the article; alone or in compounds with each other and
# with words of layout, as in `site-footer`, but not in `with-sidebar` or `social-history`.
MARKS = set(
    "ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored promo promotion "
    "banner nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead cookie cookies "
    "consent gdpr notice alert newsletter subscribe subscription share sharing social related "
    "recommended comment comments commentlist disqus replies responses popup modal overlay widget "
    "pagination pager toolbar login signin signup search skip complementary contentinfo form dialog "
    "hidden".split())
LAYOUT = set(
    "site main page top bottom left right upper lower primary secondary global mobile desktop header head "
    "bar box list links link item items area block container wrapper wrap inner outer holder section panel "
    "post posts article articles story stories button buttons icon icons unit slot row col column text "
    "body title".split())
# Marked parts with more than these shares of the page's unlinked words are not left out.
MOST, MOST_REPLIES = 0.5, 0.9
REPLIES = set("comment comments commentlist disqus replies responses".split())
PARTS = re.compile(r"[^a-zA-Z0-9]+|(?<=[a-z])(?=[A-Z])")


class Node:
    """An element. What follows from its ancestors is derived once, from its parent: depth costs nothing."""

    __slots__ = ("name", "parent", "left_out", "marked", "words", "linked", "in_article", "scope", "spared",
                 "gone", "dropped")

    def __init__(self, name: str, parent: Node | None, left_out: bool, marked: float | None = None):
        self.name, self.parent, self.left_out = name, parent, left_out
        self.marked = marked  # the share of words beyond which it is not left out
        self.words = 0  # unlinked words
        self.linked = name == "a" or (parent is not None and parent.linked)
        self.in_article = name in ("article", "main") or (parent is not None and parent.in_article)
        # The nearest element that end tags left out do not reach beyond, itself included.
        self.scope: Node = self if parent is None or name in SCOPES else parent.scope
        self.spared = False  # whether an article lies inside
        self.gone = self.dropped = False  # settled when the page has been read

    def inside(self, *names: str) -> bool:
        node: Node | None = self
        while node is not None and node.name not in names:
            node = node.parent
        return node is not None


@dataclass(frozen=True)
class Token:
    text: str | None  # decoded; None for a tag
    tag: str  # the tag's name; for a text, that of its element
    node: Node
    breaks: bool  # ends a block


def _left_out(name: str, tag: str, parent: Node) -> tuple[bool, float | None]:
    """Whether an element is left out anyway, and the share of words that spares it if it is marked."""
    if name in LEFT_OUT:
        return True, None
    if name in ("html", "body", "main", "article"):
        return False, None
    if name == "header":
        return not parent.in_article, None
    found = {k.lower(): (v or "").strip("\"'") for k, v in ATTRIBUTE.findall(tag[1 + len(name):])}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true":
        return True, None
    if re.search(r"display\s*:\s*none", found.get("style", "")):
        return True, None
    marks = set().union(*(_marks(t) for a in ("class", "id", "role") for t in found.get(a, "").split()))
    if name == "form":
        marks.add("form")
    return False, (MOST_REPLIES if marks & REPLIES else MOST) if marks else None


def _marks(token: str) -> set[str]:
    parts = {p.lower() for p in PARTS.split(token) if p and not p.isdigit()}
    return parts & MARKS if parts <= MARKS | LAYOUT else set()


def _spare(nodes: list[Node], found: list[Token]) -> None:
    """Take the marks off elements that hold most of the page's unlinked words, and settle what is left out.

    Parents come before their children in `nodes`.
    """
    for node in nodes:
        node.gone = node.left_out or (node.parent is not None and node.parent.gone)
    for t in found:
        if t.text is not None and not t.node.gone and not t.node.linked:
            t.node.words += len(t.text.split())
    for node in reversed(nodes):
        if node.parent is not None:
            node.parent.words += node.words
    for node in nodes:
        if node.marked is not None and node.words > node.marked * nodes[0].words:
            node.marked = None
    for node in nodes:
        node.dropped = node.gone or node.marked is not None or (
            node.parent is not None and node.parent.dropped)


class Open:
    """How many elements of a name are open, and how many of them in a scope."""

    def __init__(self) -> None:
        self.named: Counter = Counter()
        self.scoped: Counter = Counter()

    def add(self, node: Node, by: int = 1) -> None:
        self.named[node.name] += by
        if node.parent is not None:
            self.scoped[node.name, id(node.parent.scope)] += by

    def leave(self, node: Node, to: Node) -> Node:
        """Close all elements from one up to below another; each is closed once."""
        while node is not to:
            self.add(node, -1)
            node = node.parent
        return to


@functools.cache
def _end_of_raw(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?=[\s/>]|$)", re.I | re.A)


def tokens(page: str) -> list[Token]:
    out: list[Token] = []
    node = Node("", None, False)
    nodes = [node]
    opened = Open()
    at = 0
    while at < len(page):
        piece = TOKEN.match(page, at).group()
        at += len(piece)
        tag = NAME.match(piece) if piece.startswith("<") else None
        name = tag.group(1).lower() if tag else ""
        if piece.startswith("<!") or piece.startswith("<?"):
            if piece.startswith("<![CDATA["):
                out.append(Token(piece[9:].removesuffix("]]>"), node.name, node, False))
            continue
        if tag is None:
            out.append(Token(html.unescape(piece), node.name, node, False))
            continue
        breaks = name in BLOCKS
        if piece.startswith("</"):
            if opened.named[name] > 0:
                found = node
                while found.name != name:
                    found = found.parent
                node = opened.leave(node, found.parent)
            elif not breaks:
                continue
        else:
            node = opened.leave(node, _ended(node, name, opened))
            if name in ("article", "main"):
                above = node
                while above is not None and not above.spared:
                    above.left_out, above.marked, above.spared = False, None, True
                    above = above.parent
            child = Node(name, node, *_left_out(name, piece, node))
            nodes.append(child)
            if name not in VOID and not piece.endswith("/>"):
                node = child
                opened.add(child)
                if name in RAW:  # no tags inside
                    end = _end_of_raw(name).search(page, at)
                    at = end.start() if end else len(page)
        if name in CELLS:
            out.append(Token(" ", node.name, node, False))
        out.append(Token(None, name, node, breaks))
    _spare(nodes, out)
    return out


def _ended(node: Node, name: str, opened: Open) -> Node:
    """The element that stays open when a tag of this name opens."""
    ends = ENDS.get(name, set()) | ({"p"} if name in BLOCKS else set())
    if name in BLOCKS and name not in ("html", "head"):
        ends = ends | {"head"}
    scope = node.scope
    if scope.name not in ends and not any(opened.scoped[e, id(scope)] > 0 for e in ends):
        return node
    found = node
    while found.parent is not None and (found.name in ends or found.name not in SCOPES):
        if found.name in ends:
            return found.parent
        found = found.parent
    return node


# --- Weights ---------------------------------------------------------------------------------------

# Labelled pages: page, and which of its words are content.
LABELLED: Sequence[tuple[str, str]] = (
    ("<body><div><a href=x>Home</a> <a href=y>World</a> <a href=z>Sport</a></div><div><h1>Rain in the "
     "valley</h1><p>It rained for three days and the <a href=r>river</a> rose.</p><p>Nobody was hurt, "
     "the mayor said.</p><ul><li>Roads are open.</li></ul></div><div><a href=p>Privacy</a> | <a "
     "href=t>Terms</a></div></body>",
     "Rain in the valley It rained for three days and the river rose. Nobody was hurt, the mayor said. "
     "Roads are open."),
    ("<body><table><tr><td><a href=1>News</a></td><td><a href=2>Weather</a></td></tr></table><div><h1>"
     "How to bake bread</h1><p>Mix flour, <b>water</b> and salt.<br>Wait for one hour.</p><h2>Oven</h2>"
     "<p>Bake until it is brown and sounds hollow.</p></div><ul><li><a href=3>Older</a></li><li><a "
     "href=4>Newer</a></li></ul></body>",
     "How to bake bread Mix flour, water and salt. Wait for one hour. Oven Bake until it is brown and "
     "sounds hollow."),
    ("<body><ul><li><a href=a>Start</a></li><li><a href=b>Shop</a></li><li><a href=c>Help</a></li></ul>"
     "<div><p><i>By a reader.</i></p><p>The old bridge was closed in spring, and walkers must take the "
     "long way round.</p><blockquote>We waited for years.</blockquote><p>It opens again in May.</p></div>"
     "<div><span>Copyright</span> <a href=d>Contact</a> <a href=e>Jobs</a></div></body>",
     "By a reader. The old bridge was closed in spring, and walkers must take the long way round. We "
     "waited for years. It opens again in May."),
)


@dataclass(frozen=True)
class Weights:
    word: float
    linked: float  # a word inside a link
    tags: dict[str, float]
    other: float  # a tag that the labelled pages do not have
    marked: float = -0.1  # a word of a marked part; the labelled pages have none


def fit(labelled: Sequence[tuple[str, str]] = LABELLED) -> Weights:
    """Log odds of standing inside the content, by kind of token. Words are bounded below and tags
    above, so that one word outweighs the tags of a short paragraph."""
    inside, outside = Counter(), Counter()
    for page, content in labelled:
        found = tokens(page)
        wanted, spans, at = content.split(), [], 0
        for i, t in enumerate(found):
            words = (t.text or "").split()
            if words and wanted[at:at + len(words)] == words:
                at += len(words)
                spans.append(i)
        if at < len(wanted):
            raise ValueError("a labelled page lacks its content")
        for i, t in enumerate(found):
            count = inside if spans[0] <= i <= spans[-1] else outside
            kind = f"<{t.tag}>" if t.text is None else "link" if t.node.linked else "word"
            count[kind] += 1 if t.text is None else len(t.text.split())

    def odds(kind: str) -> float:
        return math.log((inside[kind] + 0.5) / (outside[kind] + 0.5))

    tags = {k[1:-1]: min(-0.02, max(-2.0, 0.1 * odds(k) - 0.1))
            for k in inside.keys() | outside.keys() if k.startswith("<")}
    return Weights(max(1.0, odds("word")), min(0.5, odds("link")), tags, -0.1)


def region(found: Sequence[Token], weights: Weights) -> tuple[int, int]:
    """First token and the one behind the last of the run with the highest sum."""
    best, best_span, total, start = 0.0, (0, 0), 0.0, 0
    for i, t in enumerate(found):
        if t.node.gone or (t.node.dropped and t.text is None):
            continue
        if t.node.dropped:
            total += len(t.text.split()) * weights.marked
        elif t.text is None:
            total += weights.tags.get(t.tag, weights.other)
        else:
            total += len(t.text.split()) * (weights.linked if t.node.linked else weights.word)
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, best_span = total, (start, i + 1)
    return best_span


def extract(page: str | None, weights: Weights) -> str:
    found = tokens(page or "")
    first, behind = region(found, weights)
    # Words at the edge of the run belong to whole blocks.
    while first > 0 and first < behind and not found[first - 1].breaks:
        first -= 1
    while first < behind < len(found) and not found[behind].breaks:
        behind += 1
    blocks, parts = [], []
    for t in found[first:behind]:
        if t.breaks:
            blocks.append(" ".join("".join(parts).split()))
            parts = []
        if t.text is not None and not t.node.dropped:
            parts.append(t.text)
    blocks.append(" ".join("".join(parts).split()))
    return "\n\n".join(b for b in blocks if b)


def extracted(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """page_id, url, text of every page."""
    learned = weights or fit()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays(
                    [part["page_id"], part["url"],
                     pa.array([extract(p, learned) for p in part["html"].to_pylist()], pa.string())],
                    names=["page_id", "url", "text"])

    return small_batches(pages).select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(
        run, "page_id long, url string, text string")
