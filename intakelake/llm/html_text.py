"""Main text of a web page by composite text density.

The page is read into a tree. Each node has its characters C, its tags T, and of both those in links
(LC, LT; at least 1 each as divisors). With LCb and Cb of the body, its density is

    C / T * log(C * T / (LC * LT)) / log(ln(C * LC / (C - LC) + LCb * C / Cb + e))

characters for each tag, cut down the more of them are links. The density sum of a node adds up its
children's. The node with the largest sum is the centre of the text; the least density on its path from
the body is the threshold: an ancestor below the body takes the centre's place while it has other
children that reach the threshold with few links, or is the article itself. Its whole text is the result.

Elements that never hold main text (menus, forms, scripts, adverts, comments ...) are left out before
anything is counted, by tag or role, or by a class or id all of whose words say so (``comments-list``, not
``with-comments``). Names count for blocks alone, in an article's paragraphs only those of adverts, and
never for what holds the article; on a page without one they do not count either for an element beside which
next to nothing is left. A page is read in time proportional to its length. Character references are decoded; white space in a
block becomes one space; blocks are joined by one space.

Defined cases: a null or empty page, or one without text, gives an empty text; unclosed tags end with
their parents; what is not a tag is text; repeated rows are extracted each; extra columns are not read.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_pass, plus

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: Elements without main text.
APART = frozenset(
    "head script style noscript template nav footer aside form button select option textarea input iframe object embed svg canvas dialog menu audio video map".split())
APART_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
#: Words of a class or id that mark such an element.
ADVERT_NAMES = frozenset("ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion".split())
APART_NAMES = ADVERT_NAMES | frozenset(
    "banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login sidebar sidenav menu nav navbar navigation breadcrumb "
    "breadcrumbs footer masthead comment comments commentlist disqus respond reply replies discussion share sharing social related recommended toolbar pagination pager skip".split())
#: Words that may stand beside them in a name without changing what it says.
GLUE_NAMES = frozenset(
    "area bar block bottom box button buttons center column container content count entry entries fixed form global google group header heading inner item items left link links list main "
    "outer page panel post posts article articles primary reader readers right row secondary section site slot stories story sub the title top unit user users widget widgets wrap wrapper".split())
#: Only outside an article.
OUTER = frozenset(["header"])
ARTICLE = frozenset(["article", "main"])
#: Elements whose class or id says nothing.
NAMELESS = frozenset("html body article main h1 h2 h3 h4 h5 h6".split()) | INLINE
#: An element keeps its text in spite of its name where it has this many times the text outside such elements.
ALONE = 10
#: Start tags that end an open element of these kinds.
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS |= {t: {"p"} for t in "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split()}
#: An open element is not ended across these.
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}
HOLDS = frozenset("html body article section div td th table button object main aside nav header footer form li dd blockquote".split())
#: End tags that do not reach beyond the nearest of these.
SHORT = INLINE | {"p"}
UNCLOSED = HOLDS | SHORT
TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden|style)(?=[\s=/]|$)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
WORD = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("tag", "parent", "parts", "apart", "named", "link", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, apart: bool, named: bool, link: bool):
        self.tag, self.parent, self.apart, self.named, self.link = tag, parent, apart, named, link
        self.parts: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def name_says(value: str, wanted: frozenset[str]) -> bool:
    """Whether one of the names in a class or id is made of such words, and of others that change nothing."""
    for name in value.split():
        words = WORD.findall(name)
        if not wanted.isdisjoint(words) and all(w in APART_NAMES or w in GLUE_NAMES for w in words):
            return True
    return False


def stands_apart(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """Whether an element holds no main text, and whether its name says that it does not."""
    if tag in APART or tag in OUTER and not in_article:
        return True, False
    if not attributes or tag in ("html", "body", "article", "main"):
        return False, False
    named = False
    wanted = ADVERT_NAMES if tag == "p" and in_article else APART_NAMES if in_article else APART_NAMES | OUTER
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id"):
            named = named or tag not in NAMELESS and name_says(value, wanted)
        elif name == "role" and value in APART_ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True, named
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True, named
    return False, named


class Open:
    """The open elements, and where those of each tag are, so that none is looked for along the stack."""

    def __init__(self, root: Node) -> None:
        self.stack, self.at, self.holds, self.articles = [root], {}, [0], 0

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in HOLDS:
            self.holds.append(len(self.stack))
        self.stack.append(node)
        self.articles += node.tag in ARTICLE

    def close(self, upto: int) -> None:
        while len(self.stack) > upto:
            node = self.stack.pop()
            self.at[node.tag].pop()
            if node.tag in HOLDS:
                self.holds.pop()
            self.articles -= node.tag in ARTICLE

    def nearest(self, tags) -> int:
        """Place of the innermost open element of these tags; 0 if there is none."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def end(self, tag: str) -> None:
        at = self.nearest((tag,))
        if at and (tag not in SHORT or at >= self.holds[-1]):
            self.close(at)

    def begin(self, tag: str) -> None:
        """End what the start of an element of this tag ends."""
        scope = SCOPE.get(tag)
        while True:
            at = self.nearest(ENDS[tag])
            if not at or at < (self.holds[-1] if scope is None else self.nearest(scope)):
                return
            self.close(at)
            if tag != "tr":
                return


def parse(page: str) -> list[Node]:
    """The nodes of the page in order of their start; the first is the root."""
    root = Node("", None, False, False, False)
    nodes, open_, at, end = [root], Open(root), 0, len(page)
    last = page.rfind(">") + 1  # no tag ends behind it
    while at < end:
        m = TOKEN.search(page, at, last) if at < last else None
        above = open_.stack[-1]
        if m is None:
            above.parts.append(html.unescape(page[at:]))
            break
        if m.start() > at:
            above.parts.append(html.unescape(page[at : m.start()]))
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            if m[0].startswith("<!--") and not m[0].endswith(">"):
                break  # a comment without an end
            continue
        tag, attributes = tag.lower(), m[3] or m[6] or ""
        if m[1] or m[4]:
            open_.end(tag)
            continue
        if tag in ENDS:
            open_.begin(tag)
        above = open_.stack[-1]
        apart, named = stands_apart(tag, attributes, open_.articles > 0)
        node = Node(tag, above, above.apart or apart, named, above.link or tag == "a")
        above.parts.append(node)
        nodes.append(node)
        if tag in VOID or attributes.endswith("/") and tag not in UNCLOSED:
            continue
        if tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            node.parts.append(html.unescape(page[at : stop.start() if stop else end]))
            at = stop.end() if stop else end
            continue
        open_.push(node)
    return nodes


def settle(nodes: list[Node]) -> None:
    """Leave out the elements whose names say so, with all below them."""
    if any(n.named for n in nodes):
        above: set[int] = set()  # elements that hold an article
        for n in reversed(nodes):
            if not n.apart and n.parent is not None and (n.tag in ARTICLE or id(n) in above):
                above.add(id(n.parent))
        for n in nodes:
            n.named = n.named and id(n) not in above
        if not above:
            tops: dict[int, Node] = {}  # the outermost named element of each node below one
            outside, inside = 0, {}
            for n in nodes:
                top = n if n.named and id(n.parent) not in tops else tops.get(id(n.parent))
                if n.apart:
                    continue
                size = sum(len(x.strip()) for x in n.parts if x.__class__ is str)
                if top is None:
                    outside += size
                else:
                    tops[id(n)] = top
                    inside[id(top)] = inside.get(id(top), 0) + size
            for n in nodes:
                if id(n) in inside and inside[id(n)] > outside * ALONE:
                    n.named = inside[id(n)] < max(inside.values())
        for n in nodes:
            n.apart = n.apart or n.named or n.parent is not None and n.parent.apart


def weigh(nodes: list[Node]) -> Node:
    """Count, compute densities and their sums; returns the body, or else the root."""
    for n in nodes:
        n.chars = n.tags = n.link_chars = n.link_tags = 0
        n.density = n.total = 0.0
    for n in reversed(nodes):
        if n.apart:
            continue
        n.chars += sum(len(" ".join(x.split())) for x in n.parts if x.__class__ is str)
        if n.link:
            n.link_chars = n.chars
        up = n.parent
        if up is not None:
            up.chars += n.chars
            up.tags += n.tags + 1
            up.link_chars += 0 if up.link else n.link_chars
            up.link_tags += n.link_tags + (n.tag == "a")
    body = next((n for n in nodes if n.tag == "body"), nodes[0])
    share = body.link_chars / max(body.chars, 1)
    for n in nodes:
        if n.chars and not n.apart:
            tags, link_chars, link_tags = max(n.tags, 1), max(n.link_chars, 1), max(n.link_tags, 1)
            spread = math.log(n.chars * n.link_chars / max(n.chars - n.link_chars, 1) + share * n.chars + math.e)
            n.density = n.chars / tags * math.log(max(n.chars / link_chars * tags / link_tags, 1.0)) / max(math.log(spread), 0.1)
            if n.parent is not None:
                n.parent.total += n.density
    return body


def centre(nodes: list[Node], body: Node) -> Node:
    """The subtree that holds the main text."""
    best = body
    for n in nodes:
        if n.total > best.total and not n.apart and n.tag not in INLINE and n.tag not in ("", "html"):
            best = n
    path, n = [], best
    while n is not None and n is not body:
        path.append(n)
        n = n.parent
    least = min((x.density for x in [*path, body] if x.density > 0), default=0.0)
    chosen = best
    for up in path[1:]:
        others = [x for x in up.parts if x.__class__ is Node and not x.apart and x.density >= least > 0 and 3 * x.link_chars < x.chars]
        if up.tag in ARTICLE or len(others) > 1:
            chosen = up
    return chosen


def text_of(node: Node) -> str:
    """Blocks of the subtree in page order."""
    blocks: list[str] = []
    buffer: list[str] = []

    def flush() -> None:
        if buffer:
            blocks.append(" ".join("".join(buffer).split()))
            buffer.clear()

    stack: list[Node | str | None] = [node]
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif x.__class__ is str:
            buffer.append(x)
        elif not x.apart:
            if x.tag not in INLINE:
                flush()
                stack.append(None)
            stack.extend(reversed(x.parts))
    flush()
    return " ".join(b for b in blocks if b)


def main_text(page: str) -> str:
    if not page:
        return ""
    nodes = parse(page)
    settle(nodes)
    return text_of(centre(nodes, weigh(nodes)))


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    pages = pages.select("page_id", "url", "html")
    schema = plus(pages.drop("html"), text="string", n_chars="long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x or "") for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema.names)

    return arrow_pass(pages, run, schema)
