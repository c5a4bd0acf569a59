"""Main text of web pages by tree scoring.

The page becomes a tree (unclosed paragraphs, items and cells end where the next block begins; stray end tags are
ignored). Elements that are no article text are left out: scripts, styles, menus, forms, asides, footers, page
headers, hidden ones, and those whose class, id or role names one of ``UNLIKELY``. Each remaining paragraph gives
points for its length and its commas to its ancestors, less with each level; an element's points count by the share
of its text that is not link text. The best container, or the article or main element around it, is kept, and those
of its siblings that score near it or are running text. If nothing scores, the article, main or body element is kept.

Of what is kept nothing is dropped or capped: character references are decoded, white space within a block becomes
one space, blocks are trimmed and joined by a line feed. Null or empty html, or a page without text, gives "".
Repeated rows each get a row; only page_id, url and html are read. An empty table gives no rows. Time is in proportion to
the page, however its tags are nested or left open.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, lean

# Element and attribute names of HTML.
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes", "template")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
DROPPED = frozenset("script style noscript template head title nav footer aside form button select option textarea input iframe object embed svg canvas audio video map dialog menu datalist label".split())
PARAGRAPH = frozenset("p pre td blockquote li dd h2 h3 h4".split())
UNLIKELY = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies discussion disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promotion promoted recommended related replies reply responses rss search share sharing sidebar skip social sponsor sponsored subscribe subscription tags teaser toolbar widget".split()
)
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation note search toolbar".split())

#: A start tag of these ends an open element of the same group.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "tbody": ("tbody", "thead", "tr", "td", "th"), "option": ("option",)}
_WALLS = frozenset("table ul ol dl select article section div main body html td th blockquote".split())
_BLOCKS = "<blocks>"  # no tag's name
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^'"<>]++|<(?![a-zA-Z/!?])|"[^"]*+"|'[^']*+')*+)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in RAW}


class Node:
    __slots__ = ("commas", "dropped", "inner", "link", "parent", "parts", "points", "size", "tag")

    def __init__(self, tag: str, parent: Node | None, dropped: bool):
        self.tag, self.parent, self.dropped = tag, parent, dropped
        self.parts: list = []
        self.points = 0.0
        self.size = self.link = self.commas = 0
        self.inner = False


def _unlikely(tag: str, attributes: str, within: set) -> bool:
    if tag in DROPPED or tag == "header" and not within & {"article", "main"}:
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    found = {k.lower(): (v[1:-1] if v[:1] in ('"', "'") else v) for k, v in _ATTRIBUTE.findall(attributes)}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", ""), re.I):
        return True
    if found.get("role", "").lower() in ROLES:
        return True
    return any(x.lower() in UNLIKELY for x in _NAMES.findall(found.get("class", "") + " " + found.get("id", "")))


def parse(html: str) -> Node:
    root = Node("html", None, False)
    stack = [root]
    where: dict[str, list[int]] = {}  # the places in the stack of each open tag, and of all blocks; so no walk is needed to find one
    at, last = 0, html.rfind(">") + 1  # nothing beyond that is a tag

    def text(a: int, b: int) -> None:
        if a < b and not stack[-1].dropped:
            stack[-1].parts.append(unescape(html[a:b]))

    def top(names) -> int:
        return max((where[x][-1] for x in names if where.get(x)), default=0)

    def put(node: Node) -> None:
        where.setdefault(node.tag, []).append(len(stack))
        if node.tag in BLOCK:
            where.setdefault(_BLOCKS, []).append(len(stack))
        stack.append(node)

    def end(names: tuple, walls) -> None:
        """Closes the innermost element of these names, unless one of the walls stands within it."""
        i = top(names)
        if i and i >= top(walls):
            for node in stack[i:]:
                where[node.tag].pop()
                if node.tag in BLOCK:
                    where[_BLOCKS].pop()
            del stack[i:]

    while m := _TOKEN.search(html, at, last):
        text(at, m.start())
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            if m[0].startswith("<!--") and not (len(m[0]) > 6 and m[0].endswith("-->")) or m[0].startswith("<![CDATA[") and not m[0].endswith("]]>"):
                m_end, at = at, len(html)  # never closed: all the rest
                if m[0].startswith("<![CDATA[") and not stack[-1].dropped:
                    stack[-1].parts.append(m[0][9:] + html[m_end:])
            elif m[0].startswith("<![CDATA[") and not stack[-1].dropped:
                stack[-1].parts.append(m[0][9:].removesuffix("]]>"))
            continue
        if m[1]:
            if tag in BLOCK:
                end((tag,), ("td", "th") if tag in ("p", "div", "li", "ul", "ol") else ())
            elif tag not in VOID:
                end((tag,), (_BLOCKS,))
            continue
        if tag in _ENDS:
            end(_ENDS[tag], _WALLS - set(_ENDS[tag]))
        if tag in BLOCK:
            end(("p",), _WALLS)
            if tag[0] == "h" and tag[1:].isdigit():
                end(("h1", "h2", "h3", "h4", "h5", "h6"), _WALLS)
        if tag == "html" or tag == "body" and where.get(tag):
            continue
        node = Node(tag, stack[-1], stack[-1].dropped or _unlikely(tag, m[3], {x for x in ("article", "main") if where.get(x)}))
        if tag == "br":
            stack[-1].parts.append(" ")
        elif tag in RAW:
            close = _RAW_END[tag].search(html, at, max(at, last))
            at = close.end() if close else len(html)
        elif tag not in VOID:
            if not node.dropped:
                stack[-1].parts.append(node)
            if not m[3].endswith("/") or tag in BLOCK:
                put(node)
        elif tag == "hr":
            stack[-1].parts.append(node)
    text(at, len(html))
    return root


def _ordered(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [x for x in reversed(node.parts) if isinstance(x, Node)]
    return out


def score(nodes: list[Node]) -> None:
    """Sizes, link text and points of every node of a tree, given in page order."""
    for node in reversed(nodes):
        for x in node.parts:
            if isinstance(x, Node):
                node.size += x.size
                node.link += x.link
                node.commas += x.commas
                node.inner |= x.inner or x.tag in BLOCK
            else:
                node.size += len(x)
                node.commas += x.count(",")
        if node.tag == "a":
            node.link = node.size
    for node in nodes:
        if node.parent is None or node.size < 25 or not (node.tag in PARAGRAPH or node.tag in BLOCK and not node.inner):
            continue
        points = (1 + node.commas + min(node.size // 100, 3)) * (1 - node.link / node.size)
        level, above = 1, node.parent
        while above is not None and level <= 4:
            above.points += points / level if level < 3 else points / (3 * level)
            level, above = level + 1, above.parent
    bonus = {"article": 25, "main": 15, "section": 5, "div": 5, "pre": 3, "td": 3, "blockquote": 3, "ul": -3, "ol": -3, "dl": -3, "li": -3, "h1": -5, "h2": -5, "h3": -5, "th": -5}
    for node in nodes:
        if node.points:
            node.points = (node.points + bonus.get(node.tag, 0)) * (1 - node.link / max(node.size, 1))


def chosen(nodes: list[Node]) -> list[Node]:
    """The nodes that hold the article, in page order."""
    scored = [x for x in nodes if x.points > 0]
    if not scored:
        for tag in ("article", "main", "body"):
            if own := [x for x in nodes if x.tag == tag and x.size]:
                return [max(own, key=lambda x: x.size)]
        return nodes[:1]
    best = max(scored, key=lambda x: x.points)
    above = best
    while above is not None:
        if above.tag in ("article", "main"):
            best = above
            break
        above = above.parent
    if best.parent is None or best.tag == "body":
        return [best]
    out = []
    for x in best.parent.parts:
        if x is best:
            out.append(x)
        elif isinstance(x, Node) and x.size:
            density = x.link / x.size
            if x.points >= max(10, 0.2 * best.points) or best.tag not in ("article", "main") and (x.tag == "p" and x.size > 80 and density < 0.25 or x.tag in ("h1", "h2") and not density):
                out.append(x)
    return out


def blocks(node: Node) -> list[str]:
    out: list[str] = []
    line: list[str] = []

    def close() -> None:
        if line:
            if text := " ".join("".join(line).split()):
                out.append(text)
            line.clear()

    todo: list = [node]
    while todo:
        x = todo.pop()
        if x is None:
            close()
        elif isinstance(x, str):
            line.append(x)
        elif x.tag in BLOCK:
            close()
            todo.append(None)
            todo += reversed(x.parts)
        else:
            todo += reversed(x.parts)
    close()
    return out


def main_text(html: str | None) -> str:
    if not html:
        return ""
    nodes = _ordered(parse(html))
    score(nodes)
    return "\n".join(b for node in chosen(nodes) for b in blocks(node))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages``."""

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in byte_slices(batch, 2, 4_000_000)):
            texts = [main_text(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(lean("html", extracted), "page_id long, url string, text string, n_chars long")
