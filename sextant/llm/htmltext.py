"""Main text of HTML pages by composite text density.

Each node's density is its characters for each tag, lowered where much of it is link text. Every node's density sum is
that of its children. Starting at the body, the node of the largest density is found; its path to the body gives the
threshold (the smallest density on the way), and of the nodes that reach the threshold the one with the largest density
sum is the main subtree. It is widened to its parent while what stands beside it is of its own kind: sections like it,
headings and paragraphs. Parts that are never article text (scripts, menus, forms, notices, comments and the like) are
taken out before, by tag, role and class; a class or id takes out only what isn't most of the page's plain text.

Parsing is one pass forward, and every later step visits each node once: time grows with the page, however deep it is
nested and whatever it leaves open.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import slices

#: One attribute. A value is quoted only right after the equals sign, and only if the quote is closed somewhere.
_ATTR = re.compile(r"""(=[^\s/>=]*+|[^\s/>=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?+""")
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|(?:=[^\s/>=]*+|[^\s/>=]++)(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))?+)*+)>""")
_RAW = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in ("script", "style", "textarea", "title", "xmp", "iframe")}
_COMMENT_END = re.compile(r"--!?>")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SKIP = frozenset("nav footer aside form button select option input textarea title script style noscript template iframe object svg canvas dialog menu head audio video".split())
_BLOCK = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address details summary hr header footer nav aside form fieldset center hgroup search".split()
)
_CLOSES_P = _BLOCK - {"html", "body", "td", "th", "tr", "thead", "tbody", "tfoot", "caption"}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks of text that may stand beside the main subtree and belong to it.
_PROSE = _HEADINGS | frozenset("p ul ol dl blockquote pre figure table hr address details hgroup header".split())
_INLINE = frozenset("a b i em strong span br small sub sup code u s q cite abbr mark font label time".split())
_TEXTUAL = _PROSE | _INLINE
#: Elements that end at the start of the next of their group, unless an element of the second set lies between.
_GROUPS = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"})}
_ROWS = {"td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",), "thead": ("thead", "tbody", "tfoot", "tr"), "tbody": ("thead", "tbody", "tfoot", "tr"), "tfoot": ("thead", "tbody", "tfoot", "tr")}
_TABLE = frozenset([*_ROWS, "table"])
_IN_HEAD = frozenset("base basefont bgsound link meta title script style noscript template".split())
_HINT = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert(?:s|isement|ising)?|adsbygoogle|banner|sponsor(?:ed|s)?|promo(?:tion)?s?|nav|navbar|navigation|menus?|breadcrumbs?|sidebars?|side-?bar|rail|widgets?|footer|header|masthead|topbar|cookies?|consent|gdpr|notices?|alerts?|popups?|modal|overlay|subscribe|newsletter|signup|login|share|sharing|social|related|recommended|recirc|outbrain|taboola|pagination|pager|comments?|commentlist|disqus|respond|replies|reply|toolbar|skip|hidden|legal|copyright|tags)(?:$|[\s_-])",
    re.I,
)
#: Names that as a whole word of a class or id are no part of a layout's name.
_ADVERT = re.compile(r"(?:^|(?<=\s))(?:ads?|advert(?:s|isement|ising)?|adsbygoogle|sponsor(?:ed|s)?|promo(?:tion)?s?|cookies?|cookie-(?:notice|banner|consent)|consent|gdpr|popups?|newsletter|outbrain|taboola)(?=$|\s)", re.I)
_COMMENT = re.compile(r"comment|disqus|respond|repl(?:y|ies)", re.I)
#: Names that say how a page is laid out, not what a node is.
_STATE = re.compile(r"(?:^|(?<=\s))(?:has|have|no|not|with|without)-\S+|(?:^|(?<=[\s_-]))comments?-(?:open|closed|on|off|enabled|disabled)(?=$|\s)", re.I)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_SPACE = re.compile(r"[\s ]+")


class Node:
    """An element. skip: 0 kept, 1 never article text, 2 taken out by a name that may also stand on the frame around an article, 3 by a name of adverts and the like."""

    __slots__ = ("tag", "names", "href", "parent", "depth", "same", "saved", "inside", "cleared", "children", "skip", "chars", "links", "tags", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, attrs: str = ""):
        self.tag, self.parent, self.same, self.saved, self.cleared = tag, parent, None, None, False
        self.depth = parent.depth + 1 if parent else 0
        self.inside = bool(parent and parent.inside) or tag in ("article", "main")
        self.names, self.href, self.skip = "", tag == "a" and not attrs, 0
        self.children: list[Node | str] = []  # in page order
        self._judge(attrs)

    def _judge(self, attrs: str) -> None:
        tag = self.tag
        if tag in _SKIP or (tag == "header" and not (self.parent and self.parent.inside)):
            self.skip = 1
        if not attrs or self.skip or tag in ("html", "body", "head"):
            return
        found = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in reversed(list(_ATTR.finditer(attrs)))}
        self.href = tag == "a" and "href" in found
        self.names = (found.get("class", "") + " " + found.get("id", "")).strip()
        if found.get("role", "").lower() in _ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", ""), re.I):
            self.skip = 1
            return
        names = _STATE.sub(" ", self.names)
        if tag in ("article", "main"):
            self.skip = int(bool(_COMMENT.search(names)))
        elif _HINT.search(names):
            self.skip = 1 if _COMMENT.search(names) else 3 if _ADVERT.search(names) else 2


class _Tree:
    """Open elements. For each tag the innermost open one is known (`same` leads on to the next), so no step searches the path."""

    def __init__(self):
        self.root = self.node = Node("html", None)
        self.flow: dict[str, Node | None] = {}  # open elements of the innermost table cell, or outside of any
        self.rows: dict[str, Node | None] = {}  # open parts of tables
        self.body: Node | None = None

    def open(self, tag: str, attrs: str) -> Node:
        new = Node(tag, self.node, attrs)
        self.node.children.append(new)
        if tag in ("article", "main") and not new.skip:
            up = new.parent
            while up is not None and not up.cleared:
                up.skip, up.cleared = int(up.skip == 1), True
                up = up.parent
        return new

    def enter(self, new: Node) -> None:
        where = self.rows if new.tag in _TABLE else self.flow
        new.same, where[new.tag] = where.get(new.tag), new
        if new.tag in ("td", "th"):
            new.saved, self.flow = self.flow, {}
        self.node = new

    def close(self, to: Node) -> None:
        """Close all open elements up to `to`."""
        while True:
            n = self.node
            self.node = n.parent
            if n.saved is not None:
                self.flow = n.saved
            (self.rows if n.tag in _TABLE else self.flow)[n.tag] = n.same
            if n is to:
                return

    def table(self) -> int:
        table = self.rows.get("table")
        return table.depth if table else 0

    def start(self, tag: str, attrs: str, alone: bool) -> None:
        if tag == "html" or (tag == "body" and self.body):
            return
        head = self.flow.get("head")
        if head and tag not in _IN_HEAD:
            self.close(head)
        if tag in _CLOSES_P and (p := self.flow.get("p")):
            self.close(p)
        if tag in _HEADINGS and self.node.tag in _HEADINGS:
            self.close(self.node)
        if tag in _GROUPS:
            names, stops = _GROUPS[tag]
            stop = max((n.depth for s in stops if (n := self.flow.get(s))), default=0)
            for name in names:
                if (n := self.flow.get(name)) and n.depth > stop:
                    self.close(n)
        if tag in _ROWS:
            frame = self.table()
            if tag in ("td", "th") and (row := self.rows.get("tr")):
                frame = max(frame, row.depth)
            first = [n for name in _ROWS[tag] if (n := self.rows.get(name)) and n.depth > frame]
            if first:
                self.close(min(first, key=lambda n: n.depth))
        new = self.open(tag, attrs)
        if tag == "body":
            self.body = new
        if tag not in _VOID and not alone:
            self.enter(new)

    def end(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        if tag in _TABLE:
            n = self.rows.get(tag)
            if n and (tag == "table" or n.depth > self.table()):
                self.close(n)
        elif n := self.flow.get(tag):
            self.close(n)
        elif tag == "p":
            self.open("p", "")

    def text(self, text: str) -> None:
        head = self.flow.get("head")
        if head and self.node is head and text.strip():
            self.close(head)
        self.node.children.append(text)


def _alone(attrs: str) -> bool:
    """Whether a tag ends in a slash that belongs to no value."""
    if not attrs.endswith("/"):
        return False
    last = 0
    for m in _ATTR.finditer(attrs):
        last = m.end()
    return last < len(attrs)


def parse(page: str) -> Node:
    """Lenient tree of a page; never fails, closes what is left open, ignores ends without a start."""
    tree, at, n, text = _Tree(), 0, len(page), 0

    def flush(to: int) -> None:
        if to > text:
            tree.text(page[text:to])

    while True:
        at = page.find("<", at)
        if at < 0 or at + 1 >= n:
            break
        c = page[at + 1]
        if c in "!?" or (c == "/" and at + 2 < n and not (page[at + 2].isascii() and page[at + 2].isalpha())):
            flush(at)
            if page.startswith("<!--", at):
                if page.startswith((">", "->"), at + 4):
                    text = at = page.index(">", at + 4) + 1
                    continue
                m = _COMMENT_END.search(page, at + 4)
                text = at = m.end() if m else n
            elif page.startswith("<![CDATA[", at):
                to = page.find("]]>", at)
                tree.text(html.escape(page[at + 9 : to if to >= 0 else n]))
                text = at = to + 3 if to >= 0 else n
            else:
                to = page.find(">", at)
                text = at = to + 1 if to >= 0 else n
            continue
        m = _TAG.match(page, at)
        if m is None:
            if c.isascii() and (c.isalpha() or c == "/"):  # a tag that is never closed takes the rest with it
                flush(at)
                text = n
                break
            at += 1
            continue
        flush(at)
        text = at = m.end()
        tag = m[2].lower()
        if m[1]:
            tree.end(tag)
            continue
        tree.start(tag, m[3], _alone(m[3]))
        if tag in _RAW:
            end = _RAW[tag].search(page, at)
            inner = page[at : end.start()] if end else page[at:]
            tree.node.children.append(inner)
            text = at = end.start() if end else n
    flush(n)
    _judge_hints(tree.root)
    return tree.root


def _size(text: str) -> int:
    return len("".join(text.split()))


def _judge_hints(root: Node) -> None:
    """A hint by name stands only against nodes that are link-heavy or hold less than half of the page's plain text, one of adverts against any; without any text outside of such nodes, both stand only against link-heavy ones."""
    order, todo = [], [root]
    while todo:
        n = todo.pop()
        order.append(n)
        todo += [c for c in n.children if isinstance(c, Node) and c.skip != 1]
    if not any(n.skip > 1 for n in order):
        return

    def measure(n: Node, out: tuple[int, ...]) -> None:
        n.chars = n.links = 0
        for c in n.children:
            if isinstance(c, str):
                n.chars += _size(c)
            elif c.skip not in out:
                n.chars += c.chars
                n.links += c.links
        if n.href:
            n.links = n.chars

    for n in reversed(order):
        measure(n, (1,))
    body = next((n for n in order if n.tag == "body"), root)
    all_plain = body.chars - body.links
    for n in reversed(order):  # links of a wrapper are counted without those of the parts that are taken out of it
        plain = n.chars - n.links
        measure(n, (1, 2, 3))
        if n.skip == 2 and n.chars and 2 * n.links < n.chars and 2 * plain >= all_plain:
            n.skip = 0
    if not any(isinstance(c, str) and c.strip() for n in kept(root) for c in n.children):
        for n in reversed(order):
            measure(n, (1,))
            n.skip *= not (n.chars and 2 * n.links < n.chars)


def kept(root: Node) -> list[Node]:
    """All kept nodes from root down, parents first, in page order."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        out.append(n)
        todo += [c for c in reversed(n.children) if isinstance(c, Node) and not c.skip]
    return out


def measure(root: Node) -> list[Node]:
    """kept(body), with characters, tags, density and density sum of each; without a body, of the root.

    chars and links count characters that aren't white space; links are those inside of links. density is
    chars / tags * log(chars / links * tags / link_tags) / log(base), with
    base = log(chars / plain * links + body links / body chars * chars + e) and divisors and links
    at least 1: the more of a node is link text, the lower. base is at least e, so that link-free pages have one too.
    """
    order = kept(root)
    for n in reversed(order):
        n.chars = n.links = n.tags = n.link_tags = 0
        for c in n.children:
            if isinstance(c, str):
                n.chars += _size(c)
            elif not c.skip:
                n.chars += c.chars
                n.links += c.links
                n.tags += c.tags + 1
                n.link_tags += c.link_tags + c.href
        if n.href:
            n.links = n.chars
    body = next((n for n in order if n.tag == "body"), root)
    order = kept(body)
    share = body.links / max(body.chars, 1)
    for n in order:
        tags, links = max(n.tags, 1), max(n.links, 1)
        base = max(math.log(n.chars / max(n.chars - n.links, 1) * links + share * n.chars + math.e), math.e)
        n.density = n.chars / tags * max(0.0, math.log(max(n.chars, 1) / links * tags / max(n.link_tags, 1))) / math.log(base)
    for n in order:
        n.total = 0.0
        for c in n.children:
            if isinstance(c, str):
                n.total += _size(c) / max(n.tags, 1)
            elif not c.skip:
                n.total += c.density
    return order


def main_subtree(order: list[Node]) -> Node:
    """Node of the largest density sum among those that reach the threshold: the smallest density on the path from the densest node to the body."""
    body = order[0]
    up = max(order, key=lambda n: n.density)
    threshold = up.density
    while up is not body:
        up = up.parent
        threshold = min(threshold, up.density)
    fit = [n for n in order if n.density >= threshold and n.tag not in _INLINE] or [body]
    return max(fit, key=lambda n: n.total)


def _widened(best: Node, body: Node) -> Node:
    """The ancestor of which best is but one of several like it, or that only adds blocks of prose."""
    while best is not body:
        up = best.parent
        for c in up.children:
            if isinstance(c, str):
                if c.strip() and up is body:  # stray text beside the main block
                    return best
            elif c is not best and not c.skip and c.chars:
                alike = best.tag in _TEXTUAL or c.tag in _TEXTUAL or (c.tag == best.tag and c.names == best.names)
                if not alike or 2 * c.links >= c.chars:
                    return best
        best = up
    return best


def main_node(root: Node) -> Node:
    order = measure(root)
    return _widened(main_subtree(order), order[0])


def blocks(node: Node) -> list[str]:
    """Texts of the blocks below node in page order, white space collapsed, empty ones left out."""
    out, now = [], []

    def end() -> None:
        text = _SPACE.sub(" ", html.unescape("".join(now))).strip()
        now.clear()
        if text:
            out.append(text)

    todo: list = [node]
    while todo:
        x = todo.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            now.append(x)
        elif x.skip:
            if x.tag in _BLOCK:
                end()
        elif x.tag == "br":
            now.append(" ")
        else:
            if x.tag in _BLOCK:
                end()
                todo.append(None)
            todo += reversed(x.children)
    end()
    return out


def extract(page: str | None) -> str:
    """Main text of a page; empty for null, empty and textless pages."""
    return "\n\n".join(blocks(main_node(parse(page)))) if page else ""


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row, repeated rows too.

    Null and empty html gives an empty text; null ids and urls stay null. Of subtrees with the same density sum the
    first in the page is taken. An empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            texts = [extract(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
