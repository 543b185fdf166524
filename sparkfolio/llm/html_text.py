"""Layout-aware text of web pages.

A tokeniser feeds a tree builder that knows implied end tags and elements that are not shown; the tree is then walked
once, without recursion, and written as text: blocks apart, lists with bullets, table cells in aligned columns.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterable, Iterator
from html import unescape
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Comments, other markup, and tags as browsers read them: quotes open only right after '=', values without quotes end at
#: white space or '>'.  Nothing is tried twice, so a page takes linear time; the last group is empty where the page ends in a tag.
TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*>?|</(?![a-zA-Z])[^>]+>?|</>"
    r"|<(/?)([a-zA-Z][^ \t\n\r\f/>]*+)((?:[ \t\n\r\f/]++|[^ \t\n\r\f/>][^ \t\n\r\f/>=]*+(?:[ \t\n\r\f]*+=[ \t\n\r\f]*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|(?![\"'])[^ \t\n\r\f>]*+))?+)*+)(>?)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^ \t\n\r\f/>][^ \t\n\r\f/>=]*+)(?:[ \t\n\r\f]*+=[ \t\n\r\f]*+(?:\"([^\"]*+)\"|'([^']*+)'|(?![\"'])([^ \t\n\r\f>]*+)))?+")
BLANKS = re.compile(r"[ \t\n\r\f]+")
UNSHOWN_STYLE = re.compile(r"(?:^|[;\s])display\s*:\s*none", re.I)
#: The last declaration counts.
VISIBILITY = re.compile(r"(?:^|[;\s])visibility\s*:\s*(visible|hidden|collapse)", re.I)

#: Fixed values of HTML: elements without content, with raw content, and never shown.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
UNSHOWN = frozenset("head script style template title noscript noembed noframes iframe object audio video canvas datalist".split())
#: What SVG and MathML hold but never show.
UNSHOWN_SVG = frozenset("title desc defs metadata style script symbol clippath mask marker pattern lineargradient radialgradient filter".split())
UNSHOWN_MATH = frozenset("annotation annotation-xml".split())
#: HTML elements that end an open SVG or MathML, and elements within which HTML goes on.
BREAKS_OUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
HOLDS_HTML = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
#: Formulas whose parts stand apart.
APART = frozenset("mfrac msub msup msubsup munder mover munderover mroot mtr mmultiscripts".split())
#: Blocks with a blank line around them, and blocks on lines of their own.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure".split())
BLOCK = SPACED | frozenset(
    "html body div section article header footer nav aside main address form fieldset legend li dt dd hr figcaption details summary dialog search hgroup center menu tr td th thead tbody tfoot caption option optgroup text mtr".split()
)
#: A start tag ends the open elements named, up to the bounds named.
IMPLIED = {
    "li": ("li", "ul ol menu"),
    "dt": ("dt dd", "dl"),
    "dd": ("dt dd", "dl"),
    "tr": ("tr td th caption", "table"),
    "td": ("td th", "tr table"),
    "th": ("td th", "tr table"),
    "thead": ("thead tbody tfoot tr td th caption", "table"),
    "tbody": ("thead tbody tfoot tr td th caption", "table"),
    "tfoot": ("thead tbody tfoot tr td th caption", "table"),
    "option": ("option", "select datalist"),
    "optgroup": ("option optgroup", "select"),
    "body": ("head", "html"),
}
IMPLIED = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in IMPLIED.items()}
CLOSES_P = BLOCK - frozenset("li dt dd tr td th thead tbody tfoot caption legend figcaption summary html body option optgroup text mtr".split()) | {"li", "dt", "dd"}
P_BOUNDS = frozenset("td th table caption button object html body li div section article".split())
#: Lists, quotes and cells within each other that are set in; what lies deeper is shown without a further indent.
MAX_INDENT = 500


class Node:
    """An element: tag, children (elements and texts), whether it is shown, whether its own style makes it visible or not (None: as its
    parent), the columns and rows that a cell spans (0: all rows), the attributes that matter to what it holds, and the place among the
    open elements of the SVG or MathML that what it holds belongs to (0: HTML)."""

    __slots__ = ("children", "foreign", "own", "shown", "span", "tag", "visible")

    def __init__(self, tag: str, shown: bool = True, span: tuple[int, int] = (1, 1), visible: bool | None = None, own: dict | None = None):
        self.tag, self.shown, self.span, self.visible, self.own, self.foreign, self.children = tag, shown, span, visible, own or {}, 0, []


class Open(list):
    """The open elements, and where those of each tag stand."""

    def __init__(self, root: Node):
        super().__init__([root])
        self.at: dict[str, list[int]] = defaultdict(list)

    def append(self, node: Node) -> None:
        self.at[node.tag].append(len(self))
        super().append(node)

    def cut(self, k: int) -> None:
        """Close all from place ``k`` on."""
        for node in self[k:]:
            self.at[node.tag].pop()
        del self[k:]

    def last(self, tags: Iterable[str]) -> int:
        """The innermost place of any of the tags, 0 for none."""
        get, out = self.at.get, 0
        for t in tags:
            places = get(t)
            if places and places[-1] > out:
                out = places[-1]
        return out


def parse(html: str) -> Node:
    """The tree of a page; tags that were never closed end with their parent."""
    root = Node("html")
    stack, at, end = Open(root), 0, len(html)
    while at < end:
        token = TOKEN.search(html, at)
        if token is None:
            _text(stack, html[at:])
            break
        if token.start() > at:
            _text(stack, html[at : token.start()])
        at = token.end()
        tag = token.group(2)
        if tag is None:
            if html.startswith("<![CDATA[", token.start()) and stack[-1].foreign:
                at = html.find("]]>", token.start())
                stack[-1].children.append(html[token.start() + 9 : at if at >= 0 else end])
                at = at + 3 if at >= 0 else end
            continue
        if not token.group(4):  # the page ends inside the tag, which is not shown
            break
        tag = tag.lower()
        if token.group(1):
            _close(stack, tag)
            continue
        attributes = token.group(3)
        foreign = stack[-1].foreign
        if foreign and tag in BREAKS_OUT:
            stack.cut(foreign)
            foreign = 0
        if foreign:
            _part(stack, foreign, tag, attributes)
            continue
        _imply(stack, tag)
        own = _attributes(attributes) if tag in LABELLED and attributes else {}
        shown = tag not in UNSHOWN and not (attributes and _unshown(attributes)) and (tag != "dialog" or "open" in own)
        visible = _visibility(attributes) if attributes else None
        if visible is False and tag in ROWS and "collapse" in attributes.lower():
            shown, visible = False, None  # a collapsed row is not there
        spans = (_number(own, "colspan", 1, 1000), _number(own, "rowspan", 0, 65534)) if own and tag in ("td", "th") else (1, 1)
        node = Node(tag, shown, spans, visible, own)
        stack[-1].children.append(node)
        if tag in RAW:
            close = re.compile(f"</{tag}(?=[\\s/>]|\\Z)[^>]*>?", re.I).search(html, at)
            if tag in ("textarea", "xmp"):
                node.children.append(unescape(html[at : close.start() if close else end]))
            at = close.end() if close else end
        elif tag in ("svg", "math") and _closes_itself(attributes):
            continue
        elif tag not in VOID:
            node.foreign = len(stack) if tag in ("svg", "math") else 0
            stack.append(node)
            if own.get("label") and tag in ("option", "optgroup"):
                node.children.append(own["label"])
                if tag == "option":  # its label stands for its text
                    stack[-1] = Node(tag)
    return root


#: Elements with attributes that matter to the text.
LABELLED = frozenset("td th option optgroup details dialog ol li".split())
ROWS = frozenset("tr thead tbody tfoot".split())


def _part(stack: Open, top: int, tag: str, attributes: str) -> None:
    """An element of SVG or MathML; ``/>`` ends it."""
    hidden = tag in (UNSHOWN_SVG if stack[top].tag == "svg" else UNSHOWN_MATH)
    kind = "text" if tag == "tspan" and attributes and "x" in _attributes(attributes) else tag
    parent = stack[-1]
    if parent.tag in APART and any(isinstance(c, Node) for c in parent.children):
        parent.children.append(" ")
    node = Node(kind, not hidden and not (attributes and _unshown(attributes)), visible=_visibility(attributes) if attributes else None)
    parent.children.append(node)
    if not _closes_itself(attributes):
        node.foreign = 0 if tag in HOLDS_HTML else top
        stack.append(node)


def _closes_itself(attributes: str) -> bool:
    last = None
    if attributes.endswith("/"):
        for last in ATTRIBUTE.finditer(attributes):
            pass
        return last is None or last.end() < len(attributes)
    return False


def _number(own: dict[str, str], name: str, least: int, most: int) -> int:
    found = re.match(r"[ \t\n\r\f]*\+?([0-9]{1,9})", own.get(name, ""))
    n = int(found.group(1)) if found else 1
    return min(n, most) if n >= least else 1


def _text(stack: Open, text: str) -> None:
    parent = stack[-1]
    if parent.tag in ("table", "tr", "tbody", "thead", "tfoot") and not text.strip():
        return
    parent.children.append(unescape(text) if "&" in text else text)


def _attributes(text: str) -> dict[str, str]:
    """Names and values of a tag's attributes; the first of a name counts."""
    out: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), unescape(a or b or c))
    return out


def _integer(own: dict[str, str], name: str) -> int | None:
    """A whole number of up to nine digits, which may be negative."""
    found = re.match(r"[ \t\n\r\f]*([+-]?[0-9]{1,9})", own.get(name, ""))
    return int(found.group(1)) if found else None


def _visibility(attributes: str) -> bool | None:
    """What an element's own style says of its visibility, which others inherit and may override; None for nothing."""
    if "visibility" not in attributes.lower():
        return None
    found = VISIBILITY.findall(_attributes(attributes).get("style", ""))
    return found[-1].lower() == "visible" if found else None


def _unshown(attributes: str) -> bool:
    if "hidden" not in attributes.lower() and "none" not in attributes.lower():
        return False
    own = _attributes(attributes)
    return "hidden" in own or bool(UNSHOWN_STYLE.search(own.get("style", ""))) or own.get("type", "").lower() == "hidden"


def _imply(stack: Open, tag: str) -> None:
    if tag in CLOSES_P:
        _pop(stack, frozenset({"p"}), P_BOUNDS, all_of=False)
    if tag in IMPLIED:
        _pop(stack, *IMPLIED[tag], all_of=True)


def _pop(stack: Open, ends: frozenset, bounds: frozenset, *, all_of: bool) -> None:
    """Close the open elements of ``ends`` above the nearest of ``bounds``: the innermost, or all."""
    nearest = stack.last(ends)
    if not nearest:
        return
    bound = stack.last(bounds)
    if all_of:
        places = [at[k] for t in ends if (at := stack.at.get(t)) and (k := bisect_right(at, bound)) < len(at)]
        if places:
            stack.cut(min(places))
    elif nearest > bound:
        stack.cut(nearest)


def _close(stack: Open, tag: str) -> None:
    at = stack.at.get(tag)
    if at and not (tag in ("p", "b", "i", "a", "span", "div", "li") and stack.last(("table",)) > at[-1]):
        stack.cut(at[-1])


class Writer:
    """Lines of text, with collapsed blanks and at most one empty line between blocks."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.blank = self.space = False

    def add(self, text: str) -> None:
        text = BLANKS.sub(" ", text)
        if text == " " or not text:
            self.space = self.space or bool(text)
            return
        if self.now and (self.space or text[0] == " "):
            self.now.append(" ")
        self.now.append(text.strip(" "))
        self.space = text[-1] == " "

    def feed(self, *, blank: bool = False) -> None:
        """End the line; ``blank`` asks for an empty one before the next."""
        if self.now:
            if self.blank and self.lines:
                self.lines.append("")
            self.lines.append("".join(self.now))
            self.now, self.blank = [], False
        self.space = False
        self.blank = self.blank or blank

    def keep(self, text: str) -> None:
        """End a preformatted line, which may be empty."""
        if self.blank and self.lines:
            self.lines.append("")
        self.blank = False
        self.lines.append("".join([*self.now, text]).rstrip())
        self.now = []

    def put(self, lines: list[str], indent: str = "", first: str | None = None) -> None:
        self.feed()
        for k, line in enumerate(lines):
            if k == 0 and self.blank and self.lines:
                self.lines.append("")
            self.lines.append(((first if k == 0 and first is not None else indent) + line).rstrip())
        self.blank = self.blank and not lines

    def done(self) -> list[str]:
        self.feed()
        return self.lines


class Table:
    """Rows of cells (lines, columns and rows spanned), and the rows that start a group."""

    def __init__(self):
        self.rows: list[list[tuple[list[str], int, int]]] = []
        self.starts: set[int] = set()


def columns(line: str) -> int:
    """Columns that a line takes: wide characters take two, marks on others none."""
    if line.isascii():
        return len(line)
    return sum(0 if unicodedata.combining(c) or unicodedata.category(c) in ("Mn", "Me", "Cf") else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in line)


def _placed(table: Table) -> list[list[tuple[list[str], int, int]]]:
    """Rows of cells with their columns, the first and the one after the last, as the table lays them out; columns in which no cell starts are left out."""
    taken: dict[int, float] = {}  # column: the row at which it is free again
    rows = []
    for r, row in enumerate(table.rows):
        if r in table.starts:
            taken = {}
        at, out = 0, []
        for lines, across, down in row:
            while taken.get(at, 0) > r:
                at += 1
            if down != 1:
                free = r + down if down else float("inf")
                for c in range(at, at + across):
                    taken[c] = max(taken.get(c, 0), free)
            out.append(([x for x in lines if x] or [""], at, at + across))
            at += across
        rows.append(out)
    first = sorted({a for row in rows for _, a, _ in row})
    return [[(lines, bisect_left(first, a), bisect_left(first, z)) for lines, a, z in row] for row in rows if row]


def _aligned(table: Table) -> list[str]:
    """The rows' lines, with columns padded to a common width, two blanks apart; a cell over several columns or rows stands at its first."""
    rows = _placed(table)
    width = [0] * max((z for row in rows for _, _, z in row), default=0)
    for wide in (False, True):
        for row in rows:
            for lines, a, z in row:
                if (z - a > 1) == wide:
                    width[z - 1] += max(0, max(map(columns, lines)) - sum(width[a:z]) - 2 * (z - a - 1))
    start = [0, *accumulate(w + 2 for w in width)]
    out = []
    for row in rows:
        for i in range(max(len(lines) for lines, _, _ in row)):
            line = ""
            for lines, a, _ in row:
                if i < len(lines) and lines[i]:
                    line = line and line + "  "
                    line += " " * (start[a] - columns(line)) + lines[i]
            out.append(line)
    return out


def _rendered(node: Node) -> list[Node | str]:
    """What of an element's children is rendered: of closed details their first summary alone."""
    if node.tag != "details" or "open" in node.own:
        return node.children
    return [c for c in node.children if isinstance(c, Node) and c.tag == "summary"][:1]


def _numbering(node: Node) -> list:
    """A list's tag, the number before its first item's, and the step to the next."""
    start = _integer(node.own, "start")
    if "reversed" not in node.own or node.tag != "ol":
        return [node.tag, (1 if start is None else start) - 1, 1]
    items = sum(isinstance(c, Node) and c.tag == "li" and c.shown for c in node.children)
    return [node.tag, (items if start is None else start) + 1, -1]


def render(root: Node) -> str:
    """The text of a tree."""
    writer, writers, lists, tables = Writer(), [], [], []
    pre, flat = 0, set()  # flat: elements that are too deep to be set in
    visible, before = True, []  # before: what was the case outside of each element that says something of it
    todo: list[tuple[Node | str, bool]] = [(root, True)]
    while todo:
        node, enters = todo.pop()
        if isinstance(node, str):
            if not visible:
                continue
            if pre:
                *whole, last = node.split("\n")
                for line in whole:
                    writer.keep(line)
                if last:
                    writer.now.append(last)
            else:
                writer.add(node)
            continue
        tag = node.tag
        if enters:
            if not node.shown:
                continue
            if tag == "br":
                if pre:
                    writer.keep("")
                elif writer.now:
                    writer.feed()
                else:  # a line of its own that is empty
                    writer.blank = True
                continue
            if tag in BLOCK:
                writer.feed(blank=tag in SPACED and tag not in ("ul", "ol") or tag in ("ul", "ol") and not lists)
            if node.visible is not None:
                before.append(visible)
                visible = node.visible
            if tag in ("ul", "ol"):
                lists.append(_numbering(node))
            elif tag == "table":
                tables.append(Table())
            elif tag == "tr" and tables:
                tables[-1].rows.append([])
            elif tag in ("thead", "tbody", "tfoot") and tables:
                tables[-1].starts.add(len(tables[-1].rows))
            elif tag == "pre":
                pre += 1
            if tag in ("td", "th", "caption") and tables or tag in ("li", "blockquote", "dd"):
                if len(writers) < MAX_INDENT:
                    writers.append(writer)
                    writer = Writer()
                else:
                    writer.feed()
                    flat.add(id(node))
            todo.append((node, False))
            todo.extend((c, True) for c in reversed(_rendered(node)))
            continue
        seen = visible
        if node.visible is not None:
            visible = before.pop()
        if id(node) in flat:
            writer.feed()
        elif tag in ("td", "th", "caption") and tables:
            cell, writer = writer.done(), writers.pop()
            if tag == "caption":
                writer.put(cell)
            else:
                if not tables[-1].rows:
                    tables[-1].rows.append([])
                tables[-1].rows[-1].append((cell, *node.span))
        elif tag == "li":
            item, writer = writer.done(), writers.pop()
            if lists:
                given = _integer(node.own, "value")
                lists[-1][1] = lists[-1][1] + lists[-1][2] if given is None else given
            mark = f"{lists[-1][1]}. " if lists and lists[-1][0] == "ol" else "- "
            writer.put(item, " " * len(mark), mark if seen else None)
        elif tag in ("blockquote", "dd"):
            item, writer = writer.done(), writers.pop()
            writer.put(item, "> " if tag == "blockquote" else "  ")
        elif tag in ("ul", "ol"):
            lists.pop()
        elif tag == "table":
            writer.put(_aligned(tables.pop()))
        elif tag == "pre":
            pre -= 1
        if tag in BLOCK:
            writer.feed(blank=tag in SPACED and (tag not in ("ul", "ol") or not lists))
    return "\n".join(writer.done())


def page_text(html: str | None) -> str | None:
    """Visible text of a page; null for null."""
    return None if html is None else render(parse(html))


def extract_text(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html, ...): page_id, url, text, n_chars, n_lines.

    Null html gives a null text and zero counts, empty html an empty one.  Rows are taken one by one, so repeated rows
    and null ids come back as they are.  Depth has no limit; indents stop growing at ``MAX_INDENT`` levels.  Tags are read
    as browsers do, at any length of their attributes: a tag or quote that never ends takes the rest of the page.  Other
    columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [page_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(texts, pa.string()),
                    pa.array([len(t or "") for t in texts], pa.int64()),
                    pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64()),
                ],
                ["page_id", "url", "text", "n_chars", "n_lines"],
            )

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").mapInArrow(run, "page_id long, url string, text string, n_chars long, n_lines long")
