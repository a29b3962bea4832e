"""Layout-aware rendering of HTML as plain text.

A tokenizer cuts the page into tags and text, a tree builder supplies the end tags that HTML lets authors
leave out, visibility rules drop what a browser doesn't show, and a renderer lays out what is left: blank
lines around paragraphs, a line for each other block, bullets and numbers of lists, table cells in
aligned columns, preformatted text as it stands. All visible text is emitted; nothing is guessed to be
boilerplate.

Not shown: head, script, style, template, noscript, media and form controls without text, comments; descriptions
and definitions in svg, annotations in math (the other text of both is); elements
with ``hidden`` or ``display:none``; the text of elements with ``visibility:hidden``, but for what lies in elements within
that are ``visible`` again; the body of a ``details`` that isn't open.

Defined cases: null html gives empty text; broken markup is text or is closed where HTML closes it; of elements
nested deeper than ``MAX_DEPTH`` all visible text is given, in lines of its own for each block, but without further
bullets, indents and columns, whose size would grow with the square of the depth; where two cells of a table claim one
place, it is held as long as the first one says; a table whose columns would take over ``MAX_PADDING`` times its text (each
row in columns of its own) has cells two spaces apart, not aligned; a null page_id and repeated rows are rendered
like any other; extra columns are left alone; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import html
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Elements nested deeper are laid out at this depth.
MAX_DEPTH = 150
# The most columns and rows that a cell spans in HTML.
MAX_COLUMNS, MAX_ROWS = 1000, 65534
#: Spaces for alignment that a table may have for each of its characters.
MAX_PADDING = 500
# Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript title iframe noembed noframes object audio video canvas map datalist".split())
UNSEEN_WITHIN = {"svg": frozenset("desc metadata defs".split()), "math": frozenset("annotation annotation-xml".split())}
PRE = frozenset("pre textarea xmp".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure fieldset menu".split())
BLOCK = SPACED | frozenset("html body div section article aside header footer main nav address center details dialog dd dt figcaption form hr legend li optgroup option search summary caption thead tbody tfoot tr td th textarea xmp".split())
ENDS_P = (BLOCK - frozenset("html body option optgroup caption thead tbody tfoot tr td th textarea".split())) | {"xmp"}
#: What a start tag closes, and the elements beyond which it doesn't look.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    **{k: ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}) for k in ("thead", "tbody", "tfoot")},
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose content an end tag outside doesn't close.
SCOPE = frozenset("table td th caption button object template html".split())

_TAG = re.compile(r"""<(?:/([a-zA-Z][^\s/>]*)[^>]*>|([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+)>|([a-zA-Z][^\s/>]*)([^>]*)>)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_UNSEEN = re.compile(r"display\s*:\s*none\b")
_VISIBILITY = re.compile(r".*visibility\s*:\s*(visible|hidden|collapse)\b", re.S)


class Node:
    """An element. ``owner`` and ``leaf`` tell where the content of one beyond ``MAX_DEPTH`` goes.

    One that isn't ``shown`` hides all within; one that isn't ``visible`` hides its text, and passes that on to elements
    that don't say otherwise.
    """

    __slots__ = ("tag", "attributes", "children", "shown", "visible", "owner", "leaf")

    def __init__(self, tag: str, attributes: dict[str, str], shown: bool = True):
        self.tag, self.attributes, self.shown = tag, attributes, shown
        self.children: list[Node | str] = []
        self.visible = True
        self.owner: Node | None = None
        self.leaf = ""

    def is_closed(self) -> bool:
        return self.tag == "details" and "open" not in self.attributes


class Path:
    """The open elements from the root on, with the places of each kind, so that none is searched for.

    Elements beyond ``MAX_DEPTH`` are open like others, so they hide what they hide and end where they end; but
    what they show is put into blocks within the element at that depth, one for each of their stretches.
    """

    def __init__(self, root: Node):
        self.nodes, self.at = [root], {root.tag: [0]}

    @property
    def top(self) -> Node:
        return self.nodes[-1]

    def last(self, names: Iterable[str]) -> int:
        """The place of the innermost open element of these kinds, or -1."""
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=-1)

    def cut(self, k: int) -> None:
        while len(self.nodes) > k:
            self.at[self.nodes.pop().tag].pop()

    def close(self, names: Iterable[str], stop: Iterable[str]) -> bool:
        """End the innermost element of these kinds, unless one of ``stop`` is open within it."""
        k = self.last(names)
        if k < 1 or k < self.last(stop):
            return False
        self.cut(k)
        return True

    def put(self, child: Node | str) -> None:
        top = self.top
        if isinstance(child, str) and not top.visible:
            return
        if len(self.nodes) <= MAX_DEPTH:
            top.children.append(child)
        elif top.shown and not top.is_closed():
            home = self.nodes[MAX_DEPTH - 1].children
            if top.owner:
                if not (home and isinstance(home[-1], Node) and home[-1].owner is top.owner):
                    home.append(self._leaf(top.owner))
                home[-1].children.append(child)
            else:
                home.append(child)

    def open(self, node: Node) -> None:
        own = visibility(node.attributes)
        node.visible = self.top.visible if own is None else own
        if len(self.nodes) < MAX_DEPTH:
            self.top.children.append(node)
        else:
            above = self.top
            if len(self.nodes) > MAX_DEPTH:
                node.shown &= above.shown and (not above.is_closed() or node.tag == "summary")
                node.owner, node.leaf = above.owner, above.leaf
            if node.tag in BLOCK:
                node.owner = node
                node.leaf = "pre" if node.tag in PRE or node.leaf == "pre" else "summary" if node.tag == "summary" else "div"
                if node.shown:
                    self.nodes[MAX_DEPTH - 1].children.append(self._leaf(node))
        self.nodes.append(node)
        self.at.setdefault(node.tag, []).append(len(self.nodes) - 1)

    @staticmethod
    def _leaf(owner: Node) -> Node:
        leaf = Node(owner.leaf, {})
        leaf.owner = owner
        return leaf


def attributes_of(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(source):
        out.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return out


def is_shown(tag: str, attributes: dict[str, str]) -> bool:
    return not (tag in HIDDEN or "hidden" in attributes or _UNSEEN.search(attributes.get("style", "").lower()))


def visibility(attributes: dict[str, str]) -> bool | None:
    """What an element's style says of its visibility; None if nothing."""
    m = _VISIBILITY.match(attributes.get("style", "").lower()) if "style" in attributes else None
    return m[1] == "visible" if m else None


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("start", tag, attributes), ("raw", text, tag) and ("end", tag, "") in order."""
    at = seen = 0  # what is before ``at`` has been given, what is before ``seen`` holds no more tags
    last = page.rfind(">")
    while (i := page.find("<", seen)) >= 0:
        m = None
        if page.startswith(("<!", "<?"), i):
            end = _after(page, "-->", i + 2) if page.startswith("<!--", i) else _after(page, ">", i)
        elif i > last or not (m := _TAG.match(page, i)):
            seen = i + 1
            continue
        else:
            end = m.end()
        if i > at:
            yield "text", page[at:i], ""
        at = seen = end
        if m and m[1]:
            yield "end", m[1].lower(), ""
        elif m:
            tag = (m[2] or m[4]).lower()
            yield "start", tag, m[3] or m[5] or ""
            if tag in RAW:
                close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
                end = close.start() if close else len(page)
                if end > at:
                    yield "raw", page[at:end], tag
                at = seen = end
    if at < len(page):
        yield "text", page[at:], ""


def _after(page: str, mark: str, at: int) -> int:
    """The place behind the next mark, or the end of the page."""
    k = page.find(mark, at)
    return k + len(mark) if k >= 0 else len(page)


def tree(page: str) -> tuple[Node, str]:
    """The page's tree, and its title."""
    root = Node("html", {})
    path, title = Path(root), ""
    for kind, value, more in tokens(page):
        if kind == "text":
            if path.top.tag == "head" and value.strip():
                path.close({"head"}, ())  # text ends the head
            path.put(html.unescape(value))
        elif kind == "raw":
            if more == "title" and not title and not path.at.get("svg"):
                title = _SPACE.sub(" ", html.unescape(value)).strip()
            path.put(html.unescape(value) if more in ("title", "textarea") else value)
        elif kind == "end":
            if value == "br":
                path.put(Node("br", {}))
            elif value in HEADINGS:
                path.close(HEADINGS, SCOPE)
            elif value not in ("html", "body"):
                stop = {"table"} if value in ("td", "th", "tr", "thead", "tbody", "tfoot", "caption") else SCOPE if value != "table" else ()
                path.close({value}, stop)
        else:
            attributes = attributes_of(more) if more else {}
            if value in ("html", "body"):
                path.close({"head"}, ())
                if not is_shown(value, attributes):
                    root.shown = False
                own = visibility(attributes)
                root.visible = root.visible if own is None else own
                continue
            if path.top.tag == "head" and value not in ("base", "link", "meta", "title", "style", "script", "template", "noscript"):
                path.close({"head"}, ())
            if value in ENDS_P:
                path.close({"p"}, SCOPE)
            if value in HEADINGS and path.top.tag in HEADINGS:
                path.close(HEADINGS, ())
            if value in CLOSES:
                names, stop = CLOSES[value]
                while path.last(names) > path.last(stop):
                    path.close(names, stop)
            shown = is_shown(value, attributes) and not any(value in inner and path.at.get(outer) for outer, inner in UNSEEN_WITHIN.items())
            if value in VOID:
                path.put(Node(value, attributes, shown))
            else:
                path.open(Node(value, attributes, shown))
    return root, title


def inline(node: Node, pre: bool) -> Iterator[tuple[str | Node, bool]]:
    """The texts, line breaks and blocks in a node, with whether white space counts."""
    closed = node.is_closed()
    first = True
    for child in node.children:
        if isinstance(child, str):
            if not closed:
                yield child, pre
        elif child.shown and (not closed or (child.tag == "summary" and first)):
            first = first and child.tag != "summary"
            if child.tag in BLOCK or child.tag == "br":
                yield child, pre
            else:
                yield from inline(child, pre)


def render(node: Node, pre: bool = False) -> list[str]:
    """The lines of a node's content; an empty string is a blank line."""
    out: list[str] = []
    line: list[str] = []
    gap = False

    def add(lines: list[str], spaced: bool) -> None:
        nonlocal gap
        if not lines:
            return
        if out and (gap or spaced):
            out.append("")
        out.extend(lines)
        gap = spaced

    def flush() -> None:
        text = "".join(line)
        line.clear()
        lines = [x.rstrip() if pre else x.strip(" ") for x in text.split("\n")]
        while lines and not lines[0]:
            lines.pop(0)
        while lines and not lines[-1]:
            lines.pop()
        add(lines, False)

    for child, keep in inline(node, pre):
        if isinstance(child, str):
            if keep:
                line.append(child.replace("\r\n", "\n").replace("\r", "\n"))
            else:
                text = _SPACE.sub(" ", child)
                if text.startswith(" ") and (not line or line[-1][-1:] in (" ", "\n", "")):
                    text = text[1:]
                if text:
                    line.append(text)
        elif child.tag == "br":
            line.append("\n")
        else:
            flush()
            add(block(child, pre), child.tag in SPACED and not (child.tag in ("ul", "ol", "menu") and node.tag == "li"))
    flush()
    return out


def block(node: Node, pre: bool) -> list[str]:
    if node.tag in ("ul", "ol", "menu"):
        return items(node, pre)
    if node.tag == "table":
        return cells(node, pre)
    if node.tag in PRE:
        return render(node, True)
    lines = render(node, pre)
    if node.tag in ("blockquote", "dd"):
        return [f"    {x}" if x else x for x in lines]
    return lines


def items(node: Node, pre: bool) -> list[str]:
    """A list: what stands before an item hangs on its first line, the rest is indented by as much."""
    out: list[str] = []
    ordered = node.tag == "ol"
    number = _int(node.attributes.get("start"), 1)
    loose = Node("div", {})
    for child in [*node.children, None]:
        if isinstance(child, Node) and child.tag == "li":
            if loose.children:
                out += render(loose, pre)
                loose = Node("div", {})
            if not child.shown:
                continue
            if ordered:
                number = _int(child.attributes.get("value"), number)
            mark = f"{number}. " if ordered else "- "
            mark = mark if child.visible else " " * len(mark)
            number += 1
            for k, x in enumerate(render(child, pre)):
                out.append(f"{mark}{x}" if not k else f"{' ' * len(mark)}{x}" if x else x)
        elif child is not None:
            loose.children.append(child)
    if loose.children:
        out += render(loose, pre)
    return out


def _int(value: str | None, otherwise: int) -> int:
    m = re.match(r"\s*(-?\d{1,9})", value or "")
    return int(m[1]) if m else otherwise


def _rows(node: Node) -> Iterator[Node]:
    for child in node.children:
        if isinstance(child, Node) and child.shown:
            if child.tag == "tr":
                yield child
            elif child.tag in ("thead", "tbody", "tfoot"):
                yield from _rows(child)


def _outside(node: Node) -> Iterator[Node | str]:
    """What stands in a table beside its rows and cells: captions and stray content, shown before it."""
    for child in node.children:
        if isinstance(child, str):
            yield child
        elif child.tag in ("thead", "tbody", "tfoot") and child.shown:
            yield from _outside(child)
        elif child.tag == "tr" and child.shown:
            yield from (x for x in child.children if isinstance(x, str) or x.tag not in ("td", "th"))
        elif child.tag not in ("tr", "colgroup", "col"):
            yield child


class Columns:
    """The free columns of a table's next row: stretches between those that cells of rows above still hold."""

    def __init__(self) -> None:
        self.starts: list[int] = [0]
        self.ends: list[float] = [float("inf")]
        self.held: list[tuple[int, int, int]] = []  # the last row, from, to

    def free(self, column: int) -> int:
        """The first free column from this one on."""
        k = bisect_right(self.starts, column) - 1
        return column if k >= 0 and column < self.ends[k] else self.starts[k + 1]

    def hold(self, start: int, end: int, row: int) -> None:
        """Take the free ones of these columns up to a row."""
        k = bisect_right(self.ends, start)
        while k < len(self.starts) and self.starts[k] < end:
            a, b = self.starts.pop(k), self.ends.pop(k)
            x, y = max(a, start), min(b, end)
            heapq.heappush(self.held, (row, x, int(y)))
            for lo, hi in ((y, b), (a, x)):
                if lo < hi:
                    self.starts.insert(k, int(lo))
                    self.ends.insert(k, hi)
            k = bisect_right(self.ends, y)

    def release(self, row: int) -> None:
        """Give back what is held up to a row before this one."""
        while self.held and self.held[0][0] < row:
            _, start, end = heapq.heappop(self.held)
            k = bisect_left(self.starts, start)
            if k < len(self.starts) and self.starts[k] == end:
                self.starts.pop(k)
                end = self.ends.pop(k)
            if k and self.ends[k - 1] == start:
                self.ends[k - 1] = end
            else:
                self.starts.insert(k, start)
                self.ends.insert(k, end)


def column_widths(cells: list[tuple[int, int, list[str]]]) -> dict[int, int]:
    """The widths of the columns in which cells (column, span, lines) end, narrow spans first; other columns are empty."""
    lasts = sorted({column + span - 1 for column, span, _ in cells})
    sums = [0] * (len(lasts) + 1)  # of widths, as a tree of partial sums

    def upto(k: int) -> int:
        total = 0
        while k:
            total += sums[k]
            k &= k - 1
        return total

    width: dict[int, int] = {}
    for column, span, lines in sorted(cells, key=lambda c: c[1]):
        last = column + span - 1
        k = bisect_left(lasts, last) + 1
        have = upto(k) - upto(bisect_left(lasts, column)) + 2 * (span - 1)
        more = max(0, max(map(len, lines), default=0) - have)
        width[last] = width.get(last, 0) + more
        while more and k < len(sums):
            sums[k] += more
            k += k & -k
    return width


def cells(node: Node, pre: bool) -> list[str]:
    """A table: every column as wide as its widest cell, columns two spaces apart."""
    before = Node("div", {})
    before.children = list(_outside(node))
    grid: list[list[tuple[int, int, list[str]]]] = []
    columns = Columns()
    for number, tr in enumerate(_rows(node)):
        row, column = [], 0
        below: list[tuple[int, int, int]] = []
        columns.release(number)
        for cell in tr.children:
            if isinstance(cell, Node) and cell.tag in ("td", "th") and cell.shown:
                column = columns.free(column)
                span = min(MAX_COLUMNS, max(1, _int(cell.attributes.get("colspan"), 1)))
                down = min(MAX_ROWS, max(1, _int(cell.attributes.get("rowspan"), 1)))
                row.append((column, span, render(cell, pre)))
                if down > 1:
                    below.append((column, column + span, number + down - 1))
                column += span
        for held in below:
            columns.hold(*held)
        grid.append(row)
    width = column_widths([c for row in grid for c in row])
    start, at = {}, 0
    for column in sorted({*width, *(c[0] for row in grid for c in row)}):  # the others are empty
        start[column] = at
        at += width.get(column, 0) + (2 if width.get(column, 0) else 0)
    size = sum(len(x) for row in grid for _, _, lines in row for x in lines)
    padding = sum(max((start[column] for column, _, lines in row if k < len(lines) and lines[k]), default=0) for row in grid for k in range(max((len(lines) for _, _, lines in row), default=0)))
    if padding > MAX_PADDING * size:
        start = dict.fromkeys(start, 0)
    out = render(before, pre)
    for row in grid:
        for k in range(max((len(lines) for _, _, lines in row), default=0)):
            text: list[str] = []
            length = 0
            for column, _, lines in row:
                if k < len(lines) and lines[k]:
                    text.append(" " * (start[column] - length) if length <= start[column] else "  ")
                    text.append(lines[k])
                    length += len(text[-2]) + len(text[-1])
            out.append("".join(text).rstrip())
    return out


def render_page(page: str | None) -> tuple[str, str]:
    """(title, text) of a page."""
    if not page:
        return "", ""
    root, title = tree(page.replace("\0", ""))
    return title, "\n".join(render(root)) if root.shown else ""


def page_texts(pages: DataFrame) -> DataFrame:
    """page_id, title and text of every page."""
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [render_page(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t for t, _ in done], pa.string()), pa.array([x for _, x in done], pa.string())], ["page_id", "title", "text"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, title string, text string")
