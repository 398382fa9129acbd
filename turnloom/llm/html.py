"""Text of web pages by layout-aware rendering.

A page is built to a tree with the tags that HTML implies, and all text that a reader would see is
written down as it would be laid out: blocks on lines of their own, paragraphs and the like with a
blank line around, list items with a bullet or number and their depth, table cells in columns that
line up, preformatted text as it is. What is not shown is left out: head, scripts, styles, templates,
elements that the hidden attribute or an inline style does not display, and text whose nearest inline
visibility is hidden. Nothing is judged by content, so no text is lost.

Columns of tables are up to WRAP wide: longer lines of a cell are wrapped at spaces. A line that cannot
be wrapped (one long word, preformatted text, a wide table in a cell) stands alone, with the rest of its
row below it, so columns line up in any case. Tables in tables are laid out from the inside out, to any
depth.

Pages are rendered one by one within Arrow batches of the scan; there is no shuffle.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.functions.dom import Node, body, parse
from turnloom.llm.common import column

HIDDEN = frozenset("head script style template noscript title meta link base iframe object embed audio video canvas datalist param source track".split())
#: Parts of a drawing that are not drawn where they stand.
UNDRAWN = frozenset("desc metadata defs symbol clippath mask pattern marker lineargradient radialgradient filter".split())
#: Blocks with a blank line around them, and those on lines of their own.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure fieldset hr menu".split())
LINED = frozenset("div article section header footer main nav aside address li dt dd form figcaption caption details summary center tr body html legend option dialog hgroup search".split())
_SPACE = re.compile(r"[ \t\n\r\f]+")
#: What a table and its parts hold; all else in them is shown before the table.
PARTS = {"table": ("caption", "colgroup", "col", "thead", "tbody", "tfoot", "tr"), "colgroup": ("col",), "thead": ("tr",), "tbody": ("tr",), "tfoot": ("tr",), "tr": ("td", "th")}
#: Lines of a cell are wrapped at this width.
WRAP = 60
#: As HTML has it, a cell spans so many columns and rows at most.
COLUMNS, ROWS = 1000, 65534


def _in_svg(node: Node) -> bool:
    return any(n.tag == "svg" for n in node.up())


def declared(node: Node, name: str) -> str:
    """The value that an element's inline style gives a property, the last one, important ones first."""
    style = node.get("style")
    if name not in style.lower():
        return ""
    found, strong = "", False
    for one in style.split(";"):
        key, _, value = one.partition(":")
        if key.strip().lower() == name:
            value, mark, _ = value.lower().partition("!")
            if mark or not strong:
                found, strong = value.strip(), bool(mark)
    return found


def hidden(node: Node) -> bool:
    """Not displayed, with all that it holds: by its tag, the hidden attribute, an inline style, or as a
    hidden input; in drawings also by what svg does not draw."""
    if node.tag in HIDDEN or "hidden" in node.attrs or ("style" in node.attrs and declared(node, "display") == "none"):
        return True
    if (node.tag in UNDRAWN or node.get("display") == "none") and _in_svg(node):
        return True
    return node.tag == "input" and node.get("type").lower() == "hidden"


def visibility(node: Node, above: bool) -> bool:
    """Whether the text in an element is visible: as the element says itself, else as above it."""
    own = declared(node, "visibility") if "style" in node.attrs else ""
    own = own or ("visibility" in node.attrs and _in_svg(node) and node.get("visibility").strip().lower()) or ""
    return own not in ("hidden", "collapse") if own in ("visible", "hidden", "collapse") else above


def width(text: str) -> int:
    """Columns that a text takes: wide characters two, marks none."""
    return len(text) if text.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class _Fixed(str):
    """A line that is not to be wrapped."""

    __slots__ = ()


def wrapped(line: str) -> list[str]:
    """A line in pieces of up to WRAP columns, cut at spaces; longer words stand alone."""
    if isinstance(line, _Fixed) or width(line) <= WRAP:
        return [line]
    found, now, size = [], [], 0
    for word in line.split(" "):
        wide = width(word)
        if now and size + 1 + wide > WRAP:
            found.append(" ".join(now))
            now, size = [], 0
        size += wide + bool(now)
        now.append(word)
    return [*found, " ".join(now)]


class _Out:
    """Lines so far, and the one being written."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = self.blank = self.fixed = False
        self.indent: list[str] = [""]
        self.mark = ""

    def text(self, value: str) -> None:
        value = _SPACE.sub(" ", value)
        if value.startswith(" "):
            self.space = self.space or bool(self.now)
            value = value[1:]
        if value:
            self._begin()
            self.now.append(" " + value if self.space else value)
            self.space = value.endswith(" ")
            if self.space:
                self.now[-1] = self.now[-1][:-1]

    def _begin(self) -> None:
        if not self.now:
            if self.blank and self.lines:
                self.lines.append("")
            self.blank = False
            indent = self.indent[-1]
            self.now.append(indent[: len(indent) - len(self.mark)] + self.mark)
            self.mark = ""

    def _end(self) -> None:
        made = "".join(self.now).rstrip(" ")
        self.lines.append(_Fixed(made) if self.fixed else made)
        self.now, self.fixed = [], False

    def line(self, blank: bool = False) -> None:
        if self.now:
            self._end()
        self.space = False
        self.blank = self.blank or blank

    def broken(self) -> None:
        """A line break: an empty line where the line is empty."""
        if self.now:
            self.line()
        elif self.lines and not self.blank:
            self.lines.append("")

    def verbatim(self, value: str) -> None:
        first, *more = value.replace("\r\n", "\n").split("\n")
        if first:
            self._begin()
            self.now.append(first)
            self.fixed = True
        for one in more:
            self._begin()
            self._end()
            if one:
                self.now.append(self.indent[-1] + one)
                self.fixed = True

    def done(self) -> list[str]:
        self.line()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def _item_marks(node: Node) -> Iterator[str]:
    """Bullets, or numbers from the list's start; an item's own value counts on from there."""
    at = int(node.get("start")) if re.fullmatch(r"-?\d{1,9}", node.get("start")) else 1
    for child in node.children:
        if isinstance(child, Node) and child.tag == "li" and not hidden(child):
            if node.tag != "ol":
                yield "- "
                continue
            if re.fullmatch(r"-?\d{1,9}", child.get("value")):
                at = int(child.get("value"))
            yield f"{at}. "
            at += 1


def _rows(table: Node) -> Iterator[Node]:
    """The table's own rows, shown ones."""
    for child in table.children:
        if isinstance(child, Node) and not hidden(child):
            if child.tag == "tr":
                yield child
            elif child.tag in ("thead", "tbody", "tfoot"):
                yield from (c for c in child.children if isinstance(c, Node) and c.tag == "tr" and not hidden(c))


def _loose(part: Node) -> Iterator[Node | str]:
    """What stands in a table, its sections and rows outside of cells, each piece set apart."""
    for child in part.children:
        if isinstance(child, str):
            if child.strip():
                yield from (child, " ")
        elif child.tag not in PARTS[part.tag]:
            yield from (child, " ")
        elif child.tag in PARTS and not hidden(child):
            yield from _loose(child)


def _span(cell: Node, name: str, most: int) -> int:
    """A span as HTML reads it: leading digits, at least 1, at most what HTML allows."""
    found = re.match(r"[ \t\n\f\r]*\+?0*(\d*)", cell.get(name))[1]
    if not found:
        return most if name == "rowspan" and re.match(r"[ \t\n\f\r]*\+?0", cell.get(name)) else 1
    return most if len(found) > 6 else min(int(found), most)


def _table(table: Node, above: bool, laid: dict[int, list[str]]) -> list[str]:
    """The lines of a table's rows, cells in columns; a cell that spans columns or rows keeps its places
    free. above: whether text is visible where the table stands."""
    grid: list[dict[int, list[str]]] = []
    taken: dict[int, int] = {}
    above = visibility(table, above)
    for row in _rows(table):
        cells: dict[int, list[str]] = {}
        at, seen = 0, visibility(row, visibility(row.parent, above) if row.parent is not table else above)
        for cell in row.children:
            if not isinstance(cell, Node) or cell.tag not in ("td", "th") or hidden(cell):
                continue
            while taken.get(at, 0) > 0:
                at += 1
            lines = _render(cell.children, laid, visibility(cell, seen))
            cells[at] = [piece for line in lines if line.strip() for piece in wrapped(line if isinstance(line, _Fixed) else line.strip())]
            rows, columns = _span(cell, "rowspan", ROWS), _span(cell, "colspan", COLUMNS)
            for k in range(columns):
                taken[at + k] = max(taken.get(at + k, 0), rows)
            at += columns
        taken = {k: n - 1 for k, n in taken.items() if n > 1}
        grid.append(cells)
    places = sorted({k for cells in grid for k, lines in cells.items() if lines})
    widths = {k: max((w for cells in grid for line in cells.get(k, ()) if (w := width(line)) <= WRAP), default=0) for k in places}
    return [line for cells in grid for line in _row(cells, places, widths)]


def _row(cells: dict[int, list[str]], places: list[int], widths: dict[int, int]) -> list[str]:
    """A row's lines. After a line that is wider than its column, the cells to the right start below it."""
    starts, top = {}, 0
    for k in places:
        starts[k] = top
        top += max((i + 1 for i, line in enumerate(cells.get(k, ())) if width(line) > widths[k]), default=0) if k != places[-1] else 0
    made = []
    for i in range(max((starts[k] + len(cells.get(k, ())) for k in places), default=0)):
        parts = [(cells[k][i - starts[k]] if 0 <= i - starts[k] < len(cells.get(k, ())) else "", widths[k]) for k in places]
        made.append("  ".join(text + " " * max(0, room - width(text)) for text, room in parts).rstrip(" "))
    return made


def _render(children: list, laid: dict[int, list[str]], seen: bool = True) -> list[str]:
    """The lines of nodes. laid: the rows of all tables inside; seen: whether text is visible here."""
    out = _Out()
    stack: list = [("in", c, seen) for c in reversed(children)]
    pre = 0
    while stack:
        what, item, seen = stack.pop()
        if what == "call":
            item()
            continue
        if isinstance(item, str):
            if seen:
                out.verbatim(item) if pre else out.text(item)
            elif not pre and _SPACE.search(item):
                out.text(" ")
            continue
        tag = item.tag
        # each text of a drawing stands by itself, as do parts of it with a place of their own
        drawn = (tag == "text" or tag == "tspan" and not {"x", "y", "dy"}.isdisjoint(item.attrs)) and _in_svg(item)
        if what == "out":
            if tag == "pre":
                pre -= 1
            if tag in SPACED or tag in LINED or drawn:
                out.line(tag in SPACED and not (tag in ("ul", "ol") and len(out.indent) > 1))
            elif tag in ("td", "th"):
                out.text("  ")
            elif tag == "q" and seen:
                out.text("”")
            continue
        if hidden(item):
            continue
        if "style" in item.attrs or "visibility" in item.attrs:
            seen = visibility(item, seen)
        if tag == "br":
            out.broken()
            continue
        if tag == "img" or tag == "input":
            shown = item.get("alt") if tag == "img" else item.get("value") if item.get("type").lower() not in ("checkbox", "radio", "password", "image") else ""
            if shown and seen:
                out.text(shown)
            continue
        if tag in SPACED or tag in LINED or drawn:
            out.line(tag in SPACED and not (tag in ("ul", "ol") and len(out.indent) > 1))
        if tag == "q" and seen:
            out.text("“")
        if tag == "pre":
            pre += 1
        stack.append(("out", item, seen))
        if tag == "table":
            stack.append(("call", lambda t=item: [(out.line(), out.verbatim(line), out.line()) for line in laid[id(t)]], seen))
            stack.extend(("in", c, seen) for c in reversed(list(_loose(item))))
            stack.extend(("in", c, seen) for c in reversed(item.children) if isinstance(c, Node) and c.tag == "caption")
        elif tag in ("ul", "ol", "menu"):
            marks = _item_marks(item)
            for node, mark in reversed([(c, next(marks)) if isinstance(c, Node) and c.tag == "li" and not hidden(c) else (c, "") for c in item.children]):
                if mark:
                    stack.append(("call", lambda: (out.line(), out.indent.pop(), setattr(out, "mark", "")), seen))
                    stack.append(("in", node, seen))
                    stack.append(("call", lambda m=mark: (out.line(), _enter(out, m)), seen))
                else:
                    stack.append(("in", node, seen))
        else:
            stack.extend(("in", c, seen) for c in reversed(item.children))
    return out.done()


def _enter(out: _Out, mark: str) -> None:
    """An item begins: its mark stands before its first line, the others are under its text."""
    outer = out.indent[-1]
    if out.mark:  # a list that is all of its item's text: both marks on one line
        mark = out.mark + mark
        outer = outer[: len(outer) - len(out.mark)]
    out.mark = mark
    out.indent.append(outer + " " * len(mark))


def _seen_above(node: Node) -> bool:
    """Whether text is visible around a node: as the nearest element above it says that says so."""
    for one in node.up():
        if one is not node and visibility(one, True) == visibility(one, False):
            return visibility(one, True)
    return True


def extract_text(html: str | None) -> str:
    """All visible text of a page, laid out."""
    root = body(parse(html))
    plain = "visibility" not in (html or "").lower()
    laid: dict[int, list[str]] = {}
    for table in reversed([n for n in root.walk() if n.tag == "table"]):
        laid[id(table)] = _table(table, plain or _seen_above(table), laid)
    return "\n".join(_render([root], laid))


def extract(df: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per row of df: ``page_id, n_chars, n_lines, text``. Null and empty markup, and pages
    without visible text, give the empty text. Ids may be null or repeat; pages may be of any length and
    depth. Other columns of df are ignored, whatever their names. An empty table gives an empty result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = [extract_text(h) for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_pydict({
                    "page_id": part.column("page_id"), "n_chars": pa.array([len(t) for t in texts], pa.int64()),
                    "n_lines": pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64()), "text": pa.array(texts, pa.string()),
                })

    rows = df.select(column(df, id_col, "bigint").alias("page_id"), F.coalesce(column(df, html_col, "string"), F.lit("")).alias("html"))
    return rows.mapInArrow(run, "page_id long, n_chars long, n_lines long, text string")
