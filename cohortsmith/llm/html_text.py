"""Visible text of HTML pages, laid out as a reader sees it.

The page becomes a tree (end tags that HTML implies are added, unknown ones ignored),
invisible parts are left out, and the rest is written with the spacing of blocks,
markers and indents of lists, and table cells in aligned columns.  Rows are
independent of each other, so the work needs no shuffle.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from cohortsmith.llm.tables import column

VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
# Elements that are never shown.
HIDDEN = frozenset(
    "area audio base canvas datalist head iframe link meta noembed noframes noscript "
    "object param rp script source style svg template title track video".split()
)
# Elements that start on a line of their own, and those with a blank line around.
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre search section summary table "
    "caption tbody td tfoot th thead tr ul".split()
)
SPACED = frozenset(
    "blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 ol p pre table ul menu dir".split()
)
LISTS = frozenset("ol ul menu dir".split())
# Start tags that end an open paragraph.
ENDS_P = BLOCK - frozenset(
    "html body caption tbody td tfoot th thead tr option optgroup legend".split()
)
# Start tag to the open elements it ends, and where the search for them stops.
IMPLIED = {
    "li": ({"li"}, LISTS),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "rt": ({"rt", "rp"}, {"ruby"}),
    "rp": ({"rt", "rp"}, {"ruby"}),
    "body": ({"head"}, {"html"}),
}
# What may stand in a head; any other start tag ends it.
IN_HEAD = frozenset(
    "html head base link meta title style script noscript template".split()
)
# An end tag does not reach beyond these.
SCOPE = frozenset("table td th caption html template".split())
# Elements nested deeper are not part of the tree; their text is, in its order, with
# line breaks where they are blocks and without what they hide.
DEEPEST = 200

# A table whose aligned lines would be so many times longer than its text is written
# without alignment, cells two spaces apart.
PADDING = 50

_NOT_DISPLAYED = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(hidden|collapse|visible)", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str | None]):
        self.tag, self.attrs, self.children = tag, attrs, []


class TreeBuilder(HTMLParser):
    """Builds a tree of nodes and strings.

    ``open`` holds all open elements, ``places`` where those of a tag are in it, so that
    no search takes longer on a deeper page.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {})
        self.open = [self.root]
        self.places: dict[str, list[int]] = {}
        # For elements below the tree: whether they are displayed, and visible.
        self.below: list[tuple[bool, bool | None]] = []

    def _last(self, tags) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def _cut(self, size: int) -> None:
        while len(self.open) > size:
            self.places[self.open.pop().tag].pop()
            if len(self.open) > DEEPEST:
                self.below.pop()

    def _close_to(self, tags, stop) -> None:
        while (at := self._last(tags)) > self._last(stop):
            tag = self.open[at].tag
            self._cut(at)
            if tags == {tag}:
                return

    def handle_starttag(self, tag, attrs):
        if tag == "html":
            return
        if tag not in IN_HEAD:
            self._close_to({"head"}, {"body"})
        if tag in ENDS_P:
            self._close_to({"p"}, SCOPE | {"button"})
        if tag in IMPLIED:
            self._close_to(*IMPLIED[tag])
        if tag in ("td", "th") and self.open[-1].tag in ("table", "tbody", "thead", "tfoot"):
            self._push(Node("tr", {}))
        node = Node(tag, dict(attrs))
        if tag in VOID:
            self._add(node)
        else:
            self._push(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def _push(self, node):
        if len(self.open) <= DEEPEST:
            self.open[-1].children.append(node)
        else:
            displayed, seen = self.below[-1] if self.below else (True, None)
            own = visibility(node)
            self.below.append((
                displayed and is_displayed(node), seen if own is None else own
            ))
            if node.tag in BLOCK and displayed:
                self._holder().children.append(Node("div", {}))
        self.places.setdefault(node.tag, []).append(len(self.open))
        self.open.append(node)

    def _holder(self) -> Node:
        return self.open[min(len(self.open) - 1, DEEPEST)]

    def _add(self, child) -> None:
        """A string or an empty element into the innermost open one."""
        if not self.below:
            self.open[-1].children.append(child)
            return
        displayed, seen = self.below[-1]
        if not displayed:
            return
        if seen is not None:
            style = "visible" if seen else "hidden"
            outer = Node("span", {"style": f"visibility:{style}"})
            outer.children.append(child)
            child = outer
        self._holder().children.append(child)

    def handle_endtag(self, tag):
        if tag in ("html", "body"):
            return
        if tag == "br":
            self._add(Node("br", {}))
            return
        stop = {"table"} if tag in ("tr", "tbody", "thead", "tfoot", "td", "th") else SCOPE - {tag}
        at = self._last({tag})
        if at > self._last(stop - {tag}):
            deep = len(self.open) > DEEPEST + 1 and tag in BLOCK and self.below[-1][0]
            self._cut(at)
            if deep:
                self._holder().children.append(Node("div", {}))

    def handle_data(self, data):
        if self.open[-1].tag == "head" and data.strip():
            self._cut(len(self.open) - 1)
        self._add(data)


def is_displayed(node: Node) -> bool:
    attrs = node.attrs
    if node.tag in HIDDEN or "hidden" in attrs:
        return False
    if node.tag == "input" and (attrs.get("type") or "").lower() == "hidden":
        return False
    if node.tag == "dialog" and "open" not in attrs:
        return False
    style = attrs.get("style")
    return not (style and _NOT_DISPLAYED.search(style))


def visibility(node: Node) -> bool | None:
    """Whether the element's own style shows or hides it; None if it inherits that."""
    style = node.attrs.get("style")
    found = _VISIBILITY.findall(style) if style else None
    return found[-1].lower() == "visible" if found else None


def width(text: str) -> int:
    """Columns a text takes: wide characters two, combining ones none."""
    if text.isascii():
        return len(text)
    return sum(
        0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1
        for c in text
    )


class Page:
    """Lines with collapsed spaces, wanted breaks and a prefix for nested blocks."""

    def __init__(self):
        self.lines: list[str] = []
        self.line = ""
        self.gap = False  # a space is due before the next word
        self.breaks = 0  # 1: new line is due, 2: blank line is due
        self.indent = ""
        self.marker = ""  # list marker for the next line

    def words(self, text: str) -> None:
        parts = _SPACE.split(text)
        for k, part in enumerate(parts):
            if k:
                self.gap = True
            if part:
                self._settle()
                self.line += (" " if self.gap and self.line else "") + part
                self.gap = False

    def verbatim(self, text: str) -> None:
        for k, part in enumerate(text.split("\n")):
            if k:
                self.newline()
            if part:
                self._settle()
                self.line += part.rstrip("\r")
        self.gap = False

    def _settle(self) -> None:
        if self.breaks:
            self._flush()
            if self.breaks == 2 and self.lines and self.lines[-1]:
                self.lines.append("")
            self.breaks, self.gap = 0, False

    def _flush(self) -> None:
        if self.line:
            if self.marker:
                head, self.marker = self.marker, ""
            else:
                head = self.indent
            self.lines.append((head + self.line).rstrip())
            self.line = ""

    def newline(self) -> None:
        """A forced line break."""
        self._settle()
        if self.line:
            self._flush()
        else:
            self.lines.append("")
        self.gap = False

    def block(self, breaks: int) -> None:
        if self.line or self.lines or self.breaks:
            self.breaks = max(self.breaks, breaks)

    def edge(self) -> None:
        """Write the open line, so that marker and indent can change."""
        self._flush()
        self.gap = False

    def text(self) -> str:
        self._flush()
        out = "\n".join(self.lines)
        return re.sub(r"\n{3,}", "\n\n", out).strip("\n")


def _roman(n: int) -> str:
    out = ""
    for value, sign in (
        (1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"),
        (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i"),
    ):
        out += sign * (n // value)
        n %= value
    return out


def _letters(n: int) -> str:
    out = ""
    while n > 0:
        n, rest = divmod(n - 1, 26)
        out = chr(97 + rest) + out
    return out


def _whole(value: str | None, other: int) -> int:
    try:
        return int((value or "").strip())
    except ValueError:
        return other


def _marker(kind: str | None, n: int) -> str:
    if kind in ("a", "A") and n > 0:
        text = _letters(n)
    elif kind in ("i", "I") and 0 < n < 4000:
        text = _roman(n)
    else:
        text = str(n)
    return (text.upper() if kind in ("A", "I") else text) + ". "


def render(node: Node, page: Page, pre: bool = False, shown: bool = True) -> None:
    """Write what a node shows; ``shown`` is the visibility it inherits or has."""
    number, step = 1, 1
    if node.tag == "ol":
        items = sum(not isinstance(c, str) and c.tag == "li" for c in node.children)
        backwards = "reversed" in node.attrs
        number = _whole(node.attrs.get("start"), items if backwards else 1)
        step = -1 if backwards else 1
    closed = node.tag == "details" and "open" not in node.attrs
    for child in node.children:
        if isinstance(child, str):
            if closed or node.tag in ("table", "tbody", "thead", "tfoot", "tr") and not child.strip():
                continue
            if shown:
                page.verbatim(child) if pre else page.words(child)
            continue
        if not is_displayed(child) or closed and child.tag != "summary":
            continue
        tag = child.tag
        own = visibility(child)
        seen = shown if own is None else own
        if tag == "br":
            if seen:
                page.newline()
        elif tag == "input":
            kind = (child.attrs.get("type") or "text").lower()
            if seen and kind in ("submit", "button", "reset", "text", "search"):
                page.words(f" {child.attrs.get('value') or ''} ")
        elif tag == "table":
            page.block(2)
            _table(child, page, seen)
            page.block(2)
        elif tag == "li":
            if node.tag == "ol":
                number = _whole(child.attrs.get("value"), number)
                mark = _marker(node.attrs.get("type"), number)
                number += step
            else:
                mark = "- "
            if not seen:
                mark = " " * len(mark)
            page.block(1)
            page._settle()
            page.edge()
            outer, outer_marker = page.indent, page.marker
            page.marker = (outer_marker or outer) + mark
            page.indent = outer + " " * len(mark)
            render(child, page, pre, seen)
            page.edge()
            page.indent = outer
            page.marker = ""
            page.block(1)
        elif tag in BLOCK:
            nested_list = tag in LISTS and node.tag == "li"
            breaks = 2 if tag in SPACED and not nested_list else 1
            page.block(breaks)
            if tag in ("blockquote", "dd"):
                page._settle()
                page.edge()
                outer = page.indent
                page.indent = outer + "  "
                render(child, page, pre, seen)
                page.edge()
                page.indent = outer
            else:
                render(child, page, pre or tag == "pre", seen)
            page.block(breaks)
        elif tag == "textarea":
            if seen:
                page.verbatim("".join(c for c in child.children if isinstance(c, str)))
        elif tag in ("img", "wbr", "col"):
            continue
        else:
            render(child, page, pre, seen)


def _rows(table: Node) -> tuple[list[Node], list[tuple[Node, bool | None]]]:
    """Captions (and whatever else has no cell) and rows, in the order they show.

    A row comes with the visibility that its part of the table gives it.
    """
    captions, head, body, foot = [], [], [], []
    for child in table.children:
        if isinstance(child, str):
            if child.strip():
                captions.append(Node("div", {}))
                captions[-1].children.append(child)
        elif not is_displayed(child):
            continue
        elif child.tag == "tr":
            body.append((child, None))
        elif child.tag in ("thead", "tbody", "tfoot"):
            into = {"thead": head, "tbody": body, "tfoot": foot}[child.tag]
            own = visibility(child)
            style = {} if own is None else {"style": f"visibility:{'visible' if own else 'hidden'}"}
            for row in child.children:
                if isinstance(row, str):
                    if row.strip():
                        captions.append(Node("div", style))
                        captions[-1].children.append(row)
                elif not is_displayed(row):
                    continue
                elif row.tag == "tr":
                    into.append((row, own))
                else:
                    captions.append(Node("div", style))
                    captions[-1].children.append(row)
        elif child.tag not in ("col", "colgroup"):
            captions.append(child)
    return captions, head + body + foot


class Taken:
    """Columns that cells of earlier rows reach down into, as ranges."""

    def __init__(self):
        self.ranges: list[list[int]] = []  # first column, last + 1, row they end before
        self.new: list[list[int]] = []
        self.at = 0

    def next_row(self, row: int) -> None:
        merged: list[list[int]] = []
        for first, last, until in sorted([r for r in self.ranges + self.new if r[2] > row]):
            if merged and merged[-1][1] == first and merged[-1][2] == until:
                merged[-1][1] = last
            else:
                merged.append([first, last, until])
        self.ranges, self.new, self.at = merged, [], 0

    def free(self, column: int) -> int:
        """The first free column from ``column`` on; columns only grow inside a row."""
        while self.at < len(self.ranges) and self.ranges[self.at][0] <= column:
            column = max(column, self.ranges[self.at][1])
            self.at += 1
        return column

    def put(self, column: int, columns: int, until: int) -> None:
        self.new.append([column, column + columns, until])


def _table(table: Node, page: Page, shown: bool = True) -> None:
    captions, rows = _rows(table)
    holder = Node("div", {})
    holder.children = captions
    render(holder, page, False, shown)
    grid: list[dict[int, list[str]]] = []
    taken = Taken()
    for r, (row, of_part) in enumerate(rows):
        taken.next_row(r)
        own = visibility(row)
        row_shown = own if own is not None else shown if of_part is None else of_part
        cells, c = {}, 0
        for cell in row.children:
            if isinstance(cell, str):
                if not cell.strip():
                    continue
                text = " ".join(cell.split()) if row_shown else ""
                spans = (1, 1)
            elif not is_displayed(cell):
                continue
            else:
                inner = Page()
                one = Node("div", {})
                is_cell = cell.tag in ("td", "th")
                one.children = cell.children if is_cell else [cell]
                own = visibility(cell) if is_cell else None
                render(one, inner, False, row_shown if own is None else own)
                text = inner.text()
                spans = (
                    min(max(_whole(cell.attrs.get("colspan"), 1), 1), 1000),
                    min(max(_whole(cell.attrs.get("rowspan"), 1), 1), len(rows) - r),
                )
            c = taken.free(c)
            if spans[1] > 1:
                taken.put(c, spans[0], r + spans[1])
            cells[c] = text.split("\n") if text else [""]
            c += spans[0]
        grid.append(cells)
    columns = sorted({c for cells in grid for c, text in cells.items() if any(text)})
    widths = dict.fromkeys(columns, 0)
    for cells in grid:
        for c, text in cells.items():
            if c in widths:
                widths[c] = max(widths[c], max(map(width, text)))
    order = {c: k for k, c in enumerate(columns)}
    # Where each column starts in an aligned line.
    begins, through = {}, 0
    for c in columns:
        begins[c] = through
        through += widths[c] + 2
    aligned = text = 0
    for cells in grid:
        height = max((len(t) for t in cells.values()), default=0)
        last = max((c for c in cells if c in order), default=None)
        if last is not None:
            aligned += height * (begins[last] + widths[last])
        text += sum(len(line) + 2 for t in cells.values() for line in t)
    pad = aligned <= PADDING * (text + 1000)
    for cells in grid:
        filled = sorted(c for c in cells if c in order)
        height = max((len(t) for t in cells.values()), default=0)
        for k in range(height):
            line, at = "", 0
            for c in filled:
                value = cells[c][k] if k < len(cells[c]) else ""
                if not value:
                    continue
                if pad:
                    line += " " * (begins[c] - at) + value
                    at = begins[c] + width(value)
                else:
                    line += ("  " if line else "") + value
            if line.strip():
                page.block(1)
                page._settle()
                page.edge()
                page.line = line.rstrip()
                page.block(1)


def html_to_text(html: str | None) -> str:
    """All visible text of a page; empty for NULL."""
    if not html:
        return ""
    builder = TreeBuilder()
    builder.feed(html)
    builder.close()
    page = Page()
    render(builder.root, page)
    return page.text()


def extract(
    pages: DataFrame, id_column: str = "page_id", html_column: str = "html"
) -> DataFrame:
    """``id_column, text`` of every page.

    NULL and empty pages give an empty text; repeated rows are treated alike; other
    columns do not matter; an empty table gives an empty result.
    """
    rows = pages.select(
        column(pages, id_column).alias("id"), column(pages, html_column).alias("html")
    )

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [html_to_text(h.as_py()) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(texts, pa.string())], names=["id", "text"]
            )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(each, f"id {kind}, text string").withColumnRenamed(
        "id", id_column
    )
