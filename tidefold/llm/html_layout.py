"""Visible text of HTML pages, laid out: blocks, lists and aligned table cells.

A page is read once. The tree builder keeps the open elements on a stack and
supplies the tags that authors leave out (the ends of ``p``, ``li``, ``dd``, ``td``,
``tr`` and their like, rows of bare cells, the end of the head). Every element that
lays out on its own (list item, cell, quote) collects lines in a box of its own,
which is set into the box around it when the element ends, so depth costs no
recursion. Text is kept unless a rule hides it: elements that are never shown,
``hidden``, ``display:none``, ``visibility:hidden`` (until a descendant turns it on
again), closed ``details`` and ``dialog``.

Paragraph-like blocks stand apart by one empty line, other blocks begin a line.
Lists are marked and indented, cells of a table are padded to their column's
width and parted by `` | ``; a cell of several lines stays in its column. A cell
takes the columns and rows of its ``colspan`` and ``rowspan``; columns in which no
cell begins are not drawn.

The work is linear in the page but for tables: nested boxes are set into each other
once, at the end, marks and indents grow up to ``INDENT`` columns and stay there for
what is nested deeper, and tables nested deeper than ``TABLES`` are plain blocks.
What follows the last ``>`` of a page holds no tag and is not searched for any.

Never fails on broken markup: an unknown or stray tag is passed over, an
unfinished one is text. NULL and empty pages have the empty text. Rows are
handled one by one; nothing depends on other rows or columns.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.llm.common import table

# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
NEVER_SHOWN = frozenset(
    "script style title iframe noembed noframes noscript template head datalist audio video canvas object rp area param source track".split()
)
IN_HEAD = frozenset("base basefont bgsound link meta noscript script style template title head html".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure hr menu dir".split())
BLOCK = SPACED | frozenset(
    "address article aside body caption center dd details dialog div dt fieldset figcaption footer form header hgroup html legend li main nav "
    "optgroup option search section summary tbody td tfoot th thead tr".split()
)
ENDS_P = BLOCK - frozenset("td th tr tbody thead tfoot caption li dd dt option optgroup body html legend".split()) | frozenset(("li", "dd", "dt"))
# What a start tag ends, and the elements beyond which it does not reach.
IMPLIED_ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select", "datalist", "optgroup")),
    "optgroup": (("option", "optgroup"), ("select",)),
    "td": (("td", "th"), ("table", "tr")),
    "th": (("td", "th"), ("table", "tr")),
    "tr": (("tr", "td", "th", "caption"), ("table",)),
    "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th", "caption"), ("table",)),
    "thead": (("tbody", "thead", "tfoot", "tr", "td", "th", "caption"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot", "tr", "td", "th", "caption"), ("table",)),
}
# Elements that an end tag from outside a cell or table does not cross.
WALLS = frozenset(("table", "td", "th", "caption"))

# Columns of indent at most, and tables in tables; the limits of spans are those of the HTML standard.
INDENT, TABLES = 64, 8
MOST_COLUMNS, MOST_ROWS = 1_000, 65_534

IN_TABLE = frozenset("caption tbody td tfoot th thead tr".split())

_tag = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*>|</(?![a-zA-Z])[^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""",
    re.DOTALL,
)
_unended = re.compile(r"<!--|<!\[CDATA\[")
_attribute = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_spaces = re.compile(r"[ \t\n\r\f]+")
_hiding = re.compile(r"display\s*:\s*none", re.IGNORECASE)
_visibility = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.IGNORECASE)


class Box:
    """Lines of text, and marked groups of such, with pending space and pending empty lines."""

    def __init__(self):
        self.lines: list[str | tuple[str, list]] = []
        self.line: list[str] = []
        self.space = False
        self.gap = 0

    def _begin(self) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = 0

    def text(self, words: str) -> None:
        """Text in which white space counts as one space."""
        flat = _spaces.sub(" ", words)
        body = flat.strip(" ")
        if not body:
            self.space = self.space or (bool(flat) and bool(self.line))
            return
        if not self.line:
            self._begin()
        elif self.space or flat[0] == " ":
            self.line.append(" ")
        self.line.append(body)
        self.space = flat[-1] == " "

    def verbatim(self, words: str) -> None:
        for number, part in enumerate(words.replace("\r\n", "\n").split("\n")):
            if number:
                self.new_line()
            if part:
                if not self.line:
                    self._begin()
                elif self.space:
                    self.line.append(" ")
                self.space = False
                self.line.append(part)

    def new_line(self) -> None:
        """End the line, also an empty one inside the text."""
        if self.line:
            self.end_line()
        elif self.lines:
            self.lines.append("")

    def end_line(self) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip())
        self.line, self.space = [], False

    def apart(self, gap: int) -> None:
        self.end_line()
        self.gap = max(self.gap, gap)

    def add(self, lines: list) -> None:
        if lines:
            self.end_line()
            self._begin()
            self.lines += lines

    def finished(self) -> list:
        self.end_line()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def flat(lines: list) -> list[str]:
    """Lines with the groups in them set out: a group's mark before its first line, blanks before the others."""
    out, stack, head = [], [(iter(lines), "")], None
    while stack:
        entry = next(stack[-1][0], None)
        rest = stack[-1][1]
        if entry is None:
            stack.pop()
        elif isinstance(entry, tuple):
            mark, inner = entry
            head = (rest if head is None else head) + mark
            stack.append((iter(inner), rest + " " * len(mark) if len(rest) < INDENT else rest))
        else:
            out.append((rest if head is None else head) + entry if entry else entry)
            head = None
    return out


class Open:
    """An open element."""

    __slots__ = ("tag", "off", "unseen", "pre", "box", "own", "count", "mark", "closed", "deep", "span")

    def __init__(self, tag, off, unseen, pre, box, own=None):
        self.tag, self.off, self.unseen, self.pre, self.box, self.own = tag, off, unseen, pre, box, own
        self.count, self.mark, self.closed, self.deep, self.span = 0, "", False, False, (1, 1)


def _placed(rows: list[list[tuple[list[str], int, int]]]) -> list[list[tuple[int, int, list[str]]]]:
    """(first column, columns, lines) of each row's cells, and of cells of earlier rows that reach into it, in order."""
    out, hanging = [], []  # hanging: (first column, columns, rows left)
    for row in rows:
        reaching = sorted(hanging)
        placed = [(at, wide, []) for at, wide, _ in reaching]
        hanging = [(at, wide, left - 1) for at, wide, left in hanging if left > 1]
        at = turn = 0
        for lines, wide, high in row:
            while turn < len(reaching) and reaching[turn][0] <= at:
                at = max(at, reaching[turn][0] + reaching[turn][1])
                turn += 1
            placed.append((at, wide, lines))
            if high > 1:
                hanging.append((at, wide, high - 1))
            at += wide
        out.append(sorted(placed, key=lambda x: x[0]))
    return out


def _aligned(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Lines of a table whose cells are (lines, columns, rows)."""
    placed = _placed(rows)
    # Only columns in which a cell begins are drawn.
    begins = sorted({at for row in placed for at, _, _ in row})
    width, spread = [0] * len(begins), []
    for row in placed:
        for at, wide, lines in row:
            first, last = bisect_left(begins, at), bisect_left(begins, at + wide)
            longest = max(map(len, lines), default=0)
            if last - first == 1:
                width[first] = max(width[first], longest)
            else:
                spread.append((last - first, first, last, longest))
    for _, first, last, longest in sorted(spread):
        width[last - 1] += max(0, longest - sum(width[first:last]) - 3 * (last - first - 1))
    out = []
    for row, own in zip(placed, rows):
        for level in range(max((len(lines) for lines, _, _ in own), default=0)):
            parts, column = [], 0
            for at, wide, lines in row:
                first, last = bisect_left(begins, at), bisect_left(begins, at + wide)
                if first < column:
                    continue  # a cell below one that reaches down; its text is in the rows it began in
                parts += [" " * width[c] for c in range(column, first)]
                text = lines[level] if level < len(lines) else ""
                parts.append(text.ljust(sum(width[first:last]) + 3 * (last - first - 1)))
                column = last
            out.append(" | ".join(parts).rstrip())
    return out


def _span(found: dict, name: str, most: int) -> int:
    number = found.get(name, "").strip()
    if not re.fullmatch(r"\d{1,9}", number, re.ASCII):
        return 1
    value = int(number)
    return min(value, most) if value else (most if name == "rowspan" else 1)


class _Page:
    def __init__(self):
        self.box = Box()
        self.stack = [Open("", False, False, False, self.box)]
        self.rows: list[list] = []  # rows of the open tables, innermost last
        self.open: Counter = Counter()  # how many elements of each tag are open

    def text(self, raw: str, literal: bool = False) -> None:
        top = self.stack[-1]
        if top.tag == "head" and raw.strip():
            self.close_to(len(self.stack) - 1)
            top = self.stack[-1]
        if top.off or top.unseen or (top.closed and raw.strip()):
            return
        words = raw if literal or "&" not in raw else unescape(raw)
        if "\xa0" in words and not top.pre:
            words = words.replace("\xa0", " ")
        if top.tag in ("table", "tr", "tbody", "thead", "tfoot") and not words.strip():
            return
        top.box.verbatim(words) if top.pre else top.box.text(words)

    def close_to(self, size: int) -> None:
        """Close open elements until ``size`` are left."""
        while len(self.stack) > size:
            done = self.stack.pop()
            self.open[done.tag] -= 1
            tag, around = done.tag, self.stack[-1].box
            if done.own is not None:
                lines = done.own.finished()
                if tag in ("td", "th"):
                    if self.rows and self.rows[-1]:
                        self.rows[-1][-1].append((flat(lines), *done.span))
                elif tag == "table":
                    captions, rows = lines, self.rows.pop()
                    if not done.off:
                        around.apart(1)
                        around.add(captions + _aligned(rows))
                        around.apart(1)
                elif not done.off:
                    around.apart(0)
                    around.add([(done.mark, lines)] if lines else [])
                    around.apart(1 if tag == "blockquote" else 0)
            elif tag in BLOCK and not done.off:
                around.apart(1 if tag in SPACED else 0)

    def find(self, tags, walls) -> int:
        """Place of the nearest open element of ``tags`` before a wall, or 0."""
        if not any(self.open[t] for t in tags):
            return 0
        for at in range(len(self.stack) - 1, 0, -1):
            if self.stack[at].tag in tags:
                return at
            if self.stack[at].tag in walls:
                return 0
        return 0

    def start(self, tag: str, attributes: str, self_closing: bool) -> None:
        if self.stack[-1].tag == "head" and tag not in IN_HEAD:
            self.close_to(len(self.stack) - 1)
        if tag in ENDS_P:
            at = self.find(("p",), WALLS)
            if at:
                self.close_to(at)
        if tag in IN_TABLE and not self.open["table"]:
            return  # passed over outside a table
        if tag in IMPLIED_ENDS:
            ends, walls = IMPLIED_ENDS[tag]
            while at := self.find(ends, walls):
                self.close_to(at)
        if tag in ("td", "th") and not self.find(("tr",), ("table", "td", "th")) and self.find(("table",), ()):
            self.start("tr", "", False)
        around = self.stack[-1]
        found = {}
        if attributes:
            for name, a, b, c in _attribute.findall(attributes):
                found.setdefault(name.lower(), a or b or c)
        style = found.get("style", "")
        off = (
            around.off or tag in NEVER_SHOWN or ("hidden" in found and tag != "input") or bool(style and _hiding.search(style))
            or (tag == "dialog" and "open" not in found) or (around.closed and tag != "summary")
        )
        shown = _visibility.search(style) if style else None
        unseen = around.unseen if not shown else shown.group(1).lower() != "visible"
        box = around.box
        if tag == "br":
            if not (off or unseen):
                box.new_line()
            return
        if tag == "hr":
            if not off:
                box.apart(1)
            return
        if tag in VOID:
            return
        own = None
        deep = around.deep or (tag == "table" and len(self.rows) >= TABLES)
        if tag in ("li", "blockquote", "dd") or (tag in ("td", "th", "table") and not deep):
            own = Box()
        elif tag in BLOCK and not off:
            box.apart(1 if tag in SPACED and not (tag in ("ul", "ol") and self.find(("li",), ("table",))) else 0)
        element = Open(tag, off, unseen, around.pre or tag in ("pre", "textarea"), own or box, own)
        element.closed = tag == "details" and "open" not in found
        element.deep = deep
        if deep:
            pass  # a block like any other
        elif tag == "table":
            self.rows.append([])
        elif tag == "tr" and self.rows:
            self.rows[-1].append([])
        elif tag in ("td", "th"):
            element.span = _span(found, "colspan", MOST_COLUMNS), _span(found, "rowspan", MOST_ROWS)
        if tag in IN_TABLE or tag == "table":
            pass
        elif tag == "li":
            at = self.find(("ul", "ol", "menu", "dir"), ("table",))
            element.mark = "- "
            if at and self.stack[at].tag == "ol":
                self.stack[at].count += 1
                element.mark = f"{self.stack[at].count}. "
        elif tag in ("dd", "blockquote"):
            element.mark = "  "
            if tag == "blockquote" and not off:
                box.apart(1)
        elif tag == "ol":
            number = found.get("start", "")
            element.count = int(number) - 1 if re.fullmatch(r"-?\d{1,9}", number, re.ASCII) else 0
        if not self_closing or tag in BLOCK:
            self.stack.append(element)
            self.open[tag] += 1
        if tag in ("option", "button") and not off:
            element.box.apart(0) if tag == "option" else element.box.text(" ")

    def end(self, tag: str) -> None:
        if tag == "br":
            return self.start("br", "", False)
        at = self.find((tag,), WALLS - {tag} if tag not in ("table", "tr", "tbody", "thead", "tfoot") else ("table",) if tag != "table" else ())
        if at:
            self.close_to(at)
        elif tag == "p" and not self.stack[-1].off:
            self.stack[-1].box.apart(1)

    def finished(self) -> str:
        self.close_to(1)
        return "\n".join(flat(self.box.finished()))


def visible_text(html: str | None) -> str:
    if not html:
        return ""
    page, at, lowered = _Page(), 0, None
    last = html.rfind(">") + 1
    while True:
        found = _tag.search(html, at, last) if at < last else None
        if not found:
            _tail(page, html[at:])
            return page.finished()
        if found.start() > at:
            page.text(html[at : found.start()])
        if found.end() == last and (html.startswith("<!--", found.start()) and not found.group().endswith("-->") or html.startswith("<![CDATA[", found.start()) and not found.group().endswith("]]>")):
            _tail(page, html[found.start() :])
            return page.finished()
        at = found.end()
        data, end, name, attributes, end2, name2, attributes2 = found.groups()
        if data is not None:
            page.text(data, True)
        name = name or name2
        if not name:
            continue
        name, attributes = name.lower(), attributes or attributes2 or ""
        if end or end2:
            page.end(name)
            continue
        page.start(name, attributes, attributes.endswith("/"))
        if name in RAW:
            lowered = lowered or re.sub("[A-Z]", lambda m: m.group().lower(), html)
            stop = lowered.find(f"</{name}", at)
            stop = len(html) if stop < 0 else stop
            page.text(html[at:stop], name not in ("title", "textarea"))
            page.end(name)
            close = html.find(">", stop)
            at = len(html) if close < 0 else close + 1


def _tail(page: _Page, rest: str) -> None:
    """What is left when no tag follows: text up to a comment or character data that never ends."""
    begin = _unended.search(rest)
    if not begin:
        return page.text(rest)
    page.text(rest[: begin.start()])
    if begin.group() != "<!--":
        page.text(rest[begin.end() :], True)


def _rendered(batches):
    for batch in batches:
        texts = [visible_text(h) for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(texts, pa.string())], ["page_id", "text"])


def rendered(pages: DataFrame) -> DataFrame:
    """(page_id, text) of each row of ``pages(page_id, html)``."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html"))
    return own.mapInArrow(_rendered, "page_id long, text string")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered(table(spark, sf_dir, "pages"))


CHECKS = {"op4_html_layout": (op4, None)}
