"""Visible text of HTML pages, laid out as a page would be.

A tree is built with the end tags that HTML implies; hidden parts leave; the rest is rendered: blocks on
their own lines, blank lines around paragraphs, list markers and indents, preformatted
text as it is, and table cells padded so that columns align.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, field

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
UNSEEN = frozenset("head script style title noscript template iframe noembed noframes object audio video canvas svg math datalist".split())
APART = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure hr fieldset".split())
BLOCK = APART | frozenset("html body address article aside center details dialog dd div dt figcaption footer form header hgroup legend li main menu nav option section summary tr caption thead tbody tfoot td th".split())
CLOSES_P = APART | frozenset("address article aside center details dialog div dd dt figcaption footer form header hgroup li main menu nav section summary".split())
#: A start tag closes an open element of these names, unless one of the fences stands between.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset("ul ol menu table".split())),
    "dt": (frozenset(["dt", "dd"]), frozenset("dl table".split())),
    "dd": (frozenset(["dt", "dd"]), frozenset("dl table".split())),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "tr": (frozenset("tr td th".split()), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "thead": (frozenset("thead tbody tfoot tr td th caption".split()), frozenset(["table"])),
    "tbody": (frozenset("thead tbody tfoot tr td th caption".split()), frozenset(["table"])),
    "tfoot": (frozenset("thead tbody tfoot tr td th caption".split()), frozenset(["table"])),
    "body": (frozenset(["head"]), frozenset()),
}
CELL_GAP = "  "

#: Layout limits; text beyond them is kept, but no longer indented, aligned or spanned, so that a page's text stays in proportion to its source.
MAX_INDENT, MAX_CELL, MAX_TABLE, MAX_TABLES, MAX_SPANNED = 40, 80, 1000, 8, 250

_TAG_NAME = re.compile(r"[a-zA-Z][^ \t\n\r\f/>]*")
_COMMENT_END = re.compile(r"--!?>")
_GAP = re.compile(r"[ \t\n\r\f/]*")
_BLANK = re.compile(r"[ \t\n\r\f]*")
_ATTRIBUTE_NAME = re.compile(r"[^ \t\n\r\f/>][^ \t\n\r\f/>=]*")
_BARE_VALUE = re.compile(r"[^ \t\n\r\f>]+")
_LONG_NUMBER = re.compile(r"&#(?:0*([0-9]*)|[xX]0*([0-9a-fA-F]*));?")
_SPACES = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("attributes", "children", "tag")

    def __init__(self, tag: str, attributes: dict[str, str]) -> None:
        self.tag, self.attributes, self.children = tag, attributes, []


def _unescaped(text: str) -> str:
    """Character references as characters; numbers of any length, of which Python converts only short ones."""
    if "&" not in text:
        return text
    if "&#" in text:
        text = _LONG_NUMBER.sub(lambda m: m[0] if len(m[0]) < 100 else "\ufffd" if len(m[1] or m[2] or "") > 7 else f"&#{m[1] or '0'};" if m[1] is not None else f"&#x{m[2] or '0'};", text)
    return html.unescape(text)


def scan_attributes(source: str, at: int) -> tuple[dict[str, str], int]:
    """Attributes from a place behind a tag's name on, and the place behind its ``>``; -1 where the tag never ends. The first of equal names counts."""
    found: dict[str, str] = {}
    size = len(source)
    while True:
        at = _GAP.match(source, at).end()
        if at >= size:
            return found, -1
        if source[at] == ">":
            return found, at + 1
        name = _ATTRIBUTE_NAME.match(source, at)
        at, value = name.end(), ""
        equals = _BLANK.match(source, at).end()
        if source.startswith("=", equals):
            at = _BLANK.match(source, equals + 1).end()
            if at >= size:
                return found, -1
            if source[at] in "\"'":
                end = source.find(source[at], at + 1)
                if end < 0:
                    return found, -1
                value, at = source[at + 1 : end], end + 1
            elif source[at] != ">":
                bare = _BARE_VALUE.match(source, at)
                value, at = bare[0], bare.end()
        found.setdefault(name[0].lower(), _unescaped(value))


class Open:
    """Open elements, and for each tag their places on the stack, so that closing takes no walk over it."""

    def __init__(self, root: Node) -> None:
        self.stack, self.places = [root], {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def pop(self) -> None:
        self.places[self.stack.pop().tag].pop()

    def innermost(self, tags: frozenset[str]) -> int:
        return max((x[-1] for x in map(self.places.get, tags) if x), default=0)

    def close(self, names: frozenset[str], fences: frozenset[str], all_: bool) -> None:
        """End the innermost element of the names, or all of them, that no fence encloses further in."""
        while (at := self.innermost(names)) and at > self.innermost(fences):
            while len(self.stack) > at:
                self.pop()
            if not all_:
                return


def build_tree(source: str) -> Node:
    """The document's elements, with implied end tags; what is never closed ends with its parent.

    Takes time in proportion to the source. From a tag on that never ends (a quote left open), quotes have no meaning and tags end at their first ``>``.
    """
    root = Node("#root", {})
    here, at, size, loose = Open(root), 0, len(source), False
    last_end = source.rfind(">")
    stack = here.stack

    while at < size:
        start = source.find("<", at)
        if start < 0:
            stack[-1].children.append(_unescaped(source[at:]))
            break
        if start > at:
            stack[-1].children.append(_unescaped(source[at:start]))
        if source.startswith("<!--", start):
            if source.startswith((">", "->"), start + 4):
                at = source.index(">", start) + 1
            else:
                end = _COMMENT_END.search(source, start + 4)
                at = end.end() if end else size
            continue
        if start < last_end and (source.startswith(("<!", "<?"), start) or (source.startswith("</", start) and not _TAG_NAME.match(source, start + 2))):
            at = source.index(">", start) + 1
            continue
        slash = source.startswith("</", start)
        name = _TAG_NAME.match(source, start + 1 + slash)
        if name is None or name.end() > last_end:
            stack[-1].children.append("<")
            at = start + 1
            continue
        tag = name[0].lower()
        if source[name.end()] == ">":
            attributes, end = {}, name.end() + 1
        elif loose:
            end = source.index(">", name.end()) + 1
            attributes = scan_attributes(source[name.end() : end - 1].replace('"', " ").replace("'", " ") + ">", 0)[0]
        else:
            attributes, end = scan_attributes(source, name.end())
            if end < 0:
                loose, at = True, start
                continue
        at = end
        if slash:
            if tag == "p" and not here.places.get("p"):
                stack[-1].children.append(Node("p", {}))
            elif tag == "br":
                stack[-1].children.append(Node("br", {}))
            else:
                here.close(frozenset([tag]), frozenset() if tag in ("table", "body", "html") else frozenset(["table"]) if tag in ("tr", "thead", "tbody", "tfoot") else frozenset(["td", "th"]) - {tag}, False)
            continue
        if tag in CLOSES_P:
            here.close(frozenset(["p"]), frozenset("td th table button object".split()), False)
        if tag in IMPLIED:
            here.close(*IMPLIED[tag], True)
        if tag in ("html", "body"):
            if here.places.get(tag):
                known = stack[here.places[tag][0]]
                known.attributes = attributes | known.attributes
                continue
        elif stack[-1].tag == "head" and tag not in UNSEEN and tag not in ("meta", "link", "base"):
            here.pop()
        node = Node(tag, attributes)
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[ \t\n\r\f/>])", re.I).search(source, at)
            body = source[at : end.start() if end else size]
            node.children.append(_unescaped(body) if tag in ("textarea", "title") else body)
            at = source.find(">", end.end()) + 1 or size if end else size
        elif tag not in VOID:
            here.push(node)
    return root


def _style(raw: str) -> dict[str, str]:
    """Declarations of a style attribute; the last of equal names counts."""
    parts = (x.partition(":") for x in raw.lower().split(";"))
    return {name.strip(): value.replace("!important", "").strip() for name, _, value in parts}


def seen(node: Node, inherited: bool) -> bool | None:
    """None where an element and all in it have no box; else whether its own text shows, which what is inside may change."""
    a = node.attributes
    if node.tag in UNSEEN or "hidden" in a or (node.tag == "dialog" and "open" not in a):
        return None
    if "style" in a:
        style = _style(a["style"])
        if style.get("display") == "none":
            return None
        visibility = style.get("visibility", "inherit")
        return False if visibility in ("hidden", "collapse") else True if visibility == "visible" else inherited
    return inherited


def rendered(node: Node) -> list:
    """The children that have a box: of closed details, the first summary only."""
    if node.tag != "details" or "open" in node.attributes:
        return node.children
    return [x for x in node.children if isinstance(x, Node) and x.tag == "summary"][:1]


def _whole(node: Node, name: str, default: int) -> int:
    """A whole number of up to nine digits that an attribute gives."""
    given = node.attributes.get(name, "").strip()
    return int(given) if re.fullmatch(r"[+-]?[0-9]{1,9}", given) else default


def numeral(n: int, kind: str) -> str:
    """A list item's number as a list of that type shows it: letters or Roman numerals where they reach, else digits."""
    if kind in ("a", "A") and n > 0:
        letters = ""
        while n > 0:
            n, k = divmod(n - 1, 26)
            letters = chr(ord(kind) + k) + letters
        return letters
    if kind in ("i", "I") and 0 < n < 4000:
        out = ""
        for value, roman in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
            out, n = out + roman * (n // value), n % value
        return out.upper() if kind == "I" else out
    return str(n)


def _span(node: Node, name: str, limit: int) -> int:
    raw = node.attributes.get(name, "1").strip()
    return max(1, min(int(raw.lstrip("0")[:6] or "1"), limit)) if raw.isascii() and raw.isdigit() else 1


class Table:
    """Cells by row and column. A cell of several columns or rows has its text in the first, and the others stay empty."""

    def __init__(self) -> None:
        self.rows: list[dict[int, str]] = []
        self.spans: list[tuple[int, int, int]] = []  # first column, end, last row; of rows above
        self.own: list[tuple[int, int, int]] = []
        self.column = 0

    def new_row(self) -> None:
        self.rows.append({})
        last = len(self.rows) - 1
        self.spans = sorted(x for x in self.spans + self.own if x[2] >= last)
        self.own, self.column = [], 0

    def end_group(self) -> None:
        self.spans, self.own = [], []

    def add(self, cell: str, node: Node) -> None:
        if not self.rows:
            self.new_row()
        for first, end, _ in self.spans:
            if first <= self.column < end:
                self.column = end
        self.rows[-1][self.column] = cell
        end, rows = self.column + _span(node, "colspan", 1000), _span(node, "rowspan", 65534)
        if rows > 1 and end <= MAX_SPANNED:
            self.own.append((self.column, end, len(self.rows) + rows - 2))
        self.column = end

    def lines(self) -> list[str]:
        """Rows as lines; a cell of several lines makes its row as high. Columns without text take no room; cells wider than MAX_CELL don't widen
        theirs, and a table that is wider than MAX_TABLE isn't aligned."""
        widths: dict[int, int] = {}
        rows = [[(column, cell.split("\n")) for column, cell in row.items() if cell] for row in self.rows]
        for row in rows:
            for column, cell in row:
                widths[column] = max(widths.get(column, 0), *(len(x) for x in cell if len(x) <= MAX_CELL), 0)
        columns = sorted(widths)
        place = {column: n for n, column in enumerate(columns)}
        wide = sum(widths.values()) + len(CELL_GAP) * len(widths) > MAX_TABLE
        out = []
        for row in rows:
            for n in range(max((len(cell) for _, cell in row), default=0)):
                line = {place[column]: cell[n] for column, cell in row if n < len(cell) and cell[n]}
                out.append(CELL_GAP.join(line.values() if wide else (line.get(k, "").ljust(widths[columns[k]]) for k in range(max(line, default=-1) + 1))).rstrip(" "))
        return out


class Page:
    """Lines of one flow of text: a page, or a table cell."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = self.blank = False
        self.indent, self.marker = "", ""

    def write(self, text: str, keep: bool) -> None:
        if keep:
            first, *more = text.replace("\r\n", "\n").split("\n")
            self._put(first)
            for x in more:
                self.end_line(True)
                self._put(x)
            return
        words = _SPACES.sub(" ", text)
        if not words:
            return
        if words[0] == " ":
            self.space = True
        body = words.strip(" ")
        if body:
            if self.space and self.line:
                self.line.append(" ")
            self.space = False
            self._put(body)
            self.space = words[-1] == " "

    def _put(self, text: str) -> None:
        if not text:
            return
        if not self.line:
            if self.blank and self.lines:
                self.lines.append("")
            self.blank = False
            self.line.append(self.indent + self.marker)
            self.indent = (self.indent + " " * len(self.marker))[:MAX_INDENT]
            self.marker = ""
        self.line.append(text)

    def end_line(self, always: bool = False) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip(" "))
            self.line = []
        elif always and self.lines:
            self.lines.append("")
        self.space = False

    def apart(self) -> None:
        self.end_line()
        self.blank = True

    def text(self) -> str:
        self.end_line()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return "\n".join(self.lines)


def render(root: Node) -> str:
    """Visible text of a tree. Uses a stack of its own, so depth is not limited."""
    page, pages, tables, lists, kept, shown, deep = Page(), [], [], [], 0, True, 0
    todo: list[tuple[str, object, object]] = [("enter", root, None)]
    while todo:
        step, item, extra = todo.pop()
        if isinstance(item, str):
            if shown:
                page.write(item, kept > 0)
            continue
        tag = item.tag
        if step == "enter":
            own = seen(item, shown)
            if own is None:
                continue
            if tag == "br":
                if own:
                    page.end_line(True)
                continue
            before = (page.indent, page.marker, shown)
            shown = own
            in_table = bool(tables) and not deep and tag in ("tr", "td", "th", "thead", "tbody", "tfoot")
            if not in_table and tag in BLOCK:
                page.apart() if tag in APART and not (tag in ("ul", "ol") and lists) else page.end_line()
            if tag == "table":
                if len(tables) < MAX_TABLES and not deep:
                    tables.append(Table())
                else:
                    deep += 1
            elif in_table and tag == "tr":
                tables[-1].new_row()
            elif in_table and tag in ("td", "th"):
                pages.append(page)
                page = Page()
            elif in_table:
                tables[-1].end_group()
            elif tag in ("ul", "ol", "menu"):
                down = tag == "ol" and "reversed" in item.attributes
                first = sum(1 for x in item.children if isinstance(x, Node) and x.tag == "li") if down else 1
                lists.append([tag, _whole(item, "start", first), -1 if down else 1, item.attributes.get("type", "1")])
            elif tag == "li":
                kind = lists[-1] if lists else ["ul", 1, 1, "1"]
                kind[1] = _whole(item, "value", kind[1])
                page.marker = (numeral(kind[1], item.attributes.get("type", kind[3])) + ". " if kind[0] == "ol" else "- ") if shown else ""
                kind[1] += kind[2]
            elif tag in ("dd", "blockquote"):
                page.indent = (page.indent + "  ")[:MAX_INDENT]
            elif tag in ("pre", "textarea", "xmp"):
                kept += 1
            todo.append(("leave", item, (before, in_table)))
            todo.extend(("enter", child, None) for child in reversed(rendered(item)))
            continue
        before, in_table = extra
        shown = before[2]
        if tag == "table" and deep:
            deep -= 1
        elif tag == "table":
            page.end_line()
            for line in tables.pop().lines():
                page._put(line)
                page.end_line()
        elif in_table and tag in ("td", "th"):
            cell = page.text()
            page = pages.pop()
            tables[-1].add(cell, item)
            continue
        elif in_table and tag != "tr":
            tables[-1].end_group()
        elif tag in ("ul", "ol", "menu"):
            lists.pop()
        elif tag in ("pre", "textarea", "xmp"):
            kept -= 1
        if in_table:
            continue
        if tag in BLOCK:
            page.apart() if tag in APART and not (tag in ("ul", "ol") and lists) else page.end_line()
            page.indent, page.marker = before[0], before[1] if page.marker else ""
    return page.text()


def html_text(pages: DataFrame, *, source: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` and text: the visible text of each page.

    A null or empty page gives an empty text. Markup that is broken gives the text that is left. Time and memory stay in proportion to a page, of any
    length and nesting; beyond the layout limits text is kept, but no longer indented or aligned.
    Repeated rows each give a row; other columns are ignored; an empty table gives no rows.
    """
    if "text" in keep:
        raise ValueError("text is the name of the result's own column; rename that of the pages")
    bounded_batches(pages.sparkSession)
    kept, width = [field(pages, name) for name in keep], len(keep)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [render(build_tree(x)) if x else "" for x in batch.column(width).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(texts, pa.string())], names=[*keep, "text"])

    return pages.select(*[pages[name] for name in keep], pages[source].alias("__source")).mapInArrow(extract, T.StructType([*kept, T.StructField("text", T.StringType())]))


def html_text_report(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_lines of every page."""
    return html_text(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), F.size(F.filter(F.split("text", "\n"), lambda x: x != "")).cast("long").alias("n_lines"))
