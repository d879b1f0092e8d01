"""Markdown as a preorder tree: blocks by a stack of open containers, text by a stack of delimiters.

One text is parsed line by line. A line first goes on with the open containers that
it matches, may then open new ones, and gives the rest to the innermost leaf. Nodes are numbered as they open,
so every parent stands before its children. Everything over many texts (blocks, sections,
table grids, checks of the tree) is DataFrame work on the node rows.
"""

from __future__ import annotations

import html.entities
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.sources.pages import exploded

NODE_COLUMNS = (
    "node_no int, parent_no int, node_type string, level int, marker string, ordinal int, header boolean, alignment string, row_index int, column_index int, info string, text string, "
    "first_byte long, last_byte long, first_line int, first_column int, last_line int, last_column int"
)

_LINE_END = re.compile("\r\n|\n|\r")
_HEADING = re.compile(r"(#{1,6})(?:[ \t]+(.*?))?[ \t]*$", re.S)
_RULE = re.compile(r"([-*_])[ \t]*(?:\1[ \t]*){2,}$")
_FENCE = re.compile(r"(`{3,}(?=[^`]*$)|~{3,})(.*)$", re.S)
_ITEM = re.compile(r"([-+*])|(\d{1,9})([.)])")
_UNDERLINE = re.compile(r"(=+|-+)[ \t]*$")
_DELIMITERS = re.compile(r"\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_BAR = re.compile(r"(?<!\\)\|")
_DEFINITION = re.compile(
    r"[ \t]*\[((?:\\.|[^\[\]\\]){1,999})\]:[ \t]*\n?[ \t]*(?:<[^<>\n]*>|[^\s<]\S*)"
    r"""(?:(?:[ \t]+|[ \t]*\n[ \t]*)(?:"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|\((?:\\.|[^()\\])*\)))?[ \t]*(?:\n|$)"""
)

_TAG = r"""<[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][\w:.-]*(?:\s*=\s*(?:[^\s"'=<>`]+|'[^']*'|"[^"]*"))?)*\s*/?>|</[A-Za-z][A-Za-z0-9-]*\s*>"""
_INLINE_HTML = re.compile(rf"{_TAG}|<!---?>|<!--.*?-->|<\?.*?\?>|<![A-Za-z][^>]*>|<!\[CDATA\[.*?\]\]>", re.S)
_AUTOLINK = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[\w.!#$%&'*+/=?^`{|}~-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*)>", re.A)
_ENTITY = re.compile(r"&(?:#(\d{1,7})|#[xX]([0-9a-fA-F]{1,6})|([A-Za-z][A-Za-z0-9]{1,31}));")
_TARGET = re.compile(
    r"""\(\s*(?:<(?:\\.|[^<>\n\\])*>|(?:\\.|[^\s()\\]|\((?:\\.|[^\s()\\]|\((?:\\.|[^\s()\\])*\))*\))*)(?:\s+(?:"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|\((?:\\.|[^()\\])*\)))?\s*\)"""
)
_PLAIN = re.compile(r"[^\\`<&\n*_!\[\]]+")
_SIGNS = re.compile(r"`+|\*+|_+")
_PUNCTUATION = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")

# The tags that begin a block of HTML, as the format lists them.
_HTML_TAGS = (
    "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html "
    "iframe legend li link main menu menuitem nav noframes ol optgroup option p param search section summary table tbody td tfoot th thead title tr track ul"
).split()
#: (how a line begins, how the line that ends the block looks, whether it may follow a paragraph's line); None ends at a blank line.
_HTML = (
    (re.compile(r"<(?:script|pre|style|textarea)(?:[\s>]|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I), True),
    (re.compile("<!--"), re.compile("-->"), True),
    (re.compile(r"<\?"), re.compile(r"\?>"), True),
    (re.compile("<![A-Za-z]"), re.compile(">"), True),
    (re.compile(r"<!\[CDATA\["), re.compile(r"\]\]>"), True),
    (re.compile(rf"</?(?:{'|'.join(_HTML_TAGS)})(?:\s|/?>|$)", re.I), None, True),
    (re.compile(rf"(?:{_TAG})\s*$"), None, False),
)


@dataclass
class Node:
    """A node; lines and columns count from 0, ``last`` is the first line after it."""

    kind: str
    parent: int | None
    first: int
    last: int = 0
    raw: list[str] = field(default_factory=list)
    text: str = ""
    level: int | None = None
    marker: str | None = None
    ordinal: int | None = None
    header: bool | None = None
    alignment: str | None = None
    row: int | None = None
    column: int | None = None
    info: str | None = None
    columns: tuple[int, int] | None = None
    gone: bool = False
    # of open blocks only
    offset: int = 0
    fence: str = ""
    end: re.Pattern | None = None
    alignments: list = field(default_factory=list)
    rows: int = 0
    part: int = 0


class _Line:
    """A line and how far it has been read; a tab reaches to the next multiple of four columns."""

    def __init__(self, text: str):
        self.text, self.at, self.column, self.spare = text, 0, 0, 0

    def indent(self) -> int:
        width, at, column = self.spare, self.at, self.column + self.spare
        while at < len(self.text) and self.text[at] in " \t":
            step = 4 - column % 4 if self.text[at] == "\t" else 1
            width, column, at = width + step, column + step, at + 1
        return width

    def skip(self, width: int) -> None:
        """Reads ``width`` columns of white space; part of a tab may be left."""
        while width:
            if self.spare:
                step = min(self.spare, width)
                self.spare -= step
            elif self.at < len(self.text) and self.text[self.at] in " \t":
                self.spare = (4 - self.column % 4 if self.text[self.at] == "\t" else 1) - 1
                self.at, step = self.at + 1, 1
            else:
                return
            self.column, width = self.column + step, width - step

    def take(self, n: int) -> None:
        self.at, self.column = self.at + n, self.column + n

    def rest(self) -> str:
        return " " * self.spare + self.text[self.at :]

    def blank(self) -> bool:
        return not self.text[self.at :].strip(" \t")


CONTAINERS = ("DOCUMENT", "BLOCKQUOTE", "ORDERED_LIST", "UNORDERED_LIST", "LIST_ITEM")


class Blocks:
    """The tree of one text; ``nodes`` are in preorder, node 0 is the document."""

    def __init__(self, source: str):
        ends = list(_LINE_END.finditer(source))
        self.starts = [0, *(m.end() for m in ends)]
        stops = [*(m.start() for m in ends), len(source)]
        self.lines = [source[a:b].replace("\0", "\ufffd") for a, b in zip(self.starts, stops, strict=True)]
        if self.lines[-1] == "":
            self.lines.pop()
        self.filled = [k for k, line in enumerate(self.lines) if line.strip(" \t")]
        self.nodes = [Node("DOCUMENT", None, 0, len(self.lines))]
        self.open: list[int] = [0]
        self.definitions: set[str] = set()
        for k in range(len(self.lines)):
            self._line(k)
        self._close(1, len(self.lines))

    def _tip(self) -> Node:
        return self.nodes[self.open[-1]]

    def _add(self, kind: str, k: int, **fields) -> Node:
        while self._tip().kind not in CONTAINERS or (kind != "LIST_ITEM" and self._tip().kind.endswith("_LIST")):
            self._close(len(self.open) - 1, k)
        self.nodes.append(Node(kind, self.open[-1], k, k + 1, **fields))
        self.open.append(len(self.nodes) - 1)
        return self.nodes[-1]

    def _close(self, depth: int, k: int) -> None:
        """Closes the blocks from ``depth`` on as line ``k`` is read; lists reach to the next line that is not blank, but not out of a quote."""
        at = bisect_left(self.filled, k)
        beyond = self.filled[at] if at < len(self.filled) else len(self.lines)
        for index in self.open[1:depth]:
            if self.nodes[index].kind == "BLOCKQUOTE" and self.nodes[index].last < k:
                beyond = min(beyond, self.nodes[index].last)
        for index in self.open[depth:]:
            node = self.nodes[index]
            if node.kind == "BLOCKQUOTE":
                beyond = min(beyond, node.last)
            elif node.kind.endswith("_LIST") or node.kind == "LIST_ITEM":
                node.last = beyond
            elif node.kind == "PARAGRAPH":
                self._define(node)
            elif node.kind == "CODE_BLOCK" and not node.fence:
                while node.raw and not node.raw[-1].strip():
                    node.raw.pop()
                node.last = node.first + len(node.raw)
        del self.open[depth:]

    def _define(self, node: Node) -> None:
        """Takes link definitions off the beginning of a paragraph; one of nothing else is no node."""
        text = "\n".join(node.raw)
        while m := _DEFINITION.match(text):
            if not m[1].strip():
                break
            self.definitions.add(_label(m[1]))
            node.first += m[0].count("\n")
            text = text[m.end() :]
        node.raw, node.gone = text.split("\n"), not text.strip()

    def _line(self, k: int) -> None:
        line, depth = _Line(self.lines[k]), 1
        while depth < len(self.open) and self._goes_on(self.nodes[self.open[depth]], line, k):
            depth += 1
        matched = depth == len(self.open)
        leaf = self.nodes[self.open[depth - 1]] if matched else None
        if leaf is not None and leaf.kind in ("CODE_BLOCK", "HTML_BLOCK"):
            return
        opened, depth = self._starts(line, k, depth)
        if opened or line.blank():
            if not opened:
                self._close(depth, k)
                if self._tip().kind in ("PARAGRAPH", "TABLE"):
                    self._close(len(self.open) - 1, k)
                if self._tip().kind == "CODE_BLOCK":
                    self._tip().raw.append("")
            return
        tip = self._tip()
        if tip.kind == "PARAGRAPH":  # a line may go on with a paragraph without the marks of its containers
            for index in self.open[1:]:
                if self.nodes[index].kind == "BLOCKQUOTE":
                    self.nodes[index].last = k + 1
            tip.raw.append(line.rest().strip(" \t") if k == tip.first else line.rest().lstrip(" \t"))
            tip.last = k + 1
            return
        if tip.kind == "TABLE" and matched:
            self._row(tip, line, k, False)
            return
        self._close(depth, k)
        self._add("PARAGRAPH", k, raw=[line.rest().lstrip(" \t")])

    def _goes_on(self, node: Node, line: _Line, k: int) -> bool:
        """Whether an open block goes on with the line; reads what belongs to the block."""
        if node.kind == "BLOCKQUOTE":
            if line.indent() > 3 or line.text[line.at :].lstrip(" \t")[:1] != ">":
                return False
            self._quote(node, line, k)
        elif node.kind == "LIST_ITEM":
            if line.blank():
                return node.last > node.first + 1 or self.nodes[-1] is not node
            if line.indent() < node.offset:
                return False
            line.skip(node.offset)
            node.last = max(node.last, k + 1)
        elif node.kind == "CODE_BLOCK" and node.fence:
            bare = line.text[line.at :].strip(" \t")
            if line.indent() < 4 and bare and bare == node.fence[0] * len(bare) and len(bare) >= len(node.fence):
                node.last = k + 1
                self._close(len(self.open) - 1, k + 1)
                self.open.append(len(self.nodes) - 1)  # the line is read; the block ends with it
                self.nodes[-1].end = _LINE_END
                return True
            if node.end is not None:
                return False
            line.skip(min(node.offset, line.indent()))
            node.raw.append(line.rest())
            node.last = k + 1
        elif node.kind == "CODE_BLOCK":
            if not line.blank() and line.indent() < 4:
                return False
            line.skip(4)
            node.raw.append(line.rest())
        elif node.kind == "HTML_BLOCK":
            if node.offset or (node.end is None and line.blank()):
                return False
            node.raw.append(line.rest())
            node.last = k + 1
            node.offset = int(node.end is not None and node.end.search(line.rest()) is not None)
        elif node.kind in ("PARAGRAPH", "TABLE"):
            return not line.blank()
        return node.kind not in ("HEADING", "THEMATIC_BREAK")

    def _quote(self, node: Node, line: _Line, k: int) -> None:
        line.skip(line.indent())
        line.take(1)
        line.skip(min(1, line.indent()))
        node.last = k + 1

    def _starts(self, line: _Line, k: int, depth: int) -> tuple[bool, int]:
        """Opens what begins on the line: (whether nothing is left of it for a paragraph or row, depth of what the rest belongs to)."""
        while True:
            tip = self.nodes[self.open[depth - 1]] if depth <= len(self.open) else self._tip()
            paragraph = self._tip().kind == "PARAGRAPH"
            on = paragraph and tip.kind == "PARAGRAPH"  # the paragraph itself is matched
            indent = line.indent()
            if indent >= 4:
                if paragraph or line.blank():
                    return False, depth
                self._close(self._kept(depth), k)
                line.skip(4)
                self._add("CODE_BLOCK", k, raw=[line.rest()])
                return True, len(self.open)
            rest = line.text[line.at :].lstrip(" \t")
            if not rest:
                return False, depth
            if on and self._table(tip, rest, line, k):
                return True, len(self.open)
            if on and (m := _UNDERLINE.match(rest)):
                self._define(tip)
                if not tip.gone:
                    tip.kind, tip.level, tip.marker, tip.last = "HEADING", 1 if m[1][0] == "=" else 2, m[1][0], k + 1
                    self.open.pop()
                    return True, len(self.open)
                self.open.pop()
                depth = min(depth, len(self.open))
                continue
            if rest[0] == ">":
                self._close(self._kept(depth), k)
                self._quote(self._add("BLOCKQUOTE", k), line, k)
            elif m := _HEADING.match(rest):
                self._close(self._kept(depth), k)
                said = re.sub(r"(?:^|[ \t]+)#+$", "", m[2] or "")
                self._add("HEADING", k, level=len(m[1]), marker=m[1], raw=[said.strip(" \t")])
                self.open.pop()
                return True, len(self.open)
            elif m := _FENCE.match(rest):
                self._close(self._kept(depth), k)
                self._add("CODE_BLOCK", k, fence=m[1], marker=m[1], info=_unescaped(m[2].strip()) or None, offset=indent)
                return True, len(self.open)
            elif self._html(rest, line, k, depth, paragraph):
                return True, len(self.open)
            elif _RULE.match(rest):
                self._close(self._kept(depth), k)
                self._add("THEMATIC_BREAK", k, marker=re.sub("[ \t]", "", rest))
                self.open.pop()
                return True, len(self.open)
            elif (m := _ITEM.match(rest)) and (len(rest) == m.end() or rest[m.end()] in " \t"):
                empty = not rest[m.end() :].strip(" \t")
                if on and (empty or (m[2] and int(m[2]) != 1)):
                    return False, depth
                self._item(m, indent, empty, line, k, depth)
                if empty:
                    return True, len(self.open)
            else:
                return False, depth
            depth = len(self.open)

    def _kept(self, depth: int) -> int:
        return min(depth, len(self.open))

    def _html(self, rest: str, line: _Line, k: int, depth: int, paragraph: bool) -> bool:
        for start, end, interrupts in _HTML if rest[0] == "<" else ():
            if start.match(rest) and (interrupts or not paragraph):
                self._close(self._kept(depth), k)
                self._add("HTML_BLOCK", k, raw=[line.rest()], end=end, offset=int(end is not None and end.search(rest) is not None))
                return True
        return False

    def _item(self, m: re.Match, indent: int, empty: bool, line: _Line, k: int, depth: int) -> None:
        kind, sign = ("ORDERED_LIST", m[3]) if m[2] else ("UNORDERED_LIST", m[1])
        self._close(self._kept(depth), k)
        while self._tip().kind not in CONTAINERS:
            self._close(len(self.open) - 1, k)
        if self._tip().kind != kind or self._tip().fence != sign:
            if self._tip().kind.endswith("_LIST"):
                self._close(len(self.open) - 1, k)
            self._add(kind, k, fence=sign, ordinal=int(m[2]) if m[2] and int(m[2]) != 1 else None)
        line.skip(indent)
        line.take(m.end())
        after = line.indent()
        after = 1 if empty or after > 4 else after
        line.skip(after)
        self._add("LIST_ITEM", k, marker=m[0], ordinal=int(m[2]) if m[2] else None, offset=indent + m.end() + after)

    def _table(self, paragraph: Node, rest: str, line: _Line, k: int) -> bool:
        """Turns the last line of a paragraph into the head of a table if this line delimits as many columns."""
        if not _DELIMITERS.match(rest) or (rest[0] == "-" and rest[1:2] in (" ", "\t")) or "|" not in paragraph.raw[-1]:
            return False
        marks = _cells(rest)
        if len(marks) != len(_cells(paragraph.raw[-1])):
            return False
        paragraph.raw.pop()
        paragraph.last -= 1
        paragraph.gone = not paragraph.raw
        self._close(len(self.open) - 1, k - 1) if paragraph.raw else self.open.pop()
        table = self._add("TABLE", k - 1)
        table.alignments = [{(True, True): "CENTER", (True, False): "LEFT", (False, True): "RIGHT"}.get((m[2].startswith(":"), m[2].endswith(":"))) for m in marks]
        head = _Line(self.lines[k - 1])
        head.at = len(head.text) - len(head.text.lstrip(" \t>")) if any(self.nodes[x].kind == "BLOCKQUOTE" for x in self.open) else 0
        self._row(table, head, k - 1, True)
        table.last = k + 1
        return True

    def _row(self, table: Node, line: _Line, k: int, head: bool) -> None:
        if table.rows < 2:
            self.nodes.append(Node("TABLE_HEAD" if head else "TABLE_BODY", self.open[-1], k, k + 1))
            table.part = len(self.nodes) - 1
        row_index, table.rows = table.rows, table.rows + 1
        self.nodes[table.part].last = table.last = k + 1
        for part in self.open[1:]:
            if self.nodes[part].kind == "BLOCKQUOTE":
                self.nodes[part].last = max(self.nodes[part].last, k + 1)
        self.nodes.append(Node("TABLE_ROW", table.part, k, k + 1))
        row, shift, found = len(self.nodes) - 1, line.at, _cells(line.text[line.at :])
        stop = len(line.text[shift:].rstrip())
        for x, alignment in enumerate(table.alignments):
            a, b, said = found[x] if x < len(found) else (stop, stop, "")
            self.nodes.append(Node("TABLE_CELL", row, k, k, raw=[said.replace("\\|", "|")], header=head, alignment=alignment, row=row_index, column=x, columns=(shift + a, shift + b)))

    def finished(self) -> list[Node]:
        """Nodes that stay, with parents by their new numbers and texts filled in, those of containers from their children."""
        stay = [k for k, n in enumerate(self.nodes) if not n.gone]
        number = {k: j for j, k in enumerate(stay)}
        out = [self.nodes[k] for k in stay]
        below: list[list[Node]] = [[] for _ in out]
        for node in out:
            if node.parent is not None:
                node.parent = number[node.parent]
                below[node.parent].append(node)
            if node.kind in ("PARAGRAPH", "HEADING", "TABLE_CELL"):
                node.text = inline_text("\n".join(node.raw).strip(" \t\n"), self.definitions)
            elif node.kind in ("CODE_BLOCK", "HTML_BLOCK"):
                node.text = "\n".join(node.raw).rstrip("\n")
        for k in range(len(out) - 1, 0, -1):
            if out[k].kind == "TABLE_ROW":
                out[k].text = " | ".join(n.text for n in below[k])
            elif not out[k].text:
                out[k].text = "\n".join(n.text for n in below[k] if n.text)
        return out


def _label(text: str) -> str:
    return " ".join(text.split()).casefold()


def _unescaped(text: str) -> str:
    return re.sub(r"\\([!-/:-@\[-`{-~])", r"\1", _ENTITY.sub(_entity, text))


def _entity(m: re.Match) -> str:
    if m[3]:
        return html.entities.html5.get(m[3] + ";", m[0])
    code = int(m[1]) if m[1] else int(m[2], 16)
    return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else "\ufffd"


def _cells(row: str) -> list[tuple[int, int, str]]:
    """(first, last, content) of the cells between bars that are not escaped; a leading and a closing bar bound no empty cell."""
    first, last = len(row) - len(row.lstrip()), len(row.rstrip())
    bars = [m.start() for m in _BAR.finditer(row, first, last)]
    parts = list(zip([first, *(b + 1 for b in bars)], [*bars, last], strict=True))
    if bars and bars[0] == first:
        parts.pop(0)
    if bars and bars[-1] == last - 1 and parts:
        parts.pop()
    out = []
    for a, b in parts:
        said = row[a:b]
        a += len(said) - len(said.lstrip())
        out.append((a, a + len(said.strip()), said.strip()))
    return out


def _flanks(before: str, after: str, sign: str) -> tuple[bool, bool]:
    """Whether a run of delimiters may open and close emphasis, by the characters beside it."""
    blank = lambda c: not c or c.isspace()
    mark = lambda c: bool(c) and (c in _PUNCTUATION or unicodedata.category(c)[0] == "P")
    left = not blank(after) and (not mark(after) or blank(before) or mark(before))
    right = not blank(before) and (not mark(before) or blank(after) or mark(after))
    return (left, right) if sign == "*" else (left and (not right or mark(before)), right and (not left or mark(after)))


class _Run:
    """A run of emphasis signs of which some are still text."""

    def __init__(self, sign: str, n: int, opens: bool, closes: bool):
        self.sign, self.n, self.whole, self.opens, self.closes = sign, n, n, opens, closes

    def __str__(self) -> str:
        return self.sign * self.n


def _pair(parts: list, bottom: int) -> None:
    """Takes signs that pair up out of the runs after ``bottom``; what is left of a run is text."""
    runs = [x for x in parts[bottom:] if isinstance(x, _Run)]
    lowest: dict[tuple, int] = {}
    k = 0
    while k < len(runs):
        close = runs[k]
        if not close.closes or not close.n:
            k += 1
            continue
        key = (close.sign, close.opens, close.whole % 3)
        for j in range(k - 1, lowest.get(key, 0) - 1, -1):
            start = runs[j]
            thirds = (start.closes or close.opens) and (start.whole + close.whole) % 3 == 0 and (start.whole % 3 or close.whole % 3)
            if start.n and start.opens and start.sign == close.sign and not thirds:
                used = 2 if start.n > 1 and close.n > 1 else 1
                start.n, close.n = start.n - used, close.n - used
                for between in runs[j + 1 : k]:
                    between.opens = between.closes = False
                break
        else:
            lowest[key] = k
            k += 1
    for run in runs:
        run.opens = run.closes = False


def inline_text(raw: str, definitions: set[str] = frozenset()) -> str:
    """The text that is read: emphasis, links and escapes resolved, code, HTML and images' descriptions as they stand, breaks as line ends."""
    parts: list = []
    brackets: list[list] = []  # place among the parts, whether an image, whether it may still be a link, place in the text
    at = 0
    while at < len(raw):
        c = raw[at]
        if m := _PLAIN.match(raw, at):
            parts.append(m[0])
            at = m.end()
        elif c == "\n" or raw.startswith("\\\n", at):
            if c == "\n" and parts and isinstance(parts[-1], str):
                parts[-1] = parts[-1].rstrip(" ")
            at += 1 if c == "\n" else 2
            parts.append("\n")
            while at < len(raw) and raw[at] in " \t":
                at += 1
        elif c == "\\" and raw[at + 1 : at + 2] in _PUNCTUATION and at + 1 < len(raw):
            parts.append(raw[at + 1])
            at += 2
        elif c == "`":
            n = _SIGNS.match(raw, at).end() - at
            m = re.compile(rf"(?<!`)`{{{n}}}(?!`)").search(raw, at + n)
            if m:
                code = raw[at + n : m.start()].replace("\n", " ")
                parts.append(code[1:-1] if len(code) > 1 and code[0] == code[-1] == " " and code.strip(" ") else code)
            else:
                parts.append("`" * n)
            at = m.end() if m else at + n
        elif c == "<" and (m := _AUTOLINK.match(raw, at)):
            parts.append(m[1])
            at = m.end()
        elif c == "<" and (m := _INLINE_HTML.match(raw, at)):
            parts.append(m[0])
            at = m.end()
        elif c == "&" and (m := _ENTITY.match(raw, at)):
            parts.append(_entity(m))
            at = m.end()
        elif c in "*_":
            n = _SIGNS.match(raw, at).end() - at
            parts.append(_Run(c, n, *_flanks(raw[at - 1 : at], raw[at + n : at + n + 1], c)))
            at += n
        elif c == "[" or raw.startswith("![", at):
            n = 1 if c == "[" else 2
            brackets.append([len(parts), n == 2, True, at + n])
            parts.append(raw[at : at + n])
            at += n
        elif c == "]" and brackets:
            place, image, alive, start = brackets.pop()
            label, m = raw[start:at], _TARGET.match(raw, at + 1)
            end = m.end() if m else None
            if end is None and alive:
                m = re.compile(r"\[((?:\\.|[^\[\]\\])*)\]").match(raw, at + 1)
                if m and _label(m[1] or label) in definitions:
                    end = m.end()
                elif not m and _label(label) in definitions:
                    end = at + 1
            if not alive or end is None:
                parts.append("]")
                at += 1
                continue
            if image:
                parts[place:] = [label]
            else:
                _pair(parts, place + 1)
                parts[place] = ""
                for other in brackets:
                    other[2] = other[2] and other[1]
            at = end
        else:
            parts.append(c)
            at += 1
    _pair(parts, 0)
    return "".join(map(str, parts))


def parse_tree(source: str) -> Iterator[tuple]:
    """Rows of NODE_COLUMNS of one text; lines and columns count from 1, bytes are those of UTF-8."""
    blocks = Blocks(source)
    starts, lines = blocks.starts, blocks.lines
    sizes = [0]
    for a, b in zip(starts, [*starts[1:], len(source)], strict=True):
        sizes.append(sizes[-1] + len(source[a:b].encode("utf-8", "replace")))

    def place(line: int, column: int = 0) -> tuple[int, int, int]:
        if line >= len(starts):  # no line end at the end of the text
            return sizes[-1], len(starts), len(source) - starts[-1] + 1
        return sizes[line] + len(source[starts[line] : starts[line] + column].encode("utf-8", "replace")), line + 1, column + 1

    for k, n in enumerate(blocks.finished()):
        a, b = (place(n.first, n.columns[0]), place(n.first, n.columns[1])) if n.columns else (place(n.first), place(n.last))
        if n.kind == "DOCUMENT":
            b = (sizes[-1], len(starts), len(source) - starts[-1] + 1)
        yield k, n.parent, n.kind, n.level, n.marker, n.ordinal, n.header, n.alignment, n.row, n.column, n.info, n.text, a[0], b[0], a[1], a[2], b[1], b[2]


def markdown_tree(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, NODE_COLUMNS) of texts read as Markdown, a row per node; null texts have none, an empty one has its document node."""
    return exploded(df, id_column, text_column, NODE_COLUMNS, parse_tree)


# Block types of the nodes that stand at the top level.
BLOCK_TYPES = {
    "HEADING": "TITLE", "ORDERED_LIST": "LIST", "UNORDERED_LIST": "LIST", "TABLE": "TABLE", "CODE_BLOCK": "CODE", "BLOCKQUOTE": "BLOCKQUOTE", "THEMATIC_BREAK": "THEMATIC_BREAK", "HTML_BLOCK": "HTML",
    "PARAGRAPH": "TEXT",
}


def table_grids(nodes: DataFrame, id_column: str) -> DataFrame:
    """(id, table_no, rows) of the tables: a text per cell, row by row; table_no is the table's node."""
    keys = [id_column, "table_no"]
    # in preorder a cell belongs to the last table that began before it
    last = F.last(F.when(F.col("node_type") == "TABLE", F.col("node_no")), ignorenulls=True).over(Window.partitionBy(id_column).orderBy("node_no"))
    cells = nodes.where("node_type in ('TABLE', 'TABLE_CELL')").withColumn("table_no", last).where("node_type = 'TABLE_CELL'")
    rows = cells.groupBy(*keys, "row_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("column_index", "text"))), lambda x: x["text"]).alias("cells"))
    return rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("row_index", "cells"))), lambda x: x["cells"]).alias("rows"))


def markdown_blocks(nodes: DataFrame, texts: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, block_no, block_type, level, marker, node_no, block_text, section_path, rows) of the nodes below the document.

    A title and a table have their read text, other blocks their source; those
    without any are left out and block numbers have no gaps. The section is the last title up to the block.
    """
    # in preorder a cell belongs to the last table that began before it, so blocks and grids come from one pass and no tree meets itself in a join
    last = F.last(F.when(F.col("node_type") == "TABLE", F.col("node_no")), ignorenulls=True).over(Window.partitionBy(id_column).orderBy("node_no"))
    kept, cell = nodes.where("parent_no = 0 or node_type in ('TABLE', 'TABLE_CELL')"), F.col("node_type") == "TABLE_CELL"
    kept = kept.withColumn("block", F.when(cell, last).otherwise(F.col("node_no"))).withColumn("row_index", F.when(cell, F.col("row_index")))
    node = F.when(~cell, F.struct("parent_no", "node_type", "level", "marker", "text", "first_byte", "last_byte"))
    cells = F.transform(F.array_sort(F.collect_list(F.when(cell, F.struct("column_index", "text")))), lambda x: x["text"])
    rows = kept.groupBy(id_column, "block", "row_index").agg(F.first(node, ignorenulls=True).alias("node"), cells.alias("cells"))
    grid = F.transform(F.array_sort(F.collect_list(F.when(F.col("row_index").isNotNull(), F.struct("row_index", "cells")))), lambda x: x["cells"])
    blocks = rows.groupBy(id_column, F.col("block").alias("node_no")).agg(F.first("node", ignorenulls=True).alias("node"), grid.alias("rows")).where("node.parent_no = 0")
    blocks = blocks.select(id_column, "node_no", "node.node_type", "node.level", "node.marker", "node.text", "node.first_byte", "node.last_byte", F.when(F.size("rows") > 0, F.col("rows")).alias("rows"))
    # sizes of parsed rows are not known beforehand, so a guess must not make either side a broadcast
    top = blocks.join(texts.select(F.col(id_column), F.encode(text_column, "UTF-8").alias("source")).hint("merge"), id_column)
    source = F.trim(F.decode(F.substring("source", F.col("first_byte").cast("int") + 1, (F.col("last_byte") - F.col("first_byte")).cast("int")), "UTF-8"), F.lit(" \t\r\n\f\x0b"))
    read = F.col("node_type").isin("HEADING", "TABLE")
    kind = F.create_map(*[F.lit(x) for pair in BLOCK_TYPES.items() for x in pair])[F.col("node_type")]
    top = top.select(id_column, "node_no", kind.alias("block_type"), "level", "marker", F.when(read, F.trim("text")).otherwise(source).alias("block_text"), "rows")
    top = top.where((F.col("block_text") != "") | (F.col("block_type") == "TABLE"))
    own = Window.partitionBy(id_column).orderBy("node_no")
    title = F.last(F.when(F.col("block_type") == "TITLE", F.col("block_text")), ignorenulls=True).over(own)
    return top.select(id_column, F.row_number().over(own).alias("block_no"), "block_type", "level", "marker", "node_no", "block_text", F.coalesce(title, F.lit("")).alias("section_path"), "rows")


def tree_faults(nodes: DataFrame, id_column: str) -> DataFrame:
    """(id, node_no, fault): what breaks the form of a tree, for checks of nodes from any source."""
    parents = nodes.select(id_column, F.col("node_no").alias("parent_no"), F.col("node_type").alias("above"), F.col("first_byte").alias("a"), F.col("last_byte").alias("b"))
    joined = nodes.join(parents, [id_column, "parent_no"], "left")
    inside = {"LIST_ITEM": ("ORDERED_LIST", "UNORDERED_LIST"), "TABLE_HEAD": ("TABLE",), "TABLE_BODY": ("TABLE",), "TABLE_ROW": ("TABLE_HEAD", "TABLE_BODY"), "TABLE_CELL": ("TABLE_ROW",)}
    wrong = F.lit(False)
    for kind, above in inside.items():
        wrong = wrong | ((F.col("node_type") == kind) & ~F.coalesce(F.col("above").isin(*above), F.lit(False)))
    previous = F.lag("node_no").over(Window.partitionBy(id_column).orderBy("node_no"))
    fault = (
        F.when(F.col("node_no") != F.coalesce("previous", F.lit(-1)) + 1, "ORDER_NOT_CONTIGUOUS")
        .when((F.col("node_no") == 0) != (F.col("node_type") == "DOCUMENT"), "NOT_ONE_DOCUMENT")
        .when((F.col("node_no") > 0) & F.col("above").isNull(), "UNKNOWN_PARENT")
        .when(F.col("parent_no") >= F.col("node_no"), "PARENT_AFTER_CHILD")
        .when(wrong, "WRONG_PARENT_TYPE")
        .when(F.col("first_byte") > F.col("last_byte"), "SPAN_REVERSED")
        .when((F.col("first_byte") < F.col("a")) | (F.col("last_byte") > F.col("b")), "SPAN_OUTSIDE_PARENT")
        .when((F.col("node_type") == "LIST_ITEM") & (F.col("above") == "ORDERED_LIST") & F.col("ordinal").isNull(), "ORDINAL_MISSING")
        .when((F.col("node_type") == "TABLE_CELL") & (F.col("header") != (F.col("row_index") == 0)), "HEADER_FLAG_WRONG")
    )
    return joined.withColumn("previous", previous).select(id_column, "node_no", fault.alias("fault")).where("fault is not null")
