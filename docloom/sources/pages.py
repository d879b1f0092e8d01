"""HTML, Markdown and plain texts as rows: blocks, table cells, nodes, chunks, segments.

Parsing one text is a small pure function; Spark deals the texts. Every function
here takes a DataFrame with an id and a text column and gives rows per text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

HEADINGS = {f"h{k}" for k in range(1, 7)}
BLOCK_TAGS = {"p", "li", "pre", "blockquote"}
HIDDEN = {"script", "style", "noscript"}


def exploded(df: DataFrame, id_column: str, text_column: str, columns: str, parse: Callable[[str], Iterator[tuple]]) -> DataFrame:
    """One row per result of ``parse`` on each non-null text, with the text's id."""
    schema = StructType.fromDDL(f"id long, {columns}")
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows = [(i, *r) for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) if t is not None for r in parse(t)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=names).cast(to)

    from pyspark.sql.pandas.types import to_arrow_schema

    to = to_arrow_schema(schema)
    return df.select(F.col(id_column).cast("long").alias("id"), text_column).mapInArrow(run, schema).withColumnRenamed("id", id_column)


class _Blocks(HTMLParser):
    """Collects (type, text, rows) in reading order; what scripts and styles hold is skipped."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, str, list]] = []
        self.hidden = 0
        self.kind, self.text = "TEXT", []
        self.tables: list[list] = []
        self.cell: list[str] | None = None
        self.spans = (1, 1)

    def flush(self, kind: str = "TEXT") -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.blocks.append((self.kind, text, []))
        self.kind, self.text = kind, []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in HIDDEN:
            self.hidden += 1
        elif self.hidden:
            return
        elif tag == "table":
            self.flush()
            self.tables.append([])
        elif self.tables and tag == "tr":
            self.tables[-1].append([])
        elif self.tables and tag in ("td", "th"):
            said = dict(attrs)
            number = lambda name: max(1, min(1000, int(said.get(name) or 1))) if str(said.get(name) or "1").isdigit() else 1
            self.cell, self.spans = [], (number("rowspan"), number("colspan"))
        elif tag == "img":
            alt = (dict(attrs).get("alt") or "").strip()
            if alt and self.cell is None:
                self.flush()
                self.blocks.append(("IMAGE", alt, []))
        elif tag in HEADINGS or tag in BLOCK_TAGS:
            self.flush("TITLE" if tag in HEADINGS else "TEXT")
        elif tag == "br":
            (self.text if self.cell is None else self.cell).append(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif self.hidden:
            return
        elif tag in ("td", "th") and self.tables and self.cell is not None:
            if not self.tables[-1]:
                self.tables[-1].append([])
            self.tables[-1][-1].append((" ".join("".join(self.cell).split()), *self.spans))
            self.cell = None
        elif tag == "table" and self.tables:
            grid = filled_grid(self.tables.pop())
            if any(any(r) for r in grid):
                self.blocks.append(("TABLE", "\n".join(" | ".join(c for c in r if c) for r in grid), grid))
        elif tag in HEADINGS or tag in BLOCK_TAGS:
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            if self.cell is not None:
                self.cell.append(data)
            elif not self.tables:
                self.text.append(data)


def filled_grid(rows: list[list[tuple[str, int, int]]]) -> list[list[str]]:
    """Cells (text, row span, column span) as a grid; a spanned cell repeats its text."""
    grid: dict[tuple[int, int], str] = {}
    for y, row in enumerate(rows):
        x = 0
        for text, down, across in row:
            while (y, x) in grid:
                x += 1
            for dy in range(min(down, len(rows) - y)):
                for dx in range(across):
                    grid.setdefault((y + dy, x + dx), text)
            x += across
    width = 1 + max((x for _, x in grid), default=-1)
    return [[grid.get((y, x), "") for x in range(width)] for y in range(len(rows))]


def parse_html(html: str) -> list[tuple[str, str, list]]:
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser.blocks


def html_blocks(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, block_no, block_type, block_text): headings are titles, images their alternative text."""
    return exploded(df, id_column, text_column, "block_no int, block_type string, block_text string", lambda t: ((k + 1, kind, text) for k, (kind, text, _) in enumerate(parse_html(t))))


def html_table_cells(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, table_no, row_no, column_no, cell) of every table."""

    def parse(html: str) -> Iterator[tuple]:
        tables = [rows for kind, _, rows in parse_html(html) if kind == "TABLE"]
        return ((t, y, x, cell) for t, rows in enumerate(tables) for y, row in enumerate(rows) for x, cell in enumerate(row))

    return exploded(df, id_column, text_column, "table_no int, row_no int, column_no int, cell string", parse)


def parse_markdown(source: str) -> list[tuple[str, int, int, int, str]]:
    """(type, level, first byte, last byte, text) of the top-level blocks, last byte exclusive; a title's text is the read one."""
    from docloom.sources.markdown import BLOCK_TYPES, parse_tree

    raw, out = source.encode(), []
    for row in parse_tree(source):
        if row[1] == 0:
            kind, level, text, a, b = BLOCK_TYPES[row[2]], row[3] or 0, row[11], row[12], row[13]
            out.append((kind, level, a, b, text if kind == "TITLE" else raw[a:b].decode().strip()))
    return out


def chunk_spans(text: str, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Spans of at most ``size`` characters that overlap, cut at the last paragraph, line, sentence or space that fits."""
    at = 0
    while at < len(text):
        end = min(len(text), at + size)
        if end < len(text):
            half = at + size // 2
            for mark in ("\n\n", "\n", "。", ". ", " "):
                cut = text.rfind(mark, half, end)
                if cut >= 0:
                    end = cut + len(mark)
                    break
        yield at, end
        if end == len(text):
            return
        at = max(end - overlap, at + 1)


def recursive_chunks(df: DataFrame, id_column: str, text_column: str, size: int, overlap: int) -> DataFrame:
    """(id, chunk_no, start, end) of overlapping chunks; every character lies in one at least."""
    return exploded(df, id_column, text_column, "chunk_no int, start int, end int", lambda t: ((k, a, b) for k, (a, b) in enumerate(chunk_spans(t, size, overlap))))


_HEADING = re.compile(r"^(#{1,6})[ \t]+(.*)$", re.M)


def sections_of(text: str) -> Iterator[tuple[str, int, int]]:
    """(path, start, end) of the sections that headings open: a stack of open headings gives the path, text before the first has none.

    A heading closes those of its own level and of deeper ones. Sections cover
    every character once.
    """
    stack: list[tuple[int, str]] = []
    at, path = 0, ""
    for mark in _HEADING.finditer(text):
        if mark.start() > at:
            yield path, at, mark.start()
        level, at = len(mark[1]), mark.start()
        stack = [h for h in stack if h[0] < level] + [(level, mark[2].strip())]
        path = " > ".join(title for _, title in stack)
    if at < len(text):
        yield path, at, len(text)


def parent_child_chunks(df: DataFrame, id_column: str, text_column: str, parent: tuple[int, int] = (2200, 180), child: tuple[int, int] = (800, 120)) -> DataFrame:
    """(id, section_no, section_path, parent_no, parent_start, parent_end, child_no, start, end) of two levels of chunks; sizes are (most characters, overlap).

    Parents end at headings and are cut where a section is too long; children
    are cut from one parent each, so each lies in its parent and every character
    in one child at least. Both are numbered over the text. Null and empty texts
    have no rows.
    """

    def parse(text: str) -> Iterator[tuple]:
        parents = children = 0
        for no, (path, first, last) in enumerate(sections_of(text)):
            for a, b in chunk_spans(text[first:last], *parent):
                for c, d in chunk_spans(text[first + a : first + b], *child):
                    yield no, path, parents, first + a, first + b, children, first + a + c, first + a + d
                    children += 1
                parents += 1

    columns = "section_no int, section_path string, parent_no int, parent_start int, parent_end int, child_no int, start int, end int"
    return exploded(df, id_column, text_column, columns, parse)


def token_cost(text: str) -> int:
    """Bytes of the text as canonical JSON, and a fixed frame."""
    return len(json.dumps(text, ensure_ascii=False).encode()) + 64


_STOP = re.compile("[。！？!?；;.\n]")


def segments_of(text: str, most_chars: int, budget: int) -> Iterator[tuple[int, int]]:
    """Spans that cover every code point once, cut after the last sentence mark that fits, halved until they fit the budget."""
    at = 0
    while at < len(text):
        end = min(len(text), at + most_chars)
        if end < len(text):
            marks = [m.end() for m in _STOP.finditer(text, at, end)]
            end = marks[-1] if marks else end
        while token_cost(text[at:end]) > budget and end - at > 1:
            end = at + max(1, (end - at) // 2)
        yield at, end
        at = end


def segment_plan(df: DataFrame, id_column: str, text_column: str, most_chars: int = 1200, budget: int = 4600, most_units: int = 8) -> DataFrame:
    """(id, segment_no, start, end, cost, eligible, batch_no, text): segments of each text, packed in order by count and cost."""

    def parse(text: str) -> Iterator[tuple]:
        batch, units, used = 0, 0, 0
        for k, (a, b) in enumerate(segments_of(text, most_chars, budget)):
            part = text[a:b]
            cost, bare = token_cost(part), part.strip()
            eligible = bool(bare) and not re.fullmatch(r"(?:[-*_]\s*){3,}", bare)
            if units and (units >= most_units or used + cost > budget):
                batch, units, used = batch + 1, 0, 0
            units, used = units + 1, used + cost
            yield k, a, b, cost, eligible, batch, part

    return exploded(df, id_column, text_column, "segment_no int, start int, end int, cost long, eligible boolean, batch_no int, text string", parse)
