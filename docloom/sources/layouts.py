"""Layout services' JSON as blocks, and their lists of cells as grids; all of it column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import scalars as S
from docloom.functions import text as T

# The keys under which layout services give a value, first one wins, and the block types by part of a layout's type.
TEXT_KEYS = ("text", "Text", "markdownContent", "MarkdownContent", "content", "Content", "llmResult", "LlmResult")
TYPE_KEYS = ("type", "Type", "subType", "SubType", "layoutType", "LayoutType")
PAGE_KEYS = ("pageNum", "PageNum", "pageNo", "PageNo", "page", "Page")
BOX_KEYS = ("pos", "Pos", "bbox", "Bbox", "BBox", "box", "Box", "rect", "Rect", "region", "Region", "position", "Position", "coordinates", "Coordinates")
CELL_KEYS = ("tableRows", "TableRows", "cells", "Cells")
CAPTION_KEYS = ("caption", "Caption", "imageCaption", "ImageCaption")
BLOCK_TYPES = (
    (("title", "heading", "header1", "header2"), "TITLE"), (("table",), "TABLE"), (("figure", "chart"), "FIGURE"), (("image", "picture"), "IMAGE"), (("formula", "equation"), "FORMULA"),
    (("code",), "CODE"), (("footer",), "FOOTER"), (("header",), "HEADER"),
)
ROW_KEYS, COLUMN_KEYS = ("rowIndex", "row", "rowNo"), ("colIndex", "column", "columnNo", "col")
DOWN_KEYS, ACROSS_KEYS = ("rowSpan", "rowspan"), ("colSpan", "colspan", "columnSpan")
VALUE_KEYS = ("text", "value", "content")


def _first(entries: Column, keys: tuple[str, ...], fits=lambda v: v.isNotNull()) -> Column:
    """The value of the first key of a map that is there and fits."""
    found = F.transform(F.array(*[F.lit(k) for k in keys]), lambda k: F.try_element_at(entries, k))
    return F.get(F.filter(found, lambda v: v.isNotNull() & fits(v)), F.lit(0))


def block_type(layout_type: Column, text: Column) -> Column:
    low, out = F.lower(F.coalesce(layout_type, F.lit(""))), None
    for parts, name in BLOCK_TYPES:
        hit = F.lit(False)
        for p in parts:
            hit = hit | low.contains(p)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(T.classify_block(text))


def layout_blocks(df: DataFrame, id_column: str, json_column: str) -> DataFrame:
    """(id, block_no, block_type, text, page_no, box, box_key, cells): the layouts of a JSON list as blocks, those without text or cells left out.

    Blocks are numbered by their place in the list. ``box`` has x0, y0, x1 and y1
    where a known key holds a box or a polygon; ``cells`` is the JSON of a cell list.
    """
    each = df.select(id_column, F.posexplode(F.from_json(json_column, "array<map<string,string>>")).alias("pos", "layout"))
    layout, filled = F.col("layout"), lambda v: T.cleanup_text(v) != ""
    kind = T.cleanup_text(F.coalesce(_first(layout, TYPE_KEYS), F.lit("text")))
    plain = T.cleanup_text(F.coalesce(_first(layout, TEXT_KEYS[:6], filled), _first(layout, TEXT_KEYS[6:], lambda v: filled(v) & ~F.lower(v).contains("<table")), F.lit("")))
    named = each.select(id_column, (F.col("pos") + 1).alias("block_no"), "layout", block_type(kind, plain).alias("block_type"), plain.alias("plain"), _first(layout, CELL_KEYS, lambda v: v.isNotNull() & (v != "[]")).alias("cells"))
    caption = T.cleanup_text(F.coalesce(_first(layout, CAPTION_KEYS), F.lit("")))
    text = F.when((F.col("plain") == "") & F.col("block_type").isin("IMAGE", "FIGURE"), caption).otherwise(F.col("plain"))
    page = _first(layout, PAGE_KEYS).try_cast("int")

    def box_of(value: Column) -> Column:
        numbers = F.from_json(value, "array<double>")
        return F.when(F.size(numbers) > 4, S.box_of_polygon(numbers)).otherwise(S.box_of_json(value))

    keyed = F.transform(F.array(*[F.lit(k) for k in BOX_KEYS]), lambda k: F.struct(k.alias("key"), F.try_element_at(layout, k).alias("value")))
    boxes = F.transform(F.filter(keyed, lambda b: b["value"].isNotNull()), lambda b: F.struct(b["key"].alias("key"), box_of(b["value"]).alias("box")))
    boxes = F.filter(boxes, lambda b: b["box"].isNotNull())
    out = named.select(id_column, "block_no", "block_type", text.alias("text"), page.alias("page_no"), F.get(boxes, F.lit(0)).alias("b"), "cells")
    return out.where("text <> '' or cells is not null").select(id_column, "block_no", "block_type", "text", "page_no", F.col("b.box").alias("box"), F.col("b.key").alias("box_key"), "cells")


def grid_cells(df: DataFrame, key_columns: list[str], cells_column: str) -> DataFrame:
    """(keys, row_no, column_no, cell) of JSON cell lists with spans: the trimmed grid in long form, numbered from 0.

    A cell without a row or column number is left out. A span repeats its text;
    where cells meet, the one that starts there wins, else the first of the list
    that is not empty. Rows and outer columns that hold nothing go.
    """
    number = lambda keys, least: F.greatest(F.coalesce(_first(F.col("c"), keys).try_cast("int"), F.lit(0)), F.lit(least))
    listed = df.select(*key_columns, F.posexplode(F.from_json(cells_column, "array<map<string,string>>")).alias("at", "c"))
    placed = listed.select(
        *key_columns, "at", number(ROW_KEYS, 0).alias("r"), number(COLUMN_KEYS, 0).alias("k"), number(DOWN_KEYS, 1).alias("down"), number(ACROSS_KEYS, 1).alias("across"),
        T.cleanup_text(F.coalesce(_first(F.col("c"), VALUE_KEYS), F.lit(""))).alias("cell"),
    ).where("r > 0 and k > 0")
    spread = placed.withColumn("dr", F.explode(F.sequence(F.lit(0), F.col("down") - 1))).withColumn("dk", F.explode(F.sequence(F.lit(0), F.col("across") - 1)))
    spot = spread.select(*key_columns, (F.col("r") + F.col("dr")).alias("row"), (F.col("k") + F.col("dk")).alias("col"), "at", "cell", ((F.col("dr") == 0) & (F.col("dk") == 0)).alias("own"))
    best = F.coalesce(F.max_by(F.when(F.col("own"), F.col("cell")), F.when(F.col("own"), F.col("at"))), F.min_by("cell", F.when(F.col("cell") != "", F.col("at"))), F.lit(""))
    grid = spot.groupBy(*key_columns, "row", "col").agg(best.alias("cell"))
    held = grid.where("cell <> ''")
    ends = held.groupBy(*key_columns).agg(F.min("col").alias("low"), F.max("col").alias("high"))
    rows = held.select(*key_columns, "row").distinct().withColumn("row_no", F.row_number().over(Window.partitionBy(*key_columns).orderBy("row")) - 1)
    whole = rows.join(ends, key_columns).withColumn("col", F.explode(F.sequence("low", "high")))
    out = whole.join(grid, [*key_columns, "row", "col"], "left")
    return out.select(*key_columns, "row_no", (F.col("col") - F.col("low")).alias("column_no"), F.coalesce("cell", F.lit("")).alias("cell"))
