"""Operators on parsed blocks: traces, visible cells, chunk pipelines, references, rejections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.scalars import page_count, ratio
from docloom.functions.text import sentences, strip

CELL = r"^[\s\S]*[^。！？.!?；;\s]$"


def parse_trace(blocks: DataFrame) -> DataFrame:
    """One row per document of blocks (doc_id, block_type, page_no, box, text): pages, counts by type, box coverage."""
    kinds = blocks.groupBy("doc_id", "block_type").agg(
        F.count("*").alias("n"), F.count("box").alias("boxed"), F.min("page_no").alias("low"), F.max("page_no").alias("high")
    )
    grouped = kinds.groupBy("doc_id").agg(
        F.sum("n").alias("n_blocks"),
        F.sum("boxed").alias("n_boxed"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("block_type", "n")))).alias("type_counts"),
    )
    pages = page_count(F.col("low"), F.col("high"), F.lit(0))
    return grouped.select("doc_id", "n_blocks", pages.alias("n_pages"), "type_counts", ratio(F.col("n_boxed"), F.col("n_blocks")).alias("box_coverage"))


def visible_cells(cells: DataFrame, segments: DataFrame) -> DataFrame:
    """Cells (doc_id, table_id, row_no, column_no, cell) that a segment (doc_id, segment_no, text) of their document holds.

    A cell counts with 2 to 120 characters that do not end a sentence; rows need
    two such cells and tables two such columns. The containment test comes after
    an equi join on the document.
    """
    bare = strip(F.col("cell"))
    fit = cells.withColumn("cell", bare).where((F.length("cell").between(2, 120)) & F.col("cell").rlike(CELL))
    found = fit.join(segments, "doc_id").where(F.col("text").contains(F.col("cell"))).drop("text")
    row, table = ["doc_id", "segment_no", "table_id", "row_no"], ["doc_id", "segment_no", "table_id"]
    rows = found.groupBy(*row).agg(F.count("*").alias("n")).where("n >= 2").select(*row)
    kept = found.join(rows, row, "left_semi")
    tables = kept.groupBy(*table).agg(F.countDistinct("column_no").alias("n")).where("n >= 2").select(*table)
    return kept.join(tables, table, "left_semi")


def citable(references: DataFrame) -> DataFrame:
    """References that may be cited: with an identity, and not only there for context."""
    return references.where("coalesce(identity, '') <> '' and not coalesce(context_only, false) and coalesce(evidence_type, '') <> 'CONTEXT_ONLY'")


def is_table_reference(*fields: Column) -> Column:
    """Whether any of the table fields is present."""
    return F.coalesce(*[f.cast("string") for f in fields]).isNotNull()


def rejection_report(rejected: DataFrame, samples: int = 64, most_bytes: int = 16384) -> tuple[DataFrame, DataFrame]:
    """(reason, n) over all rejections, and a bounded sample of (kind, id, reason) for diagnosis.

    Every rejection is counted; only the sample is cut, first to a top-k by kind
    and id and then by the running size of its rows.
    """
    counts = rejected.groupBy(F.coalesce("reason", F.lit("UNKNOWN")).alias("reason")).agg(F.count("*").alias("n"))
    first = rejected.orderBy("kind", "id", "reason").limit(samples)
    size = F.octet_length(F.to_json(F.struct(F.substring(F.col("id").cast("string"), 1, 128).alias("id"), "kind", "reason"))) + 1
    used = F.sum(size).over(Window.orderBy("kind", "id", "reason").rowsBetween(Window.unboundedPreceding, 0))  # over at most ``samples`` rows
    return counts, first.withColumn("used", used).where(F.col("used") <= most_bytes - 2).drop("used")


def tick_indexes(n: Column, most: int = 7) -> Column:
    """Evenly spread indexes of n points: all of them up to ``most``, else first, last and between."""
    stride = (n - 1) / (most - 1)
    spread = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: F.floor(k * stride + 0.5).cast("int")))
    none = F.expr("cast(array() as array<int>)")
    return F.when(n <= 0, none).when(n <= most, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(spread)


def canonical_groups(entities: DataFrame) -> DataFrame:
    """Entities (name, doc_id) grouped by their normalised name: mentions and documents."""
    key = F.regexp_replace(F.lower(strip(F.col("name"))), r"[\s_-]+", " ")
    return entities.withColumn("canonical", key).groupBy("canonical").agg(F.count("*").alias("mentions"), F.countDistinct("doc_id").alias("documents"))


def drill_down(nodes: DataFrame, leaves: DataFrame, k: int = 4) -> DataFrame:
    """The k best source chunks (node, chunk, score) below each node (node, chunks)."""
    below = nodes.select("node", F.explode("chunks").alias("chunk")).join(leaves, "chunk")
    order = Window.partitionBy("node").orderBy(F.desc("score"), "chunk")
    return below.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("node", "chunk", "score", "place")


def semantic_chunks(docs: DataFrame, low: int = 240, high: int = 700, similarity: float = 0.18) -> DataFrame:
    """(doc_id, chunk_no, n_sentences, n_chars): neighbouring sentences joined while they share words and the chunk has room.

    A chunk ends where the next sentence would exceed ``high``, or where the
    chunk has ``low`` characters and the next sentence shares too few terms with
    its last one. Sizes are folded over each text's sentences.
    """
    terms = lambda s: F.array_distinct(F.regexp_extract_all(F.lower(s), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    parts = docs.select("doc_id", sentences(F.col("text")).alias("s"))
    near = F.transform(
        "s",
        lambda x, i: F.coalesce(F.size(F.array_intersect(terms(x), terms(F.get("s", i - 1)))) / F.greatest(F.lit(1), F.size(F.array_union(terms(x), terms(F.get("s", i - 1))))), F.lit(0.0)),
    )
    sized = parts.select("doc_id", F.zip_with(F.transform("s", F.length), near, lambda n, j: F.struct(n.alias("n"), j.alias("near"))).alias("p"))
    none = F.expr("cast(array() as array<struct<k:int,c:int>>)")

    def step(acc, x):
        last = F.try_element_at(acc, F.lit(-1))
        cut = last.isNull() | (last["c"] + x["n"] > high) | ((last["c"] >= low) & (x["near"] < similarity))
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct((last["k"] + 1).alias("k"), (last["c"] + x["n"]).alias("c"))))
        return F.when(cut, F.array_append(acc, F.struct(F.lit(1).alias("k"), x["n"].alias("c")))).otherwise(joined)

    folded = sized.select("doc_id", F.posexplode(F.aggregate("p", none, step)).alias("chunk_no", "c"))
    return folded.select("doc_id", "chunk_no", F.col("c.k").alias("n_sentences"), F.col("c.c").alias("n_chars"))


STRATEGIES = {"STRUCTURE": 1, "RECURSIVE": 2, "SEMANTIC": 3, "MODEL": 4}


def strategy_pipeline(names: list[str]) -> list[str]:
    """Chunking strategies in their fixed order, each once; unknown ones are refused."""
    if bad := [n for n in names if n not in STRATEGIES]:
        raise ValueError(f"unknown strategies {bad}")
    return sorted(set(names), key=STRATEGIES.__getitem__)
