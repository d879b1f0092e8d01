"""Queries over graphs, trees and parsed pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import communities
from docloom.operators import graph as G
from docloom.operators import tree
from docloom.plans.catalogue import query
from docloom.sources import markdown as M
from docloom.sources import pages as P
from docloom.sources.tables import table

EDGES = "e AS (SELECT DISTINCT o_custkey * 2 AS source, l_suppkey * 2 + 1 AS target FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"
NODES = "n AS (SELECT c_custkey * 2 AS node FROM customer UNION ALL SELECT s_suppkey * 2 + 1 FROM supplier)"
BOTH = "b AS (SELECT source, target FROM e UNION SELECT target, source FROM e)"


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select((F.col("c_custkey") * 2).alias("node")).unionByName(table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 2 + 1).alias("node")))


def edge_parts(spark: SparkSession, sf_dir: str) -> int:
    """Partitions for the links of orders; there is at most one for each line."""
    return G.parts_for(table(spark, sf_dir, "lineitem"))


def order_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer and supplier of every line."""
    parts = edge_parts(spark, sf_dir)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").repartition(parts, "o_orderkey")
    joined = orders.join(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").repartition(parts, "l_orderkey").hint("merge"), F.expr("o_orderkey = l_orderkey"))
    return joined.select((F.col("o_custkey") * 2).alias("source"), (F.col("l_suppkey") * 2 + 1).alias("target"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers that orders link, in partitions whose number grows with the lines."""
    return order_links(spark, sf_dir).repartition(edge_parts(spark, sf_dir), "source", "target").distinct()


@query(f"WITH {EDGES}, {NODES}, {BOTH}, d AS (SELECT source, count(*) AS degree FROM b GROUP BY ALL) SELECT node, coalesce(degree, 0) AS degree FROM n LEFT JOIN d ON source = node")
def graph_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degree of every node, isolated ones included."""
    return G.degrees(nodes(spark, sf_dir), edges(spark, sf_dir), parts=edge_parts(spark, sf_dir))


@query(
    f"""WITH {EDGES}, {BOTH}, h0 AS (SELECT DISTINCT source AS node FROM e WHERE source % 100 = 0), h1 AS (SELECT h0.node AS seed, target AS node FROM h0 JOIN b ON source = h0.node),
h2 AS (SELECT seed, target AS node FROM h1 JOIN b ON source = h1.node), u AS (SELECT node AS seed, node, 0 AS distance FROM h0 UNION ALL SELECT seed, node, 1 FROM h1 UNION ALL SELECT seed, node, 2 FROM h2)
SELECT seed, node, CAST(min(distance) AS INT) AS distance FROM u GROUP BY ALL"""
)
def graph_khop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes within two hops of some seeds."""
    e = edges(spark, sf_dir)
    return G.within_hops(e.where("source % 100 = 0").select(F.col("source").alias("node")).distinct(), e, 2, edge_parts(spark, sf_dir))


@query(
    # twelve rounds of minima are more than twice what the longest path between any two of these nodes needs
    f"WITH {EDGES}, {NODES}, {BOTH}, c0 AS (SELECT node, node AS c FROM n), "
    + ", ".join(
        f"c{k + 1} AS MATERIALIZED (SELECT node, min(c) AS c FROM (SELECT node, c FROM c{k} UNION ALL SELECT target, c FROM b JOIN c{k} ON source = node) GROUP BY node)" for k in range(12)
    )
    + " SELECT node, c AS component FROM c12"
)
def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected components named by their smallest node."""
    return G.components(nodes(spark, sf_dir), edges(spark, sf_dir), parts=edge_parts(spark, sf_dir))


@query(
    f"WITH {EDGES}, {NODES}, {BOTH}, l0 AS (SELECT node, node AS c FROM n), "
    + ", ".join(
        f"""v{k} AS (SELECT target AS node, c, count(*) AS votes FROM b JOIN l{k} ON source = node GROUP BY ALL),
w{k} AS (SELECT node, c FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY votes DESC, c) AS place FROM v{k}) WHERE place = 1),
l{k + 1} AS MATERIALIZED (SELECT l{k}.node, coalesce(w{k}.c, l{k}.c) AS c FROM l{k} LEFT JOIN w{k} ON w{k}.node = l{k}.node)"""
        for k in range(5)
    )
    + " SELECT node, min(node) OVER (PARTITION BY c) AS community FROM l5"
)
def graph_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities by label propagation, named by their smallest member."""
    return G.label_propagation(nodes(spark, sf_dir), edges(spark, sf_dir), parts=edge_parts(spark, sf_dir))


@query()
def graph_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities of customers and suppliers by modularity, connected and named by their smallest member."""
    return communities.communities(nodes(spark, sf_dir), order_links(spark, sf_dir), parts=edge_parts(spark, sf_dir))


@query(
    """WITH s AS (SELECT doc_id AS source_id, text FROM documents), ent AS (SELECT doc_id % 900 AS id, doc_id AS source_id, CASE WHEN doc_id % 50 = 0 THEN '' ELSE source || doc_id END AS name FROM documents),
c AS (SELECT id, count(*) AS copies FROM ent GROUP BY ALL)
SELECT id, CASE WHEN copies > 1 THEN 'DUPLICATE_ID' WHEN length(name) = 0 THEN 'EMPTY_NAME' END AS reason FROM ent JOIN c USING (id) WHERE copies > 1 OR length(name) = 0"""
)
def candidate_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities that the isolation rejects, with reasons."""
    docs = table(spark, sf_dir, "documents")
    name = F.when(F.col("doc_id") % 50 == 0, "").otherwise(F.concat("source", F.col("doc_id").cast("string")))
    entities = docs.select((F.col("doc_id") % 900).alias("id"), F.col("doc_id").alias("source_id"), name.alias("name"))
    none = spark.range(0)
    relations = none.select("id", F.col("id").alias("source_entity"), F.col("id").alias("target_entity"), F.array("id").alias("evidence_ids"))
    evidences = none.select("id", F.col("id").alias("source_id"), F.col("id").alias("entity_id"), F.col("id").alias("relation_id"), F.lit("").alias("quote"))
    rejected = G.isolate_candidates(entities, relations, evidences, docs.select(F.col("doc_id").alias("source_id"), "text"))[3]
    return rejected.where("kind = 'entity'").select("id", "reason")


@query()
def tree_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary trees over vectors, one for each label."""
    items = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("doc"), F.col("vec_id").alias("item"), F.col("embedding").cast("array<double>").alias("vector"))
    return tree.build_tree(items).select("doc", "level", "node", "parent", "n_leaves")


@query()
def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed blocks of raw pages."""
    return P.html_blocks(table(spark, sf_dir, "pages"), "page_id", "html")


@query(
    """SELECT page_id, CAST(t AS INT) AS table_no, CAST(c.r AS INT) AS row_no, CAST(c.k AS INT) AS column_no, CASE WHEN c.x = 'id' THEN page_id || '.' || t ELSE c.x END AS cell FROM pages, (VALUES (0), (1)) n(t),
 (VALUES (0, 0, 'id'), (0, 1, 'a & b'), (0, 2, 'a & b'), (1, 0, 'id'), (1, 1, 'c d'), (1, 2, '')) c(r, k, x)"""
)
def html_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table cells of pages in long form, spans filled; every page gets a table before and one after its own markup."""
    built = lambda t: F.concat(F.lit('<table><tr><th rowspan="2"> '), F.col("page_id").cast("string"), F.lit(f".{t}</th><td colspan=2>a &amp; b</td></tr><tr><td><b>c</b>\n d</td><td></td></tr></table>"))
    pages = table(spark, sf_dir, "pages").withColumn("html", F.concat(built(0), F.coalesce("html", F.lit("")), built(1)))
    return P.html_table_cells(pages, "page_id", "html")


@query()
def markdown_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree of every text read as Markdown: parents, marks, ordinals, cells, read text and source spans."""
    return M.markdown_tree(table(spark, sf_dir, "documents"), "doc_id", "text")


@query()
def markdown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-level blocks of every text read as Markdown, with their sections and table grids."""
    docs = table(spark, sf_dir, "documents")
    blocks = M.markdown_blocks(M.markdown_tree(docs, "doc_id", "text"), docs, "doc_id", "text")
    return blocks.withColumn("rows", F.to_json("rows"))


def _part_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Markdown text per part: title, table, nested list and quote around its columns."""
    text = """concat('# ', p_name, '\n\n| key | **value** |\n| :-- | --: |\n| brand | ', p_brand, ' |\n| type \\\\| kind | `', p_type, '` |\n\n3. ', p_brand, '\n   - size ', p_size, '\n4. end\n\n> *', p_type, '*\n')"""
    # a part is a short row whose text takes long to parse: parts are dealt out, as a file of them may be a single task's
    parts = table(spark, sf_dir, "part")
    return parts.repartition(G.parts_for(parts, 5000), "p_partkey").select("p_partkey", F.expr(text).alias("text"))


@query(
    r"""WITH s AS (SELECT p_partkey, p_name AS n, p_brand AS b, p_type AS t, CAST(p_size AS VARCHAR) AS z FROM part),
l AS (SELECT *, octet_length(encode(n)) AS ln, octet_length(encode(b)) AS lb, octet_length(encode(t)) AS lt, length(z) AS lz FROM s),
o AS (SELECT *, 3 + ln AS o1, 4 + ln AS o2, 4 + ln + 20 AS o3, 4 + ln + 34 AS o4, 4 + ln + 47 + lb AS o5 FROM l),
q AS (SELECT *, o5 + 22 + lt AS o6, o5 + 23 + lt AS o7, o5 + 27 + lt + lb AS o8, o5 + 38 + lt + lb + lz AS o9, o5 + 46 + lt + lb + lz AS o11, o5 + 51 + 2 * lt + lb + lz AS o12 FROM o)
SELECT p_partkey, u.x.node_no AS node_no, u.x.parent_no AS parent_no, u.x.node_type AS node_type, u.x.marker AS marker, u.x.ordinal AS ordinal, u.x.text AS text, u.x.first_byte AS first_byte, u.x.last_byte AS last_byte
FROM (SELECT p_partkey, unnest([
 {'node_no': 0, 'parent_no': NULL, 'node_type': 'DOCUMENT', 'marker': NULL, 'ordinal': NULL, 'text': '', 'first_byte': 0, 'last_byte': o12},
 {'node_no': 1, 'parent_no': 0, 'node_type': 'HEADING', 'marker': '#', 'ordinal': NULL, 'text': n, 'first_byte': 0, 'last_byte': o1},
 {'node_no': 2, 'parent_no': 0, 'node_type': 'TABLE', 'marker': NULL, 'ordinal': NULL, 'text': 'key | value' || chr(10) || 'brand | ' || b || chr(10) || 'type | kind | ' || t, 'first_byte': o2, 'last_byte': o6},
 {'node_no': 3, 'parent_no': 2, 'node_type': 'TABLE_HEAD', 'marker': NULL, 'ordinal': NULL, 'text': 'key | value', 'first_byte': o2, 'last_byte': o3},
 {'node_no': 4, 'parent_no': 3, 'node_type': 'TABLE_ROW', 'marker': NULL, 'ordinal': NULL, 'text': 'key | value', 'first_byte': o2, 'last_byte': o3},
 {'node_no': 5, 'parent_no': 4, 'node_type': 'TABLE_CELL', 'marker': NULL, 'ordinal': NULL, 'text': 'key', 'first_byte': o2 + 2, 'last_byte': o2 + 5},
 {'node_no': 6, 'parent_no': 4, 'node_type': 'TABLE_CELL', 'marker': NULL, 'ordinal': NULL, 'text': 'value', 'first_byte': o2 + 8, 'last_byte': o2 + 17},
 {'node_no': 7, 'parent_no': 2, 'node_type': 'TABLE_BODY', 'marker': NULL, 'ordinal': NULL, 'text': 'brand | ' || b || chr(10) || 'type | kind | ' || t, 'first_byte': o4, 'last_byte': o6},
 {'node_no': 8, 'parent_no': 7, 'node_type': 'TABLE_ROW', 'marker': NULL, 'ordinal': NULL, 'text': 'brand | ' || b, 'first_byte': o4, 'last_byte': o5},
 {'node_no': 9, 'parent_no': 8, 'node_type': 'TABLE_CELL', 'marker': NULL, 'ordinal': NULL, 'text': 'brand', 'first_byte': o4 + 2, 'last_byte': o4 + 7},
 {'node_no': 10, 'parent_no': 8, 'node_type': 'TABLE_CELL', 'marker': NULL, 'ordinal': NULL, 'text': b, 'first_byte': o4 + 10, 'last_byte': o4 + 10 + lb},
 {'node_no': 11, 'parent_no': 7, 'node_type': 'TABLE_ROW', 'marker': NULL, 'ordinal': NULL, 'text': 'type | kind | ' || t, 'first_byte': o5, 'last_byte': o6},
 {'node_no': 12, 'parent_no': 11, 'node_type': 'TABLE_CELL', 'marker': NULL, 'ordinal': NULL, 'text': 'type | kind', 'first_byte': o5 + 2, 'last_byte': o5 + 14},
 {'node_no': 13, 'parent_no': 11, 'node_type': 'TABLE_CELL', 'marker': NULL, 'ordinal': NULL, 'text': t, 'first_byte': o5 + 17, 'last_byte': o5 + 19 + lt},
 {'node_no': 14, 'parent_no': 0, 'node_type': 'ORDERED_LIST', 'marker': NULL, 'ordinal': 3, 'text': b || chr(10) || 'size ' || z || chr(10) || 'end', 'first_byte': o7, 'last_byte': o11},
 {'node_no': 15, 'parent_no': 14, 'node_type': 'LIST_ITEM', 'marker': '3.', 'ordinal': 3, 'text': b || chr(10) || 'size ' || z, 'first_byte': o7, 'last_byte': o9},
 {'node_no': 16, 'parent_no': 15, 'node_type': 'PARAGRAPH', 'marker': NULL, 'ordinal': NULL, 'text': b, 'first_byte': o7, 'last_byte': o8},
 {'node_no': 17, 'parent_no': 15, 'node_type': 'UNORDERED_LIST', 'marker': NULL, 'ordinal': NULL, 'text': 'size ' || z, 'first_byte': o8, 'last_byte': o9},
 {'node_no': 18, 'parent_no': 17, 'node_type': 'LIST_ITEM', 'marker': '-', 'ordinal': NULL, 'text': 'size ' || z, 'first_byte': o8, 'last_byte': o9},
 {'node_no': 19, 'parent_no': 18, 'node_type': 'PARAGRAPH', 'marker': NULL, 'ordinal': NULL, 'text': 'size ' || z, 'first_byte': o8, 'last_byte': o9},
 {'node_no': 20, 'parent_no': 14, 'node_type': 'LIST_ITEM', 'marker': '4.', 'ordinal': 4, 'text': 'end', 'first_byte': o9, 'last_byte': o11},
 {'node_no': 21, 'parent_no': 20, 'node_type': 'PARAGRAPH', 'marker': NULL, 'ordinal': NULL, 'text': 'end', 'first_byte': o9, 'last_byte': o9 + 7},
 {'node_no': 22, 'parent_no': 0, 'node_type': 'BLOCKQUOTE', 'marker': NULL, 'ordinal': NULL, 'text': t, 'first_byte': o11, 'last_byte': o12},
 {'node_no': 23, 'parent_no': 22, 'node_type': 'PARAGRAPH', 'marker': NULL, 'ordinal': NULL, 'text': t, 'first_byte': o11, 'last_byte': o12}]) AS x FROM q) u"""
)
def markdown_part_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees of Markdown texts that are built around the columns of the parts."""
    nodes = M.markdown_tree(_part_texts(spark, sf_dir), "p_partkey", "text")
    return nodes.select("p_partkey", "node_no", "parent_no", "node_type", "marker", "ordinal", "text", "first_byte", "last_byte")


@query(
    """SELECT p_partkey, CAST(k AS INT) AS block_no, block_type, block_text, section_path, grid FROM (SELECT p_partkey, p_name AS section_path, unnest([
 {'k': 1, 'block_type': 'TITLE', 'block_text': p_name, 'grid': NULL},
 {'k': 2, 'block_type': 'TABLE', 'block_text': 'key | value' || chr(10) || 'brand | ' || p_brand || chr(10) || 'type | kind | ' || p_type, 'grid': '[["key","value"],["brand","' || p_brand || '"],["type | kind","' || p_type || '"]]'},
 {'k': 3, 'block_type': 'LIST', 'block_text': '3. ' || p_brand || chr(10) || '   - size ' || p_size || chr(10) || '4. end', 'grid': NULL},
 {'k': 4, 'block_type': 'BLOCKQUOTE', 'block_text': '> *' || p_type || '*', 'grid': NULL}], recursive := true) FROM part)"""
)
def markdown_part_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-level blocks of the same texts: read titles and grids, sources of the others, sections."""
    texts = _part_texts(spark, sf_dir)
    blocks = M.markdown_blocks(M.markdown_tree(texts, "p_partkey", "text"), texts, "p_partkey", "text")
    return blocks.select("p_partkey", "block_no", "block_type", "block_text", "section_path", F.to_json("rows").alias("grid"))


@query()
def chunk_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping chunks of every text."""
    return P.recursive_chunks(table(spark, sf_dir, "documents"), "doc_id", "text", 800, 120)


@query()
def parent_child_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of every text, cut to parents, and their children."""
    return P.parent_child_chunks(table(spark, sf_dir, "documents"), "doc_id", "text")


@query()
def segment_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments that cover every text once, packed into batches by token cost."""
    return P.segment_plan(table(spark, sf_dir, "documents"), "doc_id", "text").drop("text")
