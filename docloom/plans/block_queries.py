"""Queries over blocks, references, rejections and traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.operators import blocks as B
from docloom.plans.catalogue import query
from docloom.plans.text_queries import BLOCKS, STRIP, blocks
from docloom.sources.tables import table
from docloom.streaming.events import latest_trace


@query(
    f"""WITH b AS ({BLOCKS}), k AS (SELECT *, block_no // 20 AS page_no FROM b)
SELECT doc_id, count(*) AS n_blocks, CAST(max(page_no) + CASE WHEN min(page_no) = 0 THEN 1 ELSE 0 END AS INT) AS n_pages, count_if(block_type = 'TITLE') AS n_titles,
 round(count_if(block_no % 3 = 0) * 1.0 / count(*), 4) AS box_coverage FROM k GROUP BY ALL"""
)
def parse_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, block types and box coverage of each text."""
    b = blocks(spark, sf_dir).withColumn("page_no", F.floor(F.col("block_no") / 20).cast("int")).withColumn("box", F.when(F.col("block_no") % 3 == 0, 1))
    out = B.parse_trace(b)
    return out.select("doc_id", "n_blocks", "n_pages", F.coalesce(F.try_element_at("type_counts", F.lit("TITLE")), F.lit(0)).alias("n_titles"), "box_coverage")


@query(
    f"""WITH l AS ({BLOCKS}), c AS (SELECT doc_id, 1 AS table_id, block_no AS row_no, i AS column_no, string_split(block_text, ' | ')[i + 1] AS cell FROM l, LATERAL (SELECT unnest(range(0, len(string_split(block_text, ' | ')))) AS i) WHERE block_type = 'TABLE'),
f AS (SELECT doc_id, table_id, row_no, column_no, {STRIP.format("CASE WHEN (row_no + column_no) % 5 = 0 THEN 'no such ' || cell ELSE cell END")} AS cell FROM c),
g AS (SELECT f.* FROM f JOIN documents d USING (doc_id) WHERE length(cell) BETWEEN 2 AND 120 AND NOT regexp_matches(cell, '[。！？.!?；;]$') AND contains(text, cell)),
r AS (SELECT doc_id, table_id, row_no FROM g GROUP BY ALL HAVING count(*) >= 2),
k AS (SELECT g.* FROM g JOIN r USING (doc_id, table_id, row_no)), t AS (SELECT doc_id, table_id FROM k GROUP BY ALL HAVING count(DISTINCT column_no) >= 2)
SELECT doc_id, CAST(row_no AS INT) AS row_no, CAST(column_no AS INT) AS column_no, cell FROM k JOIN t USING (doc_id, table_id)"""
)
def visible_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of every table line that are grounded in the text of their document; every fifth one is made up."""
    lines = blocks(spark, sf_dir).where("block_type = 'TABLE'")
    cells = lines.select("doc_id", F.lit(1).alias("table_id"), F.col("block_no").alias("row_no"), F.posexplode(F.split("block_text", r" \| ")).alias("column_no", "cell"))
    made_up = (F.col("row_no") + F.col("column_no")) % 5 == 0
    cells = cells.withColumn("cell", F.when(made_up, F.concat(F.lit("no such "), "cell")).otherwise(F.col("cell")))
    segments = table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("segment_no"), "text")
    return B.visible_cells(cells, segments).select("doc_id", "row_no", "column_no", "cell")


@query("SELECT event_id, event_type FROM events WHERE user_id % 7 <> 0 AND event_type <> 'view' AND value >= 5")
def citable_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References without an identity or only there for context are left out."""
    e = table(spark, sf_dir, "events")
    refs = e.select("event_id", "event_type", F.when(F.col("user_id") % 7 != 0, "id").alias("identity"), (F.col("value") < 5).alias("context_only"), F.when(F.col("event_type") == "view", "CONTEXT_ONLY").alias("evidence_type"))
    return B.citable(refs).select("event_id", "event_type")


@query("SELECT event_id, event_type = 'purchase' OR user_id % 5 = 0 OR value > 90 AS is_table FROM events")
def table_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which references point into a table: those with a table, row or column of their own."""
    e = table(spark, sf_dir, "events")
    fields = (F.when(F.col("event_type") == "purchase", F.col("event_type")), F.when(F.col("user_id") % 5 == 0, F.col("user_id")), F.when(F.col("value") > 90, F.col("value")))
    return e.select("event_id", B.is_table_reference(*fields).alias("is_table"))


@query("SELECT event_type AS reason, count(*) AS n FROM events GROUP BY ALL")
def rejection_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejections by reason; all are counted whatever the sample holds."""
    e = table(spark, sf_dir, "events")
    return B.rejection_report(e.select(F.lit("entity").alias("kind"), F.col("event_id").alias("id"), F.col("event_type").alias("reason")))[0]


@query(
    """SELECT o_orderkey, CASE WHEN n <= 0 THEN '' WHEN n <= 7 THEN array_to_string(range(0, n), ',') ELSE array_to_string(list_sort(list_distinct(list_transform(range(0, 7), lambda k: CAST(floor(k * (n - 1) / 6.0 + 0.5) AS INT)))), ',') END AS ticks
FROM (SELECT o_orderkey, CAST(o_orderkey % 40 AS INT) AS n FROM orders)"""
)
def tick_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most seven evenly spread ticks."""
    n = (F.col("o_orderkey") % 40).cast("int")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(B.tick_indexes(n), ",").alias("ticks"))


@query(
    """SELECT canonical, count(*) AS mentions, count(DISTINCT doc_id) AS documents FROM (SELECT c_custkey AS doc_id, regexp_replace(lower(c_mktsegment || '-' || (c_nationkey % 3)), '[\\s_-]+', ' ', 'g') AS canonical FROM customer) GROUP BY ALL"""
)
def canonical_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities by normalised name."""
    name = F.concat("c_mktsegment", F.lit("-"), (F.col("c_nationkey") % 3).cast("string"))
    return B.canonical_groups(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), name.alias("name")))


@query(
    """WITH n AS (SELECT o_custkey AS node, o_orderkey AS chunk, o_totalprice AS score FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY score DESC, chunk) AS place FROM n)
SELECT node, chunk, score, CAST(place AS INT) AS place FROM r WHERE place <= 4"""
)
def tree_drill_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four best chunks below each summary node."""
    orders = table(spark, sf_dir, "orders")
    nodes = orders.groupBy(F.col("o_custkey").alias("node")).agg(F.collect_list("o_orderkey").alias("chunks"))
    return B.drill_down(nodes, orders.select(F.col("o_orderkey").alias("chunk"), F.col("o_totalprice").alias("score")))


@query("SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_regionkey < 2))")
def bridge_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics that a document reaches through relations."""
    region = table(spark, sf_dir, "region").where("r_regionkey < 2").select(F.col("r_regionkey").alias("n_regionkey"))
    nation = table(spark, sf_dir, "nation").join(region, "n_regionkey", "left_semi").select(F.col("n_nationkey").alias("s_nationkey"))
    return table(spark, sf_dir, "supplier").join(nation, "s_nationkey", "left_semi").select("s_suppkey")


@query(
    """WITH g AS (SELECT event_type, count(*) AS n FROM events GROUP BY ALL) SELECT event_type, n, round(n * 100.0 / sum(n) OVER (), 4) AS share,
 CAST(coalesce(sum(n) OVER (ORDER BY event_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS arc_start FROM g WHERE n > 0"""
)
def decision_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of each outcome and where its arc starts; the window is over one row per outcome."""
    grouped = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n")).withColumn("all", F.lit(1))
    order = Window.partitionBy("all").orderBy("event_type").rowsBetween(Window.unboundedPreceding, -1)
    share = F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("all")), 4)
    return grouped.select("event_type", "n", share.alias("share"), F.coalesce(F.sum("n").over(order), F.lit(0)).alias("arc_start"))


@query(
    """WITH t AS (SELECT user_id AS exchange_id, list({'seq': event_id, 'mode': CASE WHEN event_id % 3 = 0 THEN 'auto' ELSE 'shadow' END, 'at': value} ORDER BY event_id) AS x FROM events GROUP BY ALL),
f AS (SELECT exchange_id, list_reduce(x, lambda kept, t: CASE WHEN (t.mode = 'auto' AND kept.mode <> 'auto') OR t.at >= kept.at THEN t ELSE kept END) AS t FROM t)
SELECT exchange_id, t.seq AS seq, t.mode AS mode, t.at AS at FROM f"""
)
def latest_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trace that each exchange ends up with."""
    e = table(spark, sf_dir, "events")
    mode = F.when(F.col("event_id") % 3 == 0, "auto").otherwise("shadow")
    return latest_trace(e.select(F.col("user_id").alias("exchange_id"), F.col("event_id").alias("seq"), mode.alias("mode"), F.col("value").alias("at")))


@query()
def semantic_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of neighbouring, related sentences."""
    return B.semantic_chunks(table(spark, sf_dir, "documents"))


@query(
    f"""WITH b AS ({BLOCKS}),
m AS (SELECT doc_id, string_agg(CASE WHEN block_type = 'TITLE' THEN '# ' ELSE '' END || block_text, chr(10) || chr(10) ORDER BY block_no) AS md,
  '[' || string_agg('{{"block_no":' || block_no || ',"block_type":"' || block_type || '","block_text":' || CAST(to_json(block_text) AS VARCHAR) || '}}', ',' ORDER BY block_no) || ']' AS js FROM b GROUP BY doc_id)
SELECT doc_id, 'MARKDOWN' AS kind, sha256(md) AS sha256 FROM m UNION ALL SELECT doc_id, 'JSON_BLOCKS', sha256(js) FROM m"""
)
def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text's blocks as Markdown and JSON files with their hashes."""
    from docloom.sources.files import artifacts as build

    return build(blocks(spark, sf_dir)).select("doc_id", "kind", "sha256")
