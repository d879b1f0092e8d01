"""Queries over fusion traces; vectors and their labels stand for hits of several channels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.operators import fusion as X
from docloom.plans.catalogue import query
from docloom.plans.retrieval_queries import BM25, keyword_scores
from docloom.sources.tables import table

# Hits: keyword ones from the ranking, and by its ranks four more channels of the same documents.
HITS = f"""{BM25},
h AS (SELECT query_id, doc_id, CAST(1 + doc_id % 2 AS INT) AS sub_question, ch.channel, score / ch.d AS score, CAST(doc_id % 7 AS DOUBLE) / 4 AS metadata_boost FROM (SELECT * FROM kw WHERE rank <= 20) k,
 (VALUES ('keyword', 1), ('vector', 20), ('table', 2), ('graph', 3), ('tree', 5)) ch(channel, d) WHERE ch.channel = 'keyword' OR (doc_id + ch.d) % 3 = 0),
g AS (SELECT *, score >= CASE channel WHEN 'vector' THEN 0.35 WHEN 'graph' THEN 2.0 ELSE -1e300 END AS gate_passed FROM h),
c AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, sub_question, channel ORDER BY score DESC, doc_id) AS INT) AS channel_rank FROM g WHERE gate_passed)"""


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.operators.retrieval import top_k

    best = top_k(keyword_scores(spark, sf_dir, k=20), 20)
    ways = F.array(*[F.struct(F.lit(n).alias("channel"), F.lit(d).alias("d")) for n, d in (("keyword", 1), ("vector", 20), ("table", 2), ("graph", 3), ("tree", 5))])
    each = best.select("query_id", "doc_id", "score", F.explode(ways).alias("w")).where("w.channel = 'keyword' or (doc_id + w.d) % 3 = 0")
    return each.select(
        "query_id", "doc_id", (1 + F.col("doc_id") % 2).cast("int").alias("sub_question"), "w.channel", (F.col("score") / F.col("w.d")).alias("score"), ((F.col("doc_id") % 7).cast("double") / 4).alias("metadata_boost")
    )


FLOORS = {"vector": 0.35, "graph": 2.0}


@query(
    f"WITH {HITS} SELECT query_id, doc_id, sub_question, channel, score, gate_passed, CASE WHEN gate_passed THEN NULL WHEN channel = 'vector' THEN 'FILTERED_BY_VECTOR_GATE' ELSE 'FILTERED_BY_CHANNEL_GATE' END AS gate_reason FROM g"
)
def channel_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hit, whether it passes its channel's gate, and the reason if not."""
    return X.gate(hits(spark, sf_dir), FLOORS).select("query_id", "doc_id", "sub_question", "channel", "score", "gate_passed", "gate_reason")


@query(f"WITH {HITS} SELECT query_id, sub_question, channel, doc_id, channel_rank FROM c")
def channel_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places within each sub-question's channel, after the gate."""
    return X.channel_ranks(X.gate(hits(spark, sf_dir), FLOORS).where("gate_passed")).select("query_id", "sub_question", "channel", "doc_id", "channel_rank")


HYBRID = """f AS (SELECT query_id, doc_id, sum(CASE channel WHEN 'vector' THEN 1.0 WHEN 'keyword' THEN 1.1 WHEN 'table' THEN 1.2 WHEN 'graph' THEN 1.1 ELSE 1.05 END / (60 + channel_rank)) AS rrf, max(score) AS original, least(max(metadata_boost), 1.0) AS boost,
 string_agg(DISTINCT channel, ',' ORDER BY channel) AS channels FROM c GROUP BY ALL)"""


@query(
    f"WITH {HITS}, {HYBRID} SELECT query_id, doc_id, round(rrf, 8) AS rrf, round(original, 6) AS original, round(boost, 6) AS boost, round(rrf + 0.08 * original + 0.04 * boost, 8) AS hybrid, channels FROM f"
)
def fusion_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reciprocal ranks by channel weight with own scores and metadata: the hybrid score."""
    return X.hybrid(X.channel_ranks(X.gate(hits(spark, sf_dir), FLOORS).where("gate_passed")))


@query(
    f"""WITH {HITS}, {HYBRID}, o AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf + 0.08 * original + 0.04 * boost, 8) DESC, doc_id) AS place FROM f),
s AS (SELECT *, doc_id % 5 = 0 AS selected FROM o) SELECT query_id, doc_id, CAST(seat AS INT) AS seat, selected FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY selected DESC, place) AS seat FROM s) WHERE seat <= 12"""
)
def reserved_seats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected candidates first, then the rest up to the limit."""
    scored = X.hybrid(X.channel_ranks(X.gate(hits(spark, sf_dir), FLOORS).where("gate_passed")))
    placed = scored.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("hybrid"), "doc_id"))).withColumn("selected", F.col("doc_id") % 5 == 0)
    return X.seats(placed).select("query_id", "doc_id", "seat", "selected")


CODES = [*X.REASONS, "SELECTED_BY_RERANK", "FILTERED_BY_RERANK_WINDOW", "OTHER", ""]


@query(
    "WITH t(code, text) AS (VALUES " + ", ".join(f"('{c}', '{t}')" for c, t in X.REASONS.items()) + f"""), e AS (SELECT event_id, list_extract([{", ".join(f"'{c}'" for c in CODES)}], CAST(1 + event_id % {len(CODES)} AS INT)) AS code FROM events)
SELECT event_id, code, CASE WHEN code = '' THEN '{X.NO_REASON}' ELSE coalesce(text, CASE WHEN starts_with(code, 'SELECTED_') THEN '{X.SELECTED}' WHEN starts_with(code, 'FILTERED_') THEN '{X.FILTERED}' ELSE code END) END AS shown FROM e LEFT JOIN t USING (code)"""
)
def selection_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reason codes, known and unknown ones, with the text shown."""
    code = F.get(F.array(*[F.lit(c) for c in CODES]), (F.col("event_id") % len(CODES)).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", code.alias("code")).withColumn("shown", X.reason_text(F.col("code")))


@query(
    """WITH t AS (SELECT event_id, coalesce(CASE WHEN user_id % 5 > 0 THEN user_id % 5 END, 1) || ':' || coalesce(CASE WHEN event_type <> 'view' THEN event_type END, 'unknown') AS key FROM events), x AS (SELECT key, count(*) AS executions FROM t GROUP BY ALL)
SELECT t.event_id, t.key, coalesce(x.executions, 0) AS executions FROM t LEFT JOIN (SELECT * FROM x WHERE key NOT LIKE '3:%') x ON x.key = t.key"""
)
def channel_trace_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channel traces with their executions by index and channel, with defaults for missing parts."""
    index, channel = F.when(F.col("user_id") % 5 > 0, F.col("user_id") % 5), F.when(F.col("event_type") != "view", F.col("event_type"))
    t = table(spark, sf_dir, "events").select("event_id", X.channel_key(index, channel).alias("key"))
    x = t.groupBy("key").agg(F.count("*").alias("executions")).where("key not like '3:%'")
    return t.join(x, "key", "left").select("event_id", "key", F.coalesce("executions", F.lit(0)).alias("executions"))


@query(
    """WITH g AS (SELECT user_id, event_type, round(avg(value), 6) AS weight FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY weight DESC, event_type) AS k FROM g)
SELECT user_id, string_agg(event_type, ',' ORDER BY k) AS channels, string_agg(event_type, ',' ORDER BY event_type) AS types FROM r GROUP BY ALL"""
)
def channel_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels by weight, then name, and the distinct sorted types; one short list for each user."""
    g = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.round(F.avg("value"), 6).alias("weight"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "event_type")))
    grouped = g.groupBy("user_id").agg(F.transform(listed, lambda x: x["event_type"]).alias("c"), F.sort_array(F.collect_set("event_type")).alias("t"))
    return grouped.select("user_id", F.array_join("c", ",").alias("channels"), F.array_join("t", ",").alias("types"))


@query(
    f"""WITH e AS (SELECT conv_id AS query_id, CAST(turn // 4 AS INT) AS sub_question, turn AS place, CAST(turn % 5 AS BIGINT) AS reference_id, coalesce(text, '') AS text FROM conversations WHERE role = 'user'),
a AS (SELECT *, row_number() OVER (PARTITION BY query_id, reference_id ORDER BY sub_question, place) > 1 AS again FROM e),
u AS (SELECT *, again OR sum(CASE WHEN again THEN 0 ELSE length(text) END) OVER (PARTITION BY query_id ORDER BY sub_question, place, reference_id ROWS UNBOUNDED PRECEDING) <= 200 AS fits FROM a),
g AS (SELECT query_id, sub_question, string_agg(CASE WHEN fits THEN CASE WHEN again THEN '- 复用证据 [' || reference_id || ']' ELSE '[' || reference_id || '] ' || text END END, chr(10) ORDER BY place, reference_id) AS lines, count_if(fits) AS n_rendered, count_if(NOT fits) AS n_omitted FROM u GROUP BY ALL),
q AS (SELECT DISTINCT conv_id AS query_id, CAST(turn // 4 AS INT) AS sub_question FROM conversations)
SELECT query_id, sub_question, sha256(CASE WHEN n_rendered IS NULL THEN '{X.NO_EVIDENCE}' WHEN n_omitted > 0 THEN coalesce(lines || chr(10), '') || '{X.OMITTED}' ELSE lines END) AS rendered_sha256, CAST(coalesce(n_rendered, 0) AS BIGINT) AS n_rendered, CAST(coalesce(n_omitted, 0) AS BIGINT) AS n_omitted
FROM q LEFT JOIN g USING (query_id, sub_question)"""
)
def evidence_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence rendered within a budget: with repeats named, omissions noted and empty sub-questions said to be so."""
    c = table(spark, sf_dir, "conversations").withColumn("sub_question", F.floor(F.col("turn") / 4).cast("int")).withColumnRenamed("conv_id", "query_id")
    evidence = c.where("role = 'user'").select("query_id", "sub_question", F.col("turn").alias("place"), (F.col("turn") % 5).cast("long").alias("reference_id"), F.coalesce("text", F.lit("")).alias("text"))
    out = X.rendered_evidence(evidence, c.select("query_id", "sub_question").distinct(), 200)
    return out.select("query_id", "sub_question", F.sha2("rendered", 256).alias("rendered_sha256"), "n_rendered", "n_omitted")
