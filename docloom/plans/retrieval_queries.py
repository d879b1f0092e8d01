"""Queries over recall channels, fusion, gates and gold sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import scalars as S
from docloom.operators import keyword_index as K
from docloom.operators import retrieval as R
from docloom.operators import vector_index as V
from docloom.plans.catalogue import query
from docloom.plans.text_queries import BLOCKS, blocks
from docloom.sources.tables import table

TOKENS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')"
BM25 = f"""q AS (SELECT DISTINCT item_id AS query_id, unnest({TOKENS}) AS term FROM benchmark),
d AS (SELECT doc_id AS id, {TOKENS} AS toks FROM documents),
stats AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM d),
p AS (SELECT id, len(toks) AS dl, unnest(toks) AS term FROM d),
tf AS (SELECT id, term, count(*) AS tf, min(dl) AS dl FROM p WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
bm AS (SELECT q.query_id, tf.id AS doc_id,
   round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
 FROM q JOIN tf USING (term) JOIN df USING (term), stats GROUP BY ALL),
kw AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM bm)"""
UNIT = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"
VECTOR = f"""v AS (SELECT vec_id, label, {UNIT} AS u FROM embeddings),
vs AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round(list_cosine_similarity(a.u, b.u), 6) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
vr AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM vs)"""


def keyword_scores(spark: SparkSession, sf_dir: str, **cut: float) -> DataFrame:
    return R.bm25(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), "item_id", "text", "doc_id", "text", **cut)


def vector_scores(spark: SparkSession, sf_dir: str, **cut: float) -> DataFrame:
    """Every vector whose id is divisible by 50 against all others."""
    unit = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), S.l2_normalize(F.col("embedding")).alias("unit"))
    asked = unit.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.col("unit").alias("unit_q"))
    return R.vector_scores(asked, unit, **cut)


@query(f"WITH {BM25} SELECT query_id, doc_id, score, rank, CASE WHEN rank <= 6 THEN 'SELECTED_BY_KEYWORD' ELSE 'FILTERED_BY_FINAL_TOP_K' END AS reason FROM kw WHERE rank <= 10")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword channel: the ten best documents of every benchmark item, with reasons."""
    best = R.top_k(keyword_scores(spark, sf_dir, k=10), 10)
    reason = F.when(F.col("rank") <= 6, "SELECTED_BY_KEYWORD").otherwise("FILTERED_BY_FINAL_TOP_K")
    return best.select("query_id", "doc_id", "score", "rank", reason.alias("reason"))


@query(f"WITH {BM25}, b AS (SELECT query_id, max(score) AS best FROM bm GROUP BY ALL) SELECT query_id, doc_id, score FROM bm JOIN b USING (query_id) WHERE score >= 0.25 * best")
def keyword_relative_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword hits that reach a quarter of their query's best score."""
    return R.relative_floor(keyword_scores(spark, sf_dir, share=0.25), 0.25)


def grain_sql(units: str) -> str:
    """BM25 of units (id, text), several rows of an id being one unit, with every posting scored."""
    return f"""WITH r AS ({units}), d AS (SELECT id, {TOKENS} AS toks FROM r),
l AS (SELECT id, sum(len(toks)) AS dl FROM d GROUP BY ALL), stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM l),
q AS (SELECT DISTINCT item_id AS query_id, unnest({TOKENS}) AS term FROM benchmark),
tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(toks) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
bm AS (SELECT query_id, tf.id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
 FROM q JOIN tf USING (term) JOIN df USING (term) JOIN l ON l.id IS NOT DISTINCT FROM tf.id, stats GROUP BY ALL),
kw AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank FROM bm)"""


CHUNKS, SECTIONS, ROUTES = (
    f"SELECT {{'doc_id': doc_id, 'block_no': block_no}} AS id, block_text AS text FROM ({BLOCKS})",
    "SELECT doc_id AS id, text FROM documents",
    "SELECT {'scope': coalesce(source, ''), 'topic': coalesce(lang, '')} AS id, text FROM documents",
)


def grain(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """(unit, text) of the three grains: blocks of a text, texts, and all texts of a scope and topic."""
    if name == "chunk":
        return blocks(spark, sf_dir).select(F.struct("doc_id", "block_no").alias("unit"), F.col("block_text").alias("text"))
    docs = table(spark, sf_dir, "documents")
    if name == "section":
        return docs.select(F.col("doc_id").alias("unit"), "text")
    blank = F.lit("")
    return docs.select(F.struct(F.coalesce("source", blank).alias("scope"), F.coalesce("lang", blank).alias("topic")).alias("unit"), "text")


def indexed(spark: SparkSession, sf_dir: str, name: str, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """Hits and work of all benchmark items in the keyword index of a grain."""
    return K.search(table(spark, sf_dir, "benchmark"), K.build(grain(spark, sf_dir, name), "unit", "text"), "item_id", "text", k)


@query(f"{grain_sql(CHUNKS)} SELECT query_id, id.doc_id AS doc_id, id.block_no AS block_no, score, rank FROM kw WHERE rank <= 10")
def keyword_index_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best blocks of texts by the keyword index."""
    return indexed(spark, sf_dir, "chunk")[0].select("query_id", "unit.doc_id", "unit.block_no", "score", "rank")


@query(f"{grain_sql(SECTIONS)} SELECT query_id, id AS doc_id, score, rank FROM kw WHERE rank <= 10")
def keyword_index_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best whole texts by the keyword index, the same as ``bm25_topk`` by scoring every text."""
    return indexed(spark, sf_dir, "section")[0].withColumnRenamed("unit", "doc_id")


@query(f"{grain_sql(ROUTES)} SELECT query_id, id.scope AS scope, id.topic AS topic, score, rank FROM kw WHERE rank <= 3")
def keyword_index_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three best scopes and topics by the words of all their texts."""
    return indexed(spark, sf_dir, "route", 3)[0].select("query_id", "unit.scope", "unit.topic", "score", "rank")


@query()
def keyword_index_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings of each query's terms at the grain of texts, and how many of them its search reads."""
    return indexed(spark, sf_dir, "section")[1]


@query(f"WITH {VECTOR} SELECT query_id, doc_id, score, rank FROM vr WHERE rank <= 10")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector channel: ten nearest by cosine."""
    return R.top_k(vector_scores(spark, sf_dir, k=10), 10)


def indexed_hits(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    """Ten nearest of the same queries through an inverted file; vectors are spread widely here, so five in eight of its lists are read for a recall of 0.9."""
    unit = table(spark, sf_dir, "embeddings").where("vec_id is not null and embedding is not null").select(F.col("vec_id").alias("doc_id"), S.l2_normalize(F.col("embedding")).alias("unit"))
    coarse = V.train(unit)
    asked = unit.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.col("unit").alias("unit_q"))
    return V.search(asked, V.build(unit, coarse), coarse, unit, k, probes=-(-5 * len(coarse.centroids) // 8))


@query()
def vector_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector channel through the index: ten nearest by cosine among the lists that are read."""
    return indexed_hits(spark, sf_dir)


@query()
def vector_index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of each query's ten nearest the index finds."""
    return V.recall(indexed_hits(spark, sf_dir), vector_topk(spark, sf_dir))


@query(f"WITH {VECTOR} SELECT query_id, doc_id, score FROM vs WHERE score >= 0.35")
def vector_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector hits at or above the similarity floor."""
    return vector_scores(spark, sf_dir, floor=0.35).where("score >= 0.35")


@query(
    f"""WITH {VECTOR}, l AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY b.vec_id) AS INT) AS rank
  FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
u AS (SELECT query_id, doc_id, 'vector' AS channel, 1.0 / (60 + rank) AS part FROM vr WHERE rank <= 10
  UNION ALL SELECT query_id, doc_id, 'keyword', 1.1 / (60 + rank) FROM l WHERE rank <= 10)
SELECT query_id, doc_id, round(sum(part), 8) AS fused, string_agg(DISTINCT channel, ',' ORDER BY channel) AS channels FROM u GROUP BY ALL"""
)
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted reciprocal-rank fusion of the vector channel with a label channel."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label")
    # the ten lowest ids of a label besides the query's own are among its eleven lowest, so no pairs of a class are listed
    lead = e.withColumn("place", F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))).where("place <= 11")
    same = lead.join(asked, "label").where("vec_id <> query_id").select("query_id", F.col("vec_id").alias("doc_id"), F.lit(0.0).alias("score"))
    return R.fuse({"vector": R.top_k(vector_scores(spark, sf_dir, k=10), 10), "keyword": R.top_k(same, 10)})


@query(
    f"""WITH {VECTOR}, f AS (SELECT * FROM vr WHERE rank <= 40),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score * (1 + doc_id % 3) DESC, doc_id) AS INT) AS final_rank FROM f WHERE rank <= 24)
SELECT query_id, doc_id, rank, final_rank, CASE WHEN final_rank IS NULL THEN 'FILTERED_BY_RERANK_CANDIDATE_TOP_K' WHEN final_rank <= 6 THEN 'SELECTED_BY_RANK' ELSE 'FILTERED_BY_FINAL_TOP_K' END AS reason
FROM f LEFT JOIN (SELECT query_id, doc_id, final_rank FROM r) USING (query_id, doc_id)"""
)
def topk_cascade_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40 candidates, 24 reranked, 6 selected; each with the reason for its fate."""
    ranked = R.top_k(vector_scores(spark, sf_dir, k=40), 40).withColumn("rerank_score", F.col("score") * (1 + F.col("doc_id") % 3))
    return R.cascade(ranked, 40, 24, 6).select("query_id", "doc_id", "rank", "final_rank", "reason")


NORMAL = "CASE WHEN s BETWEEN 0 AND 1 THEN s WHEN s >= 50 THEN 1.0 WHEN s <= -50 THEN 0.0 ELSE 1.0 / (1.0 + exp(-s)) END"


@query(f"SELECT event_id, round({NORMAL}, 9) AS normal FROM (SELECT event_id, (value - 50) / 10 AS s FROM events)")
def score_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw scores to [0, 1], with the step where identity and sigmoid meet."""
    return table(spark, sf_dir, "events").select("event_id", F.round(S.normalize_score((F.col("value") - 50) / 10), 9).alias("normal"))


@query(
    f"""WITH n AS (SELECT user_id AS query_id, event_id AS position, {NORMAL} AS normal FROM (SELECT *, (value - 50) / 10 AS s FROM events)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY normal DESC, position) AS INT) AS rank FROM n)
SELECT query_id, position, round(normal, 6) AS normal, rank FROM r WHERE rank <= 5"""
)
def rerank_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of each query after normalisation; ties keep their position."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("position"), ((F.col("value") - 50) / 10).alias("score"))
    return R.rerank(e, 5).select("query_id", "position", "normal", "rank")


@query(f"WITH {VECTOR} SELECT query_id, doc_id // 10 AS parent_id, min(rank) AS best_rank, arg_min(doc_id, rank) AS doc_id, count(*) AS n_children FROM vr WHERE rank <= 40 GROUP BY query_id, doc_id // 10")
def parent_elevation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Child hits lifted to their parent blocks of ten."""
    return R.elevate(R.top_k(vector_scores(spark, sf_dir, k=40), 40), F.floor(F.col("doc_id") / 10))


@query(
    f"""WITH {VECTOR}, g AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT g.query_id, count(*) AS n_relevant, count(h.doc_id) AS n_found, round(count(h.doc_id) * 1.0 / count(*), 6) AS recall
FROM g LEFT JOIN (SELECT * FROM vr WHERE rank <= 10) h ON h.query_id = g.query_id AND h.doc_id = g.doc_id GROUP BY ALL"""
)
def gold_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of the ten nearest against vectors of the same label; how many those are is counted, not listed."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label")
    wanted = asked.join(e.groupBy("label").agg((F.count("*") - 1).alias("n_relevant")), "label").where("n_relevant > 0")
    hits = R.top_k(vector_scores(spark, sf_dir, k=10), 10).join(e.select(F.col("vec_id").alias("doc_id"), F.col("label").alias("found_label")), "doc_id")
    found = hits.join(asked, "query_id").where("label = found_label").groupBy("query_id").agg(F.count("*").alias("n_found"))
    out = wanted.join(found, "query_id", "left").withColumn("n_found", F.coalesce("n_found", F.lit(0)))
    return out.select("query_id", "n_relevant", "n_found", F.round(F.col("n_found") / F.col("n_relevant"), 6).alias("recall"))


@query(
    f"""WITH {BM25}, s AS (SELECT item_id AS query_id, item_id % 5 = 0 AS empty_scope FROM benchmark)
SELECT query_id, empty_scope, n_returned, (n_returned = 0) = empty_scope AS correct FROM (SELECT s.query_id, s.empty_scope, count(k.doc_id) AS n_returned
FROM s LEFT JOIN (SELECT * FROM kw WHERE rank <= 6 AND query_id % 5 <> 0) k ON k.query_id = s.query_id GROUP BY s.query_id, s.empty_scope)"""
)
def empty_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether questions outside the scope get nothing; scope is applied before recall, not to its results."""
    cases = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") % 5 == 0).alias("empty_scope"))
    scoped = table(spark, sf_dir, "benchmark").where("item_id % 5 <> 0")
    hits = R.top_k(R.bm25(scoped, table(spark, sf_dir, "documents"), "item_id", "text", "doc_id", "text", k=6), 6).groupBy("query_id").agg(F.count("*").alias("n_returned"))
    out = cases.join(hits, "query_id", "left").withColumn("n_returned", F.coalesce("n_returned", F.lit(0)))
    return out.select("query_id", "empty_scope", "n_returned", ((F.col("n_returned") == 0) == F.col("empty_scope")).alias("correct"))


@query(
    f"""SELECT vec_id, round(n, 4) AS length, round(sqrt(list_sum(list_transform(u, lambda x: (x / n) * (x / n)))), 4) AS unit_length
FROM (SELECT vec_id, {UNIT} AS u, sqrt(list_inner_product({UNIT}, {UNIT})) AS n FROM embeddings)"""
)
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths before and after normalisation."""
    e = table(spark, sf_dir, "embeddings")
    unit = S.l2_normalize(F.col("embedding"))
    return e.select("vec_id", F.round(S.norm(F.col("embedding")), 4).alias("length"), F.round(S.norm(unit), 4).alias("unit_length"))


@query(
    f"""WITH v AS (SELECT vec_id, label, {UNIT} AS u FROM embeddings)
SELECT a.label AS left_label, b.label AS right_label, round(avg(list_cosine_similarity(a.u, b.u)), 4) AS similarity FROM v a JOIN v b ON a.label < b.label GROUP BY ALL"""
)
def average_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average similarity between clusters: the product of the mean unit vectors, so that no pair is ever listed."""
    e = table(spark, sf_dir, "embeddings").select("label", S.l2_normalize(F.col("embedding")).alias("u"))
    parts = e.select("label", F.posexplode("u").alias("k", "x")).groupBy("label", "k").agg(F.avg("x").alias("x"))
    left, right = parts.select(F.col("label").alias("left_label"), "k", F.col("x").alias("a")), parts.select(F.col("label").alias("right_label"), "k", F.col("x").alias("b"))
    return left.join(right, "k").where("left_label < right_label").groupBy("left_label", "right_label").agg(F.round(F.sum(F.col("a") * F.col("b")), 4).alias("similarity"))


@query(
    """SELECT source AS scope, lang AS topic, count(*) AS n_docs, round(avg(n_chars), 4) AS mean_chars, CASE WHEN count(*) >= 10 THEN 'ROUTED' ELSE 'WIDENED' END AS route
FROM documents GROUP BY ALL"""
)
def knowledge_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents narrowed by scope and topic; thin routes are widened."""
    d = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("scope"), F.col("lang").alias("topic"))
    return d.agg(F.count("*").alias("n_docs"), F.round(F.avg("n_chars"), 4).alias("mean_chars")).withColumn("route", F.when(F.col("n_docs") >= 10, "ROUTED").otherwise("WIDENED"))


@query(
    r"""SELECT conv_id, turn, CAST(i AS INT) AS part_no, parts[i] AS question FROM (SELECT conv_id, turn, parts, unnest(range(1, len(parts) + 1)) AS i FROM
 (SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array(text, '[？?；;\n]+'), lambda p: regexp_replace(regexp_replace(p, '^[\p{Z}\s]+', ''), '[\p{Z}\s]+$', '')), lambda p: p <> '') AS parts
  FROM conversations WHERE role = 'user'))"""
)
def question_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns split into their questions."""
    from docloom.functions.text import non_blank

    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    parts = c.select("conv_id", "turn", F.posexplode(non_blank(F.split("text", "[？?；;\n]+"))).alias("pos", "question"))
    return parts.select("conv_id", "turn", (F.col("pos") + 1).alias("part_no"), "question")


@query(
    """WITH r AS (SELECT conv_id, turn, length(text) AS n, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS used FROM conversations)
SELECT conv_id, turn, CAST(used AS BIGINT) AS used, used <= 1500 AS rendered FROM r"""
)
def evidence_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence rendered while its running length stays within the budget."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    used = F.sum(F.length("text")).over(w)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", used.alias("used"), (used <= 1500).alias("rendered"))
