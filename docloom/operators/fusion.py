"""Fusion traces: channels with their keys and gates, hybrid scores, reasons, seats, rendered evidence.

Everything keeps the grain (query_id, sub_question, ...), so many questions run at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.retrieval import RRF, WEIGHTS

#: Shares of a candidate's own score and of its metadata boost, which counts up to 1, in the hybrid score.
ORIGINAL, METADATA = 0.08, 0.04

# Reasons and the texts shown for them.
REASONS = {
    "SELECTED_BY_RANK": "按综合排名选入",
    "SELECTED_TOP_RANK": "排名靠前选入",
    "SELECTED_ROUTE_CANDIDATE_RESERVE": "路由候选保留选入",
    "SELECTED_GRAPH_RAG_QUOTE": "图谱证据选入",
    "SELECTED_RAPTOR_SOURCE_CHUNK": "RAPTOR 源块选入",
    "SELECTED_SAME_SECTION_BODY": "同章节正文选入",
    "SELECTED_STRUCTURE_ANCHOR": "结构锚点选入",
    "SELECTED_STRUCTURE_ANCHOR_BODY": "结构锚点正文选入",
    "SELECTED_STRUCTURE_DESCENDANT_BODY": "结构下级正文选入",
    "SELECTED_STRUCTURE_NAVIGATION_CHILD": "结构导航·子块选入",
    "SELECTED_STRUCTURE_NAVIGATION_CURRENT": "结构导航·当前块选入",
    "SELECTED_STRUCTURE_NAVIGATION_PARENT": "结构导航·父块选入",
    "SELECTED_STRUCTURE_NAVIGATION_SIBLING": "结构导航·同级块选入",
    "FILTERED_BY_CANDIDATE_TOP_K": "超出候选数上限被筛除",
    "FILTERED_BY_CHANNEL_GATE": "未过通道质量闸门",
    "FILTERED_BY_FINAL_TOP_K": "超出最终证据数上限",
    "FILTERED_BY_KEYWORD_RELATIVE_SCORE": "关键词相对分过低被筛除",
    "FILTERED_BY_RERANK_CANDIDATE_TOP_K": "超出重排候选数上限",
    "FILTERED_BY_VECTOR_GATE": "未过向量相似度闸门",
    "FILTERED_NOT_APPLICABLE_TO_TARGET_ENTITY": "与目标实体不相关被筛除",
    "CONTEXT_ONLY": "仅作上下文·不可引用",
}
NO_REASON, SELECTED, FILTERED = "未进入最终证据", "已选入", "被筛除"
OMITTED, NO_EVIDENCE, REUSED = "- 其余证据因上下文预算限制已省略", "- 当前子问题没有检索到证据", "- 复用证据 [{0}]"


def reason_text(code: Column) -> Column:
    """The text of a reason; unknown ones by their lead, others as they are."""
    known = F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair])
    lead = F.when(code.startswith("SELECTED_"), SELECTED).when(code.startswith("FILTERED_"), FILTERED).otherwise(code)
    return F.when(F.coalesce(code, F.lit("")) == "", NO_REASON).otherwise(F.coalesce(F.try_element_at(known, code), lead))


def channel_key(index: Column, channel: Column) -> Column:
    """Key of a channel's trace and execution: ``index:channel``, 1 and unknown where missing."""
    return F.concat_ws(":", F.coalesce(index, F.lit(1)).cast("string"), F.coalesce(F.nullif(channel, F.lit("")), F.lit("unknown")))


def gate(hits: DataFrame, floors: dict[str, float]) -> DataFrame:
    """Adds gate_passed and gate_reason: whether a hit's score reaches the floor of its channel (none: it passes)."""
    floor = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in floors.items() for x in pair]), F.col("channel")), F.lit(float("-inf")))
    passed = F.coalesce(F.col("score") >= floor, F.lit(False))
    code = F.when(F.col("channel") == "vector", "FILTERED_BY_VECTOR_GATE").otherwise("FILTERED_BY_CHANNEL_GATE")
    return hits.withColumn("gate_passed", passed).withColumn("gate_reason", F.when(~passed, code))


def channel_ranks(hits: DataFrame) -> DataFrame:
    """Adds channel_rank: the place by score within query, sub-question and channel; ties to the lower id."""
    order = Window.partitionBy("query_id", "sub_question", "channel").orderBy(F.desc("score"), "doc_id")
    return hits.withColumn("channel_rank", F.row_number().over(order))


def hybrid(hits: DataFrame) -> DataFrame:
    """(query_id, doc_id, rrf, original, boost, hybrid, channels) of ranked hits (query_id, doc_id, channel, channel_rank, score, metadata_boost).

    Weighted reciprocal ranks over all channels, plus a share of the best own
    score and of the best metadata boost; a document counts once for each channel and sub-question.
    """
    weight = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair]), F.col("channel")), F.lit(1.0))
    grouped = hits.groupBy("query_id", "doc_id").agg(
        F.sum(weight / (RRF + F.col("channel_rank"))).alias("rrf"),
        F.coalesce(F.max("score"), F.lit(0.0)).alias("original"),
        F.least(F.coalesce(F.max("metadata_boost"), F.lit(0.0)), F.lit(1.0)).alias("boost"),
        F.array_join(F.sort_array(F.collect_set("channel")), ",").alias("channels"),
    )
    score = F.col("rrf") + ORIGINAL * F.col("original") + METADATA * F.col("boost")
    return grouped.select("query_id", "doc_id", F.round("rrf", 8).alias("rrf"), F.round("original", 6).alias("original"), F.round("boost", 6).alias("boost"), F.round(score, 8).alias("hybrid"), "channels")


def seats(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """The rows of each query that are shown: selected ones first, the rest by place; 4 to 20 of them, 12 unless said."""
    n = max(4, min(limit or 12, 20))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.coalesce("selected", F.lit(False))), "place")
    return rows.withColumn("seat", F.row_number().over(order)).where(F.col("seat") <= n)


def rendered_evidence(evidence: DataFrame, questions: DataFrame, budget: int) -> DataFrame:
    """(query_id, sub_question, rendered, n_rendered, n_omitted) for every (query_id, sub_question) of ``questions``.

    Evidence (query_id, sub_question, place, reference_id, text) is taken by
    place while the query's running length stays within the budget. What an
    earlier sub-question rendered is only named again; what does not fit is
    noted as omitted; a sub-question without evidence says so.
    """
    by_query = Window.partitionBy("query_id").orderBy("sub_question", "place", "reference_id")
    first = Window.partitionBy("query_id", "reference_id").orderBy("sub_question", "place")
    fresh = evidence.withColumn("again", F.row_number().over(first) > 1)
    used = F.sum(F.when(F.col("again"), 0).otherwise(F.length("text"))).over(by_query.rowsBetween(Window.unboundedPreceding, 0))
    taken = fresh.withColumn("fits", F.col("again") | (used <= budget))
    line = F.when(F.col("again"), F.concat(F.lit(REUSED.split("{0}")[0]), F.col("reference_id").cast("string"), F.lit(REUSED.split("{0}")[1]))).otherwise(
        F.concat(F.lit("["), F.col("reference_id").cast("string"), F.lit("] "), F.col("text"))
    )
    grouped = taken.groupBy("query_id", "sub_question").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("fits"), F.struct("place", "reference_id", line.alias("line"))))), lambda x: x["line"]).alias("lines"),
        F.count_if(F.col("fits")).alias("n_rendered"),
        F.count_if(~F.col("fits")).alias("n_omitted"),
    )
    out = questions.join(grouped, ["query_id", "sub_question"], "left")
    note = F.when(F.col("n_omitted") > 0, F.array(F.lit(OMITTED))).otherwise(F.expr("cast(array() as array<string>)"))
    text = F.when(F.col("lines").isNull(), NO_EVIDENCE).otherwise(F.array_join(F.concat(F.col("lines"), note), "\n"))
    return out.select("query_id", "sub_question", text.alias("rendered"), F.coalesce("n_rendered", F.lit(0)).alias("n_rendered"), F.coalesce("n_omitted", F.lit(0)).alias("n_omitted"))
