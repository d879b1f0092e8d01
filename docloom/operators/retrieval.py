"""Recall channels, fusion, gates, ranks and their reasons as DataFrame plans.

Queries and documents are DataFrames; a channel gives (query_id, doc_id, score)
and every later step keeps that grain, so that many queries run at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.scalars import normalize_score
from docloom.functions.text import eval_tokens

K1, B = 1.2, 0.75
RRF = 60
#: Queries that one block holds about, by keyword and by vector; a block's terms or vectors are sent to every task.
TERM_BLOCK, VECTOR_BLOCK = 2000, 10_000
#: Documents and queries that are scored at once in a task.
ROWS, COLUMNS = 512, 256
#: Bytes of an Arrow batch of tokens, a session setting that is made only where there is none: texts of any length take the same memory.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "6m"
#: Channel weights of the fusion.
WEIGHTS = {"vector": 1.0, "keyword": 1.1, "table": 1.2, "graph": 1.1, "tree": 1.05}


def _blocks(queries: DataFrame, key: str, size: int) -> list[DataFrame]:
    """Queries dealt by hash to as many blocks as keep each near ``size`` rows."""
    n = max(1, -(-queries.count() // size))
    return [queries if n == 1 else queries.where(F.pmod(F.xxhash64(key), F.lit(n)) == k) for k in range(n)]


def _best(scores: np.ndarray, ids: np.ndarray, fits: np.ndarray, k: int | None, floor: float | None, share: float | None) -> np.ndarray:
    """Which of a batch's scores (a row per document, a column per query) can be in the result: a superset, cut where that is safe.

    The batch's k best of a query, ties to the lower id; scores from ``floor`` on;
    scores of at least ``share`` of the batch's best, which is at most the best of all.
    """
    keep = fits.copy()
    if floor is not None:
        keep &= scores >= floor
    if share is not None and len(scores):
        keep &= scores >= share * np.where(fits, scores, -np.inf).max(0) - 1e-9
    if k is not None and len(scores) > k:
        order = np.lexsort((np.broadcast_to(ids[:, None], scores.shape), -np.where(keep, scores, -np.inf)), axis=0)
        first = np.zeros_like(keep)
        np.put_along_axis(first, order[:k], True, axis=0)
        keep &= first
    return keep


def _rows(scores: np.ndarray, keep: np.ndarray, ids: np.ndarray, query_ids: np.ndarray) -> pa.RecordBatch:
    row, column = np.nonzero(keep)
    return pa.RecordBatch.from_arrays([pa.array(query_ids[column]), pa.array(ids[row]), pa.array(scores[row, column])], names=["query_id", "doc_id", "score"])


def bm25(queries: DataFrame, docs: DataFrame, query_id: str, query_text: str, doc_id: str, doc_text: str, k: int | None = None, share: float | None = None) -> DataFrame:
    """(query_id, doc_id, score): BM25 of the documents that share a term with a query.

    With ``k`` or ``share`` every batch of documents keeps only what can be among
    a query's k best, or reach that share of its best, so that neither common
    words nor many queries make the shuffled result large; ``top_k`` and
    ``relative_floor`` then give the exact result. Terms are looked up in the
    vocabulary of a block of queries, and a batch's scores are one product of
    term weights with the queries' terms. Frequencies are counted in one pass
    over the texts, scores in another.
    """
    tokens = docs.select(F.col(doc_id).cast("long").alias("id"), eval_tokens(F.col(doc_text)).alias("tokens"))
    asked = queries.select(F.col(query_id).cast("long").alias("query_id"), F.array_distinct(eval_tokens(F.col(query_text))).alias("terms"))
    return reduce(DataFrame.unionByName, [_bm25_block(block, tokens, k, share) for block in _blocks(asked, "query_id", TERM_BLOCK)])


def _bm25_block(asked: DataFrame, tokens: DataFrame, k: int | None, share: float | None) -> DataFrame:
    wanted = asked.orderBy("query_id").collect()  # a block of queries
    vocabulary = sorted({t for row in wanted for t in row["terms"]})
    context, conf = tokens.sparkSession.sparkContext, tokens.sparkSession.conf
    if conf.get(BATCH_SETTING, None) is None:
        conf.set(BATCH_SETTING, BATCH_BYTES)
    shared = context.broadcast((vocabulary, [(row["query_id"], row["terms"]) for row in wanted]))

    def places(batch: pa.RecordBatch, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, term) of every token in the vocabulary, and all documents' lengths."""
        listed = batch.column("tokens")
        bounds = listed.offsets.to_numpy()
        lengths = np.diff(bounds)
        found = pc.index_in(listed.values.slice(int(bounds[0]), int(bounds[-1] - bounds[0])), value_set=words)
        at = found.fill_null(-1).to_numpy()
        owner = np.repeat(np.arange(len(lengths)), lengths)
        return owner[at >= 0], at[at >= 0], lengths

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = pa.array(shared.value[0], pa.string())
        df, n, length = np.zeros(len(words), np.int64), 0, 0
        for batch in batches:
            owner, at, lengths = places(batch, words)
            df += np.bincount(np.unique(owner * len(words) + at) % max(1, len(words)), minlength=len(words))
            n, length = n + len(lengths), length + int(lengths.sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-2, len(words))), pa.array(np.concatenate([[n, length], df]))], names=["term", "n"])

    # a row per term of the block's queries, and two for the corpus
    counts = {row["term"]: row["n"] for row in tokens.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    n, average = counts.get(-2, 0), counts.get(-1, 0) / max(1, counts.get(-2, 0))
    df = np.array([counts.get(j, 0) for j in range(len(vocabulary))], float)
    idf = context.broadcast(np.log(1 + (n - df + 0.5) / (df + 0.5)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, known = pa.array(shared.value[0], pa.string()), shared.value[1]
        number = {t: j for j, t in enumerate(shared.value[0])}
        query_ids = np.array([q for q, _ in known], np.int64)
        for batch in (b.slice(first, ROWS) for b in batches for first in range(0, b.num_rows, ROWS)):
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            owner, at, lengths = places(batch, words)
            used, at = np.unique(at, return_inverse=True)
            tf = np.bincount(owner * len(used) + at, minlength=len(lengths) * len(used)).reshape(len(lengths), -1).astype(float)
            weight = tf * (K1 + 1) if len(used) else tf
            if len(used):  # in place: a batch's table of terms is the largest thing that a worker holds
                weight /= tf + K1 * (1 - B + B * lengths[:, None] / average)
                weight *= idf.value[used]
            column = {int(j): c for c, j in enumerate(used)}
            for first in range(0, len(known), COLUMNS):
                part = known[first : first + COLUMNS]
                holds = np.zeros((len(used), len(part)))
                for q, (_, terms) in enumerate(part):
                    for c in (column.get(number[t]) for t in terms):
                        if c is not None:
                            holds[c, q] = 1
                scores = np.round(weight @ holds, 6)
                # a term's weight is positive, so what shares one has a score even where it rounds to 0
                keep = _best(scores, ids, (tf > 0).astype(float) @ holds > 0, k, None, share)
                if keep.any():
                    yield _rows(scores, keep, ids, query_ids[first : first + COLUMNS])

    return tokens.mapInArrow(score, "query_id long, doc_id long, score double")


def top_k(scored: DataFrame, k: int, by: str = "query_id") -> DataFrame:
    """The k best of each query, with their rank; ties go to the lower id. Spark prunes to k before it shuffles."""
    order = Window.partitionBy(by).orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def vector_scores(queries: DataFrame, vectors: DataFrame, k: int | None = None, floor: float | None = None) -> DataFrame:
    """(query_id, doc_id, score) cosine of queries (query_id, unit_q) with all other (doc_id, unit).

    Queries go in blocks to every task, whose batches of vectors are multiplied
    with them. With ``k`` a batch keeps what can be among a query's k best, with
    ``floor`` what reaches it; ``top_k`` then gives the exact result.
    """
    context = vectors.sparkSession.sparkContext

    def block(part: DataFrame) -> DataFrame:
        rows = part.orderBy("query_id").collect()  # a block of queries
        shared = context.broadcast((np.array([r["query_id"] for r in rows], np.int64), np.array([r["unit_q"] for r in rows], float)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            query_ids, asked = shared.value
            for batch in (b.slice(first, ROWS) for b in batches for first in range(0, b.num_rows, ROWS)):
                ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
                units = batch.column("unit").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
                for first in range(0, len(query_ids), COLUMNS):
                    own = query_ids[first : first + COLUMNS]
                    scores = np.round(units @ asked[first : first + COLUMNS].T, 6)
                    keep = _best(scores, ids, ids[:, None] != own[None, :], k, floor, None)
                    if keep.any():
                        yield _rows(scores, keep, ids, own)

        return vectors.select("doc_id", F.col("unit").cast("array<double>").alias("unit")).mapInArrow(run, "query_id long, doc_id long, score double")

    return reduce(DataFrame.unionByName, [block(x) for x in _blocks(queries, "query_id", VECTOR_BLOCK)])


def relative_floor(scored: DataFrame, share: float, by: str = "query_id") -> DataFrame:
    """Rows that reach a share of their query's best score; the best is aggregated, so that no group is sorted."""
    best = scored.groupBy(by).agg(F.max("score").alias("best"))
    return scored.join(best, by).where(F.col("score") >= share * F.col("best")).drop("best")


def fuse(channels: dict[str, DataFrame], weights: dict[str, float] | None = None) -> DataFrame:
    """(query_id, doc_id, fused, channels): weighted reciprocal ranks over all channels' (query_id, doc_id, rank)."""
    weights = weights or WEIGHTS
    parts = None
    for name, rows in channels.items():
        part = rows.select("query_id", "doc_id", F.lit(name).alias("channel"), (F.lit(weights.get(name, 1.0)) / (RRF + F.col("rank"))).alias("part"))
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 8).alias("fused"), F.array_join(F.sort_array(F.collect_set("channel")), ",").alias("channels"))


def cascade(ranked: DataFrame, candidates: int, reranked: int, final: int) -> DataFrame:
    """Adds the reason why each candidate of (query_id, rank, rerank_score) stays or drops out along the cascade."""
    first = ranked.where(F.col("rank") <= candidates)
    again = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "doc_id")
    kept = first.where(F.col("rank") <= reranked).withColumn("final_rank", F.row_number().over(again))
    dropped = first.where(F.col("rank") > reranked).withColumn("final_rank", F.lit(None).cast("int"))
    reason = F.when(F.col("final_rank").isNull(), "FILTERED_BY_RERANK_CANDIDATE_TOP_K").when(F.col("final_rank") <= final, "SELECTED_BY_RANK").otherwise("FILTERED_BY_FINAL_TOP_K")
    return kept.unionByName(dropped).withColumn("reason", reason)


def rerank(scored: DataFrame, k: int) -> DataFrame:
    """Normalises raw scores, ranks by them (ties by position) and keeps the best k; rounding comes after ranking."""
    ready = scored.withColumn("normal", normalize_score(F.col("score")))
    order = Window.partitionBy("query_id").orderBy(F.desc("normal"), "position")
    return ready.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(0, k)).withColumn("normal", F.round("normal", 6))


def elevate(ranked: DataFrame, parent: Column) -> DataFrame:
    """Candidates lifted to their parents: the best-ranked child stands for its parent."""
    lifted = ranked.withColumn("parent_id", parent)
    return lifted.groupBy("query_id", "parent_id").agg(
        F.min("rank").alias("best_rank"), F.min_by("doc_id", F.struct("rank", "doc_id")).alias("doc_id"), F.count("*").alias("n_children")
    )


def recall_at_k(results: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """(query_id, n_relevant, n_found, recall) of results (query_id, doc_id, rank) against gold (query_id, doc_id)."""
    gold = gold.distinct()
    hits = gold.join(results.where(F.col("rank") <= k), ["query_id", "doc_id"], "left_semi").groupBy("query_id").agg(F.count("*").alias("n_found"))
    wanted = gold.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    out = wanted.join(hits, "query_id", "left").withColumn("n_found", F.coalesce("n_found", F.lit(0)))
    return out.withColumn("recall", F.round(F.col("n_found") / F.col("n_relevant"), 6))
