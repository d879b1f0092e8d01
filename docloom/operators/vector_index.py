"""Approximate vector search: an inverted file of quantised residuals with exact re-ranking.

Coarse centroids are trained on a bounded sample. Every vector is stored in the list of its nearest
centroid as the difference to it, one byte a component. A query scores the vectors of its nearest lists block by block, keeps the
best few, and these are ranked by their exact cosine. Lists are tables of blocks; a list of any size is as many blocks as it needs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.graph import written

#: Bound of the training sample, and rounds of its clustering.
SAMPLE, TRAIN_ROUNDS = 20_000, 12
#: Vectors in a block, candidates that a query keeps for exact ranking.
BLOCK, KEPT = 1024, 100


class Coarse:
    """Centroids of the lists, and for each component the step of its quantised residuals."""

    def __init__(self, sample: np.ndarray, lists: int):
        rng = np.random.default_rng(0)
        self.centroids = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)].copy()
        for _ in range(TRAIN_ROUNDS):
            near = self.nearest(sample, 1)[:, 0]
            sums, n = np.zeros_like(self.centroids), np.bincount(near, minlength=len(self.centroids))
            np.add.at(sums, near, sample)
            self.centroids[n > 0] = sums[n > 0] / n[n > 0, None]
        rest = np.abs(sample - self.centroids[self.nearest(sample, 1)[:, 0]])
        self.step = np.maximum(rest.max(0), 1e-12) / 127

    def nearest(self, vectors: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` nearest lists of each vector, the nearest first."""
        far = (self.centroids**2).sum(1) - 2 * vectors @ self.centroids.T
        return np.argsort(far, axis=1, kind="stable")[:, :n]

    def codes(self, vectors: np.ndarray, lists: np.ndarray) -> np.ndarray:
        return np.clip(np.round((vectors - self.centroids[lists]) / self.step), -127, 127).astype(np.int8)


def train(vectors: DataFrame, lists: int | None = None, sample: int = SAMPLE) -> Coarse:
    """Learns from at most ``sample`` vectors (doc_id, unit), spread by a hash of their id; all of them are indexed, whatever the sample.

    Without a number of lists there are about as many as the square root of the vectors, 8 to 4096.
    """
    n = vectors.count()
    if lists is None:
        lists = max(8, min(4096, int(n**0.5)))
    spread = max(1, -(-n // sample))
    rows = vectors.where(F.pmod(F.xxhash64("doc_id"), F.lit(spread)) == 0).select("unit").limit(sample).collect()
    return Coarse(np.array(sorted(r["unit"] for r in rows), float), lists)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(float)


def build(vectors: DataFrame, coarse: Coarse) -> DataFrame:
    """(list, ids, codes): blocks of the lists over vectors (doc_id, unit), written sorted by list, so that a scan skips other lists."""
    shared = vectors.sparkSession.sparkContext.broadcast(coarse)  # bounded by the number of lists

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = _matrix(batch.column("unit"))
            lists = shared.value.nearest(unit, 1)[:, 0]
            codes = [c.tobytes() for c in shared.value.codes(unit, lists)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lists, pa.int32()), pa.array(codes, pa.binary())], names=["doc_id", "list", "code"])

    rows = written(vectors.select("doc_id", "unit").mapInArrow(coded, "doc_id long, list int, code binary"), "codes")
    sizes = rows.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    dealt = rows.join(sizes, "list").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    packed = dealt.groupBy("list", "block").agg(F.collect_list(F.struct("doc_id", "code")).alias("rows"))
    packed = packed.select("list", F.col("rows.doc_id").alias("ids"), F.col("rows.code").alias("codes"))
    return written(packed.repartition("list").sortWithinPartitions("list"), "index")


def search(queries: DataFrame, index: DataFrame, coarse: Coarse, vectors: DataFrame, k: int, probes: int, kept: int = KEPT) -> DataFrame:
    """(query_id, doc_id, score, rank) of the ``k`` best vectors of each query's ``probes`` nearest lists; a vector is no hit of its own id.

    Queries are (query_id, unit_q). Scores are exact cosines, rounded to six places; ties go to the lower id.
    """
    shared = index.sparkSession.sparkContext.broadcast(coarse)

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = shared.value.nearest(_matrix(batch.column("unit_q")), probes)
                at = np.repeat(np.arange(batch.num_rows), near.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column("query_id").take(pa.array(at)), pa.array(near.ravel(), pa.int32()), batch.column("unit_q").take(pa.array(at))], names=["query_id", "list", "unit_q"])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for no, ids, codes, asked in zip(*(batch.column(c) for c in ("list", "ids", "codes", "asked")), strict=True):
                ids, asked = ids.values.to_numpy(), asked.values
                code = np.frombuffer(b"".join(codes.values.to_pylist()), np.int8).reshape(len(ids), -1)
                q_ids, q = asked.field("query_id").to_numpy(), _matrix(asked.field("unit_q"))
                score = q @ (shared.value.centroids[no.as_py()] + code * shared.value.step).T
                score[q_ids[:, None] == ids[None]] = -np.inf
                best = np.argsort(-score, axis=1, kind="stable")[:, :kept]
                at = np.repeat(np.arange(len(q_ids)), best.shape[1])
                found = score[at, best.ravel()]
                keep = np.isfinite(found)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[at[keep]]), pa.array(ids[best.ravel()[keep]]), pa.array(found[keep])], names=["query_id", "doc_id", "near"])

    asked = queries.select("query_id", "unit_q").mapInArrow(probed, "query_id long, list int, unit_q array<double>")
    asked = written(asked, "asked")
    parts = asked.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    grouped = asked.join(parts, "list").withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("parts"))).groupBy("list", "part").agg(F.collect_list(F.struct("query_id", "unit_q")).alias("asked"))
    pairs = index.join(grouped.drop("part"), "list")
    close = pairs.mapInArrow(scored, "query_id long, doc_id long, near double")
    near = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("near"), "doc_id"))
    close = close.withColumn("place", near).where(F.col("place") <= kept).select("query_id", "doc_id")
    dot = F.aggregate(F.zip_with("unit", "unit_q", lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    exact = close.join(vectors.select("doc_id", "unit"), "doc_id").join(queries.select("query_id", "unit_q"), "query_id").select("query_id", "doc_id", F.round(dot, 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return exact.withColumn("rank", rank).where(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, wanted, hit): of each query's exact hits, those that were found."""
    hits = found.select("query_id", "doc_id", F.lit(1).alias("hit"))
    return exact.join(hits, ["query_id", "doc_id"], "left").groupBy("query_id").agg(F.count("*").alias("wanted"), F.sum(F.coalesce("hit", F.lit(0))).alias("hit"))
