"""The inverted file against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import vector_index as V
from docloom.plans import retrieval_queries as Q


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_recall_of_the_registered_query(spark, folder):
    rows = Q.vector_index_recall(spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/embeddings.parquet").where("vec_id % 50 = 0").count()
    assert sum(r.hit for r in rows) >= 0.9 * sum(r.wanted for r in rows)


def frames(spark, n=400, d=12):
    r = np.random.default_rng(4)
    v = r.normal(size=(n, d))
    v[n // 2 :] = v[0] + r.normal(scale=1e-3, size=(n - n // 2, d))  # half of all vectors in one list
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return v, spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "doc_id long, unit array<double>")


def test_all_lists_and_candidates_give_the_exact_result(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 64)
    v, vectors = frames(spark)
    coarse = V.train(vectors, 9)
    index = V.build(vectors, coarse)
    assert sorted(x for r in index.collect() for x in r.ids) == list(range(len(v))) and max(len(r.ids) for r in index.collect()) < 200
    asked = vectors.where("doc_id % 40 = 3").select(F.col("doc_id").alias("query_id"), F.col("unit").alias("unit_q"))
    got = {}
    for r in V.search(asked, index, coarse, vectors, 5, probes=9, kept=400).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.doc_id, r.score)
    for q, hits in got.items():
        score = np.round(v @ v[q], 6)
        score[q] = -2
        want = sorted(range(len(v)), key=lambda k: (-score[k], k))[:5]
        assert [hits[k + 1][0] for k in range(5)] == want
        assert [hits[k + 1][1] for k in range(5)] == pytest.approx([score[k] for k in want], abs=2e-6)
    assert len(got) == 10


def test_training_sample_is_bounded_and_every_vector_indexed(spark):
    v, vectors = frames(spark)
    coarse = V.train(vectors, 5, sample=50)
    assert len(coarse.centroids) == 5
    assert V.build(vectors, coarse).select(F.sum(F.size("ids"))).first()[0] == len(v)
