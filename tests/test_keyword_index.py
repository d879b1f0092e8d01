"""The keyword index against BM25 of every unit, and the share of postings that it reads."""

import math
import random
import re
from collections import Counter

import pytest

from docloom.operators import keyword_index as K
from docloom.plans import retrieval_queries as Q

SCHEMA = "unit long, text string"


def plain(rows, asked, k):
    """{query: [(unit, score), ...]} by scoring every unit."""
    words = {}
    for unit, text in rows:
        words.setdefault(unit, []).extend(re.findall(r"\w+", (text or "").lower()))
    average = sum(map(len, words.values())) / len(words)
    df = Counter(t for w in words.values() for t in set(w))
    found = {}
    for query, text in asked:
        scores = {}
        for unit, w in words.items():
            tf = Counter(w)
            for t in set(re.findall(r"\w+", (text or "").lower())) & tf.keys():
                idf = math.log(1 + (len(words) - df[t] + 0.5) / (df[t] + 0.5))
                scores[unit] = scores.get(unit, 0) + idf * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(w) / average))
        if scores:
            found[query] = sorted(((u, round(x, 6)) for u, x in scores.items()), key=lambda h: (-h[1], h[0]))[:k]
    return found


def corpus(n=600):
    r = random.Random(5)
    vocabulary = [f"w{j}" for j in range(300)]
    weights = [1 / (j + 1) for j in range(300)]
    rows = [(u, " ".join(r.choices(vocabulary, weights, k=r.randint(1, 40)))) for u in range(n)]
    # half of a second unit's texts, repeated rows, no text, an empty one
    return rows + [(3, "w1 w2 w250"), (3, "w1 w2 w250"), (9000, None), (9001, "")]


def searched(spark, rows, asked, k):
    hits, work = K.search(spark.createDataFrame(asked, "query_id long, q string"), K.build(spark.createDataFrame(rows, SCHEMA), "unit", "text"), "query_id", "q", k)
    found = {}
    for h in sorted(hits.collect(), key=lambda h: h["rank"]):
        found.setdefault(h.query_id, []).append((h.unit, h.score))
    return found, {w.query_id: (w.n_postings, w.n_read) for w in work.collect()}


@pytest.mark.parametrize("block", [4, 64])
def test_hits_are_those_of_scoring_all(spark, monkeypatch, block):
    monkeypatch.setattr(K, "BLOCK", block)
    rows = corpus()
    r = random.Random(6)
    asked = [(q, " ".join(r.sample([f"w{j}" for j in range(300)], r.randint(1, 12)))) for q in range(12)]
    asked += [(50, "w0 w299"), (51, "w0 W0 w0 w1 w2 w3"), (52, "unknown"), (53, None), (54, "w7"), (54, "w8 w200")]
    merged = [(q, " ".join(t or "" for p, t in asked if p == q)) for q in {q for q, _ in asked}]
    found, work = searched(spark, rows, asked, 5)
    want = plain(rows, merged, 5)
    assert found.keys() == want.keys() == work.keys() and 52 not in found and 53 not in found
    for q, hits in want.items():
        assert [u for u, _ in found[q]] == [u for u, _ in hits]
        assert [x for _, x in found[q]] == pytest.approx([x for _, x in hits], abs=2e-6)
    assert all(read <= n for n, read in work.values())


def test_common_words_stay_unread_beside_rare_ones(spark, monkeypatch):
    monkeypatch.setattr(K, "BLOCK", 4)
    rows = [(u, f"the of and x{u % 97} y{u // 200} z{u % 31}") for u in range(2000)]
    asked = [(1, "the of and x5 z3"), (2, "the x90"), (3, "and of y4 x7")]
    found, work = searched(spark, rows, asked, 3)
    assert found == plain(rows, asked, 3)
    assert sum(read for _, read in work.values()) < 0.4 * sum(n for n, _ in work.values())


def test_no_units_and_ties(spark):
    assert searched(spark, [], [(1, "a")], 3) == ({}, {})
    found, _ = searched(spark, [(u, "same words") for u in range(300, 0, -1)], [(1, "words")], 4)
    assert [u for u, _ in found[1]] == [1, 2, 3, 4]


def test_the_index_reads_no_more_than_all(spark, sf_dir):
    rows = Q.keyword_index_work(spark, sf_dir).collect()
    assert rows and all(0 < r.n_read <= r.n_postings for r in rows)


def test_shards_move_only_their_best_units(spark, monkeypatch):
    shown, write = {}, K.written
    monkeypatch.setattr(K, "written", lambda df, tag: shown.setdefault(tag, write(df, tag)))
    r = random.Random(9)
    rows = [(u, " ".join(r.choices(["the", "of", "and", *[f"w{j}" for j in range(90)]], k=r.randint(0, 30)))) for u in range(900)] + [(5000 + u, "of w1 w2") for u in range(50)]
    asked = [(q, f"the of and w{q} w{q + 1}") for q in range(20)]
    index = K.build(spark.createDataFrame(rows, SCHEMA).repartition(7), "unit", "text")
    hits, work = K.search(spark.createDataFrame(asked, "query_id long, q string"), index, "query_id", "q", 4)
    found = {}
    for h in sorted(hits.collect(), key=lambda h: (h.query_id, h["rank"])):
        found.setdefault(h.query_id, []).append((h.unit, h.score))
    want = plain(rows, asked, 4)
    assert {q: [u for u, _ in x] for q, x in found.items()} == {q: [u for u, _ in x] for q, x in want.items()}
    assert all([x for _, x in found[q]] == pytest.approx([x for _, x in want[q]], abs=2e-6) for q in want)
    df = Counter(t for _, text in rows for t in set(text.split()))
    assert {w.query_id: w.n_postings for w in work.collect()} == {q: sum(df[t] for t in set(text.split())) for q, text in asked}
    # of 20 queries with about 1500 postings each, seven shards give four units and a count; texts with a unit of their own are read once
    assert shown["scored"].count() <= 7 * 20 * 5 and "gains" not in shown and index.n == 950
    assert shown["shards"].where("term is null").count() == 7


@pytest.mark.parametrize("kind", ["string", "struct<a: string, b: int>"])
def test_units_of_any_type_are_ordered_as_spark_orders_them(spark, kind):
    names = ["b", "a", "", None, "é", "Z", "aa"]
    values = [(n, "x y") for n in names] if kind == "string" else [((n, b), "x y") for n in names for b in (2, None, -1)]
    rows = spark.createDataFrame(values, f"unit {kind}, text string")
    hits, _ = K.search(spark.createDataFrame([("q", "y")], "query_id string, q string"), K.build(rows.repartition(3), "unit", "text"), "query_id", "q", 5)
    want = [r.unit for r in rows.orderBy("unit").limit(5).collect()]
    assert [h.unit for h in sorted(hits.collect(), key=lambda h: h["rank"])] == want
