import random

import numpy as np
import pytest

from docloom.llm import near_dup
from docloom.llm.shared import components as graph_components

from .helpers import components, frame, odd_texts, prose, shingles


def check(spark, texts):
    out = near_dup.near_duplicates(frame(spark, texts)).orderBy("doc_id").collect()
    sets = [shingles(t) for t in texts]
    assert [r.n_shingles for r in out] == [len(s) for s in sets]
    assert [r.component_id for r in out] == components(sets)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def edited(text, places, seed):
    words, r = text.split(), random.Random(seed)
    for _ in range(places):
        words[r.randrange(len(words))] = f"edit{r.randrange(10**6)}"
    return " ".join(words)


def test_families_of_copies_match_brute_force(spark):
    base = [prose(k, 160) for k in range(4)]
    texts = [t for k, b in enumerate(base) for t in [b, b, b.upper(), *[edited(b, e, 10 * k + e) for e in range(1, 7)]]]
    texts += [" ".join(base[0].split()[:-20]), " ".join(base[1].split()[15:]), "two words", "Two  Words", prose(99, 80)]
    check(spark, texts)


def test_chains_join_documents_that_are_not_alike(spark):
    words = prose(5, 200).split()
    check(spark, [" ".join(words[k : k + 120]) for k in range(0, 60, 4)])


def test_family_with_edits_shared_by_few(spark):
    base = prose(7, 150)
    far = [edited(base, 4, k) for k in range(12)]
    check(spark, [base, *far, *[edited(t, 1, 100 + k) for k, t in enumerate(far)]])


def test_odd_rows(spark):
    texts = odd_texts()
    out = near_dup.near_duplicates(frame(spark, texts)).collect()
    assert len(out) == len(texts)
    empty = [r for r in out if r.doc_id in (0, 1, 2)]
    assert all(r.n_shingles == 0 and r.kept and r.component_id == r.doc_id for r in empty)
    assert {r.component_id for r in out if r.doc_id in (8, 9)} == {8}
    assert [r.kept for r in out if r.doc_id is None] == [True]
    assert near_dup.near_duplicates(frame(spark, [])).count() == 0


def test_keep_one_keeps_columns(spark):
    docs = frame(spark, [prose(1, 50), prose(1, 50), None])
    kept = near_dup.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 2]


def test_sketches_merge_and_estimate():
    r = np.random.default_rng(3)
    both, left, right = (r.integers(0, 2**63, n).astype(np.uint64) for n in (800, 100, 100))
    a, b = np.concatenate([both, left]), np.concatenate([both, right])
    merged = np.maximum(near_dup.registers(a), near_dup.registers(b))
    assert (merged == near_dup.registers(np.unique(np.concatenate([a, b])))).all()
    x, y = near_dup.registers(a), near_dup.registers(b)
    more, less = np.array([(x > y).sum()]), np.array([(x < y).sum()])
    fit = near_dup.log_likelihoods(more, less, len(x) - more - less, np.array([900.0]), np.array([900.0]), np.linspace(0, 1, 101))
    assert abs(fit.argmax() / 100 - 0.8) < 0.12


@pytest.mark.parametrize("edges", [[], [(1, 2), (2, 3), (5, 4), (9, 8), (8, 7), (7, 6)], [(k, 0) for k in range(1, 50)], [(k, k + 1) for k in range(40)]])
def test_components(spark, edges):
    out = {r.node: r.component for r in graph_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}
    for _ in parent:
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert out == parent


def test_keep_one_goes_by_id_and_text(spark):
    copied, clean, again = prose(1, 50), prose(2, 50), prose(3, 50)
    rows = [(0, copied), (5, copied), (5, clean), (6, again), (6, again), (7, again), (None, copied), (None, prose(4, 50)), (None, prose(4, 50)), (8, prose(5, 50)), (8, prose(5, 50).replace(" ", "  ")), (9, None), (9, None)]
    kept = near_dup.keep_one(frame(spark, rows)).collect()
    plain = lambda pairs: sorted(((k, (t or "").split()) for k, t in pairs), key=str)
    want = [(0, copied), (5, clean), (6, again), (None, prose(4, 50)), (8, prose(5, 50)), (9, ""), (9, "")]
    assert plain((r.doc_id, r.text) for r in kept) == plain(want)


def test_keep_one_links_from_eighty_percent_on(spark):
    words = prose(60, 400).split()
    # 396 shingles each, five of them lost to every edit: 356 of 436 are shared
    edited_words = [f"edit{k}" if k % 50 == 20 else w for k, w in enumerate(words)]
    a, b = shingles(" ".join(words)), shingles(" ".join(edited_words))
    assert 0.80 < len(a & b) / len(a | b) < 0.83
    kept = near_dup.keep_one(frame(spark, [" ".join(words), " ".join(edited_words), prose(61, 90)]))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2]


def test_clashing_names_and_empty_table(spark):
    docs = frame(spark, [prose(1, 50), prose(1, 50), prose(2, 50)])
    for a, b in (("node", "key_0"), ("key", "__id"), ("spans", "gone_id")):
        docs = docs.withColumnRenamed(a, b)
    kept = near_dup.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 2]
    assert near_dup.keep_one(docs.limit(0)).count() == 0
