"""Clusters of whole documents by rounds against the plain clusterer."""

import numpy as np
import pytest

from docloom.operators import tree


def vectors(seed, n, groups=40, d=16):
    r = np.random.default_rng(seed)
    middles = r.normal(size=(groups, d))
    return middles[r.integers(groups, size=n)] + r.normal(scale=0.5, size=(n, d))


def plain(ids, v, most):
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    return sorted(sorted(int(ids[k]) for k in c) for c in tree.bounded_clusters(unit, most))


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault((r.doc, r.cluster), []).append(r.item)
    assert all(c == min(v) for (_, c), v in out.items())
    by = {}
    for (doc, _), v in out.items():
        by.setdefault(doc, []).append(sorted(v))
    return {doc: sorted(v) for doc, v in by.items()}


@pytest.mark.parametrize(("n", "most"), [(90, 4), (300, 6)])
def test_rounds_give_the_clusters_of_the_plain_clusterer(spark, n, most):
    v = vectors(n, n)
    ids = np.random.default_rng(1).permutation(5 * n)[:n]
    order = np.argsort(ids)
    ids, v = ids[order], v[order]
    items = spark.createDataFrame([(3, int(i), x.tolist()) for i, x in zip(ids, v)] + [(4, 1, [1.0] * 16), (4, 9, [1.0] * 15 + [0.5])], "doc long, item long, vector array<double>")
    got = found(tree.cluster_level(items.repartition(3), most, in_task=20))
    assert got[3] == plain(ids, v, most)
    assert got[4] == [[1, 9]] and max(map(len, got[3])) <= most


def quick_linkage(unit, target):
    """Average linkage by sums of similarities that are added as clusters merge."""
    sums, size, members = unit @ unit.T, np.ones(len(unit)), [[k] for k in range(len(unit))]
    alive = np.ones(len(unit), bool)
    np.fill_diagonal(sums, -np.inf)
    for _ in range(len(unit) - target):
        mean = sums / size[:, None] / size[None]
        a, b = sorted(np.unravel_index(int(mean.argmax()), mean.shape))
        sums[a] += sums[b]
        sums[:, a] += sums[:, b]
        sums[b] = sums[:, b] = sums[a, a] = -np.inf
        size[a] += size[b]
        members[a] += members[b]
        alive[b] = False
    return [sorted(members[k]) for k in np.flatnonzero(alive)]


def test_a_large_document_is_clustered_as_a_whole(spark, monkeypatch):
    v = vectors(5, 1200, groups=150)
    items = spark.createDataFrame([(1, k, x.tolist()) for k, x in enumerate(v)], "doc long, item long, vector array<double>")
    got = found(tree.cluster_level(items, 6))[1]
    monkeypatch.setattr(tree, "average_linkage", quick_linkage)
    assert got == plain(np.arange(1200), v, 6)


def test_single_clusters_join_in_order(spark):
    r = np.random.default_rng(8)
    totals = r.normal(size=(24, 8))
    sizes = [1 if k % 2 else 2 + k % 3 for k in range(24)]
    rows = [("1", 10 * k, n, (n * t / np.linalg.norm(t)).tolist()) for k, (n, t) in enumerate(zip(sizes, totals))]
    frame = spark.createDataFrame(rows, "group string, cluster long, n long, total array<double>")
    joins = tree._single_joined(frame, 4).collect()
    now = {c: [n, np.array(t)] for _, c, n, t in rows}
    want = []
    while True:
        for s in sorted(c for c in now if now[c][0] == 1):
            room = [c for c in sorted(now) if c != s and now[c][0] < 4]
            if room:
                break
        else:
            break
        best = max(room, key=lambda c: (round(float(now[c][1] @ now[s][1]) / now[c][0], 12), -c))
        a, b = min(s, best), max(s, best)
        want.append((a, b))
        now[a] = [now[a][0] + now[b][0], now[a][1] + now[b][1]]
        del now[b]
    assert sorted((j.cluster, j.other) for j in joins) == sorted(want)
    assert sorted((j.cluster, j.other) for j in tree._joined_in_task(frame, 4).collect()) == sorted(want)


def test_zero_vectors_and_few_items(spark):
    items = spark.createDataFrame([(1, 5, [0.0, 0.0]), (1, 7, [0.0, 0.0]), (2, 3, [1.0, 0.0])], "doc long, item long, vector array<double>")
    assert found(tree.cluster_level(items)) == {1: [[5, 7]], 2: [[3]]}
    assert found(tree.cluster_level(items, 2, in_task=1)) == {1: [[5, 7]], 2: [[3]]}
    five = spark.createDataFrame([(1, k, [0.0, 0.0]) for k in range(5)], "doc long, item long, vector array<double>")
    assert sorted(map(len, found(tree.cluster_level(five, 2, in_task=1))[1])) == sorted(map(len, found(tree.cluster_level(five, 2))[1]))
    assert tree.cluster_level(items.limit(0)).count() == 0


def best_pair_first(unit, target):
    """Average linkage as it reads: the best pair merges, then all means are taken anew; of equal ones the lowest pair."""
    members, sums, alive = [[k] for k in range(len(unit))], unit.astype(float).copy(), list(range(len(unit)))
    while len(alive) > max(1, target):
        sizes = np.array([len(members[k]) for k in alive], float)
        mean = (sums[alive] @ sums[alive].T) / np.outer(sizes, sizes)
        mean[np.tril_indices(len(alive))] = -np.inf
        a, b = np.unravel_index(int(np.round(mean, 12).argmax()), mean.shape)
        a, b = alive[a], alive[b]
        members[a] += members[b]
        sums[a] += sums[b]
        alive.remove(b)
    return [sorted(members[k]) for k in alive]


@pytest.mark.parametrize("kind", ["spread", "copies", "ties", "zeros"])
def test_rounds_in_a_task_merge_the_best_pair_first(kind):
    r = np.random.default_rng(2)
    v = {"spread": vectors(3, 120), "copies": vectors(4, 7)[r.integers(7, size=120)], "ties": r.integers(-1, 2, size=(90, 3)).astype(float), "zeros": np.zeros((9, 4))}[kind]
    length = np.linalg.norm(v, axis=1, keepdims=True)
    unit = v / np.where(length > 0, length, 1)
    for target in (1, 5, 20):
        assert tree.average_linkage(unit, target) == best_pair_first(unit, target)


def rounds_by_joins(monkeypatch):
    calls, nearest = [], tree.nearest_clusters
    monkeypatch.setattr(tree, "nearest_clusters", lambda *x: (calls.append(1), nearest(*x))[1])
    return calls


def test_a_document_that_fits_a_task_needs_no_joins(spark, monkeypatch):
    v = vectors(6, 900, groups=200)
    items = spark.createDataFrame([(1, k, x.tolist()) for k, x in enumerate(v)], "doc long, item long, vector array<double>")
    calls = rounds_by_joins(monkeypatch)
    assert found(tree.cluster_level(items, 6))[1] == plain(np.arange(900), v, 6) and not calls


def test_copies_take_no_rounds_of_their_own(spark, monkeypatch):
    v = vectors(7, 6)[np.arange(180) % 6]
    items = spark.createDataFrame([(1, k, x.tolist()) for k, x in enumerate(v)], "doc long, item long, vector array<double>")
    calls = rounds_by_joins(monkeypatch)
    assert found(tree.cluster_level(items, 30, in_task=40))[1] == plain(np.arange(180), v, 30)
    assert len(calls) == 1  # for single clusters, not for a round


def test_pairs_of_blocks_are_dealt_to_parts_of_a_group(spark, monkeypatch):
    monkeypatch.setattr(tree, "BLOCK", 4)
    clusters = spark.createDataFrame([("1", k, 1, x.tolist()) for k, x in enumerate(vectors(9, 90))], "group string, cluster long, n long, total array<double>")
    best = tree.nearest_clusters(clusters, clusters)
    assert best._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") == 2
    v = np.array([r.total for r in clusters.orderBy("cluster").collect()])
    grid = np.round(v @ v.T, 12)
    np.fill_diagonal(grid, -np.inf)
    assert {r.cluster: r.other for r in best.collect()} == dict(enumerate(grid.argmax(1).tolist()))
