"""Communities by modularity against a plain sequential version."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import communities as C
from docloom.plans import graph_queries as G


def plain_modularity(edges, labels):
    m2 = 2 * len(edges)
    inside, size = 0, {}
    for a, b in edges:
        inside += 2 * (labels[a] == labels[b])
        for x in (a, b):
            size[labels[x]] = size.get(labels[x], 0) + 1
    return inside / m2 - sum(s * s for s in size.values()) / m2**2


def plain_louvain(edges):
    """Nodes move one after another while any gains, then communities become nodes."""
    weight, names = {}, {}
    for a, b in edges:
        for x, y in ((a, b), (b, a)):
            weight.setdefault(x, {})[y] = weight.get(x, {}).get(y, 0) + 1
            names[x] = x
    m2 = sum(sum(n.values()) for n in weight.values())
    while True:
        k = {x: sum(n.values()) for x, n in weight.items()}
        own, size, any_moved = {x: x for x in weight}, dict(k), False
        going = True
        while going:
            going = False
            for x in sorted(weight):
                size[own[x]] -= k[x]
                near = {own[x]: 0}
                for y, w in weight[x].items():
                    if y != x:
                        near[own[y]] = near.get(own[y], 0) + w
                best = min(near, key=lambda c: (-(near[c] - k[x] * size[c] / m2), c != own[x], c))
                if near[best] - k[x] * size[best] / m2 > near[own[x]] - k[x] * size[own[x]] / m2 + 1e-9:
                    own[x], going, any_moved = best, True, True
                size[own[x]] += k[x]
        names = {x: own[c] for x, c in names.items()}
        if not any_moved:
            return names
        upper = {}
        for x, n in weight.items():
            for y, w in n.items():
                upper.setdefault(own[x], {})[own[y]] = upper.get(own[x], {}).get(own[y], 0) + w
        weight = upper


def frames(spark, nodes, edges):
    return spark.createDataFrame([(n,) for n in nodes], "node long"), spark.createDataFrame(edges, "source long, target long")


def groups_graph(seed, groups=6, size=12, inner=0.5, outer=0.02):
    r = random.Random(seed)
    n = groups * size
    return list(range(n)), [(a, b) for a in range(n) for b in range(a) if r.random() < (inner if a // size == b // size else outer)]


def connected(edges, members):
    left, todo = set(members), [min(members)]
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    left.discard(todo[0])
    while todo:
        for y in near.get(todo.pop(), ()):
            if y in left:
                left.discard(y)
                todo.append(y)
    return not left


def test_planted_groups_are_found_whatever_the_partitions(spark):
    nodes, edges = groups_graph(1)
    n, e = frames(spark, nodes, edges)
    got = {r.node: r.community for r in C.communities(n, e).collect()}
    assert {frozenset(x for x in got if got[x] == c) for c in got.values()} == {frozenset(range(12 * k, 12 * k + 12)) for k in range(6)}
    assert all(got[x] == min(y for y in got if got[y] == got[x]) for x in got)
    again = {r.node: r.community for r in C.communities(n.repartition(7), e.selectExpr("target as source", "source as target").repartition(5), passes=1, rounds=20).collect()}
    assert again == got


def test_modularity_is_that_of_the_formula_and_not_under_plain_louvain(spark):
    nodes, edges = groups_graph(2, groups=8, size=8, inner=0.45, outer=0.08)
    n, e = frames(spark, nodes, edges)
    found = C.communities(n, e)
    labels = {r.node: r.community for r in found.collect()}
    q = C.modularity(C.links_of(e), found)
    assert q == pytest.approx(plain_modularity(edges, labels))
    assert q >= plain_modularity(edges, plain_louvain(edges)) - 1e-9
    assert all(connected(edges, [x for x in labels if labels[x] == c]) for c in set(labels.values()))


def test_order_graph_is_not_under_plain_louvain(spark, sf_dir):
    e, n = G.edges(spark, sf_dir), G.nodes(spark, sf_dir)
    edges = [tuple(r) for r in e.collect()]
    found = C.communities(n, e)
    assert found.count() == n.count() == found.select("node").distinct().count()
    assert C.modularity(C.links_of(e), found) >= plain_modularity(edges, plain_louvain(edges)) - 1e-9


def test_two_components_and_odd_edges(spark):
    n = spark.createDataFrame([(1,), (2,), (3,), (4,), (5,), (5,), (None,)], "node long")
    e = spark.createDataFrame([(1, 2), (2, 1), (1, 2), (3, 4), (5, 5), (5, 99), (None, 1)], "source long, target long")
    assert {r.node: r.community for r in C.communities(n, e).collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}


def test_no_edges_leave_each_node_alone(spark):
    n, e = frames(spark, [7, 8], [])
    assert {r.node: r.community for r in C.communities(n, e).collect()} == {7: 7, 8: 8}
    assert C.communities(n.limit(0), e).count() == 0 and C.modularity(C.links_of(e), n.withColumn("community", F.col("node"))) == 0.0


def test_blocks_and_one_task_find_the_same(spark, monkeypatch):
    nodes, edges = groups_graph(3, groups=5, size=10, inner=0.5, outer=0.06)
    # repeated, turned, loops, null ends, ends that are no node, and a node of which only such links are left
    odd = edges[:9] + [(b, a) for a, b in edges[3:12]] + [(4, 4), (None, 1), (2, None), (7, 990), (991, 992), (60, 993)]
    n, e = frames(spark, [*nodes, 60, 61, 61, None], edges + odd)
    alone = sorted(C.communities(n, e, rounds=2, levels=2).collect())
    monkeypatch.setattr(C, "HELD", 60)
    blocks = sorted(C.communities(n.repartition(5), e.repartition(3), rounds=2, levels=2).collect())
    assert alone == blocks and len(alone) == 52 and {r.community for r in alone if r.node >= 60} == {60, 61}


def test_a_graph_that_a_task_can_hold_takes_few_jobs(spark):
    tracker, nodes_edges = spark.sparkContext.statusTracker(), groups_graph(1)
    spark.sparkContext.setJobGroup("few", "communities")
    C.communities(*frames(spark, *nodes_edges)).collect()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < len(tracker.getJobIdsForGroup("few")) < 60


def test_hashes_are_those_of_spark(spark):
    x = np.array([0, 1, -1, 5, 2**62, -(2**63)])
    rows = spark.createDataFrame([(int(v),) for v in x], "x long").selectExpr("x", "xxhash64(x) as a", "xxhash64(x, 7) as b", "xxhash64(7, x) as c").collect()
    assert [r.x for r in rows] == list(x)
    for got, want in ((C._hashed(x), "a"), (C._hashed(7, C._hashed(x)), "b"), (C._hashed(x, C._hashed(7)), "c")):
        assert list(got.view(np.int64)) == [r[want] for r in rows]


def test_nodes_may_have_any_type(spark):
    nodes, edges = groups_graph(4, groups=3, size=8)
    named = lambda x: f"n{x:03d}"
    n, e = spark.createDataFrame([(named(x),) for x in nodes], "node string"), spark.createDataFrame([(named(a), named(b)) for a, b in edges], "source string, target string")
    want = {named(r.node): named(r.community) for r in C.communities(*frames(spark, nodes, edges)).collect()}
    assert {r.node: r.community for r in C.communities(n, e).collect()} == want
    small = [f.selectExpr(*[f"cast({c} as int) as {c}" for c in f.columns]) for f in frames(spark, nodes, edges)]
    assert {named(r.node): named(r.community) for r in C.communities(*small).collect()} == want
