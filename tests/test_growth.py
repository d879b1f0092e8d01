"""Plans whose tasks keep their size as tables grow."""

import random

from docloom.operators import communities as C
from docloom.operators import graph as G
from docloom.operators import keyword_index as K
from docloom.operators import retrieval as R
from docloom.plans import graph_queries as Q
from docloom.plans import suite_queries as S


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_markdown_blocks_parse_once_and_broadcast_nothing(spark, sf_dir):
    shown = plan(Q.markdown_part_blocks(spark, sf_dir))
    assert "Broadcast" not in shown and shown.count("MapInArrow") == 1


def test_parts_are_dealt_before_they_are_parsed(spark, sf_dir):
    assert "REPARTITION_BY_NUM" in plan(Q._part_texts(spark, sf_dir)) and G.parts_for(spark.range(41), 10) == 5


def test_links_take_as_many_partitions_as_are_asked(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(Q, "edge_parts", lambda *_: 9)
    assert plan(Q.edges(spark, sf_dir)).count("9), REPARTITION_BY_NUM") == 3
    assert plan(Q.graph_degree(spark, sf_dir)).count("9), REPARTITION_BY_NUM") == 4


def test_hops_list_neighbours_only_where_they_meet(spark):
    r = random.Random(3)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(90)] + [(0, k) for k in range(0, 60, 3)]
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = set()
    for seed in (0, 7, 99):
        seen, front = {seed: 0}, [seed]
        for k in (1, 2, 3):
            front = [y for y in {y for x in front for y in near.get(x, ())} if y not in seen]
            seen |= dict.fromkeys(front, k)
        want |= {(seed, n, d) for n, d in seen.items()}
    found = G.within_hops(spark.createDataFrame([(0,), (7,), (99,)], "node long"), spark.createDataFrame(edges, "source long, target long"), 3, 5)
    assert sorted(tuple(x) for x in found.collect()) == sorted(want)
    shown = plan(found).splitlines()
    listed, dealt = (next(k for k, line in enumerate(shown) if word in line) for word in ("Generate explode(nodes", "REPARTITION_BY_NUM"))
    assert listed < dealt


def test_links_of_communities_move_packed(spark):
    links = C.links_of(spark.createDataFrame([(0, k) for k in range(1, 3001)], "source long, target long"))
    near = [(r.target, [x.source for x in r.near]) for r in C.packed(links).collect()]
    assert len(near) == 3003 and max(len(x) for _, x in near) < 2 * C.BLOCK
    assert sorted((s, t) for t, x in near for s in x) == sorted((r.source, r.target) for r in links.collect())


def test_cases_deal_their_events_out(spark, sf_dir):
    assert all("REPARTITION_BY_NUM" in plan(q(spark, sf_dir)) for q in (S.text_cases, S.value_cases))


def test_keyword_scores_bound_their_batches(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(name)
    rows = spark.createDataFrame([(1, "a b"), (2, "b")], "id long, text string")
    assert R.bm25(rows, rows, "id", "text", "id", "text").count() == 4
    assert spark.conf.get(name, None) == "6m"


def test_lengths_join_texts_before_words_are_listed(spark, monkeypatch):
    shown, write = {}, K.written
    monkeypatch.setattr(K, "written", lambda df, tag: (shown.setdefault(tag, plan(df)), write(df, tag))[1])
    K.build(spark.createDataFrame([(1, "a b"), (1, "b"), (2, None)], "unit long, text string"), "unit", "text")
    assert shown["gains"].index("Generate") < shown["gains"].index("Join")
