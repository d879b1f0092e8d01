import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import graph, tree
from docloom.operators import retrieval as R
from docloom.operators.metadata_filter import FilterError, compile_filter
from docloom.operators.table_query import PlanError, TablePlan, run, validate
from docloom.streaming import events as E


def test_filter_errors(spark):
    fields, c = {"a": F.lit("x"), "d": F.lit(None)}, lambda **t: {"version": 1, "and": [t]}
    for bad in (c(field="z", op="=", value=1), c(field="a", op="~", value=1), c(field="a", op="in", value=["x", None]), c(field="a", op="=", value=None), c(field="d", op="=", value=1), {"version": 2, "and": []}, {"version": 1}):
        with pytest.raises(FilterError):
            compile_filter(bad, fields, only_empty={"d"})


def test_filter_with_nulls(spark):
    df = spark.createDataFrame([("x", ["p"]), (None, []), ("", None)], "a string, l array<string>")
    n = lambda op, value=None, name="a": df.where(compile_filter({"version": 1, "and": [{"field": name, "op": op, "value": value}]}, {"a": F.col("a"), "l": F.col("l")}, {"l"})).count()
    assert (n("empty"), n("not empty"), n("!=", "x"), n("not in", ["x"]), n("contains", "p", "l"), n("empty", None, "l")) == (2, 1, 2, 2, 1, 2)


def test_table_plans(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 5.0)], "g string, v double")
    assert run(TablePlan("GROUP_SUM", metric="v", group_by="g"), df).orderBy("g").collect()[0]["result"] == 3.0
    for bad in (TablePlan("AVG"), TablePlan("SUM", metric="g"), TablePlan("GROUP_COUNT"), TablePlan("COUNT", filters=[("v", "LIKE", 1)]), TablePlan("LOOKUP", columns=["z"])):
        with pytest.raises(PlanError):
            validate(bad, df)


def test_candidates_are_isolated_with_reasons(spark):
    sources = spark.createDataFrame([("s", "alpha uses beta")], "source_id string, text string")
    entities = spark.createDataFrame([("e1", "s", "alpha"), ("e2", "s", "beta"), ("d", "s", "x"), ("d", "s", "y"), ("u", "none", "z"), ("n", "s", "")], "id string, source_id string, name string")
    relations = spark.createDataFrame([("r1", "e1", "e2", ["v1"]), ("r2", "e1", "d", ["v1"]), ("r3", "e1", "e2", ["v9"])], "id string, source_entity string, target_entity string, evidence_ids array<string>")
    evidences = spark.createDataFrame(
        [("v1", "s", None, "r1", "alpha uses"), ("v2", "s", "e1", None, "not there"), ("v3", "s", "e1", "r1", "beta"), ("v4", "s", "e9", None, "beta"), ("v5", "none", "e1", None, "beta")],
        "id string, source_id string, entity_id string, relation_id string, quote string",
    )
    e, r, v, rejected = graph.isolate_candidates(entities, relations, evidences, sources)
    assert {x.id for x in e.collect()} == {"e1", "e2"} and [x.id for x in r.collect()] == ["r1"] and [x.id for x in v.collect()] == ["v1"]
    why = {(x.kind, x.id): x.reason for x in rejected.collect()}
    assert why == {
        ("entity", "d"): "DUPLICATE_ID", ("entity", "u"): "UNKNOWN_SOURCE", ("entity", "n"): "EMPTY_NAME", ("relation", "r2"): "UNKNOWN_ENDPOINT", ("relation", "r3"): "UNBOUND_EVIDENCE",
        ("evidence", "v2"): "QUOTE_NOT_IN_SOURCE", ("evidence", "v3"): "NOT_ONE_OWNER", ("evidence", "v4"): "UNKNOWN_OWNER", ("evidence", "v5"): "UNKNOWN_SOURCE",
    }


def test_components_and_communities(spark):
    nodes = spark.createDataFrame([(k,) for k in range(12)], "node long")
    edges = spark.createDataFrame([(k, k + 1) for k in range(5)] + [(7, 9), (9, 8), (8, 7)], "source long, target long")
    found = {r.node: r.component for r in graph.components(nodes, edges).collect()}
    assert found == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 6: 6, 7: 7, 8: 7, 9: 7, 10: 10, 11: 11}
    alone = graph.label_propagation(nodes, edges.limit(0)).collect()
    assert all(r.node == r.community for r in alone)


def test_clusters_are_bounded_and_close():
    r = np.random.default_rng(1)
    unit = np.concatenate([np.eye(4)[k] + 0.05 * r.standard_normal((5, 4)) for k in range(4)])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    clusters = tree.bounded_clusters(unit, 6)
    assert sorted(x for c in clusters for x in c) == list(range(20)) and max(map(len, clusters)) <= 6 and min(map(len, clusters)) > 1
    assert all(len({x // 5 for x in c}) == 1 for c in clusters)
    assert tree.bounded_clusters(np.array([[1.0, 0], [0.9, 0.1], [0, 1], [0.1, 0.9]]), 2) == [[0, 1], [2, 3]]


def test_tree_has_one_parent_each_and_one_root(spark):
    r = np.random.default_rng(2)
    rows = [(d, k, [float(x) for x in r.standard_normal(4)]) for d, n in ((1, 30), (2, 1), (3, 5)) for k in range(n)]
    out = tree.build_tree(spark.createDataFrame(rows, "doc long, item long, vector array<double>"), most=4, levels=8).collect()
    for doc, n in ((1, 30), (2, 1), (3, 5)):
        mine = [x for x in out if x.doc == doc]
        assert sum(x.level == 0 for x in mine) == n and sum(x.parent is None for x in mine) == 1
        for x in mine:
            if x.parent is not None:
                assert sum(y.level == x.level + 1 and y.node == x.parent for y in mine) == 1


def test_fusion_prefers_what_channels_agree_on(spark):
    ranked = lambda ids: spark.createDataFrame([(1, d, k + 1) for k, d in enumerate(ids)], "query_id long, doc_id long, rank int")
    best = R.fuse({"vector": ranked([5, 7]), "keyword": ranked([7, 9])}).orderBy(F.desc("fused")).first()
    assert best.doc_id == 7 and best.channels == "keyword,vector" and abs(best.fused - (1 / 62 + 1.1 / 61)) < 1e-8


def test_sse_and_message_folding(spark):
    text = "data: a\ndata: b\n\nevent: x\ndata:c\n\ndata: [DONE]\n\ndata: tail"
    assert spark.createDataFrame([(text,)], "t string").select(E.sse_frames(F.col("t")).alias("f")).first()["f"] == ["a\nb", "c", "tail"]
    rows = [("m", 2, "text", "lo"), ("m", 1, "text", "hel"), ("m", 3, "thinking", "t"), ("m", 4, "thinking", "t"), ("m", 5, "reference", "r1"), ("m", 6, "reference", "r2"), ("m", 7, "done", None), ("f", 1, "error", "x"), ("f", 2, "text", "late")]
    out = {r.message_id: r for r in E.fold_batch(spark.createDataFrame(rows, "message_id string, seq long, kind string, value string")).collect()}
    assert (out["m"].text, out["m"].thinking, out["m"].references, out["m"].status) == ("hello", "t", "r2", "DONE")
    assert (out["f"].text, out["f"].status) == ("", "FAILED")


def _stream(spark, tmp_path, name, parts, schema):
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))


def test_stream_folding_equals_batch(spark, tmp_path):
    schema = "message_id string, seq long, kind string, value string"
    parts = [[("a", 1, "text", "x"), ("b", 1, "text", "q")], [("a", 2, "text", "y"), ("a", 3, "done", None)]]
    stream = _stream(spark, tmp_path, "in", parts, schema)
    seen = []
    q = E.fold_stream(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).foreachBatch(lambda df, i: seen.extend(df.collect())).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = {}
    for r in seen:
        if r.n_events >= last.get(r.message_id, r).n_events:
            last[r.message_id] = r
    batch = {r.message_id: r for r in E.fold_batch(spark.createDataFrame([x for p in parts for x in p], schema)).collect()}
    assert last == batch


def test_log_stream_keeps_each_id_once(spark, tmp_path):
    schema = "log_id long, ts timestamp"
    import datetime

    at = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    stream = _stream(spark, tmp_path, "in", [[(1, at(0)), (2, at(1))], [(2, at(2)), (3, at(3))]], schema)
    out = str(tmp_path / "out")
    q = E.merge_log_stream(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.log_id for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_retries_end_in_the_dead_letter_folder(spark, tmp_path):
    rows = spark.createDataFrame([(k, k) for k in range(4)], "id long, need long")
    handle = E.with_retries(lambda df: df.withColumn("ok", F.col("need") <= F.col("attempt")), str(tmp_path / "s"), str(tmp_path / "d"))
    handle(rows.where("id < 4").withColumn("need", F.col("id") + 1), 7)
    assert [r.id for r in spark.read.parquet(str(tmp_path / "d/batch=7")).collect()] == [3]


def test_reconcile(spark):
    now = "timestamp'2024-01-01 12:00:00'"
    df = spark.sql("select 1 id, timestamp'2024-01-01 11:59:00' d, null h, 1 n union all select 2, timestamp'2024-01-01 11:50:00', null, 1 union all select 3, timestamp'2024-01-01 09:00:00', null, 1 union all select 4, timestamp'2024-01-01 11:50:00', null, 12")
    tasks = df.selectExpr("id task_id", "d dispatched", "cast(h as timestamp) heartbeat", "n dispatches")
    assert {r.task_id: r.action for r in E.reconcile(tasks, F.expr(now)).collect()} == {2: "REDISPATCH", 3: "STALE"}


def test_latest_trace_is_the_ordered_fold(spark):
    import random

    r = random.Random(5)
    rows = [(r.randrange(6), k, r.choice(["auto", "shadow", "manual"]), r.randrange(9)) for k in range(80)]
    want = {}
    for x, seq, mode, at in rows:
        kept = want.get(x)
        if kept is None or (mode == "auto" and kept[1] != "auto") or at >= kept[2]:
            want[x] = (seq, mode, at)
    out = E.latest_trace(spark.createDataFrame(rows, "exchange_id long, seq long, mode string, at long")).collect()
    assert {x.exchange_id: (x.seq, x.mode, x["at"]) for x in out} == want


def test_semantic_chunks_hold_all_sentences(spark):
    from docloom.operators.blocks import semantic_chunks, strategy_pipeline

    texts = ["\n".join(f"alpha beta gamma {k} " + "x" * 60 for k in range(30)), "one", None, ""]
    out = semantic_chunks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    first = [c for c in out if c.doc_id == 0]
    assert sum(c.n_sentences for c in first) == 30 and all(c.n_chars <= 700 for c in first) and {c.doc_id for c in out} == {0, 1}
    assert strategy_pipeline(["SEMANTIC", "STRUCTURE", "SEMANTIC"]) == ["STRUCTURE", "SEMANTIC"]
    with pytest.raises(ValueError):
        strategy_pipeline(["OTHER"])


def test_label_propagation_takes_every_order(spark, tmp_path):
    import random
    from collections import Counter

    from docloom.plans import catalogue

    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    r = random.Random(6)
    orders = [(k, r.randrange(1, 9), r.choice([10.0, 500000.0])) for k in range(40)]
    lines = [(k, r.randrange(1, 7)) for k in range(40) for _ in range(2)]
    put("customer", [(k,) for k in range(1, 9)], "c_custkey long")
    put("supplier", [(k,) for k in range(1, 7)], "s_suppkey long")
    put("orders", orders, "o_orderkey long, o_custkey long, o_totalprice double")
    put("lineitem", lines, "l_orderkey long, l_suppkey long")

    def communities(least):
        links = {(2 * c, 2 * s + 1) for k, c, price in orders if price > least for o, s in lines if o == k}
        links |= {(b, a) for a, b in links}
        label = {n: n for n in [*range(2, 17, 2), *range(3, 14, 2)]}
        for _ in range(5):
            votes = {n: Counter(label[a] for a, b in links if b == n) for n in label}
            label = {n: min(v, key=lambda c: (-v[c], c)) if v else label[n] for n, v in votes.items()}
        return {n: min(m for m in label if label[m] == label[n]) for n in label}

    out = {x.node: x.community for x in catalogue.queries()["graph_label_propagation"](spark, str(tmp_path)).collect()}
    assert out == communities(0) != communities(400000)


def test_more_queries_than_a_block(spark):
    from docloom.operators.retrieval import vector_scores

    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.6, 0.8])], "doc_id long, unit array<double>")
    queries = spark.range(100_001).select(F.col("id").alias("query_id"), F.array(F.lit(0.0), F.lit(1.0)).alias("unit_q"))
    out = vector_scores(queries, vectors)
    assert out.groupBy("doc_id").agg(F.count("*"), F.countDistinct("query_id"), F.min("score"), F.max("score")).orderBy("doc_id").collect() == [
        (0, 100_000, 100_000, 0.0, 0.0),
        (1, 100_000, 100_000, 0.8, 0.8),
    ]
