"""Queries over joins, sets, sorts, pages and the two filter languages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.operators.metadata_filter import compile_filter
from docloom.operators.table_query import TablePlan, run
from docloom.plans.catalogue import query
from docloom.sources.tables import table


@query(
    """SELECT o.o_orderkey AS exchange_id, c.c_custkey AS dialogue_code, CASE WHEN o.o_orderstatus = 'O' THEN 'UP' ELSE 'DOWN' END AS rating,
 CAST(o.o_orderdate AS DATE) AS feedback_date, left(c.c_name, 2000) AS answer_preview, n.n_name AS scope
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
WHERE o.o_orderstatus IN ('O', 'F') AND c.c_acctbal > 0
ORDER BY CASE WHEN o.o_orderstatus = 'F' THEN 0 ELSE 1 END, o.o_orderdate DESC, o.o_orderkey LIMIT 200"""
)
def feedback_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback with its exchange and dialogue, bad ratings first, newest first: a top-200 report."""
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    joined = orders.where("o_orderstatus in ('O', 'F')").join(customer.where("c_acctbal > 0"), F.expr("o_custkey = c_custkey")).join(nation, F.expr("c_nationkey = n_nationkey"))
    first = F.when(F.col("o_orderstatus") == "F", 0).otherwise(1)
    best = joined.orderBy(first, F.desc("o_orderdate"), "o_orderkey").limit(200)
    return best.select(
        F.col("o_orderkey").alias("exchange_id"),
        F.col("c_custkey").alias("dialogue_code"),
        F.when(F.col("o_orderstatus") == "O", "UP").otherwise("DOWN").alias("rating"),
        F.col("o_orderdate").cast("date").alias("feedback_date"),
        F.left("c_name", F.lit(2000)).alias("answer_preview"),
        F.col("n_name").alias("scope"),
    )


@query("SELECT c_custkey, c_nationkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def semi_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows within a scope given by another table; the scope's filter is below the join."""
    scope = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(scope, "c_custkey", "left_semi").select("c_custkey", "c_nationkey")


@query("SELECT c_custkey, 'NO_RELATION' AS reason FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_unlinked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without any relation."""
    linked = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(linked, "c_custkey", "left_anti").select("c_custkey", F.lit("NO_RELATION").alias("reason"))


@query(
    """WITH k AS (SELECT l_orderkey, l_linenumber, unnest([{'p': 1, 'id': l_partkey * 10 + 1}, {'p': 2, 'id': l_suppkey * 10 + 2}, {'p': 3, 'id': l_orderkey * 10 + 3}]) AS x FROM lineitem),
r AS (SELECT p_partkey * 10 + 1 AS id, 'part' AS what FROM part WHERE p_size < 10 UNION ALL SELECT s_suppkey * 10 + 2, 'supplier' FROM supplier WHERE s_acctbal > 5000
  UNION ALL SELECT o_orderkey * 10 + 3, 'order' FROM orders WHERE o_orderstatus = 'P')
SELECT l_orderkey, l_linenumber, CAST(min(x.p) AS INT) AS priority, arg_min(what, x.p) AS matched FROM k JOIN r ON r.id = k.x.id GROUP BY ALL"""
)
def first_match_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows matched by the first of several keys that hits: one equi join over keys with priorities."""
    line = table(spark, sf_dir, "lineitem")
    key = lambda p, column: F.struct(F.lit(p).alias("priority"), (F.col(column).cast("long") * 10 + p).alias("id"))
    keys = line.select("l_orderkey", "l_linenumber", F.explode(F.array(key(1, "l_partkey"), key(2, "l_suppkey"), key(3, "l_orderkey"))).alias("k")).select("l_orderkey", "l_linenumber", "k.*")
    ref = lambda name, column, p, what, condition: table(spark, sf_dir, name).where(condition).select((F.col(column).cast("long") * 10 + p).alias("id"), F.lit(what).alias("what"))
    refs = ref("part", "p_partkey", 1, "part", "p_size < 10").unionByName(ref("supplier", "s_suppkey", 2, "supplier", "s_acctbal > 5000")).unionByName(ref("orders", "o_orderkey", 3, "order", "o_orderstatus = 'P'"))
    return keys.join(refs, "id").groupBy("l_orderkey", "l_linenumber").agg(F.min("priority").alias("priority"), F.min_by("what", "priority").alias("matched"))


@query(
    """WITH a AS (SELECT c_nationkey AS k, count(*) AS customers FROM customer WHERE c_acctbal > 9000 GROUP BY ALL), b AS (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier WHERE s_acctbal > 9000 GROUP BY ALL)
SELECT coalesce(a.k, b.k) AS nation, coalesce(customers, 0) AS customers, coalesce(suppliers, 0) AS suppliers FROM a FULL OUTER JOIN b ON a.k = b.k"""
)
def full_outer_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups that any side knows."""
    a = table(spark, sf_dir, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    b = table(spark, sf_dir, "supplier").where("s_acctbal > 9000").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"))
    return a.join(b, "nation", "full").select("nation", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


@query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN o_orderkey IS NULL THEN 'UNKNOWN_ORDER' WHEN p_partkey IS NULL THEN 'UNKNOWN_PART' ELSE 'KNOWN' END AS outcome
FROM lineitem LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F') ON l_orderkey = o_orderkey LEFT JOIN (SELECT p_partkey FROM part WHERE p_size <= 40) ON l_partkey = p_partkey"""
)
def endpoint_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with the reason that its endpoints are unknown, rather than a silent drop."""
    orders = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("ok"))
    parts = table(spark, sf_dir, "part").where("p_size <= 40").select(F.col("p_partkey").alias("pk"))
    joined = table(spark, sf_dir, "lineitem").join(orders, F.expr("l_orderkey = ok"), "left").join(parts, F.expr("l_partkey = pk"), "left")
    outcome = F.when(F.col("ok").isNull(), "UNKNOWN_ORDER").when(F.col("pk").isNull(), "UNKNOWN_PART").otherwise("KNOWN")
    return joined.select("l_orderkey", "l_linenumber", outcome.alias("outcome"))


@query(
    """WITH q AS (SELECT doc_id, substr(text, 11, 30) AS quote, CASE WHEN doc_id % 3 = 0 THEN doc_id + 1 ELSE doc_id END AS source_id FROM documents WHERE length(text) >= 40)
SELECT q.doc_id, q.source_id, contains(d.text, q.quote) AS bound FROM q JOIN documents d ON d.doc_id = q.source_id"""
)
def quote_in_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a quote stands in the source it names: an equi join, then containment."""
    docs = table(spark, sf_dir, "documents")
    source = F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") + 1).otherwise(F.col("doc_id"))
    quotes = docs.where("length(text) >= 40").select("doc_id", F.substring("text", 11, 30).alias("quote"), source.alias("source_id"))
    sources = docs.select(F.col("doc_id").alias("source_id"), "text")
    return quotes.join(sources, "source_id").select("doc_id", "source_id", F.col("text").contains(F.col("quote")).alias("bound"))


@query(
    """WITH a AS (SELECT l_orderkey AS rel, l_linenumber AS ev FROM lineitem WHERE l_quantity > 10), b AS (SELECT l_orderkey AS rel, l_linenumber AS ev FROM lineitem WHERE l_discount < 0.08)
SELECT a.rel, count(*) AS n_bound, array_to_string(list_sort(list(CAST(a.ev AS VARCHAR))), ',') AS evidence FROM a JOIN b ON a.rel = b.rel AND a.ev = b.ev GROUP BY ALL"""
)
def reciprocal_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links that both ends name."""
    line = table(spark, sf_dir, "lineitem")
    pair = [F.col("l_orderkey").alias("rel"), F.col("l_linenumber").alias("ev")]
    both = line.where("l_quantity > 10").select(*pair).join(line.where("l_discount < 0.08").select(*pair), ["rel", "ev"])
    return both.groupBy("rel").agg(F.count("*").alias("n_bound"), F.array_join(F.sort_array(F.collect_list(F.col("ev").cast("string"))), ",").alias("evidence"))


@query(
    """SELECT event_id, CAST(i - 1 AS INT) AS position, ids[i] AS candidate, coalesce(scores[i], 0.0) AS score FROM (SELECT event_id, ids, scores, unnest(range(1, 4)) AS i FROM
 (SELECT event_id, [user_id, user_id + 1, user_id + 2] AS ids, [value, value / 2] AS scores FROM events))"""
)
def positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores joined to candidates by position; a missing score is 0."""
    e = table(spark, sf_dir, "events")
    ids = F.array("user_id", F.col("user_id") + 1, F.col("user_id") + 2).alias("ids")
    zipped = e.select("event_id", F.posexplode(F.arrays_zip(ids, F.array("value", F.col("value") / 2).alias("scores"))).alias("position", "z"))
    return zipped.select("event_id", "position", F.col("z.ids").alias("candidate"), F.coalesce("z.scores", F.lit(0.0)).alias("score"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice, (SELECT count(*) FROM lineitem) AS total FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 50 OFFSET 100")
def page_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of fifty, with the total."""
    line = table(spark, sf_dir, "lineitem")
    page = line.orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").offset(100).limit(50).select("l_orderkey", "l_linenumber", "l_extendedprice")
    return page.crossJoin(F.broadcast(line.agg(F.count("*").alias("total"))))


CELLS = """SELECT l_orderkey AS row_no, unnest([{'c': 0, 't': CAST(l_partkey AS VARCHAR)}, {'c': 1, 't': CAST(l_suppkey AS VARCHAR)}, {'c': 2, 't': l_returnflag}]) AS x FROM lineitem WHERE l_linenumber = 1"""


@query(f"SELECT row_no, CAST(x.c AS INT) AS column_no, x.t AS cell FROM ({CELLS}) WHERE row_no BETWEEN 20 AND 39 AND x.c BETWEEN 0 AND 1")
def table_window_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window of rows and columns over a table in long form."""
    line = table(spark, sf_dir, "lineitem").where("l_linenumber = 1 and l_orderkey between 20 and 39")
    cells = F.array(F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), "l_returnflag")
    return line.select(F.col("l_orderkey").alias("row_no"), F.posexplode(cells).alias("column_no", "cell")).where("column_no between 0 and 1")


@query(
    """WITH u AS (SELECT event_id % 4000 AS log_id, event_id, ts, value FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY event_id DESC) AS k FROM u)
SELECT log_id, event_id, value FROM r WHERE k = 1"""
)
def log_merge_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old and new log rows merged by id, the last one kept: an aggregate, no sort."""
    e = table(spark, sf_dir, "events").withColumn("log_id", F.col("event_id") % 4000)
    return e.groupBy("log_id").agg(F.max("event_id").alias("event_id"), F.max_by("value", "event_id").alias("value"))


@query("SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0 INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k")).intersect(table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_custkey"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def set_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_custkey"))


@query("SELECT c_nationkey AS k, 'customer' AS origin FROM customer UNION ALL SELECT s_nationkey, 'supplier' FROM supplier")
def set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.lit("customer").alias("origin"))
    return one.unionByName(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.lit("supplier").alias("origin")))


@query("SELECT c_custkey, CASE WHEN lower(c_name || ' ' || c_mktsegment) LIKE '%build%' THEN true ELSE false END AS hit FROM customer")
def keyword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyword looked for in several fields, either case."""
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", F.lower(F.concat_ws(" ", "c_name", "c_mktsegment")).contains("build").alias("hit"))


@query(
    """WITH f AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_returnflag = 'R' THEN 0 WHEN l_returnflag = 'N' THEN 1 ELSE 2 END, coalesce(CASE WHEN l_tax > 0.04 THEN CAST(l_quantity AS INT) END, 9999), l_linenumber) AS place FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST(place AS INT) AS place FROM f WHERE place <= 4"""
)
def candidate_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected before normal before filtered, then final rank with missing last, then position; four seats each."""
    state = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    final = F.coalesce(F.when(F.col("l_tax") > 0.04, F.col("l_quantity").cast("int")), F.lit(9999))
    w = Window.partitionBy("l_orderkey").orderBy(state, final, "l_linenumber")
    return table(spark, sf_dir, "lineitem").withColumn("place", F.row_number().over(w)).where("place <= 4").select("l_orderkey", "l_linenumber", "place")


def _table_query(name: str, sql: str, source: str, plan: TablePlan) -> None:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(plan, table(spark, sf_dir, source))

    f.__name__, f.__doc__ = name, f"Table query {plan.operation}."
    query(sql)(f)


_table_query("table_dsl_lookup", "SELECT p_partkey, p_brand FROM part WHERE p_size >= 45 AND p_name LIKE '%a%'", "part", TablePlan("LOOKUP", columns=["p_partkey", "p_brand"], filters=[("p_size", "GTE", 45), ("p_name", "CONTAINS", "a")]))
_table_query("table_dsl_count", "SELECT count(*) AS result FROM part WHERE p_size < 10", "part", TablePlan("COUNT", filters=[("p_size", "LT", 10)]))
_table_query("table_dsl_sum", "SELECT sum(l_quantity) AS result FROM lineitem WHERE l_returnflag = 'R'", "lineitem", TablePlan("SUM", metric="l_quantity", filters=[("l_returnflag", "EQ", "R")]))
_table_query("table_dsl_max", "SELECT max(p_retailprice) AS result FROM part WHERE p_size <= 20", "part", TablePlan("MAX", metric="p_retailprice", filters=[("p_size", "LTE", 20)]))
_table_query("table_dsl_min", "SELECT min(p_retailprice) AS result FROM part WHERE p_size > 20", "part", TablePlan("MIN", metric="p_retailprice", filters=[("p_size", "GT", 20)]))
_table_query("table_dsl_group_count", "SELECT p_brand, count(*) AS result FROM part GROUP BY ALL", "part", TablePlan("GROUP_COUNT", group_by="p_brand"))
_table_query("table_dsl_group_sum", "SELECT l_returnflag, sum(l_quantity) AS result FROM lineitem GROUP BY ALL", "lineitem", TablePlan("GROUP_SUM", metric="l_quantity", group_by="l_returnflag"))


def _filter_query(name: str, sql_condition: str, condition: dict) -> None:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = table(spark, sf_dir, "customer")
        fields = {"department": F.col("c_mktsegment"), "owner": F.col("c_name"), "labels": F.array("c_mktsegment", F.col("c_nationkey").cast("string")), "retiredAt": F.when(F.col("c_acctbal") < 0, F.col("c_acctbal"))}
        return c.where(compile_filter({"version": 1, **condition}, fields, {"labels"}, {"retiredAt"})).select("c_custkey", "c_mktsegment")

    f.__name__, f.__doc__ = name, "Customers under a metadata filter."
    query(f"SELECT c_custkey, c_mktsegment FROM customer WHERE {sql_condition}")(f)


_filter_query("metadata_filter_and", "c_mktsegment = 'BUILDING' AND c_name LIKE '%1%'", {"and": [{"field": "department", "op": "=", "value": "BUILDING"}, {"field": "owner", "op": "contains", "value": "1"}]})
_filter_query("metadata_filter_or", "c_mktsegment <> 'BUILDING' OR c_name LIKE '%77%'", {"or": [{"field": "department", "op": "!=", "value": "BUILDING"}, {"field": "owner", "op": "contains", "value": "77"}]})
_filter_query("metadata_filter_in", "c_mktsegment IN ('BUILDING', 'MACHINERY') AND NOT (c_mktsegment = 'MACHINERY' OR CAST(c_nationkey AS VARCHAR) = '7')", {"and": [{"field": "department", "op": "in", "value": ["BUILDING", "MACHINERY"]}, {"field": "labels", "op": "not in", "value": ["MACHINERY", "7"]}]})
_filter_query("metadata_filter_empty", "c_acctbal < 0", {"and": [{"field": "retiredAt", "op": "not empty"}]})
