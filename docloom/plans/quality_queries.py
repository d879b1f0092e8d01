"""Queries over routes, funnels, latency and windows of key figures.

Events stand for traces: the type is the channel or status, the value the duration.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.operators.stats import exact_percentiles
from docloom.plans.catalogue import query
from docloom.sources.tables import table


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


@query(
    """SELECT count(*) AS total, count_if(user_id % 2 = 0) AS auto_count, count_if(user_id % 2 = 1) AS shadow_count, count_if(event_type = 'purchase') AS success_count,
 count_if(event_type NOT IN ('purchase', 'view')) AS failed_count, count_if(coalesce(conf, 0) >= 0.8) AS high_confidence, round(avg(conf), 6) AS mean_confidence,
 count(DISTINCT user_id) AS top_documents, round(count_if(event_type = 'purchase') * 100.0 / count(*), 6) AS success_rate, round(count_if(event_type <> 'purchase') * 100.0 / count(*), 6) AS low_rate
FROM (SELECT *, CASE WHEN value <= 100 THEN value / 100 END AS conf FROM events)"""
)
def route_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All figures of route traces in one aggregate; unknown statuses count as failed, empty averages are null."""
    conf = F.when(F.col("value") <= 100, F.col("value") / 100)
    kind = F.col("event_type")
    return _events(spark, sf_dir).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("user_id") % 2 == 0).alias("auto_count"),
        F.count_if(F.col("user_id") % 2 == 1).alias("shadow_count"),
        F.count_if(kind == "purchase").alias("success_count"),
        F.count_if(~kind.isin("purchase", "view")).alias("failed_count"),
        F.count_if(F.coalesce(conf, F.lit(0.0)) >= 0.8).alias("high_confidence"),
        F.round(F.avg(conf), 6).alias("mean_confidence"),
        F.countDistinct("user_id").alias("top_documents"),
        F.round(F.try_divide(F.count_if(kind == "purchase") * 100.0, F.count("*")), 6).alias("success_rate"),
        F.round(F.try_divide(F.count_if(kind != "purchase") * 100.0, F.count("*")), 6).alias("low_rate"),
    )


@query(
    """SELECT user_id AS document_id, count(*) AS n, round(avg(CASE WHEN value <= 100 THEN value / 100 END), 6) AS mean_confidence, count_if(event_type <> 'purchase') AS not_success
FROM events GROUP BY ALL ORDER BY n DESC, document_id LIMIT 6"""
)
def top_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six documents named most: a top-k report."""
    grouped = _events(spark, sf_dir).groupBy(F.col("user_id").alias("document_id")).agg(
        F.count("*").alias("n"), F.round(F.avg(F.when(F.col("value") <= 100, F.col("value") / 100)), 6).alias("mean_confidence"), F.count_if(F.col("event_type") != "purchase").alias("not_success")
    )
    return grouped.orderBy(F.desc("n"), "document_id").limit(6)


@query(
    """SELECT event_type AS metric, count(*) AS n, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY ALL"""
)
def distribution_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles with linear interpolation for each metric; metrics without values are left out."""
    e = _events(spark, sf_dir).select(F.col("event_type").alias("metric"), "value")
    summary = e.groupBy("metric").agg(F.count("value").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.round(F.avg("value"), 6).alias("mean"))
    points = exact_percentiles(e, ["metric"], "value", {"p50": 0.5, "p90": 0.9})
    return summary.where("n > 0").join(points, "metric").select("metric", "n", "low", "high", "mean", F.round("p50", 6).alias("p50"), F.round("p90", 6).alias("p90"))


STAGES = """SELECT event_type AS stage_code, CASE WHEN user_id % 2 = 0 THEN 'auto' ELSE 'shadow' END AS mode, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90,
 round(quantile_cont(value, 0.99), 6) AS p99, count(*) AS samples FROM events GROUP BY ALL"""


@query(STAGES)
def stage_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latency percentiles by stage and mode."""
    mode = F.when(F.col("user_id") % 2 == 0, "auto").otherwise("shadow")
    e = _events(spark, sf_dir).select(F.col("event_type").alias("stage_code"), mode.alias("mode"), "value")
    keys, points = ["stage_code", "mode"], {"p50": 0.5, "p90": 0.9, "p99": 0.99}
    found = exact_percentiles(e, keys, "value", points).join(e.groupBy(*keys).agg(F.count("*").alias("samples")), keys)
    return found.select(*keys, *[F.round(n, 6).alias(n) for n in points], "samples")


@query(
    f"""WITH s AS ({STAGES}) SELECT event_id, CASE WHEN value <= p50 THEN 'P50' WHEN value <= p90 THEN 'P90' WHEN value <= p99 THEN 'P99' ELSE 'SLOW' END AS band
FROM events JOIN s ON stage_code = event_type AND mode = CASE WHEN user_id % 2 = 0 THEN 'auto' ELSE 'shadow' END"""
)
def latency_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each trace against its stage's percentiles."""
    e = _events(spark, sf_dir).withColumn("mode", F.when(F.col("user_id") % 2 == 0, "auto").otherwise("shadow"))
    joined = e.join(stage_percentiles(spark, sf_dir).withColumnRenamed("mode", "m"), F.expr("stage_code = event_type and mode = m"))
    v = F.col("value")
    return joined.select("event_id", F.when(v <= F.col("p50"), "P50").when(v <= F.col("p90"), "P90").when(v <= F.col("p99"), "P99").otherwise("SLOW").alias("band"))


@query(
    """WITH m AS (SELECT max(CAST(ts AS DATE)) AS last_day FROM events), d AS (SELECT event_type, value, date_diff('day', CAST(ts AS DATE), last_day) AS age FROM events, m)
SELECT event_type, count_if(age < 3) AS current_count, count_if(age >= 3 AND age < 6) AS previous_count, count_if(age < 3) - count_if(age >= 3 AND age < 6) AS delta,
 count_if(age >= 3 AND age < 6) > 0 AS comparable FROM d GROUP BY ALL"""
)
def kpi_previous_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window of days against the one before it, in one pass after the last day is known."""
    e = _events(spark, sf_dir)
    last = e.agg(F.max(F.col("ts").cast("date")).alias("last_day"))
    age = F.datediff("last_day", F.col("ts").cast("date"))
    now, before = F.count_if(age < 3), F.count_if((age >= 3) & (age < 6))
    return e.crossJoin(F.broadcast(last)).groupBy("event_type").agg(now.alias("current_count"), before.alias("previous_count"), (now - before).alias("delta"), (before > 0).alias("comparable"))


@query(
    """SELECT CAST(ts AS DATE) AS day, count_if(user_id % 2 = 0) AS auto_count, round(count_if(user_id % 2 = 0 AND event_type = 'purchase') * 100.0 / nullif(count_if(user_id % 2 = 0), 0), 6) AS auto_success,
 round(avg(CASE WHEN user_id % 2 = 1 THEN value END), 6) AS shadow_value FROM events GROUP BY ALL"""
)
def daily_mode_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily figures by mode; a mode without traces on a day is null, not zero."""
    auto = F.col("user_id") % 2 == 0
    grouped = _events(spark, sf_dir).groupBy(F.col("ts").cast("date").alias("day"))
    return grouped.agg(
        F.count_if(auto).alias("auto_count"),
        F.round(F.try_divide(F.count_if(auto & (F.col("event_type") == "purchase")) * 100.0, F.count_if(auto)), 6).alias("auto_success"),
        F.round(F.avg(F.when(~auto, F.col("value"))), 6).alias("shadow_value"),
    )


@query("SELECT event_type, round(sum(value * user_id) / sum(user_id), 6) AS weighted FROM events GROUP BY ALL")
def weighted_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy("event_type").agg(F.round(F.try_divide(F.sum(F.col("value") * F.col("user_id")), F.sum("user_id")), 6).alias("weighted"))


@query(
    """SELECT event_type AS channel, count(*) AS recalled, count_if(value > 60) AS selected, round(count_if(value > 60) * 100.0 / count(*), 1) AS selection_rate, count(DISTINCT user_id) AS snapshots,
 round(avg(value), 6) AS mean_score, min(value) AS low_score, max(value) AS high_score FROM events GROUP BY ALL"""
)
def channel_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recalled and selected hits of each channel."""
    hit = F.count_if(F.col("value") > 60)
    grouped = _events(spark, sf_dir).groupBy(F.col("event_type").alias("channel"))
    return grouped.agg(
        F.count("*").alias("recalled"), hit.alias("selected"), F.round(hit * 100.0 / F.count("*"), 1).alias("selection_rate"), F.countDistinct("user_id").alias("snapshots"),
        F.round(F.avg("value"), 6).alias("mean_score"), F.min("value").alias("low_score"), F.max("value").alias("high_score"),
    )


@query(
    """WITH s AS (SELECT count(*) AS n0, count_if(o_orderstatus <> 'P') AS n1, count_if(o_orderstatus = 'F') AS n2, count_if(o_orderstatus = 'F' AND o_totalprice > 100000) AS n3 FROM orders),
u AS (SELECT unnest([{'k': 1, 's': 'sample', 'n': n0}, {'k': 2, 's': 'parsed', 'n': n1}, {'k': 3, 's': 'strategy', 'n': n2}, {'k': 4, 's': 'indexed', 'n': n3}]) AS x, n0 FROM s)
SELECT CAST(x.k AS INT) AS step_no, x.s AS step, x.n AS n, round(x.n * 100.0 / n0, 2) AS share, coalesce(lag(x.n) OVER (ORDER BY x.k) - x.n, 0) AS lost FROM u"""
)
def document_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps with their share of the first and their loss against the one before; the window is over four rows."""
    done = F.col("o_orderstatus")
    one = table(spark, sf_dir, "orders").agg(
        F.count("*").alias("n0"), F.count_if(done != "P").alias("n1"), F.count_if(done == "F").alias("n2"), F.count_if((done == "F") & (F.col("o_totalprice") > 100000)).alias("n3")
    )
    steps = one.select("n0", F.expr("stack(4, 1, 'sample', n0, 2, 'parsed', n1, 3, 'strategy', n2, 4, 'indexed', n3) as (step_no, step, n)"))
    w = Window.partitionBy("n0").orderBy("step_no")
    return steps.select("step_no", "step", "n", F.round(F.col("n") * 100.0 / F.col("n0"), 2).alias("share"), F.coalesce(F.lag("n").over(w) - F.col("n"), F.lit(0)).alias("lost"))


@query(
    """SELECT user_id % 10 AS sub_question, count(DISTINCT event_type) AS channels, count(*) AS recalled, count_if(value > 20) AS accepted, count_if(value > 60) AS reranked, count_if(value > 120) AS selected
FROM events GROUP BY ROLLUP (user_id % 10)"""
)
def retrieval_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recalled, accepted, reranked and selected by sub-question, with the total, in one rollup."""
    v = F.col("value")
    e = _events(spark, sf_dir).withColumn("sub_question", F.col("user_id") % 10)
    return e.rollup("sub_question").agg(F.countDistinct("event_type").alias("channels"), F.count("*").alias("recalled"), F.count_if(v > 20).alias("accepted"), F.count_if(v > 60).alias("reranked"), F.count_if(v > 120).alias("selected"))


@query(
    """SELECT r.r_regionkey AS scope, count(DISTINCT n_nationkey) AS topics, count(DISTINCT s_nationkey) AS covered, count(DISTINCT n_nationkey) - count(DISTINCT s_nationkey) AS pending, count(s_suppkey) AS relations,
 round(count(DISTINCT s_nationkey) * 100.0 / count(DISTINCT n_nationkey), 2) AS rate FROM region r LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 8000 GROUP BY ALL"""
)
def scope_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics of each scope that have documents."""
    suppliers = table(spark, sf_dir, "supplier").where("s_acctbal > 8000")
    joined = table(spark, sf_dir, "region").join(table(spark, sf_dir, "nation"), F.expr("n_regionkey = r_regionkey"), "left").join(suppliers, F.expr("s_nationkey = n_nationkey"), "left")
    topics, covered = F.countDistinct("n_nationkey"), F.countDistinct("s_nationkey")
    return joined.groupBy(F.col("r_regionkey").alias("scope")).agg(
        topics.alias("topics"), covered.alias("covered"), (topics - covered).alias("pending"), F.count("s_suppkey").alias("relations"), F.round(covered * 100.0 / topics, 2).alias("rate")
    )


@query("SELECT s_nationkey AS topic, count(*) AS relations, count(DISTINCT s_suppkey) AS documents, round(avg(CASE WHEN s_acctbal > 0 THEN s_acctbal END), 6) AS mean_score FROM supplier GROUP BY ALL")
def topic_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations, documents and mean finite score of each topic."""
    grouped = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("topic"))
    return grouped.agg(F.count("*").alias("relations"), F.countDistinct("s_suppkey").alias("documents"), F.round(F.avg(F.when(F.col("s_acctbal") > 0, F.col("s_acctbal"))), 6).alias("mean_score"))


@query(
    """SELECT o_orderkey, CASE WHEN p = 4 THEN 'PARSE_FAILED' WHEN i = 4 THEN 'INDEX_FAILED' WHEN p = 2 THEN 'PARSING' WHEN s = 2 THEN 'PLANNING' WHEN i = 2 THEN 'INDEXING' WHEN p <> 3 THEN 'WAITING_PARSE' WHEN s <> 3 THEN 'WAITING_STRATEGY'
 WHEN i <> 3 THEN 'WAITING_INDEX' ELSE 'USABLE' END AS status FROM (SELECT o_orderkey, o_orderkey % 5 AS p, o_custkey % 4 AS s, (o_orderkey + o_custkey) % 5 AS i FROM orders)"""
)
def status_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One status from three, failures first, then what runs, then what waits."""
    p, s, i = F.col("o_orderkey") % 5, F.col("o_custkey") % 4, (F.col("o_orderkey") + F.col("o_custkey")) % 5
    status = (
        F.when(p == 4, "PARSE_FAILED").when(i == 4, "INDEX_FAILED").when(p == 2, "PARSING").when(s == 2, "PLANNING").when(i == 2, "INDEXING")
        .when(p != 3, "WAITING_PARSE").when(s != 3, "WAITING_STRATEGY").when(i != 3, "WAITING_INDEX").otherwise("USABLE")
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", status.alias("status"))


@query("SELECT user_id, sum(CASE WHEN event_type = 'click' THEN value ELSE 0 END) AS prompt_tokens, count(*) AS calls, coalesce(nullif(count_if(event_type = 'signup'), 0), count_if(event_type = 'view') + count_if(event_type = 'click')) AS messages FROM events GROUP BY ALL")
def usage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage sums, and message counts that fall back to questions and answers."""
    kind = F.col("event_type")
    return _events(spark, sf_dir).groupBy("user_id").agg(
        F.sum(F.when(kind == "click", F.col("value")).otherwise(0.0)).alias("prompt_tokens"),
        F.count("*").alias("calls"),
        F.coalesce(F.nullif(F.count_if(kind == "signup"), F.lit(0)), F.count_if(kind == "view") + F.count_if(kind == "click")).alias("messages"),
    )


@query(
    """WITH g AS (SELECT user_id, event_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 2 HOUR AS session_end, count(*) AS n FROM s GROUP BY user_id, run"""
)
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that a gap of two hours ends."""
    e = _events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    grouped = e.groupBy("user_id", F.session_window("ts", "2 hours").alias("w")).agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("session_start"), F.col("w.end").cast("timestamp_ntz").alias("session_end"), "n")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS day_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily buckets."""
    e = _events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    grouped = e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return grouped.select(F.col("w.start").cast("timestamp_ntz").alias("day_start"), "event_type", "n", "total")


@query(
    """WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, max(CASE WHEN event_type = 'error' THEN NULL ELSE value END) AS v FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day) AS k FROM d),
n AS (SELECT *, k - row_number() OVER (PARTITION BY user_id ORDER BY day) AS island FROM r WHERE v IS NOT NULL)
SELECT user_id, min(day) AS first_day, max(day) AS last_day, count(*) AS points FROM n GROUP BY user_id, island"""
)
def gap_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A series cut into runs without missing points."""
    daily = _events(spark, sf_dir).groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.max(F.when(F.col("event_type") != "error", F.col("value"))).alias("v"))
    w = Window.partitionBy("user_id").orderBy("day")
    kept = daily.withColumn("k", F.row_number().over(w)).where("v is not null").withColumn("island", F.col("k") - F.row_number().over(w))
    return kept.groupBy("user_id", "island").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("points")).drop("island")


@query(
    """SELECT event_type, CAST(ts AS DATE) AS day, round(sum(value) / max(sum(value)) OVER (PARTITION BY event_type), 6) AS share_of_max,
 round(CASE WHEN max(sum(value)) OVER (PARTITION BY event_type) = min(sum(value)) OVER (PARTITION BY event_type) THEN 0.5 ELSE (sum(value) - min(sum(value)) OVER (PARTITION BY event_type)) / (max(sum(value)) OVER (PARTITION BY event_type) - min(sum(value)) OVER (PARTITION BY event_type)) END, 6) AS height
FROM events GROUP BY event_type, CAST(ts AS DATE)"""
)
def normalised_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series scaled by their maximum and between their ends; a flat series lies in the middle."""
    daily = _events(spark, sf_dir).groupBy("event_type", F.col("ts").cast("date").alias("day")).agg(F.sum("value").alias("v"))
    w = Window.partitionBy("event_type")
    low, high = F.min("v").over(w), F.max("v").over(w)
    height = F.when(high == low, 0.5).otherwise((F.col("v") - low) / (high - low))
    return daily.select("event_type", "day", F.round(F.col("v") / high, 6).alias("share_of_max"), F.round(height, 6).alias("height"))
