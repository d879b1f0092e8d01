"""Queries over dates, ids, numbers and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import scalars as S
from docloom.plans.catalogue import query
from docloom.sources.tables import table


@query(
    """SELECT event_id, date_trunc('day', ts)::TIMESTAMP AS day_start, (date_trunc('day', ts) + INTERVAL '23 hours 59 minutes 59.999 seconds')::TIMESTAMP AS day_end,
 CAST(strftime(ts, '%Y%m%d') AS BIGINT) AS day_key, CAST(isodow(ts) AS INT) AS weekday, CAST(ceil(dayofyear(ts) / 7.0) - CASE WHEN isodow(date_trunc('year', ts)) = 1 THEN 0 ELSE 1 END AS INT) AS week_no,
 date_trunc('week', ts)::TIMESTAMP AS week_start, CAST(day(last_day(ts)) AS INT) AS month_days, strftime(ts, '%Y-%m-%d %H:%M:%S') AS shown FROM events"""
)
def date_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day, week and month figures of timestamps."""
    ts = F.col("ts")
    return table(spark, sf_dir, "events").select(
        "event_id",
        S.day_start(ts).cast("timestamp_ntz").alias("day_start"),
        S.day_end(ts).cast("timestamp_ntz").alias("day_end"),
        S.number_key(ts).alias("day_key"),
        S.iso_weekday(ts).alias("weekday"),
        S.week_of_year(ts).alias("week_no"),
        S.week_start(ts).cast("timestamp_ntz").alias("week_start"),
        F.size(S.month_dates(ts.cast("date"))).alias("month_days"),
        F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias("shown"),
    )


@query(
    """SELECT o_orderkey, CAST(d AS INT) AS n_between, d + 2 AS n_inclusive, CAST(abs(date_diff('day', a, b)) * 86400 AS BIGINT) AS seconds FROM
 (SELECT o_orderkey, a, b, greatest(0, abs(date_diff('day', a, b)) - 1) AS d FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 9 - 4 AS INT) AS b FROM orders))"""
)
def between_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days between two dates in either order; equal ends count twice in the inclusive list."""
    d = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("a"))
    d = d.withColumn("b", F.date_add("a", (F.col("o_orderkey") % 9 - 4).cast("int")))
    a, b = F.col("a"), F.col("b")
    return d.select("o_orderkey", F.size(S.between_dates(a, b, False)).alias("n_between"), F.size(S.between_dates(a, b, True)).cast("long").alias("n_inclusive"), S.seconds_between(a.cast("timestamp"), b.cast("timestamp")).alias("seconds"))


@query(
    """SELECT event_id, id, (id >> 22) + 1288834974657 AS millis, (id >> 17) & 31 AS datacenter, (id >> 12) & 31 AS worker, id & 4095 AS sequence,
 ((id >> 12) << 12) | ((event_id % 4096) << 6) | (user_id & 63) AS gene FROM (SELECT event_id, user_id, ((epoch_us(ts) // 1000 - 1288834974657) << 22) | ((user_id % 32) << 17) | ((user_id % 7) << 12) | (event_id % 4096) AS id FROM events)"""
)
def snowflake_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time-ordered ids made and taken apart."""
    e = table(spark, sf_dir, "events")
    millis = F.unix_millis(F.col("ts").cast("timestamp"))
    made = e.select("event_id", "user_id", S.snowflake(millis, F.col("user_id") % 32, F.col("user_id") % 7, F.col("event_id") % 4096).alias("id"))
    gene = S.gene_id(F.col("id"), F.col("event_id") % 4096, F.col("user_id"))
    return made.select("event_id", "id", S.snowflake_parts(F.col("id")).alias("p"), gene.alias("gene")).select("event_id", "id", "p.*", "gene")


@query(
    """SELECT event_id, id, (id >> 35) + 1716134400 AS seconds, (id >> 13) & 4194303 AS worker, id & 8191 AS sequence
FROM (SELECT event_id, (((epoch(ts)::BIGINT + 100000000) - 1716134400) << 35) | (user_id << 13) | (event_id % 8192) AS id FROM (SELECT event_id, user_id, TIMESTAMP '2024-06-01' + INTERVAL (event_id) SECOND AS ts FROM events))"""
)
def uid_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second-ordered ids made and taken apart."""
    e = table(spark, sf_dir, "events")
    seconds = F.lit(1717200000).cast("long") + F.col("event_id") + 100000000
    made = e.select("event_id", S.uid(seconds, F.col("user_id"), F.col("event_id") % 8192).alias("id"))
    return made.select("event_id", "id", S.uid_parts(F.col("id")).alias("p")).select("event_id", "id", "p.*")


@query(
    """SELECT event_id, CASE WHEN value > 0 THEN round(value / 300, 4) ELSE 0.0 END AS share, CASE WHEN value - 50 = 0 THEN 'neutral' WHEN value > 50 THEN 'positive' ELSE 'negative' END AS tone,
 CASE WHEN value <= 10 THEN 'LE_10' WHEN value <= 50 THEN 'LE_50' ELSE 'SLOW' END AS band FROM events"""
)
def number_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratios, tones and bands."""
    v = F.col("value")
    share = F.when(v > 0, S.ratio(v, F.lit(300.0))).otherwise(0.0)
    band = F.when(v <= 10, "LE_10").when(v <= 50, "LE_50").otherwise("SLOW")
    return table(spark, sf_dir, "events").select("event_id", share.alias("share"), S.delta_tone(v - 50).alias("tone"), band.alias("band"))


@query(
    """SELECT event_id, floor(x0) AS left_px, ceil(x1) AS right_px, least(x0, x1) AS x0, greatest(x0, x1) AS x1 FROM (SELECT event_id, value AS x0, value + user_id AS x1 FROM events)"""
)
def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes from polygons, and the pixels they cover."""
    e = table(spark, sf_dir, "events")
    points = F.array(F.col("value"), F.lit(1.0), F.col("value") + F.col("user_id"), F.lit(2.0))
    box = S.box_of_polygon(points)
    return e.select("event_id", box.alias("b")).select("event_id", F.floor("b.x0").cast("double").alias("left_px"), F.ceil("b.x1").cast("double").alias("right_px"), "b.x0", "b.x1")


@query("SELECT event_id, json_extract_string(props, '$.' || json_keys(props)[1]) AS first_value, CAST(len(json_keys(props)) AS INT) AS n_keys FROM events")
def json_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open metadata as maps."""
    entries = S.json_map(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", F.get(F.map_values(entries), F.lit(0)).alias("first_value"), F.size(entries).alias("n_keys"))
