"""Exact order statistics of large groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.graph import written

#: Equal ranges of value that a group is counted in.
RANGES = 4096


def exact_percentiles(rows: DataFrame, keys: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """``keys`` and one column per point: percentiles of ``value`` with linear interpolation between neighbours.

    No group's values meet in one place. Each group is counted in RANGES equal
    ranges between its ends; running counts say which ranges hold the ranks
    asked for, and only the distinct values of these, with their counts, are
    ordered. Null values do not count; a group without values is left out.
    """
    held = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("x"))
    values = written(held.groupBy(*keys, "x").agg(F.count("*").alias("n")), "values")
    ends = values.groupBy(*keys).agg(F.min("x").alias("low"), F.max("x").alias("high"), F.sum("n").alias("total"))
    ends = written(ends, "ends")
    same = lambda left, right: [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys]
    part = F.least(F.lit(RANGES - 1), F.floor((F.col("x") - F.col("low")) / (F.col("high") - F.col("low")) * RANGES))
    placed = values.alias("v").join(ends.alias("e"), same("v", "e"))
    placed = placed.select(*[F.col(f"v.{k}").alias(k) for k in keys], "x", "n", "total", F.when(F.col("high") > F.col("low"), part).otherwise(0).cast("int").alias("part"))

    upto = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(*keys, "part").agg(F.sum("n").alias("held"), F.first("total").alias("total"))  # at most RANGES rows a group
    counts = counts.withColumn("before", F.coalesce(F.sum("held").over(upto), F.lit(0)))
    ranks = F.array(*[F.lit(p) for p in points.values()])
    # ranks count from 0; a percentile lies between two of them
    asked = F.exists(
        ranks, lambda p: (F.floor(p * (F.col("total") - 1)) < F.col("before") + F.col("held")) & (F.ceil(p * (F.col("total") - 1)) >= F.col("before"))
    )
    wanted = counts.where(asked).select(*keys, "part", "before")
    near = placed.alias("p").join(wanted.alias("w"), [*same("p", "w"), F.col("p.part") == F.col("w.part")])
    near = near.select(*[F.col(f"p.{k}").alias(k) for k in keys], "x", "n", "total", F.col("p.part").alias("part"), "before")
    own = Window.partitionBy(*keys, "part").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    near = near.withColumn("first", F.col("before") + F.coalesce(F.sum("n").over(own), F.lit(0)))
    at = lambda rank: F.max(F.when((F.col("first") <= rank) & (rank < F.col("first") + F.col("n")), F.col("x")))

    def point(p: float):
        place = F.lit(p) * (F.col("total") - 1)
        return F.struct(at(F.floor(place)).alias("low"), at(F.ceil(place)).alias("high"), F.max(place - F.floor(place)).alias("share"))

    found = near.groupBy(*keys).agg(*[point(p).alias(name) for name, p in points.items()])
    between = lambda c: F.col(f"{c}.low") + (F.col(f"{c}.high") - F.col(f"{c}.low")) * F.col(f"{c}.share")
    return found.select(*keys, *[between(name).alias(name) for name in points])
