"""Graph operators as joins and aggregates: degrees, hops, components, communities, checked candidates."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: dict[str, str] = {}
#: Rows of a partition about, where a task sorts or holds the keys of a partition.
PART_ROWS = 500_000
#: Parts by hash of a node's neighbours, so that no task gets all that a seed reaches.
SPREAD = 16


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a table in the folder that ``spark.checkpoint.dir`` names, which ends its lineage there.

    Without that setting a folder of this machine serves, which only a session
    that runs on it alone may use.
    """
    spark: SparkSession = df.sparkSession
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        folder = _own_dir.setdefault(app, "") or "file://" + tempfile.mkdtemp(prefix="docloom-")
        _own_dir[app] = folder
    path = f"{folder.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts_for(df: DataFrame, rows: int = PART_ROWS) -> int:
    """Partitions that keep ``df``, a table as it is read, near ``rows`` rows each; never fewer than the session's."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))


def usable_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (source, target) of which both ends are nodes (node)."""
    return edges.join(nodes.select(F.col("node").alias("source")), "source", "left_semi").join(nodes.select(F.col("node").alias("target")), "target", "left_semi").select("source", "target")


def both_ways(edges: DataFrame, parts: int | None = None) -> DataFrame:
    """Links (source, target) in both directions, each once; ``parts`` partitions if given, so that a task's share can stay the same as edges grow."""
    ends = F.array(F.struct("source", "target"), F.struct(F.col("target").alias("source"), F.col("source").alias("target")))
    both = edges.where("source <> target").select(F.explode(ends).alias("e")).select("e.source", "e.target")
    return (both.repartition(parts, "source", "target") if parts else both).distinct()


def degrees(nodes: DataFrame, edges: DataFrame, parts: int | None = None) -> DataFrame:
    """(node, degree) with 0 for isolated nodes."""
    counted = both_ways(edges, parts).groupBy(F.col("source").alias("node")).agg(F.count("*").alias("degree"))
    return nodes.join(counted, "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree"))


def within_hops(seeds: DataFrame, edges: DataFrame, hops: int, parts: int | None = None) -> DataFrame:
    """(seed, node, distance) of the nodes within some hops of each seed, the shortest distance kept.

    Neighbours move as arrays, and are listed only where all that a seed reaches
    of one part of the nodes meets; so a step shuffles no row per path.
    """
    part = lambda node: F.pmod(F.xxhash64(node), F.lit(SPREAD)).alias("part")
    near = both_ways(edges, parts).groupBy("source", part("target")).agg(F.collect_list("target").alias("nodes"))
    near = written(near, "near") if hops > 1 else near
    reached = seeds.select(F.col("node").alias("seed"), part("node"), "node", F.lit(0).alias("distance"))
    for k in range(hops):
        front = reached.where(F.col("distance") == k).select("seed", F.col("node").alias("source"))
        step = front.join(near, "source").select("seed", "part", "nodes", F.lit(k + 1).alias("distance"))
        met = step.unionByName(reached.select("seed", "part", F.array("node").alias("nodes"), "distance"))
        met = met.repartition(parts, "seed", "part") if parts else met.repartition("seed", "part")
        reached = met.select("seed", "part", F.explode("nodes").alias("node"), "distance").groupBy("seed", "part", "node").agg(F.min("distance").alias("distance"))
        reached = written(reached, "reached") if k < hops - 1 else reached
    return reached.select("seed", "node", "distance")


def components(nodes: DataFrame, edges: DataFrame, parts: int | None = None) -> DataFrame:
    """(node, component): the smallest node reachable, by rounds of minima and pointer jumps until nothing changes."""
    links = written(both_ways(edges, parts), "links")
    labels = written(nodes.select("node", F.col("node").alias("component")), "labels")
    while True:
        near = links.join(labels, F.col("source") == F.col("node")).groupBy(F.col("target").alias("n")).agg(F.min("component").alias("m"))
        lower = labels.join(near, F.col("node") == F.col("n"), "left").select("node", F.least("component", F.coalesce("m", "component")).alias("c"))
        jump = labels.select(F.col("node").alias("c"), F.col("component").alias("up"))
        after = written(lower.join(jump, "c").select("node", F.least("c", "up").alias("component")), "labels")
        changed = after.join(labels.withColumnRenamed("component", "old"), "node").where("component <> old")
        if changed.isEmpty():
            return after
        labels = after


def label_propagation(nodes: DataFrame, edges: DataFrame, rounds: int = 5, parts: int | None = None) -> DataFrame:
    """(node, community): each round a node takes its neighbours' most frequent label, ties to the smallest; named by the smallest member."""
    links = written(both_ways(edges, parts), "links")
    labels = nodes.select("node", F.col("node").alias("community"))
    for _ in range(rounds):
        votes = links.join(labels, F.col("source") == F.col("node")).groupBy(F.col("target").alias("n"), "community").agg(F.count("*").alias("votes"))
        won = votes.groupBy("n").agg(F.min_by("community", F.struct((-F.col("votes")).alias("v"), "community")).alias("c"))
        labels = written(labels.join(won, F.col("node") == F.col("n"), "left").select("node", F.coalesce("c", "community").alias("community")), "labels")
    names = labels.groupBy("community").agg(F.min("node").alias("name"))
    return labels.join(names, "community").select("node", F.col("name").alias("community"))


def isolate_candidates(entities: DataFrame, relations: DataFrame, evidences: DataFrame, sources: DataFrame, most_name: int = 120) -> tuple[DataFrame, ...]:
    """Checked (entities, relations, evidences, rejections).

    entities (id, source_id, name), relations (id, source_entity, target_entity,
    evidence_ids), evidences (id, source_id, entity_id, relation_id, quote),
    sources (source_id, text). All copies of a repeated id are rejected; a quote
    must stand in its source; an evidence has exactly one owner; a relation needs
    an evidence that names it back. Every rejected row has its first reason.
    """

    def once(df: DataFrame) -> DataFrame:
        copies = df.groupBy("id").agg(F.count("*").alias("copies"))
        return df.join(copies, "id")

    known = sources.select("source_id", "text")
    e = once(entities).join(known.select("source_id", F.lit(True).alias("has_source")), "source_id", "left")
    e_reason = (
        F.when(F.col("copies") > 1, "DUPLICATE_ID")
        .when(F.col("has_source").isNull(), "UNKNOWN_SOURCE")
        .when(F.coalesce(F.length("name"), F.lit(0)) == 0, "EMPTY_NAME")
        .when(F.length("name") > most_name, "NAME_TOO_LONG")
    )
    e = e.withColumn("reason", e_reason)
    good_e = e.where("reason is null").select("id", "source_id", "name")

    ends = good_e.select("id")
    r = once(relations).join(ends.select(F.col("id").alias("source_entity"), F.lit(True).alias("a")), "source_entity", "left").join(ends.select(F.col("id").alias("target_entity"), F.lit(True).alias("b")), "target_entity", "left")
    r = r.withColumn("reason", F.when(F.col("copies") > 1, "DUPLICATE_ID").when(F.col("a").isNull() | F.col("b").isNull(), "UNKNOWN_ENDPOINT").when(F.col("source_entity") == F.col("target_entity"), "SELF_RELATION"))
    open_r = r.where("reason is null").select("id", "source_entity", "target_entity", "evidence_ids")

    v = once(evidences).join(known, "source_id", "left")
    v = v.join(ends.select(F.col("id").alias("entity_id"), F.lit(True).alias("ek")), "entity_id", "left").join(open_r.select(F.col("id").alias("relation_id"), F.lit(True).alias("rk")), "relation_id", "left")
    owners = F.col("entity_id").isNotNull().cast("int") + F.col("relation_id").isNotNull().cast("int")
    v_reason = (
        F.when(F.col("copies") > 1, "DUPLICATE_ID")
        .when(F.col("text").isNull(), "UNKNOWN_SOURCE")
        .when(owners != 1, "NOT_ONE_OWNER")
        .when(F.col("ek").isNull() & F.col("rk").isNull(), "UNKNOWN_OWNER")
        .when(~F.col("text").contains(F.col("quote")), "QUOTE_NOT_IN_SOURCE")
    )
    v = v.withColumn("reason", v_reason)
    good_v = v.where("reason is null").select("id", "source_id", "entity_id", "relation_id", "quote")

    named = open_r.select(F.col("id").alias("relation_id"), F.explode("evidence_ids").alias("id"))
    bound = named.join(good_v.select("id", "relation_id"), ["id", "relation_id"]).select(F.col("relation_id").alias("id")).distinct().withColumn("bound", F.lit(True))
    r_all = r.join(bound, "id", "left").withColumn("reason", F.coalesce("reason", F.when(F.col("bound").isNull(), "UNBOUND_EVIDENCE")))
    good_r = r_all.where("reason is null").select("id", "source_entity", "target_entity", "evidence_ids")
    rejected = e.where("reason is not null").select(F.lit("entity").alias("kind"), "id", "reason")
    rejected = rejected.unionByName(r_all.where("reason is not null").select(F.lit("relation").alias("kind"), "id", "reason"))
    rejected = rejected.unionByName(v.where("reason is not null").select(F.lit("evidence").alias("kind"), "id", "reason"))
    return good_e, good_r, good_v, rejected
