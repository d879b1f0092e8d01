"""Summary trees: per-document clustering level by level, parents, weighted texts.

Clustering is average linkage on cosine with a bounded cluster size. Clusters that are each other's nearest
merge in rounds: average linkage is reducible, so these are the merges that the best pair first would make, and the
strongest of them give the same clusters. A document that fits a task runs its rounds there, and looks for the nearest
of a cluster again only where a merge took it. Rounds of larger documents are joins of blocks of cluster sums, until as
few clusters are left as fit a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.graph import parts_for, written
from docloom.operators.retrieval import BATCH_BYTES, BATCH_SETTING

#: Clusters up to which the rounds of a document run in one task, over 8 MB of vectors of 64 components; larger ones give the same clusters by joins.
IN_TASK = 16_384
#: Clusters of a document among which single ones are joined in one task; in larger documents they join in waves, with the same result.
JOINED_IN_TASK = 16_384
#: Clusters of a block about; products of two blocks are taken at once.
BLOCK = 1024
#: Rows of products that a task holds at once, parts that the blocks of a document are dealt to, and items of a partition about.
ROWS, PARTS_OF_GROUP, PART_ITEMS = 128, 16, 256


def linkage_merges(total: np.ndarray, n: np.ndarray, need: int | None = None) -> tuple[np.ndarray, ...]:
    """(cluster, other, score, round) of merges of clusters (sums ``total`` of ``n`` rows each): ``other`` goes into the smaller ``cluster``.

    In each round, pairs that are each other's nearest merge; of equally near ones the smallest is the nearest. Rounds
    end when no later merge can be among the ``need`` strongest, or when one cluster is left.
    """
    total, n, names = np.array(total, float), np.array(n, float), np.arange(len(n))
    mean = total / n[:, None]
    other, score, gone = np.zeros(len(n), np.int64), np.full(len(n), -np.inf), np.zeros(0, np.int64)
    made, strong, left, k = [], np.zeros(0), len(n), 0

    def look(rows: np.ndarray, tell: bool) -> None:
        """Nearest of ``rows``; if asked for, the others learn how near these are."""
        for part in (rows[at : at + ROWS] for at in range(0, len(rows), ROWS)):
            grid = np.round(mean[part] @ mean.T, 12)
            grid[:, gone] = -np.inf
            grid[np.arange(len(part)), part] = -np.inf
            other[part] = grid.argmax(1)
            score[part] = grid[np.arange(len(part)), other[part]]
            if tell:
                best = grid.argmax(0)
                value, best = grid[best, np.arange(len(names))], part[best]
                nearer = (value > score) | ((value == score) & (best < other) & (value > -np.inf))
                other[nearer], score[nearer] = best[nearer], value[nearer]

    if left > 1 and need != 0:
        look(names, False)
    while left > 1 and (need is None or (strong > score.max()).sum() < need):
        rows = np.arange(len(names))
        first = np.flatnonzero((other[other] == rows) & (rows < other) & (score > -np.inf))
        if not len(first):  # the last digit of a product may depend on the side it is seen from
            best = int(score.argmax())
            first, second = np.array([min(best, other[best])]), np.array([max(best, other[best])])
        else:
            second = other[first]
        made.append((names[first], names[second], score[first], np.full(len(first), k)))
        strong, left, k = np.append(strong, score[first]), left - len(first), k + 1
        total[first] += total[second]
        n[first] += n[second]
        mean[first] = total[first] / n[first, None]
        hit, into = np.zeros(len(names), bool), rows
        hit[first] = hit[second] = True
        into[second] = first
        lost, before = hit[other] & ~hit, score.copy()
        other = into[other]
        score[hit | lost] = -np.inf
        gone = np.append(gone, second)
        look(first, True)
        # a cluster whose nearest has merged keeps it if it is as near as before, as no merge comes nearer than its parts
        look(np.flatnonzero(lost & (score < before)), False)
        if 8 * len(gone) > len(names):
            keep = np.ones(len(names), bool)
            keep[gone] = False
            other = (np.cumsum(keep) - 1)[other[keep]]
            total, n, mean, names, score, gone = total[keep], n[keep], mean[keep], names[keep], score[keep], gone[:0]
    columns = zip(*made, strict=True) if made else [[np.zeros(0, np.int64)]] * 2 + [[np.zeros(0)], [np.zeros(0, np.int64)]]
    return tuple(np.concatenate(c) for c in columns)


def average_linkage(unit: np.ndarray, target: int) -> list[list[int]]:
    """``target`` clusters of rows of ``unit`` by merging the pair with the highest mean similarity; ties to the lowest indexes."""
    need = max(0, len(unit) - max(1, target))
    cluster, other, score, turn = linkage_merges(unit, np.ones(len(unit)), need)
    strongest = np.lexsort((turn, cluster, -score))[:need]
    up = np.arange(len(unit))
    up[other[strongest]] = cluster[strongest]
    while (up[up] != up).any():
        up = up[up]
    order = np.argsort(up, kind="stable")
    return [part.tolist() for part in np.split(order, np.flatnonzero(np.diff(up[order])) + 1)] if len(unit) else []


def single_joins(n: np.ndarray, total: np.ndarray, most: int) -> list[tuple[int, int]]:
    """(cluster, other) joins of single clusters, in their order, to the nearest with room; ``other`` goes into the smaller ``cluster``."""
    n, total, out = n.copy(), np.array(total, float), []
    for s in np.flatnonzero(n == 1):
        room = (n > 0) & (n < most)
        room[s] = False
        if n[s] != 1 or not room.any():
            continue
        score = np.where(room, np.round(total @ total[s] / np.maximum(n, 1), 12), -np.inf)
        best = int(score.argmax())
        a, b = int(min(s, best)), int(max(s, best))
        out.append((a, b))
        n[a], total[a], n[b] = n[a] + n[b], total[a] + total[b], 0
    return out


def bounded_clusters(unit: np.ndarray, most: int) -> list[list[int]]:
    """Clusters of at most ``most`` rows: as few as fit, oversize ones split again, single ones joined, in their order, to the nearest with room."""
    clusters = oversize_split(unit, most)
    for a, b in single_joins(np.array([len(c) for c in clusters], np.int64), np.array([unit[c].sum(0) for c in clusters]), most):
        clusters[a], clusters[b] = clusters[a] + clusters[b], []
    return sorted(sorted(c) for c in clusters if c)


def _packed(clusters: DataFrame, name: str) -> DataFrame:
    """Rows of (group, cluster, n, total) as blocks (group, block, blocks) of about BLOCK; a block is one row."""
    counts = clusters.groupBy("group").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    dealt = clusters.join(counts, "group").withColumn("block", F.pmod(F.xxhash64("cluster"), F.col("blocks")))
    return dealt.groupBy("group", "block", "blocks").agg(F.collect_list(F.struct("cluster", "n", "total")).alias(name))


def _members(rows: pa.StructScalar) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, mean vector) of a block, in the order of clusters."""
    rows = rows.values
    cluster, n = rows.field("cluster").to_numpy(), rows.field("n").to_numpy()
    total = rows.field("total").flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
    order = np.argsort(cluster)
    return cluster[order], total[order] / n[order, None]


def _local_best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for group, left, right in zip(*(batch.column(c) for c in ("group", "left", "right")), strict=True):
            (a, x), (b, y) = _members(left), _members(right)
            mean = np.round(x @ y.T, 12)
            mean[a[:, None] == b[None]] = -np.inf
            at = mean.argmax(1)  # of equal ones the first, so the smallest cluster
            score = mean[np.arange(len(a)), at]
            found = np.isfinite(score)
            yield pa.RecordBatch.from_arrays(
                [pa.array([group.as_py()] * int(found.sum()), pa.string()), pa.array(a[found]), pa.array(b[at[found]]), pa.array(score[found])], names=["group", "cluster", "other", "score"]
            )


def nearest_clusters(left: DataFrame, right: DataFrame) -> DataFrame:
    """(group, cluster, other, score): for each cluster of ``left`` (group, cluster, n, total) the one of ``right`` in its group with the highest mean similarity.

    It is not the cluster itself; of equal ones it is the smallest. Blocks keep only their best, so pairs are never listed.
    Blocks of ``left`` are dealt to parts, each of which meets all blocks of ``right``, so that no task has a whole group's pairs.
    """
    conf = left.sparkSession.conf
    if conf.get(BATCH_SETTING, None) is None:
        conf.set(BATCH_SETTING, BATCH_BYTES)
    parts = max(int(conf.get("spark.sql.shuffle.partitions")), 4 * PARTS_OF_GROUP)
    ours = _packed(left, "left").select("group", F.pmod("block", F.lit(PARTS_OF_GROUP)).alias("part"), "left")
    # a group of few blocks on the left has as few parts
    met = ours.groupBy("group").agg(F.collect_set("part").alias("met"))
    theirs = _packed(right, "right").join(met, "group").select("group", F.explode("met").alias("part"), "right")
    pairs = ours.repartition(parts, "group", "part").join(theirs.repartition(parts, "group", "part").hint("merge"), ["group", "part"])
    found = pairs.mapInArrow(_local_best, "group string, cluster long, other long, score double")
    best = F.min(F.struct((-F.col("score")).alias("less"), "other")).alias("best")
    return found.groupBy("group", "cluster").agg(best).select("group", "cluster", F.col("best.other").alias("other"), (-F.col("best.less")).alias("score"))


def _added(left: str, right: str):
    return F.zip_with(left, right, lambda x, y: x + y)


def _copies(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clusters (group, cluster, n, total), merges) of items (group, cluster, total): copies of a unit vector are one cluster, as nothing is nearer.

    By rounds each copy would take one of its own. Vectors of zeros are no nearer to each other than to any, and stay apart.
    """
    apart = F.when(~F.exists("total", lambda x: x != 0), F.col("cluster"))
    kinds = written(items.groupBy("group", "total", apart.alias("apart")).agg(F.min("cluster").alias("first"), F.count("*").alias("n")), "kinds")
    clusters = kinds.select("group", F.col("first").alias("cluster"), "n", F.transform("total", lambda x: x * F.col("n")).alias("total"))
    several = kinds.where("n > 1").select("group", "total", "first")
    merges = items.join(several, ["group", "total"]).where("cluster > first")
    return clusters, merges.select("group", F.col("first").alias("cluster"), F.col("cluster").alias("other"), F.lit(1.0).alias("score"), F.lit(-1).alias("round"))


def _finished(clusters: DataFrame, turn: int) -> DataFrame:
    """(group, cluster, other, score, round) of all merges of groups of clusters that fit a task, from round ``turn`` on."""

    def run(key, frame):
        frame = frame.sort_values("cluster").reset_index(drop=True)
        ids = frame["cluster"].to_numpy()
        cluster, other, score, rounds = linkage_merges(np.array(frame["total"].tolist(), float), frame["n"].to_numpy())
        return pd.DataFrame({"group": key[0], "cluster": ids[cluster], "other": ids[other], "score": score, "round": (rounds + turn).astype("int32")})

    return clusters.repartition(parts_for(clusters, PART_ITEMS), "group").groupBy("group").applyInPandas(run, "group string, cluster long, other long, score double, round int")


def merges_of(items: DataFrame, most: int, in_task: int | None = None) -> DataFrame:
    """(group, cluster, other, score, round) of merges of items (group, cluster, total): ``other`` goes into the smaller ``cluster``.

    In each round, pairs that are each other's nearest merge. A group is left when no later merge can be among
    the strongest that leave one cluster for each ``most`` items; what fits a task is merged to the end there.
    """
    in_task = IN_TASK if in_task is None else in_task
    now, copies = (written(x, "clusters") for x in _copies(items))
    need = written(items.groupBy("group").agg((F.count("*") - F.ceil(F.count("*") / most)).alias("need")), "need")
    done, k = copies, 0
    while True:
        fit = written(now.groupBy("group").agg(F.count("*").alias("n")).where(F.col("n") <= in_task).select("group"), "fit")
        if not fit.isEmpty():
            done = done.unionByName(written(_finished(now.join(fit, "group", "left_semi"), k), "merges"))
            now = written(now.join(fit, "group", "left_anti"), "clusters")
        if now.isEmpty():
            return done
        best = written(nearest_clusters(now, now), "nearest")
        # merges to come are no stronger than the best pair of now
        top = best.groupBy("group").agg(F.max("score").alias("top"))
        strong = done.join(top, "group").where("score > top").groupBy("group").agg(F.count("*").alias("strong"))
        ready = strong.join(need, "group").where("strong >= need").select("group")
        best = best.join(written(ready, "ready"), "group", "left_anti")
        back = best.select("group", F.col("other").alias("cluster"), F.col("cluster").alias("other"))
        pairs = written(best.where("cluster < other").join(back, ["group", "cluster", "other"]).select("group", "cluster", "other", "score", F.lit(k).alias("round")), "merges")
        if pairs.isEmpty():
            return done
        done, k = done.unionByName(pairs), k + 1
        gone = pairs.select("group", F.col("other").alias("cluster"))
        absorbed = pairs.select("group", "cluster", "other").join(now.select("group", F.col("cluster").alias("other"), F.col("n").alias("m"), F.col("total").alias("more")), ["group", "other"]).drop("other")
        live = now.join(best.select("group").distinct(), "group", "left_semi").join(gone, ["group", "cluster"], "left_anti").join(absorbed, ["group", "cluster"], "left")
        now = written(
            live.select("group", "cluster", (F.col("n") + F.coalesce("m", F.lit(0))).alias("n"), F.when(F.col("more").isNotNull(), _added("total", "more")).otherwise(F.col("total")).alias("total")), "clusters"
        )


def _cut(items: DataFrame, most: int, in_task: int | None = None) -> DataFrame:
    """(group, item, cluster) of items (group, item, unit): average linkage into one cluster for each ``most`` items."""
    named = items.select("group", F.col("item").alias("cluster"), F.col("unit").alias("total"))
    need = named.groupBy("group").agg((F.count("*") - F.ceil(F.count("*") / most)).alias("need"))
    place = F.row_number().over(Window.partitionBy("group").orderBy(F.desc("score"), "cluster", "round", "other"))
    kept = merges_of(named, most, in_task).withColumn("place", place).join(need, "group").where("place <= need")
    # an absorbed cluster points to what took it in, and that to what took this in
    up = written(items.select("group", "item").join(kept.select("group", F.col("other").alias("item"), "cluster"), ["group", "item"], "left").select("group", "item", F.coalesce("cluster", "item").alias("cluster")), "up")
    while True:
        above = up.select("group", F.col("item").alias("cluster"), F.col("cluster").alias("above"))
        after = written(up.join(above, ["group", "cluster"]).select("group", "item", F.col("above").alias("cluster"), (F.col("above") != F.col("cluster")).alias("moved")), "up")
        if after.where("moved").isEmpty():
            return after.drop("moved")
        up = after.drop("moved")


def _in_task(items: DataFrame, most: int, singles: bool) -> DataFrame:
    """(group, item, cluster) of groups that fit a task; a cluster is named by its smallest item."""

    def run(key, frame):
        frame = frame.sort_values("item").reset_index(drop=True)
        unit, ids, label = np.array(frame["unit"].tolist(), float), frame["item"].to_numpy(), frame["item"].to_numpy().copy()
        for rows in bounded_clusters(unit, most) if singles else oversize_split(unit, most):
            label[rows] = ids[rows].min()
        return frame.assign(cluster=label)[["group", "item", "cluster"]]

    # a group is a short row of vectors whose linkage takes long: groups are dealt out, as all of them may be few bytes
    return items.repartition(parts_for(items, PART_ITEMS), "group").groupBy("group").applyInPandas(run, "group string, item long, cluster long")


def _single_joined(clusters: DataFrame, most: int) -> DataFrame:
    """The same joins (group, cluster, other) in waves, as if one after another; None where there are none.

    A single cluster waits if an earlier one has the same nearest or wants to join it, or if its nearest is an
    earlier single one: these go first. All before the first that waits join at once, as they do not change each other's nearest.
    """
    now = written(clusters.select("group", "cluster", "n", "total"), "singles")
    joins = None
    while True:
        lone = now.where("n = 1")
        best = written(nearest_clusters(lone, now.where(F.col("n") < most)), "nearest")
        if best.isEmpty():
            return joins
        first = best.groupBy("group", "other").agg(F.min("cluster").alias("first"))
        ready = best.join(first, ["group", "other"]).where("cluster = first")
        wooed = first.select("group", F.col("other").alias("cluster"), F.col("first").alias("by"))
        earlier = best.select("group", F.col("cluster").alias("other"), F.lit(True).alias("single"))
        ready = ready.join(wooed, ["group", "cluster"], "left").join(earlier, ["group", "other"], "left")
        ready = ready.where("(by is null or by > cluster) and (single is null or other > cluster)").select("group", "cluster", "other")
        # one that has to wait may yet choose anything, so those after it wait too
        waits = best.join(ready.select("group", "cluster"), ["group", "cluster"], "left_anti").groupBy("group").agg(F.min("cluster").alias("waits"))
        ready = ready.join(waits, "group", "left").where("waits is null or cluster < waits")
        # the joined cluster keeps the smaller name
        ready = written(ready.select("group", F.least("cluster", "other").alias("cluster"), F.greatest("cluster", "other").alias("other")), "joins")
        joins = ready if joins is None else joins.unionByName(ready)
        more = ready.join(now.select("group", F.col("cluster").alias("other"), F.col("n").alias("m"), F.col("total").alias("more")), ["group", "other"])
        left = now.join(more.select("group", F.col("other").alias("cluster")), ["group", "cluster"], "left_anti").join(more.drop("other"), ["group", "cluster"], "left")
        now = written(left.select("group", "cluster", (F.col("n") + F.coalesce("m", F.lit(0))).alias("n"), F.when(F.col("more").isNotNull(), _added("total", "more")).otherwise(F.col("total")).alias("total")), "singles")


def _joined_in_task(clusters: DataFrame, most: int) -> DataFrame:
    """(group, cluster, other) joins of single clusters in their order; ``other`` goes into the smaller ``cluster``."""

    def run(key, frame):
        frame = frame.sort_values("cluster").reset_index(drop=True)
        ids = frame["cluster"].to_numpy()
        joins = single_joins(frame["n"].to_numpy(), np.array(frame["total"].tolist(), float), most)
        return pd.DataFrame([(key[0], int(ids[a]), int(ids[b])) for a, b in joins], columns=["group", "cluster", "other"])

    return clusters.groupBy("group").applyInPandas(run, "group string, cluster long, other long")


def oversize_split(unit: np.ndarray, most: int) -> list[list[int]]:
    """Clusters of at most ``most`` rows, single ones included."""

    def split(rows: list[int]) -> list[list[int]]:
        found = [[rows[k] for k in c] for c in average_linkage(unit[rows], math.ceil(len(rows) / most))]
        return [d for c in found for d in (split(c) if len(c) > most and len(c) < len(rows) else [c[k : k + most] for k in range(0, len(c), most)])]

    return sorted(split(list(range(len(unit)))), key=min) if len(unit) else []


def cluster_level(items: DataFrame, most: int = 6, in_task: int | None = None) -> DataFrame:
    """(doc, item, cluster) of items (doc, item, vector); a cluster is named by its smallest item.

    As few clusters as ``most`` items each allow; oversize ones are split again, then single ones join, in their order, the nearest with room.
    """
    in_task = max(most, IN_TASK if in_task is None else in_task)
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda t, x: t + x * x))
    unit = F.when(length > 0, F.transform("vector", lambda x: x / length)).otherwise(F.col("vector"))
    rows = written(items.select(F.col("doc").cast("string").alias("group"), F.col("item").cast("long").alias("item"), unit.alias("unit")), "items")
    sizes = rows.groupBy("group").agg(F.count("*").alias("n"))
    big = written(sizes.where(F.col("n") > in_task).select("group"), "big")
    done = _in_task(rows.join(big, "group", "left_anti"), most, True)
    if big.isEmpty():
        return done.select(F.col("group").cast("long").alias("doc"), "item", "cluster")
    large = rows.join(big, "group", "left_semi")
    open_items, settled = large, None  # a group under work is a document, or a part of it that is still too large
    while True:
        found = written(open_items.join(_cut(open_items, most, in_task), ["group", "item"]).select("group", "item", "unit", "cluster"), "parts")
        counts = found.groupBy("group", "cluster").agg(F.count("*").alias("n"))
        sized = found.join(counts, ["group", "cluster"])
        inner = F.concat_ws("/", "group", F.col("cluster").cast("string"))
        fit = sized.where(F.col("n") <= most).select(F.split("group", "/")[0].alias("group"), "item", "cluster")
        mid = sized.where((F.col("n") > most) & (F.col("n") <= in_task)).select(inner.alias("group"), "item", "unit")
        mid = _in_task(mid, most, False).select(F.split("group", "/")[0].alias("group"), "item", "cluster")
        part = written(fit.unionByName(mid), "settled")
        settled = part if settled is None else settled.unionByName(part)
        open_items = written(sized.where(F.col("n") > in_task).select(inner.alias("group"), "item", "unit"), "open")
        if open_items.isEmpty():
            break
    named = settled.join(large, ["group", "item"])
    each = named.select("group", "cluster", F.posexplode("unit").alias("k", "x")).groupBy("group", "cluster", "k").agg(F.sum("x").alias("x"), F.count("*").alias("n"))
    totals = each.groupBy("group", "cluster").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("total"))
    totals = written(totals, "totals")
    few = totals.groupBy("group").count().where(F.col("count") <= JOINED_IN_TASK).select("group")
    joins = _joined_in_task(totals.join(few, "group", "left_semi"), most)
    waves = _single_joined(totals.join(few, "group", "left_anti"), most)
    joins = written(joins if waves is None else joins.unionByName(waves), "joins")
    if not joins.isEmpty():
        up = written(settled.select("group", "cluster").distinct().join(joins.select("group", F.col("other").alias("cluster"), F.col("cluster").alias("into")), ["group", "cluster"], "left").select("group", "cluster", F.coalesce("into", "cluster").alias("into")), "joined")
        while True:
            above = up.select("group", F.col("cluster").alias("into"), F.col("into").alias("above"))
            after = written(up.join(above, ["group", "into"]).select("group", "cluster", F.col("above").alias("into"), (F.col("above") != F.col("into")).alias("moved")), "joined")
            up = after.drop("moved")
            if after.where("moved").isEmpty():
                break
        settled = settled.join(up, ["group", "cluster"]).select("group", "item", F.col("into").alias("cluster"))
    return done.unionByName(settled.select("group", "item", "cluster")).select(F.col("group").cast("long").alias("doc"), "item", "cluster")


def build_tree(items: DataFrame, most: int = 6, levels: int = 3) -> DataFrame:
    """(doc, level, node, parent, n_leaves, vector): leaves at level 0, then one row per cluster, until a document has one node left.

    A level's vectors are the means of its members. Each level is a written
    table, so that its plan does not grow with the number of levels.
    """
    now = items.select("doc", F.col("item").alias("node"), "vector", F.lit(1).cast("long").alias("n_leaves"))
    done = None
    for level in range(levels + 1):
        now = written(now, "level")
        counts = now.groupBy("doc").agg(F.count("*").alias("n"))
        open_docs = counts.where("n > 1").select("doc")
        if level == levels or open_docs.isEmpty():
            rows = now.select("doc", F.lit(level).alias("level"), "node", F.lit(None).cast("long").alias("parent"), "n_leaves", "vector")
            return rows if done is None else done.unionByName(rows)
        climbing = now.join(open_docs, "doc")
        clusters = written(cluster_level(climbing.select("doc", F.col("node").alias("item"), "vector"), most), "clusters").withColumnRenamed("item", "node")
        joined = now.join(clusters, ["doc", "node"], "left")
        rows = joined.select("doc", F.lit(level).alias("level"), "node", F.col("cluster").alias("parent"), "n_leaves", "vector")
        done = rows if done is None else done.unionByName(rows)
        parts = climbing.join(clusters, ["doc", "node"]).select("doc", "cluster", "n_leaves", F.posexplode("vector").alias("k", "x"))
        mean = parts.groupBy("doc", "cluster", "k").agg(F.avg("x").alias("x"))
        vectors = mean.groupBy("doc", "cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("vector"))
        leaves = climbing.join(clusters, ["doc", "node"]).groupBy("doc", "cluster").agg(F.sum("n_leaves").alias("n_leaves"))
        now = vectors.join(leaves, ["doc", "cluster"]).select("doc", F.col("cluster").alias("node"), "vector", "n_leaves")
    return done


# How many keywords and questions a node has, its length, and the labels of its parts.
KEYWORDS, QUESTIONS, WEIGHTED_CHARS = 12, 6, 1200
PARTS = ("标题：", "章节：", "关键词：", "摘要：", "典型问题：")


def build_nodes(items: DataFrame, level: int = 1) -> DataFrame:
    """(node, title, section_path, page_range, keywords, questions, chunk_ids, weighted) of clustered items.

    Items (node, item, title, section_path, page_range, keywords, questions,
    summary) are taken in their order. The title is the last part of the common
    section, else the most frequent title, first seen first, else the leading
    keywords. Keywords are counted before anything is collected, so a node
    gathers as many values as it has distinct ones.
    """
    from docloom.functions import text as T

    def frequent(values: DataFrame, most: int) -> DataFrame:
        counted = values.where("value <> ''").groupBy("node", "value").agg(F.count("*").alias("n"), F.min("at").alias("at"))
        best = counted.withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("n"), "at"))).where(F.col("place") <= most)
        return best.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]).alias("values"))

    at = F.struct("item", F.lit(0).alias("k"))
    titles = frequent(items.select("node", F.col("title").alias("value"), at.alias("at")), 1).select("node", F.col("values")[0].alias("common_title"))
    words = frequent(items.select("node", "item", F.posexplode("keywords").alias("k", "value")).select("node", "value", F.struct("item", "k").alias("at")), KEYWORDS)
    asked = items.select("node", "item", F.posexplode("questions").alias("k", "value")).where("value <> ''").groupBy("node", "value").agg(F.min(F.struct("item", "k")).alias("at"))
    asked = asked.withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy("at"))).where(F.col("place") <= QUESTIONS)
    asked = asked.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]).alias("asked"))
    grouped = items.groupBy("node").agg(
        F.array_sort(F.collect_set("item")).alias("chunk_ids"), F.collect_set("section_path").alias("paths"), F.collect_set("page_range").alias("ranges"), F.min_by("summary", "item").alias("summary")
    )
    none = F.expr("cast(array() as array<string>)")
    out = grouped.join(titles, "node", "left").join(words.withColumnRenamed("values", "keywords"), "node", "left").join(asked, "node", "left")
    out = out.withColumns({"keywords": F.coalesce("keywords", none), "section_path": T.common_section_path(F.col("paths")), "page_range": T.merge_page_ranges(F.col("ranges"))})
    generated = F.transform(F.slice("keywords", 1, 3), lambda w: F.concat(w, F.lit(" 的核心内容是什么？")))
    numbered = F.concat(F.lit(f"层级摘要 L{level}-"), F.col("node").cast("string"))
    title = F.when(F.col("section_path") != "", T.last_section(F.col("section_path"))).otherwise(
        F.coalesce("common_title", F.when(F.size("keywords") > 0, F.array_join(F.slice("keywords", 1, 3), "、")), numbered)
    )
    out = out.withColumns({"title": title, "questions": F.coalesce("asked", generated)})
    said = lambda k, value: F.when(value != "", F.concat(F.lit(PARTS[k]), value))
    weighted = F.concat_ws(
        "\n", F.concat(F.lit(PARTS[0]), "title"), said(1, F.col("section_path")), said(2, F.array_join("keywords", "、")), F.concat(F.lit(PARTS[3]), F.coalesce("summary", F.lit(""))), said(4, F.array_join("questions", "；"))
    )
    return out.select("node", "title", "section_path", "page_range", "keywords", "questions", "chunk_ids", F.substring(weighted, 1, WEIGHTED_CHARS).alias("weighted"))


def inner_similarity(items: DataFrame) -> DataFrame:
    """(doc, similarity): mean over clusters of two or more items of their mean pairwise cosine; items (doc, cluster, unit).

    A cluster's pairs sum to half of what its summed vector's square exceeds the
    sum of squares by, so pairs are not listed; 0 where no cluster has two items.
    """
    each = items.select("doc", "cluster", F.posexplode("unit").alias("k", "x")).groupBy("doc", "cluster", "k").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count("*").alias("n"))
    sums = each.groupBy("doc", "cluster").agg(F.max("n").alias("n"), (F.sum(F.col("s") * F.col("s")) - F.sum("q")).alias("pairs"))
    mean = F.when(F.col("n") > 1, F.col("pairs") / (F.col("n") * (F.col("n") - 1)))
    return sums.groupBy("doc").agg(F.coalesce(F.avg(mean), F.lit(0.0)).alias("similarity"))
