"""Exact k-means on integer vectors by kd-tree filtering.

Vectors become integers, so sums, means and distances are exact and do not
depend on partitions. Each partition's vectors are cut into blocks; a block is a
kd-tree whose nodes hold a count, integer sums and a box, and is written once.
In a round the centroids (a few rows) go down every tree together: at a node, a
centroid that is strictly farther than another one from every place of the box is
pruned, a node with one centroid left is assigned whole by its count and sums, and
vectors of leaves are compared with what is left for their leaf.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import in_batches, pick, written

COMPONENTS = 64
SCALE = 64
CLUSTERS = 16
ROUNDS = 3
#: Vectors of a tree and of a leaf.
BLOCK = 4096
LEAF = 16
#: Larger components are an error: their squared distances may not fit in a long.
LARGEST = 1 << 27

_TREES = "n int, ids binary, known binary, kind string, vectors binary, low binary, high binary, sums binary"


def integers(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): vectors of exactly ``components`` finite components as the integers floor(scale * x).

    Others are left out: null vectors, other lengths, null or non-finite
    components. Repeated rows and null ids stay. A component beyond LARGEST raises an error.
    """
    wide = pick(vectors, "vec_id", "embedding").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    finite = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))

    def whole(x):
        too_large = F.raise_error(F.lit(f"a component times {scale} is beyond {LARGEST}")).cast("long")
        return F.when(F.abs(x * scale) > LARGEST, too_large).otherwise(F.floor(x * scale).cast("long"))

    return wide.where((F.size("x") == components) & finite).select("vec_id", F.transform("x", whole).alias("v"))


def first_centroids(vectors: DataFrame, k: int = CLUSTERS, seed: int = 1) -> np.ndarray:
    """The ``k`` vectors with the smallest SHA-256 of ``seed:vec_id``, in that order; null ids are last, equal ids go by components."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(mark.alias("mark"), "v").orderBy(F.col("mark").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def levels(n: int, leaf: int = LEAF) -> list[np.ndarray]:
    """Bounds of a tree's nodes, level by level: node j of a level has the vectors ``bounds[j]:bounds[j + 1]``, its children are 2j and 2j + 1."""
    out = [np.array([0, n])]
    while np.diff(out[-1]).max() > leaf:
        bounds = out[-1]
        middle = (bounds[:-1] + bounds[1:] + 1) // 2
        out.append(np.append(np.stack([bounds[:-1], middle], 1).ravel(), n))
    return out


def tree_order(v: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """Order of the vectors in which each node of ``levels`` splits its vectors at the median of the widest side of their box."""
    order = np.arange(len(v))
    for bounds in levels(len(v), leaf)[:-1]:
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            own = v[order[a:b]]
            wide = np.argmax(own.max(0) - own.min(0))
            order[a:b] = order[a:b][np.argpartition(own[:, wide], (b - a + 1) // 2 - 1)]
    return order


def _small(v: np.ndarray) -> np.ndarray:
    """The same integers in as few bytes as hold them."""
    for kind in (np.int8, np.int16, np.int32):
        if v.min() >= np.iinfo(kind).min and v.max() <= np.iinfo(kind).max:
            return v.astype(kind)
    return v


def _planted(components: int):
    def tree(ids: np.ndarray, known: np.ndarray, v: np.ndarray) -> tuple:
        order = tree_order(v)
        ids, known, v = ids[order], known[order], _small(v[order])
        starts = [b[:-1] for b in levels(len(v))]
        low = np.concatenate([np.minimum.reduceat(v, s) for s in starts])
        high = np.concatenate([np.maximum.reduceat(v, s) for s in starts])
        sums = np.concatenate([np.add.reduceat(v.astype(np.int64), s) for s in starts])
        return len(v), ids.tobytes(), known.tobytes(), v.dtype.str, v.tobytes(), low.tobytes(), high.tobytes(), sums.tobytes()

    def rows(trees: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.binary(), pa.binary(), pa.string()] + [pa.binary()] * 4
        names = [c.split()[0] for c in _TREES.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*trees, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            ids = batch.column("vec_id")
            known = np.array(ids.is_valid().to_numpy(zero_copy_only=False), bool)
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, components)
            held.append((ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), known, flat))
            while sum(len(x[0]) for x in held) >= BLOCK:
                every = [np.concatenate(x) for x in zip(*held, strict=True)]
                yield rows([tree(*(x[:BLOCK] for x in every))])
                held = [tuple(x[BLOCK:] for x in every)]
        every = [np.concatenate(x) for x in zip(*held, strict=True)]
        if every and len(every[0]):
            yield rows([tree(*every)])

    return run


def trees(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row per tree over the integer ``vectors`` (vec_id, v)."""
    return in_batches(vectors, _planted(components), _TREES)


def filtered(n: int, v: np.ndarray, low: np.ndarray, high: np.ndarray, centroids: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
    """(cluster of each vector, nodes assigned whole as (node, first, end, cluster)) of a tree by filtering; ties go to the smaller number."""
    k = len(centroids)
    squares = (centroids**2).sum(1)
    out = np.full(len(v), -1, np.int64)
    whole: list[tuple[int, int, int, int]] = []
    left, every, first_node = np.ones((1, k), bool), levels(n, leaf), 0
    nodes = np.zeros(1, np.int64)
    for depth, bounds in enumerate(every):
        a, b = low[first_node + nodes].astype(np.int64), high[first_node + nodes].astype(np.int64)
        # twice the squared distance from the middle of the box, less what is the same for all
        middle = np.where(left, 2 * squares - 2 * ((a + b) @ centroids.T), np.iinfo(np.int64).max)
        best = middle.argmin(1)
        apart = centroids[None] - centroids[best][:, None]
        nearest_place = np.maximum(apart * a[:, None], apart * b[:, None]).sum(2)
        left &= squares[None] - squares[best][:, None] - 2 * nearest_place <= 0  # the others are farther from all of the box
        alone = left.sum(1) == 1
        for node, c in zip(nodes[alone], left[alone].argmax(1), strict=True):
            whole.append((first_node + int(node), int(bounds[node]), int(bounds[node + 1]), int(c)))
            out[bounds[node] : bounds[node + 1]] = c
        first_node += len(bounds) - 1
        nodes, left = nodes[~alone], left[~alone]
        if depth + 1 < len(every):
            nodes, left = np.repeat(2 * nodes, 2) + np.tile([0, 1], len(nodes)), np.repeat(left, 2, axis=0)
        elif len(nodes):
            sizes = bounds[nodes + 1] - bounds[nodes]
            rows = np.concatenate([np.arange(bounds[x], bounds[x + 1]) for x in nodes])
            far = np.where(np.repeat(left, sizes, axis=0), squares - 2 * _products(v[rows], centroids), np.iinfo(np.int64).max)
            out[rows] = far.argmin(1)
    return out, whole


def _products(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact inner products; in floating point where no sum can leave its exact range."""
    largest = max(abs(int(x)) for m in (v, centroids) for x in (m.min(), m.max()))
    if largest**2 * v.shape[1] < 1 << 52:
        return (v.astype(np.float64) @ centroids.T.astype(np.float64)).astype(np.int64)
    return v.astype(np.int64) @ centroids.T


def _arrays(row: dict, components: int) -> tuple:
    v, low, high = (np.frombuffer(row[c], row["kind"]).reshape(-1, components) for c in ("vectors", "low", "high"))
    return v, low, high, np.frombuffer(row["sums"], np.int64).reshape(-1, components)


def _distances(v: np.ndarray, centroids: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    return ((v.astype(np.int64) - centroids[cluster]) ** 2).sum(1)


def _round(centroids: np.ndarray, with_distance: bool):
    k, components = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total, inertia = np.zeros(k, np.int64), np.zeros((k, components), np.int64), [0] * k
        for batch in batches:
            for row in batch.to_pylist():
                v, low, high, sums = _arrays(row, components)
                cluster, whole = filtered(row["n"], v, low, high, centroids)
                if with_distance:
                    far = _distances(v, centroids, cluster)
                    for c in np.unique(cluster):
                        inertia[c] += sum(far[cluster == c].tolist())
                count += np.bincount(cluster, minlength=k)
                single = np.ones(len(v), bool)
                for node, a, b, c in whole:
                    total[c] += sums[node]
                    single[a:b] = False
                for c in np.unique(cluster[single]):
                    total[c] += v[single & (cluster == c)].sum(0, dtype=np.int64)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array(count[used]), pa.array(total[used].tolist(), pa.list_(pa.int64())), pa.array([str(inertia[c]) for c in used], pa.string())],
            names=["cluster", "n", "sums", "inertia"],
        )

    return run


def _totals(planted: DataFrame, centroids: np.ndarray, with_distance: bool = False) -> list:
    """Count, sums and inertia of each non-empty cluster: at most as many rows as there are centroids."""
    parts = in_batches(planted, _round(centroids, with_distance), "cluster int, n long, sums array<long>, inertia string")
    sums = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(centroids.shape[1])]
    return parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum(F.col("inertia").cast("decimal(38,0)")).alias("inertia"), *sums).collect()


def centroid_hash(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in centroid).encode()).hexdigest()


def _assigned(centroids: np.ndarray, inertia: dict[int, int]):
    """Rows of the result; the figures of a cluster are at most as many as there are centroids."""
    components, hashes, total = centroids.shape[1], [centroid_hash(c) for c in centroids], sum(inertia.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                v, low, high, _ = _arrays(row, components)
                cluster, _ = filtered(row["n"], v, low, high, centroids)
                known = np.frombuffer(row["known"], bool)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.frombuffer(row["ids"], np.int64), mask=~known),
                        pa.array(cluster, pa.int32()),
                        pa.array(_distances(v, centroids, cluster)),
                        pa.array([inertia[c] for c in cluster.tolist()], pa.int64()),
                        pa.array([total] * len(v), pa.int64()),
                        pa.array([hashes[c] for c in cluster.tolist()], pa.string()),
                    ],
                    names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
                )

    return run


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, components: int = COMPONENTS, scale: int = SCALE, seed: int = 1) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that ``integers`` keeps.

    Starts at ``first_centroids``; after each round a non-empty cluster's
    centroid is the floor of its vectors' mean, an empty one's stays. Fewer vectors than ``k``
    start as many clusters. Repeated rows are vectors of their own, a null id stays null, extra
    columns are ignored; a table without a kept vector gives an empty result.
    """
    whole = written(integers(vectors, components, scale), "vectors")
    centroids = first_centroids(whole, k, seed)
    if not len(centroids):
        return whole.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    planted = written(trees(whole, components), "trees")
    for _ in range(rounds):
        moved = centroids.copy()
        for row in _totals(planted, centroids):
            moved[row["cluster"]] = [int(row[f"s{i}"]) // row["n"] for i in range(components)]
        centroids = moved
    inertia = {r["cluster"]: int(r["inertia"]) for r in _totals(planted, centroids, with_distance=True)}
    return in_batches(planted, _assigned(centroids, inertia), "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
