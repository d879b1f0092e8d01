"""Communities by modularity: parallel local moves, contraction, connected parts.

A graph is a table of links in both directions (source, target, weight), where a row
from a node to itself has twice the weight inside it. In a round the nodes of a class, drawn
by a hash of node and round, move to the neighbouring community with the largest gain in
modularity, and what others that move to the same place take from it is allowed for. A round that lowers modularity
is undone and later classes are smaller. When no node wants to move, communities become the nodes of a smaller graph.

A graph of up to HELD links is solved in one task. The links of a larger one are dealt to blocks by a hash of their
source and written once, as positions among the nodes that a block mentions. In a round a block is told the community of
each of these nodes and its size, which moves packed; it sums up its links and judges its nodes. Sizes, crowds and moves are joins and
aggregates of nodes. Weights are whole numbers, so sums are exact and the result depends neither on partitions nor on the way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.operators.graph import both_ways, components, usable_edges, written
from docloom.operators.retrieval import BATCH_BYTES, BATCH_SETTING

#: Links of a row about, where a node's links move together.
BLOCK = 1024
#: Links that a task holds at once about; a block of links is of this size.
HELD = 1 << 21
#: Labels that are packed at once.
PACKED = 1 << 16
#: Steps of a round's order among the nodes that move to one place.
STEPS = 1 << 20
BLOCK_ROWS = "block int, nodes binary, home binary, starts binary, ends binary, weights binary, strength binary, routes binary"
TOLD_ROWS = "block int, node binary, community binary, size binary"
LABEL_ROWS = "node long, community long, strength long, routes binary"


def links_of(edges: DataFrame, parts: int | None = None) -> DataFrame:
    """Undirected links (source, target, weight) of edges (source, target): repeated ones count once, edges from a node to itself do not."""
    return both_ways(edges, parts).where("source is not null and target is not null").withColumn("weight", F.lit(1).cast("long"))


def strengths(links: DataFrame) -> DataFrame:
    """(node, strength): the weight of all of a node's links, inner ones twice."""
    return links.groupBy(F.col("source").alias("node")).agg(F.sum("weight").alias("strength"))


def modularity(links: DataFrame, labels: DataFrame) -> float:
    """Share of the links' weight inside communities, less what it would be among nodes of these strengths by chance; 0 without links."""
    inside = links.join(labels.select(F.col("node").alias("source"), F.col("community").alias("a")), "source").join(labels.select(F.col("node").alias("target"), F.col("community").alias("b")), "target")
    own = inside.where("a = b").agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("w")).first()["w"]
    totals = strengths(links).join(labels, "node").groupBy("community").agg(F.sum("strength").cast("double").alias("t"))
    sums = totals.agg(F.sum("t").alias("all"), F.sum(F.col("t") * F.col("t")).alias("squares")).first()
    return float(own / sums["all"] - sums["squares"] / sums["all"] ** 2) if sums["all"] else 0.0


def packed(links: DataFrame) -> DataFrame:
    """(target, near): a node's links from others in rows of about BLOCK, written once."""
    outer = links.where("source <> target")
    counts = outer.groupBy("target").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    dealt = outer.join(counts, "target").withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")))
    return written(dealt.groupBy("target", "block").agg(F.collect_list(F.struct("source", "weight")).alias("near")).drop("block"), "near")


def _hashed(x: np.ndarray | int, seed: np.ndarray | int = 42) -> np.ndarray:
    """Spark's ``xxhash64`` of longs, or of an int, after what gave ``seed``."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turned = lambda v, n: v << np.uint64(n) | v >> np.uint64(64 - n)
    seed = np.atleast_1d(seed).astype(np.uint64)
    if isinstance(x, int):
        h = turned(seed + p5 + np.uint64(4) ^ np.array([x], np.uint64) * p1, 23) * p2 + p3
    else:
        h = turned(seed + p5 + np.uint64(8) ^ turned(x.astype(np.int64).view(np.uint64) * p2, 31) * p1, 27) * p1 + p4
    h = (h ^ h >> np.uint64(33)) * p2
    h = (h ^ h >> np.uint64(29)) * p3
    return h ^ h >> np.uint64(32)


def _firsts(keys: np.ndarray) -> np.ndarray:
    """Where in sorted ``keys`` each of them is for the first time."""
    return np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)


def _summed(of: np.ndarray, to: np.ndarray, weight: np.ndarray | None, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs (of, to) in order, each once, and the sum of their weights, 1 each where there are none; ``to`` is below ``width``."""
    keys = of.astype(np.int64) * width + to
    order = None if weight is None else np.argsort(keys)
    keys = np.sort(keys) if order is None else keys[order]
    at = _firsts(keys)
    sums = np.diff(np.r_[at, len(keys)]) if order is None else np.add.reduceat(weight[order], at) if len(at) else np.zeros(0, np.int64)
    return keys[at] // width, keys[at] % width, sums


def _judged(of: np.ndarray, to: np.ndarray, w: np.ndarray, own: np.ndarray, k: np.ndarray, size: np.ndarray, total: int) -> tuple[np.ndarray, ...]:
    """(best, worth, now, inside) of nodes in communities ``own``: the neighbouring community with the largest gain, what it and staying are worth, the links inside.

    ``of``, ``to`` and ``w`` are the summed links of nodes and communities. A node's own community counts without
    the node; among equal gains the smallest community is the best.
    """
    mine = to == own[of]
    inside = np.zeros(len(own), np.int64)
    inside[of[mine]] = w[mine]
    of, to, w = of[~mine], to[~mine], w[~mine]
    gain = np.round(w - k[of].astype(float) * size[to] / float(total), 9)
    best, worth, at = own.copy(), np.full(len(own), -np.inf), _firsts(of)
    if len(of):
        counts = np.diff(np.r_[at, len(of)])
        worth[of[at]] = np.maximum.reduceat(gain, at)
        top = np.flatnonzero(gain == np.repeat(worth[of[at]], counts))
        best[of[at]] = to[top[_firsts(of[top])]]
    return best, worth, np.round(inside - k.astype(float) * (size[own] - k) / float(total), 9), inside


class _Course:
    """The course of rounds: which labels are the best so far, and how many classes the next round has."""

    def __init__(self):
        self.best, self.q, self.first, self.classes = None, None, None, 2

    def back(self, labels, q: float) -> bool:
        """Takes the labels of a round and their modularity; whether they are worse and the round is undone."""
        if self.q is not None and q < self.q - 1e-12:
            self.classes *= 2
            return True
        self.first = q if self.first is None else self.first
        self.best, self.q = labels, q
        return False

    @property
    def better(self) -> bool:
        return self.q is not None and self.q > self.first + 1e-12


def _settled(names: np.ndarray, of: np.ndarray, to: np.ndarray, weight: np.ndarray | None, labels: np.ndarray, k: np.ndarray, loops: int, rounds: int) -> tuple[np.ndarray, bool]:
    """``settled`` in one task: nodes and labels are positions in ``names``, ``loops`` is the weight of links from a node to itself."""
    total, course = int(k.sum()), _Course()
    for turn in range(rounds if total else 0):
        size = np.bincount(labels, k, len(names)).astype(np.int64)
        best, worth, now, inside = _judged(*_summed(of, labels[to], weight, len(names)), labels, k, size, total)
        q = (int(inside.sum()) + loops) / total - float(np.square(size.astype(float)).sum()) / total**2
        if course.back(labels, q):
            labels = course.best
            continue
        wants = worth > now
        if not wants.any():
            break
        goes = wants & (_hashed(turn, _hashed(names)).view(np.int64) % course.classes == 0)
        crowd = np.bincount(best[goes], k[goes], len(names))
        ahead = _hashed(names, _hashed(turn)).view(np.int64) % STEPS / float(STEPS) * (crowd[best] - k)
        with np.errstate(invalid="ignore"):
            labels = np.where(goes & (worth - now > k * ahead / float(total)), best, labels)
    return (labels if course.best is None else course.best), course.better


def _climbed(names: np.ndarray, of: np.ndarray, to: np.ndarray, weight: np.ndarray | None, labels: np.ndarray, k: np.ndarray, loops: int, levels: int, rounds: int) -> tuple[np.ndarray, bool]:
    """Labels after rounds of nodes, then of the communities found, up to ``levels`` times."""
    labels, moved = _settled(names, of, to, weight, labels, k, loops, rounds)
    for _ in range(levels):
        up, at = np.unique(labels, return_inverse=True)
        a, b, w = _summed(at[of], at[to], weight, len(up))
        found, more = _settled(names[up], a[a != b], b[a != b], w[a != b], np.arange(len(up)), np.bincount(at, k, len(up)).astype(np.int64), loops + int(w[a == b].sum()), rounds)
        if not more:
            break
        labels, moved = up[found][at], True
    return labels, moved


def _parts(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest of ``n`` nodes that links (a, b) lead to from each."""
    low = np.arange(n)
    while len(a):
        x, y = low[a], low[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(low, up := low[low]):
            low = up
    return low


def _alone(batches: Iterator[pa.RecordBatch], passes: int, levels: int, rounds: int, cut: bool) -> Iterator[pa.RecordBatch]:
    """(node, community) of a whole graph in packed rows, its connected parts if ``cut``."""
    got = [(b.column("target").to_numpy(), b.column("near")) for b in batches if b.num_rows]
    if not got:
        return
    ends = np.concatenate([np.repeat(node, np.diff(near.offsets.to_numpy())) for node, near in got])
    source = np.concatenate([near.flatten().field("source").to_numpy() for _, near in got])
    weight = np.concatenate([near.flatten().field("weight").to_numpy() for _, near in got])
    names, of = np.unique(ends, return_inverse=True)
    to, outer = np.searchsorted(names, source), ends != source
    k, loops = np.bincount(of, weight, len(names)).astype(np.int64), int(weight[~outer].sum())
    of, to, weight = of[outer], to[outer], weight[outer]
    labels = np.arange(len(names))
    for _ in range(passes):
        labels, moved = _climbed(names, of, to, weight, labels, k, loops, levels, rounds)
        if not moved:
            break
    if cut:
        same = labels[of] == labels[to]
        labels = _parts(len(names), of[same], to[same])
    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[labels])], ["node", "community"])


def in_one_task(links: DataFrame, passes: int, levels: int, rounds: int, cut: bool) -> DataFrame:
    """(node, community) of the nodes of a graph that a task can hold; connected parts of communities if ``cut``."""
    loops = links.where("source = target").select("target", F.array(F.struct("source", "weight")).alias("near"))
    rows = packed(links).unionByName(loops)
    return written(rows.coalesce(1).mapInArrow(partial(_alone, passes=passes, levels=levels, rounds=rounds, cut=cut), "node long, community long"), "labels")


class Blocks(NamedTuple):
    """Links in ``parts`` blocks (``rows``), and ``start``: (node, community, strength, routes), each node a community of its own.

    A node is judged by the block that its hash names, where all its links are. ``routes`` are the bits of the blocks
    that mention it. ``loops`` is the weight of links from a node to itself.
    """

    rows: DataFrame
    start: DataFrame
    parts: int
    loops: int


def _ints(x, dtype=np.int64) -> np.ndarray:
    return np.frombuffer(x.as_buffer(), dtype)


def _block(of: np.ndarray, to: np.ndarray, weight: np.ndarray | None, k: np.ndarray | None, nodes: np.ndarray, home: np.ndarray, parts: int) -> pa.RecordBatch:
    """A block's row from links in order of ``of`` (positions in ``home``) and ``to`` (in ``nodes``)."""
    block = _hashed(nodes).view(np.int64) % parts
    width = -(-parts // 8)
    routes = np.zeros((len(home), width * 8), bool)
    routes[of, block[to]] = True
    routes[np.arange(len(home)), block[home]] = True
    starts = np.r_[0, np.cumsum(np.bincount(of, minlength=len(home)))]
    one = lambda x, dtype=np.int64: pa.array([None if x is None else x.astype(dtype).tobytes()], pa.binary())
    row = [pa.array([block[home[0]]], pa.int32()), one(nodes), one(home, np.int32), one(starts), one(to, np.int32), one(weight), one(k), one(np.packbits(routes, axis=1, bitorder="little"), np.uint8)]
    return pa.RecordBatch.from_arrays(row, [c.split()[0] for c in BLOCK_ROWS.split(", ")])


def _built(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """The block of the links of a partition (source, target, weight); where weights are null, repeated links count once."""
    got = [(b.column("source").to_numpy(), b.column("target").to_numpy(), b.column("weight")) for b in batches if b.num_rows]
    if not got:
        return
    source, target = np.concatenate([s for s, _, _ in got]), np.concatenate([t for _, t, _ in got])
    weight = None if got[0][2].null_count else np.concatenate([w.to_numpy() for _, _, w in got])
    del got
    nodes = np.unique(np.concatenate([np.unique(source), np.unique(target)]))
    of, to = np.searchsorted(nodes, source), np.searchsorted(nodes, target)
    del source, target
    of, to, w = _summed(of, to, weight, len(nodes))
    home, row = np.unique(of, return_inverse=True)
    k = np.bincount(row, None if weight is None else w, len(home)).astype(np.int64)
    outer = of != to
    yield _block(row[outer], to[outer], None if weight is None else w[outer], k, nodes, home, parts)


class _Held(NamedTuple):
    """A block's arrays, and the community and its size that it was told of each node: -1 of a node that is not there."""

    nodes: np.ndarray
    home: np.ndarray
    of: np.ndarray
    to: np.ndarray
    weight: np.ndarray | None
    k: np.ndarray
    routes: np.ndarray
    community: np.ndarray
    size: np.ndarray


def _met(batches: Iterator[pa.RecordBatch], work: Callable) -> Iterator[pa.RecordBatch]:
    """What ``work`` makes of the block of a partition and of what it is told."""
    row, told = None, []
    for b in batches:
        for x in b.to_struct_array():
            if x["nodes"].is_valid:
                row = x
            else:
                told.append(tuple(_ints(x[name]) for name in ("node", "community", "size")))
    if row is None:
        return
    nodes, home = _ints(row["nodes"]), _ints(row["home"], np.int32)
    community, size = np.full(len(nodes), -1, np.int64), np.zeros(len(nodes), np.int64)
    for node, its, n in told:
        at = np.minimum(np.searchsorted(nodes, node), len(nodes) - 1)
        there = nodes[at] == node
        community[at[there]], size[at[there]] = its[there], n[there]
    of = np.repeat(np.arange(len(home)), np.diff(_ints(row["starts"])))
    weight = _ints(row["weights"]) if row["weights"].is_valid else None
    yield from work(_Held(nodes, home, of, _ints(row["ends"], np.int32), weight, _ints(row["strength"]), _ints(row["routes"], np.uint8).reshape(len(home), -1), community, size))


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], list(columns))


def _bits(routes: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(routes.shape[1]), len(routes), [None, pa.py_buffer(np.ascontiguousarray(routes))]).cast(pa.binary())


def _bytes(column: pa.Array) -> np.ndarray:
    """All bytes of a binary column without nulls, one value after the other."""
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]]


def _begun(held: _Held) -> Iterator[pa.RecordBatch]:
    node = held.nodes[held.home]
    yield _batch(node=node, community=node, strength=held.k, routes=_bits(held.routes))


def _usable(held: _Held, parts: int) -> Iterator[pa.RecordBatch]:
    """The block without the links that have an end of which nothing was told, and without nodes that are left with none."""
    there = held.community >= 0
    good = there[held.home][held.of] & there[held.to]
    if good.any():
        mentioned = np.unique(np.r_[held.home[held.of[good]], held.to[good]])
        home, of = np.unique(held.home[held.of[good]], return_inverse=True)
        nodes, to = held.nodes[mentioned], np.searchsorted(mentioned, held.to[good])
        yield _block(of, to, None, np.bincount(of, minlength=len(home)), nodes, np.searchsorted(mentioned, home), parts)


def _choices(held: _Held, total: int) -> Iterator[pa.RecordBatch]:
    """A round's view of the nodes of a block: where each is and wants to be, and what both are worth."""
    names, label = np.unique(held.community, return_inverse=True)
    size = np.zeros(len(names), np.int64)
    size[label] = held.size
    own = label[held.home]
    best, worth, now, inside = _judged(*_summed(held.of, label[held.to], held.weight, len(names)), own, held.k, size, total)
    yield _batch(node=held.nodes[held.home], community=names[own], strength=held.k, routes=_bits(held.routes), to=names[best], worth=worth, now=now, inside=inside, size=size[own])


def _between(held: _Held) -> Iterator[pa.RecordBatch]:
    """Links between communities, summed up in the block; what links a node to itself is what its strength has beyond other links."""
    names, label = np.unique(held.community, return_inverse=True)
    outer = np.bincount(held.of, held.weight, len(held.home)).astype(np.int64)
    own = label[held.home]
    weight = np.ones(len(held.of), np.int64) if held.weight is None else held.weight
    a, b, w = _summed(np.r_[own[held.of], own], np.r_[label[held.to], own], np.r_[weight, held.k - outer], len(names))
    yield _batch(source=names[a], target=names[b], weight=w).filter(pa.array(w > 0))


def _within(held: _Held) -> Iterator[pa.RecordBatch]:
    """Links that hold together what the block's links inside communities hold together: from each node to the smallest that they lead to."""
    ends = held.home[held.of]
    same = held.community[ends] == held.community[held.to]
    low = _parts(len(held.nodes), ends[same], held.to[same])
    far = low != np.arange(len(low))
    yield _batch(source=held.nodes[far], target=held.nodes[low[far]], community=held.community[far])


def _spanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (source, target) that hold together what those of a partition do, up to HELD of them at once."""
    got, rows = [], 0

    def out() -> pa.RecordBatch:
        nodes, at = np.unique(np.concatenate(got, axis=1), return_inverse=True)
        low = _parts(len(nodes), *at.reshape(2, -1))
        far = low != np.arange(len(low))
        return _batch(source=nodes[far], target=nodes[low[far]])

    for b in batches:
        got.append(np.stack([b.column("source").to_numpy(), b.column("target").to_numpy()]))
        rows += b.num_rows
        if rows >= HELD:
            yield out()
            got, rows = [], 0
    if rows:
        yield out()


def _told(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Rows for the blocks that ``routes`` of labels (node, community, size, routes) name, each with many labels."""
    got, rows = [], 0

    def out() -> pa.RecordBatch:
        node, community, size = (np.concatenate([b.column(c).to_numpy() for b in got]) for c in ("node", "community", "size"))
        routes = np.concatenate([_bytes(b.column("routes")) for b in got]).reshape(rows, -1)
        bits = np.unpackbits(routes, axis=1, count=parts, bitorder="little").astype(bool)
        to = [(block, np.flatnonzero(bits[:, block])) for block in range(parts)]
        to = [(block, at) for block, at in to if len(at)]
        columns = [pa.array([x[at].tobytes() for _, at in to], pa.binary()) for x in (node, community, size)]
        return _batch(block=pa.array([block for block, _ in to], pa.int32()), **dict(zip(("node", "community", "size"), columns, strict=True)))

    for b in batches:
        got.append(b)
        rows += b.num_rows
        if rows >= PACKED:
            yield out()
            got, rows = [], 0
    if rows:
        yield out()


def _asked(rows: DataFrame, parts: int, labels: DataFrame, work: Callable, schema: str) -> DataFrame:
    """What ``work`` makes of each block, once it is told the communities of its nodes and their sizes: ``labels`` (node, community, strength, routes)."""
    sizes = labels.groupBy("community").agg(F.sum("strength").alias("size"))
    told = labels.join(sizes, "community").select("node", "community", "size", "routes").mapInArrow(partial(_told, parts=parts), TOLD_ROWS)
    return rows.unionByName(told, allowMissingColumns=True).repartitionById(parts, "block").mapInArrow(partial(_met, work=work), schema)


def dealt(links: DataFrame, n: int, nodes: DataFrame | None = None) -> Blocks:
    """``n`` links (source, target, weight), both directions of each, in blocks; where weights are null, repeated links count once, and only ones between ``nodes``."""
    conf, parts = links.sparkSession.conf, -(-n // HELD)
    if conf.get(BATCH_SETTING, None) is None:
        conf.set(BATCH_SETTING, BATCH_BYTES)
    by_hash = F.pmod(F.xxhash64("source"), F.lit(parts)).cast("int")
    rows = written(links.select("source", "target", "weight").repartitionById(parts, by_hash).mapInArrow(partial(_built, parts=parts), BLOCK_ROWS), "blocks")
    begun = lambda rows: rows.repartitionById(parts, "block").mapInArrow(partial(_met, work=_begun), LABEL_ROWS)
    if nodes is not None:
        rows = written(_asked(rows, parts, begun(rows).join(nodes, "node", "left_semi"), partial(_usable, parts=parts), BLOCK_ROWS), "blocks")
    loops = links.where("source = target").agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    return Blocks(rows, written(begun(rows), "labels"), parts, loops)


def settled(blocks: Blocks, labels: DataFrame, rounds: int) -> tuple[DataFrame, bool]:
    """(labels, whether they are better than before): rounds of local moves until no node wants to, at most ``rounds``.

    A node compares its own community, without itself, with each neighbouring
    one; it wants to go where the gain is largest, to the smallest name among equals, and to stay unless that is better. A
    node of this round's class goes if the gain outlasts those others that go to the same community and, by hash, before it.
    """
    total, course = labels.agg(F.sum("strength")).first()[0] or 0, _Course()
    for turn in range(rounds if total else 0):
        judged = _asked(blocks.rows, blocks.parts, labels, partial(_choices, total=total), f"{LABEL_ROWS}, to long, worth double, now double, inside long, size long")
        wants = F.col("worth") > F.col("now")
        goes = wants & (F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(course.classes)) == 0)
        figures = Observation()
        judged = judged.select("*", wants.alias("wants"), goes.alias("goes"))
        judged = written(judged.observe(figures, F.count_if("wants").alias("n"), F.sum("inside").alias("inside"), F.sum(F.col("strength").cast("double") * F.col("size")).alias("squares")), "judged")
        seen = figures.get
        if course.back(labels, (seen["inside"] + blocks.loops) / total - seen["squares"] / total**2):
            labels = course.best
            continue
        if not seen["n"]:
            break
        crowd = judged.where("goes").groupBy("to").agg(F.sum("strength").alias("crowd"))
        ahead = F.pmod(F.xxhash64(F.lit(turn), "node"), F.lit(STEPS)) / F.lit(float(STEPS)) * (F.coalesce("crowd", F.lit(0)) - F.col("strength"))
        lasts = F.col("worth") - F.col("now") > F.col("strength") * ahead / F.lit(float(total))
        moved = F.when(F.col("goes") & lasts, F.col("to")).otherwise(F.col("community"))
        labels = written(judged.join(crowd, "to", "left").select("node", moved.alias("community"), "strength", "routes"), "labels")
    return (labels if course.best is None else course.best), course.better


def _climb(base: Blocks, labels: DataFrame, levels: int, rounds: int) -> tuple[DataFrame, bool]:
    """Labels after rounds of nodes, then of the communities found, up to ``levels`` times; levels that a task can hold are solved in one."""
    labels, moved = settled(base, labels, rounds)
    below, found = base, labels
    for level in range(levels):
        links = _asked(below.rows, below.parts, found, _between, "source long, target long, weight long")
        links = written(links.groupBy("source", "target").agg(F.sum("weight").alias("weight")), "links")
        n = links.count()
        if small := n <= HELD:
            up = in_one_task(links, 1, levels - level - 1, rounds, False)
            more = not up.where("node <> community").isEmpty()
        else:
            below = dealt(links, n)
            found, more = settled(below, below.start, rounds)
            up = found
        if not more:
            break
        moved = True
        up = up.select(F.col("node").alias("community"), F.col("community").alias("above"))
        labels = written(labels.join(up, "community").select("node", F.col("above").alias("community"), "strength", "routes"), "labels")
        if small:
            break
    return labels, moved


def _cut(base: Blocks, labels: DataFrame) -> DataFrame:
    """(node, community): the connected parts of communities. Blocks, then pieces of communities, keep only the links that hold them together."""
    inside = written(_asked(base.rows, base.parts, labels, _within, "source long, target long, community long"), "inside")
    pieces = inside.groupBy("community").agg(F.ceil(F.count("*") / HELD).alias("pieces"))
    inside = inside.join(pieces, "community").repartition("community", F.pmod(F.xxhash64("source"), F.col("pieces")))
    inside = written(inside.select("source", "target").mapInArrow(_spanned, "source long, target long"), "inside")
    return components(labels.select("node"), inside).select("node", F.col("component").alias("community"))


def _numbered(nodes: DataFrame, edges: DataFrame, **how) -> DataFrame:
    """``communities`` of nodes of any type that has an order, which are numbered by it."""
    pairs = nodes.sort("node").rdd.zipWithIndex().map(lambda x: (x[0][0], x[1]))
    numbers = written(nodes.sparkSession.createDataFrame(pairs, T.StructType([nodes.schema["node"], T.StructField("number", T.LongType())])), "numbers")
    of = lambda name: numbers.select(F.col("node").alias(name), F.col("number").alias(f"{name}_number"))
    ends = edges.join(of("source"), "source").join(of("target"), "target").select(F.col("source_number").alias("source"), F.col("target_number").alias("target"))
    found = communities(numbers.select(F.col("number").alias("node")), ends, **how)
    named = found.select(F.col("node").alias("number"), F.col("community").alias("other"))
    return named.join(numbers, "number").join(numbers.select(F.col("number").alias("other"), F.col("node").alias("community")), "other").select("node", "community")


def communities(nodes: DataFrame, edges: DataFrame, passes: int = 1, levels: int = 6, rounds: int = 20, parts: int | None = None) -> DataFrame:
    """(node, community) of all ``nodes`` (node), named by the community's smallest node.

    A pass moves nodes, contracts communities and moves these, until nothing
    moves; the next pass begins with the nodes in the communities found. At last, communities
    are cut into their connected parts, which never costs modularity. Edges with an end that is no node, null ends and loops do
    not count; a node without a link is a community of its own; repeated nodes count once.
    """
    nodes = nodes.select("node").where("node is not null").distinct()
    if nodes.schema["node"].dataType != T.LongType():
        return _numbered(nodes, edges, passes=passes, levels=levels, rounds=rounds, parts=parts)
    edges = written(edges.where("source <> target").select(F.col("source").cast("long").alias("source"), F.col("target").cast("long").alias("target")), "edges")
    n = 2 * edges.count()
    if n <= HELD:
        done = in_one_task(written(links_of(usable_edges(edges, nodes), parts), "links"), passes, levels, rounds, True)
    else:
        ends = F.array(F.struct("source", "target"), F.struct(F.col("target").alias("source"), F.col("source").alias("target")))
        both = edges.select(F.explode(ends).alias("e")).select("e.source", "e.target", F.lit(None).cast("long").alias("weight"))
        base = dealt(both, n, nodes)
        labels = base.start
        for _ in range(passes):
            labels, moved = _climb(base, labels, levels, rounds)
            if not moved:
                break
        done = _cut(base, labels)
    alone = nodes.join(done, "node", "left_anti").select("node", F.col("node").alias("community"))
    return done.unionByName(alone)
