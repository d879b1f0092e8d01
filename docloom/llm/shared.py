"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_DIR: dict[str, str] = {}
_worker_state: dict[str, dict] = {}
#: Bytes of an Arrow batch that a Python worker gets at once; a longer row comes alone.
BATCH_BYTES = "6m"


def worker_state(operator: str) -> dict:
    """What tasks of one operator keep in a Python worker between them.

    Workers serve one operator after another; what an earlier one has kept is let
    go first, so that its memory does not add up with that of the next.
    """
    if operator not in _worker_state:
        if _worker_state:
            _worker_state.clear()
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # only the GNU library keeps freed memory and has a call for it
                ctypes.CDLL("libc.so.6").malloc_trim(0)
        _worker_state[operator] = {}
    return _worker_state[operator]


class WordMemory:
    """What a Python worker remembers of the words it has seen: at most two generations of about ``most_bytes`` each.

    A full young generation becomes the old one; of the old one only words that
    are asked for again move on, so frequent words stay and rare ones go.
    """

    ENTRY_BYTES = 180

    def __init__(self, most_bytes: int):
        self.most_bytes, self.young, self.old, self.young_bytes = most_bytes, {}, {}, 0

    def known(self, words: set[str]) -> dict:
        """Those of ``words`` that are remembered, with their values."""
        young, old = self.young, self.old
        found = {w: young[w] for w in words if w in young}
        again = {w: old[w] for w in words if w in old and w not in found}
        if again:
            self.add(again)
        return found | again

    def missing(self, words: set[str]) -> set[str]:
        """Those of ``words`` that are not remembered; all others are in ``young`` until the next call, however many are added."""
        if self.young_bytes > self.most_bytes:
            self.old, self.young, self.young_bytes = self.young, {}, 0
        fresh = words.difference(self.young)
        if self.old:
            again = {w: self.old[w] for w in fresh if w in self.old}
            self.put(again)
            fresh.difference_update(again)
        return fresh

    def put(self, fresh: dict) -> None:
        """Remembers words without a change of generations."""
        self.young.update(fresh)
        held = sum(map(len, fresh.values())) if isinstance(next(iter(fresh.values()), None), bytes) else 0
        self.young_bytes += sum(map(len, fresh)) + held + self.ENTRY_BYTES * len(fresh)

    def add(self, fresh: dict) -> None:
        self.put(fresh)
        if self.young_bytes > self.most_bytes:
            self.old, self.young, self.young_bytes = self.young, {}, 0


def in_batches(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``df.mapInArrow(run, schema)`` with batches bounded by BATCH_BYTES, however long the texts are.

    The bound is a session setting, made only where the session has none.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name, None) is None:
        conf.set(name, BATCH_BYTES)
    return df.mapInArrow(run, schema)


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and every executor can read: ``spark.checkpoint.dir``.

    A private folder is used only where that setting is missing and the session
    runs on this machine alone, as in tests.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIR:
        _LOCAL_DIR[app] = "file://" + tempfile.mkdtemp(prefix="docloom-")
    return _LOCAL_DIR[app]


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a table in the shared folder, so that lineage ends there and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns of any name cannot clash; a missing one is null text."""
    have = set(df.columns)
    return df.select(*[F.col(f"`{n}`") if n in have else F.lit(None).cast("string").alias(n) for n in names])


def with_keys(df: DataFrame, *keys: Column) -> tuple[DataFrame, list[str]]:
    """``df`` and after its own columns the keys, under names that it does not have yet; these names."""
    taken, names = {c.lower() for c in df.columns}, []
    for k in range(len(keys)):
        name = f"key_{k}"
        while name in taken:
            name += "_"
        taken.add(name)
        names.append(name)
    return df.withColumns(dict(zip(names, keys, strict=True))), names


def running(items: Column, element: Callable, advance: Callable, of_type: str) -> Column:
    """Array of ``element(at, x)`` for each x of ``items``; ``at`` starts at 0 and becomes ``advance(at, x)``.

    Elements are gathered in blocks, so that a very long array is not copied for each of them.
    """
    block = 256
    start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<array<{of_type}>>)").alias("blocks"), F.expr(f"cast(array() as array<{of_type}>)").alias("tail"))

    def step(acc: Column, x: Column) -> Column:
        full, one = F.size(acc["tail"]) >= block, element(acc["at"], x)
        return F.struct(
            advance(acc["at"], x).cast("int").alias("at"),
            F.when(full, F.array_append(acc["blocks"], acc["tail"])).otherwise(acc["blocks"]).alias("blocks"),
            F.when(full, F.array(one)).otherwise(F.array_append(acc["tail"], one)).alias("tail"),
        )

    return F.aggregate(items, start, step, lambda acc: F.flatten(F.array_append(acc["blocks"], acc["tail"])))


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """(node, component) for undirected ``edges(a, b)``; component is the smallest node reachable.

    Each round lets every node's larger neighbours, then its smaller ones, point
    to the smallest node among its neighbours, until the edges no longer
    change. Minima are aggregated before the shuffle, so a hub with very many
    neighbours is a skewed join that Spark can split, never a collected group.
    Edges live in a table in the shared folder between rounds.
    """
    spark = edges.sparkSession
    now = written(
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), tag
    )
    before = None
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            now.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u and v > m").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        large = written(large, tag)
        # now every edge goes from a smaller to a larger node; the larger one keeps its smallest neighbour
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(
            F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")
        ).where("a < b").distinct()
        now = written(small, tag)
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if before == (state["n"], state["s"]):
            break
        before = (state["n"], state["s"])
    members = now.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component"))
    roots = now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return written(members.unionByName(roots), tag)
