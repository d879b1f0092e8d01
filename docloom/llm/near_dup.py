"""Near-duplicate documents by SetSketch registers.

A document's set holds the hashes of its distinct word shingles. Each register
of its sketch is the exponentially spaced, truncated minimum of exponential
variables over the set: sketches of parts merge by taking the larger register,
and equal registers are as likely as the sets are similar. Rows of a band of
registers are the candidate buckets, a joint likelihood over all registers
drops candidates that cannot reach the threshold, and the full sets decide.

Documents with equal sets form one node, so exact copies cost nothing further.
Shingles that no other candidate holds bound what a set's best link can be; sets
that cannot reach the threshold leave their bucket. Within a bucket no pairs are
listed: every member is compared with a few hubs, the links found are closed
into components, and only members that are still in different components of the
same bucket are looked up again, by their rarest shingles. Pairs inside one
component need no comparison, as they cannot change the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bytewords import mix, slices, windows, words_of
from .shared import components, in_batches, pick, with_keys, worker_state, written

WIDTH = 5
#: Bands x registers a band: two sets with a similarity of 0.85 share no bucket once in 13 million pairs.
BANDS, ROWS = 28, 5
#: SetSketch parameters: base, rate and largest register (registers fit 16 bits).
B, RATE, TOP = 1.001, 20.0, 65534
#: Log-likelihood by which the threshold may fall behind the best similarity before a candidate is dropped.
SLACK = 24.0
HUBS = 3

_FACTORS = mix(np.arange(7, 7 + BANDS * ROWS, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text: ``width`` words, or the whole sequence where there are fewer."""
    for _, data, bounds in slices(texts):
        words = words_of(data, bounds)
        for a, b in zip(words.first[:-1], words.first[1:], strict=True):
            yield np.unique(windows(words.hashes[a:b], min(width, max(1, b - a))))


def registers(items: np.ndarray) -> np.ndarray:
    """The set's registers as 16-bit integers."""
    low = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(items), 256):
            np.minimum(low, (items[at : at + 256, None] * _FACTORS).min(axis=0), out=low)
    first = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(first) / np.log(B)), 0, TOP + 1).astype(np.uint16)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    worker_state("near_dup")
    for batch in batches:
        sizes, nodes, sketches = [], [], []
        for items in shingle_sets(batch.column("text")):
            sizes.append(len(items))
            nodes.append(xxhash.xxh3_128_digest(items.tobytes()) if len(items) else None)
            sketches.append(registers(items).tobytes() if len(items) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_hash"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.array(sketches, pa.binary())],
            names=["doc_id", "text_hash", "n_shingles", "digest", "sketch"],
        )


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    worker_state("near_dup")
    for batch in batches:
        nodes, sets = [], []
        for items in shingle_sets(batch.column("text")):
            nodes.append(xxhash.xxh3_128_digest(items.tobytes()))
            sets.append(items.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(sets, pa.binary())], names=["digest", "items"])


def log_likelihoods(more: np.ndarray, less: np.ndarray, same: np.ndarray, n_u: np.ndarray, n_v: np.ndarray, js: np.ndarray) -> np.ndarray:
    """Joint log-likelihood of each similarity in ``js`` (columns) given how many registers are larger, smaller and equal."""
    u, v = (n_u / (n_u + n_v))[:, None], (n_v / (n_u + n_v))[:, None]
    j = np.minimum(js[None, :], np.minimum(u / v, v / u))
    chance = lambda x: np.clip(-np.log1p(-np.maximum(x, 0) * (B - 1) / B) / np.log(B), 1e-12, 1)
    up, down = chance(u - v * j), chance(v - u * j)
    return more[:, None] * np.log(up) + less[:, None] * np.log(down) + same[:, None] * np.log(np.clip(1 - up - down, 1e-12, 1))


def _likely(percent: int):
    grid = np.linspace(0.0, 1.0, 101)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            of = lambda name: np.frombuffer(b"".join(batch.column(name).to_pylist()), np.uint16).reshape(batch.num_rows, -1)  # noqa: B023, E731
            left, right = of("sketch_a"), of("sketch_b")
            more, less = (left > right).sum(1), (left < right).sum(1)
            sizes = [batch.column(n).to_numpy().astype(np.float64) for n in ("n_a", "n_b")]
            fit = log_likelihoods(more, less, left.shape[1] - more - less, *sizes, grid)
            best, at = fit.max(1), fit[:, percent]
            able = (fit.argmax(1) >= percent) | (best - at <= SLACK)
            able &= 100 * np.minimum(*sizes) >= percent * np.maximum(*sizes)
            yield batch.select(["a", "b"]).filter(pa.array(able))

    return run


def _linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("items_a"), batch.column("items_b"), strict=True):
                x, y = (np.frombuffer(z.as_buffer(), np.int64) for z in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            sets = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("items")[at : at + 512]]
            nodes = np.repeat(batch.column("node")[at : at + 512].to_numpy(), [len(x) for x in sets])
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(np.concatenate(sets))], names=["node", "item"])


def _attach(pairs: DataFrame, table: DataFrame, **columns: str) -> DataFrame:
    for side in ("a", "b"):
        own = table.select(F.col("node").alias(side), *[F.col(c).alias(f"{name}_{side}") for name, c in columns.items()])
        pairs = pairs.join(own, side)
    return pairs


def _confirmed(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the full sets confirm, as a written table."""
    likely = _attach(pairs, nodes, sketch="sketch", n="n_shingles").transform(in_batches, _likely(percent), "a long, b long")
    return written(_attach(likely, sets, items="items").transform(in_batches, _linked(percent), "a long, b long"), "links")


def _prefix_pairs(mixed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes in different components, one of them aside, that can be similar enough.

    Sets of n and m items need an intersection of percent * (n + m) / (100 + percent)
    items, so all but that many of a set's items, and one more, hold a common
    one: only its rarest items are looked up. Sets that a family's members have
    in common are so left to the last, and mostly not reached.
    """
    items = sets.join(mixed, "node").select("node", "items").transform(in_batches, _exploded, "node long, item long")
    counts = items.groupBy("item").agg(F.count("*").alias("n")).where("n > 1")
    spare = lambda n, m: f"{n} - ceil({percent} * ({n} + {m}) / {100 + percent}) + 1"
    aside = mixed.where("aside").select(F.col("node").alias("x"), F.col("size").alias("size_x"), F.col("component").alias("cx"))
    rarity = Window.partitionBy("x").orderBy("n", "item")
    # items that no other set holds come first and lead nowhere; they only move the others back
    own = items.join(aside, F.col("node") == F.col("x")).join(counts, "item", "left").select("x", "size_x", "cx", "item", F.coalesce("n", F.lit(1)).alias("n"))
    lead = own.withColumn("place", F.row_number().over(rarity)).where(f"n > 1 and place <= size_x - ceil({percent} * size_x / 100) + 1")
    others = items.join(mixed.drop("aside"), "node")
    found = lead.join(others, "item").where(
        f"component <> cx and 100 * least(size, size_x) >= {percent} * greatest(size, size_x) and place <= {spare('size_x', 'size')}"
    )
    return found.select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b")).distinct()


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of ``docs``.

    Documents whose sets have ``100 * intersection >= percent * union`` are
    linked; component_id is the smallest doc_id of a document's component and
    kept says whether it is the document's own. Null and wordless texts have an
    empty set and are linked with nothing. Rows with equal doc_id are rows of
    one result each; a null doc_id is kept only if no other id is in its
    component. An empty table gives an empty result; other columns are ignored.
    """
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    found = _grouped(docs, percent)
    return found.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def _grouped(docs: DataFrame, percent: int) -> DataFrame:
    """(doc_id, text_hash, n_shingles, digest, component_id, lead), one row for each row of ``docs``.

    lead is the (no_id, doc_id, text_hash) of the component that sorts first, where a missing id sorts last.
    """
    docs = pick(docs, "doc_id", "text")
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    sketched = written(
        hashed.transform(in_batches, _sketches, "doc_id long, text_hash long, n_shingles long, digest binary, sketch binary"), "sketches"
    )
    nodes = written(
        sketched.where("digest is not null")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("doc_id"), F.min(_place()).alias("lead"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
        .withColumn("node", F.monotonically_increasing_id()),
        "nodes",
    )
    width = 2 * ROWS
    banded = nodes.select(
        "node", F.explode(F.array(*[F.xxhash64(F.lit(k), F.substring("sketch", k * width + 1, width)) for k in range(BANDS)])).alias("key")
    )
    shared = banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    members = written(banded.join(shared, "key"), "members")

    wanted = members.select("node").distinct().join(nodes.select("node", "doc_id", "digest"), "node")
    texts = docs.alias("d").join(wanted.select("doc_id").distinct().alias("w"), F.expr("d.doc_id <=> w.doc_id"), "left_semi")
    full = texts.select("text").transform(in_batches, _full_sets, "digest binary, items binary")
    sets = written(wanted.select("node", "digest").join(full, "digest").select("node", "items").dropDuplicates(["node"]), "sets")

    # A shingle that no other candidate holds counts against every link of its set. Sets with too many of these can
    # have no link in a bucket, which ends most comparisons within families of heavily edited copies.
    single = sets.transform(in_batches, _exploded, "node long, item long").groupBy("item").agg(F.count("*").alias("n"), F.min("node").alias("node")).where("n = 1")
    single = single.groupBy("node").agg(F.count("*").alias("alone"))
    sized = nodes.select("node", "n_shingles").join(single, "node", "left").select("node", F.col("n_shingles").alias("size"), F.coalesce("alone", F.lit(0)).alias("alone"))
    members = members.join(sized, "node").where(f"100 * (size - alone) >= {percent} * size")
    least = members.groupBy("key").agg(F.count("*").alias("n"), F.min("size").alias("least")).where("n > 1")
    # the best partner of a set is a subset of its shared shingles, as small as the bucket has it
    members = members.join(least.select("key", "least"), "key").where(
        f"100 * (size - alone) >= {percent} * (size + least - least(size - alone, least))"
    )
    members = written(members.select("key", "node", "size", "alone"), "members")

    hubs = members.groupBy("key").agg(
        F.count("*").alias("n"),
        F.min_by("node", F.expr("alone / size + (xxhash64(node) & 1023) * 1e-9")).alias("hub0"),
        *[F.min_by("node", F.xxhash64(F.lit(k), "node")).alias(f"hub{k}") for k in range(1, HUBS)],
    )
    hubs = hubs.where("n > 1").select("key", F.explode(F.array_distinct(F.array(*[f"hub{k}" for k in range(HUBS)]))).alias("hub"))
    pairs = written(
        members.join(hubs, "key").where("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct(), "pairs"
    )
    found = components(_confirmed(pairs, nodes, sets, percent))

    # members of one bucket that are in different components so far
    placed = members.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = written(placed, "placed")
    main = (
        placed.groupBy("key", "component")
        .agg(F.count("*").alias("n"))
        .groupBy("key")
        .agg(F.count("*").alias("parts"), F.max_by("component", F.struct("n", "component")).alias("main"))
        .where("parts > 1")
        .select("key", "main")
    )
    mixed = placed.join(main, "key").select("node", "size", "component", (F.col("component") != F.col("main")).alias("aside"))
    mixed = written(mixed.groupBy("node").agg(F.first("size").alias("size"), F.first("component").alias("component"), F.max("aside").alias("aside")), "mixed")
    rest = _prefix_pairs(mixed, sets, percent).join(pairs, ["a", "b"], "left_anti")
    late = _confirmed(rest, nodes, sets, percent)
    if not late.isEmpty():
        found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(late))

    grouped = nodes.select("node", "digest", "doc_id", "lead").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = grouped.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.min("lead").alias("lead"))
    named = grouped.drop("lead").join(lowest, "component").select("digest", "component_id", "lead")
    return sketched.select("doc_id", "text_hash", "n_shingles", "digest").join(named, "digest", "left")


def _place() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``docs`` without the near-duplicates: of each component one row stays, one with the smallest id and, under that, text hash.

    Rows go by id and text, so a row of another text with the same id is judged
    by its own text; of exactly repeated rows one stays, any of them where other
    columns differ. Null and wordless texts all stay; a missing id sorts last. An
    empty table gives an empty result; other columns, whatever their names, pass through.
    """
    rows = _grouped(docs, percent).where("digest is not null")
    rows = written(rows.select("doc_id", "text_hash", _place().eqNullSafe(F.col("lead")).alias("leads")), "rows")
    keyed, (own_id, own_hash) = with_keys(docs, F.col("doc_id"), F.xxhash64("text"))

    def key(marks: DataFrame) -> tuple[DataFrame, Column]:
        marks = marks.select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash"))
        return marks, (keyed[own_hash] == marks["gone_hash"]) & keyed[own_id].eqNullSafe(marks["gone_id"])

    gone = key(rows.where("not leads").distinct())
    again = rows.where("leads").groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1")
    left = keyed.join(*gone, "left_anti")
    if not again.isEmpty():
        again = key(again)
        repeated = keyed.join(*again, "left_semi").dropDuplicates([own_id, own_hash])
        left = left.join(*again, "left_anti").unionByName(repeated)
    return left.drop(own_id, own_hash)
