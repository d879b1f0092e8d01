"""Keyword index at any grain: written shards of postings, and top-k search that leaves postings unread.

A unit is whatever is searched: a chunk, a section, a route of many texts. A posting is a unit's count of a term. A shard
holds all postings of some units, a row for each of its terms, so no row grows with the corpus. A search reads a
query's terms shard by shard and gives each shard's best units, of which the best of all are taken. In a shard, terms with
many postings are cut into tiers by weight. A query first sums up its heaviest tiers, those of rare words, and learns what a
unit must reach at least. It reads on until what the other tiers can add is small, learns a higher bound, and looks the few
units that may still win up in single blocks of the other tiers. The result is that of scoring everything.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.text import eval_tokens
from docloom.operators.graph import written
from docloom.operators.retrieval import B, BATCH_BYTES, BATCH_SETTING, K1

#: Postings of a block about, tiers of a term with more postings than that.
BLOCK, TIERS = 64, 4
#: Share of its postings that a query sums up for its first bound; share of that bound which unread tiers may add at most.
FIRST, REST = 0.2, 0.6
#: Scores are compared after rounding to six places; bounds allow for it.
SLACK = 1e-5
#: Words and units of a shard, whichever is reached first.
SHARD_WORDS, SHARD_UNITS = 1 << 21, 1 << 18
#: Units among which repeated ones are looked for before all are.
LOOK = 10_000


class Index(NamedTuple):
    """``shards``: rows (shard, term, n, units, counts) of a term's postings, and a row (shard, ids, lengths) of the units; how many units there are and their mean length."""

    shards: DataFrame
    n: int
    average: float


def _repeated(units: DataFrame) -> bool:
    return not units.groupBy("unit").count().where("count > 1").isEmpty()


def build(rows: DataFrame, unit: str, text: str) -> Index:
    """Indexes units by the words of all their rows; null texts have none, but their unit counts among all.

    Where a unit has several rows, lengths and frequencies are aggregated before,
    so its texts never meet in one place; else a text is read once.
    """
    conf = rows.sparkSession.conf
    if conf.get(BATCH_SETTING, None) is None:
        conf.set(BATCH_SETTING, BATCH_BYTES)
    tokens = rows.select(F.struct(F.col(unit).alias("id")).alias("unit"), eval_tokens(F.col(text)).alias("tokens"))
    if not _repeated(tokens.select("unit").limit(LOOK)):
        shards = _shards(tokens.select("unit", F.size("tokens").alias("length"), "tokens", F.lit(None).cast("array<int>").alias("counts")))
        if not _repeated(shards.where("term is null").select(F.explode("ids").alias("unit"))):
            return _index(shards)
    lengths = written(tokens.groupBy("unit").agg(F.sum(F.size("tokens")).alias("length")), "lengths")
    # lengths join rows of texts, which are fewer than postings, and a row counts its words before they move
    words = tokens.join(lengths, "unit").select("unit", "length", F.explode_outer("tokens").alias("term"))
    counts = written(words.groupBy("unit", "length", "term").agg(F.count("term").cast("int").alias("tf")), "gains")
    listed = counts.groupBy("unit", "length").agg(F.collect_list(F.when(F.col("term").isNotNull(), F.struct("term", "tf"))).alias("of"))
    return _index(_shards(listed.select("unit", "length", F.col("of.term").alias("tokens"), F.col("of.tf").alias("counts"))))


def _shards(units: DataFrame) -> DataFrame:
    """Written shards of ``units`` (unit, length, tokens, counts), a row each; without counts, every token counts once."""
    ids = T.ArrayType(units.schema["unit"].dataType["id"].dataType)
    schema = T.StructType.fromDDL("shard long, term string, n long, units binary, counts binary, lengths binary").add("ids", ids)
    return written(units.mapInArrow(_packed, schema), "shards")


def _index(shards: DataFrame) -> Index:
    found = shards.where("term is null").agg(F.sum(F.size("ids")), F.sum("n")).first()
    return Index(shards, found[0] or 0, (found[1] or 0) / found[0] if found[0] and found[1] else 1.0)


def _order(ids: pa.Array) -> np.ndarray:
    """Places of the ids in their order."""
    keys = {}

    def add(column: pa.Array) -> None:
        if pa.types.is_struct(column.type):
            for part in column.flatten():
                add(part)
        else:
            keys[f"k{len(keys)}"] = column

    add(ids)
    return pc.sort_indices(pa.table(keys), sort_keys=[(k, "ascending") for k in keys], null_placement="at_start").to_numpy()


def _binary(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Runs of ``values`` from each of ``starts`` to the next as bytes."""
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer((starts * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards of the units of a partition."""
    got, words, units, shard = [], 0, 0, TaskContext.get().partitionId() << 32

    def listed(batch: pa.RecordBatch, name: str) -> pa.Array:
        return batch.column(name).flatten()

    def out() -> Iterator[pa.RecordBatch]:
        ids = pa.concat_arrays([b.column("unit").field("id") for b in got])
        order = _order(ids)
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        sizes = np.concatenate([pc.fill_null(pc.list_value_length(b.column("tokens")), 0).to_numpy(zero_copy_only=False) for b in got])
        coded = pa.concat_arrays([listed(b, "tokens") for b in got]).dictionary_encode()
        keys = coded.indices.to_numpy().astype(np.int64) * len(order) + np.repeat(place, sizes)
        if got[0].column("counts").null_count:
            keys.sort()
            at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
            keys, tf = keys[at], np.diff(np.r_[at, len(keys)])
        else:
            by = np.argsort(keys)
            keys, tf = keys[by], np.concatenate([listed(b, "counts").to_numpy() for b in got])[by]
        length = np.concatenate([b.column("length").to_numpy() for b in got])[order].astype(np.int64)
        starts = np.searchsorted(keys, np.arange(len(coded.dictionary) + 1) * len(order))
        n, none = len(coded.dictionary), lambda kind, n: pa.nulls(n, kind)
        one = pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), ids.take(pa.array(order)))
        yield _rows([np.full(n, shard), coded.dictionary, np.diff(starts), _binary((keys % len(order)).astype(np.int32), starts), _binary(tf.astype(np.int32), starts), none(pa.binary(), n), none(one.type, n)])
        yield _rows([np.array([shard]), none(pa.string(), 1), np.array([int(length.sum())]), none(pa.binary(), 1), none(pa.binary(), 1), pa.array([length.tobytes()], pa.binary()), one])

    for b in batches:
        if not b.num_rows:
            continue
        got.append(b)
        words, units = words + len(listed(b, "tokens")), units + b.num_rows
        if words >= SHARD_WORDS or units >= SHARD_UNITS:
            yield from out()
            got, words, units, shard = [], 0, 0, shard + 1
    if got:
        yield from out()


def _rows(columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], ["shard", "term", "n", "units", "counts", "lengths", "ids"])


class _Tier(NamedTuple):
    """Postings of a term by unit, the largest of their weights, and how much larger that is than the next tier's."""

    term: int
    units: np.ndarray
    weights: np.ndarray
    top: float
    drop: float


def _tiers(term: int, units: np.ndarray, weights: np.ndarray, block: int) -> list[_Tier]:
    if len(units) <= block:
        return [_Tier(term, units, weights, top := float(weights.max()), top)]
    tier = np.minimum(TIERS - 1, np.floor((1 - weights / weights.max()) * TIERS)).astype(int)
    parts = [(units[mine], weights[mine]) for mine in (tier == t for t in range(TIERS)) if mine.any()]
    tops = [float(w.max()) for _, w in parts] + [0.0]
    return [_Tier(term, u, w, tops[j], tops[j] - tops[j + 1]) for j, (u, w) in enumerate(parts)]


def _summed(tiers: list[_Tier], n: int) -> np.ndarray:
    return np.bincount(np.concatenate([t.units for t in tiers]), np.concatenate([t.weights for t in tiers]), n)


def _reach(scores: np.ndarray, k: int) -> float:
    """The k-th best of sums that can only grow, so the k-th best of all is not lower; 0 where fewer have one."""
    return float(np.partition(scores, len(scores) - k)[len(scores) - k]) if 0 < k <= len(scores) else 0.0


def _best_of(tiers: list[_Tier], n: int, k: int, block: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(units, scores, postings read) of the ``k`` best of a shard's ``n`` units, and of those that are level with the last one the first ones."""
    tiers = sorted(tiers, key=lambda t: -t.top)
    sizes = np.array([len(t.units) for t in tiers])
    n_first = max(1, int(np.searchsorted(np.cumsum(sizes), FIRST * sizes.sum(), "right")))
    reach = _reach(_summed(tiers[:n_first], n), k)
    left = np.cumsum([t.drop for t in tiers][::-1])[::-1]
    n_read = max(n_first, int((left >= REST * reach - SLACK).sum()))  # what is left only falls
    scores, read = _summed(tiers[:n_read], n), int(sizes[:n_read].sum())
    units = np.flatnonzero(scores)
    if n_read < len(tiers):
        rest: dict[int, float] = {}
        for t in tiers[n_read:]:
            rest[t.term] = max(rest.get(t.term, 0.0), t.top)
        seen = np.zeros(n)
        for t in tiers[:n_read]:
            seen[t.units] += rest.get(t.term, 0.0)
        units = units[scores[units] + sum(rest.values()) - seen[units] >= _reach(scores, k) - SLACK]
        done = np.zeros(n, bool)
        for term in rest:
            done[:] = False
            for t in tiers[:n_read]:
                if t.term == term:
                    done[t.units] = True
            asked = units[~done[units]]
            for t in tiers[n_read:] if len(asked) else ():
                if t.term == term:
                    # a tier's blocks are runs of its units
                    at = np.minimum(np.searchsorted(t.units, asked), len(t.units) - 1)
                    there = t.units[at] == asked
                    scores[asked[there]] += t.weights[at[there]]
                    opened = np.unique(at // block)
                    read += int(np.minimum(block, len(t.units) - opened * block).sum())
    found = np.round(scores[units], 6)
    if len(units) > k:
        units, found = (x[found >= np.partition(found, len(found) - k)[len(found) - k]] for x in (units, found))
    first = np.lexsort((units, -found))[:k]
    return units[first], found[first], read


def _found(table: pa.Table, n: int, average: float, k: int, block: int) -> pa.Table:
    """Each query's ``k`` best units of a shard, and a row without a unit for the postings that it has and reads there."""
    held = table.filter(table.column("ids").is_valid()).combine_chunks()
    posts = table.filter(table.column("ids").is_null()).combine_chunks()
    length = np.frombuffer(held.column("lengths")[0].as_buffer(), np.int64)
    ids = pa.concat_arrays(held.column("ids").chunks).flatten()
    by_query: dict = {}
    for term, row in enumerate(zip(*(posts.column(c) for c in ("units", "counts", "df", "queries")), strict=True)):
        units, tf = (np.frombuffer(x.as_buffer(), np.int32) for x in row[:2])
        df = row[2].as_py()
        gain = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[units] / average))
        tiers = _tiers(term, units, np.log(1 + (n - df + 0.5) / (df + 0.5)) * gain, block)
        for query in row[3].as_py():
            by_query.setdefault(query, []).extend(tiers)
    queries, units, scores, sizes, reads = [], [], [], [], []
    for query, tiers in by_query.items():
        best, score, read = _best_of(tiers, len(length), k, block)
        queries += [query] * (len(best) + 1)
        units += [*best.tolist(), None]
        scores += [*score.tolist(), None]
        sizes += [0] * len(best) + [sum(len(t.units) for t in tiers)]
        reads += [0] * len(best) + [read]
    of_type = posts.schema.field("queries").type.value_type
    unit = ids.take(pa.array(units, pa.int64()))
    kept = pa.array([u is not None for u in units], pa.bool_())
    return pa.table({"query_id": pa.array(queries, of_type), "unit": unit, "is_hit": kept, "score": pa.array(scores, pa.float64()), "n_postings": pa.array(sizes, pa.int64()), "n_read": pa.array(reads, pa.int64())})


def search(queries: DataFrame, index: Index, query_id: str, text: str, k: int) -> tuple[DataFrame, DataFrame]:
    """The hits (query_id, unit, score, rank) and the work (query_id, n_postings, n_read) of each query's ``k`` best units.

    A query's terms are those of all its rows, each once. Ties go to the lower
    unit. Queries without a term of the index have no rows.
    """
    asked = queries.select(F.col(query_id).alias("query_id"), F.explode(eval_tokens(F.col(text))).alias("term")).distinct()
    asked = written(asked.groupBy("term").agg(F.collect_list("query_id").alias("queries")), "asked")
    shards = index.shards
    terms = shards.select("term", "n").join(asked.select("term"), "term").groupBy("term").agg(F.sum("n").alias("df"))
    terms = written(asked.join(terms, "term"), "terms")
    posts = shards.select("shard", "term", "units", "counts").join(terms, "term").drop("term")
    held = shards.where("term is null").select("shard", "lengths", "ids")
    met = posts.unionByName(held, allowMissingColumns=True).repartition(max(1, held.count()), "shard")
    schema = T.StructType([T.StructField("query_id", asked.schema["queries"].dataType.elementType), T.StructField("unit", shards.schema["ids"].dataType.elementType)])
    schema = schema.add("is_hit", "boolean").add("score", "double").add("n_postings", "long").add("n_read", "long")
    run = partial(_found, n=index.n, average=index.average, k=k, block=BLOCK)
    scored = written(met.groupBy("shard").applyInArrow(lambda table: run(table), schema), "scored")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "unit")
    hits = scored.where("is_hit").select("query_id", "unit", "score", F.row_number().over(order).alias("rank")).where(F.col("rank") <= k)
    work = scored.where("not is_hit").groupBy("query_id").agg(F.sum("n_postings").alias("n_postings"), F.sum("n_read").alias("n_read"))
    return hits, work
