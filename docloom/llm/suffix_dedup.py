"""Exact removal of long repeated byte strings by suffix arrays.

Every window of LENGTH bytes holds an anchor: the gram with the smallest hash in
it, a choice that depends on the window's bytes alone. Equal windows thus meet at
equal anchors, and anchors are some two hundred times fewer than positions.

1. Anchors are counted over the corpus; one that occurs once repeats nothing. The
   others carry a hash of all bytes that windows around them can touch (the
   context): a context that occurs twice is repeated as a whole.
2. Where an anchor has several contexts, each distinct one is halved: windows
   left and right of the anchor share a longer string each, and a half whose
   string no other context has is done. An anchor answers only for the windows of
   which it is the smallest gram; these are cut into cores that STEP + 1 window
   positions share. Strings with equal cores are laid side by side as flank, core
   symbol, flank, without bytes that no other string of the core has there; a
   suffix array over these, built by the grouping construction, and its common
   prefixes say which windows recur.
3. Covered bytes are merged for each document and cut out of its text.

A core with very many different flanks is not put into one suffix array: there
every window becomes a key of its own, which is exact as well.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytewords import _BYTE, mix, powers, slices
from .shared import in_batches, pick, worker_state, written

LENGTH, GRAM, STEP = 400, 40, 20
#: Contexts with one half from which on they are divided by hubs, and symbols of a block of cores sorted together.
MOST, BLOCK = 200, 20_000
#: Contexts of one group that are divided in one task.
IN_TASK = 10_000
#: Bytes on either side of an anchor by which a hub resembles others.
NEAR = 120
#: Contexts whose cores are made at once, and bytes of texts from which on those of their anchors are made.
PART, AT_ONCE = 256, 1 << 19

_U = np.uint64


# --- suffix array by grouping -------------------------------------------------


def suffix_array(text: list[int]) -> list[int]:
    """Suffix array of integers of which the last one is unique and smallest, by the grouping construction.

    Suffixes are grouped by their first symbol. Groups are processed in
    descending order: each member's previous smaller suffix is found over the
    pointers set so far, and the suffixes pointed to leave their group for new
    ones right above it, by how often they are pointed to. Afterwards suffixes
    share a group only if they have the same Lyndon prefix. One pass over the
    array from the left then emits every group's members in their order.
    """
    n = len(text)
    symbols = np.array(text, np.int64)
    ranked = np.argsort(symbols, kind="stable")
    heads = np.flatnonzero(np.append(True, np.diff(symbols[ranked]) > 0))
    sizes = np.diff(np.append(heads, n))
    spread, first = np.empty((2, n), np.int64)
    spread[ranked], first[ranked] = np.arange(n), np.repeat(heads, sizes)
    order, where, start = ranked.tolist(), spread.tolist(), first.tolist()
    end = [0] * (n + 1)
    for at, size in zip(heads.tolist(), sizes.tolist(), strict=True):
        end[at] = at + size
    before = [-1] * n
    top = n
    while top:
        group = start[order[top - 1]]
        if top - group == 1:
            i = order[group]
            p = i - 1
            while p >= 0 and start[p] >= group:
                p = before[p]
            before[i] = p
            if p >= 0 and (cut := end[start[p]] - 1) > (old := start[p]):
                other, place = order[cut], where[p]
                order[place], order[cut] = other, p
                where[other], where[p] = place, cut
                start[p], end[old], end[cut] = cut, cut, cut + 1
            top = group
            continue
        pointed: Counter = Counter()
        for i in sorted(order[group:top]):
            p = i - 1
            while p >= 0 and start[p] >= group:
                p = before[p]
            before[i] = p
            if p >= 0:
                pointed[p] += 1
        by_count: dict[int, dict[int, list[int]]] = {}
        for p, times in pointed.items():
            by_count.setdefault(times, {}).setdefault(start[p], []).append(p)
        for times in sorted(by_count, reverse=True):
            for old, moved in by_count[times].items():
                last = cut = end[old]
                for p in moved:
                    cut -= 1
                    other, place = order[cut], where[p]
                    order[place], order[cut] = other, p
                    where[other], where[p] = place, cut
                for p in moved:
                    start[p] = cut
                end[old], end[cut] = cut, last
        top = group
    out, free, done = [-1] * n, list(range(n + 1)), [False] * n
    out[0] = n - 1
    done[n - 1] = True
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not done[j]:
            slot = free[start[j]]
            out[slot], done[j] = j, True
            free[start[j]] = slot + 1
            j = before[j]
    return out


def common_prefixes(text: list[int], order: list[int], most: int | None = None) -> list[int]:
    """Length of the longest common prefix of each suffix, by position, with its neighbours in the array (the longer one), counted up to ``most``."""
    n = len(text)
    symbols, ranked = np.array([*text, -1]), np.array(order, np.int64)
    upper, open_pairs, known = np.zeros(n + 1, np.int64), np.arange(1, n), 0
    while len(open_pairs) and known != most:
        # a suffix that ends meets the symbol -1 behind the text, and its longer neighbour never does at the same length
        equal = symbols[ranked[open_pairs - 1] + known] == symbols[ranked[open_pairs] + known]
        open_pairs, known = open_pairs[equal], known + 1
        upper[open_pairs] = known
    longest = np.zeros(n, np.int64)
    longest[ranked] = np.maximum(upper[:n], upper[1:])
    return longest.tolist()


# --- anchors ------------------------------------------------------------------


def _prefix_hash(data: np.ndarray) -> np.ndarray:
    total = np.zeros(len(data) + 1, _U)
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE[data] * powers(len(data) + 1)[0][: len(data)], out=total[1:])
    return total


def _span_hash(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    down = powers(len(total))[1]
    with np.errstate(over="ignore"):
        return mix((total[end] - total[start]) * down[start] + mix((end - start).astype(_U)))


def _sliding(values: np.ndarray, width: int, pick_of) -> np.ndarray:
    """pick_of (minimum or maximum) over each run of ``width`` values."""
    n, done = len(values), 1
    while 2 * done <= width:
        values = pick_of(values[: len(values) - done], values[done:])
        done *= 2
    return pick_of(values[: n - width + 1], values[width - done : width - done + n - width + 1])


def anchors_of(data: np.ndarray, bounds: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, position in it, hashes of gram, context, left and right half, least and largest number of bytes before it) of every anchor.

    Texts come as a run that no window crosses. The last two bound the windows
    that choose this anchor; they follow from the context alone. A half's hash is
    0 where the text ends before it does, or no such window holds it.
    """
    none = tuple(np.zeros(0, np.int64) for _ in range(8))
    if len(data) < length:
        return none
    total = _prefix_hash(data)
    with np.errstate(over="ignore"):
        grams = mix((total[gram:] - total[:-gram]) * powers(len(total))[1][: len(total) - gram] + mix(np.array([gram], _U)))
    width = length - gram + 1
    low = _sliding(grams, width, np.minimum)
    for end in bounds[1:-1].tolist():
        low[max(0, end - length + 1) : end] = 0  # windows that would cross a bound choose nothing
    padded = np.zeros(len(grams) + width - 1, _U)
    padded[width - 1 : width - 1 + len(low)] = low
    best = _sliding(padded, width, np.maximum)
    at = np.flatnonzero((best == grams) & (grams != 0))
    text = np.searchsorted(bounds, at, "right") - 1
    left, right = np.maximum(bounds[text], at - (length - gram)), np.minimum(bounds[text + 1], at + length)
    with np.errstate(over="ignore"):
        context = mix(_span_hash(total, left, right) + mix((at - left).astype(_U)))
    half = (length - gram) // 2
    fewest, most = _asked(low, grams[at], at, length - gram)
    from_left, to_right = at - half, at + length - half
    halves = []
    for start, end, fits in ((from_left, at + gram, (from_left >= bounds[text]) & (most >= half)), (at, to_right, (to_right <= bounds[text + 1]) & (fewest <= half))):
        hashed = np.zeros(len(at), _U)
        hashed[fits] = _span_hash(total, start[fits], end[fits])
        halves.append(hashed.view(np.int64))
    return text, at - bounds[text], grams[at].view(np.int64), context.view(np.int64), *halves, fewest, most


def _asked(low: np.ndarray, grams: np.ndarray, at: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest number of bytes before each anchor in the windows of which it is the smallest gram.

    Windows that hold an anchor and have its value as smallest are one run: the
    last run of that value that begins at the anchor or before.
    """
    begins = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
    ends = np.append(begins[1:], len(low)) - 1
    is_anchor = np.repeat([False, True], [len(begins), len(at)])
    order = np.lexsort((is_anchor, np.append(begins, at), np.append(low[begins], grams)))
    last = np.maximum.accumulate(np.where(is_anchor[order], -1, np.arange(len(order))))
    run = np.empty(len(order), np.int64)
    run[order] = order[last]
    run = run[len(begins) :]
    return at - np.minimum(ends[run], at), at - np.maximum(begins[run], at - reach)


SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
NAMES = ["doc_id", "text_hash", "at", "gram", "context", "left", "right", "low", "high", "n", "places"]


def _scan(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("suffix_dedup")
        for batch in batches:
            for first, data, bounds in slices(batch.column("text")):
                text, at, grams, contexts, *more = anchors_of(data, bounds, length, gram)
                if not len(at):
                    continue
                # equal contexts within one text stand once, with their number and, where they recur, all their places
                order = np.lexsort((at, contexts, grams, text))
                text, at, grams, contexts = (x[order] for x in (text, at, grams, contexts))
                new = np.ones(len(at), bool)
                new[1:] = (text[1:] != text[:-1]) | (grams[1:] != grams[:-1]) | (contexts[1:] != contexts[:-1])
                heads = np.flatnonzero(new)
                counts = np.diff(np.append(heads, len(at)))
                recur = np.repeat(counts > 1, counts)
                ids, hashes = batch.column("doc_id"), batch.column("text_hash")
                rows = pa.array(first + text[heads])
                yield pa.RecordBatch.from_arrays(
                    [ids.take(rows), hashes.take(rows), *[pa.array(x) for x in (at[heads], grams[heads], contexts[heads], *[x[order[heads]] for x in more], counts)], pa.array([None] * len(heads), pa.list_(pa.int64()))],
                    names=NAMES,
                )
                if recur.any():
                    owner, spots = text[recur], at[recur]
                    own, begin = np.unique(owner, return_index=True)
                    rows = pa.array(first + own)
                    empty = pa.array([None] * len(own), pa.int64())
                    merged = []
                    for part in np.split(spots, begin[1:]):
                        part = np.sort(part)
                        breaks = np.flatnonzero(np.diff(part) > gram) + 1  # contexts closer than that overlap
                        merged.append(np.ravel([[p[0], p[-1]] for p in np.split(part, breaks)]).tolist())
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(rows), hashes.take(rows), *[empty] * 8, pa.array(merged, pa.list_(pa.int64()))],
                        names=NAMES,
                    )

    return run


# --- texts on their way through shuffles ---


def _zipped(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, zipped) of docs with these columns and text: what a join then shuffles is compressed, null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compress = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                zipped = [compress(t.as_buffer()) if t.is_valid else None for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(zipped, pa.binary())], names=["doc_id", "text_hash", "zipped"])

    return docs.select("doc_id", "text_hash", "text").transform(in_batches, run, "doc_id long, text_hash long, zipped binary")


def _unzipped(zipped: pa.Array) -> list[bytes]:
    import zstandard

    expand = zstandard.ZstdDecompressor().decompress
    return [expand(z.as_buffer()) if z.is_valid else b"" for z in zipped]


# --- cores and flanks ---------------------------------------------------------

CORES = "core long, left binary, right binary, doc_id long, text_hash long, at long, single boolean, low int, high int"
_CORE_NAMES = ["core", "left", "right", "doc_id", "text_hash", "at", "single", "low", "high"]
_CORE_TYPES = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32()]


def _parts(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """The bytes ``data[start : start + size]`` of each two numbers."""
    offsets = np.zeros(len(size) + 1, np.int32)
    np.cumsum(size, out=offsets[1:])
    flat = data[np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], size)]
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])


def _core_rows(data: np.ndarray, total: np.ndarray, text: np.ndarray, places: np.ndarray, wanted: np.ndarray, single: np.ndarray, salt: np.ndarray | None, length: int, step: int) -> tuple:
    """(anchor, core, left flank, right flank, begin, single) of the cores around the anchors at ``places``.

    ``total`` is the prefix hash of ``data``, a run of texts; ``text`` holds the
    first and last place of each anchor's own. ``wanted`` tells of each anchor and
    each offset, in steps, whether the core that begins so far before is asked
    for. One core position stands once, as single if any of its anchors is.
    """
    offsets = np.arange(wanted.shape[1]) * step
    anchor, k = np.nonzero(wanted)
    begin = places[anchor] - offsets[k]
    fits = (begin >= text[anchor, 0]) & (begin + length - step <= text[anchor, 1])
    anchor = anchor[fits]
    begin, one, owner = np.unique(begin[fits], return_index=True, return_inverse=True)
    flags = np.bincount(owner, single[anchor], len(begin)) > 0
    anchor = anchor[one]
    ends, (first, last) = begin + length - step, text[anchor].T
    cores = _span_hash(total, begin, ends)
    if salt is not None:
        cores = mix(cores ^ salt[anchor].view(_U))
    before, after = np.minimum(step, begin - first), np.minimum(step, last - ends)
    return anchor, pa.array(cores.view(np.int64)), _parts(data, begin - before, before), _parts(data, ends, after), begin - first, flags


def _covering(low: np.ndarray, high: np.ndarray, reach: int, step: int) -> np.ndarray:
    """For each anchor and each core, in steps before it, whether it serves windows with ``low`` to ``high`` bytes before the anchor."""
    offsets = np.arange(0, reach, step)
    return (np.minimum(low, reach - 1)[:, None] < offsets + step) & (offsets <= high[:, None])


def _cores(length: int, gram: int, step: int):
    """Cores around the listed anchors of each text, and the whole contexts of those in groups to be divided.

    A context's row has its group as core, the bytes before the anchor
    backwards as left, those from the anchor on as right, and the least and
    largest number of bytes before the anchor of the windows that are asked for.
    """
    reach = length - gram
    half = reach // 2
    in_left = np.arange(0, reach, step) >= half

    def rows_of(batch: pa.RecordBatch, first: int, raws: list[bytes]) -> Iterator[pa.RecordBatch]:
        """Rows of the texts ``raws``, of which the first is that of row ``first``."""
        listed = batch.column("spots").slice(first, len(raws))
        bounds, values = listed.offsets.to_numpy(), listed.values
        data = np.frombuffer(b"".join(raws), np.uint8)
        total = _prefix_hash(data)
        ends = np.cumsum([0, *map(len, raws)])
        owners = np.repeat(np.arange(len(raws)), np.diff(bounds))
        # anchors come in parts; the solver drops cores that two parts list
        for begin in range(0, len(owners), 8 * PART):
            owner = owners[begin : begin + 8 * PART]
            flat = values.slice(int(bounds[0]) + begin, len(owner))
            at, left, right, single, low, high = (flat.field(n).to_numpy(zero_copy_only=False) for n in ("at", "left", "right", "single", "low", "high"))
            text, places = np.stack([ends[owner], ends[owner + 1]], axis=1), ends[owner] + at
            ids = [batch.column(c).take(pa.array(first + owner)) for c in ("doc_id", "text_hash")]
            wanted = np.where(in_left, left[:, None], right[:, None]) & _covering(low, high, reach, step)
            anchor, core, before, after, spots, flags = _core_rows(data, total, text, places, wanted, single, None, length, step)
            if len(anchor):
                none = pa.nulls(len(anchor), pa.int32())
                yield pa.RecordBatch.from_arrays([core, before, after, *[x.take(pa.array(anchor)) for x in ids], pa.array(spots), pa.array(flags), none, none], names=_CORE_NAMES)
            for name, least, largest in (("left", np.maximum(half, low), high), ("right", low, np.minimum(half, high))):
                own = flat.field(f"{name}_group")
                which = np.flatnonzero(own.is_valid().to_numpy(zero_copy_only=False))
                for some in np.split(which, range(PART, len(which), PART)):
                    if len(some):
                        spots = list(zip(at[some].tolist(), [raws[k] for k in owner[some]], strict=True))
                        before, after = [raw[max(0, a - reach) : a][::-1] for a, raw in spots], [raw[a : a + length] for a, raw in spots]
                        taken = pa.array(some)
                        columns = [own.take(taken), pa.array(before, pa.binary()), pa.array(after, pa.binary()), *[x.take(taken) for x in ids], pa.array(at[some]), pa.array(single[some])]
                        yield pa.RecordBatch.from_arrays([*columns, *[pa.array(x[some].astype(np.int32)) for x in (least, largest)]], names=_CORE_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("suffix_dedup")
        for batch in batches:
            raws: list[bytes] = []
            held = 0
            for k in range(batch.num_rows):
                raws += _unzipped(batch.column("zipped").slice(k, 1))
                held += len(raws[-1])
                if held >= AT_ONCE or k + 1 == batch.num_rows:
                    yield from rows_of(batch, k + 1 - len(raws), raws)
                    raws, held = [], 0

    return run


def _context_cores(length: int, gram: int, step: int):
    """Cores of the windows that whole contexts ask for; a group's cores meet only those of its own."""
    reach = length - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("suffix_dedup")
        for batch in (b.slice(first, PART) for b in batches for first in range(0, b.num_rows, PART)):
            before, after = batch.column("left").to_pylist(), batch.column("right").to_pylist()
            raws = [b[::-1] + a for b, a in zip(before, after, strict=True)]
            data = np.frombuffer(b"".join(raws), np.uint8)
            ends = np.cumsum([0, *map(len, raws)])
            places = ends[:-1] + [len(b) for b in before]
            group, at, single, low, high = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("core", "at", "single", "low", "high"))
            wanted = _covering(low, high, reach, step)
            text = np.stack([ends[:-1], ends[1:]], axis=1)
            anchor, core, left, right, begin, flags = _core_rows(data, _prefix_hash(data), text, places, wanted, single, group, length, step)
            if len(anchor):
                own, none = pa.array(anchor), pa.nulls(len(anchor), pa.int32())
                spots = begin + (at - places + ends[:-1])[anchor]
                ids = [batch.column(c).take(own) for c in ("doc_id", "text_hash")]
                yield pa.RecordBatch.from_arrays([core, left, right, *ids, pa.array(spots), pa.array(flags), none, none], names=_CORE_NAMES)

    return run


# --- groups of very many contexts ---------------------------------------------


def _agreement(ours: list[bytes], theirs: list[bytes], width: int) -> np.ndarray:
    """How many leading bytes of each two strings of at most ``width`` bytes agree."""
    grid = lambda rows: np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rows), np.uint8).reshape(len(rows), width)
    differ = np.concatenate([grid(ours) != grid(theirs), np.ones((len(ours), 1), bool)], axis=1)
    return np.minimum(differ.argmax(1), [min(len(x), len(y)) for x, y in zip(ours, theirs, strict=True)])


def _against_hub(length: int):
    """Each context with its hub: how far both agree before and from the anchor on, and the bytes that follow (-1: none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("suffix_dedup")
        for batch in (b.slice(first, 8 * PART) for b in batches for first in range(0, b.num_rows, 8 * PART)):
            left, right, hub_left, hub_right = (batch.column(c).to_pylist() for c in ("left", "right", "hub_left", "hub_right"))
            a, b = _agreement(left, hub_left, length), _agreement(right, hub_right, length)
            next_left = [x[n] if n < len(x) else -1 for x, n in zip(left, a.tolist(), strict=True)]
            next_right = [x[n] if n < len(x) else -1 for x, n in zip(right, b.tolist(), strict=True)]
            kept = batch.select([*_CORE_NAMES, "hub_doc", "hub_hash", "hub_at"])
            yield pa.RecordBatch.from_arrays([*kept.columns, *[pa.array(x, pa.int64()) for x in (a, b, next_left, next_right)]], names=[*kept.schema.names, "a", "b", "next_left", "next_right"])

    return run


def _divided(members: DataFrame, length: int) -> tuple[list[DataFrame], DataFrame]:
    """(spans, contexts of small groups) of groups of contexts.

    Groups of at most IN_TASK contexts are divided in one task each. In rounds
    before that, a larger one is compared with its hub as a join, which Spark can
    split; its hub is found by counts and a maximum that are aggregated before
    the shuffle.
    """
    spans, ready, turn = [], [], 0
    names = {"core": "core", "hub_doc": "doc_id", "hub_hash": "text_hash", "hub_at": "at", "hub_left": "left", "hub_right": "right"}
    hub_columns = [F.col(f"hub.{c}").alias(n) for n, c in names.items() if n != "core"]
    while True:
        large = written(members.groupBy("core").agg(F.count("*").alias("n")).where(f"n > {IN_TASK}").select("core"), "large")
        if large.isEmpty():
            ready.append(members)
            break
        ready.append(members.join(large.hint("merge"), "core", "left_anti"))
        # written, so that the join with the hubs shuffles by itself and a hot group can be split
        members = written(members.join(large.hint("merge"), "core", "left_semi"), "crowd")
        whole = F.struct("doc_id", "text_hash", "at", "left", "right")
        near = F.xxhash64(F.substring("left", 1, NEAR), F.substring("right", 1, NEAR))
        alike = members.groupBy("core", near.alias("near")).agg(F.count("*").alias("m"), F.min_by(whole, F.xxhash64(F.lit(turn), "doc_id", "text_hash", "at")).alias("hub"))
        hubs = alike.groupBy("core").agg(F.max_by("hub", F.struct("m", "near")).alias("hub"))
        hubs = written(hubs.select("core", *hub_columns), "hubs")
        paired = members.join(hubs.hint("merge"), "core")
        compared = paired.transform(in_batches, _against_hub(length), f"{CORES}, hub_doc long, hub_hash long, hub_at long, a long, b long, next_left long, next_right long")
        compared = written(compared.where("not (doc_id <=> hub_doc and text_hash = hub_hash and at = hub_at)"), "compared")
        shared = compared.where(F.col("a") + F.col("b") >= length)
        spans.append(shared.select("doc_id", "text_hash", (F.col("at") - F.col("a")).alias("first"), (F.col("at") + F.col("b")).alias("last")))
        widest = shared.groupBy("hub_doc", "hub_hash", "hub_at", "a").agg(F.max("b").alias("b"))
        spans.append(
            widest.select(F.col("hub_doc").alias("doc_id"), F.col("hub_hash").alias("text_hash"), (F.col("hub_at") - F.col("a")).alias("first"), (F.col("hub_at") + F.col("b")).alias("last"))
        )
        # what is left of a context are windows that hold the first differing byte before the anchor, and others that hold the first one after
        after = F.least(F.col("high"), length - 1 - F.col("b"), F.col("a"))
        ways = F.array(
            *[
                F.when((next_byte >= 0) & (low <= high), F.struct(F.xxhash64("core", F.lit(way), n, next_byte).alias("core"), low.cast("int").alias("low"), high.cast("int").alias("high")))
                for way, n, next_byte, low, high in (
                    ("left", "a", F.col("next_left"), F.greatest(F.col("low"), F.col("a") + 1), F.col("high")),
                    ("right", "b", F.col("next_right"), F.col("low"), after),
                )
            ]
        )
        branched = compared.select(F.explode(F.array_compact(ways)).alias("w"), *_CORE_NAMES[1:-2]).select("w.core", *_CORE_NAMES[1:-2], "w.low", "w.high")
        members, turn = written(branched, "members"), turn + 1
    dealt = reduce(DataFrame.unionByName, ready).repartition("core").sortWithinPartitions("core")
    parted = written(dealt.transform(in_batches, _divide(length, MOST), f"{CORES}, first long, last long"), "parted")
    spans.append(parted.where("core is null").select("doc_id", "text_hash", "first", "last"))
    return spans, parted.where("core is not null").drop("first", "last")


def _hub(left: np.ndarray, right: np.ndarray, rows: np.ndarray) -> int:
    """One of the contexts ``rows`` that looks like most others: the most frequent bytes around the anchor, ever more of them."""
    for width in (NEAR // 3, NEAR, 2 * NEAR, 3 * NEAR):
        near = np.ascontiguousarray(np.concatenate([left[rows, :width], right[rows, :width]], axis=1))
        _, kind, times = np.unique(near.view(f"V{near.shape[1]}").ravel(), return_inverse=True, return_counts=True)
        if times.max() == 1:
            break
        rows = rows[kind.ravel() == times.argmax()]
    return int(rows[len(rows) // 2])


def divide(group: int, left: np.ndarray, right: np.ndarray, sizes: np.ndarray, ends: np.ndarray, keys: list[tuple], length: int, most: int) -> tuple[list[tuple], list[tuple]]:
    """(spans, small groups) of one group of contexts.

    ``left`` and ``right`` hold a context's bytes before and from the anchor on,
    filled up with zeros; ``sizes`` their numbers; ``ends`` the least and largest
    number of bytes before the anchor of the windows asked for; ``keys`` what
    tells contexts apart. A span is (context, bytes before, bytes from the anchor
    on); a small group is (group, contexts, ends), of two or more. The windows of
    a context are never in two groups.
    """
    spans, small, open_groups = [], [], [(group, np.arange(len(left)), ends)]
    while open_groups:
        group, rows, ends = open_groups.pop()
        # a window has its bytes before the anchor and, of its length, the others after it
        fits = (np.maximum(ends[:, 0], length - sizes[rows, 1]) <= np.minimum(ends[:, 1], sizes[rows, 0]))
        rows, ends = rows[fits], ends[fits]
        if len(rows) <= most:
            if len(rows) > 1:
                small.append((group, rows, ends))
            continue
        hub = _hub(left, right, rows)
        other = np.array([keys[k] != keys[hub] for k in rows])
        others, low, high = rows[other], ends[other, 0], ends[other, 1]
        agree = []
        for side, grid in enumerate((left, right)):
            differ = np.concatenate([grid[others] != grid[hub], np.ones((len(others), 1), bool)], axis=1).argmax(1)
            agree.append(np.minimum(differ, np.minimum(sizes[others, side], sizes[hub, side])))
        a, b = agree
        held = a + b >= length
        spans += zip(others[held].tolist(), a[held].tolist(), b[held].tolist(), strict=True)
        for width in np.unique(a[held]):
            spans.append((hub, int(width), int(b[held & (a == width)].max())))
        # what is left of a context are windows that hold the first differing byte before the anchor, and others that hold the first one after
        ways = (("left", left, a, 0, np.maximum(low, a + 1), high), ("right", right, b, 1, low, np.minimum(np.minimum(high, length - 1 - b), a)))
        for way, grid, n, side, low_now, high_now in ways:
            more = np.flatnonzero((n < sizes[others, side]) & (low_now <= high_now))
            codes = n[more].astype(np.int64) * 256 + grid[others[more], n[more]]
            order = np.argsort(codes, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(codes[order])) + 1):
                if len(part) > 1:
                    at = more[part]
                    branch = xxhash.xxh64_intdigest(f"{group}/{way}/{codes[part[0]]}") - (1 << 63)
                    open_groups.append((branch, others[at], np.stack([low_now[at], high_now[at]], axis=1)))
    return spans, small


def _divide(length: int, most: int):
    """Spans and small groups of the groups of contexts that arrive sorted; a span has no core."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("suffix_dedup")
        rows: list[tuple] = []
        out: list[tuple] = []

        def close() -> None:
            if len(rows) > 1:
                grid = lambda k: np.frombuffer(b"".join(r[k].ljust(length, b"\0") for r in rows), np.uint8).reshape(len(rows), length)
                sizes, ends = np.array([[len(r[1]), len(r[2])] for r in rows]), np.array([r[7:9] for r in rows])
                spans, small = divide(rows[0][0], grid(1), grid(2), sizes, ends, [r[3:6] for r in rows], length, most)
                for k, a, b in spans:
                    out.append((None, None, None, *rows[k][3:5], None, None, None, None, rows[k][5] - a, rows[k][5] + b))
                for group, members, asked in small:
                    out.extend((group, *rows[k][1:7], *e, None, None) for k, e in zip(members.tolist(), asked.tolist(), strict=True))
            rows.clear()

        def flush() -> Iterator[pa.RecordBatch]:
            for first in range(0, len(out), 8 * PART):
                columns = zip(*out[first : first + 8 * PART], strict=True)
                arrays = [pa.array(c, t) for c, t in zip(columns, [*_CORE_TYPES, pa.int64(), pa.int64()], strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*_CORE_NAMES, "first", "last"])
            out.clear()

        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in _CORE_NAMES], strict=True):
                if rows and rows[0][0] != row[0]:
                    close()
                    if len(out) > 8 * PART:
                        yield from flush()
                rows.append(row)
        close()
        yield from flush()

    return run


def repeated_windows(cores: np.ndarray, lefts: list[bytes], rights: list[bytes], step: int) -> np.ndarray:
    """For each core, left and right flank the least and largest number of left bytes of those windows that occur again; (0, -1) if none does.

    All strings go into one text, each as left bytes, the core's symbol, right
    bytes and a common end symbol; windows hold ``step`` bytes and the core.
    """
    raw = b"".join(part for pair in zip(lefts, rights, strict=True) for part in (pair[0], b"\0", pair[1], b"\0")) + b"\0"
    text = np.frombuffer(raw, np.uint8).astype(np.int64) + 2
    n_left, n_right = np.array([len(x) for x in lefts]), np.array([len(x) for x in rights])
    ends = np.cumsum(n_left + n_right + 2) - 1
    middles = ends - n_right - 1
    text[middles] = np.unique(cores, return_inverse=True)[1] + 258
    text[ends], text[-1] = 1, 0
    symbols = text.tolist()
    shared = np.array(common_prefixes(symbols, suffix_array(symbols), step + 1))
    taken = np.arange(step + 1)
    inside = (taken <= n_left[:, None]) & (taken >= step - n_right[:, None])
    again = inside & (shared[np.maximum(middles[:, None] - taken, 0)] > step)
    return np.where(again.any(1)[:, None], np.stack([again.argmax(1), step - again[:, ::-1].argmax(1)], axis=1), [0, -1])


def _sizes(flanks: pa.Array) -> np.ndarray:
    return pc.binary_length(flanks).to_numpy().astype(np.int64)


def _shared(core: np.ndarray, flanks: list[bytes], step: int) -> np.ndarray:
    """How many first bytes of each flank, of at most ``step`` bytes, another one of its core has too."""
    n = len(core)
    keyed = np.zeros((n, 8 + step), np.uint8)
    keyed[:, :8] = core.astype(">i8").view(np.uint8).reshape(n, 8)
    keyed[:, 8:] = np.frombuffer(b"".join(x.ljust(step, b"\0") for x in flanks), np.uint8).reshape(n, step)
    order = np.argsort(keyed.view(f"V{8 + step}").ravel())
    same = np.append(keyed[order][1:] == keyed[order][:-1], np.zeros((n - 1, 1), bool), axis=1)
    agree = np.concatenate([[0], np.maximum(same.argmin(1) - 8, 0), [0]])
    shared = np.empty(n, np.int64)
    shared[order] = np.maximum(agree[1:], agree[:-1])
    return np.minimum(shared, [len(x) for x in flanks])


def _solve(length: int, step: int):
    """Covered spans of the single strings among those that arrive sorted by core."""

    def spans(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Spans of all rows of some cores."""
        rows = pa.concat_batches(parts)
        core, single = rows.column("core").to_numpy(), rows.column("single").to_numpy(zero_copy_only=False)
        group = np.cumsum(np.append(False, core[1:] != core[:-1]))
        kept = (np.bincount(group) > 1) & (np.bincount(group, single) > 0)
        rows, group, single = rows.filter(pa.array(kept[group])), group[kept[group]], single[kept[group]]
        if not rows.num_rows:
            return
        # two anchors may have led to one place, which must not count as two
        ids, hashes, at = rows.column("doc_id"), rows.column("text_hash").to_numpy(), rows.column("at").to_numpy()
        place = [group, ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(), hashes, at]
        order = np.lexsort((~single, *place[::-1]))
        new = np.append(True, np.any([x[order][1:] != x[order][:-1] for x in place], axis=0))
        which = np.sort(order[new])
        rows, group, single, at = rows.take(pa.array(which)), group[which], single[which], at[which]
        # a string that stands twice recurs as a whole; the others of its core are compared with one copy of it
        left, right = rows.column("left"), rows.column("right")
        flanks = [x.dictionary_encode().indices.to_numpy() for x in (left, right)]
        order = np.lexsort((*flanks, group))
        new = np.append(True, np.any([x[order][1:] != x[order][:-1] for x in (group, *flanks)], axis=0))
        kind = np.empty(len(order), np.int64)
        kind[order] = np.cumsum(new) - 1
        heads, times = order[new], np.bincount(kind)
        of_core = group[heads]
        windows = np.where((times > 1)[:, None], np.stack([np.maximum(0, step - _sizes(right)[heads]), _sizes(left)[heads]], axis=1), [0, -1])
        asked = (times == 1) & (np.bincount(kind, single) > 0)
        several, unknown = np.bincount(of_core) > 1, np.bincount(of_core, asked) > 0
        unclear = np.flatnonzero((several & unknown)[of_core])
        if len(unclear):
            taken, owner = pa.array(heads[unclear]), of_core[unclear]
            befores, afters = left.take(taken).to_pylist(), right.take(taken).to_pylist()
            # bytes that no other string of the core has at that place are in no window that occurs again
            n_left, n_right = _shared(owner, [x[::-1] for x in befores], step), _shared(owner, afters, step)
            hopeful = n_left + n_right >= step
            hopeful &= (np.bincount(owner, hopeful) > 1)[owner] & (np.bincount(owner, hopeful & asked[unclear]) > 0)[owner]
            place = np.flatnonzero(hopeful)
            # cores are compared in suffix arrays of about BLOCK symbols each, a core in one
            block = np.cumsum((n_left + n_right)[place] + 2) // BLOCK
            begins = np.flatnonzero(np.diff(owner[place], prepend=-1))
            for some in np.split(place, begins[1:][np.diff(block[begins]) > 0]):
                if len(some):
                    cut = [(befores[k][len(befores[k]) - a :], afters[k][:b]) for k, a, b in zip(some.tolist(), n_left[some].tolist(), n_right[some].tolist(), strict=True)]
                    found = repeated_windows(owner[some], [a for a, _ in cut], [b for _, b in cut], step)
                    some = unclear[some]
                    windows[some] = np.where(asked[some, None], found, windows[some])
        first, last = windows[kind].T
        held = np.flatnonzero(single & (first <= last))
        # windows that start at most ``step`` bytes apart overlap, so the first and the last one bound one run
        own = [rows.column(c).take(pa.array(held)) for c in ("doc_id", "text_hash")]
        yield pa.RecordBatch.from_arrays([*own, pa.array((at - last)[held]), pa.array((at - first)[held] + length)], names=["doc_id", "text_hash", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("suffix_dedup")
        open_rows: list[pa.RecordBatch] = []
        for batch in batches:
            batch = batch.select(["core", "left", "right", "doc_id", "text_hash", "at", "single"])
            if not batch.num_rows:
                continue
            core = batch.column("core").to_numpy()
            cut = int(np.searchsorted(core, core[-1]))  # the last core may go on in the next batch
            if cut or (open_rows and open_rows[0].column("core")[0].as_py() != core[0]):
                yield from spans([*open_rows, batch.slice(0, cut)])
                open_rows = []
            open_rows.append(batch.slice(cut))
        if open_rows:
            yield from spans(open_rows)

    return run


# --- the operator -------------------------------------------------------------


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, step: int = STEP) -> DataFrame:
    """(doc_id, text_hash, spans): for texts with repeated bytes, the sorted, merged (first, last) byte spans to remove, end exclusive."""
    if not 0 < gram < length or (length - gram) % (2 * step):
        raise ValueError("the gram must be shorter than the length, and twice the step divide what lies between")
    reach = length - gram
    docs = pick(docs, "doc_id", "text").where(F.octet_length("text") >= length).withColumn("text_hash", F.xxhash64("text"))
    scanned = written(
        docs.transform(in_batches, _scan(length, gram), "doc_id long, text_hash long, at long, gram long, context long, left long, right long, low long, high long, n long, places array<long>"), "anchors"
    )
    # Tables on both sides of these joins are written ones, so that Spark can split a hot gram or context; no side is broadcast.
    found = scanned.where("places is null").drop("places")
    contexts = written(found.groupBy("gram", "context").agg(F.sum("n").alias("total")), "contexts")
    grams = contexts.groupBy("gram").agg(F.count("*").alias("kinds"), F.sum("total").alias("uses")).where("uses > 1")
    grams = written(grams.select("gram", (F.col("kinds") > 1).alias("several")), "grams")
    repeated = written(contexts.join(grams.hint("merge"), "gram").where("total > 1 or several"), "repeated")
    placed = written(found.drop("n").join(repeated.hint("merge"), ["gram", "context"]), "placed")

    whole = placed.where("total > 1").select("doc_id", "text_hash", F.greatest(F.col("at") - reach, F.lit(0)).alias("first"), (F.col("at") + length).alias("last"))
    pairs = F.expr("transform(sequence(0, cast(size(places) div 2 as int) - 1), k -> struct(places[2 * k] as a, places[2 * k + 1] as b))")
    inner = (
        scanned.where("places is not null")
        .select("doc_id", "text_hash", F.explode(pairs).alias("p"))
        .select("doc_id", "text_hash", F.greatest(F.col("p.a") - reach, F.lit(0)).alias("first"), (F.col("p.b") + length).alias("last"))
    )

    # each distinct context once, with the number of contexts that have its halves
    one = F.struct("doc_id", "text_hash", "at", "left", "right", "low", "high", (F.col("total") == 1).alias("single"))
    listed = placed.where("several and total = 1").select("gram", one.alias("o"))
    others = placed.where("several and total > 1").dropDuplicates(["gram", "context"]).select("gram", one.alias("o"))
    listed = written(listed.unionByName(others).select("gram", "o.*"), "listed")
    for side in ("left", "right"):
        shared = listed.where(f"{side} <> 0").groupBy("gram", side).agg(F.count("*").alias(f"n_{side}")).where(f"n_{side} > 1")
        listed = listed.join(written(shared, "shared").hint("merge"), ["gram", side], "left")
    listed = listed.where("n_left > 1 or n_right > 1")
    few = lambda side: F.coalesce(F.col(f"n_{side}").between(2, MOST), F.lit(False)).alias(side)
    group = lambda side: F.when(F.col(f"n_{side}") > MOST, F.xxhash64(F.lit(side), "gram", side)).alias(f"{side}_group")
    spot = F.struct("at", few("left"), few("right"), group("left"), group("right"), "single", "low", "high")
    wanted = listed.groupBy(F.col("doc_id").alias("i"), F.col("text_hash").alias("h")).agg(F.collect_list(spot).alias("spots"))
    texts = _zipped(docs).join(wanted.hint("merge"), F.expr("doc_id <=> i and text_hash = h")).select("doc_id", "text_hash", "zipped", "spots")
    # repeated rows have no single context, but one of them may stand for its context; the solver drops its copies
    cores = written(texts.transform(in_batches, _cores(length, gram, step), CORES), "cores")
    spans, small = _divided(cores.where("low is not null"), length)
    cores = cores.where("low is null")
    cores = cores.unionByName(small.transform(in_batches, _context_cores(length, gram, step), CORES))
    near = cores.drop("low", "high").repartition("core").sortWithinPartitions("core")
    near = near.transform(in_batches, _solve(length, step), "doc_id long, text_hash long, first long, last long")
    spans = reduce(DataFrame.unionByName, [whole, inner, near, *spans])
    return spans.groupBy("doc_id", "text_hash").agg(_merged(F.sort_array(F.collect_set(F.struct("first", "last")))).alias("spans"))


def _merged(spans: Column) -> Column:
    """Sorted spans with those that touch or overlap made one."""
    none = F.expr("cast(array() as array<struct<first:bigint,last:bigint>>)")

    def step(acc, x):
        end = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(end["first"].alias("first"), F.greatest(end["last"], x["last"]).alias("last"))))
        fresh = F.array_append(acc, F.struct(x["first"].alias("first"), x["last"].alias("last")))
        return F.when((F.size(acc) > 0) & (x["first"] <= F.try_element_at(acc, F.lit(-1))["last"]), joined).otherwise(fresh)

    return F.aggregate(spans, none, lambda acc, x: step(acc, x))


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, spans, kept): one row for each row of ``docs``; kept is the remaining bytes.

    A byte goes if a string of ``length`` bytes that covers it starts anywhere
    else too, in any document or the same one. Null and empty texts have no
    bytes; repeated rows are repeats of each other; an empty table gives an
    empty result.
    """
    docs = pick(docs, "doc_id", "text")
    found = repeated_spans(docs, length).select(F.col("doc_id").alias("i"), F.col("text_hash").alias("h"), "spans")
    rows = docs.withColumn("text_hash", F.xxhash64("text"))
    joined = _zipped(rows).join(found.hint("merge"), F.expr("doc_id <=> i and text_hash <=> h"), "left").select("doc_id", "zipped", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sizes, kept, inside = [], [], []
                for raw, spans in zip(_unzipped(part.column("zipped")), part.column("spans").to_pylist(), strict=True):
                    spans = [(s["first"], min(s["last"], len(raw))) for s in spans or []]
                    ends = [0, *[b for _, b in spans]], [*[a for a, _ in spans], len(raw)]
                    sizes.append(len(raw))
                    kept.append(b"".join(raw[a:b] for a, b in zip(*ends, strict=True)))
                    inside.append([{"first": a, "last": b} for a, b in spans])
                removed = [n - len(k) for n, k in zip(sizes, kept, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *[pa.array(x, pa.int64()) for x in (sizes, removed, [len(s) for s in inside])], pa.array(inside, SPANS), pa.array(kept, pa.binary())],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"],
                )

    return joined.transform(in_batches, cut, "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<first:long,last:long>>, kept binary")
