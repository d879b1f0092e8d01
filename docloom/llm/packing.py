"""Packing token pieces into windows by non-negative least squares.

Every document's ids are cut into whole windows, one main piece whose length is
a multiple of a unit, and a tail shorter than the unit. Main lengths then take
few values, so their histogram is bounded by the window, not by the data.
Shallow combinations of lengths that fill a window exactly are enumerated, their
repeat counts are solved against the histogram by non-negative least squares
and rounded down to what is there. Pieces are dealt to the combinations by their
rank within their length. Tails and the few main pieces left over are packed
greedily in many independent groups.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain, combinations_with_replacement
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import WordMemory, in_batches, pick, worker_state, written

WINDOW = 4096
UNIT = 64
END_ID = 2
#: Bytes of words and ids that a Python worker remembers: at most two generations of about this many.
CACHE_BYTES = 48_000_000
#: Texts whose words are looked up together; a batch bounds their bytes.
PART_TEXTS = 1024
#: Pieces that one greedy group or one rank bucket holds about.
GROUP_PIECES = 8000

#: Control characters that Python, but not the tokenizer, takes for white space.
_ODD = re.compile("[\x1c-\x1f]")


# How a tokenizer file that lower-cases, drops white space and never joins across it says so.
LOWERED = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


class WordTokenizer:
    """A tokenizer file's ids, with those of the words seen.

    Where the file drops white space and never joins across it, a text's ids are
    those of its words in turn. Words of lower-case letters in composed form then
    need no normalising and are one piece before merging; these skip the patterns
    of the full tokenizer. Texts that hold an added token literally, and all texts
    of any other kind of file, go through the full tokenizer whole.
    """

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        parts = json.loads(definition)
        self.full = Tokenizer.from_str(definition)
        self.by_word = parts["normalizer"] == LOWERED and parts["pre_tokenizer"] == SPLIT and not any(x["normalized"] for x in parts["added_tokens"])
        self.added = [x["content"] for x in parts["added_tokens"]]
        plain = {"normalizer": None, "post_processor": None, "decoder": None, "added_tokens": []}
        to_bytes = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        plain["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, to_bytes]}
        self.plain = Tokenizer.from_str(json.dumps(parts | plain))
        self.mark = parts["model"].get("end_of_word_suffix") or ""
        words = self.plain.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(words.values()) + 1, bool)
        self.ends[[k for w, k in words.items() if self.mark and w.endswith(self.mark)]] = True
        self.memory = WordMemory(CACHE_BYTES)

    def _whole(self, text: str) -> bool:
        """Whether a text goes through the full tokenizer as it is; an added token that only lower-casing would make is none there."""
        if not self.by_word or _ODD.search(text) is not None:
            return True
        low = text.lower()
        return any(x in text or x.lower() in low for x in self.added)

    def _plain(self, words: list[str]) -> Iterator[bytes]:
        """Ids of words of which each ends with an id that the vocabulary marks as an end; many share one call."""
        for e in self.plain.encode_batch_fast([" ".join(words[k : k + 500]) for k in range(0, len(words), 500)], add_special_tokens=False):
            ids = np.array(e.ids, "<u4")
            raw, cuts = ids.tobytes(), [0, *(4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()]
            yield from (raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False))

    def encode(self, parts: list[str]) -> list[bytes]:
        easy = [bool(self.mark) and w.isalpha() and w == w.lower() and is_normalized("NFC", w) for w in parts]
        rest = self.full.encode_batch_fast([w for w, x in zip(parts, easy, strict=True) if not x], add_special_tokens=False)
        ids = (iter([array("I", e.ids).tobytes() for e in rest]), self._plain([w for w, x in zip(parts, easy, strict=True) if x]))
        return [next(ids[x]) for x in easy]

    def token_bytes(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [None if self._whole(t) else t.encode("utf-8", "replace").lower().decode().split() for t in texts]
        fresh = self.memory.missing(set(chain.from_iterable(s for s in split if s)))
        ids = self.memory.young  # holds every word of these texts once the fresh ones are put in
        # a letter before a final comma or full stop ends a token, so such parts share the ids of what precedes
        ended = {w for w in fresh if w[-1] in ",." and len(w) > 1 and w[-2].isalpha()}
        rest = list({w for w in chain((w[:-1] for w in ended), (",", ".")) if w not in ids} | (fresh - ended))
        made = dict(zip(rest, self.encode(rest), strict=True))
        self.memory.put(made)
        self.memory.put({w: ids[w[:-1]] + ids[w[-1]] for w in ended})
        return [array("I", self.full.encode(t, add_special_tokens=False).ids).tobytes() if s is None else b"".join(map(ids.__getitem__, s)) for t, s in zip(texts, split, strict=True)]


def tokenizer_of(definition: str) -> WordTokenizer:
    """One tokenizer per Python worker and definition."""
    kept = worker_state("packing")
    if definition not in kept:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; more threads only hold memory
        kept[definition] = WordTokenizer(definition)
    return kept[definition]


def _cut(definition, window: int, unit: int, end_id: int, with_ids: bool):
    tail = array("I", [end_id]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_of(definition.value)
        for batch in batches:
            for at in range(0, batch.num_rows, PART_TEXTS):
                part = batch.slice(at, PART_TEXTS)
                rows: list[list] = [[] for _ in range(6)]
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), tokenizer.token_bytes([t or "" for t in part.column("text").to_pylist()]), strict=True):
                    ids += tail
                    n = len(ids) // 4
                    whole, rest = n // window * window, n % window // unit * unit
                    cuts = [*range(0, whole, window), whole, whole + rest, n]
                    for a, b in zip(cuts, cuts[1:], strict=False):
                        if a < b:
                            piece = ids[4 * a : 4 * b]
                            for column, value in zip(rows, (doc_id, a, b - a, zlib.crc32(piece), n, piece if with_ids else None), strict=True):
                                column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(rows, [pa.int64()] * 5 + [pa.binary()], strict=True)],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"],
                )

    return run


def fillings(total: int, parts: int = 4) -> np.ndarray:
    """Combinations that sum to ``total``: all of at most ``parts`` parts, and all of two distinct lengths repeated; a row of counts each."""
    found = {(total,)}
    for n in range(2, parts + 1):
        for lead in combinations_with_replacement(range(1, total), n - 1):
            last = total - sum(lead)
            if last >= lead[-1]:
                found.add((*lead, last))
    for a in range(1, total):
        for k in range(1, total // a + 1):
            left = total - k * a
            if left == 0:
                found.add((a,) * k)
            for b in range(a + 1, left + 1):
                if left % b == 0:
                    found.add((a,) * k + (b,) * (left // b))
    out = np.zeros((len(found), total + 1))
    for row, combination in zip(out, sorted(found), strict=True):
        np.add.at(row, list(combination), 1)
    return out[:, 1:]


def nnls(a: np.ndarray, y: np.ndarray, rounds: int = 500) -> np.ndarray:
    """x >= 0 that minimises |a x - y|, by the active-set method of Lawson and Hanson."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(rounds):
        gain = a.T @ (y - a @ x)
        gain[active] = -np.inf
        best = int(gain.argmax())
        if gain[best] <= 1e-9 * (1 + np.abs(y).max()):
            break
        active[best] = True
        while True:
            columns = np.flatnonzero(active)
            s = np.linalg.lstsq(a[:, columns], y, rcond=None)[0]
            if (s > 0).all():
                x[:] = 0
                x[columns] = s
                break
            low = s <= 0
            step = (x[columns][low] / (x[columns][low] - s[low] + 1e-300)).min()
            x[columns] += step * (s - x[columns])
            active[columns[low & (x[columns] <= 1e-9)]] = False
            x[~active] = 0
    return x


def repeat_counts(histogram: np.ndarray, combos: np.ndarray) -> np.ndarray:
    """Whole repeats of each combination, never using more of a length than ``histogram`` (lengths 1..n) has."""
    solved = nnls(combos.T, histogram.astype(float))
    left, repeats = histogram.astype(np.int64), np.zeros(len(combos), np.int64)
    order = [*np.argsort(-solved, kind="stable")[: int((solved > 0.5).sum())], *np.argsort(combos.sum(1), kind="stable")]
    for k, p in enumerate(order):
        used = combos[p] > 0
        n = int((left[used] // combos[p][used].astype(np.int64)).min())
        n = min(n, int(solved[p])) if k < int((solved > 0.5).sum()) else n
        if n > 0:
            repeats[p] += n
            left -= n * combos[p].astype(np.int64)
    return repeats


def _ranked(pieces: DataFrame, key: str, n_groups: int) -> DataFrame:
    """Adds ``rank``, 0-based within ``key``; ranks are counted in groups of rows and shifted by the groups before."""
    salted = pieces.withColumn("group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(n_groups)))
    sizes = salted.groupBy(key, "group").agg(F.count("*").alias("n"))
    before = Window.partitionBy(key).orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(key, "group", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    own = Window.partitionBy(key, "group").orderBy("doc_id", "start", "ids_crc32")
    return salted.withColumn("rank", F.row_number().over(own) - 1).join(shifts, [key, "group"]).withColumn("rank", F.col("rank") + F.col("shift")).drop("shift", "group")


def best_fit(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece, the longest first, each into the fullest bin that still takes it."""
    room: list[list[int]] = [[] for _ in range(window + 1)]
    bins, offsets, n = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    open_rooms = np.zeros(window + 1, bool)
    for k in np.argsort(-lengths, kind="stable"):
        need = int(lengths[k])
        ahead = int(open_rooms[need:].argmax()) + need
        if open_rooms[ahead]:
            at = room[ahead].pop()
            open_rooms[ahead] = bool(room[ahead])
        else:
            at, ahead, n = n, window, n + 1
        bins[k], offsets[k] = at, window - ahead
        room[ahead - need].append(at)
        open_rooms[ahead - need] = True
    return bins, offsets


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, unit: int = UNIT, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and their ids if asked for.

    A null or empty text is the end id alone. Each id lies in exactly one piece;
    the pieces of a sequence are gapless from 0 and fill at most ``window``.
    Repeated rows are documents of their own. An empty table packs to nothing.
    """
    if window % unit:
        raise ValueError("the window must be a multiple of the unit")
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file, whatever the data's size
    pieces = pick(docs, "doc_id", "text").transform(
        in_batches,
        _cut(definition, window, unit, end_id, with_ids), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
    )
    pieces = written(pieces if with_ids else pieces.drop("ids"), "pieces")
    spark = pieces.sparkSession
    mains = pieces.where(f"length % {unit} = 0").withColumn("units", (F.col("length") / unit).cast("int"))
    total = window // unit
    histogram = np.zeros(total, np.int64)
    for row in mains.groupBy("units").count().collect():  # at most window / unit rows
        histogram[row["units"] - 1] = row["count"]
    combos = fillings(total)
    repeats = repeat_counts(histogram, combos)
    slots, used, sequence = [], np.zeros(total, np.int64), 0
    for p in np.flatnonzero(repeats):
        n, offset = int(repeats[p]), 0
        for k in np.flatnonzero(combos[p]):
            each = int(combos[p][k])
            slots.append((int(k) + 1, int(used[k]), int(used[k]) + n * each, each, offset, sequence))
            used[k] += n * each
            offset += each * (int(k) + 1) * unit
        sequence += n
    plan = spark.createDataFrame(slots, "units int, low long, high long, each long, base long, first long")
    n_groups = max(64, int(histogram.sum()) // GROUP_PIECES)
    ranked = _ranked(mains, "units", n_groups)
    # the plan has a row per length and combination in use, a number that the window bounds
    placed = ranked.join(F.broadcast(plan.withColumnRenamed("units", "u")), F.expr("units = u and rank >= low and rank < high"), "left")
    placed = written(placed.drop("u"), "placed")
    own = F.col("rank") - F.col("low")
    filled = placed.where("first is not null").select(
        *pieces.columns,
        (F.col("first") + F.floor(own / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("base") + own % F.col("each") * F.col("length")).cast("long").alias("offset"),
    )
    rest = placed.where("first is null").select(*pieces.columns).unionByName(pieces.where(f"length % {unit} > 0"))
    n_rest = rest.count()
    fits = max(1, n_rest // GROUP_PIECES)
    rest = rest.withColumn("pack", F.pmod(F.xxhash64("doc_id", "ids_crc32", "start"), F.lit(fits)))
    columns = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes)

    def greedy(key, frame):
        frame = frame.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=False, kind="stable")
        bins, offsets = best_fit(frame["length"].to_numpy(), window)
        return frame.drop(columns="pack").assign(sequence_id=(1 << 50) + (int(key[0]) << 24) + bins, offset=offsets)

    packed = rest.groupBy("pack").applyInPandas(greedy, f"{columns}, sequence_id long, offset long")
    return filled.unionByName(packed)
