"""Quality rules by compression bands.

How far zstandard shrinks a text, as a whole and in fixed chunks, tells
repetitive or patterned text (shrinks too far) from encoded or random text
(hardly shrinks). What is usual depends on the length, so limits belong to bands
of it, BANDS_PER_OCTAVE to each doubling. A band's limits lie WIDTHS robust
deviations below and above the median ratio that the corpus has there; both come
from exact counts of ratios over all texts. Bands with few texts take those of the
nearest band with enough, and outside all of it stand fixed limits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytewords import SAME, SPACE, slices, windows, words_of
from .shared import in_batches, pick, with_keys, worker_state, written

#: (bytes from, least ratio, largest ratio) that hold in any corpus; no least ratio below 256 bytes, where the frame's header weighs too much.
FIXED = ((0, 0.0, 3.0), (256, 1.2, 3.5), (1024, 1.4, 4.0), (4096, 1.4, 4.5), (16384, 1.4, 5.0), (131072, 1.4, 6.0))
#: Texts of more than CHUNK bytes are also judged in equal chunks of at most that many; limits of any corpus, and the share of bad ones.
CHUNK, FIXED_CHUNK, BAD_SHARE = 2048, (1.4, 4.0), 0.25
#: Bands of length; deviations from the median, below and above; texts that a band needs for limits of its own; ratios are counted to STEP, up to TOP.
BANDS_PER_OCTAVE, WIDTHS, ENOUGH, STEP, TOP = 2, (5.0, 3.5), 100, 0.005, 20.0
LEVEL = 3
#: Base rules.
LEAST_WORDS, REPEAT_PERCENT = 50, 50

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_WHITE = " \t\n\x0b\x0c\r"


def repeated_words(hashes: np.ndarray, width: int = 3) -> int:
    """Words that lie in a window of ``width`` words found twice or more, the first one included."""
    keys = windows(hashes, width)
    if len(keys) < 2:
        return 0
    order = np.sort(keys)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    found = twice[np.minimum(np.searchsorted(twice, keys), len(twice) - 1)] == keys
    covered = np.zeros(len(hashes), bool)
    for k in range(width):
        covered[k : k + len(found)] |= found
    return int(covered.sum())


def duplicate_lines(text: str) -> int:
    """Lines that hold a word and equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(_WHITE)]
    return len(lines) - len(set(lines))


def compression(raw: bytes, compress) -> tuple[float, list[dict]]:
    """Ratio of the whole text, and length and ratio of each of its equal chunks where it is longer than one."""
    if not raw:
        return 0.0, []
    chunks, n = [], -(-len(raw) // CHUNK)
    if n > 1:
        cuts = [len(raw) * k // n for k in range(n + 1)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            chunks.append({"n": b - a, "ratio": (b - a) / len(compress(raw[a:b]))})
    return len(raw) / len(compress(raw)), chunks


_COUNTS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"
_FIGURES = f"doc_id long, text_hash long{_COUNTS.removeprefix('doc_id long')}, n_bytes long, ratio double, chunks array<struct<n:long,ratio:double>>"
_CHUNKS = pa.list_(pa.struct([("n", pa.int64()), ("ratio", pa.float64())]))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    worker_state("quality_bands")
    compress = zstandard.ZstdCompressor(level=LEVEL).compress
    for batch in batches:
        texts = batch.column("text")
        rows = []
        for _, data, bounds in slices(texts):
            words = words_of(data, bounds, fold=SAME)
            heads = np.concatenate([[0], np.cumsum(((data & 0xC0) != 0x80) & ~SPACE[data])])
            symbols = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
            for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                raw = data[a:b].tobytes()
                first, last = words.first[k], words.first[k + 1]
                n = int(last - first)
                again = repeated_words(words.hashes[first:last])
                failed = n < LEAST_WORDS or 100 * again > REPEAT_PERCENT * n
                rows.append((n, int(heads[b] - heads[a]), int(symbols[b] - symbols[a]), duplicate_lines(raw.decode()), again, failed, len(raw), *compression(raw, compress)))
        if rows:
            *columns, chunks = zip(*rows, strict=True)
            columns = [batch.column("doc_id"), batch.column("text_hash"), *[pa.array(c) for c in columns], pa.array(chunks, _CHUNKS)]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _FIGURES.split(", ")])


def band_of(n_bytes: Column) -> Column:
    return F.floor(F.log2(F.greatest(n_bytes, F.lit(1))) * BANDS_PER_OCTAVE).cast("int")


def _quantile(values: np.ndarray, counts: np.ndarray, share: float) -> float:
    """The value below which ``share`` of the counted values lie, those of one value spread evenly over its step."""
    upto = np.cumsum(counts)
    at = int(np.searchsorted(upto, share * upto[-1]))
    return float(values[at] + STEP * (share * upto[-1] - (upto[at] - counts[at])) / counts[at])


def fitted(counts: dict[int, dict[int, int]]) -> dict[int, tuple[float, float]]:
    """(least, largest) usual ratio of each band that has ENOUGH texts, from band -> ratio in steps -> texts."""
    limits = {}
    for band, bins in counts.items():
        if sum(bins.values()) >= ENOUGH:
            steps = sorted(bins)
            values, sizes = np.array(steps) * STEP, np.array([bins[b] for b in steps])
            low, mid, high = (_quantile(values, sizes, q) for q in (0.25, 0.5, 0.75))
            # half the quartile range on either side would let junk widen the range that it should fall out of
            deviation = max(STEP, (mid - low) / 0.6745)
            limits[band] = (mid - WIDTHS[0] * deviation, mid + WIDTHS[1] * deviation)
    return limits


def bands(figures: DataFrame) -> dict[str, dict[int, tuple[float, float]]]:
    """Limits of whole texts and of chunks by band, learned from all texts that pass the base rules.

    Counts of at most 2 kinds x bands x TOP / STEP ratios come to the driver, however many texts there are.
    """
    passed = figures.where("not base_failed and n_bytes > 0")
    whole = passed.select(F.lit("text").alias("kind"), "n_bytes", "ratio")
    chunks = passed.select(F.explode("chunks").alias("c")).select(F.lit("chunk").alias("kind"), F.col("c.n").alias("n_bytes"), F.col("c.ratio").alias("ratio"))
    binned = whole.unionByName(chunks).select("kind", band_of(F.col("n_bytes")).alias("band"), F.floor(F.least("ratio", F.lit(TOP)) / STEP).cast("int").alias("bin"))
    counts: dict[str, dict[int, dict[int, int]]] = {"text": {}, "chunk": {}}
    for row in binned.groupBy("kind", "band", "bin").count().collect():
        counts[row["kind"]].setdefault(row["band"], {})[row["bin"]] = row["count"]
    return {kind: fitted(x) for kind, x in counts.items()}


def limits_at(limits: dict[int, tuple[float, float]], kind: str, band: int) -> tuple[float, float]:
    """Limits of a band: fixed ones, narrowed by those learned for it, or between two bands that have some on the line between these."""
    if kind == "chunk":
        low, high = FIXED_CHUNK
    else:
        low, high = next((lo, hi) for least, lo, hi in reversed(FIXED) if 2 ** (band / BANDS_PER_OCTAVE) >= least)
    below, above = max((b for b in limits if b <= band), default=None), min((b for b in limits if b >= band), default=None)
    if below is not None and above is not None:
        share = (band - below) / max(1, above - below)
        own = [x + share * (y - x) for x, y in zip(limits[below], limits[above], strict=True)]
        low, high = (max(low, own[0]) if low else low), min(high, own[1])
    return low, high


def _limit(limits: dict[int, tuple[float, float]], kind: str, band: Column, which: int) -> Column:
    # 64 octaves hold any length
    return F.get(F.array(*[F.lit(limits_at(limits, kind, b)[which]) for b in range(64 * BANDS_PER_OCTAVE)]), band)


def _judged(docs: DataFrame) -> DataFrame:
    docs = pick(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    figures = written(docs.transform(in_batches, _measure, _FIGURES), "figures")
    found = bands(figures)
    band = band_of(F.col("n_bytes"))
    least, most = (_limit(found["text"], "text", band, k) for k in (0, 1))
    outside = lambda c: (c["ratio"] < _limit(found["chunk"], "chunk", band_of(c["n"]), 0)) | (c["ratio"] > _limit(found["chunk"], "chunk", band_of(c["n"]), 1))
    size = lambda chunks: F.aggregate(chunks, F.lit(0).cast("long"), lambda acc, c: acc + c["n"])
    share = F.when(F.size("chunks") > 0, size(F.filter("chunks", outside)) / F.col("n_bytes")).otherwise(0.0)
    judged = figures.withColumns({"least_ratio": least, "largest_ratio": most, "bad_chunk_share": share})
    verdict = (
        F.when(F.col("ratio") > F.col("largest_ratio"), "repetitive")
        .when(F.col("ratio") < F.col("least_ratio"), "incompressible")
        .when(F.col("bad_chunk_share") > BAD_SHARE, "bad_chunks")
        .otherwise("ok")
    )
    return judged.withColumn("verdict", verdict).withColumn("kept", ~F.col("base_failed") & (F.col("verdict") == "ok"))


def assess(docs: DataFrame) -> DataFrame:
    """Base counts, compression figures and verdict, one row for each row of ``docs``.

    kept is false where a base rule fails (under LEAST_WORDS words, or over
    REPEAT_PERCENT of the words in repeated 3-word windows), else whether the
    verdict is ``ok``. A null or empty text has no words and is not kept;
    repeated rows fare alike and count each; an empty table gives an empty
    result; other columns are ignored.
    """
    names = [c.split()[0] for c in _COUNTS.split(", ")]
    return _judged(docs).select(*names, "kept", "n_bytes", "ratio", "least_ratio", "largest_ratio", "bad_chunk_share", "verdict")


def keep_good(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that are not kept.

    Rows go by id and text, so a row of another text with the same id is judged
    by its own; rows without text go. Other columns, whatever their names, pass through.
    """
    gone = _judged(docs).where("not kept").select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct()
    keyed, (own_id, own_hash) = with_keys(docs, F.col("doc_id"), F.xxhash64("text"))
    left = keyed.join(gone, (keyed[own_hash] == gone["gone_hash"]) & keyed[own_id].eqNullSafe(gone["gone_id"]), "left_anti")
    return left.drop(own_id, own_hash)
