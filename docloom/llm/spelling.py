"""Spelling variants: words one edit apart, grouped under the form that is far more frequent.

Words are counted in tasks and summed before any of them meet. Near words are
found by self-joins of tries. A near pair has its one edit in the first or in the
second half of the words, so it shares the second half or the first; words that share a
half form a bucket, and the trie of a bucket holds what is left of its words.
Down this trie goes a set of active nodes, those within one edit of
the path so far, and terminal nodes that are active at a terminal node
are near words. Buckets of very many words are halved again, with the edit in a
quarter, an eighth and so on; they end at one free letter, which the alphabet bounds.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import in_batches, pick, written

LEAST_LETTERS = 6
LEAST_COUNT = 5
#: A form has at least this many times the occurrences of its variant.
TIMES = 5
#: One run in this many loses a letter.
ONE_IN = 199
#: Words in a bucket before it is halved again.
MOST = 4096
#: Different words that a task counts before it passes them on.
HELD = 150_000
#: Characters of a text that are looked at at once; a longer run of letters stays whole.
PIECE = 1 << 20

_RUN = re.compile("[a-zÀ-ÿ]+")
_STOP = re.compile("[^A-Za-zÀ-ÿ]")


def _pieces(text: str) -> Iterator[str]:
    """The text in parts that end at no letter, with A-Z lower-cased."""
    at = 0
    while at < len(text):
        to = at + PIECE
        if to < len(text):
            end = _STOP.search(text, to)
            to = end.start() if end else len(text)
        yield text[at:to].encode("utf-8", "replace").lower().decode()
        at = to


def damaged(doc_id: object, run: str) -> str:
    """The run, or for one in ONE_IN what is left of it without the letter that the checksum names."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % ONE_IN:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def _counted(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                for piece in _pieces(text.as_py() or ""):
                    for word, n in Counter(_RUN.findall(piece)).items():
                        if len(word) >= least:
                            word = damaged(doc_id, word)
                            if len(word) >= least:
                                held[word] += n
                    if len(held) >= HELD:
                        yield out()
                        held.clear()
        if held:
            yield out()

    return run


def vocabulary(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words of whole texts that have enough letters and occurrences.

    A null text has none. A null id counts as an empty one in the checksum.
    Repeated rows count each time; an empty table gives no words.
    """
    parts = in_batches(pick(docs, "doc_id", "text"), _counted(least_letters), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _halves(lead: str, tail: str, differ: str) -> str:
    """SQL for the two buckets below one: the edit is in the second, or else in the first half of what the bucket leaves free.

    Pairs whose edit may lie in either half share the first one; the other
    bucket passes them over, as its pairs have to differ in their first ``differ`` letters.
    """
    first = f"floor((least - {lead} - {tail}) / 2)"
    return f"""array(named_struct('least', least, 'lead', cast({lead} + {first} as int), 'tail', cast({tail} as int), 'differ', cast({differ} as int)),
        named_struct('least', least, 'lead', cast({lead} as int), 'tail', cast(least - {lead} - {first} as int), 'differ', cast(least({differ}, {lead} + {first}) as int)))"""


def _keyed(entries: DataFrame) -> DataFrame:
    at = F.col("at")
    lead, tail = F.expr("substring(word, 1, at.lead)"), F.expr("right(word, at.tail)")
    return entries.withColumn("bucket", F.concat_ws(" ", at["least"], at["lead"], at["tail"], at["differ"], lead, tail))


def buckets(words: DataFrame, most: int = MOST) -> DataFrame:
    """(word, n, at, bucket): each word beside all words that share a half with it, in buckets of at most ``most`` where letters are left to halve.

    ``at.least`` is the length of the shorter word of a pair. A word meets words of its own
    length, words one letter longer and words one letter shorter, the last two in buckets of the shorter one's length.
    """
    lengths = words.withColumn("least", F.explode(F.expr("array(char_length(word), char_length(word) - 1)"))).where(F.col("least") > 0)
    entries = lengths.withColumn("at", F.explode(F.expr(_halves("0", "0", "2147483647")))).drop("least")
    entries = written(_keyed(entries), "spelling")
    done = None
    while True:
        free = F.expr("at.least - at.lead - at.tail")
        crowded = written(entries.where(free > 1).groupBy("bucket").count().where(F.col("count") > most).select("bucket"), "crowded")
        if crowded.isEmpty():
            return entries if done is None else done.unionByName(entries)
        rest = entries.join(crowded, "bucket", "left_anti").select(*entries.columns)
        done = rest if done is None else done.unionByName(rest)
        again = entries.join(crowded, "bucket", "left_semi").withColumn("least", F.expr("at.least"))
        again = again.withColumn("at", F.explode(F.expr(_halves("at.lead", "at.tail", "at.differ"))))
        entries = written(_keyed(again.drop("least")).select(*done.columns), "spelling")


class Trie:
    """A trie over distinct strings; node 0 is the root, ``ends[v]`` the index of the string that ends at v, or -1."""

    def __init__(self, strings: list[str]):
        self.below: list[dict[str, int]] = [{}]
        self.ends = [-1]
        for k, s in enumerate(strings):
            v = 0
            for letter in s:
                w = self.below[v].get(letter)
                if w is None:
                    w = self.below[v][letter] = len(self.below)
                    self.below.append({})
                    self.ends.append(-1)
                v = w
            self.ends[v] = k

    def near_pairs(self) -> Iterator[tuple[int, int]]:
        """Pairs of strings with exactly one insertion, deletion or replacement between them, each way.

        The active nodes of a node are those whose strings are within one edit
        of its own, with that distance. Those of a child follow from its parent's.
        """
        below, ends = self.below, self.ends
        start = {0: 0} | dict.fromkeys(below[0].values(), 1)
        stack = [(0, start)]
        while stack:
            v, active = stack.pop()
            if ends[v] >= 0:
                yield from ((ends[v], ends[w]) for w, far in active.items() if far and ends[w] >= 0)
            for letter, child in below[v].items():
                found: dict[int, int] = {}
                for w, far in active.items():
                    if far:  # no edit is left: only the same letter leads on
                        x = below[w].get(letter)
                        if x is not None:
                            found.setdefault(x, 1)
                        continue
                    found.setdefault(w, 1)  # the child's letter is an insertion
                    for other, x in below[w].items():
                        if other != letter:
                            found.setdefault(x, 1)
                            continue
                        found[x] = 0
                        for y in below[x].values():  # one letter more on the other side
                            found.setdefault(y, 1)
                stack.append((child, found))


def near_words(words: list[str], counts: list[int], least: int, lead: int, tail: int, differ: int) -> list[tuple[str, int, int, str]]:
    """(word, near words, occurrences of the most frequent one, that one) of a bucket's words; equally frequent ones go by code points."""
    trie = Trie([w[lead : len(w) - tail] for w in words])
    best: dict[int, tuple[int, str]] = {}
    n_near: Counter = Counter()
    for a, b in trie.near_pairs():
        x, y = words[a], words[b]
        if min(len(x), len(y)) == least and x[:differ] != y[:differ]:
            n_near[a] += 1
            found = (-counts[b], y)
            if a not in best or found < best[a]:
                best[a] = found
    return [(words[a], n, -best[a][0], best[a][1]) for a, n in n_near.items()]


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words of each bucket; rows come sorted by bucket."""
    names = ["word", "n_near", "near_n", "near"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
    bucket, words, counts, at, found = None, [], [], None, []

    def settle() -> None:
        if len(words) > 1:
            found.extend(near_words(words, counts, **at))

    for batch in batches:
        for key, word, n, where in zip(*(batch.column(c).to_pylist() for c in ("bucket", "word", "n", "at")), strict=True):
            if key != bucket:
                settle()
                bucket, words, counts, at = key, [], [], where
            words.append(word)
            counts.append(n)
        if len(found) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names=names)
            found.clear()
    settle()
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names=names)


def nearest(words: DataFrame, most: int = MOST) -> DataFrame:
    """(word, n_near, near_n, near) of distinct ``words`` (word, n) that have near words; near is the most frequent one."""
    entries = buckets(words, most).repartition("bucket").sortWithinPartitions("bucket")
    parts = in_batches(entries.select("bucket", "word", "n", "at"), _joined, "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", (-F.col("best.less")).alias("near_n"), "best.near")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms`` (word, form): the end of each word's chain of forms.

    Every word points to its form, then to what that points to, until nothing
    changes; counts grow by a factor along a chain, so it has no circle and is short.
    """
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        moved = written(now.join(ahead, "root", "left").select("word", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moved")), "roots")
        now = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return now


def variants(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, times: int = TIMES, most: int = MOST) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the vocabulary.

    ``form`` is the word's most frequent near word (of equally frequent ones the
    first by code points) if that has ``times`` the word's occurrences, else null;
    ``root`` ends the chain of forms and is the word itself where there is none. Documents may
    have null ids or texts, repeated rows and extra columns of any name; without words the result is empty.
    """
    words = written(vocabulary(docs, least_letters, least_count), "vocabulary")
    near = words.join(nearest(words, most), "word", "left")
    has = F.col("near_n") >= times * F.col("n")
    found = written(
        near.select("word", F.when(has, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("near_n")).alias("form_n")), "forms"
    )
    ends = roots(found.where("form is not null"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
