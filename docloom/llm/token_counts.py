"""Token counts of a unigram vocabulary without making tokens.

An Aho-Corasick automaton lists the vocabulary's matches by their end; dynamic
programming over positions carries the best score and the number of pieces on
that path. Ties go to the piece that starts first, and runs of unknown
characters count once, as in the reference tokenizer of such vocabularies.
Words are independent of one another, so the counts of those seen are kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import WordMemory, in_batches, pick, worker_state

MARK = "▁"
#: Bytes of words whose counts a Python worker remembers: at most two generations of about this many.
CACHE_BYTES = 48_000_000
UNKNOWN_PENALTY = 10.0

_WHITE = str.maketrans({c: " " for c in "\t\n\x0b\x0c\r"})


def vocabulary(model_file: str) -> list[tuple[str, float]]:
    """(piece, log probability) of a piece vocabulary: its normal pieces, with probabilities that fall with the rank."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    plain = [k for k in range(model.vocab_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k))]
    total = math.log(sum(1 / (r + 10) for r in range(len(plain))))
    return [(model.id_to_piece(k), -math.log(r + 10) - total) for r, k in enumerate(plain)]


class Counter:
    """Counts pieces of words under a vocabulary."""

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.matches = ahocorasick.Automaton()
        for piece, score in pieces:
            self.matches.add_word(piece, (len(piece), score))
        self.matches.make_automaton()
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        self.memory = WordMemory(CACHE_BYTES)

    def count(self, word: str) -> int:
        n = len(word)
        best, pieces, lost = [-math.inf] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        best[0] = 0.0
        found = self.matches.iter(word)
        end, match = next(found, (n, None))
        for to in range(1, n + 1):
            single = False
            while end == to - 1:  # longest first, so that the earlier start keeps a tie
                length, score = match
                at = to - length
                if best[at] + score > best[to]:
                    best[to], pieces[to], lost[to] = best[at] + score, pieces[at] + 1, False
                single |= length == 1
                end, match = next(found, (n, None))
            if not single and best[to - 1] + self.unknown > best[to]:
                best[to], pieces[to], lost[to] = best[to - 1] + self.unknown, pieces[to - 1] + (not lost[to - 1]), True
        return pieces[n]

    def totals(self, texts: list[list[str]]) -> list[int]:
        """Pieces of each text, given as its words."""
        words = set(chain.from_iterable(texts))
        counts = self.memory.known(words)
        fresh = {w: self.count(MARK + w) for w in words.difference(counts)}
        self.memory.add(fresh)
        counts |= fresh
        return [sum(map(counts.__getitem__, t)) for t in texts]


def token_counts(docs: DataFrame, pieces: list[tuple[str, float]]) -> DataFrame:
    """(doc_id, n_words, n_tokens), one row for each row of ``docs``.

    Words are runs without ASCII white space, each with the mark before it.
    Null and empty texts have no words and no tokens; an empty table gives an
    empty result. The vocabulary is broadcast: its size does not depend on the data.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, key = worker_state("token_counts"), hash(tuple(shared.value))
        counter = kept.get(key) or kept.setdefault(key, Counter(shared.value))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [(t or "").translate(_WHITE).split(" ") for t in part.column("text").to_pylist()]
                texts = [[w for w in t if w] for t in texts]
                counts = [pa.array([len(t) for t in texts], pa.int64()), pa.array(counter.totals(texts), pa.int64())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *counts], names=["doc_id", "n_words", "n_tokens"])

    return pick(docs, "doc_id", "text").transform(in_batches, run, "doc_id long, n_words long, n_tokens long")
