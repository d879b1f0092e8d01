"""Language identification by cross-parsing entropy.

A suffix automaton over a sample of each language's labelled text gives the
longest match from any position. A text is cut greedily into longest matches:
the fewer phrases a language's automaton needs per character, the closer the
text is to it. Automata are built once on the driver from a bounded sample; all
whole texts are parsed in the tasks, many of them in step with one another.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import in_batches, pick, worker_state

#: Bounds of the training sample: rows of each language, their longest run of text, and characters of each language.
SAMPLE_ROWS, SAMPLE_TEXT, SAMPLE_CHARS = 48, 3000, 32_000
#: Bound of the sample over all languages: with more than SAMPLE_ALL / SAMPLE_CHARS of them, each one's share is smaller, never below LEAST_CHARS.
SAMPLE_ALL, LEAST_CHARS = 6_400_000, 400
#: Margin from which on a prediction replaces a given language that is another one, and characters that the text has at least.
RELABEL, RELABEL_CHARS = 0.1, 128
#: Codes with a column of their own in the table of moves, and bytes of that table; moves by rarer letters are looked up in a sorted list.
DENSE, DENSE_BYTES = 252, 64_000_000
#: Codes from which on a text can be told from letters in random order, and the share of their cost that it must stay below.
LEAST_CODES, CHANCE_SHARE = 64, 0.95
#: Texts are parsed in runs of this many characters, so that a very long text is many short lanes.
RUN = 1024
LANE_CHARS = 800_000
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 modulo 4; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def normal(text: str, codes: np.ndarray) -> np.ndarray:
    """Codes of the lower-cased text; what is no letter is a space (1), and runs of spaces are one."""
    out = codes[np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")]
    return out[~((out == 1) & np.concatenate([[False], out[:-1] == 1]))]


def alphabet(texts: list[str]) -> np.ndarray:
    """Code of each character: 0 unseen letters, 1 what is no letter, 2 and up the sample's letters, the most frequent first."""
    seen = Counter(c for text in texts for c in text.lower() if c.isalpha())
    codes = np.zeros(sys.maxunicode + 1, np.uint8 if len(seen) + 2 <= 256 else np.int32)
    codes[[k for k in range(len(codes)) if not chr(k).isalpha()]] = 1
    for k, c in enumerate(sorted(seen, key=lambda c: (-seen[c], c))):
        codes[ord(c)] = k + 2
    return codes


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of each state; state 0 accepts the empty string."""
    move, link, length, last = [{}], [-1], [0], 0
    for c in symbols:
        new = len(move)
        move.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in move[p]:
            move[p][c] = new
            p = link[p]
        if p >= 0:
            q = move[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(move)
                move.append(dict(move[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and move[p].get(c) == q:
                    move[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return move


class Model:
    """Automata of all languages as one table of edges; ``scale`` turns phrases a character into bits a character."""

    def __init__(self, samples: dict[str, list[str]]):
        self.languages = sorted(samples)
        self.codes = alphabet([t for x in self.languages for t in samples[x]])
        self.n_codes = int(self.codes.max()) + 1
        chars = max(LEAST_CHARS, min(SAMPLE_CHARS, SAMPLE_ALL // max(1, len(samples))))
        edges, self.roots, scale, states = [], [], [], 1  # state 0 means that there is no move
        for x in self.languages:
            symbols: list[int] = []
            for t in samples[x]:
                symbols += [1, *normal(t, self.codes).tolist()]
            symbols = symbols[:chars]
            move = suffix_automaton(symbols)
            edges += [(states + s, c, states + t) for s, m in enumerate(move) for c, t in m.items()]
            self.roots.append(states)
            scale.append(np.log2(max(2, len(symbols))))
            states += len(move)
        self.states, self.scale = states, np.array(scale)
        self.width = min(self.n_codes, DENSE, max(2, DENSE_BYTES // (4 * states)))
        edges = np.array(edges, np.int32).reshape(-1, 3)
        rare = edges[:, 1] >= self.width
        self.edges = edges[~rare]
        keys = edges[rare, 0].astype(np.int64) * self.n_codes + edges[rare, 1]
        order = np.argsort(keys)
        self.rare_keys, self.rare_moves = keys[order], edges[rare, 2][order]
        self._table: np.ndarray | None = None
        self.chance = CHANCE_SHARE * min([self._shuffled(samples[x]) for x in self.languages], default=np.inf)

    def _shuffled(self, texts: list[str]) -> float:
        """Bits a code that the best language needs for a language's sample with its codes in random order."""
        codes = np.random.default_rng(0).permutation(np.concatenate([normal(t, self.codes) for t in texts]))[: 4 * RUN]
        runs = [codes[at : at + RUN] for at in range(0, len(codes), RUN)]
        return float((self.phrases(runs).sum(0) * self.scale).min() / len(codes))

    def table(self) -> np.ndarray:
        """Next state times width at [state times width + code]; 0 where there is none."""
        if self._table is None:
            table = np.zeros(self.states * self.width, np.int32)
            table[self.edges[:, 0] * self.width + self.edges[:, 1]] = self.edges[:, 2] * self.width
            self._table = table
        return self._table

    def _after(self, now: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Next states (times width) of ``now`` (times width, a row per language) by ``code``; 0 where there is none."""
        rare = np.flatnonzero(code >= self.width)
        if not len(rare):
            return self.table()[now + code]
        after = self.table()[now + np.where(code < self.width, code, 0)]  # no edge has code 0
        keys = now[:, rare].astype(np.int64) // self.width * self.n_codes + code[rare]
        at = np.minimum(np.searchsorted(self.rare_keys, keys), len(self.rare_keys) - 1)
        after[:, rare] = np.where(self.rare_keys[at] == keys, self.rare_moves[at] * self.width, 0)
        return after

    def __getstate__(self):
        return self.__dict__ | {"_table": None}

    def phrases(self, runs: list[np.ndarray]) -> np.ndarray:
        """Phrases that each language needs for each run, a row per run."""
        order = np.argsort([-len(r) for r in runs], kind="stable")
        sizes = np.array([len(runs[k]) for k in order])
        longest = int(sizes[0]) if len(sizes) else 0
        grid = np.zeros((len(runs), longest), self.codes.dtype)
        for lane, k in enumerate(order):
            grid[lane, : len(runs[k])] = runs[k]
        grid = np.ascontiguousarray(grid.T)
        roots = (np.array(self.roots, np.int32) * self.width)[:, None]
        state = np.repeat(roots, len(runs), 1)
        count = np.zeros(state.shape, np.int64)
        lanes = np.searchsorted(-sizes, -np.arange(longest), "left")  # those longer than t
        for t in range(longest):
            n = int(lanes[t])
            code, now = grid[t, :n], state[:, :n]
            after = self._after(now, code)
            miss = after == 0
            again = self._after(np.broadcast_to(roots, now.shape), code) if self.n_codes > self.width else self.table()[roots + code]
            lost = again == 0
            count[:, :n] += (miss & (now != roots)).view(np.int8) + (miss & lost).view(np.int8)
            state[:, :n] = np.where(miss, np.where(lost, roots, again), after)
        count += state != roots
        out = np.zeros((len(runs), len(self.languages)), np.int64)
        out[order] = count.T
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """Language, score and fit of each text.

        The score is how far the second best language falls behind, 0 to 1. A
        text fits unless it has LEAST_CODES codes or more and its best language
        needs no fewer phrases than for letters in random order.
        """
        runs, owner, sizes = [], [], np.zeros(len(texts))
        for k, text in enumerate(texts):
            if text and _LETTER.search(text) and self.languages:
                codes = normal(text, self.codes)
                sizes[k] = len(codes)
                for at in range(0, len(codes), RUN):
                    runs.append(codes[at : at + RUN])
                    owner.append(k)
        total = np.zeros((len(texts), len(self.languages)))
        if runs:
            np.add.at(total, np.array(owner), self.phrases(runs))
        bits = total * self.scale / np.maximum(sizes, 1)[:, None]
        names, scores, fits = [], [], []
        for k in range(len(texts)):
            if not sizes[k]:
                names.append(UNKNOWN)
                scores.append(0.0)
                fits.append(False)
                continue
            order = np.argsort(bits[k], kind="stable")
            names.append(self.languages[order[0]])
            scores.append(float(1 - bits[k, order[0]] / bits[k, order[1]]) if len(order) > 1 else 1.0)
            fits.append(bool(sizes[k] < LEAST_CODES or bits[k, order[0]] < self.chance))
        return names, scores, fits


def train(docs: DataFrame) -> Model:
    """Learns from texts and languages of documents that are not held out.

    Of each language at most the SAMPLE_ROWS texts that come first by a hash of their id
    are used, and SAMPLE_CHARS characters of these. A text longer than
    SAMPLE_TEXT gives a run of that many characters at a place drawn by another
    hash of its id, or from its first letter on if that run has none; rows
    without text, language or id are left out. Every language is learned; the more there
    are, the fewer rows and characters of each, so that all of them stay within SAMPLE_ALL.
    """
    from pyspark.sql import Window

    rows = pick(docs, "doc_id", "text", "lang").where(
        F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").rlike(r"\p{L}")
    )
    n_languages = rows.select("lang").distinct().count()
    most = max(1, min(SAMPLE_ROWS, SAMPLE_ROWS * SAMPLE_ALL // SAMPLE_CHARS // max(1, n_languages)))
    place = F.pmod(F.xxhash64("doc_id", F.lit("run")), F.length("text") - SAMPLE_TEXT + 1).cast("int") + 1
    drawn = F.when(F.length("text") > SAMPLE_TEXT, F.substring("text", place, SAMPLE_TEXT)).otherwise(F.col("text"))
    lettered = F.regexp_extract("text", rf"(?s)\p{{L}}.{{0,{SAMPLE_TEXT - 1}}}", 0)
    rows = rows.select("doc_id", "lang", F.when(drawn.rlike(r"\p{L}"), drawn).otherwise(lettered).alias("text"))
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "text")
    chosen = rows.withColumn("place", F.row_number().over(first)).where(F.col("place") <= most)
    samples: dict[str, list[str]] = {}
    for row in chosen.select("lang", "place", "text").orderBy("lang", "place").collect():  # bounded by the sample
        samples.setdefault(row["lang"], []).append(row["text"])
    return Model({k: list(dict.fromkeys(v)) for k, v in samples.items()})


def _predicted(shared, batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[str], list[float], list[bool]]]:
    """Parts of a batch of about LANE_CHARS characters, with their predictions."""
    worker_state("langid")
    texts = batch.column("text")
    sizes, at = np.cumsum([0, *pc.fill_null(pc.utf8_length(texts), 0).to_pylist()]), 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(sizes, sizes[at] + LANE_CHARS, "right")) - 1)
        yield batch.slice(at, to - at), *shared.value.predict(texts.slice(at, to - at).to_pylist())
        at = to


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row for each row of ``docs``; ``und`` with score 0 for null and letterless texts.

    Without learned languages every text is ``und``; with one, its score is 1.
    Ties go to the language that sorts first. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs))  # bounded by the training sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, names, scores, _ in _predicted(shared, batch):
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                    names=["doc_id", "held_out", "lang_pred", "score"],
                )

    ready = pick(docs, "doc_id", "text").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return ready.transform(in_batches, run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, languages: list[str] | None = None, least_score: float = 0.0, relabel: float = RELABEL, model: Model | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, in which a language was identified; no row moves.

    Rejected are null and letterless texts, texts of LEAST_CODES codes or more
    that fit no learned language better than letters in random order do (dumps
    of encoded data, languages that nothing was learned of), scores under
    ``least_score`` and, where ``languages`` is given, other languages. A missing
    ``lang`` becomes the prediction, and so does a given one that is another language while the
    score is ``relabel`` or more and the text has RELABEL_CHARS; a closer call keeps what is given. Repeated rows fare alike;
    an empty table gives an empty result; other columns, whatever their names, pass through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs))
    wanted = None if languages is None else set(languages)
    place = docs.columns.index("lang") if docs.columns.count("lang") == 1 else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, names, scores, fits in _predicted(shared, batch):
                if place is not None:
                    said = pa.array(names, part.schema.field(place).type)
                    long = pc.fill_null(pc.greater_equal(pc.utf8_length(part.column("text")), RELABEL_CHARS), False)
                    sure = pc.and_(long, pa.array([s >= relabel and n != UNKNOWN for n, s in zip(names, scores, strict=True)], pa.bool_()))
                    filled = pc.if_else(sure, said, pc.coalesce(part.column(place), said))
                    part = part.set_column(place, "lang", filled)
                keep = [f and s >= least_score and (wanted is None or n in wanted) for n, s, f in zip(names, scores, fits, strict=True)]
                yield part.filter(pa.array(keep, pa.bool_()))

    # Spark's own call takes columns by name, which a dot in one would break
    names = [f"column {k}" if set(c) & {".", "`"} else c for k, c in enumerate(docs.columns)]
    ready = docs if names == docs.columns else docs.toDF(*names)
    kept = ready.transform(in_batches, run, ready.schema)
    return kept if names == docs.columns else kept.toDF(*docs.columns)
