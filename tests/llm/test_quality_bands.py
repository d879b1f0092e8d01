import random
import re
from collections import Counter

import numpy as np
import pytest

from docloom.llm import quality_bands as Q

from .helpers import frame, odd_texts, prose


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    again = {k + j for k in range(len(words) - 2) if seen[tuple(words[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(again) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again), failed


def test_base_counts_match_brute_force(spark):
    texts = [t[1] if isinstance(t, tuple) else t for t in odd_texts()]
    texts += [prose(2, 300) + "\n" + prose(2, 100), "a b c a b c a b", "x\nx\n \n \nx y\n" * 30, "# * $ % & | < > ##", "a b " * 40]
    out = {r.doc_id: r for r in Q.assess(frame(spark, texts)).collect()}
    for k, t in enumerate(texts):
        r = out[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(t)
        assert not (r.base_failed and r.kept)


def test_bands_reject_repetition_and_noise_and_keep_prose(spark):
    r = random.Random(4)
    noise = " ".join("".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(60)) for _ in range(80))
    words = prose(6, 40).split()
    near = " ".join(w + str(k // 30) for k in range(3000) for w in words[k % 2 : k % 2 + 1])
    texts = [prose(5, 400), prose(8, 6000), noise, near, prose(9, 1500) + " zz" * 9000]
    said = [row.verdict for row in Q.assess(frame(spark, texts)).orderBy("doc_id").collect()]
    assert said[:2] == ["ok", "ok"] and said[2] == "incompressible" and said[3] == "repetitive" and said[4] in ("repetitive", "bad_chunks")


def test_empty_and_keep(spark):
    assert Q.assess(frame(spark, [])).count() == 0
    docs = frame(spark, [prose(5, 400), "short", None, (0, "short again"), (7, prose(6, 90)), (7, prose(6, 90))]).withColumnRenamed("key", "key_0")
    kept = Q.keep_good(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id, r.text) for r in kept.collect()) == [(0, prose(5, 400)), (7, prose(6, 90)), (7, prose(6, 90))]


def plain_limits(texts):
    """Limits by band from whole lists of ratios."""
    import math

    import zstandard

    compress = zstandard.ZstdCompressor(level=Q.LEVEL).compress
    by_band = {}
    for t in texts:
        raw = t.encode()
        if not base(t)[-1]:
            by_band.setdefault(math.floor(math.log2(len(raw)) * Q.BANDS_PER_OCTAVE), []).append(len(raw) / len(compress(raw)))
    out = {}
    for band, ratios in by_band.items():
        if len(ratios) >= Q.ENOUGH:
            ratios.sort()
            q1, q2 = ratios[len(ratios) // 4], ratios[len(ratios) // 2]
            out[band] = (q2 - Q.WIDTHS[0] * (q2 - q1) / 0.6745, q2 + Q.WIDTHS[1] * (q2 - q1) / 0.6745)
    return out


def test_bands_come_from_the_corpus_and_decide(spark):
    clean = [prose(1000 + k, 100 + k % 40) for k in range(300)]
    marked = [" ".join(w + "$$$%%%###" for w in prose(2000 + k, 50).split()) for k in range(20)]
    rows = {r.doc_id: r for r in Q.assess(frame(spark, clean + marked)).collect()}
    assert not any(r.base_failed for r in rows.values())
    assert sum(rows[k].kept for k in range(300)) >= 297
    assert sum(rows[300 + k].verdict == "repetitive" for k in range(20)) >= 18
    # the same texts without a corpus around them pass the fixed limits
    assert all(r.kept for r in Q.assess(frame(spark, marked)).collect())
    want = plain_limits(clean + marked)
    assert want
    for k, t in enumerate(clean + marked):
        band = int(np.floor(np.log2(len(t.encode())) * Q.BANDS_PER_OCTAVE))
        if band in want:
            assert abs(rows[k].largest_ratio - want[band][1]) < 0.08 and abs(rows[k].least_ratio - max(want[band][0], 1.2 if band < 20 else 1.4)) < 0.12


def test_bad_parts_of_long_texts_count(spark):
    r = random.Random(5)
    noise = "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(5000))
    noise = " ".join(noise[k : k + 70] for k in range(0, 5000, 70))
    said = {r.doc_id: r for r in Q.assess(frame(spark, [prose(5, 900) + " " + noise, prose(5, 1500), prose(7, 320) + " zz" * 450])).collect()}
    assert said[0].verdict == "bad_chunks" and said[0].bad_chunk_share > 0.25 and said[1].verdict == "ok" and said[2].bad_chunk_share > 0


def test_quantiles_of_counts():
    values, counts = np.arange(1, 6) * Q.STEP, np.array([10, 20, 40, 20, 10])
    assert abs(Q._quantile(values, counts, 0.5) - (3 * Q.STEP + Q.STEP / 2)) < 1e-9


def test_limits_between_and_beyond_learned_bands():
    learned = {20: (1.5, 2.0), 24: (1.9, 2.4)}
    assert Q.limits_at(learned, "text", 20) == (1.5, 2.0)
    assert Q.limits_at(learned, "text", 22) == pytest.approx((1.7, 2.2))
    assert Q.limits_at(learned, "text", 26) == (1.4, 4.5) and Q.limits_at({}, "chunk", 21) == Q.FIXED_CHUNK
