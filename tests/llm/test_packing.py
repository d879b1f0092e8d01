import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from docloom.llm import packing

from .helpers import frame, odd_texts, prose

PATH = public_tokenizers.path("word_bpe_49k.json")


def ids_of(text, path=PATH):
    t = Tokenizer.from_file(path)
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")


def check(spark, texts, window=256, unit=16, path=PATH):
    rows = packing.pack(frame(spark, texts), path, window, unit).collect()
    want = {k: ids_of(t[1] if isinstance(t, tuple) else t, path) for k, t in enumerate(texts)}
    for k, ids in want.items():
        mine = sorted((r for r in rows if r.doc_id == k), key=lambda r: r.start)
        assert b"".join(r.ids for r in mine) == ids.tobytes()
        assert [r.start for r in mine] == [0, *np.cumsum([r.length for r in mine])[:-1]]
        assert all(r.ids_crc32 == zlib.crc32(r.ids) and r.doc_tokens == len(ids) and 4 * r.length == len(r.ids) for r in mine)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1]] and sum(n for _, n in parts) <= window
    return sequences


def test_every_id_lies_in_one_piece(spark):
    check(spark, [prose(k, 5 + 7 * k) for k in range(60)])


def test_odd_rows(spark):
    texts = [t for t in odd_texts() if not isinstance(t, tuple)]
    texts += ["It's  don't, WE'RE. x.,y ,. É. Éa, ÉÀ. İstanbul ΣΑΣ. é, <|endoftext|> 12,5 á. ﬁ", "word. word, word.. word,. 'S."]
    check(spark, texts)
    assert packing.pack(frame(spark, []), PATH).count() == 0


def test_literal_markers_and_other_tokenizer_files(spark):
    texts = ["<|endoftext|> hi", "a<|startoftext|>b <|ENDOFTEXT|> <|endoftext|", prose(7, 40), "Upper  lower\n\tcase's 12", None]
    check(spark, texts)
    check(spark, texts, path=public_tokenizers.path("byte_bpe_50k.json"))


def test_markers_that_lower_case_makes_are_plain_text(spark):
    texts = ["<|ENDOFTEXT|>x", "a <|EndOfText|> b", "<|STARTofTEXT|>", "<|endoftext|>x <|ENDOFTEXT|>", "<|ENDOFTEXT|", prose(3, 30) + "<|EndOFText|>."]
    check(spark, texts)
    with open(PATH, encoding="utf-8") as f:
        ids = np.frombuffer(packing.WordTokenizer(f.read()).token_bytes(["<|ENDOFTEXT|>x"])[0], "<u4")
    assert 49407 not in ids[:-1] and len(ids) == 7


def test_words_are_forgotten_within_the_bound(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_BYTES", 2000)
    with open(PATH, encoding="utf-8") as f:
        t = packing.WordTokenizer(f.read())
    for k in range(12):
        text = prose(k % 5, 60)
        assert t.token_bytes([text, "to be"])[0] == ids_of(text)[:-1].tobytes()
        assert len(t.memory.young) + len(t.memory.old) < 200


def test_remembered_words_are_not_copied_for_each_batch(monkeypatch):
    monkeypatch.setattr(packing.WordMemory, "known", None)
    with open(PATH, encoding="utf-8") as f:
        t = packing.WordTokenizer(f.read())
    texts = [prose(k, 80) for k in range(4)]
    for bound in (10**6, 100):
        t.memory.most_bytes = bound
        for _ in range(3):
            assert t.token_bytes(texts) == [ids_of(x)[:-1].tobytes() for x in texts]
            words = {w for x in texts for w in x.lower().split()}
            assert words <= t.memory.young.keys()
            assert bound == 100 or not t.memory.missing(words)


def test_repeated_rows_are_documents_of_their_own(spark):
    rows = packing.pack(frame(spark, [(1, "some words"), (1, "some words"), (None, "x")]), PATH).collect()
    assert len([r for r in rows if r.doc_id == 1]) == 2 and len([r for r in rows if r.doc_id is None]) == 1


def test_little_padding(spark):
    sequences = check(spark, [prose(k, 30 + k % 90) for k in range(300)])
    total = sum(n for parts in sequences.values() for _, n in parts)
    assert total / (256 * len(sequences)) > 0.97


@pytest.mark.parametrize("seed", range(5))
def test_nnls_meets_its_conditions(seed):
    r = np.random.default_rng(seed)
    a, y = r.random((20, 60)), r.random(20) * 10
    x = packing.nnls(a, y)
    gain = a.T @ (y - a @ x)
    assert (x >= 0).all() and (gain <= 1e-6).all() and abs(gain[x > 1e-9]).max(initial=0) < 1e-6


def test_repeats_never_exceed_the_histogram():
    combos = packing.fillings(16)
    assert (combos @ np.arange(1, 17) == 16).all()
    h = np.random.default_rng(1).integers(0, 40, 16)
    used = packing.repeat_counts(h, combos) @ combos
    assert (used <= h).all() and used @ np.arange(1, 17) > 0.5 * h @ np.arange(1, 17)


def test_best_fit_fills_without_overlap():
    lengths = np.random.default_rng(2).integers(1, 60, 500)
    bins, offsets = packing.best_fit(lengths, 64)
    taken = np.zeros((bins.max() + 1, 64), int)
    for b, o, n in zip(bins, offsets, lengths, strict=True):
        taken[b, o : o + n] += 1
    assert taken.max() == 1 and taken.mean() > 0.95
