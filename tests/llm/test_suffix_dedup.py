import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from docloom.llm import suffix_dedup as S

from .helpers import frame, prose, sha


@pytest.mark.parametrize("alphabet", [1, 2, 3, 30])
def test_suffix_array_and_prefixes(alphabet):
    r = random.Random(alphabet)
    for _ in range(150):
        text = [r.randint(1, alphabet) for _ in range(r.randint(0, 60))] + [0]
        order = S.suffix_array(text)
        assert order == sorted(range(len(text)), key=lambda i: text[i:])
        want = [0] * len(text)
        for a, b in zip(order, order[1:], strict=False):
            n = 0
            while text[a + n] == text[b + n]:
                n += 1
            want[a], want[b] = max(want[a], n), max(want[b], n)
        assert S.common_prefixes(text, order) == want


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for t in raw:
        for s in range(len(t) - length + 1):
            seen[t[s : s + length]] = seen.get(t[s : s + length], 0) + 1
    out = []
    for t in raw:
        gone = bytearray(len(t))
        for s in range(len(t) - length + 1):
            if seen[t[s : s + length]] > 1:
                gone[s : s + length] = b"\x01" * length
        spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(t)))
        out.append((len(t), sum(gone), spans, sha(bytes(b for b, g in zip(t, gone, strict=True) if not g))))
    return out


def check(spark, texts, monkeypatch=None):
    rows = S.remove_repeats(frame(spark, texts)).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, sha(bytes(r.kept))) for r in rows] == brute(texts, S.LENGTH)


def texts_with_repeats():
    a, b, c = prose(1, 300), prose(2, 300), prose(3, 200)
    passage = prose(50, 120)[:520]
    return [
        a, a, a[:700] + "X" + a[701:], b + passage + c, passage + b[5:], c[:399], c[:400], c[:400] + "tail", "Thor " * 400, "Thor " * 300 + c, "ab" * 220, "z" * 401, "z" * 400,
        None, "", "short", "é" * 300, b[:450] + b[:450], *[prose(100 + k, 40) + passage[k : k + 460] + prose(200 + k, 40) for k in range(30)],
    ]


def test_removed_bytes_match_brute_force(spark):
    check(spark, texts_with_repeats())


@pytest.mark.parametrize(("most", "in_task"), [(1, 10_000), (3, 10_000), (2, 5)])
def test_crowded_halves_are_exact_too(spark, monkeypatch, most, in_task):
    monkeypatch.setattr(S, "MOST", most)
    monkeypatch.setattr(S, "IN_TASK", in_task)
    check(spark, texts_with_repeats())


@pytest.mark.parametrize("in_task", [7, 10_000])
def test_family_of_edited_copies_divided_by_hubs(spark, monkeypatch, in_task):
    monkeypatch.setattr(S, "MOST", 4)
    monkeypatch.setattr(S, "IN_TASK", in_task)
    r, base, texts = random.Random(9), prose(70, 260), []
    for k in range(40):
        t = list(base)
        for _ in range(k % 4):
            t[r.randrange(len(t))] = r.choice("XYZ")
        texts.append(prose(300 + k, k % 5 * 10) + "".join(t)[: 900 + 20 * (k % 7)] + prose(400 + k % 6, 30))
    check(spark, texts)


def test_repeated_rows_and_empty_table(spark):
    text = prose(4, 150)
    rows = S.remove_repeats(frame(spark, [(1, text), (1, text), (None, prose(5, 150))])).collect()
    assert sorted(r.n_removed for r in rows) == sorted([len(text.encode())] * 2 + [0])
    assert S.remove_repeats(frame(spark, [])).count() == 0


def test_each_window_is_asked_of_its_smallest_gram():
    length, gram = 60, 12
    raw = [prose(k, 60).encode() for k in (31, 32, 33)]
    bounds = np.cumsum([0, *map(len, raw)])
    text, at, *_, low, high = S.anchors_of(np.frombuffer(b"".join(raw), np.uint8), bounds, length, gram)
    assert low.min() >= 0 and high.max() <= length - gram
    for k, t in enumerate(raw):
        asked = Counter(int(a) - x for i, a, b, c in zip(text, at, low, high, strict=True) if i == k for x in range(b, c + 1))
        repeated = len(set(t[i : i + gram] for i in range(len(t) - gram + 1))) < len(t) - gram + 1
        assert set(asked) == set(range(len(t) - length + 1))
        assert repeated or set(asked.values()) == {1}


def solved(rows, size):
    table = pa.Table.from_pylist([dict(zip(S._CORE_NAMES, r, strict=True)) for r in sorted(rows, key=lambda r: r[0])], pa.schema(list(zip(S._CORE_NAMES, S._CORE_TYPES, strict=True))))
    found = (tuple(r.values()) for b in S._solve(S.LENGTH, S.STEP)(iter(table.to_batches(max_chunksize=size))) for r in b.to_pylist())
    return sorted(found, key=str)


def core_rows():
    r, rows, want = random.Random(3), [], []
    letters = lambda n: bytes(r.choice(b"ab") for _ in range(n))
    for core in range(60):
        base = letters(S.STEP), letters(S.STEP)
        own = []
        for k in range(r.randint(1, 6)):
            left, right = (bytearray(x) for x in base)
            for side in (left, right):
                if r.random() < 0.5:
                    side[r.randrange(S.STEP)] = ord("X") + k % 2
            own.append((core, bytes(left[r.choice((0, 0, 5)) :]), bytes(right[: r.choice((S.STEP, S.STEP, 7))]), None if k == 0 else k, k, 1000 * core + k, r.random() < 0.8, None, None))
        rows += own + own[:1]  # a place that two anchors lead to
        for core_, left, right, doc, text_hash, at, single, *_ in own:
            again = [
                x
                for x in range(max(0, S.STEP - len(right)), len(left) + 1)
                if any(o[5] != at and o[1].endswith(left[len(left) - x :]) and o[2].startswith(right[: S.STEP - x]) and len(o[1]) >= x and len(o[2]) >= S.STEP - x for o in own)
            ]
            if single and again:
                want.append((doc, text_hash, at - again[-1], at - again[0] + S.LENGTH))
    return rows, want


@pytest.mark.parametrize("size", [1, 7, 10_000])
@pytest.mark.parametrize("block", [50, 20_000])
def test_solver_matches_pairwise_comparison(monkeypatch, size, block):
    monkeypatch.setattr(S, "BLOCK", block)
    rows, want = core_rows()
    assert solved(rows, size) == sorted(want, key=str)


def test_suffix_arrays_hold_only_bytes_that_may_recur(monkeypatch):
    symbols, build = [], S.suffix_array
    monkeypatch.setattr(S, "suffix_array", lambda text: (symbols.append(len(text)), build(text))[1])
    same, other = b"k" * 17 + b"xyz", b"q" * 17 + b"xyz"
    pair = [(1, same, b"r" * 20, 1, 1, 500, True, None, None), (1, other, b"r" * 20, 2, 2, 500, True, None, None)]
    apart = [(2, same[::-1], b"t" * 20, 3, 3, 500, True, None, None), (2, other[::-1], b"u" * 20, 4, 4, 500, True, None, None)]
    assert solved(pair + apart, 100) == [(1, 1, 497, 900), (2, 2, 497, 900)]
    assert symbols == [2 * (3 + 1 + 20 + 1) + 1]
