import re
import zlib
from collections import Counter, defaultdict

import pytest

from docloom.llm import spelling

from .helpers import UPPER, frame, odd_texts, prose


def distance(a, b):
    """Edits by the full table."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain_counts(rows, least_letters=6, least_count=5):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= least_letters and n >= least_count}


def plain_variants(counts, times=5):
    near = defaultdict(list)
    words = sorted(counts)
    for a in words:
        for b in words:
            if abs(len(a) - len(b)) <= 1 and distance(a, b) == 1:
                near[a].append(b)
    form = {}
    for a, others in near.items():
        best = min(others, key=lambda b: (-counts[b], b))
        if counts[best] >= times * counts[a]:
            form[a] = best
    out = set()
    for a in words:
        root = a
        while root in form:
            root = form[root]
        out.add((a, form.get(a), root, counts[a], len(near[a]), counts[form[a]] if a in form else None))
    return out


def rows_of(df):
    return {tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


def test_equals_comparison_of_all_words(spark):
    texts = [prose(k, 400) + " Königlich" * k + " koniglich" * (k % 2) for k in range(40)]
    typed = ["wanderer " * 60 + "wandere " * 12 + "wandexer " * 6 + "wandrer " * 7 + "wanderrr " * 5, "aaaaaa " * 30 + "aaaaaaa " * 6 + "AAAAAAAA " * 5 + "baaaaa " * 6]
    docs = frame(spark, texts + typed + odd_texts()[:9] + ["same text here"])
    got = rows_of(spelling.variants(docs))
    want = plain_variants(plain_counts([(r["doc_id"], r["text"]) for r in docs.collect()]))
    assert got == want
    assert any(x[1] for x in got) and any(x[4] > 1 for x in got)


@pytest.mark.parametrize("most", [1, 3, 50])
def test_crowded_buckets_are_halved_without_losing_or_repeating_pairs(spark, most):
    stems = ["prefix" + a + b + c for a in "abc" for b in "abé" for c in ("", "a", "bb", "cab")] + ["x" * k for k in range(6, 12)] + ["ab" * k for k in range(3, 7)]
    counts = {w: 5 + 7 * k for k, w in enumerate(stems)}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r["word"]: (r["n_near"], r["near_n"], r["near"]) for r in spelling.nearest(words, most).collect()}
    want = {}
    for a in counts:
        near = [b for b in counts if distance(a, b) == 1]
        if near:
            best = min(near, key=lambda b: (-counts[b], b))
            want[a] = (len(near), counts[best], best)
    assert got == want
    sizes = spelling.buckets(words, most).where("at.least - at.lead - at.tail > 1").groupBy("bucket").count()
    assert sizes.where(f"count > {most}").isEmpty()


def test_a_third_of_all_words_in_one_half(spark):
    words = [("common" + "abcdefghij"[k // 100] + "abcdefghij"[k // 10 % 10] + "abcdefghij"[k % 10], 5 + k % 40) for k in range(1000)]
    got = {r["word"]: r["n_near"] for r in spelling.nearest(spark.createDataFrame(words, "word string, n long"), 20).collect()}
    assert got == {w: 27 for w, _ in words}


def test_pieces_of_long_texts_end_between_words(monkeypatch):
    monkeypatch.setattr(spelling, "PIECE", 10)
    text = "Éa" * 40 + " short WORDS and × signs" + "q" * 25
    assert [m for p in spelling._pieces(text) for m in re.findall("[a-zÀ-ÿ]+", p)] == re.findall("[a-zÀ-ÿ]+", text.translate(UPPER))


def test_damage_takes_the_letter_the_checksum_names():
    hit = next((k, w) for k in range(2000) for w in ("spelling", "éclairs") if zlib.crc32(f"{k}:{w}".encode()) % 199 == 0)
    at = zlib.crc32(f"{hit[0]}:{hit[1]}".encode()) % len(hit[1])
    assert spelling.damaged(*hit) == hit[1][:at] + hit[1][at + 1 :]


def test_ties_chains_and_limits(spark):
    text = "abcdefg " * 625 + "abcdefh " * 125 + "abcdeih " * 25 + "abcdjih " * 5 + "qrstuvw " * 10 + "qrstuvx " * 50 + "qrstuva " * 50 + "qrstuv " * 4 + "abcde " * 99
    got = {r["word"]: r for r in spelling.variants(frame(spark, [(5, text)])).collect()}
    want = {r[0]: r for r in plain_variants(plain_counts([(5, text)]))}
    assert {w: tuple(r) for w, r in got.items()} == want
    assert got["abcdjih"]["root"] == "abcdefg" and got["qrstuvw"]["form"] == "qrstuva" and "qrstuv" not in got


def test_empty_tables(spark):
    for texts in ([], [None, "", "a b c"]):
        df = spelling.variants(frame(spark, texts))
        assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"] and df.count() == 0
