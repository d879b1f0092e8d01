import re
from collections import defaultdict

import pytest

from docloom.llm import decontam as D

from .helpers import UPPER, frame, odd_texts, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def brute(texts, items):
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[k : k + n])].add(item)
    out = []
    for t in texts:
        w = words(t)
        hit, found = [False] * len(w), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if ids := windows.get(tuple(w[k : k + n])):
                    found |= ids
                    hit[k : k + n] = [True] * n
        out.append((len(w), sum(hit), found, any(hit) and 20 * sum(hit) >= len(w)))
    return out


ITEMS = [(1, prose(1, 60)), (2, prose(2, 13)), (3, prose(3, 12)), (4, "Single"), (5, None), (6, "...!"), (7, prose(1, 60)), (8, "aa aa aa aa aa aa aa aa aa aa aa aa aa aa aa"), (None, "no id words"), (2, prose(2, 13))]


def bench(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, words string")


def texts():
    p, q = prose(1, 60), prose(2, 13)
    mid = " ".join(p.split()[20:36])
    return [
        p, p.upper().replace(" ", " -- "), prose(10, 100) + " " + mid + " " + prose(11, 100), prose(12, 500) + q, " ".join(p.split()[20:32]), prose(3, 12), "a single, SINGLE word", "aa " * 40, "bb " + "aa " * 13,
        (prose(13, 1015) + " " + p) * 2, prose(1, 2500), "É" + p, "no id words", *[t[1] if isinstance(t, tuple) else t for t in odd_texts()],
    ]


@pytest.mark.parametrize("most", [D.BROADCAST_BYTES, -1])
def test_hits_match_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(D, "BROADCAST_BYTES", most)
    out = {r.doc_id: r for r in D.contamination(frame(spark, texts()), bench(spark)).collect()}
    for k, (n, hit, found, bad) in enumerate(brute(texts(), ITEMS)):
        r = out[k]
        assert (r.n_words, r.n_hit, set(r["items"]), r.contaminated) == (n, hit, found - {None}, bad), k


def test_drop_and_cut(spark):
    t = [prose(10, 30), prose(10, 10) + " " + prose(2, 13) + ", " + prose(11, 10), None]
    docs = frame(spark, t)
    dropped = D.decontaminate(docs, bench(spark))
    assert dropped.columns == docs.columns and sorted(r.doc_id for r in dropped.collect()) == [0, 2]
    cut = {r.doc_id: r.text for r in D.decontaminate(docs, bench(spark), action="cut").collect()}
    assert cut[0] == t[0] and cut[2] is None and words(cut[1]) == words(prose(10, 10)) + words(prose(11, 10))
    with pytest.raises(ValueError):
        D.decontaminate(docs, bench(spark), action="other")


def test_clashing_names_null_and_repeated_ids(spark):
    docs = frame(spark, [(1, prose(2, 13)), (1, "other words"), (2, None), (2, prose(2, 13)), (3, "")])
    docs = docs.withColumnRenamed("node", "__spans").withColumnRenamed("key", "key_0").withColumnRenamed("n", "gone_id")
    left = D.decontaminate(docs, bench(spark))
    assert left.columns == docs.columns and sorted((r.doc_id, r.text or "") for r in left.collect()) == [(1, "other words"), (2, ""), (3, "")]
    cut = D.decontaminate(docs, bench(spark), action="cut")
    assert cut.columns == docs.columns and sorted((r.doc_id, " ".join(words(r.text))) for r in cut.collect()) == [(1, ""), (1, "other words"), (2, ""), (2, ""), (3, "")]


def test_empty_tables_and_repeated_rows(spark):
    docs, none = frame(spark, [(1, prose(2, 13)), (1, prose(2, 13)), (1, "other"), (None, prose(2, 13))]), bench(spark).limit(0)
    out = D.contamination(docs, bench(spark)).collect()
    assert sorted((r.n_hit > 0) for r in out) == [False, True, True, True]
    assert all(r.n_hit == 0 for r in D.contamination(docs, none).collect()) and D.contamination(frame(spark, []), bench(spark)).count() == 0


def test_plan_is_native_and_broadcasts(spark):
    plan = D.contamination(frame(spark, ["x"]), bench(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastHashJoin" in plan
