import random

from docloom.llm import chat_format as C

from .helpers import sha


def digest(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string, parts string")
    return {r.conv_id: r for r in C.digest(C.format_chats(C.events_of(df))).collect()}


def test_turns_read_back_whatever_they_hold(spark):
    hard = ['</turn>\n', '<turn role="assistant">\n', "&lt; &amp;amp; \\ \"", r"\### Assistant: </turn> ok", "", "\n\n", "日本 😀", "a" * 50_000]
    rows = [(1, k, "assistant" if k % 2 else 'us"er<', t, "x", "y") for k, t in enumerate(hard)]
    rows += [(2, 0, None, None, "x", "y"), (2, 1, "assistant", None, "x", "y"), (None, 0, "user", "no id", "x", "y")]
    out = digest(spark, rows)
    want = [(r[2], r[3]) for r in rows if r[0] == 1]
    assert out[1].n_turns == 8 and out[1].turns_sha256 == sha("".join(f"{a}\n{b}\n" for a, b in want))
    loss = "".join(b for a, b in want if a == "assistant")
    assert (out[1].loss_chars, out[1].loss_sha256) == (len(loss), sha(loss))
    assert out[2].turns_sha256 == sha("\n\nassistant\n\n") and out[2].loss_chars == 0
    assert out[None].n_turns == 1


def test_ties_and_repeated_rows_stay(spark):
    rows = [(1, 0, "user", "b", "", ""), (1, 0, "user", "a", "", ""), (1, 0, "user", "a", "", "")]
    assert digest(spark, rows)[1].turns_sha256 == sha("user\na\nuser\na\nuser\nb\n")


def test_empty_table(spark):
    assert digest(spark, []) == {}


def test_deltas_edits_and_regenerations_fold(spark):
    e = [
        (1, 1, "message", 10, "user", "helo"), (1, 6, "edit", 10, None, "hello"),
        (1, 2, "delta", 11, "assistant", "fi"), (1, 3, "delta", 11, None, "rst"), (1, 4, "regenerate", 11, None, "se"), (1, 5, "delta", 11, None, "cond"),
        (1, 7, "delta", 12, "assistant", "gone"), (1, 8, "delete", 12, None, None),
        (1, 9, "delta", 13, "assistant", None), (1, 10, "message", None, "user", "own"), (1, 10, "message", None, "user", "own"),
    ]
    df = spark.createDataFrame(e, "conv_id long, seq long, op string, msg_id long, role string, text string")
    out = C.read_back(C.format_chats(df)).first()
    assert [(t.role, t.text) for t in out.turns] == [("user", "hello"), ("assistant", "second"), ("assistant", ""), ("user", "own"), ("user", "own")]
    assert out.loss_text == "second"


def fold(events):
    """Messages of a log, event by event."""
    messages, order = {}, []
    for k, (conv, seq, op, msg, role, text) in enumerate(sorted(events, key=lambda e: (e[1], e[2], e[5] or ""))):
        key = (conv, msg) if msg is not None else (conv, "own", k)
        if key not in messages:
            messages[key] = {"conv": conv, "seq": seq, "role": None, "text": "", "live": True}
            order.append(key)
        m = messages[key]
        m["role"] = role if m["role"] is None else m["role"]
        m["text"] = m["text"] + (text or "") if op == "delta" and m["live"] else ("" if op == "delete" else text or "")
        m["live"] = op != "delete" and (op != "delta" or m["live"])
    return [messages[k] for k in order if messages[k]["live"]]


def test_random_logs_match_a_plain_fold(spark):
    r = random.Random(11)
    events = []
    for conv in range(12):
        for seq in r.sample(range(1000), r.randint(1, 60)):
            op = r.choice(["message", "delta", "delta", "delta", "edit", "regenerate", "delete"])
            events.append((conv, seq, op, r.choice([None, 1, 2, 3, 4, 5]) if op == "message" else r.randint(1, 5), r.choice(["user", "assistant", None]), r.choice(["", "a<b", "&amp;", 'q"', "x\ny", None])))
    df = spark.createDataFrame(events, "conv_id long, seq long, op string, msg_id long, role string, text string").repartition(5)
    want = {}
    for m in sorted(fold(events), key=lambda m: (m["conv"], m["seq"])):
        want.setdefault(m["conv"], []).append((m["role"] or "", m["text"]))
    got = {row.conv_id: [(t.role, t.text) for t in row.turns] for row in C.read_back(C.format_chats(df)).collect()}
    assert got == want


def test_the_derived_log_needs_its_fold(spark):
    rows = [(c, t, "assistant" if t % 2 else "user", f"text {c} {t} " + "é" * (t % 9)) for c in range(6) for t in range(20)]
    log = C.events_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert {r.op for r in log.select("op").distinct().collect()} == {"message", "delta", "edit", "regenerate", "delete"}
    assert log.count() > 2 * len(rows)
    plain = {r.conv_id: r for r in C.digest(C.format_chats(log)).collect()}
    for c in range(6):
        assert plain[c].turns_sha256 == sha("".join(f"{role}\n{text}\n" for conv, _, role, text in rows if conv == c))
    plan = C.digest(C.format_chats(log))._jdf.queryExecution().optimizedPlan().toString()
    assert "log" in plan and plan.count("Aggregate") >= 2


def test_plan_is_native(spark):
    df = spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    plan = C.digest(C.format_chats(C.events_of(df)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
