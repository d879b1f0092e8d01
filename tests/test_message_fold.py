"""Messages from events: column functions, the stateful stream and a plain fold agree, whatever the order of arrival."""

import random
import time

from docloom.streaming import events as E

SCHEMA = "message_id string, seq long, kind string, value string"


def plain(rows):
    found = {}
    for message in sorted({r[0] for r in rows}):
        events = sorted((r[1:] for r in rows if r[0] == message), key=lambda e: (e[0], e[1], e[2] or ""))
        kinds = [k for _, k, _ in events]
        held = events[: kinds.index("error")] if "error" in kinds else events
        of = lambda kind: [v or "" for _, k, v in held if k == kind]  # noqa: E731, B023
        status = "FAILED" if "error" in kinds else "DONE" if of("done") else "STREAMING"
        found[message] = ("".join(of("text")), "\n".join(dict.fromkeys(v for v in of("thinking") if v)), ([""] + of("reference"))[-1], status, len(events))
    return found


def cases(seed=3):
    r = random.Random(seed)
    kinds = ["text"] * 5 + ["thinking"] * 2 + ["reference", "done", "error"]
    rows = [(f"m{r.randrange(9)}", s, r.choice(kinds), r.choice(["a", "b\nc", "", None, " d"])) for s in range(120)]
    return rows + [("one", 1, "error", None), ("tie", 1, "text", "b"), ("tie", 1, "text", "a"), ("null", 1, "text", None)]


def held(rows):
    return {r.message_id: tuple(r)[1:] for r in rows}


def run(stream, folder, wait=0.0, **lengths):
    seen = []

    def take(df, _):
        seen.extend(df.collect())
        time.sleep(wait)

    q = E.fold_stream(stream, **lengths).writeStream.outputMode("update").option("checkpointLocation", str(folder / "c")).foreachBatch(take).trigger(availableNow=True).start()
    assert q.awaitTermination(150)
    return seen


def files(spark, folder, parts):
    for rows in parts:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder / "in"))
        time.sleep(1.1)  # files are taken in the order of their times
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))


def test_batch_equals_a_plain_fold(spark):
    rows = cases()
    assert held(E.fold_batch(spark.createDataFrame(rows, SCHEMA)).collect()) == plain(rows)
    assert E.fold_batch(spark.createDataFrame([], SCHEMA)).collect() == []


def test_events_of_later_triggers_take_their_place(spark, tmp_path):
    rows = cases(4)
    random.Random(1).shuffle(rows)
    seen = run(files(spark, tmp_path, [rows[k::3] for k in range(3)]), tmp_path)
    last = {}
    for r in seen:
        if r.message_id not in last or r.n_events > last[r.message_id].n_events:
            last[r.message_id] = r
    assert held(last.values()) == plain(rows)


def test_state_goes_after_idling(spark, tmp_path):
    parts = [[("a", 1, "text", "x")], [("b", 1, "text", "y")], [("a", 2, "text", "z")]]
    seen = run(files(spark, tmp_path, parts), tmp_path, wait=2.5, idle="1 second")
    assert [(r.message_id, r.text, r.n_events) for r in seen] == [("a", "x", 1), ("b", "y", 1), ("a", "z", 1)]
