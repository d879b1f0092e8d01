"""Streaming operators: frames, message folding, log merging, retries, reconciling.

Every stateful operator has a batch twin of the same semantics, which is also
what its tests compare with.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

MESSAGE = "message_id string, text string, thinking string, references string, status string, n_events long"


def sse_frames(text: Column) -> Column:
    """Payloads of server-sent events: frames end at a blank line, data lines are joined, the end mark is dropped."""
    frames = F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), r"\n\n+")
    data = lambda frame: F.filter(F.split(frame, "\n"), lambda line: line.startswith("data:"))
    joined = F.transform(frames, lambda f: F.array_join(F.transform(data(f), lambda line: F.regexp_replace(line, "^data: ?", "")), "\n"))
    return F.filter(joined, lambda p: (p != "") & (p != "[DONE]"))


def fold(state: dict, kind: str, value: str) -> dict:
    """One event onto a message: text appends, a thought is kept once, references are replaced, an error fails the message."""
    if state["status"] == "FAILED":
        return state
    if kind == "text":
        state["text"] += value or ""
    elif kind == "thinking" and value and value not in state["thoughts"]:
        state["thoughts"].append(value)
    elif kind == "reference":
        state["references"] = value or ""
    elif kind == "error":
        state["status"] = "FAILED"
    elif kind == "done":
        state["status"] = "DONE"
    return state


def _blank() -> dict:
    return {"text": "", "thoughts": [], "references": "", "status": "STREAMING"}


def fold_batch(events: DataFrame) -> DataFrame:
    """Messages from all their events (message_id, seq, kind, value), by column functions; events of one seq go by kind and value.

    What comes after an error counts but changes nothing. A message is as long as its own events.
    """
    listed = F.sort_array(F.collect_list(F.struct("seq", "kind", F.coalesce("value", F.lit("")).alias("value"))))
    failed = F.array_position(F.transform("events", lambda e: e["kind"]), "error")
    counted = events.groupBy("message_id").agg(listed.alias("events")).withColumn("failed", failed)
    counted = counted.withColumn("held", F.when(F.col("failed") > 0, F.slice("events", 1, (F.col("failed") - 1).cast("int"))).otherwise(F.col("events")))
    of = lambda kind: F.transform(F.filter("held", lambda e: e["kind"] == kind), lambda e: e["value"])
    status = F.when(F.col("failed") > 0, "FAILED").when(F.exists("held", lambda e: e["kind"] == "done"), "DONE").otherwise("STREAMING")
    thoughts = F.array_join(F.array_distinct(F.filter(of("thinking"), lambda v: v != "")), "\n")
    reference = F.coalesce(F.try_element_at(of("reference"), F.lit(-1)), F.lit(""))
    return counted.select(
        "message_id", F.array_join(of("text"), "").alias("text"), thoughts.alias("thinking"), reference.alias("references"), status.alias("status"), F.size("events").cast("long").alias("n_events")
    )


class _Fold(StatefulProcessor):
    """Keeps a message's events in a list state and folds all of them by seq whenever some arrive; a timer ends an idle message."""

    def __init__(self, idle_ms: int, kept_ms: int):
        self.idle_ms, self.kept_ms = idle_ms, kept_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", "seq long, kind string, value string", self.kept_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        fresh = [(int(s), k, None if pd.isna(v) else v) for frame in rows for s, k, v in frame[["seq", "kind", "value"]].itertuples(index=False)]
        self.events.appendList(fresh)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        known = sorted((tuple(e) for e in self.events.get()), key=lambda e: (e[0], e[1], e[2] or ""))
        message = _blank()
        for _, kind, value in known:
            message = fold(message, kind, value)
        thinking = "\n".join(message.pop("thoughts"))
        yield pd.DataFrame([{"message_id": key[0], "text": message["text"], "thinking": thinking, "references": message["references"], "status": message["status"], "n_events": len(known)}])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.events.clear()
        yield from ()

    def close(self) -> None:
        pass


def fold_stream(events: DataFrame, idle: str = "10 minutes", kept: str = "1 day") -> DataFrame:
    """Messages as their events arrive, in whatever order: an event of a later trigger with a smaller seq takes its place in the fold.

    A message's events are dropped after it was idle, and at the latest after
    ``kept``, their time to live. Needs the RocksDB state store
    (``spark.sql.streaming.stateStore.providerClass``). As timers ask for batches
    without data, a query that is to end by itself (``availableNow``) needs
    ``spark.sql.streaming.noDataMicroBatches.enabled`` off.
    """
    ms = lambda length: int(pd.Timedelta(length).total_seconds() * 1000)
    return events.groupBy("message_id").transformWithStateInPandas(_Fold(ms(idle), ms(kept)), MESSAGE, "Update", "ProcessingTime")


def current_run(events: DataFrame, active: DataFrame) -> DataFrame:
    """Events (message_id, run_id) of the run that is active for their message; stale ones are dropped."""
    return events.join(active, ["message_id", "run_id"], "left_semi")


def merge_log_stream(logs: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Log rows (log_id, ts), each id once within the watermark."""
    return logs.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["log_id"])


def windowed_counts(events: DataFrame, length: str = "5 minutes", slide: str | None = None, lateness: str = "10 minutes") -> DataFrame:
    """Counts and sums in tumbling or sliding windows with late data bounded by a watermark."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    return events.withWatermark("ts", lateness).groupBy(window.alias("window"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def with_retries(handle: Callable[[DataFrame], DataFrame], sink: str, dead: str, attempts: int = 3) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: rows that ``handle`` marks not ok are tried again, then go to the dead-letter folder.

    Each attempt writes its results in a folder of the batch, so a batch that
    is repeated after a failure replaces what it wrote.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        batch = batch.withColumn("attempt", F.lit(1))
        for k in range(1, attempts + 1):
            done = handle(batch)
            path = f"{sink}/batch={batch_id}/attempt={k}"
            done.write.mode("overwrite").parquet(path)
            kept = done.sparkSession.read.schema(done.schema).parquet(path)
            failed = kept.where("not ok").drop("ok")
            if k == attempts:
                failed.write.mode("overwrite").parquet(f"{dead}/batch={batch_id}")
            elif failed.isEmpty():
                return
            batch = failed.withColumn("attempt", F.lit(k + 1))

    return run


def reconcile(tasks: DataFrame, now: Column, grace: str = "5 minutes", silence: str = "2 hours", most: int = 12, batch: int = 200, newest_first: bool = False) -> DataFrame:
    """What to do with unfinished tasks (task_id, dispatched, heartbeat, dispatches): re-dispatch, give up or wait; a bounded batch a round."""
    late = F.expr("interval " + grace)
    quiet = F.coalesce("heartbeat", "dispatched") < now - F.expr("interval " + silence)
    again = (F.coalesce("heartbeat", "dispatched") < now - late) & (F.col("dispatches") < most)
    action = F.when(quiet, "STALE").when(again, "REDISPATCH").otherwise("WAIT")
    return tasks.withColumn("action", action).where("action <> 'WAIT'").orderBy(F.desc("dispatched") if newest_first else F.asc("dispatched"), "task_id").limit(batch)


def latest_trace(traces: DataFrame) -> DataFrame:
    """The trace that each exchange ends up with (exchange_id, seq, mode, at): in order of arrival, an automatic one replaces
    any that is not, and otherwise one that is not older replaces what is there.

    Because a later one of another mode can replace an automatic one again, this
    is a fold over each exchange's few traces, not a sort.
    """
    ordered = F.sort_array(F.collect_list(F.struct("seq", "mode", "at")))
    first = F.get("traces", F.lit(0))
    step = lambda kept, t: F.when(((t["mode"] == "auto") & (kept["mode"] != "auto")) | (t["at"] >= kept["at"]), t).otherwise(kept)
    folded = F.aggregate(F.slice("traces", 2, F.size("traces")), first, step)
    grouped = traces.where("exchange_id is not null").groupBy("exchange_id").agg(ordered.alias("traces"))
    return grouped.select("exchange_id", folded.alias("t")).select("exchange_id", "t.*")
