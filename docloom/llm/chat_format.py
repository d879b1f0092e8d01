"""Chat formatting with DataFrame functions only: event logs folded into messages, then rendered.

A log row is an event of a conversation, ordered by its sequence number. Streamed
deltas, edits and regenerations are folded into one text per message; messages
are then ordered within their conversation and rendered by a template that can
be read back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import running

OPEN, MIDDLE, CLOSE = '<turn role="', '">\n', "\n</turn>\n"


def escape(text: Column) -> Column:
    """No ``<`` or quote is left, so that no text can close a turn or a role; reversed by ``unescape``."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unescape(text: Column) -> Column:
    for a, b in (("&quot;", '"'), ("&lt;", "<"), ("&amp;", "&")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, seq, role, text): the final messages of logs with conv_id, seq, op, msg_id, role and text.

    ``message``, ``edit`` and ``regenerate`` events set a message's text,
    ``delta`` events append to it, ``delete`` removes the message until it is set
    again. Events act in
    the order of seq (ties: by op, then text). A message stands where its first
    event stood and has its first role. Rows without a msg_id are whole messages
    of their own, each of them, also where rows repeat. Null text is empty.
    """
    events = events.select("conv_id", "seq", F.coalesce("op", F.lit("message")).alias("op"), "msg_id", "role", F.coalesce("text", F.lit("")).alias("text"))
    whole = events.where("msg_id is null").select("conv_id", "seq", "role", "text")
    # only events since the last reset count: grouped per message, so that a long conversation is many small groups
    log = F.sort_array(F.collect_list(F.struct("seq", "op", "text", "role")))
    logs = events.where("msg_id is not null").groupBy("conv_id", "msg_id").agg(log.alias("log"))
    resets = F.array_max(F.transform("log", lambda x, i: F.when(x["op"] != "delta", i + 1).otherwise(0)))
    from_last = F.expr("slice(log, greatest(last, 1), size(log))")
    folded = (
        logs.withColumn("last", resets)
        .where("last = 0 or get(log, last - 1).op <> 'delete'")
        .select(
            "conv_id",
            F.get("log", F.lit(0))["seq"].alias("seq"),
            F.get(F.filter("log", lambda x: x["role"].isNotNull()), F.lit(0))["role"].alias("role"),
            F.array_join(F.transform(from_last, lambda x: x["text"]), "").alias("text"),
        )
    )
    return whole.unionByName(folded)


def render(messages: DataFrame, learn_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans): each conversation as one text, and the spans (start, end) of the texts to learn.

    Turns are ordered by seq, ties by role and text; a null role is empty; null
    conv_ids are one conversation. Spans count code points, end exclusive.
    """
    turns = F.sort_array(F.collect_list(F.struct("seq", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))))
    grouped = messages.groupBy("conv_id").agg(turns.alias("turns"))
    parts = F.transform(
        "turns",
        lambda t: F.struct(
            F.concat(F.lit(OPEN), escape(t["role"]), F.lit(MIDDLE)).alias("head"), escape(t["text"]).alias("body"), (t["role"] == learn_role).alias("learn")
        ),
    )
    parted = grouped.select("conv_id", parts.alias("parts"))
    spans = running(
        F.col("parts"),
        lambda at, p: F.struct((at + F.length(p["head"])).alias("start"), (at + F.length(p["head"]) + F.length(p["body"])).alias("end"), p["learn"].alias("learn")),
        lambda at, p: at + F.length(p["head"]) + F.length(p["body"]) + len(CLOSE),
        "struct<start:int,end:int,learn:boolean>",
    )
    return parted.select(
        "conv_id",
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "").alias("formatted"),
        F.transform(F.filter(spans, lambda s: s["learn"]), lambda s: F.struct(s["start"], s["end"])).alias("loss_spans"),
    )


def format_chats(events: DataFrame) -> DataFrame:
    """Event logs to rendered conversations: ``render(fold_events(events))``."""
    return render(fold_events(events))


def read_back(formatted: DataFrame) -> DataFrame:
    """``formatted`` with ``turns``, an array of (role, text) parsed from the rendered text, and ``loss_text`` under the spans."""
    pieces = F.split("formatted", "\n</turn>\n", -1)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def parse(piece: Column) -> Column:
        head = F.instr(piece, MIDDLE)
        role = F.substring(piece, F.lit(len(OPEN) + 1), head - 1 - len(OPEN))
        return F.struct(unescape(role).alias("role"), unescape(F.substring(piece, head + len(MIDDLE), F.length(piece))).alias("text"))

    loss = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    return formatted.select("*", F.transform(pieces, parse).alias("turns"), F.array_join(loss, "").alias("loss_text"))


def events_of(conversations: DataFrame) -> DataFrame:
    """The event log that leads to the given rows (conv_id, turn, role, text), each of them one message.

    By a hash of its turn and text a message came whole, streamed as deltas, as a
    draft that an edit replaced, or as a streamed draft that was regenerated and
    streamed again, after which a message of its own was written and deleted.
    Events stand in no order; seq is (turn, step). Repeated rows are messages of
    their own, a null turn comes first, null text is empty.
    """
    rows = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("id"))
    size = F.greatest(F.ceil(F.length("text") / 4), F.lit(1)).cast("int")
    piece = lambda k: F.substring("text", size * k + 1, size)
    nobody = F.lit(None).cast("string")

    def event(step: int, op: str, text: Column, role: Column = nobody, own: bool = True) -> Column:
        return F.struct(F.lit(step).alias("step"), F.lit(op).alias("op"), (F.col("id") if own else -F.col("id") - 1).alias("msg_id"), role.alias("role"), text.alias("text"))

    role, text, draft = F.col("role"), F.col("text"), F.concat(F.lit("draft "), F.reverse("text"))
    streamed = lambda first, op, role=nobody: [event(first, op, piece(0), role), *[event(first + k, "delta", piece(k)) for k in (1, 2, 3)]]
    ways = [
        [event(0, "message", text, role)],
        streamed(0, "delta", role),
        [event(0, "message", draft, role), event(1, "edit", text)],
        [
            event(0, "delta", draft, role), event(1, "delta", piece(0)), *streamed(2, "regenerate"),
            event(6, "message", draft, role, own=False), event(7, "delta", text, own=False), event(8, "delete", F.lit(""), own=False),
        ],
    ]
    way = F.pmod(F.xxhash64("turn", "text"), F.lit(len(ways)))
    log = F.when(way == 0, F.array(*ways[0]))
    for k in (1, 2, 3):
        log = log.when(way == k, F.array(*reversed(ways[k])))
    told = rows.select("conv_id", "turn", F.explode(log).alias("e"))
    return told.select("conv_id", F.struct("turn", "e.step").alias("seq"), "e.op", "e.msg_id", "e.role", "e.text")


def digest(formatted: DataFrame) -> DataFrame:
    """conv_id and, read back from the rendered text: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_back(formatted).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
