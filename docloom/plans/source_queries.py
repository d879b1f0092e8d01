"""Queries over layouts, cells, streamed frames and tasks; inputs are built from table rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.plans.catalogue import query
from docloom.sources import layouts as L
from docloom.sources.tables import table
from docloom.streaming import events as E


def _layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id").cast("string")
    made = F.concat(
        F.lit('[{"type":"DocTitle","text":"No. '), k, F.lit('","pageNum":1,"pos":[0,0,10,20]},{"Type":"table","cells":[{"rowIndex":2,"colIndex":2,"text":"h","colSpan":2},{"row":3,"col":2,"text":"a'), k,
        F.lit('"},{"row":3,"column":3,"value":" b "},{"row":0,"col":1,"text":"lost"},{"rowNo":3,"columnNo":5,"text":""}],"pageNo":"2","bbox":{"x":1,"y":2,"w":3,"h":4}},'),
        F.lit('{"subType":"figure","caption":"Figure '), k, F.lit('","box":[1,2,9,2,9,8,1,8]},{"type":"image"},{"type":"para","llmResult":"<TABLE>"},{"type":"page_header","content":"top"},{"content":"一、'), k, F.lit('"}]'),
    )
    return table(spark, sf_dir, "pages").select("page_id", made.alias("layouts"))


@query(
    """SELECT page_id, CAST(b.n AS INT) AS block_no, b.t AS block_type, CASE WHEN b.n IN (1, 3, 7) THEN b.x || page_id ELSE b.x END AS text, CAST(b.p AS INT) AS page_no, b.box AS box, b.k AS box_key FROM pages,
 (VALUES (1, 'TITLE', 'No. ', 1, '0.0|0.0|10.0|20.0', 'pos'), (2, 'TABLE', '', 2, '1.0|2.0|4.0|6.0', 'bbox'), (3, 'FIGURE', 'Figure ', NULL, '1.0|2.0|9.0|8.0', 'box'), (6, 'HEADER', 'top', NULL, NULL, NULL), (7, 'TITLE', '一、', NULL, NULL, NULL)) b(n, t, x, p, box, k)"""
)
def layout_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layouts with keys of several spellings as typed blocks with pages and boxes."""
    b = L.layout_blocks(_layouts(spark, sf_dir), "page_id", "layouts")
    box = F.when(F.col("box").isNotNull(), F.concat_ws("|", "box.x0", "box.y0", "box.x1", "box.y1"))
    return b.select("page_id", "block_no", "block_type", "text", "page_no", box.alias("box"), "box_key")


@query(
    """SELECT page_id, CAST(c.r AS INT) AS row_no, CAST(c.k AS INT) AS column_no, CASE WHEN c.r = 1 AND c.k = 0 THEN c.x || page_id ELSE c.x END AS cell FROM pages, (VALUES (0, 0, 'h'), (0, 1, 'h'), (1, 0, 'a'), (1, 1, 'b')) c(r, k, x)"""
)
def layout_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell lists with spans as trimmed grids."""
    b = L.layout_blocks(_layouts(spark, sf_dir), "page_id", "layouts").where("cells is not null")
    return L.grid_cells(b, ["page_id"], "cells")


@query(
    """SELECT conv_id, turn, CAST(x.k AS INT) AS frame_no, CASE x.k WHEN 0 THEN 'turn ' || turn WHEN 1 THEN 'a' || chr(10) || 'b' ELSE '{"role":"' || role || '"}' END AS payload FROM conversations, (VALUES (0), (1), (2)) x(k)"""
)
def frames_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Server-sent frames with comments, several data lines and an end mark."""
    text = F.concat(F.lit(": hello\n\ndata: turn "), F.col("turn").cast("string"), F.lit('\n\nevent: x\ndata:a\ndata: b\r\n\r\n\ndata: {"role":"'), "role", F.lit('"}\n\nid: 1\n\ndata: [DONE]\n\n'))
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.posexplode(E.sse_frames(text)).alias("frame_no", "payload"))


KINDS = "CASE event_type WHEN 'view' THEN 'text' WHEN 'click' THEN 'thinking' WHEN 'purchase' THEN 'reference' WHEN 'error' THEN CASE WHEN event_id % 40 = 0 THEN 'error' ELSE 'text' END ELSE 'done' END"


@query(
    f"""WITH e AS (SELECT user_id AS message_id, event_id AS seq, {KINDS} AS kind, event_type || (event_id % 10) AS value FROM events), x AS (SELECT message_id, min(CASE WHEN kind = 'error' THEN seq END) AS failed, count(*) AS n_events FROM e GROUP BY ALL),
k AS (SELECT e.* FROM e JOIN x USING (message_id) WHERE failed IS NULL OR seq < failed), t AS (SELECT message_id, value, min(seq) AS seq FROM k WHERE kind = 'thinking' GROUP BY ALL)
SELECT x.message_id, sha256(coalesce((SELECT string_agg(value, '' ORDER BY seq) FROM k WHERE k.message_id = x.message_id AND kind = 'text'), '')) AS text_sha256,
 coalesce((SELECT string_agg(value, chr(10) ORDER BY seq) FROM t WHERE t.message_id = x.message_id), '') AS thinking, coalesce((SELECT arg_max(value, seq) FROM k WHERE k.message_id = x.message_id AND kind = 'reference'), '') AS "references",
 CASE WHEN failed IS NOT NULL THEN 'FAILED' WHEN (SELECT count(*) FROM k WHERE k.message_id = x.message_id AND kind = 'done') > 0 THEN 'DONE' ELSE 'STREAMING' END AS status, n_events FROM x"""
)
def message_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events folded into the state of their message."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("message_id"), F.col("event_id").alias("seq"), F.expr(KINDS).alias("kind"), F.concat("event_type", (F.col("event_id") % 10).cast("string")).alias("value"))
    out = E.fold_batch(e.withColumn("message_id", F.col("message_id").cast("string")))
    return out.select(F.col("message_id").cast("long").alias("message_id"), F.sha2("text", 256).alias("text_sha256"), "thinking", "references", "status", "n_events")


@query("WITH a AS (SELECT user_id, max(event_id % 4) AS run FROM events GROUP BY ALL) SELECT e.event_id FROM events e JOIN a ON a.user_id = e.user_id AND e.event_id % 4 = a.run")
def active_run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the run that is active for their message; stale ones are dropped."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("message_id"), (F.col("event_id") % 4).alias("run_id"))
    return E.current_run(e, e.groupBy("message_id").agg(F.max("run_id").alias("run_id"))).select("event_id")


@query(
    """WITH t AS (SELECT event_id AS task_id, ts AS dispatched, CASE WHEN event_id % 3 = 0 THEN ts + to_minutes(CAST(event_id % 300 AS INT)) END AS heartbeat, event_id % 15 AS dispatches, (SELECT max(ts) FROM events) AS now FROM events),
a AS (SELECT task_id, dispatched, CASE WHEN coalesce(heartbeat, dispatched) < now - INTERVAL 2 HOUR THEN 'STALE' WHEN coalesce(heartbeat, dispatched) < now - INTERVAL 5 MINUTE AND dispatches < 12 THEN 'REDISPATCH' ELSE 'WAIT' END AS action FROM t)
SELECT task_id, action FROM a WHERE action <> 'WAIT' ORDER BY dispatched DESC, task_id LIMIT 200"""
)
def tasks_reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unfinished tasks to give up or to dispatch again: a bounded batch, the latest first."""
    e = table(spark, sf_dir, "events")
    now = e.agg(F.max("ts").alias("now"))
    beat = F.when(F.col("event_id") % 3 == 0, F.timestamp_add("MINUTE", (F.col("event_id") % 300).cast("int"), F.col("ts").cast("timestamp"))).cast("timestamp_ntz")
    tasks = e.select(F.col("event_id").alias("task_id"), F.col("ts").cast("timestamp_ntz").alias("dispatched"), beat.alias("heartbeat"), (F.col("event_id") % 15).alias("dispatches")).crossJoin(F.broadcast(now))  # one row
    return E.reconcile(tasks, F.col("now").cast("timestamp_ntz"), newest_first=True).select("task_id", "action")
