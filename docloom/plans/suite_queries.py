"""Queries over small functions: each row of a table picks one of some literal cases, SQL names the result expected of it.

Ideographs and odd inputs, which the tables do not hold, are met this way; the
functions run on columns, for every row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import scalars as S
from docloom.functions import text as T
from docloom.operators import tree
from docloom.operators.graph import parts_for
from docloom.plans.catalogue import query
from docloom.sources import files
from docloom.sources.tables import table


def _case(cases: dict, key: str = "event_id") -> Column:
    """The input that a row's key picks."""
    inputs = list(cases)
    return F.get(F.array(*[F.lit(x) for x in inputs]), (F.col(key) % len(inputs)).cast("int"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events dealt out: their rows are short but take long, and a file of them may be a single task's."""
    events = table(spark, sf_dir, "events").select("event_id")
    return events.repartition(parts_for(events, 25_000), "event_id")


def _expected(cases: dict, key: str = "event_id") -> str:
    said = ", ".join("NULL" if v is None else f"'{str(v).replace(chr(39), chr(39) * 2)}'" for v in cases.values())
    return f"list_extract([{said}], CAST({key} % {len(cases)} AS INT) + 1)"


def _cases(suites: dict[str, dict]) -> str:
    return "SELECT event_id, " + ", ".join(f"{_expected(cases)} AS {name}" for name, cases in suites.items()) + " FROM events"


HINT = "，请打开文档详情查看阶段记录。"
TEXTS = {
    "classified": {"第一章 总则": "TITLE", "1.2、范围": "TITLE", "结论：": "TITLE", "普通的一段文字。": "TEXT", "": "TEXT", "长" * 81 + "：": "TEXT", "2) no": "TEXT"},
    "heading": {"## Title": "Title", "####### seven": "####### seven", "#no space": "#no space", "plain": "plain"},
    "words": {'["a","b"，c]': "a|b|c", "x、y；x": "x|y", "": "", " [] ": ""},
    "common_path": {"A/B/C#A > B#A/B/D": "A > B", "A#B": "", "#X/Y": "X > Y", "A/B#A/C": "A"},
    "last_part": {"A/B/ C ": "C", "": "", "a>b": "b"},
    "labels": {"公开, 内部，公开": "PUBLIC|INTERNAL", "机密": "机密", "": ""},
    "pages": {"3-5#9": "3-9", "7": "7", "": "", "第2页#第10-12页": "2-12"},
    "reply": {'```json\n{"summary": " s "}\n```': "s", "plain": "plain", '{"other":1}': "", "```\nx\n```": "x"},
    "error": {
        "": "处理失败", "超时": "超时", "pip install x": "处理失败" + HINT, "GraphRAG Traceback (most recent call last)": "图谱构建失败" + HINT, '解析 {"detail":1}': "解析失败" + HINT, "长" * 281: "处理失败" + HINT,
    },
    "template": {"x": "x- y", "{{b}}": "- y"},
    "terms": {"检索增强生成 RAG-2 检索": "rag-2|检索增强生成|检索", "这个 一二三四五六七八": "一二三四|三四五六|五六七八|七八", "ab a.b": "a.b", "": ""},
    "hashed": {"": "0", "ab": "3105", "中文": "646394", "😀": "1772899"},
}


@query(_cases(TEXTS))
def text_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings, lists, paths, labels, pages, replies, errors, templates, terms and hashes."""
    joined = lambda c: F.array_join(c, "|")
    got = {
        "classified": T.classify_block, "heading": T.strip_heading, "words": lambda c: joined(T.metadata_words(c)), "common_path": lambda c: T.common_section_path(F.split(c, "#")), "last_part": T.last_section,
        "labels": lambda c: joined(T.label_set(c, {"公开": "PUBLIC", "内部": "INTERNAL"})), "pages": lambda c: T.merge_page_ranges(F.split(c, "#")), "reply": T.summary_of_reply, "error": T.operator_error,
        "template": lambda c: T.render_template("{{a}}-{{c}} y", a=F.when(c == "x", c), c=F.lit(None)), "terms": lambda c: joined(T.extract_terms(c)), "hashed": lambda c: T.stable_hash(c).cast("string"),
    }
    return _events(spark, sf_dir).select("event_id", *[got[name](_case(cases)).alias(name) for name, cases in TEXTS.items()])


VALUES = {
    "confidence": {"0.5": "0.5", "NaN": None, "Infinity": None, "x": None, "-1e3": "-1000.0"},
    "box": {'{"x0":1,"y0":2,"x1":3,"y1":4}': "1.0|2.0|3.0|4.0", '{"left":1,"top":2,"right":5,"bottom":6}': "1.0|2.0|5.0|6.0", '{"x":1,"y":2,"w":3,"h":4}': "1.0|2.0|4.0|6.0", "[1,2,3,4]": "1.0|2.0|3.0|4.0", '{"x":1}': None},
    "crop": {"[0.1,0.2,0.5,1.0]": "10|40|50|200", "[10.2,20.7,30.1,40.9]": "10|20|31|41", "[-5,-5,500,500]": "0|0|100|200", "[50,50,50,50]": None},
    "offset": {"8": "8", "14": "0", "-12": "-12", "-13": "0", "13": "13"},
    "merged": {'{"a":"1"}': '{"a":"1","b":"2"}', '{"b":"0","c":"3"}': '{"c":"3","b":"2"}', "no json": '{"b":"2"}'},
    "kept": {'{"a":"","b":"0","c":"x","d":null}': '{"c":"x"}', '{"a":"[]","b":"{}"}': "{}", '{"a":" "}': '{"a":" "}'},
    "candidates": {'[{"id":1},{"id":2}]': "2", "[]": "0", "nothing": "0"},
    "present": {'{"b":"2","a":"1"}': "1", '{"b":"2"}': "2", '{"a":null,"b":"x"}': "x", "{}": None},
    "metadata": {"labels=a": '{"labels":"a"}', "labels=a;retiredAt=b": '{"labels":"a","retiredAt":"b"}', " =a": "EMPTY_FIELD:1", "x=1": "UNKNOWN_FIELD:x", "labels=a;labels=b": "REPEATED_FIELD:labels"},
    "kind": {"a.MD": "MARKDOWN", "b": "UNKNOWN", "c.xls": "XLS", "d.tar.gz": "GZ", "e.htm": "HTML"},
    "parser": {"a.MD": "NATIVE_TEXT", "b": "REJECTED", "c.xls": "REJECTED", "d.pdf": "LAYOUT_SERVICE", "e.txt": "NATIVE_TEXT"},
    "decoded": {"aGk=": "hi", "": None, "%%": None, "5Lit5paH": "中文", "1tDOxA==": "中文"},
    "table": {"a,,b;,,;c,d,": "a | b\nc | d", ",,;,": "", " x ;y": "x\ny"},
    "html": {"a,<b>;c&,": "<table><tr><td>a</td><td>&lt;b&gt;</td></tr><tr><td>c&amp;</td><td></td></tr></table>", "": "<table></table>"},
}


@query(_cases(VALUES))
def value_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers, boxes, JSON, metadata, file types, decoding and tables."""
    box = lambda b: F.when(b.isNotNull(), F.concat_ws("|", *[b[f"{n}"] for n in ("x0", "y0", "x1", "y1")]))
    crop = lambda c: F.concat_ws("|", *[c[n] for n in ("left", "top", "right", "bottom")])
    pairs = lambda c: F.transform(F.split(c, ";"), lambda e: F.struct(F.split_part(e, F.lit("="), F.lit(1)).alias("field"), F.split_part(e, F.lit("="), F.lit(2)).alias("value")))
    grid = lambda c: T.trim_table(F.transform(F.split(c, ";"), lambda r: F.split(r, ",")))
    none, no_type = F.lit(None).cast("string"), F.lit("")

    def metadata(c: Column) -> Column:
        made = S.metadata_json(pairs(c), ["labels", "retiredAt"])
        return F.coalesce(made["json"], made["error"])

    def cropped(c: Column) -> Column:
        found = S.crop_box(S.box_of_json(c), F.lit(100), F.lit(200))
        return F.when(found.isNotNull(), crop(found))

    got = {
        "confidence": lambda c: S.confidence(c).cast("string"), "box": lambda c: box(S.box_of_json(c)), "crop": cropped, "offset": lambda c: S.offset_hours(c.cast("int")).cast("string"),
        "merged": lambda c: F.to_json(S.merge_maps(S.json_map(c), F.create_map(F.lit("b"), F.lit("2")))), "kept": lambda c: F.to_json(S.without_empty(S.json_map(c))),
        "candidates": lambda c: F.size(S.candidate_list(c, "id:int")).cast("string"), "present": lambda c: S.first_present(c, "a", "b"), "metadata": metadata, "kind": lambda c: files.file_type(c, none, no_type),
        "parser": lambda c: files.route(files.file_type(c, none, no_type)), "decoded": lambda c: files.decode_text(files.decode_base64(c)), "table": lambda c: T.table_text(grid(c)),
        "html": lambda c: T.table_html(grid(c)),
    }
    return _events(spark, sf_dir).select("event_id", *[got[name](_case(cases)).alias(name) for name, cases in VALUES.items()])


SHOWN = ("%Y-%m-%d", "%Y-%m-%d %H", "%Y-%m-%d %H:%M", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M:%S:%g", "%Y%m%d", "%Y%m%d%H", "%Y%m%d%H%M", "%Y%m%d%H%M%S", "%Y%m%d%H%M%S%g", "%Y-%m-%dT%H:%M:%S.%gZ")


@query("SELECT event_id, " + ", ".join(f"strftime(ts, '{f}') AS shown_{k}" for k, f in enumerate(SHOWN)) + ", date_trunc('second', ts)::TIMESTAMP AS read_back, '' AS missing FROM events")
def date_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times in all patterns, one read back, and what null shows."""
    ts = F.col("ts").cast("timestamp")
    back = S.parse_date(S.format_date(ts, S.PATTERNS[3]), S.PATTERNS[3]).cast("timestamp_ntz")
    shown = [S.format_date(ts, p).alias(f"shown_{k}") for k, p in enumerate(S.PATTERNS)]
    return table(spark, sf_dir, "events").select("event_id", *shown, back.alias("read_back"), S.format_date(F.lit(None).cast("timestamp"), S.PATTERNS[0]).alias("missing"))


@query(
    """WITH e AS (SELECT event_id, ts, CAST(event_id % 29 - 14 AS INT) AS n FROM events) SELECT event_id, (ts + to_years(n))::TIMESTAMP AS year_on, (ts + to_months(n))::TIMESTAMP AS month_on, (ts + to_days(7 * n))::TIMESTAMP AS week_on, (ts + to_days(n))::TIMESTAMP AS day_on,
 (ts + to_hours(n))::TIMESTAMP AS hour_on, (ts + to_minutes(n))::TIMESTAMP AS minute_on, (ts + to_seconds(n))::TIMESTAMP AS second_on, (ts + to_milliseconds(n))::TIMESTAMP AS millisecond_on,
 CASE WHEN event_id % 9 BETWEEN 1 AND 7 THEN (ts + to_days(CAST(event_id % 9 - isodow(ts) AS INT)))::TIMESTAMP END AS week_day, CAST(day(last_day(ts)) AS INT) AS days_in_month, CAST(quarter(ts) AS INT) AS quarter, CAST(dayofyear(ts) AS INT) AS day_of_year FROM e"""
)
def date_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times moved by every unit, days of the week by number, and parts."""
    ts, n = F.col("ts").cast("timestamp"), F.col("event_id") % 29 - 14
    moved = [S.shifted(ts, u, n).cast("timestamp_ntz").alias(f"{u.lower()}_on") for u in S.UNITS]
    parts = S.date_parts(ts)
    return table(spark, sf_dir, "events").select(
        "event_id", *moved, S.week_date(ts, F.col("event_id") % 9).cast("timestamp_ntz").alias("week_day"), parts["days_in_month"].alias("days_in_month"), parts["quarter"].alias("quarter"), parts["day_of_year"].alias("day_of_year")
    )


@query(
    """SELECT event_id, CAST(ceil(n / 6.0) AS BIGINT) AS target, round(CASE WHEN n > 0 THEN (1.0 - s * 1.0 / n) * least(1.0, value / 100) ELSE 0 END, 9) AS balance, greatest(50.0, value) AS axis, n <= 15 AND n + 2 + 3 + 4 <= 20 AS fits
FROM (SELECT *, CAST(event_id % 20 AS INT) AS n, CAST(event_id % 20 // 3 AS INT) AS s FROM events)"""
)
def cluster_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster targets, balance, axis ends and budget tests."""
    n, singles, value = F.col("event_id") % 20, F.floor(F.col("event_id") % 20 / 3), F.col("value")
    return table(spark, sf_dir, "events").select(
        "event_id", S.cluster_target(n, F.lit(6)).alias("target"), F.round(S.balance_score(singles, n, value, F.lit(100)), 9).alias("balance"), S.axis_max(value, 50.0).alias("axis"), S.fits_budget(n, 15, 20, 2, 3, 4).alias("fits")
    )


@query(
    """WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, event_type, value FROM events), p AS (SELECT day, count_if(event_type = 'view') AS parse_count, round(avg(CASE WHEN event_type = 'view' THEN value END), 6) AS parse_ms, count_if(event_type = 'click') AS index_count, round(avg(CASE WHEN event_type = 'click' THEN value END), 6) AS index_ms FROM d GROUP BY ALL)
SELECT *, round(index_ms / nullif(parse_ms, 0), 6) AS index_to_parse FROM p WHERE parse_count > 0 OR index_count > 0"""
)
def processing_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed and indexed documents a day, their mean times and the ratio of these."""
    kind, value = F.col("event_type"), F.col("value")
    mean = lambda k: F.round(F.avg(F.when(kind == k, value)), 6)
    g = table(spark, sf_dir, "events").groupBy(F.col("ts").cast("date").alias("day")).agg(
        F.count_if(kind == "view").alias("parse_count"), mean("view").alias("parse_ms"), F.count_if(kind == "click").alias("index_count"), mean("click").alias("index_ms")
    )
    return g.where("parse_count > 0 or index_count > 0").withColumn("index_to_parse", F.round(F.col("index_ms") / F.nullif("parse_ms", F.lit(0.0)), 6))


ITEMS = """i AS (SELECT source AS node, doc_id AS item, CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'title ' || (doc_id % 3) END AS title, CASE WHEN source IN ('src1', 'src2') THEN 'Guide/Part ' || source || '/' || (doc_id % 2) ELSE '' END AS path, (doc_id % 40 + 1) || '-' || (doc_id % 40 + 2) AS pages,
 ['k' || (doc_id % 5), 'k' || (doc_id % 17), 'all'] AS words, CASE WHEN source = 'src3' THEN [] ELSE ['q' || (doc_id % 9)] END AS asked, 'about ' || doc_id AS summary FROM documents)"""


@query(
    f"""WITH {ITEMS}, t AS (SELECT node, title, count(*) AS n, min(item) AS spot FROM i WHERE title <> '' GROUP BY ALL), tt AS (SELECT node, arg_min(title, {{'n': -n, 'at': spot}}) AS title FROM t GROUP BY ALL),
w AS (SELECT node, x.w AS w, count(*) AS n, min({{'item': item, 'k': x.k}}) AS spot FROM i, LATERAL (SELECT unnest(words) AS w, unnest(range(0, 3)) AS k) x GROUP BY ALL), wr AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY n DESC, spot) AS place FROM w), ww AS (SELECT node, list(w ORDER BY place) AS ws FROM wr WHERE place <= 12 GROUP BY ALL),
q AS (SELECT node, asked[1] AS q, min(item) AS spot FROM i WHERE len(asked) > 0 GROUP BY ALL), qr AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY spot) AS place FROM q), qq AS (SELECT node, list(q ORDER BY place) AS qs FROM qr WHERE place <= 6 GROUP BY ALL),
g AS (SELECT node, list_sort(list(item)) AS chunks, CASE WHEN node IN ('src1', 'src2') THEN CASE WHEN min(item % 2) = max(item % 2) THEN 'Guide > Part ' || node || ' > ' || min(item % 2) ELSE 'Guide > Part ' || node END ELSE '' END AS section, CAST(min(item % 40 + 1) AS VARCHAR) || '-' || max(item % 40 + 2) AS pages, arg_min(summary, item) AS summary FROM i GROUP BY node),
o AS (SELECT g.node, section, g.pages, chunks, ws, coalesce(qs, list_transform(ws[1:3], lambda x: x || ' 的核心内容是什么？')) AS qs, summary, CASE WHEN section <> '' THEN trim(string_split(section, '>')[-1]) ELSE coalesce(tt.title, array_to_string(ws[1:3], '、')) END AS title FROM g LEFT JOIN tt USING (node) LEFT JOIN ww USING (node) LEFT JOIN qq USING (node))
SELECT node, title, section AS section_path, pages AS page_range, array_to_string(ws, ',') AS keywords, array_to_string(qs, ',') AS questions, CAST(len(chunks) AS INT) AS n_chunks,
 sha256(left('标题：' || title || chr(10) || CASE WHEN section <> '' THEN '章节：' || section || chr(10) ELSE '' END || '关键词：' || array_to_string(ws, '、') || chr(10) || '摘要：' || summary || chr(10) || '典型问题：' || array_to_string(qs, '；'), 1200)) AS weighted_sha256 FROM o"""
)
def tree_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes built from clustered items: titles, sections, keywords, questions and weighted texts."""
    d = F.col("doc_id")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    none = F.expr("cast(array() as array<string>)")
    items = table(spark, sf_dir, "documents").select(
        F.col("source").alias("node"), d.alias("item"), F.when(d % 4 == 0, "").otherwise(text("title ", d % 3)).alias("title"),
        F.when(F.col("source").isin("src1", "src2"), text("Guide/Part ", F.col("source"), "/", d % 2)).otherwise("").alias("section_path"), text(d % 40 + 1, "-", d % 40 + 2).alias("page_range"),
        F.array(text("k", d % 5), text("k", d % 17), F.lit("all")).alias("keywords"), F.when(F.col("source") == "src3", none).otherwise(F.array(text("q", d % 9))).alias("questions"), text("about ", d).alias("summary"),
    )
    out = tree.build_nodes(items)
    return out.select("node", "title", "section_path", "page_range", F.array_join("keywords", ",").alias("keywords"), F.array_join("questions", ",").alias("questions"), F.size("chunk_ids").alias("n_chunks"), F.sha2("weighted", 256).alias("weighted_sha256"))


@query(
    """WITH v AS (SELECT label, vec_id // 5 AS cluster, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS u FROM embeddings), p AS (SELECT a.label, a.cluster, avg(list_cosine_similarity(a.u, b.u)) AS s FROM (SELECT *, row_number() OVER () AS k FROM v) a JOIN (SELECT *, row_number() OVER () AS k FROM v) b ON a.label = b.label AND a.cluster = b.cluster AND a.k < b.k GROUP BY ALL),
c AS (SELECT label, cluster, count(*) AS n FROM v GROUP BY ALL), g AS (SELECT label, count(*) AS n_clusters, round(avg(n), 6) AS mean_size, max(n) AS largest, count_if(n = 1) AS single, CAST(sum(n) AS BIGINT) AS n_items, round(count(*) * 1.0 / sum(n), 4) AS compression, round((1.0 - count_if(n = 1) * 1.0 / count(*)) * least(1.0, avg(n) / max(n)), 4) AS balance FROM c GROUP BY ALL)
SELECT CAST(g.label AS BIGINT) AS doc, n_clusters, mean_size, largest, single, n_items, compression, balance, round(coalesce(avg(s), 0), 4) AS similarity FROM g LEFT JOIN p USING (label) GROUP BY ALL"""
)
def cluster_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of clusters: sizes, compression, balance, inner similarity."""
    e = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("doc"), F.floor(F.col("vec_id") / 5).alias("cluster"), S.l2_normalize(F.col("embedding")).alias("unit"))
    sizes = e.groupBy("doc", "cluster").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("doc").agg(F.max("n").alias("most"))
    own = sizes.groupBy("doc").agg(F.count("*").alias("n_clusters"), F.avg("n").alias("mean"), F.max("n").alias("largest"), F.count_if(F.col("n") == 1).alias("single"), F.sum("n").alias("n_items"))
    out = own.join(largest, "doc").join(tree.inner_similarity(e), "doc")
    return out.select(
        "doc", "n_clusters", F.round("mean", 6).alias("mean_size"), "largest", "single", "n_items", F.round(F.col("n_clusters") / F.col("n_items"), 4).alias("compression"),
        F.round(S.balance_score(F.col("single"), F.col("n_clusters"), F.col("mean"), F.col("most")), 4).alias("balance"), F.round("similarity", 4).alias("similarity"),
    )
