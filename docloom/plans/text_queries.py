"""Queries over texts: profiles, blocks, terms, scores, citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.plans.catalogue import query
from docloom.sources.tables import table

# SQL fragments: white space at both ends, paragraphs, sentences.
STRIP = r"regexp_replace(regexp_replace({0}, '^[\p{{Z}}\s]+', ''), '[\p{{Z}}\s]+$', '')"
CLEAN = STRIP.format(r"translate(replace(replace(text, chr(13)||chr(10), chr(10)), chr(13), chr(10)), chr(9), ' ')")
PARAGRAPHS = rf"list_filter(list_transform(regexp_split_to_array({CLEAN}, '\n\s*\n+'), lambda p: {STRIP.format('p')}), lambda p: p <> '')"
LINES = rf"list_filter(list_transform(string_split(text, chr(10)), lambda p: {STRIP.format('p')}), lambda p: p <> '')"
SENTENCES = r"list_filter(list_transform(regexp_split_to_array(text, '[。！？!?；;\n]+'), lambda p: {s}), lambda p: p <> '')".format(s=STRIP.format("p"))
TOKENS = r"regexp_extract_all(lower(coalesce({0}, '')), '[\p{{L}}\p{{N}}_]+')"
TERMS = "list_distinct(regexp_extract_all(lower(coalesce({0}, '')), '[a-z][a-z0-9._/-]{{2,40}}'))"


@query(
    rf"""SELECT doc_id, char_count, token_count, n_paragraphs, max_paragraph,
       CASE WHEN n_paragraphs >= 3 THEN 1 ELSE 0 END AS structure_level,
       CASE WHEN char_count = 0 THEN 1 WHEN char_count < 500 THEN 2 ELSE 3 END AS quality_level
FROM (SELECT doc_id, CAST(length(text) AS BIGINT) AS char_count,
        CAST(CASE WHEN length(text) = 0 THEN 0 ELSE len(regexp_extract_all(text, '[A-Za-z]+')) + greatest(1, length(text) // 4) END AS BIGINT) AS token_count,
        CAST(len({PARAGRAPHS}) AS INT) AS n_paragraphs,
        CAST(coalesce(list_max(list_transform({PARAGRAPHS}, lambda p: length(p))), 0) AS INT) AS max_paragraph
      FROM documents WHERE text IS NOT NULL)"""
)
def doc_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, structure and quality level of each text."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    parts = docs.select("doc_id", "text", T.paragraphs(F.col("text")).alias("p"))
    return parts.select(
        "doc_id",
        F.length("text").cast("long").alias("char_count"),
        T.token_estimate(F.col("text")).alias("token_count"),
        F.size("p").alias("n_paragraphs"),
        F.coalesce(F.array_max(F.transform("p", F.length)), F.lit(0)).alias("max_paragraph"),
        T.structure_level(F.lit(0), F.size("p")).alias("structure_level"),
        T.quality_level(F.col("text")).alias("quality_level"),
    )


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line_no, block_text, block_type): every non-blank line; short lines that end in no comma count as titles."""
    docs = table(spark, sf_dir, "documents")
    lines = docs.select("doc_id", F.posexplode(T.non_blank(F.split("text", "\n"))).alias("pos", "block_text"))
    kind = F.when(F.length("block_text") <= 20, "TITLE").when(F.col("block_text").contains("|"), "TABLE").otherwise("TEXT")
    return lines.select("doc_id", (F.col("pos") + 1).alias("block_no"), "block_text", kind.alias("block_type"))


BLOCKS = rf"""SELECT doc_id, CAST(i AS INT) AS block_no, lines[i] AS block_text,
  CASE WHEN length(lines[i]) <= 20 THEN 'TITLE' WHEN contains(lines[i], '|') THEN 'TABLE' ELSE 'TEXT' END AS block_type
FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, {LINES} AS lines FROM documents))"""


@query(f"SELECT doc_id, block_no, block_type, sha256(block_text) AS text_sha256 FROM ({BLOCKS})")
def paragraph_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed blocks of each text, densely numbered after blank ones went."""
    return blocks(spark, sf_dir).select("doc_id", "block_no", "block_type", F.sha2("block_text", 256).alias("text_sha256"))


@query(
    f"""SELECT doc_id, block_no, block_type,
  coalesce(last_value(CASE WHEN block_type = 'TITLE' THEN block_text END IGNORE NULLS)
    OVER (PARTITION BY doc_id ORDER BY block_no ROWS UNBOUNDED PRECEDING), '') AS section_path
FROM ({BLOCKS})"""
)
def section_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each block under the last title before it; the path is flat."""
    w = Window.partitionBy("doc_id").orderBy("block_no").rowsBetween(Window.unboundedPreceding, 0)
    title = F.last(F.when(F.col("block_type") == "TITLE", F.col("block_text")), ignorenulls=True).over(w)
    return blocks(spark, sf_dir).select("doc_id", "block_no", "block_type", F.coalesce(title, F.lit("")).alias("section_path"))


@query(
    f"""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY block_no) AS INT) AS new_no, block_no AS old_no
FROM ({BLOCKS}) WHERE block_type <> 'TITLE'"""
)
def dense_renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks renumbered without gaps after a filter."""
    kept = blocks(spark, sf_dir).where("block_type <> 'TITLE'")
    return kept.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("block_no")).alias("new_no"), F.col("block_no").alias("old_no"))


@query(
    f"""WITH b AS ({BLOCKS}),
r AS (SELECT *, sum(CASE WHEN block_type = 'TABLE' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY block_no ROWS UNBOUNDED PRECEDING) AS run FROM b),
q AS (SELECT *, row_number() OVER (PARTITION BY doc_id, run ORDER BY block_no DESC) AS from_end, row_number() OVER (PARTITION BY doc_id, run ORDER BY block_no) AS from_start FROM r)
SELECT t.doc_id, t.block_no,
  coalesce((SELECT string_agg(CASE WHEN length(p.block_text) > 240 THEN regexp_replace(left(p.block_text, 240), '[\\p{{Z}}\\s]+$', '') || '...' ELSE p.block_text END, chr(10) ORDER BY p.block_no)
     FROM q p WHERE p.doc_id = t.doc_id AND p.run = t.run - 1 AND p.block_type <> 'TABLE' AND p.from_end <= 2), '') AS before_text,
  coalesce((SELECT string_agg(CASE WHEN length(n.block_text) > 240 THEN regexp_replace(left(n.block_text, 240), '[\\p{{Z}}\\s]+$', '') || '...' ELSE n.block_text END, chr(10) ORDER BY n.block_no)
     FROM q n WHERE n.doc_id = t.doc_id AND n.run = t.run AND n.block_type <> 'TABLE' AND n.from_start <= 3), '') AS after_text
FROM q t WHERE t.block_type = 'TABLE'"""
)
def table_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to two neighbours on each side of a table block, none beyond another table, each clipped.

    One window over each document numbers the runs between tables; the runs'
    ends are aggregated and joined back on (doc_id, run).
    """
    order = Window.partitionBy("doc_id").orderBy("block_no").rowsBetween(Window.unboundedPreceding, 0)
    b = blocks(spark, sf_dir).withColumn("run", F.sum((F.col("block_type") == "TABLE").cast("int")).over(order))
    text = F.struct("block_no", T.clip_text(F.col("block_text"), 240).alias("t"))
    other = b.where("block_type <> 'TABLE'").groupBy("doc_id", "run").agg(F.sort_array(F.collect_list(text)).alias("all"))
    joined = lambda part: F.array_join(F.transform(part, lambda x: x["t"]), "\n")
    ends = other.select(
        "doc_id", "run", joined(F.slice("all", F.greatest(F.size("all") - 1, F.lit(1)), F.lit(2))).alias("tail"), joined(F.slice("all", 1, 2)).alias("head")
    )
    tables = b.where("block_type = 'TABLE'").select("doc_id", "block_no", "run")
    before = ends.select("doc_id", (F.col("run") + 1).alias("run"), F.col("tail").alias("before_text"))
    after = ends.select("doc_id", "run", F.col("head").alias("after_text"))
    out = tables.join(before, ["doc_id", "run"], "left").join(after, ["doc_id", "run"], "left")
    return out.select("doc_id", "block_no", F.coalesce("before_text", F.lit("")).alias("before_text"), F.coalesce("after_text", F.lit("")).alias("after_text"))


@query(f"SELECT doc_id, CAST(len({TERMS.format('text')}) AS INT) AS n_terms, sha256(array_to_string(list_sort({TERMS.format('text')}), ',')) AS terms_sha256 FROM documents")
def text_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct terms of each text."""
    terms = table(spark, sf_dir, "documents").select("doc_id", T.extract_terms(F.col("text")).alias("t"))
    return terms.select("doc_id", F.size("t").alias("n_terms"), F.sha2(F.array_join(F.array_sort("t"), ","), 256).alias("terms_sha256"))


EXTRACT = f"""s AS (SELECT doc_id, {SENTENCES} AS parts FROM documents WHERE text IS NOT NULL),
e AS (SELECT doc_id, unnest(range(0, len(parts))) AS idx, parts FROM s),
c AS (SELECT doc_id, idx, parts[idx + 1] AS sentence FROM e WHERE length(parts[idx + 1]) BETWEEN 18 AND 260),
r AS (SELECT *, least(length(sentence), 180) / 180.0 + (CASE WHEN contains(sentence, 'the') THEN 1 ELSE 0 END) + (CASE WHEN contains(sentence, 'de') THEN 1 ELSE 0 END) AS score FROM c),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, idx) AS place FROM r)"""
# a text with its summary: the best sentences joined, at most 900 characters
SUMMARISED = EXTRACT + """, j AS (SELECT doc_id, left(string_agg(sentence, '；' ORDER BY place), 900) AS sm FROM k WHERE place <= 4 GROUP BY doc_id),
d AS (SELECT documents.doc_id, text, coalesce(sm, '') AS sm FROM documents LEFT JOIN j ON j.doc_id = documents.doc_id WHERE text IS NOT NULL)"""


def _parts_of(text: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({text}, '[。！？!?；;\\n]+'), lambda p: {STRIP.format('p')}), lambda p: p <> '')"


@query(f"WITH {EXTRACT} SELECT doc_id, CAST(place AS INT) AS place, round(score, 6) AS score, sentence FROM k WHERE place <= 4")
def extractive_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four best sentences of each text by keywords held and length; ties in reading order."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    parts = docs.select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("idx", "sentence")).where("length(sentence) between 18 and 260")
    keywords = F.array(F.lit("the"), F.lit("de"))
    scored = parts.withColumn("score", T.sentence_score(F.col("sentence"), keywords))
    order = Window.partitionBy("doc_id").orderBy(F.round("score", 9).desc(), "idx")
    ranked = scored.withColumn("place", F.row_number().over(order)).where("place <= 4")
    return ranked.select("doc_id", "place", F.round("score", 6).alias("score"), "sentence")


def summarised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, summary): each text with its best sentences joined, at most 900 characters."""
    best = extractive_summary(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("place", "sentence"))).alias("best"))  # four a text
    joined = F.left(F.array_join(F.transform("best", lambda x: x["sentence"]), "；"), F.lit(900))
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")
    return docs.join(best, "doc_id", "left").select("doc_id", "text", F.coalesce(joined, F.lit("")).alias("summary"))


@query(
    f"""WITH {SUMMARISED} SELECT doc_id, CASE WHEN len(s) = 0 THEN 1.0 ELSE round(len(list_filter(s, lambda x: length(x) >= 24 AND contains(text, x))) * 1.0 / len(s), 6) END AS copy_ratio
FROM (SELECT doc_id, text, {_parts_of("sm || chr(10) || 'added words that stand in no text'")} AS s FROM d)"""
)
def copy_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of a summary is copied from its text; the summary is the extracted one and a line of its own."""
    summary = F.concat("summary", F.lit("\nadded words that stand in no text"))
    return summarised(spark, sf_dir).select("doc_id", F.round(T.copy_ratio(summary, F.col("text")), 6).alias("copy_ratio"))


@query(
    f"""WITH {SUMMARISED} SELECT doc_id, CASE WHEN sm = '' OR text = '' THEN 0.0 ELSE round(0.42 * len(list_intersect(m, t)) / greatest(1, len(m)) + 0.24 * least(1.0, least(length(sm), 900) / 260.0)
   + 0.18 * (CASE WHEN length(sm) < greatest(240, length(text) * 0.65) THEN 1.0 ELSE 0.35 END) + 0.16 * (1 - c), 4) END AS quality_score
FROM (SELECT *, {TERMS.format('sm')} AS m, {TERMS.format('text')} AS t, CASE WHEN len(s) = 0 THEN 1.0 ELSE len(list_filter(s, lambda x: length(x) >= 24 AND contains(text, x))) * 1.0 / len(s) END AS c
 FROM (SELECT *, {_parts_of("sm")} AS s FROM d))"""
)
def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of each text's extracted summary."""
    return summarised(spark, sf_dir).select("doc_id", T.quality_score(F.col("summary"), F.col("text"), F.lit(0)).alias("quality_score"))


@query(
    f"""WITH t AS (SELECT source, doc_id, {TERMS.format('text')} AS terms FROM documents),
e AS (SELECT source, doc_id, unnest(terms) AS keyword FROM t),
g AS (SELECT source, keyword, count(*) AS n, min(doc_id) AS first_doc FROM e GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, first_doc, keyword) AS place FROM g)
SELECT source, keyword, n, CAST(place AS INT) AS place FROM r WHERE place <= 12"""
)
def keyword_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve keywords that most texts of a source share; counts are aggregated before ranking."""
    docs = table(spark, sf_dir, "documents")
    terms = docs.select("source", "doc_id", F.explode(T.extract_terms(F.col("text"))).alias("keyword"))
    counted = terms.groupBy("source", "keyword").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))
    order = Window.partitionBy("source").orderBy(F.desc("n"), "first_doc", "keyword")
    return counted.withColumn("place", F.row_number().over(order)).where("place <= 12").select("source", "keyword", "n", "place")


@query(
    r"""SELECT doc_id, CASE WHEN length(flat) > 60 THEN left(flat, 60) || '...' ELSE flat END AS preview,
 CASE WHEN length(text) > 40 THEN left(text, 40) || '...' ELSE coalesce(text, '') END AS truncated
FROM (SELECT doc_id, text, """
    + STRIP.format(r"regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')")
    + """ AS flat FROM documents)"""
)
def previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collapsed and plain leads of each text."""
    return table(spark, sf_dir, "documents").select("doc_id", T.preview(F.col("text"), 60).alias("preview"), T.truncate(F.col("text"), 40).alias("truncated"))


@query(
    r"""SELECT page_id, '/' || coalesce(nullif(regexp_replace(regexp_replace(url, '[^0-9a-zA-Z一-鿿]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'root') || '/' || page_id AS path,
 coalesce(nullif(regexp_replace(url, '\.[^.]*$', ''), ''), 'document') AS base_name,
 coalesce(list_filter(regexp_split_to_array(url, '[/>\n]+'), lambda p: p <> '')[-1], '') AS last_part FROM pages"""
)
def canonical_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses as canonical paths, base names and last parts."""
    pages = table(spark, sf_dir, "pages")
    return pages.select(
        "page_id",
        T.canonical_path(F.col("url"), F.col("page_id")).alias("path"),
        T.base_name(F.col("url")).alias("base_name"),
        T.last_section(F.col("url")).alias("last_part"),
    )


@query(
    f"""WITH c AS (SELECT conv_id, turn, role, text,
   string_agg(text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS context FROM conversations),
t AS (SELECT conv_id, turn, {TOKENS.format('text')} AS a, {TOKENS.format('context')} AS b FROM c WHERE role = 'assistant')
SELECT conv_id, turn, round(CASE WHEN len(a) = 0 THEN (CASE WHEN len(b) = 0 THEN 1.0 ELSE 0.0 END) ELSE len(list_filter(a, lambda x: list_contains(b, x))) * 1.0 / len(a) END, 6) AS score FROM t"""
)
def faithfulness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each reply's tokens that its conversation held before.

    A token was held before if its first turn in the conversation is an earlier
    one: one minimum for each conversation and token, joined by both, so that a
    long conversation is many small groups.
    """
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", T.eval_tokens(F.col("text")).alias("tokens"))
    each = c.select("conv_id", "turn", "role", F.explode("tokens").alias("token"))
    first = each.groupBy("conv_id", "token").agg(F.min("turn").alias("first_turn"))
    own = each.where("role = 'assistant'").groupBy("conv_id", "turn", "token").agg(F.count("*").alias("n"))
    held = own.join(first, ["conv_id", "token"]).groupBy("conv_id", "turn").agg(F.sum(F.when(F.col("first_turn") < F.col("turn"), F.col("n")).otherwise(0)).alias("held"))
    begun = c.where(F.size("tokens") > 0).groupBy("conv_id").agg(F.min("turn").alias("begun"))
    replies = c.where("role = 'assistant'").select("conv_id", "turn", F.size("tokens").alias("n_tokens"))
    out = replies.join(held, ["conv_id", "turn"], "left").join(begun, "conv_id", "left")
    empty = F.when(F.coalesce(F.col("begun") < F.col("turn"), F.lit(False)), 0.0).otherwise(1.0)
    return out.select("conv_id", "turn", F.round(F.when(F.col("n_tokens") == 0, empty).otherwise(F.col("held") / F.col("n_tokens")), 6).alias("score"))


@query(
    f"""WITH c AS (SELECT conv_id, turn, role, text,
   string_agg(text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS context FROM conversations),
t AS (SELECT conv_id, {TOKENS.format('text')} AS a, {TOKENS.format('context')} AS b FROM c WHERE role = 'assistant'),
s AS (SELECT conv_id, round(CASE WHEN len(a) = 0 THEN (CASE WHEN len(b) = 0 THEN 1.0 ELSE 0.0 END) ELSE len(list_filter(a, lambda x: list_contains(b, x))) * 1.0 / len(a) END, 6) AS score FROM t)
SELECT k.conv_id, count(score) AS n_replies, round(coalesce(avg(score), 0), 6) AS mean_score FROM (SELECT DISTINCT conv_id FROM conversations) k LEFT JOIN s ON s.conv_id = k.conv_id GROUP BY k.conv_id"""
)
def faithfulness_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean score of each conversation's replies, 0 where it has none."""
    every = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    means = faithfulness(spark, sf_dir).groupBy("conv_id").agg(F.count("score").alias("n_replies"), F.avg("score").alias("mean"))
    return every.join(means, "conv_id", "left").select(
        "conv_id", F.coalesce("n_replies", F.lit(0)).cast("long").alias("n_replies"), F.round(F.coalesce("mean", F.lit(0.0)), 6).alias("mean_score")
    )


@query(
    r"""WITH a AS (SELECT conv_id, turn, text || ' [1] and [' || (turn + 2) || '] [1]' AS reply, turn FROM conversations WHERE role = 'assistant'),
n AS (SELECT DISTINCT conv_id, turn, CAST(unnest(regexp_extract_all(reply, '\[(\d+)\]', 1)) AS INT) AS cited FROM a),
s AS (SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INT) AS source_no FROM conversations WHERE role = 'user')
SELECT n.conv_id, n.turn, n.cited, s.source_no IS NOT NULL AS bound FROM n LEFT JOIN s ON s.conv_id = n.conv_id AND s.source_no = n.cited"""
)
def citation_bind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers cited by replies, bound to rendered sources or rejected; sources are the user turns in order."""
    c = table(spark, sf_dir, "conversations")
    reply = F.concat(F.col("text"), F.lit(" [1] and ["), (F.col("turn") + 2).cast("string"), F.lit("] [1]"))
    cited = c.where("role = 'assistant'").select("conv_id", "turn", F.explode(T.citations(reply)).alias("cited"))
    order = Window.partitionBy("conv_id").orderBy("turn")
    sources = c.where("role = 'user'").select("conv_id", F.row_number().over(order).alias("cited"), F.lit(True).alias("bound"))
    return cited.join(sources, ["conv_id", "cited"], "left").select("conv_id", "turn", "cited", F.coalesce("bound", F.lit(False)).alias("bound"))


@query(
    """SELECT event_id, CAST(list_reduce(list_prepend(0::BIGINT, list_transform(string_split(event_type, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda h, c: (h * 31 + c) % 4294967296) AS BIGINT) AS stable_hash,
 sha256('{"event_type":"' || event_type || '","user_id":' || user_id || '}') AS fingerprint FROM events"""
)
def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stable 32-bit hashes and canonical fingerprints of events."""
    events = table(spark, sf_dir, "events")
    return events.select("event_id", T.stable_hash(F.col("event_type")).alias("stable_hash"), T.fingerprint("event_type", "user_id").alias("fingerprint"))


@query(
    """SELECT doc_id, CASE WHEN b <= 0 THEN '-' WHEN b < 1024 THEN b || ' B' ELSE printf('%.1f', floor(b * 10 / 1024.0 + 0.5) / 10) || ' KB' END AS size_text,
  CASE WHEN b < 1000 THEN b || ' ms' WHEN b < 60000 THEN printf('%.1f', floor(b / 100.0 + 0.5) / 10) || ' s' ELSE printf('%.1f', floor(b / 6000.0 + 0.5) / 10) || ' m' END AS duration_text,
  CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' ELSE lang END AS lang_label
FROM (SELECT doc_id, lang, CAST(n_chars AS BIGINT) AS b FROM documents)"""
)
def formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes, durations and labels as shown to people."""
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        T.file_size(F.col("n_chars")).alias("size_text"),
        T.duration(F.col("n_chars")).alias("duration_text"),
        T.label(F.col("lang"), {"en": "English", "fr": "French"}).alias("lang_label"),
    )


@query(
    """SELECT page_id, list_filter(string_split(url, '/'), lambda p: p <> '')[1] AS cluster_key, regexp_extract_all(url, '\\d+')[1] AS first_number FROM pages"""
)
def cluster_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leading section of each address."""
    none = F.expr("cast(array() as array<string>)")
    return table(spark, sf_dir, "pages").select(
        "page_id", T.cluster_key(F.col("url"), none).alias("cluster_key"), F.get(F.regexp_extract_all("url", F.lit(r"\d+"), F.lit(0)), F.lit(0)).alias("first_number")
    )
