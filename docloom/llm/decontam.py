"""Benchmark decontamination with DataFrame functions only.

The windows of every benchmark item are kept as anchors: the longest word of
each window with its neighbour (a set far smaller than all windows, yet every
window has one). Documents are scanned in blocks of words, their words probe the
broadcast hash table of anchors, and each hit is verified word by word to both
sides, which yields the union of all windows through that anchor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import lower_ascii, pick, with_keys, written

WINDOW = 13
#: ASCII that is neither letter nor digit ends a word; everything else is part of one.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BLOCK = 1024
#: Bytes of anchors, with the words around them, up to which these are broadcast; beyond it the probe becomes a shuffled join.
BROADCAST_BYTES = 128_000_000


def _split(text: Column) -> Column:
    return F.split(lower_ascii(text), GAP, -1)


def _bare(parts: Column) -> Column:
    """Split parts without the empty ones that a gap at either end leaves."""
    lead, tail = (F.get(parts, F.lit(0)) == "").cast("int"), ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("int")
    return F.slice(parts, lead + 1, F.size(parts) - lead - tail)


def _with_words(docs: DataFrame, *columns: str) -> DataFrame:
    """``columns`` and the lower-cased words of each text."""
    return docs.select(*columns, _split(F.col("text")).alias("parts")).select(*columns, _bare(F.col("parts")).alias("words"))


def anchors(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, key, next_key, left, right, need): anchors that together cover every window of every item."""
    reach = window - 1
    items = _with_words(pick(benchmark, "item_id", "text").distinct(), "item_id")
    items = items.where("size(words) > 0").withColumn("need", F.least(F.size("words"), F.lit(window)))
    starts = items.select("*", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("need"))).alias("s"))
    # the last word of a window is no anchor, so that an anchor's neighbour lies in the window too
    offsets = F.sequence(F.lit(0), F.greatest(F.col("need") - 2, F.lit(0)))
    best = F.array_max(F.transform(offsets, lambda o: F.struct(F.length(F.get("words", F.col("s") + o)).alias("n"), (-o).alias("o"))))
    places = starts.select("item_id", "words", "need", (F.col("s") - best["o"]).alias("q")).distinct()
    return places.select(
        "item_id",
        "need",
        F.get("words", F.col("q")).alias("key"),
        F.when(F.col("need") > 1, F.get("words", F.col("q") + 1)).alias("next_key"),
        F.reverse(F.expr(f"slice(words, greatest(q - {reach}, 0) + 1, least(q, {reach}))")).alias("left"),
        F.expr(f"slice(words, q + 2, {reach})").alias("right"),
    )


def _run(ours: Column, theirs: Column) -> Column:
    """How many leading words agree."""
    differs = F.array_position(F.zip_with(ours, theirs, lambda x, y: x.eqNullSafe(y)), F.lit(False))
    return F.when(differs > 0, differs - 1).otherwise(F.greatest(F.size(ours), F.size(theirs)))


def _bytes(probes: DataFrame) -> int:
    """About what the anchors take in memory: their characters, and a header for each word and row."""
    words = F.concat(F.array("key"), "left", "right")
    return probes.agg(F.sum(F.octet_length(F.array_join(words, "")) + 24 * F.size(words) + 100).alias("n")).first()["n"] or 0


def find_overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text_hash, spans, items) of the documents that hold a window of an item.

    spans are (first word, last word) of hit runs, sorted; items the ids of the
    items with occurring windows. Null texts have no words; rows with the same
    id and text are reported once; an empty benchmark hits nothing.
    """
    reach = window - 1
    probes = anchors(benchmark, window)
    texts = pick(docs, "doc_id", "text").where("text is not null").withColumn("text_hash", F.xxhash64("text"))
    blocks = (
        _with_words(texts, "doc_id", "text_hash")
        .select("doc_id", "text_hash", "words", F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.lit(BLOCK))).alias("at"))
        .select(
            "doc_id",
            "text_hash",
            "at",
            F.expr(f"slice(words, greatest(at - {reach}, 0) + 1, least(at, {reach}) + {BLOCK + reach})").alias("block"),
            (F.col("at") - F.least("at", F.lit(reach))).alias("base"),
        )
    )
    placed = blocks.select("doc_id", "text_hash", "block", "base", "at", F.posexplode("block").alias("i", "word")).where(
        f"base + i >= at and base + i < at + {BLOCK}"
    )
    ours_left = F.reverse(F.expr(f"slice(block, greatest(i - {reach}, 0) + 1, least(i, {reach}))"))
    ours_right = F.expr(f"slice(block, i + 2, {reach})")
    following = F.get("block", F.col("i") + 1)
    if _bytes(probes) <= BROADCAST_BYTES:
        probed = placed.join(F.broadcast(probes), (F.col("word") == F.col("key")) & (F.col("next_key").isNull() | (following == F.col("next_key"))))
        probed = probed.select("doc_id", "text_hash", "item_id", "need", "base", "i", ours_left.alias("own_left"), ours_right.alias("own_right"), "left", "right")
    else:
        probed = _shuffled(placed, blocks, written(probes, "anchors"), following, ours_left, ours_right)
    runs = probed.select(
        "doc_id",
        "text_hash",
        "item_id",
        "need",
        (F.col("base") + F.col("i")).alias("p"),
        _run(F.col("own_left"), F.col("left")).alias("before"),
        _run(F.col("own_right"), F.col("right")).alias("after"),
    )
    # Runs that are too short become null, which the collections leave out. As a filter this would move into the
    # join, whose probe of every word must stay plain compiled code.
    whole = F.col("before") + 1 + F.col("after") >= F.col("need")
    span = F.struct((F.col("p") - F.col("before")).cast("long").alias("first"), (F.col("p") + F.col("after")).cast("long").alias("last"))
    return (
        runs.groupBy("doc_id", "text_hash")
        .agg(F.sort_array(F.collect_set(F.when(whole, span))).alias("spans"), F.collect_set(F.when(whole, F.col("item_id"))).alias("items"))
        .where("size(spans) > 0")
    )


def _shuffled(placed: DataFrame, blocks: DataFrame, probes: DataFrame, following: Column, ours_left: Column, ours_right: Column) -> DataFrame:
    """The probe for anchors that are too many to broadcast.

    Only places and word pairs are shuffled to find hits; a hit then fetches its
    block, and goes on with the words around it alone.
    """
    slim = placed.select("doc_id", "text_hash", "at", "base", "i", "word", following.alias("following"))
    pairs = probes.where("next_key is not null").select("key", "next_key").distinct()
    alone = probes.where("next_key is null").select("key").distinct()
    hits = slim.join(pairs.hint("merge"), F.expr("word = key and following = next_key"), "left_semi")
    hits = hits.unionByName(slim.join(alone.hint("merge"), F.expr("word = key"), "left_semi")).distinct()
    own = blocks.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), F.col("at").alias("a"), "block")
    fetched = hits.join(own.hint("merge"), F.expr("doc_id <=> d and text_hash = h and at = a")).distinct()
    told = fetched.select("doc_id", "text_hash", "base", "i", "word", "following", ours_left.alias("own_left"), ours_right.alias("own_right"))
    told = written(told, "hits")
    two = told.join(probes.where("next_key is not null").hint("merge"), F.expr("word = key and following = next_key"))
    one = told.join(probes.where("next_key is null").hint("merge"), F.expr("word = key"))
    return two.unionByName(one).select("doc_id", "text_hash", "item_id", "need", "base", "i", "own_left", "own_right", "left", "right")


def n_covered(spans: Column) -> Column:
    """Positions covered by sorted (first, last) spans."""
    start = F.struct(F.lit(-1).cast("long").alias("upto"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, x: F.struct(
        F.greatest(acc["upto"], x["last"]).alias("upto"),
        (acc["n"] + F.greatest(F.lit(0).cast("long"), x["last"] - F.greatest(acc["upto"], x["first"] - 1))).alias("n"),
    )
    return F.aggregate(spans, start, step, lambda acc: acc["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row for each row of ``docs``: doc_id, text_hash, n_words, n_hit, spans, items, contaminated.

    A document is contaminated if at least one word in twenty lies in an
    occurring window. Null text: no words. Repeated rows get equal results. An
    empty benchmark hits nothing; an empty table gives an empty result.
    """
    found = find_overlaps(docs, benchmark, window).select(
        F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "spans", "items"
    )
    base = pick(docs, "doc_id", "text").withColumn("text_hash", F.xxhash64("text"))
    base = _with_words(base, "doc_id", "text_hash").select("doc_id", "text_hash", F.coalesce(F.size("words"), F.lit(0)).cast("long").alias("n_words"))
    out = base.join(found, (F.col("text_hash") == F.col("__hash")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    n_hit = F.coalesce(n_covered(F.col("spans")), F.lit(0).cast("long"))
    return out.select("doc_id", "text_hash", "n_words", n_hit.alias("n_hit"), "spans", F.coalesce("items", F.expr("array()")).alias("items")).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, action: str = "drop") -> DataFrame:
    """``docs`` without contaminated documents (``drop``), or with the hit words of every document cut out (``cut``).

    Rows go, or are cut, by id and text, repeated ones alike. Null texts stay; an
    empty benchmark changes nothing, an empty table gives an empty one; other
    columns, whatever their names, pass through.
    """
    if action not in ("drop", "cut"):
        raise ValueError(f"unknown action {action!r}")
    keyed, (own_id, own_hash) = with_keys(docs, F.col("doc_id"), F.xxhash64("text"))
    if action == "drop":
        found = contamination(docs, benchmark, window).where("contaminated")
        gone = found.select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct()
        return keyed.join(gone, (keyed[own_hash] == gone["gone_hash"]) & keyed[own_id].eqNullSafe(gone["gone_id"]), "left_anti").drop(own_id, own_hash)
    found = find_overlaps(docs, benchmark, window).select(F.col("doc_id").alias("cut_id"), F.col("text_hash").alias("cut_hash"), "spans")
    joined = keyed.join(found, (keyed[own_hash] == found["cut_hash"]) & keyed[own_id].eqNullSafe(found["cut_id"]), "left")
    text, spans = docs["text"], found["spans"]
    # words and what lies between them, by turns
    turns = F.regexp_extract_all(text, F.lit(rf"{WORD}|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    lead = F.when(F.get(turns, F.lit(0)).rlike(f"^{WORD}$"), 0).otherwise(1)
    kept = F.filter(
        turns,
        lambda x, i: ~((F.pmod(i - lead, F.lit(2)) == 0) & F.exists(spans, lambda s: ((i - lead) / 2 >= s["first"]) & ((i - lead) / 2 <= s["last"]))),
    )
    cut = F.when(spans.isNotNull(), F.array_join(kept, "")).otherwise(text)
    return joined.select(*[cut.alias(c) if c == "text" else keyed[f"`{c}`"] for c in docs.columns])
