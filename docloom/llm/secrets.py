"""Secret scans with DataFrame functions only.

Candidates are found by pattern in every whole text. Their hashes are then
counted over the corpus by distinct documents (repositories) and distinct
sources (owners): a value that many owners or many repositories carry is a
copied example, one that stays with few of them and looks random is a live
credential.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import pick, running, with_keys, written

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Kinds in their order; a failing shorter run of the second and third kind holds no longer one, so the length is part of the pattern.
KINDS = ("assign", "access", "hex", "key", "jwt", "service", "owned", "bearer", "url", "account")
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: A private key from its first line to its last one, which may have a few header lines; a first line alone holds no secret.
MORE = (
    r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:[\x09-\x0D\x20]*[A-Za-z-]{2,20}: [^\n]{0,80}\n){0,3}[A-Za-z0-9+/=\x09-\x0D\x20]*-----END [A-Z ]{0,40}PRIVATE KEY-----"
    r"|-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
    r"|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"
    r"|(?i:bearer)\x20[A-Za-z0-9._~+/-]{16,}=*"
    r"|://[^\x09-\x0D\x20/@:]{1,64}:[^\x09-\x0D\x20/@:]{6,64}@"
    r"|(?:AccountKey|SharedAccessKey)=[A-Za-z0-9+/]{24,}=*"
    r"|[A-Za-z0-9+/_-]{24,}"
)
_KEY_FRAME = r"-----(?:BEGIN|END) [A-Z ]{0,40}PRIVATE KEY-----|[\x09-\x0D\x20]"
#: A value with this many owners, or in this many repositories, or more is a copied example.
COPIED_OWNERS, COPIED_REPOSITORIES = 3, 10
#: Distinct characters that a live-looking value has at least.
DISTINCT_CHARS = 8


def _spans(text: Column, pattern: str, found: Column, kind: Column | int) -> Column:
    """(start, kind, end, value) of the matches ``found`` of ``pattern`` in code points, from the pieces between them."""
    pieces = F.split(text, pattern, -1)
    pairs = F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda a, b: F.struct(F.length(a).alias("gap"), b.alias("value")))
    kind_of = kind if callable(kind) else lambda value: F.lit(kind)
    of_type = "struct<start:int,kind:int,end:int,value:string>"

    def span(at: Column, x: Column) -> Column:
        start = at + x["gap"]
        return F.struct(start.alias("start"), kind_of(x["value"]).cast("int").alias("kind"), (start + F.length(x["value"])).alias("end"), x["value"].alias("value"))

    spans = running(pairs, span, lambda at, x: at + x["gap"] + F.length(x["value"]), of_type)
    return F.when(F.size(found) > 0, spans).otherwise(F.expr(f"cast(array() as array<{of_type}>)"))


def _more_kind(value: Column) -> Column:
    return (
        F.when(value.startswith("-----BEGIN"), 3)
        .when(value.rlike(r"^(?i:bearer)\x20"), 7)
        .when(value.startswith("://"), 8)
        .when(value.rlike("^(AccountKey|SharedAccessKey)="), 9)
        .when(value.contains("."), 4)
        .when(value.rlike(r"^(gh[pousr]_|glpat-|xox[abprs]-|sk_live_|sk-|AIza)"), 5)
        .otherwise(6)
    )


def _plausible(value: Column) -> Column:
    """Whether a match of MORE can be a secret: a key or an address, else letters and digits."""
    return value.startswith("-----") | value.startswith("://") | (value.rlike("[0-9]") & value.rlike("[A-Za-z]"))


def _secret_of(kind: Column, value: Column) -> Column:
    """The part of a match whose owners count: what is assigned, a key's body, a token, an address's password."""
    return (
        F.when(kind == 0, F.regexp_extract(value, ASSIGN, 2))
        .when(kind == 3, F.regexp_replace(value, _KEY_FRAME, ""))
        .when(kind == 7, F.substring_index(value, " ", -1))
        .when(kind == 8, F.regexp_extract(value, "^://[^:]*:(.*)@$", 1))
        .when(kind == 9, F.regexp_extract(value, "^[A-Za-z]*=(.*)$", 1))
        .otherwise(value)
    )


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, owner, start, kind, end, value) for every candidate; kind is an index into KINDS."""
    text = F.col("text")
    low = F.lower(text)
    hinted = low.contains("password") | low.contains("passwd") | low.contains("secret") | low.contains("token") | low.contains("api_key") | low.contains("apikey")
    none = F.expr("cast(array() as array<string>)")
    every = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    more = F.filter(every(MORE), _plausible)
    matched = pick(docs, "doc_id", "text", "source").where("text is not null").select(
        "doc_id",
        "text",
        F.col("source").cast("string").alias("owner"),
        F.when(hinted, every(ASSIGN)).otherwise(none).alias("m_assign"),
        F.when(text.contains("AKIA"), every(ACCESS)).otherwise(none).alias("m_access"),
        every(HEX).alias("m_hex"),
        F.size(more).alias("n_more"),
    ).where("size(m_assign) + size(m_access) + size(m_hex) + n_more > 0")
    strong = F.filter(_spans(text, ASSIGN, F.col("m_assign"), 0), lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= 8)
    spans = F.concat(
        strong,
        _spans(text, ACCESS, F.col("m_access"), 1),
        _spans(text, HEX, F.col("m_hex"), 2),
        F.filter(
            F.when(F.col("n_more") > 0, _spans(text, MORE, every(MORE), _more_kind)).otherwise(F.expr("cast(array() as array<struct<start:int,kind:int,end:int,value:string>>)")),
            lambda s: _plausible(s["value"]),
        ),
    )
    out = matched.select("doc_id", F.xxhash64("text").alias("text_hash"), "owner", F.explode(spans).alias("s")).select("doc_id", "text_hash", "owner", "s.*")
    out = _apart(out)
    return out.withColumn("value", _secret_of(F.col("kind"), F.col("value")))


def _apart(spans: DataFrame) -> DataFrame:
    """Without the spans of added kinds that overlap one of a base kind in the same text.

    A base span overlaps another one if it starts no later and ends after that
    one's start, or starts later but before its end.
    """
    own = Window.partitionBy("doc_id", "text_hash").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    back = Window.partitionBy("doc_id", "text_hash").orderBy(F.desc("start"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    base = lambda name: F.when(F.col("kind") < 3, F.col(name))
    upto = F.max(base("end")).over(own)
    after = F.min(base("start")).over(back)
    marked = spans.withColumns({"upto": upto, "after": after})
    touched = (F.coalesce(F.col("upto"), F.lit(-1)) > F.col("start")) | (F.coalesce(F.col("after"), F.col("end")) < F.col("end"))
    return marked.where((F.col("kind") < 3) | ~touched).drop("upto", "after")


def ownership(found: DataFrame) -> DataFrame:
    """(value_hash, n_owners, n_repositories) over the whole corpus; counts are made distinct by grouping, never by collecting."""
    per = found.select("value_hash", "owner", "doc_id").distinct().groupBy("value_hash", "owner").agg(F.count("*").alias("n"))
    return per.groupBy("value_hash").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repositories"))


def scan(docs: DataFrame) -> DataFrame:
    """One row per candidate: doc_id, text_hash, kind, start, end (code points, end exclusive), value_hash, n_owners, n_repositories, verdict.

    verdict is ``copied`` where COPIED_OWNERS or more owners, or
    COPIED_REPOSITORIES or more repositories, carry the value, else ``live``
    where it looks random, else ``weak``. Null texts have no
    candidates; a null source counts as one owner; repeated rows give repeated
    candidates; empty tables give empty results.
    """
    found = candidates(docs).withColumn("value_hash", F.sha2("value", 256))
    found = found.withColumn("looks_random", F.size(F.array_distinct(F.split("value", ""))) >= DISTINCT_CHARS)
    found = written(found.drop("value"), "candidates")
    counts = ownership(found)
    verdict = F.when((F.col("n_owners") >= COPIED_OWNERS) | (F.col("n_repositories") >= COPIED_REPOSITORIES), "copied").when(F.col("looks_random"), "live").otherwise("weak")
    names = F.array(*[F.lit(k) for k in KINDS])
    return found.join(counts, "value_hash").select(
        "doc_id", "text_hash", F.get(names, F.col("kind")).alias("kind"), F.col("kind").alias("kind_no"), "start", "end", "value_hash", "n_owners", "n_repositories", verdict.alias("verdict")
    )


def _per_document(found: DataFrame) -> DataFrame:
    """(span_id, span_hash, spans): the sorted spans of each id and text."""
    spans = F.sort_array(F.collect_set(F.struct("start", "kind_no", "end", "kind", "verdict", "n_owners", "n_repositories")))
    return found.groupBy(F.col("doc_id").alias("span_id"), F.col("text_hash").alias("span_hash")).agg(spans.alias("spans"))


def digest(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, counts and hash of the base spans, all spans (base ones and added live ones), and verdicts, as text.

    verdicts has every candidate, also those that the ownership of their value
    keeps out of spans, each with its verdict, owners and repositories. A null text
    has no spans; repeated rows fare alike; an empty table gives an empty result.
    """
    # the hash stands in for the text, which no shuffle has to carry
    rows, own = pick(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("text_hash")), _per_document(scan(docs))
    slim = rows.join(own, (rows["text_hash"] == own["span_hash"]) & rows["doc_id"].eqNullSafe(own["span_id"]), "left")
    slim = slim.select("doc_id", F.coalesce("spans", F.expr("array()")).alias("all"))
    told = lambda spans, *names: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", *[s[n] for n in names])), ",")
    place = ("kind", "start", "end")
    base = F.filter("all", lambda s: s["kind_no"] < 3)
    count = lambda k: F.size(F.filter("all", lambda s: s["kind_no"] == k)).cast("long")
    return slim.select(
        "doc_id",
        *[count(k).alias(f"n_{KINDS[k]}") for k in range(3)],
        F.sha2(told(base, *place), 256).alias("base_sha256"),
        told(F.filter("all", lambda s: (s["kind_no"] < 3) | (s["verdict"] == "live")), *place).alias("spans"),
        told(F.col("all"), *place, "verdict", "n_owners", "n_repositories").alias("verdicts"),
    )


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every live credential replaced by ``mark``; copied examples and weak values stay.

    Overlapping spans are blanked as one. Null and empty texts stay as they are,
    repeated rows are redacted alike, an empty table gives an empty one; other
    columns, whatever their names, pass through.
    """
    live = _per_document(scan(docs).where("verdict = 'live'"))
    keyed, (own_id, own_hash) = with_keys(docs, F.col("doc_id"), F.xxhash64("text"))
    joined = keyed.join(live, (keyed[own_hash] == live["span_hash"]) & keyed[own_id].eqNullSafe(live["span_id"]), "left")
    text, spans = docs["text"], live["spans"]
    # the text before each span that does not start under an earlier one, then the mark
    pieces = running(
        spans,
        lambda upto, s: F.when(s["start"] < upto, F.lit("")).otherwise(F.concat(F.substring(text, upto + 1, s["start"] - upto), F.lit(mark))),
        lambda upto, s: F.greatest(upto, s["end"]),
        "string",
    )
    rest = F.substring(text, F.array_max(F.transform(spans, lambda t: t["end"])) + 1, F.length(text))
    cut = F.when(spans.isNotNull(), F.concat(F.array_join(pieces, ""), rest)).otherwise(text)
    return joined.select(*[cut.alias(c) if c == "text" else keyed[f"`{c}`"] for c in docs.columns])
