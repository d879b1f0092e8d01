"""Numbers, vectors, boxes, dates, ids and JSON as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- vectors and scores -------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column) -> Column:
    """The unit vector; a zero vector stays as it is."""
    n = norm(v)
    return F.when(n == 0, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def normalize_score(score: Column) -> Column:
    """Identity on [0, 1], else a sigmoid clipped beyond 50; not monotonic where the two meet, which fixes rerank order."""
    return F.when(score.between(0.0, 1.0), score).when(score >= 50, 1.0).when(score <= -50, 0.0).otherwise(1.0 / (1.0 + F.exp(-score)))


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(part / whole, 4)).otherwise(0.0)


def cluster_target(n: Column, most: Column) -> Column:
    return F.ceil(n / most).cast("long")


def balance_score(singletons: Column, clusters: Column, average: Column, most: Column) -> Column:
    return F.when(clusters > 0, (1.0 - singletons / clusters) * F.least(F.lit(1.0), average / most)).otherwise(0.0)


def page_count(low: Column, high: Column, fallback: Column) -> Column:
    """Pages from the lowest and highest number seen; counting may start at 0."""
    return F.when(high.isNull(), F.coalesce(fallback, F.lit(0))).when(low == 0, high + 1).otherwise(high)


def delta_tone(delta: Column, higher_is_better: bool = True) -> Column:
    good = delta > 0 if higher_is_better else delta < 0
    return F.when(F.coalesce(delta, F.lit(0.0)) == 0, "neutral").when(good, "positive").otherwise("negative")


def confidence(value: Column) -> Column:
    """A finite number, else null."""
    number = value.try_cast("double")
    return F.when(F.isnan(number) | (F.abs(number) == float("inf")), None).otherwise(number)


def axis_max(values_max: Column, nominal: float) -> Column:
    return F.greatest(F.lit(nominal), F.coalesce(values_max, F.lit(nominal)))


# --- boxes --------------------------------------------------------------------


def box_of_json(text: Column) -> Column:
    """(x0, y0, x1, y1) of a box given by corners, sides, or origin and size; null if no form fits."""
    at = lambda *names: F.coalesce(*[F.get_json_object(text, f"$.{n}").try_cast("double") for n in names])
    x0, y0 = at("x0", "left", "x"), at("y0", "top", "y")
    x1 = F.coalesce(at("x1", "right"), at("x", "left") + at("w", "width"))
    y1 = F.coalesce(at("y1", "bottom"), at("y", "top") + at("h", "height"))
    listed = F.from_json(text, "array<double>")
    from_list = F.when(F.size(listed) >= 4, F.struct(*[F.get(listed, F.lit(k)).alias(n) for k, n in enumerate(("x0", "y0", "x1", "y1"))]))
    named = F.when(x0.isNotNull() & y0.isNotNull() & x1.isNotNull() & y1.isNotNull(), F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")))
    return F.coalesce(named, from_list)


def box_of_polygon(numbers: Column) -> Column:
    """Bounds of a flat list x, y, x, y, ... of two points or more."""
    xs, ys = F.filter(numbers, lambda _, i: i % 2 == 0), F.filter(numbers, lambda _, i: i % 2 == 1)
    box = F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))
    return F.when((F.size(numbers) >= 4) & (F.size(numbers) % 2 == 0), box)


def crop_box(box: Column, width: Column, height: Column) -> Column:
    """Whole pixels around a box, clamped to the page; coordinates of at most 1.5 are shares of the page."""
    share = F.greatest(box["x0"], box["y0"], box["x1"], box["y1"]) <= 1.5
    sx, sy = F.when(share, width).otherwise(1), F.when(share, height).otherwise(1)
    left = F.greatest(F.lit(0), F.floor(box["x0"] * sx)).cast("int")
    top = F.greatest(F.lit(0), F.floor(box["y0"] * sy)).cast("int")
    right, bottom = F.least(width, F.ceil(box["x1"] * sx)).cast("int"), F.least(height, F.ceil(box["y1"] * sy)).cast("int")
    found = F.struct(left.alias("left"), top.alias("top"), right.alias("right"), bottom.alias("bottom"))
    return F.when((right > left) & (bottom > top), found)


# --- dates --------------------------------------------------------------------

# Weekday names.
WEEKDAYS = ["星期一", "星期二", "星期三", "星期四", "星期五", "星期六", "星期日"]


def day_start(ts: Column) -> Column:
    return F.date_trunc("DAY", ts)


def day_end(ts: Column) -> Column:
    return F.date_trunc("DAY", ts) + F.expr("INTERVAL '0 23:59:59.999' DAY TO SECOND")


def number_key(ts: Column, pattern: str = "yyyyMMdd") -> Column:
    """The date as a number; 0 for null."""
    return F.coalesce(F.date_format(ts, pattern).cast("long"), F.lit(0))


def iso_weekday(ts: Column) -> Column:
    return F.weekday(ts) + 1


def weekday_name(ts: Column) -> Column:
    return F.get(F.array(*[F.lit(x) for x in WEEKDAYS]), F.weekday(ts))


def week_of_year(ts: Column) -> Column:
    """Sevenths of the year begun, one less unless the year began on a Monday; not the ISO week."""
    starts_monday = F.weekday(F.date_trunc("YEAR", ts)) == 0
    return (F.ceil(F.dayofyear(ts) / 7) - F.when(starts_monday, 0).otherwise(1)).cast("int")


def date_parts(ts: Column) -> Column:
    parts = {
        "year": F.year(ts), "month": F.month(ts), "day": F.dayofmonth(ts), "hour": F.hour(ts), "minute": F.minute(ts),
        "second": F.second(ts), "millis": (F.date_format(ts, "SSS")).cast("int"), "weekday": iso_weekday(ts), "weekday_name": weekday_name(ts),
        "day_of_year": F.dayofyear(ts), "week_of_year": week_of_year(ts), "quarter": F.quarter(ts), "days_in_month": F.dayofmonth(F.last_day(ts)),
        "date": F.date_format(ts, "yyyy-MM-dd"),
    }
    return F.struct(*[c.alias(n) for n, c in parts.items()])


def week_start(ts: Column) -> Column:
    return F.date_trunc("WEEK", ts)


def week_end(ts: Column) -> Column:
    """The last millisecond of Sunday."""
    return F.date_trunc("WEEK", ts) + F.expr("INTERVAL '6 23:59:59.999' DAY TO SECOND")


def month_dates(ts: Column) -> Column:
    first = F.trunc(ts, "MM")
    return F.sequence(first, F.last_day(ts), F.expr("INTERVAL 1 DAY"))


def seconds_between(a: Column, b: Column) -> Column:
    """Whole seconds apart; -1 if one is missing. Works for timestamps with and without a zone."""
    micros = lambda t: F.unix_micros(t.cast("timestamp"))
    return F.coalesce(F.floor(F.abs(micros(a) - micros(b)) / 1000000).cast("long"), F.lit(-1))


def between_dates(a: Column, b: Column, with_ends: bool) -> Column:
    """Days between two dates in either order; with equal ends the inclusive list names the day twice."""
    low, high = F.least(a, b), F.greatest(a, b)
    days = F.sequence(low, high, F.expr("INTERVAL 1 DAY"))
    inner = F.filter(days, lambda d: (d > low) & (d < high))
    return F.concat(F.array(low), inner, F.array(high)) if with_ends else inner


def parse_date(text: Column, pattern: str) -> Column:
    """Null where the text does not fit the pattern."""
    return F.try_to_timestamp(text, F.lit(pattern))


# The date patterns.
PATTERNS = (
    "yyyy-MM-dd", "yyyy-MM-dd HH", "yyyy-MM-dd HH:mm", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss:SSS", "yyyyMMdd", "yyyyMMddHH", "yyyyMMddHHmm", "yyyyMMddHHmmss", "yyyyMMddHHmmssSSS",
    "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'",
)
UNITS = ("YEAR", "MONTH", "WEEK", "DAY", "HOUR", "MINUTE", "SECOND", "MILLISECOND")


def format_date(ts: Column, pattern: str) -> Column:
    """The date as text; empty for null."""
    return F.coalesce(F.date_format(ts, pattern), F.lit(""))


def shifted(ts: Column, unit: str, n: Column) -> Column:
    """``n`` units later; a month's missing days become its last one."""
    if unit not in UNITS:
        raise ValueError(f"unknown unit {unit!r}")
    return F.timestamp_add(unit, n.cast("int"), ts)


def week_date(ts: Column, index: Column) -> Column:
    """The day of the same week by its number, 1 Monday to 7 Sunday, at the same time; null for other numbers."""
    return F.when(index.between(1, 7), F.timestamp_add("DAY", (index - iso_weekday(ts)).cast("int"), ts))


def offset_hours(hours: Column) -> Column:
    return F.when((hours > 13) | (hours < -12), 0).otherwise(hours)


# --- ids ----------------------------------------------------------------------

# The epochs of both id layouts, in milliseconds and in seconds.
SNOWFLAKE_EPOCH = 1288834974657
UID_EPOCH_SECONDS = 1716134400


def snowflake(millis: Column, datacenter: Column, worker: Column, sequence: Column) -> Column:
    """41 bits of time, 5 of datacenter, 5 of worker, 12 of sequence."""
    ticks = F.shiftleft((millis - SNOWFLAKE_EPOCH).cast("long"), 22)
    return ticks.bitwiseOR(F.shiftleft(datacenter.cast("long"), 17)).bitwiseOR(F.shiftleft(worker.cast("long"), 12)).bitwiseOR(sequence.cast("long"))


def snowflake_millis(id_: Column) -> Column:
    return F.shiftright(id_, 22) + SNOWFLAKE_EPOCH


def snowflake_parts(id_: Column) -> Column:
    bits = lambda shift, mask: F.shiftright(id_, shift).bitwiseAND(F.lit(mask).cast("long"))
    return F.struct(snowflake_millis(id_).alias("millis"), bits(17, 31).alias("datacenter"), bits(12, 31).alias("worker"), bits(0, 4095).alias("sequence"))


def gene_id(id_: Column, sequence: Column, gene: Column) -> Column:
    """Time and machine bits of an id with its sequence moved up by six and the gene in the lowest six; overlaps are kept as they are."""
    high = F.shiftleft(F.shiftright(id_, 12), 12)
    return high.bitwiseOR(F.shiftleft(sequence.cast("long"), 6)).bitwiseOR(gene.cast("long").bitwiseAND(F.lit(63).cast("long")))


def uid(seconds: Column, worker: Column, sequence: Column) -> Column:
    """28 bits of seconds, 22 of worker, 13 of sequence."""
    return F.shiftleft((seconds - UID_EPOCH_SECONDS).cast("long"), 35).bitwiseOR(F.shiftleft(worker.cast("long"), 13)).bitwiseOR(sequence.cast("long"))


def uid_parts(id_: Column) -> Column:
    bits = lambda shift, mask: F.shiftright(id_, shift).bitwiseAND(F.lit(mask).cast("long"))
    return F.struct((F.shiftrightunsigned(id_, 35) + UID_EPOCH_SECONDS).alias("seconds"), bits(13, (1 << 22) - 1).alias("worker"), bits(0, 8191).alias("sequence"))


# --- JSON ---------------------------------------------------------------------


def json_map(text: Column) -> Column:
    """Keys and values of a JSON object as text; an empty map for what is none."""
    return F.coalesce(F.from_json(text, "map<string,string>"), F.expr("cast(map() as map<string,string>)"))


def merge_maps(base: Column, extra: Column) -> Column:
    """The second map's entries win."""
    kept = F.map_filter(base, lambda k, _: ~F.map_contains_key(extra, k))
    return F.map_concat(kept, extra)


def without_empty(entries: Column) -> Column:
    return F.map_filter(entries, lambda _, v: v.isNotNull() & ~v.isin("", "0", "[]", "{}"))


def candidate_list(text: Column, schema: str) -> Column:
    """A JSON list as an array of structs; empty for what is none."""
    return F.coalesce(F.from_json(text, f"array<struct<{schema}>>"), F.from_json(F.lit("[]"), f"array<struct<{schema}>>"))


def first_present(text: Column, *names: str) -> Column:
    """The first of some keys of a JSON object that is there and not null, as text."""
    return F.coalesce(*[F.get_json_object(text, f"$.{n}") for n in names])


def metadata_json(entries: Column, known: list[str]) -> Column:
    """(json, error) of a list of (field, value): a JSON object, or the first entry that has no field, an unknown or a repeated one."""
    field = lambda e: F.trim(F.coalesce(e["field"], F.lit("")))
    fields = F.transform(entries, field)
    faults = F.transform(
        fields,
        lambda f, i: F.when(f == "", F.concat(F.lit("EMPTY_FIELD:"), (i + 1).cast("string")))
        .when(~f.isin(known), F.concat(F.lit("UNKNOWN_FIELD:"), f))
        .when(F.array_position(fields, f) <= i, F.concat(F.lit("REPEATED_FIELD:"), f)),
    )
    error = F.get(F.filter(faults, lambda x: x.isNotNull()), F.lit(0))
    pairs = F.transform(entries, lambda e: F.struct(field(e).alias("key"), e["value"].alias("value")))
    return F.struct(F.when(error.isNull(), F.to_json(F.map_from_entries(F.when(error.isNull(), pairs)))).alias("json"), error.alias("error"))


def in_ranges(options: dict[str, object], limits: dict[str, tuple[int, int]]) -> list[str]:
    """Names of the options that are missing, no whole number (true and false are none) or outside their limits."""
    return [n for n, (low, high) in limits.items() if type(options.get(n)) is not int or not low <= options[n] <= high]


# Limits of the extraction options.
EXTRACTION_LIMITS = {
    "batchChunkLimit": (1, 20), "inputTokenBudget": (256, 32000), "maxQuoteChars": (20, 2000), "maxReasonChars": (20, 2000), "maxUnitTextChars": (50, 8000), "modelContextTokens": (1024, 200000),
    "outputReserve": (1, 100000), "promptReserve": (1, 100000), "modelResponseMaxBytes": (1, 67108864), "maxEntityNameChars": (1, 10000), "maxDocumentBytes": (1, 64000000),
}


def fits_budget(cost: Column, budget: int, context: int, schema: int, output: int, prompt: int) -> Column:
    """Whether a request's cost keeps its own budget, and with the schema and both reserves the model's context."""
    return (cost <= budget) & (cost + schema + output + prompt <= context)
