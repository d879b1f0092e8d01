"""Format-preserving pseudonyms with DataFrame functions only.

Personal numbers and dates are found by pattern, validated, and permuted by a
keyed Feistel network over the valid values of their own format: card numbers
stay valid cards, dates dates, addresses addresses. The permutation depends on
the key and the kind alone, so equal values stay linked across documents and no
table of pseudonyms is kept. Formats whose valid values are no full range are
numbered without gaps, or walked along the permutation's cycle until a valid
value comes. All of it is column expressions.

Of e-mail addresses the last part of the domain stays, of account numbers the
country, of telephone numbers a country code that stands apart. A date with
slashes is a day and a month where that is possible, else a month and a day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import pick, running

KINDS = ("email", "iban", "date", "ip", "ssn", "phone", "card")
_EDGE, _END = r"(?<![0-9A-Za-z.+@_-])", r"(?![0-9A-Za-z])"
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}"
IBAN = r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![0-9A-Za-z])"
DATE = r"(?<![0-9A-Za-z./-])(?:\d{4}-\d\d-\d\d|\d\d[./]\d\d[./]\d{4})(?![0-9A-Za-z])"
IP = r"(?<![0-9A-Za-z.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?[0-9A-Za-z])"
SSN = r"(?<![0-9A-Za-z-])\d{3}-\d{2}-\d{4}(?![0-9A-Za-z-])"
PHONE = (
    r"(?<![0-9A-Za-z])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d(?:[ .-]?\d){5,11}|\(\d{3}\) ?\d{3}-\d{4}|(?<![.-])\d{3}[.-]\d{3}[.-]\d{4}(?![.-]\d)|0\d{2,4}[/-]\d{5,8})(?![0-9A-Za-z])"
)
CARD = r"(?<![0-9A-Za-z])\d(?:[ -]?\d){12,18}(?![0-9A-Za-z])"
PATTERN = "|".join((EMAIL, IBAN, DATE, IP, SSN, PHONE, CARD))
ROUNDS = 8
#: Dates are permuted among these days from the epoch of the range: 340 x 215 of them, 1900-01-01 to 2100-02-19.
FIRST_DAY, DAYS = "1900-01-01", (340, 215)
#: Steps along a cycle at most; each meets a valid date with a chance of 3 in 5.
WALK = 100


def kind_of(value: Column) -> Column:
    """Index into KINDS of a match of PATTERN."""
    whole = lambda p: value.rlike(f"^(?:{p})$")
    return (
        F.when(value.contains("@"), 0).when(whole(IBAN), 1).when(whole(DATE), 2).when(whole(IP), 3).when(whole(SSN), 4).when(whole(PHONE), 5).otherwise(6)
    )


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"[^0-9]", "")


def _chars(value: Column) -> Column:
    return F.filter(F.split(value, ""), lambda c: c != "")


def luhn_sum(digits: Column) -> Column:
    """Sum of the digits where every second one, from the last but one, is doubled and cast out."""
    n = F.length(digits)

    def add(acc, pair):
        d = F.when((n - 1 - pair["i"]) % 2 == 1, F.when(pair["d"] > 4, pair["d"] * 2 - 9).otherwise(pair["d"] * 2)).otherwise(pair["d"])
        return acc + d

    pairs = F.transform(_chars(digits), lambda c, i: F.struct(c.cast("int").alias("d"), i.alias("i")))
    return F.aggregate(pairs, F.lit(0), add)


def _mod97(alphanumeric: Column) -> Column:
    """The number that the text makes, letters being 10 to 35, modulo 97."""
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(_chars(alphanumeric), F.lit(0), lambda acc, c: (F.when(c.rlike("[0-9]"), acc * 10).otherwise(acc * 100) + value(c)) % 97)


def _date(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_timestamp(F.concat_ws("-", year, month, day), F.lit("yyyy-MM-dd")).cast("date")


def _day(value: Column) -> Column:
    """The date that a text of any of the date formats names, null if there is none."""
    first, second, year = F.substring(value, 1, 2), F.substring(value, 4, 2), F.substring(value, 7, 4)
    iso = F.try_to_timestamp(F.when(value.contains("-"), value), F.lit("yyyy-MM-dd")).cast("date")
    return F.coalesce(iso, F.when(~value.contains("-"), _date(year, second, first)), F.when(_american(value), _date(year, first, second)))


def _american(value: Column) -> Column:
    """Whether a date can only be a month and a day: one with slashes whose second number is no month."""
    return F.substring(value, 3, 1).eqNullSafe("/") & (F.substring(value, 4, 2) > "12")


def _offset(day: Column) -> Column:
    return F.datediff(day, F.lit(FIRST_DAY).cast("date"))


def valid(value: Column, kind: Column) -> Column:
    """Whether a match is a real value of its kind."""
    digits, plain = _digits(value), F.replace(value, F.lit(" "), F.lit(""))
    offset = _offset(_day(value))
    return (
        F.when(kind == 1, F.length(plain).between(15, 34) & F.substring(plain, 3, 2).between("02", "98") & (_mod97(F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))) == 1))
        .when(kind == 2, (offset >= 0) & (offset < DAYS[0] * DAYS[1]))
        .when(kind == 3, F.forall(F.split(value, r"\."), lambda o: (o.cast("int") <= 255) & ~o.rlike("^0[0-9]")))
        .when(kind == 4, ~value.rlike(r"^(000|666|9)|-00-|-0000$"))
        .when(kind == 5, F.length(digits).between(7, 15))
        .when(kind == 6, (luhn_sum(digits) % 10 == 0) & ~digits.rlike(r"^0+$"))
        .otherwise(F.lit(True))
    )


def feistel(left: Column, right: Column, n_left: Column, n_right: Column, key: str, tweak: Column) -> Column:
    """(left, right) permuted over n_left x n_right values; a struct of two longs."""

    def step(acc, i):
        seen = F.when(i % 2 == 0, acc["right"]).otherwise(acc["left"])
        told = F.sha2(F.concat_ws("|", F.lit(key), tweak, i, seen), 256)
        drawn = F.conv(F.substring(told, 1, 15), 16, 10).cast("long")
        return F.struct(
            F.when(i % 2 == 0, (acc["left"] + drawn % n_left) % n_left).otherwise(acc["left"]).alias("left"),
            F.when(i % 2 == 1, (acc["right"] + drawn % n_right) % n_right).otherwise(acc["right"]).alias("right"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(left.cast("long").alias("left"), right.cast("long").alias("right")), step)


def _permuted_number(text: Column, radix: int, key: str, tweak: Column) -> Column:
    """A text of 2 to 24 symbols of the radix (digits, or letters as base 26 digits already split), permuted as two halves."""
    half = F.floor(F.length(text) / 2).cast("int")
    power = lambda n: F.pow(F.lit(float(radix)), n).cast("long")
    n_left, n_right = power(half), power(F.length(text) - half)
    left = F.coalesce(F.substring(text, F.lit(1), half).try_cast("long"), F.lit(0).cast("long"))
    right = F.coalesce(F.substring(text, half + 1, F.length(text)).try_cast("long"), F.lit(0).cast("long"))
    out = feistel(left, right, n_left, n_right, key, F.concat_ws(":", tweak, F.length(text)))
    pad = lambda v, n: F.when(n > 0, F.lpad(v.cast("string"), n, "0")).otherwise("")
    return F.transform(F.array(out), lambda o: F.concat(pad(o["left"], half), pad(o["right"], F.length(text) - half)))[0]


def _refill(template: Column, symbols: Column, which: str) -> Column:
    """``template`` with its characters of class ``which`` replaced in turn by those of ``symbols``."""

    def step(acc, c):
        own = c.rlike(which)
        return F.struct(
            F.concat(acc["out"], F.when(own, F.substring(symbols, acc["k"], F.lit(1))).otherwise(c)).alias("out"),
            (acc["k"] + own.cast("int")).alias("k"),
        )

    return F.aggregate(_chars(template), F.struct(F.lit("").alias("out"), F.lit(1).alias("k")), step, lambda acc: acc["out"])


def _shifted(text: Column, by: Column) -> Column:
    """Every letter and digit of ``text`` moved within its class by what ``by``, 128 hexadecimal digits, has at its place; the rest stays."""

    def move(c: Column, j: Column) -> Column:
        base = F.when(c.rlike("^[a-z]$"), 97).when(c.rlike("^[A-Z]$"), 65).when(c.rlike("^[0-9]$"), 48)
        size = F.when(c.rlike("^[0-9]$"), 10).otherwise(26)
        drawn = F.conv(F.substring(by, (j % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int")
        return F.when(base.isNull(), c).otherwise(F.char(base + (F.ascii(c) - base + drawn) % size))

    return F.array_join(F.transform(_chars(text), move), "")


def _permuted_text(text: Column, key: str, tweak: Column) -> Column:
    """A text permuted among those with the same classes of characters, as two halves of a Feistel network."""
    half = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substring(text, F.lit(1), half).alias("left"), F.substring(text, half + 1, F.length(text)).alias("right"))

    def step(acc: Column, i: Column) -> Column:
        even = i % 2 == 0
        by = F.sha2(F.concat_ws("|", F.lit(key), tweak, i, F.when(even, acc["right"]).otherwise(acc["left"])), 512)
        return F.struct(F.when(even, _shifted(acc["left"], by)).otherwise(acc["left"]).alias("left"), F.when(~even, _shifted(acc["right"], by)).otherwise(acc["right"]).alias("right"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda acc: F.concat(acc["left"], acc["right"]))


def _permuted_day(offset: Column, key: str, tweak: Column) -> Column:
    return F.transform(
        F.array(feistel(F.floor(offset / DAYS[1]), offset % DAYS[1], F.lit(DAYS[0]).cast("long"), F.lit(DAYS[1]).cast("long"), key, tweak)),
        lambda d: (d["left"] * DAYS[1] + d["right"]).cast("int"),
    )[0]


def _once(value: Column, f) -> Column:
    """f(value) with value computed once."""
    return F.transform(F.array(value), f)[0]


def pseudonym(value: Column, kind: Column, key: str) -> Column:
    """The value's stand-in of the same kind and format."""
    digits, name = _digits(value), F.get(F.array(*[F.lit(k) for k in KINDS]), kind)
    tenfold = lambda text: _permuted_number(text, 10, key, name)

    at, last = F.instr(value, "@"), F.length(F.substring_index(value, ".", -1)) + 1
    domain = F.substring(value, at + 1, F.length(value) - at - last)
    email = F.concat(
        _permuted_text(F.substring(value, F.lit(1), at - 1), key, F.lit("email:local")),
        F.lit("@"), _permuted_text(domain, key, F.lit("email:domain")), F.substring(value, F.length(value) - last + 1, last),
    )

    plain = F.replace(value, F.lit(" "), F.lit(""))
    country = F.substring(plain, 1, 2)
    inner = _permuted_text(F.substring(plain, 5, 64), key, F.concat_ws(":", name, country))
    iban = _once(inner, lambda m: F.concat(country, F.lpad((98 - _mod97(F.concat(m, country, F.lit("00")))).cast("string"), 2, "0"), m))

    first = F.lit(FIRST_DAY).cast("date")
    tweak = F.when(_american(value), F.lit("date:american")).otherwise(name)
    moved = lambda offset: _permuted_day(offset, key, tweak)
    # of the dates that can only be a month and a day, the cycle is walked to the next such one
    fits = lambda offset: ~_american(value) | (F.dayofmonth(F.date_add(first, offset)) > 12)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), moved(_offset(_day(value))), lambda acc, i: F.when(fits(acc), acc).otherwise(moved(acc)))
    mark = F.substring(value, 3, 1)
    date = _once(
        F.date_add(first, walked),
        lambda day: F.when(value.contains("-"), F.date_format(day, "yyyy-MM-dd"))
        .when(_american(value), F.date_format(day, "MM/dd/yyyy"))
        .otherwise(F.concat_ws("", F.date_format(day, "dd"), mark, F.date_format(day, "MM"), mark, F.date_format(day, "yyyy"))),
    )

    octets = F.transform(F.split(value, r"\."), lambda o: o.cast("long"))
    address = feistel(octets[0] * 256 + octets[1], octets[2] * 256 + octets[3], F.lit(65536).cast("long"), F.lit(65536).cast("long"), key, name)
    ip = F.transform(
        F.array(address),
        lambda a: F.concat_ws(".", *[x.cast("long").cast("string") for x in (F.floor(a["left"] / 256), a["left"] % 256, F.floor(a["right"] / 256), a["right"] % 256)]),
    )[0]

    # areas 001-899 without 666, groups 01-99 and serials 0001-9999 are numbered without gaps
    area, group, serial = (F.substring(digits, *x).cast("long") for x in ((1, 3), (4, 2), (6, 4)))
    number = feistel(area - F.when(area > 666, 2).otherwise(1), (group - 1) * 9999 + serial - 1, F.lit(898).cast("long"), F.lit(99 * 9999).cast("long"), key, name)
    pad = lambda v, n: F.lpad(v.cast("string"), n, "0")
    ssn = _once(
        number,
        lambda x: F.concat_ws("-", pad(x["left"] + F.when(x["left"] > 664, 2).otherwise(1), 3), pad(F.floor(x["right"] / 9999) + 1, 2), pad(x["right"] % 9999 + 1, 4)),
    )

    code = F.length(F.regexp_replace(F.regexp_extract(value, r"^\+\d{1,3}(?=[ .(-])|^0", 0), r"\D", ""))
    phone = _refill(value, F.concat(F.substring(digits, F.lit(1), code), tenfold(F.substring(digits, code + 1, F.length(digits)))), "[0-9]")

    body = tenfold(F.substring(digits, F.lit(1), F.length(digits) - 1))
    card = F.transform(F.array(body), lambda b: F.concat(b, ((10 - luhn_sum(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))[0]
    return (
        F.when(kind == 0, email)
        .when(kind == 1, _refill(value, iban, "[0-9A-Z]"))
        .when(kind == 2, date)
        .when(kind == 3, ip)
        .when(kind == 4, ssn)
        .when(kind == 5, phone)
        .otherwise(_refill(value, card, "[0-9]"))
    )


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """(doc_id, n_found, found, text), one row for each row of ``docs``.

    found lists kind:start:end of every replaced value (code points of the
    original text, end exclusive); text has the pseudonyms in their place, null
    for null. Values that fail validation stay. Rows without a digit or an at
    sign are passed through without a search.
    """
    text = F.col("text")
    none = F.expr("cast(array() as array<string>)")
    hits = F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(none)
    found = pick(docs, "doc_id", "text").select("doc_id", "text", hits.alias("hits"))
    pairs = F.zip_with(F.split(text, PATTERN, -1), F.col("hits"), lambda gap, hit: F.struct(gap.alias("gap"), hit.alias("hit")))
    typed = F.transform(pairs, lambda p: F.struct(p["gap"].alias("gap"), p["hit"].alias("hit"), kind_of(p["hit"]).alias("kind")))
    some = F.size("hits") > 0
    found = found.select("doc_id", "text", F.when(some, typed).alias("typed"))
    real = lambda p: p["hit"].isNotNull() & valid(p["hit"], p["kind"])
    parts = F.transform(
        "typed", lambda p: F.struct(p["gap"].alias("gap"), p["hit"].alias("hit"), p["kind"].alias("kind"), F.coalesce(real(p), F.lit(False)).alias("real"))
    )
    found = found.select("doc_id", "text", parts.alias("parts"))
    renewed = F.transform(
        "parts",
        lambda p: F.concat(p["gap"], F.when(p["real"], pseudonym(p["hit"], p["kind"], key)).otherwise(F.coalesce(p["hit"], F.lit("")))),
    )
    names = F.array(*[F.lit(k) for k in KINDS])

    width = lambda p: F.coalesce(F.length(p["hit"]), F.lit(0))
    placed = running(
        F.col("parts"),
        lambda at, p: F.struct(p["real"].alias("real"), F.concat_ws(":", F.get(names, p["kind"]), at + F.length(p["gap"]), at + F.length(p["gap"]) + width(p)).alias("said")),
        lambda at, p: at + F.length(p["gap"]) + width(p),
        "struct<real:boolean,said:string>",
    )
    places = F.transform(F.filter(placed, lambda x: x["real"]), lambda x: x["said"])
    out = found.select("doc_id", F.coalesce(places, none).alias("places"), F.when(F.col("parts").isNull(), text).otherwise(F.array_join(renewed, "")).alias("text"))
    return out.select("doc_id", F.size("places").cast("long").alias("n_found"), F.array_join("places", ",").alias("found"), "text")
