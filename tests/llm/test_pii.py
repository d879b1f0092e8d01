import datetime
import hashlib
import random
import re
import string

from docloom.llm import pii

from .helpers import frame, odd_texts, prose


def luhn(digits):
    return sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(map(int, digits[::-1]))) % 10 == 0


def mod97(iban):
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


CARDS = [str(4000000000000000 + 9973 * k) for k in range(400)]
CARDS = [c for c in CARDS if luhn(c)]


def renewed(spark, texts):
    return {r.doc_id: r for r in pii.pseudonymise(frame(spark, texts), "k").collect()}


def test_formats_and_links_are_kept(spark):
    values = [
        ("card", "4539 1488 0343 6467", r"\d{4} \d{4} \d{4} \d{4}"), ("date", "1987-03-29", r"\d{4}-\d\d-\d\d"), ("date", "29.03.1987", r"\d\d\.\d\d\.\d{4}"),
        ("ip", "152.143.123.131", r"\d+\.\d+\.\d+\.\d+"), ("ssn", "123-45-6789", r"\d{3}-\d{2}-\d{4}"), ("phone", "+1 (743) 555-3824", r"\+1 \(\d{3}\) \d{3}-\d{4}"),
        ("email", "bosbt.42@mail8.example.com", r"[a-z]{5}\.\d\d@[a-z]{4}\d\.[a-z]{7}\.com"), ("iban", "DE89370400440532013000", r"DE\d{20}"),
    ]
    texts = [f"{prose(k, 5)} {v} end" for k, (_, v, _) in enumerate(values)] + [f"again: {v}, 😀 and {v}." for _, v, _ in values]
    out = renewed(spark, texts)
    for k, (kind, value, shape) in enumerate(values):
        one, two = out[k], out[k + len(values)]
        m = re.search(shape, one.text)
        assert one.n_found == 1 and two.n_found == 2 and one.found.startswith(kind) and m and m[0] != value and value not in one.text
        assert two.text == texts[k + len(values)].replace(value, m[0])  # the same stand-in everywhere, and nothing else moves
        a, b = map(int, one.found.split(":")[1:])
        assert texts[k][a:b] == value
    assert luhn(re.sub(r"\D", "", re.search(values[0][2], out[0].text)[0])) and mod97(re.search(values[7][2], out[7].text)[0]) == 1
    datetime.date.fromisoformat(re.search(values[1][2], out[1].text)[0])


def test_permutations_are_one_to_one(spark):
    ips = [f"10.0.{k // 256}.{k % 256}" for k in range(600)]
    days = [(datetime.date(1990, 1, 1) + datetime.timedelta(k)).isoformat() for k in range(600)]
    mails = [f"ab{k:03d}@x.org" for k in range(600)]
    for values in (CARDS, ips, days, mails):
        out = renewed(spark, values)
        assert all(r.n_found == 1 for r in out.values()) and len({r.text for r in out.values()}) == len(values)
    assert all(luhn(r.text) for r in renewed(spark, CARDS).values())


# --- the same in plain Python ---


def network(left, right, n_left, n_right, key, tweak):
    for i in range(pii.ROUNDS):
        told = hashlib.sha256("|".join([key, tweak, str(i), str(right if i % 2 == 0 else left)]).encode()).hexdigest()
        drawn = int(told[:15], 16)
        if i % 2 == 0:
            left = (left + drawn % n_left) % n_left
        else:
            right = (right + drawn % n_right) % n_right
    return left, right


def text_network(text, key, tweak):
    half = len(text) // 2
    parts = [text[:half], text[half:]]
    for i in range(pii.ROUNDS):
        by = hashlib.sha512("|".join([key, tweak, str(i), parts[1 - i % 2]]).encode()).hexdigest()
        out = ""
        for j, c in enumerate(parts[i % 2]):
            base, size = (97, 26) if c in string.ascii_lowercase else (65, 26) if c in string.ascii_uppercase else (48, 10) if c in string.digits else (None, 0)
            out += c if base is None else chr(base + (ord(c) - base + int(by[2 * (j % 64) : 2 * (j % 64) + 2], 16)) % size)
        parts[i % 2] = out
    return parts[0] + parts[1]


def number_network(text, key, tweak):
    half = len(text) // 2
    left, right = network(int(text[:half] or 0), int(text[half:] or 0), 10**half, 10 ** (len(text) - half), key, f"{tweak}:{len(text)}")
    return (f"{left:0{half}d}" if half else "") + f"{right:0{len(text) - half}d}"


FIRST = datetime.date(1900, 1, 1)


def plain_pseudonym(kind, value, key):
    digits = re.sub(r"\D", "", value)
    refill = lambda symbols, which: "".join(next(it) if re.match(which, c) else c for it in [iter(symbols)] for c in value)
    if kind == "email":
        local, domain = value.split("@")
        head, last = domain.rsplit(".", 1)
        return f"{text_network(local, key, 'email:local')}@{text_network(head, key, 'email:domain')}.{last}"
    if kind == "iban":
        plain = value.replace(" ", "")
        inner = text_network(plain[4:], key, f"iban:{plain[:2]}")
        return refill(plain[:2] + f"{98 - mod97(plain[:2] + '00' + inner):02d}" + inner, "[0-9A-Z]")
    if kind == "date":
        american = value[2] == "/" and value[3:5] > "12"
        day = datetime.date.fromisoformat(value) if "-" in value else datetime.date(int(value[6:]), int(value[:2] if american else value[3:5]), int(value[3:5] if american else value[:2]))
        k = (day - FIRST).days
        while True:
            left, right = network(k // pii.DAYS[1], k % pii.DAYS[1], *pii.DAYS, key, "date:american" if american else "date")
            k = left * pii.DAYS[1] + right
            day = FIRST + datetime.timedelta(k)
            if not american or day.day > 12:
                break
        return day.isoformat() if "-" in value else day.strftime("%m/%d/%Y") if american else day.strftime(f"%d{value[2]}%m{value[2]}%Y")
    if kind == "ip":
        o = [int(x) for x in value.split(".")]
        left, right = network(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, key, "ip")
        return f"{left // 256}.{left % 256}.{right // 256}.{right % 256}"
    if kind == "ssn":
        areas = [a for a in range(1, 900) if a != 666]
        left, right = network(areas.index(int(digits[:3])), (int(digits[3:5]) - 1) * 9999 + int(digits[5:]) - 1, 898, 99 * 9999, key, "ssn")
        return f"{areas[left]:03d}-{right // 9999 + 1:02d}-{right % 9999 + 1:04d}"
    if kind == "phone":
        m = re.match(r"\+\d{1,3}(?=[ .(-])|0", value)
        code = len(re.sub(r"\D", "", m[0])) if m else 0
        return refill(digits[:code] + number_network(digits[code:], key, "phone"), "[0-9]")
    body = number_network(digits[:-1], key, "card")
    return refill(next(body + str(c) for c in range(10) if luhn(body + str(c))), "[0-9]")


def many_values():
    r = random.Random(5)
    pick = lambda alphabet, n: "".join(r.choice(alphabet) for _ in range(n))
    low, num = string.ascii_lowercase, string.digits
    out = [("card", " ".join(c[k : k + 4] for k in range(0, 16, 4)) if j % 2 else c) for j, c in enumerate(CARDS[:25])]
    for k in range(25):
        day = FIRST + datetime.timedelta(r.randrange(pii.DAYS[0] * pii.DAYS[1]))
        out.append(("date", [day.isoformat(), day.strftime("%d.%m.%Y"), day.strftime("%d/%m/%Y")][k % 3]))
        out.append(("date", day.replace(day=13 + k % 15).strftime("%m/%d/%Y")))
        out.append(("ip", ".".join(str(r.randrange(256)) for _ in range(4))))
        out.append(("ssn", f"{r.choice([1, 665, 667, 899, r.randrange(1, 666)]):03d}-{r.randrange(1, 100):02d}-{r.randrange(1, 10000):04d}"))
        out.append(("phone", [f"+49 30 {pick(num, 7)}", f"({pick('2345', 3)}) 555-{pick(num, 4)}", f"{pick('2345', 3)}-{pick('2345', 3)}-{pick(num, 4)}", f"+44{pick('123', 9)}", f"030/{pick('123', 7)}"][k % 5]))
        out.append(("email", f"{pick(low, r.randint(1, 9))}{pick('.-_', 1)}{pick(num + low, r.randint(1, 20))}@{pick(low, 4)}.{pick(low + num, 5)}.co"))
        country, inner = [("DE", pick(num, 18)), ("GB", pick(string.ascii_uppercase, 4) + pick(num, 14)), ("NL", pick(string.ascii_uppercase, 4) + pick(num, 10))][k % 3]
        iban = country + f"{98 - mod97(country + '00' + inner):02d}" + inner
        out.append(("iban", " ".join(iban[j : j + 4] for j in range(0, len(iban), 4)) if k % 2 else iban))
    return out


def test_pseudonyms_match_a_plain_feistel_and_stay_valid(spark):
    values = many_values()
    out = renewed(spark, [v for _, v in values])
    for k, (kind, value) in enumerate(values):
        assert out[k].found == f"{kind}:0:{len(value)}", (kind, value, out[k])
        assert out[k].text == plain_pseudonym(kind, value, "k"), (kind, value)
    again = renewed(spark, [out[k].text for k in range(len(values))])
    assert [again[k].found for k in range(len(values))] == [f"{kind}:0:{len(out[k].text)}" for k, (kind, _) in enumerate(values)]


def test_every_valid_number_has_its_own_stand_in(spark):
    ssn = [f"{a:03d}-{g:02d}-{n:04d}" for a in (1, 665, 667, 898, 899) for g in (1, 50, 99) for n in (1, 5000, 9999, *range(20, 60))]
    american = [(datetime.date(2000, 1, 1) + datetime.timedelta(k)).strftime("%m/%d/%Y") for k in range(700)]
    for values in (ssn, american):
        out = renewed(spark, values)
        assert all(r.n_found == 1 for r in out.values()) and len({r.text for r in out.values()}) == len(values)


def test_invalid_values_and_odd_rows_stay(spark):
    texts = [t[1] if isinstance(t, tuple) else t for t in odd_texts()] + ["4539148803436468 2023-02-30 999.1.1.1 000-12-3456 1.2.3.4.5 DE00370400440532013000 v1.2.3"]
    out = renewed(spark, texts)
    assert [out[k].text for k in range(len(texts))] == texts and all(r.n_found == 0 for r in out.values())
    assert pii.pseudonymise(frame(spark, []), "k").count() == 0


def test_key_changes_pseudonyms_and_plan_is_native(spark):
    docs = frame(spark, ["4539148803436467"])
    a, b = (pii.pseudonymise(docs, k).first().text for k in ("k", "l"))
    assert a != b
    plan = pii.pseudonymise(docs, "k")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
