"""Pseudonyms against a plain Python version of the same network, and their formats."""

import datetime
import hashlib
import itertools
import re

import pytest
from pyspark.sql import functions as F

from seriesloom.llm import pii

KEY = "k"


def network(kind, symbols, radices, key=KEY):
    s = list(symbols)
    half = len(s) // 2
    for r in range(pii.ROUNDS):
        first = r % 2 == 0
        other = s[half:] if first else s[:half]
        seed = hashlib.sha256("|".join([key, kind, ",".join(map(str, radices)), str(r), ",".join(map(str, other)), key])
                              .encode()).hexdigest()
        for i in range(len(s)):
            if (i < half) == first:
                h = int(hashlib.sha256(f"{seed}|{i}".encode()).hexdigest()[:12], 16)
                s[i] = (s[i] + h) % radices[i]
    return s


def luhn(d):
    return sum(sum(divmod(2 * int(x), 10)) if i % 2 else int(x) for i, x in enumerate(reversed(d))) % 10 == 0


def pseudonym(m):
    digits = re.sub("[^0-9]", "", m)
    if m[0].isalpha():
        plain = m.replace(" ", "")
        old = [int(c, 36) - (10 if c.isalpha() else 0) for c in plain[4:]]
        new = network("iban", old, [26 if c.isalpha() else 10 for c in plain[4:]])
        body = "".join(chr(65 + x) if c.isalpha() else str(x) for c, x in zip(plain[4:], new))
        check = 98 - int("".join(str(int(c, 36)) for c in body + plain[:2] + "00")) % 97
        left = iter(f"{plain[:2]}{check:02d}{body}")
        return "".join(c if c == " " else next(left) for c in m)
    if m[0] == "+" and m[1] != "1":
        left = iter(digits[:2] + "".join(map(str, network("foreign", map(int, digits[2:]), [10] * (len(digits) - 2)))))
        return "".join(next(left) if c.isdigit() else c for c in m)
    if re.fullmatch(r"\d+\.\d+\.\d+\.\d+", m):
        return ".".join(map(str, network("ip", list(map(int, m.split("."))), [256] * 4)))
    if re.fullmatch(r"\d{3}-\d\d-\d{4}", m):
        a, g, n = map(int, m.split("-"))
        a, g, n = network("ssn", [a - 2 if a > 666 else a - 1, g - 1, n - 1], [898, 99, 9999])
        return f"{a + 2 if a >= 665 else a + 1:03d}-{g + 1:02d}-{n + 1:04d}"
    if re.fullmatch(r"\d{4}-\d\d-\d\d", m):
        d = datetime.date.fromisoformat(m)
        base, p, q = (datetime.date(1900, 1, 1), 92, 397) if d.year < 2000 else (datetime.date(2000, 1, 1), 75, 487)
        n = (d - base).days
        x, y = network("date", [n % p, n // p], [p, q])
        return (base + datetime.timedelta(x + p * y)).isoformat()
    if len(digits) in (10, 11):
        ten = [int(x) - (2 if i in (0, 3) else 0) for i, x in enumerate(digits[-10:])]
        new = network("phone", ten, [8 if i in (0, 3) else 10 for i in range(10)])
        new = digits[:-10] + "".join(str(x + (2 if i in (0, 3) else 0)) for i, x in enumerate(new))
    else:
        new = digits[0] + "".join(map(str, network("card", map(int, digits[1:-1]), [10] * (len(digits) - 2))))
        new += next(str(c) for c in range(10) if luhn(new + str(c)))
    left = iter(new)
    return "".join(next(left) if c.isdigit() else c for c in m)


def run(spark, texts):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, PII string")
    return pii.pseudonymise(df, KEY).orderBy("doc_id").collect()


VALUES = ["4041894974608795", "4041 8949 7460 8795", "+1 (988) 555-2485", "(988) 555-2485", "988-555-2485", "42.144.35.254",
          "123-45-6789", "700-01-0001", "2021-03-05", "1999-12-31", "2000-02-29", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "+49 (30) 1234567",
          "+33 1 23 45 67 89"]


def test_values_equal_the_plain_version(spark):
    rows = run(spark, [f"a {v}, b {v}. c" for v in VALUES])
    for v, row in zip(VALUES, rows):
        p = pseudonym(v)
        assert row.text == f"a {p}, b {p}. c" and p != v, v
        assert [x.pseudonym for x in row.pii] == [p, p]


def test_links_over_layouts(spark):
    a, b, c, d = (r.text for r in run(spark, ["2021-03-05", "05.03.2021", "03/05/2021", "Anna.42@Example.org"]))
    day = datetime.date.fromisoformat(a)
    assert b == day.strftime("%d.%m.%Y") and c == day.strftime("%m/%d/%Y")
    assert re.fullmatch(r"[A-Z][a-z]{3}\.\d\d@Example\.org", d) and d != "Anna.42@Example.org"


def test_invalid_values_and_edges_stay(spark):
    texts = ["4041894974608796", "123-45-67890", "666-45-6789", "000-45-6789", "300.1.1.1", "1.2.3.4.5", "2021-02-30", "DE89 3704 0044 0532 0130 01", "+49 123",
             "(188) 555-2485", "x4041894974608795", "", None, "no digits", "99", "@", "a@b"]
    for t, row in zip(texts, run(spark, texts)):
        assert row.text == t and row.pii == [], t


def test_permutation(spark):
    rows = [(list(x),) for x in itertools.product(range(3), range(4), range(2))]
    df = spark.createDataFrame(rows, "s array<long>")
    r = F.array(*[F.lit(x).cast("long") for x in (3, 4, 2)])
    out = [tuple(x.p) for x in df.select(pii.permute(F.lit("t"), F.col("s"), r, KEY).alias("p")).collect()]
    assert sorted(out) == [tuple(x[0]) for x in rows]
    assert out == [tuple(network("t", x[0], [3, 4, 2])) for x in rows]


def test_empty_table(spark):
    assert run(spark, []) == []


@pytest.mark.parametrize("n", [1, 2])
def test_short_local_parts(spark, n):
    out = {r.text for r in run(spark, ["".join(x) + "@a.org" for x in itertools.product("abcdefghij", repeat=n)])}
    assert len(out) == 10 ** n


def test_addresses_before_marks(spark):
    ends = [".", "...", ". Thanks", ")", "", ", x", "; x", "?"]
    alone, *marked = run(spark, ["jane.doe@mail.example.com"] + [f"Write to jane.doe@mail.example.com{e}" for e in ends])
    assert alone.text != "jane.doe@mail.example.com"
    assert [r.text for r in marked] == [f"Write to {alone.text}{e}" for e in ends]


def test_values_next_to_others(spark):
    card, iban, day = "4111 1111 1111 1111", "BE68 5390 0754 7034", "2021-03-05"
    texts = ["card {c} 123 ok", "12 {c}", "1234 {c}", "{c} {c} {c} 12 12", "{i} EUR 50", "AB12 {i} XXXX", "{c} 03/05/2021x",
             "PAID {i} PAID {c} AND {d} A.B", "42 {d} 10 15 30", "5 {d} {d} {d}", "{c} 5-2nd", "{i}. {c}, {d}"]
    ways = {"c": card, "i": iban, "d": day}
    news = {k: pseudonym(v) for k, v in ways.items()}
    for t, row in zip(texts, run(spark, [t.format(**ways) for t in texts])):
        assert row.text == t.format(**news), t
    odd = "41111 11111 11111 1"
    rows = run(spark, [odd, f"{card[:-1]}2 123", " ".join(["12"] * 1000), f"3782 822463 10005 7 {iban}"])
    assert rows[0].text == pseudonym(odd) and rows[1].pii == [] == rows[2].pii
    assert rows[3].text == f"{pseudonym('3782 822463 10005')} 7 {news['i']}"


def test_dates_with_times_and_day_first(spark):
    a, b, c, d = (r.text for r in run(spark, ["2021-12-25", "25/12/2021", "2021-12-25T10:00", "at 2021-12-25T10:00:00Z."]))
    day = datetime.date.fromisoformat(a)
    assert a != "2021-12-25" and b == day.strftime("%d/%m/%Y") and c == f"{a}T10:00" and d == f"at {a}T10:00:00Z."


def test_phones_outside_the_plan(spark):
    texts = ["+1 (017) 555-7713", "+1 017-555-7713", "1 (988) 155-2485", "+1.188.055.2485"]
    rows = run(spark, texts)
    for t, row in zip(texts, rows):
        old, new = (re.sub("[^0-9]", "", x)[-10:] for x in (t, row.text))
        radices = [(8 if x > "1" else 2) if i in (0, 3) else 10 for i, x in enumerate(old)]
        want = network("phone", [int(x) - 2 * (r == 8) for x, r in zip(old, radices)], radices)
        assert new == "".join(str(x + 2 * (r == 8)) for x, r in zip(want, radices)) and new != old
        assert re.sub("[0-9]", "9", t) == re.sub("[0-9]", "9", row.text) and [x.kind for x in row.pii] == ["phone"]
    assert re.sub("[^0-9]", "", rows[0].text) == re.sub("[^0-9]", "", rows[1].text)


def test_long_runs_and_repeated_rows(spark):
    card = "4111 1111 1111 1111"
    plain = " ".join(str(1000 + i * 7919 % 9000) for i in range(50_000))  # many chance cards
    dense = " ".join([card] * 12_500)  # nothing but cards, over block borders
    odd = " ".join(["12"] + [card] * 300)
    rows = run(spark, [plain, dense, odd, odd])
    words = plain.split()
    got, at = [], 0
    while at < len(words):
        size = 4 if at + 4 <= len(words) and luhn("".join(words[at:at + 4])) else 0
        got += [" ".join(words[at:at + size])] if size else []
        at += size or 1
    assert len(rows[0].pii) == len(got) and len(got) > 1000
    assert len(rows[0].text.split()) == 50_000
    assert rows[1].text == " ".join([pseudonym(card)] * 12_500) and len(rows[1].pii) == 12_500
    assert rows[2].text == " ".join(["12"] + [pseudonym(card)] * 300)
    assert (rows[2].text, rows[2].pii) == (rows[3].text, rows[3].pii)


@pytest.mark.parametrize("block", [1, 3])
def test_blocks_of_a_run(spark, monkeypatch, block):
    monkeypatch.setattr(pii, "BLOCK", block)
    test_values_next_to_others(spark)
