"""PII: format-preserving pseudonyms of validated numbers and dates, with DataFrame functions only.

A found value is checked (Luhn digit, number plan, calendar, octets), written as a list of symbols with a radix each, and
permuted by a keyed Feistel network over that list: in each round one half gets, symbol by symbol, a keyed hash of the other
half added modulo its radix. That is a permutation of all values of the format, so pseudonyms are valid values of it, equal
values have equal pseudonyms in every document and layout, and different ones have different ones.

    kind    symbols (radix)
    card    digits after the first, without the Luhn digit (10), which is computed anew
    phone   ten digits of the North American plan (10; 8 for the first of area and exchange, which are 2 to 9); behind the
            country code also others (2 for a first digit of 0 or 1), so those within and outside the plan stay so
    ssn     area 001-899 without 666 (898), group 01-99 (99), serial 0001-9999 (9999)
    ip      octets (256)
    date    number of the day in its century, in two symbols: 1900s (92, 397), 2000s (75, 487)
    email   letters (26) and digits (10) of the part before @, in lower case; the domain stays
    iban    letters (26) and digits (10) after the check digits, which are computed anew; the country stays
    foreign digits of a number in + notation of other plans, after the first two (10); eight to fifteen in all
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import query, table, without

ROUNDS = 10
#: Layouts, none inside a longer run of letters, digits or joining marks.
_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9][A-Za-z0-9-]*+\.){1,127}[A-Za-z]{2,}+"
_OPEN, _SHUT = r"(?<![A-Za-z0-9_.+-])", r"(?![A-Za-z0-9_]|[.-][0-9])"
_IP = r"[0-9]{1,3}+(?:\.[0-9]{1,3}+){3}"
_DATE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4}"
_SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
_PHONE = r"(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}([ .-])[0-9]{3}\1[0-9]{4})"
_CARD = r"[0-9](?:[ -]?[0-9]){12,18}"
_IBAN = r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"
#: Groupings of cards that may stand next to other numbers; other groupings count where nothing else is in the run.
_CARD_GROUPS = (r"[0-9](?:-?[0-9]){12,18}|[0-9]{4}(?: [0-9]{4}){3}(?: [0-9]{3})?|[0-9]{4} [0-9]{6} [0-9]{4,5}"
                r"|[0-9]{4}(?: [0-9]{3}){3}|[0-9]{4} [0-9]{4} [0-9]{5}|[0-9]{4} [0-9]{5} [0-9]{6}|[0-9]{6} [0-9]{13}")
_FOREIGN = r"\+[2-9][0-9]{1,3}(?:[ .-]?\(?[0-9]{1,8}\)?){1,5}"


def _grouped(pattern: str) -> str:
    """For use next to others: the separator group by name."""
    return pattern.replace(r"([ .-])", r"(?<sep>[ .-])").replace(r"\1", r"\k<sep>")


#: Runs of numbers, and of numbers and capital words, with blanks between: what may hold a card or an account number. A word
#: of a run ends like a value and begins no address and no date with slashes.
_WORD_END = rf"(?!/[0-9]){_SHUT}"
_NUMBER = rf"[0-9]++(?:-[0-9]++)*+{_WORD_END}"
_WORD = rf"(?![A-Za-z0-9._%+-]*+@)[A-Z0-9]++(?:-[0-9]++)*+{_WORD_END}"
_NUMBERS = rf"(?=[0-9](?:[ -]?[0-9]){{12}}){_NUMBER}(?: {_NUMBER})*+"
_WORDS = rf"(?={_IBAN}{_SHUT}){_WORD}(?: {_WORD})*+"
#: Most words of a value in a run: 34 characters in fours; words of a run whose parts are put together in one piece.
WORDS, BLOCK = 9, 512


#: A plus sign or an opening bracket may stand before a phone number.
#: A time may follow a date: 2021-03-05T10:00.
FOUND = rf"{_EMAIL}|{_OPEN}[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}(?=T[0-9]{{2}})|{_OPEN}(?:{_IP}|{_DATE}|{_SSN}|{_grouped(_PHONE)}|{_FOREIGN}|{_WORDS}|{_NUMBERS}){_SHUT}"
#: Lengths of account numbers by country, for those that may stand next to other words; others count where nothing else does.
_LENGTHS = {15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
            22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
            25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
            29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}
_LONG = "|".join(rf"(?:{c.replace(' ', '|')})(?: ?[A-Z0-9]){{{n - 2}}}" for n, c in _LENGTHS.items())
#: What a part of a run can be.
_PART = rf"^(?:{_DATE}|{_SSN}|{_grouped(_PHONE)}|(?=(?:{_LONG})$){_IBAN}|{_CARD_GROUPS})$"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _letters(x: Column) -> Column:
    """The characters of a string, without a last empty one."""
    return F.filter(F.split(x, "", -1), lambda c: c != "")


def _numbers(x: Column) -> Column:
    return F.transform(_letters(x), lambda c: c.cast("long"))


def _luhn_sum(digits: Column, double_last: bool) -> Column:
    """Sum of the digits of a string, every second one doubled (9 taken from two-figure results), counted from the right."""
    turned = F.reverse(_numbers(digits))
    odd = 0 if double_last else 1
    return F.aggregate(F.transform(turned, lambda x, i: F.when(
        (i % 2 == odd), F.when(x > 4, x * 2 - 9).otherwise(x * 2)).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)


def _iban_rest(country: Column, check: Column, body: Column) -> Column:
    """Remainder by 97 of an account number, with the country and the check digits moved behind the body."""
    values = F.transform(_letters(F.concat(body, country, check)), lambda c: F.when(
        c.rlike("^[A-Z]$"), F.ascii(c) - 55).otherwise(c.cast("int")).cast("long"))
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, v: (a * F.when(v > 9, 100).otherwise(10) + v) % 97)


def _longs(*columns) -> Column:
    return F.array(*[c.cast("long") if isinstance(c, Column) else F.lit(c).cast("long") for c in columns])


def _day_first(m: Column) -> Column:
    """Whether a date with slashes has its day in front: only where the first number is no month."""
    return F.substring(m, 1, 2).cast("int") > 12


def _date_of(m: Column) -> Column:
    """Day that a date in one of the layouts names, null if there is no such day between 1900 and 2099."""
    text = F.when(F.substring(m, 5, 1) == "-", m).when(
        (F.substring(m, 3, 1) == ".") | _day_first(m), F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 4, 2), F.substring(m, 1, 2))) \
        .otherwise(F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 1, 2), F.substring(m, 4, 2)))
    day = F.try_to_date(text, "yyyy-MM-dd")
    return F.when((F.substring(text, 1, 2).isin("19", "20")) & (F.date_format(day, "yyyy-MM-dd") == text), day)


def _parse(m: Column) -> Column:
    """struct(kind, symbols, radices) of a found string; kind is null where the value is not valid."""
    digits = _digits(m)
    no_symbols = F.array().cast("array<long>")

    def of(kind, symbols, radices):
        return F.struct(F.lit(kind).alias("kind"), symbols.alias("symbols"), radices.alias("radices"))

    local = _letters(F.lower(F.substring_index(m, "@", 1)))
    letter, digit = "^[a-z]$", "^[0-9]$"
    email = of("email", F.transform(local, lambda c: F.when(c.rlike(letter), F.ascii(c) - 97)
                                    .when(c.rlike(digit), F.ascii(c) - 48).otherwise(F.lit(0)).cast("long")),
               F.transform(local, lambda c: F.when(c.rlike(letter), F.lit(26)).when(c.rlike(digit), F.lit(10))
                           .otherwise(F.lit(1)).cast("long")))
    octets = F.transform(F.split(m, r"\.", -1), lambda x: x.cast("long"))
    ip = of("ip", octets, F.transform(octets, lambda x: F.lit(256).cast("long")))
    day = _date_of(m)
    old = F.year(day) < 2000
    since = F.datediff(day, F.when(old, F.lit("1900-01-01")).otherwise(F.lit("2000-01-01")).cast("date")).cast("long")
    first, second = F.when(old, F.lit(92)).otherwise(F.lit(75)), F.when(old, F.lit(397)).otherwise(F.lit(487))
    date = of("date", _longs(F.pmod(since, first), F.floor(since / first)), _longs(first, second))
    area, part, serial = (F.substring(digits, a, n).cast("long") for a, n in ((1, 3), (4, 2), (6, 4)))
    ssn = of("ssn", _longs(F.when(area > 666, area - 2).otherwise(area - 1), part - 1, serial - 1), _longs(898, 99, 9999))
    ten = F.substring(digits, -10, 10)
    first_of = lambda i: (i == 0) | (i == 3)
    phone = of("phone", F.transform(_numbers(ten), lambda x, i: F.when(first_of(i) & (x > 1), x - 2).otherwise(x)),
               F.transform(_numbers(ten), lambda x, i: F.when(first_of(i), F.when(x > 1, F.lit(8)).otherwise(F.lit(2)))
                           .otherwise(F.lit(10)).cast("long")))
    inner = _numbers(F.substring(digits, F.lit(2), F.length(digits) - 2))
    card = of("card", inner, F.transform(inner, lambda x: F.lit(10).cast("long")))
    account = F.regexp_replace(m, " ", "")
    body = _letters(F.substring(account, F.lit(5), F.length(account)))
    iban = of("iban", F.transform(body, lambda c: F.when(c.rlike("^[A-Z]$"), F.ascii(c) - 65).otherwise(c.cast("int"))
                                  .cast("long")),
              F.transform(body, lambda c: F.when(c.rlike("^[A-Z]$"), F.lit(26)).otherwise(F.lit(10)).cast("long")))
    after = _numbers(F.substring(digits, F.lit(3), F.length(digits)))
    foreign = of("foreign", after, F.transform(after, lambda x: F.lit(10).cast("long")))
    none = F.struct(F.lit(None).cast("string").alias("kind"), no_symbols.alias("symbols"), no_symbols.alias("radices"))
    coded = (F.length(digits) == 11) & digits.startswith("1")
    plan = ten.rlike("^[2-9][0-9]{2}[2-9]") & ((F.length(digits) == 10) | coded)
    plan = plan | (coded & (m.startswith("+") | m.contains("(")))
    return (F.when(m.contains("@"), email)
            .when(m.rlike(f"^{_IP}$") & F.forall(octets, lambda x: x < 256), ip)
            .when(m.rlike(f"^(?:{_DATE})$") & day.isNotNull(), date)
            .when(m.rlike(f"^{_SSN}$") & area.between(1, 899) & (area != 666) & (part > 0) & (serial > 0), ssn)
            .when(m.rlike(f"^{_PHONE}$") & plan, phone)
            .when(m.rlike(f"^{_FOREIGN}$") & F.length(digits).between(8, 15), foreign)
            .when(m.rlike(f"^{_IBAN}$") & (_iban_rest(F.substring(account, 1, 2), F.substring(account, 3, 2),
                                                      F.substring(account, F.lit(5), F.length(account))) == 1), iban)
            .when(m.rlike(f"^{_CARD}$") & (_luhn_sum(digits, False) % 10 == 0), card)
            .otherwise(none))


def _once(x: Column, f) -> Column:
    """f(x), with x computed once and not at each place where f uses it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _longest(words: Column, i: Column) -> Column:
    """Number of words of the longest value that starts at word i of a run, 0 if none does."""
    value = lambda t: F.when(t.rlike(_PART), _parse(t)["kind"]).isNotNull()
    return F.aggregate(F.sequence(F.least(F.lit(WORDS), F.size(words) - i), F.lit(1)), F.lit(0), lambda best, k: F.when(
        best > 0, best).when(_once(F.array_join(F.slice(words, i + 1, k), " "), value), k).otherwise(0))


def _cut(words: Column, sizes: Column) -> Column:
    """Values and what lies between them, each followed by a blank but the last; sizes: of the value that starts at a word.

    The parts are collected in blocks of BLOCK words and the blocks joined at the end, so the copies that a growing array
    takes stay small against the run.
    """
    strings = F.array().cast("array<string>")
    joined = lambda start, size: F.array_join(F.slice(words, start + 1, size), " ")
    state = lambda end, out: F.struct(end.cast("int").alias("end"), out.alias("out"))

    def between(end, start):
        return F.when(start > end, F.array(joined(end, start - end), F.lit(" "))).otherwise(strings)

    def take(st, i):
        size = F.element_at(sizes, i + 1)
        return F.when((size > 0) & (i >= st["end"]), state(i + size, F.concat(
            st["out"], between(st["end"], i), F.array(joined(i, size), F.lit(" "))))).otherwise(st)

    def block(st, b):
        inner = F.aggregate(F.sequence(b, F.least(b + BLOCK, F.size(words)) - 1), state(st["end"], strings), take)
        return _once(inner, lambda new: state(new["end"], F.concat(st["out"], F.array(new["out"]))))

    blocks = F.aggregate(F.sequence(F.lit(0), F.size(words) - 1, F.lit(BLOCK)),
                         state(F.lit(0), F.array().cast("array<array<string>>")), block)
    parts = _once(blocks, lambda st: F.concat(F.flatten(st["out"]), between(st["end"], F.size(words))))
    return _once(parts, lambda out: F.slice(out, F.lit(1), F.size(out) - 1))


def _parts(m: Column) -> Column:
    """The found string in parts that give it again when joined: in a run, valid values and what lies between them.

    The leftmost value counts, and of those with one start the longest. The work is linear in the words of a run.
    """
    cut = _once(F.split(m, " ", -1), lambda words: _once(
        F.transform(F.sequence(F.lit(0), F.size(words) - 1), lambda i: _longest(words, i)), lambda sizes: _cut(words, sizes)))
    return F.when(m.contains(" ") & m.rlike("^[A-Z0-9 -]+$") & ~m.rlike(f"^(?:{_DATE}|{_SSN}|{_grouped(_PHONE)})$"), cut) \
        .otherwise(F.array(m))


def permute(kind: Column, symbols: Column, radices: Column, key: str, rounds: int = ROUNDS) -> Column:
    """Feistel network over symbols with a radix each; ``kind``, the radices and the key choose the permutation."""
    half = F.floor(F.size(symbols) / 2).cast("int")
    format_of = F.array_join(radices.cast("array<string>"), ",")

    def turn(s, r):
        first = r % 2 == 0  # the half that changes: the first in even rounds
        other = F.when(first, F.slice(s, half + 1, F.size(s) - half)).otherwise(F.slice(s, 1, half))
        seed = F.sha2(F.concat_ws("|", F.lit(key), kind, format_of, r.cast("string"),
                                  F.array_join(other.cast("array<string>"), ","), F.lit(key)).cast("binary"), 256)

        def symbol(x, i):
            hashed = F.conv(F.substring(F.sha2(F.concat_ws("|", seed, i.cast("string")).cast("binary"), 256), 1, 12), 16, 10)
            return F.when((i < half) == first, F.pmod(x + hashed.cast("long"), F.element_at(radices, i + 1))).otherwise(x)

        return F.transform(s, symbol)

    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), symbols, turn)


def _laid_out(m: Column, digits: Column) -> Column:
    """The string m with its digits replaced, in order, by those of ``digits``."""
    chars = _letters(m)
    return F.array_join(F.transform(chars, lambda c, i: F.when(
        c.rlike("^[0-9]$"), F.substring(digits, F.length(_digits(F.substring(m, F.lit(1), i + 1))), F.lit(1)))
        .otherwise(c)), "")


def _render(m: Column, kind: Column, s: Column) -> Column:
    """The found string with the permuted symbols in its layout."""
    at = lambda i: F.element_at(s, i)
    joined = F.array_join(s.cast("array<string>"), "")
    digits = _digits(m)
    local = _letters(F.substring_index(m, "@", 1))
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    email = F.concat(F.array_join(F.transform(local, lambda c, i: F.when(
        c.rlike("^[a-z]$"), F.substring(F.lit(alphabet), F.element_at(s, i + 1).cast("int") + 1, F.lit(1)))
        .when(c.rlike("^[A-Z]$"), F.substring(F.lit(alphabet.upper()), F.element_at(s, i + 1).cast("int") + 1, F.lit(1)))
        .when(c.rlike("^[0-9]$"), F.element_at(s, i + 1).cast("string")).otherwise(c)), ""),
        F.lit("@"), F.substring_index(m, "@", -1))
    day = _date_of(m)
    old = F.year(day) < 2000
    moved = F.date_add(F.when(old, F.lit("1900-01-01")).otherwise(F.lit("2000-01-01")).cast("date"),
                       (at(1) + at(2) * F.when(old, F.lit(92)).otherwise(F.lit(75))).cast("int"))
    layout = lambda f: F.date_format(moved, f)
    date = F.when(F.substring(m, 5, 1) == "-", layout("yyyy-MM-dd")).when(F.substring(m, 3, 1) == ".", layout("dd.MM.yyyy")) \
        .when(_day_first(m), layout("dd/MM/yyyy")).otherwise(layout("MM/dd/yyyy"))
    ssn = F.concat_ws("-", F.lpad(F.when(at(1) >= 665, at(1) + 2).otherwise(at(1) + 1).cast("string"), 3, "0"),
                      F.lpad((at(2) + 1).cast("string"), 2, "0"), F.lpad((at(3) + 1).cast("string"), 4, "0"))
    old_ten = F.substring(digits, -10, 10)
    ten = F.array_join(F.transform(s, lambda x, i: F.when(
        ((i == 0) | (i == 3)) & (F.substring(old_ten, i + 1, F.lit(1)) > "1"), x + 2).otherwise(x)).cast("array<string>"), "")
    phone = _laid_out(m, F.concat(F.substring(digits, F.lit(1), F.length(digits) - 10), ten))
    front = F.concat(F.substring(digits, 1, 1), joined)
    card = _laid_out(m, F.concat(front, F.pmod(-_luhn_sum(front, True), F.lit(10)).cast("string")))
    account = F.regexp_replace(m, " ", "")
    country, body = F.substring(account, 1, 2), _letters(F.substring(account, F.lit(5), F.length(account)))
    moved_body = F.array_join(F.transform(body, lambda c, i: F.when(
        c.rlike("^[A-Z]$"), F.substring(F.lit(alphabet.upper()), F.element_at(s, i + 1).cast("int") + 1, F.lit(1)))
        .otherwise(F.element_at(s, i + 1).cast("string"))), "")
    check = F.lpad((98 - _iban_rest(country, F.lit("00"), moved_body)).cast("string"), 2, "0")
    whole_iban, chars = F.concat(country, check, moved_body), _letters(m)
    iban = F.array_join(F.transform(chars, lambda c, i: F.when(c == " ", c).otherwise(F.substring(
        whole_iban, F.length(F.regexp_replace(F.substring(m, F.lit(1), i + 1), " ", "")), F.lit(1)))), "")
    foreign = _laid_out(m, F.concat(F.substring(digits, 1, 2), joined))
    return F.when(kind == "iban", iban).when(kind == "foreign", foreign).when(kind == "email", email).when(kind == "ip", F.array_join(s.cast("array<string>"), ".")) \
        .when(kind == "date", date).when(kind == "ssn", ssn).when(kind == "phone", phone).when(kind == "card", card) \
        .otherwise(m)


def pseudonymise(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The table with pseudonyms for personal values in ``text``, and ``pii``: array of struct(kind, pseudonym) in order.

    All of a text is read. Values that look like a kind but are not valid stay (no such day, wrong Luhn digit). Null texts
    stay null, with an empty list, as do texts without values. Rows that repeat stay, each with the same pseudonyms, and an
    empty table gives an empty one. A column called pii in the input is replaced. Octets are written without zeros in front.
    Addresses of IP version 6 and numbers of passports are no kinds and stay in clear.
    """
    df = without(df, ["pii"])
    names = df.columns
    body = F.col(f"`{text}`").cast("string")
    some = body.rlike("[0-9@]")
    found = df.select("*", F.when(some, F.regexp_extract_all(body, F.lit(FOUND), F.lit(0))).alias("_found"))
    cut = found.withColumn("_parts", F.when(F.size("_found") > 0, F.transform("_found", _parts)))
    inside = lambda name, f: F.transform(name, lambda parts: F.transform(parts, f))
    parsed = cut.withColumn("_parsed", inside("_parts", lambda m: F.struct(m.alias("m"), _parse(m).alias("p"))))
    made = parsed.withColumn("_made", inside("_parsed", lambda x: F.struct(
        x["m"].alias("m"), x["p"]["kind"].alias("kind"),
        permute(x["p"]["kind"], x["p"]["symbols"], x["p"]["radices"], key).alias("s"))))
    shown = made.withColumn("_shown", inside("_made", lambda x: F.struct(
        x["kind"].alias("kind"), _render(x["m"], x["kind"], x["s"]).alias("pseudonym"))))
    gaps = F.split(body, FOUND, -1)
    new = F.array_join(F.zip_with(gaps, F.col("_shown"), lambda g, parts: F.concat(g, F.coalesce(
        F.array_join(F.transform(parts, lambda x: x["pseudonym"]), ""), F.lit("")))), "")
    valid = F.filter(F.flatten("_shown"), lambda x: x["kind"].isNotNull())
    none = F.array().cast("array<struct<kind:string,pseudonym:string>>")
    return shown.select(*[F.when(F.col("_shown").isNotNull(), new).otherwise(F.col(f"`{c}`")).alias(c) if c == text
                          else F.col(f"`{c}`") for c in names], F.coalesce(valid, none).alias("pii"))


@query("op2_pii_pseudonyms")
def op2(spark, sf_dir):
    done = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key="key of the registered query")
    return done.select("doc_id", "text", F.size("pii").alias("n_replaced"),
                       F.transform("pii", lambda x: F.concat_ws(":", x["kind"], x["pseudonym"])).alias("pseudonyms"))
