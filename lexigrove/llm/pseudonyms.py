"""Format-preserving pseudonyms for personal data, in column functions only.

Validated values are replaced by values of the same format: digits stay digits,
check digits stay right, dates stay dates. A value is a row of symbols, each
with its number of choices; a Feistel network shifts one half of the symbols by
keyed SHA-256 of the other half, in turns. It is a permutation of the format,
so equal values get equal pseudonyms in all documents and different values
different ones.

Formats: e-mail addresses (the local part), IPv4 addresses, IBANs (modulo 97),
ISO and day-month-year dates (within their 400 years), social security numbers,
phone numbers (after the country code; three, three and four digits after +1,
elsewhere at most the digits of the country or 15 in all), card numbers (Luhn). Values that fail
their check are left alone.

Edge cases: null stays null; empty texts and texts without a value are
returned unchanged; repeated rows give repeated results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lexigrove.llm.shared import unused

TURNS = 8
KEY = "corpus"

# --- fixed values: formats and their patterns, in order of precedence ---
# National digits of some countries at most; elsewhere all digits are 15 at most.
NATIONAL = {"7": 10, "31": 9, "33": 9, "34": 9, "41": 9, "44": 10, "45": 8, "47": 8, "48": 9, "61": 9, "91": 10}
LEAST_NATIONAL, ALL_DIGITS = 6, 15
PATTERNS = {
    "email": r"(?<![\w.%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}[A-Z0-9]{11,30}+(?!\w)",
    "iso": r"(?<![\w-])\d{4}-\d{2}-\d{2}(?![\w-])",
    "dmy": r"(?<![\w./])\d{2}[./]\d{2}[./]\d{4}(?!\w|[./]\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
}


def _phones() -> str:
    """Phones after +1 have three, three and four digits, others as many as their country allows; no group begins another value."""
    other = "|".join(PATTERNS[kind] for kind in ("ip", "iso", "dmy", "ssn")) + r"|(?:\d{4}[ -]){3}\d{4}(?!\w|[ -]\d)"
    step = rf"(?:(?: (?!{other})|[.-])(?=\d\d))?\d"

    def after(code: str, national: int) -> list[str]:
        return [rf"{code}[ .-]?\(?\d{{{area}}}\)?(?:{step}){{{LEAST_NATIONAL - area},{national - area}}}" for area in (4, 3, 2)]

    formats = [r"1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}"]
    for code, national in NATIONAL.items():
        formats += after(code, national)
    listed = "|".join(["1", *NATIONAL])
    for size in (1, 2, 3):
        formats += after(rf"(?!{listed})\d{{{size}}}", ALL_DIGITS - size)
    return rf"(?<![\w+])\+(?:{'|'.join(formats)})(?!\w)" + r"|(?<!\w)\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)|(?<![\w-])\d{3}-\d{3}-\d{4}(?![\w-])"


PATTERNS |= {
    "phone": _phones(),
    "card": r"(?<![\w.-])(?:\d{13,19}|(?:\d{4} ){3}\d{1,7}|(?:\d{4}-){3}\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?!\w|-\d)",
}
# All but addresses begin with one of a few characters.
ANY = PATTERNS["email"] + "|(?=[0-9+(A-Z])(?:" + "|".join(p for kind, p in PATTERNS.items() if kind != "email") + ")"
# Every value holds a digit or an at sign; texts without any are not searched.
HINT = "[0-9@]"
DAYS_OF_ERA = (189, 773)
SSN = (898, 99, 9999)


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def feistel(symbols: Column, choices: Column, tag: str, key: str = KEY) -> Column:
    """A keyed permutation of all rows of symbols with these numbers of choices."""
    half = F.floor(F.size(symbols) / 2).cast("int")

    def turn(state: Column, number: Column) -> Column:
        first = number % 2 == 0
        other = F.when(first, F.slice(state, half + 1, F.size(state) - half)).otherwise(F.slice(state, F.lit(1), half))
        told = F.concat_ws("|", F.lit(key), F.lit(tag), number.cast("string"), F.size(state).cast("string"), F.array_join(other.cast("array<string>"), ","))

        def shifted(digest: Column) -> Column:
            def one(symbol: Column, place: Column) -> Column:
                drawn = F.conv(F.substring(digest, (place * 6) % 58 + 1, F.lit(6)), 16, 10).cast("long")
                moved = F.pmod(symbol + drawn, F.get(choices, place)).cast("int")
                return F.when((place < half) == first, moved).otherwise(symbol)
            return F.transform(state, one)

        return _let(F.sha2(told, 256), shifted)

    return F.aggregate(F.sequence(F.lit(0), F.lit(TURNS - 1)), symbols, turn)


def _luhn(digits: Column) -> Column:
    """Weighted digit sum of a row of digits, the last one counted once."""
    n = F.size(digits)

    def part(digit: Column, place: Column) -> Column:
        twice = digit * 2
        return F.when((n - place) % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(digit)

    return F.aggregate(F.transform(digits, part), F.lit(0), lambda a, x: a + x)


def _refilled(text: Column, values: Column, pattern: str) -> Column:
    """The text with its characters of the pattern replaced, in order, by the values."""
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("used"))

    def put(state: Column, char: Column) -> Column:
        fits = char.rlike(pattern)
        return F.struct(F.concat(state["text"], F.when(fits, F.get(values, state["used"])).otherwise(char)).alias("text"),
                        (state["used"] + F.when(fits, 1).otherwise(0)).alias("used"))

    return F.aggregate(_chars(text), start, put, lambda s: s["text"])


def _digits(text: Column) -> Column:
    return _chars(F.regexp_replace(text, r"\D", "")).cast("array<int>")


def _radix(symbols: Column, radix: int) -> Column:
    return F.transform(symbols, lambda _: F.lit(radix))


def _text(values: Column) -> Column:
    return values.cast("array<string>")


def _code(char: Column) -> Column:
    """0-9 for digits, 10-35 for letters of either case."""
    return F.when(char.rlike("[0-9]"), char.cast("int")).otherwise(F.ascii(F.lower(char)) - 87)


def _of_code(code: Column) -> Column:
    return F.when(code < 10, code.cast("string")).otherwise(F.char(code + 87))


def _alphanumeric(part: Column, tag: str, key: str) -> Column:
    """Letters stay letters, digits digits; the result is in lower case."""
    chars = _chars(F.regexp_replace(part, r"[^A-Za-z0-9]", ""))
    base = F.transform(chars, lambda c: F.when(c.rlike("[0-9]"), 0).otherwise(10))
    choices = F.transform(base, lambda b: F.when(b == 0, 10).otherwise(26))
    symbols = F.transform(chars, lambda c: F.when(c.rlike("[0-9]"), _code(c)).otherwise(_code(c) - 10))
    return _let(feistel(symbols, choices, tag, key), lambda out: _refilled(
        part, F.transform(F.arrays_zip(out.alias("o"), base.alias("b")), lambda z: _of_code(z["o"] + z["b"])), "[A-Za-z0-9]"))


def _mod97(text: Column) -> Column:
    return F.aggregate(_chars(text), F.lit(0), lambda a, c: _let(
        _code(c), lambda v: F.when(v < 10, a * 10 + v).otherwise(a * 100 + v) % 97).cast("int"))


def _email(value: Column, key: str) -> Column:
    return F.concat(_alphanumeric(F.substring_index(value, "@", 1), "email", key), F.lit("@"), F.substring_index(value, "@", -1))


def _ip(value: Column, key: str) -> Column:
    octets = F.split(value, r"\.").cast("array<int>")
    return F.when(F.forall(octets, lambda o: o < 256),
                  F.array_join(_text(feistel(octets, _radix(octets, 256), "ip", key)), ".")).otherwise(value)


def _iban(value: Column, key: str) -> Column:
    country, account = F.substring(value, 1, 2), F.substring(value, F.lit(5), F.length(value))
    good = _mod97(F.concat(account, F.substring(value, 1, 4))) == 1
    return F.when(good, _let(F.upper(_alphanumeric(account, "iban", key)), lambda new: F.concat(
        country, F.lpad((98 - _mod97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0"), new))).otherwise(value)


def _date(value: Column, key: str, year: Column, month: Column, day: Column, shown) -> Column:
    when = F.try_to_date(F.concat_ws("-", year, month, day), "yyyy-MM-dd")
    era = F.floor(year.cast("int") / 400) * 400
    start = F.make_date(era.cast("int"), F.lit(1), F.lit(1))
    number = F.date_diff(when, start)
    symbols = F.array(F.floor(number / DAYS_OF_ERA[1]).cast("int"), (number % DAYS_OF_ERA[1]).cast("int"))
    new = _let(feistel(symbols, F.array(*map(F.lit, DAYS_OF_ERA)), "date", key),
               lambda s: F.date_add(start, F.get(s, F.lit(0)) * DAYS_OF_ERA[1] + F.get(s, F.lit(1))))
    return F.when(when.isNotNull() & (year.cast("int") > 0), _let(new, lambda d: shown(
        F.lpad(F.year(d).cast("string"), 4, "0"), F.lpad(F.month(d).cast("string"), 2, "0"), F.lpad(F.day(d).cast("string"), 2, "0")))).otherwise(value)


def _iso(value: Column, key: str) -> Column:
    return _date(value, key, F.substring(value, 1, 4), F.substring(value, 6, 2), F.substring(value, 9, 2), lambda y, m, d: F.concat_ws("-", y, m, d))


def _dmy(value: Column, key: str) -> Column:
    return _date(value, key, F.substring(value, 7, 4), F.substring(value, 4, 2), F.substring(value, 1, 2),
                 lambda y, m, d: F.concat(d, F.substring(value, 3, 1), m, F.substring(value, 6, 1), y))


def _ssn(value: Column, key: str) -> Column:
    parts = F.split(value, "-").cast("array<int>")
    area, group, serial = (F.get(parts, F.lit(i)) for i in range(3))
    good = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    symbols = F.array((area - 1 - F.when(area > 666, 1).otherwise(0)).cast("int"), group - 1, serial - 1)
    made = _let(feistel(symbols, F.array(*map(F.lit, SSN)), "ssn", key), lambda s: F.concat_ws(
        "-", F.lpad((F.get(s, F.lit(0)) + 1 + F.when(F.get(s, F.lit(0)) >= 665, 1).otherwise(0)).cast("string"), 3, "0"),
        F.lpad((F.get(s, F.lit(1)) + 1).cast("string"), 2, "0"), F.lpad((F.get(s, F.lit(2)) + 1).cast("string"), 4, "0")))
    return F.when(good, made).otherwise(value)


def _phone(value: Column, key: str) -> Column:
    country = F.regexp_extract(value, r"^\+\d{1,3}(?=\D)", 0)
    rest = F.substring(value, F.length(country) + 1, F.length(value))
    digits = _digits(rest)
    return F.concat(country, _refilled(rest, _text(feistel(digits, _radix(digits, 10), "phone", key)), "[0-9]"))


def _card(value: Column, key: str) -> Column:
    digits = _digits(value)
    payload = F.slice(digits, F.lit(1), F.size(digits) - 1)
    made = _let(feistel(payload, _radix(payload, 10), "card", key), lambda p: _refilled(
        value, _text(F.concat(p, F.array(F.pmod(-_luhn(F.concat(p, F.array(F.lit(0)))), F.lit(10)).cast("int")))), "[0-9]"))
    return F.when(_luhn(digits) % 10 == 0, made).otherwise(value)


_MAKERS = {"email": _email, "ip": _ip, "iban": _iban, "iso": _iso, "dmy": _dmy, "ssn": _ssn, "phone": _phone, "card": _card}


def pseudonym(value: Column, key: str = KEY) -> Column:
    """The pseudonym of one found value."""
    out = F.when(value.rlike(f"^(?:{PATTERNS['email']})$"), _email(value, key))
    for kind, make in list(_MAKERS.items())[1:]:
        out = out.when(value.rlike(f"^(?:{PATTERNS[kind]})$"), make(value, key))
    return out.otherwise(value)


def pseudonymised(docs: DataFrame, key: str = KEY) -> DataFrame:
    """The documents with their values replaced, and ``n_values``, the number of values replaced."""
    own = [c for c in docs.columns if c not in ("text", "n_values")]
    found, new = unused(docs.columns, "_found", "_new")
    # Pieces between the values and the values themselves alternate.
    rows = docs.select(*own, "text", F.when(F.col("text").rlike(HINT), F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).alias(found))
    rows = rows.select("*", F.when(F.size(found) > 0, F.transform(found, lambda v: pseudonym(v, key))).alias(new))
    filled = F.array_join(F.flatten(F.zip_with(F.split("text", ANY, -1), F.col(new), lambda piece, value: F.array(piece, F.coalesce(value, F.lit(""))))), "")
    changed = F.size(F.filter(F.zip_with(found, new, lambda a, b: a != b), lambda x: x))
    return rows.select(*own, F.when(F.col(new).isNotNull(), filled).otherwise(F.col("text")).alias("text"),
                       F.when(F.col(new).isNotNull(), changed).otherwise(0).cast("long").alias("n_values"))
