"""Format-preserving pseudonyms for personal data, in built-in expressions only.

Candidates are found by one pattern and validated by kind. What is valid is permuted by a keyed Feistel network within its own format:

- strings of digits, letters or hexadecimal digits (phone and card numbers, social security numbers, names before an @, secret tokens): two halves
  take turns; every character of one half moves within its own alphabet by an amount taken from a keyed hash of the other half. Separators stay.
  A card number keeps its length and gets the check digit of its new digits.
- IPv4 addresses: two halves of 16 bits.
- calendar dates: the day within its 400-year cycle, as a pair from 189 x 773 = 146097 days.

Each is a bijection of its format that depends on the key and the kind only, so equal values stay linked across documents and different values
stay different. Whoever holds the key can invert it; without the key it is as strong as the hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qassay.functions.text import bind

ROUNDS = 6
# The formats, each beginning where no character of its own kind stands before it.
FORMATS = {
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]{1,64}+@[\p{L}\p{N}\-]{1,63}+(?:\.[\p{L}\p{N}\-]{1,63}+)+",
    "secret": r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,64}+(?![0-9A-Za-z])",
    "phone": r"(?<![0-9])(?:\+[0-9]{1,3}[ .\-]?)?(?:\([0-9]{3}\)[ .\-]?|[0-9]{3}[.\-])[0-9]{3}[.\-][0-9]{4}(?![0-9\-])",
    "ssn": r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])",
    "date": r"(?<![0-9\-.])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9\-])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}+|[0-9]{4}(?:[ \-][0-9]{4}){3})(?![0-9])",
}
PATTERN = "|".join(FORMATS.values())


def _hash(key: str, kind: str, turn: Column, value: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), value), 256)


def _amount(digest: Column, at: Column) -> Column:
    """A number of 16 bits from the digest, whose places repeat after 16."""
    return F.conv(F.substring(digest, F.pmod(at, F.lit(16)) * 4 + 1, F.lit(4)), 16, 10).cast("int")


def _moved(char: Column, amount: Column, hexadecimal: bool) -> Column:
    """The character moved within its alphabet: digits, lower or upper case letters, or hexadecimal digits; others stay."""
    code = F.ascii(char)

    def within(first: int, size: int) -> Column:
        return F.char((F.pmod(code - first + amount, F.lit(size)) + first).cast("int"))

    if hexadecimal:
        value = F.pmod(F.conv(char, 16, 10).cast("int") + amount, F.lit(16))
        return F.lower(F.conv(value.cast("string"), 10, 16))
    ascii_only = F.length(char) == F.octet_length(char)
    alphabets = F.when(code.between(48, 57), within(48, 10)).when(code.between(97, 122), within(97, 26)).when(code.between(65, 90), within(65, 26))
    return F.when(ascii_only, F.coalesce(alphabets.otherwise(char), char)).otherwise(char)


def string_feistel(value: Column, key: str, kind: str, hexadecimal: bool = False) -> Column:
    """Each character moved within its alphabet; length, separators and characters beyond ASCII stay."""

    def network(chars: Column) -> Column:
        middle = F.ceil(F.size(chars) / 2).cast("int")
        start = F.struct(F.slice(chars, 1, middle).alias("a"), F.slice(chars, middle + 1, F.size(chars) - middle).alias("b"))

        def turn(s: Column, n: Column) -> Column:
            moved = bind(_hash(key, kind, n, F.array_join(s["b"], "")), lambda d: F.transform(s["a"], lambda c, i: _moved(c, _amount(d, i), hexadecimal)))
            return F.struct(s["b"].alias("a"), moved.alias("b"))

        turns = F.array(*[F.lit(n) for n in range(ROUNDS)])
        return F.aggregate(turns, start, turn, lambda s: F.array_join(F.concat(s["a"], s["b"]), ""))

    return bind(F.split(value, ""), network)


def pair_feistel(value: Column, key: str, kind: str, high: int, low: int) -> Column:
    """Permutation of 0 ... high * low - 1, as pairs of numbers below high and low that take turns."""
    start = F.struct(F.floor(value / low).cast("long").alias("a"), F.pmod(value, F.lit(low)).cast("long").alias("b"))

    def turn(s: Column, n: Column) -> Column:
        def by(other: Column) -> Column:
            return F.conv(F.substring(_hash(key, kind, n, other.cast("string")), 1, 12), 16, 10).cast("long")

        even = n % 2 == 0
        a = F.when(even, F.pmod(s["a"] + by(s["b"]), F.lit(high).cast("long"))).otherwise(s["a"])
        b = F.when(even, s["b"]).otherwise(F.pmod(s["b"] + by(s["a"]), F.lit(low).cast("long")))
        return F.struct(a.alias("a"), b.alias("b"))

    return F.aggregate(F.array(*[F.lit(n) for n in range(ROUNDS)]), start, turn, lambda s: s["a"] * low + s["b"])


def luhn_sum(digits: Column, check_last: bool) -> Column:
    """Weighted digit sum; with check_last the last digit is the check digit, else the check digit is still to come."""
    first = 0 if check_last else 1

    def weighted(c: Column, i: Column) -> Column:
        d = F.try_to_number(c, F.lit("9")).cast("int")
        double = (i + first) % 2 == 1
        return F.when(double, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.transform(F.reverse(F.split(digits, "")), weighted), F.lit(0), lambda s, x: s + x)


def _card(span: Column, key: str) -> Column:
    def rebuilt(body: Column) -> Column:
        check = F.pmod(10 - luhn_sum(F.regexp_replace(body, "[ -]", ""), False) % 10, F.lit(10))
        return F.concat(body, check.cast("string"))

    valid = luhn_sum(F.regexp_replace(span, "[ -]", ""), True) % 10 == 0
    return F.when(valid, bind(string_feistel(F.substring(span, F.lit(1), F.length(span) - 1), key, "card"), rebuilt)).otherwise(span)


def _ip(span: Column, key: str) -> Column:
    def moved(parts: Column) -> Column:
        number = F.aggregate(parts, F.lit(0).cast("long"), lambda s, x: s * 256 + x)
        back = bind(pair_feistel(number, key, "ip", 65536, 65536), lambda v: F.concat_ws(".", *[F.pmod(F.floor(v / (256**p)), F.lit(256)).cast("string") for p in (3, 2, 1, 0)]))
        return F.when(F.exists(parts, lambda x: x > 255), span).otherwise(back)

    return bind(F.transform(F.split(span, r"\."), lambda x: x.cast("long")), moved)


def _date(span: Column, key: str) -> Column:
    def part(pattern: str) -> Column:
        return F.regexp_extract(span, pattern, 1).try_cast("int")

    iso, dotted = span.substr(5, 1) == "-", span.substr(3, 1) == "."
    year = F.when(iso, part(r"^([0-9]{4})")).otherwise(part(r"([0-9]{4})$"))
    first, second = part(r"^([0-9]{2})"), part(r"^[0-9]{2}.([0-9]{2})")
    month = F.when(iso, part(r"^[0-9]{4}-([0-9]{2})")).when(dotted, second).otherwise(first)
    day = F.when(iso, part(r"([0-9]{2})$")).when(dotted, first).otherwise(second)

    def moved(p: Column) -> Column:
        y, m, d = p["y"], p["m"], p["d"]
        leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
        days = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
        valid = (y >= 1) & m.between(1, 12) & (d >= 1) & (d <= days)
        cycle = F.make_date((F.floor(y / 400) * 400).cast("int"), F.lit(1), F.lit(1))
        new = F.date_add(cycle, pair_feistel(F.date_diff(F.make_date(y, m, d), cycle).cast("long"), key, "date", 189, 773).cast("int"))
        return F.when(valid, bind(new, lambda date: _written(date, iso, dotted))).otherwise(span)

    return bind(F.struct(year.alias("y"), month.alias("m"), day.alias("d")), moved)


def _written(date: Column, iso: Column, dotted: Column) -> Column:
    year, month, day = F.lpad(F.year(date).cast("string"), 4, "0"), F.lpad(F.month(date).cast("string"), 2, "0"), F.lpad(F.dayofmonth(date).cast("string"), 2, "0")
    return F.when(iso, F.concat_ws("-", year, month, day)).when(dotted, F.concat_ws(".", day, month, year)).otherwise(F.concat_ws("/", month, day, year))


def kind_of(span: Column) -> Column:
    """Which format a match has, in the order of FORMATS."""
    kinds = F.when(span.contains("@"), "email").when(span.rlike(r"^[0-9A-Fa-f]{32,64}$"), "secret")
    kinds = kinds.when(span.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn").when(span.rlike(r"^([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})$"), "date")
    return kinds.when(span.rlike(r"^([0-9]{1,3}\.){3}[0-9]{1,3}$"), "ip").when(span.rlike(r"^([0-9]{13,19}|[0-9]{4}([ -][0-9]{4}){3})$"), "card").otherwise("phone")


def pseudonym(span: Column, key: str) -> Column:
    """The replacement of a match; itself if it is not valid."""
    kind, code = kind_of(span), F.regexp_extract(span, r"^\+[0-9]{1,3}(?=[ .(-])", 0)
    local = F.regexp_extract(span, r"^([^@]*)@", 1)
    secret = string_feistel(F.lower(span), key, "secret", hexadecimal=True)  # a number, so its case is no part of it
    return (
        F.when(kind == "email", F.concat(string_feistel(local, key, "email"), F.substring(span, F.length(local) + 1, F.length(span))))
        .when(kind == "secret", F.when(span.rlike("[A-F]") & ~span.rlike("[a-f]"), F.upper(secret)).otherwise(secret))
        .when(kind == "ssn", string_feistel(span, key, "ssn"))
        .when(kind == "date", _date(span, key))
        .when(kind == "ip", _ip(span, key))
        .when(kind == "card", _card(span, key))
        .otherwise(F.concat(code, string_feistel(F.substring(span, F.length(code) + 1, F.length(span)), key, "phone")))
    )


def pseudonymise(docs: DataFrame, key: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, text with its valid personal data replaced, found (kind, value, replacement in order of the text).

    Null texts stay null and empty ones empty, with nothing found. Every match of a whole text counts; equal values get equal replacements
    everywhere, so repeated rows stay equal. Values that fail validation (check digit, octet, calendar) stay as they are and are not listed. Other
    columns are not looked at, and an empty table gives an empty result.
    """
    if not key:
        raise ValueError("a key is needed")
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    none = F.expr("cast(array() as array<string>)")
    matches = F.when(F.col("text").rlike("[0-9@]"), F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))).otherwise(none)
    own = own.withColumn("_matches", F.coalesce(matches, none))
    changed = F.transform("_matches", lambda m: F.struct(kind_of(m).alias("kind"), m.alias("value"), pseudonym(m, key).alias("replacement")))
    own = own.withColumn("_changed", changed)
    between = F.split("text", PATTERN, -1)
    whole = F.array_join(F.zip_with(between, F.concat("_changed", F.array(F.lit(None))), lambda a, b: F.concat(a, F.coalesce(b["replacement"], F.lit("")))), "")
    found = F.filter("_changed", lambda x: x["replacement"] != x["value"])
    return own.select("doc_id", F.when(F.size(found) > 0, whole).otherwise(F.col("text")).alias("text"), found.alias("found"))
