"""Format-preserving pseudonyms of personal numbers and dates, in DataFrame operations only.

Found values are validated (Luhn's check for card numbers, octets of addresses, calendar dates), then
permuted by a keyed Feistel network within their format: digits stay digits, letters keep their case,
separators stay in place, a card number stays valid, a date stays a date. One key gives one permutation
for all documents, so equal values stay linked, also where they are written with other separators.

The network adds, character by character, a stream from SHA-256 over key, format, round and the other
half, so each round can be undone and every format's values are permuted among themselves.

Formats that are not found and stay in the text: slash and dot dates with the month first (12/25/2024),
years outside 1900 to 2099 and one-digit days or months; card numbers with separators in groups other
than 4-4-4-4 (4-6-5); phones without a hyphen before the last four digits (555 123 4567, 555.123.4567)
or with groups other than 3-3-4.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Days from 1900-01-01 to 2099-12-31, the dates that are permuted.
DAYS = 73049

#: The shapes of values that are looked for. Validation follows.
SHAPES = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"(?<![0-9.])(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}(?![0-9]|\.[0-9])",
    "iso_date": r"(?<![0-9-])(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}(?![0-9]|-[0-9])",
    "slash_date": r"(?<![0-9/])[0-9]{2}/[0-9]{2}/(?:19|20)[0-9]{2}(?![0-9]|/[0-9])",
    "dot_date": r"(?<![0-9.])[0-9]{2}\.[0-9]{2}\.(?:19|20)[0-9]{2}(?![0-9]|\.[0-9])",
    "phone": r"(?:\+[0-9]{1,3}[ -]?)?(?:\([0-9]{3}\)[ -]?|(?<![0-9-])[0-9]{3}[ -])[0-9]{3}-[0-9]{4}(?![0-9]|-[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])",
    "card": r"(?<![0-9])(?:[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{13,19})(?![0-9])",
}
DATE_FORMS = {"iso_date": "yyyy-MM-dd", "slash_date": "dd/MM/yyyy", "dot_date": "dd.MM.yyyy"}


def _pattern() -> str:
    """All shapes as alternatives; the group of the card shape is the only one and is number 1."""
    return "|".join(f"(?:{SHAPES[k]})" for k in ("email", "ip", "iso_date", "slash_date", "dot_date", "phone", "ssn", "card"))


def _byte(stream: Column, i: Column) -> Column:
    return F.conv(F.substring(stream, F.lit(2) * (i % 32) + 1, F.lit(2)), 16, 10).cast("int")


def _shift(half: Column, stream: Column) -> Column:
    """Adds the stream to each digit (mod 10) and letter (mod 26); other characters stay."""

    def one(c: Column, i: Column) -> Column:
        code, s = F.ascii(c), _byte(stream, i)
        turn = lambda first, size: F.char(F.lit(first) + (code - first + s) % size)
        return F.when(c.rlike("^[0-9]$"), turn(48, 10)).when(c.rlike("^[a-z]$"), turn(97, 26)).when(c.rlike("^[A-Z]$"), turn(65, 26)).otherwise(c)

    return F.array_join(F.transform(F.split(half, ""), one), "")


def feistel(value: Column, kind: str, key: str) -> Column:
    """A keyed permutation of all strings that have the value's length and classes of characters."""
    cut = F.floor(F.length(value) / 2).cast("int")
    start = F.struct(F.substring(value, F.lit(1), cut).alias("a"), F.substring(value, cut + 1, F.length(value)).alias("b"))
    # Length and classes are part of what the stream depends on; both halves keep theirs.
    step = lambda acc, i: F.struct(acc["b"].alias("a"), _shift(acc["a"], F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), F.length(acc["a"]).cast("string"), acc["b"]), 256)).alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda acc: F.concat(acc["a"], acc["b"]))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _filled(form: Column, digits: Column) -> Column:
    """The form with its digits replaced, in order."""
    put = lambda c, i: F.when(c.rlike("^[0-9]$"), F.substring(digits, F.length(_digits(F.substring(form, F.lit(1), i + 1))), F.lit(1))).otherwise(c)
    return F.array_join(F.transform(F.split(form, ""), put), "")


def luhn_sum(digits: Column, doubled: int) -> Column:
    """Luhn's sum; places from the right whose number mod 2 is ``doubled`` count twice."""
    place = lambda c, i: F.when(i % 2 == doubled, F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int"))
    shown = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    return F.aggregate(F.transform(shown, place), F.lit(0), lambda a, b: a + b)


def _card(value: Column, key: str) -> Column:
    digits = _digits(value)
    body = feistel(F.substring(digits, F.lit(1), F.length(digits) - 1), "card", key)
    check = F.pmod(F.lit(10) - F.pmod(luhn_sum(body, 0), F.lit(10)), F.lit(10))
    return _filled(value, F.concat(body, check.cast("string")))


def _ip(value: Column, key: str) -> Column:
    """Octets are added modulo 256, two against two."""
    octets = F.transform(F.split(value, r"\."), lambda c: c.cast("int"))
    start = F.struct(F.slice(octets, 1, 2).alias("a"), F.slice(octets, 3, 2).alias("b"))

    def step(acc: Column, i: Column) -> Column:
        stream = F.sha2(F.concat_ws("|", F.lit(key), F.lit("ip"), i.cast("string"), F.array_join(F.transform(acc["b"], lambda x: x.cast("string")), ".")), 256)
        return F.struct(acc["b"].alias("a"), F.transform(acc["a"], lambda x, j: ((x + _byte(stream, j)) % 256).cast("int")).alias("b"))

    done = lambda acc: F.array_join(F.transform(F.concat(acc["a"], acc["b"]), lambda x: x.cast("string")), ".")
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, done)


def _date(value: Column, form: str, key: str) -> Column:
    """The day's number goes through the network on five digits until it is a day's number again."""
    first = F.to_date(F.lit("1900-01-01"))
    number = F.lpad(F.datediff(F.try_to_timestamp(value, F.lit(form)).cast("date"), first).cast("string"), 5, "0")
    walk = lambda acc, i: F.when((i == 0) | (acc.cast("int") >= DAYS), feistel(acc, "date", key)).otherwise(acc)
    day = F.aggregate(F.sequence(F.lit(0), F.lit(80)), number, walk)
    return F.date_format(F.date_add(first, day.cast("int")), form)


def kind_of(value: Column) -> Column:
    """The kind of a found value, null if it does not validate."""
    out = F.when(value.contains("@"), F.lit("email")).when(value.rlike(f"^(?:{SHAPES['ip']})$"), F.lit("ip"))
    for kind, form in DATE_FORMS.items():
        out = out.when(value.rlike(f"^(?:{SHAPES[kind]})$"), F.when(F.try_to_timestamp(value, F.lit(form)).isNotNull(), F.lit(kind)))
    out = out.when(value.rlike(f"^(?:{SHAPES['ssn']})$"), F.lit("ssn")).when(value.rlike(f"^(?:{SHAPES['phone']})$"), F.lit("phone"))
    return out.when(F.pmod(luhn_sum(_digits(value), 1), F.lit(10)) == 0, F.lit("card"))


def pseudonym(value: Column, key: str) -> Column:
    """The value's pseudonym; a value that does not validate stays."""
    kind = kind_of(value)
    at = F.locate("@", value)
    out = F.when(kind == "email", F.concat(feistel(F.substring(value, F.lit(1), at - 1), "email", key), F.substring(value, at, F.length(value))))
    out = out.when(kind == "ip", _ip(value, key)).when(kind == "card", _card(value, key))
    for k, form in DATE_FORMS.items():
        out = out.when(kind == k, _date(value, form, key))
    area = F.regexp_extract(value, r"^(\+[0-9]{1,3}[ -]?)", 1)  # a country code stays
    rest = F.substring(value, F.length(area) + 1, F.length(value))
    out = out.when(kind == "phone", F.concat(area, _filled(rest, feistel(_digits(rest), "phone", key))))
    return out.when(kind == "ssn", _filled(value, feistel(_digits(value), "ssn", key))).otherwise(value)


def pseudonymised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, key: str) -> DataFrame:
    """One row per input row: doc_id, text with pseudonyms, n_found, n_replaced, kinds (sorted, distinct).

    A null text stays null, with nothing found; a text without any value stays as it is. Repeated rows
    are treated one by one; an empty table gives an empty result; other columns are not read. n_found
    counts shapes, n_replaced those that validate; a number that fails its check stays as it is. Whoever
    has ``key`` can undo the pseudonyms, so it has no default and must not be empty.
    """
    if not key:
        raise ValueError("key must not be empty")
    pattern = _pattern()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("_text"))
    none = F.array().cast("array<string>")
    may = F.coalesce(F.col("_text").rlike("[0-9@]"), F.lit(False))
    rows = rows.withColumn("_found", F.when(may, F.regexp_extract_all("_text", F.lit(pattern), F.lit(0))).otherwise(none))
    rows = rows.withColumn("_new", F.transform("_found", lambda v: F.struct(pseudonym(v, key).alias("value"), kind_of(v).alias("kind"))))
    pieces = F.split(F.col("_text"), pattern, -1)
    joined = F.array_join(F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(F.get(F.col("_new.value"), i), F.lit("")))), "")
    text = F.when(F.size("_found") > 0, joined).otherwise(F.col("_text"))
    kinds = F.array_sort(F.array_distinct(F.filter(F.col("_new.kind"), lambda k: k.isNotNull())))
    changed = F.size(F.filter(F.col("_new.kind"), lambda k: k.isNotNull()))
    return rows.select("doc_id", text.alias("text"), F.size("_found").cast("long").alias("n_found"), changed.cast("long").alias("n_replaced"), kinds.alias("kinds"))
