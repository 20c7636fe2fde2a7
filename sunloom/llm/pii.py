r"""Format-preserving pseudonyms for personal numbers, dates and addresses.

Candidates are found by one pattern and validated: payment cards by length and Luhn sum,
telephone numbers by their number of digits, IPv4 addresses by their octets, dates by the
calendar, social security numbers by their area. A valid value is replaced by a keyed
permutation of itself within its format: a Feistel network of ``ROUNDS`` rounds in which
the halves of the symbols shift each other, each symbol within its own alphabet. Equal
values get equal pseudonyms in all documents, different values different ones, and the
pseudonym of a valid value is valid. Addresses that begin with 0 or with 224 and more, and
dates before 1900 and after 2099, are permuted among themselves. Mail addresses are permuted the same way in what
stands before the ``@``. Only built-in functions are used.
"""

from __future__ import annotations

from datetime import date
from math import ceil, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunloom.llm.words import aside

ROUNDS = 8
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: dates from the first day of one of these years to that of the next are permuted among themselves; the last range ends with 9999
YEARS = (1, 1900, 2100)

MAIL = r"(?<![\w.+-])[\w.+-]++@(?:[A-Za-z0-9-]++\.)+[A-Za-z]{2,}"
IPV4 = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d]|\.\d)"
ISO, DOTTED, SLASHED = r"(?<![\d-])\d{4}-\d{2}-\d{2}(?![\d-])", r"(?<![\d.])\d{2}\.\d{2}\.\d{4}(?![\d]|\.\d)", r"(?<![\d/])\d{2}/\d{2}/\d{4}(?![\d/])"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
PHONE = r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{4}(?![\d])|(?<![\d+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?![\d])"
CARD = r"(?<![\d-])\d(?:[ -]?\d){12,18}(?!-?\d)"
ANY = "|".join((MAIL, IPV4, ISO, DOTTED, SLASHED, SSN, CARD, PHONE))


def let(value: Column, body) -> Column:
    """``body`` of the value, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shift(key: str, turn: Column, place: Column, other: Column, radix: Column) -> Column:
    """Keyed number below ``radix`` from the other half, the round and the place."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), turn.cast("string"), place.cast("string"), F.array_join(F.transform(other, lambda x: x.cast("string")), ",")), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 13), 16, 10).cast("long"), radix.cast("long")).cast("int")


def feistel(symbols: Column, radices: Column, key: str) -> Column:
    """Permute an array of numbers (int), each below the radix of its place."""
    half = F.floor(F.size(symbols) / 2).cast("int")

    def moved(a: Column, ra: Column, b: Column, turn: Column) -> Column:
        return F.transform(a, lambda x, i: F.pmod(x + shift(key, turn, i, b, F.get(ra, i)), F.get(ra, i)).cast("int"))

    start = F.struct(
        F.slice(symbols, F.lit(1), half).alias("a"), F.slice(symbols, half + 1, F.size(symbols)).alias("b"),
        F.slice(radices, F.lit(1), half).alias("ra"), F.slice(radices, half + 1, F.size(radices)).alias("rb"),
    )
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)), start,
        lambda s, turn: F.struct(
            F.when(turn % 2 == 1, moved(s["a"], s["ra"], s["b"], turn)).otherwise(s["a"]).alias("a"),
            F.when(turn % 2 == 0, moved(s["b"], s["rb"], s["a"], turn)).otherwise(s["b"]).alias("b"),
            s["ra"].alias("ra"), s["rb"].alias("rb"),
        ),
        lambda s: F.concat(s["a"], s["b"]),
    )


def chars(value: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(value)), lambda i: F.substr(value, i, F.lit(1)))


def permuted_text(value: Column, key: str) -> Column:
    """Letters move within their case and digits within digits; all else stands.

    The first digit of a run stays between 1 and 9, or 0, as it was.
    """
    def symbol(c: Column, before: Column) -> Column:
        digit, first = c.rlike("[0-9]"), ~F.coalesce(before.rlike("[0-9]"), F.lit(False))
        kind = F.when(digit & first & (c == "0"), "x").when(digit & first, "n").when(digit, "d").when(c.rlike("[a-z]"), "l").when(c.rlike("[A-Z]"), "u").otherwise("x")
        return let(kind, lambda k: F.struct(
            c.alias("c"), k.alias("k"),
            F.when(k == "n", F.position(c, F.lit(DIGITS)) - 2).when(k == "d", F.position(c, F.lit(DIGITS)) - 1)
            .when(k == "l", F.position(c, F.lit(LOWER)) - 1).when(k == "u", F.position(c, F.lit(UPPER)) - 1).otherwise(0).cast("int").alias("s"),
            F.when(k == "n", 9).when(k == "d", 10).when(k.isin("l", "u"), 26).otherwise(1).cast("int").alias("r"),
        ))

    def back(x: Column, n: Column) -> Column:
        one = F.lit(1)
        return (
            F.when(x["k"] == "n", F.substr(F.lit(DIGITS), n + 2, one)).when(x["k"] == "d", F.substr(F.lit(DIGITS), n + 1, one))
            .when(x["k"] == "l", F.substr(F.lit(LOWER), n + 1, one)).when(x["k"] == "u", F.substr(F.lit(UPPER), n + 1, one)).otherwise(x["c"])
        )

    coded = let(chars(value), lambda cs: F.transform(cs, lambda c, i: symbol(c, F.get(cs, i - 1))))
    return let(coded, lambda xs: F.array_join(F.zip_with(xs, feistel(F.transform(xs, lambda x: x["s"]), F.transform(xs, lambda x: x["r"]), key), back), ""))


def luhn_sum(digits: Column, doubled_from_right: int) -> Column:
    """Sum of a digit string with every second digit doubled, counted from the right from 0."""
    def part(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == doubled_from_right, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.transform(F.reverse(chars(digits)), part), F.lit(0), lambda s, x: s + x)


def card(value: Column, key: str) -> Column:
    """The first digit stays, those up to the last are permuted, the last makes the sum right."""
    def renewed(digits: Column) -> Column:
        inner = F.transform(chars(F.substr(digits, F.lit(2), F.length(digits) - 2)), lambda c: c.cast("int"))
        moved = let(inner, lambda d: feistel(d, F.transform(d, lambda _: F.lit(10)), key))
        payload = F.concat(F.substr(digits, F.lit(1), F.lit(1)), F.array_join(F.transform(moved, lambda x: x.cast("string")), ""))
        return let(payload, lambda p: F.concat(p, F.pmod(-luhn_sum(p, 0), F.lit(10)).cast("string")))

    def written(new: Column) -> Column:
        place = lambda i: F.length(F.regexp_replace(F.substr(value, F.lit(1), i), "[^0-9]", ""))
        return F.array_join(F.transform(chars(value), lambda c, i: F.when(c.rlike("[0-9]"), F.substr(new, place(i + 1), F.lit(1))).otherwise(c)), "")

    return let(F.regexp_replace(value, "[^0-9]", ""), lambda d: F.when(luhn_sum(d, 1) % 10 == 0, let(renewed(d), written)))


def ipv4(value: Column, key: str) -> Column:
    """The first octet stays 0, between 1 and 223, or from 224 on, as it was."""
    def renewed(o: Column) -> Column:
        first = F.get(o, F.lit(0))
        low = F.when(first == 0, 0).when(first < 224, 1).otherwise(224)
        radices = F.array(F.when(first == 0, 1).when(first < 224, 223).otherwise(32), *(F.lit(256) for _ in range(3)))
        moved = feistel(F.transform(o, lambda x, i: x - F.when(i == 0, low).otherwise(0)), radices, key)
        return F.array_join(F.transform(moved, lambda x, i: (x + F.when(i == 0, low).otherwise(0)).cast("string")), ".")

    return let(F.transform(F.split(value, "\\."), lambda x: x.cast("int")), lambda o: F.when(~F.exists(o, lambda x: x > 255), renewed(o)))


def calendar_day(value: Column, form: str, key: str) -> Column:
    bounds = [date(year, 1, 1).toordinal() - 1 for year in YEARS] + [date.max.toordinal()]

    def spread(start: int, stop: int) -> Column:
        half = ceil(sqrt(stop - start))
        return F.struct(F.lit(start).alias("start"), F.lit(stop - start).alias("days"), F.lit(ceil((stop - start) / half)).alias("rows"), F.lit(half).alias("half"))

    def renewed(d: Column, r: Column) -> Column:
        def once(day: Column) -> Column:
            new = feistel(F.array(F.floor(day / r["half"]).cast("int"), (day % r["half"]).cast("int")), F.array(r["rows"], r["half"]), key)
            return let(new, lambda n: F.get(n, F.lit(0)) * r["half"] + F.get(n, F.lit(1)))

        # a number past the last day is permuted again until it is a day; at most 1 in 600 is past it
        inside = F.aggregate(F.sequence(F.lit(1), F.lit(40)), once(d - r["start"]), lambda x, _: F.when(x < r["days"], x).otherwise(once(x)))
        return F.date_format(F.date_add(epoch, r["start"] + inside), form)

    epoch = F.lit("0001-01-01").cast("date")
    ranges = [spread(*x) for x in zip(bounds[:-1], bounds[1:], strict=True)]
    day = F.datediff(F.to_date(F.try_to_timestamp(value, F.lit(form))), epoch)
    of = lambda d: F.when(d < bounds[1], ranges[0]).when(d < bounds[2], ranges[1]).otherwise(ranges[2])
    return let(day, lambda d: F.when((d >= 0) & (d < bounds[-1]), let(of(d), lambda r: renewed(d, r))))


def ssn(value: Column, key: str) -> Column:
    def number(at: int, size: int) -> Column:
        return F.substring(value, at, size).cast("int")

    area = number(1, 3)
    valid = (area >= 1) & (area <= 899) & (area != 666) & (number(5, 2) > 0) & (number(8, 4) > 0)
    symbols = F.array(area - F.when(area > 666, 2).otherwise(1), number(5, 2) - 1, number(8, 4) - 1)
    made = let(feistel(symbols, F.array(F.lit(898), F.lit(99), F.lit(9999)), key), lambda n: F.concat_ws(
        "-", F.lpad((F.get(n, F.lit(0)) + F.when(F.get(n, F.lit(0)) >= 665, 2).otherwise(1)).cast("string"), 3, "0"),
        F.lpad((F.get(n, F.lit(1)) + 1).cast("string"), 2, "0"), F.lpad((F.get(n, F.lit(2)) + 1).cast("string"), 4, "0")))
    return F.when(valid, made)


def phone(value: Column, key: str) -> Column:
    """The country code stays."""
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    country = F.regexp_extract(value, r"^\+\d{1,3}(?=[^\d])", 0)
    return F.when(digits.between(8, 15), let(country, lambda c: F.concat(c, permuted_text(F.substr(value, F.length(c) + 1, F.length(value)), key))))


def mail(value: Column, key: str) -> Column:
    return F.concat(permuted_text(F.substring_index(value, "@", 1), key), F.lit("@"), F.substring_index(value, "@", -1))


def pseudonym(value: Column, key: str) -> Column:
    """Pseudonym of a candidate, null where it is not valid."""
    def is_(pattern: str) -> Column:
        return value.rlike(f"^(?:{pattern})$")

    return (
        F.when(F.contains(value, F.lit("@")), mail(value, key)).when(is_(IPV4), ipv4(value, key))
        .when(is_(ISO), calendar_day(value, "yyyy-MM-dd", key)).when(is_(DOTTED), calendar_day(value, "dd.MM.yyyy", key)).when(is_(SLASHED), calendar_day(value, "MM/dd/yyyy", key))
        .when(is_(SSN), ssn(value, key)).when(is_(CARD), card(value, key)).otherwise(phone(value, key))
    )


def pseudonymise(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    """All columns of all rows, the text with pseudonyms, and ``n_private`` (long), how many.

    Null stays null with 0; texts without a candidate stay as they are. Each row stands
    alone, so ties and repeated rows need no rule; a very long text is one row's work. An
    input column n_private is left out; an empty table gives no rows.
    """
    docs, named = aside(docs, [column], ["n_private"])
    text = F.col(f"`{column}`")
    may = text.rlike("[0-9@]")
    df = docs.withColumn("_found", F.when(may, F.regexp_extract_all(text, F.lit(ANY), 0)))
    df = df.withColumn("_new", F.transform("_found", lambda v: pseudonym(v, key)))
    joined = F.array_join(F.flatten(F.zip_with(F.split(text, ANY, -1), F.zip_with("_new", "_found", lambda a, b: F.coalesce(a, b)), lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    df = df.withColumn("_text", F.when(F.size("_found") > 0, joined).otherwise(text))
    df = df.withColumn("n_private", F.coalesce(F.size(F.filter("_new", lambda x: x.isNotNull())), F.lit(0)).cast("long"))
    return named(df.withColumn("n_private", F.greatest("n_private", F.lit(0))).withColumn(column, F.col("_text")))
