"""Personal data to format-preserving Feistel pseudonyms, in DataFrame functions only.

A value is found by its pattern, validated, and its number permuted by a keyed Feistel network within its own format:

* card numbers (13 to 19 digits that pass the Luhn test): all digits but the last are permuted, the check digit follows.
  In a run of numbers joined by single blanks, dashes, or dots between groups of four, any neighbours that make up such a number are one, the longest
  first and the earlier on ties, so a security code or an expiry beside a card does not hide it;
* phone numbers with a country code: the digits after the code are permuted, punctuation stays;
* social security numbers (ddd-dd-dddd, valid groups): permuted until valid again;
* IPv4 addresses: all four octets as one 32-bit number;
* dates (yyyy-mm-dd, dd/mm/yyyy, dd.mm.yyyy) from 1900 to 2099: the day number is permuted within those years;
* the local part of e-mail addresses: letters among letters, digits among digits, each place shifted by a keyed digest.

Equal values, however they are punctuated, get equal pseudonyms in all documents under one key, and different values of
a kind different ones, since a Feistel network is a permutation. Values that fail their test stay as they are. Null
texts stay null; everything else in a text is left untouched, and nothing is cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

ROUNDS = 8
#: Times a permuted number outside its domain is permuted again; each has less than a share of 0.35 outside.
WALKS = 40
KEY = "fairlead"

# The patterns, most specific first. A number is no part of a longer one.
_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
_IP = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\d]|\.\d)"
_DATE = r"(?<![\d./-])(?:(?:19|20)\d\d-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([/.])(?:0[1-9]|1[0-2])\1(?:19|20)\d\d)(?![\d/-])"
_SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
_PHONE = r"(?<![\d+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,3}(?!\d)"
# A whole run of numbers of 13 digits or more, up to where another kind of value starts; cards are sought in it.
# Dots part groups of four digits only, so that decimal numbers side by side are no run; a dot or dash before the first
# digit belongs to the number only if a digit is before it.
_MARK = r"(?:[ -]|(?<=\d{4})\.(?=\d{4}))"
_CARD = rf"(?<![\d+])(?<!\d[.-])(?=\d(?:{_MARK}?\d){{12}})\d++(?:{_MARK}(?!{_EMAIL}|{_IP}|{_SSN}|{_DATE.replace('([/.])', '(?:[/.])').replace(chr(92) + '1', '[/.]')})\d++)*+"
PATTERN = f"{_EMAIL}|{_IP}|{_DATE}|{_SSN}|{_PHONE}|{_CARD}"
_FIRST_DAY, _DAYS = "1900-01-01", 73049


def _digest(key: str, *parts: Column) -> Column:
    """A keyed 52-bit number of the parts."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts]), 256), 1, 13), 16, 10).cast("long")


def feistel(number: Column, high: Column, low: Column, key: str, tag: Column) -> Column:
    """A permutation of 0 .. high * low - 1 for long columns, keyed by ``key`` and ``tag``: halves of radix ``high`` and
    ``low`` are shifted in turn by digests of one another."""
    step = lambda s, i: F.when(
        i % 2 == 0, F.struct(F.pmod(s["a"] + _digest(key, tag, i, s["b"]), high).alias("a"), s["b"].alias("b"))
    ).otherwise(F.struct(s["a"].alias("a"), F.pmod(s["b"] + _digest(key, tag, i, s["a"]), low).alias("b")))
    start = F.struct(F.call_function("div", number, low).cast("long").alias("a"), F.pmod(number, low).cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: s["a"] * low + s["b"])


def _power(digits: Column) -> Column:
    return F.element_at(F.array(*[F.lit(10**i) for i in range(19)]), (digits + 1).cast("int"))


def permute_digits(digits: Column, key: str, tag: str) -> Column:
    """A permutation of the digit strings of each length (1 to 18)."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    number = feistel(digits.cast("long"), _power(n - half), _power(half), key, F.concat(F.lit(f"{tag}/"), n.cast("string")))
    return F.lpad(number.cast("string"), n, "0")


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string that ends just before the check digit."""
    n = F.length(digits)
    value = lambda i: F.substr(digits, i, F.lit(1)).cast("int")
    term = lambda i: F.when((n - i) % 2 == 0, F.floor(value(i) * 2 / 10).cast("int") + value(i) * 2 % 10).otherwise(value(i))
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + term(i))


def check_digit(digits: Column) -> Column:
    return ((10 - _luhn_sum(digits) % 10) % 10).cast("string")


def _refill(shape: Column, digits: Column, skip: Column | int = 0) -> Column:
    """``shape`` with its digits after the first ``skip`` replaced, in order, by ``digits``."""
    skip = F.lit(skip) if isinstance(skip, int) else skip
    start = F.struct(F.lit("").alias("done"), F.lit(0).alias("seen"))
    is_digit = lambda c: c.rlike("[0-9]")
    step = lambda s, c: F.struct(
        F.concat(s["done"], F.when(is_digit(c) & (s["seen"] >= skip), F.substr(digits, (s["seen"] - skip + 1).cast("int"), F.lit(1))).otherwise(c)).alias("done"),
        F.when(is_digit(c), s["seen"] + 1).otherwise(s["seen"]).alias("seen"),
    )
    return F.aggregate(F.split(shape, ""), start, step, lambda s: s["done"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def card_pseudonym(value: Column, key: str) -> Column:
    digits = _digits(value)
    body = F.substr(digits, F.lit(1), F.length(digits) - 1)
    # A value that fails the Luhn test is no card number.
    valid = check_digit(body) == F.right(digits, F.lit(1))
    fresh = permute_digits(body, key, "card")
    return F.when(valid, _refill(value, F.concat(fresh, check_digit(fresh)))).otherwise(value)


def card_parts(run: Column) -> Column:
    """The pieces of a run of numbers, in order, as array of (text, is it a card): every number that is 13 to 19 digits of
    whole neighbours and passes the Luhn test, longest first, none overlapping another."""
    # Each step binds its columns once, as variables of a lambda over one value.
    let = lambda value, body: F.transform(F.array(value), body)[0]
    text = lambda groups, i, j: F.array_join(F.slice(groups, i, j - i + 1), "")

    def of(groups, marks):
        n = F.size(groups)
        # Every group has a digit, so no number spans more than 19 groups.
        spans = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(i, F.least(n, i + 18)), lambda j: F.struct(text(groups, i, j).alias("digits"), i.alias("i"), j.alias("j")))))
        sized = F.filter(spans, lambda x: F.length(x["digits"]).between(13, 19))
        passed = F.filter(sized, lambda x: check_digit(F.substr(x["digits"], F.lit(1), F.length(x["digits"]) - 1)) == F.right(x["digits"], F.lit(1)))
        ranked = F.array_sort(F.transform(passed, lambda x: F.struct((-F.length(x["digits"])).alias("size"), x["i"].alias("i"), x["j"].alias("j"))))
        none = F.array().cast("array<struct<size:int,i:int,j:int>>")
        chosen = F.aggregate(ranked, none, lambda s, x: F.when(F.exists(s, lambda y: (x["i"] <= y["j"]) & (y["i"] <= x["j"])), s).otherwise(F.concat(s, F.array(x))))
        shown = lambda i, j: F.array_join(F.transform(F.sequence(i, j), lambda k: F.concat(groups[k - 1], F.when(k < j, marks[k - 1]).otherwise(""))), "")
        pieces = lambda cards: F.flatten(
            F.transform(
                F.sequence(F.lit(1), n),
                lambda k: let(
                    F.filter(cards, lambda c: (c["i"] <= k) & (k <= c["j"])),
                    lambda here: F.when((F.size(here) > 0) & (F.get(here, F.lit(0))["j"] > k), F.array().cast("array<struct<text:string,card:boolean>>")).otherwise(
                        F.array(
                            F.struct(F.when(F.size(here) > 0, shown(F.get(here, F.lit(0))["i"], k)).otherwise(groups[k - 1]).alias("text"), (F.size(here) > 0).alias("card")),
                            F.struct(F.coalesce(F.get(marks, k - 1), F.lit("")).alias("text"), F.lit(False).alias("card")),
                        )
                    ),
                ),
            )
        )
        return let(chosen, pieces)

    return let(F.regexp_extract_all(run, F.lit("[0-9]+"), F.lit(0)), lambda groups: let(F.regexp_extract_all(run, F.lit("[ .-]"), F.lit(0)), lambda marks: of(groups, marks)))


def phone_pseudonym(value: Column, key: str) -> Column:
    digits = _digits(value)
    # The country code ends at the first mark, or after one digit where there is none.
    marked = F.regexp_extract(value, r"^\+(\d{1,3})[ .(-]", 1)
    code = F.when(F.length(marked) > 0, F.length(marked)).otherwise(1)
    rest = F.substr(digits, code + 1, F.length(digits))
    return F.when(F.length(rest).between(4, 18), _refill(value, permute_digits(rest, key, "phone"), code)).otherwise(value)


def ip_pseudonym(value: Column, key: str) -> Column:
    octets = F.split(value, r"\.")
    number = F.aggregate(octets, F.lit(0).cast("long"), lambda s, o: s * 256 + o.cast("long"))
    fresh = feistel(number, F.lit(65536), F.lit(65536), key, F.lit("ip"))
    part = lambda k: F.pmod(F.floor(fresh / (1 << k)).cast("long"), F.lit(256)).cast("string")
    return F.concat_ws(".", part(24), part(16), part(8), part(0))


def _walk(number: Column, inside, high: int, low: int, key: str, tag: str) -> Column:
    """Permutes again while the result is outside the domain, which makes a permutation of the domain itself."""
    once = lambda x: feistel(x, F.lit(high), F.lit(low), key, F.lit(tag))
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), once(number), lambda s, _: F.when(inside(s), s).otherwise(once(s)))


def date_pseudonym(value: Column, key: str) -> Column:
    iso = value.rlike(r"^\d{4}-")
    mark = F.when(iso, F.lit("-")).otherwise(F.substring(value, 3, 1))
    day = F.coalesce(F.try_to_date(value, "yyyy-MM-dd"), F.try_to_date(F.translate(value, "/.", "--"), "dd-MM-yyyy"))
    fresh = _walk(F.datediff(day, F.lit(_FIRST_DAY)).cast("long"), lambda n: n < _DAYS, 271, 270, key, "date")
    new = F.date_add(F.lit(_FIRST_DAY).cast("date"), fresh.cast("int"))
    shown = F.when(iso, F.date_format(new, "yyyy-MM-dd")).otherwise(F.concat_ws("", F.date_format(new, "dd"), mark, F.date_format(new, "MM"), mark, F.date_format(new, "yyyy")))
    # A day that no calendar has, such as 31 April, is no date.
    return F.when(day.isNull(), value).otherwise(shown)


def ssn_pseudonym(value: Column, key: str) -> Column:
    area = lambda n: F.floor(n / 1_000_000).cast("long")
    inside = lambda n: (area(n) > 0) & (area(n) < 900) & (area(n) != 666) & (F.pmod(F.floor(n / 10_000).cast("long"), F.lit(100)) > 0) & (F.pmod(n, F.lit(10_000)) > 0)
    number = _digits(value).cast("long")
    fresh = _walk(number, inside, 31_623, 31_623, key, "ssn")
    # The network's domain is a little larger than nine digits; area < 900 keeps the walk inside them.
    return F.when(inside(number), _refill(value, F.lpad(fresh.cast("string"), F.lit(9), "0"))).otherwise(value)


def email_pseudonym(value: Column, key: str) -> Column:
    at = F.instr(value, "@")
    local, rest = F.substr(value, F.lit(1), at - 1), F.substr(value, at, F.length(value))
    small, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    whole = F.lower(value)
    n = F.length(local)
    # A two-part unbalanced network over places: each half is shifted by digests of the other half.
    shift = lambda text, other, r: F.concat_ws(
        "",
        F.transform(
            F.split(text, ""),
            lambda c, i: F.when(c.rlike("[a-z]"), F.substr(F.lit(small), (F.pmod(F.instr(F.lit(small), c) - 1 + _digest(key, F.lit(f"mail/{r}"), F.length(text), i, other), F.lit(26)) + 1).cast("int"), F.lit(1)))
            .when(c.rlike("[0-9]"), F.substr(F.lit(digits), (F.pmod(F.instr(F.lit(digits), c) - 1 + _digest(key, F.lit(f"mail/{r}"), F.length(text), i, other), F.lit(10)) + 1).cast("int"), F.lit(1)))
            .otherwise(c),
        ),
    )
    half = F.greatest(F.floor(n / 2).cast("int"), F.lit(1))
    domain = F.substr(whole, at, F.length(value))
    start = F.struct(F.substr(F.lower(local), F.lit(1), half).alias("a"), F.substr(F.lower(local), half + 1, n).alias("b"))
    step = lambda s, i: F.when(i % 2 == 0, F.struct(shift(s["a"], F.concat(i.cast("string"), s["b"], domain), "a").alias("a"), s["b"].alias("b"))).otherwise(F.struct(s["a"].alias("a"), shift(s["b"], F.concat(i.cast("string"), s["a"], domain), "b").alias("b")))
    fresh = F.aggregate(F.sequence(F.lit(0), F.lit(3)), start, step, lambda s: F.concat(s["a"], s["b"]))
    return F.concat(fresh, rest)


def kind_of(value: Column) -> Column:
    return (
        F.when(F.instr(value, "@") > 0, "email")
        .when(value.rlike(r"^(?:\d{1,3}\.){3}\d{1,3}$"), "ip")
        .when(value.rlike(r"^(?:\d{4}-\d\d-\d\d|\d\d([/.])\d\d\1\d{4})$"), "date")
        .when(value.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(value.startswith("+"), "phone")
        .otherwise("card")
    )


def pseudonym(value: Column, key: str = KEY) -> Column:
    kind = kind_of(value)
    return (
        F.when(kind == "email", email_pseudonym(value, key))
        .when(kind == "ip", ip_pseudonym(value, key))
        .when(kind == "date", date_pseudonym(value, key))
        .when(kind == "ssn", ssn_pseudonym(value, key))
        .when(kind == "phone", phone_pseudonym(value, key))
        .otherwise(card_pseudonym(value, key))
    )


def pseudonymise(documents: DataFrame, key: str = KEY, text: str = "text") -> DataFrame:
    """``documents`` with ``text`` rewritten, and ``found``: array of (kind, value, pseudonym) in text order, changed values only."""
    source = F.col(text)
    values = F.regexp_extract_all(source, F.lit(PATTERN), F.lit(0))
    one = lambda kind, value, new: F.struct(kind.alias("kind"), value.alias("value"), new.alias("pseudonym"))
    in_run = lambda v: F.transform(card_parts(v), lambda x: one(F.lit("card"), x["text"], F.when(x["card"], card_pseudonym(x["text"], key)).otherwise(x["text"])))
    # Each match is an array of values: a run of numbers may hold several cards, and numbers that are none.
    fresh = F.transform(F.col("__values"), lambda v: F.when(kind_of(v) == "card", in_run(v)).otherwise(F.array(one(kind_of(v), v, pseudonym(v, key)))))
    # The pieces between values: one more than values, so that the two are zipped in order.
    pieces = F.split(source, PATTERN, -1)
    rebuilt = F.concat_ws("", F.zip_with(F.col("__pieces"), F.col("__fresh"), lambda p, v: F.concat(p, F.coalesce(F.array_join(v["pseudonym"], ""), F.lit("")))))
    hit = source.rlike(r"[0-9@]")
    return (
        documents.withColumn("__values", F.when(hit, values).otherwise(F.array().cast("array<string>")))
        .withColumn("__fresh", fresh)
        .withColumn("__pieces", F.when(F.size("__values") > 0, pieces))
        .withColumn(text, F.when(F.size("__values") > 0, rebuilt).otherwise(source))
        .withColumn("found", F.when(F.col("__values").isNull(), F.array().cast("array<struct<kind:string,value:string,pseudonym:string>>")).otherwise(F.filter(F.flatten("__fresh"), lambda v: v["value"] != v["pseudonym"])))
        .drop("__values", "__fresh", "__pieces")
    )


def op6_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pseudonymise(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))

    def count(kind):
        return F.size(F.filter("found", lambda v: v["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return done.select("doc_id", "text", F.size("found").cast("long").alias("n_found"), *map(count, ("card", "phone", "ip", "date", "ssn", "email")))
