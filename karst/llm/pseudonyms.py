"""Operator 8: format-preserving pseudonyms for personal data, with built-in functions only.

Candidates are found by one regular expression, a group for each kind, and validated by kind:

=========  =====================================================  ===========================================
kind       found as                                               pseudonym
=========  =====================================================  ===========================================
email      local@domain                                           keyed local part, same domain
secret     32 or more hexadecimal digits                          as many keyed hexadecimal digits
iban       country, check digits and account, in one or in        other digits in the account, same country,
           groups of four, valid modulo 97                        new check digits
ip         dotted quad of octets up to 255                        another dotted quad
ip6        eight groups of hexadecimal digits, or fewer           other digits, same layout
           around a double colon
date       2024-01-31, 2024/01/31, 31.01.2024 (a true calendar    another date, same layout
           date from 1900 to 2099)
ssn        123-45-6789, as it may be issued                       another one that may be issued
phone      +1 (234) 555-6789, 234-555-6789 and other numbers of   other digits behind the same country
           10 to 15 digits with a + or brackets                   code, same layout
card       13 to 19 digits, in one or in groups (four of four,    other digits, valid by Luhn, same layout
           or 4-6-5), valid by Luhn
=========  =====================================================  ===========================================

Numbers and dates go through a keyed Feistel network: the value is split in two
halves, in turn each half gets a keyed hash of the other added, modulo its own
range.  That is a permutation of exactly the values of that format, so different
values stay different, equal values stay equal in all documents, and no table of
them is kept.  Local parts and secrets have no fixed size and get keyed hashes.

The key comes from the session's ``spark.karst.secret.key``.  Where that is unset, a random key
is drawn for the session: pseudonyms then agree within it, and nobody can undo them later.

A text is searched once: each find is put between marks, with its kind told by its place among
the groups, and the text is cut at the marks.  Marks that a text holds itself are escaped before.

Defined results: null text stays null, with no findings; empty text stays empty; texts
may be of any length, and every repetition in the expression is bounded or possessive, so none
exhausts the stack; where several kinds fit at one place the first in the table counts; a null or
empty key is refused; repeated rows get equal rows; an empty table gives no rows; other
columns of the input are kept as they are, but for n_pii and pii_kinds, which are replaced.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import documents

ROUNDS = 8
KEY_SETTING = "spark.karst.secret.key"
#: Dates that are permuted among themselves: from this day on so many, as a product of two factors.
FIRST_DAY, DAYS = "1900-01-01", (17, 4297)
#: Security numbers that may be issued: areas 001 to 899 but 666, times groups 01 to 99; serials 0001 to 9999.
AREA_GROUPS, SERIALS = 898 * 99, 9999

_HEX = "[0-9a-fA-F]{1,4}"
KINDS = {
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[\p{L}\p{N}](?:[\p{L}\p{N}\-]{0,62}\.){1,126}\p{L}{2,63}",
    "secret": r"(?<![0-9A-Za-z])[0-9a-fA-F]{32,}+(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}\d\d(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\d]|\.\d)",
    "ip6": rf"(?<![0-9A-Za-z:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}:(?:{_HEX}:){{0,5}}{_HEX})(?![0-9A-Za-z:]|\.\d)",
    "date": r"(?<![\d./\-])(?:(?:19|20)\d\d-\d\d-\d\d|(?:19|20)\d\d/\d\d/\d\d|\d\d\.\d\d\.(?:19|20)\d\d)(?![\d]|[./\-]\d)",
    "ssn": r"(?<![\d\-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d]|-\d)",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .\-]?)?\(\d{2,4}\)[ .\-]?\d{3,4}[ .\-]?\d{3,4}(?!\d)|(?<![\d+])\+\d{1,3}(?:[ .\-]?\d{2,4}){3,4}(?!\d)|(?<![\d+.\-])\d{3}-\d{3}-\d{4}(?![\d]|-\d)",
    "card": r"(?<!\d)(?:\d{13,19}|\d{4}(?:[ \-]\d{4}){3}|\d{4}[ \-]\d{6}[ \-]\d{5})(?!\d)",
}
NAMES = list(KINDS)
#: What stands around a find, and between the groups in it; and what stands for these in a text that has them.
MARK, STEP, ESCAPE = "\x01", "\x02", "\x03"
_ESCAPED = ((ESCAPE, ESCAPE + "\x06"), (MARK, ESCAPE + "\x04"), (STEP, ESCAPE + "\x05"))


def key_of(spark: SparkSession) -> str:
    """The session's key; one drawn at random is kept in its settings."""
    key = spark.conf.get(KEY_SETTING, None)
    if key is None:
        key = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, key)
    return key


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _keyed(key: str, *parts: Column) -> Column:
    """Hexadecimal digits that depend on the key."""
    return F.sha2(F.concat_ws("|", F.lit(key), *parts), 256)


def feistel(left: Column, right: Column, left_range: Column, right_range: Column, key: str, tag: Column) -> Column:
    """struct<l, r, a, b>: a keyed permutation of the pairs with 0 <= l < a and 0 <= r < b."""

    def step(pair: Column, k: Column) -> Column:
        h = F.conv(F.substring(_keyed(key, tag, k.cast("string"), pair["r"].cast("string")), 1, 14), 16, 10).cast("long")
        return F.struct(pair["r"].alias("l"), F.pmod(pair["l"] + h, pair["a"]).alias("r"), pair["b"].alias("a"), pair["a"].alias("b"))

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"), left_range.cast("long").alias("a"), right_range.cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)


def permuted_digits(digits: Column, key: str, tag: str) -> Column:
    """Another string of as many decimal digits (2 to 36)."""
    n = F.length(digits)
    u = F.floor(n / 2).cast("int")
    ten = F.lit(10).cast("double")
    pair = feistel(F.substring(digits, F.lit(1), u), F.substring(digits, u + 1, n), F.pow(ten, u), F.pow(ten, n - u), key, F.concat(F.lit(tag), n.cast("string")))
    # after an even number of rounds the halves are back in place
    return F.concat(F.lpad(pair["l"].cast("string"), u, "0"), F.lpad(pair["r"].cast("string"), n - u, "0"))


def permuted_hex(digits: Column, key: str, tag: str) -> Column:
    """Another string of as many lower-case hexadecimal digits (2 to 30)."""
    n = F.length(digits)
    u = F.floor(n / 2).cast("int")
    number = lambda s: F.conv(s, 16, 10).cast("long")
    sixteen = F.lit(16).cast("double")
    pair = feistel(number(F.substring(digits, F.lit(1), u)), number(F.substring(digits, u + 1, n)), F.pow(sixteen, u), F.pow(sixteen, n - u), key, F.concat(F.lit(tag), n.cast("string")))
    return F.lower(F.concat(F.lpad(F.hex(pair["l"]), u, "0"), F.lpad(F.hex(pair["r"]), n - u, "0")))


def luhn_remainder(digits: Column) -> Column:
    """The Luhn sum modulo 10: 0 for a valid number."""
    n = F.length(digits)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(digits, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    return F.aggregate(each, F.lit(0), lambda s, d: s + F.when(d > 9, d - 9).otherwise(d)) % 10


def iban_remainder(value: Column) -> Column:
    """An account number modulo 97, letters counting as 10 to 35: 1 for a valid one."""
    bare = F.replace(value, F.lit(" "), F.lit(""))
    chars = F.filter(F.split(F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.substring(bare, 1, 4)), ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0), lambda s, c: F.when(c.between("0", "9"), s * 10 + c.try_cast("int")).otherwise(s * 100 + F.ascii(c) - 55) % 97)


def _refilled(value: Column, digits: Column, kind: str = "[0-9]") -> Column:
    """value with its digits replaced in order by those given."""
    chars = F.split(value, "")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("k"))

    def put(s: Column, c: Column) -> Column:
        is_digit = c.rlike(f"^{kind}$")
        return F.struct(F.concat(s["out"], F.when(is_digit, F.substring(digits, s["k"] + 1, F.lit(1))).otherwise(c)).alias("out"), (s["k"] + F.when(is_digit, 1).otherwise(0)).alias("k"))

    return F.aggregate(chars, start, put)["out"]


def _card(value: Column, key: str) -> Column:
    digits = _digits(value)
    n = F.length(digits)
    body = permuted_digits(F.substring(digits, F.lit(1), n - 1), key, "card")
    last = F.pmod(-luhn_remainder(F.concat(body, F.lit("0"))), F.lit(10))
    return _refilled(value, F.concat(body, last.cast("string")))


def _phone(value: Column, key: str) -> Column:
    code = F.regexp_extract(value, r"^(\+\d{1,3})[ .\-(]", 1)
    rest = F.substring(value, F.length(code) + 1, F.length(value))
    return F.concat(code, _refilled(rest, permuted_digits(_digits(rest), key, "phone")))


def _ssn(value: Column, key: str) -> Column:
    area, group, serial = (F.substring(value, *at).cast("long") for at in ((1, 3), (5, 2), (8, 4)))
    at = (area - 1 - (area > 666).cast("long")) * 99 + group - 1
    pair = feistel(at, serial - 1, F.lit(AREA_GROUPS), F.lit(SERIALS), key, F.lit("ssn"))
    area = F.floor(pair["l"] / 99) + 1
    parts = (F.lpad((area + (area >= 666).cast("long")).cast("string"), 3, "0"), F.lpad((pair["l"] % 99 + 1).cast("string"), 2, "0"), F.lpad((pair["r"] + 1).cast("string"), 4, "0"))
    return F.concat_ws("-", *parts)


def _ip(value: Column, key: str) -> Column:
    o = F.split(value, "\\.")
    number = lambda i: F.get(o, F.lit(i)).cast("long")
    wide = F.lit(65536)
    pair = feistel(number(0) * 256 + number(1), number(2) * 256 + number(3), wide, wide, key, F.lit("ip"))
    return F.concat_ws(".", *(x.cast("string") for s in ("l", "r") for x in (F.shiftright(pair[s], 8), pair[s].bitwiseAND(255))))


def _ip6(value: Column, key: str) -> Column:
    digits = F.lower(F.replace(value, F.lit(":"), F.lit("")))
    n = F.length(digits)
    # 32 digits are permuted as two halves, each under the other: more than a long holds at once
    first, second = F.substring(digits, F.lit(1), F.lit(16)), F.substring(digits, F.lit(17), n)
    long = F.concat(permuted_hex(first, key, "ip6a"), F.when(F.length(second) > 1, permuted_hex(second, key, "ip6b")).otherwise(second))
    return _refilled(value, F.when(n > 16, long).otherwise(permuted_hex(digits, key, "ip6")), "[0-9a-fA-F]")


def _iban(value: Column, key: str) -> Column:
    account = F.substring(value, F.lit(5), F.length(value))
    new = _refilled(account, permuted_digits(_digits(account), key, "iban"))
    check = 98 - iban_remainder(F.concat(F.substring(value, 1, 2), F.lit("00"), new))
    return F.concat(F.substring(value, 1, 2), F.lpad(check.cast("string"), 2, "0"), new)


def _parsed(value: Column) -> Column:
    iso = F.regexp_replace(F.regexp_replace(value, r"^(\d\d)\.(\d\d)\.(\d{4})$", "$3-$2-$1"), "/", "-")
    return iso.try_cast("date")


def _date(value: Column, key: str) -> Column:
    day = F.datediff(_parsed(value), F.lit(FIRST_DAY).cast("date"))
    a, b = (F.lit(x) for x in DAYS)
    pair = feistel(F.floor(day / b), F.pmod(day, b), a, b, key, F.lit("date"))
    new = F.date_add(F.lit(FIRST_DAY).cast("date"), (pair["l"] * b + pair["r"]).cast("int"))
    out = F.when(value.contains("."), F.date_format(new, "dd.MM.yyyy")).when(value.contains("/"), F.date_format(new, "yyyy/MM/dd")).otherwise(F.date_format(new, "yyyy-MM-dd"))
    return F.coalesce(out, value)  # no true date: left as it is


def _email(value: Column, key: str) -> Column:
    at = F.substring_index(value, "@", 1)
    return F.concat(F.lit("u"), F.substring(_keyed(key, F.lit("email"), at), 1, 16), F.lit("@"), F.substring_index(value, "@", -1))


def _secret(value: Column, key: str) -> Column:
    n = F.length(value)
    seed = F.array(_keyed(key, F.lit("secret"), value))  # a long value is hashed once
    blocks = F.flatten(F.transform(seed, lambda s: F.transform(F.sequence(F.lit(1), F.ceil(n / 64).cast("int")), lambda i: _keyed(key, s, i.cast("string")))))
    out = F.substring(F.array_join(blocks, ""), F.lit(1), n)
    return F.when(value == F.upper(value), F.upper(out)).otherwise(out)


_MAKERS = {"email": _email, "secret": _secret, "iban": _iban, "ip": _ip, "ip6": _ip6, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}
#: Which finds of a kind are none after all.
_FALSE = {
    "date": lambda v: _parsed(v).isNull(),
    "card": lambda v: luhn_remainder(_digits(v)) != 0,
    "iban": lambda v: (iban_remainder(v) != 1) | (F.length(_digits(v)) < 4),
    "ip6": lambda v: ~v.rlike("[0-9]") | (F.length(v) < 6),
}


def _replaced(text: Column, names: list[str]) -> Column:
    """text with each find between marks: in it the values of all groups, of which one is there, with steps between."""
    return F.regexp_replace(text, F.lit("|".join(f"({KINDS[n]})" for n in names)), F.lit(MARK + STEP.join(f"${i + 1}" if n in names else "" for i, n in enumerate(NAMES)) + MARK))


def cut_at_finds(text: Column) -> Column:
    """array<string>: what stands between finds and the finds in turn, or null where nothing can be found."""
    odd = text.contains(MARK) | text.contains(STEP)
    escaped = text
    for plain, written in _ESCAPED:
        escaped = F.replace(escaped, F.lit(plain), F.lit(written))
    text = F.when(odd, escaped).otherwise(text)
    # the e-mail group comes first and is the slowest: only where there is an @
    bare = [n for n in NAMES if n != "email"]
    shifted = "|".join(f"({KINDS[n]})" for n in bare)
    without = F.regexp_replace(text, F.lit(shifted), F.lit(MARK + STEP + STEP.join(f"${i + 1}" for i in range(len(bare))) + MARK))
    marked = F.when(text.contains("@"), _replaced(text, NAMES)).when(text.rlike("[0-9]"), without).when(text.rlike("[a-fA-F]{32}"), without)
    return F.when(marked.contains(MARK), F.split(marked, MARK, -1))


def swapped(find: Column, key: str) -> Column:
    """struct<kind, new> of a find as it stands between marks; kind is null if it is none after all."""
    value = F.btrim(find, F.lit(STEP))
    place = F.length(find) - F.length(F.ltrim(find, F.lit(STEP)))
    out = F.struct(F.lit(None).cast("string").alias("kind"), value.alias("new"))
    for i, name in enumerate(NAMES):
        this = F.struct(F.lit(name).alias("kind"), _MAKERS[name](value, key).alias("new"))
        if name in _FALSE:
            this = F.when(_FALSE[name](value), F.struct(F.lit(None).cast("string").alias("kind"), value.alias("new"))).otherwise(this)
        out = F.when(place == i, this).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str | None = None, text: str = "text") -> DataFrame:
    """docs with the text's personal data replaced, and two columns more: n_pii and pii_kinds (sorted, distinct)."""
    key = key_of(docs.sparkSession) if key is None else key
    if not key:
        raise ValueError("a key is needed")
    column = F.col(text)
    old, new = (next(n for k in range(len(docs.columns) + 1) if (n := f"_{name}{k}") not in docs.columns) for name in ("found", "new"))
    rows = docs.withColumn(old, cut_at_finds(column))
    between = lambda x: F.struct(F.lit(None).cast("string").alias("kind"), x.alias("new"))
    rows = rows.withColumn(new, F.transform(old, lambda x, i: F.when(i % 2 == 1, swapped(x, key)).otherwise(between(x))))
    joined = F.array_join(F.transform(new, lambda v: v["new"]), "")
    plain = joined
    for one, written in reversed(_ESCAPED):
        plain = F.replace(plain, F.lit(written), F.lit(one))
    joined = F.when(column.contains(MARK) | column.contains(STEP), plain).otherwise(joined)
    kinds = F.filter(F.transform(new, lambda v: v["kind"]), lambda k: k.isNotNull())
    return (
        rows.withColumn("n_pii", F.coalesce(F.array_size(kinds), F.lit(0)))
        .withColumn("pii_kinds", F.coalesce(F.array_sort(F.array_distinct(kinds)), F.array().cast("array<string>")))
        .withColumn(text, F.when(F.col(new).isNotNull(), joined).otherwise(column))
        .drop(old, new)
    )


def op8_pii_pseudonyms(spark, sf_dir: str) -> DataFrame:
    """doc_id, text, n_pii, pii_kinds of every document."""
    return pseudonymise(documents(spark, sf_dir).select("doc_id", "text"))
