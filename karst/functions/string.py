"""Strings. Positions count characters from 0."""

from __future__ import annotations

import html
import ipaddress
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import col, val


def concat(*xs) -> Column:
    return F.concat(*map(col, xs))


def contains(s, part) -> Column:
    return F.contains(col(s), val(part))


def ends_with(s, part) -> Column:
    return F.endswith(col(s), val(part))


def starts_with(s, part) -> Column:
    return F.startswith(col(s), val(part))


def join(xs, separator: str) -> Column:
    return F.array_join(F.transform(col(xs), lambda e: e.cast("string")), separator)


def length(s) -> Column:
    return F.char_length(col(s))


def lowercase(s) -> Column:
    return F.lower(col(s))


def uppercase(s) -> Column:
    return F.upper(col(s))


def matches(s, pattern: str) -> Column:
    """True where the pattern is found anywhere."""
    return F.rlike(col(s), val(pattern))


def repeat(s, n) -> Column:
    return F.repeat(col(s), val(n))


def replace(s, old, new) -> Column:
    return F.replace(col(s), val(old), val(new))


def reverse(s) -> Column:
    return F.reverse(col(s))


def slice(s, start: int, end: int | None = None) -> Column:
    """From start to end, end excluded; negative positions count from the end."""
    text = col(s)
    n = F.char_length(text)
    at = lambda p: F.greatest(p + n, F.lit(0)) if isinstance(p, int) and p < 0 else val(p)
    stop = n if end is None else at(end)
    return F.substring(text, at(start) + 1, F.greatest(stop - at(start), F.lit(0)))


def slug(s) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(col(s)), "[^a-z0-9]+", "-"), "^-|-$", "")


def split(s, separator: str) -> Column:
    """At a literal separator."""
    return F.split(col(s), "\\Q" + separator + "\\E")


def substring(s, start, length=None) -> Column:
    text = col(s)
    return F.substring(text, val(start) + 1, F.char_length(text) if length is None else val(length))


def trim(s) -> Column:
    return F.trim(col(s))


def words(s) -> Column:
    return F.filter(F.split(col(s), "\\s+"), lambda w: w != "")


def wrap(s, mark: str) -> Column:
    """The string between two marks."""
    return F.concat(val(mark), col(s), val(mark))


def _is(pattern: str):
    def test(s) -> Column:
        return F.rlike(col(s), F.lit(pattern))

    test.__doc__ = f"True where the whole string matches {pattern}"
    return test


is_alphanum = _is("^[\\p{L}\\p{N}]+$")
is_alpha = _is("^\\p{L}+$")
is_ascii = _is("^\\p{ASCII}*$")
is_domain = _is("^([a-zA-Z0-9-]{1,63}\\.)+[a-zA-Z]{2,}$")
is_email = _is("^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$")
is_hexadecimal = _is("^[0-9a-fA-F]+$")
is_ipv4 = _is("^((25[0-5]|2[0-4]\\d|1\\d\\d|[1-9]?\\d)\\.){3}(25[0-5]|2[0-4]\\d|1\\d\\d|[1-9]?\\d)$")
is_numeric = _is("^[+-]?\\d+$")
is_semver = _is("^\\d+\\.\\d+\\.\\d+(-[0-9A-Za-z.-]+)?(\\+[0-9A-Za-z.-]+)?$")
is_uuid = _is("^(?i)[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")


def is_datetime(s) -> Column:
    return F.try_to_timestamp(col(s)).isNotNull()


@F.pandas_udf(T.BooleanType())
def _ipv6(s: pd.Series) -> pd.Series:
    def test(x):
        try:
            return None if x is None else bool(ipaddress.IPv6Address(x))
        except ValueError:
            return False

    return s.map(test)


def is_ipv6(s) -> Column:
    """A pandas UDF; only strings with a colon reach it."""
    text = col(s)
    return F.when(F.contains(text, F.lit(":")), _ipv6(text)).otherwise(F.when(text.isNotNull(), F.lit(False)))


def is_ip(s) -> Column:
    return is_ipv4(s) | is_ipv6(s)


def is_latitude(s) -> Column:
    return F.coalesce(col(s).try_cast("double").between(-90, 90), F.lit(False))


def is_longitude(s) -> Column:
    return F.coalesce(col(s).try_cast("double").between(-180, 180), F.lit(False))


def is_url(s) -> Column:
    return F.try_parse_url(col(s), F.lit("HOST")).isNotNull()


def html_encode(s) -> Column:
    out = col(s)
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(mark), F.lit(entity))
    return out


#: Tags that stay; their only attributes are safe links.
SAFE_TAGS = frozenset("a b blockquote br code em h1 h2 h3 h4 h5 h6 hr i li ol p pre s strong sub sup table tbody td th thead tr u ul".split())


class _Cleaner(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag in SAFE_TAGS and not self.hidden:
            links = [v for k, v in attrs if k == "href" and v and v.lower().startswith(("http:", "https:", "mailto:"))]
            self.out.append(f'<{tag} href="{html.escape(links[0])}">' if tag == "a" and links else f"<{tag}>")

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag in SAFE_TAGS and not self.hidden:
            self.out.append(f"</{tag}>")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(html.escape(data, quote=False))


@F.pandas_udf(T.StringType())
def _sanitize(s: pd.Series) -> pd.Series:
    def clean(x):
        if x is None:
            return None
        parser = _Cleaner()
        parser.feed(x)
        parser.close()
        return "".join(parser.out)

    return s.map(clean)


def html_sanitize(s) -> Column:
    """Keeps an allow-list of tags. A pandas UDF."""
    return _sanitize(col(s))


def distance(a, b) -> Column:
    """Levenshtein distance."""
    return F.levenshtein(col(a), col(b))


def similarity(a, b) -> Column:
    """1 minus the Levenshtein distance by the longer length; 1 for two empty strings."""
    longer = F.greatest(F.char_length(col(a)), F.char_length(col(b)))
    return F.when(longer == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(col(a), col(b)) / longer)
