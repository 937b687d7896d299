"""Parts of e-mail addresses and URLs; NULL where there is none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._common import col


def email_host(s) -> Column:
    return F.when(F.contains(col(s), F.lit("@")), F.substring_index(col(s), "@", -1))


def email_user(s) -> Column:
    return F.when(F.contains(col(s), F.lit("@")), F.substring_index(col(s), "@", 1))


def _part(name: str):
    def call(url) -> Column:
        return F.try_parse_url(col(url), F.lit(name))

    call.__doc__ = f"The {name} of a URL."
    return call


url_fragment, url_host, url_path, url_query, url_scheme = (_part(p) for p in ("REF", "HOST", "PATH", "QUERY", "PROTOCOL"))


def url_domain(url) -> Column:
    """The host unless it is an address."""
    host = url_host(url)
    return F.when(~host.rlike("^[0-9.]+$|^\\["), host)


def url_port(url) -> Column:
    return F.nullif(F.regexp_extract(F.try_parse_url(col(url), F.lit("AUTHORITY")), ":([0-9]+)$", 1), F.lit("")).cast("int")
