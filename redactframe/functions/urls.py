"""URL parts as column expressions; anything that is not an absolute URL gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from redactframe.functions.text import blank_to_null

URL_SHAPE = r"^([A-Za-z][A-Za-z0-9+.-]*):(?://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)(?::\d*)?)?"


def scheme(url: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(url, URL_SHAPE, 1), F.lit("")))


def host(url: Column) -> Column:
    return F.lower(blank_to_null(F.regexp_extract(url, URL_SHAPE, 2)))


def same_or_subdomain(child: Column, parent: Column) -> Column:
    return (child == parent) | F.endswith(child, F.concat(F.lit("."), parent))


def host_suffixes(name: Column) -> Column:
    """``a.b.c`` -> [a.b.c, b.c, c]: turns a subdomain test into an equi-join."""
    parts = F.split(name, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."),
    )
