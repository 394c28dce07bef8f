"""Text expressions with the same meaning on the JVM and in a SQL oracle."""

from __future__ import annotations

import re
import sys
from functools import cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redactframe import rules

# ASCII white space; Spark's own trim() strips only U+0020.
WHITESPACE = " \t\n\x0b\f\r"

# ``\b`` on Java 17 follows Unicode letters while the rules mean ASCII words.
_EDGE = r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))"
_STARTS_WITH_WORD = re.compile(r"\\b(?=(?:\(\?!\([^()]*\)\\b\))?(?:\\d|\[[A-Za-z0-9-]+\]))")
_STARTS_OPTIONAL = re.compile(r"\\b\(\?:\\\+\?1")
_ENDS_WITH_WORD = re.compile(r"(?:\\d|\[[A-Za-z0-9-]+\])(?:\{[\d,]+\})?\\b$")


def jvm_regex(pattern: str, ignore_case: bool = False) -> str:
    """Compile a rule pattern for java.util.regex with ASCII word edges.

    The common outer edges become one-sided look-arounds, which is cheaper than the
    general two-sided test.
    """
    out = pattern
    if "|" not in re.sub(r"\([^()]*\)", "", pattern):
        if _STARTS_WITH_WORD.match(out):
            out = r"(?<!\w)" + out[2:]
        elif _STARTS_OPTIONAL.match(out):
            out = r"(?=[\d+(])" + out
        if _ENDS_WITH_WORD.search(out):
            out = out[:-2] + r"(?!\w)"
    out = out.replace(r"\b", _EDGE)
    return ("(?i)" if ignore_case else "") + out


def let(value: Column, body) -> Column:
    """Bind an expression once and use it many times: ``body`` gets the bound value.

    Repeated use of a costly expression inside CASE branches or lambdas would otherwise
    evaluate it again at every mention.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def materialize(df: DataFrame, keep: list[str], **named: Column) -> DataFrame:
    """Select ``keep`` plus computed columns, each evaluated exactly once per row.

    A plain select would be merged into the filters and projections above it, which then
    repeat a costly expression at every mention. A one-row generator is not merged.
    """
    row = F.struct(*[c.alias(n) for n, c in named.items()])
    return df.select(*keep, F.inline(F.array(row)))


#: Rules of which every match holds an @ or a digit.
_TELLING = {p for _, p in (*rules.SPAN_PATTERNS, *rules.NEVER_STORE_VALUES)}


def may_match(text: Column, pattern: str) -> Column:
    """Cheap necessary condition for the built-in rules: each needs an @ or a digit. Other patterns have none."""
    if pattern not in _TELLING:
        return F.lit(True)
    if "@" in pattern:
        return F.contains(text, F.lit("@"))
    if r"\d{4}" in pattern:
        return text.rlike(r"\d{4}")
    return text.rlike(r"\d")


def count_matches(text: Column, pattern: str) -> Column:
    n = F.size(F.regexp_extract_all(text, F.lit(jvm_regex(pattern)), F.lit(0)))
    return F.when(may_match(text, pattern), n).otherwise(0)


def matches(text: Column, pattern: str, ignore_case: bool = False) -> Column:
    return text.rlike(jvm_regex(pattern, ignore_case))


def any_match(text: Column, patterns: list[str], ignore_case: bool = False) -> Column:
    return reduce(lambda a, b: a | b, [matches(text, p, ignore_case) for p in patterns])


@cache
def _capitals() -> tuple[str, str]:
    """Letters with a capital that is one character, and these capitals."""
    pairs = []
    for c in map(chr, range(sys.maxunicode + 1)):
        up = "\u1e9e" if c == "\u00df" else next((x for x in (c.upper(), c.title()) if len(x) == 1), c)
        if up != c:
            pairs.append((c, up))
    return "".join(c for c, _ in pairs), "".join(up for _, up in pairs)


def capitals(text: Column) -> Column:
    """Upper case, letter by letter, as SQL engines have it: Spark's own upper() makes two or three letters of some."""
    return F.translate(text, *_capitals())


def trim(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def blank_to_null(text: Column) -> Column:
    return F.nullif(trim(text), F.lit(""))


def first_present(*options: Column) -> Column:
    """The first non-blank option, trimmed; empty string when all are blank."""
    return F.coalesce(*[blank_to_null(o) for o in options], F.lit(""))


def collapse(text: Column) -> Column:
    return trim(F.regexp_replace(text, r"\s+", " "))


def words(text: Column) -> Column:
    """Lower-case alphanumeric runs, in order."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def squash(text: Column) -> Column:
    """Comparison form of a label or key: lower-case letters and digits only."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def lines(text: Column) -> Column:
    return F.split(text, "\r?\n", -1)


def round_half_up(x: Column) -> Column:
    """Round to the nearest integer, halves towards plus infinity."""
    return F.floor(x + F.lit(0.5))


def match_spans(text: Column, pattern: str) -> Column:
    """ARRAY<STRUCT<text, start, end>> of all non-overlapping matches, 0-based offsets.

    The pieces between matches come from the same pattern via split(), so an offset is
    the running length of pieces and matches - no second search that could land on an
    unrelated equal string.
    """
    found = F.regexp_extract_all(text, F.lit(jvm_regex(pattern)), F.lit(0))
    empty = F.array().cast("array<struct<text:string,start:int,end:int>>")
    start = F.struct(F.lit(0).alias("pos"), empty.alias("spans"))

    def step(acc, pair):
        begin = acc["pos"] + F.length(pair["gap"])
        stop = begin + F.length(pair["hit"])
        span = F.struct(pair["hit"].alias("text"), begin.alias("start"), stop.alias("end"))
        return F.struct(stop.alias("pos"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    def located(hits):
        gaps = F.split(text, jvm_regex(pattern), -1)
        pairs = F.zip_with(hits, gaps, lambda h, g: F.struct(h.alias("hit"), g.alias("gap")))
        placed = F.aggregate(F.slice(pairs, F.lit(1), F.size(hits)), start, step, lambda acc: acc["spans"])
        return F.when(F.size(hits) > 0, placed).otherwise(empty)

    return F.when(may_match(text, pattern), let(found, located)).otherwise(empty)
