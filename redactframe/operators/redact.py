"""Redaction, masking and release shaping."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redactframe import rules
from redactframe.functions.text import collapse, digits, jvm_regex, let, may_match, round_half_up, trim
from redactframe.session import stored


def scrub_ids(text: Column) -> Column:
    """Replace the six identifier shapes one after the other; the order is part of the rule."""
    out = text
    for _, pattern in rules.NEVER_STORE_VALUES:
        out = _replace(out, pattern, rules.REDACTED)
    return F.when(text.rlike(r"[@\d]"), out).otherwise(text)


def redact_spans(text: Column, patterns=rules.SPAN_PATTERNS) -> Column:
    """Replace every detector match by its type in brackets."""
    out = text
    for entity, pattern in patterns:
        out = _replace(out, pattern, f"[{entity}]")
    return F.when(text.rlike(r"[@\d]"), out).otherwise(text)


def _replace(text: Column, pattern: str, by: str) -> Column:
    """Replace all matches; bound once, because the next rule mentions this text twice."""
    swap = lambda t: F.when(may_match(t, pattern), F.regexp_replace(t, jvm_regex(pattern), F.lit(by))).otherwise(t)
    return let(text, swap)


def mask_id(value: Column) -> Column:
    """Show only the last four of a 12-digit number; anything else is unchanged."""
    d = digits(value)
    return F.when(F.length(d) == 12, F.concat(F.lit("XXXX XXXX "), F.substring(d, 9, 4))).otherwise(value)


def safe_excerpt(text: Column, limit: int = 160) -> Column:
    no_images = F.regexp_replace(text, r"(?i)data:[a-z/+.-]+;base64,[A-Za-z0-9+/=]+", "[image]")
    return F.substring(collapse(no_images), 1, limit)


def strip_actions(reply: Column) -> Column:
    """Remove fenced and bare action objects from a reply."""
    fenced = r'```(?:json)?\s*\{[\s\S]*?"action"\s*:[\s\S]*?\}\s*```'
    bare = r'\{[\s\S]*?"action"\s*:\s*"(?:' + rules.REPLY_ACTIONS + r')"[\s\S]*?\}'
    return trim(F.regexp_replace(F.regexp_replace(reply, fenced, ""), bare, ""))


def scrub_config(config: Column) -> Column:
    """Drop secret keys from a MAP<STRING,STRING>."""
    return F.map_filter(config, lambda k, _: ~k.isin(rules.FORBIDDEN_CONFIG_KEYS))


def suppress_value(value: Column) -> Column:
    """Audit form of a typed value: a marker when there was one, else null."""
    return F.when(F.coalesce(value, F.lit("")) != "", F.lit(rules.REDACTED))


#: Needles of a page up to which its labels meet the whole list of them.
FEW_NEEDLES = 256


def _rewritten(label: Column, plan: Column) -> Column:
    """The label with each needle of the list (sorted structs of seq and needle) replaced in turn, ignoring case."""
    quoted = lambda n: F.concat(F.lit("(?i)"), F.regexp_replace(n, r"([\\.*+?^${}()|\[\]])", r"\\$1"))
    return F.aggregate(plan, label, lambda acc, step: F.regexp_replace(acc, quoted(step["needle"]), F.lit(rules.REDACTED)))


def redact_entities(fields: DataFrame, entities: DataFrame) -> DataFrame:
    """Replace PER/ORG/LOC strings inside the field labels of the same page, ignoring case.

    ``fields``: page_id, field_idx, label. ``entities``: page_id, seq, entity_type, text.
    Distinct entity strings apply once each, in order of first appearance (``seq``), also to
    text an earlier one produced. The needles of a page are one list, which its fields meet by page; a page of more than ``FEW_NEEDLES``
    has no list, there only needles that can touch a label reach it: they share a gram with the label, or with the
    redaction marker (a later needle may match inside or across the marker).
    """
    needle = trim(F.col("text"))
    marker = rules.REDACTED.lower()
    # A needle that is not in the label can still hit text an earlier one produced: it then lies
    # inside the marker, holds it whole, or starts or ends with a piece of it. Such needles are rare.
    tails = "|".join(re.escape(marker[i:]) for i in range(len(marker)))
    heads = "|".join(re.escape(marker[:i]) for i in range(1, len(marker) + 1))
    on_marker = (
        F.lit(marker).contains(F.col("folded")) | F.col("folded").contains(marker)
        | F.col("folded").rlike(f"^(?:{tails})") | F.col("folded").rlike(f"(?:{heads})$")
    )
    needles = stored(
        entities.filter(F.col("entity_type").isin(rules.NER_GROUPS))
        .select("page_id", "seq", needle.alias("needle"), F.lower(needle).alias("folded"))
        .filter(F.length("needle") >= 2)
        .groupBy("page_id", "folded")
        .agg(F.min_by("needle", "seq").alias("needle"), F.min("seq").alias("seq"))
        .select("page_id", "seq", "needle", "folded", on_marker.alias("on_marker"))
    )
    many = stored(needles.groupBy("page_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > FEW_NEEDLES).select("page_id"))
    if many.isEmpty():
        return _redact_by_page(fields, needles)
    few = _redact_by_page(fields.join(many, "page_id", "left_anti").select(fields.columns), needles.join(many, "page_id", "left_anti"))
    rest = fields.join(many, "page_id", "left_semi").select(fields.columns)
    return few.unionByName(_redact_by_gram(rest, needles.join(many, "page_id", "left_semi")))


def _redact_by_page(fields: DataFrame, needles: DataFrame) -> DataFrame:
    """Labels against the list of needles of their page, after one shuffle of the fields."""
    lists = needles.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("seq", "needle", "folded", "on_marker"))).alias("__list"))
    low = F.lower("label")
    touched = F.exists("__list", lambda n: F.contains(low, n["folded"]))
    plan = F.filter("__list", lambda n: n["on_marker"] | F.contains(low, n["folded"]))
    own = F.when(touched, _rewritten(F.col("label"), plan)).otherwise(F.col("label"))
    return fields.join(lists, "page_id", "left").select(*fields.columns, own.alias("redacted_label"))


def _redact_by_gram(fields: DataFrame, needles: DataFrame) -> DataFrame:
    """Distinct labels against the needles that share a gram with them."""
    from redactframe.functions.contains import GRAM, all_grams, first_gram

    labels = fields.select("page_id", "label").filter(F.length("label") > 0).distinct()
    gram = first_gram(F.col("folded"), GRAM)
    candidates = (
        labels.withColumn("gram", F.explode(all_grams(F.lower("label"), GRAM, 2)))
        .join(needles.withColumn("gram", gram), ["page_id", "gram"])
        .filter(F.contains(F.lower("label"), F.col("folded")))
        .select("page_id", "label", "seq", "needle")
    )
    touched = candidates.select("page_id", "label").distinct()
    pairs = candidates.unionByName(touched.join(needles.filter("on_marker").select("page_id", "seq", "needle"), "page_id")).distinct()
    plan = pairs.groupBy("page_id", "label").agg(
        F.array_sort(F.collect_list(F.struct("seq", "needle"))).alias("plan")
    )
    done = plan.select("page_id", "label", _rewritten(F.col("label"), F.col("plan")).alias("redacted"))
    return fields.join(done, ["page_id", "label"], "left").select(
        *[c for c in fields.columns], F.coalesce("redacted", "label").alias("redacted_label")
    )


def mask_regions(regions: DataFrame) -> DataFrame:
    """CSS rects to clamped device-pixel boxes; regions that end up empty are dropped.

    Input: x, y, w, h (CSS px), dpr, canvas_w, canvas_h, type; faces get extra padding.
    """
    pad = F.when(F.col("type") == "face", rules.FACE_PAD_RATIO).otherwise(0.0)
    x, y = F.col("x") * F.col("dpr"), F.col("y") * F.col("dpr")
    w, h = F.col("w") * F.col("dpr"), F.col("h") * F.col("dpr")
    sized = regions.filter((F.col("w") > 0) & (F.col("h") > 0)).select(
        *[c for c in regions.columns],
        round_half_up(x - w * pad).alias("rx"),
        round_half_up(y - h * pad).alias("ry"),
        round_half_up(w + w * pad * 2).alias("rw"),
        round_half_up(h + h * pad * 2).alias("rh"),
    )
    zero = F.lit(0).cast("long")
    clamped = sized.select(
        "*", F.greatest(zero, "rx").alias("bx1"), F.greatest(zero, "ry").alias("by1")
    ).select(
        "*",
        F.least(F.col("rw"), F.col("canvas_w") - F.col("bx1")).alias("cw"),
        F.least(F.col("rh"), F.col("canvas_h") - F.col("by1")).alias("ch"),
    )
    return clamped.filter((F.col("cw") > 0) & (F.col("ch") > 0)).select(
        "page_id", "region_id", "type", "bx1", "by1",
        (F.col("bx1") + F.col("cw")).alias("bx2"), (F.col("by1") + F.col("ch")).alias("by2"),
    )


RELEASE_COLUMNS = ["page_id", "selector", "label", "type", "dpr", "image_width", "image_height"]


def release_view(fields: DataFrame) -> DataFrame:
    """The only columns that may leave: an allow-list, checked against the schema."""
    view = fields.select(
        "page_id", "selector", "label", "type",
        F.when(F.col("dpr") > 0, F.col("dpr")).otherwise(1.0).alias("dpr"),
        F.when((F.col("viewport_w") > 0) & (F.col("viewport_h") > 0),
               round_half_up(F.col("viewport_w") * F.col("dpr"))).alias("image_width"),
        F.when((F.col("viewport_w") > 0) & (F.col("viewport_h") > 0),
               round_half_up(F.col("viewport_h") * F.col("dpr"))).alias("image_height"),
    )
    if view.columns != RELEASE_COLUMNS:
        raise AssertionError("release view must hold the allow-listed columns only")
    return view
