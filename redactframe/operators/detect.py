"""Detection of personal data in text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redactframe import rules
from redactframe.functions.checksums import luhn_valid
from redactframe.functions.text import (
    count_matches,
    digits,
    jvm_regex,
    match_spans,
    matches,
    may_match,
    trim,
)

# Every rule of rules.SPAN_PATTERNS needs an @ or a digit; rules of a user's own need not.
_MAY_HOLD_PII = r"[@\d]"


def pii_spans(
    texts: DataFrame, key: str = "doc_id", text: str = "text", patterns=rules.SPAN_PATTERNS
) -> DataFrame:
    """One row per match and type: key, entity_type, span_text, start, end, confidence, source.

    One pass over the texts, no shuffle: the spans of all types are built in one array per
    row and exploded. The rules are independent, so one piece of text may appear under two types.
    """
    t = F.col(text)

    def typed(entity: str, pattern: str) -> Column:
        tag = F.lit(entity).alias("entity_type")
        return F.transform(
            match_spans(t, pattern),
            lambda s: F.struct(tag, s["text"].alias("span_text"), s["start"].alias("start"), s["end"].alias("end")),
        )

    spans = [typed(entity, pattern) for entity, pattern in patterns]
    found = texts.filter(t.rlike(_MAY_HOLD_PII)) if patterns is rules.SPAN_PATTERNS else texts
    return (
        found.select(key, F.explode(F.concat(*spans)).alias("s"))
        .select(key, "s.*", F.lit(1.0).alias("confidence"), F.lit("regex").alias("source"))
    )


def pii_counts(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Spans and texts per type. Only counts are needed, so no offsets are built."""
    t = F.col(text)
    per_type = F.array(*[
        F.struct(F.lit(e).alias("entity_type"),
                 count_matches(t, p).cast("long").alias("n"))
        for e, p in rules.SPAN_PATTERNS
    ])
    return (
        texts.filter(t.rlike(_MAY_HOLD_PII))
        .select(F.explode(F.filter(per_type, lambda s: s["n"] > 0)).alias("s"))
        .groupBy("s.entity_type")
        .agg(F.sum("s.n").alias("n_spans"), F.count("*").alias("n_docs"))
    )


def pii_elements(nodes: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Element-level detector: at most one hit per (element, type), short texts skipped."""
    t = trim(F.col(text))
    hits = F.array(*[
        F.when(matches(t, pattern), F.struct(F.lit(kind).alias("type"), F.lit(name).alias("matched_pattern")))
        for name, kind, pattern in rules.ELEMENT_PATTERNS
    ])
    return (
        nodes.filter((F.length(t) >= rules.ELEMENT_MIN_CHARS) & t.rlike(r"@|\d{3}|\+91"))
        .select(*keys, F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("h"))
        .select(*keys, "h.*")
        .dropDuplicates([*keys, "type"])
    )


def card_numbers(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Card-shaped digit runs with their checksum verdict, one row per distinct run and text."""
    t = F.col(text)
    runs = F.array_distinct(F.regexp_extract_all(t, F.lit(jvm_regex(rules.CARD_CANDIDATE)), F.lit(0)))
    return (
        texts.filter(t.rlike(r"\d(?:[ -]?\d){12}"))
        .select(key, F.explode(runs).alias("candidate"))
        .select(key, "candidate", digits(F.col("candidate")).alias("digits"),
                luhn_valid(F.col("candidate")).alias("luhn_ok"))
    )


def is_never_store_value(text: Column) -> Column:
    """Any of the six identifier shapes; a cheap digit/@ test screens most texts out first."""
    rule_hit = reduce(lambda a, b: a | b, [may_match(text, p) & matches(text, p) for _, p in rules.NEVER_STORE_VALUES])
    return F.coalesce(F.when(text.rlike(r"[@\d]"), rule_hit).otherwise(F.lit(False)), F.lit(False))


def is_never_store_key(key: Column, pattern: str = rules.VAULT_NEVER_STORE_KEY) -> Column:
    return matches(key, pattern, ignore_case=True)


def visible_id_count(text: Column) -> Column:
    """How many national-ID and PAN shapes a text shows."""
    by_type = dict(rules.SPAN_PATTERNS)
    return reduce(
        lambda a, b: a + b,
        [count_matches(text, by_type[e]) for e in ("AADHAAR", "PAN")],
    )


def ner_entities(predictions: DataFrame) -> DataFrame:
    """Keep confident PER/ORG/LOC words from raw token predictions.

    Input columns: word, entity (BIO), entity_group, score, has_rect. The grouped label
    wins over the BIO label when present.
    """
    label = F.coalesce(F.nullif("entity_group", F.lit("")), F.nullif("entity", F.lit("")))
    group = F.regexp_replace(F.upper(label), "^(B-|I-)", "")
    word = trim(F.col("word"))
    return (
        predictions.withColumn("entity_type", group)
        .withColumn("word", word)
        .filter(
            F.col("entity_type").isin(rules.NER_GROUPS)
            & (F.col("score") > rules.NER_MIN_SCORE)
            & (F.col("word") != "")
            & ~F.startswith("word", F.lit("##"))
            & F.col("has_rect")
        )
    )


def combine_layers(regex_spans: DataFrame | None, ner_spans: DataFrame | None) -> DataFrame:
    """Union of the enabled layers, tagged by source; switch a layer off by passing None."""
    layers = []
    if regex_spans is not None:
        layers.append(regex_spans.withColumn("source", F.lit("regex")))
    if ner_spans is not None:
        layers.append(ner_spans.withColumn("source", F.lit("ner")))
    if not layers:
        raise ValueError("at least one detection layer must be on")
    return reduce(lambda a, b: a.unionByName(b), layers)


def backfill_boxes(spans: DataFrame, nodes: DataFrame) -> DataFrame:
    """Give each span without a box the rect of the first text node of its page that contains it.

    The containment test runs as an exact gram equi-join on distinct needles, so a page
    with very many spans and nodes does not turn into a spans x nodes product.
    """
    from redactframe.functions.contains import contains_join

    needles = spans.select("page_id", "span_text").distinct()
    first_node = (
        contains_join(nodes, needles, ["page_id"], "text", "span_text")
        .groupBy("page_id", "span_text")
        .agg(F.min_by(F.struct("node_idx", "x", "y"), "node_idx").alias("box"))
    )
    return spans.join(first_node, ["page_id", "span_text"], "left").select(
        "page_id", "span_id", "span_text", F.col("box.node_idx").alias("node_idx"),
        F.col("box.x").alias("x"), F.col("box.y").alias("y"),
    )
