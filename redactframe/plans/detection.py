"""Queries: text detection, redaction and release."""

from __future__ import annotations

from pyspark.sql import functions as F

from redactframe import rules
from redactframe.functions.checksums import verhoeff_valid
from redactframe.functions.text import count_matches, materialize
from redactframe.operators import detect, redact
from redactframe.plans import sqltext as q
from redactframe.plans.registry import ORACLES, query
from redactframe.sources.shapes import cte
from redactframe.sources.tables import derived, table

def spans_sql(src: str, key: str = "doc_id", text: str = "text") -> str:
    """All spans with offsets: pieces between matches give the running positions."""
    per_type = " UNION ALL ".join(
        f"""SELECT {key}, '{e}' AS entity_type, m[i] AS span_text,
        cast(coalesce(list_sum(list_transform(g[1:i], lambda s: length(s))), 0)
           + coalesce(list_sum(list_transform(m[1:i-1], lambda s: length(s))), 0) AS BIGINT) AS span_start
        FROM (SELECT {key}, m, g, unnest(range(1, len(m) + 1)) AS i FROM (
          SELECT {key}, regexp_extract_all({text}, {q.lit(p)}) AS m, string_split_regex({text}, {q.lit(p)}) AS g FROM {src})
        WHERE len(m) > 0)"""
        for e, p in rules.SPAN_PATTERNS
    )
    return (f"SELECT {key}, entity_type, span_text, span_start, span_start + length(span_text) AS span_end, "
            f"'regex' AS source FROM ({per_type})")


def _spans_out(df, key="doc_id"):
    return df.select(key, "entity_type", "span_text", F.col("start").cast("long").alias("span_start"),
                     F.col("end").cast("long").alias("span_end"), "source")


@query("pii_spans", oracle=spans_sql("documents"))
def pii_spans(spark, sf):
    return _spans_out(detect.pii_spans(table(spark, sf, "documents")))


@query("pii_spans_ids", oracle=f"{cte('id_texts')} {spans_sql('id_texts')}")
def pii_spans_ids(spark, sf):
    return _spans_out(detect.pii_spans(derived(spark, sf, "id_texts")))


@query("pii_counts_by_type", oracle="SELECT entity_type, cast(sum(n) AS BIGINT) AS n_spans, count(*) AS n_docs FROM (" + " UNION ALL ".join(
    f"SELECT '{e}' AS entity_type, len(regexp_extract_all(text, {q.lit(p)})) AS n FROM documents" for e, p in rules.SPAN_PATTERNS
) + ") WHERE n > 0 GROUP BY entity_type")
def pii_counts_by_type(spark, sf):
    return detect.pii_counts(table(spark, sf, "documents"))


@query("pii_elements", oracle="SELECT doc_id, line_no, type, matched_pattern FROM (" + " UNION ALL ".join(
    f"SELECT doc_id, line_no, '{kind}' AS type, '{name}' AS matched_pattern FROM nodes WHERE {q.has('t', p)}"
    for name, kind, p in rules.ELEMENT_PATTERNS
) + ")")
def pii_elements(spark, sf):
    nodes = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    return detect.pii_elements(nodes, ["doc_id", "line_no"]).withColumn("line_no", F.col("line_no").cast("long"))


ORACLES["pii_elements"] = (
    "WITH nodes AS (SELECT doc_id, i - 1 AS line_no, " + q.trim("l[i]") + " AS t FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i "
    "FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE length(" + q.trim("l[i]") + ") >= 4) "
    + ORACLES["pii_elements"]
)

LUHN_SQL = """(length({d}) BETWEEN 13 AND 19 AND coalesce(list_sum(list_transform(range(1, length({d}) + 1), lambda i:
  CASE WHEN (i % 2) = 0 THEN (CASE WHEN cast(substr(reverse({d}), i, 1) AS INT) > 4 THEN 2 * cast(substr(reverse({d}), i, 1) AS INT) - 9
       ELSE 2 * cast(substr(reverse({d}), i, 1) AS INT) END) ELSE cast(substr(reverse({d}), i, 1) AS INT) END)), 1) % 10 = 0)"""


def luhn_sql(d: str) -> str:
    return LUHN_SQL.format(d=d)


@query("card_luhn", oracle=f"""WITH c AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, {q.lit(rules.CARD_CANDIDATE)})) AS candidate FROM documents),
 d AS (SELECT doc_id, candidate, {q.digits('candidate')} AS digits FROM c)
 SELECT doc_id, candidate, digits, {luhn_sql('digits')} AS luhn_ok FROM d""")
def card_luhn(spark, sf):
    return detect.card_numbers(table(spark, sf, "documents"))


def _verhoeff_sql(d: str) -> str:
    mul = "[" + ",".join("[" + ",".join(map(str, r)) + "]" for r in rules.VERHOEFF_D) + "]"
    perm = "[" + ",".join("[" + ",".join(map(str, r)) + "]" for r in rules.VERHOEFF_P) + "]"
    state = "0"
    for i in range(12):
        digit = f"cast(substr({d}, {12 - i}, 1) AS INT)"
        state = f"({mul})[{state} + 1][({perm})[{i % 8 + 1}][{digit} + 1] + 1]"
    return f"CASE WHEN length({d}) = 12 THEN {state} = 0 ELSE false END"


@query("verhoeff_id", oracle=f"{cte('national_ids')}, d AS (SELECT row_id, {q.digits('number')} AS digits FROM national_ids) "
       f"SELECT row_id, digits, {_verhoeff_sql('digits')} AS valid FROM d")
def verhoeff_id(spark, sf):
    n = derived(spark, sf, "national_ids")
    return n.select("row_id", F.regexp_replace("number", r"\D", "").alias("digits"), verhoeff_valid(F.col("number")).alias("valid"))


NER_SQL = (
    "SELECT page_id, token_idx, word, entity_type, score, span_start FROM (SELECT page_id, token_idx, span_start, score, has_rect, "
    + q.trim("word") + " AS word, regexp_replace(upper(coalesce(nullif(entity_group, ''), nullif(entity, ''))), '^(B-|I-)', '') AS entity_type "
    "FROM token_predictions) WHERE entity_type IN ('PER', 'ORG', 'LOC') AND score > 0.8 AND word <> '' AND NOT starts_with(word, '##') AND has_rect"
)


def _ner(spark, sf):
    return detect.ner_entities(derived(spark, sf, "token_predictions"))


@query("ner_postfilter", oracle=f"{cte('token_predictions')} {NER_SQL}")
def ner_postfilter(spark, sf):
    return _ner(spark, sf).select("page_id", "token_idx", "word", "entity_type", "score", "span_start")


@query("pii_all", oracle=f"{cte('token_predictions', 'id_texts')}, r AS ({spans_sql('id_texts')}), n AS ({NER_SQL}) "
       "SELECT doc_id, entity_type, span_text, span_start, source FROM r UNION ALL "
       "SELECT token_idx, entity_type, word, span_start, 'ner' FROM n")
def pii_all(spark, sf):
    regex = detect.pii_spans(derived(spark, sf, "id_texts")).select(
        "doc_id", "entity_type", "span_text", F.col("start").cast("long").alias("span_start"))
    ner = _ner(spark, sf).select(F.col("token_idx").alias("doc_id"), "entity_type", F.col("word").alias("span_text"), "span_start")
    return detect.combine_layers(regex, ner)


@query("bbox_backfill", oracle=f"""{cte('text_nodes', 'unboxed_spans')}
 SELECT s.page_id, s.span_id, s.span_text, m.node_idx, m.x, m.y FROM unboxed_spans s LEFT JOIN (
   SELECT s2.span_id, n.node_idx, n.x, n.y, row_number() OVER (PARTITION BY s2.span_id ORDER BY n.node_idx) AS rn
   FROM unboxed_spans s2 JOIN text_nodes n ON n.page_id = s2.page_id AND contains(n.text, s2.span_text)) m
 ON m.span_id = s.span_id AND m.rn = 1""")
def bbox_backfill(spark, sf):
    return detect.backfill_boxes(derived(spark, sf, "unboxed_spans"), derived(spark, sf, "text_nodes"))


@query("never_store_docs", oracle=f"SELECT doc_id FROM documents WHERE {q.never_store_value('text')}")
def never_store_docs(spark, sf):
    return table(spark, sf, "documents").filter(detect.is_never_store_value(F.col("text"))).select("doc_id")


@query("redact_docs", oracle=f"SELECT doc_id, {q.scrub('text')} AS redacted FROM documents")
def redact_docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", redact.scrub_ids(F.col("text")).alias("redacted"))


@query("redact_ids", oracle=f"{cte('id_texts')} SELECT doc_id, {q.scrub('text')} AS redacted FROM id_texts")
def redact_ids(spark, sf):
    return derived(spark, sf, "id_texts").select("doc_id", redact.scrub_ids(F.col("text")).alias("redacted"))


@query("redact_entities", oracle=f"""{cte('user_fields', 'token_predictions')},
 f AS (SELECT cast(floor(field_idx / 10) AS BIGINT) AS page_id, field_idx, label FROM user_fields),
 e AS (SELECT page_id, lower({q.trim('word')}) AS needle, min(token_idx) AS seq FROM token_predictions
       WHERE coalesce(nullif(entity_group, ''), '') IN ('PER','ORG','LOC') AND length({q.trim('word')}) >= 2 GROUP BY ALL),
 p AS (SELECT page_id, list(needle ORDER BY seq) AS needles FROM e GROUP BY page_id)
 SELECT f.page_id, f.field_idx, f.label, CASE WHEN p.needles IS NULL THEN f.label ELSE
   list_reduce(list_prepend(f.label, p.needles), lambda acc, n: regexp_replace(acc, concat('(?i)', regexp_escape(n)), '[REDACTED]', 'g')) END AS redacted_label
 FROM f LEFT JOIN p ON p.page_id = f.page_id""")
def redact_entities(spark, sf):
    fields = derived(spark, sf, "user_fields").select(
        F.floor(F.col("field_idx") / 10).alias("page_id"), "field_idx", "label")
    entities = derived(spark, sf, "token_predictions").select(
        "page_id", F.col("token_idx").alias("seq"), F.col("entity_group").alias("entity_type"), F.col("word").alias("text"))
    return redact.redact_entities(fields, entities)


@query("mask_id", oracle=f"""{cte('national_ids')} SELECT row_id, CASE WHEN length({q.digits('number')}) = 12
 THEN concat('XXXX XXXX ', right({q.digits('number')}, 4)) ELSE number END AS masked FROM national_ids""")
def mask_id(spark, sf):
    return derived(spark, sf, "national_ids").select("row_id", redact.mask_id(F.col("number")).alias("masked"))


@query("safe_excerpt", oracle="SELECT doc_id, substr(" + q.collapse(
    "regexp_replace(text, '(?i)data:[a-z/+.-]+;base64,[A-Za-z0-9+/=]+', '[image]', 'g')") + ", 1, 160) AS excerpt FROM documents")
def safe_excerpt(spark, sf):
    return table(spark, sf, "documents").select("doc_id", redact.safe_excerpt(F.col("text")).alias("excerpt"))


@query("mask_regions", oracle=f"""{cte('regions')}, s AS (SELECT *, CASE WHEN type = 'face' THEN cast(0.45 AS DOUBLE) ELSE cast(0 AS DOUBLE) END AS pad FROM regions WHERE w > 0 AND h > 0),
 r AS (SELECT page_id, region_id, type, canvas_w, canvas_h,
   greatest(0, cast(floor(x * dpr - w * dpr * pad + 0.5) AS BIGINT)) AS bx1, greatest(0, cast(floor(y * dpr - h * dpr * pad + 0.5) AS BIGINT)) AS by1,
   cast(floor(w * dpr + w * dpr * pad * 2 + 0.5) AS BIGINT) AS rw, cast(floor(h * dpr + h * dpr * pad * 2 + 0.5) AS BIGINT) AS rh FROM s),
 c AS (SELECT *, least(rw, canvas_w - bx1) AS cw, least(rh, canvas_h - by1) AS ch FROM r)
 SELECT page_id, region_id, type, bx1, by1, bx1 + cw AS bx2, by1 + ch AS by2 FROM c WHERE cw > 0 AND ch > 0""")
def mask_regions(spark, sf):
    return redact.mask_regions(derived(spark, sf, "regions"))


_FENCED = r'```(?:json)?\s*\{[\s\S]*?"action"\s*:[\s\S]*?\}\s*```'
_BARE = r'\{[\s\S]*?"action"\s*:\s*"(?:' + rules.REPLY_ACTIONS + r')"[\s\S]*?\}'


@query("strip_actions", oracle=f"{cte('replies')} SELECT reply_id, " + q.trim(
    f"regexp_replace(regexp_replace(raw, {q.lit(_FENCED)}, '', 'g'), {q.lit(_BARE)}, '', 'g')") + " AS prose FROM replies")
def strip_actions(spark, sf):
    return derived(spark, sf, "replies").select("reply_id", redact.strip_actions(F.col("raw")).alias("prose"))


_KEEP = [f"CASE WHEN {k} IN {q.in_list(rules.FORBIDDEN_CONFIG_KEYS)} THEN NULL ELSE concat({k}, '=', {v}) END"
         for k, v in (("k1", "v1"), ("k2", "v2"), ("k3", "v3"))]


@query("scrub_config", oracle=f"{cte('configs')} SELECT config_id, concat_ws(',', {', '.join(_KEEP)}) AS kept FROM configs")
def scrub_config(spark, sf):
    c = derived(spark, sf, "configs")
    clean = redact.scrub_config(F.create_map("k1", "v1", "k2", "v2", "k3", "v3"))
    kept = F.array_join(F.transform(F.map_entries(clean), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return c.select("config_id", kept.alias("kept"))


@query("flagship_release")
def flagship_release(spark, sf):
    """Documents ready for release: identifiers scrubbed, remaining detector spans replaced, counts kept."""
    return release_documents(table(spark, sf, "documents"))


def release_documents(docs):
    """Stateless, so it also runs on a stream. Each text is scrubbed once and its counts read off the result."""
    t = F.col("text")
    n_spans = sum((count_matches(t, p) for _, p in rules.SPAN_PATTERNS), F.lit(0))
    markers = lambda c: F.size(F.split(c, r"\[REDACTED\]", -1)).cast("long")
    scrubbed = materialize(
        docs, ["doc_id", "source", "text"], scrubbed=redact.scrub_ids(t),
        n_spans=F.when(t.rlike(r"[@\d]"), n_spans).otherwise(0).cast("long"))
    return scrubbed.select(
        "doc_id", "source", redact.redact_spans(F.col("scrubbed")).alias("released"), "n_spans",
        (markers(F.col("scrubbed")) - markers(t)).alias("n_ids"))


def _spans_replaced(x: str) -> str:
    for e, p in rules.SPAN_PATTERNS:
        x = f"regexp_replace({x}, {q.lit(p)}, '[{e}]', 'g')"
    return x


ORACLES["flagship_release"] = (
    f"WITH s AS (SELECT doc_id, source, text, {q.scrub('text')} AS scrubbed FROM documents) SELECT doc_id, source, "
    f"{_spans_replaced('scrubbed')} AS released, cast("
    + " + ".join(f"len(regexp_extract_all(text, {q.lit(p)}))" for _, p in rules.SPAN_PATTERNS)
    + " AS BIGINT) AS n_spans, cast(len(string_split(scrubbed, '[REDACTED]')) - len(string_split(text, '[REDACTED]')) AS BIGINT) AS n_ids FROM s"
)
