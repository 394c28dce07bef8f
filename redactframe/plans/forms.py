"""Queries: form controls, classification, labels."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from redactframe import rules
from redactframe.operators import fields, pages, redact
from redactframe.plans import sqltext as q
from redactframe.plans.registry import query
from redactframe.sources.shapes import cte
from redactframe.sources.tables import derived

SELECTOR = (
    "CASE WHEN id <> '' THEN concat('#', id) WHEN name <> '' THEN concat(tag, '[name=\"', name, '\"]') "
    f"WHEN {q.trim('css_class')} <> '' THEN concat(tag, '.', regexp_replace({q.trim('css_class')}, '\\s+', '.', 'g')) "
    "ELSE concat(tag, ':nth(', field_idx, ')') END"
)


def _present(*cols: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({q.trim(c)}, '')" for c in cols) + ", '')"


_TOKENS = ("list_filter(string_split_regex(lower(concat_ws(' ', name, id, aria_label, data_testid, placeholder)), '[^a-z0-9]+'), "
           "lambda w: w <> '')")
_JOINED = f"array_to_string({_TOKENS}, '-')"
_AUTO = "(" + " OR ".join(f"contains(lower(autocomplete), {q.lit(k)})" for k in rules.SENSITIVE_AUTOCOMPLETE) + ")"
_KEYS = "[" + ", ".join(q.lit(k) for k in rules.SENSITIVE_KEYWORDS) + "]"

SENSITIVE_SQL = f"""SELECT page_id, selector, reason, type, label, x, y, width, height FROM (
 SELECT *, row_number() OVER (PARTITION BY page_id, selector ORDER BY rule, field_idx) AS rn FROM (
  SELECT page_id, {SELECTOR} AS selector, field_idx, rule, x, y, width, height, {_present('label', 'placeholder', 'aria_label')} AS label,
   CASE rule WHEN 1 THEN 'type="password"' WHEN 2 THEN concat('autocomplete="', autocomplete, '"')
     WHEN 3 THEN 'keyword match in attributes' ELSE 'potential card number in contenteditable' END AS reason,
   CASE rule WHEN 1 THEN 'password_input' WHEN 4 THEN 'contenteditable_pii' ELSE 'sensitive_input' END AS type
  FROM (SELECT * EXCLUDE (type), CASE WHEN tag = 'input' AND type = 'password' THEN 1 WHEN tag = 'input' AND {_AUTO} THEN 2
     WHEN tag IN ('input', 'textarea') AND (list_has_any({_TOKENS}, {_KEYS}) OR contains({_JOINED}, 'social-security')) THEN 3
     WHEN contenteditable AND {q.has('content', rules.CONTENTEDITABLE_CARD)} THEN 4 END AS rule FROM form_fields)
  WHERE rule IS NOT NULL)) WHERE rn = 1 AND width <> 0 AND height <> 0"""

_FILLABLE = ("NOT disabled AND NOT readonly AND width <> 0 AND height <> 0 AND ((tag = 'input' AND "
             f"CASE WHEN type = '' THEN 'text' ELSE lower(type) END NOT IN {q.in_list(rules.UNFILLABLE_INPUT_TYPES)}) OR tag IN ('select', 'textarea'))")
FILLABLE_SQL = f"""SELECT page_id, selector, field_idx, label, type, has_value FROM (SELECT page_id, {SELECTOR} AS selector, field_idx,
  {_present('label', 'aria_label', 'placeholder', 'name', 'id')} AS label, 'text_input' AS type, length({q.trim('value')}) > 0 AS has_value,
  row_number() OVER (PARTITION BY page_id, {SELECTOR} ORDER BY field_idx) AS rn FROM form_fields WHERE {_FILLABLE}) WHERE rn = 1"""


@query("sensitive_fields", oracle=f"{cte('form_fields')} {SENSITIVE_SQL}")
def sensitive_fields(spark, sf):
    return fields.sensitive_fields(derived(spark, sf, "form_fields")).drop("field_idx")


@query("sensitive_no_password", oracle=f"{cte('form_fields')} SELECT page_id, selector, type FROM ({SENSITIVE_SQL}) WHERE type <> 'password_input'")
def sensitive_no_password(spark, sf):
    return fields.sensitive_fields(derived(spark, sf, "form_fields"), password_layer=False).select("page_id", "selector", "type")


@query("fillable_fields", oracle=f"{cte('form_fields')} {FILLABLE_SQL}")
def fillable_fields(spark, sf):
    return fields.fillable_fields(derived(spark, sf, "form_fields")).select(
        "page_id", "selector", "field_idx", "label", "type", "has_value")


@query("fields_for_fill", oracle=f"""{cte('form_fields')}, s AS ({SENSITIVE_SQL}), f AS ({FILLABLE_SQL})
 SELECT page_id, selector, label, type FROM f UNION ALL SELECT page_id, selector, label, type FROM s
 WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.page_id = s.page_id AND f.selector = s.selector)""")
def fields_for_fill(spark, sf):
    controls = derived(spark, sf, "form_fields")
    return fields.fields_for_fill(fields.fillable_fields(controls), fields.sensitive_fields(controls)).drop("field_idx")


@query("field_labels", oracle=f"""{cte('form_fields', 'control_labels')}, l AS (SELECT page_id, for_id, min_by({q.trim('label_text')}, label_idx) AS for_label
  FROM control_labels WHERE {q.trim('label_text')} <> '' GROUP BY page_id, for_id)
 SELECT f.page_id, f.field_idx, coalesce(l.for_label, nullif({q.trim('f.aria_label')}, ''), nullif({q.trim('f.placeholder')}, ''), nullif({q.trim('f.name')}, ''), nullif({q.trim('f.id')}, ''), '') AS label
 FROM form_fields f LEFT JOIN l ON l.page_id = f.page_id AND l.for_id = f.id""")
def field_labels(spark, sf):
    controls = derived(spark, sf, "form_fields").drop("label")
    labelled = pages.attach_labels(controls, derived(spark, sf, "control_labels")).withColumnRenamed("for_label", "label")
    return labelled.select("page_id", "field_idx", fields.field_label().alias("label"))


def _class_sql() -> str:
    own = "coalesce(nullif(label, ''), nullif(aria_label, ''), '')"
    ws = lambda *c: "concat_ws(' ', " + ", ".join(f"nullif({x}, '')" for x in c) + ")"
    base = f"""SELECT *, concat({ws('label', 'name', 'id', 'aria_label', 'title')}, ' ', {own}) AS id_text,
      concat({ws('label', 'name', 'id', 'aria_label', 'placeholder', 'title')}, ' ', {own}) AS all_text,
      {ws('name', 'id', 'placeholder', 'aria_label')} AS safe_text, string_split_regex(lower(autocomplete), '\\s+') AS toks FROM form_fields"""
    from redactframe.plans.detection import luhn_sql

    card = lambda c: f"({q.has(c, rules.FIELD_CARD_VALUE)} AND {luhn_sql(q.digits(c))})"
    steps = [
        ("tag NOT IN ('input', 'textarea', 'select', 'button')", None, "not_scannable"),
        ("type = 'password'", "password", "password_type"),
        (f"safe_text <> '' AND {q.any_has('safe_text', rules.SAFE_FIELD_PATTERNS, True)}", None, "allowlist_safe"),
        ("regexp_matches(lower(autocomplete), '^(shipping|billing)-') AND NOT regexp_matches(lower(autocomplete), 'cc-|bday')", None, "shipping_or_billing"),
        ("readonly AND type = 'number'", None, "readonly_number"),
        ("type = 'number' AND try_cast(max AS INT) < 10000", None, "small_number"),
        (card("value"), "never_store", "luhn_valid_card_value"),
        (card("placeholder"), "never_store", "luhn_valid_card_placeholder"),
        (q.has("all_text", rules.CARDHOLDER_PATTERN, True), "cardholderName", "cardholder_name_pattern"),
        (q.has("all_text", rules.CARD_EXPIRY_PATTERN, True), "cardExpiry", "card_expiry_pattern"),
        (q.any_has("id_text", rules.NEVER_STORE_FIELD_PATTERNS, True), "never_store", "identifier_pattern"),
    ]
    steps += [(f"list_contains(toks, {q.lit(t)})", k, f"autocomplete={t}") for t, k in rules.AUTOCOMPLETE_KEYS]
    steps += [(q.any_has("all_text", p, True), k, f"keyword:{k}") for k, p in rules.KEYWORD_KEYS]
    key = " ".join(f"WHEN {c} THEN {q.lit(k)}" for c, k, _ in steps)
    reason = " ".join(f"WHEN {c} THEN {q.lit(r)}" for c, _, r in steps)
    return (f"{cte('form_fields')}, b AS ({base}), r AS (SELECT page_id, field_idx, CASE {key} END AS key, CASE {reason} END AS reason FROM b) "
            f"SELECT page_id, field_idx, key, reason, coalesce(key IN {q.in_list(rules.SENSITIVE_FIELD_KEYS)}, false) AS sensitive FROM r")


@query("classify_fields", oracle=_class_sql())
def classify_fields(spark, sf):
    return fields.classify_fields(derived(spark, sf, "form_fields"))


@query("safe_fields", oracle=f"{cte('form_fields')} SELECT field_idx, name FROM form_fields WHERE name <> '' AND {q.any_has('name', rules.SAFE_FIELD_PATTERNS, True)}")
def safe_fields(spark, sf):
    return derived(spark, sf, "form_fields").filter(fields.is_safe_field(F.col("name"))).select("field_idx", "name")


def resolve_sql(label: str, source: str, keep: str) -> str:
    """Alias, exact and containment stages as joins on the fixed key table."""
    flat = lambda s: re.sub("[^a-z0-9]", "", s.lower())
    keys = q.values([(i, k, flat(k), flat(rules.PROFILE_LABELS.get(k, k))) for i, k in enumerate(rules.PROFILE_KEYS)])
    alias = q.values(list(rules.LABEL_ALIASES.items()))
    clean = q.trim(f"regexp_replace(regexp_replace({label}, '[*_#`]+', '', 'g'), '\\s+', ' ', 'g')")
    return f"""SELECT {keep}, CASE WHEN cleaned = '' OR tok = '' OR {q.has('cleaned', rules.SKIP_LABELS, True)}
      OR {q.has('cleaned', rules.PROFILE_NEVER_STORE_KEY, True)} THEN NULL ELSE coalesce(
        (SELECT min_by(a.k, a.k) FROM {alias} a(t, k) WHERE a.t = tok),
        (SELECT min_by(p.k, p.o) FROM {keys} p(o, k, a, b) WHERE tok = p.a OR tok = p.b),
        CASE WHEN length(tok) >= 4 THEN (SELECT min_by(p.k, p.o) FROM {keys} p(o, k, a, b)
           WHERE contains(p.a, tok) OR contains(tok, p.a) OR contains(p.b, tok) OR contains(tok, p.b)) END) END AS key
      FROM (SELECT *, {q.squash('cleaned')} AS tok FROM (SELECT *, {clean} AS cleaned FROM {source}))"""


@query("resolve_label", oracle=f"{cte('labels_seen')} {resolve_sql('label', 'labels_seen', 'label_id, label')}")
def resolve_label(spark, sf):
    return derived(spark, sf, "labels_seen").select(
        "label_id", "label", fields.resolve_label_expr(F.col("label")).alias("key"))


@query("photo_boxes", oracle=f"""{cte('photos')} SELECT page_id, box_id FROM photos WHERE w >= 48 AND h >= 48 AND y + h >= 0 AND y <= viewport_h
 AND x + w >= 0 AND x <= viewport_w AND w / h <= 3 AND w / h >= 0.25""")
def photo_boxes(spark, sf):
    return fields.photo_boxes(derived(spark, sf, "photos")).select("page_id", "box_id")


@query("release_view", oracle=f"""{cte('page_meta')} SELECT page_id, selector, label, type, dpr,
 CASE WHEN viewport_w > 0 AND viewport_h > 0 THEN cast(floor(viewport_w * dpr + 0.5) AS BIGINT) END AS image_width,
 CASE WHEN viewport_w > 0 AND viewport_h > 0 THEN cast(floor(viewport_h * dpr + 0.5) AS BIGINT) END AS image_height FROM page_meta""")
def release_view(spark, sf):
    return redact.release_view(derived(spark, sf, "page_meta"))
