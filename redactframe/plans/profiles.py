"""Queries: profile extraction, validation, merging, matching and grounding."""

from __future__ import annotations

from pyspark.sql import functions as F

from redactframe import rules
from redactframe.operators import documents, fields, matching, profile
from redactframe.plans import sqltext as q
from redactframe.plans.detection import _verhoeff_sql, luhn_sql
from redactframe.plans.forms import _class_sql, _FILLABLE, resolve_sql
from redactframe.plans.registry import ORACLES, query
from redactframe.sources import files
from redactframe.sources.shapes import RAW_PROFILE_TEXT, cte
from redactframe.sources.tables import derived, table
from redactframe.streaming.streams import work_folder

PNSK = rules.PROFILE_NEVER_STORE_KEY


def forbidden(k: str, v: str) -> str:
    return f"({q.has(k, PNSK, True)} OR {q.never_store_value(v)})"


def clip(v: str) -> str:
    return f"CASE WHEN length({v}) > 200 THEN concat(substr({v}, 1, 197), '...') ELSE {v} END"


_CLEAN = lambda x: q.trim(f"regexp_replace(regexp_replace({x}, '[*_#`]+', '', 'g'), '\\s+', ' ', 'g')")
_RX = q.lit(rules.LABEL_VALUE_LINE)
LINES_SQL = f"""l AS (SELECT doc_id, i AS line_idx, {q.trim('l[i]')} AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (
   SELECT doc_id, string_split_regex(text, '\\r?\\n') AS l FROM profile_texts))),
 s AS (SELECT doc_id, line_idx, {q.trim("regexp_replace(line, '[*_]', '', 'g')")} AS line FROM l WHERE line <> '' AND length(line) <= 600
   AND NOT regexp_matches(line, '^\\||^#{{1,6}}\\s|^---+$')),
 v AS (SELECT doc_id, line_idx, {_CLEAN(f'regexp_extract(line, {_RX}, 1)')} AS label,
   {q.collapse(f"regexp_replace(regexp_extract(line, {_RX}, 2), '^[*]+|[*]+$', '', 'g')")} AS value FROM s WHERE regexp_matches(line, {_RX})),
 k AS (SELECT * FROM v WHERE label <> '' AND value <> '' AND NOT {q.has('label', rules.SKIP_LABELS, True)} AND NOT {forbidden('label', 'value')}
   AND NOT {q.has('label', rules.NOISE_LABELS, True)}),
 r AS ({resolve_sql('label', 'k', 'doc_id, line_idx, label, value')}),
 labelled AS (SELECT doc_id, key, {clip('value')} AS value FROM (SELECT doc_id, coalesce(key, label) AS key, min_by(value, line_idx) AS value FROM r GROUP BY 1, 2))"""


@query("label_values", oracle=f"{cte('profile_texts')}, {LINES_SQL} SELECT doc_id, key, value FROM labelled WHERE NOT {forbidden('key', 'value')}")
def label_values(spark, sf):
    return profile.label_values(derived(spark, sf, "profile_texts"))


def cue_pairs_sql() -> list[tuple[str, str]]:
    def cue(p, ci):
        return f"regexp_extract(text, {q.lit(('(?i)' if ci else '') + p)}, 1)"

    v = {k: cue(p, ci) for k, ci, p in rules.CUE_PATTERNS}
    never = dict(rules.NEVER_STORE_VALUES)
    nid = f"regexp_replace(regexp_extract(text, {q.lit(never['AADHAAR'])}, 0), '\\s', '', 'g')"
    name = q.trim(f"regexp_replace({v['fullName']}, '(?i){rules.CUE_NAME_NOISE}', '', 'g')")
    v["phone"] = f"right({q.digits(v['phone'])}, 10)"
    v["fullName"] = f"CASE WHEN length({name}) >= 3 THEN {name} END"
    v["city"] = q.trim(f"regexp_replace({v['city']}, '(?i){rules.CUE_CITY_NOISE}', '', 'g')")
    for k in ("state", "college", "diagnosis"):
        v[k] = q.trim(v[k])
    v["bankAccount"] = f"CASE WHEN {luhn_sql(q.digits(v['bankAccount']))} THEN {v['bankAccount']} END"
    return [("aadhaar", f"CASE WHEN {_verhoeff_sql(nid)} THEN {nid} END"), ("pan", f"regexp_extract(text, {q.lit(never['PAN'])}, 0)")] + list(v.items())


def cues_sql(src: str) -> str:
    return " UNION ALL ".join(f"SELECT doc_id, '{k}' AS key, {e} AS value FROM {src}" for k, e in cue_pairs_sql())


@query("cue_fields", oracle=f"{cte('profile_texts')} SELECT doc_id, key, {clip('value')} AS value FROM ({cues_sql('profile_texts')}) WHERE coalesce(value, '') <> '' AND NOT {forbidden('key', 'value')}")
def cue_fields(spark, sf):
    return profile.cue_fields(derived(spark, sf, "profile_texts"))


@query("cue_fields_docs", oracle=f"SELECT doc_id, key, {clip('value')} AS value FROM ({cues_sql('documents')}) WHERE coalesce(value, '') <> '' AND NOT {forbidden('key', 'value')}")
def cue_fields_docs(spark, sf):
    return profile.cue_fields(table(spark, sf, "documents"))


def indic_sql(src: str) -> str:
    def either(a, b):
        first = q.trim(f"regexp_extract(text, {q.lit(a)}, 1)")
        return f"coalesce(nullif({first}, ''), {q.trim(f'regexp_extract(text, {q.lit(chr(40) + chr(63) + chr(105) + chr(41) + b)}, 1)')})"

    name = q.trim(f"regexp_replace({either(rules.INDIC_NAME, rules.INDIC_NAME_LATIN)}, '(?i){rules.INDIC_NAME_NOISE}', '', 'g')")
    city = q.trim(f"regexp_replace({either(rules.INDIC_CITY, rules.INDIC_CITY_LATIN)}, '(?i){rules.INDIC_CITY_NOISE}', '', 'g')")
    rows = [("fullName", f"CASE WHEN length({name}) >= 2 THEN {name} END"), ("city", city),
            ("email", f"regexp_extract(text, {q.lit(rules.INDIC_EMAIL)}, 1)")]
    return " UNION ALL ".join(f"SELECT doc_id, '{k}' AS key, {e} AS value FROM {src}" for k, e in rows)


@query("indic_cues", oracle=f"{cte('indic_texts')} SELECT doc_id, key, value FROM ({indic_sql('indic_texts')}) WHERE coalesce(value, '') <> ''")
def indic_cues(spark, sf):
    return profile.indic_cues(derived(spark, sf, "indic_texts"))


_PROFILE_SQL = f"""{cte('profile_texts')}, {LINES_SQL}, u AS (SELECT doc_id, key, value, 0 AS stage FROM ({cues_sql('profile_texts')}) WHERE coalesce(value, '') <> ''
  UNION ALL SELECT doc_id, key, value, 1 FROM ({indic_sql('profile_texts')}) WHERE coalesce(value, '') <> ''
  UNION ALL SELECT doc_id, key, value, 2 FROM labelled WHERE NOT {forbidden('key', 'value')}),
 b AS (SELECT doc_id, key, min_by(value, stage) AS value FROM u GROUP BY doc_id, key),
 profile AS (SELECT doc_id, key, {clip('value')} AS value FROM b WHERE NOT {forbidden('key', 'value')})"""


@query("extract_profile", oracle=f"{_PROFILE_SQL} SELECT * FROM profile")
def extract_profile(spark, sf):
    return profile.extract_profile(derived(spark, sf, "profile_texts"))


_LABELS = "CASE key " + " ".join(f"WHEN {q.lit(k)} THEN {q.lit(v)}" for k, v in rules.PROFILE_LABELS.items()) + " ELSE key END"


@query("profile_display", oracle=f"{_PROFILE_SQL} SELECT doc_id, {_LABELS} AS key, {q.trim('value')} AS value FROM profile WHERE NOT {forbidden('key', 'value')} AND {q.trim('value')} <> ''")
def profile_display(spark, sf):
    return profile.display_fields(profile.extract_profile(derived(spark, sf, "profile_texts")))


RAW = f"raw AS (SELECT user_id, {RAW_PROFILE_TEXT} AS raw FROM raw_profiles)"


def _raw(spark, sf):
    return derived(spark, sf, "raw_profiles").selectExpr("user_id", f"{RAW_PROFILE_TEXT} AS raw")


_OBJ = "json_valid({x}) AND json_type({x}) = 'OBJECT'"
JSON_ENTRIES = f"""o AS (SELECT user_id, raw, json_keys(raw) AS ks FROM raw WHERE raw IS NOT NULL AND CASE WHEN json_valid(raw) THEN json_type(raw) = 'OBJECT' ELSE false END),
 je AS (SELECT user_id, i AS pos, ks[i] AS raw_key, json_extract_string(raw, concat('$."', ks[i], '"')) AS value FROM (SELECT *, unnest(range(1, len(ks) + 1)) AS i FROM o))"""


@query("json_profiles", oracle=f"""{cte('raw_profiles')}, {RAW}, {JSON_ENTRIES},
 c AS (SELECT user_id, pos, raw_key, {q.trim('value')} AS value FROM je WHERE {q.trim('value')} <> '' AND NOT {forbidden('raw_key', q.trim('value'))}),
 r AS ({resolve_sql('raw_key', 'c', 'user_id, pos, raw_key, value')}),
 f AS (SELECT user_id, coalesce(key, nullif({_CLEAN('raw_key')}, ''), raw_key) AS key, min_by(value, pos) AS value FROM r GROUP BY 1, 2)
 SELECT user_id, key, value FROM f WHERE NOT {q.has('key', PNSK, True)}""")
def json_profiles(spark, sf):
    return profile.json_profiles(_raw(spark, sf), "raw")


@query("extract_json_profile", oracle=f"""{cte('raw_profiles')}, {RAW.replace("FROM raw_profiles", f"FROM raw_profiles WHERE starts_with({RAW_PROFILE_TEXT}, '{{') AND json_valid({RAW_PROFILE_TEXT})")}, {JSON_ENTRIES},
 c AS (SELECT user_id, pos, raw_key, {q.trim('value')} AS value FROM je WHERE {q.trim('value')} <> '' AND NOT {forbidden('raw_key', q.trim('value'))}),
 r AS ({resolve_sql('raw_key', 'c', 'user_id, pos, raw_key, value')}),
 f AS (SELECT user_id, coalesce(key, nullif({_CLEAN('raw_key')}, ''), raw_key) AS key, min_by(value, pos) AS value FROM r GROUP BY 1, 2)
 SELECT user_id, key, value FROM f WHERE NOT {forbidden('key', 'value')}""")
def extract_json_profile(spark, sf):
    """The JSON branch of extraction, on the rows that are JSON objects."""
    objects = _raw(spark, sf).where("startswith(raw, '{') AND try_parse_json(raw) IS NOT NULL").withColumnRenamed("raw", "text")
    return profile.extract_profile(objects, key="user_id")


_PAIR = q.lit(profile._PAIR)
NORM_SQL = f"""{cte('raw_profiles')}, {RAW}, {JSON_ENTRIES},
 t AS (SELECT user_id, {q.trim('raw')} AS t FROM raw WHERE {q.trim('raw')} <> ''),
 x AS (SELECT user_id, t, list_filter(list_transform(string_split_regex(t, '\\r?\\n'), lambda s: {q.trim('s')}), lambda s: s <> '') AS ls FROM t WHERE NOT json_valid(t)),
 y AS (SELECT *, len(list_filter(ls, lambda s: NOT regexp_matches(s, {_PAIR}))) = 0 AS ok FROM x),
 z AS (SELECT user_id, i AS pos, ls[i] AS s FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM y WHERE ok)),
 e AS (SELECT user_id, pos, raw_key AS key, value FROM je WHERE value IS NOT NULL UNION ALL
   SELECT user_id, pos, regexp_extract(s, {_PAIR}, 1), regexp_extract(s, {_PAIR}, 2) FROM z UNION ALL SELECT user_id, 1, 'raw', t FROM y WHERE NOT ok)
 SELECT user_id, key, max_by(value, pos) AS value FROM e GROUP BY user_id, key"""


@query("normalize_profile", oracle=NORM_SQL)
def normalize_profile(spark, sf):
    return profile.normalize_profile(_raw(spark, sf), "raw")


@query("parse_profile", oracle=f"""{cte('raw_profiles')}, {RAW}, {JSON_ENTRIES},
 t AS (SELECT user_id, {q.trim("coalesce(raw, '')")} AS t FROM raw),
 x AS (SELECT user_id, t, regexp_matches(t, '^[\\[{{]') AS j, list_filter(list_transform(string_split(t, chr(10)), lambda s: {q.trim('s')}), lambda s: s <> '') AS ls FROM t),
 y AS (SELECT *, len(list_filter(ls, lambda s: NOT contains(s, ':'))) = 0 AS ok, len(list_filter(ls, lambda s: {q.trim("split_part(s, ':', 1)")} <> '')) AS n FROM x),
 er AS (SELECT *, CASE WHEN starts_with(t, '[') THEN CASE WHEN json_valid(t) THEN 'NOT_AN_OBJECT' ELSE 'INVALID_JSON' END WHEN j AND NOT json_valid(t) THEN 'INVALID_JSON'
   WHEN t = '' THEN 'EMPTY' WHEN NOT j AND ok AND n = 0 THEN 'UNPARSEABLE' END AS error FROM y),
 z AS (SELECT user_id, i AS pos, ls[i] AS s FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM er WHERE error IS NULL AND NOT j AND ok)),
 e AS (SELECT user_id, pos, raw_key AS key, value FROM je UNION ALL SELECT user_id, pos, {q.trim("split_part(s, ':', 1)")}, {q.trim("substr(s, instr(s, ':') + 1)")} FROM z
   UNION ALL SELECT user_id, 1, 'notes', t FROM er WHERE error IS NULL AND NOT j AND NOT ok)
 SELECT user_id, error, NULL AS key, NULL AS value FROM er WHERE error IS NOT NULL UNION ALL
 SELECT user_id, NULL, key, max_by(value, pos) FROM e WHERE key <> '' GROUP BY user_id, key""")
def parse_profile(spark, sf):
    return profile.parse_profile(_raw(spark, sf), "raw")


VALID_SQL = f"""{cte('struct_entries')}, v AS (SELECT doc_id, pos, {q.trim('key')} AS key, {q.trim('value')} AS value FROM struct_entries
   WHERE {q.trim('key')} <> '' AND length({q.trim('key')}) <= 64 AND NOT {q.has(q.trim('key'), rules.VAULT_NEVER_STORE_KEY, True)} AND value_type = 'string'
   AND {q.trim('value')} <> '' AND length({q.trim('value')}) <= 2000 AND NOT {q.never_store_value(q.trim('value'))}),
 f AS (SELECT doc_id, key, min(pos) AS first_pos FROM v GROUP BY ALL), a AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY first_pos) AS n FROM f),
 c AS (SELECT doc_id, first_pos AS cut FROM a WHERE n = 120),
 u AS (SELECT v.doc_id, v.key, v.value, v.pos, a.first_pos FROM v JOIN a ON a.doc_id = v.doc_id AND a.key = v.key AND a.n <= 120 LEFT JOIN c ON c.doc_id = v.doc_id WHERE c.cut IS NULL OR v.pos <= c.cut)"""


@query("validate_fields", oracle=f"{VALID_SQL} SELECT doc_id, key, max_by(value, pos) AS value, min(first_pos) AS first_pos FROM u GROUP BY doc_id, key")
def validate_fields(spark, sf):
    return profile.validate_fields(derived(spark, sf, "struct_entries"))[0]


@query("validate_report", oracle=f"""{VALID_SQL}, t AS (SELECT doc_id, count(*) AS total FROM struct_entries GROUP BY doc_id),
 w AS (SELECT doc_id, count(DISTINCT key) AS kept, count(*) AS used FROM u GROUP BY doc_id)
 SELECT t.doc_id, coalesce(kept, 0) AS kept, total - coalesce(used, 0) AS dropped, total FROM t LEFT JOIN w ON w.doc_id = t.doc_id""")
def validate_report(spark, sf):
    return profile.validate_fields(derived(spark, sf, "struct_entries"))[1]


_DMY = q.lit(r"^(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{4})$")


@query("normalize_values", oracle=f"""{cte('typed_values')}, v AS (SELECT row_id, key, {q.trim('value')} AS v FROM typed_values)
 SELECT row_id, key, CASE WHEN key = 'dob' AND regexp_matches(v, {_DMY}) THEN concat(regexp_extract(v, {_DMY}, 3), '-', lpad(regexp_extract(v, {_DMY}, 2), 2, '0'), '-', lpad(regexp_extract(v, {_DMY}, 1), 2, '0'))
  WHEN key = 'gender' AND regexp_matches(lower(v), '^(m|male|man)$') THEN 'male' WHEN key = 'gender' AND regexp_matches(lower(v), '^(f|female|woman)$') THEN 'female'
  WHEN key = 'gender' AND regexp_matches(lower(v), '^(o|other|non-?binary)$') THEN 'other' ELSE v END AS value FROM v""")
def normalize_values(spark, sf):
    return derived(spark, sf, "typed_values").select("row_id", "key", profile.normalize_value(F.col("key"), F.col("value")).alias("value"))


ALIAS_SQL = "CASE lower(key) " + " ".join(f"WHEN {q.lit(a)} THEN {q.lit(k)}" for a, k in rules.POPUP_ALIASES.items()) + " ELSE key END"
MERGED_SQL = f"""merged AS (SELECT user_id, key, max_by(value, o) AS value, max_by(origin, o) AS origin, max_by(updated_at, o) AS updated_at, min(entry_idx) AS key_order FROM (
  SELECT user_id, {ALIAS_SQL} AS key, value, origin, updated_at, entry_idx, CASE origin WHEN 'stored' THEN 3 WHEN 'popup' THEN 2 ELSE 1 END * 1000000000000 + entry_idx AS o
  FROM profile_entries WHERE value <> '') GROUP BY user_id, key)"""


@query("merge_profiles", oracle=f"{cte('profile_entries')}, {MERGED_SQL} SELECT user_id, key, value, origin FROM merged")
def merge_profiles(spark, sf):
    return profile.merge_profiles(derived(spark, sf, "profile_entries"))


def _harvest(spark, sf):
    controls = derived(spark, sf, "form_fields")
    usable = controls.filter(fields.is_fillable() & (F.col("width") != 0) & (F.col("height") != 0))
    keyed = fields.classify_fields(controls).select("page_id", "field_idx", "key")
    return usable, keyed


_CLASSED = _class_sql()


@query("harvest_upsert", oracle=f"""WITH cl AS ({_CLASSED}), {cte('form_fields', 'profile_entries', 'skipped_keys')[5:]},
 p AS (SELECT user_id, {ALIAS_SQL} AS key, value, updated_at FROM profile_entries WHERE value <> ''),
 h AS (SELECT f.page_id AS user_id, cl.key, {q.trim('f.value')} AS v, f.field_idx FROM form_fields f JOIN cl ON cl.page_id = f.page_id AND cl.field_idx = f.field_idx
   WHERE {_FILLABLE.replace('type', 'f.type')} AND cl.key IS NOT NULL AND cl.key <> 'never_store' AND length({q.trim('f.value')}) >= 2
   AND NOT EXISTS (SELECT 1 FROM skipped_keys s WHERE s.user_id = f.page_id AND s.key = cl.key)),
 n AS (SELECT user_id, key, max_by(v, field_idx) AS new_value, min(v) AS lo, max(v) AS hi FROM h GROUP BY ALL),
 pp AS (SELECT user_id, key, max_by(value, updated_at) AS value, max(updated_at) AS updated_at FROM p GROUP BY ALL)
 SELECT coalesce(pp.user_id, n.user_id) AS user_id, coalesce(pp.key, n.key) AS key, coalesce(n.new_value, pp.value) AS value,
  CASE WHEN n.new_value IS NULL OR (pp.value IS NOT NULL AND lo = pp.value AND hi = pp.value) THEN pp.updated_at ELSE 1800000000 END AS updated_at
 FROM pp FULL JOIN n ON n.user_id = pp.user_id AND n.key = pp.key""")
def harvest_upsert(spark, sf):
    usable, keyed = _harvest(spark, sf)
    found = usable.join(keyed, ["page_id", "field_idx"]).filter("key IS NOT NULL AND key <> 'never_store'").select(
        F.col("page_id").alias("user_id"), "key", "value", "field_idx")
    stored = derived(spark, sf, "profile_entries").filter("value <> ''").withColumn("key", profile.flatten_alias(F.col("key"))).groupBy(
        "user_id", "key").agg(F.max_by("value", "updated_at").alias("value"), F.max("updated_at").alias("updated_at"))
    return profile.harvest_upsert(stored, found, derived(spark, sf, "skipped_keys"), now=1800000000)


@query("profile_stats", oracle=f"{cte('profile_entries')} SELECT user_id, count(*) FILTER ({q.trim('value')} <> '') AS n_fields, max(updated_at) AS last_updated FROM profile_entries WHERE key <> '_skipped' GROUP BY user_id")
def profile_stats(spark, sf):
    return profile.profile_stats(derived(spark, sf, "profile_entries"))


def _profile(spark, sf):
    return derived(spark, sf, "profile_entries").select("user_id", "key", "value", F.col("entry_idx").alias("key_order"))


def corr(a: str, b: str) -> str:
    x, y = q.squash(a), q.squash(b)
    return f"({x} <> '' AND {y} <> '' AND (contains({x}, {y}) OR contains({y}, {x})))"


def namelike(a: str) -> str:
    return f"({q.squash(a)} IN {q.in_list(rules.NAME_LIKE_KEYS)} OR ends_with({q.squash(a)}, 'name'))"


def match_sql(src: str, want: str, names: bool) -> str:
    extra = f" WHEN {namelike('p.key')} AND {namelike('w.wanted')} THEN 2" if names else ""
    return f"""SELECT user_id, wanted, min_by(key, o) AS key, min_by(value, o) AS value FROM (
      SELECT w.user_id, w.wanted, p.key, p.value, CASE WHEN p.key = {q.trim('w.wanted')} THEN 0 WHEN {corr('p.key', 'w.wanted')} THEN 1{extra} END * 1000000000000 + p.entry_idx AS o
      FROM (SELECT DISTINCT user_id, {want} AS wanted FROM {src}) w JOIN profile_entries p ON p.user_id = w.user_id WHERE {q.trim('w.wanted')} <> '') WHERE o IS NOT NULL GROUP BY user_id, wanted"""


PLAN_SQL = f"""m AS ({match_sql('user_fields', 'label', True)}),
 h AS (SELECT f.user_id, f.selector, f.field_idx, f.label, m.key AS profile_key, {q.trim('m.value')} AS value, row_number() OVER (PARTITION BY f.user_id, f.selector ORDER BY f.field_idx) AS rn
   FROM user_fields f JOIN m ON m.user_id = f.user_id AND m.wanted = f.label WHERE f.type <> 'password_input' AND {q.trim('m.value')} <> '' AND length({q.trim('m.value')}) <= 2000),
 plan AS (SELECT user_id, selector, field_idx, label, profile_key, value FROM h WHERE rn = 1)"""


@query("fill_plan", oracle=f"{cte('user_fields', 'profile_entries')}, {PLAN_SQL} SELECT * FROM plan")
def fill_plan(spark, sf):
    return matching.fill_plan(derived(spark, sf, "user_fields"), _profile(spark, sf))


@query("fill_summary", oracle=f"""{cte('user_fields', 'profile_entries')}, {PLAN_SQL}, o AS (SELECT user_id, count(*) FILTER (type <> 'password_input') AS n FROM user_fields GROUP BY user_id),
 f AS (SELECT user_id, count(*) AS filled FROM plan GROUP BY user_id)
 SELECT o.user_id, CASE coalesce(filled, 0) WHEN 0 THEN 'done' WHEN 1 THEN 'type' ELSE 'fill_many' END AS action, coalesce(filled, 0) AS filled, greatest(0, n - coalesce(filled, 0)) AS remaining
 FROM o LEFT JOIN f ON f.user_id = o.user_id""")
def fill_summary(spark, sf):
    rows = derived(spark, sf, "user_fields")
    return matching.fill_summary(rows, matching.fill_plan(rows, _profile(spark, sf)))


@query("prefill_status", oracle=f"""WITH cl AS ({_CLASSED}), {cte('form_fields', 'profile_entries', 'skipped_keys')[5:]},
 p AS (SELECT user_id, {ALIAS_SQL} AS key, max(value) AS value FROM profile_entries WHERE value <> '' GROUP BY ALL),
 r AS (SELECT f.page_id, cl.key, CASE WHEN cl.key = 'never_store' THEN 'never_store' WHEN length({q.trim('f.value')}) >= 2 OR p.value IS NOT NULL THEN 'filled' ELSE 'unknown' END AS status
   FROM form_fields f JOIN cl ON cl.page_id = f.page_id AND cl.field_idx = f.field_idx LEFT JOIN p ON p.user_id = f.page_id AND p.key = cl.key
   WHERE {_FILLABLE.replace('type', 'f.type')} AND cl.key IS NOT NULL AND NOT EXISTS (SELECT 1 FROM skipped_keys s WHERE s.user_id = f.page_id AND s.key = cl.key))
 SELECT page_id, count(*) FILTER (status = 'filled') AS filled, count(DISTINCT CASE WHEN status = 'unknown' THEN key END) AS unknown, count(*) FILTER (status = 'never_store') AS never_store FROM r GROUP BY page_id""")
def prefill_status(spark, sf):
    usable, keyed = _harvest(spark, sf)
    known = derived(spark, sf, "profile_entries").filter("value <> ''").withColumn("key", profile.flatten_alias(F.col("key"))).groupBy(
        "user_id", "key").agg(F.max("value").alias("value"))
    return matching.prefill_status(usable, keyed, known, derived(spark, sf, "skipped_keys"))


@query("fill_confidence", oracle=f"""{cte('claims', 'profile_entries')}, m AS ({match_sql('claims', "coalesce(profile_key, '')", False)}),
 j AS (SELECT c.claim_id, m.key, lower({q.trim("coalesce(m.value, '')")}) AS have, lower({q.trim('c.value')}) AS typed, coalesce(c.profile_key, '') = '' OR NOT EXISTS (SELECT 1 FROM profile_entries e WHERE e.user_id = c.user_id) AS no_base
   FROM claims c LEFT JOIN m ON m.user_id = c.user_id AND m.wanted = coalesce(c.profile_key, ''))
 SELECT claim_id, key AS resolved_key, CASE WHEN no_base THEN 60 WHEN key IS NULL THEN 50 WHEN have = typed THEN 100 WHEN contains(have, typed) OR contains(typed, have) THEN 85 ELSE 70 END AS confidence FROM j""")
def fill_confidence(spark, sf):
    return matching.fill_confidence(derived(spark, sf, "claims"), _profile(spark, sf))


VAULT_TEXTS = """vault AS (SELECT owner_id, text FROM (SELECT cast(substr(source, 4) AS BIGINT) AS owner_id, text,
  row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS rn, sum(strlen(text)) OVER (PARTITION BY source ORDER BY doc_id DESC) AS sz FROM documents) WHERE rn <= 5 AND (rn = 1 OR sz <= 262144))"""


@query("provenance_check", oracle=f"""{cte('claims', 'profile_entries')}, {VAULT_TEXTS}, m AS ({match_sql('claims', "coalesce(profile_key, '')", False)}),
 j AS (SELECT c.claim_id, c.user_id, c.label, lower({q.trim('c.value')}) AS needle, m.key AS rkey, coalesce({q.trim('m.value')} <> '' AND lower({q.trim('m.value')}) = lower({q.trim('c.value')}), false) AS pm
   FROM claims c LEFT JOIN m ON m.user_id = c.user_id AND m.wanted = coalesce(c.profile_key, '')),
 k AS (SELECT *, length(needle) >= 2 AND EXISTS (SELECT 1 FROM vault v WHERE v.owner_id = j.user_id AND contains(lower(v.text), needle)) AS vm,
   length(needle) >= 2 AND EXISTS (SELECT 1 FROM profile_entries p WHERE p.user_id = j.user_id AND contains(lower(p.value), needle)) AS tm,
   EXISTS (SELECT 1 FROM profile_entries p WHERE p.user_id = j.user_id AND p.key NOT IN ('raw', 'notes', 'Notes') AND needle <> '' AND lower({q.trim('p.value')}) = needle
      AND NOT ({corr('p.key', 'j.label')} OR ({namelike('p.key')} AND {namelike('j.label')}))) AS conflict FROM j),
 d AS (SELECT claim_id, CASE WHEN pm THEN 'profile' WHEN vm THEN 'vault' WHEN tm THEN 'profile_text' END AS found,
   label <> '' AND ((rkey IS NOT NULL AND NOT {corr('rkey', 'label')}) OR (NOT pm AND conflict)) AS bad FROM k)
 SELECT claim_id, CASE WHEN NOT bad THEN found END AS source, found IS NOT NULL AND NOT bad AS accepted FROM d""")
def provenance_check(spark, sf):
    docs = table(spark, sf, "documents").selectExpr("cast(substr(source, 4) AS bigint) AS owner_id", "doc_id", "doc_id AS extracted_at", "text")
    vault = documents.vault_retention(docs)
    return matching.provenance(derived(spark, sf, "claims"), _profile(spark, sf), vault)


ALL_TEXTS = "vault AS (SELECT cast(substr(source, 4) AS BIGINT) AS owner_id, text FROM documents)"


@query("provenance_all", oracle=f"""{cte('claims', 'profile_entries')}, {ALL_TEXTS}, m AS ({match_sql('claims', "coalesce(profile_key, '')", False)}),
 j AS (SELECT c.claim_id, c.user_id, c.label, lower({q.trim('c.value')}) AS needle, m.key AS rkey, coalesce({q.trim('m.value')} <> '' AND lower({q.trim('m.value')}) = lower({q.trim('c.value')}), false) AS pm
   FROM claims c LEFT JOIN m ON m.user_id = c.user_id AND m.wanted = coalesce(c.profile_key, '')),
 k AS (SELECT *, length(needle) >= 2 AND EXISTS (SELECT 1 FROM vault v WHERE v.owner_id = j.user_id AND contains(lower(v.text), needle)) AS vm,
   length(needle) >= 2 AND EXISTS (SELECT 1 FROM profile_entries p WHERE p.user_id = j.user_id AND contains(lower(p.value), needle)) AS tm,
   EXISTS (SELECT 1 FROM profile_entries p WHERE p.user_id = j.user_id AND p.key NOT IN ('raw', 'notes', 'Notes') AND needle <> '' AND lower({q.trim('p.value')}) = needle
      AND NOT ({corr('p.key', 'j.label')} OR ({namelike('p.key')} AND {namelike('j.label')}))) AS conflict FROM j),
 d AS (SELECT claim_id, CASE WHEN pm THEN 'profile' WHEN vm THEN 'vault' WHEN tm THEN 'profile_text' END AS found,
   label <> '' AND ((rkey IS NOT NULL AND NOT {corr('rkey', 'label')}) OR (NOT pm AND conflict)) AS bad FROM k)
 SELECT claim_id, CASE WHEN NOT bad THEN found END AS source, found IS NOT NULL AND NOT bad AS accepted FROM d""")
def provenance_all(spark, sf):
    """Claims against every document of their user."""
    vault = table(spark, sf, "documents").selectExpr("cast(substr(source, 4) AS bigint) AS owner_id", "text")
    return matching.provenance(derived(spark, sf, "claims"), _profile(spark, sf), vault, retained=False)


def _best(src: str, want: str, keys: str, order: str) -> str:
    """First key that correlates, then first name-like one, for the distinct wanted texts."""
    return f"""SELECT user_id, wanted, min_by(key, o) AS key, min_by(value, o) AS value FROM (
      SELECT w.user_id, w.wanted, p.key, p.value, CASE WHEN {corr('p.key', 'w.wanted')} THEN 0 WHEN {namelike('p.key')} AND {namelike('w.wanted')} THEN 1 END * 1000000000000 + p.{order} AS o
      FROM (SELECT DISTINCT user_id, {want} AS wanted FROM {src}) w JOIN {keys} p ON p.user_id = w.user_id) WHERE o IS NOT NULL GROUP BY user_id, wanted"""


@query("fill_rewrite", oracle=f"""{cte('claims', 'profile_entries', 'user_fields')}, {VAULT_TEXTS},
 ff AS (SELECT user_id, label AS key, min_by(selector, field_idx) AS value, min(field_idx) AS ko FROM user_fields WHERE type <> 'password_input' AND label <> '' GROUP BY ALL),
 tg AS ({_best('claims', 'label', 'ff', 'ko')}),
 pl AS (SELECT c.claim_id, c.user_id, c.label, {q.trim('c.value')} AS proposed, tg.key AS field_label, tg.value AS selector FROM claims c JOIN tg ON tg.user_id = c.user_id AND tg.wanted = c.label WHERE c.label <> ''),
 m1 AS ({match_sql('claims', 'label', True)}), m2 AS ({match_sql('pl', 'field_label', True)}),
 k AS (SELECT pl.*, coalesce(m1.key, m2.key) AS pk, {q.trim('CASE WHEN m1.key IS NOT NULL THEN m1.value ELSE m2.value END')} AS own FROM pl
   LEFT JOIN m1 ON m1.user_id = pl.user_id AND m1.wanted = pl.label LEFT JOIN m2 ON m2.user_id = pl.user_id AND m2.wanted = pl.field_label),
 v AS (SELECT *, CASE WHEN coalesce(own, '') <> '' THEN own WHEN length(proposed) >= 2 AND (EXISTS (SELECT 1 FROM vault t WHERE t.owner_id = k.user_id AND contains(lower(t.text), lower(proposed)))
   OR EXISTS (SELECT 1 FROM profile_entries p WHERE p.user_id = k.user_id AND contains(lower(p.value), lower(proposed)))) THEN proposed END AS value FROM k),
 r AS (SELECT *, row_number() OVER (PARTITION BY user_id, selector ORDER BY claim_id) AS rn FROM v WHERE coalesce(value, '') <> '')
 SELECT user_id, selector, claim_id, value, coalesce(pk, label) AS profile_key FROM r WHERE rn = 1""")
def fill_rewrite(spark, sf):
    docs = table(spark, sf, "documents").selectExpr("cast(substr(source, 4) AS bigint) AS owner_id", "doc_id", "doc_id AS extracted_at", "text")
    return matching.rewrite_fill(
        derived(spark, sf, "claims"), derived(spark, sf, "user_fields"), _profile(spark, sf), documents.vault_retention(docs))


def _reply_sql() -> str:
    from redactframe.plans.agents import _REPLY_SQL

    with_, body = cte("replies"), _REPLY_SQL
    return body[len(with_):]


_REPLY_ATTEMPTS = f"""fr AS (SELECT a.reply_id, o.user_id, cast(CASE a.pos WHEN 1 THEN o.c1 ELSE o.c2 END AS JSON) AS j FROM (SELECT * FROM acts WHERE action = 'fill') a JOIN replies o USING (reply_id)),
 tries AS (SELECT reply_id, user_id, p AS claim_id, coalesce(nullif(e ->> '$.profileKey', ''), nullif(e ->> '$.label', ''), e ->> '$.selector') AS label,
   CASE WHEN json_type(e, '$.value') = 'VARCHAR' THEN e ->> '$.value' END AS value, e ->> '$.selector' AS selector FROM (
    SELECT reply_id, user_id, unnest(cast(json_extract(j, '$.fields') AS JSON[])) AS e, generate_subscripts(cast(json_extract(j, '$.fields') AS JSON[]), 1) AS p FROM fr WHERE json_type(j, '$.fields') = 'ARRAY')
    WHERE json_type(e) = 'OBJECT'
  UNION ALL SELECT reply_id, user_id, i, ks[i], json_extract_string(j, concat('$.fields."', ks[i], '"')), NULL FROM (SELECT *, unnest(range(1, len(ks) + 1)) AS i FROM (
    SELECT reply_id, user_id, j, json_keys(j, '$.fields') AS ks FROM fr WHERE json_type(j, '$.fields') = 'OBJECT')))"""


@query("reply_fill_fields", oracle=f"""{cte('replies', 'profile_entries', 'user_fields')}, {VAULT_TEXTS}, acts AS ({cte('replies')}{_reply_sql()}), {_REPLY_ATTEMPTS},
 ff AS (SELECT user_id, label AS key, min_by(selector, field_idx) AS value, min(field_idx) AS ko FROM user_fields WHERE type <> 'password_input' AND label <> '' GROUP BY ALL),
 ps AS (SELECT user_id, selector, min_by(label, field_idx) AS label, min_by(type, field_idx) AS type FROM user_fields GROUP BY ALL),
 un AS (SELECT tries.* FROM tries LEFT JOIN ps ON ps.user_id = tries.user_id AND ps.selector = tries.selector WHERE ps.selector IS NULL),
 tg AS ({_best('un', 'label', 'ff', 'ko')}),
 pl AS (SELECT u.reply_id, u.claim_id, u.user_id, u.label, {q.trim('u.value')} AS proposed, tg.key AS field_label, tg.value AS selector FROM un u JOIN tg ON tg.user_id = u.user_id AND tg.wanted = u.label WHERE u.label <> ''
   UNION ALL SELECT tries.reply_id, tries.claim_id, tries.user_id, tries.label, {q.trim('tries.value')}, ps.label, tries.selector FROM tries JOIN ps ON ps.user_id = tries.user_id AND ps.selector = tries.selector WHERE ps.type <> 'password_input'),
 m1 AS ({match_sql('pl', 'label', True)}), m2 AS ({match_sql('pl', 'field_label', True)}),
 k AS (SELECT pl.*, coalesce(m1.key, m2.key) AS pk, {q.trim('CASE WHEN m1.key IS NOT NULL THEN m1.value ELSE m2.value END')} AS own FROM pl
   LEFT JOIN m1 ON m1.user_id = pl.user_id AND m1.wanted = pl.label LEFT JOIN m2 ON m2.user_id = pl.user_id AND m2.wanted = pl.field_label),
 v AS (SELECT *, CASE WHEN coalesce(own, '') <> '' THEN own WHEN length(proposed) >= 2 AND (EXISTS (SELECT 1 FROM vault t WHERE t.owner_id = k.user_id AND contains(lower(t.text), lower(proposed)))
   OR EXISTS (SELECT 1 FROM profile_entries p WHERE p.user_id = k.user_id AND contains(lower(p.value), lower(proposed)))) THEN proposed END AS value FROM k), {PLAN_SQL},
 z AS (SELECT reply_id, selector, value, coalesce(pk, label) AS profile_key, 0 AS stage, claim_id AS place FROM v WHERE coalesce(value, '') <> ''
   UNION ALL SELECT fr.reply_id, plan.selector, plan.value, plan.profile_key, 1, plan.field_idx FROM fr JOIN plan ON plan.user_id = fr.user_id)
 SELECT reply_id, selector, value, profile_key FROM (SELECT *, row_number() OVER (PARTITION BY reply_id, selector ORDER BY stage, place) AS rn FROM z) WHERE rn = 1""")
def reply_fill_fields(spark, sf):
    """Replies to verified typed values: candidates, first valid action, proposals, page fields."""
    from redactframe.operators import agents

    docs = table(spark, sf, "documents").selectExpr("cast(substr(source, 4) AS bigint) AS owner_id", "doc_id", "doc_id AS extracted_at", "text")
    actions = agents.reply_actions(derived(spark, sf, "replies").select("reply_id", "user_id", "raw"))
    return matching.reply_fills(actions, derived(spark, sf, "user_fields"), _profile(spark, sf), documents.vault_retention(docs))


def _all_texts(spark, sf):
    return table(spark, sf, "documents").selectExpr("cast(substr(source, 4) AS bigint) AS owner_id", "text")


@query("fill_rewrite_all", oracle=ORACLES["fill_rewrite"].replace(VAULT_TEXTS, ALL_TEXTS))
def fill_rewrite_all(spark, sf):
    """As ``fill_rewrite``, against every document of the user."""
    return matching.rewrite_fill(derived(spark, sf, "claims"), derived(spark, sf, "user_fields"), _profile(spark, sf), _all_texts(spark, sf), retained=False)


@query("reply_fill_fields_all", oracle=ORACLES["reply_fill_fields"].replace(VAULT_TEXTS, ALL_TEXTS))
def reply_fill_fields_all(spark, sf):
    """As ``reply_fill_fields``, against every document of the user."""
    from redactframe.operators import agents

    actions = agents.reply_actions(derived(spark, sf, "replies").select("reply_id", "user_id", "raw"))
    return matching.reply_fills(actions, derived(spark, sf, "user_fields"), _profile(spark, sf), _all_texts(spark, sf), retained=False)


@query("profile_export", oracle="SELECT 'customer-' || c_custkey AS profile_name, unnest(['name', 'segment', 'nation']) AS key, unnest([c_name, c_mktsegment, CAST(c_nationkey AS VARCHAR)]) AS value FROM customer")
def profile_export(spark, sf):
    """Entries written as the export and read back."""
    entries = table(spark, sf, "customer").selectExpr("concat('customer-', c_custkey) AS profile_name", "stack(3, 'name', c_name, 'segment', c_mktsegment, 'nation', string(c_nationkey)) AS (key, value)")
    path = f"{work_folder(spark)}/profiles"
    files.write_profiles(entries, path, buckets=8)
    return spark.read.schema(entries.schema).json(path).drop("bucket")
