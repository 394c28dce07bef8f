"""Queries: replies, actions, sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from redactframe import rules
from redactframe.operators import agents, audit
from redactframe.plans import sqltext as q
from redactframe.plans.audit import EV, _events
from redactframe.plans.registry import query
from redactframe.sources.shapes import cte
from redactframe.sources.tables import derived, table

_T = q.trim("selector")
_SAFE = q.has(_T, rules.SELECTOR_SAFE)
REJECT = f"""CASE action
 WHEN 'click' THEN CASE WHEN coalesce({_T}, '') <> '' OR coalesce({q.trim('text')}, '') <> '' THEN NULL WHEN x IS NULL OR y IS NULL THEN 'NO_TARGET'
   WHEN NOT (x BETWEEN 0 AND 65535 AND y BETWEEN 0 AND 65535) THEN 'BAD_COORDINATES' END
 WHEN 'type' THEN CASE WHEN selector IS NULL OR value IS NULL THEN 'MISSING_FIELD' WHEN {_T} = '' OR length({_T}) > 256 OR NOT {_SAFE} THEN 'BAD_SELECTOR'
   WHEN length(value) > 2000 THEN 'VALUE_TOO_LONG' WHEN length(value) > 100 AND NOT {q.has("coalesce(prompt, '')", rules.INJECTION_INTENT, True)} THEN 'LONG_VALUE' END
 WHEN 'write_code' THEN CASE WHEN coalesce(code, value, '') = '' THEN 'EMPTY_CODE' END
 WHEN 'scroll' THEN CASE WHEN NOT coalesce(direction IN ('up', 'down'), false) THEN 'BAD_DIRECTION' END
 WHEN 'navigate' THEN CASE WHEN url IS NULL OR length(url) > 2048 OR NOT coalesce({q.scheme('url')} IN ('http', 'https'), false) OR {q.host('url')} IS NULL THEN 'BAD_URL' END
 WHEN 'done' THEN NULL WHEN 'key_press' THEN NULL WHEN 'wait' THEN NULL
 WHEN 'hover' THEN CASE WHEN selector IS NULL THEN 'MISSING_FIELD' END WHEN 'clear' THEN CASE WHEN selector IS NULL THEN 'MISSING_FIELD' END
 WHEN 'focus' THEN CASE WHEN selector IS NULL THEN 'MISSING_FIELD' END WHEN 'extract_text' THEN CASE WHEN selector IS NULL THEN 'MISSING_FIELD' END
 WHEN 'fill_many' THEN CASE WHEN NOT coalesce(n_fields > 0, false) THEN 'NO_FIELDS' END WHEN 'fill' THEN CASE WHEN NOT coalesce(n_attempts > 0, false) THEN 'NO_FIELDS' END
 WHEN 'select' THEN CASE WHEN selector IS NULL THEN 'MISSING_FIELD' END ELSE 'UNKNOWN_ACTION' END"""
_PLACE = f"action = 'click' AND coalesce({_T}, '') = '' AND coalesce({q.trim('text')}, '') = '' AND reason IS NULL"


@query("validate_actions", oracle=f"""{cte('actions')}, a AS (SELECT * REPLACE (CASE WHEN action = 'fill_field' THEN 'type' ELSE action END AS action), 0 AS n_attempts FROM actions),
 r AS (SELECT *, {REJECT} AS reason FROM a)
 SELECT action_id, action, reason, CASE WHEN action IN ('hover', 'clear', 'focus', 'extract_text') THEN substr({_T}, 1, 256) ELSE {_T} END AS selector,
  CASE WHEN {_PLACE} THEN cast(floor(x + 0.5) AS BIGINT) END AS x, CASE WHEN {_PLACE} THEN cast(floor(y + 0.5) AS BIGINT) END AS y,
  CASE WHEN action = 'done' THEN substr(coalesce(summary, ''), 1, 500) END AS summary, CASE WHEN action = 'wait' THEN coalesce(ms, 1000) END AS ms FROM r""")
def validate_actions(spark, sf):
    return agents.validate_actions(derived(spark, sf, "actions"))


def _js(name: str, of: str = "j") -> str:
    return f"CASE WHEN json_type({of}, '$.{name}') = 'VARCHAR' THEN {of} ->> '$.{name}' END"


def _jn(name: str) -> str:
    return f"CASE WHEN json_type(j, '$.{name}') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN cast(j ->> '$.{name}' AS DOUBLE) END"


_FS = q.trim(_js("selector", "e"))
_REPLY_SQL = f"""{cte('replies')}, c AS (SELECT reply_id, 1 AS pos, cast(c1 AS JSON) AS j FROM replies UNION ALL SELECT reply_id, 2, cast(c2 AS JSON) FROM replies),
 u AS (SELECT reply_id, pos, p, e, {_FS} AS s, {_js('value', 'e')} AS v, {_js('profileKey', 'e')} AS k FROM (
   SELECT reply_id, pos, unnest(cast(json_extract(j, '$.fields') AS JSON[])) AS e, generate_subscripts(cast(json_extract(j, '$.fields') AS JSON[]), 1) AS p
   FROM c WHERE j ->> '$.action' = 'fill_many' AND json_type(j, '$.fields') = 'ARRAY') WHERE coalesce(e ->> '$.action', 'type') = 'type'),
 w AS (SELECT reply_id, pos, s, min_by(v, p) AS v, min_by(k, p) AS k, min(p) AS p FROM u WHERE s <> '' AND length(s) <= 256 AND {q.has('s', rules.SELECTOR_SAFE)} AND length(v) <= 2000 GROUP BY ALL),
 n AS (SELECT reply_id, pos, count(*) AS n_fields, min_by(s, p) AS s, min_by(v, p) AS v, min_by(k, p) AS k, string_agg(concat(s, '=', v), '; ' ORDER BY p) AS fields FROM w GROUP BY ALL),
 a AS (SELECT c.reply_id, c.pos, CASE WHEN n_fields = 1 OR j ->> '$.action' = 'fill_field' THEN 'type' ELSE {_js('action')} END AS action,
   CASE WHEN n_fields = 1 THEN n.s WHEN j ->> '$.action' = 'fill_field' THEN coalesce({_js('field_selector')}, {_js('selector')}) ELSE {_js('selector')} END AS selector,
   CASE WHEN n_fields = 1 THEN n.v WHEN j ->> '$.action' = 'select' THEN coalesce(j ->> '$.value', '') ELSE {_js('value')} END AS value,
   {', '.join(f'{_js(x)} AS {x}' for x in ('text', 'code', 'direction', 'url', 'summary', 'key'))}, {', '.join(f'{_jn(x)} AS {x}' for x in ('x', 'y', 'ms'))},
   CASE WHEN n_fields = 1 THEN n.k ELSE {_js('profileKey')} END AS profile_key, coalesce(n_fields, 0) AS n_fields, n.fields, 'type this in' AS prompt,
   CASE WHEN j ->> '$.action' = 'fill' THEN CASE json_type(j, '$.fields') WHEN 'ARRAY' THEN json_array_length(j, '$.fields') WHEN 'OBJECT' THEN 1 END END AS n_attempts FROM c LEFT JOIN n USING (reply_id, pos)),
 r AS (SELECT *, CASE WHEN action IS NULL THEN 'NO_ACTION' ELSE {REJECT} END AS reason, {_T} AS sel, {q.trim('text')} AS txt FROM a),
 f AS (SELECT *, row_number() OVER (PARTITION BY reply_id ORDER BY pos) AS rn, action = 'click' AND coalesce(sel, '') = '' AND coalesce(txt, '') <> '' AS worded,
   action = 'click' AND coalesce(sel, '') = '' AND coalesce(txt, '') = '' AS place FROM r WHERE reason IS NULL)
 SELECT o.reply_id, action, CASE WHEN action = 'click' THEN nullif(sel, '') WHEN action = 'write_code' THEN coalesce(sel, '') WHEN action IN ('type', 'select') THEN sel
   WHEN action IN ('hover', 'extract_text', 'clear', 'focus') THEN substr(sel, 1, 256) END AS selector, CASE WHEN worded THEN txt END AS text,
   CASE WHEN place THEN cast(floor(x + 0.5) AS BIGINT) END AS x, CASE WHEN place THEN cast(floor(y + 0.5) AS BIGINT) END AS y,
   CASE WHEN action IN ('type', 'select') THEN value END AS value, CASE WHEN action = 'write_code' THEN coalesce(code, value) END AS code,
   CASE WHEN action = 'scroll' THEN direction END AS direction, CASE WHEN action = 'navigate' THEN url END AS url,
   CASE WHEN action = 'done' THEN substr(coalesce(summary, ''), 1, 500) END AS summary, CASE WHEN action = 'key_press' THEN substr(coalesce(key, 'Enter'), 1, 50) END AS key,
   CASE WHEN action = 'wait' THEN coalesce(ms, 1000) END AS ms, CASE WHEN action = 'type' THEN profile_key END AS profile_key,
   CASE WHEN action = 'fill_many' THEN fields END AS fields, f.pos FROM replies o LEFT JOIN f ON f.reply_id = o.reply_id AND rn = 1"""


@query("reply_actions", oracle=f"SELECT * EXCLUDE (pos) FROM ({_REPLY_SQL})")
def reply_actions(spark, sf):
    found = agents.reply_actions(derived(spark, sf, "replies").select("reply_id", "raw")).drop("attempts")
    return found.withColumn("fields", F.array_join(F.transform("fields", lambda e: F.concat(e["selector"], F.lit("="), e["value"])), "; "))


@query("fill_many", oracle=f"""{cte('fill_items')}, t AS (SELECT action_id, pos, {_T} AS selector, value FROM fill_items WHERE value IS NOT NULL AND {_T} <> '' AND {_SAFE}),
 f AS (SELECT action_id, selector, min_by(value, pos) AS value, min(pos) AS pos FROM t GROUP BY ALL)
 SELECT action_id, selector, value, pos, CASE WHEN count(*) OVER (PARTITION BY action_id) = 1 THEN 'type' ELSE 'fill_many' END AS action FROM f""")
def fill_many(spark, sf):
    return agents.fill_many(derived(spark, sf, "fill_items"))


@query("stuck_sessions", oracle=f"""WITH {EV}, l AS (SELECT *, lag(event_type) OVER w AS p1, lag(event_type, 2) OVER w AS p2 FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts_ms, event_id)),
 h AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts_ms, event_id) AS rn FROM l WHERE event_type = p1 AND p1 = p2)
 SELECT user_id, event_id AS stop_event, ts_ms AS stop_ms, event_type AS signature FROM h WHERE rn = 1""")
def stuck_sessions(spark, sf):
    return agents.stuck_keys(_events(spark, sf), "user_id", "ts_ms", "event_id", F.col("event_type"), audit.day_of(F.col("ts_ms")))


@query("failure_runs", oracle=f"""WITH {EV}, g AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts_ms, event_id ROWS UNBOUNDED PRECEDING) AS g FROM e)
 SELECT user_id, count(*) AS length, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms FROM g WHERE event_type = 'error' GROUP BY user_id, g HAVING count(*) >= 2""")
def failure_runs(spark, sf):
    return agents.failure_runs(_events(spark, sf), "user_id", "ts_ms", "event_id", F.col("event_type") == "error", audit.day_of(F.col("ts_ms")))


def _num(x: str) -> str:
    return f"regexp_replace(cast(cast({x} AS DECIMAL(20, 6)) AS VARCHAR), '\\.?0+$', '')"


_LABEL = f"""CASE WHEN action = 'done' THEN concat('Done: ', coalesce(nullif(summary, ''), 'Task complete.')) ELSE concat('[', step + 1, '] ', action,
 CASE WHEN action = 'write_code' THEN concat(' (', length(coalesce(code, '')), ' chars)') ELSE concat(
  CASE WHEN coalesce(selector, '') <> '' THEN concat(' → ', selector) ELSE '' END, CASE WHEN coalesce(value, '') <> '' THEN concat(' = "', substr(value, 1, 40), '"') ELSE '' END,
  CASE WHEN coalesce(key, '') <> '' THEN concat(' [', key, ']') ELSE '' END, CASE WHEN coalesce(text, '') <> '' THEN concat(' "', text, '"') ELSE '' END,
  CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN concat(' at (', {_num('x')}, ', ', {_num('y')}, ')') ELSE '' END) END) END"""


@query("step_log", oracle=f"""{cte('actions')}, n AS (SELECT session_id, action, row_number() OVER (PARTITION BY session_id ORDER BY step, action_id) AS n, {_LABEL} AS label FROM actions),
 d AS (SELECT session_id, min(n) AS stop FROM n WHERE action = 'done' AND n <= 15 GROUP BY session_id)
 SELECT n.session_id, string_agg(label, chr(10) ORDER BY n) AS log, count(*) AS steps FROM n LEFT JOIN d ON d.session_id = n.session_id WHERE n <= 15 AND (stop IS NULL OR n <= stop) GROUP BY n.session_id""")
def step_log(spark, sf):
    return agents.step_log(derived(spark, sf, "actions"))


@query("session_memory", oracle="""SELECT conv_id, turn, role, CASE WHEN role = 'assistant' THEN substr(text, 1, 500) ELSE text END AS text FROM (
 SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 6""")
def session_memory(spark, sf):
    return agents.session_memory(table(spark, sf, "conversations"))


_CLEANED = q.trim("regexp_replace(first_text, '[📸🔒]', '', 'g')")


@query("session_names", oracle=f"""WITH f AS (SELECT conv_id, min_by(text, turn) FILTER (role = 'user') AS first_text, count(*) AS messages FROM conversations GROUP BY conv_id)
 SELECT conv_id, CASE WHEN first_text IS NULL THEN 'New chat' WHEN length({_CLEANED}) > 30 THEN concat(substr({_CLEANED}, 1, 30), '…') ELSE {_CLEANED} END AS name, messages FROM f""")
def session_names(spark, sf):
    return agents.session_names(table(spark, sf, "conversations"))


_SESS = """SELECT c_nationkey AS owner_id, c_custkey AS session_id, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_custkey % 7 END AS messages FROM customer"""


@query("prune_sessions", oracle=f"WITH s AS ({_SESS}) SELECT owner_id, session_id, messages FROM (SELECT *, row_number() OVER (PARTITION BY owner_id, messages = 0 ORDER BY session_id) AS rn FROM s) WHERE messages > 0 OR rn = 1")
def prune_sessions(spark, sf):
    s = table(spark, sf, "customer").selectExpr(
        "c_nationkey AS owner_id", "c_custkey AS session_id", "CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_custkey % 7 END AS messages")
    return agents.prune_empty(s)


_OUT = """CASE WHEN capture_error IS NOT NULL THEN 'capture' WHEN model_error IS NOT NULL THEN 'model' WHEN action IS NULL THEN 'no_action' WHEN exec_error IS NOT NULL THEN 'execute'
 WHEN action IN ('done', 'fill_many') THEN 'done' WHEN step >= 10 THEN 'max_steps' ELSE 'continue' END"""


@query("run_outcomes", oracle=f"{cte('runs')}, o AS (SELECT *, {_OUT} AS outcome FROM runs) SELECT run_id, outcome, CASE WHEN outcome = 'done' THEN CASE WHEN action = 'fill_many' THEN concat('Filled ', filled, ' field(s).') ELSE summary END END AS summary FROM o")
def run_outcomes(spark, sf):
    return derived(spark, sf, "runs").select("run_id", agents.run_outcome().alias("outcome"), agents.run_summary().alias("summary"))
