"""Queries: audit logs, budgets, gates, ordered event analytics (batch twins of the streams)."""

from __future__ import annotations

from pyspark.sql import functions as F

from redactframe import rules
from redactframe.operators import audit
from redactframe.plans import sqltext as q
from redactframe.plans.registry import ORACLES, query
from redactframe.sources import files
from redactframe.sources.shapes import cte
from redactframe.sources.tables import derived, events
from redactframe.streaming.streams import work_folder

EV = "e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) // 1000 AS ts_ms FROM events)"


def _events(spark, sf):
    return events(spark, sf).select("event_id", "user_id", "event_type", "value", F.unix_millis("ts").alias("ts_ms"))


@query("audit_actions", oracle=f"{cte('actions')} SELECT action_id, session_id, action, nullif(selector, '') AS selector, CASE WHEN coalesce(value, '') <> '' THEN '[REDACTED]' END AS value, nullif(url, '') AS url, approved, result FROM actions")
def audit_actions(spark, sf):
    return audit.audit_actions(derived(spark, sf, "actions"))


@query("audit_export", oracle=f"""{cte('audit_rows')} SELECT coalesce(nullif(timestamp, ''), time) AS timestamp, domain, CASE WHEN coalesce(fields_redacted, 0) <> 0 THEN fields_redacted ELSE fields END AS "fieldsRedacted", faces_detected AS "facesDetected" FROM audit_rows""")
def audit_export(spark, sf):
    return audit.export_rows(derived(spark, sf, "audit_rows"))


@query("audit_sink", oracle=ORACLES["audit_export"])
def audit_sink(spark, sf):
    """The export written as CSV and read back."""
    rows, path = audit.export_rows(derived(spark, sf, "audit_rows")), f"{work_folder(spark)}/audit"
    files.write_audit(rows, path)
    return spark.read.option("header", True).schema(rows.schema).csv(path)


@query("audit_rollup", oracle=f"{cte('audit_rows')} SELECT domain, count(*) AS scans, cast(sum(CASE WHEN coalesce(fields_redacted, 0) <> 0 THEN fields_redacted ELSE coalesce(fields, 0) END) AS BIGINT) AS fields, cast(sum(coalesce(faces_detected, faces, 0)) AS BIGINT) AS faces FROM audit_rows GROUP BY domain")
def audit_rollup(spark, sf):
    return audit.rollup(derived(spark, sf, "audit_rows"))


@query("audit_retention", oracle=f"WITH {EV}, r AS (SELECT user_id, event_id, ts_ms, row_number() OVER (PARTITION BY user_id ORDER BY ts_ms DESC, event_id DESC) AS age_rank FROM e) SELECT * FROM r WHERE age_rank <= 50")
def audit_retention(spark, sf):
    return audit.keep_newest(_events(spark, sf).select("user_id", "event_id", "ts_ms"), ["user_id"], ["ts_ms", "event_id"], rules.SCAN_LOG_CAP)


@query("audit_retention_agent", oracle=f"WITH {EV}, r AS (SELECT event_type, event_id, ts_ms, row_number() OVER (PARTITION BY event_type ORDER BY ts_ms DESC, event_id DESC) AS age_rank FROM e) SELECT * FROM r WHERE age_rank <= 500")
def audit_retention_agent(spark, sf):
    return audit.keep_newest(_events(spark, sf).select("event_type", "event_id", "ts_ms"), ["event_type"], ["ts_ms", "event_id"], rules.ACTION_LOG_CAP)


_DELTAS = {"fields": "click", "faces": "view", "pii": "error"}


@query("privacy_budget", oracle=f"WITH {EV} SELECT user_id, event_id, ts_ms, " + ", ".join(
    f"cast(sum(CASE WHEN event_type = '{t}' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS total_{c}" for c, t in _DELTAS.items()
) + " FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts_ms, event_id ROWS UNBOUNDED PRECEDING)")
def privacy_budget(spark, sf):
    d = _events(spark, sf).select("user_id", "event_id", "ts_ms", *[
        F.when(F.col("event_type") == t, 1).otherwise(0).alias(c) for c, t in _DELTAS.items()])
    return audit.privacy_budget(d, "user_id", "ts_ms", "event_id", list(_DELTAS)).drop(*_DELTAS)


HOUR = 3_600_000
GREEDY_SQL = """RECURSIVE {ev}, n AS (SELECT user_id, event_id, ts_ms, row_number() OVER (PARTITION BY user_id ORDER BY ts_ms, event_id) AS i FROM e),
 g AS (SELECT user_id, event_id, ts_ms, i, true AS accepted, ts_ms AS last, cast(NULL AS BIGINT) AS before FROM n WHERE i = 1
  UNION ALL SELECT n.user_id, n.event_id, n.ts_ms, n.i, n.ts_ms - g.last >= {gap}, CASE WHEN n.ts_ms - g.last >= {gap} THEN n.ts_ms ELSE g.last END, g.last
  FROM g JOIN n ON n.user_id = g.user_id AND n.i = g.i + 1)"""


@query("risk_cache", oracle=f"WITH {GREEDY_SQL.format(ev=EV, gap=6 * HOUR)} SELECT user_id, event_id, ts_ms, accepted AS recomputed, last AS report_ts FROM g")
def risk_cache(spark, sf):
    return audit.risk_cache(_events(spark, sf).select("user_id", "event_id", "ts_ms"), "user_id", "ts_ms", "event_id", 6 * HOUR)


@query("rate_limit", oracle=f"WITH {GREEDY_SQL.format(ev=EV, gap=12 * HOUR)} SELECT user_id, event_id, ts_ms, accepted, CASE WHEN NOT accepted THEN {12 * HOUR} - (ts_ms - before) END AS retry_after_ms FROM g")
def rate_limit(spark, sf):
    return audit.rate_limit(_events(spark, sf).select("user_id", "event_id", "ts_ms"), "user_id", "ts_ms", "event_id", 12 * HOUR)


@query("debounce_sessions", oracle=f"""WITH {EV}, p AS (SELECT *, lag(ts_ms) OVER (PARTITION BY user_id ORDER BY ts_ms, event_id) AS prev FROM e WHERE event_type <> 'signup'),
 s AS (SELECT *, sum(CASE WHEN prev IS NULL OR ts_ms - prev > {2 * HOUR} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts_ms, event_id ROWS UNBOUNDED PRECEDING) AS b FROM p)
 SELECT user_id, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms, count(*) AS n FROM s GROUP BY user_id, b""")
def debounce_sessions(spark, sf):
    page_changes = _events(spark, sf).filter("event_type <> 'signup'").select("user_id", "event_id", "ts_ms")
    return audit.debounce(page_changes, "user_id", "ts_ms", "event_id", 2 * HOUR)


def reply_sql(ask: str, answer: str, within: int) -> str:
    return f"""WITH {EV}, a AS (SELECT a.user_id, a.event_id, a.ts_ms, min((b.ts_ms, b.event_id)) AS r FROM e a LEFT JOIN e b ON b.user_id = a.user_id AND b.event_type = '{answer}'
   AND (b.ts_ms > a.ts_ms OR (b.ts_ms = a.ts_ms AND b.event_id > a.event_id)) WHERE a.event_type = '{ask}' GROUP BY ALL),
 f AS (SELECT a.user_id, a.event_id, a.ts_ms, b.event_id AS bid, b.ts_ms AS bts, row_number() OVER (PARTITION BY a.event_id ORDER BY b.ts_ms, b.event_id) AS rn
   FROM e a LEFT JOIN e b ON b.user_id = a.user_id AND b.event_type = '{answer}' AND (b.ts_ms > a.ts_ms OR (b.ts_ms = a.ts_ms AND b.event_id > a.event_id)) WHERE a.event_type = '{ask}')
 SELECT user_id, event_id, ts_ms, CASE WHEN bts - ts_ms <= {within} THEN bid END AS answer_id, CASE WHEN bts - ts_ms <= {within} THEN bts - ts_ms END AS delay_ms,
  coalesce(bts - ts_ms > {within}, true) AS missed FROM f WHERE rn = 1"""


@query("approval_join", oracle=reply_sql("click", "purchase", 24 * HOUR))
def approval_join(spark, sf):
    log = _events(spark, sf).filter("event_type IN ('click', 'purchase')")
    return audit.first_reply(log, "user_id", "ts_ms", "event_id", F.col("event_type") == "click", F.col("event_type") == "purchase", 24 * HOUR)


@query("detection_sla", oracle=reply_sql("signup", "view", 6 * HOUR))
def detection_sla(spark, sf):
    log = _events(spark, sf).filter("event_type IN ('signup', 'view')")
    return audit.first_reply(log, "user_id", "ts_ms", "event_id", F.col("event_type") == "signup", F.col("event_type") == "view", 6 * HOUR)


@query("epoch_filter", oracle=f"{cte('scans')} SELECT tab_id, scan_id, epoch, payload FROM (SELECT *, max(epoch) OVER (PARTITION BY tab_id) AS m FROM scans) WHERE epoch = m")
def epoch_filter(spark, sf):
    return audit.current_epoch(derived(spark, sf, "scans")).select("tab_id", "scan_id", "epoch", "payload")


@query("receipts", oracle=f"""{cte('regions')} SELECT page_id, count(*) FILTER (type IN ('password_input', 'sensitive_input', 'contenteditable_pii')) AS password_fields,
 count(*) FILTER (type IN ('face', 'photo')) AS faces, count(*) FILTER (type IN ('pii', 'filled_input')) AS pii_spans FROM regions GROUP BY page_id""")
def receipts(spark, sf):
    return audit.receipts(derived(spark, sf, "regions"))


_ERR = "CASE " + " ".join(
    "WHEN " + " OR ".join(f"contains(message, {q.lit(n)})" for n in needles) + f" THEN '{code}'" for needles, code in rules.ERROR_RULES
) + " ELSE 'UNKNOWN' END"


@query("error_codes", oracle=f"{cte('error_messages')} SELECT code, count(*) AS n FROM (SELECT {_ERR} AS code FROM error_messages) GROUP BY code")
def error_codes(spark, sf):
    return derived(spark, sf, "error_messages").groupBy(audit.error_code(F.col("message")).alias("code")).agg(F.count("*").alias("n"))


_BLOCK = """CASE WHEN NOT coalesce(sanitized, false) THEN 'FACE_REDACTION_REQUIRED: missing result' WHEN coalesce(error, '') <> '' THEN error
 WHEN coalesce(image, '') = '' THEN 'FACE_REDACTION_REQUIRED: no image' WHEN NOT starts_with(image, 'data:image/') THEN 'FACE_REDACTION_REQUIRED: not an image'
 WHEN face_enabled AND NOT coalesce(face_pass, false) THEN 'FACE_REDACTION_REQUIRED: pass incomplete' WHEN ner_enabled AND NOT coalesce(ner_pass, false) THEN 'NER_REDACTION_REQUIRED: pass incomplete' END"""


@query("release_gate", oracle=f"{cte('releases')} SELECT release_id, {_BLOCK} AS block_reason FROM releases")
def release_gate(spark, sf):
    released, blocked = audit.release_gate(derived(spark, sf, "releases"))
    return released.select("release_id", F.lit(None).cast("string").alias("block_reason")).unionByName(blocked.select("release_id", "block_reason"))


@query("endpoint_locality", oracle=f"{cte('endpoints')} SELECT row_id, coalesce({q.host('endpoint')} IN {q.in_list(rules.LOCAL_ENDPOINT_HOSTS)}, false) AS is_local, CASE WHEN coalesce({q.host('endpoint')} IN {q.in_list(rules.LOCAL_ENDPOINT_HOSTS)}, false) THEN snippet END AS snippet FROM endpoints")
def endpoint_locality(spark, sf):
    return audit.local_only(derived(spark, sf, "endpoints"), "endpoint", "snippet").select("row_id", "is_local", "snippet")
