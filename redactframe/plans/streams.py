"""Queries: the streams, each driven over the whole table and compared with its batch meaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from redactframe.plans.agents import session_memory  # noqa: F401  (registered first: its oracle is reused)
from redactframe.plans.audit import _DELTAS, EV, HOUR
from redactframe.plans.detection import release_documents
from redactframe.plans.registry import ORACLES, query
from redactframe.sources.shapes import SHAPES
from redactframe.streaming import stateful, streams


@query("stream_redact", oracle=ORACLES["flagship_release"])
def stream_redact(spark, sf):
    return streams.drive(release_documents(streams.file_stream(spark, sf, "documents")), streams.work_folder(spark))


def _event_stream(spark, sf):
    return streams.file_stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _sentinel(spark, columns: str):
    return spark.sql(f"SELECT {columns}")


NO_USER = -1


@query("stream_rescans", oracle=ORACLES["debounce_sessions"])
def stream_rescans(spark, sf):
    far = _sentinel(spark, f"cast({NO_USER} AS bigint) AS user_id, timestamp '2100-01-01' AS ts")

    def build(with_flush):
        changes = with_flush(_event_stream(spark, sf).filter("event_type <> 'signup'").select("user_id", "ts"))
        return streams.rescans(changes, "user_id", "ts", "2 hours", "10 minutes")

    done = streams.drive_to_close(spark, build, far, streams.work_folder(spark))
    return done.filter(F.col("user_id") != NO_USER).select(
        "user_id", F.unix_millis("first_ts").alias("first_ms"), F.unix_millis("last_ts").alias("last_ms"), "n")


@query("stream_budget", oracle=f"WITH {EV} SELECT user_id, " + ", ".join(
    f"count(*) FILTER (event_type = '{t}') AS total_{c}" for c, t in _DELTAS.items()) + " FROM e GROUP BY user_id")
def stream_budget(spark, sf):
    deltas = _event_stream(spark, sf).select("user_id", *[
        F.when(F.col("event_type") == t, 1).otherwise(0).alias(c) for c, t in _DELTAS.items()])
    updates = streams.drive(streams.budget(deltas, "user_id", list(_DELTAS)), streams.work_folder(spark), mode="update")
    return streams.latest(updates, ["user_id"])


@query("stream_approvals", oracle=f"""WITH {EV}, j AS (SELECT p.user_id, p.event_id AS pending_id, d.event_id AS decision_id,
   row_number() OVER (PARTITION BY p.user_id, p.event_id ORDER BY d.ts_ms, d.event_id) AS rn FROM e p LEFT JOIN e d
   ON d.user_id = p.user_id AND d.event_type = 'purchase' AND (d.ts_ms > p.ts_ms OR d.ts_ms = p.ts_ms AND d.event_id > p.event_id) AND d.ts_ms <= p.ts_ms + {2 * HOUR}
   WHERE p.event_type = 'click')
 SELECT user_id, pending_id, decision_id, decision_id IS NOT NULL AS approved FROM j WHERE rn = 1""")
def stream_approvals(spark, sf):
    far = _sentinel(spark, f"cast({NO_USER} AS bigint) AS user_id, cast(-1 AS bigint) AS event_id, 'click' AS event_type, timestamp '2100-01-01' AS ts "
                           f"UNION ALL SELECT {NO_USER - 1}, -2, 'purchase', timestamp '2100-01-01'")

    def build(with_flush):
        side = lambda kind: with_flush(_event_stream(spark, sf).filter(F.col("event_type") == kind)).filter(F.col("event_type") == kind)
        pending = side("click").select("user_id", F.col("event_id").alias("pending_id"), F.col("ts").alias("pending_ts"))
        decisions = side("purchase").select("user_id", F.col("event_id").alias("decision_id"), F.col("ts").alias("decision_ts"))
        return stateful.approvals_stream(pending, decisions, "user_id", 2 * HOUR, "10 minutes")

    with streams.state_provider(spark):
        done = streams.drive_to_close(spark, build, far, streams.work_folder(spark))
    return done.filter(F.col("user_id") >= 0).select("user_id", "pending_id", "decision_id", "approved")


@query("stream_rate_limit", oracle=ORACLES["rate_limit"])
def stream_rate_limit(spark, sf):
    far = _sentinel(spark, f"cast({NO_USER} AS bigint) AS user_id, cast(-1 AS bigint) AS event_id, timestamp '2100-01-01' AS ts")

    def build(with_flush):
        calls = with_flush(_event_stream(spark, sf).select("user_id", "event_id", "ts"))
        return stateful.rate_limit_stream(calls, "user_id", "ts", "10 minutes", 12 * HOUR)

    with streams.state_provider(spark):
        out = streams.drive_to_close(spark, build, far, streams.work_folder(spark))
    return out.filter(F.col("key") != NO_USER).withColumnRenamed("key", "user_id")


@query("stream_epoch", oracle=ORACLES["epoch_filter"])
def stream_epoch(spark, sf):
    shape = SHAPES["scans"]
    scans = streams.file_stream(spark, sf, shape.base).selectExpr(*shape.columns)
    with streams.state_provider(spark):
        ledger = streams.drive(stateful.epoch_stream(scans), streams.work_folder(spark))
    return stateful.still_released(ledger).select("tab_id", "scan_id", "epoch", "payload")


@query("stream_budget_ttl", oracle=f"""WITH {EV}, p AS (SELECT *, lag(ts_ms) OVER (PARTITION BY user_id ORDER BY ts_ms, event_id) AS prev FROM e),
 s AS (SELECT *, sum(CASE WHEN prev IS NULL OR ts_ms - prev > {24 * HOUR} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts_ms, event_id ROWS UNBOUNDED PRECEDING) AS b FROM p)
 SELECT user_id, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms, """ + ", ".join(
    f"count(*) FILTER (event_type = '{t}') AS total_{c}" for c, t in _DELTAS.items()) + " FROM s GROUP BY user_id, b")
def stream_budget_ttl(spark, sf):
    """Budgets that end after a day without an event."""
    far = _sentinel(spark, f"cast({NO_USER} AS bigint) AS user_id, 'none' AS event_type, timestamp '2100-01-01' AS ts")

    def build(with_flush):
        deltas = with_flush(_event_stream(spark, sf).select("user_id", "event_type", "ts")).select("user_id", "ts", *[
            F.when(F.col("event_type") == t, 1).otherwise(0).alias(c) for c, t in _DELTAS.items()])
        return streams.budget_sessions(deltas, "user_id", "ts", list(_DELTAS), "24 hours", "10 minutes")

    done = streams.drive_to_close(spark, build, far, streams.work_folder(spark)).filter(F.col("user_id") != NO_USER)
    return done.select("user_id", F.unix_millis("first_ts").alias("first_ms"), F.unix_millis("last_ts").alias("last_ms"), *[f"total_{c}" for c in _DELTAS])


@query("stream_memory", oracle=ORACLES["session_memory"])
def stream_memory(spark, sf):
    turns = streams.file_stream(spark, sf, "conversations")
    with streams.state_provider(spark):
        out = streams.drive(stateful.memory_stream(turns, "conv_id"), streams.work_folder(spark), mode="update")
    newest = out.groupBy("key").agg(F.max("batch").alias("batch"))
    return out.join(newest, ["key", "batch"]).select(F.col("key").alias("conv_id"), "turn", "role", "text")


_TTL, _VISIT, _LOAD = HOUR // 2, HOUR // 3, HOUR // 2
_KIND = "CASE event_type WHEN 'signup' THEN 'close' WHEN 'purchase' THEN 'load' ELSE 'visit' END"


@query("stream_risk_badge", oracle=f"""WITH RECURSIVE {EV}, o AS (SELECT user_id, ts_ms, {_KIND} AS kind, row_number() OVER (PARTITION BY user_id ORDER BY ts_ms, event_id) AS n FROM e),
 r AS (SELECT user_id, cast(0 AS BIGINT) AS n, cast(NULL AS BIGINT) AS report, cast(NULL AS BIGINT) AS due, cast(NULL AS BIGINT) AS refreshed, cast(NULL AS BIGINT) AS cached FROM o WHERE n = 1
  UNION ALL SELECT user_id, n, CASE WHEN kind <> 'close' THEN report END, CASE WHEN kind = 'load' THEN ts_ms + {_LOAD} WHEN kind = 'close' THEN NULL WHEN fresh THEN due ELSE ts_ms + {_VISIT} END,
   refreshed, CASE WHEN kind = 'visit' AND fresh THEN ts_ms END
  FROM (SELECT *, coalesce(ts_ms - report < {_TTL}, false) AS fresh FROM (
   SELECT o.user_id, o.n, o.ts_ms, o.kind, CASE WHEN r.due <= o.ts_ms THEN r.due ELSE r.report END AS report, CASE WHEN r.due <= o.ts_ms THEN NULL ELSE r.due END AS due,
    CASE WHEN r.due <= o.ts_ms THEN r.due END AS refreshed FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1)))
 SELECT user_id, refreshed AS ts_ms, 'refresh' AS kind FROM r WHERE refreshed IS NOT NULL UNION ALL SELECT user_id, cached, 'cached' FROM r WHERE cached IS NOT NULL
 UNION ALL SELECT user_id, max_by(due, n), 'refresh' FROM (SELECT user_id, n, coalesce(due, -1) AS due FROM r) GROUP BY user_id HAVING max_by(due, n) >= 0""")
def stream_risk_badge(spark, sf):
    """Visits answered from a report younger than 30 minutes, or refreshed after 20 quiet minutes, loads after 30; a signup closes the tab."""
    far = _sentinel(spark, f"cast({NO_USER} AS bigint) AS user_id, cast(-1 AS bigint) AS event_id, 'view' AS event_type, timestamp '2100-01-01' AS ts")

    def build(with_flush):
        visits = with_flush(_event_stream(spark, sf)).select(
            "user_id", "event_id", "ts", F.expr(_KIND).alias("kind"))
        return stateful.risk_badge_stream(visits, "user_id", "ts", "10 minutes", _TTL, _VISIT, _LOAD)

    with streams.state_provider(spark):
        done = streams.drive_to_close(spark, build, far, streams.work_folder(spark))
    return done.filter(F.col("key") != NO_USER).withColumnRenamed("key", "user_id")
