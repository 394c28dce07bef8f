"""Audit logs, budgets, gates and caches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redactframe import rules
from redactframe.functions import urls
from redactframe.functions.greedy import greedy_accept
from redactframe.functions.ordered import islands, running_totals, with_next_match, with_previous
from redactframe.operators.redact import suppress_value

DAY_MS = 86_400_000


def day_of(ts_ms: Column) -> Column:
    """Segment for per-key ordered work: one day of one key."""
    return F.floor(ts_ms / DAY_MS).cast("long")


def audit_actions(actions: DataFrame) -> DataFrame:
    """Log form of agent actions: typed values never appear."""
    blank = lambda c: F.nullif(c, F.lit(""))
    return actions.select(
        "action_id", "session_id", "action", blank(F.col("selector")).alias("selector"),
        suppress_value(F.col("value")).alias("value"), blank(F.col("url")).alias("url"), "approved", "result")


def export_rows(log: DataFrame) -> DataFrame:
    """The fixed four export columns, with the older column names as fallbacks; zero and blank fall back too."""
    either = lambda a, b: F.coalesce(F.when(F.col(a) != 0, F.col(a)), F.col(b))
    return log.select(
        F.coalesce(F.nullif("timestamp", F.lit("")), F.col("time")).alias("timestamp"), "domain",
        either("fields_redacted", "fields").alias("fieldsRedacted"), F.col("faces_detected").alias("facesDetected"))


def rollup(log: DataFrame) -> DataFrame:
    """Scans, fields and faces per domain. Face counts read either column name."""
    zero = F.lit(0).cast("long")
    fields = F.coalesce(F.when(F.col("fields_redacted") != 0, F.col("fields_redacted")), F.col("fields"), zero)
    faces = F.coalesce("faces_detected", "faces", zero)
    return log.groupBy("domain").agg(
        F.count("*").alias("scans"), F.sum(fields).alias("fields"), F.sum(faces).alias("faces"))


def keep_newest(log: DataFrame, keys: list[str], order: list[str], cap: int) -> DataFrame:
    """Compaction to the newest ``cap`` rows per key; the rank limit prunes before the shuffle."""
    newest = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return log.withColumn("age_rank", F.row_number().over(newest)).filter(F.col("age_rank") <= cap)


def privacy_budget(deltas: DataFrame, key: str, ts_ms: str, event: str, counters: list[str]) -> DataFrame:
    """Running totals per session, even when one session holds most of the events."""
    return running_totals(deltas, [key], [ts_ms, event], {f"total_{c}": c for c in counters}, day_of(F.col(ts_ms)))


def risk_cache(visits: DataFrame, key: str, ts_ms: str, event: str, ttl_ms: int) -> DataFrame:
    """Which visits recompute the report and which may use one younger than the TTL.

    The age counts from the last recomputation, so a busy tab still refreshes.
    """
    d = greedy_accept(visits, [key], ts_ms, event, ttl_ms)
    return d.withColumnRenamed("accepted", "recomputed").withColumn(
        "report_ts", F.when(F.col("recomputed"), F.col(ts_ms)).otherwise(F.col("last_accepted"))).drop("last_accepted")


def rate_limit(calls: DataFrame, key: str, ts_ms: str, event: str, interval_ms: int) -> DataFrame:
    """Accept at most one call per interval; a refused call learns how long to wait."""
    d = greedy_accept(calls, [key], ts_ms, event, interval_ms)
    wait = F.when(~F.col("accepted"), F.lit(interval_ms) - (F.col(ts_ms) - F.col("last_accepted")))
    return d.withColumn("retry_after_ms", wait).drop("last_accepted")


def debounce(mutations: DataFrame, key: str, ts_ms: str, event: str, gap_ms: int) -> DataFrame:
    """Bursts with pauses of at most ``gap_ms`` collapse to one rescan each (batch form)."""
    seg = day_of(F.col(ts_ms))
    prev = with_previous(mutations, [key], [ts_ms, event], [ts_ms], seg)
    opens = F.col(f"prev_{ts_ms}").isNull() | (F.col(ts_ms) - F.col(f"prev_{ts_ms}") > gap_ms)
    bursts = islands(prev, [key], [ts_ms, event], opens, "burst", seg)
    return bursts.groupBy(key, "burst").agg(
        F.min(ts_ms).alias("first_ms"), F.max(ts_ms).alias("last_ms"), F.count("*").alias("n")).drop("burst")


def first_reply(
    log: DataFrame, key: str, ts_ms: str, event: str, asks: Column, answers: Column, within_ms: int
) -> DataFrame:
    """Each asking row with the first answer after it, if that came in time (batch interval join).

    Linear in the log: no pair of rows is formed, so a key with dense asks and answers is fine.
    """
    answer = F.when(answers, F.struct(F.col(ts_ms).alias("at"), F.col(event).alias("id")))
    joined = with_next_match(log, [key], [ts_ms, event], answer, "__a", day_of(F.col(ts_ms)))
    timely = F.col("__a.at") - F.col(ts_ms) <= within_ms
    return joined.filter(asks).select(
        key, event, ts_ms,
        F.when(timely, F.col("__a.id")).alias("answer_id"),
        F.when(timely, F.col("__a.at") - F.col(ts_ms)).alias("delay_ms"),
        F.coalesce(~timely, F.lit(True)).alias("missed"))


def current_epoch(scans: DataFrame) -> DataFrame:
    """Scan results of the newest epoch of each tab; older ones are discarded."""
    newest = scans.groupBy("tab_id").agg(F.max("epoch").alias("epoch"))
    return scans.join(newest, ["tab_id", "epoch"])


def receipts(regions: DataFrame) -> DataFrame:
    """Masked regions per page, by class."""
    kind = F.col("type")
    return regions.groupBy("page_id").agg(
        F.count_if(kind.isin(rules.MASKED_FIELD_TYPES)).alias("password_fields"),
        F.count_if(kind.isin("face", "photo")).alias("faces"),
        F.count_if(kind.isin("pii", "filled_input")).alias("pii_spans"))


def error_code(message: Column) -> Column:
    """First matching message rule; UNKNOWN when none fits."""
    tests = [
        (reduce(lambda a, b: a | b, [F.contains(message, F.lit(n)) for n in needles]), code)
        for needles, code in rules.ERROR_RULES
    ]
    return reduce(lambda acc, t: acc.when(t[0], t[1]), tests[1:], F.when(tests[0][0], tests[0][1])).otherwise("UNKNOWN")


def release_block() -> Column:
    """Why a sanitised result may not leave, or null. Anything missing blocks."""
    image = F.coalesce("image", F.lit(""))
    return (
        F.when(~F.coalesce(F.col("sanitized"), F.lit(False)), "FACE_REDACTION_REQUIRED: missing result")
        .when(F.coalesce("error", F.lit("")) != "", F.col("error"))
        .when(image == "", "FACE_REDACTION_REQUIRED: no image")
        .when(~F.startswith(image, F.lit("data:image/")), "FACE_REDACTION_REQUIRED: not an image")
        .when(F.col("face_enabled") & ~F.coalesce(F.col("face_pass"), F.lit(False)), "FACE_REDACTION_REQUIRED: pass incomplete")
        .when(F.col("ner_enabled") & ~F.coalesce(F.col("ner_pass"), F.lit(False)), "NER_REDACTION_REQUIRED: pass incomplete")
    )


def release_gate(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fail-closed split: released rows and blocked rows with their reason. Every row is in exactly one."""
    coded = results.withColumn("block_reason", release_block())
    return coded.filter("block_reason IS NULL").drop("block_reason"), coded.filter("block_reason IS NOT NULL")


def is_local_endpoint(endpoint: Column) -> Column:
    return F.coalesce(urls.host(endpoint).isin(rules.LOCAL_ENDPOINT_HOSTS), F.lit(False))


def local_only(rows: DataFrame, endpoint: str, column: str) -> DataFrame:
    """Keep the column's text only where the endpoint is this machine."""
    local = is_local_endpoint(F.col(endpoint))
    return rows.withColumn("is_local", local).withColumn(column, F.when(local, F.col(column)))
