"""Queries: evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from redactframe import rules
from redactframe.functions.text import matches, may_match
from redactframe.operators import evaluate
from redactframe.plans import sqltext as q
from redactframe.plans.registry import query
from redactframe.sources.shapes import cte
from redactframe.sources.tables import derived, table

HITS = f"""{cte('gt_elements', 'detections')}, n AS (SELECT page_id, selector, count(*) AS hits FROM detections WHERE fired GROUP BY ALL),
 h AS (SELECT g.*, coalesce(n.hits, 0) AS hits FROM gt_elements g LEFT JOIN n ON n.page_id = g.page_id AND n.selector = g.selector)"""
COUNTS = """count(*) FILTER (sensitive AND hits > 0) AS tp, cast(sum(CASE WHEN sensitive THEN 0 ELSE hits END) AS BIGINT) AS fp,
 count(*) FILTER (sensitive AND hits = 0) AS fn, count(*) FILTER (NOT sensitive AND hits = 0) AS tn"""


def scores(src: str, keep: str) -> str:
    return f"""SELECT {keep} tp, fp, fn, tn, round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN p + r > 0 THEN 2 * (p * r) / (p + r) ELSE 0 END, 4) AS f1,
     round(CASE WHEN tp + fp > 0 THEN cast(fp AS DOUBLE) / (tp + fp) ELSE 0 END, 4) AS over_redaction
     FROM (SELECT *, CASE WHEN tp + fp > 0 THEN cast(tp AS DOUBLE) / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN cast(tp AS DOUBLE) / (tp + fn) ELSE 0 END AS r FROM {src})"""


PAGES = f"pages_eval AS ({scores(f'(SELECT page_id, {COUNTS} FROM h GROUP BY page_id)', 'page_id,')})"
MACRO = ", ".join(f"round(avg({c}), 4) AS macro_{c}" for c in evaluate.SCORES)
POOLED = f"(SELECT count(*) AS pages, cast(sum(tp) AS BIGINT) AS tp, cast(sum(fp) AS BIGINT) AS fp, cast(sum(fn) AS BIGINT) AS fn, cast(sum(tn) AS BIGINT) AS tn, {MACRO} FROM pages_eval)"
OVERALL = scores(POOLED, "pages, " + ", ".join(f"macro_{c}" for c in evaluate.SCORES) + ",")


def _inputs(spark, sf):
    return derived(spark, sf, "gt_elements"), derived(spark, sf, "detections").filter("fired")


@query("eval_pages", oracle=f"{HITS}, {PAGES} SELECT * FROM pages_eval")
def eval_pages(spark, sf):
    return evaluate.eval_pages(*_inputs(spark, sf))


@query("eval_overall", oracle=f"{HITS}, {PAGES} {OVERALL}")
def eval_overall(spark, sf):
    return evaluate.eval_overall(evaluate.eval_pages(*_inputs(spark, sf)))


@query("eval_gate", oracle=f"{HITS}, {PAGES}, o AS ({OVERALL}) " + " UNION ALL ".join(
    f"SELECT '{m}' AS metric, macro_{m} AS value, cast({t} AS DOUBLE) AS target, macro_{m} {'>=' if d == 'ge' else '<='} {t} AS passed FROM o"
    for m, t, d in rules.EVAL_TARGETS))
def eval_gate(spark, sf):
    return evaluate.eval_gate(evaluate.eval_overall(evaluate.eval_pages(*_inputs(spark, sf))))


@query("eval_misses", oracle=f"{HITS} SELECT page_id, selector, CASE WHEN sensitive THEN 'FN' ELSE 'FP' END AS kind, type, reason, hits FROM h WHERE (sensitive AND hits = 0) OR (NOT sensitive AND hits > 0)")
def eval_misses(spark, sf):
    return evaluate.eval_misses(*_inputs(spark, sf))


@query("latency_stats", oracle="SELECT event_type, count(*) AS n, min(value) AS min_ms, round(avg(value), 4) AS avg_ms, max(value) AS max_ms FROM events GROUP BY event_type")
def latency_stats(spark, sf):
    return evaluate.latency_stats(table(spark, sf, "events"), "event_type", "value")


_ANY = " OR ".join(q.has("text", p) for _, p in rules.SPAN_PATTERNS)


@query("label_eval", oracle=f"WITH d AS (SELECT doc_id, ({_ANY}) AS flag FROM documents), j AS (SELECT l.toxic = 1 AS y, d.flag AS f FROM labels l JOIN d ON d.doc_id = l.doc_id), "
       f"c AS (SELECT count(*) FILTER (y AND f) AS tp, count(*) FILTER (NOT y AND f) AS fp, count(*) FILTER (y AND NOT f) AS fn, count(*) FILTER (NOT y AND NOT f) AS tn FROM j) {scores('c', '')}")
def label_eval(spark, sf):
    flags = table(spark, sf, "documents").select(
        "doc_id", reduce(lambda a, b: a | b, [may_match(F.col("text"), p) & matches(F.col("text"), p) for _, p in rules.SPAN_PATTERNS]).alias("flag"))
    return evaluate.label_eval(flags, table(spark, sf, "labels"), "toxic")
