"""Detector evaluation against labelled ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redactframe import rules


def ratio(num: Column, den: Column) -> Column:
    """num / den, 0 when undefined."""
    return F.when(den > 0, num / den).otherwise(0.0)


def with_scores(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and over-redaction from tp, fp, fn, unrounded."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    d = counts.withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn))
    p, r = F.col("precision"), F.col("recall")
    return d.withColumn("f1", ratio(2 * (p * r), p + r)).withColumn("over_redaction", ratio(fp, tp + fp))


SCORES = ["precision", "recall", "f1", "over_redaction"]


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in SCORES})


def element_hits(truth: DataFrame, detections: DataFrame) -> DataFrame:
    """Ground-truth elements with how many detections hit them. Detections are counted before the join."""
    hits = detections.groupBy("page_id", "selector").agg(F.count("*").alias("hits"))
    return truth.join(hits, ["page_id", "selector"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)))


def eval_pages(truth: DataFrame, detections: DataFrame) -> DataFrame:
    """Confusion counts per page. A false positive counts every detection on a harmless element."""
    s, n = F.col("sensitive"), F.col("hits")
    counts = element_hits(truth, detections).groupBy("page_id").agg(
        F.count_if(s & (n > 0)).alias("tp"),
        F.sum(F.when(~s, n).otherwise(0)).alias("fp"),
        F.count_if(s & (n == 0)).alias("fn"),
        F.count_if(~s & (n == 0)).alias("tn"),
    )
    return rounded(with_scores(counts))


def eval_overall(pages: DataFrame) -> DataFrame:
    """One row: pooled (micro) counts and scores, and page averages (macro)."""
    pooled = pages.agg(
        F.count("*").alias("pages"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")],
        *[F.round(F.avg(c), 4).alias(f"macro_{c}") for c in SCORES])
    return rounded(with_scores(pooled))


def eval_gate(overall: DataFrame, targets=rules.EVAL_TARGETS) -> DataFrame:
    """Metric, value, target and pass flag, from the macro averages."""
    rows = F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(f"macro_{m}").alias("value"), F.lit(t).alias("target"),
                 (F.col(f"macro_{m}") >= t if d == "ge" else F.col(f"macro_{m}") <= t).alias("passed"))
        for m, t, d in targets])
    return overall.select(F.inline(rows))


def eval_misses(truth: DataFrame, detections: DataFrame) -> DataFrame:
    """Missed sensitive elements and hits on harmless ones, with type and reason."""
    n, s = F.col("hits"), F.col("sensitive")
    kind = F.when(s & (n == 0), "FN").when(~s & (n > 0), "FP")
    return element_hits(truth, detections).withColumn("kind", kind).filter("kind IS NOT NULL").select(
        "page_id", "selector", "kind", "type", "reason", "hits")


def latency_stats(log: DataFrame, group: str, value: str) -> DataFrame:
    return log.groupBy(group).agg(
        F.count("*").alias("n"), F.min(value).alias("min_ms"), F.round(F.avg(value), 4).alias("avg_ms"), F.max(value).alias("max_ms"))


def label_eval(flags: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """Detector flag against a 0/1 label, joined on doc_id; one row of counts and scores."""
    d = labels.join(flags, "doc_id")
    y, f = F.col(label) == 1, F.col("flag")
    counts = d.agg(F.count_if(y & f).alias("tp"), F.count_if(~y & f).alias("fp"), F.count_if(y & ~f).alias("fn"), F.count_if(~y & ~f).alias("tn"))
    return rounded(with_scores(counts))
