"""Ordered per-key computations that stay even when one key holds most of the rows.

A plain ``lag()``/running ``sum()`` over ``PARTITION BY key`` puts a whole key in one
task. These helpers cut every key into value-derived segments (an hour, a day, a block of
step numbers), work inside segments, and carry one summary row per segment across the
cut. Segments come from the data, not from partition numbers, so a re-run task after an
executor loss sees the same cuts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SEG = "__segment"


def with_previous(
    df: DataFrame, keys: list[str], order: list[str], cols: list[str], segment: Column
) -> DataFrame:
    """Add ``prev_<c>``: the value of c on the row before, per key, null on the first row."""
    cut = df.withColumn(_SEG, segment)
    inside = Window.partitionBy(*keys, _SEG).orderBy(*order)
    local = cut.withColumn("__rn", F.row_number().over(inside))
    for c in cols:
        local = local.withColumn(f"__lag_{c}", F.lag(c).over(inside))
    tails = cut.groupBy(*keys, _SEG).agg(
        F.max_by(F.struct(*cols), F.struct(*order)).alias("__tail")
    )
    carried = tails.select(
        *keys, _SEG, F.lag("__tail").over(Window.partitionBy(*keys).orderBy(_SEG)).alias("__carry")
    )
    joined = local.join(carried, [*keys, _SEG], "left")
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[
            F.when(F.col("__rn") == 1, F.col("__carry")[c]).otherwise(F.col(f"__lag_{c}")).alias(f"prev_{c}")
            for c in cols
        ],
    )


def running_totals(
    df: DataFrame, keys: list[str], order: list[str], sums: dict[str, str], segment: Column
) -> DataFrame:
    """Add inclusive running sums ``{new_name: column}`` per key in the given order."""
    cut = df.withColumn(_SEG, segment)
    inside = Window.partitionBy(*keys, _SEG).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = cut
    for name, c in sums.items():
        local = local.withColumn(f"__in_{name}", F.sum(c).over(inside))
    totals = cut.groupBy(*keys, _SEG).agg(*[F.sum(c).alias(f"__t_{n}") for n, c in sums.items()])
    before = Window.partitionBy(*keys).orderBy(_SEG).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *keys, _SEG, *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__base_{n}") for n in sums]
    )
    joined = local.join(carried, [*keys, _SEG], "left")
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[(F.col(f"__base_{n}") + F.col(f"__in_{n}")).alias(n) for n in sums],
    )


def with_next_match(
    df: DataFrame, keys: list[str], order: list[str], value: Column, name: str, segment: Column
) -> DataFrame:
    """Add ``name``: the first non-null ``value`` strictly after this row, per key.

    The windows run backwards and take the last value seen: a frame that grows is updated row
    by row, while a frame that reaches to the end of the partition is recomputed for each row.
    """
    cut = df.withColumn(_SEG, segment).withColumn("__value", value)
    seen = (Window.unboundedPreceding, -1)
    backwards = Window.partitionBy(*keys, _SEG).orderBy(*[F.desc(c) for c in order]).rowsBetween(*seen)
    local = cut.withColumn("__here", F.last("__value", ignorenulls=True).over(backwards))
    heads = cut.groupBy(*keys, _SEG).agg(
        F.min_by("__value", F.when(F.col("__value").isNotNull(), F.struct(*order))).alias("__head")
    )
    later = Window.partitionBy(*keys).orderBy(F.desc(_SEG)).rowsBetween(*seen)
    carried = heads.select(*keys, _SEG, F.last("__head", ignorenulls=True).over(later).alias("__carry"))
    return local.join(carried, [*keys, _SEG], "left").select(
        *[F.col(c) for c in df.columns], F.coalesce("__here", "__carry").alias(name)
    )


def islands(
    df: DataFrame, keys: list[str], order: list[str], starts: Column, name: str, segment: Column
) -> DataFrame:
    """Number consecutive runs per key: a row where ``starts`` holds opens a new run."""
    flagged = df.withColumn("__start", F.when(starts, 1).otherwise(0))
    return running_totals(flagged, keys, order, {name: "__start"}, segment).drop("__start")
