"""Structured Streaming forms of the event-driven operators.

Each builder takes and returns streaming DataFrames; ``drive`` runs one to the end of the
available input, which is how the batch checks use them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactframe.session import ensure_checkpoint_dir


def rescans(mutations: DataFrame, key: str, ts: str, gap: str, watermark: str) -> DataFrame:
    """Bursts of changes to one rescan per quiet gap; state is dropped once the watermark passes."""
    return (
        mutations.withWatermark(ts, watermark)
        .groupBy(F.session_window(ts, gap).alias("w"), key)
        .agg(F.count("*").alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
        .select(key, "first_ts", "last_ts", "n")
    )


def budget(deltas: DataFrame, key: str, counters: list[str]) -> DataFrame:
    """Running totals per session; use output mode update."""
    return deltas.groupBy(key).agg(*[F.sum(c).alias(f"total_{c}") for c in counters])


def budget_sessions(deltas: DataFrame, key: str, ts: str, counters: list[str], idle: str, watermark: str) -> DataFrame:
    """Totals of each session; one ends after ``idle`` without a row, and leaves the state once the watermark has passed its end."""
    totals = [F.sum(c).alias(f"total_{c}") for c in counters]
    return (
        deltas.withWatermark(ts, watermark)
        .groupBy(F.session_window(ts, idle).alias("w"), key)
        .agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), *totals)
        .drop("w")
    )


def work_folder(spark: SparkSession) -> str:
    """A fresh folder below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"


def file_stream(spark: SparkSession, folder: str, name: str, per_trigger: int | None = None) -> DataFrame:
    """A table's files as a stream; new files that match are picked up by later triggers."""
    path = f"{folder}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(path + "*")


def drive(stream: DataFrame, work: str, mode: str = "append") -> DataFrame:
    """Run a stream over the available input into a parquet table and read it back."""
    out = f"{work}/out"
    spark = stream.sparkSession
    writer = stream.writeStream.option("checkpointLocation", f"{work}/state").trigger(availableNow=True)
    if mode == "update":
        # every batch lands in its own folder, so a re-run of a batch after a failure overwrites itself
        def keep(batch: DataFrame, number: int) -> None:
            batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/{number:08d}")

        query = writer.outputMode("update").foreachBatch(keep).start()
    else:
        query = writer.outputMode(mode).format("parquet").option("path", out).start()
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return spark.read.schema(_with_batch(stream, mode)).parquet(f"{out}/*" if mode == "update" else out)


def _with_batch(stream: DataFrame, mode: str):
    from pyspark.sql import types as T

    return T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())]) if mode == "update" else stream.schema


def drive_to_close(
    spark: SparkSession, build: Callable[[Callable[[DataFrame], DataFrame]], DataFrame], sentinel: DataFrame, work: str
) -> DataFrame:
    """Drive a watermark-bound stream and then close it with one far-future row per source.

    The tail of a finite input stays in state until the watermark passes it. A second run
    from the same checkpoint reads the sentinel, which moves the watermark; the caller
    filters the sentinel's own rows out. ``build`` gets a function that adds the flush source to a stream.
    """
    flush = f"{work}/flush"
    sentinel.limit(0).write.mode("overwrite").parquet(flush)

    def with_flush(stream: DataFrame) -> DataFrame:
        extra = spark.readStream.schema(sentinel.schema).parquet(flush)
        return stream.select(*sentinel.columns).unionByName(extra)

    drive(build(with_flush), work)
    sentinel.write.mode("append").parquet(flush)
    return drive(build(with_flush), work)


def state_provider(spark: SparkSession):
    """Context that selects the RocksDB state store, which the custom stateful operators need."""
    from contextlib import contextmanager

    name = "spark.sql.streaming.stateStore.providerClass"
    rocks = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

    @contextmanager
    def scope():
        before = spark.conf.get(name, None)
        spark.conf.set(name, rocks)
        try:
            yield
        finally:
            spark.conf.set(name, before) if before else spark.conf.unset(name)

    return scope()


def latest(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Newest row per key of an update-mode table."""
    rest = [c for c in updates.columns if c not in (*keys, "batch")]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("u")).select(*keys, "u.*")

