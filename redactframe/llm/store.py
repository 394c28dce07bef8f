"""Tables and files in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from redactframe.session import ensure_checkpoint_dir


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder named by ``spark.checkpoint.dir`` (a temporary one only on a local master)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        ensure_checkpoint_dir(spark)
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing reads any more: neither a DataFrame still to be run nor its result."""
    for df in tables:
        jvm = df.sparkSession._jvm
        place = jvm.org.apache.hadoop.fs.Path(df.shared_path)
        place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def free_name(name: str, *taken: list[str]) -> str:
    """``name``, or the first of ``name_``, ``name__``, ... that no column has (names differ by more than case)."""
    used = {c.lower() for columns in taken for c in columns}
    while name.lower() in used:
        name += "_"
    return name


#: Bytes of an Arrow batch between Spark and its Python workers.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Keep batches of long texts small, in the JVM and in Python, unless the session says otherwise."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
