"""Table access: explicit columns in, parquet pruning and pushdown left to the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# Tables whose rows cost real work to process (texts, or rows that derived shapes expand).
_WIDE = {"documents": "doc_id", "pages": "page_id", "orders": "o_orderkey", "customer": "c_custkey"}


#: Keys that deal the rows of a base table out.
_KEYS = {"orders": ["o_orderkey"], "customer": ["c_custkey"], "part": ["p_partkey"], "lineitem": ["l_orderkey", "l_linenumber"]}

#: Session setting that a user of small, single-row-group files may set; unset, a scan keeps its own partitions.
INPUT_PARTITIONS = "redactframe.input.partitions"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A base table, partitioned as its scan is.

    One row group is one task, however many cores wait. Where that hurts, ``redactframe.input.partitions`` deals the
    rows of wide tables out by key; nothing about the data or the machine decides it.
    """
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    parts = spark.conf.get(INPUT_PARTITIONS, None)
    return df.repartition(int(parts), _WIDE[name]) if parts and name in _WIDE else df


def events(spark: SparkSession, folder: str) -> DataFrame:
    """The event log with an instant-typed ``ts`` (the files carry zone-less timestamps)."""
    return table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def derived(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table that Spark derives row by row from a base table (see sources.shapes).

    The columns come out of a one-row generator, so an operator sees them as finished columns, as
    it would from a stored table, instead of pulling their expressions into its own.

    A base row is a few numbers that a shape makes into texts, pages or boxes, so files are small for the work in them:
    a million rows may be one split, one task. The rows are therefore dealt out by key before they are expanded, over
    four tasks a core at most (each has its expressions to set up), or those of ``redactframe.input.partitions``.
    """
    from redactframe.sources.shapes import SHAPES

    shape = SHAPES[name]
    row = F.expr("inline(array(struct(" + ", ".join(shape.columns) + ")))")
    base = table(spark, folder, shape.base)
    if not (spark.conf.get(INPUT_PARTITIONS, None) and shape.base in _WIDE):
        tasks = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
        base = base.repartition(tasks, *_KEYS[shape.base])
    return base.select(row)
