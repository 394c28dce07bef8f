"""Connected components of a link table by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactframe.llm.store import discard, written

#: Links for each file of a round's table.
FILE_ROWS = 1 << 17


def _large(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node moves to the smallest node that the node sees, itself included."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Every neighbour below a node, and the node itself, moves to the smallest of them."""
    low = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(low.withColumnRenamed("m", "b")).where("a <> b").distinct()


def connected(links: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(node, root): each linked node and the smallest node of its component.

    ``links`` has two columns of one orderable type; self-links and nulls are ignored, nodes without a link are not
    returned. Each round is a few equi-joins; its result is a written table. The number of rounds grows with the
    square of the logarithm of a component's size; the driver only reads a count and a sum of each round.
    """
    src, dst = links.columns
    a, b = F.col(src), F.col(dst)
    edges = links.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    edges = written(edges, "links")
    # files of a bounded number of rows: a round has two rows a link at most
    files = 1 + edges.count() // FILE_ROWS
    state = None
    for _ in range(most_rounds):
        nodes = written(_small(_large(edges)).coalesce(files), "stars")
        now = nodes.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(edges)
        edges = nodes
        if now == state:
            return nodes.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now
    raise RuntimeError(f"links did not settle in {most_rounds} rounds")
