"""Audit of how the sources of a language differ in their terms, by three-dimensional cube partitioning.

The scan counts terms inside its tasks. The terms kept for a language are dealt to term blocks of some thousand, its
sources to group blocks of some ten. A task owns one (group block, group block, term block) cell: it gets the slices of
counts of both group blocks in its term block (each slice is replicated to the cells of its row and column of the
cube), and computes, for every pair of sources, what that block of terms adds to their divergence. The parts are summed
along the term axis. A cell is bounded whatever a language, a source or a term holds.

All numbers are whole: a share is ``1 + floor(SCALE * (count + 1) / (N + V))`` and a term adds
``floor((p - q)**2 / q)``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redactframe.llm import blocks as B
from redactframe.llm.store import small_batches, written

SCALE = 1_000_000_000
#: Terms of a term block and sources of a group block, about.
TERM_BLOCK, GROUP_BLOCK = 2048, 8
#: Bytes of text that are counted in one step, and rows of counts that a task sums up before it hands them on.
COUNTED_BYTES, HELD_ROWS = 2 << 20, 1 << 18

#: ASCII letters and every byte of a code point beyond ASCII.
TERM = B.byte_set(bytes([*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]))


def block_terms(block: B.Block) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased terms of a block, and the number of terms of each text."""
    starts, ends, bounds = B.runs(TERM[block.data], block.offsets)
    data = B.gather(B.LOWER[block.data], starts, ends - starts)
    offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))), np.diff(bounds)


def block_counts(lang: pa.Array, source: pa.Array, block: B.Block) -> pa.Table:
    """``lang``, ``source``, ``term``, ``n`` occurrences, ``docs`` texts that hold it, of the rows of a block; each group has a row without a term."""
    langs, sources = lang.dictionary_encode(), source.dictionary_encode()
    wide = max(1, len(sources.dictionary))
    group = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64) * wide + sources.indices.to_numpy(zero_copy_only=False)
    terms, many = block_terms(block)
    coded = terms.dictionary_encode()
    size = max(1, len(coded.dictionary))
    doc = np.repeat(np.arange(block.rows), many)
    # one sort: by group, term and text
    key = np.sort((group[doc] * size + coded.indices.to_numpy(zero_copy_only=False)) * block.rows + doc)
    pair = key // block.rows
    first = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1]))) if len(key) else np.zeros(0, np.int64)
    new_doc = np.concatenate(([True], key[1:] != key[:-1])).astype(np.int64) if len(key) else np.zeros(0, np.int64)
    found, own = pair[first] // size, np.unique(group)
    codes = pa.array(np.concatenate((pair[first] % size, np.zeros(len(own), np.int64))), mask=np.arange(len(first) + len(own)) >= len(first))
    groups = np.concatenate((found, own))
    return pa.table({
        "lang": langs.dictionary.take(pa.array(groups // wide)), "source": sources.dictionary.take(pa.array(groups % wide)),
        "term": coded.dictionary.take(codes), "n": np.concatenate((np.diff(np.append(first, len(key))), np.zeros(len(own), np.int64))),
        "docs": np.concatenate((np.add.reduceat(new_doc, first) if len(first) else first, np.zeros(len(own), np.int64)))})


def _summed(held: list[pa.Table]) -> pa.Table:
    out = pa.concat_tables(held).group_by(["lang", "source", "term"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
    return out.select(["lang", "source", "term", "n_sum", "docs_sum"]).rename_columns(["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``term``, ``n``, ``docs`` of a table of (lang, source, text) without nulls, summed in each task and then over all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            for block in B.blocks(batch.column(2), COUNTED_BYTES):
                held.append(block_counts(*(batch.column(c).slice(block.row0, block.rows) for c in (0, 1)), block))
                if sum(t.num_rows for t in held) > HELD_ROWS:
                    held = [_summed(held)]
                    if held[0].num_rows > HELD_ROWS // 2:
                        yield from held.pop().to_batches(1 << 16)
        if held:
            yield from _summed(held).to_batches(1 << 16)

    found = docs.mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(count: np.ndarray, total: int) -> np.ndarray:
    """``1 + floor(SCALE * (count + 1) / total)`` in whole numbers, by three steps of long division."""
    quotient, rest = np.zeros(len(count), np.int64), count.astype(np.int64) + 1
    for _ in range(3):
        rest = rest * 1000
        quotient, rest = quotient * 1000 + rest // total, rest % total
    return 1 + quotient


def cell_pairs(cell: pa.Table) -> pa.Table:
    """What the term block of a cell adds for each ordered pair of sources, one of either group block.

    A row of the cell is a slice: ``lang``, ``low``, ``high`` (group blocks), ``own`` (the slice's), ``source``, ``total``
    (N + V), ``width`` (terms in the block) and ``slice`` (place and count of its terms).
    """
    width = cell.column("width")[0].as_py()
    own, low, high = (cell.column(c).to_numpy() for c in ("own", "low", "high"))
    names, totals, slices = cell.column("source").combine_chunks(), cell.column("total").to_numpy(), cell.column("slice").combine_chunks()
    share = np.ones((cell.num_rows, width), np.int64)
    places, counts = slices.flatten().field(0).to_numpy(zero_copy_only=False), slices.flatten().field(1).to_numpy(zero_copy_only=False)
    bounds = np.concatenate(([0], np.cumsum(np.diff(slices.offsets.to_numpy()))))
    for i in range(cell.num_rows if width else 0):
        share[i] = shares(np.zeros(1, np.int64), int(totals[i]))[0]
        at = slice(bounds[i], bounds[i + 1])
        share[i][places[at]] = shares(counts[at], int(totals[i]))
    left, right, value = [], [], []
    for i in range(cell.num_rows):
        # pairs inside one group block belong to its diagonal cell
        others = np.flatnonzero((own != own[i]) | (low == high))
        others = others[others != i]
        q = share[others]
        gap = share[i] - q
        left.append(np.full(len(others), i))
        right.append(others)
        value.append((gap * gap // q).sum(axis=1))
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.table({"lang": cell.column("lang").combine_chunks().take(pa.array(join(left))), "source": names.take(pa.array(join(left))),
                     "item": names.take(pa.array(join(right))), "value": pa.array(join(value), pa.int64())})


def _share(count: Column, total: Column) -> Column:
    return F.lit(1) + F.call_function("div", F.lit(SCALE).cast("decimal(38,0)") * (count + 1).cast("decimal(20,0)"), total.cast("decimal(20,0)"))


def source_divergence(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = 3, top_terms: int = 200) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value``, ``rank`` for every (lang, source) group of ``docs``.

    Part ``pair``: the divergence from each other source of the language, over the terms in at least ``least_docs`` rows of
    the language. Part ``term``: the terms that the group has beyond their share in the language, the first ``top_terms``.
    Ranks begin at 1 in each group and part, by falling value, then by the item's UTF-8 bytes.

    Null lang, source and text count as ''. Repeated rows are documents each. A group without terms still has pairs (its
    shares are those of counts of 0); a language without kept terms has pairs of value 0 and no terms; an empty table
    gives an empty result. Columns besides the three are not read.
    """
    small_batches(docs.sparkSession)
    clean = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))))
    counts = written(term_counts(clean), "term-counts")
    terms = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("m"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs")
    # terms of a block get places 0, 1, 2, ... in it
    sizes = counts.where("term IS NULL").groupBy("lang").agg(F.count(F.lit(1)).alias("sources"))
    known = written(terms, "kept-terms")
    sizes = sizes.join(known.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("m").alias("lang_n")), "lang", "left").na.fill(0, ["v", "lang_n"])
    sizes = sizes.withColumn("term_blocks", F.greatest(F.lit(1), F.ceil(F.col("v") / TERM_BLOCK))).withColumn("group_blocks", F.ceil(F.col("sources") / GROUP_BLOCK))
    sizes = written(sizes, "languages")
    dealt = known.join(sizes.select("lang", "term_blocks"), "lang").withColumn("k", F.pmod(F.xxhash64("term"), F.col("term_blocks"))).drop("term_blocks")
    place = F.row_number().over(Window.partitionBy("lang", "k").orderBy("term")) - 1
    dealt = written(dealt.withColumn("place", place), "placed-terms")
    rows = written(counts.where("term IS NOT NULL").drop("docs").join(dealt, ["lang", "term"]), "placed-counts")

    slices = written(rows.groupBy("lang", "source", "k").agg(F.collect_list(F.struct("place", "n")).alias("slice"), F.sum("n").alias("n")), "slices")
    groups = counts.where("term IS NULL").select("lang", "source").join(slices.groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left")
    groups = groups.join(sizes, "lang").withColumn("total", F.coalesce("n", F.lit(0)) + F.col("v")).withColumn("lang_total", F.col("lang_n") + F.col("v"))
    groups = written(groups.withColumn("own", F.pmod(F.xxhash64(F.lit("group"), "source"), F.col("group_blocks"))), "groups")

    widths = dealt.groupBy("lang", "k").agg(F.count(F.lit(1)).cast("int").alias("width"))
    every = groups.select("lang", "source", "own", "total", "group_blocks", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("term_blocks") - 1)).alias("k"))
    full = every.join(slices.drop("n"), ["lang", "source", "k"], "left").join(widths, ["lang", "k"], "left").na.fill(0, ["width"])
    none = F.array().cast("array<struct<place: int, n: bigint>>")
    full = full.withColumn("slice", F.coalesce("slice", none)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("group_blocks") - 1)))
    cells = full.select("lang", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "k", "own", "source", "total", "width", "slice")
    parts = cells.groupBy("lang", "low", "high", "k").applyInArrow(cell_pairs, "lang string, source string, item string, value bigint")
    pairs = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    p, q = _share(F.col("n"), F.col("total")), _share(F.col("m"), F.col("lang_total"))
    ratios = rows.join(groups.select("lang", "source", "total", "lang_total"), ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q"))
    gap = F.col("p") - F.col("q")
    over = ratios.where("p > q").select("lang", "source", "item", F.call_function("div", gap * gap, F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return ranked(pairs, "pair").unionByName(ranked(over, "term").where(F.col("rank") <= top_terms))
