"""Exact near-duplicates: all pairs of texts whose sets of word shingles have a Jaccard similarity of 0.8 or more.

Candidates come first from the fingerprints of the sets, by the pigeonring search of ``simhash``; they are compared whole,
as are all others. Pairs at 0.8 differ in more bits than that search finds, so the prefix filter meets the rest.

Prefix filter: with the shingles of every set in one global order, two sets of similarity t share one of their first
``size - ceil(t * size) + 1``. An equi-join on those shingles meets each such pair, whatever the order is; rare
shingles come first, by counts of a sample of texts, so that little else meets. What meets must pass the bound that
sizes and places set (PPJoin); what is left is compared set by set.

A set's mark holds the parity of its shingles in each of about as many cells as it has shingles. Two marks differ in at
most as many cells as the sets differ in shingles, so a pair whose marks differ in more than Jaccard 0.8 allows goes
before any whole set travels.

Equal sets collapse first. Of the sets that share a shingle each is compared with one leader, then those not yet
connected with each other, so a large group of near copies does not become a list of all its pairs. A shingle that very
many sets share is dealt to blocks of sets; blocks have leaders of their own, which meet in turn, and what is not yet
connected meets block by block. Shingle and set equality is by 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redactframe.llm import blocks as B
from redactframe.llm import simhash
from redactframe.llm.components import connected
from redactframe.llm.store import discard, small_batches, written

#: Cells of the sample's shingle counts, and the number of texts in the sample. They decide cost, not results.
CELLS, SAMPLE = 1 << 20, 8192
#: Sets of a block of a shared shingle, about, and the share of sets (one of so many) whose shingles are counted for that.
BLOCK_SETS, COUNTED = 4096, 64
#: Rows (three numbers each) of a table that may be sent to all tasks.
SENT_ROWS = 1 << 20
#: Sets of a shared shingle up to which all pairs not connected are compared at once; of more, connected in turn, first a
#: spanning forest of those that marks leave is.
FEW_SETS = 32
#: Sets for each task and file of a stored table, at least.
FILE_SETS = 4096
_LOW = np.uint64(CELLS - 1)


def row_hash(rows: DataFrame) -> Column:
    """64-bit hash of a whole row; what Spark does not hash enters as text."""
    odd = ("map<", "variant")
    return F.xxhash64(*(f.cast("string") if any(o in rows.schema[c].dataType.simpleString() for o in odd) else f for c in rows.columns for f in [F.col(f"`{c}`")]))


def alike(shared, one, two):
    """Jaccard similarity of 0.8 or more, in whole numbers."""
    return 9 * shared >= 4 * (one + two)


def prefix_length(size):
    return np.where(size > 0, size - (4 * size + 4) // 5 + 1, 0)


def ordered_sets(block: B.Block, width: int, rank: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text by (rank of their cell, hash), and n + 1 bounds."""
    hashes, bounds = simhash.block_shingles(block.data, block.offsets, width)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    cell = rank[(hashes & _LOW).astype(np.intp)] if rank is not None else np.zeros(len(hashes), np.uint8)
    order = np.lexsort((hashes, cell, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], np.searchsorted(owner[new], np.arange(len(bounds)))


def mark_cells(size: int) -> int:
    """Cells of a mark: the least power of two that is not under twice the size, 64 at least."""
    return 1 << max(6, (2 * size - 1).bit_length())


def mark(hashes: np.ndarray) -> bytes:
    cells = mark_cells(len(hashes))
    return np.packbits((np.bincount((hashes >> np.uint64(20)).astype(np.int64) & (cells - 1), minlength=cells) & 1).astype(bool)).tobytes()


def may_be_alike(one: int, two: int, mark_one: bytes, mark_two: bytes) -> bool:
    """False only for sets (sizes and marks) that are not alike: the cells that differ bound their difference from below."""
    x, y = np.frombuffer(mark_one, np.uint8), np.frombuffer(mark_two, np.uint8)
    while len(x) != len(y):  # fold the longer one: a cell of the shorter is two of its cells
        x, y = (x, y) if len(x) < len(y) else (y, x)
        y = y[:len(y) // 2] ^ y[len(y) // 2:]
    return 9 * int(np.bitwise_count(x ^ y).sum()) <= one + two


def cell_ranks(texts: DataFrame, width: int) -> np.ndarray:
    """Logarithm of the shingle count of each cell, over a sample of the one text column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, np.int64)
        for batch in batches:
            for block in B.blocks(batch.column(0)):
                counts += np.bincount((ordered_sets(block, width, None)[0] & _LOW).astype(np.intp), minlength=CELLS)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used], pa.int64())], names=["cell", "n"])

    column = texts.columns[0]
    share = min(1.0, SAMPLE / max(1, texts.count()))
    drawn = texts.where(F.pmod(F.xxhash64(F.lit("shingle sample"), column), F.lit(2**20)) < int(share * 2**20))
    found = drawn.mapInArrow(run, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most CELLS rows
    rank = np.zeros(CELLS, np.uint8)
    rank[found.column("cell").to_numpy()] = np.log2(1 + found.column("n").to_numpy()).astype(np.uint8)
    return rank


def shingle_sets(rows: DataFrame, width: int, rank: np.ndarray) -> DataFrame:
    """``id``, ``row``, ``set`` (hash of the set), ``fp`` (its fingerprint), ``size``, ``prefix`` and ``mark`` of each row of (id, row, text)."""
    sent = rows.sparkSession.sparkContext.broadcast(rank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, prints, sizes, prefixes, counts, marks = [], [], [], [], [], []
            for block in B.blocks(batch.column(2)):
                hashes, bounds = ordered_sets(block, width, sent.value)
                size = np.diff(bounds)
                names.append(np.array([xxhash.xxh3_64_intdigest(hashes[a:b].tobytes()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], np.uint64))
                prints.append(simhash.majority(hashes, bounds))
                sizes.append(size)
                marks += [mark(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                counts.append(prefix_length(size))
                prefixes.append(B.gather(hashes, bounds[:-1], counts[-1]))
            whole = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
            offsets = np.concatenate(([0], np.cumsum(whole(counts, np.int64)))).astype(np.int32)
            prefix = pa.ListArray.from_arrays(pa.array(offsets), pa.array(whole(prefixes, np.uint64).view(np.int64)))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(whole(names, np.uint64).view(np.int64)), pa.array(whole(prints, np.uint64).view(np.int64)),
                pa.array(whole(sizes, np.int64), pa.int64()), prefix, pa.array(marks, pa.binary())],
                names=["id", "row", "set", "fp", "size", "prefix", "mark"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, row bigint, set bigint, fp bigint, size bigint, prefix array<bigint>, mark binary")


def _groups(batches: Iterator[pa.RecordBatch], keys: int, blocks: int | None = None) -> Iterator[list[np.ndarray]]:
    """Columns of the rows of one group at a time; the first ``keys`` columns name it, and the rows are sorted by them.

    A group of a single row is left out, unless the column numbered ``blocks`` says that its key has further blocks.
    """
    held: list[list[np.ndarray]] = []

    def wanted() -> bool:
        return len(held) > 1 or len(held[0][0]) > 1 or (blocks is not None and held[0][blocks][0] > 1)
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        new = np.zeros(batch.num_rows - 1, bool)
        for c in columns[:keys]:
            new |= c[1:] != c[:-1]
        cuts = np.concatenate(([0], np.flatnonzero(new) + 1, [batch.num_rows]))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if held and any(held[-1][k][0] != columns[k][a] for k in range(keys)):
                if wanted():
                    yield [np.concatenate(x) for x in zip(*held, strict=True)]
                held = []
            held.append([c[a:b] for c in columns])
    if held and wanted():
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _batch(parts: list[list[np.ndarray]], names: list[str]) -> pa.RecordBatch:
    columns = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=names)


def _in_batches(parts: Iterator[list[np.ndarray]], names: list[str], rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part[0])
        if n >= rows:
            yield _batch(held, names)
            held, n = [], 0
    if held:
        yield _batch(held, names)


def fingerprint_pairs(distinct: DataFrame, files: int) -> DataFrame:
    """Pairs (a, b) of sets (``set``, ``fp``): each set with the first of its fingerprint, and the first ones of fingerprints that the pigeonring search links."""
    prints = written(distinct.groupBy("fp").agg(F.min("set").alias("first")).coalesce(files), "near-prints")
    same = distinct.select("set", "fp").join(prints, "fp").where("set <> first").select("set", "first")
    end = lambda name: prints.select(F.col("fp").alias(name), F.col("first").alias(f"{name}_set"))
    near = simhash.links(prints.select("fp"), near_only=True).join(end("src"), "src").join(end("dst"), "dst").select("src_set", "dst_set")
    pairs = same.union(near).toDF("x", "y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    found = written(pairs.distinct().coalesce(files), "print-pairs")
    discard(prints)
    return found


def hot_keys(distinct: DataFrame) -> DataFrame:
    """``key`` and ``blocks`` of the shingles that more than a block of sets have in their prefixes, by counts of a share of the sets."""
    some = distinct.where(F.pmod(F.xxhash64(F.lit("counted"), "set"), F.lit(COUNTED)) == 0).select(F.explode("prefix").alias("key"))
    many = F.ceil(F.col("n") * COUNTED / BLOCK_SETS).cast("long")
    return some.groupBy("key").agg(F.count(F.lit(1)).alias("n")).select("key", many.alias("blocks")).where("blocks > 1")


def with_leaders(keyed: DataFrame, tasks: int) -> DataFrame:
    """The rows (key, block, blocks, size, place, set) whose key others share, with ``n`` (rows of the key and block) and ``lead``: a set of those that
    may be alike, or the set itself."""
    names = ["key", "block", "blocks", "size", "place", "set", "n", "lead"]

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        for key, block, blocks, size, place, name in _groups(batches, 2, 2):
            lead, at = np.empty(len(key), np.int64), 0
            while at < len(key):  # sizes rise
                end = int(np.searchsorted(4 * size, 5 * size[at], "right"))
                own = slice(at, end)
                may = alike(np.minimum(size[own] - place[own], size[at] - place[at]), size[own], size[at])
                lead[own] = np.where(may, name[at], name[own])
                at = end
            yield [key, block, blocks, size, place, name, np.full(len(key), len(key)), lead]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _in_batches(parts(batches), names)

    dealt = keyed.select(names[:-2]).repartition(tasks, "key", "block").sortWithinPartitions("key", "block", "size", "set")
    return dealt.mapInArrow(run, ", ".join(f"{x} bigint" for x in names))


def open_cells(known: DataFrame) -> DataFrame:
    """The rows of each key in cells (``low``, ``high``) of two blocks of it, or of one: every two rows of a key meet in a cell.

    Rows of a key of one block are in one cell. A key of more blocks whose rows all have one root has none.
    """
    zero = F.lit(0).cast("long")
    single = known.where("blocks = 1").withColumn("low", zero).withColumn("high", zero)
    many = known.where("blocks > 1")
    mixed = many.groupBy("key").agg(F.min("root").alias("first"), F.max("root").alias("last")).where("first <> last").select("key")
    dealt = many.join(mixed, "key").withColumn("other", F.explode(F.sequence(zero, F.col("blocks") - 1)))
    dealt = dealt.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("other")
    return single.unionByName(dealt)


class Marks:
    """Marks of rows by rising size, as bytes of equal width by class of width, and the same folded to half of it."""

    def __init__(self, size: np.ndarray, marks: list[bytes]):
        width = np.array([len(m) for m in marks])
        self.of: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
        self.width, self.size = width, size
        for w in np.unique(width).tolist():
            first, last = np.searchsorted(width, [w, w + 1])
            own = np.frombuffer(b"".join(marks[first:last]), np.uint8).reshape(-1, w)
            self.of[w] = first, own, own[:, :w // 2] ^ own[:, w // 2:]

    def near(self, i: int, j: np.ndarray) -> np.ndarray:
        """Which of the rows j (behind i, at most 1.25 times its size) may be alike to row i."""
        w, out = int(self.width[i]), np.zeros(len(j), bool)
        own = self.of[w][1][i - self.of[w][0]]
        for wide, k in ((w, 1), (2 * w, 2)):  # the wider class is folded
            if wide in self.of:
                some = np.flatnonzero(self.width[j] == wide)
                gap = np.bitwise_count(self.of[wide][k][j[some] - self.of[wide][0]] ^ own).sum(axis=1, dtype=np.int64)
                out[some] = 9 * gap <= self.size[j[some]] + self.size[i]
        return out


def open_pairs(cells: DataFrame, tasks: int, forest: bool = False) -> DataFrame:
    """Pairs (a, b) of a cell that may be alike by size and place, by marks where the cells have ``mark``, and have different ``root``.

    With ``forest`` only as many of a cell's pairs as connect what all of them connect.
    """
    names = ["key", "low", "high", "block", "size", "place", "set", "root", *(["mark"] if "mark" in cells.columns else [])]

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        for _, low, high, block, size, place, name, root, *mark in _groups(batches, 3):
            if (root == root[0]).all():
                continue
            marks = Marks(size, mark[0].tolist()) if mark else None
            apart = low[0] != high[0]  # pairs inside a block meet in the block's own cell
            ends = np.searchsorted(4 * size, 5 * size, "right")
            rest, tree = size - place, np.unique(root, return_inverse=True)[1]
            for i in range(len(size) - 1):
                j = np.arange(i + 1, ends[i])
                ok = (tree[j] != tree[i]) & alike(np.minimum(rest[j], rest[i]), size[j], size[i])
                if apart:
                    ok &= block[j] != block[i]
                j = j[ok]
                if marks and len(j):
                    j = j[marks.near(i, j)]
                if forest and len(j):  # one of each tree, and all are one tree from now on
                    met, first = np.unique(tree[j], return_index=True)
                    j = j[first]
                    tree[np.isin(tree, met)] = tree[i]
                if len(j):
                    yield [np.minimum(name[j], name[i]), np.maximum(name[j], name[i])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _in_batches(parts(batches), ["a", "b"])

    dealt = cells.select(names).repartition(tasks, "key", "low", "high")
    return dealt.sortWithinPartitions("key", "low", "high", "size", "set").mapInArrow(run, "a bigint, b bigint").distinct()


def likely_pairs(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sizes and marks (of ``set``, ``size``, ``mark``) leave them a chance."""
    of = lambda end, n: marks.select(F.col("set").alias(end), F.col("size").alias(f"size{n}"), F.col("mark").alias(f"mark{n}"))
    both = pairs.join(of("a", 1), "a").join(of("b", 2), "b").select("a", "b", "size1", "size2", "mark1", "mark2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, marks = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True), zip(batch.column(4), batch.column(5), strict=True)
            keep = [may_be_alike(m, n, x.as_buffer(), y.as_buffer()) for (m, n), (x, y) in zip(sizes, marks, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a bigint, b bigint")


def alike_pairs(pairs: DataFrame, distinct: DataFrame, docs: DataFrame, width: int, files: int) -> DataFrame:
    """The pairs (a, b) of sets that are alike: first by marks, then by comparison of the whole sets.

    ``distinct`` has ``set``, ``size``, ``mark``, and ``id`` and ``row`` of one row of ``docs`` (``id``, ``row``, ``text``).
    What is stored on the way has at most ``files`` files a table.
    """
    pairs = written(likely_pairs(pairs, distinct.select("set", "size", "mark")).coalesce(files), "near-pairs")
    named = pairs.select(F.col("a").alias("set")).unionByName(pairs.select(F.col("b").alias("set"))).distinct()
    chosen = distinct.select("set", "id", "row").join(named, "set")
    if 2 * pairs.count() <= SENT_ROWS:  # else the texts are shuffled for the join
        chosen = F.broadcast(chosen)

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for block in B.blocks(batch.column(1)):
                hashes, bounds = ordered_sets(block, width, None)
                out += [hashes[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["set", "body"])

    # rows that repeat as a whole give a set twice
    bodies = docs.join(chosen, ["id", "row"]).select("set", "text").dropDuplicates(["set"]).mapInArrow(shingles, "set bigint, body binary")
    bodies = written(bodies.coalesce(files), "near-bodies")
    both = pairs.join(bodies.select(F.col("set").alias("a"), F.col("body").alias("one")), "a").join(
        bodies.select(F.col("set").alias("b"), F.col("body").alias("two")), "b").select("a", "b", "one", "two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                keep[i] = alike(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y))
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    found = written(both.mapInArrow(run, "a bigint, b bigint").coalesce(files), "near-alike")
    discard(pairs, bodies)
    return found


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5) -> DataFrame:
    """``id``, ``row`` (hash of the whole row) and ``root`` of every row of ``docs``: rows of one root are connected by
    pairs of Jaccard similarity 0.8 or more.

    A text of fewer words than ``width`` has one shingle, all its words. Texts without words (null, empty) have the empty set
    and are alike among themselves. Repeated rows stay repeated; an empty table gives an empty result. Other columns, of any
    name and type, enter ``row`` only.
    """
    spark = docs.sparkSession
    small_batches(spark)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).alias("id"), row_hash(docs).alias("row"), F.col(text).alias("text"))
    sets = written(shingle_sets(rows, width, cell_ranks(docs.select(text), width)), "near-sets")
    # tasks of some thousand sets: tables of very many small files cost more to store than to make
    files = 1 + sets.count() // FILE_SETS
    one = F.min(F.struct("id", "row", "fp", "size", "prefix", "mark")).alias("one")
    distinct = written(sets.groupBy("set").agg(one).select("set", "one.*").coalesce(files), "near-distinct")
    keyed = distinct.select("set", "size", F.posexplode("prefix").alias("place", "key")).withColumn("place", F.col("place").cast("long"))
    keyed = keyed.join(written(hot_keys(distinct).coalesce(files), "hot-keys"), "key", "left").na.fill(1, ["blocks"])
    keyed = keyed.withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "set"), F.col("blocks")))
    met = written(with_leaders(keyed, tasks).coalesce(files), "near-met")
    # leaders of the blocks of a key have a leader in turn
    heads = with_leaders(met.where("blocks > 1 AND set = lead").withColumn("block", F.lit(0).cast("long")), tasks)
    led = met.where("set <> lead").select("set", "lead").unionByName(heads.where("set <> lead").select("set", "lead"))
    led = written(led.groupBy("set", "lead").agg(F.count(F.lit(1)).alias("n")).coalesce(files), "near-leaders")
    # each set with the leader of most of its shingles
    most = led.groupBy("set").agg(F.max(F.struct("n", "lead"))["lead"].alias("lead"))
    close = fingerprint_pairs(distinct, files)
    pairs = most.select(F.least("set", "lead").alias("a"), F.greatest("set", "lead").alias("b")).unionByName(close)
    links = alike_pairs(pairs.distinct(), distinct, rows, width, files)
    discard(close)

    def known(links: DataFrame) -> DataFrame:
        return met.join(connected(links).withColumnRenamed("node", "set"), "set", "left").withColumn("root", F.coalesce("root", "set"))

    # then what is not connected by that: all pairs of few sets, a forest of many, and what that leaves
    few = (F.col("blocks") == 1) & (F.col("n") <= FEW_SETS)
    marks = distinct.select("set", "mark")
    state = written(known(links).coalesce(files), "near-known")
    left = open_pairs(open_cells(state.where(few)), tasks).unionByName(open_pairs(open_cells(state.where(~few)).join(marks, "set"), tasks, forest=True))
    links = links.unionByName(alike_pairs(left.distinct(), distinct, rows, width, files))
    left = open_pairs(open_cells(known(links).where(~few)).join(marks, "set"), tasks)
    links = links.unionByName(alike_pairs(left, distinct, rows, width, files))
    discard(met, led, state)
    roots = connected(links).withColumnRenamed("node", "set")
    return sets.join(roots, "set", "left").select("id", "row", F.coalesce("root", "set").alias("root"))
