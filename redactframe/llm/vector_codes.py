"""Compression of vectors to one byte a part, by per-dimension value dictionaries.

Components become whole numbers, ``floor(1024 * x)``. Blocks of vectors are stored as dictionary codes: for every
dimension the block's distinct integers, and a 16-bit code a component. A round of the codebook search then tabulates,
for each dimension, the squared difference of each distinct integer to all entries, once; the distance of a part is a
gather and an add a dimension over the codes. A block's tables are dropped with it, so memory does not grow with the
number of distinct values in the corpus.

Tasks hand on sums and counts of codebook entries; the driver sees the codebooks, 4 parts of 256 entries at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from redactframe.llm.store import written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors of a block of codes, and of one step of gathers and adds.
BLOCK_ROWS, STEP_ROWS = 8192, 1024
#: Whole components beyond this are refused: sums of them could pass 38 decimal digits.
LARGEST = 1 << 90


def whole_numbers(x: np.ndarray) -> np.ndarray:
    """``floor(1024 * x)`` of finite floats, exact: as int64 where all fit 2**62, else as Python integers."""
    scaled = np.floor(x.astype(np.float64) * SCALE)
    if scaled.size and np.abs(scaled).max() >= LARGEST:
        raise OverflowError("a component is too large for whole arithmetic")
    if not scaled.size or np.abs(scaled).max() < 2.0**62:
        return scaled.astype(np.int64)
    return np.array([int(v) for v in scaled.ravel().tolist()], object).reshape(scaled.shape)


def _kind(values: list[np.ndarray], codebook: np.ndarray):
    """The narrowest type that holds every sum of squared differences."""
    most = max([int(abs(v).max()) for v in values if len(v)] + [int(abs(codebook).max()) if codebook.size else 0] + [0])
    bound = (2 * most) ** 2 * max(1, len(values))
    return np.int32 if bound < 2**31 else np.int64 if bound < 2**62 else object


def assign(values: list[np.ndarray], codes: np.ndarray, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each part (ties to the lower index), and its squared distance, for the vectors of a block.

    ``values[d]`` are the distinct integers of dimension d, ``codes`` (vectors by dimensions) index them, ``codebooks``
    is parts by entries by dimensions of a part.
    """
    n, dims = codes.shape
    parts, entries, wide = codebooks.shape
    kind = _kind(values, codebooks)
    index, error = np.zeros((n, parts), np.int64), np.zeros((n, parts), object if kind is object else np.int64)
    for part in range(parts if n and wide else 0):
        tables = []
        for d in range(part * wide, (part + 1) * wide):
            gap = values[d].astype(kind)[:, None] - codebooks[part, :, d - part * wide].astype(kind)[None, :]
            tables.append(gap * gap)
        for a in range(0, n, STEP_ROWS):
            some = codes[a:a + STEP_ROWS, part * wide:(part + 1) * wide]
            total = tables[0][some[:, 0]]
            for d in range(1, wide):
                total += tables[d][some[:, d]]
            best = total.argmin(axis=1)
            index[a:a + STEP_ROWS, part] = best
            error[a:a + STEP_ROWS, part] = total[np.arange(len(best)), best]
    return index, error


def usable(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """``id``, ``label`` and ``vector`` (doubles) of the rows whose vector has finite components only."""
    rows = vectors.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("vector").isNotNull() & ~odd)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    if not dims:
        return np.zeros((len(column), 0), np.int64)
    return whole_numbers(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims))


def coded_blocks(rows: DataFrame, dims: int) -> DataFrame:
    """Blocks of vectors as dictionary codes: ``id`` and ``label`` lists, ``values`` (decimal text, by dimension) and ``codes`` (bytes)."""
    id_type, label_type = rows.schema["id"].dataType, rows.schema["label"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(a, BLOCK_ROWS)
                matrix = _matrix(part.column(2), dims)
                distinct = [np.unique(matrix[:, d], return_inverse=True) for d in range(dims)]
                codes = np.stack([c for _, c in distinct], axis=1).astype("<u2") if dims else np.zeros((part.num_rows, 0), "<u2")
                yield pa.RecordBatch.from_arrays([
                    pa.array([part.column(0).to_pylist()], pa.list_(batch.schema.field(0).type)), pa.array([part.column(1).to_pylist()], pa.list_(batch.schema.field(1).type)),
                    pa.array([[",".join(map(str, v.tolist())) for v, _ in distinct]], pa.list_(pa.string())), pa.array([codes.tobytes()], pa.binary())],
                    names=["id", "label", "values", "codes"])

    shape = T.StructType().add("id", T.ArrayType(id_type)).add("label", T.ArrayType(label_type)).add("values", T.ArrayType(T.StringType())).add("codes", "binary")
    return rows.select("id", "label", "vector").mapInArrow(run, shape)


def _blocks(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[int, list[np.ndarray], np.ndarray]]:
    for i, (values, codes) in enumerate(zip(batch.column("values"), batch.column("codes"), strict=True)):
        found = []
        for text in values.as_py():
            numbers = [int(x) for x in text.split(",")]
            found.append(np.array(numbers, np.int64 if max(map(abs, numbers)) < 2**62 else object))
        yield i, found, np.frombuffer(codes.as_buffer(), "<u2").reshape(-1, dims) if dims else np.zeros((len(batch.column("id")[i]), 0), "<u2")


def entry_sums(blocks: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """``part``, ``entry``, ``n`` and ``sums`` (one a dimension of the part) over the parts nearest to each entry."""
    parts, entries, wide = codebooks.shape
    sent = blocks.sparkSession.sparkContext.broadcast(codebooks)
    places = [f"s{d}" for d in range(wide)]
    kind = pa.decimal128(38)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((parts, entries), np.int64)
        sums = np.zeros((parts, entries, wide), object)
        for batch in batches:
            for _, values, codes in _blocks(batch, parts * wide):
                index, _ = assign(values, codes, sent.value)
                for part in range(parts):
                    n[part] += np.bincount(index[:, part], minlength=entries)
                    for d in range(wide):
                        # counts of (entry, distinct integer): whole numbers, summed exactly
                        own = values[part * wide + d]
                        pairs = np.bincount(index[:, part] * len(own) + codes[:, part * wide + d], minlength=entries * len(own)).reshape(entries, -1)
                        small = own.dtype != object and int(abs(own).max()) < 2**62 // max(1, len(codes))
                        sums[part, :, d] += (pairs @ own if small else pairs.astype(object) @ own.astype(object)).astype(object)
        used = np.argwhere(n > 0)
        p, e = used[:, 0], used[:, 1]
        yield pa.RecordBatch.from_arrays(
            [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(n[p, e], pa.int64()), *(pa.array([int(x) for x in sums[p, e, d]], kind) for d in range(wide))],
            names=["part", "entry", "n", *places])

    shape = ", ".join(["part int", "entry int", "n bigint", *(f"{s} decimal(38,0)" for s in places)])
    found = blocks.select("id", "values", "codes").mapInArrow(run, shape)
    return found.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(s).cast("string") for s in places)).cast("array<string>").alias("sums"))


def learn(blocks: DataFrame, codebooks: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Moves every used entry to the floor of the mean of its parts, ``rounds`` times."""
    for _ in range(rounds):
        moved = codebooks.astype(object)
        for r in entry_sums(blocks, codebooks).collect():  # at most parts * entries rows
            moved[r["part"], r["entry"]] = [int(s) // r["n"] for s in r["sums"]]
        codebooks = _narrow(moved)
    return codebooks


def _narrow(numbers: np.ndarray) -> np.ndarray:
    return numbers.astype(np.int64) if all(abs(x) < 2**62 for x in numbers.ravel().tolist()) else numbers


def encode(blocks: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """``id``, ``label``, ``index`` (an entry a part) and ``error`` of every vector of the blocks; an error beyond 64 bits is null."""
    parts, _, wide = codebooks.shape
    sent = blocks.sparkSession.sparkContext.broadcast(codebooks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, values, codes in _blocks(batch, parts * wide):
                index, error = assign(values, codes, sent.value)
                total = [int(x) for x in error.sum(axis=1)]
                lists = pa.FixedSizeListArray.from_arrays(pa.array(index.ravel(), pa.int32()), parts).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([
                    pc.list_flatten(batch.column("id").slice(i, 1)), pc.list_flatten(batch.column("label").slice(i, 1)), lists,
                    pa.array([x if x < 2**63 else None for x in total], pa.int64())], names=["id", "label", "index", "error"])

    shape = T.StructType().add("id", blocks.schema["id"].dataType.elementType).add("label", blocks.schema["label"].dataType.elementType).add("index", T.ArrayType(T.IntegerType())).add("error", "long")
    return blocks.mapInArrow(run, shape)


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES,
             rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(rows of ``id``, ``label``, ``index``, ``error``; the codebooks as parts by entries by dimensions of a part).

    Rows whose vector is null or holds a null or non-finite component go. The dimension is that of the smallest id's vector;
    vectors of another length go too, and a dimension that ``parts`` do not divide is filled up with components 0. Codebooks
    begin as the vectors of the ``entries`` smallest ids (repeated ids by their components, null ids last); a table of fewer
    rows has fewer entries, an empty one none. Repeated rows count each. Columns besides the three are not read.
    """
    rows = usable(vectors, key, vector, label)
    first = rows.orderBy(F.col("id").asc_nulls_last(), "vector").limit(1).select(F.size("vector").alias("n")).first()
    given = first["n"] if first else 0
    dims = -(-given // parts) * parts
    rows = rows.where(F.size("vector") == given)
    start = [r["vector"] for r in rows.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect()]
    if dims > given:
        rows = rows.withColumn("vector", F.concat("vector", F.array_repeat(F.lit(0.0), dims - given)))
        start = [v + [0.0] * (dims - given) for v in start]
    blocks = written(coded_blocks(rows, dims), "vector-codes")
    codebooks = whole_numbers(np.array(start, np.float64).reshape(len(start), dims)).reshape(len(start), parts, dims // parts).transpose(1, 0, 2)
    if start and dims:
        codebooks = learn(blocks, codebooks, rounds)
    return encode(blocks, codebooks), codebooks
