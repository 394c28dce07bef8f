"""SimHash near-duplicates: fingerprints of word shingles, linked by a pigeonring filter.

A fingerprint's 64 bits lie on a ring of segments. Two fingerprints at ``budget`` or fewer differing bits
agree on at least ``segments - budget`` whole segments, so an equi-join on every choice of that many segments
meets each such pair. What meets goes through the pigeonring test: some segment must start a chain in which
the first 1, 2, 3, ... consecutive segments differ by no more than their share of the budget. Only
survivors get the full Hamming check.

No pair list is made. Documents collapse to distinct fingerprints first; a bucket (fingerprints that share a
choice of segments) is searched breadth-first inside one task and leaves one link per reached fingerprint, and
a bucket beyond ``bucket_rows`` is dealt out as pairs of blocks, so no bucket has to fit into a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactframe.llm import blocks as B
from redactframe.llm.components import connected
from redactframe.llm.store import small_batches, written

SEED = 42
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))  # fixed values of XXH64
#: Spans longer than this are hashed one by one.
_LONG = 512


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc, lane):
    return _rotl(acc + lane * _P2, 31) * _P1


def xxh64_spans(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of many byte spans of one array: spans of equal length go through the rounds together."""
    out = np.empty(len(starts), np.uint64)
    if not len(starts):
        return out
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    # the eight bytes from every place on, as one little-endian number
    lanes = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,)).copy()
    order = np.argsort(lengths.astype(np.uint16) if lengths.max() < 65536 else lengths, kind="stable")
    by_length = lengths[order]
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(by_length)) + 1, [len(order)]))
    base = np.uint64(seed)
    with np.errstate(over="ignore"):
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            size, rows = int(by_length[a]), order[a:b]
            if size > _LONG:
                for i in rows:
                    out[i] = xxhash.xxh64_intdigest(data[starts[i]:starts[i] + size].tobytes(), seed)
                continue
            at, left = starts[rows].copy(), size
            if size >= 32:
                acc = [np.full(len(at), x, np.uint64) for x in (base + _P1 + _P2, base + _P2, base, base - _P1)]
                while left >= 32:
                    acc = [_round(x, lanes[at + 8 * k]) for k, x in enumerate(acc)]
                    at += 32
                    left -= 32
                h = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
                for x in acc:
                    h = (h ^ _round(np.uint64(0), x)) * _P1 + _P4
            else:
                h = np.full(len(at), base + _P5, np.uint64)
            h = h + np.uint64(size)
            while left >= 8:
                h = _rotl(h ^ _round(np.uint64(0), lanes[at]), 27) * _P1 + _P4
                at += 8
                left -= 8
            if left >= 4:
                h = _rotl(h ^ ((lanes[at] & np.uint64(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
                at += 4
                left -= 4
            while left:
                h = _rotl(h ^ ((lanes[at] & np.uint64(0xFF)) * _P5), 11) * _P1
                at += 1
                left -= 1
            h = (h ^ (h >> np.uint64(33))) * _P2
            h = (h ^ (h >> np.uint64(29))) * _P3
            out[rows] = h ^ (h >> np.uint64(32))
    return out


#: A byte's eight bits, each as a count of its own byte within one 64-bit number.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8").ravel().copy()


def majority(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Bits that are set in over half of each text's hashes; no hashes give zero."""
    counts = np.diff(bounds)
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    # byte-wide counters hold 255 at most, so each text is summed in chunks of that many hashes
    chunks = -(-counts[full] // 255)
    first_chunk = np.concatenate(([0], np.cumsum(chunks)))
    within = np.arange(first_chunk[-1]) - np.repeat(first_chunk[:-1], chunks)
    chunk_starts = np.repeat(bounds[:-1][full], chunks) + 255 * within
    for lane in range(8):
        spread = _SPREAD[((hashes >> np.uint64(8 * lane)) & np.uint64(0xFF)).astype(np.intp)]
        eight = np.add.reduceat(spread, chunk_starts).view(np.uint8).reshape(-1, 8)
        bits = np.add.reduceat(eight.astype(np.int64), first_chunk[:-1], axis=0)
        over = 2 * bits > counts[full][:, None]
        out[full] |= np.packbits(over, axis=1, bitorder="little").ravel().astype(np.uint64) << np.uint64(8 * lane)
    return out


def block_shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word shingles, text after text, and each text's first."""
    data = B.LOWER[data]
    starts, ends, bounds = B.runs(B.NOT_SPACE[data], offsets)
    lengths = ends - starts
    # the words again, each followed by one blank: a shingle is then one span
    joined_at = np.concatenate(([0], np.cumsum(lengths + 1)))
    joined = np.full(joined_at[-1], 0x20, np.uint8)
    keep = np.ones(len(joined), bool)
    keep[joined_at[1:] - 1] = False
    joined[keep] = B.gather(data, starts, lengths)
    words = np.diff(bounds)
    shingles = np.where(words >= width, words - width + 1, np.minimum(words, 1))
    out_bounds = np.concatenate(([0], np.cumsum(shingles)))
    first = np.arange(out_bounds[-1]) - np.repeat(out_bounds[:-1] - bounds[:-1], shingles)
    last = first + np.repeat(np.minimum(words, width), shingles) - 1
    begin = joined_at[first]
    return xxh64_spans(joined, begin, joined_at[last + 1] - 1 - begin), out_bounds


def block_fingerprints(data: np.ndarray, offsets: np.ndarray, width: int) -> np.ndarray:
    return majority(*block_shingles(data, offsets, width))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4) -> DataFrame:
    """One row per document: its key and ``fp``, the 64 bits as a signed number.

    Null and empty texts have no words and get fingerprint zero; a text of fewer words than ``width`` has one
    shingle, the whole sequence. Other columns of ``docs`` are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [block_fingerprints(b.data, b.offsets, width) for b in B.blocks(batch.column(1))]
            fp = np.concatenate(prints) if prints else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("id"), F.col(text).alias("t")).mapInArrow(run, f"id {kind}, fp bigint")


def _segments(count: int) -> list[np.uint64]:
    """Masks of ``count`` consecutive segments of 64 bits, as even as they can be."""
    cuts = [round(64 * i / count) for i in range(count + 1)]
    return [np.uint64((1 << b) - (1 << a)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def pigeonring(differences: np.ndarray, budget: int) -> np.ndarray:
    """Rows of segment differences (one column a segment) in which some start passes every chain length."""
    m = differences.shape[1]
    ring = np.concatenate((differences, differences[:, :-1]), axis=1).astype(np.int64)
    running = np.concatenate((np.zeros((len(ring), 1), np.int64), np.cumsum(ring, axis=1)), axis=1)
    passes = np.zeros(len(ring), bool)
    for start in range(m):
        ok = np.ones(len(ring), bool)
        for length in range(1, m + 1):
            ok &= (running[:, start + length] - running[:, start]) * m <= length * budget
        passes |= ok
    return passes


def near(one: np.uint64, many: np.ndarray, masks: list[np.uint64], budget: int) -> np.ndarray:
    """Positions in ``many`` within ``budget`` bits of ``one``: pigeonring test first, then the full count."""
    x = many ^ one
    # an eighth of the columns decides for most rows, so segments are counted on what that leaves
    alive = np.flatnonzero(np.bitwise_count(x & masks[0]) + np.bitwise_count(x & masks[1]) <= budget)
    if not len(alive):
        return alive
    x = x[alive]
    differences = np.stack([np.bitwise_count(x & m) for m in masks], axis=1)
    alive, x = alive[ok := pigeonring(differences, budget)], x[ok]
    return alive[np.bitwise_count(x) <= budget]


def spanning_links(prints: np.ndarray, masks: list[np.uint64], budget: int, near_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """For the fingerprints of one bucket: (member, smallest of its connected part) for all but that smallest.

    With ``near_only`` the second is the near fingerprint from which the member was reached.
    """
    prints = np.unique(prints)
    child, root = [], []
    left = prints
    while len(left) > 1:
        top, left = left[0], left[1:]
        queue = [top]
        while queue and len(left):
            one = queue.pop()
            hit = near(one, left, masks, budget)
            if len(hit):
                found = left[hit]
                child.append(found)
                root.append(np.full(len(found), one if near_only else top, np.uint64))
                queue.extend(found)
                left = np.delete(left, hit)
    none = np.zeros(0, np.uint64)
    return (np.concatenate(child), np.concatenate(root)) if child else (none, none)


def links(distinct: DataFrame, budget: int = 4, segments: int = 7, bucket_rows: int = 4096, near_only: bool = False) -> DataFrame:
    """Links (src, dst) that connect exactly those fingerprints (column ``fp``) that ``budget`` bits connect.

    With ``near_only`` each link is itself of ``budget`` bits or fewer; else it may end at the smallest fingerprint of a bucket's part.

    Choices and buckets are always shuffled: the planner sizes them by the fingerprints, not by the rows that each expands to, and would
    broadcast, through the driver, many times what it reckons with.
    """
    masks = _segments(segments)
    choices = [np.bitwise_or.reduce([masks[i] for i in pick]) for pick in combinations(range(segments), segments - budget)]
    signed = [int(np.uint64(c).view(np.int64)) for c in choices]
    # few bytes, much work: a fixed number of tasks, where adaptive execution would go by the bytes
    tasks = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = distinct.repartition(tasks, F.xxhash64("fp")).select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(c)) for c in signed])).alias("pick", "bits"))
    sizes = keyed.groupBy("pick", "bits").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = keyed.hint("merge").join(sizes.hint("merge"), ["pick", "bits"])
    # a bucket of g blocks: each fingerprint goes to the g pairs of blocks that hold its own
    parts = F.ceil(F.col("n") / F.lit(bucket_rows)).cast("int")
    own = F.pmod(F.xxhash64("fp"), parts).cast("int")
    dealt = met.withColumn("own", own).withColumn("parts", parts).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("fp", "pick", "bits", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    bucket = F.xxhash64("pick", "bits", "lo", "hi").alias("bucket")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(prints: list[np.ndarray]):
            child, root = spanning_links(np.concatenate(prints).view(np.uint64), masks, budget, near_only)
            return pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), pa.array(root.view(np.int64))], names=["src", "dst"])

        open_key, held = None, []
        for batch in batches:
            keys, prints = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(keys):
                continue
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if keys[a] != open_key and held:
                    yield flush(held)
                    held = []
                open_key = keys[a]
                held.append(prints[a:b])
        if held:
            yield flush(held)

    pairs = dealt.select(bucket, "fp").repartition(tasks, "bucket").sortWithinPartitions("bucket")
    return pairs.mapInArrow(run, "src bigint, dst bigint").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, budget: int = 4,
                    segments: int = 7, bucket_rows: int = 4096) -> DataFrame:
    """Fingerprint and component of every document: ``id``, ``fp`` (signed), ``component`` (smallest id reachable).

    Repeated rows stay repeated. Rows with a null key take part; a component's smallest id skips nulls and is null
    only where all its ids are. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    prints = written(fingerprints(docs, key, text, width), "simhash")
    by_print = prints.groupBy("fp").agg(F.min("id").alias("smallest"))
    roots = connected(links(by_print.select("fp"), budget, segments, bucket_rows))
    rooted = by_print.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = written(rooted, "simhash-roots")
    # only fingerprints that have a link need their component's smallest id looked up
    component = rooted.groupBy("root").agg(F.min("smallest").alias("component"))
    by_print = rooted.select("fp", "root").join(component, "root").select("fp", "component")
    return prints.join(by_print, "fp").select("id", "fp", "component")


def hex_print(column: str = "fp"):
    return F.lower(F.lpad(F.hex(column), 16, "0"))
