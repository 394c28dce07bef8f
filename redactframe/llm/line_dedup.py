"""Line dedup through a sharded minimal perfect hash.

Pass 1 hashes every line to 128 bits inside the scan's tasks and counts, by an ordinary aggregation, in how many
documents each occurs and which is the largest id that holds it. Lines of enough documents are dealt to shards by
hash. One task a shard builds a minimal perfect hash over its line hashes (levels of bit arrays, ranks by
counting) and, in the order that this hash gives, arrays of fingerprints, counts and keepers.

Pass 2 sends the arrays to the tasks in groups of bounded size and probes them for every line: no line is joined
or shuffled. An index larger than one group is probed group by group, with the documents written in between, so the
broadcast never grows with the data.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from redactframe.llm import blocks as B
from redactframe.llm.store import free_name, small_batches, written

#: Second base of the line hashes: one 64-bit hash places a line, the other is its fingerprint.
_SECOND = 0xA0761D6478BD642F
_GAMMA = 2.0
_LEVELS = 24
NO_KEEPER = -(2**63)


def line_keys(block: B.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each line's key (white space stripped at both ends), and each text's first line."""
    starts, ends, bounds = B.lines(block.data, block.offsets)
    solid = np.flatnonzero(B.NOT_SPACE[block.data])
    first, last = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    empty = first == last
    if len(solid):
        low = np.where(empty, starts, solid[np.minimum(first, len(solid) - 1)])
        high = np.where(empty, starts, solid[np.maximum(last - 1, 0)] + 1)
        return low, high, bounds
    return starts, starts, bounds


def hashed_lines(block: B.Block, min_chars: int):
    """Positions (line numbers in the block) of keys of at least ``min_chars`` code points, with both hashes."""
    low, high, bounds = line_keys(block)
    points = B.code_points(block.data)
    long_enough = np.flatnonzero(points[high] - points[low] >= min_chars)
    data = B.LOWER[block.data]
    low, high = low[long_enough], high[long_enough]
    return long_enough, B.span_hashes(data, low, high), B.span_hashes(data, low, high, _SECOND), bounds


@dataclass
class PerfectHash:
    """Places n known 64-bit hashes at 0 to n - 1; any other hash gets some place or -1."""

    sizes: list[int]
    bits: np.ndarray  # all levels' bits, packed
    ranks: np.ndarray  # set bits before every 512th bit
    rest: np.ndarray  # hashes that no level could place alone, sorted

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash:
        left, sizes, levels = np.unique(hashes), [], []
        for level in range(_LEVELS):
            if not len(left):
                break
            size = max(64, int(_GAMMA * len(left)))
            place = cls._place(left, level, size)
            alone = np.bincount(place, minlength=size) == 1
            sizes.append(size)
            levels.append(alone)
            left = left[~alone[place]]
        flat = np.concatenate(levels) if levels else np.zeros(0, bool)
        flat = np.concatenate((flat, np.zeros(-len(flat) % 512, bool)))
        ranks = np.concatenate(([0], np.cumsum(flat.reshape(-1, 512).sum(axis=1)))).astype(np.int64)
        return cls(sizes, np.packbits(flat, bitorder="little"), ranks, np.sort(left))

    @staticmethod
    def _place(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
        salt = np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)
        return (B.mix(hashes + salt) % np.uint64(size)).astype(np.int64)

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -1, np.int64)
        open_, before = np.arange(len(hashes)), 0
        words = self.bits.view("<u8")
        for level, size in enumerate(self.sizes):
            if not len(open_):
                return out
            bit = before + self._place(hashes[open_], level, size)
            hit = (self.bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
            at = bit[hit]
            # set bits before: whole stretches of 512, then whole words, then within the word
            rank = self.ranks[at >> 9]
            for k in range(7):
                rank = rank + np.where((at >> 6 & 7) > k, np.bitwise_count(words[(at >> 9) * 8 + k]), 0)
            below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            out[open_[hit]] = rank + np.bitwise_count(words[at >> 6] & below)
            open_, before = open_[~hit], before + size
        if len(self.rest) and len(open_):
            at = np.minimum(np.searchsorted(self.rest, hashes[open_]), len(self.rest) - 1)
            same = self.rest[at] == hashes[open_]
            out[open_[same]] = self.ranks[-1] + at[same]
        return out


@dataclass
class Shard:
    """One shard's perfect hash and, by place, fingerprint, document count and keeper of each line."""

    index: PerfectHash
    prints: np.ndarray
    counts: np.ndarray
    keepers: np.ndarray

    @classmethod
    def build(cls, place: np.ndarray, prints: np.ndarray, counts: np.ndarray, keepers: np.ndarray) -> Shard:
        index = PerfectHash.build(place)
        order = np.zeros(len(place), np.int64)
        order[index.lookup(place)] = np.arange(len(place))
        return cls(index, prints[order], counts[order], keepers[order])

    def probe(self, place: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which lines are in the shard, and the keeper of each."""
        at = self.index.lookup(place)
        known = at >= 0
        known[known] = self.prints[at[known]] == prints[known]
        keeper = np.full(len(place), NO_KEEPER)
        keeper[known] = self.keepers[at[known]]
        return known, keeper

    def to_row(self) -> dict:
        i = self.index
        arrays = {"bits": i.bits, "ranks": i.ranks, "rest": i.rest, "prints": self.prints, "counts": self.counts, "keepers": self.keepers}
        return {"sizes": i.sizes, **{k: v.tobytes() for k, v in arrays.items()}}

    @classmethod
    def of_row(cls, row: Row) -> Shard:
        index = PerfectHash(list(row["sizes"]), np.frombuffer(row["bits"], np.uint8), np.frombuffer(row["ranks"], np.int64),
                            np.frombuffer(row["rest"], np.uint64))
        return cls(index, np.frombuffer(row["prints"], np.uint64), np.frombuffer(row["counts"], np.int32), np.frombuffer(row["keepers"], np.int64))


_SHARD_TYPE = "shard int, sizes array<bigint>, bits binary, ranks binary, rest binary, prints binary, counts binary, keepers binary"


def line_counts(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """``place``, ``print`` (the two hashes), ``n`` documents and ``keeper`` of each line of enough documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for block in B.blocks(batch.column(1)):
                which, place, prints, bounds = hashed_lines(block, min_chars)
                doc = B.owner(bounds)[which]
                # one entry a document and line, however often the document repeats it
                order = np.lexsort((doc, prints, place))
                place, prints, doc = place[order], prints[order], doc[order]
                new = np.ones(len(doc), bool)
                new[1:] = (place[1:] != place[:-1]) | (prints[1:] != prints[:-1]) | (doc[1:] != doc[:-1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(place[new].view(np.int64)), pa.array(prints[new].view(np.int64)), ids.take(pa.array(block.row0 + doc[new]))],
                    names=["place", "print", "id"])

    lines = docs.mapInArrow(run, "place bigint, print bigint, id bigint")
    return lines.groupBy("place", "print").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("id"), F.lit(NO_KEEPER)).alias("keeper")).where(F.col("n") >= min_docs)


def build_index(counts: DataFrame, shard_lines: int) -> tuple[DataFrame, int]:
    """One row per shard, its perfect hash and arrays; and the number of shards that lines are dealt to."""
    counts = written(counts, "lines")
    shards = max(1, -(-counts.count() // shard_lines))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        keeper = group["keeper"].to_numpy(np.int64)
        shard = Shard.build(group["place"].to_numpy(np.int64).view(np.uint64), group["print"].to_numpy(np.int64).view(np.uint64),
                            group["n"].clip(upper=2**31 - 1).to_numpy(np.int32), keeper)
        return pd.DataFrame([{"shard": int(group["shard"].iloc[0]), **shard.to_row()}])

    # the top bits deal the shards; the perfect hash mixes all bits anew
    dealt = counts.withColumn("shard", F.pmod(F.shiftrightunsigned("place", 33), F.lit(shards)).cast("int"))
    return written(dealt.groupBy("shard").applyInPandas(build, _SHARD_TYPE), "line-shards"), shards


@dataclass
class ShardGroup:
    """Some shards of an index of ``total`` shards, as they are sent to the tasks."""

    total: int
    shards: dict[int, Shard]

    def probe(self, place: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known, keeper = np.zeros(len(place), bool), np.full(len(place), NO_KEEPER)
        own = (place >> np.uint64(33)) % np.uint64(self.total)
        for number, shard in self.shards.items():
            at = np.flatnonzero(own == number)
            known[at], keeper[at] = shard.probe(place[at], prints[at])
        return known, keeper


def _groups(index: DataFrame, limit: int) -> list[list[int]]:
    """Shard numbers in groups of at most ``limit`` bytes of arrays (a shard is bounded by its number of lines)."""
    size = sum(F.octet_length(c) for c in ("bits", "ranks", "rest", "prints", "counts", "keepers"))
    groups, held = [], 0
    for row in index.select("shard", size.alias("size")).orderBy("shard").collect():
        if not groups or held + row["size"] > limit:
            groups, held = [*groups, []], 0
        groups[-1].append(row["shard"])
        held += row["size"]
    return groups


def drop_lines(batch_ids: pa.Array, column: pa.Array, group: ShardGroup, min_chars: int):
    """New texts of a batch, and lines before and dropped."""
    ids = np.asarray(pc.fill_null(pc.cast(batch_ids, pa.int64()), NO_KEEPER), np.int64)
    texts, n_lines, n_dropped = [], [], []
    for block in B.blocks(column):
        starts, ends, bounds = B.lines(block.data, block.offsets)
        which, place, prints, _ = hashed_lines(block, min_chars)
        doc = B.owner(bounds)
        known, keeper = group.probe(place, prints)
        gone = np.zeros(len(starts), bool)
        gone[which] = known & (keeper != ids[block.row0 + doc[which]])
        dropped = B.per_text(gone.astype(np.int64), bounds)
        n_lines.append(np.diff(bounds))
        n_dropped.append(dropped)
        # kept lines keep their newline; the last kept line of a text loses it
        stays = ~gone
        lengths = np.where(stays, ends - starts + 1, 0)
        last = np.zeros(len(starts), bool)
        kept = np.flatnonzero(stays)
        if len(kept):
            last[kept[np.flatnonzero(np.append(doc[kept][1:] != doc[kept][:-1], True))]] = True
        data = np.append(block.data, np.uint8(10))
        # a text's final line has no newline of its own: its span may reach into the next text by one byte
        spans = B.gather(data, starts, lengths)
        line_end = np.cumsum(lengths)
        if len(kept):
            spans[line_end[kept] - 1] = 10
        cut = last & stays
        keep_byte = np.ones(len(spans), bool)
        keep_byte[line_end[cut] - 1] = False
        sizes = B.per_text(lengths - cut, bounds)
        texts.append((spans[keep_byte], sizes))
    sizes = np.concatenate([s for _, s in texts]) if texts else np.zeros(0, np.int64)
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    data = np.concatenate([d for d, _ in texts]) if texts else np.zeros(0, np.uint8)
    new = pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return new, join(n_lines), join(n_dropped)


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 40, min_docs: int = 5,
                shard_lines: int = 500_000, group_bytes: int = 64 << 20) -> DataFrame:
    """All columns of ``docs`` with the text less its repeated lines, then ``__lines`` and ``__dropped`` (counts).

    A line's key is the line without ASCII white space at its ends and in ASCII lower case. Keys of at least
    ``min_chars`` code points in at least ``min_docs`` rows lose their lines except in the row of the largest id (in
    every row that carries it, if rows repeat). A null text is one empty line and comes out empty; rows with a null
    key count as documents and keep a line only where no row with a key has it. Other columns pass as they are, whatever
    their names: a new name that is taken gets underscores behind it. Keys are whole numbers; others raise TypeError.
    """
    small_batches(docs.sparkSession)
    if not isinstance(docs.schema[key].dataType, T.IntegralType):
        raise TypeError(f"{key} is not a column of whole numbers")
    counts = line_counts(docs.select(F.col(key).cast("bigint"), text), min_chars, min_docs)
    index, total = build_index(counts, shard_lines)
    names = docs.columns
    at_key, at_text = names.index(key), names.index(text)
    lines, dropped = (free_name(name, docs.columns) for name in ("__lines", "__dropped"))
    state = docs.withColumn(lines, F.lit(None).cast("bigint")).withColumn(dropped, F.lit(0).cast("bigint"))
    kind = T.StructType(state.schema.fields)
    for number, members in enumerate(_groups(index, group_bytes) or [[]]):
        rows = index.where(F.col("shard").isin(members)).collect() if members else []
        sent = docs.sparkSession.sparkContext.broadcast(ShardGroup(total, {r["shard"]: Shard.of_row(r) for r in rows}))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                columns = batch.columns
                new, n_lines, n_dropped = drop_lines(columns[at_key], columns[at_text], sent.value, min_chars)
                columns[at_text] = new.cast(columns[at_text].type)
                columns[-2] = pc.coalesce(columns[-2], pa.array(n_lines, pa.int64()))
                columns[-1] = pc.add(columns[-1], pa.array(n_dropped, pa.int64()))
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

        if number:
            state = written(state, "line-pass")
        state = state.mapInArrow(run, kind)
    return state
