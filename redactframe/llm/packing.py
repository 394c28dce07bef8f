"""Packing documents into token sequences: length patterns by non-negative least squares, then best fit.

Tokens are counted in the scan's tasks. The histogram of piece lengths, one number a length, is all that the driver
sees. It lists the patterns of up to three lengths that fill a sequence exactly, fits how often each repeats by
non-negative least squares, rounds, and packs what is left by best fit over length counts. The plan is runs of equal
patterns, whose number depends on the sequence length only. Each piece then gets a number among the pieces of its
length (spread over cells of bounded size) and looks its place up in the plan.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from redactframe.llm.sharding import numbered
from redactframe.llm.store import small_batches, written

_encoders: dict[str, object] = {}


def encoder(path: str):
    """A byte-level BPE tokenizer file as ranks of the faster library: same vocabulary, same ids.

    The file's merges are in the order of their results' ids, so an id is its rank; added tokens found in a text
    become their id, as the tokenizer itself does.
    """
    if path not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # the printable stand-ins that byte-level vocabularies write for bytes
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        stand_in = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(stand_in[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
        _encoders[path] = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
    return _encoders[path]


def token_ids(path: str, text: str) -> np.ndarray:
    return np.asarray(encoder(path).encode_to_numpy(text, allowed_special="all"), "<u4")


def pieces(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = 1024, end_id: int = 2, keep: tuple[str, ...] = ()) -> DataFrame:
    """``id``, ``piece``, ``start``, ``length``, ``crc`` of every piece, and the columns ``keep`` of its document; a null text is the end token alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # equal texts of a batch are encoded once
            texts = pc.fill_null(batch.column(1), "").dictionary_encode()
            known: list[tuple] = []
            for value in texts.dictionary:
                ids = np.append(token_ids(path, value.as_py()), np.uint32(end_id)).astype("<u4")
                first = len(ids) if len(ids) <= limit else len(ids) % limit or limit
                starts = np.concatenate(([0], np.arange(first, len(ids), limit)))
                ends = np.append(starts[1:], len(ids))
                known.append((starts, ends - starts, [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]))
            rows = [known[i] for i in texts.indices.to_pylist()]
            count = np.array([len(r[0]) for r in rows], np.int64)
            numbers = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            own = pa.array(np.repeat(np.arange(len(rows)), count))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(own), pa.array(numbers, pa.int32()),
                pa.array(np.concatenate([r[0] for r in rows] or [[]]), pa.int64()), pa.array(np.concatenate([r[1] for r in rows] or [[]]), pa.int64()),
                pa.array([c for r in rows for c in r[2]], pa.int64()), *(x.take(own) for x in batch.columns[2:])], names=["id", "piece", "start", "length", "crc", *keep])

    shape = T.StructType([T.StructField("id", docs.schema[key].dataType)]).add("piece", "integer").add("start", "long").add("length", "long").add("crc", "long")
    shape = T.StructType([*shape.fields, *(docs.schema[c] for c in keep)])
    return docs.select(F.col(key).alias("id"), F.col(text).alias("text"), *keep).mapInArrow(run, shape)


def exact_patterns(lengths: np.ndarray, limit: int) -> np.ndarray:
    """All sets of one to three of the lengths that sum to ``limit``, as rows in falling order padded by zeros."""
    present = np.zeros(limit + 1, bool)
    present[lengths] = True
    out = [np.array([[limit, 0, 0]])] if present[limit] else []
    for a in lengths:
        b = limit - a
        if 0 < b <= a and present[b]:
            out.append(np.array([[a, b, 0]]))
        b = lengths[(lengths <= a) & (lengths < limit - a)]
        c = limit - a - b
        ok = (c <= b) & present[np.maximum(c, 0)]
        out.append(np.stack([np.full(ok.sum(), a), b[ok], c[ok]], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 3), np.int64)


def fit_repeats(patterns: np.ndarray, counts: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative least squares: repeats x with as little as can be of |A x - counts|, by accelerated projection.

    A (lengths by patterns) is only applied: a pattern touches three lengths at most. Short lengths weigh less, as
    they fit into what is left over anyway.
    """
    n = len(counts)
    weight = np.linspace(0.3, 1.0, n)
    weight[0] = 0.0  # the padding

    def apply(x: np.ndarray) -> np.ndarray:
        return sum(np.bincount(patterns[:, k], x, n) for k in range(3)) * weight

    def back(r: np.ndarray) -> np.ndarray:
        r = r * weight
        return r[patterns].sum(axis=1)

    v = np.ones(len(patterns))
    for _ in range(20):  # the largest eigenvalue bounds the step
        v = back(apply(v))
        v /= np.linalg.norm(v) or 1.0
    step = 1.0 / (1.02 * float(v @ back(apply(v))) or 1.0)
    x = y = np.zeros(len(patterns))
    t, want = 1.0, counts * weight
    for _ in range(rounds):
        new = np.maximum(0.0, y - step * back(apply(y) - want))
        t, s = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        y, x = new + (s - 1) / t * (new - x), new
    return x


@dataclass
class Plan:
    """Runs of equal slots: slots ``first`` on of a length lie at ``offset`` of sequences ``sequence`` on."""

    keys: np.ndarray  # length * 2**44 + first, sorted
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (length << 44) + number
        at = np.searchsorted(self.keys, key, "right") - 1
        return self.sequence[at] + key - self.keys[at], self.offset[at]


def _best_fit(left: np.ndarray, limit: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over counts: equal pieces meet equal bins in one step."""
    open_: dict[int, dict[tuple[int, ...], int]] = {}
    free = np.zeros(limit + 1, np.int64)

    def put(space: int, pattern: tuple[int, ...], many: int) -> None:
        own = open_.setdefault(space, {})
        own[pattern] = own.get(pattern, 0) + many
        free[space] += many

    for length in range(limit, 0, -1):
        count = int(left[length])
        while count:
            fits = np.flatnonzero(free[length:])
            if not len(fits):
                each = limit // length
                if count >= each:
                    put(limit - each * length, (length,) * each, count // each)
                if count % each:
                    put(limit - count % each * length, (length,) * (count % each), 1)
                break
            space = length + int(fits[0])
            pattern, many = next(iter(open_[space].items()))
            each = min(space // length, max(1, count // many)) if many <= count else 1
            used = min(many, count // each)
            if used == many:
                del open_[space][pattern]
            else:
                open_[space][pattern] -= used
            free[space] -= used
            put(space - each * length, pattern + (length,) * each, used)
            count -= used * each
    return [(p, n) for own in open_.values() for p, n in own.items()]


def make_plan(counts: np.ndarray, limit: int) -> Plan:
    """Plan for ``counts[l]`` pieces of each length l."""
    left = counts.astype(np.int64).copy()
    chosen: list[tuple[tuple[int, ...], int]] = []
    patterns = exact_patterns(np.flatnonzero(left), limit)
    if len(patterns):
        x = fit_repeats(patterns, left.astype(float))
        rounded = np.floor(x + 0.5).astype(np.int64)
        for i in np.argsort(-x, kind="stable")[:np.count_nonzero(rounded)]:
            pattern = tuple(int(v) for v in patterns[i] if v)
            many = min(int(rounded[i]), *(int(left[v]) // pattern.count(v) for v in pattern))
            if many > 0:
                chosen.append((pattern, many))
                for v in pattern:
                    left[v] -= many
    chosen += _best_fit(left, limit)
    runs, base = [], 0
    for pattern, many in chosen:
        offset = 0
        for v in pattern:
            runs.append((v, many, base, offset))
            offset += v
        base += many
    length, many, first, offset = np.array(runs, np.int64).reshape(-1, 4).T
    order = np.argsort(length, kind="stable")
    length, many, first, offset = length[order], many[order], first[order], offset[order]
    before = np.cumsum(many) - many
    own = np.searchsorted(length, length)
    number = before - before[own] if len(length) else before
    return Plan((length << 44) + number, first, offset, base)


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = 1024, end_id: int = 2, cell_rows: int = 512,
         keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per piece: ``id``, ``piece``, ``start``, ``length``, ``crc``, the columns ``keep`` of its document, ``sequence``, ``offset``.

    A document is its token ids and ``end_id``; one longer than ``limit`` is cut so that all but its first piece are
    full. Null and empty texts are the end token alone. Repeated rows are packed each; an empty table has no pieces.
    """
    small_batches(docs.sparkSession)
    rows = written(pieces(docs, path, key, text, limit, end_id, keep).withColumn("row", F.monotonically_increasing_id()), "pieces")
    counts = np.zeros(limit + 1, np.int64)
    for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():  # at most ``limit`` rows
        counts[r["length"]] = r["n"]
    sent = docs.sparkSession.sparkContext.broadcast(make_plan(counts, limit))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = sent.value.place(batch.column("length").to_numpy(), batch.column("number").to_numpy())
            columns = [*batch.columns[:-1], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "sequence", "offset"])

    placed = numbered(rows, "length", counts.tolist(), ["row"], "number", cell_rows).select("id", "piece", "start", "length", "crc", *keep, "number")
    shape = T.StructType(placed.schema.fields[:-1]).add("sequence", "long").add("offset", "long")
    return placed.mapInArrow(run, shape)
