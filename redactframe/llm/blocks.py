"""Texts of an Arrow batch as one byte array, cut into blocks of bounded size.

The operators of this package work on UTF-8 bytes inside tasks. All character classes they need are
ASCII sets, so a byte test is exact: no byte of a longer code point is ASCII.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one numpy step holds at a time; a longer single text is a block of its own.
BLOCK_BYTES = 1 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95  # odd, so that it has an inverse modulo 2**64
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


@dataclass
class Block:
    """Texts ``row0`` to ``row0 + rows`` of a batch: their bytes, and where each begins."""

    row0: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1


def byte_set(pattern_bytes: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(pattern_bytes)] = True
    return table


#: White space of the word rules: a blank and the five controls from tab to carriage return.
SPACE = byte_set(b" \t\n\x0b\x0c\r")
NOT_SPACE = ~SPACE
#: Digits, lower-case ASCII letters, and every byte of a code point beyond ASCII.
ALNUM_OR_WIDE = byte_set(bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]))
_lower = np.arange(256, dtype=np.uint8)
_lower[0x41:0x5B] += 32
LOWER = _lower


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without a copy, and n + 1 offsets; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def blocks(column: pa.Array | pa.ChunkedArray, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    data, offsets = text_bytes(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield Block(first, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first])
        first = last


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run of true bytes, none across two texts; and each text's first run."""
    n = len(mask)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    edges = offsets[(offsets > 0) & (offsets < n)]
    before = np.zeros(n, bool)
    before[1:] = mask[:-1]
    before[edges] = False
    after = np.zeros(n, bool)
    after[:-1] = mask[1:]
    after[edges - 1] = False
    starts, ends = np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def owner(bounds: np.ndarray) -> np.ndarray:
    """Index of the text that each item belongs to, from each text's first item."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every line, split at newlines (an empty text is one empty line), and each text's first line."""
    breaks = np.flatnonzero(data == 10)
    per_text = np.diff(np.searchsorted(breaks, offsets)) + 1
    bounds = np.concatenate(([0], np.cumsum(per_text)))
    starts, ends = np.empty(bounds[-1], np.int64), np.empty(bounds[-1], np.int64)
    first = np.zeros(bounds[-1], bool)
    first[bounds[:-1]] = True
    starts[first], starts[~first] = offsets[:-1], breaks + 1
    last = np.zeros(bounds[-1], bool)
    last[bounds[1:] - 1] = True
    ends[last], ends[~last] = offsets[1:], breaks
    return starts, ends, bounds


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(which: str, base: int, n: int) -> np.ndarray:
    have = _powers[which]
    if len(have) < n:
        steps = np.full(n, base & (2**64 - 1), np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if n <= 2 * BLOCK_BYTES:  # keep the tables of ordinary blocks only
            _powers[which] = have
    return have[:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _BASE) -> np.ndarray:
    """64-bit hashes of byte spans of one array: differences of one running polynomial, then mixed.

    Equal bytes give equal values wherever they stand; different spans meet with a chance near 2**-64.
    """
    n = len(data) + 1
    key = str(base)
    _powers.setdefault(f"up{key}", np.ones(1, np.uint64))
    _powers.setdefault(f"down{key}", np.ones(1, np.uint64))
    up, down = _power(f"up{key}", base, n), _power(f"down{key}", pow(base, -1, 2**64), n)
    total = np.zeros(n, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _ODD)


def code_points(data: np.ndarray) -> np.ndarray:
    """Running count of code points: entry i counts those that begin before byte i."""
    total = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=total[1:])
    return total


def per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of items by text; texts without items get 0."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[bounds[1:]] - total[bounds[:-1]]


def gather(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The bytes (or items) of many spans, one after the other."""
    total = int(lengths.sum())
    if not total:
        return data[:0]
    shift = starts - np.concatenate(([0], np.cumsum(lengths)[:-1]))
    return data[np.arange(total) + np.repeat(shift, lengths)]
