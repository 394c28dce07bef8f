"""Hashed character n-grams of whole texts, as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np

from redactframe.llm import blocks as B

_PLANE = 0x10000


@cache
def _letters() -> np.ndarray:
    """Lower-case letter of every code point of the first plane, a blank where it is no letter."""
    out = np.full(_PLANE, 0x20, np.uint32)
    for c in range(_PLANE):
        if (s := chr(c)).isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 and ord(low) < _PLANE else c
    return out


def decode(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes and n + 1 offsets in code points (malformed bytes give some code point, no error)."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    padded = np.concatenate((data, np.zeros(3, np.uint8)))
    first = padded[lead].astype(np.uint32)
    out = first.copy()
    wide = np.flatnonzero(first >= 0x80)
    if len(wide):
        at, b0 = lead[wide], first[wide]
        b1, b2, b3 = (padded[at + k].astype(np.uint32) & 0x3F for k in (1, 2, 3))
        two, three = (b0 & 0x1F) << 6 | b1, (b0 & 0x0F) << 12 | b1 << 6 | b2
        out[wide] = np.where(b0 < 0xE0, two, np.where(b0 < 0xF0, three, (b0 & 0x07) << 18 | b1 << 12 | b2 << 6 | b3))
    return out, np.searchsorted(lead, offsets)


def letters_only(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters with single blanks for all else, and one blank before and after each text."""
    low = np.where(points < _PLANE, _letters()[np.minimum(points, _PLANE - 1)], points)
    return pad(low, offsets, low == 0x20)


def pad(points: np.ndarray, offsets: np.ndarray, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of blanks become one, and each text gets one before and one after it."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    at = np.arange(len(points)) + np.repeat(2 * np.arange(n) + 1, sizes)
    out = np.full(len(points) + 2 * n, 0x20, np.uint32)
    out[at] = np.where(blank, 0x20, points)
    bounds = offsets + 2 * np.arange(n + 1)
    space = out == 0x20
    keep = np.ones(len(out), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    keep[bounds[:-1]] = True  # the first blank of each text stays, though the text before ends with one
    total = np.concatenate(([0], np.cumsum(keep)))
    return out[keep], total[bounds]


def hashed(points: np.ndarray, bounds: np.ndarray, orders: tuple[int, ...], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the bucket of every n-gram within a text, and each text's first n-gram."""
    points = points.astype(np.uint32)
    for n in orders:
        if len(points) < n:
            yield np.zeros(0, np.intp), np.zeros(len(bounds), np.int64)
            continue
        h = np.full(len(points) - n + 1, n * 0x9E3779B1 % 2**32, np.uint32)
        for k in range(n):
            h = (h ^ points[k:len(points) - n + 1 + k]) * np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
        h = (h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - int(buckets).bit_length() + 1)
        sizes = np.maximum(np.diff(bounds) - n + 1, 0)
        starts = np.concatenate(([0], np.cumsum(sizes)))
        inside = np.ones(len(h), bool)
        if n > 1:  # n-grams that reach over a text's end
            for k in range(1, n):
                ends = bounds[1:] - k
                ends = ends[(ends >= bounds[:-1]) & (ends < len(h))]
                inside[ends] = False
        yield h[inside].astype(np.intp), starts


def text_grams(block: B.Block, orders: tuple[int, ...], buckets: int) -> list[tuple[np.ndarray, np.ndarray]]:
    points, bounds = letters_only(*decode(block.data, block.offsets))
    return list(hashed(points, bounds, orders, buckets))


def segment_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of rows of ``values`` by text; texts without rows get 0."""
    out = np.zeros((len(starts) - 1, *values.shape[1:]), np.float64)
    full = np.flatnonzero(np.diff(starts))
    if len(full):
        out[full] = np.add.reduceat(values, starts[:-1][full], axis=0)
    return out
