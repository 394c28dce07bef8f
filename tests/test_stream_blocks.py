"""State of the streams in event order: rows are kept in blocks, so its calls do not grow with the slices of a key."""

from __future__ import annotations

import random
from types import SimpleNamespace

import pandas as pd
import pytest

from redactframe.streaming import in_order
from redactframe.streaming.stateful import RateLimiter


class Store:
    """State and timers of one key in memory; counts the entries written."""

    def __init__(self):
        self.maps, self.values, self.timers, self.writes = {}, {}, set(), 0

    def getMapState(self, name, *_):
        data = self.maps.setdefault(name, {})

        def update(k, v):
            self.writes += 1
            data[k] = v

        return SimpleNamespace(getValue=data.__getitem__, containsKey=data.__contains__, updateValue=update,
                               removeKey=lambda k: data.pop(k), keys=lambda: iter(list(data)))

    def getValueState(self, name, *_):
        return SimpleNamespace(get=lambda: self.values[name], exists=lambda: name in self.values,
                               update=lambda v: self.values.__setitem__(name, v), clear=lambda: self.values.pop(name, None))

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


def judged(batches, watermarks, slice_ms):
    store, limiter = Store(), RateLimiter(2000, slice_ms)
    limiter.init(store)
    out = []
    for rows, mark in zip(batches, watermarks, strict=True):
        if rows:
            list(limiter.handleInputRows((0,), iter([pd.DataFrame(rows, columns=["ts_ms", "event_id", "code"])]), None))
        while store.timers and min(store.timers) <= mark:
            store.timers.discard(min(store.timers))
            now = SimpleNamespace(getCurrentWatermarkInMs=lambda mark=mark: mark)
            for frame in limiter.handleExpiredTimer((0,), now, None):
                out += list(frame[["event_id", "ts_ms", "accepted"]].itertuples(index=False, name=None))
    assert not store.maps["blocks"]
    return out, store.writes


def in_turn(rows):
    last, out = None, []
    for ts, event, _ in sorted(rows):
        ok = last is None or ts - last >= 2000
        out.append((event, ts, ok))
        last = ts if ok else last
    return out


@pytest.mark.parametrize("block", [3, 4096])
@pytest.mark.parametrize("slice_ms", [1, 500, 10_000])
def test_overlapping_blocks_are_judged_in_order(monkeypatch, block, slice_ms):
    monkeypatch.setattr(in_order, "BLOCK_ROWS", block)
    for seed in range(20):
        rng = random.Random(seed)
        batches, marks, done = [], [], 0
        for _ in range(6):
            batches.append([(rng.randint(done, done + 12_000), rng.randrange(10**9), 0) for _ in range(rng.randrange(40))])
            done += rng.choice([0, 900, 6_000])
            marks.append(done)
        got, _ = judged([*batches, []], [*marks, 10**9], slice_ms)
        assert got == in_turn([r for b in batches for r in b])


def test_entries_do_not_grow_with_slices():
    rows = [(i * 60_000, i, 0) for i in range(3_000)]
    got, writes = judged([rows, []], [0, 10**12], 60_000)
    assert len(got) == 3_000
    assert writes <= 2
