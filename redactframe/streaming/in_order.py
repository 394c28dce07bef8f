"""Rows of a key judged in event order, whatever batch brought them and in whatever order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Event time that is judged at once, in milliseconds: memory holds the rows of a key in one slice, and blocks that overlap it.
SLICE_MS = 60_000
#: Rows of one entry of the state, at most. An entry costs a call to the state store, whatever it holds.
BLOCK_ROWS = 4_096
#: Output rows of one frame, about.
FRAME_ROWS = 10_000


class InOrder(StatefulProcessor):
    """Keeps the rows of a key in state until the watermark has passed their slice of event time, then judges slice by slice.

    Input rows: ``ts_ms``, ``event_id``, ``code``, all long; they are judged by (ts_ms, event_id). A row goes to state as it
    comes, in blocks of any slices, so a batch is never held whole; a judgement reads the blocks whose first slice is due. A key has one timer, at the end of its first
    waiting slice or of the slice that holds its deadline. Rows behind the watermark are late: Spark drops them before they get here.

    A subclass declares its own state in ``open``, reads it in ``load``, writes it in ``save``, and gives output rows from ``judge``
    (one event) and ``settle`` (no event before that time is still to come). ``deadline`` is when it wants to settle next.
    """

    columns: list[str]
    nullable: dict[str, str] = {}

    def __init__(self, slice_ms: int = SLICE_MS):
        self.slice = slice_ms

    def open(self, handle: StatefulProcessorHandle) -> None: ...
    def load(self) -> None: ...
    def save(self) -> None: ...

    def judge(self, ts: int, event: int, code: int) -> Iterator[tuple]:
        raise NotImplementedError

    def settle(self, before: int) -> Iterator[tuple]:
        return iter(())

    def deadline(self) -> int | None:
        return None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.blocks = handle.getMapState("blocks", "first long, part long", "body binary")
        self.wake = handle.getValueState("wake", "at_ms long, part long")
        self.open(handle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        at, part = self.wake.get() if self.wake.exists() else (None, 0)
        due = at
        for frame in rows:
            if not len(frame):
                continue
            body = np.column_stack([frame[c].to_numpy(np.int64) for c in ("ts_ms", "event_id", "code")])
            body = body[np.argsort(body[:, 0], kind="stable")]
            for start in range(0, len(body), BLOCK_ROWS):
                own = body[start:start + BLOCK_ROWS]
                self.blocks.updateValue((int(own[0, 0]) // self.slice, part), (own.tobytes(),))
                part += 1
            end = (int(body[0, 0]) // self.slice + 1) * self.slice
            due = end if due is None else min(due, end)
        if due is not None:
            self._wake_at(at, due, part)
        return iter(())

    def _wake_at(self, now: int | None, at: int, part: int) -> None:
        """Moves the timer from ``now`` to ``at``; ``part`` is the number of the next block."""
        if at != now:
            if now is not None:
                self.handle.deleteTimer(now)
            self.handle.registerTimer(at)
        self.wake.update((at, part))

    def _whole(self, limit: int) -> Iterator[np.ndarray]:
        """The rows of the slices below ``limit`` in order, a slice or more at a time; they leave the state.

        Of equal instants and ids the larger code is first. A block is read when its first slice is due; what
        it holds of later slices waits in memory, and goes back to state if its slice is not whole yet.
        """
        due = sorted(k for k in self.blocks.keys() if k[0] < limit)
        held = np.empty((0, 3), np.int64)
        for i, name in enumerate(due):
            own = np.frombuffer(self.blocks.getValue(name)[0], np.int64).reshape(-1, 3)
            held = np.concatenate([held, own])
            self.blocks.removeKey(name)
            ready = min(limit, due[i + 1][0] if i + 1 < len(due) else limit)  # no later block has rows below
            below = held[:, 0] // self.slice < ready
            if below.any():
                out, held = held[below], held[~below]
                yield out[np.lexsort((-out[:, 2], out[:, 1], out[:, 0]))]
        if len(held):
            part = self.wake.get()[1]
            held = held[np.argsort(held[:, 0], kind="stable")]
            for start in range(0, len(held), BLOCK_ROWS):
                own = held[start:start + BLOCK_ROWS]
                self.blocks.updateValue((int(own[0, 0]) // self.slice, part), (own.tobytes(),))
                part += 1
            self.wake.update((self.wake.get()[0], part))

    def _results(self, limit: int) -> Iterator[tuple]:
        for body in self._whole(limit):
            for ts, event, code in body.tolist():
                yield from self.judge(ts, event, code)
        yield from self.settle(limit * self.slice)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        limit = timerValues.getCurrentWatermarkInMs() // self.slice  # slices below this one are whole
        self.load()
        held = []
        for row in self._results(limit):
            held.append((key[0], *row))
            if len(held) >= FRAME_ROWS:
                yield self._frame(held)
                held = []
        self.save()
        waiting = [k[0] for k in self.blocks.keys()] + ([self.deadline() // self.slice] if self.deadline() is not None else [])
        part = self.wake.get()[1]
        self.wake.clear()
        if waiting:
            self._wake_at(None, (min(waiting) + 1) * self.slice, part)
        if held:
            yield self._frame(held)

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["key", *self.columns]).astype(self.nullable)

    def close(self) -> None:
        pass


def in_order(log: DataFrame, key: str, ts: str, watermark: str, processor: InOrder, result: str) -> DataFrame:
    """``log`` (key, event_id, code and the event time ``ts``) through a processor; ``result`` is the DDL of its columns.

    The key comes out as ``key``. Rows without an event time or an id have no place in the order and are left out.
    """
    kind = log.schema[key].dataType.simpleString()
    rows = log.where(F.col(ts).isNotNull() & F.col("event_id").isNotNull()).withWatermark(ts, watermark).select(
        key, ts, F.unix_millis(ts).alias("ts_ms"), F.col("event_id").cast("long").alias("event_id"), F.col("code").cast("long").alias("code"))
    return rows.groupBy(key).transformWithStateInPandas(processor, f"key {kind}, {result}", "Append", "EventTime")
