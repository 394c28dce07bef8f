"""Custom stateful stream operators: rate limit, risk badge, approvals, epoch fence, bounded memory.

Rate limit, risk badge and approvals judge rows in event order once the watermark has passed them (``in_order``). The epoch
fence and the memory need no order of arrival; they take batches as they come.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from redactframe import rules
from redactframe.streaming.in_order import SLICE_MS, InOrder, in_order


class RateLimiter(InOrder):
    """At most one accepted call per interval and key; state is the last accepted instant."""

    columns = ["event_id", "ts_ms", "accepted", "retry_after_ms"]
    nullable = {"retry_after_ms": "Int64"}

    def __init__(self, interval_ms: int, slice_ms: int = SLICE_MS):
        super().__init__(slice_ms)
        self.interval = interval_ms

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("last", "last_ms long")

    def load(self) -> None:
        self.last = self.state.get()[0] if self.state.exists() else None

    def save(self) -> None:
        if self.last is not None:
            self.state.update((self.last,))

    def judge(self, ts: int, event: int, code: int) -> Iterator[tuple]:
        ok = self.last is None or ts - self.last >= self.interval
        yield event, ts, ok, None if ok else self.interval - (ts - self.last)
        self.last = ts if ok else self.last


#: Codes of the rows of ``RiskBadge`` and ``Approvals``.
VISIT, LOAD, CLOSE = 0, 1, 2
PENDING, DECISION = 0, 1


class RiskBadge(InOrder):
    """Debounced refresh with a cache.

    A load always asks for a refresh after its quiet time and never reads the cache; a visit is answered from a fresh
    report, else it asks for one after its own, shorter quiet time; a later request replaces a waiting one. A close
    forgets the key.
    """

    columns = ["ts_ms", "kind"]

    def __init__(self, ttl_ms: int, visit_quiet_ms: int, load_quiet_ms: int, slice_ms: int = SLICE_MS):
        super().__init__(slice_ms)
        self.ttl, self.visit_quiet, self.load_quiet = ttl_ms, visit_quiet_ms, load_quiet_ms

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("badge", "report_ms long, due_ms long")

    def load(self) -> None:
        self.report, self.due = self.state.get() if self.state.exists() else (None, None)

    def save(self) -> None:
        if self.report is None and self.due is None:
            self.state.clear()
        else:
            self.state.update((self.report, self.due))

    def judge(self, ts: int, event: int, code: int) -> Iterator[tuple]:
        yield from self.settle(ts + 1)
        if code == CLOSE:
            self.report, self.due = None, None
        elif code == LOAD:
            self.due = ts + self.load_quiet
        elif self.report is not None and ts - self.report < self.ttl:
            yield ts, "cached"
        else:
            self.due = ts + self.visit_quiet

    def settle(self, before: int) -> Iterator[tuple]:
        if self.due is not None and self.due < before:
            yield self.due, "refresh"
            self.report, self.due = self.due, None

    def deadline(self) -> int | None:
        return self.due


class Approvals(InOrder):
    """Open actions wait in state; the first decision after them settles all of them, and a deadline those without one."""

    columns = ["pending_id", "pending_ms", "decision_id", "decision_ms", "approved"]
    nullable = {"decision_id": "Int64", "decision_ms": "Int64"}

    def __init__(self, timeout_ms: int, slice_ms: int = SLICE_MS):
        super().__init__(slice_ms)
        self.timeout = timeout_ms

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getListState("pending", "ts_ms long, event_id long")

    def load(self) -> None:
        self.waiting = deque(tuple(x) for x in self.state.get()) if self.state.exists() else deque()

    def save(self) -> None:
        if self.waiting:
            self.state.put(list(self.waiting))
        else:
            self.state.clear()

    def judge(self, ts: int, event: int, code: int) -> Iterator[tuple]:
        yield from self.settle(ts)
        if code == PENDING:
            self.waiting.append((ts, event))
        else:
            while self.waiting:
                asked, pending = self.waiting.popleft()
                yield pending, asked, event, ts, True

    def settle(self, before: int) -> Iterator[tuple]:
        while self.waiting and self.waiting[0][0] + self.timeout < before:
            asked, pending = self.waiting.popleft()
            yield pending, asked, None, None, False

    def deadline(self) -> int | None:
        return self.waiting[0][0] + self.timeout if self.waiting else None


#: Groups of keys of the epoch fence. Each group of a batch costs some calls to the state, each key did before.
FENCE_GROUPS = 1024


class EpochFence(StatefulProcessor):
    """Releases rows of the newest epoch of a key; state is that epoch of each key of a group, in one value.

    A newer epoch takes back all that the one before released, by one row without scan and payload. Rows without a key are group -1.
    """

    def __init__(self, kind: str):
        self.kind = kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("newest", f"tabs array<{self.kind}>, epochs array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest = dict(zip(*self.state.get(), strict=True)) if self.state.exists() else {}
        changed = False
        for part in rows:
            part = part[part["epoch"].notna()]
            tabs = part["tab_id"].tolist() if key[0] >= 0 else [None] * len(part)
            epochs = part["epoch"].astype("int64").tolist()
            top: dict = {}
            for tab, epoch in zip(tabs, epochs, strict=True):
                if epoch > top.get(tab, epoch - 1):
                    top[tab] = epoch
            risen = {tab: epoch for tab, epoch in top.items() if tab not in newest or epoch > newest[tab]}
            back = [(tab, None, newest[tab], None, "retract") for tab in risen if tab in newest]
            newest |= risen
            changed |= bool(risen)
            if back:
                yield pd.DataFrame(back, columns=["key", "scan_id", "epoch", "payload", "op"])
            held = [newest[tab] == epoch for tab, epoch in zip(tabs, epochs, strict=True)]
            if any(held):
                current = part[held]
                names = [tab for tab, own in zip(tabs, held, strict=True) if own]
                yield pd.DataFrame({"key": names, "scan_id": current["scan_id"].to_numpy(), "epoch": current["epoch"].astype("int64").to_numpy(),
                                    "payload": current["payload"].to_numpy(), "op": "release"})
        if changed:
            self.state.update((list(newest), list(newest.values())))

    def close(self) -> None:
        pass


class BoundedMemory(StatefulProcessor):
    """The newest messages of a key; every batch emits the memory it leaves behind."""

    def __init__(self, turns: int = rules.MEMORY_TURNS, chars: int = rules.MEMORY_CHARS):
        self.turns, self.chars = turns, chars

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.memory = handle.getListState("memory", "turn long, role string, text string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = list(self.memory.get()) if self.memory.exists() else []
        for part in rows:
            fresh = [
                (int(t), r, x[: self.chars] if r == "assistant" else x)
                for t, r, x in zip(part["turn"], part["role"], part["text"])
            ]
            held = sorted([*held, *fresh])[-self.turns :]
        self.memory.put([tuple(h) for h in held])
        yield pd.DataFrame([(key[0], *h) for h in held], columns=["key", "turn", "role", "text"])

    def close(self) -> None:
        pass


def rate_limit_stream(calls: DataFrame, key: str, ts: str, watermark: str, interval_ms: int = rules.RATE_LIMIT_MS, slice_ms: int = SLICE_MS) -> DataFrame:
    """``calls``: key, event_id and the event-time column ``ts``."""
    return in_order(calls.withColumn("code", F.lit(0)), key, ts, watermark, RateLimiter(interval_ms, slice_ms),
                    "event_id long, ts_ms long, accepted boolean, retry_after_ms long")


def risk_badge_stream(
    visits: DataFrame, key: str, ts: str, watermark: str, ttl_ms: int, visit_quiet_ms: int, load_quiet_ms: int, slice_ms: int = SLICE_MS
) -> DataFrame:
    """``visits``: key, event_id, kind (load, close or any other, a visit) and the event-time column ``ts``."""
    code = F.when(F.col("kind") == "close", CLOSE).when(F.col("kind") == "load", LOAD).otherwise(VISIT)
    return in_order(visits.withColumn("code", code), key, ts, watermark, RiskBadge(ttl_ms, visit_quiet_ms, load_quiet_ms, slice_ms), "ts_ms long, kind string")


def approvals_stream(pending: DataFrame, decisions: DataFrame, key: str, timeout_ms: int, watermark: str, slice_ms: int = SLICE_MS) -> DataFrame:
    """Pending actions, each with the first decision made after it and within the timeout.

    ``pending``: key, pending_id, pending_ts. ``decisions``: key, decision_id, decision_ts; at equal times a decision
    with a larger id comes after. Both sides go to one keyed state that holds open actions only, so no action meets more than one
    decision. One without a decision in time comes out with null decision columns once the watermark has passed its
    limit. The watermark is that of both sides together: it must allow for the lag of the slower side.
    """
    both = pending.select(key, F.col("pending_ts").alias("ts"), F.col("pending_id").alias("event_id"), F.lit(PENDING).alias("code")).unionByName(
        decisions.select(key, F.col("decision_ts").alias("ts"), F.col("decision_id").alias("event_id"), F.lit(DECISION).alias("code")))
    out = in_order(both, key, "ts", watermark, Approvals(timeout_ms, slice_ms),
                   "pending_id long, pending_ms long, decision_id long, decision_ms long, approved boolean")
    return out.select(F.col("key").alias(key), "pending_id", F.timestamp_millis("pending_ms").alias("pending_ts"),
                      "decision_id", F.timestamp_millis("decision_ms").alias("decision_ts"), "approved")


def epoch_stream(scans: DataFrame) -> DataFrame:
    """``scans``: tab_id, scan_id, epoch, payload. A ledger of rows with ``op`` release, and retract for an epoch that a newer one replaces.

    Rows without an epoch are never released.
    """
    kind = {c: scans.schema[c].dataType.simpleString() for c in ("tab_id", "scan_id", "payload")}
    group = F.when(F.col("tab_id").isNull(), -1).otherwise(F.pmod(F.xxhash64("tab_id"), F.lit(FENCE_GROUPS))).cast("int").alias("tabs")
    out = scans.select(group, "tab_id", "scan_id", "epoch", "payload").groupBy("tabs").transformWithStateInPandas(
        EpochFence(kind["tab_id"]), f"key {kind['tab_id']}, scan_id {kind['scan_id']}, epoch long, payload {kind['payload']}, op string", "Append", "None")
    return out.withColumnRenamed("key", "tab_id")


def still_released(ledger: DataFrame) -> DataFrame:
    """What of a ledger of ``epoch_stream`` has not been taken back."""
    back = ledger.where("op = 'retract'").select("tab_id", "epoch")
    return ledger.where("op = 'release'").drop("op").join(back, ["tab_id", "epoch"], "left_anti")


def memory_stream(turns: DataFrame, key: str) -> DataFrame:
    """``turns``: key, turn, role, text; use output mode update."""
    return turns.groupBy(key).transformWithStateInPandas(
        BoundedMemory(), "key long, turn long, role string, text string", "Update", "None")
