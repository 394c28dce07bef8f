"""Streams that judge rows in event order: shuffled rows over several batches give what the whole log in order gives."""

import random

import pytest
from pyspark.sql import functions as F

from redactframe.streaming import stateful, streams

LOG = "key long, event_id long, ts_ms long, kind string"
FAR = 4_000_000_000_000


def log_of(seed, n, steps, kinds):
    rng, t, out = random.Random(seed), 1_000_000, []
    for i in range(n):
        t += rng.choice(steps)
        out.append((rng.randint(0, 2), i, t, rng.choice(kinds)))
    return out


def run(spark, folder, log, build, batches=4):
    """``build`` gets a stream of the shuffled log, a file a batch, then one far row that moves the watermark on."""
    src = f"{folder}/in"
    mixed = random.Random(1).sample(log, len(log))
    for part in [mixed[i::batches] for i in range(batches)] + [[(-1, -1, FAR, "none")]]:
        spark.createDataFrame(part, LOG).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(src).withColumn("ts", F.timestamp_millis("ts_ms"))
    with streams.state_provider(spark):
        return [tuple(r) for r in streams.drive(build(stream), f"{folder}/work").collect() if r[0] != -1]


def limited(log, interval):
    last, out = {}, []
    for key, event, ts, _ in sorted(log, key=lambda r: (r[2], r[1])):
        ok = key not in last or ts - last[key] >= interval
        out.append((key, event, ts, ok, None if ok else interval - (ts - last[key])))
        if ok:
            last[key] = ts
    return out


def by_text(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("slice_ms", [1, 7_000, 10**9])
def test_rate_limit_of_shuffled_batches(spark, tmp_path, slice_ms):
    log = log_of(3, 150, [0, 200, 900, 4000], ["call"])
    got = run(spark, tmp_path, log, lambda s: stateful.rate_limit_stream(s, "key", "ts", "1 hour", 2000, slice_ms))
    assert by_text(got) == by_text(limited(log, 2000))


def test_late_rows_are_not_judged(spark, tmp_path):
    src = str(tmp_path / "in")
    late = (0, 9, 100_000, "call")
    for part in ([(0, 1, 50_000, "call"), (0, 2, 900_000, "call")], [(0, 3, 950_000, "call")], [late, (0, 4, 951_000, "call")], [(-1, -1, FAR, "call")]):
        spark.createDataFrame(part, LOG).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(src).withColumn("ts", F.timestamp_millis("ts_ms"))
    with streams.state_provider(spark):
        out = streams.drive(stateful.rate_limit_stream(stream, "key", "ts", "1 second", 2000, 1000), str(tmp_path / "work"))
    assert sorted((r["event_id"], r["accepted"]) for r in out.collect() if r["key"] == 0) == [(1, True), (2, True), (3, True), (4, False)]


def badges(log, ttl, visit, load):
    out = []
    for key in {r[0] for r in log}:
        report = due = None
        for _, _, ts, kind in sorted((r for r in log if r[0] == key), key=lambda r: (r[2], r[1])):
            if due is not None and due <= ts:
                out.append((key, due, "refresh"))
                report, due = due, None
            if kind == "close":
                report = due = None
            elif kind == "load":
                due = ts + load
            elif report is not None and ts - report < ttl:
                out.append((key, ts, "cached"))
            else:
                due = ts + visit
        if due is not None:
            out.append((key, due, "refresh"))
    return out


@pytest.mark.parametrize("slice_ms", [1000, 600_000])
def test_risk_badge_of_shuffled_batches(spark, tmp_path, slice_ms):
    log = log_of(4, 200, [0, 5_000, 40_000, 90_000, 400_000], ["visit", "visit", "load", "close"])
    got = run(spark, tmp_path, log, lambda s: stateful.risk_badge_stream(s, "key", "ts", "1 day", 600_000, 120_000, 180_000, slice_ms))
    assert by_text(got) == by_text(badges(log, 600_000, 120_000, 180_000))


def decided(log, timeout):
    out = []
    for key, event, ts, kind in log:
        if kind == "ask":
            later = sorted((t, e) for k, e, t, x in log if k == key and x == "yes" and (t, e) > (ts, event) and t <= ts + timeout)
            t, e = later[0] if later else (None, None)
            out.append((key, event, ts, e, t, bool(later)))
    return out


def test_approvals_of_shuffled_batches(spark, tmp_path):
    log = log_of(5, 200, [0, 100, 1000, 9000], ["ask", "ask", "yes"])

    def build(s):
        asks = s.where("kind <> 'yes'").select("key", F.col("event_id").alias("pending_id"), F.col("ts").alias("pending_ts"))
        yes = s.where("kind = 'yes'").select("key", F.col("event_id").alias("decision_id"), F.col("ts").alias("decision_ts"))
        out = stateful.approvals_stream(asks, yes, "key", 5000, "1 hour", 3000)
        return out.select("key", "pending_id", F.unix_millis("pending_ts").alias("p"), "decision_id", F.unix_millis("decision_ts").alias("d"), "approved")

    assert by_text(run(spark, tmp_path, log, build)) == by_text(decided(log, 5000))


def test_epoch_fence_takes_back_older_releases(spark, tmp_path):
    schema = "tab_id long, scan_id long, epoch long, payload string"
    batches = [[(1, 1, 0, "a"), (2, 2, 5, "b")], [(1, 3, 1, "c"), (1, 4, 0, "stale"), (2, 5, 5, None)], [(1, 6, 0, "stale"), (2, 7, None, "none"), (1, 8, 1, "d")]]
    for part in batches:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with streams.state_provider(spark):
        ledger = streams.drive(stateful.epoch_stream(stream), str(tmp_path / "work"))
    assert [(r["tab_id"], r["epoch"]) for r in ledger.where("op = 'retract'").collect()] == [(1, 0)]
    assert sorted(r["scan_id"] for r in ledger.where("op = 'release'").collect()) == [1, 2, 3, 5, 8]
    assert sorted(r["scan_id"] for r in stateful.still_released(ledger).collect()) == [2, 3, 5, 8]


def test_budget_state_ends_with_the_session(spark, tmp_path):
    schema = "key long, ts_ms long, n long"
    for part in ([(k, 1_000 * k, 1) for k in range(20)], [(0, 3_000, 2)], [(99, 10_000_000, 1)], [(99, 10_000_001, 1)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withColumn("ts", F.timestamp_millis("ts_ms"))
    totals = streams.budget_sessions(stream, "key", "ts", ["n"], "1 minute", "1 second")
    writer = totals.writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).format("parquet").option("path", str(tmp_path / "out"))
    query = writer.start()
    query.awaitTermination()
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(rows) >= 20 and rows[-1] == 1  # the open session of key 99
    got = {r["key"]: r["total_n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {0: 3, **{k: 1 for k in range(1, 20)}}


def test_one_key_with_very_many_rows(spark, tmp_path):
    """Rows of one key in one batch, far more than an Arrow batch holds."""
    n = 200_000
    spark.range(n).select(F.lit(0).cast("long").alias("key"), F.col("id").alias("event_id"), ((F.col("id") * 7919) % n * 10 + 10_000).alias("ts_ms"),
                          F.lit("call").alias("kind")).coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.createDataFrame([(-1, -1, FAR, "call")], LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(LOG).parquet(str(tmp_path / "in")).withColumn("ts", F.timestamp_millis("ts_ms"))
    with streams.state_provider(spark):
        out = streams.drive(stateful.rate_limit_stream(stream, "key", "ts", "1 second", 1000), str(tmp_path / "work"))
    got = out.where("key = 0").agg(F.count("*"), F.count_if("accepted"), F.max("retry_after_ms")).first()
    assert tuple(got) == (n, n // 100, 990)


def test_epoch_fence_calls_the_state_once_a_group():
    """Very many keys of one group: one read and one write of the state, rows without a key included."""
    import pandas as pd

    class Value:
        calls, held = 0, None

        def exists(self):
            return self.held is not None

        def get(self):
            self.calls += 1
            return self.held

        def update(self, value):
            self.calls += 1
            self.held = value

    fence = stateful.EpochFence("long")
    fence.state = Value()
    frame = lambda rows: pd.DataFrame(rows, columns=["tab_id", "scan_id", "epoch", "payload"])
    rows = [(t, 10 * t + e, e, "p") for t in range(3000) for e in (0, 1)]
    out = pd.concat(fence.handleInputRows((5,), iter([frame(rows)]), None))
    assert sorted(out["scan_id"]) == [10 * t + 1 for t in range(3000)] and set(out["op"]) == {"release"}
    out = pd.concat(fence.handleInputRows((5,), iter([frame([(7, 1, 2, "p"), (8, 2, 0, "p"), (9, 3, None, "p")])]), None))
    assert out[["key", "epoch", "op"]].values.tolist() == [[7, 1, "retract"], [7, 2, "release"]]
    assert fence.state.calls == 3
    fence.state = Value()
    assert pd.concat(fence.handleInputRows((-1,), iter([frame([(None, 1, 2, "p"), (None, 2, 1, "p")])]), None))["scan_id"].tolist() == [1]
