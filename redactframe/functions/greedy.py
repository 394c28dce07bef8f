"""Greedy spacing: accept an event when at least ``interval`` passed since the last accepted one.

The rule looks sequential over a whole key. Two facts make it spread out:

* an event at least ``interval`` after its *predecessor* is always accepted, so such
  events cut a key into independent runs;
* inside a run, acceptance is the orbit of the first event under "first event at least
  ``interval`` later", which pointer doubling finds in log(run length) rounds.

Runs up to a checked size are folded in place; longer runs (a key that never pauses) are
walked in blocks of that size and joined up by pointer doubling over the block entries, so no
run is ever gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactframe.functions.ordered import islands, running_totals, with_next_match, with_previous
from redactframe.session import cut_lineage

MAX_FOLD = 1000
SEGMENT_MS = 86_400_000


def greedy_accept(
    df: DataFrame, keys: list[str], ts: str, event: str, interval: int, segment: int = SEGMENT_MS, max_fold: int = MAX_FOLD
) -> DataFrame:
    """Rows of df plus ``accepted`` (boolean) and ``last_accepted`` (ts that decided, null on the first).

    ``ts`` and ``event`` are long columns; ``event`` is unique per key and breaks ties.
    ``segment`` is the width of the cuts in units of ``ts`` (see functions.ordered).
    """
    slim = df.select(*keys, F.col(ts).alias("__ts"), F.col(event).alias("__ev"))
    order = ["__ts", "__ev"]
    timed = slim.withColumn("__seg_by", F.floor(F.col("__ts") / segment))
    prev = with_previous(timed, keys, order, ["__ts"], F.col("__seg_by"))
    opens = F.col("prev___ts").isNull() | (F.col("__ts") - F.col("prev___ts") >= interval)
    run = islands(prev, keys, order, opens, "__run", F.col("__seg_by"))
    run = cut_lineage(run.select(*keys, "__ts", "__ev", "__seg_by", "__run"))
    sizes = run.groupBy(*keys, "__run").agg(F.count("*").alias("__n"))
    runs = run.join(sizes, [*keys, "__run"])

    single = runs.filter("__n = 1").select(*keys, "__ev", "__ts")
    short = runs.filter(f"__n BETWEEN 2 AND {max_fold}")
    folded = short.groupBy(*keys, "__run").agg(F.sort_array(F.collect_list(F.struct("__ts", "__ev"))).alias("__all"))
    empty = F.array().cast("array<struct<__ts:bigint,__ev:bigint>>")
    init = F.struct(F.lit(None).cast("long").alias("last"), empty.alias("kept"))

    def step(acc, e):
        ok = acc["last"].isNull() | (e["__ts"] - acc["last"] >= interval)
        return F.struct(
            F.when(ok, e["__ts"]).otherwise(acc["last"]).alias("last"),
            F.when(ok, F.concat(acc["kept"], F.array(e))).otherwise(acc["kept"]).alias("kept"),
        )

    kept = folded.select(*keys, F.explode(F.aggregate("__all", init, step, lambda a: a["kept"])).alias("__hit")).select(
        *keys, F.col("__hit.__ev").alias("__ev"), F.col("__hit.__ts").alias("__ts"))
    accepted = single.unionByName(kept)
    long_runs = runs.filter(f"__n > {max_fold}")
    if not long_runs.isEmpty():
        accepted = accepted.unionByName(_orbit(long_runs, keys, interval, segment, max_fold))

    flags = accepted.select(*keys, F.col("__ev").alias(event), F.lit(True).alias("accepted"))
    marked = df.join(flags, [*keys, event], "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)))
    # the latest accepted instant at or before each row: runs are cut by segment like everything else
    at = marked.select(*keys, F.col(ts).alias("__ts"), F.col(event).alias("__ev"), "accepted").withColumn(
        "__seg_by", F.floor(F.col("__ts") / segment))
    last = _last_accepted(at, keys)
    return marked.join(last.select(*keys, F.col("__ev").alias(event), "last_accepted"), [*keys, event])


def _last_accepted(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Max accepted ts strictly before each row, across segments."""
    marked = rows.withColumn("__acc", F.when(F.col("accepted"), F.col("__ts")))
    back = marked.withColumn("__neg", -F.col("__ts")).withColumn("__negev", -F.col("__ev"))
    return with_next_match(
        back, keys, ["__neg", "__negev"], F.col("__acc"), "last_accepted", -F.col("__seg_by")
    ).drop("__neg", "__negev", "__acc")


def _orbit(rows: DataFrame, keys: list[str], interval: int, segment: int, block: int) -> DataFrame:
    """Accepted events of long runs.

    A run is cut into blocks of ``block`` events. The only thing a block needs to know is the
    event at which the orbit enters it, and the candidates are the events that some jump from an
    earlier block lands on. Each block walks its few candidates in place, which leaves a graph of
    entry events only; pointer doubling finds the entries the run really visits, and
    those blocks then list their accepted events. Every round is a reliable checkpoint.
    """
    ids = [*keys, "__run"]
    in_block = [*ids, "__blk"]
    counted = running_totals(
        rows.withColumn("__one", F.lit(1)), ids, ["__ts", "__ev"], {"__idx": "__one"}, F.col("__seg_by"))
    numbered = cut_lineage(counted.select(*ids, F.floor((F.col("__idx") - 1) / block).alias("__blk"), "__ts", "__ev"))

    events = numbered.withColumn("__kind", F.lit(1))
    probes = numbered.withColumn("__ts", F.col("__ts") + interval).withColumn("__kind", F.lit(0))
    target = F.when(F.col("__kind") == 1, F.struct(F.col("__ev").alias("ev"), F.col("__blk").alias("blk")))
    jump = cut_lineage(
        with_next_match(
            events.unionByName(probes), ids, ["__ts", "__kind", "__ev"], target, "__to", F.floor(F.col("__ts") / segment))
        .filter("__kind = 0 AND __to IS NOT NULL")
        .select(*ids, "__blk", F.col("__ev").alias("__from"), F.col("__to.ev").alias("__to"), F.col("__to.blk").alias("__to_blk"))
    )
    heads = numbered.groupBy(*ids).agg(F.min_by(F.struct("__blk", "__ev"), F.struct("__ts", "__ev")).alias("h")).select(
        *ids, "h.__blk", "h.__ev")
    landed = jump.filter("__blk <> __to_blk").select(*ids, F.col("__to_blk").alias("__blk"), F.col("__to").alias("__ev"))
    entries = landed.unionByName(heads).distinct()
    # at most ``block`` events and entries per group
    blocks = numbered.groupBy(*in_block).agg(F.sort_array(F.collect_list(F.struct("__ts", "__ev"))).alias("__all"))
    doors = entries.groupBy(*in_block).agg(F.collect_list("__ev").alias("__doors"))
    walked = blocks.join(doors, in_block)

    def next_last(last, e, door):
        """(ts, ev) of the last accepted event after seeing e; null until the door is reached."""
        start = last.isNull() & (e["__ev"] == door)
        go = last.isNotNull() & (e["__ts"] - last["__ts"] >= interval)
        return start | F.coalesce(go, F.lit(False))

    nothing = F.lit(None).cast("struct<__ts:bigint,__ev:bigint>")
    leave = lambda door: F.aggregate("__all", nothing, lambda last, e: F.when(next_last(last, e, door), e).otherwise(last))["__ev"]
    exits = walked.select(*ids, F.explode(F.transform("__doors", lambda d: F.struct(d.alias("door"), leave(d).alias("exit")))).alias("w")).select(
        *ids, F.col("w.door").alias("__door"), F.col("w.exit").alias("__from"))
    hop = cut_lineage(exits.join(jump, [*ids, "__from"]).select(*ids, F.col("__door").alias("__from"), "__to"))

    reached = cut_lineage(heads.select(*ids, "__ev"))
    n = reached.count()
    while True:
        step = reached.join(hop.withColumnRenamed("__from", "__ev"), [*ids, "__ev"]).select(*ids, F.col("__to").alias("__ev"))
        reached = cut_lineage(reached.unionByName(step).distinct())
        grown = reached.count()
        if grown == n:
            break
        n = grown
        first = hop.withColumnRenamed("__to", "__mid")
        second = hop.withColumnRenamed("__from", "__mid")
        hop = cut_lineage(first.join(second, [*ids, "__mid"]).select(*ids, "__from", "__to"))

    none = F.array().cast("array<struct<__ts:bigint,__ev:bigint>>")
    init = F.struct(nothing.alias("last"), none.alias("kept"))

    def collect(acc, e):
        take = next_last(acc["last"], e, F.col("__ev"))
        return F.struct(F.when(take, e).otherwise(acc["last"]).alias("last"),
                        F.when(take, F.concat(acc["kept"], F.array(e))).otherwise(acc["kept"]).alias("kept"))

    visited = reached.join(entries, [*ids, "__ev"]).join(blocks, in_block)
    return visited.select(*keys, F.explode(F.aggregate("__all", init, collect, lambda acc: acc["kept"])).alias("__hit")).select(
        *keys, F.col("__hit.__ev").alias("__ev"), F.col("__hit.__ts").alias("__ts"))
