"""Sharding by balanced label propagation.

A document's label is its shard. Documents that share a link key are neighbours; a link's members are counted per
shard, so a neighbourhood is at most one row a shard, whatever its size. In each round a document proposes to move to
the shard where most of its neighbours are (a link too large for one shard has as many target shards as it needs), and
the shards admit proposals by falling gain up to their capacity. Documents without neighbours wait and fill what is
left. At the end counts are made exact: each shard keeps its quota, and the rest goes into the open places, members
of one link next to each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redactframe.llm.store import written

#: Gains are compared by their logarithm; shares of a class are drawn in this many steps.
_STEPS = 1 << 20


def _literal(values: list[int]) -> Column:
    """A constant array; the optimizer folds it into one value."""
    return F.from_json(F.lit(str([int(v) for v in values])), "array<bigint>")


def numbered(rows: DataFrame, group: str, sizes: list[int], by: list[str], name: str, cell_rows: int) -> DataFrame:
    """Adds ``name``: 0, 1, 2, ... within each value 0 ... len(sizes) - 1 of ``group``, without a task per value.

    The first column of ``by`` is hashed to cells of about ``cell_rows`` rows, so rows that agree in it stay next to each
    other; within a cell rows are ordered by ``by``, whose last column is unique. ``sizes`` are the groups' row counts.
    """
    cells = F.get(_literal([max(1, -(-n // cell_rows)) for n in sizes]), F.col(group).cast("int"))
    dealt = rows.withColumn("__cell", F.pmod(F.xxhash64(F.lit("cell"), by[0]), cells))
    counts = dealt.groupBy(group, "__cell").agg(F.count(F.lit(1)).alias("__many"))
    before = F.sum("__many").over(Window.partitionBy(group).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(group, "__cell", F.coalesce(before, F.lit(0)).alias("__before"))
    inner = F.row_number().over(Window.partitionBy(group, "__cell").orderBy(*by)) - 1
    out = dealt.withColumn("__inner", inner).join(starts, [group, "__cell"])
    return out.withColumn(name, F.col("__before") + F.col("__inner")).drop("__cell", "__inner", "__before")


def _counts(rows: DataFrame, group: str, n: int) -> list[int]:
    """Rows per value 0 ... n - 1 of ``group``: n numbers on the driver."""
    found = {r[group]: r["n"] for r in rows.groupBy(group).agg(F.count(F.lit(1)).alias("n")).collect()}
    return [found.get(i, 0) for i in range(n)]


def propose(members: DataFrame, state: DataFrame, capacity: int) -> DataFrame:
    """``row``, ``shard``, ``goal``, ``party``, ``gain`` of each document that would have more neighbours in another shard."""
    placed = members.join(state, "row")
    votes = placed.groupBy("link", "shard").agg(F.count(F.lit(1)).alias("n"))
    # at most one entry a shard; the fullest shards first, as many as the link's size needs
    # equal counts are ranked by a hash, so that ties spread over all shards
    vote = F.struct((-F.col("n")).alias("n"), F.xxhash64("link", "shard").alias("tie"), "shard")
    tops = votes.groupBy("link").agg(F.sort_array(F.collect_list(vote)).alias("tops"), F.sum("n").alias("total"))
    # as a table of its own, so that adaptive execution can split a link with very many members in the join below
    tops = written(tops.withColumn("goals", F.slice("tops", F.lit(1), F.ceil(F.col("total") / capacity).cast("int"))), "votes")
    own = F.coalesce(-F.get(F.filter("tops", lambda t: t["shard"] == F.col("shard")), F.lit(0))["n"], F.lit(0)) - 1
    at_home = F.exists("goals", lambda t: t["shard"] == F.col("shard"))
    goal = F.when(at_home, F.get(F.filter("goals", lambda t: t["shard"] == F.col("shard")), F.lit(0))).otherwise(
        F.get("goals", F.pmod(F.xxhash64("row"), F.size("goals")).cast("int")))
    pulls = placed.join(tops, "link").withColumn("own", own).withColumn("goal", goal)
    there = -F.col("goal.n") - F.when(at_home, 1).otherwise(0)
    # up to 64 members of a link are admitted or turned away together
    party = F.xxhash64("link", F.pmod(F.xxhash64("row"), F.ceil(F.col("total") / 64)))
    pulls = pulls.select("row", "shard", F.col("goal.shard").alias("goal"), there.alias("there"), "own", at_home.alias("home"), party.alias("party"))
    by_goal = pulls.groupBy("row", "shard", "goal").agg(
        F.sum("there").alias("there"), F.sum("own").alias("own"), F.max("home").alias("home"), F.min("party").alias("party"))
    best = by_goal.groupBy("row", "shard").agg(
        F.max_by(F.struct("goal", "party"), F.struct("there", -F.col("goal"))).alias("goal"), F.max("there").alias("there"), F.sum("own").alias("own"),
        F.max("home").alias("home")).select("row", "shard", "goal.goal", "goal.party", "there", "own", "home")
    # a tie moves only a document that is in none of its links' shards, so that the others can stay
    gain = F.col("there") - F.col("own")
    return best.where((F.col("goal") != F.col("shard")) & ((gain > 0) | ((gain == 0) & ~F.col("home")))).select("row", "shard", "goal", "party", gain.alias("gain"))


def admit(moves: DataFrame, loads: list[int], capacity: int, round_: int) -> DataFrame:
    """The proposals that fit: per goal by falling gain, and a drawn share of the class that fits in part."""
    rank = F.least(F.floor(F.log2(F.col("gain") + 1)), F.lit(62)).cast("int")
    moves = moves.withColumn("rank", rank)
    asked: dict[tuple[int, int], int] = {}
    leaving = [0] * len(loads)
    for r in moves.groupBy("shard", "goal", "rank").agg(F.count(F.lit(1)).alias("n")).collect():  # shards squared x 63 numbers at most
        asked[r["goal"], r["rank"]] = asked.get((r["goal"], r["rank"]), 0) + r["n"]
        leaving[r["shard"]] += r["n"]
    share = [0] * (63 * len(loads))
    for goal, load in enumerate(loads):
        room = capacity - load + leaving[goal]
        for rank_ in range(62, -1, -1):
            n = asked.get((goal, rank_), 0)
            if n and room > 0:
                share[goal * 63 + rank_] = _STEPS * min(n, room) // n
                room -= n
    drawn = F.pmod(F.xxhash64(F.lit(round_), "party", "goal"), F.lit(_STEPS)) < F.get(_literal(share), F.col("goal") * 63 + F.col("rank"))
    return moves.where(drawn).select("row", "goal")


def propagate(members: DataFrame, state: DataFrame, shards: int, capacity: int, rounds: int) -> DataFrame:
    """Rounds of moves over linked documents; stops when nobody moves."""
    for round_ in range(rounds):
        moves = written(propose(members, state, capacity), "moves")
        taken = admit(moves, _counts(state, "shard", shards), capacity, round_)
        state = written(state.join(taken, "row", "left").select("row", F.coalesce("goal", "shard").alias("shard")), "labels")
        if moves.isEmpty():
            break
    return state


def assign(rows: DataFrame, members: DataFrame, shards: int = 40, rounds: int = 4, cell_rows: int = 256) -> DataFrame:
    """``row``, ``shard``, ``slot`` of every row: shard counts differ by one at most, slots are gapless from 0.

    ``rows`` has a unique ``row`` number; ``members`` has (row, link), a row may have several links. Links of one row do
    not count. Empty tables give an empty result.
    """
    total = rows.count()
    capacity = max(1, -(-total // shards))
    sizes = written(members.groupBy("link").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "links")
    members = written(members.join(sizes, "link"), "members")
    start = F.pmod(F.xxhash64(F.lit("start"), "row"), F.lit(shards)).cast("int")
    linked = members.select("row").distinct().withColumn("shard", start)
    state = propagate(members.select("row", "link"), written(linked, "labels"), shards, capacity, rounds)

    # members of a link stand together in every order below, a link larger than a cell in several parts
    lead = F.xxhash64("link", F.pmod(F.xxhash64("row"), F.ceil(F.col("size") / cell_rows)))
    order = members.groupBy("row").agg(F.min_by(lead, F.struct("size", "link")).alias("by"))
    held = written(state.join(order, "row"), "held")
    loads = _counts(held, "shard", shards)
    quota = [total // shards + (1 if i < total % shards else 0) for i in range(shards)]
    ranked = numbered(held, "shard", loads, ["by", "row"], "number", cell_rows)
    ranked = written(ranked.withColumn("stays", F.col("number") < F.get(_literal(quota), F.col("shard"))), "ranked")
    kept = _counts(ranked.where("stays"), "shard", shards)

    # whoever has no place yet, in lanes of counted size, takes the open places in order
    lanes = 1024
    free = rows.select("row").join(ranked.select("row", "stays", "by"), "row", "left").where("stays is null or not stays")
    free = free.select("row", F.coalesce("by", F.xxhash64("row")).alias("by")).withColumn("lane", F.pmod(F.xxhash64(F.lit("lane"), "by"), F.lit(lanes)).cast("int"))
    free = written(free, "free")
    in_lane = _counts(free, "lane", lanes)
    lane_starts = [sum(in_lane[:i]) for i in range(lanes)]
    open_ends = [sum(q - k for q, k in zip(quota[:i + 1], kept[:i + 1], strict=True)) for i in range(shards)]
    filled = numbered(free, "lane", in_lane, ["by", "row"], "number", cell_rows)
    filled = filled.withColumn("place", F.get(_literal(lane_starts), F.col("lane")) + F.col("number"))
    shard = F.size(F.filter(_literal(open_ends), lambda end: end <= F.col("place")))
    filled = filled.select("row", shard.alias("shard"))
    final = written(ranked.where("stays").select("row", "shard").unionByName(filled), "shards")
    return numbered(final, "shard", quota, ["row"], "slot", cell_rows)


def shard_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 40, rounds: int = 4, cell_rows: int = 256) -> DataFrame:
    """``id``, ``size``, ``crc``, ``shard``, ``slot`` of every document; documents with equal texts are linked.

    Size is the text's UTF-8 bytes plus 16. A null text counts as an empty one; null ids and repeated rows are rows
    like any other. The law is ``rows``: counts of any two shards differ by one at most.
    """
    text = F.coalesce(F.col(text), F.lit(""))
    crc = F.crc32(text.cast("binary"))
    rows = docs.select(F.col(key).alias("id"), (F.octet_length(text) + 16).cast("bigint").alias("size"), crc.alias("crc"), F.xxhash64(text).alias("hash"))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "documents")
    # equal size, CRC and 64-bit hash: equal texts
    members = rows.select("row", F.struct("hash", "crc", "size").alias("link"))
    return rows.select("row", "id", "size", "crc").join(assign(rows, members, shards, rounds, cell_rows), "row").drop("row")


def cut_share(members: DataFrame, state: DataFrame) -> float:
    """Share of neighbour pairs (two rows of one link) that lie in different shards; 0 without pairs."""
    placed = members.join(state, "row").groupBy("link", "shard").agg(F.count(F.lit(1)).cast("double").alias("n"))
    links = placed.groupBy("link").agg(F.sum("n").alias("all"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("together"))
    pairs, together = links.agg(F.sum(F.col("all") * (F.col("all") - 1) / 2), F.sum("together")).first()
    return 1 - together / pairs if pairs else 0.0
