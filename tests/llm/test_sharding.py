import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from redactframe.llm import sharding


def shards_of(df, **options):
    rows = sharding.shard_documents(df, **options).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    counts = [len(slots[i]) for i in range(options.get("shards", 40))]
    assert max(counts) - min(counts) <= 1 and sum(counts) == len(rows)
    return rows


@pytest.mark.parametrize("cell_rows", [3, 4096])
def test_groups_stay_together(rows, cell_rows):
    texts = [f"own {i}" for i in range(300)] + [f"copy {i % 60}" for i in range(180)] + ["hot"] * 200 + [None, ""]
    df = rows([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, shard string")
    out = shards_of(df, shards=8, cell_rows=cell_rows)
    by_text = defaultdict(Counter)
    for r in out:
        t = texts[r["id"]] or ""
        assert (r["size"], r["crc"]) == (len(t.encode()) + 16, zlib.crc32(t.encode()))
        by_text[t][r["shard"]] += 1
    whole = [c for t, c in by_text.items() if t.startswith("copy")]
    assert sum(len(c) == 1 for c in whole) >= 0.8 * len(whole)
    assert len(by_text["hot"]) <= 5  # 200 rows need three of the 86-row shards


def test_awkward_tables(rows):
    assert shards_of(rows([], "doc_id long, text string")) == []
    assert len(shards_of(rows([(None, None)] * 3 + [(7, "a")] * 4, "doc_id long, text string"))) == 7
    assert len(shards_of(rows([(1, "z" * 100_000)], "doc_id long, text string"))) == 1


def test_several_links_pull_together(spark):
    """Two tight clusters of pairwise links: propagation cuts fewer pairs than the start."""
    members = [(i, f"{i // 30}-{k}") for i in range(240) for k in (i % 30, (i + 1) % 30, (i + 7) % 30)]
    mem = spark.createDataFrame(members, "row long, link string")
    rows = mem.select("row").distinct()
    out = sharding.assign(rows, mem, shards=8, rounds=6)
    start = rows.withColumn("shard", F.pmod(F.xxhash64(F.lit("start"), "row"), F.lit(8)).cast("int"))
    assert sharding.cut_share(mem, out.select("row", "shard")) < 0.8 * sharding.cut_share(mem, start)
    assert sorted(r["count"] for r in out.groupBy("shard").count().collect()) == [30] * 8
