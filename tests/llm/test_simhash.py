import random

import brute
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from redactframe.llm import simhash
from redactframe.llm.components import connected

TEXTS = ["", None, "  \n\t", "One", "one two", "ONE two\tthree  four five", "é ß 你好 and more words here", "x" * 700 + " tail", "w " * 400 + "end",
         "the quick brown fox jumps over the lazy dog again and again today", "The Quick brown fox jumps over the lazy dog again and again today"]


def test_xxh64_matches_library():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 4000).astype(np.uint8)
    starts = rng.integers(0, 4000, 400)
    lengths = np.minimum(rng.integers(0, 700, 400), 4000 - starts)
    lengths[:70] = np.minimum(np.arange(70), 4000 - starts[:70])
    got = simhash.xxh64_spans(data, starts, lengths)
    assert [int(x) for x in got] == [xxhash.xxh64_intdigest(data[s:s + n].tobytes(), 42) for s, n in zip(starts, lengths, strict=True)]


def test_fingerprints(rows):
    df = rows([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, fp string")
    got = {r["id"]: r["fp"] % 2**64 for r in simhash.fingerprints(df).collect()}
    assert got == {i: brute.fingerprint(t) for i, t in enumerate(TEXTS)}


def test_pigeonring_keeps_every_near_pair():
    rng = random.Random(4)
    masks = simhash._segments(7)
    for _ in range(300):
        x = np.uint64(rng.getrandbits(64))
        flips = np.uint64(sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))))
        d = np.array([[int(np.bitwise_count(flips & m)) for m in masks]])
        assert simhash.pigeonring(d, 4)[0]
        assert len(simhash.near(x, np.array([x ^ flips]), masks, 4)) == 1


@pytest.mark.parametrize("bucket_rows", [4096, 16])
def test_links_connect_what_brute_force_connects(spark, bucket_rows):
    rng = random.Random(9)
    prints = {0, 2**64 - 1}
    for _ in range(12):
        x = rng.getrandbits(64)
        prints.add(x)
        for _ in range(rng.choice([0, 1, 3, 40])):  # chains and dense groups
            x ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5)))
            prints.add(x)
    prints = sorted(prints)
    pairs = [(a, b) for i, a in enumerate(prints) for b in prints[i + 1:] if (a ^ b).bit_count() <= 4]
    want = brute.components(pairs, prints)
    df = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "fp long")
    roots = {r["node"] % 2**64: r["root"] % 2**64 for r in connected(simhash.links(df, bucket_rows=bucket_rows)).collect()}
    groups = lambda m: {frozenset(n for n in prints if m.get(n, n) == m.get(p, p)) for p in prints}
    assert groups(roots) == groups(want)


def test_near_duplicates(rows):
    data = [(i + 10, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[5]), (3, TEXTS[5]), (None, TEXTS[9]), (None, "unlike all the others in this table")]
    prints = [brute.fingerprint(t) for _, t in data]
    pairs = [(i, j) for i in range(len(data)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    root = brute.components(pairs, range(len(data)))
    want = []
    for i, (d, _) in enumerate(data):
        ids = [data[j][0] for j in range(len(data)) if root[j] == root[i] and data[j][0] is not None]
        want.append((d, f"{prints[i]:016x}", min(ids, default=None)))
    df = rows([(d, t, "clash", 1) for d, t in data], "doc_id long, text string, id string, component int")
    got = simhash.near_duplicates(df).select("id", simhash.hex_print("fp"), "component").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_empty(rows):
    assert simhash.near_duplicates(rows([], "doc_id long, text string")).count() == 0


def test_components_of_long_path_and_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5), (None, 7)]
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(1, 201)} | {1000 + i: 1000 for i in range(1, 300)}
    assert {k: v for k, v in got.items() if k != v} == want


@pytest.mark.parametrize("near_only", [True, False])
def test_choices_are_not_broadcast(spark, tmp_path, near_only):
    """A small file of fingerprints expands to 35 rows each: the planner, which counts the file, must not send those through the driver."""
    spark.createDataFrame([(x,) for x in (0b0111, 0, -1, 1 << 40)], "fp long").write.parquet(f"{tmp_path}/prints")
    found = simhash.links(spark.read.parquet(f"{tmp_path}/prints"), near_only=near_only)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    parts = brute.components([(r["src"], r["dst"]) for r in found.collect()], [0b0111, 0, -1, 1 << 40])
    assert parts[0b0111] == parts[0] == parts[1 << 40] != parts[-1]
