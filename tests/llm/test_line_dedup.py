import brute
import numpy as np
import pytest

from redactframe.llm import line_dedup

LONG = "this passage is long enough to count as a shared line é"
LONG2 = "another passage that several of the documents repeat"
ROWS = [
    (1, f"{LONG}\nown text one\n{LONG2}"), (2, f"  {LONG.upper().replace('É', 'é')}\t\nown text two"), (3, f"x\n\n{LONG}\n{LONG}\n"), (4, LONG), (5, f"{LONG}\r\nend"),
    (5, f"{LONG}\r\nend"), (6, LONG2), (7, f"{LONG2}\n{LONG2}"), (8, f"\n{LONG2}\n"), (None, f"{LONG2}\n{LONG}"), (9, None), (10, ""), (11, "\n\n"), (12, LONG[:39]),
    (13, "one line in four documents only, so that it stays"), (14, "one line in four documents only, so that it stays"), (15, "y" * 5000 + "\nz"), (16, f"{LONG2} \n\x0b"),
]


@pytest.mark.parametrize(("shard_lines", "group_bytes"), [(500_000, 64 << 20), (1, 1)])
def test_against_brute_force(rows, shard_lines, group_bytes):
    """The second case puts every line into a shard and a pass of its own."""
    df = rows([(t, d, "kept") for d, t in ROWS], "text string, doc_id long, place string")
    out = line_dedup.dedup_lines(df, shard_lines=shard_lines, group_bytes=group_bytes)
    assert out.columns == ["text", "doc_id", "place", "__lines", "__dropped"]
    got = [(r["doc_id"], r["__lines"], r["__dropped"], r["text"]) for r in out.collect()]
    assert sorted(got, key=str) == sorted(brute.dedup_lines(ROWS), key=str)


def test_empty_table(rows):
    assert line_dedup.dedup_lines(rows([], "doc_id long, text string")).count() == 0


def test_only_null_ids_keep_their_lines(rows):
    out = line_dedup.dedup_lines(rows([(None, LONG)] * 6, "doc_id long, text string")).collect()
    assert [(r["text"], r["__dropped"]) for r in out] == [(LONG, 0)] * 6


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 30_000])
def test_perfect_hash(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
    index = line_dedup.PerfectHash.build(keys)
    assert sorted(index.lookup(keys)) == list(range(len(keys)))
    prints = rng.integers(0, 2**63, len(keys)).astype(np.uint64)
    shard = line_dedup.Shard.build(keys, prints, np.full(len(keys), 5, np.int32), np.arange(len(keys)))
    again = line_dedup.Shard.of_row(shard.to_row())
    known, keeper = again.probe(keys, prints)
    assert known.all() and (keeper == np.arange(len(keys))).all()
    assert not again.probe(keys, prints ^ np.uint64(1))[0].any()
    others = rng.integers(2**63, 2**64, 1000, dtype=np.uint64)
    assert not again.probe(others, others)[0].any()




def test_names_that_are_taken(rows):
    df = rows([(i, LONG + f"\nown {i}", i, "kept") for i in range(6)], "doc_id long, text string, __lines int, `__Dropped` string")
    out = line_dedup.dedup_lines(df)
    assert out.columns == [*df.columns, "__lines_", "__dropped_"]
    assert sorted(tuple(r) for r in out.collect()) == [(i, (LONG + "\n" if i == 5 else "") + f"own {i}", i, "kept", 2, int(i < 5)) for i in range(6)]


def test_keys_are_whole_numbers(rows):
    with pytest.raises(TypeError, match="whole numbers"):
        line_dedup.dedup_lines(rows([("a", LONG)], "doc_id string, text string"))
