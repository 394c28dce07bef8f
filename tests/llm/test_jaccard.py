import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline as P
from redactframe.llm import jaccard

SMALL, GIVEN = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def roots(docs):
    """Component of each place in the list: equal sets, and pairs of Jaccard similarity 0.8 or more."""
    sets = [brute.shingles(t) for _, t in docs]
    pairs = [(j, i) for i in range(len(docs)) for j in range(i) if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) > 0]
    return brute.components(pairs, range(len(docs)))


def partition(pairs):
    groups = {}
    for key, root in pairs:
        groups.setdefault(root, set()).add(key)
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("folder", [SMALL, GIVEN])
def test_components_are_those_of_all_pairs(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    given = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want = partition((given[i][0], r) for i, r in roots(given).items())
    assert partition((r["id"], r["root"]) for r in jaccard.near_duplicates(docs).collect()) == want


def test_stage_links_near_copies_beyond_four_bits(spark):
    docs = spark.read.parquet(f"{GIVEN}/documents.parquet").where("doc_id IN (1, 255, 709, 944, 643, 770)")
    prints = {r["doc_id"]: brute.fingerprint(r["text"]) for r in docs.collect()}
    assert all((prints[a] ^ prints[b]).bit_count() > 4 for a, b in ((1, 255), (709, 944), (643, 770)))
    assert sorted(r["doc_id"] for r in P.near_dedup(spark, docs, GIVEN).collect()) == [1, 643, 709]


def test_group_whose_leader_is_not_like_all(spark, rows):
    """A chain of texts, each like the next alone, and texts without words."""
    words = [f"w{i}" for i in range(400)]
    docs = [(i, " ".join(words[9 * i:9 * i + 100])) for i in range(30)] + [(50, None), (51, ""), (52, "w1 w2"), (53, "W1  w2")]
    frame = rows([(d, t, "en", "s", len(t or "")) for d, t in docs], COLUMNS)
    want = partition((docs[i][0], r) for i, r in roots(docs).items())
    assert frozenset(range(30)) in want
    assert partition((r["id"], r["root"]) for r in jaccard.near_duplicates(frame).collect()) == want


def test_texts_of_one_id_stay_if_not_alike(spark, rows):
    one, two = (" ".join(f"{c}{i}" for i in range(50)) for c in "ab")
    given = [(7, one), (7, two), (7, two), (8, one), (9, two)]
    out = P.near_dedup(spark, rows([(d, t, "en", "s", len(t)) for d, t in given], COLUMNS), SMALL)
    assert sorted((r["doc_id"], r["text"]) for r in out.collect()) == [(7, one), (7, two)]


@given(st.sets(st.integers(0, 2**64 - 1), max_size=120), st.sets(st.integers(0, 2**64 - 1), max_size=30), st.floats(0, 1))
@settings(max_examples=300, deadline=None)
def test_marks_lose_no_alike_pair(own, more, share):
    one = sorted(own)
    two = sorted({*one[:round(len(one) * share)], *more})
    x, y = (np.array(v, np.uint64) for v in (one, two))
    shared = len({*one} & {*two})
    if jaccard.alike(shared, len(one), len(two)):
        assert jaccard.may_be_alike(len(one), len(two), jaccard.mark(x), jaccard.mark(y))


def test_marks_drop_unlike_pairs():
    rng = np.random.default_rng(1)
    for n in (10, 60, 500, 5000):
        sets = [rng.integers(0, 2**64, n, dtype=np.uint64) for _ in range(20)]
        assert not any(jaccard.may_be_alike(n, n, jaccard.mark(a), jaccard.mark(b)) for a in sets for b in sets if a is not b)


@pytest.mark.parametrize(("block", "few"), [(3, 2), (4096, 2), (4096, 32)])
def test_shingles_that_many_sets_share(spark, rows, monkeypatch, block, few):
    """Blocks of a few sets, cells of many: groups of near copies, chains and unlike texts around one shared passage, as all pairs have them."""
    monkeypatch.setattr(jaccard, "BLOCK_SETS", block)
    monkeypatch.setattr(jaccard, "FEW_SETS", few)
    monkeypatch.setattr(jaccard, "COUNTED", 1)
    passage = " ".join(f"p{i}" for i in range(50))
    words = [f"w{i}" for i in range(300)]
    docs = [(i, f"{passage} {' '.join(words[i:i + 3])}") for i in range(25)]
    docs += [(100 + i, f"{passage} {' '.join(words[40 * (i % 3):40 * (i % 3) + 12 + i // 3])}") for i in range(18)]
    docs += [(200 + i, " ".join(words[9 * i:9 * i + 100])) for i in range(20)]
    rng = np.random.default_rng(4)  # copies of one text that differ among themselves by more than from it
    docs += [(300 + i, " ".join(w if rng.random() > 0.03 else f"x{rng.integers(9999)}" for w in words[:150 + i])) for i in range(40)]
    frame = rows([(d, t, "en", "s", len(t)) for d, t in docs], COLUMNS)
    want = partition((docs[i][0], r) for i, r in roots(docs).items())
    assert partition((r["id"], r["root"]) for r in jaccard.near_duplicates(frame).collect()) == want


def test_columns_of_any_name_and_type(spark):
    text = " ".join(f"a{i}" for i in range(30))
    docs = spark.sql(f"SELECT * FROM VALUES (2, '{text}', map('k', 1), 'x', 7), (1, '{text}', map('k', 2), 'y', 7), (1, '{text}', map('k', 2), 'y', 7), (3, null, null, null, 8) AS t(doc_id, text, `__row`, `a.b`, root)")
    out = P.near_dedup(spark, docs, SMALL)
    assert out.columns == docs.columns
    assert sorted((tuple(r) for r in out.collect()), key=str) == [(1, text, {"k": 2}, "y", 7), (3, None, None, None, 8)]


def test_near_copies_come_from_fingerprints(spark, rows):
    """Pairs of the pigeonring search are near ones, and connect what 4 bits of the sets' fingerprints connect."""
    words = [f"w{i}" for i in range(300)]
    docs = [(i, " ".join(words[:200 + i])) for i in range(12)] + [(100 + i, " ".join(f"v{i}x{j}" for j in range(60))) for i in range(5)]
    frame = rows([(d, t) for d, t in docs], "id long, text string").selectExpr("id", "id AS row", "text")
    distinct = jaccard.shingle_sets(frame, 5, np.zeros(jaccard.CELLS, np.uint8))
    prints = {r["set"]: r["fp"] % 2**64 for r in distinct.collect()}
    pairs = [(r["a"], r["b"]) for r in jaccard.fingerprint_pairs(distinct, 1).collect()]
    assert pairs and all((prints[a] ^ prints[b]).bit_count() <= 4 for a, b in pairs)
    near = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 4]
    assert partition(brute.components(pairs, prints).items()) == partition(brute.components(near, prints).items())
