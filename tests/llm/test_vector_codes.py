import math

import numpy as np
import pytest

from redactframe.llm import queries, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, id string, codes int"


def brute(rows, parts=4, entries=256, rounds=4):
    """Plain loops over Python integers."""
    kept = [(i, [math.floor(1024 * float(x)) for x in v], g) for i, v, g in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return [], []
    wide = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * wide:(p + 1) * wide]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            own = {}
            for _, v, _ in kept:
                own.setdefault(near(cut(v, p), book)[1], []).append(cut(v, p))
            for j, members in own.items():
                book[j] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    out = []
    for i, v, g in kept:
        best = [near(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, g, [j for _, j in best], total if (total := sum(d for d, _ in best)) < 2**63 else None))
    return out, books


def both(rows, data, **options):
    frame = rows([(i, v, g, "clash", 1) for i, v, g in data], SCHEMA)
    got, books = vector_codes.compress(frame, **options)
    want, plain = brute([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], g) for i, v, g in data], **options)
    assert books.tolist() == plain or not plain
    key = lambda r: (str(r[0]), str(r[1]), r[2], str(r[3]))
    assert sorted([(r["id"], r["label"], r["index"], r["error"]) for r in got.collect()], key=key) == sorted(want, key=key)
    return want


def vectors(n, dims, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    return [(i, (spread * rng.normal(size=dims)).tolist(), int(i % 3) if i % 4 else None) for i in range(n)]


@pytest.mark.parametrize("block", [7, 8192])
def test_against_plain_loops(rows, monkeypatch, block):
    monkeypatch.setattr(vector_codes, "BLOCK_ROWS", block)
    both(rows, vectors(90, 8, 1), entries=6)


def test_nulls_ties_and_repeats(rows):
    hot = [0.25] * 8
    data = [(i, hot, 1) for i in range(20, 60)] + [(20, hot, 1)] * 3 + vectors(12, 8, 2) + [
        (None, hot, None), (100, None, 1), (101, [None] * 8, 1), (102, [float("nan")] + [0.0] * 7, 1), (103, [float("inf")] * 8, 2), (3, [-0.5] * 8, 2)]
    assert len(both(rows, data, entries=5)) == 40 + 3 + 12 + 2


def test_large_components(rows):
    """Beyond 32 and 64 bits the sums stay exact; an error that no long holds is null."""
    both(rows, vectors(30, 4, 3, spread=1e5), entries=4)
    both(rows, vectors(30, 4, 4, spread=1e3), entries=4)
    want = both(rows, [(i, [1e20 * i, 0.0, 0.0, 1e9], 0) for i in range(5)], entries=2)
    assert any(r[3] is None for r in want)


def test_few_rows_and_odd_lengths(rows):
    assert both(rows, []) == []
    assert both(rows, [(1, None, 1)]) == []
    assert both(rows, [(5, [0.5, 0.25, 0.0, 1.0], 1)]) == [(5, 1, [0, 0, 0, 0], 0)]
    frame = rows([(1, [0.5, 0.25, 1.0, -1.0, 3.0], 1, "", 1), (2, [0.5], 1, "", 1), (3, [], None, "", 1), (4, [0.0] * 5, 1, "", 1)], SCHEMA)
    got, books = vector_codes.compress(frame)
    assert sorted(r["id"] for r in got.collect()) == [1, 4] and books.shape == (4, 2, 2)  # filled up to 8 components
    empty, books = vector_codes.compress(rows([(1, [], 1, "", 1), (2, [], 1, "", 1)], SCHEMA))
    assert [r["index"] for r in empty.collect()] == [[0] * 4] * 2 and books.shape == (4, 2, 0)


def test_query_columns(spark):
    out = queries.op13_vector_codes(spark, "/root/testdata/sf0.001")
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert all(len(r["code"]) == 8 for r in out.collect())
