import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from redactframe.llm import packing
from redactframe.llm.queries import tokenizer_path

TEXTS = ["Hello world, don't 12345!", None, "", "  two\n\n  lines \t", "é ß 你好 \U0001F600", "<|endoftext|> inside", "word " * 3000, "x" * 4000, "a b c " * 400, "\x00\x01\x10", "Hello world, don't 12345!"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokenizer_path())


def test_ids_are_the_tokenizers(tokenizer):
    for t in TEXTS:
        assert packing.token_ids(tokenizer_path(), t or "").tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids


def test_pack(rows, tokenizer):
    docs = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (4, "again"), (4, "again")]
    df = rows([(t, d, 1) for d, t in docs], "text string, doc_id long, piece int")
    got = [r.asDict() for r in packing.pack(df, tokenizer_path(), cell_rows=2).collect()]
    want = []
    for d, t in docs:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) if len(ids) <= 1024 else len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids), 1024), len(ids)]
        want += [(d, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
    assert sorted([tuple(r[c] for c in ("id", "piece", "start", "length", "crc")) for r in got], key=str) == sorted(want, key=str)
    check_sequences([(r["sequence"], r["offset"], r["length"]) for r in got], 1024)


def check_sequences(placed, limit):
    own = defaultdict(list)
    for s, o, n in placed:
        own[s].append((o, n))
    for parts in own.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= limit
    return len(own)


@pytest.mark.parametrize("counts", [{}, {1: 1}, {1024: 3}, {1: 5000}, {600: 10}, {512: 3, 511: 2, 1: 1}, {300: 100, 424: 100, 700: 7}])
def test_plans(counts):
    check_plan(counts, 1024)


@pytest.mark.parametrize("seed", range(4))
def test_random_plans_are_near_the_bound(seed):
    rng = np.random.default_rng(seed)
    lengths = np.clip(rng.lognormal(5, 1, 4000).astype(int), 1, 1024)
    values, many = np.unique(lengths, return_counts=True)
    used = check_plan(dict(zip(values.tolist(), many.tolist(), strict=True)), 1024)
    assert used <= 1.01 * lengths.sum() / 1024 + 2


def check_plan(counts, limit):
    histogram = np.zeros(limit + 1, np.int64)
    for length, n in counts.items():
        histogram[length] = n
    plan = packing.make_plan(histogram, limit)
    length = np.repeat(np.arange(limit + 1), histogram)
    number = np.concatenate([np.arange(n) for n in histogram]) if len(length) else length
    sequence, offset = plan.place(length, number) if len(length) else (length, length)
    used = check_sequences(list(zip(sequence.tolist(), offset.tolist(), length.tolist(), strict=True)), limit)
    assert used == plan.sequences
    return used


def test_patterns_fill_exactly():
    p = packing.exact_patterns(np.array([1, 2, 3, 5, 10]), 10)
    assert {tuple(x) for x in p.tolist()} == {(10, 0, 0), (5, 5, 0), (5, 3, 2)}


def test_empty(rows):
    assert packing.pack(rows([], "doc_id long, text string"), tokenizer_path()).count() == 0
