import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from redactframe.llm import blocks, divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(0x41, 0x5B)}


def brute(docs, top=200):
    seen, held = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in docs:
        lang, source = lang or "", source or ""
        terms = TERM.findall((text or "").translate(LOWER))
        seen[lang, source].update(terms)
        held[lang].update(set(terms))
    out = set()
    for lang in held:
        kept = sorted(t for t, n in held[lang].items() if n >= 3)
        own = {s: {t: c[t] for t in kept} for (at, s), c in seen.items() if at == lang}
        all_ = {t: sum(c[t] for c in own.values()) for t in kept}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        q = share(all_)
        for s, c in own.items():
            p = share(c)
            pairs = [(o, sum((p[t] - r[t]) ** 2 // r[t] for t in kept)) for o, r in ((o, share(x)) for o, x in own.items() if o != s)]
            terms = [(t, (p[t] - q[t]) ** 2 // q[t]) for t in kept if c[t] and p[t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                ordered = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out |= {(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ordered)}
    return out


def ours(df, **options):
    got = [tuple(r) for r in divergence.source_divergence(df, **options).collect()]
    assert len(got) == len(set(got))
    return set(got)


SCHEMA = "lang string, source string, text string, term string, value double, total int, k int"


def made(rows, docs):
    return rows([(*d, "clash", 0.5, 1, 2) for d in docs], SCHEMA)


def test_many_blocks(rows, monkeypatch):
    """Cells of a few terms and sources: every pair of group blocks meets, whatever the block sizes."""
    rng = np.random.default_rng(3)
    words = [f"w{a}{b}" for a in "abcdefg" for b in "éöxyz"] + ["the"] * 20
    docs = [(f"l{i % 2}", f"s{rng.integers(13) if i % 3 else 0}", " ".join(rng.choice(words, rng.integers(0, 30)))) for i in range(160)]
    monkeypatch.setattr(divergence, "TERM_BLOCK", 4)
    monkeypatch.setattr(divergence, "GROUP_BLOCK", 3)
    monkeypatch.setattr(divergence, "HELD_ROWS", 50)
    monkeypatch.setattr(divergence, "COUNTED_BYTES", 300)
    want = brute(docs, 5)
    assert ours(made(rows, docs), top_terms=5) == want and len(want) > 300


def test_awkward_tables(rows):
    assert ours(made(rows, [])) == set()
    docs = [(None, None, None), ("", None, "One one ONE"), ("", "b", ""), ("x", "a", "ß É one"), ("x", "a", "ß É one"), ("x", "b", "É one"), ("x", "c", None), ("x", "c", "1 2 _"), ("one", "z", "alone")]
    want = brute(docs)
    assert ours(made(rows, docs)) == want
    assert ("", "", "pair", "b", 0, 1) in want  # no term in three rows: pairs of value 0


def test_long_texts_and_a_hot_source(rows):
    docs = [("en", "hot", "alpha beta " * 30_000 + "x" * 200_000)] * 4 + [("en", f"s{i}", "alpha gamma gamma") for i in range(4)]
    assert ours(made(rows, docs)) == brute(docs)


@given(st.lists(st.integers(0, 2**40), min_size=1, max_size=5), st.integers(0, 2**44))
@settings(max_examples=50, deadline=None)
def test_shares_of_huge_counts(counts, more):
    total = sum(counts) + len(counts) + more
    got = divergence.shares(np.array(counts), total)
    assert got.tolist() == [1 + 10**9 * (c + 1) // total for c in counts]


@pytest.mark.parametrize("texts", [["a b a", "", "Ünï c"], [""], ["1 2 3"]])
def test_counts_of_a_block(texts):
    import pyarrow as pa

    n = len(texts)
    got = divergence.block_counts(pa.array(["l"] * n), pa.array(["s"] * n), next(blocks.blocks(pa.array(texts)))).to_pylist()
    want = Counter(t for x in texts for t in TERM.findall(x.translate(LOWER)))
    assert {r["term"]: r["n"] for r in got if r["term"] is not None} == dict(want)
    assert [r for r in got if r["term"] is None] == [{"lang": "l", "source": "s", "term": None, "n": 0, "docs": 0}]
