import hashlib

import brute
import numpy as np
import pytest

from redactframe.llm import blocks as B
from redactframe.llm import decontaminate
import pyarrow as pa

W = [f"word{i}" for i in range(40)]
ITEMS = [(1, " ".join(W[:12])), (10, " ".join(W[20:29])), (2, "Short item!"), (2, "Short item!"), (3, ""), (4, None), (None, "no id here"), (5, " ".join([W[0]] * 15)), (6, "é ß 你")]
DOCS = [
    (1, " ".join(W)), (2, " ".join(W[1:11]).upper()), (3, " ".join(W[:9])), (4, None), (5, ""), (6, "a short, ITEM; short item short"), (7, "word0 " * 30),
    (8, " ".join(W[20:29]) + " x " + " ".join(W[2:12])), (9, "word0-word1_word2.word3" * 2), (None, "there is no id here"), (10, "it has É, é ß 你 in it"), (10, "it has É, é ß 你 in it"),
    (11, "z " * 20_000 + " ".join(W[:10])), (12, "short"), (13, "item"),
]


def longest(text):
    """Longest run of equal words that fills a window of the item: words, item, start, place."""
    found, words = [], brute.BENCH_WORD.findall(brute.lower(text or ""))
    for i, item in ITEMS:
        own = brute.BENCH_WORD.findall(brute.lower(item or ""))
        for a in range(len(own)):
            for b in range(len(words)) if own[a] in words else ():
                n = 0
                while a + n < len(own) and b + n < len(words) and own[a + n] == words[b + n]:
                    n += 1
                if n >= min(10, len(own)):
                    found.append((-n, "" if i is None else str(i), a, b))
    if not found:
        return 0, None, None, None
    n, item, a, b = min(found)
    return -n, item, a, b


@pytest.mark.parametrize("block_bytes", [8 << 20, 40])
def test_against_brute_force(rows, block_bytes):
    docs = rows([(d, t, "c") for d, t in DOCS], "doc_id long, text string, hit string")
    bench = rows([(i, t, 0) for i, t in ITEMS], "item_id long, text string, id int")
    out = decontaminate.scan(docs, bench, block_bytes=block_bytes).collect()
    assert sorted([(r["id"], *tuple(r)[5:]) for r in out], key=str) == sorted([(d, *longest(t)) for d, t in DOCS], key=str)
    got = [tuple(r)[:5] for r in out]
    want = [(d, n, h, len(f), hashlib.sha256(",".join(f).encode()).hexdigest()) for d, n, h, f in brute.contaminated(DOCS, ITEMS)]
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = [tuple(r) for r in decontaminate.clean(docs, bench, block_bytes=block_bytes).collect()]
    assert sorted(kept, key=str) == sorted([(d, t, "c") for (d, t), x in zip(DOCS, brute.contaminated(DOCS, ITEMS), strict=True) if not x[2]], key=str)


def test_empty_tables(rows):
    docs, bench = rows(DOCS, "doc_id long, text string"), rows(ITEMS, "item_id long, text string")
    assert decontaminate.scan(docs.limit(0), bench).count() == 0
    assert decontaminate.scan(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.clean(docs, bench.limit(0)).count() == len(DOCS)


def test_suffix_order():
    rng = np.random.default_rng(2)
    for top, n in ((2, 300), (3, 300), (50, 500), (2**20, 100)):
        words = rng.integers(0, top, n)
        suffix = lambda p, w=words: tuple(w[p:p + int(np.argmin(np.append(w[p:], 0) > 0))])[:60]
        order = decontaminate.suffix_order(words, 60)
        assert sorted(order) == list(np.flatnonzero(words))
        assert [suffix(p) for p in order] == sorted(suffix(p) for p in order)
    assert len(decontaminate.suffix_order(np.zeros(5, np.int64), 10)) == 0


def test_longest_matches(rows):
    docs = rows([(1, "q " + " ".join(W[3:9])), (2, " ".join(W[3:8])), (3, None)], "doc_id long, text string")
    bench = rows([(7, " ".join(W[:12]))], "item_id long, text string")
    got = {r["start"]: (r["length"], r["id"], r["place"]) for r in decontaminate.matches(docs, bench).collect()}
    assert got == {3: (6, 1, 1), 4: (5, 1, 2), 5: (4, 1, 3), 6: (3, 1, 4), 7: (2, 1, 5), 8: (1, 1, 6)}


def test_matches_of_string_ids(rows):
    docs = rows([("b", "x " + " ".join(W[3:9])), ("a", " ".join(W[3:9])), (None, "nothing")], "doc_id string, text string")
    got = decontaminate.matches(docs, rows([("i", " ".join(W[:12]))], "item_id string, text string")).where("start = 3").collect()
    assert [tuple(r) for r in got] == [("i", 3, 6, "a", 0)]


def test_blocks_cover_long_texts():
    column = pa.array(["a" * 50, None, "b", "c" * 7, ""])
    got = list(B.blocks(column, 10))
    assert [(b.row0, b.rows, len(b.data)) for b in got] == [(0, 1, 50), (1, 4, 8)]
