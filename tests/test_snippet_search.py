import random

import pytest

from redactframe.operators import documents as D

WORDS = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "theta", "lambda", "omega", "sigma"]


def brute(docs, queries, k):
    out = set()
    for q, text in queries:
        asked = set(text.split())
        found = sorted((-sum(w in s.lower() for w in asked), d, i) for d, t in docs for i, s in enumerate(t.split("\n")))
        out |= {(q, d, i, -n, r + 1) for r, (n, d, i) in enumerate([x for x in found if x[0] < 0][:k])}
    return out


@pytest.mark.parametrize("limits", [(D.SENT_ROWS, D.SENT_NUMBERS), (0, 0)])
def test_sent_and_shuffled_sides_give_the_answers_of_all_sentences(spark, rows, monkeypatch, limits):
    monkeypatch.setattr(D, "SENT_ROWS", limits[0])
    monkeypatch.setattr(D, "SENT_NUMBERS", limits[1])
    rng = random.Random(3)
    docs = [(d, "\n".join(" ".join(rng.choice(["x", ""]) + rng.choice(WORDS) for _ in range(rng.randint(1, 6))) for _ in range(5))) for d in range(40)]
    queries = [(q, " ".join(rng.sample(WORDS, 4))) for q in range(12)] + [(99, "absent")]
    found = D.top_snippets(rows(docs, "doc_id long, text string"), rows(queries, "query_id long, text string"), 4)
    assert {(r["query_id"], r["doc_id"], r["sent_idx"], r["score"], r["rank"]) for r in found.collect()} == brute(docs, queries, 4)


def test_words_of_sentences_are_not_shuffled(spark, rows):
    """The runs that hold a word go to the sentences; what is shuffled has one row a sentence and task."""
    docs = rows([(1, "alpha beta\ngamma alphabet"), (2, "delta")], "doc_id long, text string")
    plan = D.snippet_index(docs, rows([("alpha",), ("gamma",)], "word string"), 8)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
