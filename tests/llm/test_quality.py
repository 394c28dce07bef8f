import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from redactframe.llm import quality_model, quality_rules

SMALL = "/root/testdata/sf0.01"
TEXTS = [None, "", "one", "a b a b a b", "a b c a b c", "line\nline\n \n \nline x\nx", "# a | b <c> * 100%\n\n\n", "é ß\t你好\x0bz\x0c", "w " * 9000, "x y z\x1f", "one two three " * 40,
         "sentence number one is here. " * 3 + " ".join(f"w{i}" for i in range(80))]


def test_rule_counts(rows):
    df = rows([(t, i, 5) for i, t in enumerate(TEXTS)], "text string, doc_id long, n_words int")
    got = {r["id"]: tuple(r[c] for c in quality_rules.BASE) for r in quality_rules.statistics(df).collect()}
    assert got == {i: brute.rule_counts(t) for i, t in enumerate(TEXTS)}


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")


def test_verdicts(tables):
    docs, labels = tables
    out = quality_rules.judge(docs, labels)
    assert out.count() == docs.count()
    rows_ = out.join(labels, out["id"] == labels["doc_id"]).collect()
    assert all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) for r in rows_)
    assert not any(r["base_failed"] and r["kept"] for r in rows_)
    good = [r for r in rows_ if r["quality"] == 1 and not r["base_failed"]]
    bad = [r for r in rows_ if r["quality"] == 0]
    assert sum(r["kept"] for r in good) / len(good) >= 0.97
    assert sum(not r["kept"] for r in bad) / len(bad) >= 0.6


def test_rules_without_labels_or_rows(tables, rows):
    docs, labels = tables
    out = quality_rules.judge(docs.limit(50), labels.limit(0))
    assert out.where("kept = base_failed").count() == 0
    assert quality_rules.judge(docs.limit(0), labels).count() == 0
    odd = rows([(None, "a b"), (1, None), (1, None)], "doc_id long, text string")
    assert quality_rules.judge(odd, rows([(None, 1), (1, None), (1, 0)], "doc_id long, quality int")).count() == 3


def test_forest_finds_outliers():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 8))
    forest = quality_rules.Forest.grow(x, 100, 256)
    far = forest.score(np.full((5, 8), 6.0))
    usual = forest.score(x)
    assert far.min() > np.quantile(usual, 0.99) and 0 < usual.min() < usual.max() < 1
    same = quality_rules.Forest.grow(np.ones((300, 8)), 10, 256)
    assert np.isfinite(same.score(np.ones((3, 8)))).all()


def test_threshold():
    good, bad = np.zeros(10), np.zeros(10)
    good[:5], bad[4:] = 20, 5
    assert quality_rules.best_threshold(good, bad, 0.98) == 0.5
    assert quality_rules.best_threshold(good, np.zeros(10), 0.98) == 1.0


def test_classifier_on_held_out_rows(tables):
    docs, labels = tables
    scored = quality_model.score(docs, quality_model.train(docs, labels))
    got = scored.where(quality_model.held_out(F.col("id"))).join(labels, F.col("id") == labels["doc_id"]).collect()
    ranks = [(a["score"] > b["score"]) + 0.5 * (a["score"] == b["score"]) for a in got for b in got if a["quality"] > b["quality"]]
    assert len(ranks) > 100 and sum(ranks) / len(ranks) > 0.9
    assert all(0 <= r["score"] <= 1 for r in got)


def test_classifier_awkward_rows(tables, rows):
    docs, labels = tables
    odd = rows([(None, "a text", 1), (1, None, 2), (1, "", 3), (1, "", 3), (2, "z " * 100_000, 4), (3, "\n", 5)], "doc_id long, text string, score int")
    model = quality_model.train(docs, labels, per_class=20)
    got = quality_model.score(odd, model).collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got)
    assert quality_model.train(odd, labels.limit(0)) is None
    assert {r["score"] for r in quality_model.score(odd, None).collect()} == {0.5}
    one_class = quality_model.train(docs, labels.where("quality = 1"), per_class=20)
    assert min(r["score"] for r in quality_model.score(odd, one_class).collect()) > 0.5
    assert quality_model.score(docs.limit(0), model).count() == 0


def test_labelled_sample_is_not_cut_for_the_driver():
    import inspect

    assert inspect.signature(quality_model.train).parameters["per_class"].default == 4000
