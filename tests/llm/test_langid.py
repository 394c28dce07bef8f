import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from redactframe.llm import blocks as B
from redactframe.llm import grams, langid
import pyarrow as pa

SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def model(docs):
    return langid.train(docs, per_language=150)


def test_held_out_accuracy(docs, model):
    got = langid.identify(docs.select("doc_id", "text", "lang"), model).where(langid.held_out(F.col("doc_id"))).collect()
    right = [r["__lang"] == r["lang"] for r in got]
    assert len(right) > 200 and sum(right) / len(right) > 0.97
    assert all(0 <= r["__score"] <= 1 for r in got)
    sure = [r["__score"] for r in got]  # calibration: the mean probability is near the accuracy
    assert abs(sum(sure) / len(sure) - sum(right) / len(right)) < 0.05


def test_weights_are_sparse(model):
    assert 0 < np.count_nonzero(model.weights) < 0.6 * model.weights.size
    assert 0.25 <= model.temperature <= 256


def test_split(docs):
    for r in docs.select("doc_id", langid.held_out(docs["doc_id"]).alias("h")).limit(50).collect():
        assert r["h"] == (brute.crc(r["doc_id"]) % 3 == 1)


def test_awkward_rows(rows, model):
    texts = [None, "", "12 34 !!", "\n", "ß", "the thing of the", "the " * 60_000]
    df = rows([(t, i, None) for i, t in enumerate(texts)], "text string, doc_id long, lang string")
    got = {r["doc_id"]: r for r in langid.identify(df, model).collect()}
    assert [got[i]["__lang"] == "und" for i in range(7)] == [True] * 4 + [False] * 3
    assert all(got[i]["__score"] == 0 for i in range(4))
    assert got[5]["__lang"] == got[6]["__lang"] == "en"


def test_nothing_to_learn(rows):
    df = rows([(1, "some text", None), (None, "text", "en"), (2, None, "en")], "doc_id long, text string, lang string")
    assert langid.train(df) is None
    assert {r["__lang"] for r in langid.identify(df, None).collect()} == {"und"}
    assert langid.identify(df.limit(0), langid.train(df.limit(0))).count() == 0


def test_labels_and_ids_do_not_matter_to_a_prediction(docs, model):
    a = {r["text"]: r["__score"] for r in langid.identify(docs.select("text").limit(40), model).collect()}
    b = {r["text"]: r["__score"] for r in langid.identify(docs.select("text", (-docs["doc_id"]).alias("doc_id")).limit(40), model).collect()}
    assert a == b


def test_document_frequencies(rows):
    texts = ["abc", "abd abd", "", "xyz"]
    n, f = langid.document_frequencies(rows([(t,) for t in texts], "text string"))
    want = np.zeros(langid.BUCKETS, int)
    for t in texts:
        own = {int(x) for h, _ in grams.text_grams(next(B.blocks(pa.array([t]))), langid.ORDERS, langid.BUCKETS) for x in h}
        for x in own:
            want[x] += 1
    assert n == 4 and (f == want).all()


def test_grams_stay_within_texts():
    texts = ["ab", "", None, "Éa1b", "你好 x\U0001F600", "a"]
    together = next(B.blocks(pa.array(texts)))
    for k, parts in enumerate(grams.text_grams(together, (1, 2, 3), 1 << 15)):
        h, first = parts
        for i, t in enumerate(texts):
            alone = grams.text_grams(next(B.blocks(pa.array([t], pa.string()))), (1, 2, 3), 1 << 15)[k][0]
            assert h[first[i]:first[i + 1]].tolist() == alone.tolist()


def test_temperature_recovers_the_scale():
    rng = np.random.default_rng(0)
    logits = rng.normal(size=(4000, 3)) * 2
    labels = np.array([rng.choice(3, p=langid.softmax(x)) for x in logits])
    assert abs(langid.fit_temperature(logits * 3, labels) - 3) < 0.3


def test_unlearned_scripts_are_unusual(docs, rows, model):
    odd = ["Привет, как дела? Сегодня хорошая погода и мы идем гулять в парк.", "今日はとても良い天気ですね。公園に行きましょう。", "დღეს კარგი ამინდია და ჩვენ პარკში მივდივართ", "สวัสดีครับ วันนี้อากาศดีมาก"]
    got = {r["text"]: r["__usual"] for r in langid.identify(rows([(t,) for t in [*odd, None, "", "12"]], "text string"), model).collect()}
    assert not any(got.values())
    assert langid.identify(docs, model).where("NOT __usual").count() == 0


def test_names_that_are_taken(rows, model):
    df = rows([("the thing of the", 1, "own", "a", 2.0, True)], "text string, __letter int, __lang string, `__Score` string, x double, __usual boolean")
    out = langid.identify(df, model)
    assert out.columns == [*df.columns, "__lang_", "__score_", "__usual_"]
    assert tuple(out.first())[:7] == ("the thing of the", 1, "own", "a", 2.0, True, "en")


def test_regression_against_plain_loops():
    """Follow-the-regularised-leader, one coordinate at a time, over the same order of rows."""
    rng = np.random.default_rng(5)
    rows = [(np.sort(rng.choice(12, 4, replace=False)).astype(np.int32), rng.random(4)) for _ in range(30)]
    labels, classes = rng.integers(0, 3, 30), 3
    alpha, beta, l1, l2, epochs, seed = 0.5, 1.0, 0.2, 0.02, 3, 7
    z, n = [[0.0] * classes for _ in range(12)], [[0.0] * classes for _ in range(12)]
    bias, bias_n = [0.0] * classes, [0.0] * classes

    def weight(f, c):
        if abs(z[f][c]) <= l1:
            return 0.0
        return ((1 if z[f][c] > 0 else -1) * l1 - z[f][c]) / ((beta + n[f][c] ** 0.5) / alpha + l2)

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            index, value = rows[i]
            w = {(f, c): weight(f, c) for f in index for c in range(classes)}
            logit = [bias[c] + sum(v * w[f, c] for f, v in zip(index, value, strict=True)) for c in range(classes)]
            e = np.exp(np.array(logit) - max(logit))
            for c in range(classes):
                error = e[c] / e.sum() - (labels[i] == c)
                for f, v in zip(index, value, strict=True):
                    g = v * error
                    z[f][c] += g - ((n[f][c] + g * g) ** 0.5 - n[f][c] ** 0.5) / alpha * w[f, c]
                    n[f][c] += g * g
                bias_n[c] += error * error
                bias[c] -= alpha * error / (beta + bias_n[c] ** 0.5)
    weights, got_bias = langid.fit_ftrl(rows, labels, classes, alpha, beta, l1, l2, epochs, seed)
    assert np.allclose(weights[:12], [[weight(f, c) for c in range(classes)] for f in range(12)]) and np.allclose(got_bias, bias)
    assert (weights[12:] == 0).all()
