"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies of hashed n-grams are counted over all training rows. The regression is fitted on a bounded,
documented sample per language by follow-the-regularised-leader with an elastic net (the L1 part leaves exact
zeros), and a temperature fitted on a held-back part of that sample calibrates its probabilities. TF is an
n-gram's share of the text, so a text's score is the mean of its n-grams' weights: prediction is one pass over the
whole text with a table look-up per n-gram.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from redactframe.llm import blocks as B
from redactframe.llm import grams as G
from redactframe.llm.store import free_name, small_batches

UNKNOWN = "und"
ORDERS = (1, 2, 3)
BUCKETS = 1 << 15
#: Shares of a text are small numbers; this brings frequent features to some tens, so that few passes suffice.
SCALE = 1000.0


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # buckets x languages, idf and scale folded in
    bias: np.ndarray
    temperature: float
    idf: np.ndarray
    rarest: float  # mean idf of a text's n-grams up to which it may be of a learned language

    def scores(self, block: B.Block) -> tuple[np.ndarray, np.ndarray]:
        """Logits of each text, and the mean idf of its n-grams."""
        table = np.column_stack((self.weights, self.idf))
        total, count = np.zeros((block.rows, table.shape[1])), np.zeros(block.rows)
        for bucket, starts in G.text_grams(block, ORDERS, BUCKETS):
            total += G.segment_sums(table[bucket], starts)
            count += np.diff(starts)
        total /= np.maximum(count, 1)[:, None]
        return total[:, :-1] + self.bias, total[:, -1]

    def predict(self, block: B.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the likeliest language of each text (the first of equals), its calibrated probability, and whether the text's n-grams are usual ones."""
        logits, rarity = self.scores(block)
        p = softmax(logits / self.temperature)
        best = p.argmax(axis=1)
        return best, p[np.arange(len(best)), best], rarity <= self.rarest


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def document_frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """Number of texts, and in how many of them each bucket occurs; counted over every row of the one text column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for block in B.blocks(batch.column(0)):
                parts = G.text_grams(block, ORDERS, BUCKETS)
                for t in range(block.rows):
                    seen = np.zeros(BUCKETS, bool)
                    for bucket, starts in parts:
                        seen[bucket[starts[t]:starts[t + 1]]] = True
                    frequency += seen
                n += block.rows
        used = np.flatnonzero(frequency)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1), pa.int32()), pa.array(np.append(frequency[used], n), pa.int64())], names=["bucket", "n"])

    rows = texts.mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # at most BUCKETS + 1
    frequency, n = np.zeros(BUCKETS, np.int64), 0
    for r in rows:
        if r["bucket"] < 0:
            n = r["n"]
        else:
            frequency[r["bucket"]] = r["n"]
    return n, frequency


def sparse_shares(texts: DataFrame) -> DataFrame:
    """``label``, ``index``, ``share``: the buckets of each text and their shares of its n-grams, as packed arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, share = [], []
            for block in B.blocks(batch.column(1)):
                parts = G.text_grams(block, ORDERS, BUCKETS)
                for t in range(block.rows):
                    own = np.concatenate([bucket[starts[t]:starts[t + 1]] for bucket, starts in parts])
                    values, counts = np.unique(own, return_counts=True)
                    index.append(values.astype(np.int32).tobytes())
                    share.append((counts / max(1, len(own))).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(index, pa.binary()), pa.array(share, pa.binary())], names=["label", "index", "share"])

    return texts.mapInArrow(run, "label string, index binary, share binary")


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, alpha: float = 0.5, beta: float = 1.0,
             l1: float = 0.2, l2: float = 0.02, epochs: int = 4, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Follow-the-regularised-leader (proximal) for multinomial logistic regression; weights and an unpenalised bias."""
    z, n = np.zeros((BUCKETS, classes)), np.zeros((BUCKETS, classes))
    bias, bias_n = np.zeros(classes), np.zeros(classes)

    def leader(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) > l1, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2), 0.0)

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            index, value = rows[i]
            zi, ni = z[index], n[index]
            w = leader(zi, ni)
            error = softmax(value @ w + bias)
            error[labels[i]] -= 1.0
            g = value[:, None] * error
            grown = ni + g * g
            z[index] = zi + g - (np.sqrt(grown) - np.sqrt(ni)) / alpha * w
            n[index] = grown
            bias_n += error * error
            bias -= alpha * error / (beta + np.sqrt(bias_n))
    return leader(z, n), bias


def fit_temperature(logits: np.ndarray, labels: np.ndarray, low: float = 0.25, high: float = 256.0) -> float:
    """Temperature of least negative log-likelihood, by golden-section search (1 without rows)."""
    if not len(labels):
        return 1.0

    def loss(log_t: float) -> float:
        x = logits / np.exp(log_t)
        x = x - x.max(axis=1, keepdims=True)
        return float((np.log(np.exp(x).sum(axis=1)) - x[np.arange(len(labels)), labels]).mean())

    a, b, ratio = np.log(low), np.log(high), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def held_out(key: Column) -> Column:
    """Documents that are never learned from: crc32 of the id as text leaves 1 after division by 3 (null id: false)."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 1500) -> LanguageModel | None:
    """Fit on rows with a text, a language and an id that is not held out; None if there are none.

    Document frequencies come from all of them. The regression sees a sample of about ``per_language`` documents a
    language (by a hash of the id; a repeated id counts once), a fifth of it held back for the temperature.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = rows.where(F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id")))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    languages = sorted(sizes)
    n, frequency = document_frequencies(rows.select("text"))
    idf = np.log((1 + n) / (1 + frequency)) + 1
    share = F.create_map(*[F.lit(x) for k, v in sizes.items() for x in (k, int(min(1.0, per_language / v) * 2**20))])
    fold = F.xxhash64(F.lit("language sample"), "id")
    drawn = rows.where(F.pmod(fold, F.lit(2**20)) < share[F.col("lang")]).groupBy("id", "lang").agg(F.min("text").alias("text"))
    sample = sorted((r["label"], bytes(r["index"]), bytes(r["share"])) for r in sparse_shares(drawn.select("lang", "text")).collect())
    number = {name: i for i, name in enumerate(languages)}
    labels = np.array([number[r[0]] for r in sample])
    features = []
    for _, index, part in sample:
        index = np.frombuffer(index, np.int32)
        features.append((index, np.frombuffer(part, np.float32) * idf[index] * SCALE))
    back = np.arange(len(sample)) % 5 == 4
    fit = np.flatnonzero(~back)
    weights, bias = fit_ftrl([features[i] for i in fit], labels[fit], len(languages))
    test = np.flatnonzero(back)
    logits = np.array([features[i][1] @ weights[features[i][0]] + bias for i in test]).reshape(len(test), len(languages))
    # n-grams of no learned language fall on buckets by chance: halfway between that and the rarest text held back
    rarity = np.array([np.frombuffer(part, np.float32) @ idf[np.frombuffer(index, np.int32)] for _, index, part in sample])
    rarest = (max(rarity[back] if back.any() else rarity, default=0.0) + idf.mean()) / 2
    return LanguageModel(languages, weights * (idf * SCALE)[:, None], bias, fit_temperature(logits, labels[test]), idf, float(rarest))


def identify(docs: DataFrame, model: LanguageModel | None, text: str = "text") -> DataFrame:
    """All columns of ``docs``, then three: ``__lang``, ``__score`` (calibrated probability of that language) and ``__usual``.

    A text that is null or has no letter, and every text if there is no model, is ``und`` with score 0 and not usual. A text is
    usual unless its n-grams are as rare on the whole as those of an unlearned language would be. Columns of ``docs`` pass
    as they are, whatever their names: a new name that is taken gets underscores behind it. Repeated rows stay repeated.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)
    lang, certainty, usual = (free_name(name, docs.columns) for name in ("__lang", "__score", "__usual"))
    rows = docs.withColumn(free_name("__letter", docs.columns), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    shape = T.StructType(list(docs.schema.fields)).add(lang, "string").add(certainty, "double").add(usual, "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            letter = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(bool)
            names, score, common = np.full(batch.num_rows, UNKNOWN, object), np.zeros(batch.num_rows), np.zeros(batch.num_rows, bool)
            for block in B.blocks(batch.column(at)) if model else ():
                best, p, near = model.predict(block)
                own = slice(block.row0, block.row0 + block.rows)
                names[own] = np.where(letter[own], np.array(model.languages, object)[best], UNKNOWN)
                score[own] = np.where(letter[own], p, 0.0)
                common[own] = letter[own] & near
            columns = [*batch.columns[:-1], pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(common)]
            yield pa.RecordBatch.from_arrays(columns, names=shape.names)

    return rows.mapInArrow(run, shape)
