"""Quality classifier: supervised subword embeddings.

Words and character n-grams are hashed to learned vectors; a document is their average, a softmax over two classes
reads it. Vectors and softmax are trained together by stochastic gradient descent in numpy on a bounded sample of
labelled rows. Averaging is linear, so a trained model folds into one number per bucket, and scoring a whole text is
a look-up and a mean.
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
from redactframe.llm.store import small_batches

BUCKETS = 1 << 17
ORDERS = (3, 4)
#: A word counts as several n-grams, which are many more than words.
WORD_WEIGHT = 3.0
#: Bucket of the token for a word that repeats the one before it.
REPEATED = 1


def block_features(block: B.Block) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Bucket of each word, word repetition and n-gram in text order, each text's first one, and a weight."""
    starts, ends, bounds = B.runs(B.NOT_SPACE[block.data], block.offsets)
    words = (B.span_hashes(block.data, starts, ends) >> np.uint64(64 - 17)).astype(np.intp)
    # a word said twice running is one token of its own, whatever the word
    again = np.flatnonzero((words[1:] == words[:-1]) & (B.owner(bounds)[1:] == B.owner(bounds)[:-1])) + 1
    repeated = np.full(len(again), REPEATED, np.intp), np.searchsorted(again, bounds)
    points, offsets = G.decode(block.data, block.offsets)
    points, offsets = G.pad(points, offsets, (points == 0x20) | ((points >= 9) & (points <= 13)))
    return [(words, bounds, WORD_WEIGHT), (*repeated, WORD_WEIGHT), *((h, first, 1.0) for h, first in G.hashed(points, offsets, ORDERS, BUCKETS))]


@dataclass
class QualityModel:
    folded: np.ndarray  # each bucket's vector times the difference of the softmax rows
    bias: float

    def score(self, block: B.Block) -> np.ndarray:
        total, weight = np.zeros(block.rows), np.zeros(block.rows)
        for bucket, first, w in block_features(block):
            total += w * G.segment_sums(self.folded[bucket], first)
            weight += w * np.diff(first)
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(weight, 1e-9) + self.bias, -30, 30)))


def bags(rows: DataFrame) -> DataFrame:
    """``label``, ``index``, ``share`` of (label, text) rows: a document's buckets and their shares, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, share = [], []
            for block in B.blocks(batch.column(1)):
                parts = block_features(block)
                for t in range(block.rows):
                    own = [b[first[t]:first[t + 1]] for b, first, _ in parts]
                    total = np.bincount(np.concatenate(own), np.concatenate([np.full(len(o), p[2]) for o, p in zip(own, parts, strict=True)]), BUCKETS)
                    used = np.flatnonzero(total)
                    index.append(used.astype(np.int32).tobytes())
                    share.append((total[used] / max(total.sum(), 1e-9)).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(index, pa.binary()), pa.array(share, pa.binary())], names=["label", "index", "share"])

    return rows.mapInArrow(run, "label int, index binary, share binary")


def fit_sgd(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, dims: int = 16, epochs: int = 6, rate: float = 2.0, seed: int = 5) -> QualityModel:
    """Softmax regression over averaged vectors, both learned by stochastic gradient descent with a falling rate."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dims, 1 / dims, (BUCKETS, dims)).astype(np.float32)
    out, bias = np.zeros((2, dims), np.float32), np.zeros(2, np.float32)
    step, steps = 0, max(1, epochs * len(rows))
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            index, share = rows[i]
            now = np.float32(rate * (1 - step / steps))
            step += 1
            own = vectors[index]
            hidden = share @ own
            logits = out @ hidden + bias
            e = np.exp(logits - logits.max())
            error = e / e.sum()
            error[labels[i]] -= 1
            back = error @ out
            out -= now * error[:, None] * hidden
            bias -= np.float32(0.05) * now * error
            # a bucket's share of the mean is small; its own share scales its step up to a plain average's
            vectors[index] = own - now * (share * len(share))[:, None] / max(1.0, np.sqrt(len(share))) * back
    return QualityModel((vectors @ (out[1] - out[0])).astype(np.float64), float(bias[1] - bias[0]))


def held_out(key: Column) -> Column:
    """Rows whose labels are never learned: crc32 of the id as text divides by 5 (null id: false)."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label_key: str = "doc_id", label: str = "quality",
          per_class: int = 4000) -> QualityModel | None:
    """Fit on about ``per_class`` labelled documents of each class, drawn by a hash of the id; None without any.

    Labels that are null, or belong to a null or held-out id, are left out. An id with several labels takes the
    lowest, a repeated id counts once (its smallest text). A null text is empty.
    """
    known = labels.where(F.col(label_key).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(label_key)))
    known = known.groupBy(F.col(label_key).alias("id")).agg(F.min(F.when(F.col(label) > 0, 1).otherwise(0)).alias("label"))
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    share = F.when(F.col("label") == 1, int(min(1.0, per_class / max(1, sizes.get(1, 0))) * 2**20)).otherwise(int(min(1.0, per_class / max(1, sizes.get(0, 0))) * 2**20))
    drawn = known.where(F.pmod(F.xxhash64(F.lit("quality sample"), "id"), F.lit(2**20)) < share)
    # about 2 x per_class rows of two numbers, whatever the tables' sizes
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(drawn), "id")
    rows = rows.groupBy("id", "label").agg(F.min("text").alias("text")).select("label", "text")
    sample = sorted((r["label"], bytes(r["index"]), bytes(r["share"])) for r in bags(rows).collect())
    if not sample:
        return None
    model = fit_sgd([(np.frombuffer(i, np.int32), np.frombuffer(s, np.float32)) for _, i, s in sample], np.array([r[0] for r in sample]))
    # the sample's classes are drawn to be even: put the true shares back
    drawn_good = sum(r[0] for r in sample)
    odds = np.log(max(1, sizes.get(1, 0)) / max(1, sizes.get(0, 0))) - np.log(max(1, drawn_good) / max(1, len(sample) - drawn_good))
    return QualityModel(model.folded, model.bias + float(odds))


def score(docs: DataFrame, model: QualityModel | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``id`` and ``score`` (0 to 1) of every document; null and empty texts get the bias alone, 0.5 without a model."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    shape = T.StructType([T.StructField("id", docs.schema[key].dataType)]).add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [sent.value.score(b) for b in B.blocks(batch.column(1))] if sent.value else [np.full(batch.num_rows, 0.5)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(parts) if parts else [], pa.float64())], names=["id", "score"])

    return docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(run, shape)
