"""Quality rules with an isolation forest over rule statistics.

One pass over the texts computes the rule statistics, a narrow table that all later steps read. The forest's trees
are grown on the driver from a bounded sample of those rows, as the method has it (a few hundred rows a tree);
every document's path length is then computed in the tasks. Its threshold comes from the scores of all labelled
documents, counted in score bins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from redactframe.llm import blocks as B
from redactframe.llm.store import small_batches, written

_SYMBOLS = B.byte_set(b"#*$%&|<>")
_UPPER = B.byte_set(bytes(range(0x41, 0x5B)))
_MARKS = B.byte_set(b"!?.,;:")
_SALT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]

#: Statistics of the base rules, then further ones that only the forest reads.
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FURTHER = ("n_chars", "n_upper", "n_marks", "n_distinct_words")
SCORE_BINS = 2000


def _repeats(keys: np.ndarray) -> np.ndarray:
    """Which of the values occur more than once."""
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(keys), bool)
    return twice[np.minimum(np.searchsorted(twice, keys), len(twice) - 1)] == keys


def _distinct(keys: np.ndarray, texts: np.ndarray, n: int) -> np.ndarray:
    """Number of different keys of each text."""
    order = np.lexsort((keys, texts))
    keys, texts = keys[order], texts[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (texts[1:] != texts[:-1])
    return np.bincount(texts[new], minlength=n)


def block_statistics(block: B.Block) -> dict[str, np.ndarray]:
    data, offsets, n = block.data, block.offsets, block.rows
    solid = B.NOT_SPACE[data]
    starts, ends, bounds = B.runs(solid, offsets)
    lead = (data & 0xC0) != 0x80
    count = lambda mask: B.per_text(mask.astype(np.int64), offsets)
    words = B.span_hashes(data, starts, ends)
    text = B.owner(bounds)
    repeat = np.zeros(len(words), bool)
    if len(words) > 2:
        with np.errstate(over="ignore"):
            window = B.mix(words[:-2] * _SALT[0] + words[1:-1] * _SALT[1] + words[2:] * _SALT[2] + text[:-2].astype(np.uint64) * _SALT[0])
        inside = text[2:] == text[:-2]
        again = np.zeros(len(words), bool)
        again[:-2][inside] = _repeats(window[inside])
        repeat = again.copy()
        repeat[1:] |= again[:-1]
        repeat[2:] |= again[:-2]
    line_starts, line_ends, line_bounds = B.lines(data, offsets)
    solid_before = np.concatenate(([0], np.cumsum(solid)))
    filled = solid_before[line_ends] > solid_before[line_starts]
    lines = B.span_hashes(data, line_starts[filled], line_ends[filled])
    line_text = B.owner(line_bounds)[filled]
    return {
        "n_words": np.diff(bounds), "word_chars": count(lead & solid), "n_symbols": count(_SYMBOLS[data]),
        "n_dup_lines": np.bincount(line_text, minlength=n) - _distinct(lines, line_text, n),
        "n_repeat_words": B.per_text(repeat.astype(np.int64), bounds), "n_chars": count(lead),
        "n_upper": count(_UPPER[data]), "n_marks": count(_MARKS[data]), "n_distinct_words": _distinct(words, text, n),
    }


def statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``id`` and the statistics of every whole text; a null or empty text has no words and no symbols."""
    small_batches(docs.sparkSession)
    names = (*BASE, *FURTHER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [block_statistics(b) for b in B.blocks(batch.column(1))]
            columns = [pa.array(np.concatenate([p[c] for p in parts]) if parts else [], pa.int64()) for c in names]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", *names])

    shape = T.StructType([T.StructField("id", docs.schema[key].dataType)])
    for c in names:
        shape = shape.add(c, "long")
    return docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(run, shape)


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    """The forest's inputs: shares and means, so that a text's length alone is no anomaly.

    Repeated lines and digits are left out: boilerplate and numbers stand in good documents too, and every input that
    varies without meaning makes the splits on the others rarer.
    """
    f = {k: np.asarray(v, float) for k, v in s.items()}
    words, chars = (np.maximum(f[c], 1) for c in ("n_words", "n_chars"))
    return np.stack([
        f["word_chars"] / words, f["n_symbols"] / chars, f["n_repeat_words"] / words, f["n_upper"] / chars, f["n_marks"] / words,
        np.log1p(f["n_distinct_words"]) / np.log1p(words),
    ], axis=1)


def _average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search in a binary tree of n rows."""
    n = np.asarray(n, float)
    full = 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1)
    return np.where(n > 2, full, np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Trees as arrays of nodes: split feature (-1 at a leaf), threshold, left child (the right one follows it), path length."""

    feature: np.ndarray  # trees x nodes
    threshold: np.ndarray
    left: np.ndarray
    path: np.ndarray
    rows: int

    @classmethod
    def grow(cls, sample: np.ndarray, trees: int, rows: int, seed: int = 11) -> Forest:
        rng = np.random.default_rng(seed)
        rows = min(rows, len(sample))
        depth = int(np.ceil(np.log2(max(rows, 2))))
        size = 2 ** (depth + 1) + 1
        feature, left = np.full((trees, size), -1), np.zeros((trees, size), int)
        threshold, path = np.zeros((trees, size)), np.zeros((trees, size))
        for t in range(trees):
            todo, used = [(0, sample[rng.choice(len(sample), rows, replace=False)], 0)], 1
            while todo:
                node, part, level = todo.pop()
                low, high = part.min(axis=0), part.max(axis=0)
                can = np.flatnonzero(high > low)
                if level == depth or len(part) < 2 or not len(can):
                    path[t, node] = level + _average_path(len(part))
                    continue
                k = rng.choice(can)
                cut = rng.uniform(low[k], high[k])
                feature[t, node], threshold[t, node], left[t, node] = k, cut, used
                goes = part[:, k] < cut
                if not goes.any():  # rounding put the cut on the lowest value
                    goes = part[:, k] == low[k]
                    threshold[t, node] = np.nextafter(low[k], np.inf)
                todo += [(used, part[goes], level + 1), (used + 1, part[~goes], level + 1)]
                used += 2
        return cls(feature, threshold, left, path, rows)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly of each row, 0 to 1: rows that random splits part early score high."""
        total, at = np.zeros(len(x)), np.arange(len(x))
        for feature, threshold, left, path in zip(self.feature, self.threshold, self.left, self.path, strict=True):
            node, open_ = np.zeros(len(x), int), at
            while len(open_ := open_[feature[node[open_]] >= 0]):
                own = node[open_]
                node[open_] = left[own] + (x[open_, feature[own]] >= threshold[own])
            total += path[node]
        return 2.0 ** (-total / len(self.feature) / max(float(_average_path(self.rows)), 1e-9))


def best_threshold(good: np.ndarray, bad: np.ndarray, least_kept: float) -> float:
    """Score above which a document fails, from label counts by score bin.

    Among the cuts that keep at least ``least_kept`` of the good rows, the one with the most bad rows above it less
    the share of good ones; the highest of equal cuts. Without bad rows nothing fails.
    """
    if not bad.sum():
        return 1.0
    kept = np.cumsum(good) / max(1, good.sum())
    caught = 1 - np.cumsum(bad) / bad.sum()
    gain = np.where(kept >= least_kept, caught - (1 - kept), -np.inf)
    return (len(gain) - int(np.argmax(gain[::-1]))) / len(gain)


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label_key: str = "doc_id", label: str = "quality",
          trees: int = 200, tree_rows: int = 64, sample_rows: int = 20_000, least_kept: float = 0.99) -> DataFrame:
    """``id``, the base statistics, ``base_failed``, ``anomaly`` and ``kept`` of every document.

    The forest grows from about ``sample_rows`` rows (drawn by a hash of their statistics, equal ones once) that pass the base rules. The threshold reads
    every labelled document that passes them; each label row counts, null ids and labels do not. Without any sample
    or label row the base rules alone decide. Repeated documents stay repeated.
    """
    table = written(statistics(docs, key, text), "rules")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    table = table.withColumn("base_failed", failed)
    passing = table.where(~F.col("base_failed"))
    share = min(1.0, sample_rows / max(1, passing.count()))
    names = (*BASE, *FURTHER)
    drawn = passing.where(F.pmod(F.xxhash64(F.lit("forest"), *names), F.lit(2**20)) < int(share * 2**20)).select(*names)
    rows = drawn.distinct().toArrow().sort_by([(c, "ascending") for c in names])
    sample = features({c: rows.column(c).to_numpy() for c in names})
    forest = Forest.grow(sample, trees, tree_rows) if len(sample) else None
    sent = docs.sparkSession.sparkContext.broadcast(forest)
    shape = T.StructType(list(table.schema.fields)).add("anomaly", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features({c: batch.column(c).to_numpy() for c in names})
            score = sent.value.score(x) if sent.value else np.zeros(len(x))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], names=shape.names)

    scored = written(table.mapInArrow(run, shape), "anomalies")
    known = labels.select(F.col(label_key).alias("id"), F.col(label).alias("label")).where("id is not null and label is not null")
    bins = F.least(F.floor(F.col("anomaly") * SCORE_BINS), F.lit(SCORE_BINS - 1)).cast("int")
    counts = scored.where(~F.col("base_failed")).select("id", bins.alias("bin")).join(known, "id").groupBy("bin").agg(
        F.count(F.when(F.col("label") > 0, 1)).alias("good"), F.count(F.when(F.col("label") <= 0, 1)).alias("bad"))
    good, bad = np.zeros(SCORE_BINS), np.zeros(SCORE_BINS)
    for r in counts.collect():  # at most SCORE_BINS rows
        good[r["bin"]], bad[r["bin"]] = r["good"], r["bad"]
    threshold = best_threshold(good, bad, least_kept)
    kept = ~F.col("base_failed") & (F.col("anomaly") < F.lit(threshold) if threshold < 1 else F.lit(True))
    return scored.select("id", *BASE, "base_failed", "anomaly", kept.alias("kept"))
