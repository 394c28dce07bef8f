"""From raw documents to packed sequences: language ID, line dedup, near-duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet to the shared
folder and gives the reread table to the next stage. All stages but the last keep the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from redactframe.llm import decontaminate, jaccard, langid, line_dedup, packing
from redactframe.llm.queries import tokenizer_path
from redactframe.llm.store import free_name, table, written


def _own(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``lang`` becomes the language that the model finds, whatever was given, null included.

    Rejects texts that are null or without a letter, and texts whose n-grams are as rare as those of a language that was not learned.
    """
    found = langid.identify(docs, langid.train(docs))
    lang, usual = found.columns[-3], found.columns[-1]
    kept = found.where((F.col(lang) != langid.UNKNOWN) & F.col(usual))
    return kept.withColumn("lang", F.col(lang)).select(_own(docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the long lines that five or more documents share; n_chars follows. A text may become empty."""
    cut = line_dedup.dedup_lines(docs).select(_own(docs))
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component stays, that with the smallest id; of rows that repeat this id, that with the smallest row hash.

    Documents at a Jaccard similarity of 0.8 or more, by shingles of five words, are linked; the search is exact.
    Rows without an id link no others and stay.
    """
    named = docs.where(F.col("doc_id").isNotNull())
    found = jaccard.near_duplicates(named)
    heads = found.groupBy("root").agg(F.min(F.struct("id", "row")).alias("r")).select(F.col("r.id").alias("id"), F.col("r.row").alias("row"))
    own = free_name("__row", docs.columns)
    numbered = named.withColumn(own, jaccard.row_hash(named))
    # rows that repeat as a whole are one
    chosen = numbered.join(heads, (numbered["doc_id"] == heads["id"]) & (numbered[own] == heads["row"]), "left_semi")
    kept = chosen.dropDuplicates(["doc_id", own])
    return kept.select(_own(docs)).unionByName(docs.where(F.col("doc_id").isNull()))


def remove_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold any 10-word window of a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of the documents left, placed in sequences of at most 1024 tokens, with the document's language."""
    placed = packing.pack(docs, tokenizer_path(), keep=("lang",))
    return placed.select(F.col("id").alias("doc_id"), "piece", "start", "length", F.col("crc").alias("ids_crc32"), F.col("sequence").alias("sequence_id"), "offset", "lang")


STAGES = [
    ("language ID", language_id), ("line dedup", dedup_lines), ("near-dedup", near_dedup),
    ("benchmark decontamination", remove_benchmarks), ("best-fit packing", pack_sequences),
]

#: A trained model, XXH64 fingerprints and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.lower().replace(" ", "-"))
    return written(STAGES[-1][1](spark, docs, sf_dir), "packed")
