"""From documents to token ids: five stages, each written as Parquet and read again by the next.

Quality classifier, near-dedup by SimHash and shingle similarity, suffix-array dedup, mixing to source weights, byte-level BPE. Every
stage takes ``(spark, docs, sf_dir)`` and works on all rows that its predecessor kept; all but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import bpe, jaccard, knn_quality, mixing, queries, suffix
from palimpsest.llm.common import cut, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest-neighbour classifier accepts. Labels of all ids but those held out teach it."""
    model = queries.quality_model(docs, table(spark, sf_dir, "labels"))
    return docs.where(knn_quality.score(F.col("text"), model, spark) >= 0.5)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near copies.

    Operator 2's fingerprints and trees find texts that differ in 4 bits or fewer; since that misses most pairs of a similarity of 0.8, minhash
    bands find others. An exact check follows for both: sets of 5-word shingles with a similarity of 0.8 or more.
    """
    return jaccard.keep_one(docs, words=5, radius=4)


def repeat_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without 50-byte strings that start in a document of a smaller id."""
    found = suffix.remove_repeats(docs, length=50)
    changed = found.withColumn("text", F.when(F.col("n_removed") > 0, suffix.valid_text(F.col("kept"))).otherwise(F.col("text")))
    return changed.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as source weights 5, 2, 1 ask for; some not at all."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all rows, and whether decoding gives back their bytes."""
    path, pattern = public_tokenizers.path(queries.BPE_RANKS), public_tokenizers.PATTERN
    back = bpe.round_trip_rows(docs.select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text")), path, pattern)
    return back.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.col("decoded") == F.encode("text", "utf-8")).alias("round_trip"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("repeat_dedup", repeat_dedup), ("mix", mix), ("encode", encode)]

#: Shingle sets and merges by rank have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
