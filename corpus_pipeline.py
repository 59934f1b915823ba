"""A training-corpus pipeline over `documents`: each stage's rows are written and read again as the next one's.

Null texts and texts without words pass the filters of lines, near duplicates and benchmark items; the classifier judges them by its bias
alone, as any text of which it knows no word. Repeated rows are judged alike, and of near duplicates, equal texts among them, the smallest id stays (of
equal rows one); very long texts are judged whole. An empty table passes every stage. Each stage returns the columns of documents, the last one
a row per remaining document with its tokens' digests.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonguemill.llm import bpe, decontam, lines, simhash, toxicity
from tonguemill.llm.common import documents, new_path, put_back, removed, row_key, scratch, set_aside, small_batches, written


def keeps_columns(stage):
    """The stage, with the documents' columns set aside that are named like those which operators add."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        docs, own = set_aside(docs, ("score", "predicted", "coverage", "item_id", "contaminated"))
        return put_back(stage(spark, docs, sf_dir), own)

    return run


@keeps_columns
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier (fitted on the labelled ones not held out) does not reject."""
    small_batches(spark)
    model = toxicity.fit(docs, documents(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where("predicted = 0").select(*docs.columns)


@keeps_columns
def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines and passages of over 50 words go, and documents of which nothing is left; n_chars follows the text."""
    left = lines.dedup(docs, drop_emptied=True, over=lines.PASSAGE)
    return left.select(*(F.char_length("text").cast("bigint").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


@keeps_columns
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (0.8 of five-word shingles) stays: the smallest id (rows equal in id and text once). Rows without words pass."""
    small_batches(spark)
    worded = F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    bare, docs = docs.where(~worded), docs.where(worded)
    keyed = docs.withColumn("_key", row_key(F.col("doc_id"), F.col("text")))
    found = written(simhash.similar_texts(docs.select(F.struct("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("k")).alias("doc_id"), "text"), words=5, similarity=0.8), "kept")
    stay = found.where("doc_id = component_id").select(F.col("doc_id.doc_id").alias("_id2"), F.col("doc_id.k").alias("_key2")).distinct()
    same = F.col("_key").eqNullSafe(F.col("_key2")) & F.col("doc_id").eqNullSafe(F.col("_id2"))
    return keyed.join(stay, same, "left_semi").dropDuplicates(["_key", "doc_id"]).select(*docs.columns).unionByName(bare)


@keeps_columns
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, whole or in pieces."""
    small_batches(spark)
    return decontam.flag(docs, documents(spark, sf_dir, "benchmark")).where("not contaminated").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of what is left, by their digests, checked by decoding them."""
    small_batches(spark)
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("toxicity", drop_toxic), ("line_dedup", dedup_lines), ("simhash", drop_near_duplicates), ("decontamination", decontaminate), ("byte_bpe", encode)]

#: A trained classifier and byte-pair encoding have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage writes on its way goes when its result is written, and that goes when the next one's is."""
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"stage-{name}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            removed(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
