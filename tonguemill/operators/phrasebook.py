"""Phrasebooks and translation memories: exact lookups by join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Phrases, and the forms of an answer without a phrase. NAME, the product in them, is the caller's.
PHRASES = (("Hello World", "你好，世界"), ("Text Translation", "文本翻译"), ("Domain Driven Design", "领域驱动设计"), ("Artificial Intelligence", "人工智能"))
NAME = "磨坊"
ANSWER_OPEN, PREVIEW, PREVIEW_LLM = "[译文] ", "即时译文: ", "即时译文 (Llama.cpp): "


def answer_close(name: str = NAME) -> str:
    return f" (已由{name}引擎翻译)"


def greeting(name: str = NAME) -> str:
    return f"你好，欢迎使用{name}！"


def phrasebook(spark: SparkSession, more: tuple = ()) -> DataFrame:
    """The neutral phrases and the caller's own; phrases that name a product are the caller's (see product_phrases)."""
    return spark.createDataFrame([*PHRASES, *more], "source_text string, translated_text string")


def product_phrases(name: str, translated: str, greetings: tuple[str, ...] = ()) -> tuple:
    """Phrases that name a product: its name and a welcome, for each name given."""
    return ((name, translated), *((f"Hello, welcome to {n}!", f"你好，欢迎使用{translated}翻译器！") for n in (name, *greetings)))


def latest(book: DataFrame, version: str = "version") -> DataFrame:
    """One translation a source text: that of the highest version. Pre-aggregates, so hot texts do no harm."""
    return book.groupBy("source_text").agg(F.max_by("translated_text", version).alias("translated_text"))


def _met(requests: DataFrame, book: DataFrame) -> DataFrame:
    """Requests with `_phrase`, by hash and text; Spark broadcasts the book where its size allows.

    Empty texts, which need no phrase, are dealt by a hash of their id, so they never meet in one task.
    """
    side = book.select(F.xxhash64("source_text").alias("_hash"), "source_text", F.col("translated_text").alias("_phrase"))
    text = F.coalesce("text", F.lit(""))
    rows = requests.withColumn("_h", F.when(text == "", F.xxhash64("request_id")).otherwise(F.xxhash64(text)))
    return rows.join(side, (F.col("_h") == F.col("_hash")) & (text == F.col("source_text")), "left").drop("_h", "_hash", "source_text")


def answer(text: Column, phrase: Column, name: str = NAME) -> Column:
    """What a text is answered with, given its phrase (null: none)."""
    return F.when(text == "", "").otherwise(F.coalesce(phrase, F.concat(F.lit(ANSWER_OPEN), text, F.lit(answer_close(name)))))


def translate_phrasebook(requests: DataFrame, book: DataFrame, name: str = NAME) -> DataFrame:
    """Adds translated_text; the book has one row a source text."""
    said = answer(F.coalesce("text", F.lit("")), F.col("_phrase"), name)
    return _met(requests, book).withColumn("translated_text", said).drop("_phrase")


def quick_preview(requests: DataFrame, book: DataFrame, llm: bool = False, name: str = NAME) -> DataFrame:
    """Adds preview."""
    text = F.coalesce("text", F.lit(""))
    if llm:
        return requests.withColumn("preview", F.when(text == "", "").otherwise(F.concat(F.lit(PREVIEW_LLM), text)))
    preview = F.when(text == "", "").when(F.col("_phrase").isNotNull(), F.col("_phrase")).when(F.contains(text, F.lit("Hello")), greeting(name)).otherwise(F.concat(F.lit(PREVIEW), text))
    return _met(requests, book).withColumn("preview", preview).drop("_phrase")
