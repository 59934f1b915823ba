"""Large translation memories: stored once in buckets of their text hash, with a filter that spares the shuffle what cannot hit.

The filter is a register-blocked Bloom filter as a table: a text's hash names one of WORDS words of 64 bits and three bits in it. It has at most WORDS rows (some
16 MB), so it may be broadcast whatever the memory's size; at 5 million texts about one in a hundred others passes it, at 20 million one in five. Texts that
pass and are not there cost a place in the shuffle, nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonguemill.operators.phrasebook import NAME, answer

WORDS = 1 << 20


def _word(h: Column) -> Column:
    return h.bitwiseAND(F.lit(WORDS - 1)).cast("int")


def _mask(h: Column) -> Column:
    bit = lambda shift: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(63)).cast("int"))
    return bit(20).bitwiseOR(bit(26)).bitwiseOR(bit(32))


def store_memory(book: DataFrame, table: str, buckets: int = 64, path: str | None = None) -> None:
    """Files book (source_text, translated_text; one row a text, see phrasebook.latest) as `table` and its filter as `table`_filter; below path, if given, else in the
    warehouse. Null texts are left out: nothing asks for them."""
    key = ["hash", "source_text"]
    rows = book.where("source_text is not null").select(F.xxhash64("source_text").alias("hash"), "source_text", "translated_text")
    place = lambda df, name: df.write.mode("overwrite").option("path", f"{path}/{name}") if path else df.write.mode("overwrite")
    place(rows.repartition(buckets, *key), "memory").bucketBy(buckets, *key).sortBy(*key).saveAsTable(table)
    kept = book.sparkSession.table(table)
    place(kept.groupBy(_word(F.col("hash")).alias("word")).agg(F.bit_or(_mask(F.col("hash"))).alias("bits")), "filter").saveAsTable(f"{table}_filter")


def translate_memory(requests: DataFrame, table: str, name: str = NAME) -> DataFrame:
    """Adds translated_text, as translate_phrasebook does with the book that was stored. Only texts that pass the filter are shuffled, into the memory's buckets; the
    memory is read where it lies."""
    spark: SparkSession = requests.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = requests.withColumn("_h", F.xxhash64(text))
    met = rows.join(F.broadcast(spark.table(f"{table}_filter")), _word(F.col("_h")) == F.col("word"), "left")
    may = (text != "") & F.coalesce(F.col("bits").bitwiseAND(_mask(F.col("_h"))) == _mask(F.col("_h")), F.lit(False))
    asked = met.where(may).drop("word", "bits")
    memory = spark.table(table).withColumnRenamed("translated_text", "_phrase")
    # each text is looked up once, so one that a third of the requests share is no hot bucket; its requests meet it in a join that Spark can split
    buckets = int(spark.sql(f"DESCRIBE EXTENDED {table}").where("col_name = 'Num Buckets'").first().data_type)
    wanted = asked.select(F.col("_h").alias("_h2"), F.col("text").alias("_text")).distinct().repartition(buckets, "_h2", "_text")
    hits = wanted.join(memory, (F.col("_h2") == F.col("hash")) & (F.col("_text") == F.col("source_text"))).select("_h2", "_text", "_phrase")
    found = asked.join(hits, (F.col("_h") == F.col("_h2")) & (F.col("text") == F.col("_text")), "left").drop("_h2", "_text")
    rest = met.where(~may).drop("word", "bits").withColumn("_phrase", F.lit(None).cast("string"))
    return found.unionByName(rest).withColumn("translated_text", answer(text, F.col("_phrase"), name)).drop("_phrase", "_h")
