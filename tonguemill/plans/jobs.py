"""Whole batch jobs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonguemill.functions.text import char_count, ocr_prompt, trim_artifacts
from tonguemill.operators.balance import deal_by_cost
from tonguemill.operators.phrasebook import translate_phrasebook
from tonguemill.operators.requests import apply_default_pair, gate_model, respond
from tonguemill.operators.tokens import UNBOUNDED, assemble_streams
from tonguemill.plans.engines import BAD_IMAGE, NO_IMAGE, ReadingLate, answer_pieces, run_engine, run_engine_pieces
from tonguemill.sources.images import file_size
from tonguemill.sources.shared import stored

# Fixed value.
NOT_LOADED_OCR = "PaddleOCR-VL 主模型或 mmproj 视觉投影器未能成功加载，请检查文件路径"


def translate_batch(requests: DataFrame, book: DataFrame) -> DataFrame:
    """Responses of a phrasebook: one join (none with a broadcast book), the rest projections."""
    rows = translate_phrasebook(apply_default_pair(requests), book)
    return respond(rows.withColumn("error_message", F.lit(None).cast("string")))


def translate_batch_engine(requests: DataFrame, engine, partitions: int | None = None, collapse: bool = True) -> DataFrame:
    """Responses of a model engine; empty texts never reach it, and succeed where it does not load.

    With collapse (for deterministic engines) each distinct request is answered once and joined back,
    on its columns; empty texts are dealt by their own number, so they are no hot key.
    partitions deals the calls to so many tasks of nearly the same number of characters; what is asked is stored before.
    """
    rows = apply_default_pair(requests).withColumn("text", F.coalesce("text", F.lit("")))
    key = ["text", "source_lang", "target_lang"]
    asked = rows.where("text <> ''")
    asked = asked.select(*key).distinct() if collapse else asked
    if partitions:
        asked = stored(asked, "asked")
        asked = deal_by_cost(asked, F.char_length("text"), [F.col(c) for c in (key if collapse else ["request_id", *key])], partitions)
    answers = run_engine(asked, engine, "translate")
    if collapse:
        spread = rows.withColumn("_spread", F.when(F.col("text") == "", F.xxhash64("request_id")).otherwise(F.lit(0)))
        met = spread.join(answers.withColumn("_spread", F.lit(0).cast("bigint")), [*key, "_spread"], "left").drop("_spread")
    else:
        met = answers.unionByName(rows.where("text = ''").withColumns({"translated_text": F.lit(""), "engine_loaded": F.lit(True)}))
    return respond(gate_model(met, F.coalesce("engine_loaded", F.lit(False))))


def translate_batch_pieces(requests: DataFrame, engine, most: int | None = None, partitions: int | None = None) -> DataFrame:
    """Responses of an engine that answers piece by piece, each joined into a text by the task that asks for it; nothing is shuffled unless calls are dealt.

    Empty texts never reach the engine. Where it does not load, or fails on a text, the response says so. most cuts an answer off after so many pieces; partitions deals
    the calls as in translate_batch_engine.
    """
    rows = apply_default_pair(requests).drop("translated_text", "error_message").withColumn("text", F.coalesce("text", F.lit("")))
    asked = rows.where("text <> ''")
    if partitions:
        asked = deal_by_cost(stored(asked, "asked"), F.char_length("text"), [F.col("request_id")], partitions)
    answers = answer_pieces(asked, engine, most=most).withColumn("translated_text", trim_artifacts(F.col("translated_text")))
    return respond(answers.unionByName(rows.where("text = ''").withColumns({"translated_text": F.lit(""), "error_message": F.lit(None).cast("string")})))


def gate_images(manifest: DataFrame, images: DataFrame) -> DataFrame:
    """Manifest rows (path, task_type) with length, and error_message where the file is missing. Lengths come from the listing (path, length); the
    tasks look for the files that it lacks, as empty ones, by themselves."""
    found = images.groupBy("path").agg(F.max("length").alias("length"))
    met = manifest.join(found, "path", "left")

    def look(batches):
        for rows in batches:
            yield rows.assign(length=pd.array([file_size(p) for p in rows["path"]], dtype="Int64"))

    asked = F.col("length").isNull() & F.col("path").isNotNull()
    known = met.where(~asked).unionByName(met.where(asked).mapInPandas(look, met.schema))
    missing = F.concat(F.lit(NO_IMAGE), F.coalesce("path", F.lit("")), F.lit(")"))
    return known.withColumn("error_message", F.when(F.col("length").isNull(), missing))


def recognize_batch(manifest: DataFrame, images: DataFrame, engine, partitions: int | None = None, pieces: bool = False, by_content: bool = False) -> DataFrame:
    """path, success, text, error_message, n_chars for every row of the manifest (path unique there).

    images lists files (path, length). Only paths are joined and dealt, to `partitions` tasks (as many as shuffles have, unless given) of about the same number of image
    bytes; a task checks a file's header and reads its bytes itself, so no shuffle or broadcast ever holds them. Workers must be able to open the
    paths through pyarrow's file systems. Files that are no whole image of the format in their name (by_content: of any format), or that the engine cannot
    read, fail alike. With pieces the engine's pieces are assembled, without a cap.
    """
    spark = manifest.sparkSession
    gated = stored(gate_images(manifest, images).withColumn("prompt", ocr_prompt(F.col("task_type"))), "gated")
    good = gated.where("error_message is null").drop("error_message")
    dealt = deal_by_cost(good, F.col("length"), [F.col("path")], partitions or int(spark.conf.get("spark.sql.shuffle.partitions")))
    late = ReadingLate(engine, by_content)
    if pieces:
        said = run_engine_pieces(dealt, late, "recognize_pieces", "path", not_loaded=NOT_LOADED_OCR).where("event <> 'end'")
        tasks = good.select(F.col("path").alias("task_id"), F.lit(0).alias("prompt_tokens"), F.lit(None).cast("int").alias("cancel_after"))
        seen = assemble_streams(said, tasks, context=UNBOUNDED, ocr=True).select(F.col("task_id").alias("path"), F.when(F.col("error_message") == "", F.col("full_text")).alias("text"), F.nullif("error_message", F.lit("")).alias("error_message"))
    else:
        unread = F.concat(F.lit(BAD_IMAGE), "path", F.lit(")"))
        seen = run_engine(dealt, late, "recognize", "text")
        seen = seen.select("path", "text", F.when(~F.col("engine_loaded"), NOT_LOADED_OCR).when(F.col("text").isNull(), unread).alias("error_message"))
    bad = gated.where("error_message is not null").select("path", F.lit("").alias("text"), "error_message")
    text = trim_artifacts(F.coalesce("text", F.lit("")))
    return seen.unionByName(bad).select("path", F.col("error_message").isNull().alias("success"), text.alias("text"), F.coalesce("error_message", F.lit("")).alias("error_message"), char_count(text).alias("n_chars"))
