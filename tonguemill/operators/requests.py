"""Rules on tables of translation requests, as projections and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonguemill.functions.languages import code_name, display_name, from_code_name
from tonguemill.functions.text import byte_count

# Default pair and messages.
DEFAULT_SOURCE, DEFAULT_TARGET = "en", "zh"
NOT_LOADED = "Llama.cpp 模型未加载，请在设置中配置 GGUF 路径。"
NOT_LOADED_STREAM = "Llama.cpp 模型未加载或无法推理，请在设置中配置有效的 GGUF 模型文件。"
CANCELLED = "已取消"
STOPPED_NOTE, STOPPED_NOTE_OCR = "\n\n[⏹ 翻译已被用户中断]", "\n\n[⏹ OCR 识别已被用户中断]"
ERROR_PREFIX, ERROR_PREFIX_OCR = "翻译出错: ", "识别出现提示/错误: "
RESPONSE = ("request_id", "success", "original_text", "translated_text", "error_message", "source_char_count", "target_char_count")


def apply_default_pair(df: DataFrame) -> DataFrame:
    """Null languages get the default pair; empty ones stay."""
    return df.withColumns({"source_lang": F.coalesce("source_lang", F.lit(DEFAULT_SOURCE)), "target_lang": F.coalesce("target_lang", F.lit(DEFAULT_TARGET))})


def _eligible():
    return from_code_name(F.col("target_lang")) != "AutoDetect"


def keep_eligible_targets(df: DataFrame) -> DataFrame:
    return df.where(_eligible())


def reject_ineligible_targets(df: DataFrame) -> DataFrame:
    return df.where(~_eligible())


def resolve_languages(df: DataFrame, column: str = "source_lang") -> DataFrame:
    """code, code name and display name of a code-name column, by the registry's rules for unknown ones."""
    code = from_code_name(F.col(column))
    return df.withColumns({"code": code, "code_name": code_name(code), "display_name": display_name(code)})


def respond(df: DataFrame, translated="translated_text", error="error_message", keep: tuple[str, ...] = ()) -> DataFrame:
    """Response records from request_id, text, a translation and an error (null: none), and the columns `keep`; failed ones carry no translation."""
    text, message = F.coalesce("text", F.lit("")), F.coalesce(F.col(error), F.lit(""))
    good = F.col(error).isNull()
    answer = F.when(good & (text != ""), F.coalesce(F.col(translated), F.lit(""))).otherwise("")
    source = F.when(text == "", F.lit(0).cast("bigint")).otherwise(byte_count(text))
    return df.select("request_id", good.alias("success"), text.alias("original_text"), answer.alias("translated_text"), message.alias("error_message"), source.alias("source_char_count"), byte_count(answer).alias("target_char_count"), *keep)


def gate_model(df: DataFrame, loaded, stream: bool = False) -> DataFrame:
    """error_message for rows whose model is not loaded; empty texts succeed all the same."""
    text = F.coalesce("text", F.lit(""))
    return df.withColumn("error_message", F.when((text != "") & ~loaded, NOT_LOADED_STREAM if stream else NOT_LOADED))


def task_status(df: DataFrame) -> DataFrame:
    """Status of a row by its error_message and translated_text."""
    return df.withColumn("status", F.when(F.col("error_message").isNotNull(), "Failed").when(F.col("translated_text").isNotNull(), "Completed").otherwise("Pending"))


def swap_direction(df: DataFrame) -> DataFrame:
    """Texts cross over; languages too unless the source is to be detected."""
    fixed = from_code_name(F.col("source_lang")) == "AutoDetect"
    swapped = {"text": F.col("translated_text"), "translated_text": F.col("text"), "source_lang": F.when(fixed, F.col("source_lang")).otherwise(F.col("target_lang")), "target_lang": F.when(fixed, F.col("target_lang")).otherwise(F.col("source_lang"))}
    return df.select(*(swapped[c].alias(c) if c in swapped else F.col(c) for c in df.columns))


def render_result(df: DataFrame, ocr: bool = False) -> DataFrame:
    """shown: what a user reads of success, full_text, raw_text and error_message."""
    note, prefix = (STOPPED_NOTE_OCR, ERROR_PREFIX_OCR) if ocr else (STOPPED_NOTE, ERROR_PREFIX)
    error = F.col("error_message")
    shown = F.when(F.col("success"), F.col("full_text")).when(error == CANCELLED, F.concat("raw_text", F.lit(note))).when(error != "", F.concat(F.lit(prefix), error)).otherwise(F.col("raw_text"))
    return df.withColumn("shown", shown)


def supersede_requests(df: DataFrame) -> DataFrame:
    """One running request a session: one that has not finished when the session's next starts is cancelled.

    Columns session_id, request_id, started_at, finished_at; adds cancelled and error_message.
    """
    from pyspark.sql import Window

    following = F.lead("started_at").over(Window.partitionBy("session_id").orderBy("started_at", "request_id"))
    cancelled = F.coalesce(following < F.col("finished_at"), F.lit(False))
    return df.withColumn("cancelled", cancelled).withColumn("error_message", F.when(F.col("cancelled"), CANCELLED).otherwise(""))
