"""Token logs: cut at stops, caps and cancels, and joined into texts. One shuffle by task serves them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonguemill.functions.text import trim_artifacts
from tonguemill.operators.merging import merged
from tonguemill.operators.requests import CANCELLED

MAX_TOKENS, CONTEXT = 4096, 4096
CONTEXT_OCR = 8192
#: Context of an engine that has no bound of its own.
UNBOUNDED = 1 << 62
#: Places of seq in a chunk of a running count.
CHUNK = 1 << 16
# Fixed values.
DECODE_ERROR, DECODE_ERROR_OCR = "Llama.cpp 解码推理失败 (llama_decode error)。", "解码 Token 失败 (llama_decode error)"


def split_codepoints(df: DataFrame, id_col: str = "task_id", text_col: str = "text") -> DataFrame:
    """task, seq (from 1), piece: one row a code point; empty texts have none."""
    return df.where(F.col(text_col) != "").select(F.col(id_col).alias("task_id"), F.posexplode(F.split(text_col, "")).alias("seq", "piece")).withColumn("seq", F.col("seq") + 1)


def _by_task():
    return Window.partitionBy("task_id")


def stop_at_control(tokens: DataFrame) -> DataFrame:
    """The pieces before a task's first control token."""
    first = F.min(F.when(F.col("is_control"), F.col("seq"))).over(_by_task())
    return tokens.withColumn("_stop", first).where(F.col("_stop").isNull() | (F.col("seq") < F.col("_stop"))).drop("_stop")


def cap_tokens(tokens: DataFrame, budgets: DataFrame, max_tokens: int = MAX_TOKENS, context: int = CONTEXT) -> DataFrame:
    """At most max_tokens pieces, and with the prompt at most `context`."""
    room = F.greatest(F.least(F.lit(max_tokens), context - F.coalesce("prompt_tokens", F.lit(0))), F.lit(0))
    ranked = tokens.withColumn("_n", F.row_number().over(_by_task().orderBy("seq")))
    return ranked.join(budgets.select("task_id", "prompt_tokens"), "task_id", "left").where(F.col("_n") <= room).select(*tokens.columns)


def running_char_count(tokens: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Adds n_chars: characters up to and with the piece. A task is counted in chunks of `chunk` places of seq: what the chunks before hold is summed over
    chunk totals, so a task of any length takes as many tasks of Spark as it has chunks. Pieces without a task_id get no count."""
    rows = tokens.withColumn("_chunk", F.floor((F.col("seq") - 1) / chunk))
    totals = rows.groupBy("task_id", "_chunk").agg(F.sum(F.char_length("piece")).alias("_n"))
    ahead = F.sum("_n").over(_by_task().orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1))
    before = totals.select(F.col("task_id").alias("_task"), F.col("_chunk").alias("_at"), ahead.alias("_before")).where("_before > 0")
    upto = Window.partitionBy("task_id", "_chunk").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = rows.withColumn("n_chars", F.sum(F.char_length("piece")).over(upto))  # dealt by task and chunk, as the join asks
    met = counted.join(before, (F.col("task_id") == F.col("_task")) & (F.col("_chunk") == F.col("_at")), "left")
    count = F.when(F.col("task_id").isNotNull(), F.col("n_chars") + F.coalesce("_before", F.lit(0)))
    return met.select(*tokens.columns, count.alias("n_chars"))


def assemble_streams(tokens: DataFrame, tasks: DataFrame, max_tokens: int | None = MAX_TOKENS, context: int = CONTEXT, ocr: bool = False, dense: bool = False) -> DataFrame:
    """A stream result for every task of `tasks` (task_id, prompt_tokens, cancel_after).

    Kept are the pieces before the first control token, up to max_tokens and to the room that the prompt
    leaves in the context, or exactly cancel_after of them where that is no more. With dense (seq counts from 1 without gaps)
    what no task has room for goes where it is read; the tasks' largest room, one number, is found first.

    With ocr there is no cap and the piece that no longer fits fails the task with what it has, itself included; the
    text of a cancelled task is not trimmed. A control token with an error_message (where tokens have that column) fails its task
    with what it has.
    """
    most, extra = (None, 1) if ocr else (max_tokens, 0)
    known = tasks.select("task_id", (context - F.coalesce(F.col("prompt_tokens"), F.lit(0)).cast("bigint")).alias("_room"), F.col("cancel_after").alias("_k"))
    note = [F.col("error_message").alias("note")] if "error_message" in tokens.columns else []
    rows = tokens.select("task_id", "seq", "piece", "is_control", *note)
    if dense:
        last = F.col("_room") + extra if most is None else F.least(F.lit(most), F.col("_room"))
        rows = rows.where(F.col("seq") <= known.agg(F.max(last)).scalar())
    rows = merged(rows, known, most, extra)
    broken = F.col("_room") < 0
    cancelled = ~broken & F.coalesce(F.col("_k") <= F.col("spoken"), F.lit(False))
    overrun = ~broken & ~cancelled & (F.col("spoken") > F.col("_room")) if ocr else F.lit(False)
    failed = ~broken & ~cancelled & F.col("note").isNotNull()
    n_tokens = F.when(cancelled, F.col("_k")).otherwise(F.col("spoken")).cast("int")
    reason = F.when(broken | overrun | failed, "error").when(cancelled, "cancelled")
    if not ocr:
        reason = reason.when(n_tokens == F.lit(max_tokens), "max_tokens").when(n_tokens == F.col("_room"), "context")
    reason = reason.when(F.col("stopped"), "control").otherwise("end")
    error = F.when(broken | overrun, DECODE_ERROR_OCR if ocr else DECODE_ERROR).when(cancelled, CANCELLED).when(failed, F.col("note")).otherwise("")
    rows = rows.select("task_id", "raw_text", cancelled.alias("_cancelled"), n_tokens.alias("n_tokens"), reason.alias("stop_reason"), error.alias("error_message"))
    text = F.when(F.col("_cancelled"), F.col("raw_text")).otherwise(trim_artifacts(F.col("raw_text"))) if ocr else trim_artifacts(F.col("raw_text"))
    return rows.select("task_id", (F.col("error_message") == "").alias("success"), text.alias("full_text"), "raw_text", "error_message", "n_tokens", "stop_reason")
