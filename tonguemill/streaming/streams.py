"""Streaming forms: requests answered as they come, token events assembled as they end."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tonguemill.operators.history import admit_history, append_history
from tonguemill.operators.merging import Run, packed
from tonguemill.operators.phrasebook import translate_phrasebook
from tonguemill.operators.requests import CANCELLED, RESPONSE, apply_default_pair, respond
from tonguemill.operators.tokens import CONTEXT, DECODE_ERROR, MAX_TOKENS

RESULT = "task_id bigint, success boolean, full_text string, raw_text string, error_message string, n_tokens int, stop_reason string"
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@contextmanager
def state_store(spark: SparkSession):
    """The state store that stream_assemble needs, set for the session while a query starts and runs, and then as before."""
    name, value = STATE_STORE
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def stream_translate(requests: DataFrame, book: DataFrame, responses: str, history: str, checkpoint: str):
    """Answers a stream of requests and files the good ones in a history. Each batch overwrites its own responses and is filed once, so a replay repeats nothing."""

    def batch(rows: DataFrame, number: int) -> None:
        rows = translate_phrasebook(apply_default_pair(rows), book).withColumns({"error_message": F.lit(None).cast("string"), "ts": F.current_timestamp()})
        answered = respond(rows, keep=("source_lang", "target_lang", "ts")).persist()
        answered.select(*RESPONSE).write.mode("overwrite").parquet(f"{responses}/batch={number}")
        append_history(admit_history(answered, streamed=True), history, batch=f"{checkpoint}#{number}")
        answered.unpersist()

    return requests.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Events that end a task; the others are tokens.
ENDS = ("cancel", "end", "error")


class _Assemble(StatefulProcessor):
    """A task's events in the order of seq, whatever the order they come in; they come as runs (`packed`), whose event is null for pieces.

    `kept` holds what the pieces up to the frontier say, the first seq that has not come; it is appended to and read once, when the task ends. `waiting` holds what lies beyond
    it, by seq. What no room or cap lets a task use is never stored, so its state is at most the cap and one event. A task whose events all come at once asks
    the state twice and leaves only the mark that it has ended.
    """

    def __init__(self, max_tokens: int, context: int, ttl: int | None):
        self.max_tokens, self.context, self.ttl = max_tokens, context, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        event = "piece string, is_control boolean, event string, prompt_tokens int, error_message string"
        self.kept = handle.getListState("kept", "piece string", self.ttl)
        self.waiting = handle.getMapState("waiting", "seq bigint", event, self.ttl)
        self.place = handle.getValueState("place", "n bigint, waits bigint", self.ttl)
        self.ended = handle.getValueState("ended", "done boolean", self.ttl)

    def _reason(self, n: int, event: str | None, prompt_tokens: int) -> str | None:
        """Why a task with n pieces ends at this event, if it does."""
        room = self.context - prompt_tokens
        if room < 0:  # the prompt is refused before anything is said
            return "error"
        if event == "cancel":
            return "cancelled"
        if n >= self.max_tokens:
            return "max_tokens"
        return "context" if n >= room else event

    def handleInputRows(self, key, rows: Iterator[Row], timer) -> Iterator[Row]:
        longest = {}
        for run in rows:
            if run.seq not in longest or longest[run.seq].n < run.n:
                longest[run.seq] = run
        if not longest or self.ended.exists():
            return
        known = self.place.exists()
        n, waits = self.place.get() if known else (0, 0)
        ahead, said, reason, error = sorted(longest.values(), key=lambda run: -run.seq), [], None, None
        while reason is None:
            while ahead and ahead[-1].seq + ahead[-1].n <= n + 1:
                ahead.pop()
            here = (n + 1,)
            if ahead and ahead[-1].seq <= n + 1:
                run, start = ahead[-1], n + 1 - ahead[-1].seq
                took = 0 if run.event else min(run.n - start, max(0, min(self.max_tokens, self.context - run.prompt_tokens) - n))
                if took:
                    said.append(_said(run, start, start + took))
                for seq in range(n + 1, n + 1 + max(took, 1) if waits else 0):  # came before already
                    if self.waiting.containsKey((seq,)):
                        self.waiting.removeKey((seq,))
                        waits -= 1
                n += took
                if took < run.n - start:
                    reason, error = self._reason(n, run.event, run.prompt_tokens), run.error_message
            elif waits and self.waiting.containsKey(here):
                piece, is_control, event, prompt_tokens, error = self.waiting.getValue(here)
                self.waiting.removeKey(here)
                waits -= 1
                if (reason := self._reason(n, event if event in ENDS else "control" if is_control else None, prompt_tokens)) is None:
                    said.append(piece or "")
                    n += 1
            else:
                break
        if reason is None:
            new = {run.seq + i: (_said(run, i, i + 1), run.event == "control", run.event if run.event in ENDS else "token", run.prompt_tokens, run.error_message) for run in ahead for i in range(max(0, n + 1 - run.seq), run.n)}
            for seq, event in new.items():
                waits += not (waits and self.waiting.containsKey((seq,)))
                self.waiting.updateValue((seq,), event)
            if said:
                self.kept.appendList([(s,) for s in said])
            self.place.update((n, waits))
            return
        raw = "".join([*((r[0] for r in self.kept.get()) if known and self.kept.exists() else ()), *said])
        error = {"cancelled": CANCELLED, "error": error or DECODE_ERROR}.get(reason, "")
        if known:
            for state in (self.kept, self.waiting, self.place):
                state.clear()
        self.ended.update((True,))
        yield Row(task_id=key[0], success=not error, full_text=raw.rstrip(" \n\r\t"), raw_text=raw, error_message=error, n_tokens=n, stop_reason=reason)

    def close(self) -> None:
        pass


def _said(run: Row, start: int, end: int) -> str:
    """Pieces [start, end) of a run, end to end."""
    text = run.text or ""
    return text if (start, end) == (0, run.n) else Run(run.seq, run.n, text.encode(), run.lens).cut(start, end).decode()


def stream_assemble(events: DataFrame, max_tokens: int = MAX_TOKENS, context: int = CONTEXT, ttl_ms: int | None = None) -> DataFrame:
    """A result row for each task once it ends, from events (task_id, seq, piece, is_control, event, prompt_tokens).

    event: token, cancel, end, or error (with error_message, where events have that column; run_engine_pieces makes such events); seq counts a task's events, of whatever kind, from 1 without gaps. They may come in any order, more than once, and over any
    number of batches: a task's events take effect in the order of seq, as in the batch form, so a control, a cap, a cancel or an end ends
    it at its own place once all before it have come, and what lies behind is ignored. A task whose end has not come, or which lacks an
    event before it, gives nothing yet. With ttl_ms, tasks that have heard nothing for so long (processing time) are
    forgotten, and so are the marks of ended ones; without it both stay. Such a query ends under availableNow only where
    spark.sql.streaming.noDataMicroBatches.enabled is false.

    n pieces are followed by event n + 1, so a task looks at none beyond its cap and one more: later ones go where they are read, and the rest is packed into runs there.
    """
    cap = F.least(F.greatest(F.lit(context).cast("bigint") - F.col("prompt_tokens"), F.lit(0)), F.lit(max_tokens)) + 1
    error = F.when(F.col("event") == "error", F.col("error_message") if "error_message" in events.columns else None).cast("string")
    used = events.where(F.col("prompt_tokens").isNotNull() & (F.col("seq") <= cap))
    event = F.when(F.col("event").isin(*ENDS), F.col("event")).when(F.col("is_control"), "control")
    used = used.select("task_id", F.col("seq").cast("bigint").alias("seq"), "piece", event.alias("event"), "prompt_tokens", error.alias("error_message"))
    runs = packed(used, "event", ("prompt_tokens",), gaps=False).drop("places")
    return runs.groupBy("task_id").transformWithState(_Assemble(max_tokens, context, ttl_ms), RESULT, "Append", "None" if ttl_ms is None else "ProcessingTime")
