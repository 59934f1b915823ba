"""Engines that a user plugs in, and the runners that call them from mapInPandas.

An engine is an object with `key` (names what it loads, so that a reused worker keeps a loaded engine),
`is_loaded`, `load() -> bool`, and those of these methods that its jobs call. From a
pandas.DataFrame of rows to a Series: `translate` (text, source_lang, target_lang), `preview` (the same; needs no model) and
`recognize` (content, task_type, prompt; None for an image that it cannot read). From one row to an iterator of
(piece, is_control), piece by piece as they come: `translate_pieces` and `recognize_pieces`; an EngineError that it raises ends that row's
pieces with its message. `load` runs once a Python worker as long as it succeeds; where it fails, the rows come back without
an answer and say so.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from io import StringIO
from types import SimpleNamespace

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonguemill.operators import phrasebook as P
from tonguemill.operators.requests import NOT_LOADED_STREAM
from tonguemill.sources.images import read_checked

_loaded: dict = {}
#: Pieces, and characters of them, that a runner holds back before it hands them on.
HELD_PIECES, HELD_CHARS = 10_000, 1 << 20
#: Bytes of images that an engine is given at once (one longer image goes alone).
READ_BYTES = 64 << 20
# Fixed values.
NO_IMAGE, BAD_IMAGE = "待识别图像文件不存在 (", "无法读取或解析图像文件 ("


def bad_image(path: str) -> str:
    return f"{BAD_IMAGE}{path})"


class EngineError(Exception):
    """Ends one row's pieces; its message is that row's error."""


class PhrasebookEngine:
    """Answers from a bounded dictionary that travels with the plan."""

    def __init__(self, phrases, name: str = P.NAME):
        self.phrases, self.name, self.is_loaded = dict(phrases), name, False
        self.key = ("phrasebook", name, tuple(sorted(self.phrases.items())))

    def load(self) -> bool:
        self.is_loaded = True
        return True

    def translate(self, rows: pd.DataFrame) -> pd.Series:
        return rows["text"].map(lambda t: "" if not t else self.phrases.get(t, P.ANSWER_OPEN + t + P.answer_close(self.name)))

    def preview(self, rows: pd.DataFrame) -> pd.Series:
        other = lambda t: P.greeting(self.name) if "Hello" in t else P.PREVIEW + t
        return rows["text"].map(lambda t: self.phrases[t] if t in self.phrases else other(t))

    def translate_pieces(self, row) -> Iterator[tuple[str, bool]]:
        """The answer a character at a time."""
        for piece in self.phrases.get(row.text, P.ANSWER_OPEN + row.text + P.answer_close(self.name)):
            yield piece, False


class FileEngine:
    """Base of engines that need a model file; loading fails quietly where the path is empty or missing."""

    def __init__(self, path: str):
        self.path, self.key, self.is_loaded = path, ("file", path), False

    def load(self) -> bool:
        self.is_loaded = bool(self.path) and os.path.isfile(self.path)
        return self.is_loaded

    def preview(self, rows: pd.DataFrame) -> pd.Series:
        """The fixed form of a preview, which no model is asked for."""
        return P.PREVIEW_LLM + rows["text"]


class StubOcrEngine:
    """Answers with the task's name and the content as text; empty content cannot be read."""

    key, is_loaded = ("stub-ocr",), False

    def load(self) -> bool:
        self.is_loaded = True
        return True

    def recognize_pieces(self, row) -> Iterator[tuple[str, bool]]:
        yield f"{row.task_type}: ", False
        yield bytes(row.content).decode("utf-8", "ignore"), False

    def recognize(self, rows: pd.DataFrame) -> pd.Series:
        return pd.Series([f"{t}: {bytes(c).decode('utf-8', 'ignore')}" if c else None for t, c in zip(rows["task_type"], rows["content"], strict=True)], index=rows.index, dtype=object)


class ReadingLate:
    """An image engine that gets rows with path instead of content: a file's header is checked by range reads, then its bytes are
    read, in the task that uses them and for READ_BYTES of images at a time."""

    def __init__(self, engine, by_content: bool = False):
        self.engine, self.by_content, self.key = engine, by_content, ("late", by_content, engine.key)

    @property
    def is_loaded(self) -> bool:
        return self.engine.is_loaded

    def load(self) -> bool:
        return self.engine.load()

    def _groups(self, rows: pd.DataFrame) -> Iterator[tuple[list, list[bytes]]]:
        """Labels and contents of the rows whose images can be read."""
        at, contents, size = [], [], 0
        for label, path in rows["path"].items():
            if (content := read_checked(path, self.by_content)) is not None:
                if contents and size + len(content) > READ_BYTES:
                    yield at, contents
                    at, contents, size = [], [], 0
                at.append(label)
                contents.append(content)
                size += len(content)
        if contents:
            yield at, contents

    def recognize(self, rows: pd.DataFrame) -> pd.Series:
        out = pd.Series([None] * len(rows), index=rows.index, dtype=object)
        for at, contents in self._groups(rows):
            out[at] = self.engine.recognize(rows.loc[at].assign(content=contents))
        return out

    def recognize_pieces(self, row) -> Iterator[tuple[str, bool]]:
        content = read_checked(row.path, self.by_content)
        if content is None:
            raise EngineError(bad_image(row.path))
        yield from self.engine.recognize_pieces(SimpleNamespace(**row._asdict(), content=content))


def _ready(engine):
    """The engine, loaded in this worker, or None."""
    own = _loaded.get(engine.key)
    if own is None and engine.load():
        own = _loaded[engine.key] = engine
    return own


def run_engine(df: DataFrame, engine, method: str, out: str = "translated_text", drop: tuple[str, ...] = ()) -> DataFrame:
    """df (without `drop`) with the engine's answers in column `out` and engine_loaded, batch by batch.

    Where the engine does not load, out is null and engine_loaded false.
    """
    keep = [c for c in df.columns if c not in drop]
    schema = df.select(*keep).schema.add(out, "string").add("engine_loaded", "boolean")

    def call(batches):
        own = _ready(engine)
        for rows in batches:
            answers = getattr(own, method)(rows) if own is not None and len(rows) else pd.Series([None] * len(rows), index=rows.index, dtype=object)
            yield rows[keep].assign(**{out: answers, "engine_loaded": own is not None})

    return df.mapInPandas(call, schema)


def run_engine_pieces(df: DataFrame, engine, method: str = "translate_pieces", id_col: str = "request_id", most: int | None = None, not_loaded: str = NOT_LOADED_STREAM) -> DataFrame:
    """Token events (task_id, seq, piece, is_control, event, error_message) of df's rows as the engine says them: many rows out for one in.

    seq counts a task's events from 1. A task ends with `end`, or with `error` (a control token with its message) where the engine raises EngineError for it or does not load. Its
    iterator is left at its first control token, and after `most` pieces. Pieces are handed on by thousands, so a task of any length needs no
    more memory than that.
    """
    kind = df.select(F.col(id_col).alias("task_id")).schema.simpleString()[7:-1]
    names = ("task_id", "seq", "piece", "is_control", "event", "error_message")

    def call(batches):
        own = _ready(engine)
        held, size = [], 0
        for rows in batches:
            for row in rows.itertuples(index=False):
                task, seq, error = getattr(row, id_col), 0, not_loaded if own is None else None
                try:
                    for piece, control in getattr(own, method)(row) if own is not None else ():
                        seq += 1
                        size += len(piece)
                        held.append((task, seq, piece, control, "token", None))
                        if len(held) >= HELD_PIECES or size >= HELD_CHARS:
                            yield pd.DataFrame(held, columns=names)
                            held, size = [], 0
                        if control or seq == most:
                            break
                except EngineError as e:
                    error = str(e)
                held.append((task, seq + 1, "", error is not None, "end" if error is None else "error", error))
        if held:
            yield pd.DataFrame(held, columns=names)

    return df.mapInPandas(call, f"{kind}, seq bigint, piece string, is_control boolean, event string, error_message string")


def answer_pieces(df: DataFrame, engine, method: str = "translate_pieces", out: str = "translated_text", most: int | None = None, not_loaded: str = NOT_LOADED_STREAM) -> DataFrame:
    """df with column `out`, what the engine says for a row before its first control token, `most` pieces at the most, end to end, and error_message (null: none).

    The pieces of a row come one behind the other, so the task that asks for them joins them: no piece is a row, none is shuffled, and rows are told apart without an id. A
    row's iterator is left at its first control token, and after `most` pieces. Answers are handed on by the million characters.
    """
    schema = df.select("*").schema.add(out, "string").add("error_message", "string")

    def answer(own, row) -> tuple[str, str | None]:
        text, n = StringIO(), 0
        try:
            for piece, control in getattr(own, method)(row) if most != 0 else ():
                if control:
                    break
                text.write(piece)
                n += 1
                if n == most:
                    break
        except EngineError as e:
            return text.getvalue(), str(e)
        return text.getvalue(), None

    def call(batches):
        own = _ready(engine)
        for rows in batches:
            said, start, size = [], 0, 0
            for end, row in enumerate(rows.to_pandas().itertuples(index=False), 1):
                said.append(("", not_loaded) if own is None else answer(own, row))
                size += len(said[-1][0])
                if size >= HELD_CHARS or end == rows.num_rows:
                    answers = [pa.array(x, pa.string()) for x in zip(*said, strict=True)]
                    yield pa.RecordBatch.from_arrays([*rows.slice(start, end - start).columns, *answers], names=schema.names)
                    said, start, size = [], end, 0

    return df.mapInArrow(call, schema)


def quick_preview_engine(requests: DataFrame, engine) -> DataFrame:
    """Adds preview, the engine's quick answer, for which no model is loaded; empty texts get an empty one and never reach it."""
    rows = requests.withColumn("text", F.coalesce("text", F.lit("")))
    schema = rows.select("*", F.lit("").alias("preview")).schema

    def call(batches):
        for batch in batches:
            asked = batch["text"] != ""
            answers = pd.Series("", index=batch.index, dtype=object)
            if asked.any():
                answers[asked] = engine.preview(batch[asked])
            yield batch.assign(preview=answers)

    return rows.mapInPandas(call, schema)
