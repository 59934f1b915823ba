"""Token logs packed into runs where they are read, and merged into texts in one pass over the sorted runs."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts held back until a batch of results goes out: rows, bytes.
_ROWS, _BYTES = 5000, 8 << 20
#: Rows, and bytes of them, that are packed together; bytes of text in a run, to which its last piece comes.
_PACK_ROWS, _PACK_BYTES, _RUN_BYTES = 1 << 17, 8 << 20, 1 << 14


def _runs(rows: pa.Table, alone: str, alike: tuple[str, ...], gaps: bool) -> pa.RecordBatch:
    """The runs of some rows, as packed() tells."""
    column = lambda name: rows.column(name).combine_chunks()
    coded = lambda name: column(name).dictionary_encode("encode").indices.to_numpy()
    marks = column(alone)
    single = (pc.fill_null(marks, False) if pa.types.is_boolean(marks.type) else marks.is_valid()).to_numpy(zero_copy_only=False)
    task, seq = coded("task_id"), column("seq").to_numpy()
    if single.any():
        first = np.full(task.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(first, task[single], seq[single])
        kept = seq <= first[task]
        rows, task, seq, single = rows.filter(pa.array(kept)), task[kept], seq[kept], single[kept]
    follows = lambda: (task[1:] == task[:-1]) & ((seq[1:] > seq[:-1]) if gaps else (seq[1:] == seq[:-1] + 1))
    joined = follows()
    if np.count_nonzero(joined) < 0.9 * len(joined):
        order = np.lexsort((seq, task))
        rows, task, seq, single = rows.take(pa.array(order)), task[order], seq[order], single[order]
        joined = follows()
    joined &= ~(single[1:] | single[:-1])
    for name in alike:
        joined &= (c := coded(name))[1:] == c[:-1]
    pieces = column("piece").cast(pa.large_string())
    offsets = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset : pieces.offset + len(pieces) + 1]
    joined &= (at := (offsets[:-1] - offsets[0]) // _RUN_BYTES)[1:] == at[:-1]
    cuts = np.concatenate(([0], np.flatnonzero(~joined) + 1, [len(rows)]))
    starts, n = cuts[:-1], np.diff(cuts)
    lens = np.diff(offsets)
    lens = lens.astype("<u1" if lens.max() < 256 else "<u4")

    def sliced(kind: pa.DataType, ends: np.ndarray, data) -> pa.Array:
        return pa.Array.from_buffers(kind, len(starts), [None, pa.py_buffer(ends.astype(np.int32)), data])

    text = sliced(pa.string(), offsets[cuts] - offsets[0], (pieces.buffers()[2] or pa.py_buffer(b"")).slice(offsets[0]))
    if pieces.null_count:
        text = pc.if_else(pa.array((n == 1) & pieces.take(pa.array(starts)).is_null().to_numpy(zero_copy_only=False)), None, text)
    apart = seq[cuts[1:] - 1] - seq[starts] != n - 1
    places = pa.array([seq[a : a + k].tobytes() if x else None for a, k, x in zip(starts, n, apart, strict=True)] if apart.any() else [None] * len(n), pa.binary())
    heads = rows.take(pa.array(starts)).drop_columns(["seq", "piece"]).combine_chunks()
    others = [c for c in heads.column_names if c != "task_id"]
    one = lambda c: heads.column(c).combine_chunks()
    arrays = [one("task_id"), pa.array(seq[starts]), pa.array(n.astype(np.int32)), text, sliced(pa.binary(), cuts * lens.itemsize, pa.py_buffer(lens)), places, *map(one, others)]
    return pa.RecordBatch.from_arrays(arrays, ["task_id", "seq", "n", "text", "lens", "places", *others])


def packed(tokens: DataFrame, alone: str, alike: tuple[str, ...] = (), gaps: bool = True) -> DataFrame:
    """Runs of a token log (task_id, seq, piece and other columns), made where it is read, so that a shuffle of them has one row for many pieces.

    A run has pieces of one task by rising seq (without `gaps`: by one each), which agree in the columns `alike`: seq (its first), n, text (the pieces end to end), lens (bytes of
    each, one or four bytes a length), places (each seq as eight bytes, where they do not rise by one) and the first piece's other columns. A row with `alone`
    (true, or not null) is a run of its own, and ends its task: what the rows packed with it hold of that task behind it is left out.
    """
    others = [c for c in tokens.columns if c not in ("task_id", "seq", "piece")]
    schema = tokens.select("task_id", "seq").schema
    for name, kind in (("n", "integer"), ("text", "string"), ("lens", "binary"), ("places", "binary"), *((c, tokens.schema[c].dataType) for c in others)):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, size = [], 0, 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n, size = n + batch.num_rows, size + batch.nbytes
            if n >= _PACK_ROWS or size >= _PACK_BYTES:
                yield _runs(pa.Table.from_batches(held), alone, alike, gaps)
                held, n, size = [], 0, 0
        if held:
            yield _runs(pa.Table.from_batches(held), alone, alike, gaps)

    return tokens.mapInArrow(run, schema)


class Run:
    """A packed row that is being read: `at` of its pieces are taken."""

    def __init__(self, first: int, n: int, text: bytes, lens: bytes, places: bytes | None = None, rank: int = 1, note: str | None = None):
        self.first, self.n, self.text, self.lens, self.places, self.rank, self.note = first, n, text, lens, places, rank, note
        self.at, self._ends = 0, None

    def _end(self, i: int) -> int:
        """Bytes of its first i pieces."""
        if i in (0, self.n):
            return len(self.text) if i else 0
        if self._ends is None:
            self._ends = np.cumsum(np.frombuffer(self.lens, f"<u{len(self.lens) // self.n}"), dtype=np.int64)
        return int(self._ends[i - 1])

    def cut(self, start: int, end: int) -> bytes:
        return self.text[self._end(start) : self._end(end)]

    def place(self) -> int:
        """The seq of the next piece."""
        return self.first + self.at if self.places is None else int.from_bytes(self.places[8 * self.at : 8 * self.at + 8], "little", signed=True)

    def before(self, seq: int) -> int:
        """How many of its pieces have a smaller seq."""
        return min(self.n, max(0, seq - self.first)) if self.places is None else int(np.searchsorted(np.frombuffer(self.places, "<i8"), seq))

    def __lt__(self, other: Run) -> bool:
        mine, its = (self.place(), self.rank), (other.place(), other.rank)
        return mine < its or mine == its and self.cut(self.at, self.at + 1) < other.cut(other.at, other.at + 1)


class _Open:
    """A task whose runs are being read: no more than `last` pieces are counted, no more than `keep` kept."""

    def __init__(self, task, room: int, cancel_after: int | None, most: int | None, extra: int):
        self.task, self.room, self.cancel_after = task, room, cancel_after
        self.last = max(0, room + extra if most is None else min(room + extra, most)) if room >= 0 else 0
        self.keep = self.last if cancel_after is None else max(0, min(self.last, cancel_after))
        self.n, self.parts, self.stopped, self.note, self.waiting = 0, [], False, None, []

    def add(self, run: Run) -> None:
        """Its next run, by first seq; what lies before that is taken."""
        self.upto(run.first)
        if not self.stopped and self.n < self.last:
            heapq.heappush(self.waiting, run)

    def upto(self, seq: int | None = None) -> None:
        """Takes the pieces with a smaller seq (all, without one) in their order, from runs that may overlap."""
        while self.waiting and (seq is None or self.waiting[0].place() < seq):
            run = heapq.heappop(self.waiting)
            bounds = [x for x in (seq, self.waiting[0].place() if self.waiting else None) if x is not None]
            self._take(run, max(run.before(min(bounds)), run.at + 1) if bounds else run.n)
            if self.stopped or self.n >= self.last:
                self.waiting = []
            elif run.at < run.n:
                heapq.heappush(self.waiting, run)

    def _take(self, run: Run, end: int) -> None:
        if run.rank == 2:
            self.stopped, self.note = True, run.note
        else:
            n = min(end - run.at, self.last - self.n)
            if (kept := min(n, self.keep - self.n)) > 0:
                self.parts.append(run.cut(run.at, run.at + kept))
            self.n += n
        run.at = end


RESULT = "_room bigint, _k bigint, spoken bigint, raw_text string, stopped boolean, note string"


def _merge(most: int | None, extra: int):
    def results(done: list[_Open], kind: pa.DataType) -> pa.RecordBatch:
        text = pa.array([b"".join(t.parts) for t in done], pa.binary()).cast(pa.string())
        numbers = [pa.array([getattr(t, c) for t in done], pa.int64()) for c in ("room", "cancel_after", "n")]
        arrays = [pa.array([t.task for t in done], kind), *numbers, text, pa.array([t.stopped for t in done]), pa.array([t.note for t in done], pa.string())]
        return pa.RecordBatch.from_arrays(arrays, ["task_id", *(c.split()[0] for c in RESULT.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, done, size, kind = None, [], 0, None
        for batch in batches:
            kind = batch.column("task_id").type
            text = batch.column("text").cast(pa.binary())
            rows = zip(*(batch.column(c).to_pylist() for c in ("task_id", "_room", "_k", "is_control", "seq", "n", "lens", "places", "note")), strict=True)
            for i, (name, room, after, control, seq, n, lens, places, note) in enumerate(rows):
                if room is not None:
                    if task is None or task.task != name:
                        if task is not None:
                            task.upto()
                            done.append(task)
                            size += sum(map(len, task.parts))
                            if len(done) >= _ROWS or size >= _BYTES:
                                yield results(done, kind)
                                done, size = [], 0
                        task = _Open(name, room, after, most, extra)
                elif task is not None and task.task == name and not task.stopped and task.n < task.last:  # else no task asks for these pieces
                    task.add(Run(seq, n, text[i].as_py() or b"", lens, places, 0 if control is None else 1 + control, note))
        if task is not None:
            task.upto()
            yield results([*done, task], kind)

    return run


def merged(tokens: DataFrame, tasks: DataFrame, most: int | None = None, extra: int = 0) -> DataFrame:
    """For each task (task_id, _room, _k; one row an id, further ones are ignored) with its columns: spoken (pieces before the first control, counted up to the
    room and `extra` more, and to `most`), raw_text (those, or the first _k of them), stopped (at a control before that) and note (the control's).

    tokens: task_id, seq, piece, is_control, and note where controls have one. They are packed into runs where they are read. One shuffle of these by task and a sort
    by seq within it bring a task's runs together behind its own row; then a text is built as its runs pass, and nothing but it is held.
    """
    none = lambda kind: F.lit(None).cast(kind)
    rows = tokens.where("task_id is not null").withColumn("seq", F.coalesce(F.col("seq").cast("bigint"), F.lit(0)))
    rows = packed(rows, "is_control", ("is_control",)).withColumns({"_room": none("bigint"), "_k": none("bigint")})
    rows = rows if "note" in rows.columns else rows.withColumn("note", none("string"))
    own = {"task_id": F.col("task_id"), "_room": F.col("_room").cast("bigint"), "_k": F.col("_k").cast("bigint")}
    heads = tasks.select(*(own.get(f.name, none(f.dataType)).alias(f.name) for f in rows.schema))
    ordered = heads.unionByName(rows).repartition("task_id").sortWithinPartitions("task_id", F.col("seq").asc_nulls_first(), "is_control", "text")
    kind = tokens.select("task_id").schema.simpleString()[7:-1]
    return ordered.mapInArrow(_merge(most, extra), f"{kind}, {RESULT}")
