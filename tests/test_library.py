"""The library's queries against DuckDB, the known cases, and stream against batch."""

import os
import random
import struct
import time
import zlib
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from tonguemill.functions import text as T
from tonguemill.functions.languages import from_code_name, from_display_name
from tonguemill.operators import memory as M
from tonguemill.operators import phrasebook as P
from tonguemill.operators import requests as R
from tonguemill.operators import tokens as K
from tonguemill.operators.balance import deal_by_cost
from tonguemill.operators.history import append_history, clear_history, scan_history, vacuum_history
from tonguemill.plans import engines, jobs
from tonguemill.plans.queries import ORACLE_SQL, QUERIES
from tonguemill.sources import images
from tonguemill.sources.readers import read_images, read_requests
from tonguemill.sources.shared import put_new
from tonguemill.streaming.streams import stream_assemble, stream_translate

DATA = "/root/testdata/sf0.001"


def _rows(names, rows):
    plain = lambda v: v.item() if hasattr(v, "item") else v
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(repr([plain(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLE_SQL])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "events", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = QUERIES[name](spark, DATA), con.sql(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got.columns, got.collect()) == _rows(want.columns, want.fetchall())


def _requests(spark, *texts):
    return spark.createDataFrame([(i, t, "en", "zh") for i, t in enumerate(texts)], "request_id long, text string, source_lang string, target_lang string")


def test_known_cases(spark):
    book = P.phrasebook(spark, P.product_phrases("Mill", "磨坊"))
    got = {r.original_text: r for r in jobs.translate_batch(_requests(spark, "Hello, welcome to Mill!", "", None, "Hello World", "x"), book).collect()}
    assert got["Hello, welcome to Mill!"].translated_text == "你好，欢迎使用磨坊翻译器！" and got["Hello, welcome to Mill!"].source_char_count == 23
    assert got[""].success and got[""].translated_text == "" and got[""].source_char_count == 0
    assert got["Hello World"].translated_text == "你好，世界" and got["x"].translated_text.startswith(P.ANSWER_OPEN)
    seen = {r.text: r.preview for r in P.quick_preview(_requests(spark, "Hello", "a"), book).collect()}
    assert seen == {"Hello": P.greeting(), "a": P.PREVIEW + "a"}
    assert not engines.FileEngine("").load() and not engines.FileEngine("non_existent_model_path.gguf").load()
    failed = R.gate_model(_requests(spark, "Hello world", ""), F.lit(False), stream=True).orderBy("request_id").collect()
    assert "模型未加载" in failed[0].error_message and failed[1].error_message is None
    assert spark.range(1).select(from_code_name(F.lit("EN"))).first()[0] == "AutoDetect"
    names = spark.range(1).select(from_display_name(F.lit("英语")), from_display_name(F.lit("english")), from_display_name(F.lit(None).cast("string"))).first()
    assert tuple(names) == ("English", "AutoDetect", "AutoDetect")
    counts = spark.range(1).select(T.byte_count(F.lit("😀")), T.char_count(F.lit("😀")), T.utf16_count(F.lit("😀"))).first()
    assert tuple(counts) == (4, 1, 2)


def test_engine_without_collapse_is_the_same(spark):
    rows = _requests(spark, "a", "a", "", None, "Hello World")
    engine = engines.PhrasebookEngine(P.PHRASES)
    want = sorted(map(repr, jobs.translate_batch(rows, P.phrasebook(spark)).collect()))
    for collapse in (True, False):
        assert sorted(map(repr, jobs.translate_batch_engine(rows, engine, 3, collapse).collect())) == want


def test_engine_that_does_not_load(spark):
    rows = _requests(spark, "Hello world", "", None)
    for collapse in (True, False):
        got = {r.request_id: r for r in jobs.translate_batch_engine(rows, engines.FileEngine("nope.gguf"), collapse=collapse).collect()}
        assert not got[0].success and got[0].error_message == R.NOT_LOADED and got[0].translated_text == ""
        assert all(got[i].success and got[i].error_message == "" for i in (1, 2))
    seen = {r.text: r.preview for r in engines.quick_preview_engine(rows, engines.FileEngine("")).collect()}
    assert seen == {"Hello world": P.PREVIEW_LLM + "Hello world", "": ""}  # no model is asked for
    engine = engines.PhrasebookEngine(P.PHRASES)
    assert not engine.is_loaded and engine.load() and engine.is_loaded
    said = {r.text: r.preview for r in engines.quick_preview_engine(_requests(spark, "Hello", "Hello World", "a", ""), engine).collect()}
    assert said == {"Hello": P.greeting(), "Hello World": "你好，世界", "a": P.PREVIEW + "a", "": ""}
    llm = {r.text: r.preview for r in P.quick_preview(_requests(spark, "Test text", "", None), P.phrasebook(spark), llm=True).collect()}
    assert "Llama.cpp" in llm["Test text"] and llm[""] == "" and llm[None] == ""

    class Strict(engines.FileEngine):
        def preview(self, rows):
            assert (rows["text"] != "").all()
            return super().preview(rows)

    assert [r.preview for r in engines.quick_preview_engine(_requests(spark, "", None, "b", ""), Strict("")).orderBy("request_id").collect()] == ["", "", P.PREVIEW_LLM + "b", ""]
    assert engines.quick_preview_engine(_requests(spark, ""), Strict("")).first().preview == ""
    empty = engines.PhrasebookEngine({"silent": ""})  # an empty phrase is a phrase
    assert [r.preview for r in engines.quick_preview_engine(_requests(spark, "silent"), empty).collect()] == [""]


def _spelling(name="spelling"):
    """An engine that spells texts: `|` is a control token, `!` an error, `~` never ends."""

    class Spelling(engines.FileEngine):  # within a function, so that it travels with the plan
        def load(self):
            return True

        def translate_pieces(self, row):
            for c in row.text:
                if c == "!":
                    raise engines.EngineError(f"stuck at {row.request_id}")
                while c == "~":
                    yield "~", False
                yield c, c == "|"

    return Spelling(name)


def test_engine_that_answers_in_pieces(spark, monkeypatch):
    rows = _requests(spark, "ab|c", "", "xy!z", None, "plain \n", "~", "|", "!")
    events = sorted(map(tuple, engines.run_engine_pieces(rows.where("request_id in (0, 2, 6)"), _spelling()).collect()))
    said = lambda t: [e[1:] for e in events if e[0] == t]
    assert said(0) == [(1, "a", False, "token", None), (2, "b", False, "token", None), (3, "|", True, "token", None), (4, "", False, "end", None)]
    assert said(2) == [(1, "x", False, "token", None), (2, "y", False, "token", None), (3, "", True, "error", "stuck at 2")] and said(6)[0][1:3] == ("|", True)
    for partitions in (None, 3):
        got = {r.request_id: (r.success, r.translated_text, r.error_message) for r in jobs.translate_batch_pieces(rows, _spelling(), 30_000, partitions).collect()}
        assert got == {0: (True, "ab", ""), 1: (True, "", ""), 2: (False, "", "stuck at 2"), 3: (True, "", ""), 4: (True, "plain", ""), 5: (True, "~" * 30_000, ""), 6: (True, "", ""), 7: (False, "", "stuck at 7")}
    failed = {r.request_id: (r.success, r.error_message) for r in jobs.translate_batch_pieces(_requests(spark, "a", ""), engines.FileEngine("")).collect()}
    assert failed == {0: (False, R.NOT_LOADED_STREAM), 1: (True, "")}


def test_answers_in_pieces_are_joined_where_they_are_said(spark, monkeypatch):
    """No shuffle, answers handed on by HELD_CHARS, and rows told apart without their ids."""
    monkeypatch.setattr(engines, "HELD_CHARS", 7)
    texts = ["ab|c", "xy!z", "plain \r\n", "~", "", None, "é😀", "|", "!"]
    rows = spark.createDataFrame([(None if i % 2 else (1 << 60) + 1, t, "en", None) for i, t in enumerate(texts)], "request_id long, text string, source_lang string, target_lang string").coalesce(1)
    found = jobs.translate_batch_pieces(rows, _spelling(), 12)
    own = {0: "ab", 2: "plain", 3: "~" * 12, 6: "é😀"}
    want = [(None if i % 2 else (1 << 60) + 1, t or "", own.get(i, ""), "!" not in (t or "")) for i, t in enumerate(texts)]
    assert sorted(map(repr, want)) == sorted(repr((r.request_id, r.original_text, r.translated_text, r.success)) for r in found.collect())
    assert _dealt_rows(found._jdf.queryExecution().executedPlan()) == 0


def test_pieces_are_handed_on_as_they_come(monkeypatch):
    """No more than HELD_PIECES wait in a runner, even within one text that never ends."""
    import pandas as pd

    seen = {}
    monkeypatch.setattr(engines, "HELD_PIECES", 10)
    monkeypatch.setattr(engines, "_loaded", {})

    class Frame:
        def select(self, *_):
            return self

        schema = type("S", (), {"simpleString": staticmethod(lambda: "struct<task_id:bigint>")})

        def mapInPandas(self, call, schema):
            seen["call"] = call

    engines.run_engine_pieces(Frame(), _spelling("never ends"))
    parts = seen["call"](iter([pd.DataFrame({"request_id": [7], "text": ["a~"]})]))
    first, second = next(parts), next(parts)
    assert first["seq"].tolist() == list(range(1, 11)) and second["seq"].tolist() == list(range(11, 21)) and "".join(first["piece"]) == "a" + "~" * 9


def test_merging_over_batches(spark):
    """Tasks cut by Arrow batches, pieces nobody asks for, tasks without pieces, null and repeated ids, string ids, nulls in pieces."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        tokens = [(t, s * 7, "" if s % 5 == 0 else f"{t}{s};", False) for t in "abcd" for s in range(1, 12)] + [("b", 50, None, None), ("e", 1, "x", True), ("e", 2, "y", False), (None, 1, "n", False)]
        rows = spark.createDataFrame(tokens, "task_id string, seq int, piece string, is_control boolean").repartition(5)
        tasks = spark.createDataFrame([("b", 0, None), ("b", 0, None), ("d", 4089, None), ("e", 0, None), ("none", None, 0), (None, 0, None), ("c", 0, 4)], "task_id string, prompt_tokens int, cancel_after int")
        got = {r.task_id: (r.raw_text, r.n_tokens, r.stop_reason) for r in K.assemble_streams(rows, tasks).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    text = lambda t, n: "".join(f"{t}{s};" for s in range(1, n + 1) if s % 5)
    b = "".join(f"b{s};" for s in range(1, 8) if s % 5) + "".join(f"b{s};" for s in range(8, 12) if s % 5)
    assert got == {"b": (b, 12, "end"), "d": (text("d", 7), 7, "context"), "e": ("", 0, "control"), "none": ("", 0, "cancelled"), None: ("", 0, "end"), "c": (text("c", 4), 4, "cancelled")}


def _dealt_rows(plan):
    """Rows that the shuffles of an executed plan wrote."""
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return _dealt_rows(plan.executedPlan())
    n = plan.metrics().apply("shuffleRecordsWritten").value() if plan.getClass().getSimpleName() == "ShuffleExchangeExec" else 0
    below = [plan.plan()] if plan.getClass().getSimpleName().endswith("QueryStageExec") else [plan.children().apply(i) for i in range(plan.children().size())]
    return n + sum(map(_dealt_rows, below))


def test_logs_are_packed_before_the_shuffle(spark):
    """assemble_streams: a row a task and one for many of its pieces is shuffled, in whatever order they are read."""
    text = "".join(chr(97 + i % 26) for i in range(1000))
    docs = spark.createDataFrame([(t, text) for t in range(40)], "task_id long, text string").coalesce(2)
    tasks = docs.selectExpr("task_id", "0 AS prompt_tokens", "CAST(NULL AS int) AS cancel_after")
    rows = K.split_codepoints(docs).withColumn("is_control", F.lit(False))
    backward = rows.sortWithinPartitions(F.desc("seq"), "task_id")
    for tokens, settings in ((rows, {}), (rows, {"dense": True}), (rows, {"dense": True, "ocr": True}), (backward, {})):
        found = K.assemble_streams(tokens, tasks, **settings)
        assert {(r.raw_text, r.n_tokens) for r in found.collect()} == {(text, 1000)}
        assert 80 <= _dealt_rows(found._jdf.queryExecution().executedPlan()) <= 400


@pytest.mark.parametrize("name", ["assemble_streams", "assemble_ocr_streams", "render_result", "render_ocr_result"])
def test_log_queries_shuffle_runs(spark, name):
    """Over whole documents: a few rows a document are shuffled, not one a character."""
    found = QUERIES[name](spark, DATA)
    assert len(found.collect()) == (n := spark.read.parquet(f"{DATA}/documents.parquet").count())
    assert 2 * n <= _dealt_rows(found._jdf.queryExecution().executedPlan()) <= 6 * n


def test_merging_of_runs_that_overlap(spark, monkeypatch):
    """Repeats, gaps, places below 1, nulls and controls, dealt to many runs: the same as pieces sorted one by one."""
    rng, by_task, tokens = random.Random(11), {}, []
    for t in range(120):
        step, wide = rng.choice([1, 1, 7]), rng.random() < 0.1
        for s in range(rng.randint(0, 60)):
            for _ in range(1 + (rng.random() < 0.2) + 3 * (rng.random() < 0.03)):
                control = None if rng.random() < 0.1 else rng.random() < 0.02
                tokens.append((t, None if rng.random() < 0.01 else s * step - 3, None if rng.random() < 0.05 else rng.choice(["a", "bc", "é", "", "😀" * 100 if wide else "x"]), control, f"note {t}" if control and rng.random() < 0.5 else None))
    for t, s, p, c, note in tokens:
        by_task.setdefault(t, []).append((s or 0, 0 if c is None else 1 + c, (p or "").encode(), note))
    tasks = [(t, rng.choice([0, 4076, 4090, 4096, 5000]), rng.choice([None, None, 0, 5, 40])) for t in range(125)]
    rows = spark.createDataFrame(tokens, "task_id int, seq int, piece string, is_control boolean, error_message string")
    known = spark.createDataFrame(tasks, "task_id int, prompt_tokens int, cancel_after int")
    rng.shuffle(tokens)
    mixed = spark.createDataFrame(tokens, rows.schema)
    for frame, n, most in ((rows, 1 << 17, 30), (rows.repartition(7), 40, 30), (mixed, 1 << 17, None), (mixed.repartition(3), 20, 4096)):
        monkeypatch.setattr("tonguemill.operators.merging._PACK_ROWS", n)
        want = {}
        for t, prompt, after in tasks:
            room, said = 4096 - prompt, []
            last = 0 if room < 0 else room if most is None else min(room, most)
            for _, kind, piece, _note in sorted(by_task.get(t, []), key=lambda x: x[:3]):
                if len(said) >= last or kind == 2:
                    break
                said.append(piece)
            cancelled = room >= 0 and after is not None and after <= len(said)
            want[t] = (b"".join(said[:after] if cancelled else said).decode(), after if cancelled else len(said))
        assert {r.task_id: (r.raw_text, r.n_tokens) for r in K.assemble_streams(frame, known, max_tokens=most).collect()} == want


def test_running_count_in_chunks(spark):
    tokens = [(t, s, "x" * (s % 4), False) for t in (1, 2, None) for s in range(1, 60, t or 3)]
    want = {}
    for t, s, p, _ in sorted(tokens, key=lambda r: (str(r[0]), r[1])):
        want[t, s] = want.get((t, "sum"), 0) + len(p)
        want[t, "sum"] = want[t, s]
    rows = spark.createDataFrame(tokens, "task_id long, seq int, piece string, is_control boolean")
    for chunk in (1, 7, 1000):
        got = {(r.task_id, r.seq): r.n_chars for r in K.running_char_count(rows, chunk).collect()}
        assert {k: v for k, v in got.items() if k[0]} == {k: v for k, v in want.items() if k[0] and k[1] != "sum"} and len(got) == len(tokens)
        assert all(v is None for k, v in got.items() if k[0] is None)
    plan = K.running_char_count(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and all("_chunk" in line for line in plan.split("\n") if "windowspecdefinition" in line)


def _png(width=3, height=2, tail=b""):
    chunk = lambda kind, body: len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(bytes((width + 1) * height)) + tail) + chunk(b"IEND", b"")


def _jpeg(width=5, height=4, junk=b""):
    comment = b"\xff\xfe" + (len(junk) + 2).to_bytes(2, "big") + junk
    return b"\xff\xd8\xff\xe0\x00\x04ab" + comment + b"\xff\xff\xc2\x00\x0b\x08" + struct.pack(">HH", height, width) + b"\x01\x01\x11\x00" + b"\xff\xda\x00\x02pixels\xff\xd9"


def _bmp(width=3, height=-2, cut=0):
    rows = (width * 24 + 31) // 32 * 4 * abs(height)
    return b"BM" + struct.pack("<IHHI", 54 + rows, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, rows, 0, 0, 0, 0) + bytes(rows - cut)


def _webp(body):
    return b"RIFF" + (4 + len(body)).to_bytes(4, "little") + b"WEBP" + body


VP8 = b"VP8 \x0a\x00\x00\x00" + b"\x00\x00\x00\x9d\x01\x2a" + struct.pack("<HH", 7 | 0x4000, 6)
VP8L = b"VP8L\x05\x00\x00\x00\x2f" + (6 | 4 << 14).to_bytes(4, "little") + b"\x00"
VP8X = b"VP8X\x0a\x00\x00\x00" + bytes(4) + (8).to_bytes(3, "little") + (9).to_bytes(3, "little")


def test_image_headers():
    see = lambda data: images.image_header(lambda at, n: data[at : at + n] if at >= 0 else b"", len(data))
    good = {_png(): ("png", 3, 2), _jpeg(): ("jpeg", 5, 4), _jpeg(junk=b"\xff\xc0" * 300): ("jpeg", 5, 4), _bmp(): ("bmp", 3, 2), _webp(VP8): ("webp", 7, 6), _webp(VP8L): ("webp", 7, 5), _webp(VP8X): ("webp", 9, 10)}
    for data, want in good.items():
        assert see(data) == want
        for cut in range(len(data)):  # cut off anywhere
            assert see(data[:cut]) is None, (want, cut)
    wrong = [b"", b"text", b"x" * 100, _png(0), _jpeg(0), _bmp(0), _bmp(cut=1), _png()[:20] + b"\x09" + _png()[21:], b"RIFF" + bytes(40), b"\xff\xd8" + bytes(60) + b"\xff\xd9", _webp(b"VP8 " + bytes(40))]
    assert [see(x) for x in wrong] == [None] * len(wrong)


def test_recognize_batch(spark, tmp_path):
    files = {"a.png": _png(tail=b"x" * 5000), "b.png": b"", "d.JPG": _jpeg(junk=b"e"), "cut.png": _png()[:-1], "text.bmp": b"no image", "jpeg.png": _jpeg(), "e.webp": _webp(VP8L), "f.bmp": _bmp(), "g.txt": _png()}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    listed = images.list_images(spark, str(tmp_path))
    assert listed.columns == ["path", "length"] and listed.count() == len(files) - 2  # one is empty, one no image by its name
    at = f"file:{tmp_path}/"
    tasks = {**dict.fromkeys(files, "ocr"), "c.png": "table", "d.JPG": None}
    manifest = spark.createDataFrame([*((at + n, t) for n, t in tasks.items()), (None, "ocr")], "path string, task_type string")
    text = lambda n: f"{tasks[n]}: {files[n].decode('utf-8', 'ignore')}".rstrip(" \n\r\t")
    want = {at + n: (True, text(n), "", len(text(n))) for n in ("a.png", "d.JPG", "e.webp", "f.bmp")}
    want |= {at + n: (False, "", engines.bad_image(at + n), 0) for n in ("b.png", "cut.png", "text.bmp", "jpeg.png", "g.txt")}
    want |= {at + n: (False, "", f"{jobs.NO_IMAGE}{at}{n})", 0) for n in ("c.png",)} | {None: (False, "", jobs.NO_IMAGE + ")", 0)}
    for pieces in (False, True):
        seen = jobs.recognize_batch(manifest, listed, engines.StubOcrEngine(), partitions=3, pieces=pieces)
        assert {r.path: tuple(r)[1:] for r in seen.collect()} == want
        assert "content" not in seen._jdf.queryExecution().executedPlan().toString()
    loose = {r.path: r.success for r in jobs.recognize_batch(manifest, listed, engines.StubOcrEngine(), by_content=True).collect()}
    assert loose[at + "jpeg.png"] and not loose[at + "cut.png"]
    failed = {r.path: r.error_message for r in jobs.recognize_batch(manifest, listed, engines.FileEngine("")).collect()}
    assert failed[at + "a.png"] == failed[at + "cut.png"] == jobs.NOT_LOADED_OCR and failed[at + "c.png"] == f"{jobs.NO_IMAGE}{at}c.png)"

    class Blind(engines.StubOcrEngine):
        key = ("blind",)

        def recognize(self, rows):
            assert all(images.image_header(lambda a, n, c=c: c[a : a + n], len(c)) for c in rows["content"])  # bad files never come here
            return super().recognize(rows).map(lambda t: None)

    unread = {r.path: r.error_message for r in jobs.recognize_batch(manifest, listed, Blind()).collect()}
    assert unread[at + "a.png"] == engines.bad_image(at + "a.png")


def test_images_are_read_in_groups(tmp_path, monkeypatch):
    import pandas as pd

    monkeypatch.setattr(engines, "READ_BYTES", 3 * len(_png()))
    for i in range(8):
        (tmp_path / f"{i}.png").write_bytes(_png() if i != 2 else b"none")
    sizes = []

    class Counting(engines.StubOcrEngine):
        def recognize(self, rows):
            sizes.append(len(rows))
            return rows["path"]

    rows = pd.DataFrame({"path": [str(tmp_path / f"{i}.png") for i in range(8)]}, index=range(10, 18))
    got = engines.ReadingLate(Counting()).recognize(rows)
    assert sizes == [3, 3, 1] and [x is None for x in got] == [i == 2 for i in range(8)] and got[17] == rows["path"][17]


def test_rows_dealt_by_cost(spark):
    rng = random.Random(6)
    rows = spark.createDataFrame([(i, "x" * int(rng.paretovariate(1.1) * 20) if i % 50 else None) for i in range(4000)], "id long, text string").where("length(text) < 5000 or text is null")
    dealt = deal_by_cost(rows, F.char_length("text"), [F.col("id")], 16).withColumn("at", F.spark_partition_id())
    by = [r[1] for r in dealt.groupBy("at").agg(F.sum(F.coalesce(F.char_length("text"), F.lit(0)))).collect()]
    longest = rows.agg(F.max(F.char_length("text"))).first()[0]
    mean = sum(by) / 16
    assert len(by) == 16 and max(by) <= mean * (1 + 1 / 16) + longest and dealt.count() == rows.count() and dealt.columns == ["id", "text", "at"]
    assert deal_by_cost(rows.limit(0), F.char_length("text"), [F.col("id")], 4).count() == 0
    asked = _requests(spark, *(t.text for t in rows.limit(300).collect()), "Hello World")
    want = sorted(map(repr, jobs.translate_batch(asked, P.phrasebook(spark)).collect()))
    for collapse in (True, False):
        assert sorted(map(repr, jobs.translate_batch_engine(asked, engines.PhrasebookEngine(P.PHRASES), 5, collapse).collect())) == want


def test_assemble_ocr_and_dense(spark):
    tokens = spark.createDataFrame([(t, i + 1, p or "", p is None) for t, pieces, _, _ in CASES for i, p in enumerate(pieces)], "task_id long, seq int, piece string, is_control boolean")
    tasks = spark.createDataFrame([(t, p, c) for t, _, p, c in CASES], "task_id long, prompt_tokens int, cancel_after int")
    plain = [sorted(map(repr, K.assemble_streams(tokens, tasks, dense=d).collect())) for d in (True, False)]
    assert plain[0] == plain[1]
    for dense in (True, False):
        got = {r.task_id: (r.full_text, r.success, r.stop_reason, r.n_tokens) for r in K.assemble_streams(tokens, tasks, context=4096, ocr=True, dense=dense).collect()}
        assert got[1] == ("a b", True, "end", 3) and got[2] == ("a", True, "control", 1) and got[3] == ("abc", False, "error", 3) and got[4] == ("", False, "error", 0)
        assert got[5] == ("ab", False, "cancelled", 2) and got[7] == ("a", False, "error", 1) and got[8] == ("a", True, "end", 1)
    cancelled = spark.createDataFrame([(1, 10, 3)], "task_id long, prompt_tokens int, cancel_after int")
    assert K.assemble_streams(tokens, cancelled, ocr=True).first().full_text == "a b\n " and K.assemble_streams(tokens, cancelled).first().full_text == "a b"


def test_requests_without_words_and_greetings(spark):
    book = P.phrasebook(spark)
    rows = [("", ""), (None, ""), ("Hello World", "你好，世界"), ("Hello you", P.ANSWER_OPEN + "Hello you" + P.answer_close("X"))]
    got = {r.original_text: r.translated_text for r in jobs.respond(P.translate_phrasebook(_requests(spark, *(t for t, _ in rows)), book, "X").withColumn("error_message", F.lit(None).cast("string"))).collect()}
    assert got == {t or "": a for t, a in rows}


HISTORY_ROWS = "SELECT '2' AS id, 'b' AS source_text, 'B' AS translated_text, 'en' AS source_lang, 'zh' AS target_lang, timestamp'2024-01-02' AS ts UNION ALL SELECT '1', 'a', 'A', 'en', 'ja', timestamp'2024-01-01'"


def test_history(spark, tmp_path):
    at, rows = str(tmp_path / "h"), spark.sql(HISTORY_ROWS)
    ids = lambda *range_: [r.id for r in scan_history(spark, at, *range_).collect()]
    assert ids() == []
    assert append_history(rows, at) and append_history(rows, at)
    assert ids() == ["1", "1", "2", "2"] and scan_history(spark, at).columns == ["id", "source_text", "translated_text", "source_lang", "target_lang", "ts"]
    clear_history(spark, at)
    assert ids() == []
    # a batch is filed once, however often it is tried, also after a clear
    assert append_history(rows, at, "b1") and not append_history(rows, at, "b1") and append_history(rows.limit(0), at, "none")
    assert ids() == ["1", "2"]
    reader = scan_history(spark, at)
    clear_history(spark, at)
    assert ids() == [] and reader.count() == 2  # who has begun sees all
    assert not append_history(rows, at, "b1") and ids() == []
    vacuum_history(spark, at)
    assert append_history(rows, at, "b2") and ids() == ["1", "2"] and len(os.listdir(tmp_path / "h" / "data")) == 1
    log = sorted(f for f in os.listdir(tmp_path / "h" / "log") if f.endswith(".json"))
    assert [int(f[:20]) for f in log] == list(range(len(log)))


def test_history_ranges_and_half_done_attempts(spark, tmp_path):
    at = str(tmp_path / "h")
    for day in range(1, 6):
        append_history(spark.sql(f"SELECT '{day}' AS id, 't' AS source_text, 't' AS translated_text, 'en' AS source_lang, 'zh' AS target_lang, timestamp'2024-01-0{day} 12:00:00' AS ts"), at, f"day {day}")
    append_history(spark.sql("SELECT 'none' AS id, 't' AS source_text, 't' AS translated_text, 'en' AS source_lang, 'zh' AS target_lang, cast(null AS timestamp) AS ts"), at)
    found = scan_history(spark, at, datetime(2024, 1, 2, 12), datetime(2024, 1, 4, 12))
    assert [r.id for r in found.collect()] == ["2", "3"] and len(found.inputFiles()) == 2  # others are not opened
    assert [r.id for r in scan_history(spark, at, since=datetime(2024, 1, 5)).collect()] == ["5"]
    assert [r.id for r in scan_history(spark, at).collect()] == ["none", "1", "2", "3", "4", "5"]
    # data without a commit, a commit that is being written, and one that somebody else wrote first
    spark.sql(HISTORY_ROWS).write.partitionBy("target_lang").parquet(f"{at}/data/commit=lost")
    (tmp_path / "h" / "log" / f"{6:020d}.json").write_text('{"number": 6, "da')
    assert scan_history(spark, at).count() == 6
    assert append_history(spark.sql(HISTORY_ROWS), at, "after") and scan_history(spark, at).count() == 8
    assert not put_new(spark, f"{at}/log/{6:020d}.json", "x") and put_new(spark, f"{at}/log/new.txt", "x")


def test_history_written_by_many(spark, tmp_path):
    """Writers of one batch at the same time leave one copy, writers of several each theirs."""
    at, rows = str(tmp_path / "h"), spark.sql(HISTORY_ROWS)
    with ThreadPoolExecutor(6) as pool:
        done = list(pool.map(lambda i: append_history(rows, at, f"b{i % 3}"), range(6)))
    assert sorted(done) == [False] * 3 + [True] * 3 and scan_history(spark, at).count() == 6
    assert len(os.listdir(tmp_path / "h" / "data")) == 3


def test_stream_replays_file_nothing_twice(spark, tmp_path):
    book, at = P.phrasebook(spark), str(tmp_path)
    _requests(spark, "Hello World", "", "x").write.parquet(f"{at}/in")
    asked = lambda: spark.readStream.schema("request_id long, text string, source_lang string, target_lang string").parquet(f"{at}/in")
    for _ in range(2):
        stream_translate(asked(), book, f"{at}/responses", f"{at}/history", f"{at}/c").awaitTermination()
        for name in os.listdir(f"{at}/c/commits"):  # the second run finds its last batch unfinished and does it again
            os.remove(f"{at}/c/commits/{name}")
    assert [r.source_text for r in scan_history(spark, f"{at}/history").orderBy("id").collect()] == ["Hello World", "x"]
    assert spark.read.parquet(f"{at}/responses").count() == 3


def test_stored_memory(spark, tmp_path):
    rng = random.Random(9)
    book = [(f"text {i}", f"t{i}") for i in range(500)] + [("", "never"), (None, "null"), ("Hello World", "own")]
    M.store_memory(spark.createDataFrame(book, "source_text string, translated_text string"), "stored_memory", buckets=6, path=str(tmp_path))
    asked = _requests(spark, *(rng.choice([f"text {rng.randrange(700)}", "", None, "Hello World", "Text 1"]) for _ in range(900)))
    found = M.translate_memory(asked, "stored_memory")
    want = P.translate_phrasebook(asked, spark.createDataFrame([b for b in book if b[0]], "source_text string, translated_text string"))
    assert sorted(map(repr, found.select("request_id", "translated_text").collect())) == sorted(map(repr, want.select("request_id", "translated_text").collect()))
    keep = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        for partitions in ("3", "6", "200"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            plan = M.translate_memory(asked, "stored_memory")._jdf.queryExecution().executedPlan().toString()
            assert plan.count("stored_memory[") == 1 and "Bucketed: true" in plan
            assert "hashpartitioning(hash#" not in plan and "hashpartitioning(_h2#" in plan  # the memory lies where it is, the texts come to it
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    bits = spark.table("stored_memory_filter")
    passes = spark.range(20_000).select(F.xxhash64(F.concat(F.lit("other "), F.col("id").cast("string"))).alias("h"))
    assert bits.count() <= M.WORDS and passes.join(bits, M._word(F.col("h")) == F.col("word")).where(F.col("bits").bitwiseAND(M._mask(F.col("h"))) == M._mask(F.col("h"))).count() < 20


def test_readers(spark, tmp_path):
    texts = ["a,\"b", "", "two\nlines", "back\\slash", None, " spaces ", "é😀"]
    rows = _requests(spark, *texts)
    plain = lambda df: sorted(((r.request_id, r.text, r.source_lang, r.target_lang) for r in df.collect()), key=lambda r: r[0])
    rows.write.json(str(tmp_path / "json"))
    rows.write.parquet(str(tmp_path / "parquet"))
    for fmt in ("json", "parquet"):
        read = read_requests(spark, str(tmp_path / fmt), fmt)
        assert plain(read) == plain(rows) and read.schema.simpleString() == "struct<request_id:bigint,text:string,source_lang:string,target_lang:string>"
    (tmp_path / "r.csv").write_text('request_id,text,source_lang,target_lang\n0,"a,""b",en,zh\n1,"two\nlines",,zh\n2," spaces ",en,zh\n3,,en,\n', encoding="utf-8")
    assert plain(read_requests(spark, str(tmp_path / "r.csv"), "csv")) == [(0, 'a,"b', "en", "zh"), (1, "two\nlines", None, "zh"), (2, " spaces ", "en", "zh"), (3, None, "en", None)]
    (tmp_path / "s.csv").write_text("request_id;text;source_lang;target_lang\n0;a,b;en;zh\n")
    assert plain(read_requests(spark, str(tmp_path / "s.csv"), "csv", sep=";")) == [(0, "a,b", "en", "zh")]
    for name in ("a.png", "b.JPEG", "c.txt"):
        (tmp_path / "i").mkdir(exist_ok=True)
        (tmp_path / "i" / name).write_bytes(b"x")
    found = read_images(spark, str(tmp_path / "i"))
    assert sorted(os.path.basename(r.path) for r in found.select("path").collect()) == ["a.png", "b.JPEG"]


RESULT = ("full_text", "raw_text", "success", "error_message", "n_tokens", "stop_reason")


def _assembled(spark, tmp_path, name, schema, parts, **settings):
    """Results by task of a stream that gets each of parts in a micro-batch of its own."""
    at = tmp_path / name
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{at}/in")
        time.sleep(0.05)  # file streams go by modification time
    stream = stream_assemble(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in"), **settings)
    query = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    assert len({p["batchId"] for p in query.recentProgress if p["numInputRows"]}) == len(parts)
    return {r.task_id: tuple(r[c] for c in RESULT) for r in spark.read.parquet(f"{at}/out").collect()}


CASES = [  # task, pieces (None: control), prompt, cancel_after
    (1, ["a", " b", "\n "], 10, None), (2, ["a", None, "b"], 10, None), (3, ["a", "b", "c"], 4094, None), (4, ["a"], 5000, None), (5, ["a", "b", "c"], 10, 2), (6, [None], 10, 0), (7, ["a", "b"], 4096, None), (8, ["a"], 10, 5)]


def test_stream_assemble_is_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    tokens = [(t, i, p or "", p is None) for t, pieces, _, _ in CASES for i, p in enumerate(pieces)]
    batch = K.assemble_streams(spark.createDataFrame(tokens, "task_id long, seq int, piece string, is_control boolean"), spark.createDataFrame([(t, p, c) for t, _, p, c in CASES], "task_id long, prompt_tokens int, cancel_after int"))
    want = {r.task_id: r for r in batch.collect()}
    assert [want[t].stop_reason for t in range(1, 9)] == ["end", "control", "context", "error", "cancelled", "cancelled", "context", "end"]
    assert want[1].full_text == "a b" and want[1].raw_text == "a b\n " and want[5].raw_text == "ab" and want[7].success
    events = []
    for t, pieces, p, c in CASES:
        own = [(piece or "", piece is None, "token") for piece in pieces]
        if c is not None and c <= len(pieces):
            own.insert(c, ("", False, "cancel"))
        events += [(t, i + 1, *e, p) for i, e in enumerate([*own, ("", False, "end"), ("late", False, "token")])]
    schema = "task_id long, seq int, piece string, is_control boolean, event string, prompt_tokens int"
    want = {t: tuple(r[c] for c in RESULT) for t, r in want.items()}
    for n in (1, 3):  # micro-batches; each takes the next few events of every task
        of = {t: [e for e in events if e[0] == t] for t, *_ in CASES}
        parts = [[e for own in of.values() for e in own[k * len(own) // n : (k + 1) * len(own) // n]] for k in range(n)]
        assert _assembled(spark, tmp_path, f"r{n}", schema, parts) == want
    # a control that comes late takes the pieces behind it along
    late = [(1, 1, "a", False, "token", 0), (1, 4, "X", False, "token", 0), (2, 1, "x", False, "token", 0)], [(1, 3, "", True, "token", 0), (1, 5, "", False, "end", 0)], [(1, 2, "b", False, "token", 0)], [(1, 6, "z", False, "token", 0), (1, 1, "again", False, "token", 0)]
    assert _assembled(spark, tmp_path, "late", schema, late) == {1: ("ab", "ab", True, "", 2, "control")}
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # else a stream with a TTL waits for it
    assert _assembled(spark, tmp_path, "ttl", schema, late, ttl_ms=3_600_000) == {1: ("ab", "ab", True, "", 2, "control")}
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def test_stream_packs_events_before_the_shuffle(spark, tmp_path):
    """A task's events are a few runs for the shuffle; what lies behind its room or its end does not go there."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "task_id long, seq int, piece string, is_control boolean, event string, prompt_tokens int"
    n = {1: 3000, 2: 50, 3: 700}
    events = [(t, s, "" if s == k else "aé"[s % 2], False, "end" if s == k else "token", 3096) for t, k in n.items() for s in range(k, 0, -1)] + [(4, 1, "\n", True, "token", 0)] + [(4, s, "z", False, "token", 0) for s in range(2, 900)]
    spark.createDataFrame(events, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    found = stream_assemble(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    query = found.writeStream.format("memory").queryName("packs").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    said = lambda k: "".join("aé"[s % 2] for s in range(1, k))
    assert {r.task_id: (r.raw_text, r.stop_reason) for r in spark.table("packs").collect()} == {1: (said(1001), "context"), 2: (said(50), "end"), 3: (said(700), "end"), 4: ("", "control")}
    assert query.recentProgress[0]["stateOperators"][0]["numRowsTotal"] == 4  # only the marks of ended tasks
    assert _dealt_rows(query._jsq.streamingQuery().lastExecution().executedPlan()) < 20


def test_an_engine_s_pieces_as_a_stream(spark, tmp_path):
    """What run_engine_pieces says, shuffled over micro-batches, gives what the batch job gives."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = _requests(spark, "ab|c", "", "xy!z", "plain \n", "|", "!", "one two")
    events = [(*e[:5], 0, e[5]) for e in map(tuple, engines.run_engine_pieces(rows.where("text <> ''"), _spelling()).collect())]
    random.Random(7).shuffle(events)
    schema = "task_id long, seq long, piece string, is_control boolean, event string, prompt_tokens int, error_message string"
    got = _assembled(spark, tmp_path, "pieces", schema, [events[:9], events[9:20], events[20:]])
    want = {r.request_id: (r.success, r.translated_text, r.error_message) for r in jobs.translate_batch_pieces(rows, _spelling()).collect() if r.request_id != 1}
    assert {t: (g[2], g[0] if g[2] else "", g[3]) for t, g in got.items()} == want
    assert got[2][1] == "xy" and got[2][-1] == "error"  # what was said before the error


def test_shuffled_events_over_many_batches(spark, tmp_path):
    """Any split and order of events, repeats among them, gives the batch form's result."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng = random.Random(5)
    tokens, tasks, events = [], [], []
    for t in range(60):
        pieces = [None if rng.random() < 0.04 else rng.choice(["a", "bc", " ", "\n", "é"]) for _ in range(rng.randint(0, 25))]
        prompt, after = rng.choice([0, 0, 4090, 4080, 4096, 4097]), rng.choice([None, None, 0, 3, 10, 30])
        tokens += [(t, i + 1, p or "", p is None) for i, p in enumerate(pieces)]
        tasks.append((t, prompt, after))
        own = [(p or "", p is None, "token") for p in pieces]
        if after is not None and after <= len(own):
            own.insert(after, ("", False, "cancel"))
        events += [(t, i + 1, *e, prompt) for i, e in enumerate([*own, ("", False, "end"), ("behind", False, "token")])]
    events += rng.sample(events, 100)
    rng.shuffle(events)
    batch = K.assemble_streams(spark.createDataFrame(tokens, "task_id long, seq int, piece string, is_control boolean"), spark.createDataFrame(tasks, "task_id long, prompt_tokens int, cancel_after int"), max_tokens=20)
    want = {r.task_id: tuple(r[c] for c in RESULT) for r in batch.collect()}
    assert len({w[-1] for w in want.values()}) == 6
    cuts = sorted(rng.sample(range(1, len(events)), 5))
    parts = [events[a:b] for a, b in zip([0, *cuts], [*cuts, len(events)], strict=True)]
    schema = "task_id long, seq int, piece string, is_control boolean, event string, prompt_tokens int"
    assert _assembled(spark, tmp_path, "mixed", schema, parts, max_tokens=20) == want
