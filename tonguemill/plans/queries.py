"""Registered queries over the driver's tables, and the SQL that says the same."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonguemill.functions import text as T
from tonguemill.functions.languages import LANGUAGES, from_display_name, language_pairs
from tonguemill.operators import memory as M
from tonguemill.operators import phrasebook as P
from tonguemill.operators import requests as R
from tonguemill.operators import tokens as K
from tonguemill.operators.history import admit_history, append_history, clear_history, scan_history
from tonguemill.plans import engines, jobs
from tonguemill.sources.images import FORMATS, list_images
from tonguemill.sources.readers import REQUESTS, read_images, read_requests
from tonguemill.sources.shared import new_path, qualified
from tonguemill.streaming.streams import state_store, stream_assemble, stream_translate

SOURCE = "CASE WHEN doc_id % 7 = 0 THEN 'auto' WHEN doc_id % 19 = 0 THEN NULL ELSE lang END"
TARGET = "CASE doc_id % 6 WHEN 0 THEN 'zh' WHEN 1 THEN 'ja' WHEN 2 THEN 'ko' WHEN 3 THEN 'zh-Hant' WHEN 4 THEN 'auto' ELSE 'xx' END"
IMAGE = "concat('img_', cast(page_id AS string), '.', CASE page_id % 6 WHEN 0 THEN 'png' WHEN 1 THEN 'jpg' WHEN 2 THEN 'jpeg' WHEN 3 THEN 'bmp' WHEN 4 THEN 'webp' ELSE 'txt' END)"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def req(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "documents").selectExpr("doc_id AS request_id", "text", f"{SOURCE} AS source_lang", f"{TARGET} AS target_lang")


def tok(spark, sf_dir) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("task_id"), "text")
    return K.split_codepoints(rows).withColumn("is_control", F.col("piece") == "\n")


def budgets(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "documents").selectExpr("doc_id AS task_id", "cast(3000 + doc_id % 1000 AS int) AS prompt_tokens", "cast(CASE WHEN doc_id % 100 = 0 THEN 100 END AS int) AS cancel_after")


def sess(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "events").selectExpr("user_id AS session_id", "event_id AS request_id", "cast(ts AS timestamp) AS started_at", "timestampadd(MINUTE, cast(ceil(value) AS int), cast(ts AS timestamp)) AS finished_at")


def img(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "pages").selectExpr(f"{IMAGE} AS path", "cast(html AS binary) AS content", "cast(octet_length(html) AS bigint) AS length", "cast(page_id % 8 AS int) AS choice")


def translate_batch(spark, sf_dir):
    return jobs.translate_batch(req(spark, sf_dir), P.phrasebook(spark))


def translate_batch_memory(spark, sf_dir):
    book = _table(spark, sf_dir, "documents").selectExpr("text AS source_text", "concat(lang, ':', cast(doc_id AS string)) AS translated_text", "doc_id AS version")
    return jobs.translate_batch(req(spark, sf_dir), P.latest(book))


def translate_batch_stored_memory(spark, sf_dir):
    """The same from the memory as it is stored: bucketed, behind its filter."""
    book = _table(spark, sf_dir, "documents").selectExpr("text AS source_text", "concat(lang, ':', cast(doc_id AS string)) AS translated_text", "doc_id AS version")
    at = new_path(spark, "memory")
    table = at.rsplit("/", 1)[1].replace("-", "_")
    M.store_memory(P.latest(book), table, path=at)
    rows = M.translate_memory(R.apply_default_pair(req(spark, sf_dir)), table)
    return R.respond(rows.withColumn("error_message", F.lit(None).cast("string")))


def engine_map_in_pandas(spark, sf_dir):
    return jobs.translate_batch_engine(req(spark, sf_dir), engines.PhrasebookEngine(P.PHRASES))


def engine_dealt_by_cost(spark, sf_dir):
    """The same, with the calls dealt to 64 tasks of about as many characters each."""
    return jobs.translate_batch_engine(req(spark, sf_dir), engines.PhrasebookEngine(P.PHRASES), partitions=64)


def engine_quick_preview(spark, sf_dir):
    return engines.quick_preview_engine(req(spark, sf_dir), engines.PhrasebookEngine(P.PHRASES)).select("request_id", "preview")


def engine_pieces(spark, sf_dir):
    """Answers that an engine gives piece by piece, assembled."""
    return jobs.translate_batch_pieces(req(spark, sf_dir), engines.PhrasebookEngine(P.PHRASES))


def engine_pieces_not_loaded(spark, sf_dir):
    return jobs.translate_batch_pieces(req(spark, sf_dir), engines.FileEngine(""))


def quick_preview_llm(spark, sf_dir):
    return P.quick_preview(req(spark, sf_dir), P.phrasebook(spark), llm=True).select("request_id", "preview")


def engine_quick_preview_llm(spark, sf_dir):
    """Previews of an engine whose model is not there."""
    return engines.quick_preview_engine(req(spark, sf_dir), engines.FileEngine("")).select("request_id", "preview")


def engine_not_loaded(spark, sf_dir):
    return jobs.translate_batch_engine(req(spark, sf_dir), engines.FileEngine(""))


def translate_no_model(spark, sf_dir):
    return R.respond(R.gate_model(req(spark, sf_dir), F.lit(False)).withColumn("translated_text", F.lit(None).cast("string")))


def task_status(spark, sf_dir):
    rows = R.gate_model(req(spark, sf_dir), F.col("request_id") % 2 == 0).withColumn("translated_text", F.when(F.col("request_id") % 6 != 2, F.col("text")))
    return R.task_status(rows).select("request_id", "status")


def quick_preview(spark, sf_dir):
    return P.quick_preview(req(spark, sf_dir), P.phrasebook(spark)).select("request_id", "preview")


def resolve_languages(spark, sf_dir):
    rows = req(spark, sf_dir)
    rows = rows.select("request_id", "source_lang").unionByName(rows.select("request_id", F.upper("source_lang").alias("source_lang")))
    found = R.resolve_languages(rows)
    return found.withColumns({"back": T.from_code_name(F.col("code_name")), "by_display": from_display_name(F.col("display_name"))})


def default_pair(spark, sf_dir):
    return R.apply_default_pair(req(spark, sf_dir)).select("request_id", "source_lang", "target_lang")


def eligible_targets(spark, sf_dir):
    return R.keep_eligible_targets(req(spark, sf_dir)).select("request_id", "target_lang")


def ineligible_targets(spark, sf_dir):
    return R.reject_ineligible_targets(req(spark, sf_dir)).select("request_id", "target_lang")


def pairs_of_requests(spark, sf_dir):
    """How often each pair that a user may choose is asked for."""
    asked = R.apply_default_pair(req(spark, sf_dir)).groupBy("source_lang", "target_lang").agg(F.count(F.lit(1)).alias("n"))
    return language_pairs(spark).join(asked, ["source_lang", "target_lang"], "left").select("source_lang", "target_lang", "source_display", "target_display", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def build_prompt(spark, sf_dir):
    rows = R.apply_default_pair(req(spark, sf_dir))
    return rows.select("request_id", T.build_prompt(F.col("text"), F.col("source_lang"), F.col("target_lang")).alias("prompt"))


def swap_direction(spark, sf_dir):
    rows = P.translate_phrasebook(R.apply_default_pair(req(spark, sf_dir)), P.phrasebook(spark))
    return R.swap_direction(rows).select("request_id", "text", "translated_text", "source_lang", "target_lang")


def char_counts(spark, sf_dir):
    text = F.col("text")
    return _table(spark, sf_dir, "documents").select("doc_id", T.byte_count(text).alias("n_bytes"), T.char_count(text).alias("n_code_points"))


def trim_artifacts(spark, sf_dir):
    padded = F.expr("concat(text, CASE doc_id % 4 WHEN 0 THEN ' ' WHEN 1 THEN '\\n\\t' WHEN 2 THEN '\\r\\n ' ELSE '' END)")
    return _table(spark, sf_dir, "documents").select("doc_id", T.trim_artifacts(padded).alias("text"))


def split_codepoints(spark, sf_dir):
    return tok(spark, sf_dir).groupBy("task_id", "piece").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))


def stop_at_control(spark, sf_dir):
    return K.stop_at_control(tok(spark, sf_dir)).groupBy("task_id").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last_seq"))


def cap_tokens(spark, sf_dir):
    return K.cap_tokens(tok(spark, sf_dir), budgets(spark, sf_dir)).groupBy("task_id").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last_seq"))


def running_char_count(spark, sf_dir):
    return K.running_char_count(tok(spark, sf_dir)).groupBy("task_id").agg(F.max("n_chars").alias("n_chars"), F.sum("n_chars").alias("sum_chars"))


def assemble_streams(spark, sf_dir):
    return K.assemble_streams(tok(spark, sf_dir), budgets(spark, sf_dir), dense=True)


def assemble_ocr_streams(spark, sf_dir):
    """The same logs in a recognition's context: no cap, a piece that no longer fits fails the task."""
    return K.assemble_streams(tok(spark, sf_dir), budgets(spark, sf_dir), context=K.CONTEXT_OCR, ocr=True, dense=True)


def render_result(spark, sf_dir):
    return R.render_result(assemble_streams(spark, sf_dir)).select("task_id", "shown")


def render_ocr_result(spark, sf_dir):
    return R.render_result(assemble_ocr_streams(spark, sf_dir), ocr=True).select("task_id", "shown")


def supersede_requests(spark, sf_dir):
    return R.supersede_requests(sess(spark, sf_dir)).select("session_id", "request_id", F.col("cancelled").cast("int").alias("cancelled"), "error_message")


def _history(spark, sf_dir) -> DataFrame:
    rows = P.translate_phrasebook(R.apply_default_pair(req(spark, sf_dir)), P.phrasebook(spark))
    rows = rows.withColumns({"error_message": F.lit(None).cast("string"), "ts": F.timestamp_seconds(F.lit(1700000000) + F.col("request_id"))})
    return admit_history(R.respond(rows, keep=("source_lang", "target_lang", "ts")))


def _shown(history: DataFrame) -> DataFrame:
    return history.select("id", "source_text", "translated_text", "source_lang", "target_lang", F.unix_timestamp("ts").alias("ts"))


def history_admitted(spark, sf_dir):
    return _shown(_history(spark, sf_dir))


def history_scan(spark, sf_dir):
    """The admitted history, filed and read again in its order."""
    at = new_path(spark, "history")
    append_history(_history(spark, sf_dir), at)
    return _shown(scan_history(spark, at))


def history_range(spark, sf_dir):
    """The history filed in three batches, and what a scan of two and a half hours finds."""
    at, rows = new_path(spark, "history"), _history(spark, sf_dir)
    for hour in range(3):
        append_history(rows.where(F.floor(F.unix_timestamp("ts") / 3600) % 3 == hour), at, batch=f"hour {hour}")
    since = datetime.fromtimestamp(1700000000 + 100, timezone.utc)
    return _shown(scan_history(spark, at, since, since + timedelta(minutes=150)))


def history_append_clear(spark, sf_dir):
    """Filed, cleared, filed as two batches and each of these once more, as a retry would: each record is there two times."""
    at, rows = new_path(spark, "history"), _history(spark, sf_dir)
    append_history(rows, at)
    clear_history(spark, at)
    for batch in ("one", "two", "one", "two"):
        append_history(rows, at, batch)
    return _shown(scan_history(spark, at)).groupBy("id", "ts", "target_lang").agg(F.count(F.lit(1)).alias("n"))


def requests_read(spark, sf_dir):
    """Requests written as JSON lines and read with the fixed schema."""
    at = new_path(spark, "requests")
    req(spark, sf_dir).write.json(at)
    return read_requests(spark, at, "json").select(*(c.split()[0] for c in REQUESTS.split(", ")))


def _filed(spark, sf_dir, wrap=lambda name, content: content) -> str:
    """Pages written as one file each; their folder."""
    at = new_path(spark, "images")

    def write(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(at if "://" in at or at.startswith("file:") else f"file://{at}")
        store.create_dir(root, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if (data := wrap(name, content)) is not None:
                    with store.open_output_stream(f"{root}/{name}") as f:
                        f.write(data)
            yield batch.select(["path"])

    img(spark, sf_dir).select("path", "content").mapInArrow(write, "path string").count()
    return at


def images_read(spark, sf_dir):
    """Pages written as one file each; name and length of those that are images."""
    return read_images(spark, _filed(spark, sf_dir)).select(F.substring_index("path", "/", -1).alias("name"), F.col("length").cast("bigint").alias("length"), F.sha2("content", 256).alias("content_sha256"))


def ocr_prompt(spark, sf_dir):
    task = T.ocr_task_type(F.col("choice"))
    return img(spark, sf_dir).select("path", task.alias("task_type"), T.ocr_prompt(task).alias("prompt"))


#: What stands before and behind the text of a page that is filed as an image of one pixel.
_AROUND = {
    "png": (bytes.fromhex("89504e470d0a1a0a0000000d49484452000000010000000108000000003a7e9b55"), bytes.fromhex("0000000049454e44ae426082")),
    "jpeg": (bytes.fromhex("ffd8ffc0000b080001000101011100"), bytes.fromhex("ffd9")),
    "bmp": (bytes.fromhex("424d000000000000000036000000280000000100000001000000010018000000000004000000000000000000000000000000000000000000"), b""),
    "webp": (bytes.fromhex("524946461200000057454250") + b"VP8L" + bytes.fromhex("050000002f0000000000"), b""),
}
#: A page in so many is filed as it is, under the name of an image.
NO_IMAGES = 25


def _as_image(name: str, content: bytes) -> bytes | None:
    if name.endswith(".txt"):  # these are asked for and not there
        return None
    if not content or int(name[4:].split(".")[0]) % NO_IMAGES == NO_IMAGES - 1:
        return content
    before, behind = _AROUND[FORMATS[name.rsplit(".", 1)[1]]]
    return before + content + behind


class PageEngine(engines.StubOcrEngine):
    """Answers with the task's name and the page that is filed as an image."""

    key = ("pages",)

    def recognize(self, rows):
        return super().recognize(rows.assign(content=[self._page(*x) for x in zip(rows["path"], rows["content"], strict=True)]))

    def recognize_pieces(self, row):
        row.content = self._page(row.path, row.content)
        return super().recognize_pieces(row)

    def _page(self, path: str, content: bytes) -> bytes:
        before, behind = _AROUND[FORMATS[path.rsplit(".", 1)[1]]]
        return content[len(before) : len(content) - len(behind)]


def _recognized(spark, sf_dir, engine, **settings) -> DataFrame:
    at = qualified(spark, _filed(spark, sf_dir, _as_image)) + "/"
    manifest = img(spark, sf_dir).select(F.concat(F.lit(at), "path").alias("path"), T.ocr_task_type(F.col("choice")).alias("task_type"))
    found = jobs.recognize_batch(manifest, list_images(spark, at), engine, **settings)
    return found.withColumns({c: F.replace(c, F.lit(at)) for c in ("path", "error_message")})


def recognize_batch(spark, sf_dir):
    return _recognized(spark, sf_dir, PageEngine())


def recognize_batch_pieces(spark, sf_dir):
    """The same from an engine that answers piece by piece."""
    return _recognized(spark, sf_dir, PageEngine(), pieces=True)


def recognize_no_model(spark, sf_dir):
    return _recognized(spark, sf_dir, engines.FileEngine(""))


def _stream(spark, sf_dir) -> DataFrame:
    """`documents` as a file stream; the pattern names that one file or folder, as file streams take no single file."""
    return spark.readStream.schema(_table(spark, sf_dir, "documents").schema).parquet(f"{sf_dir}/documents.parque[t]")


def stream_translate_query(spark, sf_dir):
    """`documents` as a file stream of requests, answered and filed; returns the history."""
    at = new_path(spark, "stream")
    asked = _stream(spark, sf_dir).selectExpr("doc_id AS request_id", "text", f"{SOURCE} AS source_lang", f"{TARGET} AS target_lang")
    stream_translate(asked, P.phrasebook(spark), f"{at}/responses", f"{at}/history", f"{at}/checkpoint").awaitTermination()
    return scan_history(spark, f"{at}/history").select("id", "source_text", "translated_text", "source_lang", "target_lang")


def stream_assemble_query(spark, sf_dir):
    """`documents` as a stream of token events (a cancel after its hundredth piece where one is planned, an end behind the last), assembled; equals assemble_streams.
    Each text's events are dealt anew, so most come out of order."""
    at = new_path(spark, "stream")
    cancelled = "doc_id % 100 = 0"
    # a cancel that lies behind the last piece stays away: the text is whole by then
    late = f"({cancelled} AND char_length(text) >= 100)"
    # a letter stands for the end, and one for the cancel; backward, the end comes first
    said = f"concat(CASE WHEN {late} THEN concat(substr(text, 1, 100), 'c', substr(text, 101)) ELSE coalesce(text, '') END, 'e')"
    events = _stream(spark, sf_dir).selectExpr("doc_id AS task_id", "cast(3000 + doc_id % 1000 AS int) AS prompt_tokens", f"coalesce({late}, false) AS late", f"{said} AS said")
    events = events.selectExpr("task_id", "prompt_tokens", "late", "cast(char_length(said) AS bigint) AS n", "posexplode(split(reverse(said), '')) AS (at, piece)").withColumn("seq", F.col("n") - F.col("at"))
    kind = "CASE WHEN at = 0 THEN 'end' WHEN late AND seq = 101 THEN 'cancel' ELSE 'token' END"
    events = events.withColumn("event", F.expr(kind)).selectExpr("task_id", "prompt_tokens", "seq", "CASE WHEN event = 'token' THEN piece ELSE '' END AS piece", "event = 'token' AND piece = '\n' AS is_control", "event")
    found = stream_assemble(events)
    with state_store(spark):
        found.writeStream.format("parquet").option("path", f"{at}/results").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{at}/results")


QUERIES = {
    **{f.__name__: f for f in (translate_batch, translate_batch_memory, translate_batch_stored_memory, engine_map_in_pandas, engine_dealt_by_cost, translate_no_model, task_status, quick_preview, resolve_languages, default_pair, eligible_targets, ineligible_targets, pairs_of_requests, build_prompt, swap_direction, char_counts, trim_artifacts, split_codepoints, stop_at_control, cap_tokens, running_char_count, assemble_streams, render_result, supersede_requests, history_admitted, ocr_prompt, recognize_batch, recognize_batch_pieces, engine_quick_preview, engine_not_loaded, engine_pieces, engine_pieces_not_loaded, quick_preview_llm, engine_quick_preview_llm, assemble_ocr_streams, render_ocr_result, history_scan, history_range, history_append_clear, requests_read, images_read, recognize_no_model)},
    "stream_translate": stream_translate_query,
    "stream_assemble": stream_assemble_query,
}


# ---------------------------------------------------------------- SQL

_LANG = "lang_t AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{c}', '{d}', '{n}')" for i, (c, d, n) in enumerate(LANGUAGES)) + ") AS t(ordinal, code, display_name, code_name))"
_REQ = f"req AS (SELECT doc_id AS request_id, coalesce(text, '') AS text, {SOURCE} AS source_lang, {TARGET} AS target_lang FROM documents)"
_PAIR = _REQ + ", pair AS (SELECT request_id, text, coalesce(source_lang, 'en') AS source_lang, coalesce(target_lang, 'zh') AS target_lang FROM req)"
_BOOK = "book AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in P.PHRASES) + ") AS t(source_text, phrase))"
_TOK = "tok AS (SELECT doc_id AS task_id, unnest(string_split(text, '')) AS piece, generate_subscripts(string_split(text, ''), 1) AS seq FROM documents WHERE text <> '')"
_ANSWER = f"CASE WHEN text = '' THEN '' ELSE coalesce(phrase, '{P.ANSWER_OPEN}' || text || '{P.answer_close()}') END"


def _responses(book: str) -> str:
    return f"""WITH {_PAIR}, {book}, a AS (SELECT request_id, text, {_ANSWER} AS t FROM pair LEFT JOIN book ON text = source_text)
SELECT request_id, true AS success, text AS original_text, t AS translated_text, '' AS error_message, strlen(text) AS source_char_count, strlen(t) AS target_char_count FROM a"""


_MEMORY = "book AS (SELECT text AS source_text, arg_max(lang || ':' || doc_id, doc_id) AS phrase FROM documents GROUP BY text)"
_ASSEMBLED = f"""WITH {_TOK}, b AS (SELECT doc_id AS task_id, 3000 + doc_id % 1000 AS p, CASE WHEN doc_id % 100 = 0 THEN 100 END AS k FROM documents),
c AS (SELECT task_id, count(*) AS total, min(CASE WHEN piece = chr(10) THEN seq END) AS control FROM tok GROUP BY task_id),
m AS (SELECT b.task_id, p, k, control, least(coalesce(control - 1, total, 0), 4096, 4096 - p) AS most FROM b LEFT JOIN c USING (task_id)),
n AS (SELECT *, coalesce(k <= most, false) AS cancelled, CASE WHEN k <= most THEN k ELSE most END AS n_tokens FROM m),
r AS (SELECT n.task_id, coalesce(string_agg(piece, '' ORDER BY seq), '') AS raw_text FROM n LEFT JOIN tok ON tok.task_id = n.task_id AND seq <= n_tokens GROUP BY n.task_id),
s AS (SELECT task_id, NOT cancelled AS success, rtrim(raw_text, chr(32) || chr(10) || chr(13) || chr(9)) AS full_text, raw_text, CASE WHEN cancelled THEN '{R.CANCELLED}' ELSE '' END AS error_message, n_tokens::INTEGER AS n_tokens,
  CASE WHEN cancelled THEN 'cancelled' WHEN n_tokens = 4096 THEN 'max_tokens' WHEN n_tokens = 4096 - p THEN 'context' WHEN control IS NOT NULL THEN 'control' ELSE 'end' END AS stop_reason FROM n JOIN r USING (task_id))
"""
_ASSEMBLED_OCR = f"""WITH {_TOK}, b AS (SELECT doc_id AS task_id, 3000 + doc_id % 1000 AS p, CASE WHEN doc_id % 100 = 0 THEN 100 END AS k FROM documents),
c AS (SELECT task_id, count(*) AS total, min(CASE WHEN piece = chr(10) THEN seq END) AS control FROM tok GROUP BY task_id),
m AS (SELECT b.task_id, p, k, control, coalesce(control - 1, total, 0) AS spoken, least(coalesce(control - 1, total, 0), 8193 - p) AS most FROM b LEFT JOIN c USING (task_id)),
n AS (SELECT *, coalesce(k <= most, false) AS cancelled, CASE WHEN k <= most THEN k ELSE most END AS n_tokens FROM m),
r AS (SELECT n.task_id, coalesce(string_agg(piece, '' ORDER BY seq), '') AS raw_text FROM n LEFT JOIN tok ON tok.task_id = n.task_id AND seq <= n_tokens GROUP BY n.task_id),
s AS (SELECT task_id, NOT cancelled AND spoken <= 8192 - p AS success, CASE WHEN cancelled THEN raw_text ELSE rtrim(raw_text, chr(32) || chr(10) || chr(13) || chr(9)) END AS full_text, raw_text,
  CASE WHEN cancelled THEN '{R.CANCELLED}' WHEN spoken > 8192 - p THEN '{K.DECODE_ERROR_OCR}' ELSE '' END AS error_message, n_tokens::INTEGER AS n_tokens,
  CASE WHEN cancelled THEN 'cancelled' WHEN spoken > 8192 - p THEN 'error' WHEN control IS NOT NULL THEN 'control' ELSE 'end' END AS stop_reason FROM n JOIN r USING (task_id))
"""
_CODE = "coalesce((SELECT code FROM lang_t WHERE code_name = {0}), 'AutoDetect')"
_NAME = "coalesce((SELECT display_name FROM lang_t WHERE code_name = {0}), (SELECT display_name FROM lang_t WHERE ordinal = 0))"
_TASK = "CASE page_id % 8 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(T.OCR_TASKS)) + " ELSE 'ocr' END"
_PREFIX = "CASE task_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.OCR_PREFIXES.items()) + " ELSE 'OCR:' END"
_NL = "chr(10)"


def _sql_text(s: str) -> str:
    return " || ".join(f"'{part}'" if part else "''" for part in s.split("\n")).replace(" || ", " || chr(10) || ")


_HISTORY = f"WITH {_PAIR}, {_BOOK} SELECT request_id::VARCHAR AS id, text AS source_text, {_ANSWER} AS translated_text, source_lang, target_lang, 1700000000 + request_id AS ts FROM pair LEFT JOIN book ON text = source_text WHERE text <> ''"
_NO_MODEL = f"WITH {_REQ} SELECT request_id, text = '' AS success, text AS original_text, '' AS translated_text, CASE WHEN text = '' THEN '' ELSE '{R.NOT_LOADED}' END AS error_message, strlen(text) AS source_char_count, 0::BIGINT AS target_char_count FROM req"
_PREVIEW = f"WITH {_REQ}, {_BOOK} SELECT request_id, CASE WHEN text = '' THEN '' WHEN phrase IS NOT NULL THEN phrase WHEN contains(text, 'Hello') THEN '{P.greeting()}' ELSE '{P.PREVIEW}' || text END AS preview FROM req LEFT JOIN book ON text = source_text"
_PREVIEW_LLM = f"WITH {_REQ} SELECT request_id, CASE WHEN text = '' THEN '' ELSE '{P.PREVIEW_LLM}' || text END AS preview FROM req"
_SEEN = f"""WITH i AS (SELECT {IMAGE} AS path, {_TASK} AS task_type, html, page_id % 6 <> 5 AS there, page_id % {NO_IMAGES} < {NO_IMAGES - 1} AND strlen(html) > 0 AS good FROM pages),
t AS (SELECT path, there, good, CASE WHEN there AND {{ready}} AND good THEN rtrim(task_type || ': ' || html, chr(32) || chr(10) || chr(13) || chr(9)) ELSE '' END AS text FROM i)
SELECT path, there AND {{ready}} AND good AS success, text, CASE WHEN NOT there THEN '{jobs.NO_IMAGE}' || path || ')' WHEN NOT {{ready}} THEN '{jobs.NOT_LOADED_OCR}' WHEN NOT good THEN '{jobs.BAD_IMAGE}' || path || ')' ELSE '' END AS error_message, length(text) AS n_chars FROM t"""

ORACLE_SQL = {
    "translate_batch": _responses(_BOOK),
    "engine_map_in_pandas": _responses(_BOOK),
    "engine_dealt_by_cost": _responses(_BOOK),
    "translate_batch_memory": _responses(_MEMORY),
    "translate_batch_stored_memory": _responses(_MEMORY),
    "translate_no_model": _NO_MODEL,
    "engine_not_loaded": _NO_MODEL,
    "task_status": f"WITH {_REQ} SELECT request_id, CASE WHEN text <> '' AND request_id % 2 <> 0 THEN 'Failed' WHEN request_id % 6 <> 2 THEN 'Completed' ELSE 'Pending' END AS status FROM req",
    "quick_preview": _PREVIEW,
    "engine_quick_preview": _PREVIEW,
    "engine_pieces": _responses(_BOOK),
    "engine_pieces_not_loaded": _NO_MODEL.replace(R.NOT_LOADED, R.NOT_LOADED_STREAM),
    "quick_preview_llm": _PREVIEW_LLM,
    "engine_quick_preview_llm": _PREVIEW_LLM,
    "resolve_languages": f"WITH {_LANG}, {_REQ}, r AS (SELECT request_id, source_lang FROM req UNION ALL SELECT request_id, upper(source_lang) FROM req), c AS (SELECT request_id, source_lang, coalesce(code, 'AutoDetect') AS code FROM r LEFT JOIN lang_t ON code_name = source_lang) SELECT request_id, source_lang, c.code, code_name, display_name, c.code AS back, c.code AS by_display FROM c JOIN lang_t ON lang_t.code = c.code",
    "default_pair": f"WITH {_PAIR} SELECT request_id, source_lang, target_lang FROM pair",
    "eligible_targets": f"WITH {_LANG}, {_REQ} SELECT request_id, target_lang FROM req SEMI JOIN lang_t ON code_name = target_lang AND code <> 'AutoDetect'",
    "ineligible_targets": f"WITH {_LANG}, {_REQ} SELECT request_id, target_lang FROM req ANTI JOIN lang_t ON code_name = target_lang AND code <> 'AutoDetect'",
    "pairs_of_requests": f"WITH {_LANG}, {_PAIR} SELECT s.code_name AS source_lang, t.code_name AS target_lang, s.display_name AS source_display, t.display_name AS target_display, count(request_id) AS n FROM lang_t s JOIN lang_t t ON t.ordinal > 0 LEFT JOIN pair ON source_lang = s.code_name AND target_lang = t.code_name GROUP BY ALL",
    "build_prompt": f"WITH {_LANG}, {_PAIR}, c AS (SELECT request_id, text, coalesce(s.code, 'AutoDetect') AS code, s.display_name AS sd, coalesce(t.display_name, '自动检测') AS td FROM pair LEFT JOIN lang_t s ON s.code_name = source_lang LEFT JOIN lang_t t ON t.code_name = target_lang) SELECT request_id, {_sql_text(T.CHAT_OPEN)} || CASE WHEN code = 'AutoDetect' THEN '{T.INTO}' || td ELSE '{T.TRANSLATE_FROM}' || sd || '{T.TRANSLATE_TEXT}' || td END || {_sql_text(T.ONLY)} || text || {_sql_text(T.CHAT_CLOSE)} AS prompt FROM c",
    "swap_direction": f"WITH {_LANG}, {_PAIR}, {_BOOK} SELECT request_id, {_ANSWER} AS text, text AS translated_text, CASE WHEN code = 'AutoDetect' OR code IS NULL THEN source_lang ELSE target_lang END AS source_lang, CASE WHEN code = 'AutoDetect' OR code IS NULL THEN target_lang ELSE source_lang END AS target_lang FROM pair LEFT JOIN book ON text = source_text LEFT JOIN lang_t ON code_name = source_lang",
    "char_counts": "SELECT doc_id, strlen(text) AS n_bytes, length(text) AS n_code_points FROM documents",
    "trim_artifacts": "SELECT doc_id, rtrim(text || CASE doc_id % 4 WHEN 0 THEN ' ' WHEN 1 THEN chr(10) || chr(9) WHEN 2 THEN chr(13) || chr(10) || ' ' ELSE '' END, chr(32) || chr(10) || chr(13) || chr(9)) AS text FROM documents",
    "split_codepoints": f"WITH {_TOK} SELECT task_id, piece, count(*) AS n, min(seq)::INTEGER AS first_seq FROM tok GROUP BY task_id, piece",
    "stop_at_control": f"WITH {_TOK}, s AS (SELECT *, min(CASE WHEN piece = chr(10) THEN seq END) OVER (PARTITION BY task_id) AS stop FROM tok) SELECT task_id, count(*) AS n, max(seq)::INTEGER AS last_seq FROM s WHERE stop IS NULL OR seq < stop GROUP BY task_id",
    "cap_tokens": f"WITH {_TOK}, r AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY seq) AS i FROM tok) SELECT task_id, count(*) AS n, max(seq)::INTEGER AS last_seq FROM r WHERE i <= least(4096, 4096 - (3000 + task_id % 1000)) GROUP BY task_id",
    "running_char_count": f"WITH {_TOK}, r AS (SELECT task_id, sum(length(piece)) OVER (PARTITION BY task_id ORDER BY seq) AS n_chars FROM tok) SELECT task_id, max(n_chars)::BIGINT AS n_chars, sum(n_chars)::BIGINT AS sum_chars FROM r GROUP BY task_id",
    "assemble_streams": _ASSEMBLED + "SELECT * FROM s",
    "render_result": _ASSEMBLED + f"SELECT task_id, CASE WHEN success THEN full_text ELSE raw_text || {_sql_text(R.STOPPED_NOTE)} END AS shown FROM s",
    "assemble_ocr_streams": _ASSEMBLED_OCR + "SELECT * FROM s",
    "render_ocr_result": _ASSEMBLED_OCR + f"SELECT task_id, CASE WHEN success THEN full_text WHEN error_message = '{R.CANCELLED}' THEN raw_text || {_sql_text(R.STOPPED_NOTE_OCR)} ELSE '{R.ERROR_PREFIX_OCR}' || error_message END AS shown FROM s",
    "supersede_requests": f"WITH s AS (SELECT user_id AS session_id, event_id AS request_id, coalesce(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < ts + to_minutes(ceil(value)::BIGINT), false) AS c FROM events) SELECT session_id, request_id, c::INTEGER AS cancelled, CASE WHEN c THEN '{R.CANCELLED}' ELSE '' END AS error_message FROM s",
    "history_admitted": _HISTORY,
    "history_scan": _HISTORY,
    "history_range": f"SELECT * FROM ({_HISTORY}) WHERE ts >= 1700000100 AND ts < 1700009100",
    "history_append_clear": f"SELECT id, ts, target_lang, count(*) * 2 AS n FROM ({_HISTORY}) GROUP BY ALL",
    "requests_read": f"WITH {_REQ} SELECT request_id, text, source_lang, target_lang FROM req",
    "images_read": f"SELECT {IMAGE} AS name, strlen(html) AS length, sha256(html) AS content_sha256 FROM pages WHERE page_id % 6 <> 5",
    "ocr_prompt": f"WITH i AS (SELECT {IMAGE} AS path, {_TASK} AS task_type FROM pages) SELECT path, task_type, {_sql_text(T.CHAT_OPEN)} || '<__media__>' || chr(10) || {_PREFIX} || {_sql_text(T.CHAT_CLOSE)} AS prompt FROM i",
    "recognize_batch": _SEEN.format(ready="true"),
    "recognize_batch_pieces": _SEEN.format(ready="true"),
    "recognize_no_model": _SEEN.format(ready="false"),
    "stream_assemble": _ASSEMBLED + "SELECT * FROM s",
    "stream_translate": f"WITH {_PAIR}, {_BOOK} SELECT request_id::VARCHAR AS id, text AS source_text, {_ANSWER} AS translated_text, source_lang, target_lang FROM pair LEFT JOIN book ON text = source_text WHERE text <> ''",
}
