"""Line dedup by winnowing over line hashes. DataFrame functions only.

A document is the sequence of its non-blank lines. Every window of RUN consecutive lines selects the
line with the smallest hash (leftmost on ties) as its fingerprint, so equal windows select equal
lines and every repeated run of RUN lines is guaranteed one. Only selected lines become rows; those whose hash
occurs at one place alone are done with. The other places are joined, and the match is extended both ways: the
windows around each of them that selected it are compared as wholes. A line goes when some window over it also starts
earlier (smaller id, or same document and earlier line); overlapping windows make up longer runs. Windows are judged on
the input, not on what is left. Blank lines (only space, tab, carriage return) stay.

With `over` given, every run of one or two lines that holds more than that many words is a window as well,
marked and judged in the same way, so passages in a few long lines go too, also in documents under RUN lines.
Words are runs other than ASCII white space.

Nothing is paired within a group: marks and first places are pre-aggregated, and each position
meets one row of its key.

Edge cases: null text stays null and has no lines; empty text stays empty; documents with fewer than
RUN lines keep all, save for the windows of `over`; rows equal in id and text are one document (neither copy is later); rows that
share an id but not a text are ordered by a hash of both; a null id sorts first; extra columns stay
as they are; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonguemill.llm.common import put_back, row_key, set_aside, written

RUN = 3
#: Words above which one or two lines are a passage of their own, for `over`.
PASSAGE = 50
_BLANK = " \t\r"


def _lines(text):
    return F.split(text, "\n", -1)


def _places(lines):
    """Numbers of the non-blank lines, from 0."""
    return F.filter(F.transform(lines, lambda x, k: F.when(F.trim(x, F.lit(_BLANK)) != "", k)), lambda k: k.isNotNull())


def fingerprints(df: DataFrame, run: int = RUN, id_col: str = "doc_id", text_col: str = "text", over: int | None = None) -> DataFrame:
    """One row a selected line: id, _key, place (hash of document and line), mark (hash of the line), around (the windows that
    selected it: at, the number of their first non-blank line, size in lines, whole, a digest)."""
    rows = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), row_key(F.col(id_col), F.col(text_col)).alias("_key"), F.filter(_lines(F.col(text_col)), lambda x: F.trim(x, F.lit(_BLANK)) != "").alias("lines"))
    rows = rows.where(F.size("lines") >= (run if over is None else 1)).withColumn("hashes", F.transform("lines", lambda x: F.xxhash64(x)))
    sizes = [run]
    if over is not None:
        rows = rows.withColumn("words", F.transform("lines", lambda x: F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+"))))
        sizes += [n for n in (1, 2) if n < run]

    def window(at, n, offset):
        """The window of n lines in which line `at` stands at `offset`, where it selects that line."""
        first = at - offset
        part = lambda c: F.slice(c, F.greatest(first, F.lit(0)) + 1, n)
        inside = (first >= 0) & (first + n <= F.size("lines"))
        holds = F.lit(True) if n == run else F.aggregate(part("words"), F.lit(0), lambda acc, k: acc + k) > over
        chosen = F.array_position(part("hashes"), F.array_min(part("hashes"))) == offset + 1
        whole = F.unhex(F.md5(F.array_join(part("lines"), "\n")))
        return F.when(inside & holds & chosen, F.struct(first.alias("at"), F.lit(n).alias("size"), whole.alias("whole")))

    around = lambda at: F.array_compact(F.array(*(window(at, n, o) for n in sizes for o in range(n))))
    each = F.transform("hashes", lambda mark, at: F.struct(at.alias("line"), mark.alias("mark"), around(at).alias("around")))
    picked = rows.select("id", "_key", F.explode(F.filter(each, lambda f: F.size(f["around"]) > 0)).alias("f"))
    return picked.select("id", "_key", F.xxhash64("_key", "id", "f.line").alias("place"), "f.mark", "f.around")


def repeated(found: DataFrame) -> DataFrame:
    """id, _key, at, size of the windows of the fingerprints `found` that also start earlier.

    Places that share a mark are extended to the windows around them, and each window meets the first of its kind. Marks
    and first places are pre-aggregated and written, so the joins' hot keys are split by Spark's skew join.
    """
    found = written(found, "lines")
    several = F.min("place") != F.max("place")  # rows of equal documents have equal places
    marks = written(found.groupBy("mark").agg(several.alias("again")).where("again").select("mark"), "lines-marks")
    near = written(found.join(marks, "mark", "left_semi").select("id", "_key", "place", F.explode("around").alias("w")).select("id", "_key", "place", "w.*"), "lines-near")
    start = F.struct("id", "_key", "at")
    first = written(near.groupBy("whole").agg(F.min(start).alias("first"), several.alias("again")).where("again").select("whole", "first"), "lines-first")
    return near.join(first, "whole").where(start > F.col("first")).select("id", "_key", "at", "size").distinct()


def marked(df: DataFrame, run: int = RUN, id_col: str = "doc_id", text_col: str = "text", over: int | None = None) -> DataFrame:
    """df with `_starts`: the later windows of each row (null: none), or with `over` their lines."""
    later = repeated(fingerprints(df, run, id_col, text_col, over))
    starts = F.collect_set("at") if over is None else F.array_distinct(F.flatten(F.collect_list(F.sequence("at", F.col("at") + F.col("size") - 1))))
    # the same id with other text is another document; the same id and text is the same one
    later = later.groupBy("id", "_key").agg(F.array_sort(starts).alias("_starts")).select(F.col("id").alias("_id2"), F.col("_key").alias("_key2"), "_starts")
    rows = df.withColumn("_key", row_key(F.col(id_col), F.col(text_col)))
    return rows.join(later, F.col("_key").eqNullSafe(F.col("_key2")) & F.col(id_col).eqNullSafe(F.col("_id2")), "left").drop("_id2", "_key2", "_key")


def _cut(rows: DataFrame, text, run: int) -> DataFrame:
    """rows with `_new`, the text that stays, and `_places`. Lines are columns of their own, so that no lambda splits a text again."""
    rows = rows.withColumn("_lines", _lines(text))
    rows = rows.withColumn("_places", _places(F.col("_lines")))
    gone = F.flatten(F.transform("_starts", lambda i: F.slice("_places", i + 1, run)))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), gone), lambda k: F.get("_lines", k))
    return rows.withColumn("_new", F.when(F.col("_starts").isNull(), text).otherwise(F.array_join(kept, "\n")))


def dedup(df: DataFrame, run: int = RUN, id_col: str = "doc_id", text_col: str = "text", drop_emptied: bool = False, over: int | None = None) -> DataFrame:
    """df with later repeated runs deleted from text_col; rows that lose all their non-blank lines go if drop_emptied."""
    df, own = set_aside(df)
    id_col, text_col = own[id_col], own[text_col]
    rows = _cut(marked(df, run, id_col, text_col, over), F.col(text_col), run if over is None else 1)
    if drop_emptied:
        rows = rows.where(F.col("_starts").isNull() | (F.trim("_new", F.lit(_BLANK + "\n")) != ""))
    return put_back(rows.withColumn(text_col, F.col("_new")), own)


def report(df: DataFrame, run: int = RUN, id_col: str = "doc_id", text_col: str = "text", over: int | None = None) -> DataFrame:
    """id, n_lines (non-blank), n_removed, kept_sha256 (of the remaining text; null text: as empty) for every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows, run = marked(df.select(id_col, text_col), run, id_col, text_col, over), run if over is None else 1
    rows = _cut(rows, text, run)
    gone = F.when(F.col("_starts").isNull(), 0).otherwise(F.size(F.array_distinct(F.flatten(F.transform("_starts", lambda i: F.sequence(i, i + run - 1))))))
    return rows.select(id_col, F.size("_places").cast("bigint").alias("n_lines"), gone.cast("bigint").alias("n_removed"), F.sha2("_new", 256).alias("kept_sha256"))


SQL = rf"""
WITH l AS (SELECT doc_id, k, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents)),
b AS (SELECT doc_id, k, line, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS j FROM l WHERE trim(line, chr(32) || chr(9) || chr(13)) <> ''),
w AS (SELECT doc_id, j, line || chr(10) || lead(line, 1) OVER d || chr(10) || lead(line, 2) OVER d AS whole FROM b WINDOW d AS (PARTITION BY doc_id ORDER BY j)),
later AS (SELECT doc_id, j FROM (SELECT doc_id, j, row_number() OVER (PARTITION BY whole ORDER BY doc_id, j) AS r FROM w WHERE whole IS NOT NULL) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, j + o AS j FROM later, (SELECT unnest([0, 1, 2]) AS o)),
kept AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.k) AS text, count(b.j) AS n, count(gone.j) AS g
  FROM (SELECT l.*, gone.j IS NULL AS stays FROM l LEFT JOIN b ON b.doc_id = l.doc_id AND b.k = l.k LEFT JOIN gone ON gone.doc_id = b.doc_id AND gone.j = b.j) AS l
  LEFT JOIN b ON b.doc_id = l.doc_id AND b.k = l.k LEFT JOIN gone ON gone.doc_id = b.doc_id AND gone.j = b.j WHERE stays GROUP BY l.doc_id),
sizes AS (SELECT b.doc_id, count(*) AS n, count(gone.j) AS g FROM b LEFT JOIN gone ON gone.doc_id = b.doc_id AND gone.j = b.j GROUP BY b.doc_id)
SELECT d.doc_id, coalesce(sizes.n, 0)::BIGINT AS n_lines, coalesce(sizes.g, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM documents AS d LEFT JOIN kept ON kept.doc_id = d.doc_id LEFT JOIN sizes ON sizes.doc_id = d.doc_id
"""

#: SQL with the windows of `over` = PASSAGE.
PASSAGES_SQL = SQL.replace("w AS (SELECT doc_id, j, line ||", "w3 AS (SELECT doc_id, j, 3 AS size, line ||").replace(
    "later AS (SELECT doc_id, j FROM (SELECT doc_id, j, row_number()",
    rf"""c AS (SELECT doc_id, j, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM b),
w AS (SELECT * FROM w3 UNION ALL SELECT doc_id, j, 1, line FROM c WHERE n > {PASSAGE} UNION ALL
  SELECT doc_id, j, 2, two FROM (SELECT doc_id, j, line || chr(10) || lead(line) OVER e AS two, n + lead(n) OVER e AS n FROM c WINDOW e AS (PARTITION BY doc_id ORDER BY j)) WHERE n > {PASSAGE}),
later AS (SELECT doc_id, j, size FROM (SELECT doc_id, j, size, row_number()""",
).replace("FROM later, (SELECT unnest([0, 1, 2]) AS o)", "FROM later, (SELECT unnest([0, 1, 2]) AS o) WHERE o < size")
