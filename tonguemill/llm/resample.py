"""Target-distribution importance resampling: documents drawn as a target's word n-grams would have them.

A text, ASCII upper case lowered and its separators collapsed to single spaces, is scanned by one regular expression with
overlapped matches: between boundary lookarounds each match begins at a word and holds the runs of 1, 2, ... words that begin
there as nested groups, so the scan itself emits every n-gram. Its UTF-8 bytes' CRC-32 modulo `buckets` is the feature.
Each text is scanned once; what is kept of it is two bytes a feature. Buckets are counted over all documents and over all
target texts; a bucket's gain is how much more of the target falls into it, a document's weight the sum of its features'
gains, and Gumbel noise (of a hash of the id) added to the weight makes the highest scores a draw in proportion to it.

Edge cases: null and empty texts, and texts without words, have no feature and weight 0; texts under `least_words` words are scored
but never drawn; ids may be null (the noise is that of an empty id) and repeat (each row is scored for itself); rows that tie
in score go by smaller id, then by their place in the input, nulls last; extra columns are ignored; an empty target leaves
every gain to the documents' counts alone; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonguemill.llm.common import numbered, written

#: Separators (ASCII but letters and digits) become spaces, A-Z lower case; all other bytes stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def scanner(n: int) -> regex.Pattern:
    """Matches at each word, when overlapped: group n is the word, the groups around it are runs of up to 2, ... n words."""
    runs = b"([^ ]++)"
    for _ in range(n - 1):
        runs = b"(" + runs + b"(?: [^ ]++)?)"
    return regex.compile(b"(?<![^ ])" + runs + b"(?![^ ])")


def features(text: bytes | None, pattern: regex.Pattern, buckets: int) -> tuple[int, np.ndarray]:
    """Number of words, and the bucket of each run of 1 to n words (n: the pattern's groups)."""
    n, crc = pattern.groups, zlib.crc32
    spans = tuple(range(n, 0, -1))
    clean = b" ".join((text or b"").translate(_FOLD).split())
    # a single group comes without its tuple
    runs = (m.group(*spans) if n > 1 else (m[1],) for m in pattern.finditer(clean, overlapped=True))
    found = np.fromiter((crc(g) for own in runs for g in own), np.uint32)
    words = len(found) // n
    left = np.arange(words, 0, -1)  # words from each match to the end: runs beyond it are none
    keep = np.arange(1, n + 1) <= left[:, None]
    return words, (found.reshape(words, n)[keep] % np.uint32(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.uint32)


def scanned(df: DataFrame, n: int, buckets: int, id_col: str, text_col: str) -> DataFrame:
    """id, n_words and grams (the features' buckets, packed) for every row."""
    schema = df.select(F.col(id_col).alias("_id")).schema.simpleString()[7:-1] + ", n_words bigint, grams binary"

    def run(batches):
        pattern = scanner(n)
        for batch in batches:
            found = [features(t, pattern, buckets) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([w for w, _ in found], pa.int64()), pa.array([g.tobytes() for _, g in found], pa.binary())], ["_id", "n_words", "grams"])

    return df.select(F.col(id_col).alias("_id"), text_col).mapInArrow(run, schema)


def _type(buckets: int):
    return np.uint16 if buckets <= 1 << 16 else np.uint32


def counted(grams: DataFrame, buckets: int) -> np.ndarray:
    """How many features fall into each bucket: counted in each task, then summed; `buckets` numbers come to the driver."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for g in batch.column(0):
                total += np.bincount(np.frombuffer(g.as_buffer(), _type(buckets)), minlength=buckets)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(total[there], pa.int64())], ["bucket", "n"])

    rows = grams.select("grams").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return out


def gains(documents: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of how much likelier a bucket is in the target, with one added to every count; rounded down."""
    buckets, s, t = len(documents), int(documents.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(((b + 1) * (s + buckets)) / ((a + 1) * (t + buckets)))) for a, b in zip(documents.tolist(), target.tolist(), strict=True)], np.int64)


def resample(df: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, n: int = 3, buckets: int = 10000, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text") -> DataFrame:
    """id, n_features, weight, score, rank (from 1 among the drawn; null: not drawn) and n_words for every row."""
    rows = written(scanned(df, n, buckets, id_col, text_col), "grams")
    aimed = scanned(target.select(F.lit(0).alias("_none"), target_text), n, buckets, "_none", target_text)
    gain = gains(counted(rows, buckets), counted(aimed, buckets))
    schema = rows.select("_id").schema.simpleString()[7:-1] + ", n_words bigint, n_features bigint, weight bigint"

    def run(batches):
        for batch in batches:
            grams = [np.frombuffer(g.as_buffer(), _type(buckets)) for g in batch.column(2)]
            weights = pa.array([int(gain[g].sum()) for g in grams], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(g) for g in grams], pa.int64()), weights], ["_id", "n_words", "n_features", "weight"])

    word = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(word, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))
    scored = rows.mapInArrow(run, schema).withColumns({"score": (F.col("weight") + noise).cast("bigint"), "_open": F.col("n_words") >= least_words, "_place": F.monotonically_increasing_id()})
    scored = written(scored, "scored")
    drawn = scored.where("_open").count() * percent // 100
    order = [F.col("_open").desc(), F.col("score").desc(), F.col("_id").asc_nulls_last(), F.col("_place")]
    rank = F.when(F.col("_open") & (F.col("_number") <= drawn), F.col("_number"))
    return numbered(scored, order).select(F.col("_id").alias(id_col), "n_features", "weight", "score", rank.alias("rank"), "n_words")
