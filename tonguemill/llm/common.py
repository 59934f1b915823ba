"""What the operators of this subpackage share: shared storage, batch sizes, hashing helpers."""

from __future__ import annotations

import os
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from tonguemill.sources.shared import new_path, shared_dir

__all__ = ["new_path", "shared_dir"]

#: Rows in an Arrow batch; texts may be long, so far fewer than Spark's default.
BATCH_ROWS = 1000


#: Tables written within each `scratch` that is open.
_made: list[list[str]] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read again: lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    if _made:
        _made[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession):
    """Deletes, at its end, the tables that were written within it: what is to stay is written by other means, or after it."""
    _made.append([])
    try:
        yield
    finally:
        for path in _made.pop():
            removed(spark, path)


def whole_numbers(df: DataFrame, column: str) -> None:
    """Raises where a column holds no integers."""
    kind = df.schema[column].dataType
    if not isinstance(kind, (ByteType, ShortType, IntegerType, LongType)):
        raise TypeError(f"{column} must hold integers, not {kind.simpleString()}")


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a table that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def small_batches(spark: SparkSession) -> None:
    """Bounds the rows of an Arrow batch for the session, since one row may hold a very long text."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def row_key(id_col, text_col):
    """Tells rows apart that share an id but not a text; never null."""
    return F.xxhash64(id_col, text_col)


def set_aside(df: DataFrame, names: tuple[str, ...] = ()) -> tuple[DataFrame, dict[str, str]]:
    """df with every column that begins with _ or is named in names prefixed with _own_, so that an
    operator's columns cannot clash with it; and each column's new name by its old one."""
    own = {c: f"_own_{c}" if c.startswith("_") or c.lower() in names else c for c in df.columns}
    return df.select(*(F.col(f"`{c}`").alias(n) for c, n in own.items())), own


def put_back(df: DataFrame, own: dict[str, str]) -> DataFrame:
    """The columns that were set aside, under their old names."""
    return df.select(*(F.col(f"`{n}`").alias(c) for c, n in own.items()))


#: Rows numbered by one task.
NUMBERED_ROWS = 1_000_000


def numbered(df: DataFrame, order: list, within: str | None = None) -> DataFrame:
    """df (a written table) with _number, the row's place from 1 in a total order, or in its part of equal `within`, which the order then begins with.

    Rows are dealt to ranges of the order, counted by range, and numbered in each from what comes before it; the counts, one row a
    range and value of `within`, are broadcast. No task sees more than a range.
    """
    spark = df.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // NUMBERED_ROWS))
    dealt = written(df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    by = ["_range", within] if within else ["_range"]
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ahead = ahead.partitionBy(within) if within else ahead
    counts = dealt.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).select(*by, F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return dealt.withColumn("_place_in_range", place).join(F.broadcast(counts), by).withColumn("_number", F.col("_ahead") + F.col("_place_in_range")).drop("_range", "_ahead", "_place_in_range")


def file_system(path: str):
    """pyarrow file system and the path in it, for a URI or a local path."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path)


# ---------------------------------------------------------------- rolling hashes in numpy

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


class PrefixHash:
    """Polynomial hashes (mod 2**64, bytes mapped through a random table, result mixed) of any
    substring of a byte buffer, all from one prefix sum. Two are kept for 64 + extra bits."""

    def __init__(self, seed: int, base: int = _BASE):
        self.table = np.random.default_rng(seed).integers(0, _MASK, 256, dtype=np.uint64)
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.size = 0
        self._grow(1 << 16)

    def _grow(self, n: int) -> None:
        if n > self.size:
            self.size = max(n, 2 * self.size)
            ones = np.ones(1, np.uint64)
            self.power = np.cumprod(np.concatenate([ones, np.full(self.size, self.base, np.uint64)]), dtype=np.uint64)
            self.back = np.cumprod(np.concatenate([ones, np.full(self.size, self.inverse, np.uint64)]), dtype=np.uint64)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        """data: uint8. Entry i: sum over the first i bytes."""
        self._grow(len(data))
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.power[: len(data)], dtype=np.uint64, out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Mixed hash of each [start, end)."""
        return mix((prefix[end] - prefix[start]) * self.back[start] + (end - start).astype(np.uint64))

    def grams(self, prefix: np.ndarray, n: int) -> np.ndarray:
        """As spans, of every n consecutive bytes."""
        h = prefix[n:] - prefix[:-n]
        h *= self.back[: len(h)]
        h += np.uint64(n)
        return mix(h)


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser, vectorised."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def window_minima(h: np.ndarray, w: int) -> np.ndarray:
    """Winnowing: for each window of w consecutive values, the position of its smallest (leftmost on ties).

    Equal windows pick equal relative positions, and positions ascend. Fewer than w values: none. Only the upper
    32 bits of a value count; its position (below 2**32) is packed below them, so that a minimum carries its place.
    """
    n = len(h)
    if n < w:
        return np.zeros(0, np.int64)
    best = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    span = 1
    while span * 2 <= w:  # doubling: best[i] is the minimum of span values from i
        best = np.minimum(best[:-span], best[span:])
        span *= 2
    if rest := w - span:
        best = np.minimum(best[:-rest], best[rest:])
    return (best & np.uint64(0xFFFFFFFF)).astype(np.int64)
