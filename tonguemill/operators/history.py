"""The history of successful translations: Parquet data under committed snapshots.

A history is a folder. Each append writes its rows below data/, in a folder of its own and partitioned by target language, and then one small file below log/, numbered
without gaps, that commits them; a clear is such a file by itself. What no file commits, as the rest of a failed attempt, is not there. Readers
take the log as it is when they begin, so they see an append or a clear wholly or not at all.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonguemill.sources.shared import deleted, put_new

HISTORY = "id string, source_text string, translated_text string, source_lang string, target_lang string, ts timestamp"


def admit_history(df: DataFrame, streamed: bool = False) -> DataFrame:
    """History rows of responses (with source_lang, target_lang, ts); a streamed answer must not be empty.

    Rows of empty requests never enter.
    """
    admitted = F.col("success") & (F.col("original_text") != "")
    if streamed:
        admitted = admitted & (F.col("translated_text") != "")
    return df.where(admitted).select(F.col("request_id").cast("string").alias("id"), F.col("original_text").alias("source_text"), "translated_text", "source_lang", "target_lang", "ts")


@dataclass(frozen=True)
class Commit:
    """One file of the log: data that it adds (None: it clears), the batch that they are, their first and last ts in microseconds."""

    number: int
    data: str | None
    batch: str | None = None
    first: int | None = None
    last: int | None = None


def _file(path: str, number: int) -> str:
    return f"{path}/log/{number:020d}.json"


def commits(spark: SparkSession, path: str) -> list[Commit]:
    """The log in order; files that are being written are not yet part of it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/log")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return []
    lines = [r.value for r in spark.read.text(f"{path}/log").collect()]
    return sorted((Commit(**json.loads(x)) for x in lines if x.endswith("}")), key=lambda c: c.number)


def _committed(spark: SparkSession, path: str, **what) -> bool:
    """Adds a commit with the next free number; False where its batch is committed already."""
    number = 0
    while True:
        known = commits(spark, path)
        if what.get("batch") is not None and any(c.batch == what["batch"] for c in known):
            return False
        number = max([number, *(c.number + 1 for c in known)])
        if put_new(spark, _file(path, number), json.dumps({"number": number, **what})):
            return True
        number += 1  # somebody else's, perhaps still being written


def append_history(df: DataFrame, path: str, batch: str | None = None) -> bool:
    """Files the rows. With a batch id they are filed once, however often that is tried: a retried or restarted job that names its batch changes nothing, and gets False."""
    spark = df.sparkSession
    if batch is not None and any(c.batch == batch for c in commits(spark, path)):
        return False
    data = f"data/commit={uuid.uuid4().hex}"
    df.write.partitionBy("target_lang").parquet(f"{path}/{data}")
    first, last = spark.read.schema(HISTORY).parquet(f"{path}/{data}").agg(F.unix_micros(F.min("ts")), F.unix_micros(F.max("ts"))).first()
    done = _committed(spark, path, data=data, batch=batch, first=first, last=last)
    if not done:
        deleted(spark, f"{path}/{data}")
    return done


def _live(known: list[Commit]) -> list[Commit]:
    """What has been added since the last clear."""
    cleared = max((c.number for c in known if c.data is None), default=-1)
    return [c for c in known if c.number > cleared]


def scan_history(spark: SparkSession, path: str, since: datetime | None = None, until: datetime | None = None) -> DataFrame:
    """All records (from `since`, to before `until`) in order of time, then id; data of other times are not opened. Times without a zone are in the session's."""
    ts = lambda t: F.lit(t).cast("timestamp")
    micros = lambda t: None if t is None else spark.range(1).select(F.unix_micros(ts(t))).first()[0]
    low, high = micros(since), micros(until)
    # rows without a ts are in no range, but among all
    inside = lambda c: (low is None and high is None) or (c.first is not None and (low is None or c.last >= low) and (high is None or c.first < high))
    found = [f"{path}/{c.data}" for c in _live(commits(spark, path)) if inside(c)]
    rows = spark.read.schema(f"{HISTORY}, commit string").option("basePath", f"{path}/data").parquet(*found) if found else spark.createDataFrame([], HISTORY)
    rows = rows if since is None else rows.where(F.col("ts") >= ts(since))
    rows = rows if until is None else rows.where(F.col("ts") < ts(until))
    return rows.select(*(c.split()[0] for c in HISTORY.split(", "))).orderBy("ts", "id")


def clear_history(spark: SparkSession, path: str) -> None:
    """Drops every record at once; batches filed before stay known. The history stays usable, and readers that have begun keep what they saw until vacuum_history."""
    _committed(spark, path, data=None)


def vacuum_history(spark: SparkSession, path: str) -> None:
    """Deletes the data of cleared records; readers that began before the clear may then fail."""
    known = commits(spark, path)
    live = {c.data for c in _live(known)}
    for c in known:
        if c.data is not None and c.data not in live:
            deleted(spark, f"{path}/{c.data}")
