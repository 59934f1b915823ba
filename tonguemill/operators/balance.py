"""Rows dealt to tasks by what they cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets a partition.
FINE = 64


def deal_by_cost(df: DataFrame, cost: Column, key: list[Column], partitions: int, fine: int = FINE) -> DataFrame:
    """df in `partitions` partitions of nearly equal summed cost (a number; null: 0): none exceeds the mean by more than one bucket, that is by about
    a `fine`-th of it and the costliest row.

    key tells the rows apart. By its hash they fall into partitions * fine buckets; the buckets' costs are summed before any shuffle of rows, and the running sum over
    the buckets, cut at equal steps, gives each its partition. That table, one row a bucket, is broadcast. df is read twice, so it should be a stored table.
    """
    rows = df.withColumn("_bucket", F.pmod(F.xxhash64(*key), F.lit(partitions * fine)).cast("int"))
    totals = rows.groupBy("_bucket").agg(F.sum(F.coalesce(cost, F.lit(0)).cast("double") + 1).alias("_cost"))
    upto = F.sum("_cost").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    middle = (upto - F.col("_cost") / 2) / F.sum("_cost").over(Window.partitionBy(F.lit(0)))
    dealt = totals.select("_bucket", F.least(F.floor(middle * partitions), F.lit(partitions - 1)).cast("int").alias("_to"))
    return rows.join(F.broadcast(dealt), "_bucket").repartitionById(partitions, F.col("_to")).drop("_bucket", "_to")
