"""Ranks within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


BUCKET_ROWS = 100_000


def ranked(df: DataFrame, key: str, order: str, buckets: int | None = None) -> DataFrame:
    """Adds `rank`, 0, 1, ... within each `key`, so that no task holds a whole group.

    A group is spread over hash buckets of `order`, so many that even a group of all rows has
    about BUCKET_ROWS in each; ranks run within buckets, and the sizes of the buckets before (at
    most one row per bucket and key) are added. `order` should be unique. `df` is read three
    times and should be cheap to read.
    """
    buckets = buckets or max(64, -(-df.count() // BUCKET_ROWS))
    spread = df.withColumn("_bucket", F.pmod(F.xxhash64(order), F.lit(buckets)).cast("int"))
    sizes = spread.groupBy(key, "_bucket").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(key, "_bucket", F.coalesce(before, F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy(key, "_bucket").orderBy(order)) - 1
    numbered = spread.withColumn("_within", within)
    return numbered.join(starts, [key, "_bucket"]).withColumn("rank", F.col("_start") + F.col("_within")).drop("_bucket", "_within", "_start")
