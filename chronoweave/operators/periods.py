"""Overlapping and gapped intervals: starts and ends are ranked independently per key.

With starts and ends sorted on their own, the coverage breaks exactly where the start of rank i + 1 exceeds the
end of rank i; the starts and ends around the breaks pair up into continuous periods. Hot keys are cut into
shards by start time; a shard's carry-in is the largest end of all earlier shards.

Defined cases: a null end is open; an interval whose end is not after its start, without a start or without a
key (null or empty) covers nothing; touching intervals leave no gap; repeated rows change nothing; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.operators.skew import TimeShards
from chronoweave.sources.tables import micros

OPEN = (1 << 63) - 1
ROWS_PER_SHARD = 1 << 18


def _intervals(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    rows = df.select(F.col(key).alias("key"), micros(start).alias("s"), F.coalesce(micros(end), F.lit(OPEN)).alias("e"))
    # intervals with the same start are covered by the longest: combined before any shuffle, so ties cannot pile up
    return rows.where("key <> '' and s < e").groupBy("key", "s").agg(F.max("e").alias("e"))


def _breaks(df: DataFrame, key: str, start: str, end: str, rows_per_shard: int) -> DataFrame:
    """(key, shard, begin, finish): begin is a period's start, finish the end of the period before it (null at the first)."""
    rows = _intervals(df, key, start, end)
    shards = TimeShards(rows, "key", "s", rows_per_shard)
    rows = shards.attach(rows)
    if shards.count:
        tops = rows.groupBy("key", "shard").agg(F.max("e").alias("top"), F.min("s").alias("low"))
        earlier = Window.partitionBy("key").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
        carry = tops.select("key", F.min("low").over(earlier).alias("s"), F.max("top").over(earlier).alias("e"), "shard", F.lit(True).alias("carried"))
        rows = rows.withColumn("carried", F.lit(False)).unionByName(carry.where("s is not null"))
    else:
        rows = rows.withColumn("carried", F.lit(False))
    group = Window.partitionBy("key", "shard")
    by_start = rows.withColumn("rank", F.row_number().over(group.orderBy("s")))
    by_end = rows.withColumn("rank", F.row_number().over(group.orderBy("e")) + 1)
    ranked = by_start.select("key", "shard", "rank", F.col("s").alias("begin"), F.lit(None).cast("bigint").alias("finish"), "carried").unionByName(
        by_end.select("key", "shard", "rank", F.lit(None).cast("bigint").alias("begin"), F.col("e").alias("finish"), F.lit(False).alias("carried"))
    )
    paired = ranked.groupBy("key", "shard", "rank").agg(F.max("begin").alias("begin"), F.max("finish").alias("finish"), F.max("carried").alias("carried"))
    # rank 1 has no end before it: the first period of the key, unless it is a carry-in of earlier shards
    return paired.where("begin is not null and ((finish is null and not carried) or begin > finish)").select("key", "shard", "begin", "finish")


def gaps(df: DataFrame, key: str, start: str, end: str, rows_per_shard: int = ROWS_PER_SHARD) -> DataFrame:
    """(key, gap_from_us, gap_to_us) between the continuous periods of each key."""
    found = _breaks(df, key, start, end, rows_per_shard).where("finish is not null")
    return found.select(F.col("key").alias(key), F.col("finish").alias("gap_from_us"), F.col("begin").alias("gap_to_us"))


def periods(df: DataFrame, key: str, start: str, end: str, rows_per_shard: int = ROWS_PER_SHARD) -> DataFrame:
    """(key, period_from_us, period_to_us), period_to_us -1 for an open period."""
    breaks = _breaks(df, key, start, end, rows_per_shard)
    tops = _intervals(df, key, start, end).groupBy("key").agg(F.max("e").alias("top"))
    # the next break of a shard's last one is the first of a later shard: few rows a key
    within = breaks.withColumn("to", F.lead("finish").over(Window.partitionBy("key", "shard").orderBy("begin")))
    firsts = breaks.groupBy("key", "shard").agg(F.min_by("finish", "begin").alias("first"))
    later = firsts.withColumn("later", F.lead("first").over(Window.partitionBy("key").orderBy("shard"))).drop("first")
    begun = within.join(later, ["key", "shard"]).withColumn("to", F.coalesce("to", "later")).join(tops, "key")
    closed = F.coalesce("to", "top")
    return begun.select(F.col("key").alias(key), F.col("begin").alias("period_from_us"), F.when(closed == OPEN, F.lit(-1)).otherwise(closed).alias("period_to_us"))
