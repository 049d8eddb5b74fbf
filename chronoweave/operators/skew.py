"""Hot-key handling shared by the time-ordered and the key-lookup operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.sources.tables import cut

#: Most hot keys whose description is broadcast; beyond it the join is left to the planner.
BROADCAST_KEYS = 20_000


def hot_keys(df: DataFrame, key: str, rows: int) -> DataFrame:
    """Keys with more than ``rows`` rows and their count ``n``; counts are combined before the shuffle."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > rows)


def small(df: DataFrame, count: int, most: int | None = None) -> DataFrame:
    """Hint a broadcast only where the counted size is within the bound (``most`` for rows of two numbers)."""
    return F.broadcast(df) if count <= (most or BROADCAST_KEYS) else df


class TimeShards:
    """Cuts the rows of hot keys into time shards of about ``rows_per_shard`` rows.

    Keys of at most ``rows_per_shard`` rows stay whole in shard 0. The time span of a hot key is cut into
    equal cells, the cells are counted, and runs of cells are packed into shards, so nothing is sorted.
    Rows of equal time always share a shard. Shards of a key are numbered from 0 in the order of time.
    """

    def __init__(self, df: DataFrame, key: str, time: str, rows_per_shard: int, cells_per_shard: int = 8):
        self.key, self.time = key, time
        spans = (
            df.groupBy(key)
            .agg(F.count(F.lit(1)).alias("_n"), F.min(time).alias("_lo"), F.max(time).alias("_hi"))
            .where((F.col("_n") > rows_per_shard) & (F.col("_hi") > F.col("_lo")))
        )
        wanted = F.ceil(F.col("_n") / rows_per_shard) * cells_per_shard
        spans = spans.select(key, "_lo", F.greatest(F.lit(1), F.ceil((F.col("_hi") - F.col("_lo") + 1) / wanted)).alias("_width"))
        self.spans = cut(spans)
        self.count = self.spans.count()
        if not self.count:
            return
        cell = F.floor((F.col(time) - F.col("_lo")) / F.col("_width"))
        histogram = df.join(small(self.spans, self.count), key).groupBy(key, cell.alias("_cell")).agg(F.count(F.lit(1)).alias("_n"))
        before = Window.partitionBy(key).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
        packed = histogram.select(key, "_cell", F.floor(F.coalesce(F.sum("_n").over(before), F.lit(0)) / rows_per_shard).cast("int").alias("_slot"))
        order = Window.partitionBy(key).orderBy("_slot")
        # _from: first microsecond of the shard, the cells before the first row included
        shards = packed.groupBy(key, "_slot").agg(F.min("_cell").alias("_first")).withColumn("shard", F.row_number().over(order) - 1)
        shards = shards.join(self.spans, key).select(
            key, "shard", "_slot", F.when(F.col("shard") > 0, F.col("_lo") + F.col("_first") * F.col("_width")).alias("shard_from")
        )
        shards = shards.withColumn("shard_to", F.lead("shard_from").over(Window.partitionBy(key).orderBy("shard")))
        self.shards = cut(shards)
        self.cells = cut(packed.join(self.shards.select(key, "_slot", "shard"), [key, "_slot"]).select(key, "_cell", "shard"))
        self.cell_count = self.cells.count()

    def attach(self, df: DataFrame, time: str | None = None, shard: str = "shard") -> DataFrame:
        """``df`` with a column ``shard`` by ``time``, one of the times the shards were made of (null: no shard)."""
        if not self.count:
            return df.withColumn(shard, F.lit(0))
        cell = F.floor((F.col(time or self.time) - F.col("_lo")) / F.col("_width"))
        spread = df.join(small(self.spans, self.count), self.key, "left").withColumn("_cell", cell)
        cells = small(self.cells.withColumnRenamed("shard", shard), self.cell_count // 8)
        found = spread.join(cells, [self.key, "_cell"], "left")
        return found.withColumn(shard, F.when(F.col("_lo").isNull(), F.lit(0)).otherwise(F.col(shard))).drop("_cell", "_lo", "_width")

    def replicate(self, intervals: DataFrame, start: str, end: str) -> DataFrame:
        """Rows valid from ``start`` to ``end`` (null: open) copied into every shard of their key they reach into.

        A version that began before a shard arrives in it as that shard's carry-in. Other keys: one copy, shard 0.
        Both ends are looked up as cells, so no row carries a list of shards.
        """
        if not self.count:
            return intervals.withColumn("shard", F.lit(0))
        last = self.shards.groupBy(self.key).agg(F.max("shard").alias("_last"))
        reach = self.attach(self.attach(intervals, start, "_from"), end, "_to").join(small(last, self.count), self.key, "left")
        until = F.coalesce("_to", "_last", F.lit(0))
        return reach.withColumn("shard", F.explode(F.sequence(F.col("_from"), until))).drop("_from", "_to", "_last")


def salted_lookup(left: DataFrame, right: DataFrame, key: str, rows: int, salts: int, how: str = "inner") -> DataFrame:
    """Join ``left`` to ``right`` (few rows a key) on ``key``, spreading the left rows of hot keys over ``salts`` tasks.

    The right rows of a hot key are copied ``salts`` times; hot keys are those of more than ``rows`` left rows,
    at most (left rows / rows) of them, broadcast only while their count is within the bound.
    """
    hot = cut(hot_keys(left, key, rows).select(key, F.lit(True).alias("_hot")))
    count = hot.count()
    if not count:
        return left.join(right, key, how)
    spread = left.join(small(hot, count), key, "left").withColumn(
        "_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int")).otherwise(F.lit(0))
    )
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    copied = right.join(small(hot, count), key, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return spread.drop("_hot").join(copied, [key, "_salt"], how).drop("_salt")


def largest_by_key(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value): one row a key with the largest of its values.

    Keys alone are counted first; only rows of repeated keys are shuffled with their values, so large texts of
    keys that occur once stay where they were read. Too many repeated keys to broadcast: all rows are aggregated.
    """
    rows = df.select(key, value)
    repeated = cut(hot_keys(rows.select(key), key, 1).select(F.col(key).alias("_key")))
    count = repeated.count()
    if not count:
        return rows
    if count > BROADCAST_KEYS:
        return rows.groupBy(key).agg(F.max(value).alias(value))
    same = F.col(key).eqNullSafe(F.col("_key"))
    once = rows.join(F.broadcast(repeated), same, "left_anti")
    return once.unionByName(rows.join(F.broadcast(repeated), same, "left_semi").groupBy(key).agg(F.max(value).alias(value)))


def parallel(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as there are cores, if it has fewer: for slow steps on few bytes."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
