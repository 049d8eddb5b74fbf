"""Attributes as known at event time: a bitemporal as-of join that shards hot entities by time.

A statement can be used from max(as_of, recorded_at) on. In that order the running maximum of
(as_of, recorded_at, id) is the statement an event sees, so each (entity, key) becomes a line of intervals.
Hot entities, hot by events or by statements, are cut into time shards; each shard gets the statement that was seen
before it began as its carry-in. In each shard events and statements are then merged in the order of time, apart
from all other shards: a shard of many statements and few events costs no more than its rows.

Defined cases: events with the same id are one record; events without entity_id or timestamp see nothing;
statements without as_of or recorded_at are never known; of equal times the larger id holds; an entity without
statements gives no row; null values give no row; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.operators.skew import TimeShards
from chronoweave.sources.tables import micros

#: Events and statements of an entity beyond which it is hot; statements of an (entity, key) beyond which its line is sharded.
EVENTS_PER_SHARD = 4096
ROWS_PER_SHARD = 1 << 18
#: JSON null, with the white space JSON allows around it.
JSON_NULL = r"^[ \t\r\n]*null[ \t\r\n]*$"


def known_lines(properties: DataFrame) -> DataFrame:
    """(entity_id, key, property_id, none, from_us, to_us): which statement is seen from when until when; with
    ``none`` its value is null."""
    rows = properties.select(
        "entity_id", "key", "id", micros("as_of").alias("as_of_us"), micros("recorded_at").alias("recorded_us"),
        (F.col("value_json").isNull() | F.col("value_json").rlike(JSON_NULL)).alias("none"),
    ).where("entity_id is not null and key is not null and as_of_us is not null and recorded_us is not null")
    rows = rows.withColumn("group", F.xxhash64("entity_id", "key")).withColumn("from_us", F.greatest("as_of_us", "recorded_us"))
    rows = rows.withColumn("seen", F.struct("as_of_us", "recorded_us", "id", "none")).drop("as_of_us", "recorded_us", "id", "none")
    shards = TimeShards(rows, "group", "from_us", ROWS_PER_SHARD)
    rows = shards.attach(rows).drop("group")
    group = ["entity_id", "key", "shard"]
    order = Window.partitionBy(*group).orderBy("from_us", "seen")
    earlier = F.max("seen").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("earlier", earlier)
    if shards.count:
        best = rows.groupBy(*group).agg(F.max("seen").alias("best"))
        before = Window.partitionBy("entity_id", "key").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.join(best.withColumn("carry", F.max("best").over(before)).drop("best"), group).withColumn("earlier", F.greatest("earlier", "carry"))
    rows = rows.where("earlier is null or seen > earlier").withColumn("to_us", F.lead("from_us").over(order))
    if shards.count:
        begins = rows.groupBy(*group).agg(F.min("from_us").alias("begin"))
        begins = begins.withColumn("next", F.lead("begin").over(Window.partitionBy("entity_id", "key").orderBy("shard"))).drop("begin")
        rows = rows.join(begins, group).withColumn("to_us", F.coalesce("to_us", "next"))
    return rows.where("to_us is null or from_us < to_us").select("entity_id", "key", F.col("seen.id").alias("property_id"), F.col("seen.none").alias("none"), "from_us", "to_us")


def attributes_at_events(events: DataFrame, properties: DataFrame, events_per_shard: int = EVENTS_PER_SHARD) -> DataFrame:
    """(access_id, property_key, property_id): every event with each attribute of its entity as known then."""
    events = events.select(F.col("id").alias("access_id"), "entity_id", micros("timestamp").alias("time_us")).where("entity_id is not null and time_us is not null")
    told = properties.where("key is not null").select("entity_id", F.greatest(micros("as_of"), micros("recorded_at")).alias("time_us"))
    told = told.where("entity_id is not null and time_us is not null")
    shards = TimeShards(events.select("entity_id", "time_us").unionByName(told), "entity_id", "time_us", events_per_shard)
    # repeats of a record share entity, time and therefore shard: they meet where the merge needs them anyway
    events = shards.attach(events).groupBy("entity_id", "shard", "access_id").agg(F.min("time_us").alias("time_us"))
    lines = shards.replicate(known_lines(properties), "from_us", "to_us").select("entity_id", "shard", "key", F.col("from_us").alias("time_us"), "property_id", "none")
    asked = events.join(lines.select("entity_id", "shard", "key").distinct(), ["entity_id", "shard"])
    merged = lines.withColumn("access_id", F.lit(None).cast("string")).unionByName(asked.withColumn("property_id", F.lit(None).cast("string")).withColumn("none", F.lit(None).cast("boolean")))
    # at one time the statement comes before the events
    order = Window.partitionBy("entity_id", "shard", "key").orderBy("time_us", F.col("access_id").isNotNull())
    seen = F.last(F.when(F.col("access_id").isNull(), F.struct("property_id", "none")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    found = merged.withColumn("seen", seen).where("access_id is not null and not seen.none")
    return found.select("access_id", F.col("key").alias("property_key"), "seen.property_id")
