"""History of changing entity attributes: Merkle comparison of snapshots, then versions with periods.

Every (entity_id, key) hashes to a leaf bucket; there are as many leaves as make about LEAF_ROWS rows a leaf. The
digest of a leaf in a snapshot describes its *state*: a statement that only repeats the value already known as the
latest adds nothing, so a snapshot that sends everything again leaves the digests as they were. Digests of parents
are sums over their children. Consecutive snapshots are compared from the root; only children of differing nodes
are looked at, only rows of differing leaves are diffed into versions, and these are appended. A late or corrected
statement rewrites a leaf: then all earlier rows of that leaf are diffed too, as a repeat may matter after it.

Defined cases: rows equal in id, entity_id, key and as_of are one record, the last recorded; a statement without
as_of or without entity_id or key has no place in a history and is left out; a missing recorded_at counts as
earliest; of statements with the same as_of and recorded_at the larger id holds; SQL null and JSON null end a
version; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.functions.json_values import canonical_value
from chronoweave.operators.skew import TimeShards, small
from chronoweave.sources.tables import cut, micros

FANOUT_BITS = 4
#: Rows a leaf holds on average; the number of leaves is the power of the fan-out next above rows / LEAF_ROWS.
LEAF_ROWS = 64
SNAPSHOT_DAYS = 90
#: Pairs of snapshot and leaf (16 bytes each) up to which those pruned are broadcast; beyond it they are joined.
PRUNED_BROADCAST = 200_000
#: A (entity, key) of more statements than this is cut into time shards.
ROWS_PER_SHARD = 1 << 18


def tree_depth(rows: int) -> int:
    """Levels below the root of a tree for so many rows."""
    depth = 1
    while (1 << (FANOUT_BITS * depth)) * LEAF_ROWS < rows:
        depth += 1
    return depth


def statements(properties: DataFrame, depth: int) -> DataFrame:
    """Property rows as statements: times in microseconds, canonical value, leaf bucket and snapshot number added."""
    recorded = F.coalesce(micros("recorded_at"), F.lit(-(1 << 62)))
    out = properties.select("id", "entity_id", "key", canonical_value(F.col("value_json")).alias("value"), micros("as_of").alias("as_of_us"), recorded.alias("recorded_us"))
    out = out.where("as_of_us is not null and entity_id is not null and entity_id <> '' and key is not null")
    day = F.lit(86_400_000_000 * SNAPSHOT_DAYS)
    group = F.xxhash64("entity_id", "key")
    leaf = group.bitwiseAND(F.lit((1 << (FANOUT_BITS * depth)) - 1))
    return out.withColumn("group", group).withColumn("leaf", leaf).withColumn("snapshot", F.floor(F.col("recorded_us") / day))


def changes_of_state(rows: DataFrame) -> DataFrame:
    """(leaf, snapshot, mark, change) of every row: change is 0 if the state as known when it was recorded stays the
    same, 1 if it goes on with another value, 2 if earlier times are rewritten; mark is a hash of the row.

    Only what the comparison needs is shuffled: (entity_id, key) as two hashes, the value as one.
    """
    light = rows.select("group", F.xxhash64("key", "entity_id").alias("other"), "leaf", "snapshot", "as_of_us", "recorded_us", "id", F.when(F.col("value").isNotNull(), F.xxhash64("value")).alias("value"))
    shards = TimeShards(light, "group", "recorded_us", ROWS_PER_SHARD)
    group = ["group", "other", "shard"]
    light = shards.attach(light).withColumn("told", F.struct("as_of_us", "recorded_us", "id", "value"))
    order = Window.partitionBy(*group).orderBy("recorded_us", "as_of_us", "id")
    light = light.withColumn("known", F.max("told").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    if shards.count:
        best = light.groupBy(*group).agg(F.max("told").alias("best"))
        before = Window.partitionBy("group", "other").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
        carried = best.withColumn("carry", F.max("best").over(before)).drop("best")
        light = light.join(carried, group).withColumn("known", F.greatest("known", "carry")).drop("carry")
    same = F.col("value").eqNullSafe(F.col("known.value"))
    later = F.col("known").isNull() | (F.col("as_of_us") > F.col("known.as_of_us"))
    again = (F.col("as_of_us") == F.col("known.as_of_us")) & (F.col("id") == F.col("known.id"))
    change = F.when(same & (later | again), 0).when(later, 1).otherwise(2)
    return light.select("leaf", "snapshot", F.xxhash64("id", "value", "as_of_us", "recorded_us").alias("mark"), change.alias("change"))


def leaf_digests(rows: DataFrame) -> DataFrame:
    """(snapshot, leaf, digest, rewritten): what each snapshot adds to the state of each leaf.

    Every change of state adds at least 1, so none can go unseen; a snapshot of repeats adds 0."""
    digest = F.col("mark").bitwiseAND(F.lit(0x7FFFFFFF)) + 1
    return rows.groupBy("snapshot", "leaf").agg(F.sum(F.when(F.col("change") > 0, digest).otherwise(0)).alias("digest"), F.max(F.col("change") == 2).alias("rewritten"))


def cumulative(digests: DataFrame) -> DataFrame:
    """Digests of whole snapshots from what each adds; (snapshot, leaf, digest, before, rewritten)."""
    order = Window.partitionBy("leaf").orderBy("snapshot")
    total = F.sum("digest").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return digests.select("snapshot", "leaf", total.alias("digest"), (total - F.col("digest")).alias("before"), "rewritten")


def differing_leaves(compared: DataFrame, depth: int) -> DataFrame:
    """Descend from the root of each snapshot into differing children only; (snapshot, leaf) of differing leaves.

    ``compared`` has (snapshot, leaf, digest, before) with the digests of a leaf in a snapshot and in the one
    before it. Digests are never negative changes, so a parent's sum differs if a child's does.
    """
    compared = compared.select("snapshot", "leaf", "digest", "before", F.abs(F.col("digest") - F.col("before")).alias("apart"))
    reached = None
    for level in range(depth + 1):
        node = F.shiftright("leaf", FANOUT_BITS * (depth - level))
        nodes = compared.groupBy("snapshot", node.alias("node")).agg(F.sum("apart").alias("apart"))
        if reached is not None:
            parents = reached.select("snapshot", F.col("node").alias("parent"))
            nodes = nodes.withColumn("parent", F.shiftright("node", FANOUT_BITS)).join(parents, ["snapshot", "parent"], "left_semi")
        reached = nodes.where("apart > 0").select("snapshot", "node")
    return reached.select("snapshot", F.col("node").alias("leaf"))


def versions(rows: DataFrame) -> DataFrame:
    """Diff statements into versions: (entity_id, property_key, property_id, value, valid_from_us, valid_to_us)."""
    shards = TimeShards(rows, "group", "as_of_us", ROWS_PER_SHARD)
    group = ["entity_id", "key", "shard"]
    last = F.max(F.struct("recorded_us", "id", "value")).alias("last")
    holding = shards.attach(rows).groupBy(*group, "as_of_us").agg(last)
    holding = holding.select(*group, "as_of_us", F.col("last.id").alias("id"), F.col("last.value").alias("value"))
    order = Window.partitionBy(*group).orderBy("as_of_us")
    holding = holding.withColumn("previous", F.lag("value").over(order))
    if shards.count:
        ends = holding.groupBy(*group).agg(F.max_by(F.struct("value"), "as_of_us").alias("end"))
        ends = ends.withColumn("carry", F.lag("end").over(Window.partitionBy("entity_id", "key").orderBy("shard"))).drop("end")
        first = F.row_number().over(order) == 1
        holding = holding.withColumn("first", first).join(ends, group).withColumn("previous", F.when(F.col("first"), F.col("carry.value")).otherwise(F.col("previous")))
    changes = holding.where(~F.col("value").eqNullSafe(F.col("previous")))
    changes = changes.withColumn("until", F.lead("as_of_us").over(order))
    if shards.count:
        begins = changes.groupBy(*group).agg(F.min("as_of_us").alias("begin"))
        begins = begins.withColumn("next", F.lead("begin").over(Window.partitionBy("entity_id", "key").orderBy("shard"))).drop("begin")
        changes = changes.join(begins, group).withColumn("until", F.coalesce("until", "next"))
    return changes.where("value is not null").select(
        "entity_id",
        F.col("key").alias("property_key"),
        F.col("id").alias("property_id"),
        "value",
        F.col("as_of_us").alias("valid_from_us"),
        F.coalesce("until", F.lit(-1)).alias("valid_to_us"),
    )


def rows_to_diff(rows: DataFrame, compared: DataFrame, differing: DataFrame) -> DataFrame:
    """Rows of the differing leaves of each snapshot, and of all snapshots up to the last that rewrote their leaf."""
    pairs = compared.join(differing.withColumn("differs", F.lit(True)), ["snapshot", "leaf"], "left")
    last = F.max(F.when(F.col("differs") & F.col("rewritten"), F.col("snapshot"))).over(Window.partitionBy("leaf"))
    pruned = cut(pairs.withColumn("last", last).where("differs is null and (last is null or snapshot > last)").select("snapshot", "leaf"))
    return rows.join(small(pruned, pruned.count(), PRUNED_BROADCAST), ["snapshot", "leaf"], "left_anti")


def build_history(properties: DataFrame) -> DataFrame:
    """The full history from all snapshots: leaves that differ between consecutive snapshots, diffed into versions."""
    depth = tree_depth(properties.select("id").count())
    rows = statements(properties, depth)
    compared = cut(cumulative(leaf_digests(changes_of_state(rows))))
    return versions(rows_to_diff(rows, compared, differing_leaves(compared, depth)))


def snapshot_changes(before: DataFrame, after: DataFrame, depth: int) -> DataFrame:
    """(leaf) of the leaves whose states differ between two whole property tables."""
    sides = [leaf_digests(changes_of_state(statements(side, depth)).withColumn("snapshot", F.lit(0))) for side in (before, after)]
    old = sides[0].select("snapshot", "leaf", F.col("digest").alias("before"))
    compared = sides[1].select("snapshot", "leaf", "digest").join(old, ["snapshot", "leaf"], "full").na.fill(0, ["digest", "before"])
    return cut(differing_leaves(cut(compared), depth).select("leaf"))


def update_history(history: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Bring a history made from ``before`` up to ``after`` (whole property tables, ``after`` holding all of before).

    Leaves whose states do not differ are neither read nor touched; those that differ are diffed from ``after``:
    versions that stand are kept, ended and corrected ones are replaced, new ones appended.
    """
    depth = tree_depth(after.select("id").count())
    changed = snapshot_changes(before, after, depth)
    few = small(changed, changed.count())
    leaf = F.xxhash64("entity_id", "property_key").bitwiseAND(F.lit((1 << (FANOUT_BITS * depth)) - 1))
    kept = history.withColumn("leaf", leaf).join(few, "leaf", "left_anti").drop("leaf")
    return kept.unionByName(versions(statements(after, depth).join(few, "leaf", "left_semi")))
