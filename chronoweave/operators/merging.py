"""Merging entities pairwise, and taking merges back exactly from the pre-image that every merge keeps."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.operators.graph import HOT_ROWS, SALTS, is_current
from chronoweave.operators.skew import salted_lookup
from chronoweave.sources.tables import cut


@dataclass
class Merged:
    """The tables after a merge, and what the changed rows were before."""

    entities: DataFrame
    aliases: DataFrame
    properties: DataFrame
    relationships: DataFrame
    before: dict[str, DataFrame]
    pairs: DataFrame


def merge_pairs(entities: DataFrame) -> DataFrame:
    """(absorbed_id, survivor_id) of every absorbed record, however long its chain of merged_into.

    The survivor is the last record of the chain that has a row: one that is not merged, or one whose merged_into names
    no row and which therefore stays a record of its own. Of a circle the smallest id survives; a self-link merges nothing.
    Each round doubles the steps taken, so the rounds grow with the logarithm of the longest chain.
    """
    rows = entities.select(F.col("id").alias("to"))
    named = entities.where("merged_into <> id").select("id", F.col("merged_into").alias("to"))
    steps, before, now = cut(named.join(rows, "to", "left_semi").select("id", "to", F.col("id").alias("low"))), None, ()
    # unfinished chains, then their distinct places, then the least ids passed stop changing: all are in their circle and have been around it
    while now != before:
        ahead = steps.select(F.col("id").alias("to"), F.col("to").alias("_to"), F.col("low").alias("_low"))
        jumped = salted_lookup(steps, ahead, "to", HOT_ROWS, SALTS, "left")
        steps = cut(jumped.select("id", F.coalesce("_to", "to").alias("to"), F.least("low", "_low").alias("low"), F.col("_to").isNotNull().alias("_open")))
        mark = F.sum(F.xxhash64("id", "low").bitwiseAND(F.lit(0x7FFFFFFF)))
        before, now = now, tuple(steps.where("_open").agg(F.count(F.lit(1)), F.countDistinct("to"), mark).first())
        steps = steps.drop("_open")
    circle = steps.select(F.col("id").alias("to"), F.col("low").alias("_low"))
    ends = salted_lookup(steps.select("id", "to"), circle, "to", HOT_ROWS, SALTS, "left")
    return cut(ends.select(F.col("id").alias("absorbed_id"), F.coalesce("_low", "to").alias("survivor_id")).where("absorbed_id <> survivor_id"))


def _moved(df: DataFrame, column: str, pairs: DataFrame) -> DataFrame:
    to = pairs.select(F.col("absorbed_id").alias(column), F.col("survivor_id").alias("_to"))
    return df.join(to, column, "left").withColumn("_was", F.col(column)).withColumn(column, F.coalesce("_to", column)).drop("_to")


def merged_aliases(entities: DataFrame, aliases: DataFrame, pairs: DataFrame) -> DataFrame:
    """(entity_id, alias) of survivors: all names and aliases of both, but not the survivor's own name."""
    names = pairs.join(entities.select(F.col("id").alias("absorbed_id"), "name"), "absorbed_id").select(F.col("survivor_id").alias("entity_id"), F.col("name").alias("alias"))
    theirs = aliases.join(pairs.withColumnRenamed("absorbed_id", "entity_id"), "entity_id").select(F.col("survivor_id").alias("entity_id"), "alias")
    own = aliases.select("entity_id", "alias").join(pairs.select(F.col("survivor_id").alias("entity_id")).distinct(), "entity_id", "left_semi")
    union = names.unionByName(theirs).unionByName(own).where("alias is not null").distinct()
    return union.join(entities.select(F.col("id").alias("entity_id"), F.col("name").alias("alias")), ["entity_id", "alias"], "left_anti")


def merged_edges(relationships: DataFrame, pairs: DataFrame) -> DataFrame:
    """Edges with both ends moved to survivors; loops that arise drop out; of moved edges that meet another of the
    same (source, target, type) one stays, with the larger confidence."""
    moved = _moved(_moved(relationships, "source_id", pairs).withColumnRenamed("_was", "_source"), "target_id", pairs).withColumnRenamed("_was", "_target")
    moved = moved.withColumn("_moved", (F.col("_source") != F.col("source_id")) | (F.col("_target") != F.col("target_id")))
    kept = moved.where(~(F.col("_moved") & (F.col("source_id") == F.col("target_id"))))
    triple = ["source_id", "target_id", "type"]
    # untouched edges come first, so a moved edge folds into an existing one
    groups = kept.groupBy(*triple).agg(F.min(F.struct("_moved", "id")).alias("_first"), F.max(F.col("_moved")).alias("_any"), F.max(F.when(F.col("_moved"), F.col("confidence"))).alias("_best"))
    joined = kept.join(groups, triple)
    leading = F.col("_first.id") == F.col("id")
    stays = ~F.col("_moved") | leading
    lifted = F.when(leading & F.col("_any"), F.greatest("confidence", "_best")).otherwise(F.col("confidence"))
    return joined.where(stays).withColumn("confidence", lifted).select(*relationships.columns)


def merged_properties(properties: DataFrame, pairs: DataFrame) -> DataFrame:
    """Versions moved to survivors; where the survivor holds the key, the moved version becomes history below it."""
    held = properties.where(is_current()).groupBy("entity_id", "key").agg(F.max(F.struct("recorded_at", "id")).alias("_held"))
    moved = _moved(properties, "entity_id", pairs).join(held, ["entity_id", "key"], "left")
    came = F.col("_was") != F.col("entity_id")
    below = came & F.col("_held").isNotNull()
    return moved.withColumn("superseded_by_id", F.when(below, F.col("_held.id")).otherwise(F.col("superseded_by_id"))).select(*properties.columns)


def merged_entities(entities: DataFrame, pairs: DataFrame) -> DataFrame:
    """Survivors with summed access counts and the widest times; absorbed records archived and pointing at them. The
    survivor of a circle no longer points into it."""
    theirs = pairs.join(entities.select(F.col("id").alias("absorbed_id"), "access_count", "last_seen", "created_at"), "absorbed_id")
    sums = theirs.groupBy(F.col("survivor_id").alias("id")).agg(F.sum("access_count").alias("_n"), F.max("last_seen").alias("_seen"), F.min("created_at").alias("_made"))
    gone = pairs.select(F.col("absorbed_id").alias("id"), F.col("survivor_id").alias("_into"))
    back = pairs.select(F.col("survivor_id").alias("id"), F.col("absorbed_id").alias("merged_into"))
    circle = entities.where("merged_into is not null").join(back, ["id", "merged_into"], "left_semi").select("id", F.lit(True).alias("_circle"))
    joined = entities.join(sums, "id", "left").join(gone, "id", "left").join(circle, "id", "left")
    return joined.withColumns(
        {
            "access_count": F.col("access_count") + F.coalesce("_n", F.lit(0)),
            "last_seen": F.greatest("last_seen", "_seen"),
            "created_at": F.least("created_at", "_made"),
            "archived": F.col("archived") | F.col("_into").isNotNull(),
            "merged_into": F.when(F.col("_circle"), F.lit(None)).otherwise(F.coalesce("_into", "merged_into")),
        }
    ).select(*entities.columns)


def merge(entities: DataFrame, aliases: DataFrame, properties: DataFrame, relationships: DataFrame, pairs: DataFrame, now: Column) -> Merged:
    """Merge every pair at once; a record may absorb many, but an absorbed one absorbs none."""
    touched = pairs.select(F.explode(F.array("absorbed_id", "survivor_id")).alias("id")).distinct()
    before = {
        "entities": entities.join(touched, "id", "left_semi"),
        "aliases": aliases.join(touched.withColumnRenamed("id", "entity_id"), "entity_id", "left_semi"),
        "properties": properties.join(pairs.select(F.col("absorbed_id").alias("entity_id")), "entity_id", "left_semi"),
        "relationships": relationships.join(touched.select(F.col("id").alias("source_id")), "source_id", "left_semi").unionByName(
            relationships.join(touched.select(F.col("id").alias("source_id")), "source_id", "left_anti").join(touched.select(F.col("id").alias("target_id")), "target_id", "left_semi")
        ),
    }
    kept = aliases.join(pairs.select(F.col("survivor_id").alias("entity_id")).distinct(), "entity_id", "left_anti")
    fresh = merged_aliases(entities, aliases, pairs).withColumn("id", F.sha2(F.concat_ws("|", "entity_id", "alias"), 256)).withColumn("added_at", now)
    return Merged(
        merged_entities(entities, pairs), kept.unionByName(fresh.select(*aliases.columns)), merged_properties(properties, pairs), merged_edges(relationships, pairs), before, pairs
    )


_ISO = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
_PARTS = ("entities", "aliases", "properties", "relationships")


def pre_images(before: dict[str, DataFrame], pairs: DataFrame) -> DataFrame:
    """(absorbed_id, survivor_id, undo_data): for each pair one JSON value of all rows the merge changed, so that the
    log alone is enough to take the merge back."""
    ends = pairs.select("absorbed_id", "survivor_id", F.explode(F.array("absorbed_id", "survivor_id")).alias("_end"))
    edges = before["relationships"]
    located = {
        "entities": before["entities"].withColumn("_end", F.col("id")), "aliases": before["aliases"].withColumn("_end", F.col("entity_id")), "properties": before["properties"].withColumn("_end", F.col("entity_id")),
        "relationships": edges.withColumn("_end", F.explode(F.array_distinct(F.array("source_id", "target_id")))),
    }
    out = pairs
    for name, rows in located.items():
        held = ends.join(rows, "_end").groupBy("absorbed_id", "survivor_id").agg(F.collect_set(F.struct(*before[name].columns)).alias(name))
        out = out.join(held, ["absorbed_id", "survivor_id"], "left")
    return out.select("absorbed_id", "survivor_id", F.to_json(F.struct(*_PARTS), _ISO).alias("undo_data"))


def from_log(log: DataFrame, tables: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """The pre-images and pairs of merge-log rows; ``tables`` give the shape of the rows."""
    shape = ", ".join(f"{name}: array<{tables[name].select(*tables[name].columns).schema.simpleString()}>" for name in _PARTS)
    kept = log.select("survivor_id", "absorbed_id", F.from_json("undo_data", f"struct<{shape}>", _ISO).alias("_was"))
    before = {name: kept.select(F.explode(f"_was.{name}").alias("_row")).select("_row.*").dropDuplicates(["id"]) for name in _PARTS}
    return before, kept.select("absorbed_id", "survivor_id")


def split(merged: Merged) -> dict[str, DataFrame]:
    """The tables as they were before the merge: pre-images instead of the rows that took their place."""
    touched = merged.pairs.select(F.explode(F.array("absorbed_id", "survivor_id")).alias("id")).distinct()
    was = merged.before
    edges = merged.relationships.join(was["relationships"].select("id"), "id", "left_anti")
    return {
        "entities": merged.entities.join(touched, "id", "left_anti").unionByName(was["entities"]),
        "aliases": merged.aliases.join(touched.withColumnRenamed("id", "entity_id"), "entity_id", "left_anti").unionByName(was["aliases"]),
        "properties": merged.properties.join(was["properties"].select("id"), "id", "left_anti").unionByName(was["properties"]),
        "relationships": edges.unionByName(was["relationships"]),
    }
