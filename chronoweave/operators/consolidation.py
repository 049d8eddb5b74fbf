"""Consolidation passes: decay, redundancy, orphans, contradictions, centrality. Each maps tables to tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.functions.scores import decayed_confidence, floor_days
from chronoweave.operators.facts import same_text
from chronoweave.operators.graph import degree_centrality, edges_of, is_current
from chronoweave.sources.tables import cut

QUICK_EVERY, FULL_EVERY = 50, 200


def decay_confidence(properties: DataFrame, now: Column) -> DataFrame:
    """All versions, current ones with the confidence their age leaves; ``decayed`` tells which changed by over 0.001.

    Every other version of the same (entity_id, key, value_json) confirms.
    """
    same = properties.where("value_json is not null").groupBy("entity_id", "key", "value_json").agg((F.count(F.lit(1)) - 1).alias("confirmations"))
    joined = properties.join(same, ["entity_id", "key", "value_json"], "left").na.fill(0, ["confirmations"])
    value = decayed_confidence(now, F.col("recorded_at"), F.col("key"), F.col("confirmations"))
    changes = is_current() & (F.abs(value - F.col("confidence")) > 0.001)
    changed = F.coalesce(changes, F.lit(False))
    return joined.withColumn("decayed", changed).withColumn("confidence", F.when(changed, value).otherwise(F.col("confidence")))


def merge_redundant(properties: DataFrame, entities: DataFrame) -> DataFrame:
    """All versions; of equal current values of an active entity the next one supersedes, and gains 0.1 of confidence (once)."""
    active = entities.where("not archived").select(F.col("id").alias("entity_id"))
    mine = properties.where(is_current()).join(active, "entity_id", "left_semi").withColumn("v", same_text(F.coalesce("value_json", F.lit("null"))))
    order = Window.partitionBy("entity_id", "key", "v").orderBy("recorded_at", "id")
    merged = mine.withColumn("_next", F.lead("id").over(order)).withColumn("_rank", F.row_number().over(order))
    touched = merged.where("_next is not null or _rank > 1").select("id", "_next", "_rank")
    joined = properties.join(touched, "id", "left")
    gained = F.when(F.col("_rank") > 1, F.least(F.lit(1.0), F.col("confidence") + 0.1)).otherwise(F.col("confidence"))
    return joined.withColumn("confidence", gained).withColumn("superseded_by_id", F.coalesce("_next", "superseded_by_id")).drop("_next", "_rank")


def orphans(entities: DataFrame, relationships: DataFrame, now: Column, min_confidence: float = 0.2, min_days: int = 90) -> DataFrame:
    """Active entities without edges, of low confidence and not seen for a while."""
    linked = edges_of(relationships).select(F.col("entity_id").alias("id")).distinct()
    lonely = entities.where((~F.col("archived")) & (F.col("confidence") < min_confidence)).join(linked, "id", "left_anti")
    return lonely.where(floor_days(now, F.col("last_seen")) >= min_days)


def prune_orphans(entities: DataFrame, relationships: DataFrame, now: Column, min_confidence: float = 0.2, min_days: int = 90) -> DataFrame:
    """All entities, orphans archived."""
    lost = orphans(entities, relationships, now, min_confidence, min_days).select("id", F.lit(True).alias("_lost"))
    return entities.join(lost, "id", "left").withColumn("archived", F.col("archived") | F.coalesce("_lost", F.lit(False))).drop("_lost")


def resolve_contradictions(conflicts: DataFrame, properties: DataFrame, now: Column, threshold: float = 0.2) -> DataFrame:
    """All conflicts; unresolved ones of which one value or both have decayed below the threshold become auto_resolved."""
    a = properties.select(F.col("id").alias("value_a_id"), F.col("confidence").alias("_a"))
    b = properties.select(F.col("id").alias("value_b_id"), F.col("confidence").alias("_b"))
    joined = conflicts.join(a, "value_a_id", "left").join(b, "value_b_id", "left")
    low_a, low_b = F.col("_a") < threshold, F.col("_b") < threshold
    said = F.when(low_a & low_b, "Both values decayed").when(low_a & ~low_b, F.concat(F.lit("Value A decayed to "), F.format_number("_a", 2))).when(low_b & ~low_a, F.concat(F.lit("Value B decayed to "), F.format_number("_b", 2)))
    hit = (F.col("status") == "unresolved") & said.isNotNull()
    return joined.select(
        "id", "entity_id", "property_key", "value_a_id", "value_b_id", F.when(hit, "auto_resolved").otherwise(F.col("status")).alias("status"), "created_at",
        F.when(hit, now).otherwise(F.col("resolved_at")).alias("resolved_at"), F.when(hit, said).otherwise(F.col("resolution")).alias("resolution"),
    )


def run_full(entities: DataFrame, properties: DataFrame, relationships: DataFrame, conflicts: DataFrame, now: Column) -> dict[str, DataFrame]:
    """All passes in their order: contradictions see the confidences that decay and redundancy leave."""
    held = cut(merge_redundant(decay_confidence(properties, now).select(*properties.columns), entities).select(*properties.columns))
    kept = cut(prune_orphans(entities, relationships, now).select(*entities.columns))
    return {
        "properties": held,
        "entities": kept,
        "conflicts": resolve_contradictions(conflicts, held, now),
        "centrality_index": degree_centrality(kept, relationships).select("entity_id", F.lit(0.0).alias("betweenness"), "degree", now.alias("updated_at")),
    }


def run_quick(entities: DataFrame, properties: DataFrame, now: Column) -> dict[str, DataFrame]:
    """Decay and redundancy only."""
    return {"properties": merge_redundant(decay_confidence(properties, now).select(*properties.columns), entities).select(*properties.columns)}
