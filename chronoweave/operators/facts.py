"""Versioned facts: supersession, conflict classes, appending and correcting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.operators.graph import current_properties, latest


def same_text(value: Column) -> Column:
    """A value for comparison: JSON strings lose quotes, outer blanks and letter case, other values stay as they are."""
    return F.when(value.rlike(r'^\s*"'), F.concat(F.lit("s"), F.lower(F.trim(F.regexp_replace(value, r'^\s*"|"\s*$', ""))))).otherwise(value)


def supersession(properties: DataFrame) -> DataFrame:
    """Each version with the id of the one recorded next on the same (entity_id, key), null for the current one."""
    order = Window.partitionBy("entity_id", "key").orderBy("recorded_at", "id")
    return properties.withColumn("next_id", F.lead("id").over(order))


def classify(properties: DataFrame, source_refs: DataFrame) -> DataFrame:
    """Each version against the one recorded before it: confirmation, historical, update or contradiction.

    A first or equal value confirms; an older as_of is historical; a newer one of an authority of 0.8 or more
    updates; the rest contradicts. The authority comes from the source (1 if there is none).
    """
    order = Window.partitionBy("entity_id", "key").orderBy("recorded_at", "id")
    told = properties.join(source_refs.select(F.col("id").alias("source_ref_id"), "authority"), "source_ref_id", "left").withColumn("authority", F.coalesce("authority", F.lit(1.0)))
    told = told.withColumn("existing_id", F.lag("id").over(order)).withColumn("existing", F.lag(same_text(F.coalesce("value_json", F.lit("null")))).over(order)).withColumn("existing_as_of", F.lag("as_of").over(order))
    kind = (
        F.when(F.col("existing_id").isNull() | (same_text(F.coalesce("value_json", F.lit("null"))) == F.col("existing")), "confirmation")
        .when(F.col("as_of") < F.col("existing_as_of"), "historical")
        .when(F.col("authority") >= 0.8, "update")
        .otherwise("contradiction")
    )
    return told.withColumn("conflict_type", kind).drop("existing", "existing_as_of")


def boost_confirmed(classified: DataFrame, by: float = 0.05) -> DataFrame:
    """Classified versions; one that confirms an earlier one gains ``by`` of confidence, up to 1."""
    confirms = (F.col("conflict_type") == "confirmation") & F.col("existing_id").isNotNull()
    return classified.withColumn("confidence", F.when(confirms, F.least(F.lit(1.0), F.col("confidence") + by)).otherwise(F.col("confidence")))


def conflicts(properties: DataFrame, source_refs: DataFrame) -> DataFrame:
    """Conflict rows (unresolved) of the contradictions: value_a is what was held, value_b what was said."""
    found = classify(properties, source_refs).where("conflict_type = 'contradiction'")
    return found.select(
        F.sha2(F.concat_ws("|", "existing_id", "id"), 256).alias("id"), "entity_id", F.col("key").alias("property_key"), F.col("existing_id").alias("value_a_id"), F.col("id").alias("value_b_id"),
        F.lit("unresolved").alias("status"), F.col("recorded_at").alias("created_at"), F.lit(None).cast("timestamp").alias("resolved_at"), F.lit(None).cast("string").alias("resolution"),
    )


def resolve_conflicts(conflicts: DataFrame, resolutions: DataFrame, now: Column) -> DataFrame:
    """Apply (id, resolution) rows: the conflicts they name become resolved."""
    named = resolutions.select("id", F.col("resolution").alias("_said"))
    joined = conflicts.join(named, "id", "left")
    hit = F.col("_said").isNotNull()
    return joined.select(
        "id", "entity_id", "property_key", "value_a_id", "value_b_id", F.when(hit, "resolved").otherwise(F.col("status")).alias("status"), "created_at",
        F.when(hit, now).otherwise(F.col("resolved_at")).alias("resolved_at"), F.coalesce("_said", "resolution").alias("resolution"),
    )


def append_versions(properties: DataFrame, new: DataFrame) -> DataFrame:
    """Append versions (columns as properties, superseded_by_id ignored) and set the pointers anew on their keys.

    A late version, whose as_of is before that of the value held, is appended already superseded by it.
    """
    touched = new.select("entity_id", "key").distinct()
    order = Window.partitionBy("entity_id", "key").orderBy("recorded_at", "id")
    columns = properties.columns
    both = properties.withColumn("_new", F.lit(False)).unionByName(new.select(*columns).withColumn("_new", F.lit(True)).withColumn("superseded_by_id", F.lit(None).cast("string")))
    mine = both.join(touched, ["entity_id", "key"], "left_semi")
    # the version in force after each row: the row itself, or the earlier one a late row does not replace
    reach = F.max(F.when(~F.col("_new") | F.col("as_of").isNotNull(), F.col("as_of"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    late = F.col("_new") & (F.col("as_of") < reach)
    mine = mine.withColumn("_late", F.coalesce(late, F.lit(False)))
    holder = F.last(F.when(~F.col("_late"), F.col("id")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    following = F.first(F.when(~F.col("_late"), F.col("id")), ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    pointed = mine.withColumn("superseded_by_id", F.when(F.col("_late"), holder).otherwise(following))
    rest = properties.join(touched, ["entity_id", "key"], "left_anti")
    return rest.select(*columns).unionByName(pointed.select(*columns))


def held_values(properties: DataFrame) -> DataFrame:
    """The one value held per (entity_id, key)."""
    return latest(current_properties(properties))
