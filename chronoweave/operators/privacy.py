"""Export, audit and hard deletion of entities, for any number of entities at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.operators.graph import edges_of


def _linked_refs(properties: DataFrame, relationships: DataFrame, keys: DataFrame) -> DataFrame:
    """(entity_id, source_ref_id) of the versions and edges of the entities in ``keys``."""
    told = properties.select("entity_id", "source_ref_id").unionByName(edges_of(relationships).select("entity_id", "source_ref_id"))
    return told.where("source_ref_id <> ''").join(keys, "entity_id", "left_semi").distinct()


def export_counts(targets: DataFrame, aliases: DataFrame, properties: DataFrame, relationships: DataFrame, source_refs: DataFrame, access_log: DataFrame) -> DataFrame:
    """(entity_id, name, type, aliases, properties, relationships, source_refs, access_log): how much an export holds; archived entities too."""
    keys = targets.select(F.col("id").alias("entity_id"))

    def count(df: DataFrame, name: str) -> DataFrame:
        return df.join(keys, "entity_id", "left_semi").groupBy("entity_id").agg(F.count(F.lit(1)).alias(name))

    known = _linked_refs(properties, relationships, keys).join(source_refs.select(F.col("id").alias("source_ref_id")), "source_ref_id", "left_semi")
    parts = [
        count(aliases, "aliases"), count(properties, "properties"), count(edges_of(relationships).select("entity_id", "id").distinct(), "relationships"),
        count(known, "source_refs"), count(access_log, "access_log"),
    ]
    out = targets.select(F.col("id").alias("entity_id"), "name", "type")
    for part in parts:
        out = out.join(part, "entity_id", "left")
    return out.na.fill(0, ["aliases", "properties", "relationships", "source_refs", "access_log"])


def export_json(targets: DataFrame, aliases: DataFrame, properties: DataFrame, relationships: DataFrame) -> DataFrame:
    """(entity_id, content, content_hash): the export as JSON with ordered parts, and its SHA-256.

    The export of one entity is one value by definition; use ``export_counts`` to see its size first.
    """
    keys = targets.select(F.col("id").alias("entity_id"))

    def part(df: DataFrame, name: str, order: str) -> DataFrame:
        rest = [c for c in df.columns if c not in ("entity_id", order)]
        return df.join(keys, "entity_id", "left_semi").groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct(order, *rest))).alias(name))

    edges = edges_of(relationships).select("entity_id", "id", "source_id", "target_id", "type", "valid_from", "valid_to").distinct()
    out = targets.select(F.col("id").alias("entity_id"), "name", "type").join(part(aliases.select("entity_id", "alias").distinct(), "aliases", "alias"), "entity_id", "left")
    out = out.join(part(properties, "properties", "recorded_at"), "entity_id", "left").join(part(edges, "relationships", "id"), "entity_id", "left")
    content = F.to_json(F.struct("entity_id", "name", "type", "aliases", "properties", "relationships"))
    return out.select("entity_id", content.alias("content")).withColumn("content_hash", F.sha2("content", 256))


def audit_belief(properties: DataFrame, source_refs: DataFrame) -> DataFrame:
    """Each version with its source, newest first within (entity_id, key) when ordered by recorded_at; source is null without a conversation."""
    refs = source_refs.select(F.col("id").alias("source_ref_id"), "conversation_id", "turn_number", "verbatim", "authority")
    joined = properties.join(refs, "source_ref_id", "left")
    source = F.when(F.col("conversation_id") != "", F.concat_ws(":", "conversation_id", "turn_number"))
    return joined.withColumn("source", source)


def log_access(access_log: DataFrame, seen: DataFrame, query: Column, caller: Column, now: Column) -> DataFrame:
    """Append one row for each entity in ``seen`` (entity_id)."""
    rows = seen.select("entity_id").withColumns({"timestamp": now, "query": query, "caller": caller})
    rows = rows.withColumn("id", F.sha2(F.concat_ws("|", "entity_id", F.unix_micros(now), "query", "caller"), 256))
    return access_log.unionByName(rows.select(*access_log.columns))


def unique_refs(targets: DataFrame, properties: DataFrame) -> DataFrame:
    """(entity_id, source_ref_id): sources that only versions of that entity name."""
    named = properties.where("source_ref_id <> ''").select("source_ref_id", "entity_id").distinct()
    single = named.groupBy("source_ref_id").agg(F.count(F.lit(1)).alias("n"), F.min("entity_id").alias("entity_id")).where("n = 1")
    return single.join(targets.select(F.col("id").alias("entity_id")), "entity_id", "left_semi").select("entity_id", "source_ref_id")


def deletion_counts(targets: DataFrame, aliases: DataFrame, properties: DataFrame, relationships: DataFrame, access_log: DataFrame) -> DataFrame:
    """(entity_id, properties, relationships, aliases, source_refs, access_log): what deleting each entity alone removes, and the access rows kept."""
    keys = targets.select(F.col("id").alias("entity_id"))
    out = keys
    for name, df in (
        ("properties", properties), ("relationships", edges_of(relationships).select("entity_id", "id").distinct()), ("aliases", aliases),
        ("source_refs", unique_refs(targets, properties)), ("access_log", access_log),
    ):
        out = out.join(df.join(keys, "entity_id", "left_semi").groupBy("entity_id").agg(F.count(F.lit(1)).alias(name)), "entity_id", "left")
    return out.na.fill(0)


def hard_delete(targets: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables without the targets' rows; access_log stays. Conflicts, merge_log and centrality go where given."""
    keys = targets.select(F.col("id").alias("entity_id"))
    lost_refs = unique_refs(targets, tables["properties"]).select(F.col("source_ref_id").alias("id"))
    out = dict(tables)
    for name in ("properties", "entity_aliases", "conflicts", "centrality_index"):
        if name in tables:
            out[name] = tables[name].join(keys, "entity_id", "left_anti")
    out["entities"] = tables["entities"].join(targets.select("id"), "id", "left_anti")
    out["source_refs"] = tables["source_refs"].join(lost_refs, "id", "left_anti")
    ends = {"relationships": ("source_id", "target_id"), "merge_log": ("survivor_id", "absorbed_id")}
    for name, columns in ends.items():
        if name in tables:
            for column in columns:
                out[name] = out[name].join(keys.withColumnRenamed("entity_id", column), column, "left_anti").select(*tables[name].columns)
    return out
