"""Table schemas, value sets and constraint violations of the graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

SCHEMA_VERSION = 1
ENTITY_TYPES = ("person", "organization", "project", "concept", "location", "event")
STATEMENT_TYPES = ("explicit", "inferred", "third_party", "corrected")
CONFLICT_STATUSES = ("unresolved", "resolved", "auto_resolved")
CONFLICT_TYPES = ("update", "contradiction", "confirmation", "historical", "retraction")

_T = {"string": StringType(), "int": IntegerType(), "bigint": LongType(), "double": DoubleType(), "boolean": BooleanType(), "timestamp": TimestampType(), "vector": ArrayType(FloatType())}
_VERSION = "key string, value_json string, as_of timestamp, recorded_at timestamp, source_ref_id string, confidence double, superseded_by_id string"
_COLUMNS = {
    "entities": "id string, type string, name string, created_at timestamp, last_seen timestamp, access_count bigint, confidence double, archived boolean, merged_into string",
    "entity_aliases": "id string, entity_id string, alias string, added_at timestamp",
    "source_refs": "id string, conversation_id string, turn_number int, timestamp timestamp, statement_type string, verbatim string, authority double",
    "properties": f"id string, entity_id string, {_VERSION}",
    "relationships": "id string, source_id string, target_id string, type string, valid_from timestamp, valid_to timestamp, source_ref_id string, confidence double, access_count bigint",
    "relationship_properties": f"id string, relationship_id string, {_VERSION}",
    "conflicts": "id string, entity_id string, property_key string, value_a_id string, value_b_id string, status string, created_at timestamp, resolved_at timestamp, resolution string",
    "merge_log": "id string, survivor_id string, absorbed_id string, timestamp timestamp, reason string, undo_data string",
    "centrality_index": "entity_id string, betweenness double, degree double, updated_at timestamp",
    "access_log": "id string, entity_id string, timestamp timestamp, query string, caller string",
    "deletion_audit_log": "id string, entity_id string, entity_name string, deleted_at timestamp, content_hash string, access_log_count bigint, items_deleted_json string",
    "verbatim_chunks": "id string, conversation_id string, turn_number int, text string, timestamp timestamp, participant string, source_type string, embedding vector",
}
TABLES = {
    name: StructType([StructField(column, _T[kind]) for column, kind in (pair.split() for pair in columns.split(", "))]) for name, columns in _COLUMNS.items()
}


def one_record(df: DataFrame, newest: tuple[str, ...] = ()) -> DataFrame:
    """One row an id, a whole one: of repeated rows the largest by the ``newest`` columns, then by the others in
    their order; null counts as smallest."""
    rest = [*newest, *(c for c in df.columns if c != "id" and c not in newest)]
    picked = df.groupBy("id").agg(F.max(F.struct(*rest)).alias("_row"))
    return picked.select("id", *(F.col(f"_row.{c}").alias(c) for c in df.columns if c != "id"))


def _bad_value(df: DataFrame, table: str, column: str, allowed: tuple[str, ...]) -> DataFrame:
    bad = df.where(F.col(column).isNull() | ~F.col(column).isin(*allowed))
    return bad.select(F.lit(table).alias("table_name"), F.lit(f"{column}_value").alias("rule"), F.col("id").alias("row_id"))


def _dangling(df: DataFrame, table: str, column: str, target: DataFrame) -> DataFrame:
    known = target.select(F.col("id").alias(column)).distinct()
    lost = df.where(F.col(column) != "").join(known, column, "left_anti")
    return lost.select(F.lit(table).alias("table_name"), F.lit(f"{column}_reference").alias("rule"), F.col("id").alias("row_id"))


def constraint_violations(entities: DataFrame, aliases: DataFrame, source_refs: DataFrame, properties: DataFrame, relationships: DataFrame) -> DataFrame:
    """(table_name, rule, row_id) of rows a checked and referenced store would have refused; references are anti-joins."""
    found = [
        _bad_value(entities, "entities", "type", ENTITY_TYPES),
        _bad_value(source_refs, "source_refs", "statement_type", STATEMENT_TYPES),
        _dangling(aliases, "entity_aliases", "entity_id", entities),
        _dangling(properties, "properties", "entity_id", entities),
        _dangling(properties, "properties", "source_ref_id", source_refs),
        _dangling(properties, "properties", "superseded_by_id", properties),
        _dangling(relationships, "relationships", "source_id", entities),
        _dangling(relationships, "relationships", "target_id", entities),
        _dangling(relationships, "relationships", "source_ref_id", source_refs),
    ]
    return reduce(DataFrame.unionByName, found)
