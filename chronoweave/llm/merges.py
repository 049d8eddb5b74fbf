"""Consolidating pairwise merges into groups: merged_into chains to one group identifier.

Defined cases: repeated rows are one record; a null, empty or blank merged_into links nothing; letter case and
outer blanks of merged_into do not matter; a named id without a row joins the records that name it but is
neither listed nor a group_id; circles and self-links are allowed; records in no group of two are not listed;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.components import HOT_ROWS, SALTS, seed_tree_components
from chronoweave.operators.skew import salted_lookup
from chronoweave.sources.tables import cut


def _same(column: str) -> F.Column:
    return F.lower(F.regexp_replace(column, r"(?U)^\s+|\s+$", ""))


def merge_groups(entities: DataFrame) -> DataFrame:
    """(entity_id, group_id) of every record in a group of two or more; group_id is the smallest id in the group."""
    rows = entities.select("id", _same("id").alias("node"), _same("merged_into").alias("named")).where("id is not null")
    components = cut(seed_tree_components(rows.where("named <> ''").select("node", "named")))
    records = rows.select("id", "node").distinct()
    members = cut(records.join(components, "node").select(F.col("id").alias("entity_id"), "component"))
    groups = members.groupBy("component").agg(F.min("entity_id").alias("group_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return salted_lookup(members, groups, "component", HOT_ROWS, SALTS).select("entity_id", "group_id")
