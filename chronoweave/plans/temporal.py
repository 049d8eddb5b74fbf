"""Queries of the general problems: attribute history, attributes at event time, periods and gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronoweave.operators.asof import attributes_at_events
from chronoweave.operators.history import build_history
from chronoweave.operators.periods import gaps, periods
from chronoweave.sources.tables import scan


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    history = build_history(scan(spark, base, "properties", "id", "entity_id", "key", "value_json", "as_of", "recorded_at"))
    return history.drop("value")


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    events = scan(spark, base, "access_log", "id", "entity_id", "timestamp")
    return attributes_at_events(events, scan(spark, base, "properties", "id", "entity_id", "key", "value_json", "as_of", "recorded_at"))


def p7_found(spark: SparkSession, base: str) -> DataFrame:
    return gaps(scan(spark, base, "relationships", "source_id", "valid_from", "valid_to"), "source_id", "valid_from", "valid_to")


def p7_periods(spark: SparkSession, base: str) -> DataFrame:
    return periods(scan(spark, base, "relationships", "source_id", "valid_from", "valid_to"), "source_id", "valid_from", "valid_to")


QUERIES = {"p1_found": p1_found, "p4_found": p4_found, "p7_found": p7_found, "p7_periods": p7_periods}

_P7 = """
WITH i AS (SELECT DISTINCT source_id, epoch_us(valid_from) AS s, coalesce(epoch_us(valid_to), 9223372036854775807) AS e
           FROM relationships WHERE source_id <> ''),
o AS (SELECT *, max(e) OVER (PARTITION BY source_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i WHERE s < e)
"""

SQL = {
    "p1_found": """
WITH v AS (
  SELECT id, entity_id, key, epoch_us(as_of) AS since, epoch_us(recorded_at) AS learnt,
         CASE WHEN value_json IS NULL THEN NULL
              WHEN NOT json_valid(value_json) THEN 's' || lower(trim(value_json))
              WHEN json_type(value_json) = 'NULL' THEN NULL
              WHEN json_type(value_json) = 'VARCHAR' THEN 's' || lower(trim(json_extract_string(value_json, '$')))
              WHEN json_type(value_json) IN ('DOUBLE', 'BIGINT', 'UBIGINT', 'HUGEINT') THEN 'n' || CAST(CAST(value_json AS DOUBLE) AS VARCHAR)
              WHEN json_type(value_json) = 'OBJECT' THEN 'o' || CAST(list_sort(list_transform(json_keys(value_json),
                   lambda k: k || ':' || regexp_replace(CAST(json_extract(value_json, '$."' || k || '"') AS VARCHAR), '[.]0$', ''))) AS VARCHAR)
              ELSE 'j' || CAST(json(value_json) AS VARCHAR) END AS value
  FROM properties WHERE entity_id <> '' AND key IS NOT NULL AND as_of IS NOT NULL),
h AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY entity_id, key, since ORDER BY learnt DESC NULLS LAST, id DESC) = 1),
c AS (SELECT *, lag(value) OVER (PARTITION BY entity_id, key ORDER BY since) AS previous FROM h),
n AS (SELECT *, lead(since) OVER (PARTITION BY entity_id, key ORDER BY since) AS until FROM c WHERE value IS DISTINCT FROM previous)
SELECT entity_id, key AS property_key, id AS property_id, since AS valid_from_us, coalesce(until, -1) AS valid_to_us FROM n WHERE value IS NOT NULL
""",
    "p4_found": """
SELECT access_id, property_key, property_id FROM (
  SELECT a.id AS access_id, p.key AS property_key, p.id AS property_id, p.value_json,
         row_number() OVER (PARTITION BY a.id, p.key ORDER BY p.as_of DESC, p.recorded_at DESC, p.id DESC) AS rn
  FROM (SELECT DISTINCT id, entity_id, timestamp FROM access_log) a
  JOIN (SELECT DISTINCT id, entity_id, key, value_json, as_of, recorded_at FROM properties) p
    ON p.entity_id = a.entity_id AND p.as_of <= a.timestamp AND p.recorded_at <= a.timestamp)
WHERE rn = 1 AND value_json IS NOT NULL AND trim(value_json) <> 'null'
""",
    "p7_found": _P7 + "SELECT source_id, reach AS gap_from_us, s AS gap_to_us FROM o WHERE s > reach",
    "p7_periods": _P7
    + """, g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS n FROM o)
SELECT source_id, min(s) AS period_from_us, CASE WHEN max(e) = 9223372036854775807 THEN -1 ELSE max(e) END AS period_to_us FROM g GROUP BY source_id, n
""",
}
