"""Queries over the graph tables: reads, facts and consolidation, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave import schema
from chronoweave.functions import text
from chronoweave.operators import consolidation, facts, graph
from chronoweave.sources.tables import micros, scan

NOW = "2026-01-01 00:00:00"
MOMENT = "2025-01-01 00:00:00"


def at(moment: str) -> Column:
    return F.lit(moment).cast("timestamp")


def entities(s: SparkSession, d: str) -> DataFrame:
    rows = schema.one_record(scan(s, d, "entities"), newest=("last_seen", "access_count", "archived"))
    return rows.withColumn("merged_into", F.nullif(F.lower(F.trim("merged_into")), F.lit("")))


def aliases(s: SparkSession, d: str) -> DataFrame:
    return schema.one_record(scan(s, d, "entity_aliases"))


def properties(s: SparkSession, d: str) -> DataFrame:
    rows = schema.one_record(scan(s, d, "properties"))
    return rows.withColumns({c: F.nullif(c, F.lit("")) for c in ("source_ref_id", "superseded_by_id")})


def relationships(s: SparkSession, d: str) -> DataFrame:
    return schema.one_record(scan(s, d, "relationships"), newest=("access_count",))


def source_refs(s: SparkSession, d: str) -> DataFrame:
    return schema.one_record(scan(s, d, "source_refs"))


def _grouped(table: str, keep: str, newest: str = "") -> str:
    order = ", ".join(f"{c} DESC NULLS LAST" for c in [*newest.split(), *keep.split()])
    return f"(SELECT id, {', '.join([*keep.split(), *newest.split()])} FROM {table} QUALIFY row_number() OVER (PARTITION BY id ORDER BY {order}) = 1)"


#: The tables with one row a record, for the SQL side.
CLEAN = f"""
WITH RECURSIVE e0 AS {_grouped("entities", "type name created_at confidence merged_into", "last_seen access_count archived")},
e AS (SELECT * REPLACE (nullif(lower(trim(merged_into)), '') AS merged_into) FROM e0),
a AS {_grouped("entity_aliases", "entity_id alias added_at")},
p0 AS {_grouped("properties", "entity_id key value_json as_of recorded_at source_ref_id confidence superseded_by_id")},
p AS (SELECT * REPLACE (nullif(source_ref_id, '') AS source_ref_id, nullif(superseded_by_id, '') AS superseded_by_id) FROM p0),
r AS {_grouped("relationships", "source_id target_id type valid_from valid_to source_ref_id confidence", "access_count")},
s AS {_grouped("source_refs", "conversation_id turn_number timestamp statement_type verbatim authority")},
sym AS (SELECT source_id AS entity_id, target_id AS other_id, 'outgoing' AS direction, * FROM r
        UNION ALL SELECT target_id, source_id, 'incoming', * FROM r),
surfaces AS (SELECT id AS entity_id, name AS surface FROM e WHERE NOT archived AND name IS NOT NULL
             UNION SELECT a.entity_id, alias FROM a JOIN e ON e.id = a.entity_id WHERE NOT archived AND alias IS NOT NULL),
v AS (SELECT *, CASE WHEN regexp_matches(value_json, '^\\s*"') THEN 's' || lower(trim(regexp_replace(value_json, '^\\s*"|"\\s*$', '', 'g'))) ELSE coalesce(value_json, 'null') END AS same FROM p)
"""

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = CLEAN + sql
        return function

    return register


def _surfaces(s, d):
    return graph.surfaces(entities(s, d).where("not archived"), aliases(s, d))


@query("SELECT DISTINCT x.alias AS probe, entity_id FROM (SELECT DISTINCT alias FROM a) x JOIN surfaces ON surface = x.alias")
def entity_search_exact(s, d):
    return graph.exact_matches(aliases(s, d).select(F.col("alias").alias("probe")), _surfaces(s, d))


@query("SELECT DISTINCT x.name AS probe, entity_id FROM (SELECT DISTINCT name FROM e WHERE type IN ('event', 'concept')) x JOIN surfaces ON contains(lower(surface), lower(x.name))")
def entity_search_fuzzy(s, d):
    return graph.substring_matches(entities(s, d).where("type in ('event', 'concept')").select(F.col("name").alias("probe")), _surfaces(s, d))


@query("SELECT id, name, type FROM e WHERE NOT archived AND type = 'organization'")
def entity_search_type(s, d):
    return entities(s, d).where("not archived and type = 'organization'").select("id", "name", "type")


@query("""SELECT e.id, name, coalesce((SELECT string_agg(DISTINCT alias, '|' ORDER BY alias) FROM a WHERE a.entity_id = e.id), '') AS aliases,
coalesce((SELECT string_agg(key || '=' || coalesce(value_json, ''), '|' ORDER BY key) FROM
  (SELECT *, row_number() OVER (PARTITION BY entity_id, key ORDER BY recorded_at DESC, id DESC) AS rn FROM p WHERE superseded_by_id IS NULL) c
  WHERE rn = 1 AND c.entity_id = e.id), '') AS properties FROM e WHERE NOT archived""")
def entity_hydrated(s, d):
    full = graph.hydrate(entities(s, d).where("not archived"), aliases(s, d), properties(s, d))
    shown = F.transform(F.array_sort(F.map_entries("properties")), lambda p: F.concat(p["key"], F.lit("="), F.coalesce(p["value"], F.lit(""))))
    return full.select("id", "name", F.array_join("aliases", "|").alias("aliases"), F.array_join(shown, "|").alias("properties"))


@query("SELECT id, entity_id, key, value_json, confidence FROM p WHERE superseded_by_id IS NULL")
def current_properties(s, d):
    return graph.current_properties(properties(s, d)).select("id", "entity_id", "key", "value_json", "confidence")


_KNOWN = f"""k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, key ORDER BY recorded_at DESC, id DESC) AS rn
FROM p WHERE recorded_at <= TIMESTAMPTZ '{MOMENT}+00') WHERE rn = 1)"""


@query(f", {_KNOWN} SELECT entity_id, key, id AS property_id, value_json FROM k")
def property_as_of(s, d):
    return graph.as_known_at(properties(s, d), at(MOMENT)).select("entity_id", "key", F.col("id").alias("property_id"), "value_json")


@query(f", {_KNOWN} SELECT e.id AS entity_id, name, type, key, value_json, k.confidence AS property_confidence FROM e LEFT JOIN k ON k.entity_id = e.id")
def point_in_time_snapshot(s, d):
    return graph.snapshot(entities(s, d), properties(s, d), at(MOMENT))


@query("SELECT entity_id, key, id, value_json, row_number() OVER (PARTITION BY entity_id, key ORDER BY recorded_at, id) AS version_no FROM p")
def property_history(s, d):
    return graph.property_history(properties(s, d)).select("entity_id", "key", "id", "value_json", "version_no")


@query("SELECT id, lead(id) OVER (PARTITION BY entity_id, key ORDER BY recorded_at, id) AS next_id FROM p")
def supersession_chain(s, d):
    return facts.supersession(properties(s, d)).select("id", "next_id")


def _edges(s, d, direction):
    return graph.edges_of(relationships(s, d), direction).select("entity_id", "other_id", "direction", F.col("id").alias("relationship_id"), "type")


@query("SELECT entity_id, other_id, direction, id AS relationship_id, type FROM sym WHERE direction = 'outgoing'")
def relationships_out(s, d):
    return _edges(s, d, "outgoing")


@query("SELECT entity_id, other_id, direction, id AS relationship_id, type FROM sym WHERE direction = 'incoming'")
def relationships_in(s, d):
    return _edges(s, d, "incoming")


@query("SELECT entity_id, other_id, direction, id AS relationship_id, type FROM sym")
def relationships_both(s, d):
    return _edges(s, d, "both")


@query("SELECT source_id, target_id, type, min(id) AS id, count(*) AS n FROM r GROUP BY ALL")
def find_relationship(s, d):
    return graph.find_relationship(relationships(s, d))


@query("""SELECT r.id AS relationship_id, o.name AS source_name, coalesce(t.name, substr(r.target_id, 1, 8)) AS target_name, type_shown FROM
(SELECT *, '→ [' || type || ']' AS type_shown FROM r) r JOIN e o ON o.id = r.source_id LEFT JOIN e t ON t.id = r.target_id""")
def edge_endpoints(s, d):
    names = entities(s, d).select("id", "name")
    source = names.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    target = names.select(F.col("id").alias("target_id"), F.col("name").alias("_target"))
    joined = relationships(s, d).withColumnRenamed("id", "relationship_id").join(source, "source_id").join(target, "target_id", "left")
    shown = F.concat(F.lit("→ ["), "type", F.lit("]"))
    return joined.select("relationship_id", "source_name", F.coalesce("_target", F.substring("target_id", 1, 8)).alias("target_name"), shown.alias("type_shown"))


_HOPS = """, n(start_id, entity_id, depth) AS (SELECT id, id, 0 FROM e
UNION SELECT n.start_id, sym.other_id, n.depth + 1 FROM n JOIN sym ON sym.entity_id = n.entity_id WHERE n.depth < {hops}{types}),
f AS (SELECT start_id, entity_id, min(depth) AS depth FROM n GROUP BY ALL)
"""
_FOUND = "SELECT start_id, entity_id, depth FROM f JOIN e ON e.id = f.entity_id WHERE depth > 0 AND NOT archived"


def _neighbors(s, d, hops, types=()):
    known = entities(s, d)
    return graph.neighbors(known, known, relationships(s, d), hops, types)


@query(_HOPS.format(hops=1, types="") + _FOUND)
def neighbors_1_hop(s, d):
    return _neighbors(s, d, 1)


@query(_HOPS.format(hops=2, types="") + _FOUND)
def neighbors_2_hop(s, d):
    return _neighbors(s, d, 2)


@query(_HOPS.format(hops=3, types="") + _FOUND)
def neighbors_3_hop(s, d):
    return _neighbors(s, d, 3)


@query(_HOPS.format(hops=2, types=" AND sym.type IN ('knows', 'works_at')") + _FOUND)
def neighbors_typed(s, d):
    return _neighbors(s, d, 2, ("knows", "works_at"))


@query(_HOPS.format(hops=1, types="") + """, i AS (SELECT start_id, entity_id FROM f JOIN e ON e.id = f.entity_id WHERE NOT archived OR depth = 0)
SELECT DISTINCT x.start_id, r.id AS relationship_id FROM r JOIN i x ON x.entity_id = r.source_id JOIN i y ON y.entity_id = r.target_id AND y.start_id = x.start_id""")
def induced_subgraph(s, d):
    known = entities(s, d)
    return graph.induced_subgraph(known, known, relationships(s, d), 1)


@query("""SELECT e.id AS entity_id, coalesce(n, 0) AS n_edges, least(coalesce(n, 0) / 20.0, 1.0) AS degree FROM e
LEFT JOIN (SELECT entity_id, count(DISTINCT id) AS n FROM sym GROUP BY 1) x ON x.entity_id = e.id WHERE NOT archived""")
def degree_centrality(s, d):
    return graph.degree_centrality(entities(s, d), relationships(s, d))


_STATS = """SELECT node_count, edge_count, property_count, round(avg_confidence, 9) AS avg_confidence, round(edge_count / greatest(node_count, 1), 9) AS density FROM
(SELECT count(*) AS node_count, coalesce(avg(confidence), 0) AS avg_confidence FROM e WHERE NOT archived), (SELECT count(*) AS edge_count FROM r),
(SELECT count(*) AS property_count FROM p WHERE superseded_by_id IS NULL)"""


@query(_STATS)
def graph_stats(s, d):
    stats = graph.graph_stats(entities(s, d), relationships(s, d), properties(s, d))
    return stats.withColumns({c: F.round(c, 9) for c in ("avg_confidence", "density")})


_CLASSES = """, c AS (SELECT p.*, existing_id, CASE WHEN existing_id IS NULL OR same = existing THEN 'confirmation' WHEN as_of < existing_as_of THEN 'historical'
  WHEN authority >= 0.8 THEN 'update' ELSE 'contradiction' END AS conflict_type FROM
  (SELECT v.*, coalesce(s.authority, 1.0) AS authority, lag(v.id) OVER w AS existing_id, lag(same) OVER w AS existing, lag(as_of) OVER w AS existing_as_of
   FROM v LEFT JOIN s ON s.id = v.source_ref_id WINDOW w AS (PARTITION BY entity_id, key ORDER BY recorded_at, v.id)) p)
"""


@query(_CLASSES + "SELECT id, existing_id, conflict_type FROM c")
def conflict_classification(s, d):
    return facts.classify(properties(s, d), source_refs(s, d)).select("id", "existing_id", "conflict_type")


@query(_CLASSES + "SELECT entity_id, key AS property_key, existing_id AS value_a_id, id AS value_b_id, 'unresolved' AS status FROM c WHERE conflict_type = 'contradiction'")
def unresolved_conflicts(s, d):
    return facts.conflicts(properties(s, d), source_refs(s, d)).select("entity_id", "property_key", "value_a_id", "value_b_id", "status")


@query(_CLASSES + ", h AS (" + _STATS + ") SELECT h.*, (SELECT count(*) FROM c WHERE conflict_type = 'contradiction') AS unresolved_conflicts FROM h")
def graph_health(s, d):
    open_conflicts = facts.conflicts(properties(s, d), source_refs(s, d)).agg(F.count(F.lit(1)).alias("unresolved_conflicts"))
    return graph_stats(s, d).join(open_conflicts, F.lit(True))  # one row each


_DAYS = f"floor((epoch_us(TIMESTAMPTZ '{NOW}+00') - epoch_us({{}})) / 86400000000.0)"
_DECAY = f""", n AS (SELECT entity_id, key, value_json, count(*) - 1 AS confirmations FROM p WHERE value_json IS NOT NULL GROUP BY 1, 2, 3),
w AS (SELECT p.*, least(1.0, pow(0.5, greatest(0, {_DAYS.format("recorded_at")}) / CASE key WHEN 'employment' THEN 180 WHEN 'location' THEN 120 WHEN 'preference' THEN 90
  WHEN 'relationship' THEN 365 WHEN 'project' THEN 60 WHEN 'contact_info' THEN 365 ELSE 180 END) * (1 + least(coalesce(confirmations, 0) * 0.1, 0.5))) AS value
  FROM p LEFT JOIN n USING (entity_id, key, value_json)),
decayed AS (SELECT * EXCLUDE (value, confidence), superseded_by_id IS NULL AND coalesce(abs(value - confidence) > 0.001, false) AS decayed,
  CASE WHEN superseded_by_id IS NULL AND abs(value - confidence) > 0.001 THEN value ELSE confidence END AS confidence FROM w)
"""


@query(_DECAY + "SELECT id, round(confidence, 6) AS confidence, decayed FROM decayed")
def decay_confidence(s, d):
    return consolidation.decay_confidence(properties(s, d), at(NOW)).select("id", F.round("confidence", 6).alias("confidence"), "decayed")


@query("""SELECT id, round(CASE WHEN rank > 1 THEN least(1.0, confidence + 0.1) ELSE confidence END, 6) AS confidence, coalesce(next_id, superseded_by_id) AS superseded_by_id FROM v LEFT JOIN
(SELECT v.id AS vid, lead(v.id) OVER w AS next_id, row_number() OVER w AS rank FROM v JOIN e ON e.id = v.entity_id
 WHERE superseded_by_id IS NULL AND NOT archived WINDOW w AS (PARTITION BY entity_id, key, same ORDER BY recorded_at, v.id)) ON vid = id""")
def merge_redundant(s, d):
    return consolidation.merge_redundant(properties(s, d), entities(s, d)).select("id", F.round("confidence", 6).alias("confidence"), "superseded_by_id")


@query(f"SELECT id, confidence FROM e WHERE NOT archived AND confidence < 0.2 AND {_DAYS.format('last_seen')} >= 90 AND id NOT IN (SELECT entity_id FROM sym WHERE entity_id IS NOT NULL)")
def prune_orphans(s, d):
    return consolidation.orphans(entities(s, d), relationships(s, d), at(NOW)).select("id", "confidence")


@query("SELECT id, confidence FROM e WHERE NOT archived AND confidence < 0.7 AND " + _DAYS.format("last_seen") + " >= 1 AND id NOT IN (SELECT entity_id FROM sym WHERE entity_id IS NOT NULL)")
def orphan_candidates(s, d):
    """Orphans at limits that some entities of any table stay under."""
    return consolidation.orphans(entities(s, d), relationships(s, d), at(NOW), 0.7, 1).select("id", "confidence")


@query(_CLASSES + _DECAY + """SELECT value_a_id, value_b_id, CASE WHEN resolution IS NULL THEN 'unresolved' ELSE 'auto_resolved' END AS status, resolution FROM (
SELECT c.existing_id AS value_a_id, c.id AS value_b_id, CASE WHEN x.confidence < 0.2 AND y.confidence < 0.2 THEN 'Both values decayed'
  WHEN x.confidence < 0.2 THEN printf('Value A decayed to %.2f', x.confidence) WHEN y.confidence < 0.2 THEN printf('Value B decayed to %.2f', y.confidence) END AS resolution
FROM c LEFT JOIN decayed x ON x.id = c.existing_id LEFT JOIN decayed y ON y.id = c.id WHERE conflict_type = 'contradiction')""")
def auto_resolve_contradictions(s, d):
    rows = properties(s, d)
    decayed = consolidation.decay_confidence(rows, at(NOW))
    return consolidation.resolve_contradictions(facts.conflicts(rows, source_refs(s, d)), decayed, at(NOW)).select("value_a_id", "value_b_id", "status", "resolution")


@query(_CLASSES + _DECAY + f""", mg AS (SELECT d.id, CASE WHEN rank > 1 THEN least(1.0, confidence + 0.1) ELSE confidence END AS confidence, coalesce(next_id, superseded_by_id) AS superseded_by_id FROM decayed d LEFT JOIN
(SELECT v.id AS vid, lead(v.id) OVER w AS next_id, row_number() OVER w AS rank FROM v JOIN e ON e.id = v.entity_id
 WHERE superseded_by_id IS NULL AND NOT archived WINDOW w AS (PARTITION BY entity_id, key, same ORDER BY recorded_at, v.id)) ON vid = d.id),
lost AS (SELECT id FROM e WHERE NOT archived AND confidence < 0.2 AND {_DAYS.format('last_seen')} >= 90 AND id NOT IN (SELECT entity_id FROM sym WHERE entity_id IS NOT NULL))
SELECT (SELECT count(*) FROM mg WHERE superseded_by_id IS NULL) AS current_properties, (SELECT round(avg(confidence), 6) FROM mg) AS avg_confidence,
(SELECT count(*) FROM e WHERE archived OR id IN (SELECT id FROM lost)) AS archived_entities,
(SELECT count(*) FROM c LEFT JOIN mg x ON x.id = c.existing_id LEFT JOIN mg y ON y.id = c.id WHERE conflict_type = 'contradiction' AND (x.confidence < 0.2 OR y.confidence < 0.2)) AS auto_resolved,
(SELECT round(avg(least(coalesce(n, 0) / 20.0, 1.0)), 6) FROM e LEFT JOIN (SELECT entity_id, count(DISTINCT id) AS n FROM sym GROUP BY 1) z ON z.entity_id = e.id
 WHERE NOT archived AND e.id NOT IN (SELECT id FROM lost)) AS avg_degree""")
def consolidate_full(s, d):
    rows, known, edges = properties(s, d), entities(s, d), relationships(s, d)
    done = consolidation.run_full(known, rows, edges, facts.conflicts(rows, source_refs(s, d)), at(NOW))
    counts = done["properties"].agg(F.sum(graph.is_current().cast("long")).alias("current_properties"), F.round(F.avg("confidence"), 6).alias("avg_confidence"))
    archived = done["entities"].agg(F.sum(F.col("archived").cast("long")).alias("archived_entities"))
    resolved = done["conflicts"].agg(F.sum((F.col("status") == "auto_resolved").cast("long")).alias("auto_resolved"))
    central = done["centrality_index"].agg(F.round(F.avg("degree"), 6).alias("avg_degree"))
    return counts.join(archived, F.lit(True)).join(resolved, F.lit(True)).join(central, F.lit(True))  # one row each


@query(_CLASSES + "SELECT id, round(CASE WHEN conflict_type = 'confirmation' AND existing_id IS NOT NULL THEN least(1.0, confidence + 0.05) ELSE confidence END, 6) AS confidence FROM c")
def confirmed_confidence(s, d):
    return facts.boost_confirmed(facts.classify(properties(s, d), source_refs(s, d))).select("id", F.round("confidence", 6).alias("confidence"))


@query("""SELECT * FROM (SELECT entity_id, 'property' AS event, p.id AS event_id, key AS label, epoch_us(recorded_at) AS at_us, name FROM p JOIN e ON e.id = p.entity_id WHERE NOT archived
UNION ALL SELECT source_id, 'relationship', r.id, r.type, epoch_us(valid_from), name FROM r JOIN e ON e.id = r.source_id WHERE NOT archived)
ORDER BY at_us DESC NULLS LAST, event_id LIMIT 500""")
def timeline(s, d):
    return graph.timeline(entities(s, d), properties(s, d), relationships(s, d)).select("entity_id", "event", "event_id", "label", "at_us", "name")


@query("""SELECT 'entities' AS table_name, 'type_value' AS rule, id AS row_id FROM e WHERE type IS NULL OR type NOT IN ('person', 'organization', 'project', 'concept', 'location', 'event')
UNION ALL SELECT 'source_refs', 'statement_type_value', id FROM s WHERE statement_type IS NULL OR statement_type NOT IN ('explicit', 'inferred', 'third_party', 'corrected')
UNION ALL SELECT 'entity_aliases', 'entity_id_reference', id FROM a WHERE entity_id <> '' AND entity_id NOT IN (SELECT id FROM e)
UNION ALL SELECT 'properties', 'entity_id_reference', id FROM p WHERE entity_id <> '' AND entity_id NOT IN (SELECT id FROM e)
UNION ALL SELECT 'properties', 'source_ref_id_reference', id FROM p WHERE source_ref_id <> '' AND source_ref_id NOT IN (SELECT id FROM s)
UNION ALL SELECT 'properties', 'superseded_by_id_reference', id FROM p WHERE superseded_by_id <> '' AND superseded_by_id NOT IN (SELECT id FROM p)
UNION ALL SELECT 'relationships', 'source_id_reference', id FROM r WHERE source_id <> '' AND source_id NOT IN (SELECT id FROM e)
UNION ALL SELECT 'relationships', 'target_id_reference', id FROM r WHERE target_id <> '' AND target_id NOT IN (SELECT id FROM e)
UNION ALL SELECT 'relationships', 'source_ref_id_reference', id FROM r WHERE source_ref_id <> '' AND source_ref_id NOT IN (SELECT id FROM s)""")
def constraint_violations(s, d):
    return schema.constraint_violations(entities(s, d), aliases(s, d), source_refs(s, d), properties(s, d), relationships(s, d))
