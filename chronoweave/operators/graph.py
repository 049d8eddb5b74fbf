"""Reads over the graph: search, hydration, edges, traversal, centrality, timeline, statistics.

Edges are read through a symmetric view (one row an end), so that 'either end' is an equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.functions.text import words
from chronoweave.operators.skew import salted_lookup
from chronoweave.sources.tables import cut, micros

HOT_ROWS = 100_000
SALTS = 32
#: Entities of a probe beyond which their pairs with questions are spread over tasks, and how many.
HOT_PROBE, PROBE_SALTS = 1000, 8


def is_current(superseded: str = "superseded_by_id") -> Column:
    return F.coalesce(F.col(superseded), F.lit("")) == ""


def surfaces(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(entity_id, surface, is_alias): names and aliases of the entities given."""
    names = entities.select(F.col("id").alias("entity_id"), F.col("name").alias("surface"), F.lit(False).alias("is_alias"))
    others = aliases.select("entity_id", F.col("alias").alias("surface")).distinct().join(entities.select(F.col("id").alias("entity_id")), "entity_id", "left_semi")
    return names.unionByName(others.withColumn("is_alias", F.lit(True))).where("surface is not null")


def exact_matches(probes: DataFrame, surfaces: DataFrame) -> DataFrame:
    """(probe, entity_id) with a name or alias equal to the probe, letter case included."""
    keyed = surfaces.select(F.col("surface").alias("probe"), "entity_id").distinct()
    return salted_lookup(keyed, probes.select("probe").distinct(), "probe", HOT_ROWS, SALTS).select("probe", "entity_id")


def _containing(parts: DataFrame, texts: DataFrame) -> DataFrame:
    """(p, s) of all texts (s) that contain a part (p), none of them empty: each part is looked up by its rarest piece of
    three characters (shorter parts by themselves), then verified."""
    sizes = [row.n for row in parts.select(F.least(F.length("p"), F.lit(3)).alias("n")).distinct().collect()]  # at most three numbers

    def pieces(text: str, n: int) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(F.col(text), i, F.lit(n))))

    found = parts.crossJoin(texts).limit(0)
    for n in sorted(sizes):
        own = parts.where(F.least(F.length("p"), F.lit(3)) == n)
        postings = texts.where(F.length("s") >= n).select("s", F.explode(pieces("s", n)).alias("piece"))
        wanted = own.select("p", F.explode(pieces("p", n)).alias("piece"))
        sizes_of = postings.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
        rarest = Window.partitionBy("p").orderBy(F.coalesce("n", F.lit(0)), "piece")
        key = wanted.join(sizes_of, "piece", "left").withColumn("rank", F.row_number().over(rarest)).where("rank = 1").select("p", "piece")
        part = salted_lookup(postings, key, "piece", HOT_ROWS, SALTS).where(F.contains("s", "p")).select("p", "s")
        found = part if n == sorted(sizes)[0] else found.unionByName(part)
    return found


def substring_matches(probes: DataFrame, surfaces: DataFrame) -> DataFrame:
    """(probe, entity_id) with a name or alias that contains the probe, letter case aside.

    A word of a probe always lies within one word of the text, so the different words of the probes are matched with
    the different words of the texts; each probe is then looked up by its rarest word and verified. % and _ are ordinary
    characters. Only a probe without a word (blank) is compared with every text; an empty one matches every entity.
    """
    probes = cut(probes.select("probe", F.lower("probe").alias("p")).where("probe is not null").distinct())
    texts = surfaces.select("entity_id", F.lower("surface").alias("s"))
    postings = texts.select("entity_id", "s", F.explode(F.array_distinct(words(F.col("s")))).alias("token")).distinct()
    counts = cut(postings.groupBy(F.col("token").alias("s")).agg(F.count(F.lit(1)).alias("n")))
    wanted = probes.select("probe", "p", F.explode(F.array_distinct(words(F.col("p")))).alias("word"))
    held = cut(_containing(wanted.select(F.col("word").alias("p")).distinct(), counts.select("s")).join(counts, "s").select(F.col("p").alias("word"), F.col("s").alias("token"), "n"))
    rarest = Window.partitionBy("probe").orderBy(F.coalesce("n", F.lit(0)), "word")
    weights = held.groupBy("word").agg(F.sum("n").alias("n"))
    key = wanted.join(weights, "word", "left").withColumn("rank", F.row_number().over(rarest)).where("rank = 1").select("probe", "p", "word")
    looked_up = key.join(held.select("word", "token"), "word").select("probe", "p", "token")
    found = salted_lookup(postings, looked_up, "token", HOT_ROWS, SALTS).where(F.contains("s", "p")).select("probe", "entity_id")
    blank = probes.where(F.size(words(F.col("p"))) == 0)
    if not blank.isEmpty():
        found = found.unionByName(blank.join(texts, F.contains("s", "p")).select("probe", "entity_id"))
    return found.distinct()


def first_matches(questions: DataFrame, probes: str, found: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """Rows of ``questions`` with the entities of ``found`` (probe, entity_id) and their columns of ``entities``, each entity
    once: at the first of the question's array ``probes`` that it matches, numbered ``step`` from 0.

    Every row carries the probes it has before, or matches, so later matches are dropped where they arise: the pairs, far
    more than the rows of either table, are never shuffled to find repeats.
    """
    met = cut(found.groupBy("entity_id").agg(F.collect_set("probe").alias("_met")))
    postings = (met if entities is None else met.join(entities, "entity_id")).select("*", F.explode("_met").alias("probe"))
    steps = questions.select("*", F.posexplode(probes).alias("step", "probe")).withColumn("_before", F.slice(probes, F.lit(1), F.col("step")))
    pairs = salted_lookup(postings, steps.drop(probes), "probe", HOT_PROBE, PROBE_SALTS)
    return pairs.where(~F.arrays_overlap("_before", "_met")).drop("_before", "_met", "probe")


def current_properties(properties: DataFrame) -> DataFrame:
    """Versions that no other one supersedes."""
    return properties.where(is_current())


def latest(properties: DataFrame) -> DataFrame:
    """Per (entity_id, key) the version recorded last (larger id on a tie); partial maxima go before the shuffle."""
    rest = F.struct("recorded_at", "id", "value_json", "confidence", "as_of", "source_ref_id")
    return properties.groupBy("entity_id", "key").agg(F.max(rest).alias("v")).select("entity_id", "key", "v.*")


def as_known_at(properties: DataFrame, moment: Column) -> DataFrame:
    """Per (entity_id, key) the version recorded last up to a moment (transaction time)."""
    return latest(properties.where(F.col("recorded_at") <= moment))


def snapshot(entities: DataFrame, properties: DataFrame, moment: Column) -> DataFrame:
    """Entities, archived ones included, with their properties as known at a moment; entities without any keep one row."""
    known = as_known_at(properties, moment).select("entity_id", "key", "value_json", F.col("confidence").alias("property_confidence"))
    return entities.select(F.col("id").alias("entity_id"), "name", "type").join(known, "entity_id", "left")


def property_history(properties: DataFrame) -> DataFrame:
    """All versions with a version number in the order of recording."""
    order = Window.partitionBy("entity_id", "key").orderBy("recorded_at", "id")
    return properties.withColumn("version_no", F.row_number().over(order))


def hydrate(entities: DataFrame, aliases: DataFrame, properties: DataFrame) -> DataFrame:
    """Entities with a sorted array of aliases and a map of their current properties."""
    grouped = aliases.groupBy("entity_id").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
    held = latest(current_properties(properties)).groupBy("entity_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value_json")))).alias("properties"))
    joined = entities.join(grouped.withColumnRenamed("entity_id", "id"), "id", "left").join(held.withColumnRenamed("entity_id", "id"), "id", "left")
    return joined.withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>"))).withColumn("properties", F.coalesce("properties", F.create_map().cast("map<string,string>")))


def symmetric(relationships: DataFrame) -> DataFrame:
    """Every edge from both ends: (entity_id, other_id, direction, and the edge's columns)."""
    out = relationships.withColumn("entity_id", F.col("source_id")).withColumn("other_id", F.col("target_id")).withColumn("direction", F.lit("outgoing"))
    back = relationships.withColumn("entity_id", F.col("target_id")).withColumn("other_id", F.col("source_id")).withColumn("direction", F.lit("incoming"))
    return out.unionByName(back)


def edges_of(relationships: DataFrame, direction: str = "both", types: tuple[str, ...] = ()) -> DataFrame:
    found = symmetric(relationships)
    if direction != "both":
        found = found.where(F.col("direction") == direction)
    return found.where(F.col("type").isin(*types)) if types else found


def find_relationship(relationships: DataFrame) -> DataFrame:
    """(source_id, target_id, type, id, n): the first edge of each triple (smallest id) and how many there are."""
    return relationships.groupBy("source_id", "target_id", "type").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))


def add_if_absent(relationships: DataFrame, new: DataFrame) -> DataFrame:
    """Append edges whose (source_id, target_id, type) does not exist yet."""
    triple = ["source_id", "target_id", "type"]
    return relationships.unionByName(new.dropDuplicates(triple).join(relationships.select(*triple).distinct(), triple, "left_anti"))


def neighbors(starts: DataFrame, entities: DataFrame, relationships: DataFrame, hops: int, types: tuple[str, ...] = ()) -> DataFrame:
    """(start_id, entity_id, depth): active entities within ``hops`` edges (at least one) of each start, itself left out.

    Breadth first; paths go through archived entities too. The frontier holds each (start, node) once.
    """
    links = cut(edges_of(relationships, types=types).select("entity_id", "other_id").distinct())
    visited = starts.select(F.col("id").alias("start_id"), F.col("id").alias("entity_id")).distinct().withColumn("depth", F.lit(0))
    frontier = visited
    for depth in range(1, max(1, hops) + 1):
        stepped = salted_lookup(frontier.select("start_id", "entity_id"), links, "entity_id", HOT_ROWS, SALTS)
        reached = stepped.select("start_id", F.col("other_id").alias("entity_id")).distinct()
        frontier = cut(reached.join(visited, ["start_id", "entity_id"], "left_anti").withColumn("depth", F.lit(depth)))
        visited = visited.unionByName(frontier)
    active = entities.where("not archived").select(F.col("id").alias("entity_id"))
    return visited.where("depth > 0").join(active, "entity_id", "left_semi")


def induced_subgraph(centers: DataFrame, entities: DataFrame, relationships: DataFrame, hops: int) -> DataFrame:
    """(start_id, relationship_id): edges with both ends within ``hops`` (1 to 4) of a center."""
    inside = neighbors(centers, entities, relationships, min(4, max(1, hops))).select("start_id", "entity_id")
    inside = cut(inside.unionByName(centers.select(F.col("id").alias("start_id"), F.col("id").alias("entity_id"))))
    edges = relationships.select(F.col("id").alias("relationship_id"), F.col("source_id").alias("entity_id"), "target_id")
    first = inside.join(edges, "entity_id").select("start_id", "relationship_id", F.col("target_id").alias("entity_id"))
    return first.join(inside, ["start_id", "entity_id"], "left_semi").select("start_id", "relationship_id").distinct()


def degree_centrality(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """(entity_id, n_edges, degree): active entities; a self-loop is one edge; degree is edges / 20, at most 1."""
    ends = edges_of(relationships).select("entity_id", "id").distinct().groupBy("entity_id").agg(F.count(F.lit(1)).alias("n_edges"))
    counted = entities.where("not archived").select(F.col("id").alias("entity_id")).join(ends, "entity_id", "left").na.fill(0, ["n_edges"])
    return counted.withColumn("degree", F.least(F.col("n_edges") / 20.0, F.lit(1.0)))


def graph_stats(entities: DataFrame, relationships: DataFrame, properties: DataFrame) -> DataFrame:
    """One row: active entities and their average confidence (0 without any), edges, current properties, edges per entity."""
    nodes = entities.where("not archived").agg(F.count(F.lit(1)).alias("node_count"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("avg_confidence"))
    edges = relationships.agg(F.count(F.lit(1)).alias("edge_count"))
    held = current_properties(properties).agg(F.count(F.lit(1)).alias("property_count"))
    stats = nodes.join(edges, F.lit(True)).join(held, F.lit(True))  # one row each
    return stats.withColumn("density", F.col("edge_count") / F.greatest("node_count", F.lit(1)))


def timeline(entities: DataFrame, properties: DataFrame, relationships: DataFrame, cap: int = 500) -> DataFrame:
    """The newest ``cap`` events of active entities: versions recorded and edges begun, ties by id."""
    active = entities.where("not archived").select(F.col("id").alias("entity_id"), "name")
    told = properties.select("entity_id", F.lit("property").alias("event"), F.col("id").alias("event_id"), F.col("key").alias("label"), micros("recorded_at").alias("at_us"))
    begun = relationships.select(F.col("source_id").alias("entity_id"), F.lit("relationship").alias("event"), F.col("id").alias("event_id"), F.col("type").alias("label"), micros("valid_from").alias("at_us"))
    return told.unionByName(begun).join(active, "entity_id").orderBy(F.desc("at_us"), "event_id").limit(cap)
