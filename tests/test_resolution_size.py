"""Pairs of mentions and entities: each once, made, compared and folded without being shuffled."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronoweave.operators import graph, resolution


def _tables(spark):
    names = ["Ann Lee", "ann lee", "Lee Ann Corp", "Ann", "Anna Leeds", "ANN LEE", "Bo", "x  Ann\tLee y", None]
    columns = "id string, name string, type string, last_seen timestamp"
    known = spark.createDataFrame([(f"e{9 - n}", name, "person") for n, name in enumerate(names)], "id string, name string, type string").withColumn("last_seen", F.lit("2025-01-01").cast("timestamp")).to(spark.createDataFrame([], columns).schema)
    aliases = spark.createDataFrame([("a", "e9", "Annie"), ("b", "e3", "Lee"), ("c", "e3", "B. Ann")], "id string, entity_id string, alias string")
    mentions = spark.createDataFrame([("m1", "Ann Lee", "person"), ("m2", "Bo", "person"), ("m3", "lee", "person"), ("m4", None, "person"), ("m5", " Corp  Lee ", "person"), ("m6", "ab", "person")], "mention_id string, name string, type string")
    return known, aliases, mentions


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_candidates_come_once_without_a_shuffle_of_pairs(spark, rows):
    known, aliases, mentions = _tables(spark)
    found = resolution.candidates(mentions, graph.surfaces(known, aliases))
    surfaces = [(r.entity_id, r.surface.lower()) for r in graph.surfaces(known, aliases).collect()]
    expected = set()
    for m in mentions.where("name is not null").collect():
        parts = m.name.split()
        for probe in [m.name, *(w for w in parts if len(w) > 2 and len(parts) > 1)]:
            expected |= {(m.mention_id, e) for e, s in surfaces if probe.lower() in s}
    assert rows(found) == sorted(expected, key=repr)
    assert "Aggregate" not in _plan(found).split("Join")[0]


def test_signals_of_all_candidates_are_compared_where_they_arise(spark, rows):
    known, aliases, mentions = _tables(spark)
    found = resolution.candidate_signals(mentions, known, aliases)
    pairs = resolution.candidates(mentions, graph.surfaces(known, aliases))
    assert rows(found) == rows(resolution.signals(mentions, pairs, known, aliases).select(*found.columns))
    assert "Aggregate" not in _plan(resolution.tier1_scores(found)).split("Join")[0]


def test_tier2_takes_connections_from_the_signals(spark, rows):
    known, aliases, mentions = _tables(spark)
    known = known.withColumn("archived", F.lit(False))
    links = spark.createDataFrame([("1", "e9", "e8"), ("2", "e9", "e7"), ("3", "e7", "e9")], "id string, source_id string, target_id string").withColumn("type", F.lit("knows"))
    near = resolution.connections(known, links)
    brought = resolution.candidate_signals(mentions, known.join(near.withColumnRenamed("entity_id", "id"), "id", "left"), aliases)
    now = F.lit("2025-02-01").cast("timestamp")
    joined = resolution.candidate_signals(mentions, known, aliases)
    columns = ("mention_id", "entity_id", "score")
    assert rows(resolution.tier2_scores(brought, known, links, now), *columns) == rows(resolution.tier2_scores(joined, known, links, now), *columns)


def test_the_best_candidate_is_folded_ties_by_id(spark, rows):
    known, aliases, mentions = _tables(spark)
    known = resolution.numbered(known.repartition(3))
    assert [r.entity_no for r in known.orderBy("id").collect()] == list(range(9))
    scored = resolution.tier1_scores(resolution.candidate_signals(mentions, known, aliases))
    order = Window.partitionBy("mention_id").orderBy(F.desc("score"), "entity_id")
    expected = scored.withColumn("n", F.row_number().over(order)).where("n = 1")
    assert rows(resolution.best(scored, known)) == rows(expected, "mention_id", "entity_id")
