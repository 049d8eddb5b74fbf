"""Reads, facts, consolidation, resolution, merging, privacy, search and recall on small graphs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from chronoweave import schema
from chronoweave.functions import scores, text
from chronoweave.operators import consolidation, evaluation, extraction, facts, graph, merging, privacy, recall, resolution, search
from chronoweave.streaming import scratchpad

NOW = dt.datetime(2026, 4, 1)


def ts(s):
    return None if s is None else dt.datetime.fromisoformat(s)


@pytest.fixture
def make(spark):
    def table(name, *rows):
        struct = schema.TABLES[name]
        defaults = {"confidence": 1.0, "access_count": 0, "archived": False, "created_at": ts("2025-01-01"), "last_seen": ts("2025-06-01"), "type": "person", "valid_from": ts("2025-01-01"), "as_of": ts("2025-01-01"), "recorded_at": ts("2025-01-01")}
        return spark.createDataFrame([tuple((defaults | row).get(f.name) for f in struct) for row in rows], struct)

    return table


def entity(i, name, **more):
    return {"id": i, "name": name} | more


def version(i, e, k, v, recorded="2025-01-01", **more):
    return {"id": i, "entity_id": e, "key": k, "value_json": v, "recorded_at": ts(recorded), "as_of": ts(recorded)} | more


def edge(i, s, t, kind="knows", **more):
    return {"id": i, "source_id": s, "target_id": t, "type": kind} | more


@pytest.fixture
def now():
    return F.lit(NOW).cast("timestamp")


def test_soundex_and_similarity(spark):
    codes = {"Robert": "R163", "Rupert": "R163", "Smith": "S530", "Smyth": "S530", "Bobob": "B000", "Tymczak": "T520", "": "", "A": "A000"}
    df = spark.createDataFrame([(w,) for w in codes], "w string").select("w", text.soundex(F.col("w")).alias("c"))
    assert {r.w: r.c for r in df.collect()} == codes
    pair = spark.createDataFrame([("John Smith", "Jon Smyth"), ("", ""), ("a", "A")], "a string, b string")
    got = pair.select(text.edit_similarity(F.col("a"), F.col("b")), text.phonetic_match(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(0.8, 0.5), (1.0, 0.0), (1.0, 0.0)]


def test_scores(spark, now):
    row = spark.range(1).select(
        scores.recency(now, F.lit(NOW - dt.timedelta(days=30)).cast("timestamp")).alias("a"), scores.recency(now, F.lit(None).cast("timestamp")).alias("b"), scores.floor_days(now, F.lit(NOW + dt.timedelta(hours=1)).cast("timestamp")).alias("c"),
        scores.decayed_confidence(now, F.lit(NOW - dt.timedelta(days=120)).cast("timestamp"), F.lit("location"), F.lit(2)).alias("d"), scores.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(-1.0), F.lit(0.0))).alias("e"),
    ).first()
    assert round(row.a, 6) == 0.367879 and row.b == 0.5 and row.c == -1 and round(row.d, 6) == 0.6 and row.e == 0.0


def test_search_treats_wildcards_as_text(make, spark, rows):
    known = make("entities", entity("1", "NATION_7"), entity("2", "NATIONX7"), entity("3", "Ab"))
    surfaces = graph.surfaces(known, make("entity_aliases", {"id": "a", "entity_id": "3", "alias": "Long 100% name"}))
    probes = spark.createDataFrame([("nation_",), ("%",), ("B",), ("zzz",), (None,), ("",)], "probe string")
    assert rows(graph.substring_matches(probes, surfaces)) == [("%", "3"), ("", "1"), ("", "2"), ("", "3"), ("B", "3"), ("nation_", "1")]
    assert rows(graph.exact_matches(spark.createDataFrame([("ab",), ("Ab",)], "probe string"), surfaces)) == [("Ab", "3")]


def test_versions_and_snapshots(make, rows):
    props = make("properties", version("v1", "e", "title", '"Manager"', "2025-01-01"), version("v2", "e", "title", '"Director"', "2025-06-01"), version("v3", "e", "title", '"VP"', "2026-01-01"))
    assert rows(facts.supersession(props), "id", "next_id") == [("v1", "v2"), ("v2", "v3"), ("v3", None)]
    at = lambda s: F.lit(ts(s)).cast("timestamp")
    assert rows(graph.as_known_at(props, at("2025-07-01")), "id") == [("v2",)] and graph.as_known_at(props, at("2020-01-01")).count() == 0
    assert rows(graph.as_known_at(props, at("2027-01-01")), "id") == rows(graph.latest(props), "id")
    assert rows(graph.snapshot(make("entities", entity("e", "E", archived=True)), props, at("2020-01-01")), "entity_id", "key") == [("e", None)]


def test_neighbors(make, rows):
    known = make("entities", *(entity(c, c) for c in "ABCD"), entity("X", "X", archived=True), entity("Y", "Y"))
    links = make("relationships", edge("1", "A", "B"), edge("2", "C", "B"), edge("3", "C", "D"), edge("4", "A", "X"), edge("5", "X", "Y"), edge("6", "A", "A"))
    start = known.where("id = 'A'")
    reach = lambda h: rows(graph.neighbors(start, known, links, h), "entity_id")
    assert reach(0) == reach(1) == [("B",)] and reach(2) == [("B",), ("C",), ("Y",)] and reach(3) == [("B",), ("C",), ("D",), ("Y",)]
    assert rows(graph.induced_subgraph(start, known, links, 2), "relationship_id") == [("1",), ("2",), ("6",)]
    assert dict(rows(graph.degree_centrality(known, links), "entity_id", "n_edges"))["A"] == 3


def test_registered_reads_start_from_entities_of_every_type(make, spark, rows, tmp_path):
    from chronoweave.plans import graph as plans
    from chronoweave.plans import retrieval

    kinds = {"p": "person", "o": "organization", "e": "event"}
    tables = {
        "entities": make("entities", *(entity(i, f"Zork{i}", type=kind) for i, kind in kinds.items())),
        "entity_aliases": make("entity_aliases"),
        "relationships": make("relationships", edge("1", "p", "o"), edge("2", "o", "e")),
        "properties": make("properties", *(version(f"v{n}", "p", f"key{n:03}", '"a rather long value of a property"') for n in range(60))),
    }
    for name, table in tables.items():
        table.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    base = str(tmp_path)
    assert rows(plans.neighbors_1_hop(spark, base), "start_id", "entity_id") == [("e", "o"), ("o", "e"), ("o", "p"), ("p", "o")]
    assert {r.start_id for r in plans.induced_subgraph(spark, base).collect()} == set(kinds)
    assert rows(retrieval.recall_identify(spark, base), "query_id", "entity_id") == [(c, c) for c in "eop"]
    spent = {r.query_id: r.cost for r in retrieval.recall_budgeted(spark, base).groupBy("query_id").agg(F.sum("cost").alias("cost")).collect()}
    assert set(spent) == set(kinds) and 200 < spent["p"] <= 2000


def test_conflict_classes(make, rows):
    refs = make("source_refs", {"id": "strong", "authority": 0.9}, {"id": "weak", "authority": 0.5})
    props = make(
        "properties", version("1", "e", "k", '"Seattle"', "2025-01-01"), version("2", "e", "k", '" seattle"', "2025-02-01", source_ref_id="weak"), version("3", "e", "k", '"Austin"', "2025-03-01", source_ref_id="strong"),
        version("4", "e", "k", '"Rome"', "2025-04-01", as_of=ts("2020-01-01")), version("5", "e", "k", '"Oslo"', "2025-05-01", source_ref_id="weak"),
    )
    assert [r[0] for r in sorted(rows(facts.classify(props, refs), "conflict_type", "id"), key=lambda r: r[1])] == ["confirmation", "confirmation", "update", "historical", "contradiction"]
    found = facts.conflicts(props, refs)
    assert rows(found, "value_a_id", "value_b_id") == [("4", "5")]
    done = facts.resolve_conflicts(found, found.select("id", F.lit("Oslo").alias("resolution")), F.lit(NOW).cast("timestamp"))
    assert rows(done, "status", "resolution") == [("resolved", "Oslo")]


def test_late_versions_do_not_supersede(make, rows):
    held = make("properties", version("1", "e", "k", '"A"', "2025-05-01"))
    late = make("properties", version("2", "e", "k", '"old"', "2025-06-01", as_of=ts("2020-01-01")), version("3", "f", "k", '"new"', "2025-06-01"))
    assert rows(facts.append_versions(held, late), "id", "superseded_by_id") == [("1", None), ("2", "1"), ("3", None)]
    newer = make("properties", version("4", "e", "k", '"B"', "2025-07-01"))
    assert rows(facts.append_versions(held, newer), "id", "superseded_by_id") == [("1", "4"), ("4", None)]


def test_consolidation(make, rows, now):
    known = make("entities", entity("e", "E", confidence=0.1, last_seen=ts("2025-01-01")), entity("f", "F", confidence=0.1, last_seen=ts("2025-01-01")), entity("g", "G", confidence=0.1, last_seen=ts("2026-03-20")))
    links = make("relationships", edge("1", "x", "f"))
    assert rows(consolidation.orphans(known, links, now), "id") == [("e",)]
    props = make("properties", version("1", "f", "location", '"Seattle"', "2026-01-01", confidence=0.8), version("2", "f", "location", '"SEATTLE "', "2026-02-01", confidence=0.8), version("3", "f", "location", '"Rome"', "2025-04-01", confidence=0.9))
    merged = {r.id: (r.superseded_by_id, round(r.confidence, 3)) for r in consolidation.merge_redundant(props, known).collect()}
    assert merged == {"1": ("2", 0.8), "2": (None, 0.9), "3": (None, 0.9)}
    once = consolidation.decay_confidence(props, now).select(*props.columns)
    assert dict(rows(once, "id", "confidence"))["3"] < 0.9
    assert rows(consolidation.decay_confidence(once, now).where("decayed"), "id") == []
    a, b = make("properties", version("a", "f", "k", "1", confidence=0.1), version("b", "f", "k", "2", confidence=0.9)), None
    conflict = make("conflicts", {"id": "c", "entity_id": "f", "value_a_id": "a", "value_b_id": "b", "status": "unresolved"}, {"id": "d", "value_a_id": "a", "value_b_id": "gone", "status": "unresolved"})
    got = rows(consolidation.resolve_contradictions(conflict, a, now), "id", "status", "resolution")
    assert got == [("c", "auto_resolved", "Value A decayed to 0.10"), ("d", "unresolved", None)] and b is None


def test_merge_and_split(make, rows, now):
    known = make("entities", entity("A", "John Smith", access_count=5), entity("B", "J. Smith", access_count=3, last_seen=ts("2025-09-01")), entity("acme", "Acme"))
    names = make("entity_aliases", {"id": "1", "entity_id": "A", "alias": "John"}, {"id": "2", "entity_id": "B", "alias": "JS"})
    links = make("relationships", edge("1", "A", "acme", confidence=0.8), edge("2", "B", "acme", confidence=0.9), edge("3", "A", "B"), edge("4", "B", "x"))
    props = make("properties", version("1", "A", "title", '"Director"'), version("2", "B", "title", '"VP"'), version("3", "B", "location", '"Austin"'))
    pairs = known.sparkSession.createDataFrame([("B", "A")], "absorbed_id string, survivor_id string")
    done = merging.merge(known, names, props, links, pairs, now)
    assert rows(done.relationships, "id", "source_id", "confidence") == [("1", "A", 0.9), ("4", "A", 1.0)]
    assert rows(done.aliases, "entity_id", "alias") == [("A", "J. Smith"), ("A", "JS"), ("A", "John"), ("B", "JS")]
    assert rows(done.properties, "id", "entity_id", "superseded_by_id") == [("1", "A", None), ("2", "A", "1"), ("3", "A", None)]
    assert rows(done.entities, "id", "access_count", "archived", "merged_into") == [("A", 8, False, None), ("B", 3, True, "A"), ("acme", 0, False, None)]
    back = merging.split(done)
    for name, table in {"entities": known, "aliases": names, "properties": props, "relationships": links}.items():
        assert rows(back[name].select(*table.columns)) == rows(table)


def test_merge_chains_reach_the_last_survivor(make, rows, now):
    chain = [entity(f"n{i:02}", f"N{i}", merged_into=f"n{i + 1:02}" if i < 11 else None) for i in range(12)]
    circle = [entity("r", "R", merged_into="q"), entity("q", "Q", merged_into="p"), entity("p", "P", merged_into="r"), entity("t", "T", merged_into="s"), entity("s", "S", merged_into="q")]
    loose = [entity("d", "D", merged_into="gone"), entity("c", "C", merged_into="d"), entity("x", "X", merged_into="x"), entity("y", "Y")]
    known = make("entities", *chain, *circle, *loose)
    pairs = merging.merge_pairs(known)
    assert rows(pairs) == sorted([(f"n{i:02}", "n11") for i in range(11)] + [(c, "p") for c in "qrst"] + [("c", "d")])
    assert rows(merging.merge_pairs(make("entities", entity("y", "Y")))) == []
    names = make("entity_aliases", {"id": "1", "entity_id": "n00", "alias": "first"})
    links = make("relationships", edge("1", "n00", "y"), edge("2", "t", "n05"))
    props = make("properties", version("1", "n03", "title", '"VP"'))
    done = merging.merge(known, names, props, links, pairs, now)
    assert ("n11", "first") in rows(done.aliases, "entity_id", "alias") and ("n11", "N0") in rows(done.aliases, "entity_id", "alias")
    assert rows(done.relationships, "id", "source_id", "target_id") == [("1", "n11", "y"), ("2", "p", "n11")]
    assert rows(done.properties, "id", "entity_id") == [("1", "n11")]
    assert {r.id: r.merged_into for r in done.entities.collect() if r.id in "pqdx"} == {"p": None, "q": "p", "d": "gone", "x": "x"}
    back = merging.split(done)
    for name, table in {"entities": known, "aliases": names, "properties": props, "relationships": links}.items():
        assert rows(back[name].select(*table.columns)) == rows(table)


def test_resolution(make, spark, rows, now):
    known = make("entities", entity("1", "John Smith"), entity("2", "John's Pizza", type="organization"), entity("3", "Robert Brown"))
    names = make("entity_aliases", {"id": "a", "entity_id": "3", "alias": "Bob Brown"})
    mentions = spark.createDataFrame([("m1", "Jon Smith", "person"), ("m2", "John's Pizza", "person"), ("m3", "bob brown", "person"), ("m4", "Alice Green", "person")], "mention_id string, name string, type string")
    pairs = resolution.candidates(mentions, graph.surfaces(known, names))
    signals = resolution.signals(mentions, pairs, known, names)
    got = {r.mention_id: (r.action, r.entity_id) for r in resolution.decide(mentions, resolution.tier1_scores(signals)).collect()}
    assert got["m3"] == ("merge", "3") and got["m2"] == got["m4"] == ("create", None)
    two = resolution.tier2_scores(signals, known, make("relationships", edge("1", "1", "2")), now, lambda a, b: F.lit(1.0))
    told = {r.mention_id: r.action for r in resolution.decide(mentions, two, lambda a, b: F.lit(True)).collect()}
    assert told["m1"] == "merge" and told["m2"] == "create"


def test_privacy(make, rows):
    known = make("entities", entity("j", "John"), entity("a", "Acme", type="organization"))
    refs = make("source_refs", {"id": "shared"}, {"id": "own"})
    props = make("properties", version("1", "j", "k", "1", source_ref_id="shared"), version("2", "j", "l", "1", source_ref_id="own"), version("3", "a", "k", "1", source_ref_id="shared"))
    tables = {"entities": known, "entity_aliases": make("entity_aliases"), "properties": props, "relationships": make("relationships", edge("1", "j", "a"), edge("2", "j", "j")), "source_refs": refs}
    log = make("access_log", {"id": "1", "entity_id": "j"})
    john = known.where("id = 'j'")
    counts = rows(privacy.deletion_counts(john, tables["entity_aliases"], props, tables["relationships"], log), "properties", "relationships", "source_refs", "access_log")
    assert counts == [(2, 2, 1, 1)]
    left = privacy.hard_delete(john, tables)
    assert rows(left["source_refs"], "id") == [("shared",)] and rows(left["properties"], "id") == [("3",)] and left["relationships"].count() == 0
    one = privacy.export_json(john, tables["entity_aliases"], props, tables["relationships"]).first()
    assert len(one.content_hash) == 64 and '"relationships"' in one.content


def test_text_search(spark, rows):
    chunks = spark.createDataFrame([("1", "The Café Corner opened"), ("2", "corner cafe corner"), ("3", "cafe at the corner; cafe corner"), ("4", None), ("5", "")], "chunk_id string, text string")
    asked = spark.createDataFrame([("q", "cafe corner"), ("none", "opened cafe"), ("empty", " ")], "query_id string, text string")
    assert rows(search.phrase_frequencies(asked, search.tokenized(chunks)), "query_id", "chunk_id", "frequency") == [("q", "1", 1), ("q", "2", 1), ("q", "3", 1)]
    assert [r.rank for r in search.bm25_phrase(asked, chunks, 2).collect()] == [0, 1]
    assert {r.chunk_id for r in search.bm25_terms(asked, chunks).where("query_id = 'none'").collect()} == {"1", "2", "3"}


def test_vector_search_keeps_ties_in_order(spark, rows):
    vectors = spark.createDataFrame([(f"{i:02}", [float(i % 3), 1.0]) for i in range(30)] + [("null", None)], "chunk_id string, embedding array<float>")
    found = search.vector_top_k(vectors.where("chunk_id = '00'").withColumnRenamed("chunk_id", "query_id"), vectors, 3)
    assert rows(found, "chunk_id", "distance", "rank") == [("00", 0.0, 0), ("03", 0.0, 1), ("06", 0.0, 2)]
    fused = search.fuse(found, found.withColumn("chunk_id", F.lit("03")).where("rank = 0"))
    assert fused.orderBy("rank").first().chunk_id == "03"


def test_recall(make, spark, now):
    known = make("entities", entity("j", "John Smith"), entity("a", "Acme Corp", type="organization"), entity("z", "Zed"))
    props = make("properties", version("1", "j", "title", '"Director of Sales"', "2026-03-01"), version("2", "a", "industry", '"Paper"', "2026-03-01"), version("3", "j", "rumor", '"moving"', "2026-03-01", confidence=0.3))
    links = make("relationships", edge("1", "j", "a", "works_at", confidence=0.95, valid_from=ts("2026-03-01")))
    asked = spark.createDataFrame([("q1", "what about john"), ("q2", "nothing here")], "query_id string, text string")
    got = {r.query_id: r.text for r in recall.recall(asked, known, make("entity_aliases"), props, links, now).collect()}
    assert got["q2"] == recall.NOTHING
    for part in ("## John Smith (person)", "- title: Director of Sales", "→ [works_at] Acme Corp", "- rumor: moving *(unconfirmed)*", "- industry: Paper"):
        assert part in got["q1"]
    small = recall.recall(asked, known, make("entity_aliases"), props, links, now, budget=12).where("query_id = 'q1'").first()
    assert small.text.count("\n- ") == 1
    past = recall.recall(asked, known, make("entity_aliases"), props, links, now, as_of=F.lit(ts("2025-06-01")).cast("timestamp"), strict_as_of=True).where("query_id = 'q1'").first()
    assert "Director" not in past.text and "works_at" not in past.text


def test_extraction(spark, rows):
    answers = {
        "plain": '[{"name": " Ann ", "type": "Person", "properties": {"a": "1", "b": "", "c": null}}]', "fenced": '```json\n[{"name": "Bo", "type": "robot"}]\n```', "around": 'Sure: [{"name": "Cy", "type": "event"}] ok', "empty": "[]", "invalid": "no", "blank": "", "nameless": '[{"type": "person"}]',
    }
    df = spark.createDataFrame(list(answers.items()), "answer_id string, answer string")
    read = extraction.parse_entities(df)
    assert rows(read, "answer_id", "name", "type") == [("around", "Cy", "event"), ("fenced", "Bo", "concept"), ("plain", "Ann", "person")]
    assert read.where("answer_id = 'plain'").first().properties == {"a": "1"}
    told = spark.createDataFrame([("plain", '[{"source": "ann b", "target": "Acme", "type": "Works At"}, {"source": "", "target": "x", "type": "y"}]')], "answer_id string, answer string")
    assert rows(extraction.parse_relations(told, read), "source", "target", "type") == [("Ann", "Acme", "works_at")]


def test_scratchpad(spark, rows, tmp_path):
    said = [("s", 1, "I met John Smith today"), ("s", 2, "He mentioned a new project at Acme Corp"), ("s", 3, "John Smith is excited and so is she"), ("t", 1, "they left")]
    turns = spark.createDataFrame(said, "session string, turn int, text string")
    found = scratchpad.mentions(turns)
    ids = dict(rows(found.where("text in ('John Smith', 'He', 'she')"), "text", "tentative_id"))
    assert len(set(ids.values())) == 1 and set(ids) == {"John Smith", "He", "she"}
    assert rows(scratchpad.unique_entities(found), "best_name", "type_hint") == [("Acme Corp", "organization"), ("John Smith", "person")]
    turns.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = scratchpad.mention_stream(spark.readStream.schema(turns.schema).parquet(f"{tmp_path}/in"))
    job = stream.writeStream.format("memory").queryName("live_mentions").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    try:
        assert job.awaitTermination(120)
    finally:
        job.stop()
    assert rows(spark.table("live_mentions"), "session", "text", "turn", "tentative_id") == rows(found, "session", "text", "turn", "tentative_id")
    ran = []
    step = scratchpad.maintenance(lambda: ran.append("quick"), lambda: ran.append("full"), 2, 4)
    for batch in range(4):
        step(turns, batch)
    assert ran == ["quick", "full"]


def test_evaluation(spark, rows):
    judged = spark.createDataFrame([("a", True), ("a", False), ("b", True)], "c string, ok boolean")
    assert {r.category: round(r.accuracy, 3) for r in evaluation.accuracy(judged, "c", "ok").collect()} == {"a": 0.5, "b": 1.0, "overall": 0.667, "task_average": 0.75}
    values = spark.createDataFrame([("g", float(v)) for v in [5, 1, 4, 2, 3, 3]], "g string, v double")
    row = evaluation.nearest_rank(values, "g", "v").first()
    assert (row.p50, row.p95, row.n, row.least, row.most) == (sorted([5, 1, 4, 2, 3, 3])[round(0.5 * 5)], 5.0, 6, 1.0, 5.0)
    assert rows(evaluation.prefix_within_budget(spark.createDataFrame([("g", 1, "abcd"), ("g", 2, "abcde"), ("g", 3, "")], "g string, n int, t string"), "g", ["n"], "t", 1), "n") == [(1,)]
    picked = evaluation.stratified_sample(spark.range(100).withColumn("c", F.col("id") % 3), "c", "id", 4)
    assert picked.count() == 12 and rows(picked) == rows(evaluation.stratified_sample(spark.range(100).withColumn("c", F.col("id") % 3), "c", "id", 4))


def test_constraints(make, rows):
    bad = schema.constraint_violations(
        make("entities", entity("1", "x", type="invalid_type")), make("entity_aliases"), make("source_refs", {"id": "r", "statement_type": "guess"}), make("properties", version("p", "nobody", "k", "1")), make("relationships", edge("e", "1", "gone"))
    )
    assert rows(bad) == [("entities", "type_value", "1"), ("properties", "entity_id_reference", "p"), ("relationships", "target_id_reference", "e"), ("source_refs", "statement_type_value", "r")]
