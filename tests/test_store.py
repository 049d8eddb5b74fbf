"""The snapshot store end to end, the registered queries, and the independence of the core."""

import ast
import datetime as dt
import json
import pathlib

import pytest
from pyspark.sql import functions as F

from chronoweave.operators import extraction
from chronoweave.sources import tables
from chronoweave.store import MemoryStore, Settings

ROOT = pathlib.Path(__file__).resolve().parents[1]
ANSWER = json.dumps(
    [{"name": "John Smith", "type": "person", "properties": {"title": "Director"}}, {"name": "Acme Corp", "type": "organization"}, {"source": "John Smith", "target": "Acme Corp", "type": "works at"}]
)


def test_store(spark, tmp_path, rows):
    store = MemoryStore(spark, f"file://{tmp_path}/store", Settings(client=extraction.canned_client({"John": ANSWER})))
    said = spark.createDataFrame([("c1", 0, "John is at Acme", "user"), ("c1", 1, "noted", "assistant")], "conversation_id string, turn_number int, text string, participant string")
    first = store.ingest(said, dt.datetime(2025, 1, 1))
    assert first == {"entities_created": 2, "entities_merged": 0, "properties": 1, "conflicts": 0}
    again = store.ingest(said.limit(1), dt.datetime(2025, 2, 1))
    assert again["entities_created"] == 0 and again["entities_merged"] == 2
    assert store.table("relationships").count() == 1 and store.table("verbatim_chunks").count() == 3
    people = {r.name: r for r in store.entity_list().collect()}
    john = people["John Smith"]
    assert json.loads(john.properties["title"]) == "Director"
    store.correct(john.id, "title", "VP", "typo", dt.datetime(2025, 3, 1))
    assert json.loads({r.name: r for r in store.entity_list("person").collect()}["John Smith"].properties["title"]) == "VP"
    past = store.snapshot(dt.datetime(2025, 2, 15)).where(F.col("entity_id") == john.id)
    assert rows(past, "key", "value_json") == [("title", '"Director"')]
    assert [r.value_json for r in store.audit_belief(john.id, "title").collect()][0] == '"VP"'
    asked = spark.createDataFrame([("q", "tell me about john")], "query_id string, text string")
    assert "[works_at] Acme Corp" in store.recall(asked, now=dt.datetime(2025, 3, 2)).first().text
    assert store.health().first().node_count == 2 and store.conflicts().count() == 0
    pairs = spark.createDataFrame([(people["Acme Corp"].id, john.id)], "absorbed_id string, survivor_id string")
    before = rows(store.table("entities"))
    merged = store.merge(pairs, "test")
    assert store.health().first().node_count == 1 and store.table("merge_log").count() == 1
    store.undo_merge(merged)
    assert rows(store.table("entities")) == before and store.table("merge_log").count() == 0
    receipt = store.hard_delete(spark.createDataFrame([(john.id,)], "id string")).first()
    assert len(receipt.content_hash) == 64 and store.table("entities").where(F.col("id") == john.id).count() == 0
    assert store.table("deletion_audit_log").count() == 1 and store.table("relationships").count() == 0
    store.forget(entity_id=people["Acme Corp"].id)
    assert store.entity_list().count() == 0


def test_plain_writes_and_undo_from_the_log(spark, tmp_path, rows):
    path = f"file://{tmp_path}/store"
    store = MemoryStore(spark, path, Settings.from_environment({"CHRONOWEAVE_TOKEN_BUDGET": "300", "CHRONOWEAVE_HIGH": ""}))
    assert store.settings.token_budget == 300 and store.settings.high == Settings().high
    new = spark.createDataFrame([("Ada", "person", ["A.", "A."]), ("Ada", "person", []), ("Bo", "person", [])], "name string, type string, aliases array<string>")
    made = sorted(store.create_entities(new, dt.datetime(2025, 1, 1, 0, 0, 0, 123456)).collect(), key=lambda r: (r.name, r.id))
    assert store.table("entities").count() == 3 and store.table("entity_aliases").count() == 1
    one, two, bo = (r.id for r in made)
    edge = spark.createDataFrame([(one, bo, "knows"), (one, bo, "knows"), (two, bo, "knows"), (two, one, "knows")], "source_id string, target_id string, type string")
    store.create_relationships(edge, dt.datetime(2025, 1, 2))
    assert store.table("relationships").count() == 4
    refs = spark.createDataFrame([("s1", "c", 1, None, "explicit", "x", 1.0), ("s1", "c", 1, None, "explicit", "x", 1.0)], store.table("source_refs").schema)
    store.upsert_source_refs(refs)
    store.upsert_source_refs(refs.withColumn("verbatim", F.lit("other")))
    assert rows(store.table("source_refs"), "id", "verbatim") == [("s1", "x")]
    texts = spark.createDataFrame([("c", 1, "Ada sells bicycles", "user")], "conversation_id string, turn_number int, text string, participant string")
    store.store_text(texts)
    store.store_text(texts, embed=False)
    assert rows(store.table("verbatim_chunks").select(F.col("embedding").isNull())) == [(False,), (True,)]
    asked = spark.createDataFrame([("q", "bicycles")], "query_id string, text string")
    assert "Ada sells bicycles" in store.recall(asked).first().text
    store.set_properties(spark.createDataFrame([(one, "k", "1", None), (two, "k", "2", None)], "entity_id string, key string, value_json string, source_ref_id string").withColumn("as_of", F.lit(dt.datetime(2025, 1, 1))).withColumn("recorded_at", F.lit(dt.datetime(2025, 1, 1))).withColumn("confidence", F.lit(1.0)))
    names = ("entities", "entity_aliases", "properties", "relationships")
    was = {name: rows(store.table(name)) for name in names}
    store.merge(spark.createDataFrame([(two, one)], "absorbed_id string, survivor_id string"), "same", dt.datetime(2025, 2, 1))
    middle = {name: rows(store.table(name)) for name in names}
    store.merge(spark.createDataFrame([(bo, one)], "absorbed_id string, survivor_id string"), "wrong", dt.datetime(2025, 3, 1))
    # as after a restart: another store object, only the log
    store = MemoryStore(spark, path)
    log = {r.absorbed_id: r.id for r in store.table("merge_log").collect()}
    with pytest.raises(ValueError):
        store.undo_logged([log[two]])
    store.undo_logged([log[bo]])
    assert {name: rows(store.table(name)) for name in names} == middle and store.table("merge_log").count() == 1
    store.undo_logged([log[two]])
    assert {name: rows(store.table(name)) for name in names} == was and store.table("merge_log").count() == 0


def test_evaluation_extras(spark, rows):
    from chronoweave.operators import evaluation

    q = spark.createDataFrame([("1", ["a", "b"]), ("2", ["a", "b"])], "id string, sessions array<string>")
    assert evaluation.shared_haystack(q, "sessions").first().shared and not evaluation.shared_haystack(q.limit(1), "sessions").first().shared
    assert not evaluation.shared_haystack(q.unionByName(spark.createDataFrame([("3", None)], q.schema)), "sessions").first().shared
    moved = spark.createDataFrame([("x", 1, "a"), ("x", 3, "b"), ("x", 5, "c"), ("y", 9, "d")], "who string, month int, value string").withColumn("asked", F.lit(4))
    assert rows(evaluation.value_as_of_month(moved, ["who"], "month", "value", "asked")) == [("x", "b")]
    none = spark.createDataFrame([], "failure string")
    assert rows(evaluation.failure_counts(none)) == [("ANSWER_ERROR", 0, 0.0), ("JUDGE_DISAGREEMENT", 0, 0.0), ("RETRIEVAL_MISS", 0, 0.0)]
    from chronoweave.schema import one_record

    twice = spark.createDataFrame([("i", 1, "z"), ("i", 2, "a"), ("i", 2, None)], "id string, n int, t string")
    assert rows(one_record(twice, ("n",))) == [("i", 2, "a")] and rows(one_record(twice.select("id", "t", "n"))) == [("i", "z", 1)]


def test_sinks(spark, tmp_path, rows):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n long")
    tables.append_json(df, f"{tmp_path}/j")
    tables.append_json(df.where("n = 2"), f"{tmp_path}/j")
    assert rows(tables.read_json(spark, f"{tmp_path}/j", df.schema, multi_line=False)) == [("a", 1), ("b", 2), ("b", 2)]
    assert rows(tables.remaining(df, df.where("n = 1"), "id")) == [("b", 2)]
    tables.write_parquet(df, f"{tmp_path}/p", "n")
    assert spark.read.parquet(f"{tmp_path}/p").count() == 2


def test_checkpoints_go_to_the_folder_the_session_names(spark, tmp_path):
    shared = spark.conf.get("spark.checkpoint.dir", None)
    assert tables.cut(spark.range(3)).count() == 3
    assert shared is None or shared.removeprefix("file:") in spark.sparkContext._jsc.sc().getCheckpointDir().get()


def test_the_core_does_not_need_the_training_data_package():
    for path in (ROOT / "chronoweave").rglob("*.py"):
        if "llm" in path.relative_to(ROOT / "chronoweave").parts:
            continue
        for node in ast.walk(ast.parse(path.read_text(encoding="utf-8"))):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in name.split(".") for name in names), path


@pytest.mark.skipif(not pathlib.Path("/root/testdata/sf0.001").exists(), reason="needs the driver's tables")
def test_registered_queries():
    import __spark_entry__

    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 60
    assert {"p1_found", "p4_found", "p7_found"} <= set(queries)


@pytest.mark.skipif(not pathlib.Path("/root/testdata/sf0.001").exists(), reason="needs the driver's tables")
def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
