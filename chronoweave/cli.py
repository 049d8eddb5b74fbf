"""Command line over a memory store: python -m chronoweave.cli STORE COMMAND ..."""

from __future__ import annotations

import argparse
import datetime as dt

from pyspark.sql import SparkSession

from chronoweave.store import MemoryStore


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="chronoweave")
    parser.add_argument("store")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("entities").add_argument("--type")
    commands.add_parser("entity").add_argument("id")
    history = commands.add_parser("history")
    history.add_argument("id")
    history.add_argument("key")
    commands.add_parser("snapshot").add_argument("--as-of", required=True, type=dt.datetime.fromisoformat)
    merge = commands.add_parser("merge")
    merge.add_argument("absorbed")
    merge.add_argument("survivor")
    commands.add_parser("merges")
    commands.add_parser("undo-merge").add_argument("log_id", nargs="+")
    commands.add_parser("stats")
    commands.add_parser("conflicts")
    commands.add_parser("consolidate").add_argument("--quick", action="store_true")
    commands.add_parser("export").add_argument("id")
    audit = commands.add_parser("audit")
    audit.add_argument("id")
    audit.add_argument("key")
    delete = commands.add_parser("delete")
    delete.add_argument("id")
    delete.add_argument("--hard", action="store_true")
    ask = commands.add_parser("recall")
    ask.add_argument("text")
    ask.add_argument("--as-of", type=dt.datetime.fromisoformat)
    a = parser.parse_args(arguments)
    spark = spark or SparkSession.builder.appName("chronoweave").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    store = MemoryStore(spark, a.store)
    one = lambda value: spark.createDataFrame([(value,)], "id string")
    if a.command == "entities":
        store.entity_list(a.type).show(200, False)
    elif a.command == "entity":
        store.recall_entity(a.id, 1).show(200, False)
    elif a.command in ("history", "audit"):
        store.audit_belief(a.id, a.key).show(200, False)
    elif a.command == "snapshot":
        store.snapshot(a.as_of).show(200, False)
    elif a.command == "merge":
        store.merge(spark.createDataFrame([(a.absorbed, a.survivor)], "absorbed_id string, survivor_id string"))
    elif a.command == "merges":
        store.table("merge_log").drop("undo_data").show(200, False)
    elif a.command == "undo-merge":
        store.undo_logged(a.log_id)
    elif a.command == "stats":
        store.health().show()
    elif a.command == "conflicts":
        store.conflicts().show(200, False)
    elif a.command == "consolidate":
        store.consolidate(full=not a.quick)
    elif a.command == "export":
        store.export_entity_data(one(a.id)).show(1, False)
    elif a.command == "delete":
        if a.hard:
            store.hard_delete(one(a.id)).show(1, False)
        else:
            store.forget(entity_id=a.id)
    elif a.command == "recall":
        store.recall(spark.createDataFrame([("q", a.text)], "query_id string, text string"), as_of=a.as_of).show(1, False)


if __name__ == "__main__":
    main()
