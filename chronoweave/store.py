"""A graph memory kept as parquet snapshots: one folder a version, and a pointer that is swapped when a version is complete.

Each call maps the current tables to new ones and writes them as the next version, so a reader never sees half a
change, and a failed call leaves the pointer where it was. Only tables that changed are written; the others are
taken over by reference.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave import schema
from chronoweave.operators import consolidation, extraction, facts, graph, merging, privacy, recall, resolution, search
from chronoweave.sources.tables import cut


@dataclass
class Settings:
    """Thresholds and budgets, with their usual values."""

    high: float = resolution.HIGH
    low: float = resolution.LOW
    token_budget: int = 2000
    quick_every: int = consolidation.QUICK_EVERY
    full_every: int = consolidation.FULL_EVERY
    client: Callable[[], Callable[[str], str]] = field(default_factory=lambda: extraction.canned_client({}))

    @classmethod
    def from_environment(cls, environment: dict[str, str] | None = None, prefix: str = "CHRONOWEAVE_") -> Settings:
        """The usual values, overridden by variables such as CHRONOWEAVE_TOKEN_BUDGET; unset and empty ones say nothing."""
        found = os.environ if environment is None else environment
        kinds = {"high": float, "low": float, "token_budget": int, "quick_every": int, "full_every": int}
        return cls(**{name: kind(found[prefix + name.upper()]) for name, kind in kinds.items() if found.get(prefix + name.upper())})


def _id() -> Column:
    return F.expr("uuid()")


class MemoryStore:
    """The graph and its operations for one folder."""

    def __init__(self, spark: SparkSession, path: str, settings: Settings | None = None):
        self.spark, self.path, self.settings = spark, path.rstrip("/"), settings or Settings()
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._path = hadoop.Path
        if self._pointer() is None:
            self._commit({name: spark.createDataFrame([], struct) for name, struct in schema.TABLES.items()})

    # snapshots

    def _pointer(self) -> dict | None:
        """The highest complete version: its number and the folder of each table."""
        root = self._path(f"{self.path}/versions")
        if not self._fs.exists(root):
            return None
        names = sorted(status.getPath().getName() for status in self._fs.listStatus(root) if status.getPath().getName().endswith(".json"))
        if not names:
            return None
        return json.loads("\n".join(row.value for row in self.spark.read.text(f"{self.path}/versions/{names[-1]}").collect()))

    def _commit(self, changed: dict[str, DataFrame]) -> None:
        now = self._pointer() or {"version": 0, "tables": {}}
        version = now["version"] + 1
        tables = dict(now["tables"])
        for name, df in changed.items():
            folder = f"{self.path}/data/{name}/{version:08d}-{uuid.uuid4().hex[:8]}"
            df.write.parquet(folder)
            tables[name] = folder
        target, draft = self._path(f"{self.path}/versions/{version:08d}.json"), self._path(f"{self.path}/versions/.draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft)
        out.write(json.dumps({"version": version, "tables": tables}).encode())
        out.close()
        if not self._fs.rename(draft, target):
            raise RuntimeError(f"version {version} was written by another writer")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self._pointer()["tables"][name])

    def replace(self, **tables: DataFrame) -> None:
        """Write whole tables, shaped as their schema says."""
        self._commit({name: df.select(*(F.col(f.name).cast(f.dataType) for f in schema.TABLES[name])) for name, df in tables.items()})

    def append(self, **tables: DataFrame) -> None:
        self.replace(**{name: self.table(name).unionByName(df.select(*schema.TABLES[name].fieldNames())) for name, df in tables.items()})

    def _now(self, now: dt.datetime | None) -> Column:
        return F.lit(now or dt.datetime.now(dt.UTC).replace(tzinfo=None)).cast("timestamp")

    # writing

    def ingest(self, texts: DataFrame, now: dt.datetime | None = None) -> dict[str, int]:
        """Ingest texts (conversation_id, turn_number, text, participant): keep them, have the client read them, resolve
        entities against the graph, classify and append facts, add edges that are new. Returns counts."""
        moment, s = self._now(now), self.settings
        rows = cut(texts.withColumn("answer_id", _id()))
        ref = rows.select(F.col("answer_id").alias("id"), "conversation_id", "turn_number", moment.alias("timestamp"), F.lit("explicit").alias("statement_type"), F.col("text").alias("verbatim"), F.lit(1.0).alias("authority"))
        chunk = rows.select(F.col("answer_id").alias("id"), "conversation_id", "turn_number", "text", moment.alias("timestamp"), "participant", F.lit("conversation").alias("source_type"), search.hash_embedding(F.col("text")).alias("embedding"))
        answers = cut(extraction.ask_model(rows, s.client))
        read = cut(extraction.parse_entities(answers))
        known, aliases = self.table("entities"), self.table("entity_aliases")
        # mentions of one name and type are one mention
        mentions = cut(read.groupBy(F.lower("name").alias("_n"), "type").agg(F.min("name").alias("name"), F.min("answer_id").alias("answer_id")).select(F.concat_ws("|", "_n", "type").alias("mention_id"), "name", "type"))
        active = known.where("not archived")
        pairs = resolution.candidates(mentions, graph.surfaces(active, aliases))
        decided = cut(resolution.decide(mentions, resolution.tier1_scores(resolution.signals(mentions, pairs, active, aliases))).withColumn("new_id", _id()))
        made = mentions.join(decided.where("action = 'create'"), "mention_id").select(
            F.col("new_id").alias("id"), "type", "name", moment.alias("created_at"), moment.alias("last_seen"), F.lit(0).cast("bigint").alias("access_count"), F.lit(1.0).alias("confidence"), F.lit(False).alias("archived"), F.lit(None).cast("string").alias("merged_into")
        )
        made = cut(made)
        learnt = decided.where("add_alias is not null").select(_id().alias("id"), "entity_id", F.col("add_alias").alias("alias"), moment.alias("added_at"))
        ids = cut(decided.select("mention_id", F.coalesce("entity_id", "new_id").alias("entity_id")))
        named = cut(read.withColumn("mention_id", F.concat_ws("|", F.lower("name"), "type")).join(ids, "mention_id").select("answer_id", "name", "entity_id", "properties"))
        told = named.select("answer_id", "entity_id", F.explode("properties").alias("key", "value"))
        versions = cut(
            told.select(
                _id().alias("id"), "entity_id", "key", F.get_json_object(F.to_json(F.struct(F.array("value").alias("v"))), "$.v").alias("_v"), moment.alias("as_of"), moment.alias("recorded_at"), F.col("answer_id").alias("source_ref_id"), F.lit(1.0).alias("confidence"), F.lit(None).cast("string").alias("superseded_by_id"),
            ).withColumn("value_json", F.regexp_replace("_v", r"^\[|\]$", "")).drop("_v")
        )
        before = self.table("properties")
        said = extraction.parse_relations(answers, read)
        source, target = (named.select("answer_id", F.col("name").alias(end), F.col("entity_id").alias(f"{end}_id")) for end in ("source", "target"))
        edges = said.join(source, ["answer_id", "source"]).join(target, ["answer_id", "target"]).select(
            _id().alias("id"), "source_id", "target_id", "type", moment.alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"), F.col("answer_id").alias("source_ref_id"), F.lit(1.0).alias("confidence"), F.lit(0).cast("bigint").alias("access_count")
        )
        after = cut(facts.append_versions(before, versions.select(*before.columns)))
        refs = self.table("source_refs").unionByName(ref)
        found = cut(facts.conflicts(after, refs).join(versions.select(F.col("id").alias("value_b_id")), "value_b_id", "left_semi"))
        seen = ids.select(F.col("entity_id").alias("id")).distinct().withColumn("_seen", F.lit(True))
        touched = known.join(seen, "id", "left").withColumn("last_seen", F.when(F.col("_seen"), F.greatest("last_seen", moment)).otherwise(F.col("last_seen"))).drop("_seen")
        counts = {"entities_created": made.count(), "entities_merged": decided.where("action = 'merge'").count(), "properties": versions.count(), "conflicts": found.count()}
        self.replace(
            entities=touched.unionByName(made), entity_aliases=aliases.unionByName(learnt), source_refs=refs, verbatim_chunks=self.table("verbatim_chunks").unionByName(chunk),
            properties=after, relationships=graph.add_if_absent(self.table("relationships"), edges), conflicts=self.table("conflicts").unionByName(found.select(*schema.TABLES["conflicts"].fieldNames())),
        )
        return counts

    def create_entities(self, new: DataFrame, now: dt.datetime | None = None) -> DataFrame:
        """Insert entities (name, type, and optionally aliases, confidence); names need not be unique, aliases of one
        entity are. Returns (id, name, type)."""
        moment = self._now(now)
        given = {"aliases": F.array().cast("array<string>"), "confidence": F.lit(1.0)}
        rows = cut(new.select("name", "type", *(F.col(c) if c in new.columns else default.alias(c) for c, default in given.items())).withColumn("id", _id()))
        made = rows.select("id", "type", "name", moment.alias("created_at"), moment.alias("last_seen"), F.lit(0).cast("bigint").alias("access_count"), "confidence", F.lit(False).alias("archived"), F.lit(None).cast("string").alias("merged_into"))
        called = rows.select(F.col("id").alias("entity_id"), F.explode(F.array_distinct("aliases")).alias("alias")).select(_id().alias("id"), "entity_id", "alias", moment.alias("added_at"))
        self.append(entities=made, entity_aliases=called)
        return rows.select("id", "name", "type")

    def create_relationships(self, new: DataFrame, now: dt.datetime | None = None) -> DataFrame:
        """Insert edges (source_id, target_id, type, and optionally valid_from, valid_to, source_ref_id, confidence) as
        they are, without looking for equal ones. Returns (id, source_id, target_id, type)."""
        given = {"valid_from": self._now(now), "valid_to": F.lit(None).cast("timestamp"), "source_ref_id": F.lit(None).cast("string"), "confidence": F.lit(1.0)}
        columns = (F.col(c) if c in new.columns else default.alias(c) for c, default in given.items())
        rows = cut(new.select("source_id", "target_id", "type", *columns).withColumn("id", _id()).withColumn("access_count", F.lit(0).cast("bigint")))
        self.append(relationships=rows)
        return rows.select("id", "source_id", "target_id", "type")

    def upsert_source_refs(self, new: DataFrame) -> None:
        """Insert sources whose id is not there yet; those that are stay as they are."""
        known = self.table("source_refs")
        fresh = schema.one_record(new.select(*schema.TABLES["source_refs"].fieldNames())).join(known.select("id"), "id", "left_anti")
        self.append(source_refs=cut(fresh))

    def store_text(self, texts: DataFrame, embed: bool = True, source_type: str = "conversation", now: dt.datetime | None = None) -> None:
        """Keep texts (conversation_id, turn_number, text, participant) without reading them; without ``embed`` they
        are found by their words only."""
        vector = search.hash_embedding(F.col("text")).cast("array<float>") if embed else F.lit(None).cast("array<float>")
        rows = texts.select(_id().alias("id"), "conversation_id", "turn_number", "text", self._now(now).alias("timestamp"), "participant", F.lit(source_type).alias("source_type"), vector.alias("embedding"))
        self.append(verbatim_chunks=cut(rows))

    def set_properties(self, new: DataFrame) -> None:
        """Append versions (entity_id, key, value_json, as_of, recorded_at, source_ref_id, confidence)."""
        rows = cut(new.withColumn("id", _id()).withColumn("superseded_by_id", F.lit(None).cast("string")))
        self.replace(properties=facts.append_versions(self.table("properties"), rows.select(*schema.TABLES["properties"].fieldNames())))

    def correct(self, entity_id: str, key: str, value: object, reason: str = "", now: dt.datetime | None = None) -> None:
        """State a value as a correction: its source is of type corrected and full authority."""
        moment, ref = self._now(now), str(uuid.uuid4())
        one = self.spark.range(1)
        self.append(source_refs=one.select(F.lit(ref).alias("id"), F.lit("").alias("conversation_id"), F.lit(0).alias("turn_number"), moment.alias("timestamp"), F.lit("corrected").alias("statement_type"), F.lit(reason).alias("verbatim"), F.lit(1.0).alias("authority")))
        self.set_properties(one.select(F.lit(entity_id).alias("entity_id"), F.lit(key).alias("key"), F.lit(json.dumps(value)).alias("value_json"), moment.alias("as_of"), moment.alias("recorded_at"), F.lit(ref).alias("source_ref_id"), F.lit(1.0).alias("confidence")))

    def forget(self, entity_id: str | None = None, relationship_id: str | None = None, now: dt.datetime | None = None) -> None:
        """Archive an entity, or end a relationship now."""
        if entity_id is not None:
            self.replace(entities=self.table("entities").withColumn("archived", F.col("archived") | (F.col("id") == entity_id)))
        if relationship_id is not None:
            ended = F.when(F.col("id") == relationship_id, self._now(now)).otherwise(F.col("valid_to"))
            self.replace(relationships=self.table("relationships").withColumn("valid_to", ended))

    def merge(self, pairs: DataFrame, reason: str = "", now: dt.datetime | None = None) -> merging.Merged:
        """Merge pairs (absorbed_id, survivor_id). The result can be given to ``undo_merge``; the log keeps each pair."""
        moment = self._now(now)
        pairs = cut(pairs.select("absorbed_id", "survivor_id"))
        done = merging.merge(self.table("entities"), self.table("entity_aliases"), self.table("properties"), self.table("relationships"), pairs, moment)
        done.before = {name: cut(df) for name, df in done.before.items()}
        log = merging.pre_images(done.before, pairs).select(_id().alias("id"), "survivor_id", "absorbed_id", moment.alias("timestamp"), F.lit(reason).alias("reason"), "undo_data")
        self.replace(entities=done.entities, entity_aliases=done.aliases, properties=done.properties, relationships=done.relationships, merge_log=self.table("merge_log").unionByName(log))
        return done

    def undo_logged(self, log_ids: list[str]) -> None:
        """Take merges back by the ids of their log rows. A survivor's merges must be taken back from the last on, as
        the pre-image of each is the state before it; so those of one call go together."""
        log = self.table("merge_log")
        chosen = cut(log.where(F.col("id").isin(*log_ids)))
        later = log.join(chosen.groupBy("survivor_id").agg(F.min("timestamp").alias("_first")), "survivor_id").where(F.col("timestamp") >= F.col("_first"))
        if chosen.count() != len(set(log_ids)) or later.join(chosen.select("id"), "id", "left_anti").count():
            raise ValueError("unknown merges, or later ones of the same survivor that are not taken back")
        tables = {"entities": self.table("entities"), "aliases": self.table("entity_aliases"), "properties": self.table("properties"), "relationships": self.table("relationships")}
        before, pairs = merging.from_log(chosen, tables)
        self.undo_merge(merging.Merged(*tables.values(), {name: cut(rows) for name, rows in before.items()}, cut(pairs)))

    def undo_merge(self, done: merging.Merged) -> None:
        now = merging.Merged(self.table("entities"), self.table("entity_aliases"), self.table("properties"), self.table("relationships"), done.before, done.pairs)
        back = merging.split(now)
        kept = self.table("merge_log").join(done.pairs, ["survivor_id", "absorbed_id"], "left_anti")
        self.replace(entities=back["entities"], entity_aliases=back["aliases"], properties=back["properties"], relationships=back["relationships"], merge_log=kept)

    def consolidate(self, full: bool = True, now: dt.datetime | None = None) -> None:
        moment = self._now(now)
        if full:
            self.replace(**consolidation.run_full(self.table("entities"), self.table("properties"), self.table("relationships"), self.table("conflicts"), moment))
        else:
            self.replace(**consolidation.run_quick(self.table("entities"), self.table("properties"), moment))

    def hard_delete(self, targets: DataFrame, now: dt.datetime | None = None) -> DataFrame:
        """Delete entities (id) and all that is about them; returns the receipts. The access log stays."""
        moment = self._now(now)
        targets = cut(self.table("entities").join(targets.select("id"), "id", "left_semi"))
        content = privacy.export_json(targets, self.table("entity_aliases"), self.table("properties"), self.table("relationships"))
        counts = privacy.deletion_counts(targets, self.table("entity_aliases"), self.table("properties"), self.table("relationships"), self.table("access_log"))
        items = F.to_json(F.struct("properties", "relationships", "aliases", "source_refs", "access_log"))
        receipts = cut(
            targets.select(F.col("id").alias("entity_id"), F.col("name").alias("entity_name")).join(content, "entity_id").join(counts, "entity_id").select(
                _id().alias("id"), "entity_id", "entity_name", moment.alias("deleted_at"), "content_hash", F.col("access_log").alias("access_log_count"), items.alias("items_deleted_json")
            )
        )
        names = ("entities", "entity_aliases", "properties", "relationships", "source_refs", "conflicts", "centrality_index", "merge_log")
        left = privacy.hard_delete(targets, {name: self.table(name) for name in names})
        self.replace(deletion_audit_log=self.table("deletion_audit_log").unionByName(receipts), **left)
        return receipts

    def log_access(self, seen: DataFrame, query: str, caller: str, now: dt.datetime | None = None) -> None:
        self.replace(access_log=privacy.log_access(self.table("access_log"), seen, F.lit(query), F.lit(caller), self._now(now)))

    # reading

    def recall(self, queries: DataFrame, as_of: dt.datetime | None = None, strict_as_of: bool = False, budget: int | None = None, now: dt.datetime | None = None) -> DataFrame:
        moment = None if as_of is None else F.lit(as_of).cast("timestamp")
        kept = self.table("verbatim_chunks").withColumnRenamed("id", "chunk_id")
        told = recall.raw_text(queries, kept if moment is None else kept.where(F.col("timestamp") <= moment))
        return recall.recall(queries, self.table("entities"), self.table("entity_aliases"), self.table("properties"), self.table("relationships"), self._now(now), budget or self.settings.token_budget, moment, strict_as_of, told)

    def recall_entity(self, entity_id: str, depth: int = 2) -> DataFrame:
        """The entity and its neighbours up to ``depth``, hydrated."""
        known = self.table("entities")
        start = known.where(F.col("id") == entity_id)
        near = graph.neighbors(start, known, self.table("relationships"), depth).select(F.col("entity_id").alias("id")).unionByName(start.select("id")).distinct()
        return graph.hydrate(known.join(near, "id", "left_semi"), self.table("entity_aliases"), self.table("properties"))

    def entity_list(self, kind: str | None = None) -> DataFrame:
        found = self.table("entities").where("not archived")
        return graph.hydrate(found.where(F.col("type") == kind) if kind else found, self.table("entity_aliases"), self.table("properties"))

    def conflicts(self, entity_id: str | None = None) -> DataFrame:
        found = self.table("conflicts").where("status = 'unresolved'")
        return found.where(F.col("entity_id") == entity_id) if entity_id else found

    def health(self) -> DataFrame:
        stats = graph.graph_stats(self.table("entities"), self.table("relationships"), self.table("properties"))
        return stats.join(self.conflicts().agg(F.count(F.lit(1)).alias("unresolved_conflicts")), F.lit(True))  # one row each

    def snapshot(self, moment: dt.datetime) -> DataFrame:
        return graph.snapshot(self.table("entities"), self.table("properties"), F.lit(moment).cast("timestamp"))

    def audit_belief(self, entity_id: str, key: str) -> DataFrame:
        told = self.table("properties").where((F.col("entity_id") == entity_id) & (F.col("key") == key))
        return privacy.audit_belief(told, self.table("source_refs")).orderBy(F.desc("recorded_at"))

    def export_entity_data(self, targets: DataFrame) -> DataFrame:
        known = self.table("entities").join(targets.select("id"), "id", "left_semi")
        return privacy.export_json(known, self.table("entity_aliases"), self.table("properties"), self.table("relationships"))
