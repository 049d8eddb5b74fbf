"""Entity resolution: candidates, signals, scores and decisions for mentions against the active entities."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.functions.scores import floor_days
from chronoweave.functions.text import lower_similarity, phonetic_codes, shared_codes, types_compatible, words
from chronoweave.operators import graph
from chronoweave.sources.tables import cut

HIGH, LOW = 0.85, 0.40
# Weights of the signals; of the second tier for a sparse and for a dense graph.
TIER1 = {"name_fuzzy": 0.35, "name_phonetic": 0.10, "alias_match": 0.25, "type_match": 0.30}
TIER2 = {
    "name_fuzzy": (0.35, 0.25), "name_phonetic": (0.08, 0.05), "alias_match": (0.25, 0.20), "type_match": (0.20, 0.15),
    "description_sim": (0.05, 0.10), "shared_neighbors": (0.02, 0.12), "recency": (0.05, 0.08),
}


def _probes(mentions: DataFrame) -> DataFrame:
    """Mentions with the array ``probes``: the name and, if it has several words, the longer ones."""
    parts = F.when(F.size(words(F.col("name"))) > 1, F.filter(words(F.col("name")), lambda w: F.length(w) > 2)).otherwise(F.array().cast("array<string>"))
    return mentions.withColumn("probes", F.array_distinct(F.concat(F.array("name"), parts)))


def candidates(mentions: DataFrame, surfaces: DataFrame) -> DataFrame:
    """(mention_id, entity_id): names or aliases that contain the mention, or one of its longer words if it has several."""
    asked = cut(_probes(mentions).select("mention_id", "probes"))
    found = graph.substring_matches(asked.select(F.explode("probes").alias("probe")), surfaces)
    return graph.first_matches(asked, "probes", found).select("mention_id", "entity_id")


def _told(mentions: DataFrame) -> DataFrame:
    return mentions.withColumns({"lower": F.lower("name"), "codes": phonetic_codes(F.col("name"))})


def _known(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    grouped = aliases.where("alias is not null").groupBy("entity_id").agg(F.collect_set(F.lower("alias")).alias("lower_aliases"))
    rest = [c for c in ("entity_no", "near") if c in entities.columns]
    known = entities.select(F.col("id").alias("entity_id"), F.col("name").alias("entity_name"), F.col("type").alias("entity_type"), "last_seen", F.lower("name").alias("entity_lower"), phonetic_codes(F.col("name")).alias("entity_codes"), *rest)
    return known.join(grouped, "entity_id", "left")


def _compared(joined: DataFrame) -> DataFrame:
    exact = (F.col("lower") == F.col("entity_lower")).cast("double")
    alias = F.array_max(F.transform("lower_aliases", lambda a: lower_similarity(F.col("lower"), a)))
    kind = F.when(F.col("type") == F.col("entity_type"), 1.0).when(types_compatible(F.col("type"), F.col("entity_type")), 0.5).otherwise(0.0)
    return joined.select(
        "mention_id", "entity_id", "name", "type", "entity_name", "entity_type", "last_seen", exact.alias("name_exact"), lower_similarity(F.col("lower"), F.col("entity_lower")).alias("name_fuzzy"),
        shared_codes(F.col("codes"), F.col("entity_codes")).alias("name_phonetic"), alias.alias("alias_match"), kind.alias("type_match"), *(c for c in ("entity_no", "near") if c in joined.columns),
    )


def signals(mentions: DataFrame, pairs: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """Text signals of each pair; alias_match is null for an entity without aliases."""
    return _compared(pairs.join(_told(mentions), "mention_id").join(_known(entities, aliases), "entity_id"))


def candidate_signals(mentions: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """``signals`` of all ``candidates``. Both sides bring what is compared, so the pairs are made, compared and passed
    on within one task; the columns ``entity_no`` and ``near`` of the entities are passed on."""
    asked = cut(_probes(_told(mentions)))
    found = graph.substring_matches(asked.select(F.explode("probes").alias("probe")), graph.surfaces(entities, aliases))
    return _compared(graph.first_matches(asked, "probes", found, _known(entities, aliases)))


def numbered(entities: DataFrame) -> DataFrame:
    """``entities`` with ``entity_no``, which numbers them from 0 in the order of their ids without gaps."""
    placed = cut(entities.select("id").orderBy("id").withColumn("_at", F.monotonically_increasing_id()))  # partition, then row
    placed = placed.select("id", F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("_row"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_from", F.coalesce(F.sum("_n").over(before), F.lit(0)))  # a row a partition
    return entities.join(placed.join(F.broadcast(parts), "_part").select("id", (F.col("_from") + F.col("_row")).alias("entity_no")), "id")


def best(scored: DataFrame, entities: DataFrame) -> DataFrame:
    """(mention_id, entity_id) of the best candidate, ties by id, of scores with the ``entity_no`` of ``numbered`` entities.

    Score (nine decimals) and number make one integer, so the pairs are folded in memory, not sorted."""
    last = (1 << 33) - 1
    folded = F.shiftleft(F.round(F.col("score") * 1_000_000_000).cast("long"), 33).bitwiseOR(F.lit(last) - F.col("entity_no"))
    top = scored.groupBy("mention_id").agg(F.max(folded).alias("_best"))
    chosen = top.select("mention_id", (F.lit(last) - F.col("_best").bitwiseAND(F.lit(last))).alias("entity_no"))
    return chosen.join(entities.select("entity_no", F.col("id").alias("entity_id")), "entity_no").select("mention_id", "entity_id")


def _composite(weights: dict[str, Column]) -> Column:
    total = sum((F.when(F.col(s).isNotNull(), w).otherwise(F.lit(0.0)) for s, w in weights.items()), F.lit(0.0))
    score = sum((F.coalesce(F.col(s) * w, F.lit(0.0)) for s, w in weights.items()), F.lit(0.0))
    fits = F.col("type_match") >= 0.5
    return F.when((F.col("name_exact") == 1.0) & fits, 0.95).when((F.col("alias_match") == 1.0) & fits, 0.92).when(total > 0, score / total).otherwise(0.0)


def tier1_scores(signals: DataFrame) -> DataFrame:
    return signals.withColumn("score", F.round(_composite({s: F.lit(w) for s, w in TIER1.items()}), 9))


def connections(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """(entity_id, near): how many active entities an entity has edges with."""
    linked = graph.edges_of(relationships).where("entity_id <> other_id").select("entity_id", F.col("other_id").alias("id")).distinct()
    return linked.join(entities.where("not archived").select("id"), "id", "left_semi").groupBy("entity_id").agg(F.count(F.lit(1)).alias("near"))


def tier2_scores(signals: DataFrame, entities: DataFrame, relationships: DataFrame, now: Column, similarity: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Tier 1 signals with connectivity, recency and, if given, a similarity of descriptions; weights shift as the graph
    fills. Signals that have the ``near`` of ``connections`` are not joined to it."""
    totals = entities.where("not archived").agg(F.count(F.lit(1)).alias("nodes")).join(relationships.agg(F.count(F.lit(1)).alias("edges")), F.lit(True))
    maturity = F.least(F.col("edges") / F.greatest("nodes", F.lit(1)) / 3.0, F.lit(1.0))
    connected = signals if "near" in signals.columns else signals.join(connections(entities, relationships), "entity_id", "left")
    full = connected.join(F.broadcast(totals.select(maturity.alias("maturity"))), F.lit(True))  # one row
    described = F.lit(None).cast("double") if similarity is None else similarity(F.concat("name", F.lit(" ("), "type", F.lit(")")), F.concat("entity_name", F.lit(" ("), "entity_type", F.lit(")")))
    full = full.withColumns(
        {
            "shared_neighbors": F.least(F.coalesce("near", F.lit(0)) / 10.0, F.lit(1.0)),
            "recency": F.coalesce(F.exp(-floor_days(now, F.col("last_seen")) / 30.0), F.lit(0.5)),
            "description_sim": described,
        }
    )
    weights = {s: F.lit(a) + (F.lit(b) - F.lit(a)) * F.col("maturity") for s, (a, b) in TIER2.items()}
    return full.withColumn("score", F.round(_composite(weights), 9)).drop("near", "maturity")


def decide(mentions: DataFrame, scored: DataFrame, tiebreak: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(mention_id, action, entity_id, confidence, add_alias): the best candidate (ties by id), merged or not.

    Excluding types count as 0. At HIGH or above the mention merges; from LOW on ``tiebreak`` (name, entity name)
    decides and costs a twentieth of the score; otherwise the mention becomes an entity of its own.
    """
    best = Window.partitionBy("mention_id").orderBy(F.desc("score"), "entity_id")
    top = scored.withColumn("_rank", F.row_number().over(best)).where("_rank = 1")
    score = F.when(types_compatible(F.col("type"), F.col("entity_type")), F.col("score")).otherwise(0.0)
    told = F.lit(False) if tiebreak is None else tiebreak(F.col("name"), F.col("entity_name"))
    confidence = F.when(score >= HIGH, score).when((score >= LOW) & told, score * 0.95)
    new_name = (F.col("name") != F.col("entity_name")) & (F.coalesce("alias_match", F.lit(0.0)) < 1.0)
    chosen = top.select("mention_id", "entity_id", confidence.alias("confidence"), F.when(new_name, F.col("name")).alias("add_alias")).where("confidence is not null")
    joined = mentions.select("mention_id").join(chosen, "mention_id", "left")
    return joined.select("mention_id", F.when(F.col("entity_id").isNotNull(), "merge").otherwise("create").alias("action"), "entity_id", F.round("confidence", 6).alias("confidence"), "add_alias")
