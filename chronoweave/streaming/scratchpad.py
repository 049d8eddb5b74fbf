"""Session scratchpad: names and pronouns of conversation turns, linked by tentative ids, in batch and as a stream."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Patterns of names and pronouns, words of organisations.
NAME = r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\b"
PRONOUN = r"\b(he|him|his|she|her|they|them|their)\b"
ORG_WORDS = ("Corp", "Inc", "LLC", "Ltd", "Company", "Group")
MENTION = "session string, tentative_id string, text string, turn int, type_hint string, context string"


def _tentative(session: Column, name: Column) -> Column:
    return F.md5(F.concat_ws("|", session, F.lower(name)))


def names(turns: DataFrame) -> DataFrame:
    """(session, turn, position, text, type_hint, tentative_id): capitalised sequences of two to four words."""
    found = turns.select("session", "turn", F.posexplode(F.regexp_extract_all("text", F.lit(f"(?U){NAME}"), 1)).alias("position", "name"), F.substring("text", 1, 200).alias("context"))
    parts = F.split("name", r"(?U)\s+")
    kept = found.where(F.size(parts) <= 4)
    hint = F.when(F.arrays_overlap(parts, F.array(*map(F.lit, ORG_WORDS))), "organization").otherwise("person")
    return kept.select("session", "turn", "position", F.col("name").alias("text"), hint.alias("type_hint"), _tentative(F.col("session"), F.col("name")).alias("tentative_id"), "context")


def mentions(turns: DataFrame) -> DataFrame:
    """Names and pronouns of (session, turn, text); a pronoun takes the id of the last person, else of the last name.

    Within a turn names come before pronouns. Pronouns before any name are left out.
    """
    named = names(turns).withColumn("phase", F.lit(0))
    said = turns.select("session", "turn", F.posexplode(F.regexp_extract_all("text", F.lit(f"(?iU){PRONOUN}"), 1)).alias("position", "text"), F.substring("text", 1, 200).alias("context"))
    said = said.withColumns({"phase": F.lit(1), "type_hint": F.lit("person"), "tentative_id": F.lit(None).cast("string")})
    both = named.unionByName(said)
    past = Window.partitionBy("session").orderBy("turn", "phase", "position").rowsBetween(Window.unboundedPreceding, 0)
    person = F.last(F.when((F.col("phase") == 0) & (F.col("type_hint") == "person"), F.col("tentative_id")), ignorenulls=True).over(past)
    anyone = F.last(F.when(F.col("phase") == 0, F.col("tentative_id")), ignorenulls=True).over(past)
    linked = both.withColumn("tentative_id", F.coalesce("tentative_id", person, anyone)).where("tentative_id is not null")
    return linked.select("session", "tentative_id", "text", "turn", "type_hint", "phase", "position", "context")


def unique_entities(mentions: DataFrame) -> DataFrame:
    """(session, tentative_id, best_name, type_hint): the longest mention of each id, the earliest of equal length."""
    order = F.struct(F.length("text").alias("length"), (-F.col("turn")).alias("turn"), (-F.col("phase")).alias("phase"), (-F.col("position")).alias("position"))
    best = F.max_by(F.struct("text", "type_hint"), order)
    return mentions.groupBy("session", "tentative_id").agg(best.alias("b")).select("session", "tentative_id", F.col("b.text").alias("best_name"), F.col("b.type_hint").alias("type_hint"))


def read_turn(session: str, turn: int, text: str, last_person: str | None, last_name: str | None) -> tuple[list[tuple], str | None, str | None]:
    """The mentions of one turn and the ids that pronouns after it mean."""
    rows = []
    for match in re.finditer(NAME, text or ""):
        parts = match.group(1).split()
        if len(parts) > 4:
            continue
        hint = "organization" if set(parts) & set(ORG_WORDS) else "person"
        key = hashlib.md5(f"{session}|{match.group(1).lower()}".encode()).hexdigest()
        rows.append((session, key, match.group(1), turn, hint, text[:200]))
        last_person, last_name = (key if hint == "person" else last_person), key
    for match in re.finditer(PRONOUN, text or "", re.IGNORECASE):
        if meant := last_person or last_name:
            rows.append((session, meant, match.group(1), turn, "person", text[:200]))
    return rows, last_person, last_name


def mention_stream(turns: DataFrame, event_time: str | None = None, gap: str = "30 minutes", gap_ms: int = 1_800_000) -> DataFrame:
    """Mentions of a stream of turns (session, turn, text). With a column ``event_time`` a session's state ends once the
    watermark, ``gap`` behind the newest turn, has passed its last turn by ``gap_ms``; without it sessions do not end."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        (stored,) = state.get if state.exists else ("[null, null]",)
        person, name = json.loads(stored)
        said = pd.concat(batches).sort_values("turn")
        rows: list[tuple] = []
        for row in said.itertuples():
            more, person, name = read_turn(key[0], int(row.turn), row.text, person, name)
            rows += more
        state.update((json.dumps([person, name]),))
        if event_time is not None:
            newest = int(said[event_time].max().timestamp() * 1000)
            state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + gap_ms)
        yield pd.DataFrame(rows, columns=[field.split()[0] for field in MENTION.split(", ")])

    if event_time is not None:
        turns = turns.withWatermark(event_time, gap)
    timeout = "NoTimeout" if event_time is None else "EventTimeTimeout"
    return turns.groupBy("session").applyInPandasWithState(step, MENTION, "ids string", "append", timeout)


def maintenance(quick: Callable[[], None], full: Callable[[], None], quick_every: int = 50, full_every: int = 200) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that runs the full or the quick consolidation every so many batches."""

    def after(_: DataFrame, batch: int) -> None:
        if (batch + 1) % full_every == 0:
            full()
        elif (batch + 1) % quick_every == 0:
            quick()

    return after
