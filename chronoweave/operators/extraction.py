"""Reading entities and relations out of a language model's JSON answers; hooks for models, with offline stand-ins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.schema import ENTITY_TYPES

_ENTITY = "array<struct<name:string,type:string,properties:string,confidence:double>>"
_RELATION = "array<struct<source:string,target:string,type:string,properties:string,confidence:double>>"


def json_array(answer: Column, kind: str) -> Column:
    """The JSON array in an answer: fences dropped, else the outermost brackets; an empty array if there is none."""
    bare = F.trim(F.regexp_replace(F.trim(answer), r"(?md)^\s*```.*$", ""))
    opening, closing = F.locate("[", bare), F.length(bare) - F.locate("]", F.reverse(bare)) + 1
    sliced = F.when((opening > 0) & (F.locate("]", bare) > 0) & (closing > opening), bare.substr(opening, closing - opening + 1))
    whole = F.when(F.startswith(bare, F.lit("[")), bare)
    empty = F.array().cast(kind)
    return F.coalesce(F.from_json(whole, kind), F.from_json(sliced, kind), empty)


def _truthy(properties: Column) -> Column:
    found = F.from_json(properties, "map<string,string>")
    kept = F.map_filter(found, lambda k, v: v.isNotNull() & ~v.isin("", "0", "0.0", "false", "[]", "{}", "null"))
    return F.coalesce(kept, F.create_map().cast("map<string,string>"))


def parse_entities(answers: DataFrame) -> DataFrame:
    """(answer_id, position, name, type, properties): nameless ones dropped, unknown types become concept, empty properties dropped."""
    rows = answers.select("answer_id", F.posexplode(json_array(F.col("answer"), _ENTITY)).alias("position", "e"))
    kind = F.lower(F.trim("e.type"))
    named = rows.select("answer_id", "position", F.trim("e.name").alias("name"), F.when(kind.isin(*ENTITY_TYPES), kind).otherwise("concept").alias("type"), _truthy(F.col("e.properties")).alias("properties"))
    return named.where("name <> ''")


def parse_relations(answers: DataFrame, entities: DataFrame) -> DataFrame:
    """(answer_id, position, source, target, type, properties): ends matched to the answer's entities, first partly equal name wins."""
    rows = answers.select("answer_id", F.posexplode(json_array(F.col("answer"), _RELATION)).alias("position", "r"))
    names = entities.groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("position", "name"))).alias("names"))
    joined = rows.join(names, "answer_id", "left").withColumn("names", F.transform("names", lambda n: n["name"]))

    def known(end: Column) -> Column:
        return F.coalesce(F.exists("names", lambda n: F.lower(n) == F.lower(end)), F.lit(False))

    def nearest(end: Column) -> Column:
        return F.try_element_at(F.filter("names", lambda n: F.contains(F.lower(n), F.lower(end)) | F.contains(F.lower(end), F.lower(n))), F.lit(1))

    source, target, kind = F.trim("r.source"), F.trim("r.target"), F.replace(F.lower(F.trim("r.type")), F.lit(" "), F.lit("_"))
    both = known(source) & known(target)
    stated = joined.where((source != "") & (target != "") & (kind != ""))
    ends = stated.select(
        "answer_id", "position", F.when(both, source).otherwise(F.coalesce(nearest(source), source)).alias("source"), F.when(both, target).otherwise(F.coalesce(nearest(target), target)).alias("target"),
        kind.alias("type"), _truthy(F.col("r.properties")).alias("properties"),
    )
    return ends


def ask_model(texts: DataFrame, client: Callable[[], Callable[[str], str]]) -> DataFrame:
    """(answer_id, answer, error) for texts (answer_id, text): one client a task, made by ``client``. Blank texts answer [];
    so do failed calls, whose error says what went wrong, so that they can be asked again."""

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        complete = client()

        def one(text: str | None) -> tuple[str, str | None]:
            if not text or not text.strip():
                return "[]", None
            try:
                return complete(text), None
            except Exception as error:  # noqa: BLE001 - one failed call must not end the task
                return "[]", f"{type(error).__name__}: {error}"

        for batch in batches:
            told = [one(text) for text in batch["text"]]
            yield pd.DataFrame({"answer_id": batch["answer_id"], "answer": [a for a, _ in told], "error": [e for _, e in told]})

    return texts.select("answer_id", "text").mapInPandas(answer, "answer_id string, answer string, error string")


def canned_client(answers: dict[str, str]) -> Callable[[], Callable[[str], str]]:
    """An offline stand-in: the answer of the first key that occurs in the text."""
    return lambda: lambda text: next((a for key, a in answers.items() if key in text), "[]")
