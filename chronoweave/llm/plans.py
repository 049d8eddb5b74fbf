"""Queries of the training-data problems and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.llm.conversations import conversation_turns, judge_conversations
from chronoweave.llm.lookalikes import lookalike_pairs, repair_texts
from chronoweave.llm.merges import merge_groups
from chronoweave.llm.mixing import mix_documents, mix_shares
from chronoweave.llm.pii import personal_items, without_personal_items
from chronoweave.llm.tokens import encode_documents
from chronoweave.llm.variants import canonical_forms, variant_pairs
from chronoweave.sources.tables import scan

_MESSAGE = ("id", "conversation_id", "turn_number", "text", "participant")


#: The texts with personal information: table, its id and its text.
_TEXTS = (("verbatim_chunks", "id", "text"), ("source_refs", "id", "verbatim"))


def _from_texts(spark: SparkSession, base: str, operator) -> DataFrame:
    parts = [operator(scan(spark, base, table, key, text), key, text).withColumn("record_table", F.lit(table)) for table, key, text in _TEXTS]
    return parts[0].unionByName(parts[1])


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    return _from_texts(spark, base, personal_items).select("record_table", "record_id", "pii_type", "start_char")


def p2_texts(spark: SparkSession, base: str) -> DataFrame:
    return _from_texts(spark, base, without_personal_items).select("record_table", "record_id", "text")


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    return merge_groups(scan(spark, base, "entities", "id", "merged_into"))


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    judged = judge_conversations(scan(spark, base, "verbatim_chunks", *_MESSAGE), scan(spark, base, "speaker_labels"))
    stored = judged.where("reason is not null and conversation not like 'linked:%'")
    return stored.select(F.col("conversation").alias("conversation_id"), "reason")


def p5_conversations(spark: SparkSession, base: str) -> DataFrame:
    return conversation_turns(scan(spark, base, "verbatim_chunks", *_MESSAGE), scan(spark, base, "speaker_labels"))


def _named(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    return scan(spark, base, "entities", "id", "type", "name", "archived", "merged_into"), scan(spark, base, "entity_aliases", "entity_id", "alias")


def p6_found(spark: SparkSession, base: str) -> DataFrame:
    return variant_pairs(*_named(spark, base))


def p6_forms(spark: SparkSession, base: str) -> DataFrame:
    return canonical_forms(*_named(spark, base))


def p8_ids(spark: SparkSession, base: str) -> DataFrame:
    return encode_documents(scan(spark, base, "documents", "doc_id", "text"))


def p9_mixture(spark: SparkSession, base: str) -> DataFrame:
    return mix_documents(scan(spark, base, "documents", "doc_id", "text", "source"), scan(spark, base, "mix_targets"))


def p9_shares(spark: SparkSession, base: str) -> DataFrame:
    return mix_shares(scan(spark, base, "documents", "doc_id", "text", "source"), scan(spark, base, "mix_targets"))


def p10_found(spark: SparkSession, base: str) -> DataFrame:
    return lookalike_pairs(scan(spark, base, "documents", "doc_id", "text"))


def p10_texts(spark: SparkSession, base: str) -> DataFrame:
    return repair_texts(scan(spark, base, "documents", "doc_id", "text")).select("doc_id", F.col("same_form").alias("text"))


QUERIES = {
    "p2_found": p2_found,
    "p2_texts": p2_texts,
    "p6_found": p6_found,
    "p6_forms": p6_forms,
    "p8_ids": p8_ids,
    "p9_mixture": p9_mixture,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_texts": p10_texts,
    "p3_found": p3_found,
    "p5_found": p5_found,
    "p5_conversations": p5_conversations,
}

_P5 = r"""
WITH m AS (
  SELECT DISTINCT conversation_id, turn_number, coalesce(text, '') AS text,
         (SELECT speaker_role FROM speaker_labels l WHERE l.label = regexp_replace(lower(participant), '^\s+|[\s:]+$', '', 'g')) AS role
  FROM verbatim_chunks WHERE conversation_id <> ''),
t AS (SELECT conversation_id, turn_number, min(text) AS text, count(DISTINCT text) AS texts, max(role) AS role,
             bool_or(regexp_matches(text, '\S')) AS spoken, bool_or(role IS NULL) AS unknown
      FROM m GROUP BY 1, 2),
c AS (SELECT conversation_id, bool_or(spoken) AS spoken,
             min(turn_number) NOT IN (0, 1) OR max(turn_number) - min(turn_number) + 1 <> count(*) OR bool_or(texts > 1) OR bool_or(unknown) AS broken
      FROM t GROUP BY 1),
n AS (SELECT *, lead(role) OVER w AS next_role, lead(spoken) OVER w AS next_spoken FROM t WHERE role IS DISTINCT FROM 'system'
      WINDOW w AS (PARTITION BY conversation_id ORDER BY turn_number)),
u AS (SELECT conversation_id, bool_or(role = 'user' AND NOT coalesce(next_role = 'assistant' AND next_spoken, false)) AS unanswered FROM n GROUP BY 1),
j AS (SELECT conversation_id, CASE WHEN NOT spoken THEN 'empty' WHEN broken THEN 'broken' WHEN unanswered THEN 'missing_reply' END AS reason
      FROM c LEFT JOIN u USING (conversation_id))
"""

SQL = {
    "p3_found": """
WITH RECURSIVE e AS (SELECT DISTINCT id, lower(trim(id)) AS node, nullif(lower(trim(merged_into)), '') AS named FROM entities),
l AS (SELECT node AS u, named AS v FROM e WHERE named IS NOT NULL UNION SELECT named, node FROM e WHERE named IS NOT NULL),
r(u, v) AS (SELECT u, u FROM l UNION SELECT r.u, l.v FROM r JOIN l ON l.u = r.v),
c AS (SELECT u AS node, min(v) AS component FROM r GROUP BY u),
g AS (SELECT id, component, min(id) OVER (PARTITION BY component) AS group_id, count(*) OVER (PARTITION BY component) AS n
      FROM (SELECT DISTINCT id, node FROM e) JOIN c USING (node))
SELECT id AS entity_id, group_id FROM g WHERE n > 1
""",
    "p5_found": _P5 + "SELECT conversation_id, reason FROM j WHERE reason IS NOT NULL",
    "p5_conversations": _P5
    + """SELECT conversation_id AS conversation, turn_number, coalesce(role, '') AS role, text FROM t
JOIN j USING (conversation_id) WHERE reason IS NULL""",
}
