"""Rebuilding conversations from message rows, and naming those that must be dropped.

Rows that carry a conversation_id belong to it. Rows without one are joined by reply and quote links, and their
conversations are the connected components of those links (alternating large-star and small-star joins); a
component that holds a stored conversation belongs to it. Turns are then combined, ordered and validated.

Defined cases: rows with the same id are one record; a null text is an empty text; rows with the same turn_number
and text are one turn, whose role is known if any of its rows has a known label; a null turn_number makes a
conversation broken; a quote of a text that several messages have is ambiguous and links nothing; of several
stored conversations in one component the smallest counts; a conversation of white space only is empty whatever its numbers; an empty table gives no
rows; extra columns are ignored. Texts are compared whole.

No conversation is gathered in one task: turns are combined before the shuffle, and the order within a
conversation is looked at in runs of TURNS_PER_RUN turn numbers, stitched over run summaries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.llm.components import star_components
from chronoweave.sources.tables import cut

TURNS_PER_RUN = 4096
_WHITE = r"(?U)^\s*$"


def _blank(text: str) -> F.Column:
    return F.col(text).rlike(_WHITE)


def quote_links(messages: DataFrame) -> DataFrame:
    """(a, b): a message without conversation, and one it quotes or replies to.

    Consecutive lines '> text' quote the message with that whole text, if only one has it; rows may also name the
    message they reply to in a column reply_to_id.
    """
    lacking = messages.where("conversation_id is null or conversation_id = ''")
    block = F.explode(F.regexp_extract_all("text", F.lit(r"(?m)((?:^>[^\n]*(?:\n|\z))+)"), 1))
    quotes = lacking.where("text rlike '(?m)^>'").select(F.col("id").alias("a"), block.alias("block"))
    quotes = quotes.select("a", F.trim(F.regexp_replace("block", r"(?m)^> ?|\n\z", "")).alias("said")).where("said <> ''").distinct()
    links = quotes.limit(0).select("a", F.col("said").alias("b"))
    if not quotes.isEmpty():
        # ids of equal texts are combined before the shuffle, so a text that everyone writes is one row a task
        said = messages.select(F.trim("text").alias("said"), "id").join(quotes.select("said").distinct(), "said", "left_semi")
        once = said.groupBy("said").agg(F.min("id").alias("b"), F.max("id").alias("other")).where("b = other")
        links = quotes.join(once, "said").select("a", "b")
    if "reply_to_id" in messages.columns:
        links = links.unionByName(lacking.where("reply_to_id <> ''").select(F.col("id").alias("a"), F.col("reply_to_id").alias("b")))
    return links


def assign_conversations(messages: DataFrame) -> DataFrame:
    """``messages`` with a column ``conversation``: the stored id, that of a stored message in the same component, or
    'linked:' and the smallest message id of the component; null for messages that belong to no conversation."""
    stored = F.when(F.col("conversation_id") != "", F.col("conversation_id"))
    components = cut(star_components(quote_links(messages)).select(F.col("node").alias("id"), "component"))
    if components.isEmpty():
        return messages.withColumn("conversation", stored)
    held = messages.select("id", stored.alias("held")).join(components, "id").groupBy("component").agg(F.min("held").alias("held"))
    meant = components.join(held, "component", "left").select("id", F.coalesce("held", F.concat(F.lit("linked:"), "component")).alias("meant"))
    return messages.join(meant, "id", "left").withColumn("conversation", F.coalesce(stored, "meant")).drop("meant")


def speaker_roles(messages: DataFrame, labels: DataFrame) -> DataFrame:
    """Add ``role`` by the label table, regardless of letter case, outer blanks and a closing colon."""
    label = F.regexp_replace(F.lower("participant"), r"(?U)^\s+|[\s:]+$", "")
    known = labels.select(F.lower(F.trim("label")).alias("label"), F.col("speaker_role").alias("role")).dropDuplicates(["label"])
    return messages.withColumn("label", label).join(F.broadcast(known), "label", "left").drop("label")  # a fixed list of labels


def turns(messages: DataFrame) -> DataFrame:
    """(conversation, turn_number, text, texts, role, spoken): one row a turn number."""
    rows = messages.where("conversation is not null").withColumn("text", F.coalesce("text", F.lit("")))
    spoken = rows.withColumn("spoken", ~_blank("text")).groupBy("conversation", "turn_number", "text")
    once = spoken.agg(F.max("role").alias("role"), F.max("spoken").alias("spoken"))
    return once.groupBy("conversation", "turn_number").agg(
        F.min("text").alias("text"), F.count(F.lit(1)).alias("texts"), F.min(F.coalesce("role", F.lit(""))).alias("role"), F.max("spoken").alias("spoken")
    )


def _unanswered(ordered: DataFrame) -> DataFrame:
    """(conversation, unanswered) from turns: a user turn whose next turn, system turns left out, is no spoken assistant turn."""
    run = F.floor(F.col("turn_number") / TURNS_PER_RUN)
    spoken = ordered.where("role <> 'system'").select(
        "conversation", "turn_number", run.alias("run"), (F.col("role") == "user").alias("asks"), ((F.col("role") == "assistant") & F.col("spoken")).alias("answers")
    )
    order = Window.partitionBy("conversation", "run").orderBy("turn_number")
    within = spoken.withColumn("answered", F.lead("answers").over(order))
    ends = within.groupBy("conversation", "run").agg(
        F.max(F.col("asks") & ~F.coalesce("answered", F.lit(True))).alias("unanswered"),
        F.min_by("answers", "turn_number").alias("first_answers"),
        F.max_by("asks", "turn_number").alias("last_asks"),
    )
    following = F.coalesce(F.lead("first_answers").over(Window.partitionBy("conversation").orderBy("run")), F.lit(False))
    return ends.withColumn("open", F.col("last_asks") & ~following).groupBy("conversation").agg(F.max(F.col("unanswered") | F.col("open")).alias("unanswered"))


def judge_conversations(messages: DataFrame, labels: DataFrame) -> DataFrame:
    """(conversation, reason): reason is empty, broken or missing_reply, null for a sound conversation."""
    return _judged(turns(speaker_roles(assign_conversations(messages), labels)))


def _judged(ordered: DataFrame) -> DataFrame:
    whole = ordered.groupBy("conversation").agg(
        F.max("spoken").alias("spoken"),
        F.min("turn_number").alias("first"),
        F.max("turn_number").alias("last"),
        F.count("turn_number").alias("numbers"),
        F.max(F.col("turn_number").isNull() | (F.col("texts") > 1) | (F.col("role") == "")).alias("flawed"),
    )
    gaps = F.col("last").cast("bigint") - F.col("first") + 1 != F.col("numbers")
    broken = F.col("flawed") | F.col("first").isNull() | ~F.col("first").isin(0, 1) | gaps
    judged = whole.join(_unanswered(ordered), "conversation", "left")
    reason = F.when(~F.col("spoken"), "empty").when(broken, "broken").when(F.coalesce("unanswered", F.lit(False)), "missing_reply")
    return judged.select("conversation", reason.alias("reason"))


def conversation_turns(messages: DataFrame, labels: DataFrame) -> DataFrame:
    """(conversation, turn_number, role, text) of the sound conversations; order by conversation and turn_number."""
    ordered = cut(turns(speaker_roles(assign_conversations(messages), labels)))
    sound = _judged(ordered).where("reason is null").select("conversation")
    return ordered.join(sound, "conversation", "left_semi").select("conversation", "turn_number", "role", "text")
