"""Mixing sources to target weights by capped water-filling.

Each source of a mix is to hold its weight's share of the mixture's tokens. A source that would have to repeat
beyond its maximum is clamped there, and what it cannot take is shared out among the others by their weights,
until all fit. A source is then taken whole as often as it fits, and once more in part: the part is the documents
whose seeded hash is below a border, found on a histogram of hashes, so nothing is sorted or collected.

Defined cases: a document id in several rows is one document; a null source is in no mix; null and empty texts
have 0 tokens, and follow their source's repetitions; a source without documents, with a weight or maximum that
is null or not above 0, takes nothing and its share goes to the others; a mix without usable sources is reported
with empty shares; repeated rows of targets count once; ties of the hash share a fate; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.llm.tokens import count_tokens
from chronoweave.operators.skew import largest_by_key, parallel
from chronoweave.sources.tables import cut

BINS = 1 << 16


def water_fill(weights: dict[str, float], caps: dict[str, float], total: float) -> dict[str, float]:
    """Share ``total`` by weight, none above its cap; all of the caps if they hold less than ``total``."""
    given = {name: 0.0 for name in weights}
    open_names = {name for name, weight in weights.items() if weight > 0 and caps.get(name, 0) > 0}
    left = min(total, sum(caps[name] for name in open_names))
    while open_names and left > 0:
        unit = left / sum(weights[name] for name in open_names)
        full = {name for name in open_names if weights[name] * unit >= caps[name]}
        if not full:
            return given | {name: weights[name] * unit for name in open_names}
        given |= {name: float(caps[name]) for name in full}
        left -= sum(caps[name] for name in full)
        open_names -= full
    return given


def _sized(documents: DataFrame, tokenizer: str) -> DataFrame:
    records = documents.select("doc_id", F.struct("source", "text").alias("record"))
    once = parallel(largest_by_key(records, "doc_id", "record")).select("doc_id", "record.source", "record.text")
    return cut(count_tokens(once, tokenizer).select("doc_id", "source", "n_tokens"))


def _plan(sized: DataFrame, targets: DataFrame, total_tokens: float | None) -> DataFrame:
    """(mix_name, source, weight, available, wanted, whole, part): tokens a source has and gives, whole passes over it, tokens of the part."""
    sizes = sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    # one row a row of mix_targets, a table of fixed size
    rows = targets.dropDuplicates(["mix_name", "source"]).join(sizes, "source", "left").select("mix_name", "source", "weight", "max_repeats", "tokens").collect()
    plan = []
    for mix in sorted({row.mix_name for row in rows}):
        own = [row for row in rows if row.mix_name == mix]
        weights = {row.source: row.weight or 0.0 for row in own}
        tokens = {row.source: row.tokens or 0 for row in own}
        caps = {row.source: tokens[row.source] * max(row.max_repeats or 0, 0) for row in own}
        given = water_fill(weights, caps, total_tokens if total_tokens is not None else sum(tokens.values()))
        for source, amount in sorted(given.items()):
            whole = int(amount // tokens[source]) if tokens[source] else 0
            plan.append((mix, source, float(weights[source]), tokens[source], float(amount), whole, float(amount - whole * tokens[source])))
    return sized.sparkSession.createDataFrame(plan, "mix_name string, source string, weight double, available long, wanted double, whole int, part double")


def _mix(sized: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    placed = sized.join(F.broadcast(plan), "source").withColumn("bin", F.pmod(F.xxhash64(F.lit(seed), "mix_name", "doc_id"), F.lit(BINS)).cast("int"))
    histogram = placed.where("part > 0").groupBy("mix_name", "source", "part", "bin").agg(F.sum("n_tokens").alias("tokens"))
    reached = F.sum("tokens").over(Window.partitionBy("mix_name", "source").orderBy("bin"))
    before = reached - F.col("tokens")
    # the bin that the border falls into goes to the nearer side
    nearer = (before < F.col("part")) & (F.abs(reached - F.col("part")) <= F.abs(before - F.col("part")))
    inside = histogram.withColumn("inside", nearer).where("inside")
    borders = inside.groupBy("mix_name", "source").agg(F.max("bin").alias("border"))
    mixed = placed.join(F.broadcast(borders), ["mix_name", "source"], "left")  # one row a row of mix_targets
    repeats = F.col("whole") + F.when(F.col("bin") <= F.col("border"), 1).otherwise(0)
    return mixed.select("mix_name", "doc_id", "source", "n_tokens", repeats.cast("int").alias("repeats")).where("repeats > 0")


def mix_documents(documents: DataFrame, targets: DataFrame, tokenizer: str = "byte_bpe_50k", seed: int = 17, total_tokens: float | None = None) -> DataFrame:
    """(mix_name, doc_id, source, n_tokens, repeats): which documents a mixture holds, and how often.

    ``total_tokens`` is the size aimed at; by default the tokens of all sources of the mix, each taken once.
    """
    sized = _sized(documents, tokenizer)
    return _mix(sized, _plan(sized, targets, total_tokens), seed)


def mix_shares(documents: DataFrame, targets: DataFrame, tokenizer: str = "byte_bpe_50k", seed: int = 17, total_tokens: float | None = None) -> DataFrame:
    """(mix_name, source, target_share, actual_share, tokens, documents, most_repeats) as really reached."""
    sized = _sized(documents, tokenizer)
    plan = _plan(sized, targets, total_tokens)
    held = _mix(sized, plan, seed).groupBy("mix_name", "source").agg(
        F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("repeats").alias("most_repeats")
    )
    mix = Window.partitionBy("mix_name")
    all_rows = plan.join(held, ["mix_name", "source"], "left").na.fill(0, ["tokens", "documents", "most_repeats"])
    share = F.when(F.sum("weight").over(mix) > 0, F.col("weight") / F.sum("weight").over(mix))
    actual = F.when(F.sum("tokens").over(mix) > 0, F.col("tokens") / F.sum("tokens").over(mix))
    return all_rows.select("mix_name", "source", F.round(share, 9).alias("target_share"), F.round(actual, 9).alias("actual_share"), "tokens", "documents", "most_repeats")
