"""Evaluation: accuracies, nearest-rank percentiles, stratified samples, failure classes, prefix budgets, dataset readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.functions.text import contained_share


def accuracy(results: DataFrame, category: str, right: str) -> DataFrame:
    """(category, n, n_right, accuracy) by category, with the rows 'overall' (micro) and 'task_average' (macro)."""
    by = results.groupBy(F.col(category).alias("category")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(right).cast("long")).alias("n_right"))
    by = by.withColumn("accuracy", F.col("n_right") / F.col("n"))
    micro = by.agg(F.lit("overall").alias("category"), F.sum("n").alias("n"), F.sum("n_right").alias("n_right"), (F.sum("n_right") / F.sum("n")).alias("accuracy"))
    macro = by.agg(F.lit("task_average").alias("category"), F.sum("n").alias("n"), F.sum("n_right").alias("n_right"), F.avg("accuracy").alias("accuracy"))
    return by.unionByName(micro).unionByName(macro)


def nearest_rank(values: DataFrame, group: str, value: str, percents: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """(group, p50, ..., n, mean, least, most): the value of rank round(p / 100 * (n - 1)), half to even.

    Ranks come from counts of equal values, so a group is summed by value before anything is ordered.
    """
    counts = values.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("c"))
    order = Window.partitionBy(group).orderBy(value)
    ranked = counts.withColumn("upto", F.sum("c").over(order)).withColumn("n", F.sum("c").over(Window.partitionBy(group)))
    picks = [F.min(F.when(F.col("upto") > F.bround(F.lit(p / 100) * (F.col("n") - 1)), F.col(value))).alias(f"p{p}") for p in percents]
    mean = (F.sum(F.col(value) * F.col("c")) / F.sum("c")).alias("mean")
    return ranked.groupBy(group).agg(*picks, F.max("n").alias("n"), mean, F.min(value).alias("least"), F.max(value).alias("most"))


def stratified_sample(rows: DataFrame, category: str, key: str, each: int, seed: int = 42) -> DataFrame:
    """``each`` rows of every category, by the order of a seeded hash of the key: the same rows every time."""
    order = Window.partitionBy(category).orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key)
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= each).drop("_n")


def failure_class(reference: Column, answer: Column, retrieved: Column) -> Column:
    """JUDGE_DISAGREEMENT if answer and context hold the reference, ANSWER_ERROR if only the context does, else RETRIEVAL_MISS."""

    def holds(text: Column) -> Column:
        return F.contains(F.lower(text), F.trim(F.lower(reference))) | (F.coalesce(contained_share(reference, text), F.lit(0.0)) > 0.7)

    return F.when(holds(retrieved) & holds(answer), "JUDGE_DISAGREEMENT").when(holds(retrieved), "ANSWER_ERROR").otherwise("RETRIEVAL_MISS")


def prefix_within_budget(rows: DataFrame, group: str, order: list[str], text: str, budget: int) -> DataFrame:
    """The rows of each group up to the first that goes over a budget of characters (4 a token)."""
    before = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("_sum", F.sum(F.coalesce(F.length(text), F.lit(0))).over(before))
    return summed.where(F.col("_sum") <= 4 * budget).drop("_sum")


def session_text(turns: DataFrame) -> DataFrame:
    """(conversation_id, session): 'Role: content' lines in the order of turns. One session is one text by definition."""
    line = F.concat(F.initcap("role"), F.lit(": "), F.coalesce("text", F.lit("")))
    return turns.groupBy("conversation_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn_number", line.alias("line")))), lambda x: x["line"]), "\n").alias("session"))


def end_of_day(date: Column) -> Column:
    return F.try_to_timestamp(F.concat(date, F.lit("T23:59:59")))


def noon(date: Column) -> Column:
    return F.try_to_timestamp(F.concat(date, F.lit("T12:00:00")))


def recall_averages(results: DataFrame, category: str, entity_recall: str, fact_recall: str) -> DataFrame:
    """(category, n, entity_recall, fact_recall): averages by category, and over all questions as 'overall'."""
    averages = [F.count(F.lit(1)).alias("n"), F.avg(entity_recall).alias("entity_recall"), F.avg(fact_recall).alias("fact_recall")]
    return results.groupBy(F.col(category).alias("category")).agg(*averages).unionByName(results.agg(F.lit("overall").alias("category"), *averages))


def failure_counts(failures: DataFrame, failure: str = "failure") -> DataFrame:
    """(failure, n, share): how often each class of failure occurs, and its share in percent; classes without a row count 0."""
    classes = failures.sparkSession.createDataFrame([("RETRIEVAL_MISS",), ("ANSWER_ERROR",), ("JUDGE_DISAGREEMENT",)], "failure string")
    counts = failures.groupBy(F.col(failure).alias("failure")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_all"))
    joined = classes.join(counts, "failure", "left").join(total, F.lit(True))  # three rows and one
    return joined.select("failure", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(100.0 * F.col("n") / F.col("_all"), F.lit(0.0)).alias("share"))


def with_references(results: DataFrame, references: DataFrame, key: str) -> DataFrame:
    """Results joined to the references of the same question; results without one drop out."""
    return results.join(references, key)


def shared_haystack(questions: DataFrame, sessions: str) -> DataFrame:
    """(shared): whether two or more questions all ask of the same, non-null list of sessions."""
    shared = (F.count(F.lit(1)) > 1) & (F.count(sessions) == F.count(F.lit(1))) & (F.min(F.md5(F.to_json(F.struct(sessions)))) == F.max(F.md5(F.to_json(F.struct(sessions)))))
    return questions.agg(F.coalesce(shared, F.lit(False)).alias("shared"))


def value_as_of_month(changes: DataFrame, keys: list[str], month: str, value: str, asked: str) -> DataFrame:
    """(keys, value): the value of the latest month at or before the month asked for, of equal months the largest value."""
    known = changes.where(F.col(month) <= F.col(asked))
    return known.groupBy(*keys).agg(F.max_by(F.col(value), F.struct(month, value)).alias("value"))
