"""Deletion keys do not pass through the driver, however small their words look."""

from chronoweave.llm import variants


def test_deletion_keys_are_never_broadcast(spark):
    written = [("person", "brackwater", 5000.0, False)] + [("person", "brackwater"[:k] + "brackwater"[k + 1 :], 1.0, False) for k in range(10)]
    words = spark.createDataFrame(written, "type string, word string, wide double, listed boolean").groupBy("type", "word", "listed").agg({"wide": "max"}).withColumnRenamed("max(wide)", "wide")
    found = variants._misspelt(words)
    assert {(r.word, r.meant) for r in found.collect()} == {(word, "brackwater") for _, word, _, _ in written[1:]}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [key" in plan and "BroadcastExchange" not in plan
