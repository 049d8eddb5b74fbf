"""The attribution of misspellings does not depend on how often all records are repeated."""

import pytest

from chronoweave.llm import variants


@pytest.mark.parametrize("times", [1, 2, 7])
def test_attribution_is_the_same_at_any_scale(spark, times):
    written = ["Elizabeth Voltirpelhel"] * 30 + ["Elizabeth Voltirrpelhel"] * 3 + ["Elizabeth Voltirpelhhell"] * 2 + ["Elizabeth Dunkelsolha"] * 5 + ["Charles Dunkelsohla"] * 4
    e = spark.createDataFrame([(f"{k}-{n}", "person", name, False, None) for k in range(times) for n, name in enumerate(written)], "id string, type string, name string, archived boolean, merged_into string")
    a = spark.createDataFrame([], "entity_id string, alias string")
    counts = {(r.main, r.side): r["count"] for r in variants.canonical_forms(e, a).groupBy("main", "side").count().collect()}
    assert counts == {("voltirpelhel", "elizabeth"): 35 * times, ("dunkelsolha", "elizabeth"): 5 * times, ("dunkelsohla", "charles"): 4 * times}
