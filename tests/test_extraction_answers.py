"""Whole texts in answers: brackets, fences, quotes and line breaks inside a name survive the parser."""

from chronoweave.plans import retrieval


def test_answers_hold_whole_texts(spark, rows, tmp_path):
    texts = ["short", "x" * 500, 'He said "[no]" and ]} then {"a": [1]}', "one\n```json\n[2]\n```\nend of a text of more than forty letters", "back\\slash \\n and \ttab, with a tail that is longer than forty", "a break\u2028``` in a text of more than forty characters", "]" * 50]
    data = [(f"c{n}", "k", n, t, "person", [0.0]) for n, t in enumerate(texts)]
    spark.createDataFrame(data, "id string, conversation_id string, turn_number int, text string, participant string, embedding array<double>").write.parquet(f"{tmp_path}/verbatim_chunks.parquet")
    assert rows(retrieval.parse_llm_json(spark, str(tmp_path))) == sorted((f"c{n}", t, "person") for n, t in enumerate(texts))
