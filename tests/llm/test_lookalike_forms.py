"""Texts that look the same get one form, in whole tokens of another script too."""

import itertools

from chronoweave.llm import lookalikes


def test_forms_are_equal_where_texts_look_the_same(spark, rows, monkeypatch):
    monkeypatch.setattr(lookalikes, "HOT_ROWS", 2)
    texts = ["а piso", "a piso", "a рiѕо", "a piso", "Ha дом", "На дом", "zzаzz qqоqq", "zzazz qqoqq", "zzаzz", "ahora piso", "дом", None, "хо", "xo"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    forms = {r.doc_id: r.same_form for r in lookalikes.repair_texts(df).collect()}
    assert len(forms) == len(texts) and forms[11] is None and forms[0] == forms[2] == "a piso" and forms[8] == "zzazz"
    paired = set(rows(lookalikes.lookalike_pairs(df)))
    for a, b in itertools.combinations([i for i, t in enumerate(texts) if t], 2):
        assert (forms[a] == forms[b]) is ((a, b) in paired or texts[a] == texts[b]), (texts[a], texts[b])
    assert {(0, 1), (4, 5), (6, 7), (12, 13)} <= paired


def test_looks_across_scripts():
    from chronoweave.llm.lookalikes import fold, look

    same = [("pаlаcе", "palace"), ("ΟΚ", "OK"), ("Օսո", "Oun"), ("ԌԚԜ", "GQW"), ("ƏӘ", "ƏƏ"), ("Ａ ｂ", "A b"), ("é", "é")]
    assert all(look(fold(a)) == look(fold(b)) for a, b in same)
    other = [("palace", "Palace"), ("e", "é"), ("б", "b"), ("я", "R"), ("λ", "A"), ("ա", "w"), ("0", "O"), ("1", "l"), ("ж", "x")]
    assert all(look(fold(a)) != look(fold(b)) for a, b in other)
