"""Variant spellings: what must be linked and what must not, with names that no list holds."""

from chronoweave.llm import variants

ENTITIES = "id string, type string, name string, archived boolean, merged_into string"


def _groups(spark, kind, names, aliases=()):
    """The sets of ids linked by pairs."""
    e = spark.createDataFrame([(i, kind, name, False, None) for i, name in names.items()], ENTITIES)
    a = spark.createDataFrame(list(aliases), "entity_id string, alias string")
    return {(r.entity_id_a, r.entity_id_b) for r in variants.variant_pairs(e, a).collect()}


def test_an_alias_that_is_a_full_name_links(spark):
    names = {"a": "Ingvild Torsvåg", "b": "INGVILD TORSVAG", "c": "Ottoline Brackwater", "d": "Rowan Lindqvist", "e": "Torsvåg Lindqvist"}
    found = _groups(spark, "person", names, [("c", "Torsvåg, Ingvild"), ("d", "Ingvild"), ("e", "-"), ("e", None), ("e", "n/a")])
    assert found == {("a", "b"), ("a", "c"), ("b", "c")}


def test_names_that_no_list_holds(spark):
    """Order and short forms are learnt: 'Xochi' is written for 'Xochitl' in several families."""
    families = [f"{a}{b}" for a in ("Brack", "Lind", "Holt", "Marsh", "Quin", "Dray") for b in ("water", "mere", "field", "bury", "cote")]
    names = {f"x{k}": f"Xochitl {f}" for k, f in enumerate(families)} | {f"y{k}": f"Ferenc {f}" for k, f in enumerate(families)}
    names |= {"z1": f"{families[3]} Xochitl", "z2": f"Xochi {families[20]}", "z3": f"Xoochitl {families[7]}", "z4": f"{families[9]} Ferenc"}
    found = _groups(spark, "person", names, [(f"x{k}", f"Xochi {families[k]}") for k in range(6)])
    assert found == {("x3", "z1"), ("x20", "z2"), ("x7", "z3"), ("y9", "z4")}


def test_unlisted_organisations_single_words_and_acronyms(spark):
    names = {"a": "Wavecrest Upholstery Ltd", "b": "Wavecrest Upholstry", "c": "Wavecrest Saddlery", "d": "IBM", "e": "International Business Machines Corp.", "f": "I.B.M.", "g": "Zyx", "h": "ZYX Inc.", "i": "The Acme", "j": "", "k": None}
    found = _groups(spark, "organization", names, [("e", "IBM"), ("a", "WU"), ("c", "WU")])
    assert found == {("a", "b"), ("d", "e"), ("d", "f"), ("e", "f"), ("g", "h")}


def test_attested_names_are_never_corrected(spark):
    families = ["Ashdown", "Birchall", "Cromwell", "Dunstable", "Everleigh", "Fotheringay", "Grantchester", "Hollingsworth", "Ilkley", "Jessop", "Kirkwall", "Lymington"]
    given = ["Kate", "Nate", "Jane", "Jacob", "Carol", "Harold", "Louis", "Lois"]
    names = {f"{g}{k}": f"{g} {family}" for k, family in enumerate(families) for g in given}
    assert _groups(spark, "person", names) == set()


def test_short_main_parts_and_two_errors(spark):
    names = {f"a{k}": "Brigid Marlowe" for k in range(9)} | {"b": "Brigid Mralowee", "c": "Brigid Ng", "d": "Brigid Li", "e": "B. Marlowe", "f": "Brigid Marowle"}
    pairs = _groups(spark, "person", names)
    linked = {i for p in pairs for i in p}
    assert {"b", "e", "f"} <= linked and not {"c", "d"} & linked


def test_long_names_and_clashing_columns(spark):
    e = spark.createDataFrame([("a", "person", "x" * 5000 + " " + "y" * 5000, False, None, "m", "s"), ("b", "person", "x" * 5000 + "  " + "Y" * 5000, False, None, "m", "s"), ("c", "person", " ".join(["word"] * 2000), False, None, "m", "s")], ENTITIES + ", form string, side string")
    a = spark.createDataFrame([("a", "z" * 3000, "t")], "entity_id string, alias string, text string")
    assert [tuple(r) for r in variants.variant_pairs(e, a).collect()] == [("a", "b")]
