"""The training-data operators: defined cases, hot groups, and brute force or round trips."""

import itertools
import random

import pytest

from chronoweave.llm import components, conversations, lookalikes, merges, mixing, pii, tokens, variants

LABELS = [("user", "user"), ("human", "user"), ("assistant", "assistant"), ("ai", "assistant"), ("system", "system")]


def _union_find(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("shape", ["random", "path", "star", "circle", "empty", "loops"])
@pytest.mark.parametrize("hot", [2, 100_000])
def test_components(spark, monkeypatch, shape, hot):
    monkeypatch.setattr(components, "HOT_ROWS", hot)
    pick = random.Random(1)
    pairs = {
        "random": [(pick.randrange(60), pick.randrange(60)) for _ in range(45)], "path": [(i, i + 1) for i in range(25)], "star": [(0, i) for i in range(1, 25)] + [(30, i) for i in range(31, 40)],
        "circle": [(i, (i + 1) % 9) for i in range(9)], "empty": [], "loops": [(1, 1), (2, 2), (2, 3), (3, 2), (None, 4)],
    }[shape]
    links = spark.createDataFrame([*pairs, *pairs[:3]], "a int, b int")
    want = _union_find([(a, b) for a, b in pairs if a != b and None not in (a, b)])
    for algorithm in (components.seed_tree_components, components.star_components):
        found = algorithm(links).collect()
        assert len(found) == len(want) and {r.node: r.component for r in found} == want


def test_merge_groups(spark, rows):
    data = [
        ("a1", None, 0), ("a2", " A1 ", 0), ("a2", " A1 ", 0), ("a3", "A2", 0), ("b1", "ghost", 0), ("b2", "GHOST", 0), ("c1", "c2", 0), ("c2", "c3", 0), ("c3", "c1", 0), ("d1", "d1", 0), ("e1", "", 0), ("f1", "gone", 0), (None, "a1", 0), ("g1", "  ", 0),
    ]
    df = spark.createDataFrame(data, "id string, merged_into string, node int")
    want = [("a1", "a1"), ("a2", "a1"), ("a3", "a1"), ("b1", "b1"), ("b2", "b1"), ("c1", "c1"), ("c2", "c1"), ("c3", "c1")]
    assert rows(merges.merge_groups(df)) == want
    assert merges.merge_groups(df.limit(0)).count() == 0


def _messages(spark, data):
    return spark.createDataFrame([(f"m{i}", *row, "x") for i, row in enumerate(data)], "id string, conversation_id string, turn_number int, text string, participant string, role string")


def test_conversations(spark, rows, monkeypatch):
    monkeypatch.setattr(conversations, "TURNS_PER_RUN", 2)
    data = [
        ("ok", 1, "hi", "User: "), ("ok", 2, "hello", " AI"), ("ok", 2, "hello", "ai"), ("ok", 3, "s", "SYSTEM"), ("ok", 4, "q", "human:"), ("ok", 5, "sys", "system"), ("ok", 6, "a", "assistant"),
        ("blank", 0, " ", "user"), ("blank", 7, None, "nobody"), ("late", 2, "x", "user"), ("gap", 0, "x", "user"), ("gap", 2, "y", "ai"), ("two", 0, "x", "user"), ("two", 0, "y", "user"), ("two", 1, "z", "ai"),
        ("who", 0, "x", "user"), ("who", 1, "y", "stranger"), ("mute", 0, "x", "user"), ("mute", 1, " ", "ai"), ("open", 0, "x", "ai"), ("open", 1, "y", "user"), ("none", None, "x", "user"), ("nobody", 0, "x", None),
        (None, 0, "x", "user"), ("", 0, "x", "user"), ("twice", 0, "x", "user"), ("twice", 1, "y", "human"), ("twice", 2, "z", "ai"), ("late_reply", 0, "a", "user"), ("late_reply", 1, "s", "system"), ("late_reply", 2, "s2", "system"), ("late_reply", 3, "s3", "system"), ("late_reply", 4, "b", "ai"),
    ]
    labels = spark.createDataFrame(LABELS, "label string, speaker_role string")
    found = conversations.judge_conversations(_messages(spark, data).drop("role"), labels)
    got = {r.conversation: r.reason for r in found.collect()}
    assert got == {
        "ok": None, "blank": "empty", "late": "broken", "gap": "broken", "two": "broken", "who": "broken", "mute": "missing_reply", "open": "missing_reply", "none": "broken", "nobody": "broken", "twice": "missing_reply", "late_reply": None,
    }
    kept = rows(conversations.conversation_turns(_messages(spark, data).drop("role"), labels).where("conversation = 'ok'"), "turn_number", "role", "text")
    assert kept == [(1, "user", "hi"), (2, "assistant", "hello"), (3, "system", "s"), (4, "user", "q"), (5, "system", "sys"), (6, "assistant", "a")]
    assert conversations.judge_conversations(_messages(spark, []).drop("role"), labels).count() == 0


def test_messages_without_conversation_are_linked(spark, rows):
    data = [(None, 0, "how is the oven?", "user"), (None, 1, "> how is the oven?\nfine", "ai"), (None, 2, "> fine\nno", "user"), (None, 0, "alone", "user"), ("c", 0, "> alone", "user")]
    found = conversations.assign_conversations(_messages(spark, data).drop("role"))
    assert rows(found, "id", "conversation") == [("m0", "linked:m0"), ("m1", "linked:m0"), ("m2", None), ("m3", None), ("m4", "c")]
    replies = _messages(spark, data[:4]).drop("role").withColumn("reply_to_id", __import__("pyspark").sql.functions.when(__import__("pyspark").sql.functions.col("id") == "m2", "m1"))
    assert ("m2", "linked:m0") in rows(conversations.assign_conversations(replies), "id", "conversation")


def test_quotes_of_several_lines_and_of_stored_messages(spark, rows):
    data = [("c", 0, "first line\nsecond line", "user"), (None, 1, "> first line\n> second line\nyes", "ai"), ("c", 2, "ok", "user"), ("d", 2, "ok", "user"), (None, 3, "> ok\nfine", "ai"), (None, 4, ">>> x\n>", "user")]
    found = conversations.assign_conversations(_messages(spark, data).drop("role"))
    # 'ok' was said twice: which is meant is unknown
    assert rows(found, "id", "conversation") == [("m0", "c"), ("m1", "c"), ("m2", "c"), ("m3", "d"), ("m4", None), ("m5", None)]


PII = [
    ("mail anna.berg+x@mail.example or ANNA (at) post [dot] example", {("email", "anna.berg+x@mail.example"), ("email", "ANNA (at) post [dot] example")}),
    ("Old one ((212) 555-0119) is off, new phone: +44 20 7946 0203.", {("phone", "(212) 555-0119"), ("phone", "+44 20 7946 0203")}),
    ("tel 2 1 2 5 5 5 0 1 3 6", {("phone", "2 1 2 5 5 5 0 1 3 6")}),
    ("the courier asked for passport no. C72388879 at 134B Kelven Blvd, Port Binmer :(", {("id_number", "C72388879"), ("address", "134B Kelven Blvd, Port Binmer")}),
    ("Noted: Dr. Timothy Vanderholt moved to Rigor Brothers Ltd.", {("name", "Timothy Vanderholt")}),
    ("Hi Kenny, thanks for the update on the glass roof!", {("name", "Kenny")}),
    ("Serial SN274-402-3210 was replaced in Port Helm. The score was 312-155 in the end.", set()),
    ("Main Street traffic was bad. Will this work before 2024-01-01?", set()),
    ("", set()), ("  \n\t", set()),
]


@pytest.mark.parametrize(("text", "items"), PII)
def test_personal_items(text, items):
    model = pii.default_model()
    assert {(kind, text[a:b]) for a, b, kind in model.find(text)} == items
    clean = model.replace(text)
    for kind, item in items:
        assert item not in clean and f"[{kind.upper()}]" in clean


def test_personal_items_of_a_table(spark, rows):
    long = "Okay 👍 I noted it. " * 3000 + "\ncall 212-555-0119"
    data = [("1", PII[5][0], 1), ("1", PII[5][0], 1), ("2", None, 1), ("3", "", 1), ("4", long, 1)]
    df = spark.createDataFrame(data, "id string, text string, items int")
    assert rows(pii.personal_items(df, "id", "text"), "record_id", "pii_type", "start_char") == [("1", "name", 3), ("4", "phone", len(long) - 12)]
    clean = dict(rows(pii.without_personal_items(df, "id", "text")))
    assert clean["1"] == "Hi [NAME], thanks for the update on the glass roof!" and clean["2"] is None and clean["3"] == "" and clean["4"] == long[:-12] + "[PHONE]"
    assert pii.personal_items(df.limit(0), "id", "text").count() == 0


def test_personal_items_in_sentences_never_trained_on():
    """A quarter of the carriers and half of all name fillers are kept apart; measured is what was kept apart."""
    from chronoweave.llm import pii_training

    lines = pii_training.carrier_lines()
    learnt = [line for k, line in enumerate(lines) if k % 4]
    model = pii_training.train(sentences=6000, epochs=3, carriers=learnt, part=pii_training.TRAINED)
    found = pii_training.evaluate(model, 800, carriers=lines[::4], part=pii_training.HELD_OUT)
    print(found)
    assert all(p >= 0.8 and r >= 0.85 for p, r in found.values())
    assert all(min(found[k]) >= 0.9 for k in ("email", "phone", "address"))


@pytest.mark.parametrize(
    ("text", "kind", "item"),
    [
        ("I met Mark Smith today", "name", "Mark Smith"), ("Paul Harrington emailed the board", "name", "Paul Harrington"), ("We hired Julian Ortega as lead engineer last week", "name", "Julian Ortega"),
        ("His SSN is 123-45-6789", "id_number", "123-45-6789"), ("+1 (212) 555-0199 ext 4", "phone", "+1 (212) 555-0199 ext 4"), ("4 Oak Crescent, Bristol", "address", "4 Oak Crescent, Bristol"),
        ("She lives at 12 Martin Luther King Street.", "address", "12 Martin Luther King Street"), ("My IBAN is DE89 3704 0044 0532 0130 00.", "id_number", "DE89 3704 0044 0532 0130 00"),
    ],
)
def test_personal_items_of_plain_sentences(text, kind, item):
    assert [(k, text[a:b]) for a, b, k in pii.default_model().find(text)] == [(kind, item)]


def test_transition_weights_decide():
    """The same two numbers, read by what came before."""
    weights = {"phone": {"bias": -1.0, "after=name": 3.0}, "id_number": {"bias": 0.5, "after=name": -3.0}, "name": {"bias": -50.0, "bare=g": 60.0}}
    model = pii.Model(weights, frozenset({"has"}))
    assert [k for _, _, k in model.find("Henry has 212-555-0199")] == ["name", "phone"] and [k for _, _, k in model.find("has 212-555-0199")] == ["id_number"]


def test_typing_errors():
    def slow(a, b):
        d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
        for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    pick = random.Random(3)
    for _ in range(500):
        a, b = ("".join(pick.choices("abc", k=pick.randrange(9))) for _ in "ab")
        assert min(slow(a, b), 3) == min(variants.typing_errors(a, b), 3)
        if len(a) >= 8 and len(b) >= 8 and slow(a, b) <= 2:
            assert set(variants.deletions(a)) & set(variants.deletions(b))


@pytest.mark.parametrize(
    ("kind", "a", "b", "same"),
    [
        ("person", "Stephen Binloyorva", "Binloyorva Stephen", True), ("person", "Dr. William H. Kipriramal", "kipriramal, Wm.", True), ("person", 'Abigail "Abby" Holver', "abigail_holver", True), ("person", "IsabellaYelvolta", "Izzy Yelvolta", True),
        ("person", "Hnry Pimcorkorwen", "HENRY  PIMCORKORWEN", True), ("person", "Timothy Dorsa", "Harold Dorsa", False), ("organization", "The Duktirsuza Foundation S.A.", "Foundation of Duktirsuza", True),
        ("organization", "Duknel corvol Dept Stores", "Duknelcorvol, Department Stores (Inc.)", True), ("organization", "Famaljaslo Transp. & Log.", "Transport and Logistics Famaljaslo Ltd", True), ("organization", "Dundra Foundation LLC", "Dundra Services S.A.", False),
    ],
)
def test_readings(kind, a, b, same):
    assert (variants.read_spelling(kind, a)[:2] == variants.read_spelling(kind, b)[:2]) is same


def test_variant_pairs(spark, rows):
    entities = [
        ("p1", "person", "Elizabeth Dunkelsolha", False, None), ("p2", "person", "elizabeth Dunkelsohla", False, ""), ("p3", "person", "Dunkelsolha, E.", False, None), ("p4", "person", "Charles Dunkelsolha", False, None), ("p5", "person", "Liz Dunkelsolha", True, None),
        ("p6", "person", "Betty Dunkelsolha", False, "p1"), ("p7", "person", None, False, None), ("p8", "person", "Liz", False, None), ("o1", "organization", "Rodfortari University PLC", False, None), ("o2", "organization", "Rodfortari Univ.", False, None),
        ("o3", "organization", "Rodfortari Systems PLC", False, None), ("p1", "person", "Elizabeth Dunkelsolha", False, None), ("x1", "project", "Elizabeth Dunkelsolha", False, None),
    ]
    e = spark.createDataFrame([(*r, "x") for r in entities], "id string, type string, name string, archived boolean, merged_into string, main string")
    a = spark.createDataFrame([("p3", "Beth Dunkelsolha", 1), ("p4", "Elizabeth Other", 1), ("p8", " ", 1), ("o1", None, 1), ("p2", "Liz", 1), ("gone", "x", 1)], "entity_id string, alias string, side int")
    assert rows(variants.variant_pairs(e, a)) == [("o1", "o2"), ("p1", "p2"), ("p1", "p3"), ("p2", "p3")]
    assert variants.variant_pairs(e.limit(0), a.limit(0)).count() == 0


def test_chunks_rejoin_to_whole_encodings():
    encoder = tokens.PieceEncoder(*tokens.tokenizer_source("byte_bpe_50k"))
    pick = random.Random(5)
    texts = ["".join(pick.choices(" 'aAbrestldv\n\t　é日1 2.,!?👩‍", k=pick.randrange(1, 1500))) for _ in range(150)] + ["we've  'll  don't\n\n\n x", "a" * 5000, " " * 3000, "<|endoftext|> " * 40]
    for text in texts:
        parts = []
        for chunk in tokens.chunks(text):
            ids = [encoder.ids(p) for p in encoder.pieces(chunk)]
            parts.append(([i for x in ids for i in x], [len(x) for x in ids], chunk))
        assert "".join(c for _, _, c in parts) == text
        assert encoder.join(parts) == encoder.encoding.encode_ordinary(text)


def test_encode_documents(spark, monkeypatch):
    monkeypatch.setattr(tokens, "HOT_ROWS", 3)
    long = "The valve saves energy, and it doesn't stop. " * 400
    data = [(1, "Hello world", 9), (1, "Hello world", 9), (2, None, 9), (3, "", 9), (4, long, 9), (5, long, 9), (6, " ", 9)]
    got = {r.doc_id: list(r.ids) for r in tokens.encode_documents(spark.createDataFrame(data, "doc_id long, text string, ids int")).collect()}
    encoder = tokens.PieceEncoder(*tokens.tokenizer_source("byte_bpe_50k"))
    assert got == {i: encoder.encoding.encode_ordinary(t or "") for i, t, _ in data}


def test_water_fill():
    assert mixing.water_fill({"a": 1, "b": 1}, {"a": 100, "b": 100}, 100) == {"a": 50, "b": 50}
    assert mixing.water_fill({"a": 1, "b": 1, "c": 2}, {"a": 10, "b": 100, "c": 100}, 100) == {"a": 10, "b": 30, "c": 60}
    assert mixing.water_fill({"a": 3, "b": 1}, {"a": 5, "b": 5}, 100) == {"a": 5, "b": 5}
    assert mixing.water_fill({"a": 1, "b": 0, "c": 1}, {"a": 0, "b": 9, "c": 9}, 4) == {"a": 0, "b": 0, "c": 4}
    assert mixing.water_fill({}, {}, 4) == {}


def test_mixing(spark):
    data = [(i, "web", "one two three four five " * 4, 1) for i in range(300)] + [(1000 + i, "small", "a short text", 1) for i in range(20)] + [(2000, None, "x", 1), (2001, "small", None, 1), (0, "web", "one two three four five " * 4, 1)]
    docs = spark.createDataFrame(data, "doc_id long, source string, text string, tokens int")
    targets = spark.createDataFrame([("m", "web", 1.0, 1), ("m", "small", 1.0, 3), ("m", "nothing", 5.0, 2), ("m", "small", 1.0, 3), ("z", "nothing", 1.0, 1)], "mix_name string, source string, weight double, max_repeats int")
    mixed = mixing.mix_documents(docs, targets).collect()
    assert all(r.repeats <= {"web": 1, "small": 3}[r.source] for r in mixed) and len({(r.mix_name, r.doc_id) for r in mixed}) == len(mixed)
    assert {r.repeats for r in mixed if r.source == "small"} == {3}
    shares = {(r.mix_name, r.source): r for r in mixing.mix_shares(docs, targets).collect()}
    assert abs(sum(r.actual_share for k, r in shares.items() if k[0] == "m") - 1) < 1e-6
    assert shares["m", "nothing"].tokens == 0 and shares["z", "nothing"].actual_share is None
    empty = spark.createDataFrame([(5000 + i, "web", None, 1) for i in range(200)], docs.schema)
    part = mixing.mix_shares(docs.unionByName(empty), targets, total_tokens=1200.0).where("mix_name = 'm'").collect()
    reached = {r.source: r.tokens for r in part}
    one = reached["small"] // 60
    assert one == 3 and abs(reached["web"] - (1200 - reached["small"])) <= 20
    assert mixing.mix_documents(docs, targets).collect() == mixed or set(mixing.mix_documents(docs, targets).collect()) == set(mixed)


def test_lookalikes(spark, rows, monkeypatch):
    monkeypatch.setattr(lookalikes, "HOT_ROWS", 2)
    same = ["The final test saves été", "Тhe ﬁnal test ѕаνеѕ été", "Ｔｈｅ　final　test saves été", "The fi​nal te­st saves été﻿", "The final test saves été"]
    other = ["the final test saves été", "The final test saves ete", "The final  test saves été", "The final test saves été²", "final The test saves été", "The\tfinal test saves été", None, "", " ", "​", " ", "👩‍🔧", "👩🔧"]
    data = [(i, t, "x") for i, t in enumerate([*same, same[0], *other])] + [(0, same[0], "x")]
    df = spark.createDataFrame(data, "doc_id long, text string, look string")
    texts = {i: t for i, t, _ in data}
    alike = [i for i, t in texts.items() if t in same]
    want = [(a, b) for a, b in itertools.combinations(sorted(alike), 2) if texts[a] != texts[b]]
    assert rows(lookalikes.lookalike_pairs(df)) == sorted(want, key=repr)
    forms = dict(rows(lookalikes.repair_texts(df), "doc_id", "same_form"))
    assert forms[1] == forms[0] == forms[3] == same[0] and forms[12] is None
    assert lookalikes.lookalike_pairs(df.limit(0)).count() == 0


def test_repair_needs_the_word_in_the_corpus(spark, rows):
    df = spark.createDataFrame([(1, "pаlace"), (2, "zzаzz"), (3, "palace"), (4, "собака сoбака")], "doc_id long, text string")
    assert dict(rows(lookalikes.repair_texts(df), "doc_id", "same_form")) == {1: "palace", 2: "zzаzz", 3: "palace", 4: "собака собака"}
