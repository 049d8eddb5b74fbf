"""History, as-of attributes, periods and gaps: defined cases, and hot keys against brute force."""

import datetime as dt
import json
import random

import pytest

from chronoweave.functions.json_values import canonical, canonical_value
from chronoweave.operators import asof, history, periods

T0 = dt.datetime(2024, 1, 1)
PROPERTY = "id string, entity_id string, key string, value_json string, as_of timestamp, recorded_at timestamp, leaf string, shard string, group string"
EVENT = "id string, entity_id string, timestamp timestamp, shard string, key string"
EDGE = "source_id string, valid_from timestamp, valid_to timestamp, key string, s string, shard int"


def at(n):
    return None if n is None else T0 + dt.timedelta(hours=n)


def us(n):
    return int((at(n) - dt.datetime(1970, 1, 1)).total_seconds()) * 1_000_000


@pytest.fixture
def properties(spark):
    # columns of clashing names come along
    return lambda data: spark.createDataFrame([(i, e, k, v, at(a), at(r), "x", "x", "x") for i, e, k, v, a, r in data], PROPERTY)


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("138", "138.0", True), ("0.541e3", "541", True), ("0", "-0.0", True), ("1e2", "100", True), ("12345678901234567890123", "12345678901234567890124", False), ('"Kelora"', "kelora ", True), ('"\\u004belora"', '"KELORA"', True),
        ('{"a":1,"b":2}', '{"b": 2.0, "a": 1}', True), ('{"a":"X"}', '{"a":"x"}', False), ("[1,2]", "[2,1]", False), ("true", '"true"', False), ('"5"', "5", False), ("NaN", '"nan"', True), ("'x'", '"\'X\'"', True), ("", '""', True),
        ('"STRASSE"', '"straße"', True), ("[1e1]", "[10]", True), ('"a" ', ' "A"', True),
    ],
)
def test_canonical(a, b, same):
    assert (canonical(a) == canonical(b)) is same


def test_built_in_and_python_forms_agree(spark):
    values = ['"Abc D"', ' "x" ', "0", "-0", "-120", "1000", "12.50", '"é"', '"a\\"b"', "null", " null ", "", "x", '{"b":1,"a":[1.0]}', "true", "007", '"  Pad "', "123456789012345678", "9" * 40, '""', "[" * 2000]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v string")
    got = {r.v: r.c for r in df.select("v", canonical_value(df.v).alias("c")).collect()}
    assert got == {v: canonical(v) for v in values} | {None: None}
    assert got["null"] is None and got[" null "] is None


def test_history_cases(properties, rows):
    data = [
        ("1", "e", "k", '"A"', 0, 0), ("2", "e", "k", '" a "', 5, 5), ("3", "e", "k", '"B"', 10, 10), ("3", "e", "k", '"B"', 10, 10), ("4", "e", "k", "null", 20, 20), ("5", "e", "k", '"C"', 30, 30),
        ("6", "e", "k", '"D"', 10, 40), ("7", "e", "k", '"A"', 2, 50), ("8", "e", "n", None, 1, 1), ("9", None, "k", "1", 1, 1), ("10", "e", None, "1", 1, 1), ("11", "e", "k", "1", None, 1), ("12", "e", "z", "1", 3, None),
        ("13", "e", "t", "1", 1, 7), ("14", "e", "t", "2", 1, 7),
    ]
    got = rows(history.build_history(properties(data)), "entity_id", "property_key", "property_id", "valid_from_us", "valid_to_us")
    # 6 corrects 3, 7 came late and repeats, of 13 and 14 the larger id holds
    assert got == sorted([("e", "k", "1", us(0), us(10)), ("e", "k", "6", us(10), us(20)), ("e", "k", "5", us(30), -1), ("e", "z", "12", us(3), -1), ("e", "t", "14", us(1), -1)], key=repr)


def _brute_history(data):
    held = {}
    for i, e, k, v, a, r in data:
        if (e, k, a) not in held or held[e, k, a][:2] < (r, i):
            held[e, k, a] = (r, i, v)
    out = []
    for group in {(e, k) for e, k, _ in held}:
        value, open_ = None, None
        for a in sorted(a for e, k, a in held if (e, k) == group):
            _, i, v = held[(*group, a)]
            v = None if v is None or v == "null" else json.loads(v)
            if v == value:
                continue
            if open_:
                out.append((*open_, us(a)))
            open_ = (*group, i, us(a)) if v is not None else None
            value = v
        if open_:
            out.append((*open_, -1))
    return sorted(out, key=repr)


def _statements(seed, n):
    pick = random.Random(seed)
    hot = lambda: "hot" if pick.random() < 0.5 else f"e{pick.randrange(6)}"
    return [(f"p{i:04}", hot(), pick.choice("kl"), pick.choice(['"a"', '"b"', "1", None, "null"]), pick.randrange(300), pick.randrange(300)) for i in range(n)]


@pytest.mark.parametrize("per_shard", [7, 50, 1 << 18])
def test_history_of_hot_keys(properties, rows, monkeypatch, per_shard):
    monkeypatch.setattr(history, "ROWS_PER_SHARD", per_shard)
    data = _statements(1, 400)
    assert rows(history.build_history(properties(data)), "entity_id", "property_key", "property_id", "valid_from_us", "valid_to_us") == _brute_history(data)


def test_only_differing_leaves_are_made_anew(properties, rows, monkeypatch):
    monkeypatch.setattr(history, "LEAF_ROWS", 2)
    data = _statements(2, 300)
    old, new = properties(data[:250]), properties(data)
    made = history.build_history(old)
    seen = []
    whole = history.versions
    monkeypatch.setattr(history, "versions", lambda df: seen.append(df.select("entity_id", "key").distinct().count()) or whole(df))
    depth = history.tree_depth(300)
    assert rows(history.update_history(made, old, new)) == rows(whole(history.statements(new, depth)))
    changed = {(e, k) for _, e, k, *_ in data[250:]}
    assert seen[-1] <= len(changed)
    assert rows(history.update_history(made, old, old)) == rows(made) and seen[-1] == 0


def test_snapshots_of_repeats_prune_their_leaves(properties, rows, monkeypatch):
    """Every 90 days all of 40 entities are sent again; only the two that changed are read for the last snapshots."""
    monkeypatch.setattr(history, "LEAF_ROWS", 1)
    day = 24
    data = [(f"a{e:02}", f"e{e}", "k", f'"v{e}"', 0, 0) for e in range(40)]
    for s in (1, 2, 3):
        data += [(f"{'abcd'[s]}{e:02}", f"e{e}", "k", '"new"' if e in (3, 7) and s == 2 else f'"v{e}"' if e not in (3, 7) or s < 2 else '"new"', s * 90 * day, s * 90 * day) for e in range(40)]
    df = properties(data)
    depth = history.tree_depth(len(data))
    states = history.statements(df, depth)
    compared = history.cumulative(history.leaf_digests(history.changes_of_state(states)))
    differing = history.differing_leaves(compared, depth)
    read = history.rows_to_diff(states, compared, differing)
    assert states.count() == 160 and 42 <= read.count() <= 50 and 30 <= differing.count() <= 42  # leaves may be shared by hash
    assert rows(history.build_history(df), "entity_id", "property_key", "property_id", "valid_from_us", "valid_to_us") == _brute_history(data)
    # a correction in the last snapshot rewrites its leaf: its repeats matter again, the others stay pruned
    data.append(("z", "e5", "k", '"other"', 0, 4 * 90 * day))
    assert rows(history.build_history(properties(data)), "entity_id", "property_key", "property_id", "valid_from_us", "valid_to_us") == _brute_history(data)
    # the same snapshot sent once more changes no leaf at all
    again = [(f"y{i}", e, k, v, 5 * 90 * day, 5 * 90 * day) for i, e, k, v, a, _ in data if a == 3 * 90 * day]
    assert history.snapshot_changes(properties(data), properties(data + again), depth).count() == 0


@pytest.mark.parametrize("per_shard", [5, 40, 1 << 18])
def test_attributes_at_events(spark, properties, rows, monkeypatch, per_shard):
    monkeypatch.setattr(asof, "ROWS_PER_SHARD", per_shard)
    data = _statements(3, 300)
    pick = random.Random(4)
    events = [(f"a{i:04}", "hot" if pick.random() < 0.6 else f"e{pick.randrange(8)}", pick.randrange(320)) for i in range(250)]
    log = spark.createDataFrame([(i, e, at(t), "x", "y") for i, e, t in [*events, *events[:20], ("n1", None, 3), ("n2", "hot", None)]], EVENT)
    want = []
    for i, e, t in events:
        for key in "kl":
            seen = [(a, r, p, v) for p, pe, k, v, a, r in data if pe == e and k == key and a <= t and r <= t]
            if seen and (best := max(seen))[3] not in (None, "null"):
                want.append((i, key, best[2]))
    assert rows(asof.attributes_at_events(log, properties(data), per_shard)) == sorted(want, key=repr)


def test_few_events_of_many_versions(spark, rows):
    """200,000 versions of one entity are sharded and merged; the ten events meet the version before each."""
    first, step = 1_700_000_000, 60
    versions = spark.range(200_000).selectExpr("concat('v', lpad(id, 7, '0')) as id", "'hot' as entity_id", "'k' as key", "cast(id as string) as value_json", f"timestamp_seconds({first} + id * {step}) as as_of", f"timestamp_seconds({first} + id * {step}) as recorded_at")
    events = spark.range(10).selectExpr("concat('a', id) as id", "'hot' as entity_id", f"timestamp_seconds({first} + id * {step} * 20000 + 30) as timestamp")
    assert rows(asof.attributes_at_events(events, versions)) == [(f"a{k}", "k", f"v{k * 20000:07}") for k in range(10)]


@pytest.mark.parametrize("per_shard", [3, 20, 1 << 18])
def test_gaps_and_periods(spark, rows, per_shard):
    pick = random.Random(5)
    data = [("hot" if pick.random() < 0.5 else f"s{pick.randrange(5)}", s := pick.randrange(2000), pick.choice([None, s, s - 1]) if pick.random() < 0.04 else s + pick.randrange(1, 9)) for _ in range(300)]
    data += data[:30] + [(None, 1, 2), ("", 1, 2), ("s1", None, 5)]
    df = spark.createDataFrame([(k, at(s), at(e), "x", "y", 1) for k, s, e in data], EDGE)
    gaps, runs = [], []
    for key in {k for k, _, _ in data if k}:
        spans = sorted((s, e if e is not None else 10**6) for k, s, e in data if k == key and s is not None and (e is None or e > s))
        merged = []
        for s, e in spans:
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        gaps += [(key, us(a[1]), us(b[0])) for a, b in zip(merged, merged[1:], strict=False)]
        runs += [(key, us(s), -1 if e == 10**6 else us(e)) for s, e in merged]
    assert rows(periods.gaps(df, "source_id", "valid_from", "valid_to", per_shard)) == sorted(gaps, key=repr)
    assert rows(periods.periods(df, "source_id", "valid_from", "valid_to", per_shard)) == sorted(runs, key=repr)


def test_empty_tables(spark, properties):
    none = properties([])
    assert history.build_history(none).count() == 0
    assert asof.attributes_at_events(spark.createDataFrame([], EVENT), none).count() == 0
    edges = spark.createDataFrame([], EDGE)
    assert periods.gaps(edges, "source_id", "valid_from", "valid_to").count() == periods.periods(edges, "source_id", "valid_from", "valid_to").count() == 0
