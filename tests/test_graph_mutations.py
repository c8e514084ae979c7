"""Batches against one-by-one service in plain Python, components, drift."""

import random

import pytest

from loomspark.operators import graph_mutations as GM
from loomspark.operators.components import components


@pytest.fixture(params=[1, 2])
def rng(request):
    return random.Random(request.param)


def _outcomes(df):
    rows = df.collect()
    assert len({r.ordinal for r in rows}) == len(rows)
    return {r.ordinal: r.outcome for r in rows}


def test_components(spark, rng):
    items = [(f"i{i}", [f"k{rng.randint(0, 60)}" for _ in range(rng.randint(0, 2))]) for i in range(70)] + [(f"z{i:02}", [f"c{i}", f"c{i + 1}"]) for i in range(40)]
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, keys in items:
        for k in keys:
            parent[top(i)] = top("key " + k)
    want = {}
    for i, _ in items:
        want.setdefault(top(i), []).append(i)
    got = {r.item: r.component for r in components(spark.createDataFrame(items, "item string, keys array<string>")).collect()}
    assert got == {i: min(group) for group in want.values() for i in group}


def test_create_concepts(spark, rng):
    stored = {"c1": {("a", True), ("b", False)}, "c2": {("d", True)}}
    requests = [(n, {(k, i == 0) for i, k in enumerate(rng.sample("abcdefghij", rng.randint(1, 3)))}) for n in range(40)]
    sets, want = dict(stored), {}
    for n, asked in requests:
        owners = {c for c, have in sets.items() if {k for k, _ in have} & {k for k, _ in asked}}
        want[n] = "existing" if asked in sets.values() else "created" if not owners else "alias_set_mismatch" if len(owners) == 1 else "alias_owned"
        if want[n] == "created":
            sets[f"n{n}"] = asked
    aliases = spark.createDataFrame([(c, k, p) for c, have in stored.items() for k, p in have], "concept_id string, alias_key string, is_preferred boolean")
    asked = spark.createDataFrame([(n, k, p) for n, have in requests for k, p in have], "ordinal long, key string, preferred boolean")
    assert _outcomes(GM.create_concepts(aliases, asked)) == want


def test_replace_aliases(spark, rng):
    keys = {f"c{i}": [f"k{i}"] for i in range(6)}
    revision = dict.fromkeys(keys, 1)
    requests = [(n, f"c{rng.randint(0, 7)}", rng.randint(1, 3), rng.choices([f"k{i}" for i in range(9)], k=rng.randint(0, 2)), rng.choice([1, 1, 1, 2])) for n in range(50)]
    concepts = spark.createDataFrame([(c, 1) for c in keys], "id string, revision long")
    aliases = spark.createDataFrame([(c, k[0], True) for c, k in keys.items()], "concept_id string, alias_key string, is_preferred boolean")
    got = _outcomes(GM.replace_aliases(concepts, aliases, spark.createDataFrame(requests, "ordinal long, id string, revision long, keys array<string>, n_preferred int")))
    for n, c, rev, asked, preferred in requests:
        if c not in keys:
            want = "missing"
        elif revision[c] != rev:
            want = "stale"
        elif not asked or len(set(asked)) != len(asked) or preferred != 1:
            want = "invalid_set"
        elif any(set(asked) & set(k) for o, k in keys.items() if o != c):
            want = "alias_owned"
        else:
            want, keys[c], revision[c] = "updated", asked, revision[c] + 1
        assert got.pop(n) == want
    assert not got


def test_update_assertions(spark, rng):
    names = [f"n{i}" for i in range(4)]
    triples = rng.sample([(s, r, o) for s in names for o in names if s < o for r in ("uses", "related_to")], 6)
    now = {f"a{i}": [1, t] for i, t in enumerate(triples)}
    requests = [(n, f"a{rng.randint(0, 6)}", rng.randint(0, 2), rng.choice([*names, "nobody"]), rng.choice(["uses", "related_to", "likes"]), rng.choice([*names, "nobody"])) for n in range(60)]
    concepts = spark.createDataFrame([(n, 1) for n in names], "id string, revision long")
    a = spark.createDataFrame([(i, rev, *t) for i, (rev, t) in now.items()], "id string, revision long, subject string, relation string, object string")
    got = _outcomes(GM.update_assertions(concepts, a, spark.createDataFrame(requests, "ordinal long, id string, revision long, subject string, relation string, object string")))
    for n, i, rev, s, r, o in requests:
        if r == "related_to" and s > o:
            s, o = o, s
        if s == o or r == "likes" or rev < 1:
            want = "invalid_input"
        elif i not in now:
            want = "missing"
        elif now[i][0] != rev:
            want = "stale"
        elif s not in names:
            want = "missing_subject"
        elif o not in names:
            want = "missing_object"
        elif any(t == (s, r, o) for j, (_, t) in now.items() if j != i):
            want = "duplicate"
        else:
            want, now[i] = "updated", [rev + 1, (s, r, o)]
        assert got.pop(n) == want
    assert not got


def test_create_assertions(spark, rng):
    names, known = ["x", "y", "z"], set(range(60))
    held = {("x", "uses", "y"): set(range(30))}
    requests = []
    for n in range(50):
        lo = rng.randint(0, 58)
        requests.append((n, rng.choice([*names, "nobody"]), rng.choice(["uses", "related_to"]), rng.choice(names), list(range(lo, lo + rng.choice([0, 1, 3, 15, 33])))))
    concepts = spark.createDataFrame([(n, 1) for n in names], "id string, revision long")
    a = spark.createDataFrame([("a0", "x", "uses", "y", 1)], "id string, subject string, relation string, object string, revision long")
    evidence = spark.createDataFrame([("a0", s) for s in range(30)], "assertion_id string, source_ref_id long")
    sources = spark.createDataFrame([(s,) for s in known], "source_ref_id long")
    got = _outcomes(GM.create_assertions(concepts, a, evidence, sources, spark.createDataFrame(requests, "ordinal long, subject string, relation string, object string, source_ids array<long>")))
    for n, s, r, o, ids in requests:
        t = (o, r, s) if r == "related_to" and s > o else (s, r, o)
        if s == o or not ids or len(ids) > 32:
            want = "invalid_input"
        elif "nobody" in t:
            want = "missing_concept"
        elif not known.issuperset(ids):
            want = "missing_source"
        elif len(held.get(t, set()) | set(ids)) > 32:
            want = "evidence_limit"
        else:
            want = "existing" if t in held else "created"
            held[t] = held.get(t, set()) | set(ids)
        assert got.pop(n) == want
    assert not got


def test_deletions_happen_once(spark):
    a = spark.createDataFrame([("a", "x", "uses", "y", 1)], "id string, subject string, relation string, object string, revision long")
    asked = spark.createDataFrame([(1, "a", 2), (2, "a", 1), (3, "a", 1), (4, None, 1), (5, "b", 1)], "ordinal long, id string, revision long")
    assert _outcomes(GM.delete_assertions(a, asked)) == {1: "stale", 2: "deleted", 3: "missing", 4: "invalid_input", 5: "missing"}
    none = spark.createDataFrame([], "ordinal long, id string, revision long")
    assert GM.delete_assertions(a, none).count() == 0


def test_drift_is_null_safe(spark):
    schema = "source_ref_id long, source_kind string, external_id string, external_version long"
    now = spark.createDataFrame([(1, "s", "a", None), (2, "s", "b", 1)], schema)
    then = GM.Snapshot(sources=spark.createDataFrame([(1, "s", "a", None), (9, "s", "b", 1)], schema))
    r = spark.createDataFrame([(1, "s", "a", None), (2, "s", "b", 1), (3, "s", "b", None)], "ordinal long, source_kind string, external_id string, external_version long")
    got = {x.ordinal: (x.source_ref_id, x.source_fault) for x in GM.resolve_sources(r, now, then).collect()}
    assert got == {1: (1, None), 2: (2, "snapshot_drift"), 3: (None, "missing_source")}
    bare = spark.createDataFrame([("c", 1)], "id string, revision long")
    none = spark.createDataFrame([], "concept_id string, alias_key string")
    assert GM.concept_drift(bare, none, GM.Snapshot(concepts=bare, aliases=none)).count() == 0
