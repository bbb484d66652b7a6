from __future__ import annotations

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lodegraph.operators.hierarchy import cycle_members, descendants, latest_rows, resolve_hierarchy
from tests.conftest import rows

SCHEMA = "id long, parent long, name string, extra string"


def brute(parents: dict):
    out = {}
    for i in parents:
        seen, x = [i], parents[i]
        while x is not None and x in parents and x not in seen:
            seen.append(x)
            x = parents[x]
        out[i] = (-1, -1) if x in seen else (seen[-1], len(seen) - 1)
    return out


def resolved(spark, parents, **kw):
    df = spark.createDataFrame([(i, p, f"n{i}", "x") for i, p in parents.items()], SCHEMA)
    return resolve_hierarchy(df, "id", "parent", "name", **kw)


@pytest.mark.parametrize("split", [1, 2, 8, 1000])
def test_chain_forest_and_cycles(spark, split):
    parents = {i: i - 1 for i in range(1, 60)} | {0: None, 100: 999}
    parents |= {200: 201, 201: 202, 202: 200, 203: 200, 204: 203, 300: 300, 301: 300}
    got = {r.id: (r.root_id, r.depth) for r in resolved(spark, parents, split_every=split).collect()}
    assert got == brute(parents)


def test_paths_names_and_descendants(spark):
    r = resolved(spark, {1: None, 2: 1, 3: 2, 4: 2, 5: 5})
    paths = {x.id: x.path for x in r.collect()}
    assert paths == {1: "n1", 2: "n1.n2", 3: "n1.n2.n3", 4: "n1.n2.n4", 5: None}
    assert rows(descendants(r)) == [(1, 2, 1), (1, 3, 2), (1, 4, 2), (2, 3, 1), (2, 4, 1)]


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([(None, 1, "a", "x"), (1, None, None, "x"), (2, 1, "b", "x")], SCHEMA)
    got = {r.id: r.path for r in resolve_hierarchy(df, "id", "parent", "name").collect()}
    assert got == {1: "", 2: ".b"}
    assert resolve_hierarchy(df.limit(0), "id", "parent", "name").count() == 0


def test_latest_rows_takes_the_newest_and_breaks_ties(spark):
    df = spark.createDataFrame([(1, 5, "old"), (1, 7, "new"), (1, 7, "zzz"), (None, 9, "x"), (2, None, "only")], "id long, at long, name string")
    assert rows(latest_rows(df, "id", "at", ["name"])) == [(1, "zzz"), (2, "only")]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10**6))
def test_random_forests(spark, seed):
    rng = random.Random(seed)
    n = rng.randint(1, 60)
    parents = {i: rng.choice([None, *range(n + 3)]) for i in range(n)}
    got = {r.id: (r.root_id, r.depth) for r in resolved(spark, parents, split_every=rng.choice([1, 3, 8])).collect()}
    assert got == brute(parents)


def cyclic(edges):
    adj = {}
    for a, b in edges:
        if a is not None and b is not None:
            adj.setdefault(a, set()).add(b)
    out = set()
    for a in adj:
        stack, seen = list(adj[a]), set()
        while stack:
            x = stack.pop()
            if x not in seen:
                seen.add(x)
                stack += adj.get(x, ())
        if a in seen:
            out.add(a)
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_cycle_members(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(25), rng.randrange(25)) for _ in range(rng.randrange(10, 45))] + [(None, 3), (3, None), (40, 40), (1, 2), (1, 2)]
    df = spark.createDataFrame([(a, b, 0) for a, b in edges], "child long, base long, id long")
    assert [r[0] for r in rows(cycle_members(df, "child", "base"))] == cyclic(edges)


def test_no_cycles_and_no_edges(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (1, 3)], "a long, b long")
    assert cycle_members(df, "a", "b").count() == 0
    assert cycle_members(df.limit(0), "a", "b").count() == 0


@pytest.mark.parametrize("split", [1, 3, 1000])
def test_roots_and_depths_without_paths(spark, split):
    parents = {i: i - 1 for i in range(1, 300)} | {0: None, 400: 999} | {i: i % 150 for i in range(500, 700)}
    parents |= {1000 + i: 1000 + (i + 1) % 90 for i in range(90)} | {1200: 1005, 1201: 1200, 1300: 1300, 1301: 1300}
    df = spark.createDataFrame([(i, p) for i, p in parents.items()], "id long, parent long")
    got = resolve_hierarchy(df, "id", "parent", None, split_every=split, paths=False)
    assert {r.id: (r.root_id, r.depth) for r in got.collect()} == brute(parents)


@pytest.mark.parametrize("seed", range(3))
def test_cycles_found_by_rounds(spark, seed):
    """Without a small core: rings, chains between cycles, and dense parts."""
    rng = random.Random(seed)
    edges = [(rng.randrange(30), rng.randrange(30)) for _ in range(rng.randrange(20, 60))]
    edges += [(100 + i, 100 + (i + 1) % 7) for i in range(7)] + [(200 + i, 201 + i) for i in range(9)] + [(209, 3), (5, 200), (300, 301), (301, 300), (300, 310), (310, 311), (311, 301), (400, 401), (401, 402), (402, 400), (400, 403), (403, 400)]
    df = spark.createDataFrame(edges, "child long, base long")
    assert [r[0] for r in rows(cycle_members(df, "child", "base", small=0))] == cyclic(edges)


def test_long_rings_and_tails_take_few_rounds(spark):
    n = 20_000
    ring = spark.range(n).selectExpr("id AS child", f"(id + 1) % {n} AS base")
    tail = spark.range(n).selectExpr(f"id + {n} AS child", f"IF(id = 0, 0, id + {n} - 1) AS base")
    from lodegraph import storage

    before = sum(map(len, storage._WRITTEN.values()))
    found = cycle_members(ring.union(tail), "child", "base", small=10)
    assert found.count() == n and found.filter(f"id >= {n}").count() == 0
    assert sum(map(len, storage._WRITTEN.values())) - before < 60
