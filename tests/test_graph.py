from __future__ import annotations

import inspect
import random

import pytest

from lodegraph.operators import graph as G
from tests.conftest import rows


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, "certain") for a, b in pairs], "src long, dst long, confidence string")


def ids(spark, *xs):
    return spark.createDataFrame([(x,) for x in xs], "def_id long")


def defs(spark, names):
    return spark.createDataFrame(
        [(i, n, f"m.{n}", "function", "python", "src/a.py", None, 1) for i, n in names.items()],
        "def_id long, name string, qualified_name string, kind string, language string, file_path string, visibility string, branch_id int",
    )


def test_seed_to_seed_is_at_depth_one(spark):
    assert rows(G.walk(edges(spark, [(1, 2), (1, 3), (3, 4)]), ids(spark, 1, 2))) == [(2, 1), (3, 1), (4, 2)]


def test_cycles_end_with_least_depth(spark):
    assert rows(G.walk(edges(spark, [(1, 2), (2, 3), (3, 2), (3, 1)]), ids(spark, 1))) == [(2, 1), (3, 2)]
    assert rows(G.walk(edges(spark, [(1, 2), (2, 3)]), ids(spark, 1), max_depth=0)) == [(2, 1)]
    assert rows(G.walk(edges(spark, [(1, 2), (2, 3)]), ids(spark, 3), backward=True)) == [(1, 2), (2, 1)]


def brute_paths(pairs, src, dst, depth):
    out, level = [], [[a, b] for a, b in sorted(set(pairs)) if a in src]
    while level:
        out += [p for p in level if p[-1] in dst]
        level = [[*p, b] for p in level if p[0] != p[-1] and len(p) < depth for a, b in sorted(set(pairs)) if a == p[-1] and b not in p]
    return sorted(out, key=lambda p: (len(p), p))


@pytest.mark.parametrize("seed", range(3))
def test_simple_paths(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(7), rng.randrange(7)) for _ in range(16)] + [(0, 0)]
    got = [list(r.path) for r in G.simple_paths(edges(spark, pairs), ids(spark, 0, 1), ids(spark, 0, 5), max_depth=5, max_paths=1000).collect()]
    assert got == brute_paths(pairs, {0, 1}, {0, 5}, 5)


def test_paths_of_any_length(spark):
    chain = [(i, i + 1) for i in range(12)] + [(0, 20), (20, 0), (3, 30)]
    assert [list(r.path) for r in G.simple_paths(edges(spark, chain), ids(spark, 0), ids(spark, 12), max_depth=None).collect()] == [list(range(13))]
    rng = random.Random(9)
    pairs = [(rng.randrange(7), rng.randrange(7)) for _ in range(14)]
    for targets, most in (({5}, 1000), ({4, 5}, 1000), ({4, 5}, 3)):
        got = [list(r.path) for r in G.simple_paths(edges(spark, pairs), ids(spark, 0, 1), ids(spark, *targets), max_depth=None, max_paths=most).collect()]
        assert got == brute_paths(pairs, {0, 1}, targets, 99)[:most]


def test_whole_path_queries_have_no_depth(spark, sf_dir):
    import __spark_entry__ as entry
    from lodegraph.plans import bridge

    found = {(r.src, r.dst) for r in bridge.calls(spark, sf_dir).filter("dst IS NOT NULL").collect()}
    got = [tuple(map(int, r.path.split(">"))) for r in entry.queries()["g_paths_whole"](spark, sf_dir).collect()]
    after = {}
    for a, b in found:
        after.setdefault(a, set()).add(b)
    level, want = [(1,)], []
    while level and len(want) < 50:
        level = [(*p, b) for p in level if p[-1] != 2 for b in after.get(p[-1], ()) if b not in p]
        want += sorted(p for p in level if p[-1] == 2)
    assert got == want[:50]


def test_parallel_edges(spark):
    e = edges(spark, [(1, 2), (1, 2), (2, 3), (2, 3)])
    assert G.simple_paths(e, ids(spark, 1), ids(spark, 3)).count() == 1
    assert G.simple_paths(e, ids(spark, 1), ids(spark, 3), multiplicity=True).count() == 4
    assert G.simple_paths(e, ids(spark, 1), ids(spark, 3), multiplicity=True, max_paths=3).count() == 3


def test_reachable(spark):
    e = edges(spark, [(1, 2), (2, 3), (3, 1), (5, 5)])
    assert G.is_reachable(e, ids(spark, 1), ids(spark, 3))
    assert not G.is_reachable(e, ids(spark, 1), ids(spark, 3), max_depth=2)
    assert not G.is_reachable(e, ids(spark, 1), ids(spark, 1))
    assert G.is_reachable(e, ids(spark, 5), ids(spark, 5))
    assert not G.is_reachable(e, ids(spark, 9), ids(spark, 1))


def test_names_are_patterns_unless_escaped(spark):
    d = defs(spark, {1: "double_it", 2: "doubleXit", 3: "other"})
    assert rows(G.resolve(d, "double_it"), "def_id") == [(1,), (2,)]
    assert rows(G.resolve(d, "double_it", escape=True), "def_id") == [(1,)]
    assert rows(G.resolve(d, "m.other"), "def_id") == [(3,)]


def test_hops_and_branches(spark):
    d, e = defs(spark, {1: "a", 2: "b", 3: "c"}), edges(spark, [(1, 2), (3, 2), (2, None)])
    assert rows(G.callers_of(e, d, "b"), "def_id") == [(1,), (3,)]
    assert rows(G.callees_of(e, d, "a"), "def_id") == [(2,)]
    assert G.callers_of(e, d, "b", confidence="inferred").count() == 0
    assert G.callees_of(e, d, "a", languages=["go"]).count() == 0
    assert G.in_branches(d, []).count() == 0 and G.in_branches(d, 1).count() == 3


def test_taint_stops_at_sanitizers(spark):
    calls = edges(spark, [(1, 2), (2, 9)])
    acc = spark.createDataFrame([(1, 5, "write"), (9, 5, "read"), (1, 6, "readwrite"), (9, 6, "readwrite")], "accessor_def_id long, target_def_id long, access_type string")
    got = [list(r.path) for r in G.taint_paths(calls, acc, ids(spark, 1), ids(spark, 9), ids(spark, 2)).collect()]
    assert got == [[1, 5, 9], [1, 6, 9]]


def test_entrypoints(spark):
    d = defs(spark, {1: "main", 2: "helper", 3: "overrider"})
    over = spark.createDataFrame([(3, 7)], "child_def_id long, base_def_id long")
    e = edges(spark, [(1, 2)])
    entries = G.entrypoints(d, e, over)
    assert rows(entries, "def_id") == [(1,)]
    assert rows(G.entrypoints_reaching(e, d, entries, "helper"), "def_id", "depth") == [(1, 1)]
    assert [list(r.path) for r in G.entrypoint_paths(e, d, entries, "helper").collect()] == [[1, 2]]


def inherits(spark, triples):
    return spark.createDataFrame([(c, b, f"m.{b}", o) for c, b, o in triples], "child_def_id long, base_def_id long, base_name string, ord int")


def test_linearize_closest_first(spark):
    got = rows(G.linearize(inherits(spark, [(1, 3, 0), (1, 2, 1), (2, 4, 0), (3, 5, 0), (4, 1, 0)])).filter("def_id = 1"), "position", "ancestor_id")
    assert got == [(1, 3), (2, 2), (3, 5), (4, 4)]


def test_overrides_take_the_nearest(spark):
    d = spark.createDataFrame([(11, 1, "f", "method"), (12, 2, "f", "method"), (13, 3, "f", "method"), (14, 1, "g", "function")], "def_id long, scope_id long, name string, kind string")
    assert rows(G.override_edges(inherits(spark, [(1, 2, 0), (2, 3, 0)]), d)) == [(11, 12), (12, 13)]


def test_tree_holds_siblings(spark):
    d = defs(spark, {1: "a", 2: "b", 3: "c", 4: "far"})
    tree = {r.def_id: (r.bases, r.children) for r in G.inheritance_tree(inherits(spark, [(1, 3, 0), (2, 3, 0)]), d, "a").collect()}
    assert tree == {1: (["m.c"], []), 2: (["m.c"], []), 3: ([], ["m.a", "m.b"])}
    assert [r.def_id for r in G.inheritance_tree(inherits(spark, [(1, 3, 0)]), d, "far").collect()] == [4]


def test_neighborhood_is_cut_in_order(spark):
    nodes = spark.createDataFrame([(c,) for c in "abcde"], "node string")
    e = spark.createDataFrame([("a", "b"), ("a", "c"), ("c", "d"), ("e", "a")], "src string, dst string")
    held, inside, cut = G.neighborhood(nodes, e, "a", hops=1, max_nodes=3)
    assert rows(held) == [("a",), ("b",), ("c",)] and cut and inside.count() == 2
    held, _, cut = G.neighborhood(nodes, e, "a", hops=2, direction="out")
    assert rows(held) == [("a",), ("b",), ("c",), ("d",)] and not cut
    with pytest.raises(ValueError):
        G.neighborhood(nodes, e, "a", hops=11)


def test_ancestors_have_no_bound_of_depth(spark):
    assert inspect.signature(G.linearize).parameters["max_depth"].default is None
    # a cycle below the chain ends too
    chain = spark.createDataFrame([(0, 1, "c1", 0), (1, 2, "c2", 0), (2, 3, "c3", 0), (3, 1, "c1", 0)], "child_def_id long, base_def_id long, base_name string, ord int")
    assert rows(G.linearize(chain).filter("def_id = 0"), "ancestor_id", "position") == [(1, 1), (2, 2), (3, 3)]
