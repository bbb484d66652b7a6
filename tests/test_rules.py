"""Rules that must be empty, with planted violations; links, pointers and chunk builders."""

from __future__ import annotations

import pytest

from lodegraph.operators import chunking as C
from lodegraph.operators import connections as X
from lodegraph.operators import retrieval as R
from tests.conftest import rows


def test_decisions_and_endpoints(spark):
    connections = spark.createDataFrame([(1, "a", "b", None), (2, "a", "b", None), (3, "a", "z", None), (4, "a", None, "r"), (9, "a", "b", None)], "decision_id long, source_site_id string, target_site_id string, target_resource_id string")
    decisions = spark.createDataFrame([(1, "supported", 10), (2, "ambiguous", 10), (3, "supported", 10), (4, "supported", 10)], "decision_id long, outcome string, candidate_id long")
    evidence = spark.createDataFrame([(1, 1, "support"), (2, 2, "support"), (3, 3, "context"), (4, 4, "support")], "decision_id long, evidence_id long, role string")
    candidates = spark.createDataFrame([(10, "a", "b")], "candidate_id long, source_site_id string, target_site_id string")
    assert rows(X.broken_decisions(connections, decisions, evidence)) == [(2,), (3,), (9,)]
    assert rows(X.broken_endpoints(connections, decisions, candidates), "decision_id") == [(3,), (9,)]
    assert rows(X.lonely_resources(connections)) == [(4, "r", 1)]
    shared = spark.createDataFrame([(4, "a", None, "r"), (4, "b", None, "r"), (4, "b", None, "r")], connections.schema)
    assert X.lonely_resources(shared).count() == 0


def test_embeddings_of_one_space(spark):
    chunks = spark.createDataFrame([(1, "h1", "function", "go"), (2, "h2", "module", "go"), (3, "h2", "function", "python")], "chunk_id long, content_hash string, granularity string, language string")
    vectors = spark.createDataFrame([("h1", [1.0, 0.0], "m", "1", 2, "r"), ("h2", [1.0, 0.0], "m", "1", 2, "r"), ("h1", [0.0, 1.0], "m", "2", 2, "r")], "content_hash string, embedding array<float>, model_name string, model_version string, dimensions int, representation_version string")
    space = {"model_name": "m", "model_version": "2", "dimensions": 2, "representation_version": "r"}
    ids = lambda **f: [(r.chunk_id, r.score) for r in R.semantic_query(chunks, vectors, [1.0, 0.0], **f).collect()]
    assert ids(identity=space) == [(1, 0.0)] and ids(identity=space | {"model_version": "1"}) == [(1, 1.0), (2, 1.0), (3, 1.0)]
    assert ids(identity=space | {"model_version": "1"}, granularities=["function"], languages=["python"]) == [(3, 1.0)] and ids(granularities=[]) == []
    with pytest.raises(ValueError):
        ids(identity={"model_name": "m"})


def test_snapshots(spark):
    snapshots = spark.createDataFrame([("s", "2024"), ("t", "2024"), ("u", None), ("e", "2024")], "snapshot_id string, sealed_at string")
    members = spark.createDataFrame([("s", 1, "a" * 40), ("s", 2, "b" * 64), ("t", 1, "main"), ("u", 1, "x")], "snapshot_id string, repo_id long, revision string")
    assert rows(X.broken_members(snapshots, members)) == [("e", "repositories"), ("t", "repositories"), ("t", "revision")]
    assert rows(X.changed_after_seal(snapshots, snapshots.filter("snapshot_id <> 't'"))) == [("t",)] and X.changed_after_seal(snapshots, snapshots).count() == 0
    files = spark.createDataFrame([(1, "p", "h1", "100644"), (1, "q", "h2", "100644"), (1, "m", "h3", "160000")], "repo_id long, path string, content_hash string, mode string")
    blobs = spark.createDataFrame([("h1",)], "content_hash string")
    assert rows(X.missing_blobs(files, blobs), "path") == [("q",)]
    now = spark.createDataFrame([(1, "p", "h1"), (1, "q", "other")], "repo_id long, path string, content_hash string")
    assert rows(X.drifted_files(files, now), "path") == [("m",), ("q",)]


def test_candidate_sets(spark):
    sets = spark.createDataFrame([(1, "a", 2), (1, "b", 0), (1, "c", 1)], "run_id long, source_site_id string, candidate_count int")
    matches = spark.createDataFrame([(1, "a", "x"), (1, "a", "y"), (1, "d", "z")], "run_id long, source_site_id string, target_site_id string")
    assert rows(X.unmatched_sources(matches, sets)) == [(1, "c", 1, 0), (1, "d", 0, 1)]
    assert rows(X.run_totals(sets)) == [(1, 3, 3)] and X.run_totals(sets.limit(0)).count() == 0


def test_parser_links_name_known_places(spark):
    place = "struct<repo_id:long,path:string,content_hash:string,start_byte:int,end_byte:int>"
    calls = spark.createDataFrame([(1, "certain", (1, "a.py", "h", 5, 9), (1, "a.py", "h", 0, 20), (1, "b.py", "g", 0, 8)), (2, "inferred", (1, "a.py", "h", 30, 34), None, (1, "b.py", "g", 0, 8))], f"edge_id long, confidence string, call {place}, caller {place}, callee {place}")
    sites = spark.createDataFrame([("site-b", 1, "b.py", "g", 0, 8, "definition")], "site_id string, repo_id long, path string, content_hash string, start_byte int, end_byte int, kind string")
    got = X.parser_links(calls, sites).collect()
    assert sorted((r.edge_id, r.verb) for r in got) == [(1, "CALLS"), (1, "HAS_CALL"), (2, "CALLS")]
    assert {r.target for r in got if r.verb == "CALLS"} == {"site-b"} and all(r.source.startswith("place:") for r in got)


def test_active_graphs_and_components(spark, tmp_path):
    edges = spark.createDataFrame([("a", "b")], "source string, target string")
    root = str(tmp_path)
    one, two = X.publish(edges, root), X.publish(edges.union(edges), root)
    X.activate(spark, root, "s", one)
    X.activate(spark, root, "s", two)
    assert X.active_graph(spark, root, "s").count() == 2
    with pytest.raises(ValueError):
        X.active_graph(spark, root, "t")
    membership = spark.createDataFrame([("n1", "c1"), ("n2", "c2"), ("n3", "c3")], "node string, component string")
    between = spark.createDataFrame([("c1", "c2", "READS"), ("c2", "c3", "READS")], "source string, target string, verb string")
    held, inside, cut = X.component_neighborhood(membership, between, "c1", hops=1)
    assert rows(held) == [("c1",), ("c2",)] and rows(inside, "src", "dst", "verb") == [("c1", "c2", "READS")] and not cut


def test_module_chunks(spark):
    modules = spark.createDataFrame([(1, 7, "pkg.m", "pkg/m.py"), (2, 8, "pkg.n", "pkg/n.py")], "anchor_def_id long, file_version_id long, qualified_name string, file_path string")
    children = spark.createDataFrame([(1, 0, "def f():\n  return 1", "def f()"), (1, 1, " ".join(["w"] * 3000), "def g()")], "anchor_def_id long, position int, body string, signature string")
    imports = spark.createDataFrame([(7, "external", "os.path", "os"), (7, "intra_repo", "pkg.a", None), (7, "unresolved", "zz", None)], "file_version_id long, dep_class string, import_path string, package_name string")
    got = {r.anchor_def_id: r for r in C.assemble_module_chunks(modules, children, imports).collect()}
    assert got[1].content == "# imports\nintra_repo: pkg.a\nexternal: os\nunresolved: zz\n\n# module: pkg.m (pkg/m.py)\n\ndef f():\n  return 1\n\ndef g()"
    assert got[2].content.strip() == "# module: pkg.n (pkg/n.py)" and got[1].token_count == C.count_words(got[1].content)


def test_cross_module_chunks(spark):
    defs = spark.createDataFrame([(i, f"m.f{i}", "function", f"def f{i}():\n  body{i}", f"def f{i}()") for i in range(1, 6)] + [(9, "m.DATA", "variable", "DATA = 1", "DATA")], "def_id long, qualified_name string, kind string, body string, signature string")
    calls = spark.createDataFrame([(1, 2), (1, 2), (2, 3), (2, 1), (4, None), (3, 5)], "src long, dst long")
    accesses = spark.createDataFrame([(3, 9, "read"), (3, 9, "write")], "accessor_def_id long, target_def_id long, access_type string")
    anchors = spark.createDataFrame([(1,), (4,), (5,)], "anchor_def_id long")
    got = {r.anchor_def_id: r for r in C.assemble_cross_module_chunks(anchors, calls, accesses, defs).collect()}
    assert set(got) == {1}
    assert got[1].content == "# anchor: m.f1 [function]\ndef f1():\n\n# shared state\n- write: m.DATA\n\n# callees (1 hop)\n# callee (1 hop): m.f2\ndef f2():\n  body2\n\n# callees (2 hop)\ndef f3()"
    few = {r.anchor_def_id: r.content for r in C.assemble_cross_module_chunks(anchors, calls, accesses, defs, budget=30).collect()}
    assert few[1] == "# anchor: m.f1 [function]\ndef f1():\n\n# shared state\n- write: m.DATA"
