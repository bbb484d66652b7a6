from __future__ import annotations

import pytest

from lodegraph.engine import Engine
from lodegraph.operators.candidates import rerank
from tests.conftest import rows


@pytest.fixture(scope="module")
def engine(spark):
    df = spark.createDataFrame
    defs = [(i, n, f"m.{n}", "function", "python", f"src/{n}.py", None, b, 100 + i, 0, 5) for i, n, b in [(1, "main", 1), (2, "load", 1), (3, "store", 1), (4, "other", 2)]]
    return Engine(
        {
            "definitions": df(defs, "def_id long, name string, qualified_name string, kind string, language string, file_path string, visibility string, branch_id int, file_version_id long, start_byte int, end_byte int"),
            "calls": df([(1, 2, "certain", 1), (2, 3, "inferred", 1), (3, None, "uncertain", 1), (4, 1, "certain", 2)], "src long, dst long, confidence string, branch_id int"),
            "accesses": df([(2, 3, "write", 1), (1, 3, "read", 1)], "accessor_def_id long, target_def_id long, access_type string, branch_id int"),
            "inherits": df([(2, 3, "m.store", 0, "certain", 1)], "child_def_id long, base_def_id long, base_name string, ord int, confidence string, branch_id int"),
            "overrides": df([(3, 9, 1)], "child_def_id long, base_def_id long, branch_id int"),
            "imports": df([(101, 102, "load", "intra_repo", 1), (101, None, "os", "external", 1)], "file_version_id long, resolved_file_version_id long, import_path string, dep_class string, branch_id int"),
            "files": df([(101, "src/main.py", 1), (102, "src/load.py", 1), (103, "src/store.py", 1), (104, "src/other.py", 2)], "file_version_id long, path string, branch_id int"),
            "versions": df([(i, f"é{i}xyz") for i in (101, 102, 103, 104, 999)], "file_version_id long, raw_content string"),
            "chunks": df([(i, 1, 100 + i, i, "function", t, 3, f"h{i}", 1) for i, t in [(1, "main ledger"), (2, "load ledgerRow"), (3, "store")]], "chunk_id long, branch_id int, file_version_id long, anchor_def_id long, granularity string, content string, token_count long, content_hash string, repo_id long"),
            "embeddings": df([("h1", [1.0, 0.0]), ("h2", [0.0, 1.0]), ("gone", [1.0, 1.0])], "content_hash string, embedding array<float>"),
            "branches": df([(1, 1), (1, 2)], "repo_id long, branch_id int"),
        },
        branches=1,
    )


def test_graph_questions(engine):
    assert rows(engine.resolve("main"), "def_id") == [(1,)] and engine.resolve("other").count() == 0
    assert rows(engine.within([1, 2]).callers_of("main"), "def_id") == [(4,)] and engine.callers_of("main").count() == 0
    assert rows(engine.reachable("main"), "def_id", "depth") == [(2, 1), (3, 2)]
    assert rows(engine.ancestors("store"), "def_id", "depth") == [(1, 2), (2, 1)]
    assert [list(r.path) for r in engine.paths("main", "store").collect()] == [[1, 2, 3]] and engine.is_reachable("main", "store")
    assert rows(engine.entrypoints(), "def_id") == [(1,)] and [list(r.path) for r in engine.entrypoint_paths("store").collect()] == [[1, 2, 3]]
    assert rows(engine.writers_of("store"), "def_id") == [(2,)] and rows(engine.readers_of("store"), "def_id") == [(1,)]
    assert [list(r.path) for r in engine.taint_paths("load", "main", ["other"]).collect()] == [[2, 3, 1]]
    assert rows(engine.inheritance("load"), "def_id") == [(2,), (3,)]
    with pytest.raises(KeyError):
        engine.table("nothing")


def test_files(engine):
    assert rows(engine.definitions_in_file("load.py"), "def_id") == [(2,)]
    assert rows(engine.source("main"), "source") == [("é101",)]
    assert rows(engine.file_source("main.py"), "raw_content") == [("é101xyz",)]
    assert rows(engine.imports("main.py", "intra_repo"), "resolved_path") == [("src/load.py",)]
    assert rows(engine.dependents("load.py")) == [("src/main.py",)]


def test_retrieval_and_administration(engine):
    assert [r.chunk_id for r in engine.semantic([1.0, 0.0]).collect()] == [1, 2]
    assert rows(engine.lexical("ledger"), "chunk_id") == [(1,), (2,)]
    assert rows(engine.structural("main"), "chunk_id", "score") == [(1, 1.0), (2, 0.5), (3, 0.25)]
    found = [r.chunk_id for r in engine.hybrid("ledger", [1.0, 0.0], top_k=3).orderBy("position").collect()]
    assert found[0] == 2 and set(found) == {1, 2, 3}  # equal in both channels, and called by the other
    assert engine.context("ledger", [1.0, 0.0], 6).first().n_chunks == 2
    assert rows(engine.within([1, 2]).branches(), "branch_id", "n_files") == [(1, 3), (2, 1)]
    assert rows(engine.garbage()["versions"], "file_version_id") == [(999,)] and rows(engine.garbage()["embeddings"], "content_hash") == [("gone",)]
    d = engine.diagnose()
    assert d["calls"].first()[:] == (3, 2, 66) and d["top_callers"].count() == 3


def test_rerank(spark):
    data = [("s", f"t{i}", i, "query", "x" * (i % 3)) for i in range(1, 6)]
    df = spark.createDataFrame(data, "source string, target string, rank int, source_text string, target_text string")
    got = rerank(df, lambda q, ts: [len(t) for t in ts], keep=3)
    assert rows(got, "position", "target") == [(1, "t2"), (2, "t5"), (3, "t1")]
    with pytest.raises(Exception, match="finite"):
        rerank(df, lambda q, ts: [True] * len(ts)).collect()
