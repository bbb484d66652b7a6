"""Cases that once gave wrong answers or lost data."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodegraph import storage
from lodegraph.functions import paths as P
from lodegraph.functions import spans as S
from lodegraph.operators import chunking as C
from lodegraph.operators import graph as G
from lodegraph.operators import linking as L
from lodegraph.operators import retrieval as R
from tests.conftest import rows


def test_windows_hold_their_endpoint(spark):
    raw = b"x" * 3000
    assert S.aligned_window(raw, 1000, 1050, 100, 200) == (975, 1075, False, True)
    assert S.aligned_window(raw, 1000, 1050, 500, 200) == (800, 1250, False, False)
    assert S.aligned_window(raw, 10, 400, 100, 50) == (10, 110, True, True)
    df = spark.createDataFrame([(bytearray(raw), 1000, 1050), (bytearray(raw), 5, 4), (bytearray(raw), 0, 3001), (bytearray(b"\xff" * 9), 0, 3), (None, 0, 0), (bytearray("aé€z".encode()), 1, 3)], "c binary, a int, b int")
    got = [r[0] for r in df.select(S.source_window("c", "a", "b", 100, 200)).collect()]
    assert (got[0].start_byte, got[0].end_byte, len(got[0].text)) == (975, 1075, 100)
    assert [g.text for g in got[1:5]] == [None] * 4 and got[5].text == "aé€z"


def test_neighborhoods_tell_of_nodes_without_room(spark):
    nodes = spark.createDataFrame([(c,) for c in "abc"], "node string")
    e = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    held, _, cut = G.neighborhood(nodes, e, "a", hops=2, max_nodes=2)
    assert rows(held) == [("a",), ("b",)] and cut
    assert G.neighborhood(nodes, e, "a", hops=2, max_nodes=3)[2] is False
    assert G.neighborhood(nodes, e, "a", hops=0, max_nodes=1)[2] is False
    with pytest.raises(ValueError):
        G.neighborhood(nodes, e, "nowhere")


def test_parts_are_not_lost_to_a_cap(spark):
    anchors = spark.createDataFrame([(1, "head", "body")], "anchor_def_id long, header string, body string")
    big = " ".join(["w"] * 5000)
    parts = [(1, 0, i, [big]) for i in range(5)] + [(1, 1, 0, ["small part", "s"])] + [(1, 2, i, ["a b c"]) for i in range(3000)]
    df = spark.createDataFrame(parts, "anchor_def_id long, priority int, position int, texts array<string>")
    got = C.assemble_function_chunks(anchors, df, cap=5000).first().content.split("\n\n")
    want = C.pack_pieces(2, [p[3] for p in sorted(parts, key=lambda p: p[1:3])], C.BUDGETS["function"])
    assert got == ["head", "body", *want] and got[2] == "small part" and len(got) > 100
    lopsided = [(1, 0, i, [" ".join(["w"] * (1 + (i * 37) % 600)), "x"] if i % 3 else [" ".join(["v"] * (1 + (i * 53) % 400))]) for i in range(400)]
    df = spark.createDataFrame(lopsided, "anchor_def_id long, priority int, position int, texts array<string>")
    assert C.assemble_function_chunks(anchors, df).first().content.split("\n\n")[2:] == C.pack_pieces(2, [p[3] for p in lopsided], C.BUDGETS["function"])


def test_the_first_piece_of_a_section_pays_no_join():
    count = lambda t: len(t.split())
    assert C.pack_section(0, "h", ["a b", "c"], 4, count) == ["h", "a b"]
    assert C.pack_section(0, "h", ["a b", "c"], 6, count) == ["h", "a b", "c"] and C.pack_section(0, "h", ["a b"], 3, count) == []


def test_unknown_repositories_are_none():
    rows_ = [(1.0, None, 1), (0.99, 7, 1), (0.98, None, 1)]
    assert R.mmr_order(rows_, 2, 0.5, 0.5) == [0, 1]


def test_long_chains_of_classes(spark):
    edges = [(i, i + 1, f"c{i}", 0) for i in range(200)]
    df = spark.createDataFrame(edges, "child_def_id long, base_def_id long, base_name string, ord int")
    got = G.linearize(df).filter("def_id IN (0, 100)")
    assert rows(got.filter("def_id = 0"), "position", "ancestor_id") == [(i, i) for i in range(1, 201)]
    assert got.filter("def_id = 100").count() == 100


def test_packages_link_without_pairs(spark):
    files = spark.createDataFrame([(1, 9, "p/a.go"), (2, 9, "p/b.go"), (3, 9, "q/c.go")], "file_version_id long, branch_id long, path string")
    defs = spark.createDataFrame([(11, 1, "f", None), (12, 2, "g", None), (13, 1, "twice", None), (14, 2, "twice", None), (15, 3, "far", None)], "def_id long, file_version_id long, name string, scope_id long")
    refs = spark.createDataFrame([(1, 2, "f", None), (2, 2, "twice", None), (3, 2, "far", None), (4, 1, "g", 99)], "ref_id long, file_version_id long, name string, target_def_id long")
    members = L.packages(files)
    assert rows(members, "package", "file_version_id") == [("p", 1), ("p", 2), ("q", 3)]
    assert {tuple(r) for r in L.link_in_package(refs, members, defs).collect()} == {(1, 11), (2, None), (3, None), (4, 99)}


def test_paths_of_imports(spark):
    assert P.normalize_relative("a/b", "../c/./d") == "a/c/d" and P.normalize_relative("", "../../x") == "x" and P.normalize_relative("a", "..") == ""
    df = spark.createDataFrame([("@s/p/q",), ("lodash/fp",), ("@only",), ("x",)], "s string")
    assert [r[0] for r in df.select(P.package_name("s")).collect()] == [P.package_of_specifier(s) for s in ("@s/p/q", "lodash/fp", "@only", "x")] == ["@s/p", "lodash", "@only", "x"]
    listed = spark.createDataFrame([("a/b",)], "p string").select(P.node_paths("p")).first()[0]
    assert [x.path for x in sorted(listed)] == P.node_candidates("a/b") and len(listed) == 13


def test_no_local_folder_on_a_cluster():
    class Context:
        master, applicationId = "spark://host:7077", "app-never"

    class Conf:
        @staticmethod
        def get(name, default=None):
            return default

    class Session:
        sparkContext, conf = Context, Conf

    with pytest.raises(RuntimeError):
        storage.scratch_root(Session)


def test_fused_ranks_need_no_single_task(spark):
    a = spark.createDataFrame([(i, float(i % 5)) for i in range(20)], "chunk_id long, score double")
    b = spark.createDataFrame([(i, float(-i)) for i in range(10, 30)], "chunk_id long, score double")
    place = lambda df: {r.chunk_id: n for n, r in enumerate(sorted(df.collect(), key=lambda r: (-r.score, r.chunk_id)), 1)}
    want: dict[int, float] = {}
    for c in (a, b):
        for k, n in place(c).items():
            want[k] = want.get(k, 0) + R.RRF_WEIGHT / (R.RRF_K + n)
    got = {r.chunk_id: r.score for r in R.fuse_scores([a, b]).collect()}
    assert got == pytest.approx({k: v / max(want.values()) for k, v in want.items()})
    assert R.fuse_scores([a.limit(0), b.limit(0)]).count() == 0 and F.lit(1) is not None
