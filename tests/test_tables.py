from __future__ import annotations

import hashlib
import subprocess

import pytest
from pyspark.sql import functions as F

from lodegraph.operators import admin, chunking, connections, frames, linking
from lodegraph.operators.joins import join_few_keys
from lodegraph.operators.ranks import distributed_row_number
from lodegraph.sources import repository, sinks
from lodegraph.streaming import events
from tests.conftest import rows


def test_row_numbers_of_a_hot_group(spark):
    df = spark.range(3000).selectExpr("id", "case when id % 3 = 0 then 'hot' else concat('g', id % 7) end g", "(id * 7919) % 1000 s")
    got = distributed_row_number(df, ["g"], [F.desc("s"), F.col("id")])
    want = df.selectExpr("id", "row_number() over (partition by g order by s desc, id) r")
    assert rows(got, "id", "rank") == rows(want)


@pytest.mark.parametrize("row_bytes", [1, 1 << 30])
def test_join_few_keys(spark, row_bytes):
    df = spark.createDataFrame([(1, 10), (1, 11), (None, 12), (3, 13)], "k long, item long")
    small = spark.createDataFrame([(1, "a"), (None, "n")], "k long, v string")
    assert rows(join_few_keys(df, small, "k", row_bytes, "item"), "item", "v") == [(10, "a"), (11, "a"), (12, "n")]


def test_frames(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 5, "c")], "k long, o long, v string")
    assert rows(frames.distinct_on(df, ["k"], [F.col("o")]), "k", "v") == [(1, "a"), (2, "c")]
    assert rows(frames.top_per(df, ["k"], [F.desc("o")], 1), "v") == [("b",), ("c",)]
    assert rows(frames.repeated_keys(df, ["k"])) == [(1, 2)]
    assert rows(frames.keep_latest(df, spark.createDataFrame([(1, 9, "new")], df.schema), ["k"]), "v") == [("c",), ("new",)]
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k long, h string")
    new = spark.createDataFrame([(2, "x"), (3, None), (4, "d")], "k long, h string")
    assert rows(frames.classify_changes(old, new, ["k"], "h")) == [(1, "deleted"), (2, "updated"), (3, "unchanged"), (4, "inserted")]


def test_packers():
    assert chunking.pack_pieces(0, [["a b c"], ["x " * 50, "y"], ["z"]], 12, lambda t: len(t.split())) == ["a b c", "y", "z"]
    assert chunking.pack_section(0, "h", ["a", "b " * 50, "c"], 12, lambda t: len(t.split())) == ["h", "a"]
    assert chunking.pack_section(0, "h", ["b " * 50], 12, lambda t: len(t.split())) == []
    assert [chunking.degrade("h", "b", ["x " * n], 5)[1] for n in (1, 9)] == ["whole", "bare"] and chunking.degrade("h", "b " * 9, [], 5) == ("h", "stub")


def test_chunk_assembly(spark):
    anchors = spark.createDataFrame([(1, "head", "body"), (2, None, None)], "anchor_def_id long, header string, body string")
    parts = spark.createDataFrame([(1, 1, 0, ["long " * 900, "short"])], "anchor_def_id long, priority int, position int, texts array<string>")
    got = {r.anchor_def_id: r.content for r in chunking.assemble_function_chunks(anchors, parts).collect()}
    assert got == {1: "head\n\nbody\n\nshort", 2: "\n\n"}


def test_linking(spark):
    refs = spark.createDataFrame([(1, 10, "f", None), (2, 10, "g", None), (3, 10, "h", None), (4, 10, "f", 99)], "ref_id long, file_version_id long, name string, target_def_id long")
    imports = spark.createDataFrame([(10, 20, ["f"]), (10, 21, [])], "file_version_id long, resolved_file_version_id long, imported_names array<string>")
    defs = spark.createDataFrame([(1, 20, "f", None, "class"), (2, 21, "g", None, "class"), (3, 20, "h", None, "class"), (4, 21, "h", None, "class")], "def_id long, file_version_id long, name string, scope_id long, kind string")
    assert rows(linking.link_references(refs, imports, defs).na.fill(-1)) == [(1, 1, 0.7), (2, 2, 0.5), (3, -1, -1.0), (4, 99, -1.0)]
    child = spark.createDataFrame([(50, 10, "x", None, "class")], defs.schema)
    edges = spark.createDataFrame([(50, "g", None, "uncertain", 0), (50, "h", None, "uncertain", 1)], "child_def_id long, base_name string, base_def_id long, confidence string, ord int")
    assert rows(linking.link_bases(edges, imports, defs.unionByName(child)), "ord", "base_def_id", "confidence") == [(0, 2, "certain"), (1, 3, "inferred")]


def test_python_import_candidates(spark):
    imports = spark.createDataFrame([("a", "pkg/sub/m.py", "..util.x"), ("b", "pkg/sub/m.py", "os.path")], "import_id string, file_path string, import_path string")
    got = [r.path for r in linking.python_candidates(imports).filter("import_id = 'a'").orderBy("priority").collect()]
    assert got == ["pkg/util/x.py", "pkg/util/x/__init__.py", "pkg/util.py", "pkg/util/__init__.py", "pkg.py", "pkg/__init__.py"]
    files = spark.createDataFrame([("pkg/util.py", 7)], "path string, file_version_id long")
    assert rows(linking.resolve_by_priority(linking.python_candidates(imports), files)) == [("a", 7, 2)]


def test_components(spark):
    nodes = spark.createDataFrame([("n1", 1, "src/pay/a"), ("n2", 1, "src/payment/x"), ("n3", 1, "other"), ("n4", 2, "src/pay/a")], "node string, repo_id long, path string")
    rules = spark.createDataFrame([(1, "src", "S"), (1, "src/pay", "P"), (1, "zzz", "Z")], "repo_id long, prefix string, component string")
    m = connections.component_membership(nodes, rules)
    assert rows(m, "node", "component") == [("n1", "P"), ("n2", "S"), ("n3", "component:1:repository"), ("n4", "component:2:repository")]
    assert rows(connections.unused_rules(rules, nodes), "prefix") == [("zzz",)]
    edges = spark.createDataFrame([(1, "n1", "n2", "CALLS", 1, None, 7), (2, "n1", "n2", "CALLS", 1, None, 8), (3, "n2", "n1", "CALLS", 1, None, 7), (4, "n1", "n1", "CALLS", 1, None, 7)], "edge_id long, source string, target string, verb string, vocabulary_version int, conditions string, decision_id long")
    ce = connections.component_edges(edges, m)
    assert rows(ce, "source", "target", "n_edges") == [("P", "S", 2), ("S", "P", 1)]
    assert rows(connections.explain_component_edge(ce.filter("source = 'P'"), edges), "edge_id") == [(1,), (2,)]


def test_revisions_ignore_row_order(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "x long, y string")
    assert connections.revision_of(df).first() == connections.revision_of(df.orderBy(F.desc("x")).select("y", "x")).first()
    assert connections.revision_of(df).first() != connections.revision_of(df.distinct()).first()
    rev = connections.publish(df, f"file://{tmp_path}")
    assert connections.publish(df, f"file://{tmp_path}") == rev and connections.read_graph(spark, f"file://{tmp_path}", rev).count() == 3


def test_reuse_and_rules(spark):
    deps = spark.createDataFrame([(1, 1, "a", "h", "100644"), (2, 1, "b", "old", "100644"), (3, 1, "c", None, None), (4, 1, "gone", "h", "100644"), (5, 1, "x", None, None)], "decision_id long, repo_id long, path string, content_hash string, mode string")
    files = spark.createDataFrame([(1, "a", "h", "100644"), (1, "b", "new", "100755"), (1, "c", "h", "100644")], "repo_id long, path string, content_hash string, mode string")
    got = {r.decision_id: (r.reusable, r.reasons) for r in connections.reuse_reasons(deps, files).collect()}
    assert got == {1: (True, []), 2: (False, ["content_changed"]), 3: (False, ["appeared"]), 4: (False, ["disappeared"]), 5: (True, [])}
    text = "aé".encode()
    blobs = spark.createDataFrame([(hashlib.sha256(text).hexdigest(), bytearray(text))], "content_hash string, content binary")
    h = blobs.first()[0]
    spans = spark.createDataFrame([(h, 1, 3, "é"), (h, 0, 9, "aé"), (h, 0, 1, "b"), ("?", 0, 0, "")], "content_hash string, start_byte long, end_byte long, excerpt string")
    assert rows(connections.broken_spans(spans, blobs), "content_hash", "end_byte") == sorted([(h, 9), (h, 1), ("?", 0)])
    assert connections.broken_hashes(blobs).count() == 0
    conn = spark.createDataFrame([(1, None, 5, "emits"), (1, 2, None, "INVOKES"), (1, 2, 3, "SPAWNS"), (1, None, None, "SPAWNS"), (1, 2, None, "LIKES"), (1, 1, None, "INVOKES"), (1, 2, None, "READS"), (1, 2, None, None)], "source_site_id long, target_site_id long, target_resource_id long, verb string")
    assert connections.broken_connections(conn).count() == 6


def test_admin(spark):
    branches = spark.createDataFrame([(1, 1, True), (1, 2, False), (2, 3, True)], "repo_id long, branch_id long, is_default boolean")
    assert rows(admin.set_default(branches, 1, 2), "branch_id", "is_default") == [(1, False), (2, True), (3, True)]
    assert rows(admin.set_default(branches, 1, 9), "branch_id", "is_default") == rows(branches, "branch_id", "is_default")
    assert admin.drop_branch(branches, 1).count() == 2
    files = spark.createDataFrame([(1,), (1,)], "branch_id long")
    assert rows(admin.files_per_branch(branches, files)) == [(1, 2), (2, 0), (3, 0)]
    refs = spark.createDataFrame([(1,), (None,), (2,)], "t long")
    assert admin.resolved_share(refs, "t").first()[:] == (3, 2, 66)
    assert admin.resolved_share(refs.limit(0), "t").first().percent is None


def tree_hash(files: dict) -> dict:
    out = {}
    dirs = {""} | {p.rsplit("/", i)[0] for p in files for i in range(1, p.count("/") + 1)}
    for d in sorted(dirs, key=lambda d: -len(d.split("/")) if d else 1):
        inside = {p[len(d) + 1 if d else 0 :]: h for p, h in files.items() if not d or p.startswith(d + "/")}
        lines = {n: f"f|{n}|{h}\n" for n, h in inside.items() if "/" not in n}
        for sub in {n.split("/")[0] for n in inside if "/" in n}:
            lines[sub] = f"d|{sub}|{out[f'{d}/{sub}' if d else sub]}\n"
        out[d] = hashlib.sha256("".join(lines[n] for n in sorted(lines)).encode()).hexdigest()
    return out


def test_tree_walk_and_hashes(spark, tmp_path):
    for p, c in {"a.py": "x", "pkg/b.py": "y", "pkg/sub/c.go": "z", "node_modules/d.js": "n", "notes.txt": "t", ".hid/e.py": "h"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(c)
    files = repository.read_tree(spark, str(tmp_path))
    assert rows(files, "rel_path", "language") == [("a.py", "python"), ("pkg/b.py", "python"), ("pkg/sub/c.go", "go")]
    hashes = {r.rel_path: r.content_hash for r in files.collect()}
    assert dict(rows(repository.directory_hashes(files))) == tree_hash(hashes)
    assert repository.directory_hashes(files.limit(0)).count() == 0
    assert repository.read_ignore_file("# c\n\nbuild/\n*.min.js\n") == ["build", "*.min.js"]


def test_incremental_plan(spark):
    mapped = spark.createDataFrame([("same", "h1", False), ("moved", "h2", False), ("gone", "h3", False), ("dep", "h4", True)], "path string, content_hash string, from_dependency boolean")
    walked = spark.createDataFrame([("same", "h1"), ("moved", "h9"), ("new", "h2"), ("new2", "h9")], "rel_path string, content_hash string")
    versions = spark.createDataFrame([("h1",), ("h2",), ("h3",), ("h4",)], "content_hash string")
    plan = repository.plan_index(mapped, walked, versions)
    assert rows(plan, "path", "action") == [("dep", "unchanged"), ("gone", "pruned"), ("moved", "cold"), ("new", "rebind"), ("new2", "cold"), ("same", "unchanged")]
    assert rows(repository.cold_contents(plan, walked), "rel_path") == [("moved",)]


def test_snapshot_of_git(spark, tmp_path):
    roots = []
    for name in ("one", "two"):
        root = tmp_path / name
        root.mkdir()
        (root / "f.py").write_text(f"x = '{name}'\n")
        (root / "link").symlink_to("f.py")
        git = lambda *a, r=root: subprocess.run(["git", "-C", str(r), "-c", "user.name=t", "-c", "user.email=t@example.org", *a], check=True, capture_output=True)
        git("init", "-q")
        git("add", "-A")
        git("commit", "-qm", "first")
        roots.append(str(root))
    got = repository.read_snapshot(spark, roots)
    assert rows(got, "repo_id", "path", "mode") == [(1, "f.py", "100644"), (1, "link", "120000"), (2, "f.py", "100644"), (2, "link", "120000")]
    assert {bytes(r.content) for r in got.filter("path = 'link'").collect()} == {b"f.py"}
    with pytest.raises(ValueError):
        repository.read_snapshot(spark, roots[:1])


def test_python_extraction(spark):
    text = "import os\nfrom .u import a, b\nX = 1\nclass C(Base, m.D):\n    def f(self):\n        return g(self.h())\n"
    files = spark.createDataFrame([(1, text), (2, "def ("), (3, None), (4, "")], "key long, content string")
    d = {r.qualified_name: (r.kind, r.parent) for r in repository.extract(files, "definitions").collect()}
    assert d == {"X": ("variable", None), "C": ("class", None), "C.f": ("method", "C")}
    spans = {r.qualified_name: text.encode()[r.start_byte : r.end_byte].decode() for r in repository.extract(files, "definitions").collect()}
    assert spans["C.f"].startswith("def f") and spans["X"] == "X = 1"
    assert rows(repository.extract(files, "imports"), "import_path", "imported_names") == [(".u", ["a", "b"]), ("os", [])]
    assert rows(repository.extract(files, "calls"), "caller", "callee", "confidence") == [("C.f", "g", "certain"), ("C.f", "h", "inferred")]
    assert rows(repository.extract(files, "bases"), "base", "ord") == [("Base", 0), ("D", 1)]


def test_sinks(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    df.write.parquet(path)
    sinks.merge_table(spark.createDataFrame([(2, "B"), (3, "c")], df.schema), path, ["k"])
    assert rows(spark.read.parquet(path)) == [(1, "a"), (2, "B"), (3, "c")]
    part = f"file://{tmp_path}/p"
    df.write.partitionBy("k").parquet(part)
    sinks.replace_partitions(spark.createDataFrame([(2, "new")], df.schema), part, ["k"])
    assert rows(spark.read.parquet(part), "k", "v") == [(1, "a"), (2, "new")]


def test_streams_equal_batches(spark, tmp_path):
    src = f"file://{tmp_path}/events"
    data = spark.range(400).selectExpr("id event_id", "timestamp'2024-01-01' + make_interval(0,0,0,0,0,id * 5) ts", "id % 7 user_id", "concat('t', id % 3) event_type", "double(id) value", "'{}' props")
    data.write.parquet(src)
    got = []
    query = events.follow(events.read_events(spark, src), lambda df, n: got.append((n, df.count())), f"file://{tmp_path}/ck")
    query.awaitTermination(60)
    assert sum(n for _, n in got) == 400
    sink = events.tumbling_counts(events.read_events(spark, src)).writeStream.format("memory").queryName("tumbling").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/ck2").start()
    sink.awaitTermination(60)
    assert rows(spark.table("tumbling")) == rows(events.tumbling_counts(data, watermark=None))


def test_scratch_is_cleared(spark):
    from pathlib import Path

    from lodegraph.storage import clear_scratch, materialize

    df = materialize(spark.range(5), "t")
    path = Path(df.inputFiles()[0].removeprefix("file://")).parent
    assert path.exists() and clear_scratch(spark) >= 1 and not path.exists() and clear_scratch(spark) == 0


def test_registry(spark, sf_dir):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
