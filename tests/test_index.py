from __future__ import annotations

from lodegraph.engine import Engine
from lodegraph.sources.index import branch_tables, index_tree
from tests.conftest import rows


def counts(plan):
    return {r.action: r["count"] for r in plan.groupBy("action").count().collect()}


def test_a_tree_is_indexed_once(spark, tmp_path):
    root, store = tmp_path / "tree", str(tmp_path / "store")
    (root / "pkg").mkdir(parents=True)
    (root / "pkg" / "__init__.py").write_text("")
    (root / "pkg" / "low.py").write_text("LIMIT = 2\ndef low(x):\n    return x + LIMIT\n")
    (root / "pkg" / "top.py").write_text("from pkg.low import low\ndef top():\n    return low(1)\ndef main():\n    return top()\n")
    (root / "same.py").write_text("LIMIT = 2\ndef low(x):\n    return x + LIMIT\n")
    (root / "notes.txt").write_text("no source")
    assert counts(index_tree(spark, str(root), store, 1)) == {"cold": 4}
    assert counts(index_tree(spark, str(root), store, 1)) == {"unchanged": 4}
    engine = Engine.of_tree(spark, str(root), store, 1)
    assert {r.qualified_name for r in engine.reachable("main").collect()} == {"top", "low"}
    assert {r.qualified_name for r in engine.callers_of("low").collect()} == {"top"}
    tables = engine.tables
    assert rows(tables["imports"], "import_path", "dep_class") == [("pkg.low", "intra_repo")]
    assert {r.access_type for r in tables["accesses"].collect()} == {"read"}

    # another branch shares contents; one file changes, one goes, one moves
    (root / "pkg" / "low.py").write_text("def low(x):\n    return x\n")
    (root / "same.py").rename(root / "moved.py")
    assert counts(index_tree(spark, str(root), store, 1)) == {"cold": 1, "rebind": 1, "pruned": 1, "unchanged": 2}
    assert counts(index_tree(spark, str(root), store, 2)) == {"rebind": 4}
    assert {r.path for r in branch_tables(spark, store, 1)["files"].collect()} == {"pkg/__init__.py", "pkg/low.py", "pkg/top.py", "moved.py"}
