from __future__ import annotations

import pytest

from lodegraph.operators import linking as L

CASES = [
    # language, file, import, resolved path, package, class
    ("python", "pkg/a.py", ".b", "pkg/b.py", None, "intra_repo"),
    ("python", "pkg/a.py", "pkg.sub.x", "pkg/sub/__init__.py", "pkg", "intra_repo"),
    ("python", "pkg/a.py", "os.path", None, "os", "external"),
    ("typescript", "web/a.ts", "./b", "web/b.tsx", None, "intra_repo"),
    ("javascript", "web/deep/a.js", "../lib", "web/lib/index.js", None, "intra_repo"),
    ("typescript", "web/a.ts", "~/b", "web/b.tsx", "~", "intra_repo"),
    ("javascript", "web/a.js", "@s/p/q", None, "@s/p", "external"),
    ("javascript", "web/a.js", "./none", None, None, "unresolved"),
    ("go", "cmd/m.go", "example.com/mod/store", "store/db.go", "example.com/mod/store", "intra_repo"),
    ("go", "cmd/m.go", "fmt", None, "fmt", "external"),
    ("go", "cmd/m.go", "github.com/a/b/c/d", None, "github.com/a/b", "external"),
    ("rust", "core/src/x/y.rs", "crate::net::Conn", "core/src/net.rs", None, "intra_repo"),
    ("rust", "core/src/x/y.rs", "super::z::T", "core/src/x/z.rs", None, "intra_repo"),
    ("rust", "core/src/x/mod.rs", "self::z", "core/src/x/z.rs", None, "intra_repo"),
    ("rust", "core/src/x/y.rs", "side_kit::m", "side/src/m/mod.rs", "side_kit", "intra_repo"),
    ("rust", "core/src/x/y.rs", "serde::Deserialize", None, "serde", "external"),
    ("solidity", "src/A.sol", "../src/B.sol", "src/B.sol", None, "intra_repo"),
    ("solidity", "src/A.sol", "kit/K.sol", "lib/kit/K.sol", "kit", "intra_repo"),
    ("solidity", "src/A.sol", "@oz/c/T.sol", None, "@oz/c", "external"),
    ("solidity", "src/A.sol", "Bare.sol", None, None, "unresolved"),
]


@pytest.fixture
def resolved(spark):
    files = ["pkg/a.py", "pkg/b.py", "pkg/sub/__init__.py", "web/a.ts", "web/b.tsx", "web/lib/index.js", "store/db.go", "store/db_test.go", "core/src/lib.rs", "core/src/net.rs", "core/src/x/mod.rs", "core/src/x/z.rs", "side/src/m/mod.rs", "side/src/lib.rs", "src/B.sol", "lib/kit/K.sol"]
    frame = spark.createDataFrame([(1, p, i) for i, p in enumerate(files)] + [(2, "web/none.ts", 99)], "branch_id long, path string, file_version_id long")
    imports = spark.createDataFrame([(i, 1, c[0], c[1], c[2]) for i, c in enumerate(CASES)], "import_id long, branch_id long, language string, file_path string, import_path string")
    modules = spark.createDataFrame([(1, "example.com/mod", "")], "branch_id long, module string, dir string")
    crates = spark.createDataFrame([(1, "core", "core"), (1, "side-kit", "side")], "branch_id long, crate string, dir string")
    aliases = spark.createDataFrame([("~/", "web"), ("~/x/", "none")], "prefix string, target string")
    return {r.import_id: r for r in L.resolve_imports(imports, frame, modules, crates, aliases).collect()}, files


def test_imports_of_every_language(resolved):
    got, files = resolved
    shown = [(c[0], c[1], c[2], None if got[i].resolved_file_version_id is None else files[got[i].resolved_file_version_id], got[i].package_name, got[i].dep_class) for i, c in enumerate(CASES)]
    assert shown == CASES
