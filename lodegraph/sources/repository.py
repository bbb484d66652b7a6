"""Source trees as frames: walking, hashing, incremental indexing and snapshots."""

from __future__ import annotations

import os
import posixpath
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodegraph.functions.paths import IGNORED_DIRECTORIES, language_of_path, walked
from lodegraph.operators.frames import distinct_on
from lodegraph.sources.scanner import LANGUAGES as SCANNED
from lodegraph.sources.scanner import scan
from lodegraph.storage import materialize


#: Bytes of contents that are handed on at once.
READ_BYTES = 32 << 20


def list_tree(root: str, ignored: tuple[str, ...] = IGNORED_DIRECTORIES) -> Iterator[str]:
    """Relative paths of the regular files below a root, in order of their names. Links are
    not followed; hidden and ignored directories are not entered. Other file systems than
    the local one are listed whole."""
    if "://" in root and not root.startswith("file://"):
        import pyarrow.fs

        fs, base = pyarrow.fs.FileSystem.from_uri(root)
        found = fs.get_file_info(pyarrow.fs.FileSelector(base, recursive=True))
        yield from sorted(posixpath.relpath(f.path, base) for f in found if f.is_file)
        return
    base = root.removeprefix("file://")
    waiting = [""]
    while waiting:
        inside = waiting.pop()
        entries = sorted(os.scandir(os.path.join(base, inside)), key=lambda e: e.name)
        yield from (posixpath.join(inside, e.name) for e in entries if e.is_file(follow_symlinks=False))
        waiting += [posixpath.join(inside, e.name) for e in reversed(entries) if e.is_dir(follow_symlinks=False) and e.name not in ignored and not e.name.startswith(".")]


def read_tree(spark: SparkSession, root: str, excludes: list[str] = (), ignored: tuple[str, ...] = IGNORED_DIRECTORIES) -> DataFrame:
    """(rel_path, language, size, content, content_hash) of the source files below a root.

    Paths are listed by the driver, which prunes; tasks read the contents of what is left.
    The sources of Spark's own would pass over names that begin with an underscore.
    """
    paths = spark.createDataFrame([(x,) for x in list_tree(root, ignored)], "rel_path string").filter(walked("rel_path", list(excludes), ignored))

    def contents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.fs

        fs, base = pyarrow.fs.FileSystem.from_uri(root if "://" in root else "file://" + os.path.abspath(root))
        for pdf in batches:
            rows, held = [], 0
            for rel in pdf["rel_path"]:
                with fs.open_input_stream(posixpath.join(base, rel)) as f:
                    content = f.read()
                rows.append((rel, len(content), content))
                held += len(content)
                if held > READ_BYTES:
                    yield pd.DataFrame(rows, columns=["rel_path", "size", "content"])
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=["rel_path", "size", "content"])

    spread = paths.repartition(spark.sparkContext.defaultParallelism)
    files = spread.mapInPandas(contents, "rel_path string, size long, content binary")
    return files.select("rel_path", language_of_path("rel_path").alias("language"), "size", "content", F.sha2("content", 256).alias("content_hash"))


def read_ignore_file(text: str) -> list[str]:
    """Exclusion patterns of an ignore file: comments and blank lines aside, trailing slashes cut."""
    lines = (line.strip() for line in text.splitlines())
    return [line.rstrip("/") for line in lines if line and not line.startswith("#")]


def directory_hashes(files: DataFrame) -> DataFrame:
    """(dir, tree_hash) of every directory of (rel_path, content_hash), the root being ''.

    A directory's hash is that of its entries sorted by name, one line `kind|name|hash`
    each. Levels are hashed from the deepest up, one aggregation each, and every level is
    written, so no level is hashed again for those above it.
    """
    parts = F.split("rel_path", "/")
    entries = files.select(F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/").alias("dir"), F.lit("f").alias("kind"), F.element_at(parts, -1).alias("name"), F.col("content_hash").alias("hash"), (F.size(parts) - 1).alias("level"))
    entries = materialize(entries, "tree-entries")
    depth = entries.agg(F.max("level")).first()[0]
    out = up = None
    for level in range(-1 if depth is None else depth, -1, -1):
        here = entries.filter(F.col("level") == level).drop("level")
        here = here if up is None else here.unionByName(up)
        lines = F.array_sort(F.collect_list(F.struct("name", F.concat_ws("|", "kind", "name", "hash").alias("line"))))
        text = F.concat(F.array_join(F.transform("_l", lambda x: x["line"]), "\n"), F.lit("\n"))
        hashed = materialize(here.groupBy("dir").agg(lines.alias("_l")).select("dir", F.sha2(text, 256).alias("tree_hash")), "tree-level")
        out = hashed if out is None else out.unionByName(hashed)
        above = F.split("dir", "/")
        up = hashed.select(F.array_join(F.slice(above, 1, F.size(above) - 1), "/").alias("dir"), F.lit("d").alias("kind"), F.element_at(above, -1).alias("name"), F.col("tree_hash").alias("hash"))
    return out if out is not None else files.sparkSession.createDataFrame([], "dir string, tree_hash string")


def plan_index(mapped: DataFrame, walked_files: DataFrame, versions: DataFrame) -> DataFrame:
    """(path, content_hash, action) of an incremental index of one branch.

    unchanged: path and content as mapped; rebind: known content under a new path or in
    place of another; cold: unknown content, to be parsed; pruned: no longer there.
    mapped: (path, content_hash, from_dependency); versions: (content_hash).
    """
    old = mapped.select("path", F.col("content_hash").alias("_old"), F.coalesce("from_dependency", F.lit(False)).alias("_dep"), F.lit(True).alias("_m"))
    new = walked_files.select(F.col("rel_path").alias("path"), "content_hash", F.lit(True).alias("_w"))
    known = versions.select("content_hash").distinct().withColumn("_known", F.lit(True))
    joined = new.join(old, "path", "full").join(known, "content_hash", "left")
    gone = F.col("_w").isNull()
    action = F.when(gone & ~F.coalesce("_dep", F.lit(False)), "pruned").when(gone | F.col("content_hash").eqNullSafe(F.col("_old")), "unchanged").when(F.col("_known"), "rebind").otherwise("cold")
    return joined.select("path", F.coalesce("content_hash", "_old").alias("content_hash"), action.alias("action"))


def cold_contents(plan: DataFrame, walked_files: DataFrame) -> DataFrame:
    """Each unknown content once, with the first path it stands under."""
    cold = walked_files.join(plan.filter("action = 'cold'").select(F.col("path").alias("rel_path")), "rel_path", "left_semi")
    return distinct_on(cold, ["content_hash"], [F.col("rel_path")])


class _Part(InputPartition):
    def __init__(self, repo_id: int, root: str, revision: str):
        super().__init__(None)
        self.repo_id, self.root, self.revision = repo_id, root, revision


def _git(root: str, *args: str, data: bytes | None = None) -> bytes:
    return subprocess.run(["git", "-C", root, *args], input=data, capture_output=True, check=True).stdout


class _SnapshotReader(DataSourceReader):
    def __init__(self, options: dict):
        self.roots = [r for r in options.get("roots", "").split(";") if r]
        self.revision = options.get("revision", "HEAD")

    def partitions(self):
        return [_Part(i, root, self.revision) for i, root in enumerate(self.roots, 1)]

    def read(self, partition):
        root = partition.root
        commit = _git(root, "rev-parse", "--verify", partition.revision + "^{commit}").decode().strip()
        for line in _git(root, "ls-tree", "-rz", commit).split(b"\0"):
            if not line:
                continue
            meta, path = line.split(b"\t", 1)
            mode, _, oid = meta.decode().split()
            content = oid.encode() if mode == "160000" else _git(root, "cat-file", "blob", oid)
            yield partition.repo_id, root, commit, path.decode("utf-8", "surrogateescape"), mode, oid, content


class SnapshotSource(DataSource):
    """Committed trees of git repositories: format "snapshot" with the option roots
    (separated by ;) and revision. A link is its text, a submodule its object id."""

    @classmethod
    def name(cls):
        return "snapshot"

    def schema(self):
        return "repo_id bigint, root string, commit string, path string, mode string, oid string, content binary"

    def reader(self, schema):
        return _SnapshotReader(self.options)


def read_snapshot(spark: SparkSession, roots: list[str], revision: str = "HEAD") -> DataFrame:
    """One partition for each repository; two or more distinct ones are needed."""
    if len(set(roots)) < 2:
        raise ValueError("a snapshot takes two or more distinct repositories")
    spark.dataSource.register(SnapshotSource)
    return spark.read.format("snapshot").option("roots", ";".join(roots)).option("revision", revision).load()


# -- definitions of source files --------------------------------------------------------

DEFINITIONS = "key long, kind string, name string, qualified_name string, parent string, start_byte int, end_byte int, visibility string"
IMPORTS = "key long, import_path string, imported_names array<string>"
CALLS = "key long, caller string, callee string, confidence string"
BASES = "key long, child string, base string, ord int"
OCCURRENCES = "key long, scope string, name string, form string, is_write boolean, is_call boolean, start_byte int"


def extract_python(text: str) -> dict[str, list[tuple]]:
    """Definitions, imports, calls and bases of a Python module; none if it doesn't parse."""
    import ast

    out: dict[str, list[tuple]] = {"definitions": [], "imports": [], "calls": [], "bases": [], "occurrences": []}
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return out
    starts = [0]
    for line in text.encode().splitlines(keepends=True):
        starts.append(starts[-1] + len(line))

    def visit(node: ast.AST, scope: list[str], kinds: list[str]) -> None:
        inside = ".".join(scope)
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                is_class = isinstance(child, ast.ClassDef)
                kind = "class" if is_class else "method" if kinds and kinds[-1] == "class" else "function"
                a, b = starts[child.lineno - 1] + child.col_offset, starts[child.end_lineno - 1] + child.end_col_offset
                qualified = ".".join([*scope, child.name])
                out["definitions"].append((kind, child.name, qualified, inside or None, a, b, "private" if child.name.startswith("_") and not child.name.startswith("__") else "public"))
                if is_class:
                    for i, base in enumerate(b for b in child.bases if isinstance(b, (ast.Name, ast.Attribute))):
                        out["bases"].append((qualified, base.id if isinstance(base, ast.Name) else base.attr, i))
                visit(child, [*scope, child.name], [*kinds, kind])
                continue
            if isinstance(child, (ast.Assign, ast.AnnAssign)) and (not kinds or kinds[-1] == "class"):
                for target in child.targets if isinstance(child, ast.Assign) else [child.target]:
                    if isinstance(target, ast.Name):
                        a, b = starts[child.lineno - 1] + child.col_offset, starts[child.end_lineno - 1] + child.end_col_offset
                        out["definitions"].append(("variable", target.id, ".".join([*scope, target.id]), inside or None, a, b, "public"))
            if isinstance(child, ast.Import):
                out["imports"] += [(n.name, []) for n in child.names]
            elif isinstance(child, ast.ImportFrom):
                out["imports"].append(("." * child.level + (child.module or ""), [n.name for n in child.names]))
            elif isinstance(child, (ast.Name, ast.Attribute)) and not isinstance(child.ctx, ast.Del):
                called = isinstance(node, ast.Call) and node.func is child
                name, form = (child.id, "plain") if isinstance(child, ast.Name) else (child.attr, "member")
                written = isinstance(child.ctx, ast.Store)
                out["occurrences"].append((inside or None, name, form, written, called, starts[child.lineno - 1] + child.col_offset))
                if written and isinstance(node, ast.AugAssign):
                    out["occurrences"].append((inside or None, name, form, False, False, starts[child.lineno - 1] + child.col_offset))
            elif isinstance(child, ast.Call):
                f = child.func
                if not isinstance(f, (ast.Name, ast.Attribute)):
                    out["occurrences"].append((inside or None, None, "other", False, True, starts[child.lineno - 1] + child.col_offset))
                if isinstance(f, ast.Name):
                    out["calls"].append((inside or None, f.id, "certain"))
                elif isinstance(f, ast.Attribute):
                    out["calls"].append((inside or None, f.attr, "inferred"))
                else:
                    out["calls"].append((inside or None, None, "uncertain"))
            visit(child, scope, kinds)

    visit(tree, [], [])
    return out


def extract(files: DataFrame, what: str) -> DataFrame:
    """definitions, imports, calls, bases or occurrences of source files (key, content[,
    language]). Occurrences are of names and members, whether they are read, written or
    called.

    Without a language column files are taken for Python. Python is parsed, and a file
    that doesn't parse has none; other languages are scanned. Null contents and unknown
    languages have none.
    """
    schema = {"definitions": DEFINITIONS, "imports": IMPORTS, "calls": CALLS, "bases": BASES, "occurrences": OCCURRENCES}[what]
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, content, language in zip(pdf["key"], pdf["content"], pdf["language"]):
                if content is None or (language != "python" and language not in SCANNED):
                    continue
                text = (content if isinstance(content, str) else bytes(content).decode("utf-8", "replace")).removeprefix("\ufeff")
                rows += [(key, *r) for r in (extract_python(text) if language == "python" else scan(text, language, what == "occurrences"))[what]]
            yield pd.DataFrame(rows, columns=columns)

    language = F.lower("language") if "language" in files.columns else F.lit("python")
    return files.select("key", "content", language.alias("language")).mapInPandas(run, schema)
