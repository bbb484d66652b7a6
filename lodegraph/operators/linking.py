"""Cross-file resolution: imports to files, names to definitions of imported files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.functions.paths import node_paths, package_name
from lodegraph.operators.frames import distinct_on

#: Confidence of a link by an imported name, and of one by a name unique in imported files.
DIRECT, UNIQUE = 0.7, 0.5
BASE_KINDS = ("contract", "interface", "class", "type")


def resolve_by_priority(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """(import_id, file_version_id, priority): of the paths an import may mean, in order of
    priority, the first that is a file. candidates: (import_id, priority, path)."""
    hits = candidates.join(files.select("path", "file_version_id"), "path")
    return distinct_on(hits, ["import_id"], [F.col("priority"), F.col("file_version_id")]).select("import_id", "file_version_id", "priority")


def classify_imports(imports: DataFrame, resolved: DataFrame, external: DataFrame) -> DataFrame:
    """(…, resolved_file_version_id, dep_class): intra_repo where resolved, external where
    external (import_id, package_name) has it, else unresolved."""
    out = imports.join(resolved.select("import_id", F.col("file_version_id").alias("resolved_file_version_id")), "import_id", "left")
    out = out.join(external.select("import_id", "package_name"), "import_id", "left")
    kind = F.when(F.col("resolved_file_version_id").isNotNull(), "intra_repo").when(F.col("package_name").isNotNull(), "external").otherwise("unresolved")
    return out.withColumn("dep_class", kind)


def python_candidates(imports: DataFrame) -> DataFrame:
    """(import_id, priority, path) of Python imports (import_id, file_path, import_path):
    the module's file, its package, then ever shorter dotted prefixes. Leading dots climb
    from the importing file's package."""
    dots = F.length(F.regexp_extract("import_path", r"^(\.*)", 1))
    rest = F.regexp_replace("import_path", r"^\.+", "")
    folder = F.slice(F.split("file_path", "/"), F.lit(1), F.greatest(F.size(F.split("file_path", "/")) - F.greatest(dots, F.lit(1)), F.lit(0)))
    parts = F.filter(F.split(rest, r"\."), lambda p: p != "")
    full = F.when(dots > 0, F.concat(folder, parts)).otherwise(parts)
    prefixes = imports.withColumn("_full", full).filter(F.size("_full") > 0).select("import_id", "_full", F.explode(F.sequence(F.size("_full"), F.lit(1), F.lit(-1))).alias("_n"))
    named = prefixes.select("import_id", (F.size("_full") - F.col("_n")).alias("_cut"), F.array_join(F.slice("_full", F.lit(1), F.col("_n")), "/").alias("_path"))
    paths = F.array(F.concat("_path", F.lit(".py")), F.concat("_path", F.lit("/__init__.py")))
    return named.select("import_id", "_cut", F.posexplode(paths).alias("_i", "path")).select("import_id", (F.col("_cut") * 2 + F.col("_i")).cast("int").alias("priority"), "path")


def packages(files: DataFrame) -> DataFrame:
    """(branch_id, package, file_version_id): the files of one directory, which see each
    other as in a Go package. Pairs are never built: both sides of a link join on the
    package."""
    return files.select("branch_id", F.regexp_replace("path", r"/?[^/]*$", "").alias("package"), "file_version_id").distinct()


def package_names(members: DataFrame, defs: DataFrame) -> DataFrame:
    """(branch_id, package, name, def_id, n): the top names that the files of a package
    define; n files or definitions share the name."""
    top = defs.filter("scope_id IS NULL").select("file_version_id", "name", "def_id")
    return members.join(top, "file_version_id").groupBy("branch_id", "package", "name").agg(F.min("def_id").alias("def_id"), F.count_distinct("def_id").alias("n"))


def link_in_package(references: DataFrame, members: DataFrame, defs: DataFrame) -> DataFrame:
    """(ref_id, target_def_id): open references (ref_id, file_version_id, name, target_def_id)
    by the names of their package, where the package defines the name once."""
    names = package_names(members, defs).filter("n = 1").select("branch_id", "package", "name", F.col("def_id").alias("_def"))
    seen = references.join(members, "file_version_id").join(names, ["branch_id", "package", "name"], "left")
    return seen.groupBy("ref_id").agg(F.max(F.coalesce("target_def_id", "_def")).alias("target_def_id"))


def link_references(references: DataFrame, imports: DataFrame, defs: DataFrame) -> DataFrame:
    """(ref_id, target_def_id, confidence) for references (ref_id, file_version_id, name,
    target_def_id).

    A link that is there stays, without a confidence of its own. First, a name that an
    import lists is looked up in the imported file; then a name still open that all
    imported files together define once. imports: (file_version_id,
    resolved_file_version_id, imported_names).
    """
    top = defs.filter("scope_id IS NULL").select(F.col("file_version_id").alias("resolved_file_version_id"), "name", F.col("def_id").alias("_def"))
    resolved = imports.filter("resolved_file_version_id IS NOT NULL")
    listed = resolved.select("file_version_id", "resolved_file_version_id", F.explode("imported_names").alias("name"))
    direct = listed.join(top, ["resolved_file_version_id", "name"]).groupBy("file_version_id", "name").agg(F.max("_def").alias("_direct"))
    seen = resolved.select("file_version_id", "resolved_file_version_id").distinct().join(top, "resolved_file_version_id")
    unique = seen.groupBy("file_version_id", "name").agg(F.count_distinct("_def").alias("_n"), F.min("_def").alias("_unique")).filter("_n = 1").drop("_n")
    out = references.join(direct, ["file_version_id", "name"], "left").join(unique, ["file_version_id", "name"], "left")
    target = F.coalesce("target_def_id", "_direct", "_unique")
    confidence = F.when(F.col("target_def_id").isNotNull(), F.lit(None)).when(F.col("_direct").isNotNull(), DIRECT).when(F.col("_unique").isNotNull(), UNIQUE)
    return out.select("ref_id", target.alias("target_def_id"), confidence.cast("double").alias("confidence"))


def link_bases(inherits: DataFrame, imports: DataFrame, defs: DataFrame, kinds: tuple[str, ...] = BASE_KINDS) -> DataFrame:
    """Inheritance edges with unknown bases looked up by name in imported files: one
    candidate is certain, of several the smallest id is taken as inferred."""
    child_file = inherits.join(defs.select(F.col("def_id").alias("child_def_id"), "file_version_id"), "child_def_id", "left")
    bases = defs.filter(F.col("kind").isin(*kinds)).select(F.col("file_version_id").alias("resolved_file_version_id"), F.col("name").alias("base_name"), F.col("def_id").alias("_def"))
    seen = imports.filter("resolved_file_version_id IS NOT NULL").select("file_version_id", "resolved_file_version_id").distinct().join(bases, "resolved_file_version_id")
    found = seen.groupBy("file_version_id", "base_name").agg(F.count_distinct("_def").alias("_n"), F.min("_def").alias("_base"))
    out = child_file.join(found, ["file_version_id", "base_name"], "left")
    open_ = F.col("base_def_id").isNull() & F.col("_base").isNotNull()
    confidence = F.when(open_, F.when(F.col("_n") == 1, "certain").otherwise("inferred")).otherwise(F.col("confidence"))
    return out.select(*[c for c in inherits.columns if c not in ("base_def_id", "confidence")], F.coalesce("base_def_id", "_base").alias("base_def_id"), confidence.alias("confidence"))


def qualified_names(defs: DataFrame) -> DataFrame:
    """Definitions of one (scope, name) that count: the last in source order wins."""
    w = Window.partitionBy("file_version_id", "scope_id", "name").orderBy(F.desc("start_byte"), F.desc("def_id"))
    return defs.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


# -- imports of every language -------------------------------------------------------------

NODE_LANGUAGES = ("javascript", "typescript")


def joined_path(base: Column, relative: Column) -> Column:
    """A relative path from a directory, with its . and .. steps taken; steps above the root
    are dropped."""
    nothing = F.expr("cast(array() as array<string>)")
    steps = F.split(F.concat_ws("/", base, relative), "/")
    taken = F.aggregate(steps, nothing, lambda held, s: F.when(s == "..", F.slice(held, F.lit(1), F.greatest(F.size(held) - 1, F.lit(0)))).when(s.isin("", "."), held).otherwise(F.array_append(held, s)))
    return F.array_join(taken, "/")


def node_candidates(imports: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(import_id, priority, path) of JavaScript and TypeScript imports: relative ones, and
    those that an alias (prefix, target) of the project covers, the longest first."""
    folder = F.regexp_replace("file_path", r"/?[^/]*$", "")
    near = imports.filter(F.col("import_path").rlike(r"^\.{1,2}(/|$)")).select("import_id", F.lit(0).alias("_at"), joined_path(folder, F.col("import_path")).alias("_path"))
    if aliases is not None:
        met = imports.join(aliases, F.col("import_path").startswith(F.col("prefix")))
        far = met.select("import_id", (F.lit(1000) - F.length("prefix")).alias("_at"), joined_path(F.col("target"), F.substring("import_path", F.length("prefix") + 1, F.length("import_path"))).alias("_path"))
        near = near.unionByName(far)
    return near.select("import_id", "_at", F.inline(node_paths("_path"))).select("import_id", (F.col("_at") * 100 + F.col("priority")).cast("int").alias("priority"), "path")


def go_candidates(imports: DataFrame, modules: DataFrame, files: DataFrame) -> DataFrame:
    """(import_id, priority, path) of Go imports below a module (branch_id, module, dir) of
    their branch: the files of the package's directory, tests last."""
    met = imports.join(modules, "branch_id").filter((F.col("import_path") == F.col("module")) | F.col("import_path").startswith(F.concat("module", F.lit("/"))))
    folders = met.select("import_id", "branch_id", joined_path(F.col("dir"), F.substring("import_path", F.length("module") + 2, F.length("import_path"))).alias("_dir"))
    sources = files.filter(F.col("path").endswith(".go")).select("branch_id", "path", F.regexp_replace("path", r"/?[^/]*$", "").alias("_dir")).distinct()
    return folders.join(sources, ["branch_id", "_dir"]).select("import_id", F.col("path").endswith("_test.go").cast("int").alias("priority"), "path")


def rust_candidates(imports: DataFrame, crates: DataFrame) -> DataFrame:
    """(import_id, priority, path) of Rust paths (a::b::C) that begin with crate, self or
    super, or with the name of a crate (branch_id, crate, dir) of their branch: the module
    of the longest beginning first. A file belongs to the crate with the longest directory."""
    owners = imports.join(crates.select("branch_id", F.col("dir").alias("_owner")), "branch_id").filter((F.col("_owner") == "") | F.col("file_path").startswith(F.concat("_owner", F.lit("/"))))
    owner = owners.groupBy("import_id").agg(F.max_by("_owner", F.length("_owner")).alias("_owner"))
    named = imports.withColumn("_steps", F.split("import_path", "::")).join(owner, "import_id", "left")
    first = F.element_at("_steps", 1)
    stem = F.regexp_replace("file_path", r"(/(mod|lib|main))?\.rs$", "")
    inside = F.concat_ws("/", F.when(F.col("_owner") != "", F.col("_owner")), F.lit("src"))
    ups = F.size(F.filter("_steps", lambda s: s == "super"))
    # super climbs from the module of the file, which is its path without an ending
    climbed = F.array_join(F.slice(F.split(stem, "/"), F.lit(1), F.greatest(F.size(F.split(stem, "/")) - ups, F.lit(0))), "/")
    base = F.when(first == "crate", inside).when(first.isin("self", "super"), climbed)
    own = named.select("import_id", base.alias("_base"), F.filter("_steps", lambda s: ~s.isin("crate", "self", "super", "*")).alias("_rest")).filter("_base IS NOT NULL")
    other = named.join(crates.select("branch_id", F.regexp_replace("crate", "-", "_").alias("_name"), F.col("dir").alias("_dir")), "branch_id").filter(first == F.col("_name"))
    other = other.select("import_id", F.concat_ws("/", F.when(F.col("_dir") != "", F.col("_dir")), F.lit("src")).alias("_base"), F.filter(F.slice("_steps", 2, F.size("_steps")), lambda s: s != "*").alias("_rest"))
    tried = own.unionByName(other).select("import_id", "_base", "_rest", F.explode(F.sequence(F.size("_rest"), F.lit(0), F.lit(-1))).alias("_n"))
    path = F.concat_ws("/", "_base", F.slice("_rest", F.lit(1), F.col("_n")))
    files = F.array(F.concat(path, F.lit(".rs")), F.concat(path, F.lit("/mod.rs")), F.concat(path, F.lit("/lib.rs")), F.concat(path, F.lit("/main.rs")))
    return tried.select("import_id", (F.size("_rest") - F.col("_n")).alias("_cut"), F.posexplode(files).alias("_i", "path")).select("import_id", (F.col("_cut") * 4 + F.col("_i")).cast("int").alias("priority"), "path")


def solidity_candidates(imports: DataFrame, dependency_dirs: tuple[str, ...] = ("lib", "node_modules")) -> DataFrame:
    """(import_id, priority, path) of Solidity imports: relative ones from the file, others
    from the root, then from directories of dependencies."""
    folder = F.regexp_replace("file_path", r"/?[^/]*$", "")
    relative = F.col("import_path").startswith(".")
    roots = F.array(*[F.lit(d) for d in ("", *dependency_dirs)])
    near = imports.filter(relative).select("import_id", F.lit(0).alias("priority"), joined_path(folder, F.col("import_path")).alias("path"))
    far = imports.filter(~relative).select("import_id", "import_path", F.posexplode(roots).alias("priority", "_root")).select("import_id", "priority", joined_path(F.col("_root"), F.col("import_path")).alias("path"))
    return near.unionByName(far)


def external_packages(imports: DataFrame) -> DataFrame:
    """(import_id, package_name) of imports that are no relative paths, by their language."""
    path, language = F.col("import_path"), F.col("language")
    steps = F.split(path, "/")
    go = F.when(F.element_at(steps, 1).contains("."), F.array_join(F.slice(steps, 1, 3), "/")).otherwise(path)
    rust = F.when(~F.element_at(F.split(path, "::"), 1).isin("crate", "self", "super"), F.element_at(F.split(path, "::"), 1))
    solidity = F.when(F.size(steps) > 1, package_name(path))
    name = F.when(language == "python", F.element_at(F.split(path, r"\."), 1)).when(language.isin(*NODE_LANGUAGES), package_name(path)).when(language == "go", go).when(language == "rust", rust).when(language == "solidity", solidity)
    return imports.filter(~path.startswith(".") & (path != "")).select("import_id", name.alias("package_name")).filter("package_name IS NOT NULL")


def resolve_imports(imports: DataFrame, files: DataFrame, modules: DataFrame, crates: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """imports (import_id, branch_id, language, file_path, import_path) with
    resolved_file_version_id, package_name and dep_class: a file of their branch where one is
    meant, else a package, else unresolved. files: (branch_id, path, file_version_id)."""
    of = lambda *names: imports.filter(F.col("language").isin(*names))
    asked = python_candidates(of("python")).unionByName(node_candidates(of(*NODE_LANGUAGES), aliases)).unionByName(solidity_candidates(of("solidity")))
    asked = asked.unionByName(rust_candidates(of("rust"), crates)).unionByName(go_candidates(of("go"), modules, files))
    # a path means a file of the importing branch
    placed = asked.join(imports.select("import_id", "branch_id"), "import_id").select("import_id", "priority", F.concat_ws("/", F.col("branch_id").cast("string"), "path").alias("path"))
    held = files.select(F.concat_ws("/", F.col("branch_id").cast("string"), "path").alias("path"), "file_version_id").distinct()
    return classify_imports(imports, resolve_by_priority(placed, held), external_packages(imports))
