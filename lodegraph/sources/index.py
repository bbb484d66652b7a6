"""Indexing a source tree into tables: what changed is parsed, resolved and linked.

Tables lie below one folder and are keyed by content: what a file version holds is parsed
once, however many branches and paths it has. A branch is the mapping of its paths; a run
writes the whole mapping of its branch anew, so nothing of earlier runs is left in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.operators import linking, resolution
from lodegraph.sources import repository
from lodegraph.storage import materialize

VERSIONS = "file_version_id long, content_hash string, language string, content string"
FILES = "path string, content_hash string, file_version_id long, from_dependency boolean"
TABLES = {"versions": VERSIONS, "definitions": f"def_id long, {repository.DEFINITIONS}", "occurrences": f"occ_id long, {repository.OCCURRENCES}", "imports": repository.IMPORTS, "bases": repository.BASES}


def read_store(spark: SparkSession, store: str, name: str, schema: str) -> DataFrame:
    """A table of the store; empty where nothing was written yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/{name}")
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(schema).parquet(f"{store}/{name}") if there else spark.createDataFrame([], schema)


def branch_files(spark: SparkSession, store: str, branch_id: int) -> DataFrame:
    return read_store(spark, store, f"files/branch_id={branch_id}", FILES)


def index_tree(spark: SparkSession, root: str, store: str, branch_id: int, excludes: list[str] = ()) -> DataFrame:
    """Index the tree below root as a branch; (path, content_hash, action) of what was done.

    Unknown contents are parsed once each and appended; the branch's mapping and directory
    hashes are written anew. A second run over the same tree finds all unchanged. A run that
    was broken off leaves at most contents that no branch maps, and can be repeated.
    """
    walked = materialize(repository.read_tree(spark, root, list(excludes)), "index-walk")
    known = read_store(spark, store, "versions", VERSIONS)
    plan = materialize(repository.plan_index(branch_files(spark, store, branch_id), walked, known), "index-plan")
    cold = repository.cold_contents(plan, walked)
    # a version is named by its content and language, so a repeated run names it alike
    identity = F.xxhash64("content_hash", "language")
    new = materialize(cold.select(identity.alias("file_version_id"), "content_hash", "language", F.make_valid_utf8(F.col("content").cast("string")).alias("content")), "index-new")
    if not new.isEmpty():
        sources = new.select(F.col("file_version_id").alias("key"), "content", "language")
        ids = {"definitions": F.xxhash64("key", "kind", "qualified_name", "start_byte").alias("def_id"), "occurrences": F.xxhash64("key", "start_byte", "name", "is_write", "is_call").alias("occ_id")}
        for what in ("definitions", "occurrences", "imports", "bases"):
            found = repository.extract(sources, what).distinct()
            (found.select(ids[what], *found.columns) if what in ids else found).write.mode("append").parquet(f"{store}/{what}")
        # contents come last: they are known only when all that they hold is written
        new.write.mode("append").parquet(f"{store}/versions")
    versions = read_store(spark, store, "versions", VERSIONS).groupBy("content_hash").agg(F.min("file_version_id").alias("file_version_id"))
    kept = plan.filter("action <> 'pruned'").select("path", "content_hash").join(versions, "content_hash")
    mapping = materialize(kept.select("path", "content_hash", "file_version_id", F.lit(False).alias("from_dependency")), "index-mapping")
    mapping.write.mode("overwrite").parquet(f"{store}/files/branch_id={branch_id}")
    repository.directory_hashes(mapping.select(F.col("path").alias("rel_path"), "content_hash")).write.mode("overwrite").parquet(f"{store}/dirs/branch_id={branch_id}")
    return plan


def branch_tables(spark: SparkSession, store: str, branch_id: int) -> dict[str, DataFrame]:
    """The tables of a branch, in the form that the engine takes: definitions, calls,
    accesses, imports, files and versions. Open callees are linked across files."""
    files = branch_files(spark, store, branch_id).withColumn("branch_id", F.lit(branch_id).cast("long"))
    here = files.select(F.col("file_version_id").alias("key")).distinct()
    of = lambda name: read_store(spark, store, name, TABLES[name]).distinct().join(here, "key", "left_semi")
    defs, occurrences = of("definitions"), of("occurrences")
    versions = read_store(spark, store, "versions", VERSIONS).dropDuplicates(["file_version_id"])
    placed = files.join(versions.select("file_version_id", "language"), "file_version_id")
    shown = defs.withColumnRenamed("key", "file_version_id").join(placed.select("file_version_id", "branch_id", F.col("path").alias("file_path"), "language"), "file_version_id")
    asked = of("imports").select(F.col("key").alias("file_version_id"), "import_path", "imported_names").join(placed.select("file_version_id", "branch_id", F.col("path").alias("file_path"), "language"), "file_version_id")
    asked = asked.withColumn("import_id", F.xxhash64("file_version_id", "file_path", "import_path", "imported_names"))
    none = spark.createDataFrame([], "branch_id long, module string, dir string"), spark.createDataFrame([(branch_id, "", "")], "branch_id long, crate string, dir string")
    imports = linking.resolve_imports(asked, files.select("branch_id", "path", "file_version_id"), *none)
    calls = resolution.call_edges(occurrences.filter("is_call"), defs)
    top = defs.filter("parent IS NULL").select("def_id", F.col("key").alias("file_version_id"), "name", F.lit(None).cast("long").alias("scope_id"))
    open_calls = calls.select(F.col("occ_id").alias("ref_id"), F.col("key").alias("file_version_id"), F.col("callee_name").alias("name"), F.col("dst").alias("target_def_id"))
    linked = linking.link_references(open_calls, imports, top).select(F.col("ref_id").alias("occ_id"), F.col("target_def_id").alias("_dst"), F.col("confidence").alias("_w"))
    confidence = F.when(F.col("_w") == linking.DIRECT, "certain").when(F.col("_w") == linking.UNIQUE, "inferred").otherwise(F.col("confidence"))
    edges = calls.join(linked, "occ_id", "left").select("src", F.coalesce("dst", "_dst").alias("dst"), "callee_name", confidence.alias("confidence"), F.lit(branch_id).cast("long").alias("branch_id"))
    accesses = resolution.data_accesses(occurrences.filter("NOT is_call"), defs).withColumn("branch_id", F.lit(branch_id).cast("long"))
    return {"definitions": shown, "calls": edges, "accesses": accesses, "imports": imports, "files": files, "versions": versions}
