"""One object over the tables of a code graph, with a method for every question.

Tables are frames by name: definitions (def_id, name, qualified_name, kind, language,
file_path, visibility, branch_id, file_version_id), calls and flows as (src, dst,
confidence, branch_id), accesses, inherits, overrides, imports, files, versions, chunks,
embeddings and branches. Edge and definition tables are cut to the branches asked for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.functions.spans import byte_slice
from lodegraph.operators import admin, graph, retrieval
from lodegraph.operators.frames import distinct_on, missing
from lodegraph.sources.index import branch_tables, index_tree


class Engine:
    def __init__(self, tables: dict[str, DataFrame], branches: int | Sequence[int] | None = None):
        self.tables, self.branch_ids = tables, branches

    @classmethod
    def of_tree(cls, spark: SparkSession, root: str, store: str, branch_id: int, excludes: Sequence[str] = ()) -> Engine:
        """Index the tree below root as a branch of a store, and open it."""
        index_tree(spark, root, store, branch_id, list(excludes))
        return cls(branch_tables(spark, store, branch_id), [branch_id])

    def table(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise KeyError(f"the engine has no table {name}")
        df = self.tables[name]
        return df if self.branch_ids is None or "branch_id" not in df.columns else graph.in_branches(df, self.branch_ids)

    def within(self, branches: int | Sequence[int]) -> Engine:
        return Engine(self.tables, branches)

    def _edges(self, name: str = "calls") -> DataFrame:
        if name == "inherits":
            return self.table(name).select(F.col("child_def_id").alias("src"), F.col("base_def_id").alias("dst"), "confidence")
        if name == "overrides":
            return self.table(name).select(F.col("child_def_id").alias("src"), F.col("base_def_id").alias("dst"))
        return self.table(name)

    # -- graph --------------------------------------------------------------------------

    def resolve(self, name: str, kind: str | None = None, languages=None) -> DataFrame:
        return graph.resolve(self.table("definitions"), name, kind, languages)

    def callers_of(self, name: str, confidence: str | None = None, languages=None) -> DataFrame:
        return graph.callers_of(self._edges(), self.table("definitions"), name, confidence, languages)

    def callees_of(self, name: str, confidence: str | None = None, languages=None) -> DataFrame:
        return graph.callees_of(self._edges(), self.table("definitions"), name, confidence, languages)

    def ancestors(self, name: str, max_depth: int | None = None, confidence: str | None = None, languages=None) -> DataFrame:
        return graph.ancestors(self._edges(), self.table("definitions"), name, max_depth, confidence, languages)

    def reachable(self, name: str, max_depth: int | None = None, confidence: str | None = None, languages=None) -> DataFrame:
        return graph.reachable_from(self._edges(), self.table("definitions"), name, max_depth, confidence, languages)

    def _seeds(self, name: str) -> DataFrame:
        return graph.seeds_of(self.table("definitions"), name)

    def paths(self, source: str, target: str, max_depth: int = 8, max_paths: int = 50) -> DataFrame:
        return graph.simple_paths(self._edges(), self._seeds(source), self._seeds(target), max_depth, max_paths)

    def is_reachable(self, source: str, target: str, max_depth: int | None = None, confidence: str | None = None) -> bool:
        return graph.is_reachable(self._edges(), self._seeds(source), self._seeds(target), max_depth, confidence)

    def entrypoints(self, **options) -> DataFrame:
        return graph.entrypoints(self.table("definitions"), self._edges(), self.table("overrides"), **options)

    def entrypoints_reaching(self, name: str, max_depth: int | None = None) -> DataFrame:
        return graph.entrypoints_reaching(self._edges(), self.table("definitions"), self.entrypoints(), name, max_depth)

    def entrypoint_paths(self, name: str, max_depth: int = 8, max_paths: int = 50) -> DataFrame:
        return graph.entrypoint_paths(self._edges(), self.table("definitions"), self.entrypoints(), name, max_depth, max_paths)

    def writers_of(self, name: str) -> DataFrame:
        return graph.accessors_of(self.table("accesses"), self.table("definitions"), name, "write")

    def readers_of(self, name: str) -> DataFrame:
        return graph.accessors_of(self.table("accesses"), self.table("definitions"), name, "read")

    def taint_paths(self, source: str, sink: str, sanitizers: Sequence[str] = (), max_depth: int = 8, max_paths: int = 50) -> DataFrame:
        clean = self.table("definitions").select("def_id").limit(0)
        for name in sanitizers:
            clean = clean.union(self._seeds(name))
        return graph.taint_paths(self._edges(), self.table("accesses"), self._seeds(source), self._seeds(sink), clean, max_depth, max_paths)

    def inheritance(self, name: str, languages=None) -> DataFrame:
        return graph.inheritance_tree(self.table("inherits"), self.table("definitions"), name, languages)

    # -- files --------------------------------------------------------------------------

    def definitions_in_file(self, path: str, kind: str | None = None) -> DataFrame:
        found = self.table("definitions").filter(F.col("file_path").like("%" + path))
        return graph.one_per_definition(found if kind is None else found.filter(F.col("kind") == kind))

    def source(self, name: str, kind: str | None = None) -> DataFrame:
        """(def_id, qualified_name, source) of what a name means."""
        found = self.resolve(name, kind).join(self.table("versions").select("file_version_id", "raw_content").dropDuplicates(["file_version_id"]), "file_version_id")
        return found.select("def_id", "qualified_name", byte_slice("raw_content", "start_byte", "end_byte").alias("source"))

    def file_source(self, path: str) -> DataFrame:
        """(file_version_id, path, raw_content) of a path, or of what ends in /path."""
        files = self.table("files").filter((F.col("path") == path) | F.col("path").endswith("/" + path))
        return distinct_on(files, ["file_version_id"], [F.col("path")]).select("file_version_id", "path").join(self.table("versions").select("file_version_id", "raw_content").dropDuplicates(["file_version_id"]), "file_version_id")

    def imports(self, path: str, dep_class: str | None = None) -> DataFrame:
        files = self.table("files").filter((F.col("path") == path) | F.col("path").endswith("/" + path)).select("file_version_id", "path")
        out = self.table("imports").join(files, "file_version_id")
        targets = self.table("files").select(F.col("file_version_id").alias("resolved_file_version_id"), F.col("path").alias("resolved_path")).distinct()
        out = out.join(targets, "resolved_file_version_id", "left")
        return out if dep_class is None else out.filter(F.col("dep_class") == dep_class)

    def dependents(self, path: str) -> DataFrame:
        """(path) of the files that import a file."""
        target = self.table("files").filter((F.col("path") == path) | F.col("path").endswith("/" + path)).select(F.col("file_version_id").alias("resolved_file_version_id"))
        users = self.table("imports").join(target, "resolved_file_version_id", "left_semi").select("file_version_id").distinct()
        return self.table("files").join(users, "file_version_id", "left_semi").select("path").distinct().orderBy("path")

    # -- retrieval ----------------------------------------------------------------------

    def semantic(self, vector: Sequence[float], top_k: int = 10, **filters) -> DataFrame:
        return retrieval.semantic_query(self.table("chunks"), self.table("embeddings"), vector, top_k, **filters)

    def lexical(self, query: str, top_k: int = 10) -> DataFrame:
        return retrieval.lexical_query(self.table("chunks"), query, top_k=top_k)

    def structural(self, name: str, depth: int = 2, granularity: str | None = None) -> DataFrame:
        return retrieval.structural_query(self._edges(), self.table("definitions"), self.table("chunks"), name, depth, granularity)

    def hybrid(self, query: str, vector: Sequence[float], top_k: int = 10, pool: int = retrieval.POOL) -> DataFrame:
        semantic, lexical = self.semantic(vector, pool).select("chunk_id", "score"), self.lexical(query, pool).select("chunk_id", "score")
        return retrieval.hybrid_query(self.table("chunks"), semantic, lexical, self._edges(), self._edges("inherits"), self._edges("overrides"), top_k, pool)

    def context(self, query: str, vector: Sequence[float], budget: int, top_k: int = 10) -> DataFrame:
        return retrieval.assemble_context(self.hybrid(query, vector, top_k), budget)

    # -- administration -----------------------------------------------------------------

    def branches(self) -> DataFrame:
        return self.table("branches").join(admin.files_per_branch(self.table("branches"), self.table("files")), "branch_id", "left")

    def garbage(self) -> dict[str, DataFrame]:
        """What no branch holds any more: versions, and vectors of no chunk."""
        every = Engine(self.tables)
        return {"versions": missing(every.table("versions"), every.table("files"), ["file_version_id"]), "embeddings": missing(every.table("embeddings"), every.table("chunks"), ["content_hash"])}

    def diagnose(self, top_callers: int = 10) -> dict[str, DataFrame]:
        calls = self._edges()
        return {"calls": admin.resolved_share(calls, "dst"), "confidence": calls.groupBy("confidence").agg(F.count("*").alias("n")), "top_callers": admin.top_sources(calls, top_callers)}
