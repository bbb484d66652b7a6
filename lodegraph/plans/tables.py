"""Queries over files, versions, chunks and runs: lookups, counts, changes and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.functions.paths import language_of_path
from lodegraph.functions.spans import byte_slice
from lodegraph.functions.text import signature
from lodegraph.operators import admin, chunking, connections, frames, linking, resolution
from lodegraph.plans import bridge as B
from lodegraph.sources import repository
from lodegraph.storage import materialize, read_table


def _versions(spark, sf_dir):
    return frames.distinct_on(read_table(spark, sf_dir, "file_versions"), ["id"], [F.col("content_hash")]).withColumnRenamed("id", "file_version_id")


def _index(spark, sf_dir):
    return read_table(spark, sf_dir, "index_files")


def t_definitions_in_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.code_definitions(spark, sf_dir).groupBy("branch_id", "file_path", "kind").agg(F.count("*").alias("n"))


def t_source_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of source that the span of every valid definition holds."""
    d = B.code_definitions(spark, sf_dir).select("def_id", "file_version_id", "start_byte", "end_byte").distinct()
    v = _versions(spark, sf_dir).select("file_version_id", "raw_content")
    raw = F.substring(F.encode("raw_content", "UTF-8"), (F.col("start_byte") + 1).cast("int"), F.greatest(F.col("end_byte") - F.col("start_byte"), F.lit(0)).cast("int"))
    return d.join(v, "file_version_id").select("def_id", F.octet_length(raw).cast("long").alias("n_bytes"))


def t_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source text and signature of every valid definition."""
    d = B.code_definitions(spark, sf_dir).select("def_id", "file_version_id", "start_byte", "end_byte").distinct()
    v = _versions(spark, sf_dir).select("file_version_id", "raw_content")
    text = byte_slice("raw_content", "start_byte", "end_byte")
    return d.join(v, "file_version_id").select("def_id", text.alias("source"), signature(text).alias("signature"))


def t_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).select("rel_path").distinct().groupBy(language_of_path("rel_path").alias("language")).agg(F.count("*").alias("n"))


def t_branch_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each repository's second branch differs from its first, by path."""
    f = _index(spark, sf_dir).groupBy("branch_id", "repo_id", "rel_path").agg(F.max("file_version_id").cast("string").alias("v"))
    side = lambda n: f.filter(F.col("branch_id") == F.col("repo_id") * 10 + n).drop("branch_id")
    return frames.classify_changes(side(1), side(2), ["repo_id", "rel_path"], "v").groupBy("repo_id", "change").agg(F.count("*").alias("n"))


def t_tree_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directory hashes of every branch's tree, the branch being the top directory."""
    files = _index(spark, sf_dir).groupBy("branch_id", "rel_path").agg(F.max("file_version_id").alias("file_version_id"))
    placed = files.join(_versions(spark, sf_dir).select("file_version_id", "content_hash"), "file_version_id")
    return repository.directory_hashes(placed.select(F.concat_ws("/", F.col("branch_id").cast("string"), "rel_path").alias("rel_path"), "content_hash"))


def t_index_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What indexing the captured sources into the first branch of each repository would do."""
    files = _index(spark, sf_dir).filter(F.col("branch_id") % 10 == 1).groupBy("repo_id", "rel_path").agg(F.max("file_version_id").alias("file_version_id"))
    mapped = files.join(_versions(spark, sf_dir).select("file_version_id", "content_hash"), "file_version_id")
    path = F.concat_ws("/", F.col("repo_id").cast("string"), "rel_path")
    captured = read_table(spark, sf_dir, "captured_files").filter("mode IN ('100644', '100755')").withColumnRenamed("path", "rel_path")
    walked = frames.distinct_on(captured.filter(language_of_path("rel_path").isNotNull()), ["repo_id", "rel_path"], [F.desc("captured_at"), F.desc("capture_id")])
    plan = repository.plan_index(mapped.select(path.alias("path"), "content_hash", F.lit(False).alias("from_dependency")), walked.select(path.alias("rel_path"), "content_hash"), _versions(spark, sf_dir))
    return plan.groupBy("action").agg(F.count("*").alias("n"))


def t_component_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by component: a rule for each first directory, one for each below src."""
    nodes = _index(spark, sf_dir).select(F.concat_ws(":", "repo_id", "rel_path").alias("node"), "repo_id", F.col("rel_path").alias("path")).distinct()
    parts = F.split("path", "/")
    one = nodes.select("repo_id", F.element_at(parts, 1).alias("prefix")).distinct()
    two = nodes.filter((F.element_at(parts, 1) == "src") & (F.size(parts) > 2)).select("repo_id", F.concat_ws("/", F.element_at(parts, 1), F.try_element_at(parts, F.lit(2))).alias("prefix")).distinct()
    rules = one.union(two).withColumn("component", F.concat_ws(":", "repo_id", "prefix"))
    return connections.component_sizes(connections.component_membership(nodes, rules))


def t_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = connections.passage_sites(read_table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return sites.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("end_byte").alias("last_byte"))


def t_packed_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of each file, in order of their ids, up to the first that a budget can't hold."""
    c = frames.distinct_on(read_table(spark, sf_dir, "chunks"), ["id"], [F.col("branch_id")])
    sized = c.select("id", "branch_id", "file_version_id", F.coalesce("token_count", F.lit(0)).alias("size")).withColumn("file", F.concat_ws("/", "branch_id", "file_version_id"))
    return chunking.pack_prefix(sized, "file", [F.col("id")], "size", 2048).select("id", "file")


def t_two_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = read_table(spark, sf_dir, "inherits_edges").select(F.col("child_def_id").alias("src"), F.col("base_def_id").alias("dst"))
    return chunking.two_hop_callees(edges).groupBy("hop").agg(F.count("*").alias("n"))


def t_python_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_version_id, import_path, resolved): imports of all Python files, resolved in
    the repository where a candidate path is one of its files."""
    v = _versions(spark, sf_dir).filter("lower(language) = 'python'")
    found = repository.extract(v.select(F.col("file_version_id").alias("key"), F.col("raw_content").alias("content")), "imports").distinct()
    files = frames.distinct_on(_index(spark, sf_dir), ["file_version_id"], [F.col("branch_id"), F.col("rel_path")]).select(F.col("file_version_id").alias("key"), F.col("rel_path").alias("file_path"), "branch_id")
    imports = found.join(files, "key").select(F.concat_ws("/", "branch_id", "key", "import_path").alias("import_id"), "branch_id", F.col("key").alias("importer"), "file_path", "import_path").distinct()
    asked = linking.python_candidates(imports).join(imports.select("import_id", "branch_id"), "import_id")
    paths = _index(spark, sf_dir).select("branch_id", F.col("rel_path").alias("path"), "file_version_id").distinct()
    hits = asked.select("import_id", "priority", F.concat_ws("/", "branch_id", "path").alias("path"))
    resolved = linking.resolve_by_priority(hits, paths.select(F.concat_ws("/", "branch_id", "path").alias("path"), "file_version_id"))
    return imports.join(resolved, "import_id", "left").select(F.col("importer").alias("file_version_id"), "import_path", F.col("file_version_id").isNotNull().alias("resolved"))


def t_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports of all sources by language and class. Every first directory counts as a crate
    and as a Go module of its own name."""
    found = repository.extract(_sources(spark, sf_dir), "imports").select("key", "import_path").distinct()
    placed = frames.distinct_on(_index(spark, sf_dir), ["file_version_id"], [F.col("branch_id"), F.col("rel_path")]).select(F.col("file_version_id").alias("key"), F.col("rel_path").alias("file_path"), "branch_id", language_of_path("rel_path").alias("language"))
    imports = materialize(found.join(placed, "key").withColumn("import_id", F.xxhash64("key", "import_path")), "imports")
    files = _index(spark, sf_dir).select("branch_id", F.col("rel_path").alias("path"), "file_version_id").distinct()
    tops = files.filter(F.instr("path", "/") > 0).select("branch_id", F.element_at(F.split("path", "/"), 1).alias("dir")).distinct()
    out = linking.resolve_imports(imports, files, tops.withColumn("module", F.col("dir")), tops.withColumn("crate", F.col("dir")).unionByName(tops.select("branch_id", F.lit("").alias("dir"), F.lit("").alias("crate")).distinct()))
    return out.groupBy("language", "dep_class").agg(F.count("*").alias("n"))


def t_python_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _versions(spark, sf_dir).filter("lower(language) = 'python'")
    return repository.extract(v.select(F.col("file_version_id").alias("key"), F.col("raw_content").alias("content")), "definitions")


def _sources(spark, sf_dir):
    return _versions(spark, sf_dir).select(F.col("file_version_id").alias("key"), F.col("raw_content").alias("content"), "language")


def t_code_extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions that all file versions hold, by language and kind."""
    found = repository.extract(_sources(spark, sf_dir), "definitions")
    return found.join(_sources(spark, sf_dir).select("key", F.lower("language").alias("language")), "key").groupBy("language", "kind").agg(F.count("*").alias("n"))


def t_code_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repository.extract(_sources(spark, sf_dir), "bases")


def t_code_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = repository.extract(_sources(spark, sf_dir), "calls")
    return calls.groupBy("callee", "confidence").agg(F.count("*").alias("n"))


def _occurrences(spark, sf_dir):
    """(occurrences, definitions) of all file versions, in the form that resolution takes."""
    found = repository.extract(_sources(spark, sf_dir), "occurrences")
    numbered = found.distinct().withColumn("occ_id", F.xxhash64("key", "start_byte", "name", "is_write", "is_call"))
    defs = repository.extract(_sources(spark, sf_dir), "definitions").distinct().withColumn("def_id", F.xxhash64("key", "kind", "qualified_name", "start_byte"))
    return materialize(numbered, "occurrences"), materialize(defs, "definitions")


def _code_edges(spark, sf_dir):
    o, d = _occurrences(spark, sf_dir)
    return resolution.call_edges(o.filter("is_call"), d), d


def t_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of all sources by confidence, with how many have a caller and a target."""
    edges, _ = _code_edges(spark, sf_dir)
    return edges.groupBy("confidence").agg(F.count("*").alias("n"), F.count("src").alias("n_callers"), F.count("dst").alias("n_targets"))


def t_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, d = _occurrences(spark, sf_dir)
    refs = resolution.reference_edges(o.filter("NOT is_call AND name IS NOT NULL"), d)
    return refs.groupBy(F.col("resolution_confidence").alias("confidence")).agg(F.count("*").alias("n"), F.count("target_def_id").alias("n_targets"))


def t_accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, d = _occurrences(spark, sf_dir)
    return resolution.data_accesses(o.filter("NOT is_call"), d).groupBy("access_type").agg(F.count("*").alias("n"))


def t_called_most(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names that most definitions of the sources reach over resolved calls of their file."""
    edges, defs = _code_edges(spark, sf_dir)
    reached = edges.filter("src IS NOT NULL AND dst IS NOT NULL").groupBy("dst").agg(F.count_distinct("src").alias("n_callers"))
    return reached.join(defs.select(F.col("def_id").alias("dst"), "key", "qualified_name").distinct(), "dst").orderBy(F.desc("n_callers"), "key", "qualified_name").limit(20).select(F.col("key").alias("file_version_id"), "qualified_name", "n_callers")


def t_python_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _versions(spark, sf_dir).filter("lower(language) = 'python'")
    calls = repository.extract(v.select(F.col("file_version_id").alias("key"), F.col("raw_content").alias("content")), "calls")
    return calls.groupBy("confidence").agg(F.count("*").alias("n"))


def t_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = read_table(spark, sf_dir, "inherits_edges").select("child_def_id", "base_name", "base_def_id", "confidence", "ord")
    return connections.revision_of(edges)


def t_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = ["repos", "file_versions", "index_files", "captured_files", "definitions", "inherits_edges", "chunks", "candidate_hits", "documents"]
    out = None
    for t in tables:
        one = read_table(spark, sf_dir, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def t_dep_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    kind = F.when(F.col("o_orderstatus") == "F", "intra_repo").when(F.col("o_orderstatus") == "O", "external").otherwise("unresolved")
    return o.groupBy(kind.alias("dep_class")).agg(F.count("*").alias("n"))


QUERIES = {
    "t_definitions_in_files": t_definitions_in_files,
    "t_source_lengths": t_source_lengths,
    "t_sources": t_sources,
    "t_languages": t_languages,
    "t_branch_changes": t_branch_changes,
    "t_tree_hashes": t_tree_hashes,
    "t_index_plan": t_index_plan,
    "t_component_sizes": t_component_sizes,
    "t_passages": t_passages,
    "t_packed_prefix": t_packed_prefix,
    "t_two_hop": t_two_hop,
    "t_python_imports": t_python_imports,
    "t_imports": t_imports,
    "t_python_definitions": t_python_definitions,
    "t_python_calls": t_python_calls,
    "t_code_extracted": t_code_extracted,
    "t_code_bases": t_code_bases,
    "t_code_calls": t_code_calls,
    "t_calls": t_calls,
    "t_references": t_references,
    "t_accesses": t_accesses,
    "t_called_most": t_called_most,
    "t_revision": t_revision,
    "t_counts": t_counts,
    "t_dep_classes": t_dep_classes,
    "t_confidences": lambda s, d: read_table(s, d, "inherits_edges").groupBy("confidence").agg(F.count("*").alias("n")),
    "t_top_callers": lambda s, d: admin.top_sources(B.calls(s, d), 20),
    "t_resolved_share": lambda s, d: admin.resolved_share(read_table(s, d, "inherits_edges"), "base_def_id"),
    "t_files_per_branch": lambda s, d: admin.files_per_branch(_index(s, d).select("branch_id").distinct(), _index(s, d).filter("NOT skipped")),
    "t_orphan_versions": lambda s, d: admin.orphan_versions(_versions(s, d), _index(s, d)).select("file_version_id"),
    "t_orphan_chunks": lambda s, d: frames.missing(read_table(s, d, "chunks").withColumnRenamed("anchor_def_id", "id_"), read_table(s, d, "definitions").withColumnRenamed("id", "id_"), ["id_"]).select(F.col("id").alias("chunk_id")).distinct(),
    "t_repeated_versions": lambda s, d: frames.repeated_keys(read_table(s, d, "file_versions"), ["id"]),
    "t_broken_hashes": lambda s, d: connections.broken_hashes(read_table(s, d, "captured_files")).select("capture_id"),
    "t_broken_modes": lambda s, d: connections.broken_modes(read_table(s, d, "captured_files")).select("capture_id"),
    "t_blobs": lambda s, d: connections.source_blobs(read_table(s, d, "captured_files")).select("content_hash", F.octet_length("content").alias("n_bytes")),
}

_V = "v AS (SELECT id AS file_version_id, content_hash, raw_content FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY content_hash) AS n FROM file_versions) WHERE n = 1)"
_LANG = "CASE lower(regexp_extract(rel_path, '[^/]\\.([A-Za-z0-9]+)$', 1)) WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'jsx' THEN 'javascript' WHEN 'mjs' THEN 'javascript' WHEN 'cjs' THEN 'javascript' WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'typescript' WHEN 'go' THEN 'go' WHEN 'rs' THEN 'rust' WHEN 'sol' THEN 'solidity' END"
_COUNTED = ["repos", "file_versions", "index_files", "captured_files", "definitions", "inherits_edges", "chunks", "candidate_hits", "documents"]

ORACLES = {
    "t_definitions_in_files": f"WITH {B.VALID_DEFS} SELECT branch_id, file_path, kind, count(*) AS n FROM valid JOIN files USING (file_version_id) GROUP BY ALL",
    "t_source_lengths": f"WITH {B.VALID_DEFS}, {_V}, d AS (SELECT DISTINCT id, file_version_id, start_byte, end_byte FROM valid JOIN files USING (file_version_id)) SELECT d.id AS def_id, greatest(0, least(end_byte, octet_length(encode(raw_content))) - start_byte) AS n_bytes FROM d JOIN v USING (file_version_id)",
    "t_languages": f"SELECT {_LANG} AS language, count(*) AS n FROM (SELECT DISTINCT rel_path FROM index_files) GROUP BY 1",
    "t_branch_changes": """WITH f AS (SELECT branch_id, repo_id, rel_path, max(file_version_id) AS v FROM index_files GROUP BY ALL), a AS (SELECT * FROM f WHERE branch_id = repo_id * 10 + 1), b AS (SELECT * FROM f WHERE branch_id = repo_id * 10 + 2)
SELECT repo_id, CASE WHEN a.v IS NULL THEN 'inserted' WHEN b.v IS NULL THEN 'deleted' WHEN a.v = b.v THEN 'unchanged' ELSE 'updated' END AS change, count(*) AS n FROM a FULL JOIN b USING (repo_id, rel_path) GROUP BY ALL""",
    "t_component_sizes": """WITH nodes AS (SELECT DISTINCT repo_id, rel_path AS path FROM index_files), rules AS (
  SELECT DISTINCT repo_id, string_split(path, '/')[1] AS prefix FROM nodes UNION
  SELECT DISTINCT repo_id, 'src/' || string_split(path, '/')[2] FROM nodes WHERE string_split(path, '/')[1] = 'src' AND len(string_split(path, '/')) > 2),
m AS (SELECT n.repo_id, n.path, arg_max(r.prefix, length(r.prefix)) AS prefix FROM nodes n JOIN rules r ON r.repo_id = n.repo_id AND (r.prefix = n.path OR starts_with(n.path, r.prefix || '/')) GROUP BY ALL)
SELECT repo_id || ':' || prefix AS component, count(*) AS member_count FROM m GROUP BY ALL""",
    "t_passages": """WITH w AS (SELECT doc_id, text, unnest(range(CAST(greatest(0, ceil((length(text) - 1800) / 1600.0)) AS BIGINT) + 1)) AS k FROM documents WHERE text IS NOT NULL)
SELECT doc_id, count(*) AS n, max(octet_length(encode(substring(text, 1, k * 1600 + 1800)))) AS last_byte FROM w WHERE trim(substring(text, k * 1600 + 1, 1800), ' ') <> '' GROUP BY doc_id""",
    "t_index_plan": f"""WITH {_V}, m AS (SELECT repo_id, rel_path, max(file_version_id) AS file_version_id FROM index_files WHERE branch_id % 10 = 1 GROUP BY ALL), old AS (SELECT repo_id, rel_path, content_hash FROM m JOIN v USING (file_version_id)),
new AS (SELECT repo_id, rel_path, content_hash FROM (SELECT repo_id, path AS rel_path, content_hash, row_number() OVER (PARTITION BY repo_id, path ORDER BY captured_at DESC, capture_id DESC) AS n FROM captured_files WHERE mode IN ('100644', '100755')) WHERE n = 1 AND {_LANG} IS NOT NULL)
SELECT CASE WHEN new.rel_path IS NULL THEN 'pruned' WHEN new.content_hash = old.content_hash THEN 'unchanged' WHEN new.content_hash IN (SELECT content_hash FROM v) THEN 'rebind' ELSE 'cold' END AS action, count(*) AS n FROM old FULL JOIN new USING (repo_id, rel_path) GROUP BY 1""",
    "t_packed_prefix": """WITH c AS (SELECT * FROM (SELECT id, branch_id, file_version_id, coalesce(token_count, 0) AS size, row_number() OVER (PARTITION BY id ORDER BY branch_id) AS n FROM chunks) WHERE n = 1)
SELECT id, file FROM (SELECT id, branch_id || '/' || file_version_id AS file, sum(size + 1) OVER (PARTITION BY branch_id, file_version_id ORDER BY id ROWS UNBOUNDED PRECEDING) AS used FROM c) WHERE used <= 2048""",
    "t_two_hop": """WITH e AS (SELECT DISTINCT child_def_id AS src, base_def_id AS dst FROM inherits_edges WHERE child_def_id IS NOT NULL AND base_def_id IS NOT NULL),
t AS (SELECT DISTINCT a.src, b.dst FROM e a JOIN e b ON a.dst = b.src WHERE a.src <> b.dst AND (a.src, b.dst) NOT IN (SELECT (src, dst) FROM e)) SELECT 1 AS hop, count(*) AS n FROM e UNION ALL SELECT 2, count(*) FROM t""",
    "t_sources": f"""WITH {B.VALID_DEFS}, {_V}, d AS (SELECT DISTINCT id, file_version_id, start_byte, end_byte FROM valid JOIN files USING (file_version_id)),
s AS (SELECT d.id AS def_id, CASE WHEN raw_content IS NULL THEN NULL WHEN end_byte <= start_byte THEN '' ELSE decode(array_slice(encode(raw_content), start_byte + 1, end_byte)) END AS source FROM d JOIN v USING (file_version_id))
SELECT def_id, source, regexp_extract(source, '^[^\\r\\n]*') AS signature FROM s""",
    "t_counts": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in _COUNTED),
    "t_dep_classes": "SELECT CASE o_orderstatus WHEN 'F' THEN 'intra_repo' WHEN 'O' THEN 'external' ELSE 'unresolved' END AS dep_class, count(*) AS n FROM orders GROUP BY 1",
    "t_confidences": "SELECT confidence, count(*) AS n FROM inherits_edges GROUP BY confidence",
    "t_top_callers": f"WITH {B.CTES} SELECT src, count(*) AS n FROM calls GROUP BY src ORDER BY n DESC, src LIMIT 20",
    "t_resolved_share": "SELECT count(*) AS n, count(base_def_id) AS n_resolved, CAST(floor(count(base_def_id) * 100 / count(*)) AS BIGINT) AS percent FROM inherits_edges",
    "t_files_per_branch": "SELECT branch_id, count(*) FILTER (WHERE NOT skipped) AS n_files FROM index_files GROUP BY branch_id",
    "t_orphan_versions": "SELECT DISTINCT id AS file_version_id FROM file_versions WHERE id NOT IN (SELECT file_version_id FROM index_files WHERE file_version_id IS NOT NULL)",
    "t_orphan_chunks": "SELECT DISTINCT id AS chunk_id FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM definitions d WHERE d.id = c.anchor_def_id)",
    "t_repeated_versions": "SELECT id, count(*) AS n FROM file_versions GROUP BY id HAVING count(*) > 1",
    "t_broken_hashes": "SELECT capture_id FROM captured_files WHERE sha256(content) IS DISTINCT FROM content_hash",
    "t_broken_modes": "SELECT capture_id FROM captured_files WHERE mode IS NULL OR mode NOT IN ('100644', '100755', '120000', '160000')",
    "t_blobs": "SELECT DISTINCT sha256(content) AS content_hash, octet_length(content) AS n_bytes FROM captured_files WHERE mode <> '160000'",
}
