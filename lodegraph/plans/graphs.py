"""Graph queries: names, hops, walks, paths, entry points, taint and inheritance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.operators import graph as G
from lodegraph.plans import bridge as B
from lodegraph.storage import read_table

_SHOWN = ["def_id", "name", "kind", "language"]
_NAMED = "(SELECT p_name FROM part WHERE p_partkey = {0})"
_SEEDS = "seeds AS (SELECT def_id FROM defs WHERE name = " + _NAMED + " OR qualified_name = " + _NAMED + " OR qualified_name LIKE '%.' || " + _NAMED + ")"


def _part(n: int) -> str:
    return f"{B.CTES}, {_SEEDS.format(n)}"


def _graph(f):
    """A query over (calls, definitions) of the bridge and the name of part 1."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(B.calls(spark, sf_dir), B.definitions(spark, sf_dir), B.name_of(spark, sf_dir, 1))

    return query


def _paths(spark: SparkSession, sf_dir: str, max_depth: int | None) -> DataFrame:
    e = B.calls(spark, sf_dir)
    src, dst = (spark.createDataFrame([(n,)], "def_id long") for n in (1, 2))
    return _shown_paths(G.simple_paths(e, src, dst, max_depth=max_depth, max_paths=50))


def _shown_paths(paths: DataFrame) -> DataFrame:
    return paths.select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), F.col("length").cast("long").alias("length"))


_PATHS = """p AS (
  SELECT [src, dst] AS path, dst AS last, 2 AS n FROM {edges} WHERE src IN ({src})
  UNION ALL
  SELECT list_append(p.path, e.dst), e.dst, p.n + 1 FROM p JOIN {edges} e ON e.src = p.last WHERE p.n < {depth} AND NOT list_contains(p.path, e.dst) AND p.path[1] <> p.last)
SELECT array_to_string(path, '>') AS path, CAST(n AS BIGINT) AS length FROM p WHERE last IN ({dst}) ORDER BY n, p.path LIMIT 50"""


def g_is_reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = B.calls(spark, sf_dir)
    one, two = (spark.createDataFrame([(n,)], "def_id long") for n in (1, 2))
    return spark.createDataFrame([(G.is_reachable(e, one, two),)], "reachable boolean")


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = spark.createDataFrame([], "child_def_id long")
    # the first line of an order is called by none
    return G.entrypoints(B.definitions(spark, sf_dir), _returned(spark, sf_dir), none, kinds=("function", "method"))


def _returned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.of_confidence(B.calls(spark, sf_dir), "certain")


def g_entrypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(spark, sf_dir).select(*_SHOWN)


def g_entrypoints_reaching(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = B.name_of(spark, sf_dir, 1)
    return G.entrypoints_reaching(_returned(spark, sf_dir), B.definitions(spark, sf_dir), _entries(spark, sf_dir), name).select("def_id", "depth")


def _entrypoint_paths(spark: SparkSession, sf_dir: str, max_depth: int | None) -> DataFrame:
    name = B.name_of(spark, sf_dir, 1)
    return _shown_paths(G.entrypoint_paths(_returned(spark, sf_dir), B.definitions(spark, sf_dir), _entries(spark, sf_dir), name, max_depth=max_depth))


def g_writers(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = read_table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + B.SUPPLIER_OFFSET).alias("def_id"), F.col("s_name").alias("name"), F.col("s_name").alias("qualified_name"))
    # what is accessed and what accesses are definitions of one frame
    d = B.definitions(spark, sf_dir)
    known = d.unionByName(targets.select(*[F.col(c) if c in targets.columns else F.lit(None).cast(t).alias(c) for c, t in d.dtypes]))
    return G.accessors_of(B.accesses(spark, sf_dir), known, "Supplier#000000001", "write").select(*_SHOWN)


def _taint_paths(spark: SparkSession, sf_dir: str, max_depth: int | None) -> DataFrame:
    one, two, clean = (spark.createDataFrame([(n,)], "def_id long") for n in (1, 2, 3))
    return _shown_paths(G.taint_paths(B.calls(spark, sf_dir), B.accesses(spark, sf_dir), one, two, clean, max_depth=max_depth))


def g_code_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every valid definition once, in the branch and path that come first."""
    return G.one_per_definition(B.code_definitions(spark, sf_dir)).select("def_id", "name", "kind", "branch_id", "file_path")


def _bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "inherits_edges")
    return e.select("child_def_id", "base_def_id", "base_name", "ord").distinct()


def g_linearize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(def_id, ancestors): all ancestors of every class, in the order of its linearisation."""
    lines = G.linearize(_bases(spark, sf_dir)).groupBy("def_id").agg(F.array_sort(F.collect_list(F.struct("position", "ancestor_id"))).alias("_l"))
    return lines.select("def_id", F.array_join(F.transform("_l", lambda x: x["ancestor_id"].cast("string")), ">").alias("ancestors"))


def g_inheritance_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole connected family of the class that most others derive from."""
    d = B.code_definitions(spark, sf_dir).withColumn("qualified_name", F.col("name")).withColumn("language", F.lit(None).cast("string"))
    bases = _bases(spark, sf_dir)
    top = bases.filter("base_def_id IS NOT NULL").groupBy("base_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "base_name").first()
    return G.inheritance_tree(bases, d, top["base_name"] if top else "")


def g_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = G.one_per_definition(B.code_definitions(spark, sf_dir))
    return G.override_edges(_bases(spark, sf_dir), d)


def g_family_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(def_id, depth) of everything that the bases without a base of their own are inherited by."""
    e = _bases(spark, sf_dir).filter("base_def_id IS NOT NULL").select(F.col("base_def_id").alias("src"), F.col("child_def_id").alias("dst"))
    roots = e.select(F.col("src").alias("def_id")).distinct().join(e.select(F.col("dst").alias("def_id")).distinct(), "def_id", "left_anti")
    return G.walk(e, roots).select("def_id", F.col("depth").cast("long").alias("depth"))


def g_neighborhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _bases(spark, sf_dir).filter("base_def_id IS NOT NULL").select(F.col("child_def_id").cast("string").alias("src"), F.col("base_def_id").cast("string").alias("dst"))
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    start = nodes.agg(F.min("node")).first()[0] or ""
    if not start:
        return nodes.withColumn("truncated", F.lit(False))
    held, _, cut = G.neighborhood(nodes, e, start, hops=3, max_nodes=20)
    return held.withColumn("truncated", F.lit(cut))


# the path queries with SQL keep to its depth; those named whole have no bound
QUERIES = {
    "g_resolve": lambda s, d: G.resolve(B.definitions(s, d), B.name_of(s, d, 1)).select(*_SHOWN),
    "g_callers": _graph(lambda e, d, q: G.callers_of(e, d, q, "certain").select(*_SHOWN)),
    "g_callees": _graph(lambda e, d, q: G.callees_of(e, d, q, languages=["python", "go"]).select(*_SHOWN)),
    "g_reachable": _graph(lambda e, d, q: G.reachable_from(e, d, q).select("def_id", F.col("depth").cast("long").alias("depth"))),
    "g_ancestors": _graph(lambda e, d, q: G.ancestors(e, d, q, confidence="uncertain").select("def_id", F.col("depth").cast("long").alias("depth"))),
    "g_is_reachable": g_is_reachable,
    "g_paths": lambda s, d: _paths(s, d, 4),
    "g_paths_whole": lambda s, d: _paths(s, d, None),
    "g_entrypoints": g_entrypoints,
    "g_entrypoints_reaching": g_entrypoints_reaching,
    "g_entrypoint_paths": lambda s, d: _entrypoint_paths(s, d, 3),
    "g_entrypoint_paths_whole": lambda s, d: _entrypoint_paths(s, d, None),
    "g_writers": g_writers,
    "g_taint_paths": lambda s, d: _taint_paths(s, d, 4),
    "g_taint_paths_whole": lambda s, d: _taint_paths(s, d, None),
    "g_code_resolve": g_code_resolve,
    "g_linearize": g_linearize,
    "g_inheritance_tree": g_inheritance_tree,
    "g_overrides": g_overrides,
    "g_family_walk": g_family_walk,
    "g_neighborhood": g_neighborhood,
}

_WALK = """w AS (
  SELECT DISTINCT {to} AS def_id, 1 AS depth FROM {edges} WHERE {at} IN (SELECT def_id FROM seeds)
  UNION
  SELECT e.{to}, w.depth + 1 FROM w JOIN {edges} e ON e.{at} = w.def_id WHERE w.depth < 12 AND e.{to} NOT IN (SELECT def_id FROM seeds) AND w.def_id NOT IN (SELECT def_id FROM seeds))"""
_CERTAIN = "certain AS (SELECT DISTINCT src, dst FROM calls WHERE dst IS NOT NULL AND confidence = 'certain')"
_UNSURE = "unsure AS (SELECT DISTINCT src, dst FROM calls WHERE dst IS NOT NULL AND confidence = 'uncertain')"
_ENTRIES = "entries AS (SELECT def_id, name, kind, language FROM defs WHERE kind IN ('function', 'method') AND visibility IS NULL AND file_path NOT LIKE '%/interfaces/%' AND file_path NOT LIKE '%/interface/%' AND def_id NOT IN (SELECT dst FROM certain))"
_FLOWS = """flows AS (SELECT DISTINCT src, dst FROM (
  SELECT src, dst FROM calls WHERE dst IS NOT NULL UNION ALL SELECT accessor_def_id, target_def_id FROM acc WHERE access_type = 'write'
  UNION ALL SELECT target_def_id, accessor_def_id FROM acc WHERE access_type = 'read') WHERE dst <> 3)"""
_FAMILY = "e AS (SELECT DISTINCT child_def_id AS src, base_def_id AS dst FROM inherits_edges WHERE base_def_id IS NOT NULL)"

ORACLES = {
    "g_resolve": f"WITH {_part(1)} SELECT def_id, name, kind, language FROM defs WHERE def_id IN (SELECT def_id FROM seeds)",
    "g_callers": f"WITH {_part(1)} SELECT def_id, name, kind, language FROM defs WHERE def_id IN (SELECT src FROM calls WHERE confidence = 'certain' AND dst IN (SELECT def_id FROM seeds))",
    "g_callees": f"WITH {_part(1)} SELECT def_id, name, kind, language FROM defs WHERE language IN ('python', 'go') AND def_id IN (SELECT dst FROM calls WHERE src IN (SELECT def_id FROM seeds))",
    "g_reachable": f"WITH RECURSIVE {_part(1)}, {_WALK.format(edges='edges', at='src', to='dst')} SELECT def_id, CAST(min(depth) AS BIGINT) AS depth FROM w GROUP BY def_id",
    "g_ancestors": f"WITH RECURSIVE {_part(1)}, {_UNSURE}, {_WALK.format(edges='unsure', at='dst', to='src')} SELECT def_id, CAST(min(depth) AS BIGINT) AS depth FROM w GROUP BY def_id",
    "g_is_reachable": f"WITH RECURSIVE {B.CTES}, r AS (SELECT dst FROM edges WHERE src = 1 UNION SELECT e.dst FROM r JOIN edges e ON e.src = r.dst) SELECT count(*) > 0 AS reachable FROM r WHERE dst = 2",
    "g_paths": f"WITH RECURSIVE {B.CTES}, {_PATHS.format(edges='edges', src='1', dst='2', depth=4)}",
    "g_entrypoints": f"WITH {B.CTES}, {_CERTAIN}, {_ENTRIES} SELECT * FROM entries",
    "g_entrypoints_reaching": f"WITH RECURSIVE {_part(1)}, {_CERTAIN}, {_ENTRIES}, {_WALK.format(edges='certain', at='dst', to='src')} SELECT def_id, min(depth) AS depth FROM w WHERE def_id IN (SELECT def_id FROM entries) GROUP BY def_id",
    "g_entrypoint_paths": f"WITH RECURSIVE {_part(1)}, {_CERTAIN}, {_ENTRIES}, {_WALK.format(edges='certain', at='dst', to='src')}, starts AS (SELECT def_id FROM entries WHERE def_id IN (SELECT def_id FROM w WHERE depth <= 3)), "
    + _PATHS.format(edges="certain", src="SELECT def_id FROM starts", dst="SELECT def_id FROM seeds", depth=3),
    "g_writers": f"WITH {B.CTES} SELECT def_id, name, kind, language FROM defs WHERE def_id IN (SELECT accessor_def_id FROM acc WHERE access_type = 'write' AND target_def_id IN (SELECT s_suppkey + {B.SUPPLIER_OFFSET} FROM supplier WHERE s_name = 'Supplier#000000001'))",
    "g_taint_paths": f"WITH RECURSIVE {B.CTES}, {_FLOWS}, {_PATHS.format(edges='flows', src='1', dst='2', depth=4)}",
    "g_code_resolve": f"WITH {B.VALID_DEFS} SELECT id AS def_id, name, kind, branch_id, file_path FROM (SELECT v.id, v.name, v.kind, f.branch_id, f.file_path, row_number() OVER (PARTITION BY v.id ORDER BY f.branch_id, f.file_path) AS n FROM valid v JOIN files f USING (file_version_id)) WHERE n = 1",
    "g_linearize": f"""WITH RECURSIVE e AS (SELECT child_def_id AS src, base_def_id AS dst, min(ord) AS ord FROM inherits_edges WHERE base_def_id IS NOT NULL AND child_def_id <> base_def_id GROUP BY ALL),
p AS (SELECT src, dst, [ord] AS route, [src, dst] AS seen FROM e UNION ALL SELECT p.src, e.dst, list_append(p.route, e.ord), list_append(p.seen, e.dst) FROM p JOIN e ON e.src = p.dst WHERE NOT list_contains(p.seen, e.dst)),
best AS (SELECT src, dst, min(struct_pack(n := len(route), r := route)) AS b FROM p GROUP BY ALL)
SELECT src AS def_id, string_agg(CAST(dst AS VARCHAR), '>' ORDER BY b, dst) AS ancestors FROM best GROUP BY src""",
    "g_overrides": f"""WITH RECURSIVE {B.VALID_DEFS}, e AS (SELECT child_def_id AS src, base_def_id AS dst, min(ord) AS ord FROM inherits_edges WHERE base_def_id IS NOT NULL AND child_def_id <> base_def_id GROUP BY ALL),
p AS (SELECT src, dst, [ord] AS route, [src, dst] AS seen FROM e UNION ALL SELECT p.src, e.dst, list_append(p.route, e.ord), list_append(p.seen, e.dst) FROM p JOIN e ON e.src = p.dst WHERE NOT list_contains(p.seen, e.dst)),
m AS (SELECT DISTINCT id, scope_id, name, kind FROM valid WHERE scope_id IS NOT NULL AND kind IN ('function', 'method', 'modifier', 'constructor') AND file_version_id IN (SELECT file_version_id FROM files)),
best AS (SELECT src, dst, min(struct_pack(n := len(route), r := route)) AS b FROM p GROUP BY ALL)
SELECT c.id AS child_def_id, arg_min(x.id, struct_pack(b := best.b, d := best.dst, i := x.id)) AS base_def_id FROM m c JOIN best ON best.src = c.scope_id JOIN m x ON x.scope_id = best.dst AND x.name = c.name AND x.kind = c.kind GROUP BY c.id""",
    "g_neighborhood": f"""WITH RECURSIVE {_FAMILY}, s AS (SELECT CAST(src AS VARCHAR) AS a, CAST(dst AS VARCHAR) AS b FROM e UNION SELECT CAST(dst AS VARCHAR), CAST(src AS VARCHAR) FROM e), n0 AS (SELECT min(a) AS node FROM s),
n1 AS (SELECT DISTINCT b AS node FROM s WHERE a IN (SELECT node FROM n0) AND b NOT IN (SELECT node FROM n0)), k1 AS (SELECT node FROM n1 ORDER BY node LIMIT 19), h1 AS (SELECT * FROM n0 UNION SELECT * FROM k1),
n2 AS (SELECT DISTINCT b AS node FROM s WHERE a IN (SELECT node FROM k1) AND b NOT IN (SELECT node FROM h1)), k2 AS (SELECT node FROM (SELECT node, row_number() OVER (ORDER BY node) AS r FROM n2) WHERE r <= 20 - (SELECT count(*) FROM h1)), h2 AS (SELECT * FROM h1 UNION SELECT * FROM k2),
n3 AS (SELECT DISTINCT b AS node FROM s WHERE a IN (SELECT node FROM k2) AND b NOT IN (SELECT node FROM h2)), k3 AS (SELECT node FROM (SELECT node, row_number() OVER (ORDER BY node) AS r FROM n3) WHERE r <= 20 - (SELECT count(*) FROM h2)), h3 AS (SELECT * FROM h2 UNION SELECT * FROM k3)
SELECT node, (SELECT count(*) FROM n1) > 19 OR (SELECT count(*) FROM n2) > 20 - (SELECT count(*) FROM h1) OR (SELECT count(*) FROM n3) > 20 - (SELECT count(*) FROM h2) AS truncated FROM h3""",
    "g_family_walk": f"WITH RECURSIVE {_FAMILY}, roots AS (SELECT DISTINCT dst AS def_id FROM e WHERE dst NOT IN (SELECT src FROM e)), w AS (SELECT DISTINCT e.src AS def_id, 1 AS depth FROM e WHERE dst IN (SELECT def_id FROM roots) UNION SELECT e.src, w.depth + 1 FROM w JOIN e ON e.dst = w.def_id WHERE w.depth < 80) SELECT def_id, CAST(min(depth) AS BIGINT) AS depth FROM w GROUP BY def_id",
}
