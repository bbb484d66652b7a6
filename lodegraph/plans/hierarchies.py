"""Queries over definitions.scope_id and inherits_edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.operators.cycles import cycle_members
from lodegraph.operators.hierarchy import descendants, latest_rows, resolve_hierarchy
from lodegraph.storage import read_table

#: A scope nested at least this deep is reported by p4_found.
DEEP = 6


def scopes(spark: SparkSession, sf_dir: str, names: bool = False, paths: bool = True) -> DataFrame:
    valid = latest_rows(read_table(spark, sf_dir, "definitions"), "id", "indexed_at", ["scope_id", *["name"] * names])
    return resolve_hierarchy(valid, "id", "scope_id", "name" if names else None, paths=paths)


def p4_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scopes(spark, sf_dir, names=True).select(F.col("id").alias("def_id"), "path", "depth", "root_id", "cyclic")


def p4_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return descendants(scopes(spark, sf_dir))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    deep = scopes(spark, sf_dir, paths=False).filter((F.col("depth") >= DEEP) | F.col("cyclic"))
    edges = read_table(spark, sf_dir, "inherits_edges")
    circular = cycle_members(edges, "child_def_id", "base_def_id")
    minus = F.lit(-1).cast("long")
    return deep.select(F.lit("scope").alias("relation"), F.col("id").alias("def_id"), "root_id", "depth").unionByName(
        circular.select(F.lit("inherits").alias("relation"), F.col("id").alias("def_id"), minus.alias("root_id"), minus.alias("depth"))
    )


QUERIES = {"p4_found": p4_found, "p4_paths": p4_paths, "p4_descendants": p4_descendants}

_VALID = """valid AS (
  SELECT id, scope_id, name FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC, scope_id DESC NULLS LAST, name DESC NULLS LAST) AS rn
    FROM definitions WHERE id IS NOT NULL)
  WHERE rn = 1)"""

_TREE = f"""{_VALID},
tree AS (
  SELECT v.id, v.id AS root_id, CAST(0 AS BIGINT) AS depth, coalesce(v.name, '') AS path
  FROM valid v WHERE v.scope_id IS NULL OR v.scope_id NOT IN (SELECT id FROM valid)
  UNION ALL
  SELECT v.id, t.root_id, t.depth + 1, t.path || '.' || coalesce(v.name, '')
  FROM tree t JOIN valid v ON v.scope_id = t.id)"""

ORACLES = {
    "p4_paths": f"""WITH RECURSIVE {_TREE}
SELECT v.id AS def_id, t.path AS path, coalesce(t.depth, -1) AS depth, coalesce(t.root_id, -1) AS root_id, t.id IS NULL AS cyclic
FROM valid v LEFT JOIN tree t ON t.id = v.id""",
    "p4_descendants": f"""WITH RECURSIVE {_TREE},
up AS (
  SELECT v.id AS descendant_id, v.scope_id AS ancestor_id, CAST(1 AS BIGINT) AS distance
  FROM valid v JOIN tree t ON t.id = v.id WHERE t.depth > 0
  UNION ALL
  SELECT u.descendant_id, v.scope_id, u.distance + 1
  FROM up u JOIN valid v ON v.id = u.ancestor_id JOIN tree t ON t.id = v.id WHERE t.depth > 0)
SELECT ancestor_id, descendant_id, distance FROM up""",
    "p4_found": f"""WITH RECURSIVE {_TREE},
e AS (SELECT DISTINCT child_def_id AS a, base_def_id AS b FROM inherits_edges WHERE child_def_id IS NOT NULL AND base_def_id IS NOT NULL),
r AS (SELECT a AS origin, b AS met FROM e UNION SELECT r.origin, e.b FROM r JOIN e ON e.a = r.met)
SELECT 'scope' AS relation, v.id AS def_id, coalesce(t.root_id, -1) AS root_id, coalesce(t.depth, -1) AS depth
FROM valid v LEFT JOIN tree t ON t.id = v.id WHERE t.id IS NULL OR t.depth >= 6
UNION ALL
SELECT DISTINCT 'inherits', origin, CAST(-1 AS BIGINT), CAST(-1 AS BIGINT) FROM r WHERE origin = met""",
}
