"""The star-schema tables read as a code graph: parts are definitions, consecutive lines of
an order are calls, suppliers hold the data that parts access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodegraph.storage import read_table

KINDS = ("function", "method", "module", "class")
LANGUAGES = ("python", "go", "rust")
SUPPLIER_OFFSET = 100_000_000


def _pick(number, names):
    out = F.lit(names[-1])
    for i, name in enumerate(names[:-1]):
        out = F.when(number % len(names) == i, name).otherwise(out)
    return out


def definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("def_id"),
        F.col("p_name").alias("name"),
        F.concat_ws(".", "p_type", "p_brand", "p_name").alias("qualified_name"),
        _pick(F.col("p_size"), KINDS).alias("kind"),
        F.when(F.col("p_size") % 5 == 0, "internal").alias("visibility"),
        _pick(F.col("p_size"), LANGUAGES).alias("language"),
        F.concat_ws("/", "p_type", "p_brand").alias("file_path"),
        F.lit(1).alias("branch_id"),
    )


_DEFS = """SELECT p_partkey AS def_id, p_name AS name, p_type || '.' || p_brand || '.' || p_name AS qualified_name,
  CASE p_size % 4 WHEN 0 THEN 'function' WHEN 1 THEN 'method' WHEN 2 THEN 'module' ELSE 'class' END AS kind,
  CASE WHEN p_size % 5 = 0 THEN 'internal' END AS visibility,
  CASE p_size % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'go' ELSE 'rust' END AS language,
  p_type || '/' || p_brand AS file_path FROM part"""

_LINE = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read_table(spark, sf_dir, "lineitem")
    following = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy(*_LINE))
    return line.select(F.col("l_partkey").alias("src"), following.alias("dst"), _confidence().alias("confidence"), F.lit(1).alias("branch_id"))


def _confidence():
    return F.when(F.col("l_returnflag") == "A", "certain").when(F.col("l_returnflag") == "N", "inferred").otherwise("uncertain")


_CALLS = f"""SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_LINE)}) AS dst,
  CASE l_returnflag WHEN 'A' THEN 'certain' WHEN 'N' THEN 'inferred' ELSE 'uncertain' END AS confidence FROM lineitem"""


def accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read_table(spark, sf_dir, "lineitem")
    return line.select(F.col("l_partkey").alias("accessor_def_id"), (F.col("l_suppkey") + SUPPLIER_OFFSET).alias("target_def_id"), F.when(F.col("l_linestatus") == "F", "write").otherwise("read").alias("access_type"), F.lit(1).alias("branch_id"))


_ACCESSES = f"SELECT l_partkey AS accessor_def_id, l_suppkey + {SUPPLIER_OFFSET} AS target_def_id, CASE WHEN l_linestatus = 'F' THEN 'write' ELSE 'read' END AS access_type FROM lineitem"

#: The bridge as common table expressions of DuckDB.
CTES = f"defs AS ({_DEFS}), calls AS ({_CALLS}), acc AS ({_ACCESSES}), edges AS (SELECT DISTINCT src, dst FROM calls WHERE dst IS NOT NULL)"


def name_of(spark: SparkSession, sf_dir: str, part: int) -> str:
    """Name of a part: the text of a query."""
    return read_table(spark, sf_dir, "part").filter(F.col("p_partkey") == part).select("p_name").first()[0]


# -- the project's own tables -----------------------------------------------------------


def code_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid definitions with their file's path and branch; one row for each path and branch."""
    from lodegraph.operators.hierarchy import latest_rows

    d = latest_rows(read_table(spark, sf_dir, "definitions"), "id", "indexed_at", ["file_version_id", "kind", "name", "scope_id", "visibility", "start_byte", "end_byte"])
    files = read_table(spark, sf_dir, "index_files").select("branch_id", "repo_id", "file_version_id", F.col("rel_path").alias("file_path")).distinct()
    return d.withColumnRenamed("id", "def_id").join(files, "file_version_id")


VALID_DEFS = """valid AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC, file_version_id DESC, kind DESC, name DESC, scope_id DESC NULLS LAST) AS rn FROM definitions WHERE id IS NOT NULL) WHERE rn = 1),
files AS (SELECT DISTINCT branch_id, repo_id, file_version_id, rel_path AS file_path FROM index_files)"""
