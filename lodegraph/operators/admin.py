"""Branches, garbage and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.operators.frames import missing


def files_per_branch(branches: DataFrame, files: DataFrame) -> DataFrame:
    """(branch_id, n_files), 0 for branches without files."""
    n = files.groupBy("branch_id").agg(F.count("*").alias("n_files"))
    return branches.select("branch_id").join(n, "branch_id", "left").na.fill(0, ["n_files"])


def set_default(branches: DataFrame, repo_id: int, branch_id: int) -> DataFrame:
    """Branches with one default for the repository; an unknown branch changes nothing."""
    own = F.col("repo_id") == repo_id
    known = not branches.filter(own & (F.col("branch_id") == branch_id)).isEmpty()
    return branches.withColumn("is_default", F.when(own, F.col("branch_id") == branch_id).otherwise(F.col("is_default"))) if known else branches


def drop_branch(df: DataFrame, branch_id: int) -> DataFrame:
    return df.filter(~F.col("branch_id").eqNullSafe(F.lit(branch_id)))


def orphan_versions(versions: DataFrame, files: DataFrame) -> DataFrame:
    """File versions that no branch holds any more."""
    return missing(versions, files.filter("file_version_id IS NOT NULL"), ["file_version_id"])


def orphan_embeddings(embeddings: DataFrame, chunks: DataFrame) -> DataFrame:
    return missing(embeddings, chunks.filter("content_hash IS NOT NULL"), ["content_hash"])


def resolved_share(references: DataFrame, target: str) -> DataFrame:
    """(n, n_resolved, percent): percent rounded down; null where there is none."""
    out = references.agg(F.count("*").alias("n"), F.count_if(F.col(target).isNotNull()).alias("n_resolved"))
    return out.withColumn("percent", F.when(F.col("n") > 0, F.floor(F.col("n_resolved") * 100 / F.col("n"))))


def top_sources(edges: DataFrame, n: int) -> DataFrame:
    """(src, n): the definitions with the most outgoing edges; ties by id."""
    return edges.groupBy("src").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "src").limit(n)
