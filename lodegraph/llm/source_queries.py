"""Queries over source files: p2, p3 and p7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.llm.parsing import check_files, invalid_rates
from lodegraph.llm.provenance import classify_files, explain_files
from lodegraph.llm.secrets import redact_files, secret_lines
from lodegraph.storage import read_table

_CAPTURED = ("capture_id", "repo_id", "path", "content")


def p2_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check_files(read_table(spark, sf_dir, "index_files"), read_table(spark, sf_dir, "file_versions"))


def p2_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return invalid_rates(p2_flags(spark, sf_dir))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_flags(spark, sf_dir).filter("NOT valid").select("file_version_id").distinct()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_lines(read_table(spark, sf_dir, "captured_files"), *_CAPTURED)


def p3_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact_files(read_table(spark, sf_dir, "captured_files"), *_CAPTURED)


def p7_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_files(*[read_table(spark, sf_dir, t) for t in ("index_files", "file_versions", "captured_files")])


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_kinds(spark, sf_dir).select("repo_id", "path")


def p7_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by what tells that they are not hand-written."""
    files = explain_files(*[read_table(spark, sf_dir, t) for t in ("index_files", "file_versions", "captured_files")])
    return files.groupBy(F.array_join("reasons", "+").alias("reasons")).agg(F.count("*").alias("files"))


QUERIES = {"p2_found": p2_found, "p2_flags": p2_flags, "p2_rates": p2_rates, "p3_found": p3_found, "p3_redacted": p3_redacted, "p7_found": p7_found, "p7_kinds": p7_kinds, "p7_reasons": p7_reasons}
