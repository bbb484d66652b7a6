"""Queries over chunks and documents: p1, p8, p9 and p10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.llm.bpe import encode_corpus
from lodegraph.llm.chunking import split_oversized, token_count
from lodegraph.llm.mojibake import restore_corpus
from lodegraph.llm.packing import pack_documents
from lodegraph.storage import read_table

MAX_TOKENS, OVERLAP = 1000, 50
CAPACITY = 2048


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(read_table(spark, sf_dir, "chunks"), "id", "content", MAX_TOKENS, OVERLAP).withColumnRenamed("id", "chunk_id")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_pieces(spark, sf_dir).select("chunk_id").distinct()


def p1_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What pieces add up to without their overlaps, and how many break a rule: over the
    limit, or with another count than their text."""
    p = p1_pieces(spark, sf_dir)
    broken = (F.col("token_count") > MAX_TOKENS) | (token_count("content") != F.col("token_count"))
    total = F.sum("token_count") - OVERLAP * (F.count("*") - 1)
    return p.groupBy("chunk_id").agg(total.alias("n_tokens"), F.count_if(broken).alias("n_broken"))


def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose pieces leave out or repeat tokens, and containers over the capacity:
    none where all is well."""
    packed = p9_containers(spark, sf_dir)
    over = packed.groupBy("container").agg(F.sum("n_tokens").alias("n")).filter(F.col("n") > CAPACITY).select(F.col("container").alias("what"))
    ends = packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.max(F.col("first_token") + F.col("n_tokens")).alias("last"))
    return over.unionByName(ends.filter("n <> last").select(F.col("doc_id").cast("string").alias("what")))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(read_table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"), "doc_id", "text", CAPACITY)


def p10_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restore_corpus(read_table(spark, sf_dir, "documents"), "doc_id", "text")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_restored(spark, sf_dir).select("doc_id").distinct()


QUERIES = {"p1_found": p1_found, "p1_pieces": p1_pieces, "p1_totals": p1_totals, "p9_fill": p9_fill, "p8_ids": p8_ids, "p9_containers": p9_containers, "p10_found": p10_found, "p10_restored": p10_restored}

ORACLES = {
    "p1_found": r"""SELECT DISTINCT id AS chunk_id FROM chunks
WHERE len(regexp_extract_all(content, '[A-Za-z0-9_]+|[^ \t\r\n]')) > 1000""",
    "p1_totals": r"""SELECT id AS chunk_id, any_value(len(regexp_extract_all(content, '[A-Za-z0-9_]+|[^ \t\r\n]'))) AS n_tokens, 0 AS n_broken FROM chunks
WHERE len(regexp_extract_all(content, '[A-Za-z0-9_]+|[^ \t\r\n]')) > 1000 GROUP BY id""",
    "p9_fill": "SELECT CAST(doc_id AS VARCHAR) AS what FROM documents WHERE false",
}
