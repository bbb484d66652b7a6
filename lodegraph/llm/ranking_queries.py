"""Queries over candidate_hits: p5 and p6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.llm.fusion import fuse_rankings, order_items
from lodegraph.llm.topn import top_n
from lodegraph.storage import read_table

CHANNELS = {"semantic": 1, "exact": 1, "lexical": 1}


def p5_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = read_table(spark, sf_dir, "candidate_hits")
    runs = read_table(spark, sf_dir, "retrieval_runs")
    return top_n(hits, runs, ["run_id", "source_site_id"], "target_site_id", "fused_score", "hit_id", "run_id", "candidate_limit")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_top(spark, sf_dir).select("hit_id")


def p6_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = read_table(spark, sf_dir, "candidate_hits")
    fused = fuse_rankings(hits, "run_id", "source_site_id", "target_site_id", "hit_id", "channels", CHANNELS)
    return order_items(fused, "run_id", "source_site_id", "target_site_id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = read_table(spark, sf_dir, "judged_sources").groupBy("run_id", "source_site_id").agg(F.max("n_wanted").alias("n_wanted"))
    return p6_order(spark, sf_dir).join(wanted, ["run_id", "source_site_id"]).filter("rank <= n_wanted").select("run_id", "source_site_id", "target_site_id")


QUERIES = {"p5_found": p5_found, "p5_top": p5_top, "p6_found": p6_found, "p6_order": p6_order}

_TOP = """SELECT run_id, source_site_id, target_site_id, fused_score, hit_id, rank FROM (
  SELECT h.run_id, h.source_site_id, h.target_site_id, h.fused_score, h.hit_id, r.candidate_limit,
         CAST(row_number() OVER (PARTITION BY h.run_id, h.source_site_id ORDER BY h.fused_score DESC, h.target_site_id) AS INTEGER) AS rank
  FROM (SELECT *, row_number() OVER (PARTITION BY run_id, source_site_id, target_site_id ORDER BY hit_id DESC) AS newest FROM candidate_hits) h
  JOIN retrieval_runs r USING (run_id)
  WHERE newest = 1 AND fused_score IS NOT NULL AND NOT isnan(fused_score))
WHERE rank <= candidate_limit"""

ORACLES = {"p5_top": _TOP, "p5_found": f"SELECT hit_id FROM ({_TOP})"}
