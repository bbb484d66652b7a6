"""Source files that do not parse: flags for files, rates for repositories."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.syntax.languages import ENDINGS, GRAMMAR_OF, first_error
from lodegraph.storage import materialize


def ending_language(path: str | Column) -> Column:
    """The language that a path's ending stands for; null for other endings."""
    ending = F.lower(F.regexp_extract(path, r"[^/]\.([A-Za-z0-9]+)$", 1))
    table = F.create_map(*[F.lit(x) for pair in ENDINGS.items() for x in pair])
    return F.element_at(table, ending)


def check_files(index: DataFrame, versions: DataFrame) -> DataFrame:
    """(repo_id, rel_path, file_version_id, language, valid, line, col, found) of each
    distinct file of the index whose ending names a language.

    Every distinct content is parsed once for each language that it is filed under. line
    and col (from 1) are those of the first error that no continuation can mend, found
    is what stands there; they are null for valid files. A missing or null content has
    a null flag; an empty one is valid.
    """
    spark = index.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    files = index.select("repo_id", "rel_path", "file_version_id", ending_language("rel_path").alias("dialect")).filter("dialect IS NOT NULL").distinct()
    files = materialize(files, "parse-files")
    hashed = versions.select(F.col("id").alias("file_version_id"), F.sha2("raw_content", 256).alias("_sha"), "raw_content").filter("raw_content IS NOT NULL")
    ids = hashed.select("file_version_id", "_sha").distinct()
    wanted = files.join(ids, "file_version_id").select("_sha", "dialect").distinct().groupBy("_sha").agg(F.collect_set("dialect").alias("dialects"))
    # equal contents meet by hash; the number of partitions is set, as parsing is what costs
    contents = hashed.select("_sha", "raw_content").repartition(parts, "_sha").dropDuplicates(["_sha"])
    todo = contents.join(wanted.repartition(parts, "_sha"), "_sha")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for sha, text, dialects in zip(pdf["_sha"], pdf["raw_content"], pdf["dialects"]):
                for dialect in dialects:
                    error = first_error(text, dialect)
                    rows.append((sha, dialect, error is None, *(error or (None, None, None))))
            out = pd.DataFrame(rows, columns=["_sha", "dialect", "valid", "line", "col", "found"])
            yield out.astype({"line": "Int32", "col": "Int32"})

    verdicts = materialize(todo.mapInPandas(parse, "_sha string, dialect string, valid boolean, line int, col int, found string"), "parse-verdicts")
    table = F.create_map(*[F.lit(x) for pair in GRAMMAR_OF.items() for x in pair])
    joined = files.join(ids, "file_version_id", "left").join(verdicts, ["_sha", "dialect"], "left")
    return joined.select("repo_id", "rel_path", "file_version_id", F.coalesce(F.element_at(table, F.col("dialect")), "dialect").alias("language"), "valid", "line", "col", "found")


def invalid_rates(checked: DataFrame) -> DataFrame:
    """(repo_id, language, n_files, n_invalid, share) over distinct file versions of known validity."""
    versions = checked.filter("valid IS NOT NULL").groupBy("repo_id", "language", "file_version_id").agg(F.min("valid").alias("valid"))
    counted = versions.groupBy("repo_id", "language").agg(F.count("*").alias("n_files"), F.sum((~F.col("valid")).cast("long")).alias("n_invalid"))
    return counted.withColumn("share", F.col("n_invalid") / F.col("n_files"))
