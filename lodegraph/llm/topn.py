"""Top N items of every group by statistics-guided skipping.

The current hits are written once, clustered by group and by descending score, in
small row groups. The footers of these files tell for each row group its best score, how
many rows it has and whether it lies inside one group. Row groups behind a group's N-th
row, that is strictly below its N-th score or tied with it and later by item, are never
read; the others are read in descending order of their best score, and the N-th score
that a reader has met so far skips more of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.storage import scratch_path

#: Bytes of a row group: small enough that a reader holds several, large enough to scan.
ROW_GROUP_BYTES = 1 << 20


def current_hits(hits: DataFrame, group: list[str], item: str, score: str, id_col: str) -> DataFrame:
    """(group, item, score, id): of each group and item the hit with the largest id.

    Hits whose score is then null or NaN are left out. Null ids lose to any other id.
    """
    newest = hits.groupBy(*group, item).agg(F.max_by(F.col(score).cast("double"), id_col).alias("_score"), F.max(id_col).alias("_id"))
    return newest.filter(F.col("_score").isNotNull() & ~F.isnan("_score")).select(*group, item, (F.col("_score") + F.lit(0.0)).alias(score), F.col("_id").alias(id_col))


def _footers(columns: list[str], score: str, limit: str):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.fs
        import pyarrow.parquet as pq

        for batch in batches:
            rows = []
            for path in batch["path"]:
                fs, inner = pyarrow.fs.FileSystem.from_uri(path)
                with fs.open_input_file(inner) as file:
                    meta = pq.ParquetFile(file).metadata
                part = int(re.search(r"part-(\d+)", path.rsplit("/", 1)[-1])[1])
                at = {meta.schema.column(i).path: i for i in range(meta.num_columns)}
                for g in range(meta.num_row_groups):
                    rg = meta.row_group(g)
                    stats = {c: rg.column(at[c]).statistics for c in [*columns, score, limit]}
                    # a row group is of one group when all its key columns are constant and known
                    whole = all(s is not None and s.has_min_max and s.null_count == 0 and s.min == s.max for s in (stats[c] for c in columns))
                    s = stats[score]
                    known = s is not None and s.has_min_max
                    only, cap = (repr([stats[c].min for c in columns]), stats[limit].max) if whole else (None, 0)
                    rows.append((path, part, g, rg.num_rows, only, cap, float(s.max) if known else float("inf")))
            yield pd.DataFrame(rows, columns=["path", "part", "rg", "n", "only", "cap", "best"])

    return read


def _reader(group: list[str], item: str, score: str, limit: str, columns: list[str]):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import heapq

        import pyarrow.fs
        import pyarrow.parquet as pq

        parts = [b for b in batches if len(b)]
        if not parts:
            return
        todo = pd.concat(parts, ignore_index=True)
        nth: dict[str, list[float]] = {}  # best scores met so far, of groups that have row groups of their own
        at, file = None, None
        for r in todo.sort_values("best", ascending=False).itertuples():
            single = isinstance(r.only, str)
            heap = nth.setdefault(r.only, []) if single else []
            if single and len(heap) >= r.cap and r.best < heap[0]:
                continue
            if r.path != at:
                fs, inner = pyarrow.fs.FileSystem.from_uri(r.path)
                at, file = r.path, pq.ParquetFile(fs.open_input_file(inner))
            rows = file.read_row_group(r.rg, columns=columns).to_pandas()
            # rows of a group come best first, so no more than its first N matter here
            rows = rows[rows.groupby(group, sort=False, dropna=False).cumcount() < rows[limit]]
            if single:
                for x in rows[score]:
                    (heapq.heappush if len(heap) < r.cap else heapq.heappushpop)(heap, x)
            yield rows

    return read


def top_n(hits: DataFrame, limits: DataFrame, group: list[str], item: str, score: str, id_col: str, limit_key: str, limit: str) -> DataFrame:
    """(group, item, score, id, rank): the first N current hits of every group.

    Order: score descending, then item ascending by bytes. `limits` gives N for each
    value of `limit_key`, one of the group columns; groups without an N, or with a null
    one, have no rows. Null group or item values count as values. An empty table gives
    an empty result. Further columns of `hits` are ignored.
    """
    spark = hits.sparkSession
    ns = limits.filter(F.col(limit) > 0).groupBy(limit_key).agg(F.max(limit).cast("int").alias("_n"))
    current = current_hits(hits, group, item, score, id_col).join(ns, limit_key)
    order = [*[F.col(g).asc_nulls_first() for g in group], F.col(score).desc(), F.col(item).asc_nulls_first()]
    columns = [*group, item, score, id_col, "_n"]
    clustered = scratch_path(spark, "topn")
    current.select(*columns).repartitionByRange(*order).sortWithinPartitions(*order).write.option("parquet.block.size", ROW_GROUP_BYTES).option("parquet.page.size", ROW_GROUP_BYTES // 8).parquet(clustered)

    written = spark.read.schema(current.select(*columns).schema).parquet(clustered)
    files = spark.createDataFrame([(f,) for f in written.inputFiles()], "path string")
    parts = max(1, min(files.count(), spark.sparkContext.defaultParallelism * 4))
    groups = files.repartition(parts).mapInPandas(_footers(group, score, "_n"), "path string, part int, rg int, n long, only string, cap int, best double")
    # the files are in the order of the rows, so of a group that has row groups of its own,
    # those behind N rows hold nothing: they are below the N-th score, or tie with it and
    # come later by item
    ahead = Window.partitionBy("only").orderBy("part", "path", "rg").rowsBetween(Window.unboundedPreceding, -1)
    own = groups.filter("only IS NOT NULL").withColumn("_ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0))).filter("_ahead < cap").drop("_ahead")
    wanted = groups.filter("only IS NULL").unionByName(own).select("path", "rg", "only", "cap", "best")
    schema = written.select(*columns).schema
    kept = wanted.repartition(parts, F.coalesce("only", F.concat("path", F.lit("#"), "rg"))).mapInPandas(_reader(group, item, score, "_n", columns), schema)
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(F.col(score).desc(), F.col(item).asc_nulls_first())))
    return ranked.filter(F.col("rank") <= F.col("_n")).drop("_n")
