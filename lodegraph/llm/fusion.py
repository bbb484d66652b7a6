"""One ranking from several scores of different scales.

Each channel's scores become ranks (shares of the run's scores that are lower), the
correlation matrix of the ranks is gathered in one distributed pass for each run, and
items are sorted by their projection on its first principal component.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.operators.joins import BROADCAST_BYTES, join_few_keys
from lodegraph.operators.ranks import distributed_row_number
from lodegraph.storage import materialize

#: Points of the rank transform; between two of them ranks are interpolated, so the
#: order within a channel is never lost.
GRID = 1000


def principal_loadings(corr: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """First principal component of a correlation matrix, each loading with the sign of
    its declared direction. Undefined correlations (a constant channel) count as 0."""
    m = np.nan_to_num(np.asarray(corr, float), nan=0.0)
    np.fill_diagonal(m, 1.0)
    _, vectors = np.linalg.eigh(m)
    return np.abs(vectors[:, -1]) * np.sign(directions)


def channel_scores(hits: DataFrame, group: list[str], item: str, id_col: str, channels: str, names: list[str]) -> DataFrame:
    """(group, item, one double for each channel): of each group and item the hit with
    the largest id. A missing channel, null score or NaN is null: not found there."""
    flat = hits.select(*group, item, F.col(id_col).alias("_id"), *[F.col(channels)[n]["score"].cast("double").alias(f"_{i}") for i, n in enumerate(names)])
    newest = flat.groupBy(*group, item).agg(*[F.max_by(f"_{i}", "_id").alias(f"_{i}") for i in range(len(names))])
    return newest.select(*group, item, *[F.when(~F.isnan(f"_{i}"), F.col(f"_{i}")).alias(n) for i, n in enumerate(names)])


def _curve(grid: list[float] | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Values and their ranks in (0, 1]; a value that fills several points of the grid gets
    their middle."""
    if grid is None or len(grid) == 0:
        return None
    points, first = np.unique(np.asarray(grid, float), return_index=True)
    last = np.append(first[1:], len(grid)) - 1
    return points, 1 / len(grid) + (1 - 1 / len(grid)) * (first + last) / 2 / max(1, len(grid) - 1)


def _to_ranks(names: list[str], shared: Broadcast | None):
    """Scores to ranks by the curve of their run, which is in `shared` or, without it, in
    the row; 0 where there is no score."""

    def convert(batches):
        for pdf in batches:
            out = pdf[["_run", "_source", "_item", *names]].copy()
            ranks = {n: np.zeros(len(pdf)) for n in names}
            for run, at in pdf.groupby("_run", dropna=False, sort=False).indices.items():
                key = None if pd.isna(run) else run
                for n in names:
                    curve = shared.value[key][n] if shared is not None else _curve(pdf[f"_g_{n}"].iloc[at[0]])
                    if curve is not None:
                        x = pdf[n].to_numpy(float)[at]
                        ranks[n][at] = np.where(np.isnan(x), 0.0, np.interp(np.nan_to_num(x), *curve))
            yield out.assign(**ranks)

    return convert


def _ranks(scores: DataFrame, names: list[str]) -> DataFrame:
    """Scores as ranks of their run and channel. The grids of few runs, counted, are sent
    to every task once; those of many are joined to the rows."""
    shares = [float(x) for x in np.linspace(0, 1, GRID + 1)]
    grids = materialize(scores.groupBy("_run").agg(*[F.percentile_approx(n, shares, 10 * GRID).alias(f"_g_{n}") for n in names]), "fuse-grids")
    row_bytes = 8 * (GRID + 2) * len(names)
    if grids.count() * row_bytes > BROADCAST_BYTES:
        return join_few_keys(scores, grids, "_run", row_bytes, "_item").mapInPandas(_to_ranks(names, None), scores.schema)
    curves = {r["_run"]: {n: _curve(r[f"_g_{n}"]) for n in names} for r in grids.collect()}
    return scores.mapInPandas(_to_ranks(names, scores.sparkSession.sparkContext.broadcast(curves)), scores.schema)


def fuse_rankings(hits: DataFrame, run: str, source: str, item: str, id_col: str, channels: str, directions: dict[str, int]) -> DataFrame:
    """(run, source, item, projection): one comparable score for each item.

    `directions` names the channels and says whether higher (1) or lower (-1) scores are
    better. An item that a channel did not find ranks below all that it found. Only the
    hit with the largest id of each run, source and item counts. Null runs, sources and
    items count as values; a run whose channels all lack scores projects to 0.
    """
    names = list(directions)
    signs = np.array([1 if directions[n] > 0 else -1 for n in names])
    scores = channel_scores(hits, [run, source], item, id_col, channels, names)
    up = scores.select(F.col(run).alias("_run"), F.col(source).alias("_source"), F.col(item).alias("_item"), *[(F.col(n) * int(s)).alias(n) for n, s in zip(names, signs)])
    up = materialize(up, "fuse-scores")
    ranked = _ranks(up, names)
    ranked = materialize(ranked, "fuse-ranks")

    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]
    # a constant channel correlates with none; corr would divide by its spread of 0
    matrices = ranked.groupBy("_run").agg(*[F.try_divide(F.covar_pop(names[i], names[j]), F.stddev_pop(names[i]) * F.stddev_pop(names[j])).alias(f"_c{i}_{j}") for i, j in pairs])

    def components(batches):
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                m = np.eye(len(names))
                for i, j in pairs:
                    m[i, j] = m[j, i] = np.nan if r[f"_c{i}_{j}"] is None else r[f"_c{i}_{j}"]
                rows.append([r["_run"], *np.abs(principal_loadings(m, signs))])
            yield pd.DataFrame(rows, columns=["_run", *[f"_w{i}" for i in range(len(names))]]).astype({"_run": pdf["_run"].dtype})

    run_type = dict(ranked.dtypes)["_run"]
    loadings = matrices.mapInPandas(components, f"_run {run_type}, " + ", ".join(f"_w{i} double" for i in range(len(names))))
    both = join_few_keys(ranked, materialize(loadings, "fuse-loadings"), "_run", 64, "_item")
    total = sum((F.col(n) * F.col(f"_w{i}") for i, n in enumerate(names)), F.lit(0.0))
    return both.select(F.col("_run").alias(run), F.col("_source").alias(source), F.col("_item").alias(item), total.alias("projection"))


def order_items(fused: DataFrame, run: str, source: str, item: str) -> DataFrame:
    """Adds rank: 1 for the best projection of each run and source, ties by item."""
    return distributed_row_number(fused, [run, source], [F.col("projection").desc(), F.col(item).asc_nulls_first()])
