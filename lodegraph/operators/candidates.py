"""Cross-repository candidates: channels of every source at once, fused by rank."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.functions.text import WORD, exact_terms, lexical_text, query_terms
from lodegraph.operators.frames import top_per
from lodegraph.storage import materialize

#: Limits of candidate retrieval. Fixed values.
CANDIDATES, CHANNEL, RESERVE, QUERY_TERMS = 30, 50, 8, 128
RRF_K = 60
#: Sources that are held against all sites at once.
BLOCK = 1000
PASSAGES = ("configuration", "declaration")
_PLACE = ["repo_id", "path", "start_byte", "end_byte", "kind", "target"]


def exact_channel(sources: DataFrame, sites: DataFrame, limit: int = CHANNEL) -> DataFrame:
    """(source, target, channel, score, rank): sites of other repositories by the number of
    exact terms they share with a source.

    sources: (source, repo_id, text); sites: (target, repo_id, path, start_byte, end_byte,
    kind, text). BLOCK sources at a time are held against all sites, so a common term
    makes no pairs that would have to be shuffled; ties at a batch's cut are kept.
    """
    asked = sources.select("source", "repo_id", F.slice(exact_terms("text"), 1, QUERY_TERMS).alias("terms"))
    scored = _in_blocks(asked, sites.select("target", "repo_id", exact_terms("text").alias("terms")), sites, _shared_terms, limit)
    return _ranked(scored, sites, "exact", limit)


def _in_blocks(sources: DataFrame, targets: DataFrame, sites: DataFrame, compare, limit: int) -> DataFrame:
    """(source, target, score) of `compare` over targets, for one block of sources after the other."""
    spark = sources.sparkSession
    blocks = max(1, -(-sources.count() // BLOCK))
    numbered = materialize(sources.withColumn("_block", F.pmod(F.xxhash64("source"), F.lit(blocks))), "channel-sources")
    schema = f"source {dict(sources.dtypes)['source']}, target {dict(sites.dtypes)['target']}, score double"
    scored = None
    for block in range(blocks):
        rows = [tuple(r)[:3] for r in numbered.filter(F.col("_block") == block).collect()]
        part = targets.mapInPandas(compare(spark.sparkContext.broadcast(rows), limit), schema)
        scored = part if scored is None else scored.unionByName(part)
    return scored


def _best(source, repo, scores: np.ndarray, allowed: np.ndarray, targets: np.ndarray, limit: int) -> pd.DataFrame:
    """A batch's targets that are not below its limit-th score for a source."""
    keep = np.flatnonzero(allowed)
    if len(keep) > limit:
        keep = keep[scores[keep] >= np.partition(scores[keep], -limit)[-limit]]
    return pd.DataFrame({"source": [source] * len(keep), "target": targets[keep], "score": scores[keep].astype(float)})


def _shared_terms(shared, limit: int):
    def run(batches):
        postings: dict[str, list[int]] = {}
        for k, (_, _, terms) in enumerate(shared.value):
            for t in terms:
                postings.setdefault(t, []).append(k)
        holders = {t: np.array(ks) for t, ks in postings.items()}
        n = len(shared.value)
        for pdf in batches:
            counts = np.zeros((len(pdf), n), np.int32)
            for i, terms in enumerate(pdf["terms"]):
                hit = [holders[t] for t in terms if t in holders]
                if hit:
                    counts[i] = np.bincount(np.concatenate(hit), minlength=n)
            repos, targets = pdf["repo_id"].to_numpy(), pdf["target"].to_numpy()
            known = pdf["repo_id"].notna().to_numpy()
            out = [_best(s, r, counts[:, k], (counts[:, k] > 0) & known & (repos != r), targets, limit) for k, (s, r, _) in enumerate(shared.value) if r is not None]
            if out:
                yield pd.concat(out, ignore_index=True)

    return run


def lexical_channel(sources: DataFrame, sites: DataFrame, limit: int = CHANNEL) -> DataFrame:
    """As exact_channel, by the number of word positions of a site's lexical_text that start
    with a query term of the source. All of a source's text asks; null texts match nothing."""
    asked = sources.select("source", "repo_id", query_terms("text").alias("terms"))
    words = F.regexp_extract_all(F.lower(F.coalesce(lexical_text("text"), F.lit(""))), F.lit(f"({WORD})"), F.lit(1))
    scored = _in_blocks(asked, sites.select("target", "repo_id", words.alias("words")), sites, _prefix_positions, limit)
    return _ranked(scored, sites, "lexical", limit)


def _prefix_positions(shared, limit: int):
    def run(batches):
        holders: dict[str, list[int]] = {}
        for k, (_, _, terms) in enumerate(shared.value):
            for t in terms:
                holders.setdefault(t, []).append(k)
        n, longest = len(shared.value), max(map(len, holders), default=0)
        for pdf in batches:
            counts = np.zeros((len(pdf), n), np.int64)
            asking: dict[str, np.ndarray] = {}
            for i, words in enumerate(pdf["words"]):
                for word, times in Counter(words).items():
                    if word not in asking:
                        ks = {k for size in range(1, min(len(word), longest) + 1) for k in holders.get(word[:size], ())}
                        asking[word] = np.fromiter(ks, np.int64, len(ks))
                    counts[i, asking[word]] += times
            repos, targets = pdf["repo_id"].to_numpy(), pdf["target"].to_numpy()
            known = pdf["repo_id"].notna().to_numpy()
            out = [_best(s, r, counts[:, k], (counts[:, k] > 0) & known & (repos != r), targets, limit) for k, (s, r, _) in enumerate(shared.value) if r is not None]
            if out:
                yield pd.concat(out, ignore_index=True)

    return run


def semantic_channel(sources: DataFrame, sites: DataFrame, limit: int = CHANNEL) -> DataFrame:
    """As exact_channel, by cosine of the embedding columns. A stated set of sources is
    held against all sites, BLOCK sources at a time; nothing is pruned.

    Each batch of sites keeps, for each source, what is not below its limit-th score in
    the batch, so ties at the cut are decided over all sites. Null and zero vectors, and
    vectors of another length, match nothing.
    """
    asked = sources.select("source", "repo_id", "embedding").filter("embedding IS NOT NULL")
    scored = _in_blocks(asked, sites.select("target", "repo_id", "embedding"), sites, _cosines, limit)
    return _ranked(scored, sites, "semantic", limit)


def _cosines(shared, limit: int):
    def run(batches):
        groups: dict[int, list] = {}
        for source, repo, raw in shared.value:
            vector = np.array(raw, float)
            length = np.linalg.norm(vector)
            if length > 0 and np.isfinite(length):
                groups.setdefault(len(vector), []).append((source, repo, vector / length))
        for pdf in batches:
            sizes = np.array([-1 if v is None else len(v) for v in pdf["embedding"]])
            out = []
            for size, queries in groups.items():
                at = np.flatnonzero(sizes == size)
                if not len(at):
                    continue
                vectors = np.vstack(pdf["embedding"].iloc[at].to_list()).astype(float)
                lengths = np.linalg.norm(vectors, axis=1)
                good = np.isfinite(lengths) & (lengths > 0)
                at, vectors = at[good], vectors[good] / lengths[good, None]
                repos, targets = pdf["repo_id"].to_numpy()[at], pdf["target"].to_numpy()[at]
                known = pdf["repo_id"].notna().to_numpy()[at]
                for (source, repo, _), scores in zip(queries, np.array([q[2] for q in queries]) @ vectors.T):
                    if repo is not None:
                        out.append(_best(source, repo, scores, known & (repos != repo), targets, limit))
            if out:
                yield pd.concat(out, ignore_index=True)

    return run


def _ranked(scored: DataFrame, sites: DataFrame, channel: str, limit: int) -> DataFrame:
    placed = scored.join(sites.select(*_PLACE), "target")
    top = top_per(placed, ["source"], [F.desc("score"), *[F.col(c) for c in _PLACE]], limit)
    return top.withColumn("channel", F.lit(channel)).select("source", "target", "channel", "score", "rank")


def overlapping(a: dict, b: dict) -> bool:
    return a["repo_id"] == b["repo_id"] and a["path"] == b["path"] and a["start_byte"] < b["end_byte"] and b["start_byte"] < a["end_byte"]


def select_candidates(pool: list[dict], limit: int, reserve: int) -> list[dict]:
    """From a pool in fused order: passages that overlap a kept passage go; the best of the
    exact channel come first, up to `reserve`; then the rest."""
    kept: list[dict] = []
    for c in pool:
        if c["kind"] in PASSAGES and any(k["kind"] in PASSAGES and overlapping(k, c) for k in kept):
            continue
        kept.append(c)
    exact = sorted((c for c in kept if c["exact_rank"] is not None), key=lambda c: c["exact_rank"])[:reserve]
    chosen = {id(c) for c in exact}
    return (exact + [c for c in kept if id(c) not in chosen])[:limit]


def fuse_channels(hits: DataFrame, sites: DataFrame, keys: list[str], limit: int = CANDIDATES, reserve: int = RESERVE, channel_limit: int = CHANNEL) -> DataFrame:
    """(keys, target, fused_score, rank): candidates of each source over all channels.

    hits: (keys, target, channel, score); sites: places of targets, of each key where they
    have its columns. Each channel gives its
    first channel_limit hits by score, so a source's pool is bounded however many it has.
    """
    own = [k for k in keys if k in sites.columns]
    placed = hits.join(sites.select(*own, *_PLACE), [*own, "target"])
    ranked = top_per(placed, [*keys, "channel"], [F.desc("score"), *[F.col(c) for c in _PLACE]], channel_limit)
    fused = ranked.groupBy(*keys, *_PLACE).agg(F.sum(1.0 / (RRF_K + F.col("rank"))).alias("fused_score"), F.min(F.when(F.col("channel") == "exact", F.col("rank"))).alias("exact_rank"))
    types = dict(fused.dtypes)

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["fused_score", *_PLACE], ascending=[False] + [True] * len(_PLACE))
        pool = pdf.astype(object).where(pdf.notna(), None).to_dict("records")
        chosen = select_candidates(pool, limit, reserve)
        return pd.DataFrame([[*[c[k] for k in keys], c["target"], c["fused_score"], i] for i, c in enumerate(chosen, 1)], columns=[*keys, "target", "fused_score", "rank"])

    schema = ", ".join(f"{k} {types[k]}" for k in [*keys, "target"]) + ", fused_score double, rank int"
    return fused.groupBy(*keys).applyInPandas(choose, schema)


def rerank(candidates: DataFrame, score, keep: int = 5) -> DataFrame:
    """(source, target, rank, …, reranker_score, position): the first `keep` candidates of
    each source by a model's score, ties by their rank.

    score: a callable from (source text, target texts) to one finite number for each
    target, called once for each source with its candidates (source_text, target_text),
    of which retrieval has already bounded the number.
    """
    fields = ", ".join(f"`{n}` {t}" for n, t in candidates.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank", ignore_index=True)
        scores = list(score(pdf["source_text"].iloc[0], pdf["target_text"].tolist()))
        if len(scores) != len(pdf) or any(isinstance(x, bool) or not np.isfinite(x) for x in scores):
            raise ValueError("a reranker gives one finite score for each candidate")
        pdf = pdf.assign(reranker_score=[float(x) for x in scores]).sort_values(["reranker_score", "rank"], ascending=[False, True]).head(keep)
        return pdf.assign(position=range(1, len(pdf) + 1))

    return candidates.groupBy("source").applyInPandas(run, f"{fields}, reranker_score double, position int")
