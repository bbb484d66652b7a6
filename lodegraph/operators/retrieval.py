"""Retrieval over chunks: vector, lexical and hybrid channels, fusion and diversity."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.functions.text import index_terms, split_camel
from lodegraph.functions.vectors import cosine, usable
from lodegraph.operators.frames import distinct_on, missing, top_per
from lodegraph.operators.graph import confidence_weight, resolve, walk
from lodegraph.operators.ranks import distributed_row_number
from lodegraph.storage import materialize

#: Constants of rank fusion and of the skeleton factor. Fixed values.
RRF_K, RRF_WEIGHT = 60, 0.5
SKELETON_FLOOR, DEF_REFERENCE, FILE_REFERENCE = 0.3, 3, 10
GRAPH_WEIGHT, OVERRIDE_WEIGHT, POOL = 0.3, 0.5, 20
REPO_LAMBDA, FILE_LAMBDA = 0.3, 0.15


# -- signals ----------------------------------------------------------------------------


def definition_signals(calls: DataFrame, accesses: DataFrame) -> DataFrame:
    """(def_id, branch_id, out_calls, out_data): outgoing calls, resolved or not, and accesses."""
    c = calls.groupBy(F.col("src").alias("def_id"), "branch_id").agg(F.count("*").alias("out_calls"))
    a = accesses.groupBy(F.col("accessor_def_id").alias("def_id"), "branch_id").agg(F.count("*").alias("out_data"))
    return c.join(a, ["def_id", "branch_id"], "full").na.fill(0, ["out_calls", "out_data"])


def file_signals(definitions: DataFrame) -> DataFrame:
    """(file_version_id, branch_id, file_sig): definitions in each file."""
    return definitions.groupBy("file_version_id", "branch_id").agg(F.count("*").alias("file_sig"))


def skeleton_factor(kind: str = "kind", out_calls: str = "out_calls", out_data: str = "out_data", file_sig: str = "file_sig") -> Column:
    """Weight from 0.3 to 1 of a chunk by how much its definition does. It multiplies the
    score, so a negative score rises."""
    module = F.greatest(F.lit(SKELETON_FLOOR), F.least(F.lit(1.0), F.coalesce(file_sig, F.lit(0)) / F.lit(float(FILE_REFERENCE))))
    other = F.greatest(F.lit(SKELETON_FLOOR), F.least(F.lit(1.0), (F.coalesce(out_calls, F.lit(0)) + F.coalesce(out_data, F.lit(0))) / F.lit(float(DEF_REFERENCE))))
    return F.when(F.col(kind) == "module", module).otherwise(other)


# -- channels ---------------------------------------------------------------------------


#: What tells spaces of embeddings apart; vectors of different ones are not compared.
IDENTITY = ("model_name", "model_version", "dimensions", "representation_version")


def of_identity(embeddings: DataFrame, identity: dict[str, object] | None) -> DataFrame:
    """Embeddings of one space: all four columns of IDENTITY as given."""
    if identity is None:
        return embeddings
    if set(identity) != set(IDENTITY):
        raise ValueError(f"an identity has {', '.join(IDENTITY)}")
    for column in IDENTITY:
        embeddings = embeddings.filter(F.col(column) == F.lit(identity[column]))
    return embeddings


def of_chunks(chunks: DataFrame, granularities: Sequence[str] | None, languages: Sequence[str] | None) -> DataFrame:
    """Chunks of the granularities and languages asked for; None asks for all."""
    out = chunks if granularities is None else chunks.filter(F.col("granularity").isin(*granularities))
    return out if languages is None else out.filter(F.col("language").isin(*languages))


def semantic_query(
    chunks: DataFrame, embeddings: DataFrame, query: Sequence[float], top_k: int | None = 10, factor: Column | None = None, identity: dict[str, object] | None = None, granularities: Sequence[str] | None = None, languages: Sequence[str] | None = None
) -> DataFrame:
    """Chunks by cosine similarity to a vector, an exact scan: (…, score).

    embeddings: (content_hash, embedding), with the columns of IDENTITY where one is asked
    for. Vectors of other dimensions, zero vectors and vectors with NaN never match. Ties go
    to the smaller chunk_id.
    """
    embeddings, chunks = of_identity(embeddings, identity), of_chunks(chunks, granularities, languages)
    q = F.array(*[F.lit(float(x)) for x in query])
    # each distinct content is compared once, then joined to its chunks
    scored = embeddings.filter(usable(F.col("embedding"), len(query))).select("content_hash", cosine(F.col("embedding"), q).alias("_cos"))
    out = chunks.join(scored, "content_hash").withColumn("score", F.col("_cos") * (F.lit(1.0) if factor is None else factor)).drop("_cos")
    return out if top_k is None else out.orderBy(F.desc("score"), "chunk_id").limit(top_k)


def parts_of_query(query: str) -> list[str]:
    """Prefixes that a query asks for: its words in lower case, with their snake and camel parts."""
    out: dict[str, None] = {}
    for word in re.findall(r"[A-Za-z0-9_]+", query):
        camel = re.sub(r"([a-z\d])([A-Z])|([A-Z]+)([A-Z][a-z])", lambda m: f"{m[1] or m[3]} {m[2] or m[4]}", word).lower()
        for part in [word.lower(), *word.lower().split("_"), *re.split(r"[ _]+", camel)]:
            if part:
                out[part] = None
    return list(out)


def fts_document(content: str | Column, qualified_name: str | Column | None = None) -> Column:
    """Text that is indexed for a chunk: its name, its name in parts, and its content."""
    c = F.col(content) if isinstance(content, str) else content
    if qualified_name is None:
        return c
    q = F.col(qualified_name) if isinstance(qualified_name, str) else qualified_name
    return F.concat_ws("\n", q, split_camel(q), c)


def postings(chunks: DataFrame, text: Column) -> DataFrame:
    """(term, chunk_id, positions): how often each term of a chunk stands in it."""
    return chunks.select("chunk_id", F.explode(index_terms(text)).alias("term")).groupBy("term", "chunk_id").agg(F.count("*").alias("positions"))


def lexical_query(chunks: DataFrame, query: str, text: Column | None = None, top_k: int | None = 10, factor: Column | None = None, index: DataFrame | None = None) -> DataFrame:
    """Chunks by the number of their term positions that a prefix of the query matches.

    No inverse document frequency, as cover density has none. A query without words
    matches nothing. index: prepared postings, else they are made here.
    """
    parts = parts_of_query(query)
    terms = postings(chunks, F.col("content") if text is None else text) if index is None else index
    hit = F.lit(False)
    for p in parts:
        hit = hit | F.col("term").startswith(p)
    counted = terms.filter(hit).groupBy("chunk_id").agg(F.sum("positions").cast("double").alias("_n"))
    out = chunks.join(counted, "chunk_id").withColumn("score", F.col("_n") * (F.lit(1.0) if factor is None else factor)).drop("_n")
    return out if top_k is None else out.orderBy(F.desc("score"), "chunk_id").limit(top_k)


def structural_query(edges: DataFrame, defs: DataFrame, chunks: DataFrame, query: str, depth: int = 2, granularity: str | None = None) -> DataFrame:
    """Chunks of what a name calls, down to a depth, scored 1 / 2**hops."""
    seeds = resolve(defs, query).select("def_id")
    near = walk(edges, seeds, depth).join(seeds, "def_id", "left_anti")
    reached = seeds.withColumn("depth", F.lit(0)).unionByName(near)
    out = chunks.join(reached.withColumnRenamed("def_id", "anchor_def_id"), "anchor_def_id")
    if granularity is not None:
        out = out.filter(F.col("granularity") == granularity)
    return out.withColumn("score", F.pow(F.lit(0.5), F.col("depth"))).drop("depth")


# -- fusion -----------------------------------------------------------------------------


def fuse_scores(channels: Sequence[DataFrame], key: str = "chunk_id", weight: float = RRF_WEIGHT) -> DataFrame:
    """(key, score): reciprocal rank fusion of ranked channels, the best score being 1.
    Channels of any length are ranked without gathering them in one task."""
    ranked = None
    for n, c in enumerate(channels):
        r = c.select(F.lit(n).alias("_channel"), key, "score")
        ranked = r if ranked is None else ranked.unionByName(r)
    ranked = distributed_row_number(ranked, ["_channel"], [F.desc("score"), F.col(key)], "_rank")
    fused = materialize(ranked.groupBy(key).agg(F.sum(F.lit(weight) / (RRF_K + F.col("_rank"))).alias("score")), "fused")
    best = fused.agg(F.max("score")).first()[0]
    return fused.withColumn("score", F.col("score") / F.lit(best)) if best else fused


def mmr_order(candidates: list[tuple], k: int, repo_lambda: float = REPO_LAMBDA, file_lambda: float = FILE_LAMBDA) -> list[int]:
    """Indices picked greedily from (score, repo, file) rows: score less a penalty for each
    picked row of the same repository and file; the first of equals wins. With at most
    one known repository and one file the order stays."""
    # an unknown repository is none
    known = {c[1] for c in candidates if not pd.isna(c[1])}
    if len(known) <= 1 and len({c[2] for c in candidates}) <= 1:
        return list(range(min(k, len(candidates))))
    repos: dict = {}
    files: dict = {}
    left, out = list(range(len(candidates))), []
    while left and len(out) < k:
        best = max(left, key=lambda i: (candidates[i][0] - repo_lambda * repos.get(candidates[i][1], 0) - file_lambda * files.get(candidates[i][2], 0), -i))
        left.remove(best)
        out.append(best)
        repos[candidates[best][1]] = repos.get(candidates[best][1], 0) + 1
        files[candidates[best][2]] = files.get(candidates[best][2], 0) + 1
    return out


def mmr_rerank(candidates: DataFrame, k: int, repo_lambda: float = REPO_LAMBDA, file_lambda: float = FILE_LAMBDA) -> DataFrame:
    """The k candidates (score, chunk_id, repo_id, file_version_id, …) that diversity picks,
    with their position.

    Rows of a file differ in score alone, so its k best decide; so do the k best files of
    a repository and the k best repositories. At most k**3 rows meet in one task.
    """
    order = [F.desc("score"), F.col("chunk_id")]
    few = top_per(candidates, ["repo_id", "file_version_id"], order, k, "_in_file")
    heads = few.filter("_in_file = 1").select("repo_id", "file_version_id", "score", "chunk_id")
    files = top_per(heads, ["repo_id"], order, k, "_n").select("repo_id", "file_version_id")
    tops = top_per(heads, ["repo_id"], order, 1, "_n").orderBy(*order).limit(k).select("repo_id")
    few = few.join(files, ["repo_id", "file_version_id"], "left_semi").join(tops, "repo_id", "left_semi").drop("_in_file")

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "chunk_id"], ascending=[False, True], ignore_index=True)
        chosen = mmr_order(list(zip(pdf["score"], pdf["repo_id"], pdf["file_version_id"])), k, repo_lambda, file_lambda)
        return pdf.drop(columns="_all").iloc[chosen].assign(position=range(1, len(chosen) + 1))

    fields = ", ".join(f"`{n}` {t}" for n, t in few.dtypes)
    return few.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(pick, f"{fields}, position int")


def expand_by_graph(anchors: DataFrame, calls: DataFrame, inherits: DataFrame, overrides: DataFrame, graph_weight: float = GRAPH_WEIGHT, override_weight: float = OVERRIDE_WEIGHT) -> DataFrame:
    """(def_id, bonus) from anchors (def_id, score): what anchors call gets their score by
    the edge's confidence; what inherits from or is inherited by anchors and callees gets
    theirs; overrides likewise. The greatest bonus stands, and only a positive one."""
    weighted = lambda e: e.select("src", "dst", confidence_weight(F.col("confidence")).alias("w"))
    a = materialize(anchors.groupBy("def_id").agg(F.max("score").alias("score")), "anchors")
    out = weighted(calls).filter("dst IS NOT NULL").join(a.withColumnRenamed("def_id", "src"), "src").groupBy(F.col("dst").alias("def_id")).agg(F.max(F.col("score") * F.col("w") * graph_weight).alias("bonus"))
    out = materialize(out.filter("bonus > 0"), "bonus-calls")
    effective = a.join(out, "def_id", "left").select("def_id", (F.col("score") + F.coalesce("bonus", F.lit(0.0))).alias("score"))
    callees = calls.filter("dst IS NOT NULL").join(effective.withColumnRenamed("def_id", "src"), "src").groupBy(F.col("dst").alias("def_id")).agg(F.max("score").alias("score"))
    expanded = materialize(effective.unionByName(callees).groupBy("def_id").agg(F.max("score").alias("score")), "expanded")

    def both_ways(edges: DataFrame, w: Column) -> DataFrame:
        e = edges.filter("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst", w.alias("w"))
        one = e.join(expanded.withColumnRenamed("def_id", "src"), "src").select(F.col("dst").alias("def_id"), (F.col("score") * F.col("w")).alias("bonus"))
        two = e.join(expanded.withColumnRenamed("def_id", "dst"), "dst").select(F.col("src").alias("def_id"), (F.col("score") * F.col("w")).alias("bonus"))
        return one.unionByName(two)

    every = out.unionByName(both_ways(inherits, confidence_weight(F.col("confidence")) * graph_weight)).unionByName(both_ways(overrides, F.lit(override_weight)))
    return every.groupBy("def_id").agg(F.max("bonus").alias("bonus")).filter("bonus > 0")


def hybrid_query(chunks: DataFrame, semantic: DataFrame, lexical: DataFrame, calls: DataFrame, inherits: DataFrame, overrides: DataFrame, top_k: int = 10, pool: int = POOL) -> DataFrame:
    """Fused, graph-expanded and diversified chunks of a query.

    semantic and lexical: scored chunks of the two channels; chunks: (chunk_id,
    anchor_def_id, granularity, repo_id, file_version_id, …), to which expansion adds.
    """
    sem = materialize(semantic.orderBy(F.desc("score"), "chunk_id").limit(pool), "hybrid-semantic")
    lex = materialize(lexical.orderBy(F.desc("score"), "chunk_id").limit(pool), "hybrid-lexical")
    fused = fuse_scores([sem, lex])
    found = chunks.join(fused, "chunk_id")
    anchors = found.filter("anchor_def_id IS NOT NULL").join(sem.select("chunk_id", F.col("score").alias("_s")), "chunk_id", "left").select(F.col("anchor_def_id").alias("def_id"), F.coalesce("_s", F.lit(0.0)).alias("score"))
    bonus = expand_by_graph(anchors, calls, inherits, overrides).withColumnRenamed("def_id", "anchor_def_id")
    related = chunks.filter(F.col("granularity") == "function").join(bonus, "anchor_def_id").select("chunk_id", "bonus")
    total = fused.join(related, "chunk_id", "full").select("chunk_id", (F.coalesce("score", F.lit(0.0)) + F.coalesce("bonus", F.lit(0.0))).alias("score"))
    return mmr_rerank(chunks.join(total, "chunk_id"), top_k)


# -- context ----------------------------------------------------------------------------


def assemble_context(chunks: DataFrame, budget: int, group: str | None = None) -> DataFrame:
    """(…, context, n_tokens, n_chunks) of ranked chunks (position, chunk_id, anchor_def_id,
    granularity, token_count, content): each next chunk that still fits is taken, an
    oversized one is passed over; a definition counts once for each granularity."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["position", "chunk_id"])
        used, seen, parts = 0, set(), []
        for r in pdf.itertuples():
            key = (-r.chunk_id if pd.isna(r.anchor_def_id) else r.anchor_def_id, r.granularity)
            size = 0 if pd.isna(r.token_count) else int(r.token_count)
            if key in seen or used + size > budget:
                continue
            seen.add(key)
            used += size
            parts.append(r.content or "")
        head = {group: [pdf[group].iloc[0]]} if group else {}
        return pd.DataFrame(head | {"context": ["\n\n".join(parts)], "n_tokens": [used], "n_chunks": [len(parts)]})

    kind = f"{group} {dict(chunks.dtypes)[group]}, " if group else ""
    keyed = chunks if group else chunks.withColumn("_all", F.lit(0))
    return keyed.groupBy(group or "_all").applyInPandas(pack, kind + "context string, n_tokens long, n_chunks int")


# -- embeddings -------------------------------------------------------------------------


def missing_embeddings(chunks: DataFrame, embeddings: DataFrame, max_tokens: int = 16000) -> DataFrame:
    """(content_hash, content): distinct contents without a vector, but for oversized ones."""
    todo = missing(chunks.filter(F.coalesce("token_count", F.lit(0)) <= max_tokens), embeddings, ["content_hash"])
    return distinct_on(todo, ["content_hash"], [F.col("chunk_id")]).select("content_hash", "content")


def embed_missing(todo: DataFrame, embed, dimensions: int, batch: int = 64) -> DataFrame:
    """(content_hash, embedding) by a callable from texts to vectors, in batches; a vector
    of other dimensions, of zeros or with NaN stops the run."""

    def run(batches):
        import math

        for pdf in batches:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                vectors = embed(part["content"].tolist())
                for v in vectors:
                    if len(v) != dimensions or not all(map(math.isfinite, v)) or not any(v):
                        raise ValueError("the embedder gave an unusable vector")
                yield pd.DataFrame({"content_hash": part["content_hash"].tolist(), "embedding": vectors})

    return todo.mapInPandas(run, "content_hash string, embedding array<float>")


