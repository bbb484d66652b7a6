"""Retrieval queries: channels, signals, fusion, diversity and contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.functions.text import STOP_WORDS, exact_terms, index_terms, split_camel
from lodegraph.operators import candidates as C
from lodegraph.operators import retrieval as R
from lodegraph.operators.frames import distinct_on, top_per
from lodegraph.plans import bridge as B
from lodegraph.storage import read_table

QUERY = "store ledgerWindow tally_quota"


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "chunks")
    one = distinct_on(c, ["id"], [F.col("content_hash"), F.col("branch_id")])
    return one.select(F.col("id").alias("chunk_id"), "branch_id", "file_version_id", "anchor_def_id", "granularity", "content", "token_count", "content_hash", F.floor(F.col("branch_id") / 10).alias("repo_id"))


_CHUNKS = "ch AS (SELECT id AS chunk_id, branch_id, file_version_id, anchor_def_id, granularity, content, token_count, content_hash FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY content_hash, branch_id) AS n FROM chunks) WHERE n = 1)"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("content_hash"), F.col("vec_id").alias("chunk_id"), "embedding")


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return read_table(spark, sf_dir, "embeddings").orderBy("vec_id").select("embedding").first()[0]


def r_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    out = R.semantic_query(v.select("chunk_id", "content_hash"), v.select("content_hash", "embedding"), _query_vector(spark, sf_dir), top_k=10)
    return out.select("chunk_id", F.round("score", 6).alias("score"))


def r_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.lexical_query(_chunks(spark, sf_dir), QUERY, top_k=None).select("chunk_id", "score")


def r_lexical_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.lexical_query(_chunks(spark, sf_dir), QUERY, top_k=20).select("chunk_id", "score")


def r_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.postings(_chunks(spark, sf_dir), F.col("content")).groupBy("term").agg(F.count("*").alias("n_chunks"), F.sum("positions").alias("n_positions"))


def r_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    sig = R.definition_signals(B.calls(spark, sf_dir), B.accesses(spark, sf_dir))
    d = B.definitions(spark, sf_dir)
    files = d.groupBy("file_path").agg(F.count("*").alias("file_sig"))
    out = d.join(sig.drop("branch_id"), "def_id", "left").join(files, "file_path")
    return out.select("def_id", F.round(R.skeleton_factor(), 6).alias("factor"))


def r_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semantic and lexical pools over chunks that have a vector of their number."""
    chunks = _chunks(spark, sf_dir)
    v = _vectors(spark, sf_dir)
    sem = R.semantic_query(v.select("chunk_id", "content_hash"), v.select("content_hash", "embedding"), _query_vector(spark, sf_dir), top_k=R.POOL)
    lex = R.lexical_query(chunks, QUERY, top_k=R.POOL)
    return R.fuse_scores([sem.select("chunk_id", "score"), lex.select("chunk_id", "score")]).select("chunk_id", F.round("score", 6).alias("score"))


def _hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir)
    v = _vectors(spark, sf_dir)
    sem = R.semantic_query(v.select("chunk_id", "content_hash"), v.select("content_hash", "embedding"), _query_vector(spark, sf_dir), top_k=R.POOL)
    lex = R.lexical_query(chunks, QUERY, top_k=R.POOL)
    inherits = read_table(spark, sf_dir, "inherits_edges").select(F.col("child_def_id").alias("src"), F.col("base_def_id").alias("dst"), "confidence").distinct()
    none = spark.createDataFrame([], "src long, dst long, confidence string")
    return R.hybrid_query(chunks, sem.select("chunk_id", "score"), lex.select("chunk_id", "score"), none, inherits, none)


def r_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid(spark, sf_dir).select("position", "chunk_id", F.round("score", 6).alias("score"))


def r_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.assemble_context(_hybrid(spark, sf_dir), 2048)


def r_missing_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = distinct_on(_chunks(spark, sf_dir), ["content_hash"], [F.col("chunk_id")]).join(_vectors(spark, sf_dir).select("chunk_id"), "chunk_id", "left_semi")
    return R.missing_embeddings(_chunks(spark, sf_dir), done.select("content_hash")).select("content_hash")


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("target"), F.col("source").alias("repo_id"), F.lit("").alias("path"), F.lit(0).alias("start_byte"), F.octet_length("text").alias("end_byte"), F.lit("call").alias("kind"), "text")


def c_exact_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whose number is divisible by 100, against all documents."""
    sites = _sites(spark, sf_dir)
    sources = sites.filter(F.col("target") % 100 == 0).select(F.col("target").alias("source"), "repo_id", "text")
    return C.exact_channel(sources, sites).select("source", "target", "score", "rank")


def c_lexical_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As c_exact_channel, by words that start with terms of the document."""
    sites = _sites(spark, sf_dir)
    sources = sites.filter(F.col("target") % 100 == 0).select(F.col("target").alias("source"), "repo_id", "text")
    return C.lexical_channel(sources, sites).select("source", "target", "score", "rank")


def c_semantic_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose number is divisible by 100, against all vectors of other labels."""
    e = read_table(spark, sf_dir, "embeddings")
    sites = e.select(F.col("vec_id").alias("target"), F.col("label").alias("repo_id"), F.lit("").alias("path"), F.lit(0).alias("start_byte"), F.lit(0).alias("end_byte"), F.lit("call").alias("kind"), "embedding")
    sources = sites.filter(F.col("target") % 100 == 0).select(F.col("target").alias("source"), "repo_id", "embedding")
    return C.semantic_channel(sources, sites, limit=10).select("source", "target", F.round("score", 6).alias("score"))


def _channel_hits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    h = read_table(spark, sf_dir, "candidate_hits")
    newest = h.groupBy("run_id", "source_site_id", F.col("target_site_id").alias("target")).agg(F.max_by(F.struct(F.col("target_repo_id").alias("repo_id"), "path", "start_byte", "end_byte", "kind", "channels"), "hit_id").alias("_h"))
    flat = newest.select("run_id", "source_site_id", "target", "_h.*")
    hits = flat.select("run_id", "source_site_id", "target", "repo_id", "path", "start_byte", "end_byte", "kind", F.explode("channels").alias("channel", "_v")).select("*", F.col("_v.score").alias("score")).drop("_v")
    return hits.filter("score IS NOT NULL AND NOT isnan(score)"), flat


def c_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reciprocal rank fusion of the channels of every source, 50 hits from each."""
    hits, _ = _channel_hits(spark, sf_dir)
    ranked = top_per(hits, ["run_id", "source_site_id", "channel"], [F.desc("score"), F.col("target")], C.CHANNEL)
    return ranked.groupBy("run_id", "source_site_id", "target").agg(F.round(F.sum(1.0 / (C.RRF_K + F.col("rank"))), 6).alias("fused"))


def c_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits, _ = _channel_hits(spark, sf_dir)
    places = hits.select("run_id", "source_site_id", "target", "repo_id", "path", "start_byte", "end_byte", "kind").distinct()
    return C.fuse_channels(hits.select("run_id", "source_site_id", "target", "channel", "score"), places, ["run_id", "source_site_id"])


def f_sub_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "definitions").select("name").distinct()
    return d.select("name", split_camel("name").alias("spaced"), F.array_join(F.array_sort(F.array_distinct(index_terms("name"))), " ").alias("terms"))


def f_exact_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read_table(spark, sf_dir, "candidate_hits").select("path").distinct()
    return t.select("path", F.size(exact_terms("path")).alias("n_terms"))


QUERIES = {
    "r_semantic": r_semantic,
    "r_lexical": r_lexical,
    "r_lexical_top": r_lexical_top,
    "r_postings": r_postings,
    "r_signals": r_signals,
    "r_rrf": r_rrf,
    "r_hybrid": r_hybrid,
    "r_context": r_context,
    "r_missing_embeddings": r_missing_embeddings,
    "c_exact_channel": c_exact_channel,
    "c_lexical_channel": c_lexical_channel,
    "c_semantic_channel": c_semantic_channel,
    "c_rrf": c_rrf,
    "c_candidates": c_candidates,
    "f_sub_tokens": f_sub_tokens,
    "f_exact_terms": f_exact_terms,
}

_CAMEL = r"regexp_replace({0}, '([a-z\d])([A-Z])|([A-Z]+)([A-Z][a-z])', '\1\3 \2\4', 'g')"
_SUBS = "list_distinct(list_concat([lower({0})], list_filter(string_split(lower({0}), '_'), lambda x: x <> ''), list_filter(regexp_split_to_array(lower(" + _CAMEL + "), '[ _]+'), lambda x: x <> '')))"
_POSTINGS = f"{_CHUNKS}, w AS (SELECT chunk_id, unnest(regexp_extract_all(coalesce(content, ''), '[A-Za-z0-9_]+')) AS word FROM ch), t AS (SELECT chunk_id, unnest({_SUBS.format('word')}) AS term FROM w)"
_PARTS = R.parts_of_query(QUERY)
_HIT = " OR ".join(f"starts_with(term, '{p}')" for p in _PARTS)
_LEX = f"{_POSTINGS}, lex AS (SELECT chunk_id, CAST(count(*) AS DOUBLE) AS score FROM t WHERE {_HIT} GROUP BY chunk_id)"
_SEM = "q AS (SELECT embedding AS v FROM embeddings ORDER BY vec_id LIMIT 1), sem AS (SELECT vec_id AS chunk_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST((SELECT v FROM q) AS DOUBLE[])) AS score FROM embeddings)"

_W = r"[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200c}\x{200d}$]+"
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_TERMS = f"list_distinct(list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '{_W}(?:[./:\\-]{_W})*'), lambda x: lower(x)), lambda x: length(x) > 2 AND x NOT IN ({_STOP})))"

ORACLES = {
    "c_exact_channel": f"""WITH t AS (SELECT doc_id, source AS repo, unnest({_TERMS}) AS term FROM documents),
o AS (SELECT doc_id, repo, term FROM (SELECT doc_id, source AS repo, unnest(terms) AS term, generate_subscripts(terms, 1) AS n FROM (SELECT doc_id, source, (SELECT list(x ORDER BY i) FROM (SELECT x, min(i) AS i FROM (SELECT unnest(l) AS x, generate_subscripts(l, 1) AS i) GROUP BY x)) AS terms
  FROM (SELECT doc_id, source, list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '{_W}(?:[./:\\-]{_W})*'), lambda x: lower(x)), lambda x: length(x) > 2 AND x NOT IN ({_STOP})) AS l FROM documents WHERE doc_id % 100 = 0))) WHERE n <= 128),
p AS (SELECT o.doc_id AS source, t.doc_id AS target, t.repo, CAST(count(*) AS DOUBLE) AS score FROM o JOIN t ON o.term = t.term AND o.repo <> t.repo GROUP BY ALL),
e AS (SELECT doc_id, octet_length(encode(text)) AS size FROM documents)
SELECT source, target, score, CAST(rank AS INTEGER) AS rank FROM (SELECT source, target, score, row_number() OVER (PARTITION BY source ORDER BY score DESC, repo, size, target) AS rank FROM p JOIN e ON e.doc_id = p.target) WHERE rank <= 50""",
    "r_semantic": f"WITH {_SEM} SELECT chunk_id, round(score, 6) AS score FROM sem ORDER BY sem.score DESC, chunk_id LIMIT 10",
    "r_lexical": f"WITH {_LEX} SELECT chunk_id, score FROM lex",
    "r_lexical_top": f"WITH {_LEX} SELECT chunk_id, score FROM lex ORDER BY score DESC, chunk_id LIMIT 20",
    "r_postings": f"WITH {_POSTINGS} SELECT term, count(DISTINCT chunk_id) AS n_chunks, CAST(count(*) AS BIGINT) AS n_positions FROM t GROUP BY term",
    "r_signals": f"""WITH {B.CTES}, c AS (SELECT src, count(*) AS n FROM calls GROUP BY src), a AS (SELECT accessor_def_id, count(*) AS n FROM acc GROUP BY accessor_def_id), f AS (SELECT file_path, count(*) AS n FROM defs GROUP BY file_path)
SELECT d.def_id, round(greatest(0.3, least(1.0, CASE WHEN d.kind = 'module' THEN f.n / 10.0 ELSE (coalesce(c.n, 0) + coalesce(a.n, 0)) / 3.0 END)), 6) AS factor
FROM defs d JOIN f USING (file_path) LEFT JOIN c ON c.src = d.def_id LEFT JOIN a ON a.accessor_def_id = d.def_id""",
    "r_rrf": f"""WITH {_LEX}, {_SEM}, s AS (SELECT chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id) AS n FROM sem ORDER BY n LIMIT {R.POOL}), l AS (SELECT chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id) AS n FROM lex ORDER BY n LIMIT {R.POOL}),
f AS (SELECT chunk_id, sum(0.5 / (60 + n)) AS score FROM (SELECT * FROM s UNION ALL SELECT * FROM l) GROUP BY chunk_id) SELECT chunk_id, round(score / (SELECT max(score) FROM f), 6) AS score FROM f""",
    "r_missing_embeddings": f"WITH {_CHUNKS}, firsts AS (SELECT content_hash, min(chunk_id) AS chunk_id FROM ch GROUP BY content_hash), done AS (SELECT content_hash FROM firsts WHERE chunk_id IN (SELECT vec_id FROM embeddings)) SELECT DISTINCT content_hash FROM ch WHERE coalesce(token_count, 0) <= 16000 AND content_hash NOT IN (SELECT content_hash FROM done)",
    "c_semantic_channel": """SELECT source, target, round(score, 6) AS score FROM (
  SELECT s.vec_id AS source, t.vec_id AS target, list_cosine_similarity(CAST(t.embedding AS DOUBLE[]), CAST(s.embedding AS DOUBLE[])) AS score,
         row_number() OVER (PARTITION BY s.vec_id ORDER BY list_cosine_similarity(CAST(t.embedding AS DOUBLE[]), CAST(s.embedding AS DOUBLE[])) DESC, t.label, t.vec_id) AS n
  FROM embeddings s JOIN embeddings t ON s.label <> t.label WHERE s.vec_id % 100 = 0) WHERE n <= 10""",
    "c_rrf": """WITH newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, source_site_id, target_site_id ORDER BY hit_id DESC) AS n FROM candidate_hits) WHERE n = 1),
flat AS (SELECT run_id, source_site_id, target_site_id, e.key AS channel, e.value.score AS score FROM (SELECT run_id, source_site_id, target_site_id, unnest(map_entries(channels)) AS e FROM newest)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY run_id, source_site_id, channel ORDER BY score DESC, target_site_id) AS rank FROM flat WHERE score IS NOT NULL AND NOT isnan(score))
SELECT run_id, source_site_id, target_site_id AS target, round(sum(1.0 / (60 + rank)), 6) AS fused FROM ranked WHERE rank <= 50 GROUP BY ALL""",
    "f_sub_tokens": f"SELECT DISTINCT name, {_CAMEL.format('name')} AS spaced, array_to_string(list_sort(list_distinct(flatten(list_transform(regexp_extract_all(coalesce(name, ''), '[A-Za-z0-9_]+'), lambda w: {_SUBS.format('w')})))), ' ') AS terms FROM definitions",
}
