from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from lodegraph.functions import paths as P
from lodegraph.functions import spans as S
from lodegraph.functions import text as T
from lodegraph.functions import vectors as V
from lodegraph.functions.fingerprints import canonical, fingerprint, row_fingerprint
from lodegraph.operators import candidates as C
from lodegraph.operators import retrieval as R
from tests.conftest import rows


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr).first()[0]


def test_words_and_parts(spark):
    assert one(spark, "parseHTTPRequest", T.split_camel("x")) == "parse HTTP Request"
    assert one(spark, "getUser_name", T.query_terms("x")) == ["getuser_name", "getuser", "name", "get", "user"]
    assert one(spark, None, T.query_terms("x")) == [] and one(spark, "", T.index_terms("x")) == []
    assert one(spark, "the foo.Bar/baz of a-b foo.bar/baz", T.exact_terms("x")) == ["foo.bar/baz", "a-b"]
    assert one(spark, "getUser_id", T.lexical_text("x")) == "getUser_id\nget User id"
    assert R.parts_of_query("getUser_name !") == ["getuser_name", "getuser", "name", "get", "user"] and R.parts_of_query("!!") == []


def test_byte_spans(spark):
    df = spark.createDataFrame([("aéb€c", 1, 3), ("aéb€c", 2, 4), ("abc", 1, 9), ("abc", 2, 1), (None, 0, 1)], "t string, a long, b long")
    assert [r[0] for r in df.select(S.byte_slice("t", "a", "b")).collect()] == ["é", "�b", "bc", "", None]
    raw = "aé€z".encode()
    for a in range(len(raw) + 1):
        lo, hi, _, _ = S.aligned_window(raw, a, a, 3, 1)
        raw[lo:hi].decode()


def test_passages_cover_the_text(spark):
    text = "é" + "x" * 3000 + " " * 2000 + "end"
    got = one(spark, text, S.passages("x"))
    raw = text.encode()
    assert all(raw[p.start_byte : p.end_byte].decode() == p.passage and p.passage.strip() for p in got)
    assert got[0].start_byte == 0 and got[-1].end_byte == len(raw)
    assert one(spark, "", S.passages("x")) == [] and one(spark, None, S.passages("x")) is None


def test_vectors(spark):
    v = V.hashed_vector("text", 10)
    assert math.isclose(sum(x * x for x in v), 1) and v == V.hashed_vector("text", 10) != V.hashed_vector("texts", 10)
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0]), (None, [1.0])], "a array<float>, b array<float>")
    got = [r[0] for r in df.select(V.cosine(F.col("a"), F.col("b"))).collect()]
    assert math.isclose(got[0], 0.5**0.5, rel_tol=1e-6) and got[1:] == [None, None, None]
    assert len(one(spark, "q", V.hashed_embedding("x", 4))) == 4


def test_fingerprints(spark):
    assert canonical({"b": 1, "a": [None, "é"]}) == '{"a":[null,"é"],"b":1}'
    with pytest.raises(ValueError):
        fingerprint({"x": float("nan")})
    df = spark.createDataFrame([("x", 1)], "b string, a long")
    assert df.select(row_fingerprint("b", "a")).first()[0] == fingerprint({"a": 1, "b": "x"})


def chunks(spark, items):
    return spark.createDataFrame([(i, h, t) for i, h, t in items], "chunk_id long, content_hash string, content string")


def test_semantic_keeps_negative_scores_and_skips_bad_vectors(spark):
    c = chunks(spark, [(1, "a", ""), (2, "b", ""), (3, "b", ""), (4, "z", ""), (5, "n", "")])
    e = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [-0.5, 0.0]), ("z", [0.0, 0.0]), ("n", [float("nan"), 1.0])], "content_hash string, embedding array<float>")
    assert [(r.chunk_id, r.score) for r in R.semantic_query(c, e, [1.0, 0.0]).collect()] == [(1, 1.0), (2, -1.0), (3, -1.0)]
    assert R.semantic_query(c, e, [1.0, 0.0], factor=F.lit(0.3)).collect()[1].score == -0.3


def test_lexical_counts_positions(spark):
    c = chunks(spark, [(1, "a", "ledger ledgerWindow"), (2, "b", "window"), (3, "c", None), (4, "d", "none")])
    assert rows(R.lexical_query(c, "ledger"), "chunk_id", "score") == [(1, 3.0)]
    assert rows(R.lexical_query(c, "?"), "chunk_id") == []


def test_fusion(spark):
    a = spark.createDataFrame([(1, 9.0), (2, 1.0)], "chunk_id long, score double")
    b = spark.createDataFrame([(2, 0.2), (1, 0.1)], "chunk_id long, score double")
    assert rows(R.fuse_scores([a, b])) == [(1, 1.0), (2, 1.0)]


def test_mmr_order():
    assert R.mmr_order([(1.0, 1, 1), (0.9, 1, 1)], 5) == [0, 1]
    assert R.mmr_order([(1.0, 1, 1), (0.99, 1, 1), (0.9, 1, 2)], 2, 0.0, 0.5) == [0, 2]


@pytest.mark.parametrize("seed", range(3))
def test_mmr_pruning_is_exact(spark, seed):
    rng = random.Random(seed)
    data = [(i, rng.randrange(4), rng.randrange(6), round(rng.random(), 2)) for i in range(80)]
    df = spark.createDataFrame(data, "chunk_id long, repo_id long, file_version_id long, score double")
    ordered = sorted(data, key=lambda r: (-r[3], r[0]))
    want = [ordered[i][0] for i in R.mmr_order([(r[3], r[1], r[2]) for r in ordered], 7)]
    assert [r.chunk_id for r in R.mmr_rerank(df, 7).orderBy("position").collect()] == want


def test_context_skips_oversized_and_repeated(spark):
    data = [(1, 1, 7, "function", 300, "A"), (2, 2, 7, "function", 300, "dup"), (3, 3, 8, "function", 300, "B"), (4, 4, None, "function", 900, "big"), (5, 5, None, "module", None, "C")]
    df = spark.createDataFrame(data, "position int, chunk_id long, anchor_def_id long, granularity string, token_count long, content string")
    r = R.assemble_context(df, 700).first()
    assert (r.context, r.n_tokens, r.n_chunks) == ("A\n\nB\n\nC", 600, 3)


def test_expansion(spark):
    anchors = spark.createDataFrame([(1, 1.0), (9, -1.0)], "def_id long, score double")
    e = lambda xs: spark.createDataFrame(xs, "src long, dst long, confidence string")
    got = dict(rows(R.expand_by_graph(anchors, e([(1, 2, "certain"), (1, 3, "uncertain"), (9, 5, "certain")]), e([(2, 4, "inferred")]), e([]))))
    assert {k: round(v, 4) for k, v in got.items()} == {2: 0.3, 3: 0.12, 4: 0.21}


def test_embedding_only_what_is_missing(spark):
    c = spark.createDataFrame([(1, "a", "x", 5), (2, "a", "x", 5), (3, "b", "y", 20000), (4, "c", "z", None)], "chunk_id long, content_hash string, content string, token_count long")
    done = spark.createDataFrame([("c",)], "content_hash string")
    todo = R.missing_embeddings(c, done)
    assert rows(todo) == [("a", "x")]
    assert R.embed_missing(todo, lambda ts: [V.hashed_vector(t, 4) for t in ts], 4).count() == 1
    with pytest.raises(Exception, match="unusable"):
        R.embed_missing(todo, lambda ts: [[0.0] * 4 for _ in ts], 4).collect()


def test_candidates_reserve_exact_and_collapse_passages():
    base = {"repo_id": 1, "path": "a", "exact_rank": None}
    call = base | {"target": "call", "kind": "call", "start_byte": 0, "end_byte": 50}
    passage = base | {"target": "passage", "kind": "configuration", "start_byte": 0, "end_byte": 20}
    other = base | {"target": "other", "kind": "configuration", "start_byte": 20, "end_byte": 40}
    duplicate = base | {"target": "duplicate", "kind": "declaration", "start_byte": 10, "end_byte": 30}
    exact = base | {"target": "exact", "kind": "call", "start_byte": 60, "end_byte": 70, "exact_rank": 1}
    got = C.select_candidates([call, other, passage, duplicate, exact], 4, 1)
    assert [c["target"] for c in got] == ["exact", "call", "other", "passage"]


def test_exact_channel_keeps_to_other_repositories(spark):
    sites = spark.createDataFrame([(1, "r", "alpha.beta gamma"), (2, "s", "alpha.beta"), (3, "s", "gamma alpha.beta"), (4, "r", "gamma")], "target long, repo_id string, text string")
    sites = sites.selectExpr("target", "repo_id", "'' path", "0 start_byte", "0 end_byte", "'call' kind", "text")
    sources = sites.filter("target = 1").selectExpr("target source", "repo_id", "text")
    assert rows(C.exact_channel(sources, sites), "target", "score", "rank") == [(2, 1.0, 2), (3, 2.0, 1)]


def test_lexical_channel_finds_what_shares_no_exact_term(spark):
    texts = [(1, "r", "getUser"), (2, "s", "userCount user"), (3, "s", "USERS"), (4, "s", "other"), (5, "r", "user"), (6, None, "user"), (7, "s", None)]
    sites = spark.createDataFrame(texts, "target long, repo_id string, text string").selectExpr("target", "repo_id", "'' path", "0 start_byte", "cast(target as int) end_byte", "'call' kind", "text")
    sources = sites.filter("target = 1").selectExpr("target source", "repo_id", "text")
    assert rows(C.exact_channel(sources, sites), "target") == []
    # usercount, user and again user, count, user
    assert rows(C.lexical_channel(sources, sites), "target", "score", "rank") == [(2, 4.0, 1), (3, 2.0, 2)]


@pytest.mark.parametrize("block", [1, 1000])
def test_semantic_channel_equals_a_plain_scan(spark, monkeypatch, block):
    monkeypatch.setattr(C, "BLOCK", block)
    rng = random.Random(2)
    data = [(i, f"r{i % 3}", [round(rng.uniform(-1, 1), 1) for _ in range(3)]) for i in range(60)] + [(90, "r9", [0.0, 0.0, 0.0]), (91, "r9", None), (92, "r9", [1.0])]
    sites = spark.createDataFrame(data, "target long, repo_id string, embedding array<float>").selectExpr("*", "'' path", "0 start_byte", "0 end_byte", "'call' kind")
    sources = sites.filter("target % 10 = 0").selectExpr("target source", "repo_id", "embedding")
    got = {(r.source, r.rank): (r.target, round(r.score, 6)) for r in C.semantic_channel(sources, sites, limit=4).collect()}
    want = {}
    for s, sr, sv in data[:60:10]:
        score = lambda v: sum(a * b for a, b in zip(sv, v)) / math.sqrt(sum(a * a for a in sv) * sum(b * b for b in v))
        ranked = sorted((-round(score(v), 6), r, t) for t, r, v in data[:60] if r != sr and any(v))
        want |= {(s, k): -x[0] for k, x in enumerate(ranked[:4], 1)}
    assert {k: v[1] for k, v in got.items()} == pytest.approx(want, abs=2e-6)


def test_paths(spark):
    df = spark.createDataFrame([("src/a.py",), ("node_modules/x.js",), (".git/a.py",), ("a.txt",), ("src/gen/b.go",)], "p string")
    assert [r[0] for r in df.select(P.walked("p", ["gen"])).collect()] == [True, False, False, False, False]
    assert [r[0] for r in df.select(P.excluded("p", ["src/*"])).collect()] == [True, False, False, False, True]
    assert P.normalize_relative("a/b", "../c") == "a/c" and P.normalize_relative("a", "../../c") == "c"
    assert P.package_of_specifier("@a/b/c") == "@a/b" and P.package_of_specifier("a/b") == "a"
    assert P.dotted_module("a/b/__init__.py") == "a.b" and P.dotted_module("a.go") is None and P.dotted_module("__init__.py") is None and P.dotted_module("a/c.py") == "a.c" and P.node_candidates("x")[0] == "x"
