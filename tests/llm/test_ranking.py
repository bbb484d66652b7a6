from __future__ import annotations

import random

import numpy as np
import pytest

from lodegraph.llm.fusion import fuse_rankings, order_items, principal_loadings
from lodegraph.llm.topn import top_n
from tests.conftest import rows

HITS = "hit_id long, run_id long, source string, target string, score double, _n string, rank string, path string"
GROUP = ["run_id", "source"]


def hits(spark, data):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in data], HITS)


def limits(spark, data):
    return spark.createDataFrame(data, "run_id long, n int")


def top(spark, data, ns):
    return top_n(hits(spark, data), limits(spark, ns), GROUP, "target", "score", "hit_id", "run_id", "n")


def brute(data, ns):
    newest = {}
    for h, r, s, t, x in data:
        if (r, s, t) not in newest or h > newest[r, s, t][0]:
            newest[r, s, t] = (h, x)
    groups = {}
    for (r, s, t), (h, x) in newest.items():
        if x is not None and x == x:
            groups.setdefault((r, s), []).append((-x, t, h))
    ns = dict(ns)
    return sorted(h for (r, _), g in groups.items() for _, _, h in sorted(g)[: ns.get(r) or 0])


def test_ties_repeats_and_bad_scores(spark):
    data = [(1, 1, "a", "t1", 0.5), (2, 1, "a", "t2", 0.5), (3, 1, "a", "t3", 0.5), (4, 1, "a", "t1", None), (5, 1, "a", "t4", float("nan")), (6, 1, "a", "t5", -0.0), (7, 1, "a", "t6", 0.0), (1, 1, "a", "t1", 0.5), (8, 2, "b", "q", 1.0), (9, 3, "c", "q", 1.0)]
    ns = [(1, 3), (2, None)]
    got = top(spark, data, ns)
    assert [r[0] for r in rows(got, "hit_id")] == brute(data, ns) == [2, 3, 6]
    assert rows(got, "rank", "target") == [(1, "t2"), (2, "t3"), (3, "t5")]


@pytest.mark.parametrize("seed", range(2))
def test_hot_group_against_brute_force(spark, seed):
    rng = random.Random(seed)
    data = [(i, rng.choice([1, 1, 2]), "hot" if rng.random() < 0.4 else f"s{rng.randrange(40)}", f"t{rng.randrange(3000):05d}", round(rng.random(), 2)) for i in range(6000)]
    ns = [(1, 5), (2, 40)]
    assert [r[0] for r in rows(top(spark, data, ns), "hit_id")] == brute(data, ns)


def test_row_groups_are_skipped_and_nothing_is_lost(spark, monkeypatch):
    import lodegraph.llm.topn as T

    monkeypatch.setattr(T, "ROW_GROUP_BYTES", 4096)
    data = [(i, 1, "hot", f"t{i:06d}", float((i * 7919) % 20011)) for i in range(20000)]
    assert [r[0] for r in rows(top(spark, data, [(1, 7)]), "hit_id")] == brute(data, [(1, 7)])


def test_ties_in_a_hot_group_are_skipped_too(spark, monkeypatch):
    import lodegraph.llm.topn as T

    monkeypatch.setattr(T, "ROW_GROUP_BYTES", 4096)
    data = [(i, 1, "hot", f"t{(i * 7919) % 20011:06d}", 0.5 if i % 3 else 0.25) for i in range(20000)]
    assert [r[0] for r in rows(top(spark, data, [(1, 9)]), "hit_id")] == brute(data, [(1, 9)])


def test_empty_and_null_keys(spark):
    assert top(spark, [], [(1, 3)]).count() == 0
    data = [(1, None, "a", "t", 1.0), (2, 1, None, "t", 1.0), (3, 1, None, None, 2.0)]
    assert rows(top(spark, data, [(1, 1)]), "hit_id") == [(3,)]


CHANNELS = "hit_id long, run_id long, source string, target string, channels map<string,struct<rank:int,score:double>>, projection string, _run string"
DIRECTIONS = {"semantic": 1, "exact": 1, "lexical": 1}


def channel_hits(spark, data):
    return spark.createDataFrame([(h, r, s, t, None if c is None else {k: (None, v) for k, v in c.items()}, "x", "y") for h, r, s, t, c in data], CHANNELS)


def fuse(spark, data, directions=DIRECTIONS):
    return order_items(fuse_rankings(channel_hits(spark, data), "run_id", "source", "target", "hit_id", "channels", directions), "run_id", "source", "target")


def test_no_scale_decides(spark):
    rng = np.random.default_rng(1)
    data, want = [], {}
    for run, scale in ((1, 1.0), (2, 1e6)):
        for s in range(30):
            quality = rng.permutation(10) / 10
            for t, q in enumerate(quality):
                c = {"semantic": float(0.8 + q / 100 + rng.normal() / 4000), "exact": float(round(q * 30)), "lexical": float(scale * 10 ** (3 * q + rng.normal() / 40))}
                data.append((len(data), run, f"s{s}", f"t{t}", c))
            want[run, f"s{s}"] = [f"t{t}" for t in np.argsort(-quality)][:3]
    got = {}
    for r in fuse(spark, data).filter("rank <= 3").orderBy("rank").collect():
        got.setdefault((r.run_id, r.source), []).append(r.target)
    assert sum(got[k] == v for k, v in want.items()) >= 57


def test_missing_null_and_repeated(spark):
    data = [(1, 1, "s", "a", {"semantic": 0.9}), (2, 1, "s", "a", {"semantic": 0.1}), (3, 1, "s", "b", {"semantic": 0.5, "exact": 3.0}), (4, 1, "s", "c", None), (5, 1, "s", "d", {"semantic": float("nan"), "exact": None}), (6, 1, "s", "e", {}), (7, 1, None, "f", {"lexical": 1.0})]
    got = fuse(spark, data)
    assert rows(got.filter("source = 's'"), "rank", "target") == [(1, "b"), (2, "a"), (3, "c"), (4, "d"), (5, "e")]
    assert rows(got.filter("source IS NULL"), "rank", "target") == [(1, "f")]
    assert fuse(spark, []).count() == 0


def test_directions(spark):
    data = [(i, 1, "s", f"t{i}", {"semantic": float(i), "exact": float(-i)}) for i in range(9)]
    got = fuse(spark, data, {"semantic": 1, "exact": -1})
    assert [r.target for r in got.orderBy("rank").collect()] == [f"t{i}" for i in range(8, -1, -1)]


def test_loadings():
    w = principal_loadings(np.array([[1, 0.5, 0.5], [0.5, 1, 0.5], [0.5, 0.5, 1]]), np.array([1, 1, -1]))
    assert np.allclose(w, np.array([1, 1, -1]) / 3**0.5)
    assert np.isfinite(principal_loadings(np.full((2, 2), np.nan), np.array([1, 1]))).all()


def test_ranks_of_few_and_many_runs_agree(spark, monkeypatch):
    from lodegraph.llm import fusion
    from lodegraph.operators import joins

    rng = np.random.default_rng(5)
    data = [(i, None if i % 7 == 0 else i % 3, f"s{i % 5}", f"t{i}", {"semantic": float(rng.normal()), "exact": float(i % 4)} if i % 6 else {"lexical": float(i)}) for i in range(120)]
    ranked = lambda: sorted(map(repr, fuse(spark, data).select("run_id", "source", "target", "rank").collect()))
    few = ranked()
    for module in (fusion, joins):
        monkeypatch.setattr(module, "BROADCAST_BYTES", 0)
    assert ranked() == few and len(few) == 120
