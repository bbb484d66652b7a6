"""Nodes on cycles of a graph in which a node may have many parents.

The graph is raked and compressed until its core is small: nodes without an edge in or
without one out fall off, and chains of nodes with one edge in and one out become single
edges, found by jumps that double. Both need a number of rounds that is logarithmic in the
length of chains and rings and in the size of trees. A core of few edges, counted, is solved
in one task; a larger one that shrinks no more is separated by colours. The chains of every
level then take their component from the nodes at their ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.storage import materialize

#: Edges of a core that one task solves.
SMALL_CORE = 200_000
#: A round that leaves more than this share of the edges does not pay.
SHRINKS = 0.9


class Level(NamedTuple):
    """What one compression took out of the graph."""

    chains: DataFrame  # (id, chain)
    ends: DataFrame  # (chain, u, v): the edge that stands for the chain
    rings: DataFrame  # (id, comp)
    loops: DataFrame  # (id): ends of chains that lead back to where they began


def cycle_members(edges: DataFrame, src: str, dst: str, small: int = SMALL_CORE) -> DataFrame:
    """(id): nodes that lead back to themselves over one or more edges.

    Null ends are no edges and repeated edges count once. Cores of up to `small` edges are
    solved in one task.
    """
    e = edges.filter(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(F.col(src).cast("long").alias("a"), F.col(dst).cast("long").alias("b")).distinct()
    e = materialize(e, "cyc-edges")
    loops = e.filter("a = b").select(F.col("a").alias("id"))
    e, levels = e.filter("a <> b"), []
    size = e.count()
    while True:
        if size <= small:
            found = _solve(e)
            break
        short, level = _compress(materialize(_rake(e), "cyc-raked"))
        now = short.count()
        levels.append(level)
        e = short
        if now > SHRINKS * size and now > small:
            found = _components(e)
            break
        size = now
    for level in reversed(levels):
        found = materialize(_unfold(found, level), "cyc-found")
    return found.select("id").union(loops).distinct()


def _rake(e: DataFrame) -> DataFrame:
    """The edges between nodes that have an edge in and an edge out."""
    into, out = e.select(F.col("b").alias("a")).distinct(), e.select(F.col("a").alias("b")).distinct()
    return e.join(into, "a", "left_semi").join(out, "b", "left_semi").select("a", "b")


def _compress(e: DataFrame) -> tuple[DataFrame, Level]:
    """Chains of nodes with one edge in and one out as single edges."""
    single = e.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("_n"), F.first("b").alias("next")).filter("_n = 1")
    single = single.join(e.groupBy(F.col("b").alias("id")).agg(F.count("*").alias("_m")).filter("_m = 1"), "id").select("id", "next")
    inner = materialize(single, "cyc-inner")
    last = inner.join(inner.select(F.col("id").alias("next"), F.lit(True).alias("_in")), "next", "left").select("id", "next", F.col("_in").isNull().alias("last"))
    last = materialize(last, "cyc-last")
    jumps = last.filter("NOT last").join(last.select(F.col("id").alias("next"), F.col("last").alias("done")), "next").select("id", F.col("next").alias("target"), F.col("next").alias("least"), "done")
    done, rings = _double(jumps)
    chains = materialize(done.select("id", F.col("target").alias("chain")).union(last.filter("last").select("id", F.col("id").alias("chain"))), "cyc-chains")
    outer = e.join(inner.select(F.col("id").alias("a")), "a", "left_anti")
    heads = outer.join(chains.select(F.col("id").alias("b"), "chain"), "b").select("chain", F.col("a").alias("u"))
    ends = materialize(heads.join(last.select(F.col("id").alias("chain"), F.col("next").alias("v")), "chain").select("chain", "u", "v"), "cyc-ends")
    plain = outer.join(inner.select(F.col("id").alias("b")), "b", "left_anti").select("a", "b")
    short = plain.union(ends.filter("u <> v").select("u", "v")).distinct()
    return materialize(short, "cyc-short"), Level(chains, ends, rings, ends.filter("u = v").select(F.col("u").alias("id")).distinct())


def _double(jumps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, target) of the jumps that end, and (id, comp) of those on rings.

    A jump covers 2**r nodes after r rounds. Those of an open chain that are not yet at its
    end are all open, so once a jump covers as many nodes more as were open at any round,
    what is still open leads round a ring; the least node it met names the ring.
    """
    current, reach, limit = materialize(jumps, "cyc-jumps"), 1, None
    while (still := current.filter("NOT done").count()) and (limit is None or reach < limit):
        limit = reach + still if limit is None else min(limit, reach + still)
        step = current.select(F.col("id").alias("target"), F.col("target").alias("_t"), F.col("least").alias("_l"), F.col("done").alias("_d"))
        longer = current.filter("NOT done").join(step, "target").select("id", F.col("_t").alias("target"), F.least("least", "_l").alias("least"), F.col("_d").alias("done"))
        current = materialize(current.filter("done").unionByName(longer), "cyc-jumps")
        reach *= 2
    return current.filter("done").select("id", "target"), current.filter("NOT done").select("id", F.col("least").alias("comp"))


def _unfold(found: DataFrame, level: Level) -> DataFrame:
    """(id, comp) with the nodes of rings and of chains whose ends share a component."""
    alone = level.loops.join(found.select("id"), "id", "left_anti").select("id", F.col("id").alias("comp"))
    known = materialize(found.unionByName(alone).unionByName(level.rings), "cyc-known")
    of = lambda end: known.select(F.col("id").alias(end), F.col("comp").alias(f"_{end}"))
    closed = level.ends.join(of("u"), "u").join(of("v"), "v").filter("_u = _v").select("chain", F.col("_u").alias("comp"))
    return known.unionByName(level.chains.join(closed, "chain").select("id", "comp"))


def components(a: list[int], b: list[int]) -> dict[int, int]:
    """Strongly connected components of more than one node: node to the root of its own.
    Tarjan's algorithm with a stack of its own."""
    onward: dict[int, list[int]] = {}
    for x, y in zip(a, b):
        onward.setdefault(x, []).append(y)
    order: dict[int, int] = {}
    low: dict[int, int] = {}
    held: list[int] = []
    on: set[int] = set()
    out: dict[int, int] = {}
    for root in onward:
        if root in order:
            continue
        walk = [(root, iter(onward[root]))]
        order[root] = low[root] = len(order)
        held.append(root)
        on.add(root)
        while walk:
            x, rest = walk[-1]
            for y in rest:
                if y not in order:
                    order[y] = low[y] = len(order)
                    held.append(y)
                    on.add(y)
                    walk.append((y, iter(onward.get(y, ()))))
                    break
                if y in on:
                    low[x] = min(low[x], order[y])
            else:
                walk.pop()
                if walk:
                    low[walk[-1][0]] = min(low[walk[-1][0]], low[x])
                if low[x] == order[x]:
                    members = []
                    while not members or members[-1] != x:
                        members.append(held.pop())
                    on.difference_update(members)
                    if len(members) > 1:
                        out.update(dict.fromkeys(members, x))
    return out


def _solve(e: DataFrame) -> DataFrame:
    """(id, comp) of a core whose edges are counted and few, in one task."""

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a: list[int] = []
        b: list[int] = []
        for pdf in batches:
            a += pdf["a"].tolist()
            b += pdf["b"].tolist()
        found = components(a, b)
        yield pd.DataFrame({"id": list(found), "comp": list(found.values())}, dtype="int64")

    return materialize(e.coalesce(1).mapInPandas(solve, "id long, comp long"), "cyc-solved")


def _components(e: DataFrame) -> DataFrame:
    """(id, comp) of a core of any size: colours (the greatest id that reaches a node)
    separate the components; each round takes out the component of every colour's origin."""
    found = None
    while True:
        e = materialize(_rake(e), "cyc-core")
        if e.isEmpty():
            return found if found is not None else e.select(F.col("a").alias("id"), F.col("b").alias("comp"))
        colour = _colour(e)
        # members of an origin's component: nodes of its colour that lead to it
        same = e.join(colour.select(F.col("id").alias("a"), F.col("c").alias("ca")), "a").join(colour.select(F.col("id").alias("b"), F.col("c").alias("cb")), "b").filter("ca = cb").select("a", "b", F.col("ca").alias("c"))
        same = materialize(same, "cyc-same")
        members = materialize(colour.filter("id = c"), "cyc-members")
        frontier = members
        while True:
            more = same.join(frontier.select(F.col("id").alias("b"), "c"), ["b", "c"]).select(F.col("a").alias("id"), "c").distinct()
            frontier = materialize(more.join(members, ["id", "c"], "left_anti"), "cyc-front")
            if frontier.isEmpty():
                break
            members = materialize(members.unionByName(frontier), "cyc-members")
        real = members.groupBy("c").agg(F.count("*").alias("_n")).filter("_n > 1").select("c")
        closed = members.join(real, "c").select("id", F.col("c").alias("comp"))
        found = materialize(closed if found is None else found.unionByName(closed), "cyc-found")
        gone = members.select("id")
        e = e.join(gone.select(F.col("id").alias("a")), "a", "left_anti").join(gone.select(F.col("id").alias("b")), "b", "left_anti")


def _colour(e: DataFrame) -> DataFrame:
    """(id, c): the greatest id that reaches id, itself included."""
    colour = materialize(e.select(F.col("a").alias("id")).union(e.select("b")).distinct().withColumn("c", F.col("id")), "cyc-colour")
    while True:
        sent = e.join(colour.select(F.col("id").alias("a"), "c"), "a").groupBy(F.col("b").alias("id")).agg(F.max("c").alias("_c"))
        moved = materialize(colour.join(sent, "id", "left").select("id", F.greatest("c", F.coalesce("_c", "c")).alias("c"), (F.coalesce("_c", "c") > F.col("c")).alias("_moved")), "cyc-colour")
        if moved.filter("_moved").isEmpty():
            return moved.drop("_moved")
        colour = moved.drop("_moved")
