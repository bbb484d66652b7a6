"""Filling containers of fixed capacity by a distributed grouping genetic algorithm.

Items are dealt to shards of bounded size. Several islands evolve packings of the same
shard apart from each other; crossover injects whole well-filled containers of one
parent into another, removes the containers that now hold an item twice, and re-inserts
the displaced items by best fit. Then elites migrate: each island goes on with its own
best packing and its neighbour's. The best packing of a shard stands, except for its
poorly filled containers, whose items are dealt anew and packed together with those of
other shards.
"""

from __future__ import annotations

import random
from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.bpe import public_tokenizer, token_counts
from lodegraph.storage import materialize

SHARD_ITEMS = 4000
ISLANDS = 3
POPULATION = 6
GENERATIONS = 25
#: Containers filled to less than this share are opened again, as long as there are several
#: shards; 1 opens all that have any room left.
FULL = 1.0
LEVELS = 8

Packing = list[list[int]]


def best_fit(sizes: list[int], items: list[int], capacity: int, bins: Packing) -> Packing:
    """Put items, in their order, each into the fullest container with room for it."""
    room = sorted((capacity - sum(sizes[i] for i in b), k) for k, b in enumerate(bins))
    for i in items:
        at = bisect_left(room, (sizes[i], -1))
        if at == len(room):
            bins.append([i])
            insort(room, (capacity - sizes[i], len(bins) - 1))
        else:
            left, k = room.pop(at)
            bins[k].append(i)
            insort(room, (left - sizes[i], k))
    return bins


def fitness(sizes: list[int], packing: Packing, capacity: int) -> tuple[int, float]:
    """Fewer containers first, then room concentrated in few of them. Greater is better."""
    return -len(packing), sum((sum(sizes[i] for i in b) / capacity) ** 2 for b in packing)


def crossover(sizes: list[int], a: Packing, b: Packing, capacity: int, rng: random.Random) -> Packing:
    ranked = sorted(b, key=lambda x: -sum(sizes[i] for i in x))
    start = rng.randrange(max(1, len(ranked) // 2))
    given = ranked[start : start + max(1, len(ranked) // 4)]
    held = {i for x in given for i in x}
    kept, displaced = [list(x) for x in given], []
    for x in a:
        if held.isdisjoint(x):
            kept.append(list(x))
        else:
            displaced += [i for i in x if i not in held]
    # mutation: the emptiest of the kept containers are opened too
    kept.sort(key=lambda x: -sum(sizes[i] for i in x))
    for _ in range(min(3, len(kept) - 1)):
        displaced += kept.pop()
    displaced.sort(key=lambda i: -sizes[i])
    return best_fit(sizes, displaced, capacity, kept)


def evolve(sizes: list[int], capacity: int, seeds: list[Packing], rng: random.Random) -> Packing:
    """Best packing found from the given ones and best-fit starts. Ends at the lower bound."""
    bound = -(-sum(sizes) // capacity)
    items = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    population = [*seeds]
    while len(population) < POPULATION:
        if population and len(min(population, key=len)) == bound:
            break
        order = items if not population else sorted(items, key=lambda i: -sizes[i] * rng.uniform(0.6, 1))
        population.append(best_fit(sizes, order, capacity, []))
    score = lambda p: fitness(sizes, p, capacity)
    population.sort(key=score, reverse=True)
    for _ in range(GENERATIONS):
        if len(population[0]) == bound or len(population) < 2:
            break
        a, b = sorted(rng.sample(range(len(population)), 2))
        child = crossover(sizes, population[b], population[a], capacity, rng)
        if score(child) > score(population[-1]):
            population[-1] = child
            population.sort(key=score, reverse=True)
    return population[0]


def _packing_of(pdf: pd.DataFrame) -> Packing:
    """The containers of rows in the order of their item numbers."""
    bins: dict[int, list[int]] = {}
    for i, b in enumerate(pdf["bin"]):
        bins.setdefault(b, []).append(i)
    return list(bins.values())


def _pack_level(items: DataFrame, capacity: int, shards: int, level: int) -> DataFrame:
    """(key, size, shard, bin) for (key, size): the best packing of each shard.

    Every shard starts with best fit; islands are begun only for shards whose start is
    above the lower bound.
    """
    shard = F.pmod(F.xxhash64("key", F.lit(level)), F.lit(shards)).cast("int")
    schema = "key string, size long, shard int, island int, bin int, optimal boolean"

    def settle(pdf: pd.DataFrame, packing: Packing, island: int) -> pd.DataFrame:
        of = [0] * len(pdf)
        for k, b in enumerate(packing):
            for i in b:
                of[i] = k
        bound = -(-int(pdf["size"].sum()) // capacity)
        return pdf[["key", "size", "shard"]].assign(island=island, bin=of, optimal=len(packing) == bound)

    def start(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key", ignore_index=True)
        sizes = pdf["size"].tolist()
        return settle(pdf, best_fit(sizes, sorted(range(len(sizes)), key=lambda i: -sizes[i]), capacity, []), -1)

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key", ignore_index=True)
        island = int(pdf["island"].iloc[0])
        rng = random.Random(f"{level}/{pdf['shard'].iloc[0]}/{island}")
        return settle(pdf, evolve(pdf["size"].tolist(), capacity, [_packing_of(pdf)], rng), island)

    def second(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["island", "key"], ignore_index=True)
        sets = [g.reset_index(drop=True) for _, g in pdf.groupby("island")]
        sizes = sets[0]["size"].tolist()
        elites = [_packing_of(g) for g in sets]
        if not bool(pdf["optimal"].any()):
            rng = random.Random(f"{level}/{pdf['shard'].iloc[0]}/migrated")
            ring = [[elites[k], elites[k - 1]] for k in range(len(elites))]
            elites += [evolve(sizes, capacity, [[list(b) for b in p] for p in seeds], rng) for seeds in ring]
        best = max(elites, key=lambda p: fitness(sizes, p, capacity))
        return settle(sets[0], best, 0)

    started = materialize(items.withColumn("shard", shard).groupBy("shard").applyInPandas(start, schema), "pack-start")
    islands = started.filter("NOT optimal").withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])))
    evolved = islands.groupBy("shard", "island").applyInPandas(first, schema).groupBy("shard").applyInPandas(second, schema)
    return started.filter("optimal").unionByName(evolved).select("key", "size", "shard", "bin")


def pack_items(items: DataFrame, capacity: int) -> DataFrame:
    """(key, size, container): items (key string, size from 1 to capacity) in containers.

    Keys are unique. No container exceeds the capacity; every item is in exactly one.
    """
    open_items = materialize(items.select("key", F.col("size").cast("long").alias("size")), "pack-items")
    done: DataFrame | None = None
    closed_bins, bound = 0, -(-(open_items.agg(F.sum("size")).first()[0] or 0) // capacity)
    for level in range(LEVELS):
        n = open_items.count()
        shards = max(1, -(-n // SHARD_ITEMS))
        packed = materialize(_pack_level(open_items, capacity, shards, level), "pack-level")
        named = packed.withColumn("container", F.concat_ws("-", F.lit(level), "shard", "bin"))
        fill = packed.groupBy("shard", "bin").agg(F.sum("size").alias("_fill"))
        bins, full = fill.agg(F.count("*"), F.count(F.when(F.col("_fill") >= FULL * capacity, 1))).first()
        if shards == 1 or level == LEVELS - 1 or closed_bins + bins == bound:
            closed, open_items = named, None
        else:
            closed_bins += full
            marked = named.join(fill, ["shard", "bin"])
            closed = marked.filter(F.col("_fill") >= FULL * capacity)
            open_items = materialize(marked.filter(F.col("_fill") < FULL * capacity).select("key", "size"), "pack-open")
        closed = closed.select("key", "size", "container")
        done = closed if done is None else done.unionByName(closed)
        if open_items is None:
            break
    return done


def pack_documents(documents: DataFrame, id_col: str, text_col: str, capacity: int = 2048, tokenizer: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """Containers of at most `capacity` tokens for the texts of documents.

    Returns (id, piece_no, first_token, n_tokens, container). A text above the capacity
    is cut into full pieces and a rest; other texts stay whole. Null and empty texts are
    left out. Ids are unique; rows that repeat an id are kept as one with its longest text.
    """
    sized = documents.select(F.col(id_col).alias("id"), token_counts(F.col(text_col), *public_tokenizer(tokenizer)).alias("n"))
    sized = sized.groupBy("id").agg(F.max("n").alias("n")).filter("n > 0")
    cap = F.lit(capacity).cast("long")
    pieces = sized.select("id", "n", F.posexplode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / cap))).alias("piece_no", "_k"))
    pieces = pieces.select("id", "piece_no", (F.col("_k") * cap).alias("first_token"), F.least(cap, F.col("n") - F.col("_k") * cap).alias("n_tokens"))
    pieces = materialize(pieces.withColumn("key", F.concat_ws("#", F.col("id").cast("string"), "piece_no")), "pack-pieces")
    full = pieces.filter(F.col("n_tokens") == cap).withColumn("container", F.concat(F.lit("full-"), "key"))
    rest = pieces.filter(F.col("n_tokens") < cap)
    packed = pack_items(rest.select("key", F.col("n_tokens").alias("size")), capacity)
    rest = rest.join(packed.select("key", "container"), "key")
    out = full.select("id", "piece_no", "first_token", "n_tokens", "container").unionByName(rest.select("id", "piece_no", "first_token", "n_tokens", "container"))
    return out.withColumnRenamed("id", id_col)
