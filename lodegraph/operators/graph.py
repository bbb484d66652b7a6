"""Graph operators over definitions and edges.

Edges are frames (src, dst[, confidence]); definitions are frames with def_id, name,
qualified_name, kind, language, file_path, visibility and branch_id. Walks are
breadth-first joins of a frontier with the edges; every level is written, so plans stay
short, and what was visited is never walked again, so cycles end.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.operators.frames import distinct_on
from lodegraph.storage import materialize

CONFIDENCE_WEIGHT = {"certain": 1.0, "inferred": 0.7, "uncertain": 0.4}
OTHER_WEIGHT = 0.5


def confidence_weight(confidence: Column) -> Column:
    out = F.lit(OTHER_WEIGHT)
    for name, weight in CONFIDENCE_WEIGHT.items():
        out = F.when(confidence == name, weight).otherwise(out)
    return out


# -- names and scopes -------------------------------------------------------------------


def name_matches(query: str, name: str = "name", qualified: str = "qualified_name", escape: bool = False) -> Column:
    """The name, the qualified name, or its end after a dot. % and _ of the query are
    wildcards in that last form unless they are escaped."""
    pattern = "%." + (query.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") if escape else query)
    return (F.col(name) == query) | (F.col(qualified) == query) | F.col(qualified).like(pattern)


def in_branches(df: DataFrame, branch_ids: int | Sequence[int], column: str = "branch_id") -> DataFrame:
    ids = [branch_ids] if isinstance(branch_ids, int) else list(branch_ids)
    return df.filter(F.col(column).isin(*ids)) if ids else df.limit(0)


def of_languages(df: DataFrame, languages: Sequence[str] | None, column: str = "language") -> DataFrame:
    return df if languages is None else df.filter(F.col(column).isin(*languages))


def of_confidence(edges: DataFrame, confidence: str | None) -> DataFrame:
    return edges if confidence is None else edges.filter(F.col("confidence") == confidence)


def one_per_definition(defs: DataFrame) -> DataFrame:
    rest = [c for c in defs.columns if c != "def_id"]
    first = defs.groupBy("def_id").agg(F.min_by(F.struct(*rest), F.struct("branch_id", "file_path")).alias("_first"))
    return first.select(*[F.col("def_id") if c == "def_id" else F.col(f"_first.{c}").alias(c) for c in defs.columns])


def _with_depth(defs: DataFrame, reached: DataFrame) -> DataFrame:
    """Definitions reached, one row each, with their depth; the others are not looked at."""
    return one_per_definition(defs.join(reached, "def_id", "left_semi")).join(reached, "def_id")


def resolve(defs: DataFrame, query: str, kind: str | None = None, languages: Sequence[str] | None = None, escape: bool = False) -> DataFrame:
    """Definitions that a name may mean, one row each."""
    found = of_languages(defs.filter(name_matches(query, escape=escape)), languages)
    return one_per_definition(found if kind is None else found.filter(F.col("kind") == kind))


def seeds_of(defs: DataFrame, query: str) -> DataFrame:
    return defs.filter(name_matches(query)).select("def_id").distinct()


# -- one hop ----------------------------------------------------------------------------


def callers_of(edges: DataFrame, defs: DataFrame, query: str, confidence: str | None = None, languages: Sequence[str] | None = None) -> DataFrame:
    hit = of_confidence(edges, confidence).join(seeds_of(defs, query).withColumnRenamed("def_id", "dst"), "dst", "left_semi")
    return of_languages(one_per_definition(defs.join(hit.select(F.col("src").alias("def_id")).distinct(), "def_id", "left_semi")), languages)


def callees_of(edges: DataFrame, defs: DataFrame, query: str, confidence: str | None = None, languages: Sequence[str] | None = None) -> DataFrame:
    hit = of_confidence(edges, confidence).join(seeds_of(defs, query).withColumnRenamed("def_id", "src"), "src", "left_semi")
    return of_languages(one_per_definition(defs.join(hit.select(F.col("dst").alias("def_id")).distinct(), "def_id", "left_semi")), languages)


def accessors_of(accesses: DataFrame, defs: DataFrame, query: str, mode: str) -> DataFrame:
    """Definitions that read or write (mode) a target; readwrite counts as both."""
    hit = accesses.filter(F.col("access_type").isin(mode, "readwrite")).join(seeds_of(defs, query).withColumnRenamed("def_id", "target_def_id"), "target_def_id", "left_semi")
    return one_per_definition(defs.join(hit.select(F.col("accessor_def_id").alias("def_id")).distinct(), "def_id", "left_semi"))


# -- walks ------------------------------------------------------------------------------


def walk(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None, backward: bool = False) -> DataFrame:
    """(def_id, depth) of all that seeds reach, by least depth.

    A seed is in the result, at depth 1, only where an edge leads from a seed to it.
    Depth 1 is always walked; null ends lead nowhere.
    """
    a, b = ("dst", "src") if backward else ("src", "dst")
    hops = materialize(edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("_a"), F.col(b).alias("def_id")).distinct(), "walk-edges")
    seeds = materialize(seeds.select("def_id").distinct(), "walk-seeds")
    start = hops.join(seeds.withColumnRenamed("def_id", "_a"), "_a", "left_semi").select("def_id").distinct()
    frontier = materialize(start.withColumn("depth", F.lit(1)), "walk-level")
    found, depth = frontier, 1
    # seeds reached at depth 1 are known; the others are never entered
    while (max_depth is None or depth < max_depth) and not frontier.isEmpty():
        onward = frontier.join(seeds, "def_id", "left_anti") if depth == 1 else frontier
        depth += 1
        step = hops.join(onward.select(F.col("def_id").alias("_a")), "_a", "left_semi").select("def_id").distinct()
        step = step.join(found.select("def_id"), "def_id", "left_anti").join(seeds, "def_id", "left_anti")
        frontier = materialize(step.withColumn("depth", F.lit(depth)), "walk-level")
        found = found.unionByName(frontier)
    return found


def reachable_from(edges: DataFrame, defs: DataFrame, query: str, max_depth: int | None = None, confidence: str | None = None, languages: Sequence[str] | None = None) -> DataFrame:
    """Definitions that a name leads to, with their least depth. The language filter holds
    for what is returned, not for what is walked through."""
    return of_languages(_with_depth(defs, walk(of_confidence(edges, confidence), seeds_of(defs, query), max_depth)), languages)


def ancestors(edges: DataFrame, defs: DataFrame, query: str, max_depth: int | None = None, confidence: str | None = None, languages: Sequence[str] | None = None) -> DataFrame:
    """Definitions that lead to a name, with their least depth."""
    return of_languages(_with_depth(defs, walk(of_confidence(edges, confidence), seeds_of(defs, query), max_depth, backward=True)), languages)


def is_reachable(edges: DataFrame, sources: DataFrame, targets: DataFrame, max_depth: int | None = None, confidence: str | None = None) -> bool:
    """Whether a source leads to a target over a path that repeats no definition, except
    for an edge from a definition to itself. max_depth counts the nodes of the path."""
    live = of_confidence(edges, confidence).filter("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct()
    s, t = sources.select(F.col("def_id").alias("origin")).distinct(), targets.select(F.col("def_id").alias("dst")).distinct()
    frontier = materialize(live.join(s.withColumnRenamed("origin", "src"), "src", "left_semi").select(F.col("src").alias("origin"), "dst"), "reach")
    seen, hops = frontier, 1
    while not frontier.isEmpty():
        hit = frontier.join(t, "dst", "left_semi")
        if not (hit if hops == 1 else hit.filter("origin <> dst")).isEmpty():
            return True
        if max_depth is not None and hops >= max(1, max_depth - 1):
            return False
        hops += 1
        step = live.join(frontier.filter("origin <> dst").select("origin", F.col("dst").alias("src")), "src").select("origin", "dst").distinct()
        frontier = materialize(step.join(seen, ["origin", "dst"], "left_anti"), "reach")
        seen = seen.unionByName(frontier)
    return False


def simple_paths(edges: DataFrame, sources: DataFrame, targets: DataFrame, max_depth: int | None = 8, max_paths: int = 50, multiplicity: bool = False) -> DataFrame:
    """(path, length): paths from a source to a target that repeat no definition, the
    shortest first, then by their ids. max_depth bounds the nodes of a path (two are
    always allowed), None does not; an edge from a definition to itself is a path.
    multiplicity keeps parallel edges.

    Every beginning of a path has a least length, by the distance of its end from a target;
    beginnings are followed in that order, so a path is built only when its length is due,
    and edges that lead to no target never.
    """
    live = edges.filter("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst")
    live = materialize(live if multiplicity else live.distinct(), "path-edges")
    t = materialize(targets.select(F.col("def_id").alias("dst")).distinct(), "path-targets")
    leading = walk(live, t.withColumnRenamed("dst", "def_id"), max_depth, backward=True).select(F.col("def_id").alias("dst"), "depth").union(t.withColumn("depth", F.lit(0)))
    useful = materialize(live.join(leading.groupBy("dst").agg(F.min("depth").alias("left")), "dst").select("src", "dst", "left"), "path-useful")
    alone = t.count() == 1

    def followed(paths: DataFrame) -> DataFrame:
        paths = paths.withColumn("least", F.size("path") + F.col("left"))
        return materialize(paths if max_depth is None else paths.filter(F.col("least") <= max(max_depth, 2)), "paths")

    start = useful.join(sources.select(F.col("def_id").alias("src")).distinct(), "src", "left_semi")
    waiting = followed(start.select(F.array("src", "dst").alias("path"), F.col("dst").alias("last"), "left"))
    arrived, total = [waiting.filter("false")], 0
    while total < max_paths and (due := waiting.agg(F.min("least")).first()[0]) is not None:
        level, later = waiting.filter(F.col("least") == due), [waiting.filter(F.col("least") > due)]
        while not level.isEmpty():
            hits = level.filter("left = 0")
            arrived.append(hits)
            total += hits.count()
            onward = level.filter(F.element_at("path", 1) != F.element_at("path", -1))
            # no path leads back to the only target
            onward = onward.filter("left > 0") if alone else onward
            longer = onward.select("path", F.col("last").alias("src")).join(useful, "src").filter(~F.array_contains("path", F.col("dst")))
            longer = followed(longer.select(F.array_append("path", F.col("dst")).alias("path"), F.col("dst").alias("last"), "left"))
            later.append(longer.filter(F.col("least") > due))
            level = longer.filter(F.col("least") == due)
        # all paths of the due length are known now
        waiting = later[0]
        for more in later[1:]:
            waiting = waiting.unionByName(more)
        waiting = materialize(waiting, "paths")
    out = arrived[0]
    for more in arrived[1:]:
        out = out.unionByName(more)
    return out.select("path", F.size("path").alias("length")).orderBy("length", "path").limit(max_paths)


def taint_edges(calls: DataFrame, accesses: DataFrame, sanitizers: DataFrame) -> DataFrame:
    """Flows: calls, writers to what they write, read targets to their readers; nothing
    flows into a sanitizer."""
    flows = calls.select("src", "dst")
    writes = accesses.filter(F.col("access_type").isin("write", "readwrite")).select(F.col("accessor_def_id").alias("src"), F.col("target_def_id").alias("dst"))
    reads = accesses.filter(F.col("access_type").isin("read", "readwrite")).select(F.col("target_def_id").alias("src"), F.col("accessor_def_id").alias("dst"))
    return flows.unionByName(writes).unionByName(reads).join(sanitizers.select(F.col("def_id").alias("dst")).distinct(), "dst", "left_anti").select("src", "dst")


def taint_paths(calls: DataFrame, accesses: DataFrame, sources: DataFrame, sinks: DataFrame, sanitizers: DataFrame, max_depth: int | None = 8, max_paths: int = 50) -> DataFrame:
    return simple_paths(taint_edges(calls, accesses, sanitizers), sources, sinks, max_depth, max_paths)


# -- entry points -----------------------------------------------------------------------


def entrypoints(defs: DataFrame, calls: DataFrame, overrides: DataFrame, kinds: Sequence[str] = ("function", "method"), file_suffix: str | None = None, include_internal: bool = False) -> DataFrame:
    """Definitions of the kinds that nothing calls and that override nothing. Internal and
    private ones, and files below an interfaces directory, are left out unless asked for."""
    out = defs.filter(F.col("kind").isin(*kinds))
    if file_suffix is not None:
        out = out.filter(F.col("file_path").like("%" + file_suffix))
    if not include_internal:
        hidden = F.coalesce(F.col("visibility").isin("internal", "private"), F.lit(False))
        out = out.filter(~hidden & ~F.col("file_path").like("%/interfaces/%") & ~F.col("file_path").like("%/interface/%"))
    out = out.join(calls.select(F.col("dst").alias("def_id")).distinct(), "def_id", "left_anti")
    return one_per_definition(out.join(overrides.select(F.col("child_def_id").alias("def_id")).distinct(), "def_id", "left_anti"))


def entrypoints_reaching(edges: DataFrame, defs: DataFrame, entries: DataFrame, query: str, max_depth: int | None = None) -> DataFrame:
    return ancestors(edges, defs, query, max_depth).join(entries.select("def_id"), "def_id", "left_semi")


def entrypoint_paths(edges: DataFrame, defs: DataFrame, entries: DataFrame, query: str, max_depth: int | None = 8, max_paths: int = 50) -> DataFrame:
    """Paths from every entry point that reaches a name to it."""
    reaching = entrypoints_reaching(edges, defs, entries, query, max_depth).select("def_id")
    return simple_paths(edges, reaching, seeds_of(defs, query), max_depth, max_paths)


# -- inheritance ------------------------------------------------------------------------


def inheritance_tree(inherits: DataFrame, defs: DataFrame, query: str, languages: Sequence[str] | None = None) -> DataFrame:
    """(def_id, bases, children): everything above and below what is one edge around the
    seeds, siblings included, with the names of bases in declaration order."""
    known = inherits.filter("base_def_id IS NOT NULL").select(F.col("child_def_id").alias("src"), F.col("base_def_id").alias("dst"))
    seeds = seeds_of(defs, query)
    near = seeds.union(known.join(seeds.withColumnRenamed("def_id", "src"), "src", "left_semi").select("dst")).union(known.join(seeds.withColumnRenamed("def_id", "dst"), "dst", "left_semi").select("src")).distinct()
    near = materialize(near, "tree-near")
    nodes = near.union(walk(known, near).select("def_id")).union(walk(known, near, backward=True).select("def_id")).distinct()
    names = one_per_definition(defs).select("def_id", "qualified_name", "language")
    named = inherits.join(names.select(F.col("def_id").alias("base_def_id"), F.col("qualified_name").alias("_q")), "base_def_id", "left")
    bases = named.groupBy(F.col("child_def_id").alias("def_id")).agg(F.array_sort(F.collect_set(F.struct("ord", F.coalesce("_q", "base_name").alias("base")))).alias("_b")).select("def_id", F.transform("_b", lambda b: b["base"]).alias("bases"))
    children = known.join(names.select(F.col("def_id").alias("src"), "qualified_name"), "src").groupBy(F.col("dst").alias("def_id")).agg(F.array_sort(F.collect_set("qualified_name")).alias("children"))
    out = names.join(nodes, "def_id", "left_semi").join(bases, "def_id", "left").join(children, "def_id", "left")
    empty = F.expr("cast(array() as array<string>)")
    return of_languages(out, languages).select("def_id", "qualified_name", F.coalesce("bases", empty).alias("bases"), F.coalesce("children", empty).alias("children"))


def linearize(inherits: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(def_id, ancestor_id, position): the ancestors of every definition, closest first,
    bases of one definition in declaration order; each once.

    Pairs are extended by doubling: an ancestor up to twice as far as all known ones is
    known from one at just that distance. So a chain of n classes takes log n rounds.
    """
    base = inherits.filter("base_def_id IS NOT NULL AND base_def_id <> child_def_id").groupBy("child_def_id", "base_def_id").agg(F.min("ord").alias("ord"))
    found = materialize(base.select(F.col("child_def_id").alias("def_id"), F.col("base_def_id").alias("ancestor_id"), F.lit(1).alias("depth"), F.array("ord").alias("route")), "lin")
    reach = 1
    while max_depth is None or reach < max_depth:
        far = found.filter(F.col("depth") == reach)
        if far.isEmpty():
            break
        onward = found.select(F.col("def_id").alias("ancestor_id"), F.col("ancestor_id").alias("_to"), F.col("depth").alias("_d"), F.col("route").alias("_r"))
        step = far.join(onward, "ancestor_id").filter("def_id <> _to").groupBy("def_id", F.col("_to").alias("ancestor_id")).agg(F.min(F.struct((F.col("depth") + F.col("_d")).alias("depth"), F.concat("route", "_r").alias("route"))).alias("_m"))
        step = step.join(found.select("def_id", "ancestor_id"), ["def_id", "ancestor_id"], "left_anti").select("def_id", "ancestor_id", "_m.depth", "_m.route")
        found = materialize(found.unionByName(step if max_depth is None else step.filter(F.col("depth") <= max_depth)), "lin")
        reach *= 2
    order = Window.partitionBy("def_id").orderBy("depth", "route", "ancestor_id")
    return found.select("def_id", "ancestor_id", F.row_number().over(order).alias("position"))


def override_edges(inherits: DataFrame, defs: DataFrame, kinds: Sequence[str] = ("function", "method", "modifier", "constructor")) -> DataFrame:
    """(child_def_id, base_def_id): members and the member of the closest ancestor with the
    same name and kind. Members are definitions scoped in the class (scope_id)."""
    members = defs.filter(F.col("kind").isin(*kinds) & F.col("scope_id").isNotNull()).select("def_id", "scope_id", "name", "kind").distinct()
    lines = linearize(inherits)
    child = members.select(F.col("def_id").alias("child_def_id"), F.col("scope_id").alias("def_id"), "name", "kind")
    base = members.select(F.col("def_id").alias("base_def_id"), F.col("scope_id").alias("ancestor_id"), "name", "kind")
    pairs = child.join(lines, "def_id").join(base, ["ancestor_id", "name", "kind"])
    return distinct_on(pairs, ["child_def_id"], [F.col("position"), F.col("base_def_id")]).select("child_def_id", "base_def_id")


# -- bounded neighbourhoods -------------------------------------------------------------


def neighborhood(nodes: DataFrame, edges: DataFrame, start: str, hops: int = 2, direction: str = "both", max_nodes: int = 200) -> tuple[DataFrame, DataFrame, bool]:
    """(nodes, edges among them, truncated) around a node. Each hop takes its new nodes in
    order of their keys until max_nodes are held; truncated says that some found no room.
    A start that is no node is an error."""
    if direction not in ("both", "out", "in"):
        raise ValueError("direction is both, out or in")
    if hops not in range(11) or max_nodes not in range(1, 5001):
        raise ValueError("hops go from 0 to 10, max_nodes from 1 to 5000")
    held = materialize(nodes.filter(F.col("node") == start).select("node").distinct(), "near")
    if held.isEmpty():
        raise ValueError(f"the graph has no node {start}")
    out = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    back = edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))
    steps = out.unionByName(back) if direction == "both" else out if direction == "out" else back
    frontier, room, truncated = held, max_nodes - 1, False
    for _ in range(hops):
        fresh = steps.join(frontier.withColumnRenamed("node", "a"), "a", "left_semi").select(F.col("b").alias("node")).distinct().join(held, "node", "left_anti").join(nodes.select("node"), "node", "left_semi")
        # one more than fits tells whether some are left out
        frontier = materialize(fresh.orderBy("node").limit(room + 1), "near-next")
        n = frontier.count()
        truncated = truncated or n > room
        if n == 0 or room == 0:
            break
        if n > room:
            frontier = materialize(frontier.orderBy("node").limit(room), "near-held")
        held, room = held.unionByName(frontier), room - min(n, room)
    inside = edges.join(held.withColumnRenamed("node", "src"), "src", "left_semi").join(held.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return held, inside, truncated
