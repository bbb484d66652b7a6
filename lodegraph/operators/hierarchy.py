"""Parent-child rows to full hierarchies.

Trees: deterministic hash splitters cut every root path into short walks. Each node
walks to its next splitter or root, the reduced graph of splitters is solved, and the
two parts are joined to exact paths. Walks double their reach each round, so the
number of rounds is logarithmic in the gap between splitters and in the depth of the
reduced graph; every round is one equi-join on written tables. Cycles without a
splitter show as walks that meet a node twice, cycles with one in the reduced graph.

Where only root and depth are asked for, a jump carries its path as long as it is short
and not at its end; longer ones on cycles show by the number of steps they cover.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.operators.cycles import cycle_members  # noqa: F401
from lodegraph.storage import materialize

SPLIT_EVERY = 8
#: Nodes of a path that jumps carry where paths are not asked for.
SHORT_PATH = 64


def latest_rows(df: DataFrame, key: str, version: str, columns: list[str]) -> DataFrame:
    """One row for each key: the one with the greatest version; of equal versions the
    one with the greatest values. Rows without a key are left out."""
    newest = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(version, *columns)).alias("_row"))
    return newest.select(key, *[F.col(f"_row.{c}").alias(c) for c in columns])


def _leap(jumps: DataFrame, tag: str, paths: bool) -> DataFrame:
    """Double the jumps (id, target, steps, path, done) until every one of them is done.

    A jump of r rounds covers 2**r steps. A path that meets a node twice belongs to a
    node on or below a cycle; it is taken out, and so, having no target any more, is
    every jump that leads to it. Hence each round ends some jumps or doubles the rest.
    Without `paths`, jumps that are done have none, and neither do long ones; the nodes
    that an open jump to a root has yet to pass are all open, so once a jump covers as many
    steps more as were open at any round, what is still open is taken out.
    """
    current, reach, limit = materialize(jumps, tag), 1, None
    while True:
        still = current.filter(~F.col("done"))
        n = still.count()
        if n == 0:
            return current
        if not paths:
            limit = reach + n if limit is None else min(limit, reach + n)
            if reach >= limit:
                return current.filter("done")
        step = current.select(
            F.col("id").alias("target"), F.col("target").alias("_t"), F.col("steps").alias("_s"), F.col("path").alias("_p"), F.col("done").alias("_d")
        )
        path = F.concat("path", "_p")
        kept = path if paths else F.when(~F.col("_d") & (F.size(path) <= SHORT_PATH), path)
        longer = still.join(step, "target").select(
            "id", F.col("_t").alias("target"), (F.col("steps") + F.col("_s")).alias("steps"), kept.alias("path"), F.col("_d").alias("done")
        )
        longer = longer.filter(F.col("path").isNull() | (F.size(F.array_distinct("path")) == F.size("path")))
        current = materialize(current.filter("done").unionByName(longer), tag)
        reach *= 2


def resolve_hierarchy(nodes: DataFrame, id_col: str, parent_col: str, name_col: str | None, split_every: int = SPLIT_EVERY, paths: bool = True) -> DataFrame:
    """Root, depth and path of every node.

    Returns (id, parent_id, root_id, depth, ancestors, path, cyclic): `ancestors` runs
    from the root to the parent, `path` holds the names from the root to the node
    joined by a dot. A node whose parent is null or in no row is a root. Nodes on or
    below a cycle have root_id and depth -1, cyclic true and null paths. Ids are unique
    (see latest_rows); null ids are left out; a null name counts as empty. Without a
    name_col there is no path column. With paths false, ancestors are null and not gathered
    on the way; there is no path column then either.
    """
    if not paths and name_col:
        raise ValueError("paths of names need the paths of ids")
    table = nodes.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(parent_col).alias("parent"), (F.coalesce(F.col(name_col).cast("string"), F.lit("")) if name_col else F.lit(None).cast("string")).alias("name")
    )
    table = materialize(table, "hier-nodes")
    known = table.select(F.col("id").alias("parent"), F.lit(True).alias("_known"))
    linked = table.join(known, "parent", "left").select("id", F.when(F.col("_known"), F.col("parent")).alias("parent"), "name")
    linked = materialize(linked, "hier-linked")

    terminal = lambda c: F.pmod(F.xxhash64(c), F.lit(split_every)) == 0
    roots = linked.filter("parent IS NULL").select("id")
    # a walk ends at a splitter or at a root; the root itself walks nowhere
    inner = linked.filter("parent IS NOT NULL")
    ends = inner.join(roots.select(F.col("id").alias("parent"), F.lit(True).alias("_root")), "parent", "left")
    jumps = ends.select(
        "id",
        F.col("parent").alias("target"),
        F.lit(1).cast("long").alias("steps"),
        F.array("parent").alias("path"),
        (terminal(F.col("parent")) | F.coalesce("_root", F.lit(False))).alias("done"),
    )
    walked = _leap(jumps, "hier-walk", paths)

    # the reduced graph: every splitter leads to its own end, a splitter or a root
    splitters = walked.filter(terminal(F.col("id")))
    reduced = splitters.join(roots.select(F.col("id").alias("target"), F.lit(True).alias("_root")), "target", "left").select(
        "id", "target", "steps", ("path" if paths else F.array("target").alias("path")), F.coalesce("_root", F.lit(False)).alias("done")
    )
    solved = _leap(reduced, "hier-reduced", paths)

    no_path = F.expr("cast(array() as array<bigint>)")
    ends = solved.select(F.col("id").alias("target"), F.col("target").alias("root_id"), F.col("steps").alias("_s"), F.col("path").alias("_p"))
    ends = ends.unionByName(roots.select(F.col("id").alias("target"), F.col("id").alias("root_id"), F.lit(0).cast("long").alias("_s"), no_path.alias("_p")))
    full = walked.join(ends, "target").select("id", "root_id", (F.col("steps") + F.col("_s")).alias("depth"), (F.reverse(F.concat("path", "_p")) if paths else F.lit(None).cast("array<bigint>")).alias("ancestors"))
    full = full.unionByName(roots.select("id", F.col("id").alias("root_id"), F.lit(0).cast("long").alias("depth"), (no_path if paths else F.lit(None).cast("array<bigint>")).alias("ancestors")))
    full = materialize(full, "hier-full")
    out = linked.join(full, "id", "left")
    columns = [
        "id",
        F.col("parent").alias("parent_id"),
        F.coalesce("root_id", F.lit(-1)).cast("long").alias("root_id"),
        F.coalesce("depth", F.lit(-1)).cast("long").alias("depth"),
        "ancestors",
        F.col("depth").isNull().alias("cyclic"),
    ]
    if not name_col:
        return out.select(*columns)
    path = F.when(F.col("depth") > 0, F.concat_ws(".", "_names", "name")).when(F.col("depth") == 0, F.col("name"))
    return out.join(_names_of_paths(full, linked), "id", "left").select(*columns, path.alias("path"))


def _names_of_paths(full: DataFrame, linked: DataFrame) -> DataFrame:
    """(id, _names): names of the ancestors, from the root down, joined by a dot."""
    steps = full.select("id", F.posexplode("ancestors").alias("_at", "_anc"))
    named = steps.join(linked.select(F.col("id").alias("_anc"), "name"), "_anc")
    gathered = named.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("_at", "name"))).alias("_list"))
    return gathered.select("id", F.array_join(F.transform("_list", lambda s: s["name"]), ".").alias("_names"))


def descendants(resolved: DataFrame) -> DataFrame:
    """(ancestor_id, descendant_id, distance) for every pair of a tree, from the exact paths."""
    pairs = resolved.filter("NOT cyclic").select(F.col("id").alias("descendant_id"), "depth", F.posexplode("ancestors").alias("_at", "ancestor_id"))
    return pairs.select("ancestor_id", "descendant_id", (F.col("depth") - F.col("_at")).cast("long").alias("distance"))
