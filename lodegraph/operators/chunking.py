"""Chunks of definitions within token budgets."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.storage import materialize

#: Budgets and caps in tokens, and the most dependencies that metadata lists. Fixed values.
BUDGETS = {"function": 512, "module": 1024, "cross_module": 2048}
CAPS = {"function": 4000, "module": 6000, "cross_module": 8000}
HARD_FACTOR, MAX_DEPENDENCIES = 1.5, 50


#: A token of the offline count, in the JVM and in Python: a word or a single mark.
WORDS = r"(?U)\w+|[^\w\s]"


def count_words(text: str) -> int:
    """Offline token count: words and single marks."""
    return len(re.findall(WORDS[4:], text))


def pack_pieces(base: int, slots: Sequence[Sequence[str]], budget: int, count: Callable[[str], int] = count_words) -> list[str]:
    """Of every slot the first alternative that still fits; slots that don't fit are passed
    over and packing goes on. A piece costs one token more for the join."""
    used, out = base, []
    for alternatives in slots:
        for piece in alternatives:
            cost = count(piece) + 1
            if used + cost <= budget:
                used += cost
                out.append(piece)
                break
    return out


def pack_section(base: int, header: str, candidates: Sequence[str], budget: int, count: Callable[[str], int] = count_words) -> list[str]:
    """The header and candidates up to the first that does not fit; nothing without one. The
    join of header and first candidate costs nothing, every other join a token."""
    used = base + count(header) + 1
    out: list[str] = []
    for piece in candidates:
        used += count(piece) + (1 if out else 0)
        if used > budget:
            break
        out.append(piece)
    return [header, *out] if out else []


def pack_prefix(pieces: DataFrame, group: str, order: list, size: str, budget: int) -> DataFrame:
    """Relational form of pack_section, without a header: the pieces of each group before its
    first overflow. Sizes are not negative."""
    running = F.sum(F.col(size) + 1).over(Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return pieces.withColumn("_used", running - 1).filter(F.col("_used") <= budget).drop("_used")


def cap_dependencies(column: str) -> tuple:
    """(first dependencies, number left out) of an array column."""
    return F.slice(column, 1, MAX_DEPENDENCIES), F.greatest(F.size(column) - MAX_DEPENDENCIES, F.lit(0))


def degrade(header: str, body: str, extras: Sequence[str], cap: int, count: Callable[[str], int] = count_words) -> tuple[str, str]:
    """(text, level) within a cap: whole, without extras, or the header alone as a stub."""
    whole = "\n\n".join([header, body, *extras])
    if count(whole) <= cap:
        return whole, "whole"
    bare = f"{header}\n\n{body}"
    if count(bare) <= cap:
        return bare, "bare"
    return header, "stub"


def assemble_function_chunks(anchors: DataFrame, parts: DataFrame, budget: int = BUDGETS["function"], hard: float = HARD_FACTOR, cap: int = CAPS["function"]) -> DataFrame:
    """(anchor_def_id, content, token_count, content_hash, level) for each definition.

    anchors: (anchor_def_id, header, body); parts: (anchor_def_id, priority, position,
    texts), alternatives from long to short.

    A part that doesn't fit is passed over, and so is then every later part with the same
    costs; of parts with the same costs no more than fit by themselves are ever taken. Only
    so many are gathered, which changes nothing and bounds what a definition gathers.
    """
    limit = int(budget * hard)
    costs = F.transform("texts", lambda t: F.least(F.regexp_count(t, F.lit(WORDS)) + 1, F.lit(limit + 1)))
    sized = parts.withColumn("_costs", costs).withColumn("_least", F.array_min("_costs")).filter(F.col("_least") <= limit)
    same = Window.partitionBy("anchor_def_id", "_costs").orderBy("priority", "position")
    first = sized.withColumn("_n", F.row_number().over(same)).filter(F.col("_n") * F.col("_least") <= limit)
    gathered = first.groupBy("anchor_def_id").agg(F.array_sort(F.collect_list(F.struct("priority", "position", "texts"))).alias("parts"))

    def build(batches):
        import hashlib

        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                header, body = r.header or "", r.body or ""
                base = count_words(header) + count_words(body)
                room = budget if base <= budget else limit
                extras = pack_pieces(base, [list(p["texts"]) for p in r.parts] if r.parts is not None else [], room)
                text, level = degrade(header, body, extras, cap)
                rows.append((r.anchor_def_id, text, count_words(text), hashlib.sha256(text.encode()).hexdigest(), level))
            yield pd.DataFrame(rows, columns=["anchor_def_id", "content", "token_count", "content_hash", "level"])

    both = anchors.join(gathered, "anchor_def_id", "left")
    kind = dict(anchors.dtypes)["anchor_def_id"]
    return both.mapInPandas(build, f"anchor_def_id {kind}, content string, token_count long, content_hash string, level string")


def two_hop_callees(calls: DataFrame) -> DataFrame:
    """(src, dst, hop): callees of callees that are not callees themselves are at hop 2."""
    one = calls.filter("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct()
    two = one.join(one.select(F.col("src").alias("dst"), F.col("dst").alias("_to")), "dst").select("src", F.col("_to").alias("dst")).distinct()
    two = two.filter("src <> dst").join(one, ["src", "dst"], "left_anti")
    return one.withColumn("hop", F.lit(1)).unionByName(two.withColumn("hop", F.lit(2)))


def inherited_members(linearized: DataFrame, members: DataFrame) -> DataFrame:
    """(def_id, name, member_def_id): of each name the member of the closest ancestor, but
    for names that the definition has itself. members: (scope_id, name, def_id)."""
    m = members.select(F.col("scope_id").alias("ancestor_id"), "name", F.col("def_id").alias("member_def_id"))
    reach = linearized.join(m, "ancestor_id").groupBy("def_id", "name").agg(F.min(F.struct("position", "member_def_id")).alias("_m"))
    own = members.select(F.col("scope_id").alias("def_id"), "name").distinct()
    return reach.join(own, ["def_id", "name"], "left_anti").select("def_id", "name", F.col("_m.member_def_id").alias("member_def_id"))


# -- chunks of modules and across modules --------------------------------------------------


def assemble_module_chunks(modules: DataFrame, children: DataFrame, imports: DataFrame, budget: int = BUDGETS["module"], cap: int = CAPS["module"]) -> DataFrame:
    """(anchor_def_id, content, token_count, content_hash, level) for each module: what it
    imports by class, then of each child the body, the signature where that is all that
    fits, or nothing.

    modules: (anchor_def_id, file_version_id, qualified_name, file_path); children:
    (anchor_def_id, position, body, signature); imports: (file_version_id, dep_class,
    import_path, package_name).
    """
    named = F.when(F.col("dep_class") == "external", F.coalesce("package_name", "import_path")).otherwise(F.col("import_path"))
    listed = imports.groupBy("file_version_id", "dep_class").agg(F.array_join(F.array_sort(F.collect_set(named)), ", ").alias("_names"))
    order = F.when(F.col("dep_class") == "intra_repo", 0).when(F.col("dep_class") == "external", 1).otherwise(2)
    lines = listed.groupBy("file_version_id").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.concat_ws(": ", "dep_class", "_names").alias("line")))).alias("_l"))
    headed = modules.join(lines, "file_version_id", "left")
    title = F.concat(F.lit("# module: "), "qualified_name", F.lit(" ("), "file_path", F.lit(")"))
    block = F.concat(F.lit("# imports\n"), F.array_join(F.transform("_l", lambda x: x["line"]), "\n"))
    anchors = headed.select("anchor_def_id", F.coalesce(block, F.lit("")).alias("header"), title.alias("body"))
    parts = children.select("anchor_def_id", F.lit(0).alias("priority"), "position", F.array("body", "signature").alias("texts"))
    return assemble_function_chunks(anchors, parts, budget, 1.0, cap)


def assemble_cross_module_chunks(anchors: DataFrame, calls: DataFrame, accesses: DataFrame, defs: DataFrame, budget: int = BUDGETS["cross_module"], cap: int = CAPS["cross_module"]) -> DataFrame:
    """(anchor_def_id, content, token_count, content_hash, level) for each anchor that calls
    something: its first line, the data that it and its callees share, bodies of callees one
    hop away, then signatures of those two hops away, each section up to its first overflow.

    anchors: (anchor_def_id); calls: (src, dst); accesses: (accessor_def_id, target_def_id,
    access_type); defs: (def_id, qualified_name, kind, body, signature). A section is cut by
    a running sum in the JVM before it is gathered.
    """
    one = defs.select(F.col("def_id").alias("dst"), F.col("qualified_name").alias("_q"), "body", "signature")
    start = anchors.select(F.col("anchor_def_id").alias("src")).distinct()
    near = calls.filter("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").select("src", "dst").distinct()
    hop1 = near.join(start, "src", "left_semi")
    hop2 = hop1.join(near.select(F.col("src").alias("dst"), F.col("dst").alias("_to")), "dst").select("src", F.col("_to").alias("dst")).distinct().filter("src <> dst").join(hop1, ["src", "dst"], "left_anti")
    reached = start.select("src", F.col("src").alias("dst")).unionByName(hop1).unionByName(hop2)
    touched = reached.join(accesses.select(F.col("accessor_def_id").alias("dst"), "target_def_id", "access_type"), "dst").groupBy("src", "target_def_id").agg(F.max("access_type").alias("op"))
    state = touched.join(defs.select(F.col("def_id").alias("target_def_id"), "qualified_name"), "target_def_id").select("src", "qualified_name", F.concat(F.lit("- "), "op", F.lit(": "), "qualified_name").alias("text"))
    tokens = lambda c: F.regexp_count(c, F.lit(WORDS))

    def section(pieces: DataFrame, header: str, order: list, room: DataFrame, joint: str) -> DataFrame:
        sized = pieces.withColumn("_size", tokens(F.col("text")))
        running = F.sum(F.col("_size") + 1).over(Window.partitionBy("src").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - 1
        fits = sized.withColumn("_used", running + F.lit(count_words(header) + 1)).join(room, "src").filter(F.col("_used") <= F.col("room"))
        texts = F.array_sort(F.collect_list(F.struct(*order, "text")))
        return fits.groupBy("src").agg(texts.alias("_t"), F.max("_used").alias("_used")).select("src", F.concat(F.lit(header + "\n"), F.array_join(F.transform("_t", lambda x: x["text"]), joint)).alias("block"), "_used")

    own = start.join(defs.select(F.col("def_id").alias("src"), F.concat(F.lit("# anchor: "), "qualified_name", F.lit(" ["), "kind", F.lit("]\n"), F.regexp_extract("body", r"^[^\r\n]*", 0)).alias("_head")), "src").join(hop1.select("src").distinct(), "src", "left_semi")
    base = own.select("src", (F.lit(budget) - tokens(F.col("_head"))).alias("room"))
    blocks = own
    plan = [
        (state, "# shared state", ["qualified_name"], "\n"),
        (hop1.join(one, "dst").select("src", "_q", F.concat(F.lit("# callee (1 hop): "), "_q", F.lit("\n"), "body").alias("text")), "# callees (1 hop)", ["_q"], "\n\n"),
        (hop2.join(one, "dst").select("src", "_q", F.col("signature").alias("text")), "# callees (2 hop)", ["_q"], "\n\n"),
    ]
    for n, (pieces, header, order, joint) in enumerate(plan):
        made = materialize(section(pieces, header, order, base, joint), "chunk-section")
        base = base.join(made.select("src", "_used"), "src", "left").select("src", (F.col("room") - F.coalesce("_used", F.lit(0))).alias("room"))
        blocks = blocks.join(made.select("src", F.col("block").alias(f"_b{n}")), "src", "left")
    extras = F.array_compact(F.array("_b0", "_b1", "_b2"))
    texts = blocks.select(F.col("src").alias("anchor_def_id"), F.concat_ws("\n\n", "_head", extras).alias("_whole"), "_head")
    level = F.when(tokens(F.col("_whole")) <= cap, "whole").otherwise("stub")
    content = F.when(level == "whole", F.col("_whole")).otherwise(F.col("_head"))
    return texts.select("anchor_def_id", content.alias("content"), tokens(content).cast("long").alias("token_count"), F.sha2(content, 256).alias("content_hash"), level.alias("level"))
