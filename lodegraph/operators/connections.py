"""Connections across repositories: sites, evidence, publication and components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.functions.fingerprints import row_fingerprint
from lodegraph.functions.spans import byte_slice, passages
from lodegraph.operators.frames import distinct_on
from lodegraph.operators.graph import neighborhood

#: Verbs of connections, with what their targets may be, and the spelling that stands for
#: another. Fixed values.
VERBS = {
    "INVOKES": ("site",),
    "DISPATCHES_TO": ("site",),
    "SPAWNS": ("site", "resource"),
    "PRODUCES": ("resource",),
    "CONSUMES": ("resource",),
    "READS": ("resource",),
    "WRITES": ("resource",),
    "PROVISIONS": ("resource",),
    "CONFIGURES": ("site", "resource"),
}
VERB_ALIASES = {"EMITS": "PRODUCES"}
MODES = ("100644", "100755", "120000", "160000")


def normalize_verb(verb: str | Column) -> Column:
    v = F.upper(F.trim(F.col(verb) if isinstance(verb, str) else verb))
    for alias, name in VERB_ALIASES.items():
        v = F.when(v == alias, name).otherwise(v)
    return v


def source_blobs(files: DataFrame) -> DataFrame:
    """(content_hash, content): each content of a snapshot once; submodules have none."""
    return files.filter(F.col("mode") != "160000").select(F.sha2("content", 256).alias("content_hash"), "content").dropDuplicates(["content_hash"])


def read_source(files: DataFrame, blobs: DataFrame) -> DataFrame:
    """Files of a snapshot with their contents, submodules left out."""
    return files.filter(F.col("mode") != "160000").drop("content").join(blobs, "content_hash")


def passage_sites(files: DataFrame, text: str, size: int = 1800, overlap: int = 200) -> DataFrame:
    """(keys, start_byte, end_byte, passage): overlapping windows of every text."""
    keys = [c for c in files.columns if c != text]
    return files.select(*keys, F.inline(passages(text, size, overlap)))


def component_membership(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """(node, repo_id, component): the component of the longest rule whose prefix is the
    node's path or a directory above it; without one, that of its repository.

    nodes: (node, repo_id, path); rules: (repo_id, prefix, component). A path has few
    prefixes, so each is looked up by equality.
    """
    parts = F.split("path", "/")
    prefixes = nodes.select("node", "repo_id", F.explode(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))).alias("prefix"))
    hit = distinct_on(prefixes.join(rules, ["repo_id", "prefix"]), ["node"], [F.length("prefix").desc(), F.col("component")]).select("node", "component")
    fallback = F.concat(F.lit("component:"), F.col("repo_id").cast("string"), F.lit(":repository"))
    return nodes.join(hit, "node", "left").select("node", "repo_id", F.coalesce("component", fallback).alias("component"))


def unused_rules(rules: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rules whose prefix holds no node."""
    parts = F.split("path", "/")
    held = nodes.select("repo_id", F.explode(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))).alias("prefix")).distinct()
    return rules.join(held, ["repo_id", "prefix"], "left_anti")


def component_edges(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """(source, target, verb, vocabulary_version, conditions, n_edges, decision_ids, edge_ids)
    between components. edges: (edge_id, source, target, verb, vocabulary_version,
    conditions, decision_id). Edges that differ in verb, version, direction or conditions
    stay apart; edges within a component are left out."""
    m = membership.select("node", "component")
    a = m.select(F.col("node").alias("source"), F.col("component").alias("_a"))
    b = m.select(F.col("node").alias("target"), F.col("component").alias("_b"))
    joined = edges.join(a, "source").join(b, "target").filter("_a <> _b")
    keys = [F.col("_a").alias("source"), F.col("_b").alias("target"), F.col("verb"), F.col("vocabulary_version"), F.col("conditions")]
    return joined.groupBy(*keys).agg(F.count("*").alias("n_edges"), F.array_sort(F.collect_set("decision_id")).alias("decision_ids"), F.array_sort(F.collect_set("edge_id")).alias("edge_ids"))


def component_sizes(membership: DataFrame) -> DataFrame:
    return membership.groupBy("component").agg(F.count("*").alias("member_count"))


def explain_component_edge(component_edge: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges that stand behind edges of components."""
    return edges.join(component_edge.select(F.explode("edge_ids").alias("edge_id")).distinct(), "edge_id", "left_semi")


def revision_of(edges: DataFrame) -> DataFrame:
    """(revision_id, n_edges): a content address of a graph, the same for any order of rows."""
    columns = sorted(edges.columns)
    hashed = edges.select(row_fingerprint(*columns).alias("h"))
    # sums of hash words are order-free and merge before the shuffle
    words = [F.sum(F.conv(F.substring("h", 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).alias(f"w{i}") for i in range(8)]
    summed = hashed.agg(F.count("*").alias("n_edges"), *words)
    return summed.select(F.sha2(F.concat_ws(":", "n_edges", *[f"w{i}" for i in range(8)]), 256).alias("revision_id"), "n_edges")


def publish(edges: DataFrame, root: str) -> str:
    """Write a graph under its revision and return the id; the same graph is written once.

    Rows carry the revision, so readers of the folder see whole revisions only.
    """
    spark = edges.sparkSession
    revision = revision_of(edges).collect()[0]["revision_id"]
    path = f"{root}/revision_id={revision}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path):
        edges.write.mode("overwrite").parquet(path)
    return revision


def read_graph(spark, root: str, revision: str) -> DataFrame:
    return spark.read.parquet(f"{root}/revision_id={revision}")


def reuse_reasons(dependencies: DataFrame, files: DataFrame) -> DataFrame:
    """(decision_id, reusable, reasons): whether what a decision depends on is unchanged.

    dependencies: (decision_id, repo_id, path, content_hash, mode), a null hash recording
    that the file was absent; files: the same columns of the present snapshot.
    """
    now = files.select("repo_id", "path", F.col("content_hash").alias("_hash"), F.col("mode").alias("_mode"), F.lit(True).alias("_there"))
    joined = dependencies.join(now, ["repo_id", "path"], "left")
    there, absent = F.col("_there").isNotNull(), F.col("content_hash").isNull()
    reason = (
        F.when(absent & there, "appeared").when(~absent & ~there, "disappeared").when(~absent & ~F.col("content_hash").eqNullSafe(F.col("_hash")), "content_changed").when(~absent & ~F.col("mode").eqNullSafe(F.col("_mode")), "mode_changed")
    )
    per = joined.withColumn("_reason", reason).groupBy("decision_id").agg(F.array_sort(F.collect_set("_reason")).alias("reasons"))
    return per.select("decision_id", (F.size("reasons") == 0).alias("reusable"), "reasons")


# -- rules that stored rows must keep: each result is empty where they do ---------------


def broken_spans(spans: DataFrame, blobs: DataFrame) -> DataFrame:
    """Spans (content_hash, start_byte, end_byte, excerpt) whose excerpt is not what the
    bytes say, or that lie outside their content."""
    both = spans.join(blobs.select("content_hash", F.col("content").cast("string").alias("_text"), F.octet_length("content").alias("_n")), "content_hash", "left")
    good = F.col("_n").isNotNull() & (F.col("start_byte") >= 0) & (F.col("start_byte") <= F.col("end_byte")) & (F.col("end_byte") <= F.col("_n"))
    return both.filter(~good | ~byte_slice("_text", "start_byte", "end_byte").eqNullSafe(F.col("excerpt"))).drop("_text", "_n")


def broken_hashes(blobs: DataFrame) -> DataFrame:
    return blobs.filter(~F.sha2("content", 256).eqNullSafe(F.col("content_hash")))


def broken_modes(files: DataFrame) -> DataFrame:
    return files.filter(~F.coalesce(F.col("mode").isin(*MODES), F.lit(False)))


def broken_connections(connections: DataFrame) -> DataFrame:
    """Connections without exactly one target, to their own site, or with a verb that is
    unknown or does not take such a target."""
    site, resource = F.col("target_site_id").isNotNull(), F.col("target_resource_id").isNotNull()
    verb = normalize_verb("verb")
    to_site = verb.isin(*[v for v, kinds in VERBS.items() if "site" in kinds])
    to_resource = verb.isin(*[v for v, kinds in VERBS.items() if "resource" in kinds])
    good = (site & ~resource & to_site & ~F.coalesce(F.col("source_site_id") == F.col("target_site_id"), F.lit(False))) | (resource & ~site & to_resource)
    return connections.filter(~F.coalesce(good, F.lit(False)))


def broken_decisions(connections: DataFrame, decisions: DataFrame, evidence: DataFrame) -> DataFrame:
    """(decision_id): decisions that have connections but were not supported, or without a
    piece of supporting evidence. decisions: (decision_id, outcome, …); evidence:
    (decision_id, evidence_id, role)."""
    used = connections.select("decision_id").distinct()
    good = decisions.filter("outcome = 'supported'").select("decision_id").join(evidence.filter("role = 'support'").select("decision_id").distinct(), "decision_id", "left_semi")
    return used.join(good, "decision_id", "left_anti")


def broken_endpoints(connections: DataFrame, decisions: DataFrame, candidates: DataFrame) -> DataFrame:
    """Connections with an end that is not one of the two sites of their decision's candidate,
    or whose decision or candidate is unknown. candidates: (candidate_id, source_site_id,
    target_site_id)."""
    of = decisions.select("decision_id", "candidate_id").join(candidates.select("candidate_id", F.col("source_site_id").alias("_a"), F.col("target_site_id").alias("_b")), "candidate_id")
    both = connections.join(of.select("decision_id", "_a", "_b"), "decision_id", "left")
    within = lambda c: (F.col(c) == F.col("_a")) | (F.col(c) == F.col("_b"))
    good = within("source_site_id") & (F.col("target_site_id").isNull() | within("target_site_id"))
    return both.filter(~F.coalesce(good, F.lit(False))).drop("_a", "_b")


def lonely_resources(connections: DataFrame) -> DataFrame:
    """(decision_id, target_resource_id, n): shared resources that not just two sites of a
    decision take part in."""
    shared = connections.filter("target_resource_id IS NOT NULL").groupBy("decision_id", "target_resource_id")
    return shared.agg(F.count_distinct("source_site_id").alias("n")).filter("n <> 2")


def broken_members(snapshots: DataFrame, members: DataFrame) -> DataFrame:
    """(snapshot_id, reason) of sealed snapshots (snapshot_id, sealed_at) that hold fewer than
    two repositories, or a revision (snapshot_id, repo_id, revision) that is no object id of
    40 or 64 hexadecimal digits."""
    sealed = snapshots.filter("sealed_at IS NOT NULL").select("snapshot_id")
    held = sealed.join(members, "snapshot_id", "left")
    per = held.groupBy("snapshot_id").agg(F.count_distinct("repo_id").alias("_n"), F.count_if(F.col("repo_id").isNotNull() & ~F.coalesce(F.col("revision").rlike("^(?:[0-9a-f]{40}|[0-9a-f]{64})$"), F.lit(False))).alias("_bad"))
    reasons = F.array_compact(F.array(F.when(F.col("_n") < 2, "repositories"), F.when(F.col("_bad") > 0, "revision")))
    return per.select("snapshot_id", F.explode(reasons).alias("reason"))


def changed_after_seal(before: DataFrame, after: DataFrame, key: str = "snapshot_id") -> DataFrame:
    """Rows of sealed snapshots that were altered or taken out: sealed rows of `before` that
    are not in `after` as they were."""
    return before.filter("sealed_at IS NOT NULL").exceptAll(after.select(*before.columns)).select(key).distinct()


def missing_blobs(files: DataFrame, blobs: DataFrame) -> DataFrame:
    """Files of a snapshot, submodules aside, whose content is not stored."""
    return files.filter("mode <> '160000'").join(blobs.select("content_hash").distinct(), "content_hash", "left_anti")


def unmatched_sources(matches: DataFrame, sets: DataFrame) -> DataFrame:
    """(run_id, source_site_id, n_listed, n_found): candidate sets whose count is not that of
    their matches, either side counting where the other has none."""
    found = matches.groupBy("run_id", "source_site_id").agg(F.count("*").alias("n_found"))
    both = sets.select("run_id", "source_site_id", F.col("candidate_count").alias("n_listed")).join(found, ["run_id", "source_site_id"], "full")
    return both.select("run_id", "source_site_id", F.coalesce("n_listed", F.lit(0)).alias("n_listed"), F.coalesce("n_found", F.lit(0)).alias("n_found")).filter("n_listed <> n_found")


def run_totals(sets: DataFrame) -> DataFrame:
    """(run_id, n_sources, n_candidates): how much each retrieval run holds; none is 0."""
    return sets.groupBy("run_id").agg(F.count("source_site_id").alias("n_sources"), F.coalesce(F.sum("candidate_count"), F.lit(0)).cast("long").alias("n_candidates"))


# -- links of a parser, and drift ----------------------------------------------------------

_PLACE = ["repo_id", "path", "content_hash", "start_byte", "end_byte", "kind"]


def parser_links(calls: DataFrame, sites: DataFrame) -> DataFrame:
    """(source, target, verb, confidence, edge_id): resolved calls as edges between places of
    a snapshot: CALLS from the call to what it calls, HAS_CALL from the caller to the call.

    calls: (edge_id, confidence) and, for each of call, caller and callee, a struct of
    repo_id, path, content_hash, start_byte, end_byte; a caller may be null. A place that is
    a site (site_id and the place) is named by it, another by its fingerprint.
    """
    kinds = {"call": "call", "caller": "definition", "callee": "definition"}
    out = calls
    for end, kind in kinds.items():
        place = [F.col(f"{end}.{c}").alias(f"_{c}") for c in _PLACE[:-1]]
        spots = calls.select("edge_id", *place, F.lit(kind).alias("_kind")).filter("_path IS NOT NULL")
        known = sites.groupBy(*_PLACE).agg(F.min("site_id").alias("_site")).select(*[F.col(c).alias(f"_{c}") for c in _PLACE], "_site")
        named = spots.join(known, [f"_{c}" for c in _PLACE], "left")
        name = F.coalesce(F.col("_site").cast("string"), F.concat(F.lit("place:"), F.sha2(F.to_json(F.struct(*[f"_{c}" for c in _PLACE])), 256)))
        out = out.join(named.select("edge_id", name.alias(f"_{end}_node")), "edge_id", "left")
    edges = out.filter("_call_node IS NOT NULL AND _callee_node IS NOT NULL")
    made = edges.select(F.col("_call_node").alias("source"), F.col("_callee_node").alias("target"), F.lit("CALLS").alias("verb"), "confidence", "edge_id")
    held = edges.filter("_caller_node IS NOT NULL").select(F.col("_caller_node").alias("source"), F.col("_call_node").alias("target"), F.lit("HAS_CALL").alias("verb"), "confidence", "edge_id")
    return made.unionByName(held)


def drifted_files(branch: DataFrame, snapshot: DataFrame) -> DataFrame:
    """(repo_id, path): files of a branch whose content is not that of the snapshot, or which
    it does not hold. Both: (repo_id, path, content_hash)."""
    there = snapshot.select("repo_id", "path", F.col("content_hash").alias("_hash"))
    return branch.join(there, ["repo_id", "path"], "left").filter(~F.col("content_hash").eqNullSafe(F.col("_hash"))).select("repo_id", "path").distinct()


def component_neighborhood(membership: DataFrame, edges: DataFrame, start: str, hops: int = 1, direction: str = "both", max_nodes: int = 200) -> tuple[DataFrame, DataFrame, bool]:
    """The neighbourhood of a component over the edges between components."""
    nodes = membership.select(F.col("component").alias("node")).distinct()
    named = edges.select(F.col("source").alias("src"), F.col("target").alias("dst"), *[c for c in edges.columns if c not in ("source", "target")])
    return neighborhood(nodes, named, start, hops, direction, max_nodes)


def activate(spark, root: str, snapshot_id: str, revision: str) -> None:
    """Make a published revision the active graph of a snapshot; the latest activation counts."""
    row = spark.createDataFrame([(snapshot_id, revision)], "snapshot_id string, revision_id string").withColumn("activated_at", F.current_timestamp())
    row.coalesce(1).write.mode("append").parquet(f"{root}/active")


def active_graph(spark, root: str, snapshot_id: str) -> DataFrame:
    """The active graph of a snapshot; an error where it has none."""
    last = spark.read.parquet(f"{root}/active").filter(F.col("snapshot_id") == snapshot_id).agg(F.max(F.struct("activated_at", "revision_id")).alias("_l")).first()["_l"]
    if last is None:
        raise ValueError(f"snapshot {snapshot_id} has no active graph")
    return read_graph(spark, root, last["revision_id"])
