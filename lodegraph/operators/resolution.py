"""Resolution within files: what names, calls and accesses of a source refer to.

Definitions are frames (key, def_id, kind, name, qualified_name, parent, start_byte), the
key being a file version and parent the qualified name of the enclosing definition, null
at the top. Occurrences are frames (occ_id, key, scope, name, form[, is_write]), scope
being the qualified name of the definition they stand in. A scope has few scopes around it,
so each is looked up by equality; no file is gathered in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.operators.graph import CONFIDENCE_WEIGHT

#: Forms of an occurrence: a plain name, a member of something, and any other.
PLAIN, MEMBER, OTHER = "plain", "member", "other"
#: Kinds whose accesses are recorded. Fixed values.
DATA_KINDS = ("variable", "var", "const", "static", "state_variable", "field")


def last_definitions(defs: DataFrame) -> DataFrame:
    """(key, parent, name, def_id): of definitions with one parent and name the last in the
    source; '' stands for no parent."""
    latest = defs.groupBy("key", F.coalesce("parent", F.lit("")).alias("parent"), "name").agg(F.max(F.struct("start_byte", "def_id")).alias("_l"))
    return latest.select("key", "parent", "name", F.col("_l.def_id").alias("def_id"))


def enclosing_definitions(occurrences: DataFrame, defs: DataFrame) -> DataFrame:
    """(occ_id, owner_def_id): the definition that each occurrence stands in; null at the top."""
    named = defs.groupBy("key", F.col("qualified_name").alias("scope")).agg(F.max(F.struct("start_byte", "def_id")).alias("_l"))
    return occurrences.join(named, ["key", "scope"], "left").select("occ_id", F.col("_l.def_id").alias("owner_def_id"))


def resolve_occurrences(occurrences: DataFrame, defs: DataFrame) -> DataFrame:
    """(occ_id, target_def_id, confidence) of every occurrence.

    A plain name means the definition of that name in the nearest scope around it, and is
    certain; a member means the only definition of its name in the file, and is inferred;
    what finds none, and other forms, are uncertain and have no target.
    """
    scope = F.coalesce("scope", F.lit(""))
    steps = F.split(scope, r"\.")
    around = F.concat(F.transform(F.sequence(F.size(steps), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), ".")), F.array(F.lit("")))
    plain = occurrences.filter(F.col("form") == PLAIN).select("occ_id", "key", "name", F.posexplode(F.array_distinct(around)).alias("_far", "parent"))
    near = plain.join(last_definitions(defs), ["key", "parent", "name"]).groupBy("occ_id").agg(F.min_by("def_id", "_far").alias("_certain"))
    single = defs.groupBy("key", "name").agg(F.min("def_id").alias("_inferred"), F.count_distinct("def_id").alias("_n")).filter("_n = 1").drop("_n")
    members = occurrences.filter(F.col("form") == MEMBER).join(single, ["key", "name"]).select("occ_id", "_inferred")
    out = occurrences.select("occ_id").join(near, "occ_id", "left").join(members, "occ_id", "left")
    confidence = F.when(F.col("_certain").isNotNull(), "certain").when(F.col("_inferred").isNotNull(), "inferred").otherwise("uncertain")
    return out.select("occ_id", F.coalesce("_certain", "_inferred").alias("target_def_id"), confidence.alias("confidence"))


def call_edges(calls: DataFrame, defs: DataFrame) -> DataFrame:
    """(occ_id, key, src, dst, callee_name, confidence): every call with its caller and what
    it calls. A callee of another form has no name."""
    named = calls.withColumn("name", F.when(F.col("form") != OTHER, F.col("name")))
    found = named.join(resolve_occurrences(calls, defs), "occ_id").join(enclosing_definitions(calls, defs), "occ_id")
    return found.select("occ_id", "key", F.col("owner_def_id").alias("src"), F.col("target_def_id").alias("dst"), F.col("name").alias("callee_name"), "confidence")


def reference_edges(references: DataFrame, defs: DataFrame) -> DataFrame:
    """(occ_id, key, name, target_def_id, resolution_confidence)."""
    weight = F.create_map(*[F.lit(x) for pair in CONFIDENCE_WEIGHT.items() for x in pair])
    found = references.select("occ_id", "key", "name").join(resolve_occurrences(references, defs), "occ_id")
    return found.select("occ_id", "key", "name", "target_def_id", weight[F.col("confidence")].alias("resolution_confidence"))


def data_accesses(references: DataFrame, defs: DataFrame, kinds: Sequence[str] = DATA_KINDS) -> DataFrame:
    """(accessor_def_id, target_def_id, access_type) of references to data that stand in a
    definition; a write where the reference is assigned to. Where a name is declared, it is
    not accessed. References and definitions have their start_byte."""
    declared = defs.filter(F.col("kind").isin(*kinds)).select("key", "start_byte", "name").distinct()
    references = references.join(declared, ["key", "start_byte", "name"], "left_anti")
    data = defs.filter(F.col("kind").isin(*kinds)).select(F.col("def_id").alias("target_def_id")).distinct()
    found = references.join(resolve_occurrences(references, defs), "occ_id").join(data, "target_def_id", "left_semi").join(enclosing_definitions(references, defs), "occ_id")
    kind = F.when(F.coalesce("is_write", F.lit(False)), "write").otherwise("read")
    return found.filter("owner_def_id IS NOT NULL AND owner_def_id <> target_def_id").select(F.col("owner_def_id").alias("accessor_def_id"), "target_def_id", kind.alias("access_type"))
