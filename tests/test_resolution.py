from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodegraph.operators import resolution as R
from lodegraph.sources import repository
from lodegraph.sources.scanner import scan
from tests.conftest import rows

PYTHON = """LIMIT = 3
def helper(x):
    return x
class A:
    size = 1
    def run(self):
        helper(LIMIT)
        self.step()
        missing()
        (lambda: 1)()
    def step(self):
        global LIMIT
        LIMIT = 4
        def helper(y):
            return y
        return helper(self.size)
"""


@pytest.fixture
def resolved(spark):
    files = spark.createDataFrame([(1, PYTHON), (2, "def helper(): pass\nhelper()\n"), (3, None), (4, "")], "key long, content string")
    occ = repository.extract(files, "occurrences").withColumn("occ_id", F.xxhash64("key", "start_byte", "name", "is_write", "is_call"))
    defs = repository.extract(files, "definitions").withColumn("def_id", F.xxhash64("key", "qualified_name", "start_byte"))
    return occ, defs


def test_calls_follow_the_scopes(resolved):
    occ, defs = resolved
    name = {r.def_id: (r.key, r.qualified_name) for r in defs.collect()}
    got = sorted(((name.get(r.src), r.callee_name, name.get(r.dst), r.confidence) for r in R.call_edges(occ.filter("is_call"), defs).filter("key = 1").collect()), key=repr)
    run, step = (1, "A.run"), (1, "A.step")
    assert got == sorted([(run, "helper", (1, "helper"), "certain"), (run, "step", (1, "A.step"), "inferred"), (run, "missing", None, "uncertain"), (run, None, None, "uncertain"), (step, "helper", (1, "A.step.helper"), "certain")], key=repr)
    other = R.call_edges(occ.filter("is_call"), defs).filter("key = 2").first()
    assert other.src is None and name[other.dst] == (2, "helper")


def test_references_and_accesses(resolved):
    occ, defs = resolved
    name = {r.def_id: r.qualified_name for r in defs.collect()}
    refs = R.reference_edges(occ.filter("NOT is_call AND name IS NOT NULL"), defs)
    assert {(r.name, name.get(r.target_def_id), r.resolution_confidence) for r in refs.filter("key = 1").collect()} >= {("LIMIT", "LIMIT", 1.0), ("size", "A.size", 0.7), ("self", None, 0.4)}
    got = {(name[r.accessor_def_id], name[r.target_def_id], r.access_type) for r in R.data_accesses(occ.filter("NOT is_call"), defs).collect()}
    assert got == {("A.run", "LIMIT", "read"), ("A.step", "LIMIT", "write"), ("A.step", "A.size", "read")}


def test_nothing_to_resolve(resolved):
    occ, defs = resolved
    assert R.call_edges(occ.limit(0), defs).count() == 0 and R.data_accesses(occ, defs.limit(0)).count() == 0
    assert rows(R.resolve_occurrences(occ, defs.limit(0)), "confidence") == [("uncertain",)] * occ.count()


def test_occurrences_of_brace_languages():
    code = "const base = 1;\nfunction run(a) {\n  base2 = base + a.size;\n  return help(a.b());\n}\n"
    got = [(scope, name, form, written, called) for scope, name, form, written, called, _ in scan(code, "javascript", True)["occurrences"]]
    assert ("run", "base2", "plain", True, False) in got and ("run", "base", "plain", False, False) in got and ("run", "size", "member", False, False) in got
    assert ("run", "help", "plain", False, True) in got and ("run", "b", "member", False, True) in got and not [x for x in got if x[1] in ("run", "const", "return")]
