from __future__ import annotations

import pytest

from lodegraph.sources.repository import extract
from lodegraph.sources.scanner import LANGUAGES, blank, flatten_use, scan
from tests.conftest import rows

GO = """package a

import (
\t"fmt"
\tx "net/http"
)

type Store struct { mu int }

// func ghost() {}
func (s *Store) Put(k string) bool {
\tfmt.Println("func no() {")
\treturn helper(k)
}

func helper(k string) bool { return é() }
const Limit = 3
"""
RUST = """use std::{fmt, collections::HashMap as Map};
pub struct S<'a> { x: &'a str }
impl<'a> Show for S<'a> {
    pub fn show(&self) -> String { format!("{}", '{'); inner(self.x) }
}
mod tests { fn t() {} }
fn inner(x: &str) -> String { r#"fn fake() {"#.into() }
"""
TS = """import { A, type B } from "./a";
export class C<T> extends Base<T> implements P, Q {
  private readonly x: string[] = [];
  constructor(private y: number) { super(); }
  async run(z: string): Promise<void> { helper(z); this.x.push(`class ${z} {`); if (z) { return; } }
}
export interface I extends J { m(): void }
type K = string;
export enum E { A }
export function helper(a) { return a; }
const top = 1;
"""
SOL = """import "./B.sol";
contract A is B, C(1) {
    uint256 public constant LIMIT = 5;
    mapping(address => uint) internal m;
    modifier only() { _; }
    event Changed(address who);
    constructor() { }
    function put(uint v) external only returns (bool) { emit Changed(msg.sender); return get(v); }
    function get(uint v) internal pure returns (bool) { return v > 0; }
}
interface I { function z() external; }
"""


def named(text, language):
    return {(d[0], d[2]) for d in scan(text, language)["definitions"]}


def test_go():
    assert named(GO, "go") == {("type", "Store"), ("method", "Store.Put"), ("function", "helper"), ("const", "Limit")}
    got = scan(GO, "go")
    assert got["imports"] == [("fmt", []), ("net/http", [])]
    assert ("Store.Put", "Println", "inferred") in got["calls"] and ("Store.Put", "helper", "certain") in got["calls"] and ("helper", "é", "uncertain") not in got["calls"]
    d = {x[1]: GO.encode()[x[4] : x[5]].decode() for x in got["definitions"]}
    assert d["Put"].endswith("helper(k)\n}") and d["helper"].endswith("é() }")


def test_rust():
    assert named(RUST, "rust") == {("type", "S"), ("method", "S.show"), ("module", "tests"), ("function", "tests.t"), ("function", "inner")}
    got = scan(RUST, "rust")
    assert got["bases"] == [("S", "Show", 1)]
    assert got["imports"] == [("std::fmt", ["fmt"]), ("std::collections::HashMap", ["HashMap"])]
    assert ("S.show", "inner", "certain") in got["calls"]
    assert flatten_use("a::{b::{c, d}, self}") == [("a::b::c", ["c"]), ("a::b::d", ["d"]), ("a::self", ["self"])]


def test_typescript():
    assert named(TS, "typescript") == {("class", "C"), ("method", "C.constructor"), ("method", "C.run"), ("interface", "I"), ("type", "K"), ("enum", "E"), ("function", "helper"), ("variable", "top")}
    got = scan(TS, "typescript")
    assert got["bases"] == [("C", "Base", 0), ("C", "P", 1), ("C", "Q", 2), ("I", "J", 0)]
    assert got["imports"] == [("./a", ["A", "B"])]
    assert ("C.run", "helper", "certain") in got["calls"] and ("C.run", "push", "inferred") in got["calls"]


def test_javascript():
    text = "const a = require('x');\nclass A { m() {} }\nfunction f() { const inner = 1; g(); }\n"
    assert named(text, "javascript") == {("variable", "a"), ("class", "A"), ("function", "f")} | {d for d in named(text, "javascript") if d[1] == "A.m"}
    assert scan(text, "javascript")["imports"] == [("x", [])]


def test_solidity():
    assert named(SOL, "solidity") == {("contract", "A"), ("state_variable", "A.LIMIT"), ("state_variable", "A.m"), ("modifier", "A.only"), ("event", "A.Changed"), ("constructor", "A.constructor"), ("function", "A.put"), ("function", "A.get"), ("interface", "I"), ("function", "I.z")}
    got = scan(SOL, "solidity")
    assert got["bases"] == [("A", "B", 0), ("A", "C", 1)] and got["imports"] == [("./B.sol", [])]
    assert ("A.put", "get", "certain") in got["calls"]


@pytest.mark.parametrize("language", LANGUAGES)
def test_nothing_breaks_the_scanner(language):
    for text in ("", "func é() {", "fn é() {", "class É {", "contract C { // é", "{", "}}}", '"', "`", "/*", "class {", "func (", "impl", "use {", "é" * 50, "x" * 10000, "{" * 5000):
        assert set(scan(text, language)) == {"definitions", "imports", "calls", "bases"}
        assert len(blank(text, language)) == len(text)


def test_extract_takes_the_language(spark):
    files = spark.createDataFrame([(1, GO, "GO"), (2, "def f(): pass", "python"), (3, None, "go"), (4, "x", None), (5, "x", "cobol")], "key long, content string, language string")
    assert rows(extract(files, "definitions").groupBy("key").count()) == [(1, 4), (2, 1)]
