from __future__ import annotations

import ast
import json
import keyword
import random

import pytest
from pyspark.sql import functions as F

from lodegraph.llm import parsing, provenance, secrets
from lodegraph.llm.syntax.glr import Tables
from lodegraph.llm.syntax.languages import first_error
from tests.conftest import rows


def test_tables_and_conflicts():
    t = Tables("s = e ; e = e '+' e | e '*' e | NUM | '(' e ')' | NUM e %% ',' ;")
    parse = lambda s: t.parse([t.token[x if not x.isdigit() else "NUM"] for x in s.split()])
    assert parse("1 + 2 * 3") == -1 and parse("( 1 + 2 ) * 3") == -1 and parse("1 1 , 2 ,") == -1
    assert parse("1 + + 2") == 2 and parse("( 1 + 2") == 4 and parse("1 )") == 1


def test_palindromes_need_many_stacks():
    t = Tables("s = 'a' s 'a' | 'b' s 'b' | ;")
    rng = random.Random(0)
    for _ in range(40):
        w = [rng.choice("ab") for _ in range(rng.randrange(1, 9))]
        assert t.parse([t.token[c] for c in w + w[::-1]]) == -1
        wrong = [*w, *w[::-1], "a", "b"]
        assert (t.parse([t.token[c] for c in wrong]) == -1) == (wrong == wrong[::-1])


VALID = {
    "python": [
        "", "\ufeffx = 1\r\n", "if x:\n\ty\nelse:\n\tz\n", "match x:\n    case {'a': 1, **r} if r: pass\n    case [a, *_] | (a): pass\n    case _: pass\n", "match(x)\ntype = 3\nprint(case)\n", "async def f(a, /, b: int = 1, *c, d, **e) -> x[1:2, ...]:\n    await g(*a, k=1, **e)\n",
        "with (open(a) as b, c): pass\n", "lambda *a, k=1, **z: (yield)\n", "x = [i for i in range(3) if i if not i] + [*a, *b]\n", "f'{x!r:>{w}} {d[\"k\"]} {{}}'\n", "@a.b(c)\nclass A(B, metaclass=C):\n    '''=======\n<<<<<<< HEAD\n'''\n",
        "try:\n  a\nexcept* (B, C) as d:\n  pass\nelse: x\nfinally: y\n", "x: int = 1; y = z = 2\nx @= y\ndel a, b[0]\n", "def f[T: int](x: T) -> T: return x\ntype A[T] = list[T]\n", "a = 0x1F + 1_000.5e-3j\nif (n := 10) > 5: pass\n", "for x in *a, b: pass\nglobal q\nraise E from None\n", "x = (\n  1,\n# c\n)\n", "d = {**a, 'b': 1}; s = {1, *x}\nassert a, b\nfrom . import (a as b, c,)\n",
    ],
    "javascript": [
        "", "#!/usr/bin/env node\nlet a = 1\nlet b = 2\n", "const r = /[({\\[]x\\/y/g; const t = `a${`b${c}`}d`;", "a = b\n++c\nif (x) y; else z\nreturn\n", "export default async function* f({a = 1, ...b}, [c, , d] = []) { yield* c; for await (const x of y) {} }", "class A extends (B, C) { static #p = 1; get x() { return this.#p } static { f() } async *[k](a) {} 'q' = 2; constructor() { super() } }",
        "import d, { a as b, default as c } from './x.js'; import * as n from \"n\"; export { b as default, c }; export * from 'y'", "x?.[0]?.y?.(z) ?? w ** 2; a ||= b; o = { a, b() {}, get c() { return 1 }, async d() {}, [e]: 1, ...f, 'g': 2, if: 3 }", "(a, {b}) => ({ a }); async (x) => await x; x => y => z", "do x++; while (x < 5) y\nlabel: for (;;) { break label }\nswitch (a) { case 1: case 2: b; default: }", "!function(){'use strict'}(globalThis);var a=function(b){return!0}", "new Map; new (f())(1).g; new.target; import('x'); try { a } catch { b } finally { c }", "var s = 'a\\\nb', u = 0b11, n = 10n, f = .5e3",
    ],
    "jsx": ["const a = <div className=\"x\" {...p} on={() => f(<b/>)}>text {x ? <i>y</i> : null}<br/></div>;\nconst f = <></>;\nif (a < b && c > d) {}"],
    "typescript": [
        "", "type A<T extends object = {}> = { readonly [K in keyof T]?: T[K] } & Partial<Record<string, number[]>> | ((a: string, b?: number) => void)", "interface I<T> extends J, K<T> { a?: string; readonly b: number[]; (x: T): void; new (y: T): I<T>; m<U>(z: U): U; [k: string]: any }", "export class A<T> extends B<T> implements C, D<T> { private readonly x: string[] = []; constructor(private readonly y: number, public z?: T) { super() } static async f<U>(a: U): Promise<Map<string, Array<U>>> { return null! } abstract g(): void; declare h: number; @dec() i = 1 }",
        "const f = <T,>(x: T): x is string => typeof x === 'string'; const g = x as unknown as T[]; let h = y!; const e = {} satisfies A; a < b > (c)", "enum E { A = 1, B, 'c' = A << 2 } declare module 'm' { export const x: number } namespace N.M { } declare global { interface Window {} }", "import type { A } from './a'; import { type B, C } from 'b'; export type { A }; import fs = require('fs'); export = x", "function f(this: Window, a: string): asserts a is 'x'; function f(a: any) {}", "let t: [a: string, b?: number, ...rest: boolean[]] = x; let u: typeof import('x'); let v: `a${string}b`; type C = A extends infer U ? U : never", "abstract class Q { abstract x: number; get y(): number { return 1 } set y(v) {} } type F = new () => A; let w: unique symbol; for (const k of rows as R[]) {}",
    ],
    "tsx": ["const a = <T,>(x: T) => <div>{x as any}</div>;\nlet m = new Map<string, Array<number>>();"],
    "go": [
        "", "package a\n", "package a\n\nimport (\n\t\"b\"\n\tc \"d\"\n\t. \"e\"\n)\n\nvar x, y = 1, `}{`\n\nfunc (s *S[T]) F(a, b int, c ...string) (n int, err error) {\n\tif r := k[0]; r == '{' || r == '\\'' {\n\t\treturn\n\t}\n\tfor i, x := range in {\n\t\tx.y[i:2]++\n\t}\n\tfor range 3 {}\n\tfor {\n\t\tbreak\n\t}\n\tswitch v := z.(type) {\n\tcase int, *T:\n\tdefault:\n\t}\n\tselect {\n\tcase a <- b:\n\tcase c, ok := <-d:\n\t}\n\tgo func() { defer f() }()\n\tm := map[string][]int{\"a\": {1, 2}}\n\t_ = T{A: 1, B: []U{{1}, {2}}}\n\tL:\n\tgoto L\n}\n",
        "package a\ntype (\n\tS struct {\n\t\tA, B int `json:\"a\"`\n\t\t*E\n\t\tp.Q\n\t}\n\tI interface {\n\t\tM(x int) error\n\t\tfmt.Stringer\n\t\t~int | ~string\n\t}\n\tF func(int, ...string) (a, b int)\n\tG[K comparable, V any] map[K]V\n)\nconst (\n\ta = iota\n\tb\n)\nfunc Map[T, U any](x []T, f func(T) U) []U { return make([]U, 0, len(x)) }\n", "package a\nvar z = struct{ X int }{1}\nfunc f() { if x := (T{1}); x.a { }; var c chan<- int = nil; a, b = b, a; x &^= 1 }\n",
    ],
    "rust": [
        "", "//! doc\n#![allow(x)]\nuse a::{b, c::*, d as _};\npub(crate) struct S<'a, T: Clone + 'a, const N: usize = 3> where T: Fn(&str) -> u8 { pub a: &'a mut [T; N], b: Option<Vec<Vec<T>>> }\nstruct U; struct V(pub u8, i32);\n", "fn f<'a>(&'a self, mut x: impl Iterator<Item = u8>) -> Result<u64, Box<dyn E + Send>> { let Some(y) = x.next() else { return Err(\"e\".into()) }; if let Some(z) = y && z > 1 { } else if a == b { } match c { 'a'..='z' | '{' => 1, Some(n @ 1..=5) if n > 2 => { 2 } S { a, .. } => 3, _ => x as u64 } }",
        "impl<T> A for B<T> where T: C { const X: u8 = 1; type Y = T; async unsafe fn g() {} }\ntrait T: Sized + 'static { fn h(&self) -> Self::Z; type Z: D; }\nenum E { A = 1, B(u8), C { x: u8 } }\nmacro_rules! m { ($x:expr) => { $x + 1 }; }\n", "const S: &str = r#\"}{ <<<<<<< \"#; static mut Q: [(&str, u32); 2] = [(\"a\", 1), (\"b]\", 2)];\nfn g() { let v = vec![1; 3]; let c = move |a: u8, _| -> u8 { a }; x.iter().filter(|x| x.size <= limit && x.y != 85).collect::<Vec<_>>()?; for i in 0..n { continue 'l; } 'l: loop { break 'l 1; } unsafe { *p += 1; } a.0.1 = !b; return; }", "/* /* nested */ */ extern \"C\" { fn z(a: *const u8, ...); } pub mod m { pub use super::x; }\nfn k() { let s = S { a: 1, ..Default::default() }; let f = S::<u8>::new(); if x < y { } let _ = &mut a[..2]; matches!(a, B | C) }",
    ],
    "solidity": [
        "", "// SPDX\npragma solidity ^0.8.20;\nimport \"./A.sol\"; import {B as C, D} from \"d\";\nabstract contract X is Y(1), Z.W { using L for uint256; mapping(address owner => mapping(uint => bool)) internal m; uint256 public constant Q = 1 ether; event E(address indexed a, uint b); error F(uint x); struct S { uint a; bytes32[] b; } enum N { A, B } modifier only() virtual { require(m[msg.sender][0], \"no :(\"); _; } constructor(uint a) Y(a) payable { } receive() external payable {} fallback() external {} function f(uint[] calldata a) external view only override(Y, Z) returns (uint b, bytes memory) { unchecked { b += a[0] ** 2; } for (uint i = 0; i < 3; i++) { if (i == 1) continue; } (bool ok, ) = address(this).call{value: 1}(\"\"); emit E(msg.sender, b); revert F({x: 1}); } }",
        "interface I { function g(uint256 a) external returns (bool); }\nlibrary L { function h(uint x) internal pure returns (uint) { return x > 1 ? x - 1 : type(uint).max; } function a() internal { assembly { let x := mload(0x40) if lt(x, 1) { revert(0, 0) } } try this.f() returns (uint v) { } catch Error(string memory r) { } catch { } delete m; new C(); } }",
    ],
}
INVALID = {
    "python": ["x = (\n", "if x:\npass\n", "  x = 1\n", "<<<<<<< HEAD\n", "def f(:\n  pass\n", "print 'x'\n", "x = 'abc\n", "'''abc", "x = 83b85de\n", "a b\n", "class A:\n", "if x:\n    a\n  b\n", "else: x\n", "x = 5 +\n", "f'{a'\n", "import\n", "a = }\n", "for x y: pass\n"],
    "javascript": ["function f( {", "let a = ;", "<<<<<<< HEAD\n", "x = 'abc\n'", "const a: string = 1;", "if (x {", "/* open", "`abc", "import os\nfrom x import y", "a b", "}", "class { x }{", "package summit", "const a"],
    "jsx": ["const a = <div><b></div>;", "const a = <div>;"],
    "typescript": ["let x: = 1;", "interface A { x: }", "type T = ;", "=======\n", "class A { private x: string", "pragma solidity ^0.8.20;"],
    "go": ["func f() {}", "package a\nfunc f() {\n", "package a\nvar x = \n", "package a\n>>>>>>> x\n", "package a\nx := 1\n", "package a\nfunc f() { if x { }", "package a\nimport \"b\" func f() {}", "use std::io;"],
    "rust": ["fn f() {", "struct S { a u8 }", "fn f() -> { }", "=======\n", "let x = 1;", "fn f() { let = 1; }", "import os", "fn f() { \"abc }", "/* open", "pub fn f(x) {}"],
    "solidity": ["contract A {", "contract A { function f() { } uint }", "pragma solidity ^0.8.20", "import (\n)", "function f( {}", "<<<<<<< ours\n", "contract A is { }", "package x\n"],
}


@pytest.mark.parametrize("language", VALID)
def test_valid_source(language):
    for text in VALID[language]:
        assert first_error(text, language) is None, text


@pytest.mark.parametrize("language", INVALID)
def test_invalid_source(language):
    for text in INVALID[language]:
        assert first_error(text, language) is not None, text


def test_python_agrees_with_the_interpreter_on_mutations():
    rng = random.Random(5)
    words = ["(", ")", "[", "]", "{", "}", ":", ",", "\n", "    ", "=", "x", "1", "'a'", "def", "if", "else", "for", "in", "lambda", "*", ".", "return", "#c\n", "async"]
    wrong = 0
    for text in VALID["python"] * 25:
        cut = rng.randrange(len(text) + 1)
        mutant = text[:cut] + rng.choice(words) + text[cut + rng.randrange(3) :] if rng.random() < 0.7 else text[:cut]
        try:
            ast.parse(mutant.removeprefix("\ufeff"))
            valid = True
        except (SyntaxError, ValueError):
            valid = False
        ours = first_error(mutant, "python") is None
        # the interpreter also refuses targets and arguments, which are no matter of the grammar
        assert ours or not valid, mutant
        wrong += ours and not valid
    assert wrong < 25 and keyword.iskeyword("if")


def test_first_error_is_placed():
    assert first_error("x = 1\ny = )\n", "python")[:2] == (2, 5)
    assert first_error("fn f() {\n", "rust")[2] == "end of file"


INDEX = "repo_id long, rel_path string, file_version_id long, language string, valid string"
VERSIONS = "id long, raw_content string, language string"


def test_flags_and_rates(spark):
    versions = spark.createDataFrame([(1, "x = 1\n", "p"), (1, "x = 1\n", "p"), (2, "x = (\n", "p"), (3, None, "p"), (4, "", "go"), (5, "x = 1\n", "js"), (6, "let x: = 1;", "t")], VERSIONS)
    index = spark.createDataFrame([(1, "a.py", 1, None, "v"), (1, "a.py", 1, None, "v"), (1, "b.py", 2, "PYTHON", "v"), (1, "c.py", 3, "p", "v"), (2, "d.go", 4, "go", "v"), (2, "e.JS", 5, "x", "v"), (2, "f.ts", 6, "x", "v"), (2, "g.py", 99, "x", "v"), (2, "h.txt", 1, "x", "v"), (2, "i.go", 1, "x", "v"), (2, None, 1, "x", "v")], INDEX)
    got = parsing.check_files(index, versions)
    flags = {(r.rel_path): r.valid for r in got.collect()}
    assert flags == {"a.py": True, "b.py": False, "c.py": None, "d.go": True, "e.JS": True, "f.ts": False, "g.py": None, "i.go": False}
    assert rows(parsing.invalid_rates(got), "repo_id", "language", "n_files", "n_invalid", "share") == [(1, "python", 2, 1, 0.5), (2, "go", 2, 1, 0.5), (2, "javascript", 1, 0, 0.0), (2, "typescript", 1, 1, 1.0)]
    assert parsing.check_files(index.limit(0), versions).count() == 0


CAPTURED = "capture_id long, repo_id long, path string, content binary, mode string, line_no string"


def captured(spark, files):
    return spark.createDataFrame([(i, r, p, None if t is None else bytearray(t if isinstance(t, bytes) else t.encode()), "100644", "x") for i, r, p, t in files], CAPTURED)


SECRET_FILES = [
    (1, 1, "a.env", "HOST=db\nDB_PASS=Winter.river91\nTOKEN_TTL=3600\nPWD=${SECRET}\n"),
    (2, 2, "b.yaml", 'a:\n  password: "hunter2x!"\n  password_field: tenant_key\n  tls: |\n    -----BEGIN RSA PRIVATE KEY-----\n    AAAAAAAAAAAAAAAA\n    -----END RSA PRIVATE KEY-----\n'),
    (3, 3, "c.py", 'url = "postgres://app:s3cretPw@h:1/x"\npassword = os.environ["DB"]\nkey = "ghp_' + "a1B2" * 9 + '"\n# see Winter.river91 above\n'),
    (4, 4, "d.js", 'const secretKey = "abcdEFGH1234" +\n  "ijklMNOP5678";\nlogin("svc", "riverQ9!x");\nconst sha = "' + "ab12" * 10 + '";\n'),
    (5, 5, "e.md", "Use `api_key=9f8e7d6c5b4a39281706` here.\r\nUse `authorization=Bearer " + "xY9" * 12 + "` too.\r\n"),
    (6, 6, "f.png", b"\x89PNG\n\xff\xfe\n"),
    (7, 7, "g.txt", None),
    (8, 8, "h.conf", ""),
    (1, 1, "a.env", "HOST=db\nDB_PASS=Winter.river91\nTOKEN_TTL=3600\nPWD=${SECRET}\n"),
] + [(100 + i, i, f"p{i}.env", "PASSWORD=letmein99\nSECRET=changeme\n") for i in range(1, 9)]


def test_secret_lines(spark):
    got = rows(secrets.secret_lines(captured(spark, SECRET_FILES), "capture_id", "repo_id", "path", "content"))
    assert got == [(1, 2), (2, 2), (2, 5), (3, 1), (3, 3), (3, 4), (4, 1), (4, 3), (5, 1), (5, 2)]
    assert secrets.secret_lines(captured(spark, SECRET_FILES).limit(0), "capture_id", "repo_id", "path", "content").count() == 0


def test_blocks_change_nothing(spark, monkeypatch):
    whole = rows(secrets.secret_lines(captured(spark, SECRET_FILES), "capture_id", "repo_id", "path", "content"))
    monkeypatch.setattr(secrets, "BLOCK_VALUES", 2)
    assert rows(secrets.secret_lines(captured(spark, SECRET_FILES), "capture_id", "repo_id", "path", "content")) == whole


def test_owner_counts_decide_what_is_a_placeholder(spark, monkeypatch):
    """Words that no list holds fall by their owners alone, however they are spelled; kept
    off, the same rows come out."""
    spellings = ["fill-this-in", "FILL_THIS_IN", "FillThisIn"]
    files = [(i, i, f"p{i}.env", f"DB_PASSWORD={spellings[i % 3]}\nAPI_KEY=own{i}Q9xz!\n") for i in range(1, 13)]
    find = lambda: rows(secrets.secret_lines(captured(spark, files), "capture_id", "repo_id", "path", "content"))
    assert find() == [(i, 2) for i in range(1, 13)]
    monkeypatch.setattr(secrets, "MIN_OWNERS", 99)
    assert find() == [(i, n) for i in range(1, 13) for n in (1, 2)]


@pytest.mark.parametrize("held", [100, 0])
def test_automaton_finds_what_no_context_names(spark, monkeypatch, held):
    monkeypatch.setattr(secrets, "BLOCK_VALUES", held)
    files = [(1, 1, "a.env", "DB_PASSWORD=Falke-71.river\n"), (2, 2, "n.txt", "first\nhe wrote Falke-71.river on the board\n"), (3, 3, "m.txt", "xFalke-71.river Falke-71.rivers\n"), (4, 4, "o.txt", "(Falke-71.river)\n" * 2)]
    got = rows(secrets.secret_lines(captured(spark, files), "capture_id", "repo_id", "path", "content"))
    assert got == [(1, 1), (2, 2), (4, 1), (4, 2)]
    monkeypatch.setattr(secrets, "SCANNED_LENGTH", 10**6)
    assert rows(secrets.secret_lines(captured(spark, files), "capture_id", "repo_id", "path", "content")) == [(1, 1)]


def test_only_the_spans_change(spark):
    """Outside the spans of credentials every byte stays, and Python that parses still does."""
    text = {1: 'import x\npassword = "Zz9!zZ9!zz"  # note é\nlogin("svc", "riverQ9!x")\nn = {"a": [1, 2]}\n', 2: "A=1\r\nSECRET_KEY=q8W7e6R5t4\r\nB=2\r\n"}
    df = captured(spark, [(i, i, f"f{i}.py" if i == 1 else "f.env", t) for i, t in text.items()])
    hits, _ = secrets.find_secrets(df, "capture_id", "repo_id", "path", "content")
    got = {r.capture_id: bytes(r.content).decode() for r in secrets.redact_files(df, "capture_id", "repo_id", "path", "content").collect()}
    for i, t in text.items():
        spans = sorted({(r.start, r.stop) for r in hits.filter(F.col("id") == i).collect()})
        kept, at = [], 0
        for a, b in spans:
            kept.append(t[at:a])
            at = b
        assert got[i] == secrets.MASK.join([*kept, t[at:]]) and spans
    ast.parse(got[1])


def test_redacted_files_keep_their_form(spark):
    files = [*SECRET_FILES, (20, 20, "z.json", json.dumps({"db": {"password": "zZ9!zZ9!zz"}, "n": 1}))]
    got = {r.capture_id: bytes(r.content).decode() for r in secrets.redact_files(captured(spark, files), "capture_id", "repo_id", "path", "content").collect()}
    assert json.loads(got[20]) == {"db": {"password": "REDACTED"}, "n": 1}
    assert got[1].splitlines()[1] == "DB_PASS=REDACTED" and got[1].splitlines()[3] == "PWD=${SECRET}"
    assert ast.parse(got[3]) and "REDACTED@h:1/x" in got[3] and "Winter" not in got[3]
    assert got[4].startswith('const secretKey = "REDACTED" +\n  "REDACTED";')
    assert "AAAA" not in got[2] and "BEGIN RSA" in got[2] and got[5].count("\r\n") == 2
    assert set(got) == {1, 2, 3, 4, 5, 20}


@pytest.mark.parametrize("text", ["a" * 300_000, "1" * 300_000, "1" * 5000 + " x", "a;" * 100_000, "a:b," * 60_000, "password" * 40_000, "http " * 50_000, '"' * 50_001, "# " * 80_000, "x=1;y(" * 30_000, "-" * 200_000, "eyJ" * 60_000, "://" * 60_000])
def test_long_lines_take_linear_time(text):
    import time

    began = time.process_time()
    for code in (True, False):
        list(secrets.literals(text, code))
    provenance.verdict(text)
    provenance.verdict("1, 2,\n" * 10 + text)
    first_error(text[:60_000], "javascript")
    first_error(text[:60_000], "python")
    assert time.process_time() - began < 20


def test_long_credentials_are_found(spark):
    long = lambda n, c: (c + "Ab3/xY7+") * (n // 9)
    files = [
        (1, 1, "a.env", f"JWT_PRIVATE_KEY={long(1600, 'M')}\n"),
        (2, 2, "b.json", f'{{"x": 1,\n"password": "{long(3000, "N")}"}}\n'),
        (3, 3, "c.sh", f"curl -H 'X: {'h' * 700}' -u svc:riverQ9!x http://h\n"),
        (4, 4, "d.txt", f"ok\n# {'note ' * 80} password: winterQ9!x\n"),
        (5, 5, "e.txt", f"see postgres://{'u' * 300}:{'p4' * 400}@host/db\n"),
        (6, 6, "f.txt", f"copied {long(1600, 'M')} here\n"),
    ]
    got = rows(secrets.secret_lines(captured(spark, files), "capture_id", "repo_id", "path", "content"))
    assert got == [(1, 1), (2, 2), (3, 1), (4, 2), (5, 1), (6, 1)]


@pytest.mark.parametrize("text", ["a:b," * 60_000 + " x", "key=" * 60_000 + " x", "# key=" * 50_000 + " x", "curl -u a" * 30_000, "x://" + "u" * 200_000, "a://b:" * 40_000, "password='" + "${" * 100_000 + "'", "password='" + "{{" * 100_000 + "'", 'a="' * 60_001, "k" * 200_000 + " :"])
def test_unbounded_patterns_take_linear_time(text):
    import time

    began = time.process_time()
    for code in (True, False):
        for x in secrets.literals(text, code):
            secrets.possible(x)
    assert time.process_time() - began < 10


def test_verdicts():
    v = provenance.verdict
    assert v("# Code generated by x v1. DO NOT EDIT.\nx = 1\n") == "generated" and v("// @generated by y\n") == "generated"
    assert v('BANNER = "# Code generated by {tool}. DO NOT EDIT."\n') is None and v('# The writer puts "DO NOT EDIT" on top of what it generates\n') is None
    assert v("/*!\n lib v1.2.3\n https://lib.example/\n Released under the MIT licence\n */\ncode") == "vendored" and v("// Copyright the contributors.\n// Use is governed by LICENSE.\n") is None
    assert v("function a(b){return b<c?b.d:b[3]}" * 30) == "minified" and v("ROUTES = '" + "a|" * 200 + "'\n" + "x = 1\n" * 100) is None
    assert v("X = [\n" + "0x1f, 0x2e, 12,\n" * 50 + "]\n") == "data" and v("X = [\n1, 2,\n]\n" + "y = x + 1\n" * 9) is None
    assert v("".join(f"function s{i}(t) {{ return t === {7 * i} ? {i % 9} : -1; }}\n" for i in range(40))) == "generated"
    assert v("".join(f'export * from "./{c}{c}";\n' for c in "abcdefghijklmnopqrstuvwxyz")) is None
    # the note of a generator stands in the comments on top, however long they are
    assert v("// a\n" * 90 + "// Code generated by x. DO NOT EDIT.\npackage a\n") == "generated" and v("package a\n\n// @generated by y\nvar x = 1\n") == "generated"
    assert v("x = 1\n# Code generated by x. DO NOT EDIT.\n") is None
    assert v(None) is None and v("") is None


def test_attribute_globs_and_precedence():
    root = provenance.parse_attributes("# c\n*.gen.py linguist-generated\nlib/** linguist-vendored=true\n/top.py linguist-generated\nother text\n")
    deep = provenance.parse_attributes("*.gen.py -linguist-generated\nkeep.py linguist-vendored=false\n")
    files = [("", root), ("lib/own", deep)]
    d = lambda p: provenance.declared(p, files)
    assert d("a/x.gen.py") == {"generated": True} and d("lib/z.py") == {"vendored": True}
    assert d("lib/own/x.gen.py") == {"vendored": True, "generated": False} and d("lib/own/keep.py") == {"vendored": False}
    assert d("top.py") == {"generated": True} and d("a/top.py") == {} and d("library/z.py") == {}


def test_attribute_files_of_nested_directories(spark):
    """Anchors, macros, quoted patterns, negation, and the latest capture of two."""
    p = lambda text, path: provenance.declared(path, [("", provenance.parse_attributes(text))])
    assert p("vendor/** vendored\n", "vendor/x.py") == {"vendored": True} and p("vendor/** vendored\n", "src/vendor/x.py") == {}
    assert p("[attr]made generated -vendored\n*.q.py made\n", "a/b.q.py") == {"generated": True, "vendored": False}
    assert p('"with blank/*.py" generated\n', "with blank/x.py") == {"generated": True}
    v = spark.createDataFrame([(1, "x = 1\n")], "id long, raw_content string")
    ix = spark.createDataFrame([(4, f, 1) for f in ("a/m.py", "a/b/m.py", "a/b/keep.py", "a/b/c/m.py", "m.py")] + [(5, "a/m.py", 1)], "repo_id long, rel_path string, file_version_id long")
    files = [(1, 4, "a/.gitattributes", "*.py linguist-generated\n"), (2, 4, "a/b/.gitattributes", "keep.py -linguist-generated\n"), (3, 4, "a/b/c/.gitattributes", "/m.py !linguist-generated\n")]
    got = [tuple(r) for r in provenance.explain_files(ix, v, captured(spark, files)).orderBy("path").collect()]
    assert got == [(4, "a/b/m.py", ["generated"], ["declared"]), (4, "a/m.py", ["generated"], ["declared"])]
    older = captured(spark, files).withColumn("captured_at", F.expr("timestamp '2020-01-01 00:00:00'"))
    newer = captured(spark, [(9, 4, "a/.gitattributes", "# nothing\n")]).withColumn("captured_at", F.expr("timestamp '2021-01-01 00:00:00'"))
    assert provenance.classify_files(ix, v, older.unionByName(newer)).count() == 0


def test_library_directories_and_dense_trees(spark):
    notice = lambda n: f"/*!\n {n} v1.2.3\n https://{n}.example/\n Released under the MIT licence\n */\ncode\n"
    files = [(r, f"pkg/asyncle/f{r}.js", notice("asyncle"), 9) for r in range(3)] + [(7, "deps/asyncle/bare.js", "x = 1\n", 9), (7, "deps/rare/bare.js", "x = 1\n", 9)]
    files += [(8, "deps/rare/n.js", notice("rare"), 9), (8, "one.js", "f(" + "a, " * 200 + "b)\n", 900), (8, "two.js", "f(1)\n", 900), (8, "three.js", None, None)]
    ix = spark.createDataFrame([(r, p, i, n) for i, (r, p, _, n) in enumerate(files)], "repo_id long, rel_path string, file_version_id long, node_count long")
    v = spark.createDataFrame([(i, t) for i, (_, _, t, _) in enumerate(files)], "id long, raw_content string")
    got = {(r.repo_id, r.path): (r.kinds, r.reasons) for r in provenance.explain_files(ix, v, captured(spark, [])).collect()}
    assert got.pop((7, "deps/asyncle/bare.js")) == (["vendored"], ["library"]) and got.pop((8, "one.js")) == (["minified"], ["content"])
    assert set(got) == {(r, p) for r, p, t, _ in files if t and "Released" in t}


def test_files_that_nobody_wrote(spark):
    body = "def f(x):\n    return x + 1\n" * 20
    banner = '"""\n lib v1.2.3\n https://lib.example/\n Released under the MIT licence\n"""\n' + body
    versions = [(1, body), (2, banner), (3, "function a(b){return b<c?b.d:b[3]}" * 30), (4, None), (5, body + "# own\n")]
    versions += [(100 + i, "// @generated by tool\nx = 1\n") for i in range(9)]
    index = [(1, "src/a.py", 1), (1, "vendor_portal/b.py", 1), (1, "app/c.py", 2), (2, "dist/d.js", 3), (2, "x_pb2.py", 4), (3, "vendor/lib/e.py", 5), (3, "src/copy.py", 5), (3, None, 1)]
    index += [(i % 3, f"m{i}.zz.ts", 100 + i) for i in range(9)] + [(9, "late.zz.ts", 4)]
    v = spark.createDataFrame([(i, t, "x") for i, t in versions], "id long, raw_content string, kinds string")
    ix = spark.createDataFrame([(r, p, f, "x") for r, p, f in index], "repo_id long, rel_path string, file_version_id long, kinds string")
    cap = captured(spark, [(1, 4, ".gitattributes", "special/** linguist-generated\n*_pb2.py -linguist-generated\n"), (2, 4, "special/s.py", body + "# s\n"), (3, 4, "own_pb2.py", body + "# t\n"), (4, 4, "pic.png", b"\x89PNG"), (5, 4, "notes.md", "@generated")])
    got = {(r.repo_id, r.path): r.kinds for r in provenance.classify_files(ix, v, cap).collect()}
    want = {(1, "app/c.py"): ["vendored"], (2, "dist/d.js"): ["minified"], (2, "x_pb2.py"): ["generated"], (3, "vendor/lib/e.py"): ["vendored"], (3, "src/copy.py"): ["vendored"], (4, "special/s.py"): ["generated"]}
    want |= {(i % 3, f"m{i}.zz.ts"): ["generated"] for i in range(9)}
    assert {k: x for k, x in got.items() if k[1] != "late.zz.ts"} == want
    assert provenance.classify_files(ix.limit(0), v.limit(0), cap.limit(0)).count() == 0


def test_mined_globs_reach_other_repositories(spark):
    """Unmarked paths gain a kind from other repositories, not where one of these has an
    exception, most show nothing, or only a convention marks the path."""
    note = "// @generated by tool\nx = 1\n"
    files = [(i % 3, f"a{i}.zz.ts", note) for i in range(9)] + [(9, "late.zz.ts", "x = 1\n")]
    files += [(i % 3, f"a{i}.yy.ts", note) for i in range(9)] + [(3, "b.yy.ts", note), (3, "c.yy.ts", "x = 1\n"), (9, "late.yy.ts", "x = 1\n")]
    files += [(i % 3, f"a{i}.xx.ts", note) for i in range(9)] + [(r, "own.xx.ts", "x = 1\n") for r in range(20, 25)]
    files += [(i % 3, f"vendor/kit/a{i}.ww.ts", "x = 1\n") for i in range(9)] + [(9, "kit/own.ww.ts", "x = 1\n")]
    ix = spark.createDataFrame([(r, p, i) for i, (r, p, _) in enumerate(files)], "repo_id long, rel_path string, file_version_id long")
    v = spark.createDataFrame([(i, t) for i, (_, _, t) in enumerate(files)], "id long, raw_content string")
    got = {(r.repo_id, r.path): r.kinds for r in provenance.classify_files(ix, v, captured(spark, [])).collect()}
    assert got.pop((9, "late.zz.ts")) == ["generated"]
    # the only repository with an exception has all others for the glob
    assert got.pop((3, "c.yy.ts")) == ["generated"]
    assert set(got) == {(r, p) for r, p, t in files if t == note or p.startswith("vendor/")}


def test_registered_queries_run(spark, sf_dir):
    from lodegraph.llm.queries import ORACLES, QUERIES

    assert set(ORACLES) <= set(QUERIES)
    for name in ("p1_found", "p2_found", "p3_found", "p5_found", "p6_found", "p7_found", "p8_ids", "p9_containers", "p10_found"):
        assert QUERIES[name](spark, sf_dir).count() > 0, name
