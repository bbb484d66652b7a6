"""Tolerant scanner for brace languages: definitions, imports, bases and calls of Go, Rust,
JavaScript, TypeScript and Solidity sources, whether or not they parse."""

from __future__ import annotations

import re
from bisect import bisect_right
from typing import NamedTuple

LANGUAGES = ("go", "rust", "javascript", "typescript", "solidity")

_TOKENS = {
    "rust": r"""//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|[bc]?r(\#*)"[\s\S]*?(?:"\1|\Z)|[bc]?"(?:[^"\\]|\\[\s\S])*(?:"|\Z)|b?'(?:[^'\\\n]|\\[^\n]{1,10})'""",
    "": r"""//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|"(?:[^"\\\n]|\\[\s\S])*(?:"|$)|'(?:[^'\\\n]|\\[\s\S])*(?:'|$)|`(?:[^`\\]|\\[\s\S])*(?:`|\Z)""",
}
_TOKENS = {k: re.compile(v, re.M) for k, v in _TOKENS.items()}

_CLASS = r"(?P<class>^[ \t]*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(?P<class_name>[\w$]+)(?P<class_rest>[^{]*))"
_JS = (
    rf"{_CLASS}|(?P<function>^[ \t]*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(?P<function_name>[\w$]+)\s*\()"
    r"|(?P<variable>^(?:export\s+)?(?:const|let|var)\s+(?P<variable_name>[\w$]+))"
    r"|(?P<method>^[ \t]+(?:(?:public|private|protected|static|readonly|abstract|override|async|get|set)\s+|\*\s*)*(?P<method_name>\#?[\w$]+)\s*(?:<[^>(]*>)?\((?=[^;{}]*\)[^;{}()]*\{))"
)
_DECLARATIONS = {
    "go": r"(?P<method>^func\s+\(\s*(?:\w+\s+)?\*?(?P<method_of>\w+)[^)]*\)\s*(?P<method_name>\w+))|(?P<function>^func\s+(?P<function_name>\w+))|(?P<type>^type\s+(?P<type_name>\w+))|(?P<var>^var\s+(?P<var_name>\w+))|(?P<const>^const\s+(?P<const_name>\w+))",
    "rust": r"(?P<impl>^[ \t]*(?:unsafe\s+)?impl\b(?:\s*<[^{]*?>)?\s+(?:(?P<impl_trait>[\w:]+)(?:<[^{]*?>)?\s+for\s+)?(?P<impl_name>\w+)[^{;]*(?=\{))|(?P<function>\bfn\s+(?P<function_name>\w+))|(?P<type>\b(?:struct|enum|union)\s+(?P<type_name>\w+))|(?P<trait>\btrait\s+(?P<trait_name>\w+))|(?P<module>\bmod\s+(?P<module_name>\w+))"
    r"|(?P<const>^[ \t]*(?:pub(?:\([^)]*\))?\s+)?const\s+(?P<const_name>[A-Z_]\w*)\s*:)|(?P<static>^[ \t]*(?:pub(?:\([^)]*\))?\s+)?static\s+(?:mut\s+)?(?P<static_name>\w+)\s*:)|(?P<macro>\bmacro_rules!\s*(?P<macro_name>\w+))",
    "javascript": _JS,
    "typescript": _JS + r"|(?P<interface>^[ \t]*(?:export\s+)?(?:declare\s+)?interface\s+(?P<interface_name>[\w$]+)(?P<interface_rest>[^{]*))|(?P<type>^[ \t]*(?:export\s+)?(?:declare\s+)?type\s+(?P<type_name>[\w$]+)\s*(?:<[^=]*>)?\s*=)|(?P<enum>^[ \t]*(?:export\s+)?(?:const\s+)?enum\s+(?P<enum_name>[\w$]+))",
    "solidity": r"(?P<contract>\bcontract\s+(?P<contract_name>\w+)(?P<contract_rest>[^{]*))|(?P<interface>\binterface\s+(?P<interface_name>\w+)(?P<interface_rest>[^{]*))|(?P<library>\blibrary\s+(?P<library_name>\w+))|(?P<function>\bfunction\s+(?P<function_name>\w+))|(?P<modifier>\bmodifier\s+(?P<modifier_name>\w+))|(?P<event>\bevent\s+(?P<event_name>\w+))"
    r"|(?P<error>\berror\s+(?P<error_name>\w+)(?=\s*\())|(?P<struct>\bstruct\s+(?P<struct_name>\w+))|(?P<enum>\benum\s+(?P<enum_name>\w+))|(?P<constructor>\bconstructor\b(?=\s*\())|(?P<state_variable>^[ \t]+[\w\[\]().=> ]+?\s(?:public|private|internal|constant|immutable)[\w ]*?\s(?P<state_variable_name>\w+)\s*(?==|;))",
}
_DECLARATIONS = {k: re.compile(v, re.M) for k, v in _DECLARATIONS.items()}
_KINDS = {k: [g for g in v.groupindex if not g.endswith(("_name", "_rest", "_of", "_trait"))] for k, v in _DECLARATIONS.items()}
_SCOPES = {"class", "interface", "contract", "library", "trait", "module", "impl", "type", "function", "method", "constructor", "modifier", "enum", "struct"}
_NOT_CALLS = set("if for while switch catch return function func fn match new typeof super await yield require import sizeof mapping constructor modifier event error emit revert with returns loop else".split()) - {"require", "revert"}
_CALL = re.compile(r"(?P<dot>\.\s*|::)?(?P<name>[A-Za-z_$][\w$]*)\s*!?\(")
_IMPORTS = {
    "go": re.compile(r'^\s*import\s+(?:[\w.]+\s+)?"([^"]+)"|^\s*(?:[\w.]+\s+)?"([\w./\-]+)"\s*$', re.M),
    "rust": re.compile(r"^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]+);", re.M),
    "javascript": re.compile(r"""^\s*(?:import|export)\b(?P<names>[^'"`;=()]*?)\s*(?:from\s*)?['"]([^'"\n]+)['"]|\brequire\(\s*['"]([^'"\n]+)['"]\s*\)""", re.M),
    "solidity": re.compile(r"""^\s*import\s+(?P<names>[^"';]*?)["']([^"'\n]+)["']""", re.M),
}
_IMPORTS["typescript"] = _IMPORTS["javascript"]


class Definition(NamedTuple):
    kind: str
    name: str
    qualified_name: str
    parent: str | None
    start: int
    end: int
    visibility: str | None


def blank(text: str, language: str) -> str:
    """The text with comments and literals replaced by spaces of the same length."""
    return _TOKENS.get(language, _TOKENS[""]).sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def _end(code: str, start: int, partner: dict[int, int]) -> int:
    """End of a declaration: its closing brace, or the semicolon or line end before one."""
    m = re.compile(r"[{;]|\n(?=\s*\n)|\Z").search(code, start)
    return min(len(code), partner.get(m.start(), len(code)) + 1) if m[0] == "{" else m.end()


def _partners(code: str) -> dict[int, int]:
    out, open_ = {}, []
    for m in re.finditer(r"[{}]", code):
        if m[0] == "{":
            open_.append(m.start())
        elif open_:
            out[open_.pop()] = m.start()
    return out


def flatten_use(tree: str) -> list[tuple[str, list[str]]]:
    """Paths of a Rust use tree, each with the names it brings in."""
    tree = re.sub(r"\s+", " ", tree.strip())
    m = re.match(r"(.*?)(?:::)?\{(.*)\}$", tree)
    if not m:
        path = tree.split(" as ")[0].strip()
        return [(path, [path.rsplit("::", 1)[-1]])]
    out, depth, part, parts = [], 0, "", []
    for c in m[2] + ",":
        if c == "," and not depth:
            parts.append(part)
            part = ""
            continue
        depth += (c == "{") - (c == "}")
        part += c
    for p in filter(str.strip, parts):
        for path, names in flatten_use(p):
            out.append((f"{m[1]}::{path}" if m[1] else path, names))
    return out


def scan(text: str, language: str, occurrences: bool = False) -> dict[str, list[tuple]]:
    """definitions, imports, calls and bases of a source, and its occurrences if asked for, in
    the columns of the Python extractor; byte offsets are of the UTF-8 text."""
    code = blank(text, language)
    partner = _partners(code)
    found: list[tuple[str, str, int, int, str | None]] = []
    bases: list[tuple[int, str, int]] = []
    for m in _DECLARATIONS[language].finditer(code):
        kind = next(k for k in _KINDS[language] if m[k] is not None)
        groups = m.groupdict()
        name = groups.get(f"{kind}_name") or kind
        if kind == "method" and name in _NOT_CALLS and name != "constructor":
            continue
        start = m.start() + len(m[0]) - len(m[0].lstrip())
        at = len(found)
        found.append((kind, name, start, _end(code, m.end(), partner), groups.get("method_of")))
        rest = groups.get(f"{kind}_rest") or ""
        if language == "solidity":
            inherited = re.split(r"\bis\b", rest, maxsplit=1)[1:]
        else:
            inherited = re.findall(r"\b(?:extends|implements)\b((?:(?!\b(?:extends|implements)\b)[\s\S])*)", rest)
        names = [x for part in inherited for x in re.findall(r"[\w$.]+", re.sub(r"<[^>]*>|\([^)]*\)", "", part))]
        bases += [(at, x.rsplit(".", 1)[-1], i) for i, x in enumerate(names)]
        if kind == "impl" and groups.get("impl_trait"):
            bases.append((at, groups["impl_trait"].rsplit("::", 1)[-1], 1))
    definitions: list[Definition] = []
    qualified: list[str] = []
    stack: list[int] = []
    for i, (kind, name, start, end, of) in enumerate(found):
        while stack and found[stack[-1]][3] <= start:
            stack.pop()
        parent = qualified[stack[-1]] if stack else of
        inside = kind
        if kind == "function" and stack and found[stack[-1]][0] in ("impl", "trait"):
            inside = "method"
        full = name if kind == "impl" else f"{parent}.{name}" if parent else name
        qualified.append(full)
        # members of functions are locals, but for nested functions and classes
        local = stack and found[stack[-1]][0] in ("function", "method") and kind in ("variable", "const", "var", "static", "method")
        if kind != "impl" and not local:
            head = text[start : start + 200].split("{", 1)[0]
            seen = re.search(r"\b(public|private|protected|internal|external|pub)\b", head)
            definitions.append(Definition(inside, name, full, parent, start, end, seen[1] if seen else None))
        if kind in _SCOPES:
            stack.append(i)
    offset = _byte_offsets(text)
    known: dict[str, int] = {}
    for d in definitions:
        known[d.name] = known.get(d.name, 0) + 1
    starts = [d.start for d in definitions]
    calls = []
    heads = {m.start(1) for m in re.finditer(r"\b(?:function|func|fn|modifier|event|error|constructor)\s*\*?\s*(?:\([^)]*\)\s*)?([\w$]+)\s*\(", code)}
    for m in _CALL.finditer(code):
        name = m["name"]
        if name in _NOT_CALLS or m.start("name") in heads or code[: m.start("name")].endswith(("function ", "fn ")):
            continue
        owner = next((d for d in reversed(definitions[: bisect_right(starts, m.start())]) if d.end > m.start() and d.kind in ("function", "method", "constructor", "modifier")), None)
        if owner is not None and owner.start <= m.start("name") < owner.start + 200 and code[owner.start : m.start("name")].count("{") == 0:
            continue
        confidence = "inferred" if m["dot"] else "certain" if known.get(name) else "uncertain"
        calls.append((owner.qualified_name if owner else None, name, confidence))
    imports = []
    for m in _IMPORTS[language].finditer(text):
        if language == "rust":
            imports += flatten_use(m[1])
            continue
        if language == "go" and m[1] is None and not re.search(r"\bimport\s*\([^)]*\Z", code[: m.start(2)]):
            continue
        names = re.findall(r"[\w$]+(?:\s+as\s+[\w$]+)?", (m.groupdict().get("names") or "").replace("import", ""))
        imports.append((next(g for g in m.groups()[::-1] if g), [n.split(" as ")[0].strip() for n in names if n not in ("type", "as", "from")]))
    named = {}
    if occurrences:
        heads |= {code.find(d.name, d.start, d.end) for d in definitions}
        named["occurrences"] = [(owner, name, form, written, called, offset(at)) for owner, name, form, written, called, at in _occurrences(code, definitions, starts, heads)]
    return named | {
        "definitions": [(d.kind, d.name, d.qualified_name, d.parent, offset(d.start), offset(d.end), d.visibility) for d in definitions],
        "imports": imports,
        "calls": calls,
        "bases": [(qualified[at], base, n) for at, base, n in bases],
    }


_NAMED = re.compile(r"(?P<dot>\.\s*|::)?(?<![\w$])(?P<name>[A-Za-z_$][\w$]*)(?=(?P<call>\s*!?\()|(?P<write>\s*(?:[-+*/%&|^]|<<|>>|\*\*|:)?=(?![=>]))|)")
_KEYWORDS = frozenset(_NOT_CALLS) | frozenset(
    "class const let var static pub use mod struct enum trait impl interface type package export default async extends implements public private protected internal external view pure payable memory storage calldata "
    "true false null nil undefined this self Self super mut ref where dyn in of do case break continue go defer chan select range map string bool int uint else try finally throw void delete instanceof contract library event error modifier constructor is override virtual pragma solidity as from".split()
)


def _occurrences(code: str, definitions: list[Definition], starts: list[int], heads: set[int]):
    """(owner, name, form, written, called, place) of each name that declares nothing."""
    open_: list[Definition] = []
    at = 0
    for m in _NAMED.finditer(code):
        place = m.start("name")
        while at < len(definitions) and starts[at] <= place:
            while open_ and open_[-1].end <= starts[at]:
                open_.pop()
            open_.append(definitions[at])
            at += 1
        while open_ and open_[-1].end <= place:
            open_.pop()
        if m["name"] in _KEYWORDS or place in heads:
            continue
        owner = next((d.qualified_name for d in reversed(open_) if d.kind in _SCOPES), None)
        yield owner, m["name"], "member" if m["dot"] else "plain", m["write"] is not None, m["call"] is not None, place


def _byte_offsets(text: str):
    if text.isascii():
        return lambda i: i
    sizes = [0]
    for c in text:
        sizes.append(sizes[-1] + len(c.encode("utf-8", "surrogatepass")))
    return lambda i: sizes[i]
