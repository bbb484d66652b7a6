"""Lexers: text to terminal numbers of a grammar, with the offset of each token.

Each returns (tokens, offsets, breaks, error): `breaks` are the tokens before which a
line ends, `error` is the offset of a lexical error or -1.
"""

from __future__ import annotations

import re

Lexed = tuple[list[int], list[int], set[int], int]

_C_COMMENT = r"//[^\n\r]*|/\*[\s\S]*?\*/"


def _words(token: dict[str, int]) -> dict[str, int]:
    """Keywords of a grammar: its literals that are words."""
    return {w: n for w, n in token.items() if re.fullmatch(r"[A-Za-z_]\w*", w) and not (w.isupper() and len(w) > 1)}


def _operators(token: dict[str, int]) -> str:
    marks = sorted((w for w in token if w and not re.fullmatch(r"[$\w]+", w)), key=lambda w: -len(w))
    return "|".join(map(re.escape, marks))


class Python:
    #: Words that a number may be followed by without a space.
    AFTER_NUMBER = ("and", "else", "for", "if", "in", "is", "not", "or")

    def __init__(self, token: dict[str, int]):
        self.token, self.words = token, _words(token)
        self.scan = re.compile(
            r"(?P<space>[ \t\f]+|\\\r?\n)|(?P<comment>\#[^\n\r]*)|(?P<line>\r\n|\n|\r)"
            r"|(?P<string>(?i:[rbuft]{0,2})(?:\"\"\"|'''|\"|'))|(?P<name>[^\W\d]\w*)"
            r"|(?P<number>0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)"
            rf"|(?P<mark>{_operators(token)})"
        ).match
        self.rest = {q: re.compile(p).match for q, p in {'"': r'(?:[^"\\\r\n]|\\(?:\r\n|[\s\S]))*"', "'": r"(?:[^'\\\r\n]|\\(?:\r\n|[\s\S]))*'", '"""': r'(?:[^"\\]|\\[\s\S]|"(?!""))*"""', "'''": r"(?:[^'\\]|\\[\s\S]|'(?!''))*'''"}.items()}

    def _formatted(self, text: str, at: int, quote: str, raw: bool) -> int:
        """End of an f-string whose text begins at `at`, or -1. Fields may hold strings of
        the same quotes; their brackets must match."""
        n, single = len(text), len(quote) == 1
        while at < n:
            if text.startswith(quote, at):
                return at + len(quote)
            c = text[at]
            if c == "\\":
                at += 3 if text.startswith("\r\n", at + 1) else 2
            elif c in "\r\n" and single:
                return -1
            elif c == "{" and text.startswith("{{", at):
                at += 2
            elif c == "{":
                at = self._field(text, at + 1, quote, raw)
                if at < 0:
                    return -1
            elif c == "}":
                if not text.startswith("}}", at):
                    return -1
                at += 2
            else:
                at += 1
        return -1

    def _field(self, text: str, at: int, quote: str, raw: bool) -> int:
        open_, n, empty = [], len(text), True
        while at < n:
            c = text[at]
            if not open_ and c in ":!" and not text.startswith("!=", at) and not text.startswith(":=", at):
                if empty:
                    return -1
                if c == "!":
                    at += 1
                    while at < n and text[at].isalnum():
                        at += 1
                    if at < n and text[at] == "}":
                        return at + 1
                    if at >= n or text[at] != ":":
                        return -1
                # the format: text that may hold fields again
                at += 1
                while at < n and text[at] != "}":
                    if text[at] == "{":
                        at = self._field(text, at + 1, quote, raw)
                        if at < 0:
                            return -1
                    elif text.startswith(quote, at) or (text[at] in "\r\n" and len(quote) == 1):
                        return -1
                    else:
                        at += 1
                return at + 1 if at < n else -1
            if c in "([{":
                open_.append(c)
            elif c in ")]}":
                if c == "}" and not open_:
                    return -1 if empty else at + 1
                if not open_ or open_.pop() + c not in ("()", "[]", "{}"):
                    return -1
            elif c == "#":
                at = text.find("\n", at)
                if at < 0:
                    return -1
            m = self.scan(text, at)
            if m and m.lastgroup == "string":
                at = self._string(text, m)
                if at < 0:
                    return -1
                empty = False
                continue
            if not c.isspace():
                empty = False
            at += 1
        return -1

    def _string(self, text: str, m: re.Match) -> int:
        head = m["string"]
        prefix = head.rstrip("\"'").lower()
        quote = head[len(prefix) :]
        if "".join(sorted(prefix)) not in ("", "r", "b", "u", "f", "t", "br", "fr", "rt"):
            return -1
        if "f" in prefix or "t" in prefix:
            return self._formatted(text, m.end(), quote, "r" in prefix)
        end = self.rest[quote](text, m.end())
        return end.end() if end else -1

    def __call__(self, text: str) -> Lexed:
        token, words, scan = self.token, self.words, self.scan
        NAME, NUM, STR, NEWLINE, INDENT, DEDENT = (token[x] for x in ("NAME", "NUM", "STR", "NEWLINE", "INDENT", "DEDENT"))
        out, at, i, n = [], [], 0, len(text)
        columns, other, depth, fresh = [0], [0], 0, True
        while i < n:
            if fresh and not depth:
                col = tabs = 0
                while i < n and text[i] in " \t\f":
                    c = text[i]
                    col = 0 if c == "\f" else (col // 8 + 1) * 8 if c == "\t" else col + 1
                    tabs = 0 if c == "\f" else tabs + 1
                    i += 1
                if i >= n:
                    break
                if text[i] in "#\r\n":
                    m = scan(text, i)
                    i = m.end()
                    fresh = m.lastgroup == "line"
                    if not fresh:
                        m = scan(text, i)
                        if m and m.lastgroup == "line":
                            i, fresh = m.end(), True
                    continue
                fresh = False
                if col > columns[-1]:
                    if tabs <= other[-1]:
                        return out, at, set(), i
                    columns.append(col)
                    other.append(tabs)
                    out.append(INDENT)
                    at.append(i)
                else:
                    while col < columns[-1]:
                        columns.pop()
                        other.pop()
                        out.append(DEDENT)
                        at.append(i)
                    if col != columns[-1] or tabs != other[-1]:
                        return out, at, set(), i
            m = scan(text, i)
            if m is None:
                return out, at, set(), i
            kind = m.lastgroup
            if kind == "name":
                w = m[0]
                out.append(words.get(w, NAME))
                at.append(i)
            elif kind == "mark":
                w = m[0]
                if w in "([{":
                    depth += 1
                elif w in ")]}":
                    depth = max(0, depth - 1)
                out.append(token[w])
                at.append(i)
            elif kind == "line":
                if not depth:
                    out.append(NEWLINE)
                    at.append(i)
                    fresh = True
            elif kind == "string":
                end = self._string(text, m)
                if end < 0:
                    return out, at, set(), i
                out.append(STR)
                at.append(i)
                i = end
                continue
            elif kind == "number":
                j = m.end()
                if j < n and (text[j].isalnum() or text[j] == "_"):
                    w = scan(text, j)
                    if not w or w.lastgroup != "name" or w[0] not in self.AFTER_NUMBER:
                        return out, at, set(), i
                if re.match(r"0_?\d*[1-9]", m[0]) and m[0].replace("_", "").isdigit():
                    return out, at, set(), i
                out.append(NUM)
                at.append(i)
            i = m.end()
        if depth:
            return out, at, set(), n
        if out and out[-1] not in (NEWLINE, DEDENT):
            out.append(NEWLINE)
            at.append(n)
        out += [DEDENT] * (len(columns) - 1)
        at += [n] * (len(columns) - 1)
        return out, at, set(), -1


class Script:
    """JavaScript and TypeScript, with elements of JSX where the ending allows them."""

    #: After these a slash begins a regular expression and < an element.
    BEFORE_OPERAND = ("return", "typeof", "case", "in", "of", "do", "else", "delete", "void", "throw", "new", "instanceof", "await", "yield", "extends", "default")

    def __init__(self, token: dict[str, int], jsx: bool = False, types: bool = False):
        self.token, self.words, self.jsx, self.types = token, _words(token), jsx, types
        self.scan = re.compile(
            rf"(?P<space>(?:[ \t\v\f ﻿  -   　]|[\n\r  ]|{_C_COMMENT})+)"
            r"|(?P<name>(?:[A-Za-z_$]|[^\x00-\x7f]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:[\w$‌‍]|[^\x00-\x7f]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*)"
            r"|(?P<number>(?:0[xX](?:_?[0-9a-fA-F])+n?|0[bB](?:_?[01])+n?|0[oO](?:_?[0-7])+n?|\d(?:_?\d)*n|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?)(?![\w$]))"
            r"""|(?P<string>"(?:[^"\\\n\r]|\\(?:\r\n|[\s\S]))*"|'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*')"""
            r"|(?P<private>\#[A-Za-z_$][\w$]*)"
            rf"|(?P<mark>{_operators(token)})"
        ).match
        self.template = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(`|\$\{)").match
        self.regex = re.compile(r"/(?![*/])(?:[^/\\\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[A-Za-z]*").match
        self.tag = re.compile(r"<\s*(/?)\s*((?:[A-Za-z_$][\w$\-]*(?:[.:][A-Za-z_$][\w$\-]*)*)?)").match
        self.close = re.compile(r"\s*>").match
        self.starts = re.compile(r"<\s*(?:>|[A-Za-z_$])").match
        self.generic = re.compile(r"<\s*(?:const\s+)?[A-Za-z_$][\w$]*\s*(?:,|extends\b)").match
        self.attribute = re.compile(r"""\s*(?:(/?)\s*>|([A-Za-z_$][\w$\-:]*)(\s*=\s*(?:("[^"]*"|'[^']*')|(?=\{)))?|(?=\{))""").match
        #: newline after these ends the statement
        self.restricted = {token[w] for w in ("return", "break", "continue", "throw") if w in token}

    def __call__(self, text: str) -> Lexed:
        token, words, scan = self.token, self.words, self.scan
        NAME, NUM, STR = token["NAME"], token["NUM"], token["STR"]
        dot, chain, brace = token["."], token["?."], token["{"]
        out, at, breaks, i, n = [], [], set(), 0, len(text)
        if text.startswith("#!"):
            i = (text.find("\n") + 1) or n
        modes: list = []  # what each open { returns to: "" , "`" or the open tags of an element
        operand, line = True, False
        while i < n:
            m = scan(text, i)
            c = text[i]
            if m is None or (c == "/" and m.lastgroup == "mark"):
                if c == "`":
                    e = self.template(text, i + 1)
                    if not e:
                        return out, at, breaks, i
                    out.append(token["TEMPLATE"] if e[1] == "`" else token["HEAD"])
                    at.append(i)
                    if line:
                        breaks.add(len(out) - 1)
                        line = False
                    operand = e[1] != "`"
                    if operand:
                        modes.append("`")
                    i = e.end()
                    continue
                if c == "/" and operand:
                    e = self.regex(text, i)
                    if not e:
                        return out, at, breaks, i
                    out.append(token["REGEX"])
                    at.append(i)
                    if line:
                        breaks.add(len(out) - 1)
                        line = False
                    operand = False
                    i = e.end()
                    continue
                if m is None:
                    return out, at, breaks, i
            kind = m.lastgroup
            if kind == "space":
                if not line:
                    s = m[0]
                    line = "\n" in s or "\r" in s or " " in s or " " in s
                i = m.end()
                if text.startswith("/*", i):
                    return out, at, breaks, i
                if line and out and out[-1] in self.restricted and i < n:
                    out.append(token[";"])
                    at.append(i)
                    operand = True
                continue
            if line:
                if not operand and m[0] in ("++", "--"):
                    # an operand on the line before can't be what this changes
                    out.append(token[";"])
                    at.append(i)
                breaks.add(len(out))
                line = False
            at.append(i)
            if kind == "name":
                w = m[0]
                member = out and (out[-1] == dot or out[-1] == chain)
                out.append(NAME if member else words.get(w, NAME))
                operand = not member and w in self.BEFORE_OPERAND
            elif kind == "number":
                out.append(NUM)
                operand = False
            elif kind == "string":
                out.append(STR)
                operand = False
            elif kind == "private":
                out.append(token["PRIVATE"])
                operand = False
            else:
                w = m[0]
                if w == "{":
                    modes.append("")
                    operand = True
                elif w == "}":
                    mode = modes.pop() if modes else ""
                    if mode == "`":
                        e = self.template(text, i + 1)
                        if not e:
                            return out, at, breaks, i
                        out.append(token["TAIL"] if e[1] == "`" else token["MIDDLE"])
                        operand = e[1] != "`"
                        if operand:
                            modes.append("`")
                        i = e.end()
                        continue
                    out.append(token[w])
                    operand = True
                    i = m.end()
                    if mode:
                        i = self._element(text, i, mode, out, at, modes)
                        if i < 0:
                            return out, at, breaks, at[-1]
                        operand = False if out[-1] == token.get("JSXEND") else True
                    continue
                elif w == "<" and self.jsx and operand and self.starts(text, i) and not (self.types and self.generic(text, i)):
                    out.append(token["JSXSTART"])
                    i = self._element(text, i, ["", []], out, at, modes)
                    if i < 0:
                        return out, at, breaks, at[-1]
                    operand = out[-1] != token["JSXEND"]
                    continue
                else:
                    operand = w not in (")", "]", "++", "--")
                out.append(token[w])
            i = m.end()
        if modes:
            return out, at, breaks, n
        return out, at, breaks, -1

    def _element(self, text: str, i: int, mode: list, out: list, at: list, modes: list) -> int:
        """Scan an element up to its end, or to a { that opens an expression; -1: malformed.

        mode: the name of the tag that is being read, or "", and the names of open tags.
        """
        token, n = self.token, len(text)
        reading, tags = mode

        def ended() -> int:
            out.append(token["JSXEND"])
            at.append(i)
            return i

        def expression() -> int:
            out.append(token["{"])
            at.append(i)
            modes.append([reading, tags])
            return i + 1

        while i < n:
            if reading:
                m = self.attribute(text, i)
                if not m:
                    return -1
                i = m.end()
                if m[1] is None:
                    if i < n and text[i] == "{":
                        return expression()
                    continue
                if m[1] != "/":
                    tags.append(reading[1:])
                elif not tags:
                    return ended()
                reading = ""
                continue
            if tags:
                while i < n and text[i] not in "<{":
                    if text[i] in "}>":
                        return -1
                    i += 1
                if i >= n:
                    return -1
                if text[i] == "{":
                    return expression()
            m = self.tag(text, i)
            if not m:
                return -1
            i = m.end()
            if m[1]:
                close = self.close(text, i)
                if not tags or tags.pop() != m[2] or not close:
                    return -1
                i = close.end()
                if not tags:
                    return ended()
            elif m[2]:
                reading = "<" + m[2]
            elif text.startswith(">", i):
                tags.append("")
                i += 1
            else:
                return -1
        return -1


class Go:
    def __init__(self, token: dict[str, int]):
        self.token, self.words = token, _words(token)
        self.scan = re.compile(
            rf"(?P<space>[ \t\r]+|﻿)|(?P<line>\n)|(?P<comment>{_C_COMMENT})|(?P<name>[^\W\d]\w*)"
            r"|(?P<number>(?:0[xX](?:_?[0-9a-fA-F])*(?:\.(?:[0-9a-fA-F_])*)?(?:[pP][+-]?\d+)?|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d+)?)i?(?!\w))"
            r"""|(?P<string>"(?:[^"\\\n]|\\[^\n])*"|`[^`]*`|'(?:[^'\\\n]|\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[0-7]{3}|[^\n]))')"""
            rf"|(?P<mark>{_operators(token)})"
        ).match
        self.ends = {token[x] for x in ("NAME", "NUM", "STR", "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}")}

    def __call__(self, text: str) -> Lexed:
        token, words, scan, ends, semi = self.token, self.words, self.scan, self.ends, self.token[";"]
        NAME, NUM, STR = token["NAME"], token["NUM"], token["STR"]
        out, at, i, n = [], [], 0, len(text)
        while i < n:
            m = scan(text, i)
            if m is None or (m.lastgroup == "mark" and text.startswith("/*", i)):
                return out, at, set(), i
            kind = m.lastgroup
            if kind == "line" or (kind == "comment" and "\n" in m[0]):
                if out and out[-1] in ends:
                    out.append(semi)
                    at.append(i)
            elif kind not in ("space", "comment"):
                out.append(words.get(m[0], NAME) if kind == "name" else NUM if kind == "number" else STR if kind == "string" else token[m[0]])
                at.append(i)
            i = m.end()
        if out and out[-1] in ends:
            out.append(semi)
            at.append(n)
        return out, at, set(), -1


class Plain:
    """Languages whose line ends mean nothing: Rust and Solidity."""

    def __init__(self, token: dict[str, int], literals: str, nested: bool = False, pragma: bool = False):
        self.token, self.words, self.nested, self.pragma = token, _words(token), nested, pragma
        comment = r"//[^\n\r]*|/\*" if nested else _C_COMMENT
        self.scan = re.compile(rf"(?P<space>[\s﻿]+)|(?P<comment>{comment})|{literals}|(?P<NAME>(?:r\#)?[^\W\d][\w$]*|\$[\w$]*)|(?P<mark>{_operators(token)})").match
        self.marks = re.compile(r"/\*|\*/").finditer

    def __call__(self, text: str) -> Lexed:
        token, words, scan = self.token, self.words, self.scan
        out, at, i, n = [], [], 0, len(text)
        if text.startswith("#!") and not text.startswith("#!["):
            i = (text.find("\n") + 1) or n
        while i < n:
            m = scan(text, i)
            if m is None or (m.lastgroup == "mark" and text.startswith("/*", i)):
                return out, at, set(), i
            kind, end = m.lastgroup, m.end()
            if kind == "comment":
                if self.nested and m[0] == "/*":
                    depth, end = 0, -1
                    for c in self.marks(text, i):
                        depth += 1 if c[0] == "/*" else -1
                        if not depth:
                            end = c.end()
                            break
                    if end < 0:
                        return out, at, set(), i
            elif kind != "space":
                if kind == "NAME":
                    out.append(words.get(m[0], token["NAME"]))
                elif kind == "raw":
                    close = '"' + m[0].lstrip("brc")[:-1]
                    end = text.find(close, m.end())
                    if end < 0:
                        return out, at, set(), i
                    end += len(close)
                    out.append(token["STR"])
                elif kind == "mark":
                    out.append(token[m[0]])
                else:
                    out.append(token[kind])
                at.append(i)
                if self.pragma and m[0] == "pragma":
                    stop = text.find(";", end)
                    if stop < 0 or "{" in text[end:stop]:
                        return out, at, set(), i
                    end = stop
            i = end
        return out, at, set(), -1


RUST_LITERALS = (
    r"""(?P<raw>(?:r|br|cr)\#*")|(?P<STR>[bc]?"(?:[^"\\]|\\[\s\S])*"|b?'(?:[^'\\\n\r\t]|\\(?:x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]+\}|[^\n]))')|(?P<LIFETIME>'[^\W\d]\w*)"""
    r"|(?P<NUM>(?:0x[0-9a-fA-F_]+|0b[01_]+|0o[0-7_]+|\d[\d_]*(?:\.(?![.\w])|\.\d[\d_]*)?(?:[eE][+-]?[\d_]+)?)(?:[iu](?:8|16|32|64|128|size)|f32|f64)?(?!\w))"
)
SOLIDITY_LITERALS = (
    r"""(?P<STR>(?:hex|unicode)?(?:"(?:[^"\\\n\r]|\\(?:\r\n|[\s\S]))*"|'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*'))"""
    r"|(?P<NUM>(?:0[xX][0-9a-fA-F_]+|(?:\d[\d_]*)?\.?\d[\d_]*(?:[eE]-?\d[\d_]*)?)(?![\w$]))"
)
