"""Which grammar and lexer a file ending stands for, and the check of one text."""

from __future__ import annotations

from lodegraph.llm.syntax import grammars, lexers
from lodegraph.llm.syntax.glr import Tables

#: File endings. Fixed values.
ENDINGS = {"py": "python", "js": "javascript", "cjs": "javascript", "mjs": "javascript", "jsx": "jsx", "ts": "typescript", "tsx": "tsx", "go": "go", "rs": "rust", "sol": "solidity"}
GRAMMARS = {"python": grammars.PYTHON, "javascript": grammars.JAVASCRIPT, "typescript": grammars.TYPESCRIPT, "go": grammars.GO, "rust": grammars.RUST, "solidity": grammars.SOLIDITY}
GRAMMAR_OF = {"jsx": "javascript", "tsx": "typescript"}

_TABLES: dict[str, Tables] = {}
_CHECKS: dict[str, Language] = {}


def tables(grammar: str) -> Tables:
    if grammar not in _TABLES:
        _TABLES[grammar] = Tables(grammars.with_leaves(GRAMMARS[grammar]))
    return _TABLES[grammar]


class Language:
    def __init__(self, name: str):
        self.tables = t = tables(GRAMMAR_OF.get(name, name))
        self.script = name in ("javascript", "jsx", "typescript", "tsx")
        if self.script:
            self.lex = lexers.Script(t.token, jsx=name in ("jsx", "tsx"), types=name in ("typescript", "tsx"))
        else:
            self.lex = {
                "python": lambda: lexers.Python(t.token),
                "go": lambda: lexers.Go(t.token),
                "rust": lambda: lexers.Plain(t.token, lexers.RUST_LITERALS, nested=True),
                "solidity": lambda: lexers.Plain(t.token, lexers.SOLIDITY_LITERALS, pragma=True),
            }[name]()

    def error(self, text: str) -> int:
        """Offset of the first error that no repair of what follows can mend, or -1."""
        text = text.removeprefix("﻿")
        tokens, offsets, breaks, bad = self.lex(text)
        if self.script:
            token = self.tables.token
            at = self.tables.parse(tokens, breaks, token[";"], token["}"])
        else:
            at = self.tables.parse(tokens)
        if at >= len(tokens):
            # the tokens are a whole file or break off: then the lexer's error, if any, is first
            return bad if bad >= 0 else len(text)
        if at >= 0 and (bad < 0 or offsets[at] <= bad):
            return offsets[at]
        return bad


def language_of(path: str | None) -> str | None:
    return ENDINGS.get(path.rsplit(".", 1)[-1].lower()) if path and "." in path.rsplit("/", 1)[-1] else None


def checker(language: str) -> Language:
    if language not in _CHECKS:
        _CHECKS[language] = Language(language)
    return _CHECKS[language]


def first_error(text: str, language: str) -> tuple[int, int, str] | None:
    """(line from 1, column from 1, what stands there) of the first error; None if valid."""
    at = checker(language).error(text)
    if at < 0:
        return None
    text = text.removeprefix("﻿")
    line = text.count("\n", 0, at) + 1
    start = text.rfind("\n", 0, at) + 1
    return line, at - start + 1, text[at : at + 24].split("\n", 1)[0] if at < len(text) else "end of file"
