"""Path functions of sources and import resolution."""

from __future__ import annotations

import posixpath
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Languages by file ending. Fixed values.
LANGUAGE_ENDINGS = {"py": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "rs": "rust", "sol": "solidity"}
#: Directories that are never walked: those of tools, then those that hold the dependencies
#: of each language. Fixed values.
TOOL_DIRECTORIES = (".git", ".hg", ".svn", "__pycache__", ".pytest_cache", ".mypy_cache", ".ruff_cache")
DEPENDENCY_DIRECTORIES = {
    "python": ("venv", ".venv", "site-packages", "env", ".env"),
    "solidity": ("lib", "node_modules", "out", "cache", "artifacts"),
    "go": ("vendor",),
    "rust": ("target",),
    "javascript": ("node_modules", "dist", "build", "out", "coverage", ".next", ".nuxt"),
    "typescript": ("node_modules", "dist", "build", "out", "coverage", ".next", ".nuxt"),
}
IGNORED_DIRECTORIES = tuple(dict.fromkeys([*TOOL_DIRECTORIES, *[d for ds in DEPENDENCY_DIRECTORIES.values() for d in ds]]))


def language_of_path(path: str | Column) -> Column:
    """Language of a path's ending; null for others."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGE_ENDINGS.items() for x in pair])
    return F.element_at(table, F.lower(F.regexp_extract(path, r"[^/]\.([A-Za-z0-9]+)$", 1)))


def glob_regex(glob: str) -> str:
    """A shell glob as a regular expression for the whole string; * crosses slashes."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            body = glob[i + 1 : end]
            out += "[" + ("^" + body[1:] if body.startswith("!") else body).replace("\\", "\\\\") + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"^(?:{out})$"


def excluded(path: str | Column, patterns: list[str]) -> Column:
    """Whether a relative path matches an exclusion: a pattern with a slash is held
    against the whole path, one without against each of its components."""
    p = F.col(path) if isinstance(path, str) else path
    whole = [glob_regex(x) for x in patterns if "/" in x]
    parts = [glob_regex(x) for x in patterns if "/" not in x]
    out = p.rlike("|".join(whole)) if whole else F.lit(False)
    return out | F.exists(F.split(p, "/"), lambda part: part.rlike("|".join(parts))) if parts else out


def walked(path: str | Column, excludes: list[str] = (), ignored: tuple[str, ...] = IGNORED_DIRECTORIES) -> Column:
    """Whether a walk reaches a path: a known language, no hidden or ignored directory, no exclusion."""
    p = F.col(path) if isinstance(path, str) else path
    dirs = F.slice(F.split(p, "/"), 1, F.greatest(F.size(F.split(p, "/")) - 1, F.lit(0)))
    pruned = F.exists(dirs, lambda d: d.startswith(".") | d.isin(*ignored))
    return language_of_path(p).isNotNull() & ~pruned & ~excluded(p, list(excludes))


def normalize_relative(base_dir: str, specifier: str) -> str:
    """A relative specifier as a path of the repository; steps above its root are dropped."""
    return posixpath.normpath(f"/{base_dir}/{specifier}").lstrip("/")


#: Endings that an import may leave out, in the order in which they are tried. Fixed values.
NODE_ENDINGS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")


def node_paths(path: str | Column) -> Column:
    """array<struct<priority, path>>: what an import of a path may mean: the path as it is,
    with an ending, or the index of a directory."""
    p = F.col(path) if isinstance(path, str) else path
    tried = [p, *[F.concat(p, F.lit(f"{inner}{e}")) for inner in ("", "/index") for e in NODE_ENDINGS]]
    return F.array(*[F.struct(F.lit(i).alias("priority"), t.alias("path")) for i, t in enumerate(tried)])


def node_candidates(path: str) -> list[str]:
    """The same as a list."""
    return [f"{path}{rest}" for rest in ("", *NODE_ENDINGS, *(f"/index{e}" for e in NODE_ENDINGS))]


def package_name(specifier: str | Column) -> Column:
    """Package of a bare import: its first segment, with a scope its first two."""
    return F.regexp_extract(specifier, r"^(@[^/]*/?[^/]*|[^/]*)", 1)


def package_of_specifier(specifier: str) -> str:
    return re.match(r"@[^/]*(?:/[^/]*)?|[^/]*", specifier)[0]


def dotted_module(path: str) -> str | None:
    """Python module name of a path; None for other files and for the root's own __init__."""
    stem, ending = posixpath.splitext(path)
    steps = stem.split("/")
    return ".".join(steps[:-1] if steps[-1] == "__init__" else steps) or None if ending == ".py" else None
