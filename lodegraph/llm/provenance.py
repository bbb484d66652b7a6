"""Source files that nobody wrote by hand: generated, minified, vendored, or data.

1. Repositories declare such paths in attribute files (one glob and its attributes per
   line). Globs are resolved as their format has it: a file in a deeper directory beats
   one above it, a later line an earlier one, and an attribute can be taken back.
2. Contents show what a file is: a header that its generator wrote, the notice of a
   released library, lines as a minifier leaves them, tables of numbers or encoded bytes,
   lines that are the same but for their numbers. Where the size of the syntax tree is
   known, a tree with too many nodes a line shows a minified file.
3. Equivalent globs are mined: directories named as a library whose release notice stands
   in files of several repositories, and file endings and directories whose files the
   contents and declarations of several repositories mark without exception. For each
   repository the latter are mined from the others only.
4. Repositories that declare nothing get the public conventions and the mined globs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.storage import materialize

#: What an attribute says about a file. Fixed values.
ATTRIBUTES = {"linguist-generated": "generated", "linguist-vendored": "vendored", "generated": "generated", "vendored": "vendored", "minified": "minified"}
ATTRIBUTE_FILE = ".gitattributes"

#: Public conventions, as an attribute file of the root directory. Fixed values.
CONVENTIONS = """
**/node_modules/** linguist-vendored
**/bower_components/** linguist-vendored
**/jspm_packages/** linguist-vendored
**/vendor/** linguist-vendored
**/vendors/** linguist-vendored
**/_vendor/** linguist-vendored
**/third_party/** linguist-vendored
**/third-party/** linguist-vendored
**/thirdparty/** linguist-vendored
**/3rdparty/** linguist-vendored
**/extern/** linguist-vendored
**/external/** linguist-vendored
**/externals/** linguist-vendored
**/site-packages/** linguist-vendored
**/dist-packages/** linguist-vendored
**/Godeps/** linguist-vendored
**/Pods/** linguist-vendored
**/Carthage/** linguist-vendored
**/gen/** linguist-generated
**/generated/** linguist-generated
**/__generated__/** linguist-generated
*_pb2.py linguist-generated
*_pb2_grpc.py linguist-generated
*_pb2.pyi linguist-generated
*.pb.go linguist-generated
*.pb.gw.go linguist-generated
*_gen.go linguist-generated
*.gen.go linguist-generated
*_mock.go linguist-generated
zz_generated.* linguist-generated
*_string.go linguist-generated
*.gen.js linguist-generated
*.gen.ts linguist-generated
*.generated.* linguist-generated
*_pb.js linguist-generated
*_pb.ts linguist-generated
*_pb.d.ts linguist-generated
*_grpc_pb.js linguist-generated
*.d.ts linguist-generated
*.g.dart linguist-generated
*.pb.rs linguist-generated
*.pb.cc linguist-generated
*.pb.h linguist-generated
*.min.js minified
*-min.js minified
*.min.mjs minified
*.min.cjs minified
*.bundle.js minified
*.chunk.js minified
"""

#: What generators write on top of their files. Fixed values.
GENERATED_NOTE = (
    r"(?:@generated\b|<auto-?generated\b|code generated (?:by|from|with)\b|(?:this )?(?:file|code|module) (?:is|was|has been) (?:auto(?:matically)?[- ]?|machine[- ]?)?generated\b"
    r"|(?:auto(?:matically)?|machine)[- ]?generated (?:by|from|file|code)\b|autogenerated\b|generated (?:by|from|with|using) (?:the )?[\w.@/\-]+[ .,].*\b(?:do not|don't|not be) (?:edit|modif|change)|generated (?:by|from) [\w.\-]+\s*$)"
)
HEADER = re.compile(rf"(?im)^[ \t]*(?:#|//+!?|/\*+!?|\*+|--|;+|%+|<!--)[ \t]*{GENERATED_NOTE}")
#: The top of a file: comments and what may stand above or between them. A generator's
#: note must stand in it.
_ABOVE = re.compile(
    r"""(?x)\ufeff? (?> \s+ | \#! \[? [^\n]* | (?:\#|//|--|;|%) [^\n]* | /\* (?> [^*]+ | \*(?!/) )* (?:\*/|\Z) | <!-- (?> [^-]+ | -(?!->) )* (?:-->|\Z)
    | <\?(?:php|xml)[^\n]* | package\ [\w.]+;? | ["']use\ [\w ]+["'];? )*"""
)
#: Notice of a released library: name and version, then an address or a licence.
RELEASE = re.compile(r"""\A\ufeff?(?:\#!.*\n)?\s*(?:/\*!|/\*\*?|\"\"\"|'''|\#|//)[\s*\#/!]*(?P<name>[@\w.\-/ ]{1,60}?)[ @]v?\d+(?:\.\d+)+[\w.\-+]*\b(?P<rest>[^\n]*(?:\n[^\n]*){0,4})""")
LICENSED = re.compile(r"(?i)\breleased under\b|\blicen[cs]ed under\b|\|\s*(?:\(c\).*\|)?\s*(?:MIT|BSD|Apache|ISC|MPL|GPL|LGPL)\b|\b(?:MIT|BSD|Apache|ISC) licen[cs]e")
_CELLS = re.compile(r"""\s*+(?:(?>0x[0-9a-fA-F]+|[-+]?\d[\d_.eE+\-]*+[uUlLfFn]{0,3}+|b?"[A-Za-z0-9+/=\\_\-]{32,}"|b?'[A-Za-z0-9+/=\\_\-]{32,}')\s*+[,;+\\]?\s*+)++""")

#: Share of a file's characters in lines that are table cells, above which it is data.
DATA_SHARE = 0.5
#: A minified file has most characters in lines longer than this, its strings and comments
#: aside, and little space in them.
LONG_LINE, LONG_SHARE, SPACE_SHARE = 300, 0.5, 0.1
_WORDS = re.compile(r"""(?m)"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|^[ \t]*(?://|\#|\*|/\*|--).*$""")
#: A file of at least so many lines is written by a tool if more than this share of them
#: are equal but for their numbers.
SAME_LINES, SAME_SHARE = 20, 0.5
_DIGITS = re.compile(r"\d+")
#: Nodes of its syntax tree for each line, and characters, above which a file is minified.
NODES_A_LINE, CHARACTERS_A_LINE = 100, 300
#: Contents shorter than this prove nothing by being equal.
EQUAL_LENGTH = 120
#: A glob is mined from so many marked files in so many repositories, and only where these
#: are at least this share of the repositories that hold files under it.
MINED_FILES, MINED_REPOS, MINED_SHARE = 8, 3, 0.5
#: A directory is named as a library if notices of so many repositories name the library.
NOTICE_REPOS = 3
#: What is judged: code, not documents, configuration or images. Fixed values.
SOURCE_ENDINGS = (
    "py", "pyi", "pyx", "go", "js", "jsx", "mjs", "cjs", "ts", "tsx", "mts", "cts", "rs", "sol", "java", "kt", "kts", "scala", "groovy", "c", "h", "cc", "cpp", "cxx", "hh", "hpp", "m", "mm", "cs", "fs", "vb",
    "rb", "php", "swift", "dart", "lua", "pl", "pm", "r", "jl", "ex", "exs", "erl", "hs", "ml", "mli", "clj", "el", "sh", "bash", "zsh", "ps1", "sql", "proto", "css", "scss", "less", "html", "htm", "vue", "svelte", "asm", "s", "v", "vhd",
)


def library_name(text: str) -> str | None:
    """The library whose release notice stands on top of a file."""
    m = RELEASE.match(text)
    return m["name"].strip().lower() if m and LICENSED.search(m[0]) else None


def _repeated(lines: list[str]) -> bool:
    """Whether most lines differ from each other in their numbers only, as a tool writes
    them."""
    full = [x.strip() for x in lines if x and not x.isspace()]
    if len(full) < SAME_LINES:
        return False
    counts: dict[str, int] = {}
    for x in set(full):
        x = _DIGITS.sub("0", x)
        counts[x] = counts.get(x, 0) + 1
    most = max(counts, key=counts.__getitem__)
    return counts[most] > SAME_SHARE * len(full) and any(c.isalpha() for c in most)


def verdict(text: str | None) -> str | None:
    """generated, vendored, minified or data, as the content shows; None if it doesn't."""
    if not text:
        return None
    if HEADER.search(text, 0, _ABOVE.match(text).end()):
        return "generated"
    if library_name(text) is not None:
        return "vendored"
    lines = text.split("\n")
    if any(len(x) > LONG_LINE for x in lines):
        code = _WORDS.sub("''", text)
        packed = [x for x in code.split("\n") if len(x) > LONG_LINE]
        size = sum(map(len, packed))
        if size >= LONG_SHARE * len(code) and sum(x.count(" ") + x.count("\t") for x in packed) <= SPACE_SHARE * size:
            return "minified"
    body = sum(map(len, lines))
    if body and sum(len(x) for x in lines if _CELLS.fullmatch(x)) > DATA_SHARE * body:
        return "data"
    return "generated" if _repeated(lines) else None


class Rule(NamedTuple):
    match: re.Pattern
    says: dict[str, bool]


def glob_pattern(glob: str) -> re.Pattern:
    """A glob of an attribute file, for paths relative to the directory of that file.

    Without a slash it matches base names at any depth; a slash at its front or inside
    anchors it to that directory, unless it begins with `**/`.
    """
    anywhere = "/" not in glob
    glob = glob.lstrip("/")
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        elif glob[i] == "[" and (end := glob.find("]", i + 2)) > 0:
            out, i = out + "[" + glob[i + 1 : end].replace("!", "^", 1) + "]", end + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return re.compile(("(?:.*/)?" if anywhere else "") + out)


_FIELDS = re.compile(r'"((?:[^"\\]|\\.)*)"|(\S+)')


def parse_attributes(text: str) -> list[Rule]:
    """Rules of an attribute file, in order. `-name`, `!name` and `name=false` take back.

    A pattern may stand in quotes; `[attr]name ...` defines a macro, which sets what it
    lists wherever it is set.
    """
    rules, macros = [], {}
    for line in text.splitlines():
        line = line.strip()
        words = [m[1].encode("latin-1", "backslashreplace").decode("unicode_escape") if m[2] is None else m[2] for m in _FIELDS.finditer(line)]
        if not words or line.startswith("#"):
            continue
        if line.startswith("[attr]"):
            macros[words[0][6:]] = words[1:]
            continue
        says, todo, expanded = {}, words[:0:-1], set()
        while todo:
            word = todo.pop()
            name, _, value = word.lstrip("-!").partition("=")
            holds = word[0] not in "-!" and value.lower() not in ("false", "0", "no")
            if name in ATTRIBUTES:
                says[ATTRIBUTES[name]] = holds
            elif holds and name not in expanded:
                expanded.add(name)
                todo += macros.get(name, [])[::-1]
        if says:
            rules.append(Rule(glob_pattern(words[0]), says))
    return rules


def declared(path: str, files: list[tuple[str, list[Rule]]]) -> dict[str, bool]:
    """What attribute files (directory, rules), from the root down, say about a path."""
    out: dict[str, bool] = {}
    for directory, rules in files:
        if directory and not path.startswith(directory + "/"):
            continue
        inside = path[len(directory) + 1 :] if directory else path
        for rule in rules:
            if rule.match.fullmatch(inside):
                out |= rule.says
    return out


def path_globs(path: str) -> list[str]:
    """Globs that a path could be declared by: its ending, with numbers and hashes
    generalised, and its directories."""
    *dirs, base = path.split("/")
    ending = re.search(r"(?:[.\-_][A-Za-z0-9]+)?(?:\.[A-Za-z0-9]+)$", base)
    globs = [f"{d}/**" for d in set(dirs)]
    if ending:
        globs.append("*" + re.sub(r"[0-9a-f]{8,}", lambda m: "[0-9a-f]" * len(m[0]), ending[0]))
    return globs


def _optional(df: DataFrame, name: str, kind: str) -> Column:
    """The column, or nulls where a table lacks it."""
    return (F.col(name) if name in df.columns else F.lit(None)).cast(kind)


def _contents(index: DataFrame, versions: DataFrame, captured: DataFrame) -> DataFrame:
    """(repo_id, path, hash, verdict, library, text, at): every path with what its contents
    show, and the texts of attribute files with the time of their capture.

    Contents are judged where they are read; only verdicts are joined.
    """
    shape = "key {0}, hash string, verdict string, library string, n_lines long, n_chars long, text string"

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [None if x is None else x if isinstance(x, str) else bytes(x).decode("utf-8", "replace") for x in pdf["content"]]
            verdicts = list(map(verdict, texts))
            yield pd.DataFrame(
                {
                    "key": pdf["key"],
                    "hash": [h if t and len(t) >= EQUAL_LENGTH else None for h, t in zip(pdf["hash"], texts)],
                    "verdict": verdicts,
                    "library": [library_name(t) if v == "vendored" else None for t, v in zip(texts, verdicts)],
                    "n_lines": [t.count("\n") + 1 if t else 0 for t in texts],
                    "n_chars": [len(t) if t else 0 for t in texts],
                    "text": [t if keep else None for t, keep in zip(texts, pdf["keep"])],
                }
            )

    read = versions.select(F.col("id").alias("key"), F.sha2(F.col("raw_content"), 256).alias("hash"), F.col("raw_content").alias("content"), F.lit(False).alias("keep"))
    judged = read.mapInPandas(judge, shape.format("long")).drop("text").distinct()
    paths = index.groupBy("repo_id", F.col("rel_path").alias("path"), F.col("file_version_id").alias("key")).agg(F.max(_optional(index, "node_count", "long")).alias("nodes"))
    # a row without a tree, or without its content, leaves the verdict as it is
    packed = (F.col("nodes") > NODES_A_LINE * F.col("n_lines")) & (F.col("n_chars") > CHARACTERS_A_LINE * F.col("n_lines"))
    shown = F.when(F.col("verdict").isNull() & packed, "minified").otherwise(F.col("verdict"))
    nothing = F.lit(None)
    indexed = paths.join(judged, "key", "left").select("repo_id", "path", "hash", shown.alias("verdict"), "library", nothing.cast("string").alias("text"), nothing.cast("timestamp").alias("at"))
    regular = captured.filter("mode IS NULL OR mode NOT IN ('120000', '160000')")
    is_rules = (F.col("path") == ATTRIBUTE_FILE) | F.col("path").endswith("/" + ATTRIBUTE_FILE)
    raw = regular.select(F.struct("repo_id", "path", _optional(regular, "captured_at", "timestamp").alias("at")).alias("key"), F.sha2(F.col("content"), 256).alias("hash"), "content", is_rules.alias("keep"))
    seen = raw.mapInPandas(judge, shape.format("struct<repo_id:bigint,path:string,at:timestamp>"))
    at = F.when(F.col("text").isNotNull(), F.col("key.at"))
    return indexed.unionByName(seen.select("key.repo_id", "key.path", "hash", "verdict", "library", "text", at.alias("at")).distinct())


def _rules_above(paths: DataFrame, files: DataFrame) -> DataFrame:
    """(repo_id, path, attributes): the attribute files in the directories above each path
    that has any, from the root down. Of several captures of one the latest is valid, so a
    path gathers as many as it has directories."""
    texts = files.filter(F.col("text").isNotNull()).groupBy("repo_id", F.regexp_replace("path", r"/?[^/]+$", "").alias("dir")).agg(F.max(F.struct("at", "text")).alias("_r"))
    rules = texts.select("repo_id", "dir", F.col("_r.text").alias("text"))
    parts = F.split("path", "/")
    dirs = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    declaring = paths.select("repo_id", "path").distinct().join(rules.select("repo_id").distinct(), "repo_id", "left_semi")
    above = declaring.select("repo_id", "path", F.explode(dirs).alias("dir")).join(rules, ["repo_id", "dir"])
    return above.groupBy("repo_id", "path").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.length("dir"), "dir", "text"))), lambda x: F.struct(x["dir"].alias("dir"), x["text"].alias("text"))).alias("attributes"))


def _libraries(files: DataFrame) -> DataFrame:
    """(library): what release notices of at least NOTICE_REPOS repositories name."""
    named = files.filter(F.col("library").isNotNull()).select("library", "repo_id").distinct()
    return named.groupBy("library").agg(F.count("*").alias("repos")).filter(F.col("repos") >= NOTICE_REPOS).select("library")


def _by_mined(judged: DataFrame) -> DataFrame:
    """(repo_id, path, kinds, denied): unmarked paths that a mined glob covers.

    Under a glob, a repository is for it where all of its paths are marked, against it
    where only some are or a mark is taken back, and silent where it shows nothing. The
    globs for a repository come from all others: none is against, and those for it are
    enough by MINED_FILES, MINED_REPOS and MINED_SHARE. A mark that rests on a public
    convention alone is no evidence of another glob.
    """

    @F.pandas_udf("array<string>")
    def globs(paths: pd.Series) -> pd.Series:
        return paths.map(path_globs)

    marked = judged.withColumn("mark", F.try_element_at(F.array_except("kinds", "denied"), F.lit(1)))
    candidates = marked.filter(F.col("shown") | F.col("mark").isNull()).withColumn("glob", F.explode(globs("path")))
    taken_back = F.col("mark").isNull() & (F.size("denied") > 0)
    counts = candidates.groupBy("glob", "repo_id").agg(F.count("*").alias("n"), F.count("mark").alias("yes"), F.max(taken_back).alias("no"), F.min("mark").alias("mined"))
    is_for = F.col("n") == F.col("yes")
    counts = counts.withColumn("stand", F.when(is_for, "for").when((F.col("yes") > 0) | F.col("no"), "against").otherwise("silent"))
    counts = materialize(counts, "prov-globs")
    of = lambda stand, value: F.sum(F.when(F.col("stand") == stand, value).otherwise(0))
    over_all = counts.groupBy("glob").agg(of("for", F.col("n")).alias("files"), of("for", F.lit(1)).alias("repos"), of("against", F.lit(1)).alias("against"), of("silent", F.lit(1)).alias("silent"), F.min(F.when(F.col("stand") == "for", F.col("mined"))).alias("mined"))
    mined = over_all.filter((F.col("files") >= MINED_FILES) & (F.col("repos") >= MINED_REPOS) & (F.col("against") <= 1))
    # a repository with an unmarked path is not for the glob, so it has no part in files and repos
    open_to = counts.filter("stand <> 'for'").select("glob", "repo_id", "stand").join(mined, "glob")
    silent = F.col("silent") - (F.col("stand") == "silent").cast("int")
    covered = open_to.filter((F.col("against") == (F.col("stand") == "against").cast("int")) & (F.col("repos") >= MINED_SHARE * (F.col("repos") + silent)))
    return candidates.filter(F.size("kinds") == 0).join(covered.select("glob", "repo_id", "mined"), ["glob", "repo_id"]).select("repo_id", "path", F.array("mined").alias("kinds"), "denied")


def classify_files(index: DataFrame, versions: DataFrame, captured: DataFrame) -> DataFrame:
    """(repo_id, path, kinds) of the files that are not hand-written source.

    `kinds` is a sorted array of generated, vendored, minified and data. A path counts
    once, with what any of its contents shows. Null paths are left out; a null content
    is judged by its path alone. Documents, configuration and images are no source.
    """
    return explain_files(index, versions, captured).select("repo_id", "path", "kinds")


def explain_files(index: DataFrame, versions: DataFrame, captured: DataFrame) -> DataFrame:
    """(repo_id, path, kinds, reasons): as classify_files; `reasons` is a sorted array of
    declared, convention, library, glob (mined), content and copy."""
    files = _contents(index, versions, captured).filter(F.col("path").isNotNull())
    ending = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    files = materialize(files.filter(ending.isin(*SOURCE_ENDINGS) | F.col("text").isNotNull()), "prov-files")
    conventions = parse_attributes(CONVENTIONS)

    def resolve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parsed: dict[str, list[Rule]] = {}
        for pdf in batches:
            by_path, denied, by_own = [], [], []
            for path, files_above in zip(pdf["path"], pdf["attributes"]):
                own = []
                for f in files_above if files_above is not None else []:
                    if f["text"] not in parsed:
                        parsed[f["text"]] = parse_attributes(f["text"])
                    own.append((f["dir"], parsed[f["text"]]))
                said = declared(path, [("", conventions), *own])
                by_path.append(sorted(k for k, yes in said.items() if yes))
                denied.append(sorted(k for k, yes in said.items() if not yes))
                by_own.append(any(declared(path, own).values()))
            yield pdf.drop(columns="attributes").assign(by_path=by_path, denied=denied, by_own=by_own)

    sources = files.filter(F.col("text").isNull()).drop("text", "at")
    resolved = sources.join(_rules_above(sources, files), ["repo_id", "path"], "left").mapInPandas(
        resolve, "repo_id long, path string, hash string, verdict string, library string, by_path array<string>, denied array<string>, by_own boolean"
    )
    resolved = materialize(resolved, "prov-resolved")

    # a directory named as a library that notices name; its files count as shown
    inside = resolved.select("repo_id", "path", F.explode(F.split(F.lower(F.regexp_replace("path", r"/?[^/]+$", "")), "/")).alias("library"))
    inside = inside.join(_libraries(resolved), "library", "left_semi").select("repo_id", "path").distinct().withColumn("of_library", F.lit("vendored"))
    # copies of a released library's file are the library's, wherever they lie
    foreign = resolved.filter((F.array_contains("by_path", "vendored") | (F.col("verdict") == "vendored")) & F.col("hash").isNotNull()).select("hash").distinct().withColumn("copied", F.lit("vendored"))
    judged = resolved.join(inside, ["repo_id", "path"], "left").join(foreign, "hash", "left")
    evident = F.array_distinct(F.array_compact(F.concat("by_path", F.array("verdict", "copied", "of_library"))))
    shown = F.col("by_own") | F.col("verdict").isNotNull() | F.col("copied").isNotNull() | F.col("of_library").isNotNull()
    by_convention = (F.size("by_path") > 0) & ~F.col("by_own")
    why = {"declared": F.col("by_own"), "convention": by_convention, "library": F.col("of_library").isNotNull(), "content": F.col("verdict").isNotNull(), "copy": F.col("copied").isNotNull() & (F.size("by_path") == 0) & F.col("verdict").isNull()}
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in why.items()]))
    judged = materialize(judged.select("repo_id", "path", evident.alias("kinds"), "denied", shown.alias("shown"), reasons.alias("reasons")), "prov-judged")
    marked = judged.filter(F.size("kinds") > 0).select("repo_id", "path", "kinds", "denied", "reasons")
    every = marked.unionByName(_by_mined(judged).withColumn("reasons", F.array(F.lit("glob"))))
    kept = every.select("repo_id", "path", "reasons", F.explode(F.array_except("kinds", "denied")).alias("kind"))
    return kept.groupBy("repo_id", "path").agg(F.array_sort(F.collect_set("kind")).alias("kinds"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("reasons")))).alias("reasons"))
