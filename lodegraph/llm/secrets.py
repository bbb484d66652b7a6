"""Credentials in captured files: find every one, and redact it in place.

1. Every literal that is assigned, passed or embedded in a file is indexed once, with its
   place and the repository (owner) that holds it, over the whole corpus.
2. Literals of many owners are placeholders and are suppressed, whatever they say and
   however they are spelled; no list of words decides it.
3. Rare literals are confirmed by the name they are bound to or by their structure, unless
   they only refer to a variable or a secret store.
4. Every file is scanned once more with an automaton over the confirmed values, so a value
   confirmed in one place is found wherever else it stands. More values than one automaton
   holds are dealt to the files that hold their longest word, by a join.
"""

from __future__ import annotations

import base64
import binascii
import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.storage import materialize

#: A literal of more owners than this share of all owners, and than MIN_OWNERS, is a placeholder.
OWNER_SHARE = 0.1
MIN_OWNERS = 3
#: Confirmed values in one automaton that is sent to every task.
BLOCK_VALUES = 100_000
#: Shorter values are found by their context only.
SCANNED_LENGTH = 8
MASK = "REDACTED"

#: Endings of names that credentials are bound to. Fixed values.
SECRET_ENDINGS = ("password", "passwd", "passphrase", "pwd", "secret", "apikey", "authtoken", "accesstoken", "privatetoken", "refreshtoken", "bottoken", "apitoken", "secretkey", "signingkey", "encryptionkey", "accesskey", "accountkey", "storagekey", "masterkey", "saskey", "privatekey", "authkey", "sharedkey", "credential", "credentials", "secrettoken")
#: Names that are credentials only with a strong value.
WEAK_NAMES = ("token", "pass", "pw", "key", "cred", "auth")
NOT_SECRET = re.compile(r"(public|page|next|cursor|csrf|primary|foreign|sort|partition|cache|index|lookup|by)(key|token|pass)$")
CODE = (".py", ".go", ".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx", ".rs", ".sol", ".java", ".rb", ".c", ".h", ".cpp", ".cs", ".php", ".kt", ".swift")

#: Values that refer to a credential kept elsewhere, or say that there is none. Fixed values.
REFERENCE = re.compile(
    r"""(?ix) ^(?: none | null | nil | true | false | undefined
    | (?: vault | secretref | secretsmanager | ssm | keyvault | op | env | file | arn | aws | gcp | sops | ref ) [:/#] .*
    | <.*> | \[.*\] | \{.*\} | \$ .* | %\w+% | %\(.*\)s | \{\{.* | enc\(.*\) | (?:process|os)\.env.* | (?>.*?\$\{).*\}.* | (?>.*?\{\{).*\}\}.* | @.*@ | \#\{.* | !\w+ .* )$"""
)

STRUCTURED = re.compile(
    r"""(?x) (?<![A-Za-z0-9_]) (?:
      (?:AKIA|ASIA)[A-Z0-9]{16} (?![A-Za-z0-9])
    | gh[pousr]_[A-Za-z0-9]{36,} | github_pat_[A-Za-z0-9_]{50,} | glpat-[A-Za-z0-9_\-]{20}
    | xox[abeoprs]-[A-Za-z0-9\-]{20,} | [srp]k_live_[A-Za-z0-9]{16,} | AIza[A-Za-z0-9_\-]{35} | npm_[A-Za-z0-9]{36}
    | SG\.[\w\-]{16,}\.[\w\-]{30,} | pypi-[\w\-]{50,} | sk-[A-Za-z0-9_\-]{32,} | hvs\.[\w\-]{24,} | dop_v1_[0-9a-f]{64} | shp(?:at|ss|ca)_[0-9a-fA-F]{32}
    | eyJ[\w\-]{10,}\.eyJ[\w\-]{10,}\.[\w\-]{16,} )"""
)
PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
PEM_BLOCK = re.compile(r"(-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----)(.*?)(-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----|\Z)", re.S)
PEM_ENCODED = re.compile(r"(?<![A-Za-z0-9+/])LS0tLS1CRUdJTi[A-Za-z0-9+/]{40,}={0,2}")
# of an unquoted value d only the place: it ends with its run, which _Runs looks up
BOUND = re.compile(
    r"""(?mx) (?<![\w.$\-]) (?P<key>[A-Za-z_$][\w.$\-]*+) ["'\]]{0,3} (?:[ \t]*:[ \t]*[&\w<>\[\]'. ]{1,24}?(?==[^=]))? [ \t]*(?:=>|:=|=(?!=)|:)[ \t]*\(?
    (?: b?"(?P<a>(?:[^"\\\n]|\\.)++)" | b?'(?P<b>(?:[^'\\\n]|\\.)++)' | `(?P<c>[^`\n]++)` | (?P<d>(?=[^\s"'`#;,(){}\[\]])) )"""
)
MORE = re.compile(r"""\s*\+\s*(?:"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|`([^`\n]*)`)""")
USERINFO = re.compile(r"(?<![A-Za-z0-9])[A-Za-z][A-Za-z0-9+.\-]{0,20}://[^/\s:@\"'`<>]*+:(?P<v>[^/\s@\"'`]++)@(?=[\w\[])")
PARAMETER = re.compile(r"[?&](?:access_token|auth_token|api_key|apikey|token|key|sig|signature|code|secret|password)=(?P<v>[A-Za-z0-9_%\-.~+/]{16,})")
PAIRED = re.compile(r"(?i)(?:^|[;\"'`\s])(?:pwd|password|accountkey|sharedaccesskey|secret)\s*=\s*(?P<v>[^;\"'`\s]+)\s*;")
HEADER = re.compile(r"""(?i)\b(?:bearer|token)[ ]+(?P<v>[A-Za-z0-9_\-.~+/]{20,}=*)""")
BASIC = re.compile(r"""(?i)(?:\bbasic[ ]+|["']auth["']\s*:\s*["'])(?P<v>[A-Za-z0-9+/]{8,}={0,2})""")
NETRC = re.compile(r"\blogin[ \t]+\S+[ \t]+password[ \t]+(?P<v>\S+)")
CALL = re.compile(r"""(?i)\b(?:login|log_in|sign_?in|connect|authenticate|auth)\w*\(\s*(?:["'][^"'\n]*["']\s*,\s*){1,2}["'](?P<v>[^"'\n]+)["']\s*\)""")
CLIENT = re.compile(r"(?:curl|wget|http)\b")
OPTION = re.compile(r"(?<=\s)(?:-u|--user)[= ]\s*[\"']?[^\s:\"']+:(?P<v>[^\s\"']+)")
NPMRC = re.compile(r":_(?:authToken|auth|password)\s*=\s*(?P<v>\S+)")
MARK = re.compile(r"(?m)(?:^|(?<=\s))(?:\#|//|--|;|\*)")
REMARK = re.compile(r"(?i)\b(?:password|passwd|pwd|pw|passphrase|token|secret|api[ _-]?key|key)\b[ \t]*[:=][ \t]*[\"']?(?P<v>(?=[^\s\"']))")
FORMS = [USERINFO, PARAMETER, PAIRED, HEADER, BASIC, NETRC, CALL, OPTION, NPMRC, REMARK]
#: What a text must hold, in small letters, for a form or a structure to be in it.
NEEDS = {USERINFO: ("://",), PARAMETER: ("=",), PAIRED: (";",), HEADER: ("bearer", "token"), BASIC: ("basic", "auth"), NETRC: ("login",), CALL: ("log", "sign", "connect", "auth"), OPTION: ("-u",), NPMRC: (":_",), REMARK: ("password", "passwd", "pwd", "pw", "passphrase", "token", "secret", "key")}
PREFIXES = ("akia", "asia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "xox", "k_live_", "aiza", "npm_", "sg.", "pypi-", "sk-", "hvs.", "dop_v1_", "shpat_", "shpss_", "shpca_", "eyj")


class _Runs:
    """(end, good) of the run of characters around a place that a value may hold, and
    whether what follows may follow one. Places are asked for in order, each run is read
    once, so the time is linear however long runs are."""

    def __init__(self, text: str, stop: str, after: str) -> None:
        self.text, self.stop, self.after = text, re.compile(stop), re.compile(after, re.M)
        self.known = (-1, False)

    def at(self, place: int) -> tuple[int, bool]:
        if place >= self.known[0]:
            m = self.stop.search(self.text, place)
            end = m.start() if m else len(self.text)
            self.known = (end, self.after.match(self.text, end) is not None)
        return self.known


class _Lines:
    """Where a pattern first ends in the line of a place; places are asked for in order."""

    def __init__(self, text: str, pattern: re.Pattern) -> None:
        self.text, self.pattern, self.stop, self.first = text, pattern, -1, None

    def before(self, place: int) -> bool:
        if place > self.stop:
            start = self.text.rfind("\n", 0, place) + 1
            self.stop = self.text.find("\n", place)
            self.stop = len(self.text) if self.stop < 0 else self.stop
            m = self.pattern.search(self.text, start, self.stop)
            self.first = m.end() if m else None
        return self.first is not None and self.first <= place


def _form_values(form: re.Pattern, text: str) -> Iterator[tuple[int, str]]:
    """(start, value) for each match of a form; OPTION belongs to a client in its line,
    REMARK to a comment, at the end of its line."""
    if form is REMARK:
        lines, runs, passed = _Lines(text, MARK), _Runs(text, r"[\s\"']", r"[\"']?[ \t]*\r?$"), 0
        for m in form.finditer(text):
            if m.start() >= passed and lines.before(m.start()):
                end, good = runs.at(m.end())
                if good:
                    yield m.end(), text[m.end() : end].rstrip(",;")
                    passed = end
        return
    lines = _Lines(text, CLIENT) if form is OPTION else None
    for m in form.finditer(text):
        if lines is None or lines.before(m.start() - 1):
            yield m.start("v"), m["v"]


def _bound_values(text: str) -> Iterator[tuple[str, str, int, str, int]]:
    """(key, group, start, value, end) for each match of BOUND."""
    runs, place = _Runs(text, r"[\s`]", r"[ \t]*\r?$|`"), 0
    while (m := BOUND.search(text, place)) is not None:
        group = next(g for g in "abcd" if m[g] is not None)
        end, good = runs.at(m.end()) if group == "d" else (m.end(), True)
        if good:
            yield m["key"], group, m.start(group), text[m.start(group) : end] if group == "d" else m[group], end
        place = end if good else m.end("key")


class Literal(NamedTuple):
    start: int
    value: str
    kind: str  # bound, weak, form, structure, key, other


def strong(value: str) -> bool:
    """A value that is more than a word or a number: letters with digits or marks, words
    in a row, or a long random run."""
    if len(value) < 6 or value.isdigit() or any(c.isspace() for c in value):
        return False
    letters, digits = sum(c.isalpha() for c in value), sum(c.isdigit() for c in value)
    if re.fullmatch(r"[a-z]+([_.][a-z]+)*|[A-Z]+(_[A-Z]+)*|[a-z]+([A-Z][a-z]+)+", value):
        return False
    if value.startswith(("/", "./", "http://", "https://")) or re.fullmatch(r"[a-z_]\w*\([^)]*\)[;,]?|[\w.]+\.(?:com|test|example|invalid|json|py|go|js|ts|md)", value):
        return False
    return letters >= 2 and (digits > 0 or bool(re.search(r"[!@#$%^&*+~?]", value)) or value.count("-") >= 2 or (value.lower() != value and value.upper() != value))


def _name(key: str) -> str:
    return re.sub(r"(raw|value|literal|str|text)$", "", re.sub(r"[^a-z0-9]", "", key.rsplit(".", 1)[-1].lower()))


def literals(text: str, code: bool) -> Iterator[Literal]:
    """Every literal of a file, with the reason why it might be a credential."""
    small = text.lower()
    for m in STRUCTURED.finditer(text) if any(x in small for x in PREFIXES) else ():
        yield Literal(m.start(), m[0], "structure")
    for m in PEM.finditer(text) if "-----BEGIN" in text else ():
        yield Literal(m.start(), m[0], "key")
    for m in PEM_ENCODED.finditer(text) if "LS0tLS1CRUdJTi" in text else ():
        yield Literal(m.start(), m[0], "structure")
    for form in FORMS:
        if not any(x in small for x in NEEDS[form]):
            continue
        for start, value in _form_values(form, text):
            if form is BASIC:
                try:
                    if b":" not in base64.b64decode(value + "=" * (-len(value) % 4)):
                        continue
                except (binascii.Error, ValueError):
                    continue
            elif form in (PARAMETER, REMARK) and not strong(value):
                continue
            yield Literal(start, value, "form")
    for name, group, start, value, stop in _bound_values(text):
        if group == "d":
            if code:
                continue
            value = value.rstrip(",")
        key = _name(name)
        if group != "d" and key.endswith(SECRET_ENDINGS):
            for more in iter(lambda end=[stop]: _continued(text, end), None):
                value += more
        if NOT_SECRET.search(key):
            kind = "other"
        elif key.endswith(SECRET_ENDINGS) or re.search(r"(^|[_.\-a-z])(pass|PASS|Pass)$", re.sub(r"(Raw|Value)$", "", name)):
            kind = "bound"
        elif key in WEAK_NAMES and strong(value):
            kind = "weak"
        else:
            kind = "other"
        yield Literal(start, value, kind)


def _continued(text: str, end: list[int]) -> str | None:
    """The next part of a literal that is put together with +."""
    m = MORE.match(text, end[0])
    if not m:
        return None
    end[0] = m.end()
    return m[1] or m[2] or m[3] or ""


def possible(literal: Literal) -> bool:
    """Whether the literal may be confirmed, its owners aside."""
    v = literal.value
    if literal.kind == "key":
        return True
    if literal.kind == "other" or REFERENCE.match(v) or v.startswith("-----BEGIN"):
        return False
    if literal.kind in ("structure", "form", "weak"):
        return True
    # bound to the name of a credential: any rare literal that is no reference or phrase
    return len(v) >= 4 and not any(c.isspace() for c in v) and not re.match(r"[a-z]+://", v)


def decode(content: bytes | None) -> str:
    """Text of a file; other encodings byte by byte, so that lines keep their numbers."""
    if content is None:
        return ""
    try:
        return bytes(content).decode("utf-8")
    except UnicodeDecodeError:
        return bytes(content).decode("latin-1")


def _distinct_files(files: DataFrame, id_col: str, owner: str, path: str, content: str) -> DataFrame:
    """(id, owner, path, content): rows repeated as they are count once."""
    some = files.select(F.col(id_col).alias("id"), F.col(owner).cast("string").alias("owner"), F.col(path).alias("path"), F.col(content).alias("content"), F.xxhash64(content).alias("_h"))
    return some.dropDuplicates(["id", "owner", "path", "_h"]).drop("_h")


def literal_index(texts: DataFrame) -> DataFrame:
    """(owner, id, path, value, kind, possible, start, stop, line_no): every literal of every
    file. A literal in parts has its first part's place and ends where it starts."""

    def emit(batches):
        for pdf in batches:
            rows = []
            for owner, key, path, content in zip(pdf["owner"], pdf["id"], pdf["path"], pdf["content"]):
                text = decode(content)
                breaks = _breaks(text)
                for x in literals(text, str(path).endswith(CODE)):
                    ok = possible(x)
                    # of those that can't be confirmed only their owners count
                    if ok or len(x.value) >= 4:
                        stop = x.start + len(x.value)
                        rows.append((owner, key, path, x.value, x.kind, ok, x.start, stop if text.startswith(x.value, x.start) else x.start, bisect_right(breaks, x.start - 1) + 1))
            yield pd.DataFrame(rows, columns=["owner", "id", "path", "value", "kind", "possible", "start", "stop", "line_no"])

    kind = dict(texts.dtypes)["id"]
    return texts.mapInPandas(emit, f"owner string, id {kind}, path string, value string, kind string, possible boolean, start int, stop int, line_no int")


def _breaks(text: str) -> list[int]:
    """Where lines end."""
    out, at = [], text.find("\n")
    while at >= 0:
        out.append(at)
        at = text.find("\n", at + 1)
    return out


def folded(value: Column) -> Column:
    """A literal without case and marks, by which its owners are counted; a literal of
    marks alone as it is."""
    letters = F.lower(F.regexp_replace(value, r"[^\p{L}\p{N}]", ""))
    return F.when(F.length(letters) > 0, letters).otherwise(value)


def confirmed_values(index: DataFrame, owners: int, share: float = OWNER_SHARE) -> DataFrame:
    """(value): rare values that are credentials by name or structure. A literal with more
    owners than `share` of all, and than MIN_OWNERS, is a placeholder."""
    spelled = index.filter("kind <> 'key'").groupBy(folded(F.col("value")).alias("_folded"), "value", "owner").agg(F.max("possible").alias("possible"))
    # the owners of a widely used literal are combined before they are shuffled
    held = spelled.select("_folded", "owner").distinct().groupBy("_folded").agg(F.count("*").alias("owners"))
    common = held.filter(F.col("owners") > max(MIN_OWNERS, int(share * owners)))
    return spelled.filter("possible").select("_folded", "value").distinct().join(common, "_folded", "left_anti").select("value")


_EDGE = re.compile(r"[A-Za-z0-9_]")
_RUN = re.compile(r"[A-Za-z0-9_]+")


def _search(text: str, automaton) -> Iterator[tuple[int, int]]:
    """Spans of the automaton's values; part of a longer word is another value."""
    for end, size in automaton.iter(text):
        a, b = end + 1 - size, end + 1
        if not (a and _EDGE.match(text[a]) and _EDGE.match(text[a - 1])) and not (b < len(text) and _EDGE.match(text[b]) and _EDGE.match(text[b - 1])):
            yield a, b


def _automaton(values: Iterator[str]):
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for v in values:
        automaton.add_word(v, len(v))
    automaton.make_automaton()
    return automaton


def _span_rows(key, path, text: str, automaton) -> list[tuple]:
    breaks = _breaks(text)
    return [(key, path, a, b, bisect_right(breaks, a - 1) + 1) for a, b in set(_search(text, automaton))]


def occurrences(texts: DataFrame, values: DataFrame, shared_values: int | None = None) -> DataFrame:
    """(id, path, start, stop, line_no): where the values stand in the texts of files, as
    words of their own.

    Up to `shared_values`, counted, one automaton is sent to every task. Beyond it, values
    are dealt to files by their longest run of letters and digits, which stands as a word in
    every file that holds the value; each file is then searched for its own values.
    """
    columns = ["id", "path", "start", "stop", "line_no"]
    schema = f"id {dict(texts.dtypes)['id']}, path string, start int, stop int, line_no int"
    if values.count() <= (BLOCK_VALUES if shared_values is None else shared_values):
        shared = texts.sparkSession.sparkContext.broadcast([r["value"] for r in values.collect()])

        def scan(batches):
            automaton = _automaton(shared.value)
            for pdf in batches:
                found = zip(pdf["id"], pdf["path"], pdf["content"]) if len(automaton) else ()
                yield pd.DataFrame([x for key, path, content in found for x in _span_rows(key, path, decode(content), automaton)], columns=columns)

        return texts.mapInPandas(scan, schema)

    def words(batches):
        for pdf in batches:
            rows = [(i, w) for i, content in zip(pdf["_file"], pdf["content"]) for w in set(_RUN.findall(decode(content)))]
            yield pd.DataFrame(rows, columns=["_file", "word"])

    def keyed(batches):
        for pdf in batches:
            rows = [(v, max(_RUN.findall(v), key=len)) for v in pdf["value"] if _RUN.search(v)]
            yield pd.DataFrame(rows, columns=["value", "word"])

    def search(batches):
        for pdf in batches:
            found = zip(pdf["id"], pdf["path"], pdf["content"], pdf["values"])
            yield pd.DataFrame([x for key, path, content, own in found for x in _span_rows(key, path, decode(content), _automaton(own))], columns=columns)

    numbered = texts.withColumn("_file", F.xxhash64("id", "path", "content"))
    asked = numbered.mapInPandas(words, "_file long, word string").join(values.mapInPandas(keyed, "value string, word string"), "word")
    own = asked.groupBy("_file").agg(F.collect_set("value").alias("values"))
    return numbered.join(own, "_file").mapInPandas(search, schema)


def find_secrets(files: DataFrame, id_col: str, owner: str, path: str, content: str) -> tuple[DataFrame, DataFrame]:
    """(hits, files): where credentials begin, and the files they were looked for in.

    Null contents hold none; null owners are one owner. Line numbers count from 1, lines
    end at LF. A private key block counts at its BEGIN line. Values shorter than
    SCANNED_LENGTH, or that are plain words, are not searched for everywhere, which would
    mark that word in every file: they count where their context shows them.
    """
    texts = materialize(_distinct_files(files, id_col, owner, path, content), "secret-files")
    index = materialize(literal_index(texts), "secret-literals")
    values = materialize(confirmed_values(index, texts.select("owner").distinct().count()), "secret-values")
    place = ["id", "path", "start", "stop", "line_no"]
    shown = index.filter("possible AND kind <> 'key'").join(values, "value", "left_semi").select(*place)
    keys = index.filter("kind = 'key'").select(*place)

    @F.pandas_udf("boolean")
    def searched(v: pd.Series) -> pd.Series:
        return v.map(lambda x: len(x) >= SCANNED_LENGTH and strong(x)).astype(bool)

    found = occurrences(texts, values.filter(searched("value")))
    return materialize(found.unionByName(shown).unionByName(keys).distinct(), "secret-hits"), texts


def secret_lines(files: DataFrame, id_col: str, owner: str, path: str, content: str) -> DataFrame:
    """(id, line_no): one row for each line on which a credential begins."""
    hits, _ = find_secrets(files, id_col, owner, path, content)
    return hits.select(F.col("id").alias(id_col), "line_no").distinct()


def redact_text(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with the spans, and the bodies of private key blocks, masked.

    Quotes, separators and line ends stay, so the surrounding code or configuration
    keeps its form. An empty span marks a literal in parts, each of which is masked.
    """
    parts, at = [], 0
    for a, b in sorted(spans):
        if b == a:
            quote = text[a - 1]
            b = text.index(quote, a)
            end = [b + 1]
            while (m := MORE.match(text, end[0])) is not None:
                parts += [text[at:a], MASK] if at <= a else []
                at = b
                group = next(g for g in (1, 2, 3) if m[g] is not None)
                a, b = m.span(group)
                end[0] = m.end()
        if text.startswith("-----BEGIN", a) or a < at:
            continue
        parts += [text[at:a], MASK]
        at = b
    out = "".join([*parts, text[at:]])

    def body(m: re.Match) -> str:
        return m[1] + re.sub(r"[A-Za-z0-9+/=]{8,}", MASK, m[2]) + m[3]

    return PEM_BLOCK.sub(body, out)


def redact_files(files: DataFrame, id_col: str, owner: str, path: str, content: str) -> DataFrame:
    """(id, path, content): the files that hold credentials, with only these replaced."""
    hits, texts = find_secrets(files, id_col, owner, path, content)
    spans = hits.groupBy("id", "path").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("spans"))

    @F.pandas_udf("binary")
    def masked(contents: pd.Series, all_spans: pd.Series) -> pd.Series:
        out = []
        for raw, todo in zip(contents, all_spans):
            text = decode(raw)
            try:
                bytes(raw).decode("utf-8")
                codec = "utf-8"
            except UnicodeDecodeError:
                codec = "latin-1"
            out.append(redact_text(text, [(s["start"], s["stop"]) for s in todo]).encode(codec))
        return pd.Series(out, dtype=object)

    both = texts.join(spans, ["id", "path"])
    return both.select(F.col("id").alias(id_col), "path", masked("content", "spans").alias("content"))
