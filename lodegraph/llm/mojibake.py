"""Texts decoded with a wrong character encoding: find them and restore them.

1. Every word with non-ASCII characters is keyed by its context stripped of non-ASCII
   characters. Words of one key are near-twins; the commonest one is the clean one. Words
   that have no ASCII to join on, or whose ASCII is part of the damage, are joined on their
   bytes: the twin is the commonest word that has the same bytes in some encoding.
2. Aligned with its clean twin, a garbled word tells which transformations (read as one
   encoding, written in another) take one to the other, character by character. All
   encodings that the library knows and that hold ASCII are open. Of the transformations
   that explain the pairs, the one that explains most is learned, then the one that
   explains most of what is left, as long as enough pairs speak for it.
3. Learned transformations are tried on every remaining record. A repair stands when
   the characters it yields are commoner in the corpus than those it replaces.
4. Words with lost characters (U+FFFD) take the characters of their clean twin.

Nothing is undone that no twin has shown: a corpus without twins comes back as it is.
"""

from __future__ import annotations

import codecs
import encodings.aliases
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.storage import materialize

#: Of transformations that explain the same pairs, the one of the commoner encodings is
#: learned. Fixed values.
COMMON = ("utf_8", "cp1252", "cp1251", "koi8_r", "shift_jis", "gb18030", "euc_jp", "big5", "euc_kr", "cp1250", "iso8859_2", "cp1254", "mac_roman", "cp437", "cp850", "cp866")
Pair = tuple[str, str]  # read as, written in

#: Twins that a transformation needs before it is applied.
MIN_TWINS = 2
#: A clean word is so many times as common as its garbled twin; two garbled forms of one
#: word are about equally common.
CLEAN_RATIO = 4
#: Gain in log-likelihood a repair must bring to a record.
MIN_GAIN = 3.0
LOST = "\ufffd"

_NON_ASCII = re.compile(r"[^\x00-\x7f]")
_WIDE = re.compile(r"[\u1100-\u11ff\u2e80-\u9fff\uac00-\ud7af\uff66-\uff9f]")
_WORD = re.compile(r"[^\s\x00-\x20!-/:-@\[-`{-~]+")
_C1 = re.compile("[\x80-\x9f]")
#: A Latin letter beside a Greek or Cyrillic one, as no word has them.
_MIXED = re.compile(r"[A-Za-z\u00c0-\u024f](?=[\u0370-\u052f])|[\u0370-\u052f](?=[A-Za-z\u00c0-\u024f])")
#: A quoted word, which shows characters instead of using them. What holds a C1 control
#: shows nothing.
_QUOTED = re.compile(r"""(?<![^\W_])(?:"[^"\s]+"|'[^'\s]+'|`[^`\s]+`|“[^”\s]+”)(?![^\W_])""")


@cache
def encodings_with_ascii() -> list[str]:
    """The text encodings of the library in which ASCII is ASCII, and all else is not."""
    out, plain = [], bytes(range(32, 127))
    for name in sorted(set(encodings.aliases.aliases.values())):
        try:
            if not codecs.lookup(name)._is_text_encoding or plain.decode(name) != plain.decode("ascii"):
                continue
            others = [c.encode(name, "ignore") for c in "éЖ語かก한ωא"]
        except (LookupError, UnicodeError):
            continue
        if any(others) and all(x[0] > 127 for x in others if x):
            out.append(name)
    return out


@cache
def byte_table(codec: str) -> dict[int, int] | None:
    """Characters to bytes of a single-byte encoding, None for others. In those of Windows,
    bytes from 128 to 159 may have passed as controls."""
    table: dict[int, int] = {}
    for b in range(128, 256):
        try:
            c = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            continue
        if len(c) == 1 and c != LOST:
            table[ord(c)] = b
    if len(table) < 64 or len("語한".encode(codec, "ignore")) > 0:
        return None
    if codec.startswith("cp125"):
        for b in range(128, 160):
            table.setdefault(b, b)
    return table


@cache
def _charmap(codec: str) -> tuple[object, dict[str, str]]:
    """The encoding as a map for charmap_encode, and the characters that controls which
    passed for bytes stand for."""
    table = byte_table(codec)
    chars = ["\ufffe"] * 256
    for c in range(128):
        chars[c] = chr(c)
    for c, b in sorted(table.items(), key=lambda x: -x[0]):
        # the greatest character of a byte is the encoding's own
        chars[b] = chr(c) if chars[b] == "\ufffe" else chars[b]
    return codecs.charmap_build("".join(chars)), {chr(c): chars[b] for c, b in table.items() if c < 160}


def read_bytes(text: str, codec: str) -> bytes | None:
    """The bytes that were read as the text, or None where the encoding can't give it."""
    try:
        if byte_table(codec) is None:
            return text.encode(codec)
        encoding_map, controls = _charmap(codec)
        if controls and _C1.search(text):
            text = _C1.sub(lambda m: controls.get(m[0], m[0]), text)
        return codecs.charmap_encode(text, "strict", encoding_map)[0]
    except UnicodeEncodeError:
        return None


def byte_forms(text: str) -> dict[bytes, list[str]]:
    """Every byte sequence that could be read as the text, and the encodings it is read in."""
    codes, out = set(map(ord, _NON_ASCII.findall(text))), {}
    for name in encodings_with_ascii():
        table = byte_table(name)
        if table is not None:
            if table.keys() >= codes:
                out.setdefault(read_bytes(text, name), []).append(name)
            continue
        try:
            out.setdefault(text.encode(name), []).append(name)
        except UnicodeEncodeError:
            continue
    return out


def decode_whole(text: str, read_as: str, actual: str) -> str | None:
    """The text with the transformation undone throughout, or None where it can't be."""
    if byte_table(read_as) is None:
        # what is read so has lost some of its bytes
        text = text.replace(LOST, "")
        if not _WIDE.search(text):
            return None
        raw = read_bytes(text, read_as)
        return None if raw is None else raw.decode(actual, "replace")
    raw = read_bytes(text, read_as)
    try:
        return None if raw is None else raw.decode(actual)
    except UnicodeDecodeError:
        return None


def _sequences(table: dict[int, int]) -> re.Pattern:
    """Characters that are well-formed sequences of UTF-8, read in the encoding."""
    chars = lambda low, high: "[" + "".join(re.escape(chr(c)) for c, b in sorted(table.items()) if low <= b <= high) + "]"
    more = chars(0x80, 0xBF)
    return re.compile(f"{chars(0xC2, 0xDF)}{more}|{chars(0xE0, 0xEF)}{more}{{2}}|{chars(0xF0, 0xF4)}{more}{{3}}")


class Repairer:
    """Learned transformations, and how many documents hold each character."""

    def __init__(self, pairs: list[Pair], documents: int, holding: dict[str, int]):
        self.n, self.holding = max(1, documents), holding
        self.logs: dict[str, float] = {}
        self.utf8 = [(r, byte_table(r), _sequences(byte_table(r))) for r, a in pairs if a == "utf_8" and byte_table(r)]
        self.lines: dict[str, list[str]] = {}
        for r, a in pairs:
            if a != "utf_8" or not byte_table(r):
                self.lines.setdefault(r, []).append(a)
        self.chars = {r: set(map(chr, byte_table(r) or ())) for r in self.lines}

    def likelihood(self, text: str) -> float:
        total, logs = 0.0, self.logs
        for c in _NON_ASCII.findall(text):
            if (x := logs.get(c)) is None:
                # C1 controls stand in no sound text, however often they occur
                seen = 0 if c < "\xa0" else self.holding.get(c, 0)
                x = logs[c] = math.log((seen + 0.1) / (self.n + 1))
            total += x
        return total

    def _undo_utf8(self, text: str, table: dict[int, int], sequences: re.Pattern) -> tuple[str, float]:
        """Every well-formed byte sequence decoded where that gains."""
        out, at, gain = [], 0, 0.0
        for m in sequences.finditer(text):
            try:
                char = m[0].translate(table).encode("latin-1").decode()
            except UnicodeDecodeError:
                continue
            a, b = m.span()
            gain += self.likelihood(char) - self.likelihood(m[0])
            out += [text[at:a], char]
            at = b
        return ("".join([*out, text[at:]]), gain) if out else (text, 0.0)

    def _undo_lines(self, text: str, utf8_only: bool) -> Iterator[tuple[float, Pair, str]]:
        """For each of the other transformations: the lines in which it gains, undone."""
        lines = text.split("\n")
        gains: dict[Pair, float] = {}
        fixed_lines: dict[Pair, dict[int, str]] = {}
        for k, line in enumerate(lines):
            if line.isascii():
                continue
            chars, base = set(_NON_ASCII.findall(line)), None
            for read_as, written in self.lines.items():
                wide = not self.chars[read_as]
                if not (_WIDE.search(line) if wide else chars <= self.chars[read_as]):
                    continue
                # what is read as two-byte characters has lost some of its bytes
                raw = read_bytes(line.replace(LOST, "") if wide else line, read_as)
                for actual in written if raw is not None else ():
                    if utf8_only and actual != "utf_8":
                        continue
                    try:
                        fixed = raw.decode(actual, "replace" if wide else "strict")
                    except UnicodeDecodeError:
                        continue
                    if fixed == line or (wide and 3 * fixed.count(LOST) > len(_NON_ASCII.findall(fixed))):
                        continue
                    if base is None:
                        base = self.likelihood(line), self.likelihood(line.replace(LOST, ""))
                    # dropping lost characters is no gain
                    more = self.likelihood(fixed) - base[wide]
                    # a new border between alphabets inside a word is as rare as a character that was not seen
                    if more > 0 and (borders := len(_MIXED.findall(fixed)) - len(_MIXED.findall(line))) > 0:
                        more += borders * math.log(0.1 / (self.n + 1))
                    if more > 0:
                        gains[read_as, actual] = gains.get((read_as, actual), 0.0) + more
                        fixed_lines.setdefault((read_as, actual), {})[k] = fixed
        for pair, gain in gains.items():
            yield gain, pair, "\n".join(fixed_lines[pair].get(k, x) for k, x in enumerate(lines))

    def undo(self, text: str, utf8_only: bool = False) -> tuple[float, Pair | None, str]:
        """(gain, transformation, text) of the one that gains most."""
        best: tuple[float, Pair | None, str] = (0.0, None, text)
        for read_as, table, sequences in self.utf8:
            fixed, gain = self._undo_utf8(text, table, sequences)
            if gain > best[0]:
                best = (gain, (read_as, "utf_8"), fixed)
        return max([best, *self._undo_lines(text, utf8_only)], key=lambda x: x[0])

    def repair(self, text: str) -> tuple[str, list[str]]:
        """(restored text, transformations undone); none for a sound text. Quoted words
        count for nothing, but where the text around them is garbled they are restored
        with it. Every step gains, so the steps end."""
        if text.isascii():
            return text, []
        quotes: list[str] = []

        def hide(m: re.Match) -> str:
            if m[0].isascii() or _C1.search(m[0]):
                return m[0]
            quotes.append(m[0])
            return f"\x00{len(quotes) - 1}\x00"

        hidden = _QUOTED.sub(hide, text)
        steps: list[str] = []
        # no repair can gain more than sound text would have
        while -self.likelihood(hidden) > (0.5 if steps else MIN_GAIN):
            # after the first step only UTF-8 that was misread once more is undone
            gain, pair, fixed = self.undo(hidden, bool(steps))
            if pair is None or gain <= (0.5 if steps else MIN_GAIN):
                break
            hidden = fixed
            steps.append(f"{pair[1].replace('_', '-')} read as {pair[0]}")
            quotes = [self._undone(q, pair) for q in quotes]
        if LOST in hidden:
            steps.append("characters lost")
        return re.sub(r"\x00(\d+)\x00", lambda m: quotes[int(m[1])] if int(m[1]) < len(quotes) else m[0], hidden), steps

    def _undone(self, quote: str, pair: Pair) -> str:
        fixed = decode_whole(quote, *pair)
        return fixed if fixed is not None and self.likelihood(fixed) > self.likelihood(quote) else quote


def _bare(word: str) -> str:
    return word if word.isascii() else _NON_ASCII.sub("", word)


def _keys(words: list[str]) -> Iterator[tuple[int, str, str]]:
    """(number, word, key) of each word with non-ASCII characters. The key is the word and
    its neighbours without them; '' where the word has no ASCII letter."""
    for k, w in enumerate(words):
        if w.isascii():
            continue
        own, left, right = _bare(w), _bare(words[k - 1]) if k else "", _bare(words[k + 1]) if k + 1 < len(words) else ""
        yield k, w, f"{left} {own} {right}" if len(own) > 1 and (left or right) else ""


def _keyed_words(text: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, word, key) of each word with non-ASCII characters."""
    spans = [m.span() for m in _WORD.finditer(text)]
    for k, w, key in _keys([text[a:b] for a, b in spans]):
        yield *spans[k], w, key


def _corpus_words(documents: DataFrame) -> DataFrame:
    """(key, word, docs)"""

    def emit(batches):
        for pdf in batches:
            rows = [x for text in pdf["text"] for x in {(key, w) for _, w, key in _keys(_WORD.findall(text))}]
            yield pd.DataFrame(rows, columns=["key", "word"])

    return documents.mapInPandas(emit, "key string, word string").groupBy("key", "word").agg(F.count("*").alias("docs"))


def explanations(garbled: str, clean: str) -> list[Pair]:
    """The transformations that take the garbled word to the clean one: pairs of encodings
    in which the two have the same bytes."""
    read, out = byte_forms(garbled), []
    for name in encodings_with_ascii():
        try:
            out += [(r, name) for r in read.get(clean.encode(name), ()) if r != name]
        except UnicodeEncodeError:
            continue
    return sorted(out)


def choose(explained: dict[tuple[Pair, ...], int]) -> list[Pair]:
    """Transformations to learn from how many pairs of twins each set of them explains: the
    one that explains most of what is left, as long as MIN_TWINS pairs speak for it."""
    order = {c: k for k, c in enumerate(COMMON)}
    left, out = dict(explained), []
    while left:
        votes: Counter[Pair] = Counter()
        for pairs, n in left.items():
            for p in pairs:
                votes[p] += n
        best = min(votes, key=lambda p: (-votes[p], order.get(p[1], len(order)) + order.get(p[0], len(order)), p))
        if votes[best] < MIN_TWINS:
            break
        out.append(best)
        left = {pairs: n for pairs, n in left.items() if best not in pairs}
    return out


def _explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        found = [explanations(w, c) for w, c in zip(pdf["word"], pdf["clean"])]
        yield pd.DataFrame({"pairs": [" ".join(f"{r}:{a}" for r, a in x) for x in found if x]}, dtype=object)


def _bytes_of_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every byte sequence of a word in any encoding."""
    for pdf in batches:
        rows = [(raw, w, n) for w, n in zip(pdf["word"], pdf["docs"]) for raw in byte_forms(w)]
        yield pd.DataFrame(rows, columns=["raw", "word", "docs"])


def learn(documents: DataFrame) -> tuple[DataFrame, list[Pair]]:
    """(clean twins (key, clean), learned transformations) of (id, text) rows.

    What reaches the driver is one count for each set of transformations that explains
    some pair; there are as many as the encodings can tell apart, whatever the corpus.
    """
    words = materialize(_corpus_words(documents), "moji-words")
    per_word = materialize(words.filter(F.instr("word", LOST) == 0).groupBy("word").agg(F.sum("docs").alias("docs")), "moji-vocabulary")
    keyed = words.filter("key <> ''").select("key", "word").join(per_word, "word")
    twins = keyed.groupBy("key").agg(F.max(F.struct("docs", "word")).alias("_m")).select("key", F.col("_m.word").alias("clean"), F.col("_m.docs").alias("clean_docs"))
    twins = materialize(twins, "moji-twins")
    near = keyed.join(twins, "key").filter(f"{CLEAN_RATIO} * docs <= clean_docs").select("word", "clean").distinct()

    # few rows, many encodings: spread over all tasks
    many = per_word.filter(F.length("word") > 2).repartition(documents.sparkSession.sparkContext.defaultParallelism)
    raw = materialize(many.mapInPandas(_bytes_of_words, "raw binary, word string, docs long"), "moji-bytes")
    commonest = raw.groupBy("raw").agg(F.max(F.struct("docs", "word")).alias("_m")).select("raw", F.col("_m.word").alias("clean"), F.col("_m.docs").alias("clean_docs"))
    met = raw.join(commonest, "raw").filter(f"{CLEAN_RATIO} * docs <= clean_docs").groupBy("word").agg(F.max(F.struct("clean_docs", "clean")).alias("_m")).select("word", F.col("_m.clean").alias("clean"))
    counts = near.unionByName(met).distinct().mapInPandas(_explain, "pairs string").groupBy("pairs").count()
    explained = {tuple(tuple(p.split(":")) for p in r["pairs"].split()): r["count"] for r in counts.collect()}
    return twins.select("key", "clean"), choose(explained)


def character_counts(documents: DataFrame) -> tuple[int, dict[str, int]]:
    """Number of documents, and of those that hold each non-ASCII character. The result
    is bounded by the number of characters in Unicode."""
    chars = documents.select(F.explode(F.array_distinct(F.split(F.regexp_replace("text", r"[\x00-\x7F]+", ""), ""))).alias("c"))
    counted = chars.filter("c <> ''").groupBy("c").count()
    return documents.count(), {r["c"]: r["count"] for r in counted.collect()}


def restore_corpus(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, restored, steps, complete) of every garbled record.

    `steps` names the encodings undone, in order; `complete` is false where characters
    are lost and no twin has them. Null, empty and ASCII texts are sound. Repeated rows
    come out as often as they go in; other columns are ignored.
    """
    spark: SparkSession = documents.sparkSession
    texts = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.col("text").rlike(r"[^\x00-\x7F]"))
    texts = materialize(texts, "moji-texts")
    twins, pairs = learn(texts)
    n, holding = character_counts(texts)
    shared = spark.sparkContext.broadcast((pairs, n, holding))
    id_type = dict(texts.dtypes)["id"]

    def apply(batches):
        repairer = Repairer(*shared.value)
        for pdf in batches:
            rows = []
            for key, text in zip(pdf["id"], pdf["text"]):
                fixed, steps = repairer.repair(text)
                if steps:
                    rows.append((key, fixed, steps))
            yield pd.DataFrame(rows, columns=["id", "restored", "steps"])

    found = materialize(texts.mapInPandas(apply, f"id {id_type}, restored string, steps array<string>"), "moji-found")
    out = fill_lost(found, twins)
    return out.withColumn("complete", F.instr("restored", LOST) == 0).withColumnRenamed("id", id_col)


def fill_lost(found: DataFrame, twins: DataFrame) -> DataFrame:
    """Words with U+FFFD replaced by the clean twin of their key, where it fits."""
    lost = found.filter(F.instr("restored", LOST) > 0).withColumn("_row", F.xxhash64("id", "restored"))

    def spans(batches):
        for pdf in batches:
            rows = [(r, a, b, w, key) for r, text in zip(pdf["_row"], pdf["restored"]) for a, b, w, key in _keyed_words(text) if LOST in w and key]
            yield pd.DataFrame(rows, columns=["_row", "a", "b", "word", "key"])

    asked = lost.dropDuplicates(["_row"]).select("_row", "restored").mapInPandas(spans, "_row long, a int, b int, word string, key string")
    answers = asked.join(twins, "key").groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("a", "b", "word", "clean"))).alias("_fills"))

    @F.pandas_udf("string")
    def filled(texts: pd.Series, fills: pd.Series) -> pd.Series:
        out = []
        for text, todo in zip(texts, fills):
            parts, at = [], 0
            for f in todo if todo is not None else []:
                pattern = "".join(f"[^\\x00-\\x7f]{{1,3}}" if c == LOST else re.escape(c) for c in f["word"])
                if re.fullmatch(pattern, f["clean"]):
                    parts += [text[at : f["a"]], f["clean"]]
                    at = f["b"]
            out.append("".join([*parts, text[at:]]))
        return pd.Series(out, dtype=object)

    # each document gathers only its own lost words
    repaired = lost.join(answers, "_row", "left").select("id", filled("restored", "_fills").alias("restored"), "steps")
    return found.filter(F.instr("restored", LOST) == 0).unionByName(repaired)
