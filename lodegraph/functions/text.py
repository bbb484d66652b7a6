"""Text functions of the lexical channel, as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that are no terms: keywords and basic types of the languages read. Fixed values.
STOP_WORDS = tuple(
    """def class function func fn return let const var import from public private
    async await void string int bool true false null none self this new if else
    for while try catch throw package export default use pub mut the and or""".split()
)

TERM = r"(?U)[\w$]+(?:[./:\-][\w$]+)*"
WORD = r"[A-Za-z0-9_]+"


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def split_camel(text: str | Column) -> Column:
    """Spaces between the parts of camel-case words: parseHTTPRequest -> parse HTTP Request."""
    return F.regexp_replace(_c(text), r"([a-z\d])([A-Z])|([A-Z]+)([A-Z][a-z])", "$1$3 $2$4")


def sub_tokens(token: str | Column) -> Column:
    """The token in lower case, its snake parts and its camel parts, each once, in order."""
    t = _c(token)
    snake = F.filter(F.split(F.lower(t), "_"), lambda x: x != "")
    camel = F.filter(F.split(F.lower(split_camel(t)), r"[ _]+"), lambda x: x != "")
    return F.array_distinct(F.concat(F.array(F.lower(t)), snake, camel))


def query_terms(text: str | Column) -> Column:
    """Distinct prefixes that a lexical query asks for; [] for a null or wordless text."""
    words = F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(f"({WORD})"), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(words, sub_tokens)))


def index_terms(text: str | Column) -> Column:
    """Every term of a text with repetitions: words in lower case, and the snake and camel
    parts of words that have several."""
    words = F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(f"({WORD})"), F.lit(1))
    return F.flatten(F.transform(words, sub_tokens))


def exact_terms(text: str | Column) -> Column:
    """Distinct dotted or slashed terms in lower case, longer than two characters, without stop words."""
    found = F.transform(F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(f"({TERM})"), F.lit(1)), F.lower)
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) > 2) & ~F.array_contains(stop, t)))


def lexical_text(text: str | Column) -> Column:
    """The text, then on a new line the text with camel-case and snake-case words in parts."""
    parted = F.regexp_replace(_c(text), r"([a-z0-9])([A-Z])", "$1 $2")
    return F.concat(_c(text), F.lit("\n"), F.replace(parted, F.lit("_"), F.lit(" ")))


def signature(text: str | Column) -> Column:
    """First line of a definition's source."""
    return F.regexp_extract(_c(text), r"\A([^\r\n]*)", 1)


def strip_quotes(text: str | Column) -> Column:
    return F.regexp_replace(_c(text), r"^[\"'`]|[\"'`]$", "")
