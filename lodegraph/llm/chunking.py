"""Splitting oversized texts at natural boundaries, by dynamic programming.

Every position between two tokens has a penalty that says how unnatural a cut there is.
Of all sequences of cuts whose pieces keep to the maximum length and the overlap, the
one with the least sum of penalties and squared deviations from even sizes is taken.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A token: a longest run of ASCII letters, digits and underscores, or any other single
#: character but space, tab, CR and LF.
TOKEN = r"[A-Za-z0-9_]+|[^ \t\r\n]"
_TOKENS = re.compile(TOKEN)

#: Penalties, from the most natural place of a cut to the least.
PARAGRAPH, TOP_LINE, LINE, SENTENCE, CLAUSE, SPACE, INSIDE = 0.0, 0.05, 0.2, 0.5, 0.8, 1.2, 3.0
#: Price of every piece, so that more pieces than needed must earn their cuts.
PIECE = 0.3
IMBALANCE = 0.5
_WIDE_ENDS = "。！？"  # these end a sentence with or without a space after them
_SENTENCE_ENDS, _CLAUSE_ENDS = ".!?" + _WIDE_ENDS, ";,:}])；，：、"


def token_count(text: str | Column) -> Column:
    """Number of tokens of a text column, computed in the JVM; 0 for null."""
    found = F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(TOKEN))
    return F.coalesce(found, F.lit(0))


def cut_penalties(text: str, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Penalty of a cut before each token (index 1..n-1)."""
    out = np.empty(len(starts))
    out[0] = 0
    for i in range(1, len(starts)):
        a, b = ends[i - 1], starts[i]
        gap = text[a:b]
        if not gap:
            last = text[a - 1]
            out[i] = SENTENCE if last in _WIDE_ENDS else CLAUSE if last in ";}，；：、" else SPACE if last in ",{" else INSIDE
            continue
        breaks = gap.count("\n") or gap.count("\r")
        if breaks > 1:
            out[i] = PARAGRAPH
        elif breaks:
            out[i] = TOP_LINE if gap[-1] in "\r\n" else LINE
        else:
            last = text[a - 1]
            out[i] = SENTENCE if last in _SENTENCE_ENDS else CLAUSE if last in _CLAUSE_ENDS else SPACE
    return out


def _candidates(penalty: np.ndarray, widest: int) -> np.ndarray:
    """Positions worth a cut: the most natural ones, and finer ones where those are far apart."""
    n = len(penalty)
    chosen = np.zeros(n + 1, bool)
    chosen[[0, n]] = True
    for level in (LINE, SENTENCE, CLAUSE, SPACE, INSIDE):
        at = np.flatnonzero(chosen)
        wide = at[:-1][np.diff(at) > widest]
        if not len(wide):
            break
        following = at[1:][np.diff(at) > widest]
        for a, b in zip(wide.tolist(), following.tolist()):
            chosen[a + 1 : b] |= penalty[a + 1 : b] <= level
    return np.flatnonzero(chosen)


def plan_cuts(penalty: np.ndarray, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Token spans [start, end) of the pieces of a text with n = len(penalty) tokens."""
    n = len(penalty)
    if n <= limit:
        return [(0, n)]
    stride = limit - overlap
    even = (n - overlap) / ceil((n - overlap) / stride) + overlap
    at = _candidates(penalty, max(1, stride // 4))
    best, back = np.full(len(at), np.inf), np.zeros(len(at), np.int64)
    best[0] = 0
    low = np.searchsorted(at, at - stride)
    for k in range(1, len(at)):
        e = at[k]
        prev = at[low[k] : k]
        # the first piece has no overlap, so it may be longer by that, but must hold one
        sizes = e - np.maximum(prev - overlap, 0)
        cost = best[low[k] : k] + IMBALANCE * ((sizes - even) / even) ** 2
        j = int(np.argmin(cost))
        value, origin = cost[j], low[k] + j
        if e <= limit and (first := IMBALANCE * ((e - even) / even) ** 2) < value:
            value, origin = first, 0
        if e <= overlap and e < n:
            continue
        best[k] = value + PIECE + (penalty[e] if e < n else 0)
        back[k] = origin
    cuts, k = [], len(at) - 1
    while k > 0:
        cuts.append(int(at[k]))
        k = int(back[k])
    cuts.reverse()
    return [(max(0, a - overlap), b) for a, b in zip([0, *cuts[:-1]], cuts)]


def split_text(text: str, limit: int, overlap: int) -> list[tuple[str, int, int]]:
    """(piece, first token, end token) of a text, in order.

    The pieces without their repeated tokens, put together, are the text. An empty text
    is one empty piece.
    """
    spans = np.array([m.span() for m in _TOKENS.finditer(text)], np.int64).reshape(-1, 2)
    starts, ends = spans[:, 0], spans[:, 1]
    n = len(starts)
    if n <= limit:
        return [(text, 0, n)]
    pieces = plan_cuts(cut_penalties(text, starts, ends), limit, overlap)
    return [(text[0 if a == 0 else starts[a] : len(text) if b == n else starts[b]], a, b) for a, b in pieces]


def split_oversized(items: DataFrame, id_col: str, text_col: str, limit: int = 1000, overlap: int = 50) -> DataFrame:
    """Ordered pieces of every item whose text has more than `limit` tokens.

    Returns (id, piece_no from 0, content, token_count, first_token, n_pieces). Counts
    stored with the items are not consulted. Rows of the same id and text count once;
    null texts and items within the limit have no rows here.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below the limit")
    # a text of more than `limit` tokens has more than `limit` characters
    long = items.select(F.col(id_col), F.col(text_col).alias("_text")).filter(F.length("_text") > limit)
    over = long.filter(token_count("_text") > limit).dropDuplicates([id_col, "_text"])
    id_type = dict(over.dtypes)[id_col]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, text in zip(pdf[id_col], pdf["_text"]):
                pieces = split_text(text, limit, overlap)
                rows += [(key, i, p, b - a, a, len(pieces)) for i, (p, a, b) in enumerate(pieces)]
            yield pd.DataFrame(rows, columns=["id", "piece_no", "content", "token_count", "first_token", "n_pieces"])

    out = over.mapInPandas(cut, f"id {id_type}, piece_no int, content string, token_count long, first_token long, n_pieces int")
    return out.withColumnRenamed("id", id_col)
