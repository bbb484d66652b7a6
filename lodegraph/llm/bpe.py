"""Byte-level BPE by speculation and verification.

A word is first cut greedily into the longest tokens of the vocabulary. BPE is local:
a token sequence is the word's encoding exactly when every adjacent pair is, encoded on
its own, that same pair (and every token encodes to itself). All pairs of a batch are
looked up at once in a sorted array of pairs known to hold; only words with a failing
pair are merged exactly.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words kept with their ids in one Python worker, and pairs whose verdict is kept.
WORD_CACHE = 400_000
PAIR_CACHE = 2_000_000
#: Words longer than this are not cached.
CACHED_LENGTH = 64


class SpeculativeBpe:
    """Encoder over a file of base64 token and rank per line, and a pre-split pattern."""

    def __init__(self, ranks_path: str, pattern: str):
        import regex

        with open(ranks_path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.split = regex.compile(pattern).findall
        self.bytes_of = {i: b for b, i in self.rank.items()}
        self.longest: dict[bytes, int] = {}  # longest token by its first two bytes
        for token in self.rank:
            self.longest[token[:2]] = max(len(token), self.longest.get(token[:2], 0))
        # a token that its own merges do not reach may not be proposed
        self.reachable = {t: i for t, i in self.rank.items() if len(t) == 1 or self.merge(t) == [i]}
        self.words: dict[str, tuple[int, ...]] = {}
        self.good = np.empty(0, np.int64)
        self.bad = np.empty(0, np.int64)

    def merge(self, word: bytes) -> list[int]:
        """Exact encoding: always merge the pair of lowest rank, leftmost first."""
        n = len(word)
        nxt, prv, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        alive = [True] * n
        rank = self.rank
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = nxt[i] if alive[i] else n
            # stale unless both parts are as they were when the entry was made
            if j >= n or not alive[i] or end[j] != stop:
                continue
            end[i], alive[j], k = stop, False, nxt[j]
            nxt[i] = k
            if k < n:
                prv[k] = i
                if (r := rank.get(word[i : end[k]])) is not None:
                    heapq.heappush(heap, (r, i, end[k]))
            if (p := prv[i]) >= 0 and (r := rank.get(word[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(rank[word[i : end[i]]])
            i = nxt[i]
        return out

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match over reachable tokens."""
        out, i, n, tokens, longest = [], 0, len(word), self.reachable, self.longest
        while i < n:
            for size in range(min(n - i, longest.get(word[i : i + 2], 1)), 0, -1):
                if (t := tokens.get(word[i : i + size])) is not None:
                    break
            out.append(t)
            i += size
        return out

    def _holding(self, pairs: np.ndarray) -> np.ndarray:
        """Whether each pair (left * 2**32 + right) encodes to itself."""
        unseen = np.setdiff1d(np.setdiff1d(pairs, self.good, assume_unique=False), self.bad, assume_unique=False)
        if len(unseen):
            if len(self.good) + len(self.bad) + len(unseen) > PAIR_CACHE:
                self.good = self.bad = np.empty(0, np.int64)
                unseen = np.unique(pairs)
            holds = np.fromiter((self.merge(self.bytes_of[p >> 32] + self.bytes_of[p & 0xFFFFFFFF]) == [p >> 32, p & 0xFFFFFFFF] for p in unseen.tolist()), bool, len(unseen))
            self.good = np.union1d(self.good, unseen[holds])
            self.bad = np.union1d(self.bad, unseen[~holds])
        at = np.searchsorted(self.good, pairs)
        at[at == len(self.good)] = 0
        return self.good[at] == pairs if len(self.good) else np.zeros(len(pairs), bool)

    def encode_words(self, words: Iterable[str]) -> list[tuple[int, ...]]:
        """Ids of distinct words."""
        raw = [w.encode() for w in words]
        out = [None] * len(raw)
        proposals, spans, at = [], [], 0
        for k, word in enumerate(raw):
            if (whole := self.reachable.get(word)) is not None:
                out[k] = (whole,)
                continue
            ids = self.propose(word)
            proposals += ids
            spans.append((k, at, at + len(ids)))
            at += len(ids)
        if not spans:
            return out
        ids = np.array(proposals, np.int64)
        fits = np.append(self._holding((ids[:-1] << 32) | ids[1:]), True) if len(ids) > 1 else np.array([True])
        starts, ends = np.array([s[1] for s in spans]), np.array([s[2] for s in spans])
        fits[ends - 1] = True  # the pair over two words counts for neither
        failing = np.add.reduceat(~fits, starts) > 0
        for (k, a, b), wrong in zip(spans, failing.tolist()):
            out[k] = tuple(self.merge(raw[k])) if wrong else tuple(proposals[a:b])
        return out

    def encode_batch(self, texts: Iterable[str | None]) -> tuple[list[int], list[int]]:
        """All ids of the texts in a row, and the number of ids of each text.

        Null and empty texts have none; strings that look like special tokens are text.
        """
        pieces = [self.split(t) if isinstance(t, str) and t else [] for t in texts]
        known = self.words
        new = [w for w in dict.fromkeys(w for p in pieces for w in p) if w not in known]
        if len(known) + len(new) > WORD_CACHE:
            known.clear()
            new = list(dict.fromkeys(w for p in pieces for w in p))
        known.update(zip(new, self.encode_words(new)))
        flat: list[int] = []
        sizes = []
        for p in pieces:
            before = len(flat)
            for w in p:
                flat += known[w]
            sizes.append(len(flat) - before)
        for w in new:
            if len(w) > CACHED_LENGTH:
                del known[w]
        return flat, sizes


_ENCODERS: dict[tuple[str, str], SpeculativeBpe] = {}


def encoder(ranks_path: str, pattern: str) -> SpeculativeBpe:
    """The encoder of this Python worker, made once."""
    key = (ranks_path, pattern)
    if key not in _ENCODERS:
        _ENCODERS[key] = SpeculativeBpe(*key)
    return _ENCODERS[key]


def public_tokenizer(name: str = "byte_bpe_50k.tiktoken") -> tuple[str, str]:
    """Path and pattern of one of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def token_ids(text: str | Column, ranks_path: str, pattern: str) -> Column:
    """Column of ids (array of int) of a text column; [] for null and empty texts."""

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        flat, sizes = encoder(ranks_path, pattern).encode_batch(texts.to_pylist())
        offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.array(flat, np.int32)))

    return ids(text)


def token_counts(text: str | Column, ranks_path: str, pattern: str) -> Column:
    """Column with the number of ids of a text column; 0 for null and empty texts."""

    @F.pandas_udf("long")
    def counts(texts: pd.Series) -> pd.Series:
        return pd.Series(encoder(ranks_path, pattern).encode_batch(texts)[1], dtype="int64")

    return counts(text)


def encode_corpus(documents: DataFrame, id_col: str, text_col: str, tokenizer: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """(id, ids) of every row; other columns are ignored, repeated rows stay repeated."""
    return documents.select(F.col(id_col), token_ids(F.col(text_col), *public_tokenizer(tokenizer)).alias("ids"))
