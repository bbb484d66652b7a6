"""Vector functions on array<float> columns."""

from __future__ import annotations

import hashlib
import math
import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a vector is null, zero, or of another length."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (size > 0), dot(a, b) / size)


def usable(a: Column, dimensions: int) -> Column:
    """Whether a vector has the dimensions, no NaN or infinity, and is not zero."""
    finite = ~F.exists(a, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (F.size(a) == dimensions) & finite & (norm(a) > 0)


def hashed_vector(text: str, dimensions: int) -> list[float]:
    """Deterministic unit vector of a text, for tests without a model: words of a chain
    of SHA-256 digests, scaled to [-0.5, 0.5)."""
    digest, values = hashlib.sha256(text.encode()).digest(), []
    while len(values) < dimensions:
        values += [w / 2**32 - 0.5 for w in struct.unpack(">8I", digest)]
        digest = hashlib.sha256(digest).digest()
    values = values[:dimensions]
    length = math.sqrt(sum(v * v for v in values)) or 1.0
    return [v / length for v in values]


def hashed_embedding(text: str | Column, dimensions: int) -> Column:
    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else hashed_vector(t, dimensions))

    return embed(text)
