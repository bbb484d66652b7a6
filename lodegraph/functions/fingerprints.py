"""Content fingerprints: SHA-256 over canonical JSON, independent of column order."""

from __future__ import annotations

import hashlib
import json
import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(value: object) -> str:
    """JSON with sorted keys and no spaces; NaN and infinity are refused."""

    def check(v: object) -> object:
        if isinstance(v, float) and not math.isfinite(v):
            raise ValueError("a fingerprint takes finite numbers only")
        if isinstance(v, dict):
            return {str(k): check(x) for k, x in v.items()}
        if isinstance(v, (list, tuple)):
            return [check(x) for x in v]
        return v.item() if hasattr(v, "item") else v

    return json.dumps(check(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def fingerprint(value: object) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def row_fingerprint(*columns: str) -> Column:
    """Fingerprint of the named columns of each row, as an object of their names and values."""

    @F.pandas_udf("string")
    def hashed(rows: pd.DataFrame) -> pd.Series:
        clean = rows.astype(object).where(rows.notna(), None)
        return pd.Series([fingerprint(r) for r in clean.to_dict("records")], dtype=object)

    return hashed(F.struct(*columns))


def content_hash(content: str | Column) -> Column:
    return F.sha2(content, 256)
