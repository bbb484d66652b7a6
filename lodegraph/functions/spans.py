"""Byte spans of UTF-8 texts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def byte_slice(content: str | Column, start: str | Column, end: str | Column) -> Column:
    """Bytes [start, end) of a text, decoded; malformed bytes become U+FFFD."""
    c, s, e = (F.col(x) if isinstance(x, str) else x for x in (content, start, end))
    raw = F.substring(F.encode(c, "UTF-8"), (s + 1).cast("int"), F.greatest(e - s, F.lit(0)).cast("int"))
    return F.make_valid_utf8(raw.cast("string"))


def aligned_window(raw: bytes, start: int, end: int, budget: int, context: int) -> tuple[int, int, bool, bool]:
    """(from, to, span clipped, context clipped): a window of at most `budget` bytes around
    [start, end), cut at character boundaries.

    The span comes first: what the budget leaves is halved for the context before and after
    it, at most `context` bytes each, and a span above the budget keeps its beginning.
    """
    n = len(raw)
    before = min(context, max(0, budget - (end - start)) // 2)
    lo = max(0, start - before)
    hi = min(n, end + context, lo + budget)
    while lo < n and raw[lo] & 0xC0 == 0x80:
        lo += 1
    while lo < hi < n and raw[hi] & 0xC0 == 0x80:
        hi -= 1
    wanted = max(0, start - context), min(n, end + context)
    return lo, hi, start < lo or hi < end, wanted[0] < lo or hi < wanted[1]


def source_window(content: str | Column, start: str | Column, end: str | Column, budget: int, context: int) -> Column:
    """struct<text, start_byte, end_byte, site_clipped, context_clipped> of a binary column;
    null for a null content, malformed UTF-8, or a range that is not within it."""
    if budget < 4:
        raise ValueError("a window takes at least one character of four bytes")

    @F.pandas_udf("struct<text:string,start_byte:int,end_byte:int,site_clipped:boolean,context_clipped:boolean>")
    def window(raws: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.DataFrame:
        rows = []
        for raw, s, e in zip(raws, starts, ends):
            row = (None,) * 5
            if raw is not None and not pd.isna(s) and not pd.isna(e) and 0 <= s <= e <= len(raw):
                lo, hi, site, around = aligned_window(bytes(raw), int(s), int(e), budget, context)
                try:
                    row = (bytes(raw).decode().encode()[lo:hi].decode(), lo, hi, site, around)
                except UnicodeDecodeError:
                    pass
            rows.append(row)
        return pd.DataFrame(rows, columns=["text", "start_byte", "end_byte", "site_clipped", "context_clipped"]).astype({"start_byte": "Int32", "end_byte": "Int32"})

    return window(content, start, end)


def passages(text: str | Column, size: int = 1800, overlap: int = 200) -> Column:
    """array<struct<start_byte, end_byte, passage>>: overlapping windows of `size`
    characters. Blank windows are left out; the last one ends with the text."""
    t = F.col(text) if isinstance(text, str) else text
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.length(t) - size) / F.lit(step))).cast("int")
    windows = F.transform(
        F.sequence(F.lit(0), last),
        lambda k: F.struct(
            F.octet_length(F.substring(t, F.lit(1), k * step)).alias("start_byte"),
            F.substring(t, k * step + 1, F.lit(size)).alias("passage"),
        ),
    )
    sized = F.transform(windows, lambda w: F.struct(w["start_byte"].alias("start_byte"), (w["start_byte"] + F.octet_length(w["passage"])).alias("end_byte"), w["passage"].alias("passage")))
    return F.when(t.isNotNull(), F.filter(sized, lambda w: F.trim(w["passage"]) != ""))
