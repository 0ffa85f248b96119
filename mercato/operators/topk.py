"""Top-k helpers: overall (TakeOrderedAndProject) and per key (window + limit).

``top_k_per_key`` filters ``row_number() <= k``; Spark plans that as a
partial WindowGroupLimit *before* the shuffle and a final one after it, so
a hot key contributes at most k rows per map task to the exchange instead
of all of its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def top_k_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int,
                  rank_col: str = "rank") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)


def paginate(df: DataFrame, order: list[Column], limit: int | None = None,
             offset: int | None = None) -> DataFrame:
    """ORDER BY .. OFFSET .. LIMIT with the reference's bounds: limit 1..100,
    offset >= 0, both optional."""
    if limit is not None and not (isinstance(limit, int) and 1 <= limit <= 100):
        raise ValueError("limit must be an integer in 1..100")
    if offset is not None and not (isinstance(offset, int) and offset >= 0):
        raise ValueError("offset must be a non-negative integer")
    out = df.orderBy(*order)
    if offset:
        out = out.offset(offset)
    if limit is not None:
        out = out.limit(limit)
    return out
