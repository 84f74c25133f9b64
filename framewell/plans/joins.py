"""Joins that a hot key does not bring into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewell.session import materialise

#: Rows of a key that make it hot, and rows that are broadcast at most.
HOT, BROADCAST_ROWS = 1000, 250_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, written already, with a hint to broadcast it if it has so few rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def skew_join(left: DataFrame, right: DataFrame, key: str, count: str) -> DataFrame:
    """left joined to right on key, which right holds once, with the number of left's rows that bear it in `count`.

    Rows of hot keys stay where they are and meet right's few hot rows by broadcast; the others are shuffled. There is
    one hot key in HOT rows at most; should these still be too many to broadcast, they are shuffled as well.
    """
    right = materialise(right, "right")
    hot = right.filter(F.col(count) > HOT).drop(count)
    n = hot.limit(BROADCAST_ROWS + 1).count()
    rest = right.drop(count)
    if n == 0 or n > BROADCAST_ROWS:
        return left.join(rest, key)
    keys = F.broadcast(hot.select(key))
    cold = left.join(keys, key, "left_anti").join(right.filter(F.col(count) <= HOT).drop(count), key)
    return left.join(F.broadcast(hot), key).unionByName(cold)
