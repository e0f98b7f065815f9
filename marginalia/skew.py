"""Joins that stay balanced when one key holds a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds more than this share of the rows, so there are at most ``1 / HOT_SHARE`` hot keys.
HOT_SHARE = 1e-3


def hot_keys(counts: DataFrame, n: str, total: int, share: float = HOT_SHARE) -> DataFrame:
    """Rows of ``counts`` (one per key, ``n`` its rows) whose key is hot: at most ``1 / share`` rows."""
    return counts.filter(F.col(n) > F.lit(max(1.0, total * share)))


def hot_aware_join(big: DataFrame, per_key: DataFrame, on: str, n: str, total: int, share: float = HOT_SHARE) -> DataFrame:
    """Inner join of ``big`` with ``per_key`` (one row per key; ``n`` counts the key's rows in ``big``).

    Rows of hot keys are joined map-side with the hot part of ``per_key``, which has at
    most ``1 / share`` rows whatever the data's size; all others by a shuffle that no
    single key can unbalance.  Null keys match nothing.
    """
    hot = F.broadcast(hot_keys(per_key, n, total, share))
    cold = per_key.filter(F.col(n) <= F.lit(max(1.0, total * share)))
    return big.join(hot, on).unionByName(big.join(F.broadcast(hot_keys(per_key, n, total, share).select(on)), on, "left_anti").join(cold, on))
