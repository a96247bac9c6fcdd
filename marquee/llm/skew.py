"""Joins of many rows to one row per key, where one key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than 1/HOT_SHARE of the rows is hot, so at most HOT_SHARE keys are.
HOT_SHARE = 1000


def lookup(rows: DataFrame, keyed: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of ``rows`` to ``keyed`` (one row per ``key``).

    ``size`` is the column of ``keyed`` with the number of ``rows`` of the key
    and ``total`` the sum of it. Keys of more than total/HOT_SHARE rows are at
    most HOT_SHARE, which proves the bound of what is broadcast; their rows
    stay where they are. All other keys are shuffled.
    """
    limit = max(1, total // HOT_SHARE)
    hot = keyed.filter(F.col(size) > limit)
    rest = keyed.filter(F.col(size) <= limit)
    ids = hot.select(F.col(key).alias("_hot"))
    here = rows.join(F.broadcast(hot), key)
    away = rows.join(F.broadcast(ids), F.col(key) == F.col("_hot"), "left_anti").join(rest, key)
    return here.unionByName(away)
