"""Running totals and ranks over groups of any size.

A window by a few keys sorts each of them in one task. Here rows are dealt out
by ranges of (keys, order), so that a frequent key takes many tasks; each task
sums its own rows, and the sums of the ranges before it, one row for each key
and range, are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.session import materialise


def running(rows: DataFrame, keys: list[str], order: str, amount: Column | None = None) -> DataFrame:
    """``rows`` with _upto, the sum of ``amount`` (1 by default: the rank from 1) up to and with each row in ``order`` within its keys, and _total over all.

    The dealt rows are written and read again, so that both passes see the same ranges.
    """
    dealt = rows.withColumn("_amount", F.lit(1).cast("long") if amount is None else amount).repartitionByRange(*keys, order)
    dealt = materialise(dealt.withColumn("_range", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy(*keys, "_range").agg(F.sum("_amount").alias("_own"))
    w = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_own").over(w.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumns({"_before": before, "_total": F.sum("_own").over(w)}).drop("_own")
    own = F.sum("_amount").over(Window.partitionBy("_range", *keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    out = dealt.withColumn("_upto", own).join(sums, [*keys, "_range"])
    return out.withColumn("_upto", F.col("_upto") + F.col("_before")).drop("_amount", "_range", "_before")
