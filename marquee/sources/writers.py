"""Sinks: backups, deletes, copies and routed inserts, as plans or as writes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def backup(events: DataFrame, path: str, at: str) -> DataFrame:
    """Write events as JSON with a manifest (timestamp, total_events) beside them; returns the manifest."""
    events.write.json(f"{path}/events")
    manifest = events.agg(F.lit(at).alias("timestamp"), F.count("*").alias("total_events"))
    manifest.write.json(f"{path}/manifest")
    return manifest


def delete(events: DataFrame, gone: DataFrame, keys: list[str], path: str | None = None) -> DataFrame:
    """Events without those in ``gone``; written to ``path`` unless it is None (a dry run)."""
    left = events.join(gone.select(*keys), keys, "left_anti")
    if path is not None:
        left.write.parquet(path)
    return left


def append_routed(events: DataFrame, path: str) -> None:
    """Append events in one folder per collection, one task's file each, so that reads prune by collection."""
    events.write.mode("append").partitionBy("collection").parquet(path)


def csv_lines(rows: DataFrame) -> DataFrame:
    """Rows as lines of CSV (line): texts with a comma in double quotes, nothing escaped, nulls empty."""
    cell = lambda c, t: F.coalesce(F.when(F.contains(F.col(c), F.lit(",")), F.concat(F.lit('"'), F.col(c), F.lit('"'))).otherwise(F.col(c)), F.lit("")) if t == "string" else F.coalesce(F.col(c).cast("string"), F.lit(""))
    return rows.select(F.concat_ws(",", *(cell(c, t) for c, t in rows.dtypes)).alias("line"))


def csv_report(rows: DataFrame, path: str) -> None:
    """``csv_lines`` with the columns' names as the first line of each file."""
    csv_lines(rows).withColumnRenamed("line", ",".join(rows.columns)).write.option("header", True).option("quote", "").csv(path, sep="\x01")


def report(stats: DataFrame, path: str, at: str) -> None:
    """Statistics (a bounded table, such as the venues of ``events.venue_stats``) as JSON in one file, with the time ``at`` which they were made."""
    stats.withColumn("timestamp", F.lit(at)).coalesce(1).write.mode("error").json(path)
