"""Inputs derived from the driver's tables, by the same rule in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.session import table


def pick(key: Column, samples: Sequence[str]) -> Column:
    """One of the samples by the key's remainder."""
    return F.get(F.array(*(F.lit(s) for s in samples)), (key % len(samples)).cast("int"))


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def pick_sql(key: str, samples: Sequence[str]) -> str:
    return f"list_extract([{', '.join(map(quoted, samples))}], CAST({key} % {len(samples)} AS BIGINT) + 1)"


ADDRESSES = [
    "12 Main St, Oakland, CA", "500 Congress Ave, Austin, TX", "Golden Gate Park San Francisco", "1 Round Rock Way, Round Rock, TX", "", "Somewhere", "77 Napa Rd, Napa, california", "Hall 3, Kyle",
    "9 Berkeley Sq, London", "West Lake Hills Dr 4", "San Jose Civic, San Jose", "Unknown Place, ATX",
]
CITIES = ["Oakland", "Austin", "", "Round Rock", "Georgetown", "San Jose", "sf"]
TITLES = ["Jazz  Night", "jazz night ", " JAZZ Night", "Open Mic", "", "Art\tWalk", "art walk"]
TIMES = ["19:00:00", "2024-05-01T19:00:00", " 7 PM", "", "2024-05-01T21:30:00Z"]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event rows with duplicates, one per order."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("event_id"), F.when(k % 3 == 0, "events").when(k % 3 == 1, "austinEvents").otherwise("bayAreaEvents").alias("collection"),
        pick(k, TITLES).alias("title"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.concat(F.lit("Venue "), (F.col("o_custkey") % 5).cast("string")).alias("venue"),
        pick(k, TIMES).alias("startTime"), pick(k, ADDRESSES).alias("address"), pick(k, CITIES).alias("city"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("created"), (k % 4 == 0).alias("has_image"), k.alias("ord"),
    )


EVENTS = f"""(SELECT o_orderkey AS event_id, CASE o_orderkey % 3 WHEN 0 THEN 'events' WHEN 1 THEN 'austinEvents' ELSE 'bayAreaEvents' END AS collection,
  {pick_sql('o_orderkey', TITLES)} AS title, strftime(o_orderdate, '%Y-%m-%d') AS date, 'Venue ' || (o_custkey % 5) AS venue,
  {pick_sql('o_orderkey', TIMES)} AS startTime, {pick_sql('o_orderkey', ADDRESSES)} AS address, {pick_sql('o_orderkey', CITIES)} AS city,
  CAST(epoch(o_orderdate) AS BIGINT) AS created, o_orderkey % 4 = 0 AS has_image, o_orderkey AS ord FROM orders)"""
