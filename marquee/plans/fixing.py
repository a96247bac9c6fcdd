"""Queries that put derived values right and score them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.functions import fixes
from marquee.plans.derive import pick, pick_sql
from marquee.plans.registry import query
from marquee.session import table

PRICES = ["$25.00", "free entry", "12.345 at the door", "tba", "", "7"]
MAPPING = {"music": "Music", "concert": "Music", "bar": "Bars", "festival": "Festivals", "comedy": "Comedy Shows", "art": "Art Shows", "dance club": "Nightclubs"}
LABELS = ["Concert", "live music", "bars", "art festival", "fest", "unknown", "dance", "comedy"]


@query(
    "fixed_prices",
    rf"""WITH t AS (SELECT o_orderkey AS id, {pick_sql('o_orderkey', PRICES)} AS x FROM orders), n AS (SELECT *, try_cast(nullif(regexp_extract(x, '[\d.]+', 0), '') AS DOUBLE) AS v FROM t)
    SELECT id, CAST(CASE WHEN v IS NOT NULL THEN floor(v * 100 + 0.5) WHEN contains(lower(x), 'free') THEN 0 END AS BIGINT) AS cents, CAST(CASE WHEN v IS NOT NULL THEN 80 WHEN contains(lower(x), 'free') THEN 95 ELSE 50 END AS INT) AS confidence FROM n""",
)
def fixed_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    t = table(spark, sf_dir, "orders").select(k.alias("id"), fixes.fix_price(pick(k, PRICES)).alias("f"))
    return t.select("id", F.round(F.col("f.value") * 100).cast("long").alias("cents"), F.col("f.confidence").alias("confidence"))


_EXACT = " ".join(f"WHEN x = '{k}' THEN '{v}'" for k, v in MAPPING.items())
_PART = " ".join(f"WHEN contains(x, '{k}') OR contains('{k}', x) THEN '{v}'" for k, v in MAPPING.items())


@query(
    "mapped_categories",
    f"""WITH t AS (SELECT o_orderkey AS id, trim(lower({pick_sql('o_orderkey', LABELS)})) AS x FROM orders), m AS (SELECT id, CASE {_EXACT} END AS a, CASE {_PART} END AS b FROM t)
    SELECT id, coalesce(a, b) AS category, CAST(CASE WHEN a IS NOT NULL THEN 95 WHEN b IS NOT NULL THEN 80 END AS INT) AS confidence FROM m""",
)
def mapped_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    t = table(spark, sf_dir, "orders").select(k.alias("id"), fixes.map_category(pick(k, LABELS), MAPPING).alias("m"))
    return t.select("id", "m.category", "m.confidence")


@query(
    "weekdays",
    """WITH t AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS d, (6 - dayofweek(o_orderdate) + 7) % 7 AS s, (1 - dayofweek(o_orderdate) + 7) % 7 AS m FROM orders)
    SELECT id, CAST(d + CAST(s AS INT) AS DATE) AS weekend, CAST(d + CAST(CASE WHEN m = 0 THEN 14 ELSE m + 7 END AS INT) AS DATE) AS next_week,
    CAST(CASE WHEN d < DATE '1996-06-15' THEN make_date(CAST(year(d) + 1 AS INT), CAST(month(d) AS INT), 1) + CAST(day(d) - 1 AS INT) ELSE d END AS DATE) AS future FROM t""",
)
def weekdays(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), fixes.relative_week(d, False, "weekend").alias("weekend"), fixes.relative_week(d, True, "week").alias("next_week"), fixes.future_date(d, F.lit("1996-06-15").cast("date")).alias("future"))
