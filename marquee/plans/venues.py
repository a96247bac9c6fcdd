"""Queries on known venues; nations stand for the list, customers for what is looked up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.operators import venues
from marquee.plans.registry import query
from marquee.session import table

_KEY = r"trim(regexp_replace(regexp_replace(lower({}), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g'))"


@query(
    "known_venues",
    rf"""WITH v AS (SELECT n_nationkey AS ord, {_KEY.format('n_name')} AS key, 'No. ' || n_nationkey || ', City ' || n_regionkey AS address FROM nation),
    q AS (SELECT c_custkey AS id, {_KEY.format("CASE WHEN c_custkey % 3 = 0 THEN n_name WHEN c_custkey % 3 = 1 THEN substr(n_name, 1, 4) ELSE 'Hall ' || c_custkey END")} AS q FROM customer JOIN nation ON c_nationkey = n_nationkey),
    e AS (SELECT id, arg_min(address, ord) AS a FROM q JOIN v ON v.key = q.q GROUP BY id), p AS (SELECT id, arg_min(address, ord) AS a FROM q JOIN v ON contains(v.key, q.q) OR contains(q.q, v.key) GROUP BY id)
    SELECT q.id, coalesce(e.a, p.a) AS address FROM q LEFT JOIN e ON q.id = e.id LEFT JOIN p ON q.id = p.id""",
)
def known_venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    known = n.select(k.alias("ord"), F.col("n_name").alias("name"), F.concat(F.lit("No. "), k.cast("string"), F.lit(", City "), F.col("n_regionkey").cast("string")).alias("address"))
    c = F.col("c_custkey")
    name = F.when(c % 3 == 0, F.col("n_name")).when(c % 3 == 1, F.substring("n_name", 1, 4)).otherwise(F.concat(F.lit("Hall "), c.cast("string")))
    t = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == k).select(c.alias("id"), name.alias("name"), F.lit("").alias("city"))
    return venues.looked_up(t, known).select("id", "address")
