"""Queries on result quality; line items stand for results, with discount and tax as measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.operators import quality as q
from marquee.plans.registry import query
from marquee.session import table


@query(
    "quality_accuracy",
    """WITH r AS (SELECT l_returnflag AS category, CAST(CASE WHEN l_linenumber = 7 THEN NULL ELSE 50 + l_partkey % 51 END AS DOUBLE) AS a FROM lineitem), g AS (SELECT category, avg(a) AS m, count(*) AS n,
      count_if(a >= 90) AS bin_90, count_if(a >= 80 AND a < 90) AS bin_80, count_if(a >= 70 AND a < 80) AS bin_70, count_if(a >= 60 AND a < 70) AS bin_60, count_if(a < 60) AS bin_0 FROM r WHERE a IS NOT NULL GROUP BY category)
    SELECT category, CAST(floor(m * 1000 + 0.5) AS BIGINT) AS average, n, CAST(bin_90 AS BIGINT) AS bin_90, CAST(bin_80 AS BIGINT) AS bin_80, CAST(bin_70 AS BIGINT) AS bin_70, CAST(bin_60 AS BIGINT) AS bin_60, CAST(bin_0 AS BIGINT) AS bin_0,
      CASE WHEN m >= 90 THEN 'A' WHEN m >= 80 THEN 'B' WHEN m >= 70 THEN 'C' WHEN m >= 60 THEN 'D' ELSE 'F' END AS grade FROM g""",
)
def quality_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.when(F.col("l_linenumber") != 7, 50 + F.col("l_partkey") % 51).cast("double")
    return q.accuracy(table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("category"), a.alias("accuracy"))).withColumn("average", F.floor(F.col("average") * 1000 + 0.5))


@query(
    "quality_ranks",
    """WITH r AS (SELECT l_returnflag AS category, CAST(l_quantity AS BIGINT) AS v FROM lineitem), o AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY category) AS n FROM r)
    SELECT category, min(v) FILTER (WHERE i >= n // 2) AS upper_median, min(v) FILTER (WHERE i >= least(n * 95 // 100, n - 1)) AS p95, min(v) FILTER (WHERE i >= (n * 95 + 99) // 100 - 1) AS p95_nearest FROM o GROUP BY category""",
)
def quality_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("category"), F.col("l_quantity").cast("long").alias("v"))
    return q.by_rank(rows, "v", ["category"])


@query(
    "quality_spread",
    """WITH v AS (SELECT l_linestatus AS category, CAST(floor(l_quantity) AS DOUBLE) AS x, CAST(l_partkey % 100 AS DOUBLE) AS y FROM lineitem)
    SELECT category, CAST(round(1000 * greatest(0, 100 - stddev_pop(x) * 100 / avg(x))) AS BIGINT) AS consistency, CAST(round(1000 * coalesce(corr(x, y), 0)) AS BIGINT) AS correlation, CAST(round(1000 * avg(y) FILTER (WHERE x >= 40)) AS BIGINT) AS calibration FROM v GROUP BY category""",
)
def quality_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("category"), F.floor("l_quantity").cast("double").alias("x"), (F.col("l_partkey") % 100).cast("double").alias("y"))
    x, y = F.col("x"), F.col("y")
    r = lambda c: F.round(1000 * c).cast("long")
    return v.groupBy("category").agg(r(q.consistency(x)).alias("consistency"), r(q.correlation(x, y)).alias("correlation"), r(q.calibration(x, y, 40)).alias("calibration"))


@query(
    "quality_groups",
    """WITH r AS (SELECT p_name AS input, CASE WHEN p_size % 2 = 0 THEN 'x' END AS date, CASE WHEN p_size % 5 <> 0 THEN 'x' ELSE '' END AS time FROM part), b AS (SELECT floor(length(input) / 20) * 20 AS band, CAST(coalesce(date, '') <> '' AS INT) AS d, CAST(coalesce(time, '') <> '' AS INT) AS t FROM r WHERE coalesce(input, '') <> '')
    SELECT CAST(band AS BIGINT) AS band, count(*) AS n, CAST(round(1000 * ((1 - var_pop(d)) * 50 + (1 - var_pop(t)) * 50)) AS BIGINT) AS consistency FROM b GROUP BY band HAVING count(*) > 1""",
)
def quality_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size")
    rows = table(spark, sf_dir, "part").select(F.col("p_name").alias("input"), F.when(s % 2 == 0, "x").alias("date"), F.when(s % 5 != 0, "x").otherwise("").alias("time"))
    return q.group_consistency(rows, ["date", "time"]).withColumn("consistency", F.round(1000 * F.col("consistency")).cast("long"))


@query(
    "quality_trend",
    """WITH r AS (SELECT event_type, floor(value) AS v, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
    SELECT event_type, CAST(round(1000 * (avg(v) FILTER (WHERE i > n // 2) - avg(v) FILTER (WHERE i <= n // 2))) AS BIGINT) AS trend FROM r GROUP BY event_type""",
)
def quality_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", "event_id", F.floor("value").cast("double").alias("v"))
    return q.trend(rows, "v", "event_id", ["event_type"]).withColumn("trend", F.round(1000 * F.col("trend")).cast("long"))


@query(
    "quality_scores",
    """WITH c AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN '1 A St, Austin' WHEN 2 THEN 'Austin' ELSE 'Elsewhere' END AS address, CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN '2024-05-01' ELSE 'soon' END AS d, CASE c_custkey % 2 WHEN 0 THEN '' ELSE '19:00' END AS t FROM customer)
    SELECT id, CAST(CASE WHEN address = '' THEN 50 ELSE 100 - CASE WHEN contains(address, ',') THEN 0 ELSE 30 END - CASE WHEN contains(lower(address), 'austin') THEN 0 ELSE 20 END END AS INT) AS address_quality,
    CAST(100 - CASE WHEN d = '' THEN 50 WHEN d = 'soon' THEN 40 WHEN d < '2024-06-01' THEN 20 ELSE 0 END - CASE WHEN t = '' THEN 30 ELSE 0 END AS INT) AS date_quality,
    CAST(100 - CASE WHEN d = '' THEN 20 ELSE 0 END - CASE WHEN address = '' THEN 20 ELSE 0 END - CASE WHEN address <> '' AND NOT contains(address, ',') THEN 20 ELSE 0 END AS INT) AS compliance FROM c""",
)
def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    address = F.when(c % 4 == 0, "").when(c % 4 == 1, "1 A St, Austin").when(c % 4 == 2, "Austin").otherwise("Elsewhere")
    d, t = F.when(c % 3 == 0, "").when(c % 3 == 1, "2024-05-01").otherwise("soon"), F.when(c % 2 == 0, "").otherwise("19:00")
    rows = table(spark, sf_dir, "customer").select(c.alias("id"), address.alias("address"), d.alias("d"), t.alias("t"))
    a = F.col("address")
    return rows.select("id", q.address_quality(a).alias("address_quality"), q.date_quality(F.col("d"), F.col("t"), F.lit("2024-06-01").cast("date")).alias("date_quality"), q.compliance([F.col("d"), a], a).alias("compliance"))
