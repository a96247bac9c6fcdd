"""Queries on the request log that the ``events`` table stands for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.operators import requests
from marquee.plans.derive import pick, pick_sql
from marquee.plans.registry import query
from marquee.session import table

CUTOFF_MS = 1_704_067_200_000


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("domain"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"),
        (F.col("event_type") != "error").cast("int").alias("success"),
        F.floor("value").alias("response_time"),
    )


LOG = "(SELECT event_id AS id, event_type AS domain, epoch_us(ts) // 1000 AS timestamp, CAST(event_type <> 'error' AS INT) AS success, CAST(floor(value) AS BIGINT) AS response_time FROM events)"


@query(
    "request_domain_stats",
    f"""SELECT domain, count(*) AS total_requests, CAST(sum(success) AS BIGINT) AS successful_requests,
        printf('%.2f%%', sum(success) * 100 / count(*)) AS success_rate
        FROM {LOG} WHERE timestamp > {CUTOFF_MS} GROUP BY domain""",
)
def request_domain_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.domain_stats(request_log(spark, sf_dir), CUTOFF_MS)


@query("request_limits", f"SELECT domain, count(*) AS requests, count(*) >= 1000 AS blocked FROM {LOG} WHERE timestamp > {CUTOFF_MS} - 3600000 GROUP BY domain")
def request_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.over_limit(request_log(spark, sf_dir), CUTOFF_MS, 3_600_000, 1000)


@query(
    "request_waits",
    f"""WITH g AS (SELECT id, domain, timestamp - lag(timestamp) OVER (PARTITION BY domain ORDER BY timestamp, id) AS gap_ms FROM {LOG}) SELECT id, domain, gap_ms, CASE WHEN gap_ms IS NULL THEN 0 ELSE greatest(0, 60000 - gap_ms) END AS wait_ms FROM g""",
)
def request_waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.waits(request_log(spark, sf_dir), 60_000).select("id", "domain", "gap_ms", "wait_ms")


@query(
    "request_overall",
    f"""SELECT count(*) AS requests, CAST(sum(success) AS BIGINT) AS successes, CAST(floor(sum(success) * 100.0 / count(*) + 0.5) AS BIGINT) AS success_rate, CAST(median(response_time) AS DOUBLE) AS median_ms, CAST(quantile_disc(response_time, 0.95) AS DOUBLE) AS p95_ms FROM {LOG}""",
)
def request_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.overall(request_log(spark, sf_dir)).withColumn("p95_ms", F.col("p95_ms").cast("double"))


@query("request_last", f"SELECT domain, max(timestamp) AS last_ms FROM {LOG} GROUP BY domain")
def request_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.last_request(request_log(spark, sf_dir))


MESSAGES = ["Timeout of 5 s", "Cloudflare check", "HTTP 429", "solve the CAPTCHA", "ECONNREFUSED", "403 Forbidden", "odd", "", "rate limit hit"]


@query(
    "error_classes",
    f"""WITH t AS (SELECT event_id AS id, lower({pick_sql('event_id', MESSAGES)}) AS m FROM events) SELECT id, CASE WHEN contains(m, 'timeout') THEN 'TIMEOUT' WHEN contains(m, 'cloudflare') THEN 'CLOUDFLARE' WHEN contains(m, 'rate limit') OR contains(m, '429') THEN 'RATE_LIMIT'
    WHEN contains(m, 'captcha') THEN 'CAPTCHA' WHEN contains(m, 'network') OR contains(m, 'econnrefused') THEN 'NETWORK' WHEN contains(m, 'blocked') OR contains(m, '403') THEN 'BLOCKED' ELSE 'UNKNOWN' END AS error_class, CAST(least(1000 * pow(2, id % 12), 300000) AS BIGINT) AS backoff_ms FROM t""",
)
def error_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select(i.alias("id"), requests.error_class(pick(i, MESSAGES)).alias("error_class"), requests.backoff_ms(i % 12).alias("backoff_ms"))


@query("cache_last_write", f"SELECT domain AS url, max(timestamp) AS timestamp, CAST(0 AS BIGINT) AS hits FROM {LOG} GROUP BY domain")
def cache_last_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = request_log(spark, sf_dir).select(F.col("domain").alias("url"), F.col("response_time").cast("string").alias("data"), "timestamp", F.col("id").alias("ord"))
    return requests.last_write(cache).select("url", "timestamp", "hits")
