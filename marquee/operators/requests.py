"""Request-log statistics over (id, domain, timestamp in ms, success 0/1, response_time)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.functions.common import contains_any, first_match, text
from marquee.operators.ranks import running


def domain_stats(log: DataFrame, cutoff_ms: int) -> DataFrame:
    """Requests, successes and success rate in percent (2 decimals, as text) per domain after ``cutoff_ms`` (strictly)."""
    return (
        log.filter(F.col("timestamp") > cutoff_ms)
        .groupBy("domain")
        .agg(F.count("*").alias("total_requests"), F.sum("success").cast("long").alias("successful_requests"))
        .withColumn("success_rate", F.format_string("%.2f%%", F.col("successful_requests") * 100 / F.col("total_requests")))
    )


def over_limit(log: DataFrame, as_of_ms: int, window_ms: int, threshold: int) -> DataFrame:
    """Per domain: requests in the window before ``as_of_ms`` and whether they reach ``threshold``."""
    recent = log.filter(F.col("timestamp") > as_of_ms - window_ms)
    return recent.groupBy("domain").agg(F.count("*").alias("requests")).withColumn("blocked", F.col("requests") >= threshold)


def waits(log: DataFrame, delay_ms: int, slice_ms: int = 3_600_000) -> DataFrame:
    """Each request's gap to the one before it on its domain, and what was left of the delay then.

    Domains are few and logs long, so a domain is cut into slices of time: a
    slice's first request takes the last one of the slices before it.
    """
    cut = log.withColumn("_slice", F.floor(F.col("timestamp") / slice_ms))
    last = cut.groupBy("domain", "_slice").agg(F.max("timestamp").alias("_last"))
    earlier = F.lag("_last").over(Window.partitionBy("domain").orderBy("_slice"))
    last = last.select("domain", "_slice", earlier.alias("_earlier"))
    w = Window.partitionBy("domain", "_slice").orderBy("timestamp", "id")
    gap = F.col("timestamp") - F.coalesce(F.lag("timestamp").over(w), "_earlier")
    out = cut.join(last, ["domain", "_slice"]).withColumn("gap_ms", gap)
    return out.withColumn("wait_ms", F.greatest(F.lit(0), delay_ms - F.col("gap_ms"))).select(*log.columns, "gap_ms", "wait_ms")


def last_request(log: DataFrame) -> DataFrame:
    return log.groupBy("domain").agg(F.max("timestamp").alias("last_ms"))


def overall(log: DataFrame) -> DataFrame:
    """Totals with a rounded success rate (0 without requests), median and nearest-rank p95 of response times.

    Response times are counted by value and the counts cumulated by ranges, so no state holds all values.
    """
    rate = F.coalesce(F.floor(F.try_divide(F.sum("success") * 100.0, F.count("*")) + 0.5), F.lit(0))
    ranks = running(log.groupBy("response_time").agg(F.count("*").alias("_c")).filter("response_time is not null").withColumn("_all", F.lit(1)), ["_all"], "response_time", F.col("_c"))
    n, upto = F.col("_total"), F.col("_upto")
    at = lambda place: F.min(F.when(upto >= place, F.col("response_time")))
    middle = ((at(F.floor((n + 1) / 2)) + at(F.floor(n / 2) + 1)) / 2.0).alias("median_ms")
    spread = ranks.agg(middle, at(F.ceil(n * 95 / 100)).alias("p95_ms"))
    totals = log.agg(F.count("*").alias("requests"), F.sum("success").alias("successes"), rate.alias("success_rate"))
    one = lambda df: df.withColumn("_one", F.lit(1))
    return one(totals).join(one(spread), "_one").drop("_one")


def next_proxy(proxies: DataFrame, most_failures: int = 3) -> DataFrame:
    """The proxy to use: fewest failures, then fastest (missing or 0 last), then first; failed ones only if all have failed."""
    order = [(F.col("failures") >= most_failures).cast("int"), F.col("failures"), F.coalesce(F.nullif("response_time", F.lit(0)), F.lit(999_999)), F.col("ord")]
    return proxies.orderBy(*order).limit(1)


def cache_stats(cache: DataFrame) -> DataFrame:
    """Entries and hits; hits are null for an empty cache."""
    return cache.agg(F.count("*").alias("entries"), F.sum("hits").alias("hits"))


def hit_rate(log: DataFrame) -> DataFrame:
    """hits, misses and the share of hits in percent as text, '0%' without lookups; rows: hit (boolean)."""
    out = log.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
    total = F.col("hits") + F.col("misses")
    return out.withColumn("hit_rate", F.when(total > 0, F.format_string("%.2f%%", F.col("hits") * 100 / total)).otherwise("0%"))


def fresh(cache: DataFrame, now_ms: int, ttl_ms: int) -> DataFrame:
    """Entries younger than the time to live."""
    return cache.filter(F.col("timestamp") > now_ms - ttl_ms)


def expired(cache: DataFrame, now_ms: int, ttl_ms: int) -> DataFrame:
    """Entries that a sweep deletes (strictly older)."""
    return cache.filter(F.col("timestamp") < now_ms - ttl_ms)


def last_write(cache: DataFrame) -> DataFrame:
    """One entry per URL, the last written; its hits start anew."""
    last = cache.groupBy("url").agg(F.max(F.struct("timestamp", "ord", "data")).alias("e"))
    return last.select("url", "e.data", "e.timestamp", F.lit(0).cast("long").alias("hits"))


def replayed(log: DataFrame, ttl_ms: int) -> DataFrame:
    """Reads of a cache as it stood then: rows of ``log`` with kind ``get`` and hit, data (what was stored, for hits) and hits (of the entry, with this one).

    log: ord, url, kind (``get`` or ``set``), data, at (ms). A read hits the
    last write before it unless that is older than the time to live; every write
    starts the count of hits anew. Of one time, rows go by ord.
    """
    upto = Window.partitionBy("url").orderBy("at", "ord").rowsBetween(Window.unboundedPreceding, 0)
    written = F.col("kind") == "set"
    last = F.last(F.when(written, F.struct("at", "data")), ignorenulls=True).over(upto)
    rows = log.withColumns({"_last": last, "_turn": F.count(F.when(written, 1)).over(upto)})
    hit = F.coalesce(~written & (F.col("at") - F.col("_last.at") <= ttl_ms), F.lit(False))
    turn = Window.partitionBy("url", "_turn").orderBy("at", "ord").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("hit", hit).withColumn("_hits", F.count(F.when(F.col("hit"), 1)).over(turn)).filter(~written)
    return rows.withColumns({"data": F.when(F.col("hit"), F.col("_last.data")), "hits": F.when(F.col("hit"), F.col("_hits"))}).drop("_last", "_turn", "_hits", "kind")


#: What messages say, in order, and the class of the error.
ERROR_CLASSES = [(["timeout"], "TIMEOUT"), (["cloudflare"], "CLOUDFLARE"), (["rate limit", "429"], "RATE_LIMIT"), (["captcha"], "CAPTCHA"), (["network", "econnrefused"], "NETWORK"), (["blocked", "403"], "BLOCKED")]


def error_class(message: Column) -> Column:
    lower = F.lower(text(message))
    return first_match([(contains_any(lower, words), F.lit(name)) for words, name in ERROR_CLASSES], F.lit("UNKNOWN"))


def backoff_ms(count: Column) -> Column:
    return F.least(1000 * F.pow(F.lit(2.0), F.least(count, F.lit(60))), F.lit(300_000.0)).cast("long")
