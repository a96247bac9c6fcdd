"""Queries on choices among images, on caches and proxies, and on summaries of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.operators import images, layers, quality, requests
from marquee.plans import derive
from marquee.plans.registry import query
from marquee.session import table
from marquee.sources import readers, writers


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of parts: several of each supplier's, with sizes in their URLs, scores, and some that are missing."""
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    url = F.concat(F.lit("https://cdn.example/e/"), (p % 5).cast("string"), F.when(p % 3 == 0, "_large").when(p % 3 == 1, "_thumb").otherwise(""), F.lit(".jpg"), F.when(p % 2 == 0, "?v=1").otherwise(""))
    rows = table(spark, sf_dir, "lineitem").filter("l_linenumber = 1").select(s.alias("event_id"), F.col("l_orderkey").alias("ord"), url.alias("url"), F.when(p % 7 > 0, (p % 13 - 3).cast("double")).alias("score"))
    return rows.withColumns({"width": (F.lit(250) + F.col("ord") % 900).cast("int"), "height": (F.lit(260) + F.col("ord") % 700).cast("int")})


_CANDIDATES = """(SELECT *, CAST(250 + ord % 900 AS INT) AS width, CAST(260 + ord % 700 AS INT) AS height FROM (SELECT l_suppkey AS event_id, l_orderkey AS ord, 'https://cdn.example/e/' || l_partkey % 5 || CASE l_partkey % 3 WHEN 0 THEN '_large' WHEN 1 THEN '_thumb' ELSE '' END || '.jpg' || CASE WHEN l_partkey % 2 = 0 THEN '?v=1' ELSE '' END AS url,
  CASE WHEN l_partkey % 7 > 0 THEN CAST(l_partkey % 13 - 3 AS DOUBLE) END AS score, 'https://cdn.example/e/' || l_partkey % 5 || '.jpg' AS plain FROM lineitem WHERE l_linenumber = 1))"""


@query("distinct_images", f"SELECT event_id, ord, url FROM {_CANDIDATES} QUALIFY row_number() OVER (PARTITION BY event_id, plain ORDER BY ord) = 1")
def distinct_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.distinct_images(candidates(spark, sf_dir)).select("event_id", "ord", "url")


@query("first_of_url", f"SELECT event_id, ord, url FROM {_CANDIDATES} QUALIFY row_number() OVER (PARTITION BY event_id, url ORDER BY ord) = 1")
def first_of_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.first_of_url(candidates(spark, sf_dir)).select("event_id", "ord", "url")


@query("best_image", f"SELECT event_id, url FROM {_CANDIDATES} QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY coalesce(score, -1) DESC, ord) = 1")
def best_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.best_image(candidates(spark, sf_dir))


@query("positive_images", f"SELECT event_id, ord, CAST(row_number() OVER (PARTITION BY event_id ORDER BY score DESC, ord) AS INT) AS rank FROM {_CANDIDATES} WHERE score > 0")
def positive_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.positive(candidates(spark, sf_dir)).select("event_id", "ord", "rank")


_R = "(width * 1.0 / height)"
_RATIO = f"CASE WHEN abs({_R} - 1.0) < 0.05 THEN 100 WHEN abs({_R} - 0.8) < 0.05 THEN 95 WHEN abs({_R} - 0.5625) < 0.05 THEN 90 WHEN abs({_R} - 0.618) < 0.05 THEN 85 WHEN {_R} >= 0.7 AND {_R} <= 1.3 THEN greatest(60, 80 - abs({_R} - 1.0) * 100) WHEN {_R} > 1.3 AND {_R} < 2.0 THEN 30 WHEN {_R} < 0.5 OR {_R} > 2.0 THEN 10 ELSE 40 END"
_PIXELS = "(CAST(width AS DOUBLE) * height / 1048576)"


@query(
    "image_shapes",
    f"""SELECT event_id, ord, CAST({_RATIO} AS DECIMAL(9, 4)) AS ratio, CAST(CASE WHEN width >= 600 AND height >= 600 THEN CASE WHEN {_PIXELS} >= 1 THEN 100 WHEN {_PIXELS} >= 0.5 THEN 90 ELSE 80 END WHEN width >= 300 AND height >= 300 THEN CASE WHEN {_PIXELS} >= 0.3 THEN 70 ELSE 60 END ELSE 20 END AS INT) AS size FROM {_CANDIDATES}""",
)
def image_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marquee.functions import images as scores

    ratio = F.col("width") / F.col("height")
    return candidates(spark, sf_dir).select("event_id", "ord", scores.ratio_score(ratio).cast("decimal(9,4)").alias("ratio"), scores.size_score(F.col("width"), F.col("height")).alias("size"))


@query(
    "scored_images",
    """SELECT event_id, count(*) AS n, CAST(min(ord) AS BIGINT) AS first FROM (SELECT l_suppkey AS event_id, l_orderkey AS ord, 250 + l_orderkey % 900 AS w, 260 + l_orderkey % 700 AS h FROM lineitem WHERE l_linenumber = 1) WHERE w >= 300 AND h >= 300 GROUP BY event_id""",
)
def scored_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = candidates(spark, sf_dir).withColumns({"title": F.lit("Night"), "venue": F.lit("Hall")})
    return images.scored_images(rows).groupBy("event_id").agg(F.count("*").alias("n"), F.min("ord").alias("first"))


_LOG = "(SELECT o_orderkey AS ord, 'u' || o_custkey AS url, CAST(epoch(o_orderdate) AS BIGINT) * 1000 + o_orderkey % 1000 AS timestamp, o_orderkey % 9 AS hits, o_orderpriority AS data FROM orders)"


def cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("ord"), F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("url"), (F.unix_seconds(F.col("o_orderdate").cast("timestamp")) * 1000 + k % 1000).alias("timestamp"), (k % 9).alias("hits"), F.col("o_orderpriority").alias("data"))


_NOW, _TTL = 850_000_000_000, 40_000_000_000


@query("cache_counts", f"SELECT count(*) AS entries, CAST(sum(hits) AS BIGINT) AS hits, CAST(count(*) FILTER (WHERE timestamp > {_NOW - _TTL}) AS BIGINT) AS fresh, CAST(count(*) FILTER (WHERE timestamp < {_NOW - _TTL}) AS BIGINT) AS expired FROM {_LOG}")
def cache_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cache(spark, sf_dir)
    fresh = requests.fresh(c, _NOW, _TTL).agg(F.count("*").alias("fresh"))
    old = requests.expired(c, _NOW, _TTL).agg(F.count("*").alias("expired"))
    one = lambda df: df.withColumn("_one", F.lit(1))
    return one(requests.cache_stats(c)).join(one(fresh), "_one").join(one(old), "_one").drop("_one")


@query("cache_hit_rate", "SELECT count(*) FILTER (WHERE o_custkey % 3 > 0) AS hits, count(*) FILTER (WHERE o_custkey % 3 = 0) AS misses, printf('%.2f%%', count(*) FILTER (WHERE o_custkey % 3 > 0) * 100.0 / count(*)) AS hit_rate FROM orders")
def cache_hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.hit_rate(table(spark, sf_dir, "orders").select((F.col("o_custkey") % 3 > 0).alias("hit")))


@query(
    "cache_reads",
    f"""WITH r AS (SELECT *, ord % 3 = 0 AS written, max(CASE WHEN ord % 3 = 0 THEN timestamp END) OVER w AS since, count(*) FILTER (WHERE ord % 3 = 0) OVER w AS turn FROM {_LOG} WINDOW w AS (PARTITION BY url ORDER BY timestamp, ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    h AS (SELECT *, NOT written AND since IS NOT NULL AND timestamp - since <= {_TTL} AS hit FROM r),
    n AS (SELECT *, count(*) FILTER (WHERE hit) OVER (PARTITION BY url, turn ORDER BY timestamp, ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS told FROM h),
    s AS (SELECT ord, url, data AS stored, turn FROM n WHERE written)
    SELECT n.ord, hit, CASE WHEN hit THEN s.stored END AS data, CASE WHEN hit THEN n.told END AS hits FROM n LEFT JOIN s ON n.url = s.url AND n.turn = s.turn WHERE NOT written""",
)
def cache_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = cache(spark, sf_dir).select("ord", "url", F.when(F.col("ord") % 3 == 0, "set").otherwise("get").alias("kind"), "data", F.col("timestamp").alias("at"))
    return requests.replayed(log, _TTL).select("ord", "hit", "data", "hits")


@query(
    "next_proxies",
    """SELECT s_suppkey AS ord, s_name AS proxy, CAST(s_suppkey % 4 AS INT) AS failures FROM supplier ORDER BY CASE WHEN s_suppkey % 4 >= 3 THEN 1 ELSE 0 END, s_suppkey % 4, CASE WHEN s_suppkey % 5 = 0 THEN 999999 ELSE s_suppkey * 37 % 500 + 1 END, s_suppkey LIMIT 1""",
)
def next_proxies(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(k.alias("ord"), F.col("s_name").alias("proxy"), (k % 4).cast("int").alias("failures"), F.when(k % 10 == 0, 0).when(k % 5 != 0, k * 37 % 500 + 1).alias("response_time"))
    return requests.next_proxy(rows).drop("response_time")


@query(
    "field_completeness",
    f"SELECT collection, count(*) FILTER (WHERE title <> '') * 100.0 / count(*) AS title, count(*) FILTER (WHERE city <> '') * 100.0 / count(*) AS city, count(*) FILTER (WHERE address <> '') * 100.0 / count(*) AS address FROM {derive.EVENTS} e GROUP BY collection",
)
def field_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.events(spark, sf_dir).groupBy("collection").agg(*(c.alias(f) for f, c in quality.completeness(["title", "city", "address"]).items()))


@query(
    "result_consistency",
    """WITH t AS (SELECT length(text) // 20 * 20 AS band, CASE WHEN lang = 'en' THEN 1 ELSE 0 END AS a, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS b FROM documents WHERE text <> ''),
    g AS (SELECT band, (1 - var_pop(a)) * 50 + (1 - var_pop(b)) * 50 AS c FROM t GROUP BY band HAVING count(*) > 1) SELECT CAST(avg(c) AS DECIMAL(12, 6)) AS consistency, count(*) AS groups FROM g""",
)
def result_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("text").alias("input"), F.when(F.col("lang") == "en", "x").alias("a"), F.when(F.col("doc_id") % 3 == 0, 1).alias("b"))
    return quality.mean_consistency(rows, ["a", "b"]).withColumn("consistency", F.col("consistency").cast("decimal(12,6)"))


@query(
    "metric_changes",
    """WITH c AS (SELECT p_name || p_partkey AS metric, CAST(p_size AS DOUBLE) AS v, p_partkey % 3 > 0 AS up, p_partkey AS k FROM part), b AS (SELECT *, CAST(1 + k % 40 AS DOUBLE) AS base FROM c WHERE k % 5 > 0)
    SELECT c.metric, CAST((c.v - base) * 100.0 / base AS DECIMAL(12, 4)) AS change, CASE WHEN base IS NULL THEN 'new' WHEN (CASE WHEN c.up THEN 1 ELSE -1 END) * (c.v - base) * 100.0 / base < -10 THEN 'regression' WHEN (CASE WHEN c.up THEN 1 ELSE -1 END) * (c.v - base) * 100.0 / base > 10 THEN 'improvement' ELSE 'stable' END AS status FROM c LEFT JOIN b ON c.k = b.k""",
)
def metric_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    now = table(spark, sf_dir, "part").select(F.concat("p_name", k.cast("string")).alias("metric"), F.col("p_size").cast("double").alias("value"), (k % 3 > 0).alias("higher_is_better"), k.alias("k"))
    base = now.filter("k % 5 > 0").select("metric", (1 + F.col("k") % 40).cast("double").alias("value"))
    return quality.regressions(now, base).withColumn("change", F.col("change").cast("decimal(12,4)"))


@query(
    "price_growth",
    """WITH t AS (SELECT o_custkey, CAST(o_totalprice AS DOUBLE) AS v, o_orderkey FROM orders), g AS (SELECT o_custkey, arg_min(v, o_orderkey) AS a, arg_max(v, o_orderkey) AS b FROM t GROUP BY o_custkey) SELECT o_custkey, CAST((b - a) * 100.0 / a AS DECIMAL(18, 4)) AS growth FROM g""",
)
def price_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(quality.growth(F.col("o_totalprice").cast("double"), F.col("o_orderkey")).cast("decimal(18,4)").alias("growth"))


@query("most_frequent_priority", "SELECT o_orderpriority, count(*) AS n, min(o_orderkey) AS first FROM orders GROUP BY o_orderpriority ORDER BY n DESC, first DESC LIMIT 1")
def most_frequent_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.most_frequent(table(spark, sf_dir, "orders").withColumn("ord", F.col("o_orderkey")), "o_orderpriority")


@query("csv_lines", """SELECT concat_ws(',', coalesce(CAST(event_id AS VARCHAR), ''), CASE WHEN contains(address, ',') THEN '"' || address || '"' ELSE address END, city, CAST(has_image AS VARCHAR)) AS line FROM """ + derive.EVENTS + " e")
def csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writers.csv_lines(derive.events(spark, sf_dir).select("event_id", "address", "city", "has_image"))


@query(
    "merged_objects",
    """WITH t AS (SELECT CAST(p_partkey // 12 AS BIGINT) AS page_id, 'offers' AS field, 1 + p_partkey % 6 AS layer, CAST(p_size % 10 * 10 AS DOUBLE) AS confidence, 'k' || p_partkey % 5 AS k, p_brand AS v FROM part WHERE p_partkey % 7 > 0),
    e AS (SELECT page_id, field, k, v FROM t QUALIFY row_number() OVER (PARTITION BY page_id, field, k ORDER BY confidence, layer DESC, v DESC) = 1) SELECT page_id, field, string_agg(k || '=' || v, ',' ORDER BY k) AS object FROM e GROUP BY page_id, field""",
)
def merged_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").filter(k % 7 > 0).select(F.floor(k / 12).alias("page_id"), F.lit("offers").alias("field"), (1 + k % 6).alias("layer"), F.lit("object").alias("kind"), (F.col("p_size") % 10 * 10).cast("double").alias("confidence"), F.create_map(F.concat(F.lit("k"), (k % 5).cast("string")), F.col("p_brand")).alias("object"))
    return layers.merged_objects(rows).select("page_id", "field", F.array_join(F.transform(F.map_entries("object"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("object"))


@query(
    "kept_layers",
    """WITH t AS (SELECT CAST(p_partkey // 24 AS BIGINT) AS page_id, p_partkey % 4 AS f, p_partkey AS layer, CASE WHEN p_partkey % 5 = 0 THEN '' WHEN p_partkey % 11 = 0 THEN NULL ELSE p_brand END AS value, CAST(p_size % 4 * 25 AS DOUBLE) AS confidence FROM part)
    SELECT page_id, f AS field, s.value AS value, s.confidence AS confidence FROM (SELECT page_id, f, list_reduce(list({'value': value, 'confidence': confidence} ORDER BY layer), lambda a, x: CASE WHEN coalesce(a.value, '') = '' OR a.confidence < x.confidence THEN x ELSE a END) AS s FROM t GROUP BY page_id, f)""",
)
def kept_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(F.floor(k / 24).alias("page_id"), (k % 4).alias("field"), k.alias("layer"), F.when(k % 5 == 0, "").when(k % 11 != 0, F.col("p_brand")).alias("value"), (F.col("p_size") % 4 * 25).cast("double").alias("confidence"))
    return layers.kept_by_priority(rows)


@query("listed_files", "SELECT o_orderkey AS id, CASE WHEN o_custkey % 3 = 0 THEN 'events' ELSE 'drafts' END AS collection, 'e' || o_orderkey AS event_id, 'f' || o_custkey || '.png' AS file FROM orders WHERE o_orderkey % 4 > 0")
def listed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    path = F.concat(F.when(c % 3 == 0, "events").otherwise("drafts"), F.lit("/e"), k.cast("string"), F.when(k % 4 == 0, "").when(k % 4 == 1, F.concat(F.lit("/deep/f"), c.cast("string"), F.lit(".png"))).otherwise(F.concat(F.lit("/f"), c.cast("string"), F.lit(".png"))))
    return readers.listing_parts(table(spark, sf_dir, "orders").select(k.alias("id"), path.alias("path"))).drop("path")


@query(
    "listed_urls",
    "SELECT doc_id AS id, trim(l) AS value FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l FROM documents) WHERE trim(l) <> '' AND NOT starts_with(trim(l), '#')",
)
def listed_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.url_list(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("value")))


@query("deleted_events", f"SELECT event_id FROM {derive.EVENTS} e WHERE event_id % 10 <> 3")
def deleted_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derive.events(spark, sf_dir)
    return writers.delete(rows, rows.filter("event_id % 10 = 3"), ["collection", "event_id"]).select("event_id")
