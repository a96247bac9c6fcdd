"""Queries on event collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.functions import places
from marquee.operators import events as ops
from marquee.plans.derive import EVENTS, events, pick, pick_sql
from marquee.plans.registry import query
from marquee.plans.scalars import _IS_AUSTIN
from marquee.session import table

PATTERNS = ["weekly", "biweekly", "monthly", "custom"]


@query(
    "venue_stats",
    f"""SELECT venue, count(*) AS events, arg_max(trim(address), ord) FILTER (WHERE trim(address) <> '') AS address FROM {EVENTS} WHERE trim(venue) <> '' GROUP BY venue ORDER BY events DESC, venue LIMIT 30""",
)
def venue_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.venue_stats(events(spark, sf_dir))


@query(
    "copy_plan",
    f"""SELECT CASE WHEN {_IS_AUSTIN} THEN 'skipped' WHEN event_id IN (SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '1%') THEN 'existing' ELSE 'copied' END AS status, count(*) AS n FROM {EVENTS} GROUP BY 1""",
)
def copy_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = table(spark, sf_dir, "orders").filter(F.col("o_orderpriority").startswith("1")).select(F.col("o_orderkey").alias("event_id"))
    plan = ops.copy_plan(events(spark, sf_dir), there, places.is_bay_area_event(F.col("address"), F.col("city")))
    return plan.groupBy("status").agg(F.count("*").alias("n"))


@query(
    "existing_events",
    f"""WITH e AS (SELECT * FROM {EVENTS}), s AS (SELECT title, date, venue, min(CASE collection WHEN 'events' THEN 0 WHEN 'austinEvents' THEN 1 ELSE 2 END) AS r FROM e WHERE event_id % 2 = 0 GROUP BY ALL)
    SELECT event_id, CASE r WHEN 0 THEN 'events' WHEN 1 THEN 'austinEvents' WHEN 2 THEN 'bayAreaEvents' END AS found_in FROM e LEFT JOIN s USING (title, date, venue) WHERE event_id % 2 = 1""",
)
def existing_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd orders as submitted events against even ones as stored ones: all of the table takes part."""
    e = events(spark, sf_dir)
    rank = F.when(F.col("collection") == "events", 0).when(F.col("collection") == "austinEvents", 1).otherwise(2)
    return ops.existing(e.filter("event_id % 2 = 1").drop("collection"), e.filter("event_id % 2 = 0").withColumn("source_rank", rank)).select("event_id", "found_in")


@query(
    "repeat_events",
    """WITH e AS (SELECT o_orderkey AS event_id, CAST(o_orderdate AS DATE) AS d, list_extract(['weekly', 'biweekly', 'monthly', 'custom'], CAST(o_orderkey % 4 AS BIGINT) + 1) AS p, CASE WHEN o_custkey % 2 = 0 THEN 10 END AS days, unnest([1, 2, 3]) AS i FROM orders)
    SELECT event_id, CAST(i AS INT) AS i, CAST(CASE p WHEN 'weekly' THEN d + CAST(7 * i AS INT) WHEN 'biweekly' THEN d + CAST(14 * i AS INT) WHEN 'custom' THEN d + CAST(coalesce(days, 0) * i AS INT)
      ELSE CAST(date_trunc('month', d) + to_months(CAST(i AS INT)) AS DATE) + CAST(day(d) - 1 AS INT) END AS DATE) AS repeat_date FROM e""",
)
def repeat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    base = table(spark, sf_dir, "orders").select(k.alias("event_id"), F.to_date("o_orderdate").alias("d"), F.get(F.array(*map(F.lit, PATTERNS)), (k % 4).cast("int")).alias("p"), F.when(F.col("o_custkey") % 2 == 0, 10).alias("days"))
    return ops.repeats(base, F.col("d"), F.col("p"), F.lit(3), F.col("days")).select("event_id", "i", "repeat_date")


#: Files by an order's number: what is an image, a thumbnail, and neither.
FILES = ["event_image.png", "event_thumbnail.jpg", "notes.txt", "thumb.jpg", "event_thumbnail.png", "event_image.jpg", "photo.png"]
_LISTED = f"""l AS (SELECT o_orderkey AS ord, CASE WHEN o_orderkey % 7 = 0 THEN 'venues' ELSE 'events' END AS collection, CAST(o_custkey % 2000 AS VARCHAR) AS event_id, {pick_sql('(o_orderkey + o_custkey)', FILES)} AS file, o_orderkey % 900 AS size FROM orders WHERE o_orderkey % 11 <> 0),
    e AS (SELECT collection, event_id, bool_or(file IN ('event_image.png', 'event_image.jpg')) AS i, bool_or(file IN ('event_thumbnail.png', 'event_thumbnail.jpg')) AS t, min(ord) AS first, max(ord) AS last,
      arg_max(size, ord) FILTER (WHERE file IN ('event_image.png', 'event_image.jpg')) AS s FROM l GROUP BY ALL)"""


def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    collection = F.when(k % 7 == 0, "venues").otherwise("events")
    deeper = F.when(k % 5 == 0, "/old.txt").otherwise("")  # the third part is the file, whatever follows
    path = F.when(k % 11 == 0, F.lit("events/loose.png")).otherwise(F.concat(F.concat_ws("/", collection, (c % 2000).cast("string"), pick(k + c, FILES)), deeper))
    return table(spark, sf_dir, "orders").select(path.alias("path"), (k % 900).alias("size"), k.alias("ord"))


@query(
    "image_audit",
    f"""WITH {_LISTED} SELECT collection, count(*) AS events, count_if(i AND t) AS both, count_if(i AND NOT t) AS image_only, count_if(NOT i AND t) AS thumbnail_only, count_if(NOT i AND NOT t) AS neither, CAST(ceil(count_if(NOT i AND t) / 500) AS BIGINT) AS batches FROM e GROUP BY collection""",
)
def image_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.image_audit(_listing(spark, sf_dir)).withColumns({c: F.col(c).cast("long") for c in ("both", "image_only", "thumbnail_only", "neither", "batches")})


@query(
    "full_scan",
    f"""WITH {_LISTED}, r AS (SELECT *, row_number() OVER (PARTITION BY collection, i AND NOT t ORDER BY first, event_id) AS r FROM e)
    SELECT collection, count(*) AS events, count_if(i) AS with_images, count_if(t) AS with_thumbnails, count_if(i AND NOT t) AS needing_thumbnails, CAST(round(1000 * avg(CASE WHEN i AND NOT t THEN s END)) AS BIGINT) AS mean_size,
    coalesce(string_agg(event_id, ',' ORDER BY r) FILTER (WHERE i AND NOT t AND r <= 5), '') AS examples FROM r GROUP BY collection""",
)
def full_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ops.full_scan(_listing(spark, sf_dir))
    return out.select("collection", "events", *(F.col(c).cast("long").alias(c) for c in ("with_images", "with_thumbnails", "needing_thumbnails")), F.round(1000 * F.col("mean_image_size")).cast("long").alias("mean_size"), "examples")


@query("needing_thumbnails", f"WITH {_LISTED} SELECT collection, event_id FROM e WHERE i AND NOT t")
def needing_thumbnails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.needing_thumbnails(_listing(spark, sf_dir))


@query("recent_needing_images", f"WITH {_LISTED} SELECT collection, event_id, last AS last_ord FROM e WHERE t AND NOT i ORDER BY last DESC, event_id LIMIT 50")
def recent_needing_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.needing_images(_listing(spark, sf_dir), 50)


@query(
    "first_files",
    f"""WITH o AS (SELECT o_orderkey AS ord, o_custkey % 2000 AS c, {pick_sql('(o_orderkey + o_custkey)', FILES)} AS file FROM orders ORDER BY o_orderkey LIMIT 50)
    SELECT CAST(c AS VARCHAR) AS event_id, string_agg(file, ',' ORDER BY ord) AS files FROM o WHERE ord % 11 <> 0 GROUP BY c""",
)
def first_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.first_files(_listing(spark, sf_dir))


@query(
    "venue_regions",
    f"""WITH v AS (SELECT venue, count(*) AS events, lower(coalesce(arg_max(trim(address), ord) FILTER (WHERE trim(address) <> ''), 'address not found')) AS a FROM {EVENTS} WHERE trim(venue) <> '' GROUP BY venue)
    SELECT venue, events, contains(a, 'austin') OR contains(a, ', tx') AS in_austin, contains(a, 'san francisco') OR contains(a, 'oakland') OR contains(a, 'berkeley') OR contains(a, ', ca') AS in_bay_area,
    NOT (contains(a, 'austin') OR contains(a, ', tx') OR contains(a, 'san francisco') OR contains(a, 'oakland') OR contains(a, 'berkeley') OR contains(a, ', ca')) AS elsewhere FROM v""",
)
def venue_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.venue_regions(ops.venue_stats(events(spark, sf_dir))).drop("address")


_STAMPS = "CAST(o_orderdate AS DATE) + INTERVAL 19 HOUR"


@query(
    "repeat_copies",
    f"""WITH e AS (SELECT CAST(o_orderkey AS VARCHAR) AS original_id, {_STAMPS} AS s, CASE WHEN o_orderkey % 3 > 0 THEN {_STAMPS} + INTERVAL 5 HOUR END AS e, unnest([1, 2]) AS i FROM orders)
    SELECT original_id, CAST(i AS INT) AS i, strftime(s + to_days(CAST(14 * i AS INT)), '%Y-%m-%d') AS date, s + to_days(CAST(14 * i AS INT)) AS starts, e + to_days(CAST(14 * i AS INT)) AS ends, true AS is_repeat FROM e""",
)
def repeat_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    start = F.to_date("o_orderdate").cast("timestamp_ntz") + F.expr("INTERVAL 19 HOUR")
    base = table(spark, sf_dir, "orders").select(k.alias("event_id"), start.alias("startDateTimestamp"), F.when(k % 3 > 0, start + F.expr("INTERVAL 5 HOUR")).alias("endDateTimestamp"))
    out = ops.repeat_copies(ops.repeats(base, F.to_date("startDateTimestamp"), F.lit("biweekly"), F.lit(2), F.lit(None).cast("int")))
    return out.select("original_id", "i", "date", F.col("startDateTimestamp").alias("starts"), F.col("endDateTimestamp").alias("ends"), "is_repeat")


@query(
    "stored_forms",
    f"""WITH e AS (SELECT *, event_id % 5 AS f FROM {EVENTS}) SELECT event_id, coalesce(nullif(title, ''), 'Event Title TBD') AS legacy_title, coalesce(nullif(address, ''), 'Address TBD') AS legacy_place, coalesce(nullif(CASE WHEN f = 1 THEN '' ELSE startTime END, ''), '19:00:00') AS start,
    title AS form_title, f = 2 AS free, CASE f WHEN 3 THEN 'https://a.example/t' WHEN 4 THEN 'https://b.example/t' ELSE '' END AS link, date >= '1996-06-14' AS is_recent, CASE WHEN f = 0 THEN date || ' 00:00:00' ELSE date || ' 20:00:00' END AS starts FROM e""",
)
def stored_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event in its older form, as a form shows it, refreshed and backfilled, side by side."""
    f = F.col("event_id") % 5
    e = events(spark, sf_dir).withColumns({
        "startTime": F.when(f == 1, "").otherwise(F.col("startTime")), "free": F.when(f == 2, "1").when(f == 3, "yes"), "ticketsLink": F.when(f == 3, "https://a.example/t").otherwise(""), "ticketUrl": F.when(f == 4, "https://b.example/t"),
        "startDateTimestamp": F.when(f > 0, F.to_timestamp(F.concat("date", F.lit(" 20:00:00")))),
    })
    back = ops.backfilled(e)
    old = ops.legacy(back).select("event_id", F.col("title").alias("legacy_title"), F.col("rawLocation").alias("legacy_place"), F.col("startTime").alias("start"))
    shown = ops.form(back).select("event_id", F.col("title").alias("form_title"), "free", F.col("ticketsLink").alias("link"))
    recent = ops.refreshed(back, "1996-06-15").select("event_id", F.lit(True).alias("is_recent"))
    starts = back.select("event_id", F.date_format("startDateTimestamp", "yyyy-MM-dd HH:mm:ss").alias("starts"))
    out = old.join(shown, "event_id").join(starts, "event_id").join(recent, "event_id", "left")
    return out.withColumn("is_recent", F.coalesce("is_recent", F.lit(False)))


@query(
    "compatibility",
    f"""WITH e AS (SELECT * FROM {EVENTS}) SELECT event_id, CAST((startTime <> '' AND NOT regexp_matches(startTime, '^[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}$'))::INT + contains(startTime, 'Z')::INT AS INT) AS n_errors, CAST((event_id % 3 = 0)::INT AS INT) AS n_warnings,
    event_id % 4 = 0 OR event_id % 6 = 0 AS may_repeat, CASE WHEN event_id % 2 = 0 THEN collection END AS found_in FROM e""",
)
def compatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    k = F.col("event_id")
    c = ops.compatibility(e.withColumns({"endTime": F.lit(None).cast("string"), "imageUrl": F.when(k % 3 == 0, "nowhere").otherwise("https://a.example/x.png")}))
    mine = ops.may_repeat(F.lit("u"), F.when(k % 4 == 0, "u"), F.when(k % 6 == 0, "u"))
    stored = e.filter("event_id % 2 = 0").select("event_id", "collection", F.lit(1).alias("source_rank")).unionByName(e.filter("event_id % 2 = 0").select("event_id", F.lit("later").alias("collection"), F.lit(2).alias("source_rank")))
    out = c.select("event_id", F.size("errors").alias("n_errors"), F.size("warnings").alias("n_warnings"), mine.alias("may_repeat"))
    return ops.found_in(out, stored)
