"""Queries on what an extracted event must have; each order stands for one, with fields missing by its number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.functions import typed
from marquee.operators import requirements
from marquee.plans.derive import pick, pick_sql
from marquee.plans.registry import query
from marquee.session import table

ADDRESSES = ["", "1 Main St, Austin", "1 Main St Austin TX", "Main Hall"]
TEXTS = ["", "A jazz concert with a band", "Wine tasting and dining", "Nothing"]
GIVEN = [None, ["Music", "Bars", "Comedy"], ["Bars"], None]
_X = f"(SELECT o_orderkey AS id, {pick_sql('o_orderkey', TEXTS)} AS title, CASE WHEN o_orderkey % 3 > 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '' END AS date, {pick_sql('o_custkey', ADDRESSES)} AS address, CASE WHEN o_custkey % 5 = 0 THEN '' ELSE 'Room' END AS venue, o_orderkey % 4 AS f, CAST(o_custkey % 100 AS INT) AS sure FROM orders)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    given = F.when(k % 4 == 1, F.array(*map(F.lit, GIVEN[1]))).when(k % 4 == 2, F.array(*map(F.lit, GIVEN[2]))).otherwise(F.lit(None).cast("array<string>"))
    return table(spark, sf_dir, "orders").select(
        k.alias("id"), pick(k, TEXTS).alias("title"), F.lit(None).cast("string").alias("description"), F.when(k % 3 > 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("").alias("date"), pick(c, ADDRESSES).alias("address"),
        F.when(c % 5 == 0, "").otherwise("Room").alias("venue"), given.alias("categories"), F.lit("https://www.example.org/x").alias("url"), *((c % 100).cast("int").alias(f"{f}_confidence") for f in ("title", "date", "venue", "address")),
    )


@query(
    "required_fields",
    f"""SELECT id, CAST((title = '')::INT + (date = '')::INT + (address = '')::INT AS INT) AS n_errors, CAST((address <> '' AND NOT contains(address, ','))::INT + (f IN (0, 3))::INT AS INT) AS n_warnings, CAST(CASE WHEN sure < 60 THEN 3 ELSE 0 END AS INT) AS n_low,
    coalesce(nullif(title, ''), 'Event Title TBD') AS title, CASE address WHEN '' THEN 'Address TBD' WHEN '1 Main St Austin TX' THEN '1 Main St, Austin TX' WHEN 'Main Hall' THEN 'Main Hall, Location TBD' ELSE address END AS address, coalesce(nullif(venue, ''), 'Venue TBD') AS venue,
    CASE f WHEN 0 THEN 'Community' WHEN 1 THEN 'Music,Comedy' WHEN 2 THEN '' ELSE 'Community' END AS categories, false AS free FROM {_X}""",
)
def required_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    low = requirements.low_confidence({f: F.col(f"{f}_confidence") for f in requirements.REQUIRED})
    checked = requirements.check(e).select("id", F.size("errors").alias("n_errors"), F.size("warnings").alias("n_warnings"), F.size(low).alias("n_low"))
    return requirements.enforce(e).select("id", "title", "address", "venue", F.array_join("categories", ",").alias("categories"), "free").join(checked, "id")


@query(
    "guessed_fields",
    f"""SELECT id, CASE WHEN date = '' THEN '1996-06-22T19:00:00' ELSE date END AS date, CAST(CASE WHEN date = '' THEN 30 ELSE sure END AS INT) AS date_confidence, CASE WHEN title = '' THEN 'Event at example' ELSE title END AS title,
    CASE WHEN venue = '' AND address <> '' THEN trim(split_part(address, ',', 1)) ELSE venue END AS venue, CAST(CASE WHEN venue = '' AND address <> '' THEN greatest(0, sure - 20) ELSE sure END AS INT) AS venue_confidence,
    CASE WHEN address <> '' AND NOT contains(address, ',') THEN address || ', Location TBD' ELSE address END AS address, CAST(CASE f WHEN 0 THEN 60 WHEN 1 THEN 95 WHEN 2 THEN 85 ELSE 10 END AS INT) AS selected FROM {_X}""",
)
def guessed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = requirements.defaults(_events(spark, sf_dir), F.lit("1996-06-15").cast("date"))
    selector, base = pick(F.col("id"), ["h1", '[class*="date"] time', "time", "img"]), F.when(F.col("id") % 4 == 0, 70).when(F.col("id") % 4 == 1, 80).when(F.col("id") % 4 == 2, 75).otherwise(5)
    return out.select("id", "date", "date_confidence", "title", "venue", "venue_confidence", "address", requirements.selector_confidence(selector, "date", base).alias("selected"))


@query(
    "tidied_fields",
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%dT') || '19:30:00' WHEN o_orderkey % 3 = 1 THEN 'soon' ELSE strftime(o_orderdate, '%Y-%m-%dT20:00:00') END AS date, CASE WHEN o_orderkey % 3 = 1 THEN 'late' WHEN o_orderkey % 3 = 2 THEN '21:00:00' END AS time,
    'A b' AS title, CASE WHEN o_orderkey % 2 = 0 THEN 'u' END AS "imageUrl", CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END AS images FROM orders""",
)
def tidied_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    date = F.when(k % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k % 3 == 1, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T20:00:00'"))
    t = table(spark, sf_dir, "orders").select(k.alias("id"), date.alias("date"), pick(k, ["19:30:00", "late", "21:00:00"]).alias("time"), F.lit("  A\n b ").alias("title"), F.when(k % 2 == 0, "u").alias("image"))
    return requirements.tidy(t).select("id", "date", "time", "title", "imageUrl", F.coalesce(F.size("imageUrls"), F.lit(-1)).alias("images"))


#: Texts by form, over the day d, an amount a, four digits n and a house number h.
SAID = ["Call 512-555-{n} at 7:05 PM on {d} for ${a}", "Free, or from ${a}.50 - mail joe@x.example", "{h} Oak Street, Austin, TX 78701 at 9 o'clock", "nothing"]


@query(
    "typed_values",
    """WITH t AS (SELECT o_orderkey AS id, o_orderkey % 4 AS f, strftime(o_orderdate, '%Y-%m-%d') AS d, CAST(5 + o_custkey % 90 AS VARCHAR) AS a, printf('%04d', o_orderkey % 10000) AS n, CAST(1 + o_custkey % 900 AS VARCHAR) AS h FROM orders)
    SELECT id, 'phone' AS field, 'us_dashed' AS kind, '(512) 555-' || n AS value, 90 AS confidence FROM t WHERE f = 0 UNION ALL SELECT id, 'time', '12hour', '19:05:00', 90 FROM t WHERE f = 0 UNION ALL SELECT id, 'time', '24hour', '07:05:00', 75 FROM t WHERE f = 0
    UNION ALL SELECT id, 'time', 'verbose_12hour', '19:05:00', 85 FROM t WHERE f = 0 UNION ALL SELECT id, 'date', 'iso_date', d, 90 FROM t WHERE f = 0 UNION ALL SELECT id, 'price', 'dollar', a || '.00', 90 FROM t WHERE f = 0
    UNION ALL SELECT id, 'price', 'free', '0.00', 95 FROM t WHERE f = 1 UNION ALL SELECT id, 'price', 'dollar', a || '.50', 90 FROM t WHERE f = 1 UNION ALL SELECT id, 'price', 'from_price', a || '.50', 80 FROM t WHERE f = 1 UNION ALL SELECT id, 'email', 'standard', 'joe@x.example', 95 FROM t WHERE f = 1
    UNION ALL SELECT id, 'address', 'full_us', h || ' Oak Street, Austin, TX 78701', 90 FROM t WHERE f = 2 UNION ALL SELECT id, 'address', 'street_only', h || ' Oak Street', 75 FROM t WHERE f = 2""",
)
def typed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    out = pick(k, SAID)
    for name, value in (("{d}", F.date_format("o_orderdate", "yyyy-MM-dd")), ("{a}", (5 + c % 90).cast("string")), ("{n}", F.format_string("%04d", k % 10000)), ("{h}", (1 + c % 900).cast("string"))):
        out = F.replace(out, F.lit(name), value)
    return typed.typed_values(table(spark, sf_dir, "orders").select(k.alias("id"), out.alias("text"))).drop("ord")
