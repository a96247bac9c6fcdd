"""Queries on addresses, dates and times in many forms, and validated events: texts are made from each order's own numbers and dates, and SQL works out what they must give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.functions import addresses, moments
from marquee.functions.common import first_match
from marquee.operators import validation
from marquee.plans.derive import pick, pick_sql
from marquee.plans.registry import query
from marquee.session import table

AS_OF = "1996-06-15"  # a Saturday
STREETS = ["Main St", "Oak Ave", "Elm Rd", "Pine Way"]
TOWNS = ["Oakland", "Austin", "Berkeley", "Round Rock"]
VENUE_TYPES = ["theater", "hall", "club"]


def _as_of() -> Column:
    return F.lit(AS_OF).cast("date")


def _forms(key: Column, texts: list[str], values: dict[str, Column]) -> Column:
    out = pick(key, texts)
    for name, value in values.items():
        out = F.replace(out, F.lit(name), value)
    return out


def _key() -> Column:
    return F.col("o_orderkey")


def _values() -> dict[str, Column]:
    return {"{n}": (_key() % 9000).cast("string"), "{s}": pick(F.col("o_custkey"), STREETS), "{c}": pick(F.col("o_custkey"), TOWNS)}


LOCATIONS = ["{n} {s} {c}", "{n} {s} ,, {c}, CA ", "{n} {s} Nevada 89501", "Hidden Valley {n}", "", "at The Big Room, {c}"]
_LOCATED = f"t AS (SELECT o_orderkey AS id, o_orderkey % 6 AS f, CAST(o_orderkey % 9000 AS VARCHAR) AS n, {pick_sql('o_custkey', STREETS)} AS s, {pick_sql('o_custkey', TOWNS)} AS c FROM orders)"


@query(
    "locations",
    f"""WITH {_LOCATED}, a AS (SELECT *, CASE f WHEN 0 THEN n || ' ' || s || ', ' || c WHEN 1 THEN n || ' ' || s || ', ' || c || ', CA' WHEN 2 THEN n || ' ' || s || ' Nevada 89501, San Francisco' WHEN 3 THEN 'Hidden Valley ' || n || ', San Francisco' WHEN 4 THEN '' ELSE 'at The Big Room, ' || c END AS address FROM t)
    SELECT id, CASE f WHEN 0 THEN n WHEN 1 THEN n WHEN 2 THEN n WHEN 3 THEN 'Hidden Valley' WHEN 4 THEN '' ELSE 'The Big Room' END || CASE WHEN f IN (0) THEN ' ' || s || ' ' || c WHEN f = 1 THEN ' ' || s WHEN f = 2 THEN ' ' || s || ' Nevada' ELSE '' END AS venue, address,
    CASE WHEN f IN (0, 1, 5) THEN c ELSE '' END AS city, CASE WHEN f IN (0, 1, 5) AND c IN ('Austin', 'Round Rock') THEN 'austin' ELSE 'bayArea' END AS region,
    CASE f WHEN 0 THEN 'Address must contain a comma (format: "Street, City")' WHEN 1 THEN 'Address must have both street and city parts' WHEN 2 THEN 'Address must contain a comma (format: "Street, City")' WHEN 3 THEN 'Address must contain a comma (format: "Street, City")' WHEN 4 THEN 'Address is required and must be a string' END AS problem,
    f = 1 AS looks_like_address, CASE WHEN f IN (0, 1, 5) AND c IN ('Austin', 'Round Rock') THEN 'austinEvents' ELSE 'bayAreaEvents' END AS repeats_in FROM a""",
)
def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    t = table(spark, sf_dir, "orders").select(_key().alias("id"), _forms(_key(), LOCATIONS, _values()).alias("x"))
    t = t.withColumn("p", addresses.parse_location(x, VENUE_TYPES))
    return t.select("id", "p.venue", "p.address", "p.city", "p.region", addresses.address_problem(x).alias("problem"), addresses.looks_like_address(x).alias("looks_like_address"), addresses.repeat_collection(x, F.lit("")).alias("repeats_in"))


COMPLETED = ["{s} Hall Chicago {n}", "Old {s} Spot tx", "The {s}", "nowhere {n}", "{s}  Boston"]


@query(
    "completed_addresses",
    f"""WITH {_LOCATED} SELECT id, CASE id % 5 WHEN 0 THEN s || ' Hall, Chicago ' || n WHEN 1 THEN 'Old ' || s || ', Spot, tx' WHEN 2 THEN 'The ' || s || ', Austin, TX' WHEN 4 THEN s || ', Boston' END AS address,
    CAST(CASE id % 5 WHEN 0 THEN 85 WHEN 1 THEN 80 WHEN 2 THEN 60 WHEN 4 THEN 85 END AS INT) AS confidence FROM t""",
)
def completed_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "orders").select(_key().alias("id"), _forms(_key(), COMPLETED, _values()).alias("x"), F.concat(F.lit("The "), _values()["{s}"]).alias("venue"))
    t = t.withColumn("a", addresses.completed_address(F.col("x"), F.col("venue")))
    return t.select("id", F.col("a.value").alias("address"), F.col("a.confidence").alias("confidence"))


DATE_SHAPES = ["M/d/yyyy", "MMMM d, yyyy", "MMM d yyyy", "d MMMM yyyy", "yyyy-MM-dd", "M-d-yyyy"]
_TIMED = "t AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS d, o_orderkey % 7 AS f, 1 + o_custkey % 12 AS h, (o_custkey * 7) % 60 AS m, CASE WHEN o_custkey % 2 = 0 THEN 'AM' ELSE 'PM' END AS p FROM orders)"
_FULL = "CASE WHEN p = 'PM' AND h <> 12 THEN h + 12 WHEN p = 'AM' AND h = 12 THEN 0 ELSE h END"


def _timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's date in one of the shapes (or none), and a clock in one of four forms."""
    c = F.col("o_custkey")
    date = first_match([(_key() % 7 == i, F.date_format("o_orderdate", s)) for i, s in enumerate(DATE_SHAPES)], F.lit("no date"))
    hour, minute, period = 1 + c % 12, (c * 7) % 60, F.when(c % 2 == 0, "AM").otherwise("PM")
    clock = pick(_key(), ["{h}:{m} {p}", "{H}:{m}", "{h} {p}", "noon"])
    for name, value in (("{h}", hour.cast("string")), ("{H}", F.format_string("%02d", hour + 10)), ("{m}", F.format_string("%02d", minute)), ("{p}", period)):
        clock = F.replace(clock, F.lit(name), value)
    return table(spark, sf_dir, "orders").select(_key().alias("id"), date.alias("date"), clock.alias("clock"))


_CLOCK = f"CASE id % 4 WHEN 0 THEN printf('%02d:%02d:00', {_FULL}, m) WHEN 1 THEN printf('%02d:%02d:00', h + 10, m) WHEN 2 THEN printf('%02d:00:00', {_FULL}) END"


@query(
    "moments",
    f"""WITH {_TIMED}, c AS (SELECT *, {_CLOCK} AS time FROM t) SELECT id, CASE WHEN f < 6 THEN d END AS date, time, CASE WHEN f < 6 THEN CAST(d AS TIMESTAMP) + CAST(coalesce(time, '00:00:00') AS INTERVAL) END AS starts_at,
    CASE WHEN id % 4 < 2 THEN time END AS first_clock FROM c""",
)
def moments_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, c = F.col("date"), F.col("clock")
    # The table's timestamps have no zone, and neither has the result.
    return _timed(spark, sf_dir).select("id", moments.flexible_date(d).alias("date"), moments.flexible_time(c).alias("time"), moments.combined(d, c).cast("timestamp_ntz").alias("starts_at"), moments.clock_of(c).alias("first_clock"))


_EVENING = "CASE WHEN h + 10 BETWEEN 7 AND 11 THEN h + 22 ELSE h + 10 END"


@query(
    "local_moments",
    f"""WITH {_TIMED}, c AS (SELECT *, CASE id % 4 WHEN 0 THEN printf('%02d:%02d:00', {_FULL}, m) WHEN 1 THEN printf('%02d:%02d:00', {_EVENING}, m) WHEN 2 THEN printf('%02d:00:00', {_FULL}) END AS time, CASE WHEN f < 4 THEN d END AS date FROM t)
    SELECT id, date, coalesce(time, CASE WHEN date IS NOT NULL THEN '19:00:00' END) AS start_time, CAST(CASE WHEN time IS NOT NULL AND date IS NOT NULL THEN 1.0 WHEN time IS NOT NULL OR date IS NOT NULL THEN 0.4 ELSE 0 END AS DOUBLE) AS confidence FROM c""",
)
def local_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _timed(spark, sf_dir).withColumn("r", moments.local_moment(F.concat_ws(" at ", "date", "clock"), _as_of()))
    return t.select("id", "r.date", F.col("r.startTime").alias("start_time"), "r.confidence")


#: Texts of a moment and what they mean on AS_OF, worked out by hand: the date, the time and the confidence.
SAID = [
    ("today at noon", "1996-06-15", None, 0.9), ("Tomorrow", "1996-06-16", None, 0.9), ("next friday", "1996-06-21", None, 0.8), ("this saturday", "1996-06-15", None, 0.8), ("next saturday", "1996-06-22", None, 0.8), ("this weekend", "1996-06-15", None, 0.8),
    ("Sunset show", "1996-06-16", None, 0.8), ("July 4, 1996 show 8pm", "1996-07-04", "20:00:00", 0.95), ("1996-03-05", "1997-03-05", "19:00:00", 0.85), ("doors open 7:30", "1996-06-15", "07:30:00", 0.75), ("9:15", "1996-06-15", "21:15:00", 0.7), ("nothing", None, None, 0.0),
]


@query(
    "said_moments",
    f"""SELECT o_orderkey AS id, CAST(nullif({pick_sql('o_orderkey', [d or '' for _, d, _, _ in SAID])}, '') AS DATE) AS date, nullif({pick_sql('o_orderkey', [t or '' for _, _, t, _ in SAID])}, '') AS time,
    CAST(list_extract([{', '.join(str(c) for *_, c in SAID)}], CAST(o_orderkey % {len(SAID)} AS BIGINT) + 1) AS DOUBLE) AS confidence FROM orders""",
)
def said_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "orders").select(_key().alias("id"), moments.parse_moment(pick(_key(), [x for x, *_ in SAID]), _as_of()).alias("r"))
    return t.select("id", "r.date", "r.time", "r.confidence")


MAPPING = {"music": "Music", "concert": "Music", "bar": "Bars", "festival": "Festivals", "comedy": "Comedy Shows", "dance club": "Nightclubs"}
#: By form: what is wrong with an event, and so the least confidence, the fixes, the errors and the warnings.
WRONG = [
    ("nothing", 100, 0, 0, 0), ("no title", 50, 1, 1, 0), ("spaces in the title", 95, 1, 0, 0), ("long title", 80, 1, 0, 0), ("no description", 40, 1, 1, 0), ("concert as category", 95, 1, 0, 0), ("unknown category", 30, 1, 1, 1), ("no address", 30, 1, 1, 0),
    ("no comma", 85, 1, 0, 0), ("past date", 90, 1, 0, 1), ("bad date", 100, 0, 1, 0), ("clock", 85, 1, 0, 0), ("bad clock", 100, 0, 1, 0), ("price text", 80, 1, 0, 0), ("long price", 80, 2, 0, 0), ("bad URL", 100, 0, 1, 0), ("odd image", 100, 0, 0, 1),
    ("no venue", 30, 1, 1, 0), ("three categories", 80, 1, 0, 0), ("end before start", 70, 1, 0, 0), ("no date", 30, 1, 1, 0),
]


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [w for w, *_ in WRONG]
    is_ = lambda *w: (_key() % len(WRONG)).isin([names.index(x) for x in w])
    number = (_key() % 1000).cast("string")
    title = F.concat(F.lit("Night "), number)
    when = lambda w, v, other: F.when(is_(w), v).otherwise(other)
    cat = lambda *x: F.array(*map(F.lit, x))
    return table(spark, sf_dir, "orders").select(
        _key().alias("id"),
        F.when(is_("no title"), "").when(is_("spaces in the title"), F.concat(F.lit("  Night   "), number)).when(is_("long title"), F.concat(title, F.repeat(F.lit("x"), 120))).otherwise(title).alias("title"),
        when("no description", F.lit(None), F.lit("Come along")).alias("description"),
        F.when(is_("concert as category"), cat("Concert")).when(is_("unknown category"), cat("zzz")).when(is_("three categories"), cat("Music", "Bars", "Festivals")).otherwise(cat("Music")).alias("categories"),
        F.when(is_("no address"), "").when(is_("no comma"), F.concat(number, F.lit(" Main St Chicago"))).otherwise(F.concat(number, F.lit(" Main St, Austin"))).alias("address"),
        F.when(is_("past date"), F.date_format("o_orderdate", "'1990-'MM-dd")).when(is_("bad date"), "someday").when(is_("no date"), F.lit(None)).otherwise("1996-07-01T19:00:00.000Z").alias("startDate"),
        when("end before start", F.lit("1996-06-20T19:00:00.000Z"), F.lit(None)).alias("endDate"),
        F.when(is_("clock"), "7:30 PM").when(is_("bad clock"), "late").otherwise("19:30:00").alias("startTime"),
        F.when(is_("price text"), F.concat(F.lit("$"), number)).when(is_("long price"), "12.345678").otherwise(F.lit(None)).alias("price"),
        when("bad URL", F.lit("nowhere"), F.lit("https://example.com/x")).alias("url"), when("odd image", F.lit("https://example.com/page"), F.lit("https://example.com/a.JPG")).alias("image"),
        when("no venue", F.lit(None), F.lit("Blue Note")).alias("venue"),
    )


def _of_form(i: int) -> str:
    return f"list_extract([{', '.join(str(w[i]) for w in WRONG)}], CAST(o_orderkey % {len(WRONG)} AS BIGINT) + 1)"


_AT = {w: i for i, (w, *_) in enumerate(WRONG)}
_NUMBER = "CAST(o_orderkey % 1000 AS VARCHAR)"
_F = f"o_orderkey % {len(WRONG)}"


@query(
    "validated_events",
    f"""SELECT o_orderkey AS id, CASE {_F} WHEN {_AT['no title']} THEN 'Event at Blue Note' WHEN {_AT['long title']} THEN substr('Night ' || {_NUMBER} || repeat('x', 120), 1, 97) || '...' ELSE 'Night ' || {_NUMBER} END AS title,
    CASE {_F} WHEN {_AT['no address']} THEN 'Blue Note, Austin, TX' WHEN {_AT['no comma']} THEN {_NUMBER} || ' Main St, Chicago' ELSE {_NUMBER} || ' Main St, Austin' END AS address,
    CASE {_F} WHEN {_AT['three categories']} THEN 'Music,Bars' ELSE 'Music' END AS categories, CASE {_F} WHEN {_AT['no venue']} THEN 'Venue TBD' ELSE 'Blue Note' END AS venue,
    CASE {_F} WHEN {_AT['past date']} THEN strftime(o_orderdate, '1990-%m-%dT00:00:00.000Z') WHEN {_AT['bad date']} THEN 'someday' WHEN {_AT['no date']} THEN '1996-06-16T19:00:00.000Z' ELSE '1996-07-01T19:00:00.000Z' END AS start_date,
    CASE {_F} WHEN {_AT['end before start']} THEN '1996-07-01T19:00:00.000Z' END AS end_date, CASE {_F} WHEN {_AT['bad clock']} THEN 'late' ELSE '19:30:00' END AS start_time,
    CAST(CASE {_F} WHEN {_AT['price text']} THEN 100 * (o_orderkey % 1000) WHEN {_AT['long price']} THEN 1235 END AS BIGINT) AS cents,
    CAST({_of_form(1)} AS INT) AS confidence, CAST({_of_form(2)} AS INT) AS n_fixes, CAST({_of_form(3)} AS INT) AS n_errors, CAST({_of_form(4)} AS INT) AS n_warnings, {_of_form(3)} = 0 AS valid FROM orders
    WHERE NOT ({_F} = {_AT['past date']} AND strftime(o_orderdate, '%m-%d') = '02-29')""",
)
def validated_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order's event; the day that 1990 lacks is left out on both sides, as the engines' texts of it differ."""
    leap = table(spark, sf_dir, "orders").filter((_key() % len(WRONG) == _AT["past date"]) & (F.date_format("o_orderdate", "MM-dd") == "02-29")).select(_key().alias("id"))
    v = validation.validate(_events(spark, sf_dir).join(leap, "id", "left_anti"), MAPPING, _as_of())
    return v.select(
        "id", "title", "address", F.array_join("categories", ",").alias("categories"), "venue", F.col("startDate").alias("start_date"), F.col("endDate").alias("end_date"), F.col("startTime").alias("start_time"), F.round(F.col("price") * 100).cast("long").alias("cents"),
        "confidence", F.size("fixes").alias("n_fixes"), F.size("errors").alias("n_errors"), F.size("warnings").alias("n_warnings"), "valid",
    )


@query(
    "validation_summary",
    # The day that 1990 lacks is a bad date: an error, and neither a fix nor a warning.
    f"""WITH o AS (SELECT *, {_F} = {_AT['past date']} AND strftime(o_orderdate, '%m-%d') = '02-29' AS leap FROM orders),
    v AS (SELECT CASE WHEN leap THEN 100 ELSE {_of_form(1)} END AS c, CASE WHEN leap THEN 0 ELSE {_of_form(2)} END AS f, CASE WHEN leap THEN 1 ELSE {_of_form(3)} END AS e, CASE WHEN leap THEN 0 ELSE {_of_form(4)} END AS w FROM o)
    SELECT count(*) AS total, count_if(e = 0) AS valid, count_if(e > 0) AS invalid, CAST(sum(f) AS BIGINT) AS total_fixes, CAST(sum(e) AS BIGINT) AS total_errors, CAST(sum(w) AS BIGINT) AS total_warnings, CAST(floor(avg(c) + 0.5) AS BIGINT) AS average_confidence FROM v""",
)
def validation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = validation.batch_summary(validation.validate(_events(spark, sf_dir), MAPPING, _as_of()))
    return out.select(*(F.col(c).cast("long").alias(c) for c in out.columns))
