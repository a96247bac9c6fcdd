"""Dates with a time or a range of times, and a zone, as instants.

Fixed values: the forms and the zones' hours from UTC; a zone's name says
whether it is summer time, so days of a change need no calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions.common import squeeze

OFFSETS = {"PDT": -7, "PST": -8, "EDT": -4, "EST": -5, "CDT": -5, "CST": -6, "MDT": -6, "MST": -7}
RANGE = rf"(?i)(\d{{1,2}})(?::(\d{{2}}))?\s*-\s*(\d{{1,2}})(?::(\d{{2}}))?\s*(am|pm)\s*({'|'.join(OFFSETS)})"
#: Forms of a day and a time: a pattern, which of its groups is the day, and how the day is written.
DAYS = [
    (r"(?i)(?:[a-z]+,\s+)?([a-z]+ \d{1,2}),? (\d{4}) at (\d{1,2}):(\d{2})\s*(am|pm)", True), (r"(?i)\b([a-z]+ \d{1,2}),? (\d{4}) (\d{1,2}):(\d{2})\s*(am|pm)", True), (r"(?i)\b(\d{1,2}/\d{1,2})/(\d{4}) (\d{1,2}):(\d{2})\s*(am|pm)", False),
]


def _hour(hour: Column, period: Column) -> Column:
    """Hour of the day; 12 am is 0, and hours beyond 12 keep as they are."""
    p = F.lower(period)
    return F.when((p == "pm") & (hour < 12), hour + 12).when((p == "am") & (hour == 12), 0).otherwise(hour)


def _at(day: Column, hour: Column, minute: Column) -> Column:
    return F.when(hour.between(0, 23) & minute.between(0, 59), F.make_timestamp(F.year(day), F.month(day), F.day(day), hour, minute, F.lit(0)))


def instants(rows: DataFrame, column: str, as_of: Column) -> DataFrame:
    """``rows`` with start, end (UTC), start_time, end_time (HH:mm:ss as said) and zone of the text in ``column``; nulls if it says none.

    A range ("12 - 6pm PDT") is on the day ``as_of``, and its start takes am or
    pm from its end; if it ends before it begins it ends on the day after. A day
    with a time ("Friday, May 2, 2025 at 7:30 PM", "May 2, 2025 7:30 PM",
    "5/2/2025 7:30 PM") has neither end nor zone; it is taken as UTC. Parts of
    the forms are columns of their own, so that each form is matched once.
    """
    parts = lambda pattern, n: F.array(*(F.nullif(F.regexp_extract("_t", pattern, i), F.lit("")) for i in range(1, n + 1)))
    own = rows.withColumn("_t", squeeze(F.col(column)))
    own = own.withColumns({"_r": parts(RANGE, 6), **{f"_d{i}": parts(p, 5) for i, (p, _) in enumerate(DAYS)}})
    of = lambda name, i: F.col(name)[i]
    number = lambda name, i: of(name, i).cast("int")
    zone = F.upper(of("_r", 5))
    found = [F.when(zone.isNotNull(), F.struct(as_of.alias("day"), _hour(number("_r", 0), of("_r", 4)).alias("h"), F.coalesce(number("_r", 1), F.lit(0)).alias("m"), _hour(number("_r", 2), of("_r", 4)).alias("eh"), F.coalesce(number("_r", 3), F.lit(0)).alias("em"), zone.alias("zone")))]
    none = lambda kind: F.lit(None).cast(kind)
    for i, (_, named) in enumerate(DAYS):
        d = f"_d{i}"
        text = F.initcap(F.concat(of(d, 0), F.lit(" " if named else "/"), of(d, 1)))
        day = F.coalesce(F.try_to_date(text, "MMMM d yyyy"), F.try_to_date(text, "MMM d yyyy")) if named else F.try_to_date(text, "M/d/yyyy")
        found.append(F.when(day.isNotNull(), F.struct(day.alias("day"), _hour(number(d, 2), of(d, 4)).alias("h"), number(d, 3).alias("m"), none("int").alias("eh"), none("int").alias("em"), none("string").alias("zone"))))
    own = own.withColumn("_w", F.coalesce(*found))
    w = lambda f: F.col(f"_w.{f}")
    own = own.withColumns({"_b": _at(w("day"), w("h"), w("m")), "_e": _at(w("day"), w("eh"), w("em"))})
    offset = F.coalesce(F.create_map(*(F.lit(v) for pair in OFFSETS.items() for v in pair))[w("zone")], F.lit(0))
    shift = F.make_dt_interval(F.lit(0), offset)
    over = F.make_dt_interval(F.when(F.col("_e") < F.col("_b"), 1).otherwise(0))
    clock = lambda h, m: F.format_string("%02d:%02d:00", h, m)
    known = F.col("_b").isNotNull()
    out = {"start": F.col("_b") - shift, "end": F.when(known, F.col("_e") + over - shift), "start_time": F.when(known, clock(w("h"), w("m"))), "end_time": F.when(known & F.col("_e").isNotNull(), clock(w("eh"), w("em"))), "zone": F.when(known, w("zone"))}
    return own.withColumns(out).select(*(c for c in rows.columns if c not in out), *out)
