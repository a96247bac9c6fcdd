"""Duplicate events: keys, groups, which one stays, and the rows to delete.

Within a group the event with an image comes first, then the newest, then the
one that comes first; the completeness score is offered but does not decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.functions.common import fold, text

KEY = "|||"


def normal_date(x: Column) -> Column:
    return F.substring_index(x, "T", 1)


def normal_start(x: Column) -> Column:
    """HH:MM after a T, else the trimmed text."""
    found = F.regexp_extract(text(x), r"T(\d{2}:\d{2})", 1)
    return F.when(found != "", found).otherwise(F.trim(text(x)))


def duplicate_key(title: Column, date: Column, venue: Column, start: Column) -> Column:
    """Null where title or date is empty: such events are no one's duplicates."""
    key = F.concat_ws(KEY, fold(title), normal_date(date), fold(venue), normal_start(start))
    return F.when((fold(title) != "") & (F.coalesce(normal_date(date), F.lit("")) != ""), key)


def with_key(events: DataFrame) -> DataFrame:
    return events.withColumn("dup_key", duplicate_key(F.col("title"), F.col("date"), F.col("venue"), F.col("startTime")))


def ranked(events: DataFrame) -> DataFrame:
    """Events in groups of more than one, with group_size, rank and status KEEP or DELETE.

    One shuffle by key serves both the count and the rank; partial counts
    first would not spare it, as every member of a group is returned.
    """
    w = Window.partitionBy("dup_key")
    order = w.orderBy(F.col("has_image").desc(), F.col("created").desc(), F.col("ord"))
    keyed = with_key(events).filter("dup_key is not null")
    out = keyed.withColumns({"group_size": F.count("*").over(w), "rank": F.row_number().over(order)}).filter("group_size > 1")
    return out.withColumn("status", F.when(F.col("rank") == 1, "KEEP").otherwise("DELETE"))


def summary(events: DataFrame) -> DataFrame:
    """Totals: events, invalid (no key), groups, duplicates kept and to delete. Counts per key are combined before the shuffle."""
    keyed = with_key(events).groupBy("dup_key").agg(F.count("*").alias("n"))
    valid = F.col("dup_key").isNotNull()
    many = valid & (F.col("n") > 1)
    total = lambda c, x: F.coalesce(F.sum(F.when(c, x)), F.lit(0)).cast("long")
    return keyed.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_events"), total(~valid, F.col("n")).alias("invalid_events"), total(many, F.lit(1)).alias("duplicate_groups"), total(many, F.col("n") - 1).alias("events_to_delete")
    )


def without_deleted(events: DataFrame) -> DataFrame:
    """Events that stay: those that are no one's duplicate and the first of each group."""
    gone = ranked(events).filter("status = 'DELETE'").select("collection", "event_id")
    return events.join(gone, ["collection", "event_id"], "left_anti")


def with_images(events: DataFrame, listing: DataFrame) -> DataFrame:
    """has_image from an object listing (path): events/<id>/event_image.png or .jpg."""
    found = listing.select(F.regexp_extract("path", r"^events/([^/]+)/event_image\.(png|jpg)$", 1).alias("event_id")).filter("event_id <> ''").distinct()
    return events.drop("has_image").join(found.withColumn("has_image", F.lit(True)), "event_id", "left").withColumn("has_image", F.coalesce("has_image", F.lit(False)))


def completeness(event: dict[str, Column], likes: Column, saves: Column) -> Column:
    """10 for each of six fields, 20 for an image, 15 for an owner, likes and twice the saves."""
    has = lambda x: F.coalesce(x.cast("string"), F.lit("")) != ""
    points = lambda c, n: F.when(c, n).otherwise(0)
    fields = [points(has(event[f]), 10) for f in ("title", "address", "venue", "categories", "ticketsLink", "startTime")]
    positive = lambda x: F.greatest(F.coalesce(x, F.lit(0)), F.lit(0))
    return sum(fields, F.lit(0)) + points(has(event["imageUrl"]), 20) + points(has(event["businessUserId"]) | has(event["createdBy"]), 15) + positive(likes) + 2 * positive(saves)
