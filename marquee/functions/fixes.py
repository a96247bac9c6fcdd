"""Values put right, with the confidence that the fix leaves, and scores of single values."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from marquee.functions.common import contains_any, first_match, fold, let, round_half_up, squeeze, text


def _fix(value: Column, confidence: Column, reason: Column) -> Column:
    return F.struct(value.alias("value"), confidence.alias("confidence"), reason.alias("reason"))


def fix_title(title: Column, venue: Column) -> Column:
    """Struct of value, confidence (100 untouched) and reason: a default, single spaces, at most 100 characters."""
    clean = squeeze(title)
    short = F.concat(F.substring(clean, 1, 97), F.lit("..."))
    default = F.concat(F.lit("Event at "), F.coalesce(F.nullif(venue, F.lit("")), F.lit("Venue TBD")))
    missing, long, spaced = F.coalesce(title, F.lit("")) == "", F.length(clean) > 100, clean != title
    value = F.when(missing, default).when(long, short).otherwise(clean)
    return _fix(value, F.when(missing, 50).when(long, 80).when(spaced, 95).otherwise(100), F.when(missing, "default").when(long, "truncated").when(spaced, "white space").otherwise(""))


def fix_price(price: Column) -> Column:
    """Struct of value, confidence and reason (number, free, none) from a price as text: its first number to two decimals, 0 for 'free', null otherwise. Of a null, null."""
    number = F.regexp_extract(text(price), r"[\d.]+", 0).try_cast("double")
    free = F.contains(F.lower(price), F.lit("free"))
    value = F.when(number.isNotNull(), round_half_up(number * 100) / 100).when(free, 0.0)
    confidence = F.when(number.isNotNull(), 80).when(free, 95).otherwise(50)
    return F.when(price.isNotNull(), _fix(value, confidence, F.when(number.isNotNull(), "number").when(free, "free").otherwise("none")))


def _keywords(mapping: Mapping[str, str]) -> Column:
    """Array of struct(k, v, i) of a mapping, in order: one literal, whatever its size."""
    return F.from_json(F.lit(json.dumps([{"k": k, "v": v, "i": i} for i, (k, v) in enumerate(mapping.items())])), "array<struct<k:string,v:string,i:int>>")


def infer_category(x: Column, mapping: Mapping[str, str]) -> Column:
    """Struct of category and confidence: the category with the most letters of its keywords in the text, the first of equals; null for none."""

    def best_of(found: Column) -> Column:
        # Categories count in the order in which their first keyword is found.
        names = F.array_distinct(F.transform(found, lambda m: m["v"]))
        letters = lambda c: F.aggregate(F.filter(found, lambda m: m["v"] == c), F.lit(0), lambda n, m: n + F.length(m["k"]))
        scored = F.transform(names, lambda c, i: F.struct((-letters(c)).alias("s"), i.alias("i"), c.alias("c")))
        return let(F.array_min(scored), lambda b: F.when(b["s"] < 0, F.struct(b["c"].alias("category"), F.least(F.lit(90), 50 - b["s"] * 5).alias("confidence"))))

    return let(F.lower(text(x)), lambda lower: let(F.filter(_keywords(mapping), lambda m: F.contains(lower, m["k"])), best_of))


def map_category(x: Column, mapping: Mapping[str, str]) -> Column:
    """Struct of category and confidence: 95 for a keyword, 80 for the first one that contains or is contained in the text (an empty text is in all), else null."""
    make = lambda m, n: F.when(m.isNotNull(), F.struct(m["v"].alias("category"), F.lit(n).alias("confidence")))
    first = lambda test: F.get(F.filter(_keywords(mapping), test), F.lit(0))
    return let(F.trim(F.lower(x)), lambda lower: F.coalesce(make(first(lambda m: m["k"] == lower), 95), make(first(lambda m: F.contains(lower, m["k"]) | F.contains(m["k"], lower)), 80)))


def valid_value(field: Column, value: Column) -> Column:
    """Whether a value may be one of the field."""
    v = F.trim(text(value))
    between = lambda a, b: F.length(v).between(a, b)
    rules = [
        (field == "title", between(3, 200)), (field == "description", between(10, 2000)), (field.isin("venue", "address"), between(3, 300)), (field == "price", v.rlike(r"(?i)[\$€£¥₹]|\bfree\b|\b\d+\b")),
        (field == "image", v.rlike(r"(?i)\.(jpg|jpeg|png|webp|gif)(\?|$)") | contains_any(v, ["image", "img"])),
        (field == "date", v.rlike(r"(?i)\d{4}|\d{1,2}/\d{1,2}|\d{1,2}-\d{1,2}|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec")), (field == "time", v.rlike(r"(?i)\d{1,2}:\d{2}|\d{1,2}\s*(am|pm)")),
    ]
    return (v != "") & first_match(rules, F.lit(True))


def adjusted_confidence(field: Column, value: Column, base: Column, as_of: Column) -> Column:
    """The confidence (0 to 100) of a value by its field: titles by length, dates by distance, addresses by a comma, images by their URL."""
    days = F.datediff(F.try_to_date(F.substring(value, 1, 10), "yyyy-MM-dd"), as_of)
    size = F.length(value)
    title = F.when(size < 5, 0.7).when(size > 150, 0.8).otherwise(1.0)
    date = F.when(days.between(-30, 365), 1.1).otherwise(0.8)
    image = F.when(F.contains(value, F.lit("image")) | value.rlike(r"(?i)\.(jpg|jpeg|png|webp|gif)"), 1.05).otherwise(0.9)
    factor = first_match([(field == "title", title), (field == "date", date), (field == "address", F.when(F.contains(value, F.lit(",")), 1.1).otherwise(1.0)), (field == "imageUrl", image)], F.lit(1.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), base * factor))


def next_weekday(day: Column, target: Column, force_next: bool = False) -> Column:
    """The next day of the week (0 Sunday to 6), today included unless ``force_next``."""
    ahead = F.pmod(target - (F.dayofweek(day) - 1), F.lit(7))
    return F.date_add(day, (F.when(ahead == 0, 7).otherwise(ahead) if force_next else ahead).cast("int"))


def relative_week(day: Column, next_: bool, what: str) -> Column:
    """Saturday for 'weekend'; Monday for 'week', a week later still if next."""
    found = next_weekday(day, F.lit(6 if what == "weekend" else 1), next_)
    return F.date_add(found, 7) if next_ and what == "week" else found


def future_date(day: Column, as_of: Column) -> Column:
    """A past date moves a year on, once; Feb 29 becomes Mar 1."""
    moved = F.make_date(F.year(day) + 1, F.month(day), F.lit(1))
    return F.when(day < as_of, F.date_add(moved, F.day(day) - 1)).otherwise(day)


#: Words that are no venue, and types of venues and streets.
NO_VENUE = ["tickets", "info", "more", "details", "call", "visit", "website"]
VENUE_TYPES = ["theater", "theatre", "hall", "center", "club", "bar", "arena", "stadium"]
STREET_TYPES = ["St", "Street", "Ave", "Avenue", "Rd", "Road", "Blvd", "Boulevard", "Dr", "Drive"]


def flyer_venue_valid(x: Column) -> Column:
    return F.coalesce(F.length(x).between(3, 80) & x.rlike("[a-zA-Z]{2,}") & ~contains_any(F.lower(x), NO_VENUE), F.lit(False))


def flyer_address_valid(x: Column) -> Column:
    return F.coalesce(F.length(x).between(8, 150) & x.rlike(r"^\d+") & contains_any(x, STREET_TYPES), F.lit(False))


def _clamped(x: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), x))


def _points(c: Column, n: int) -> Column:
    return F.when(c, n).otherwise(0)


# The points in the scores below.


def flyer_venue_confidence(x: Column, base: Column) -> Column:
    return _clamped(base + _points(contains_any(F.lower(x), VENUE_TYPES), 15) + _points(x.rlike("^[A-Z]"), 5) + _points(x.rlike("[A-Z].*[A-Z]"), 5))


def flyer_title_confidence(title: Column, full: Column, base: Column) -> Column:
    early = F.instr(full, title) - 1 < F.length(full) * 0.2
    out = base + _points(title.rlike("^[A-Z]"), 5) + _points(F.length(title).between(10, 60), 10) + _points(title.rlike(r"[&]|feat\.|featuring|with|presents"), 5) + _points(early, 10)
    return F.greatest(F.lit(0), out - _points(title.rlike(r"\d{4}"), 5) - _points(title.rlike(r"\$\d"), 10) - _points(F.size(F.split(title, " ")) > 12, 10))


def flyer_time_confidence(hour: Column, context: Column, base: Column) -> Column:
    c = F.lower(text(context))
    has = lambda w: F.contains(c, F.lit(w))
    hours = F.when((hour >= 18) | (hour <= 2), 10).when(hour.between(10, 16), 5).otherwise(0)
    return _clamped(base + hours + _points(has("doors"), 15) + _points(has("show"), 10) + _points(has("start"), 8) + _points(has("@") | has("at"), 5))


def flyer_price_confidence(amount: Column, free: Column, context: Column, base: Column) -> Column:
    c = F.lower(text(context))
    words = [("ticket", 10), ("admission", 8), ("advance", 5), ("door", 5)]
    return _clamped(base + _points(amount.between(0, 200), 5) + _points(free, 10) + sum((_points(F.contains(c, F.lit(w)), n) for w, n in words), F.lit(0)))


def image_context_score(url: Column, venue: Column) -> Column:
    """20 for an event's word in the URL, 15 for a word of the venue."""
    lower = F.lower(url)
    words = F.filter(F.split(fold(venue), " "), lambda w: F.length(w) > 3)
    return _points(contains_any(lower, ["event", "concert", "show", "festival", "performance"]), 20) + _points((F.length(text(venue)) > 3) & F.exists(words, lambda w: F.contains(lower, w)), 15)


def image_quality_score(url: Column, cdns: list[str]) -> Column:
    lower = F.lower(url)
    has = lambda w: F.contains(lower, F.lit(w))
    return _clamped(_points(contains_any(lower, cdns), 20) + _points(has(".webp"), 15) + _points(has(".png"), 10) + _points(has(".jpg") | has(".jpeg"), 5) - _points(has(".gif"), 10) - _points(has(".bmp"), 20) + _points(url.startswith("https://"), 5))
