"""Dates, times, prices and venues in noisy text, as rows of matches.

A text's matches are found with their places by one small Python scan of the
pattern tables (no built-in gives the place of a regular expression's match);
all rules about what a match says and how sure it is are column expressions on
the rows, and choices between matches of one text are windows over its id,
which is the only shuffle.

Rules are kept as they are where they are well defined, also where they are odd:
hour 0 and minute 0 count as missing where matches are told apart and weighed,
a single price is less sure than a range, and a weekday with a number alone is
no date.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.functions import forms
from marquee.functions.common import contains_any, first_match, text
from marquee.functions.venues import clean_name, name_quality, valid_name
from marquee.session import short_methods, spread

_SCAN = "id long, field string, family string, ord int, g array<string>, found string, at int, size int, before string, after string"


def needed(pattern: str) -> tuple[str, ...]:
    """Texts in lower case of which every match of a form has one; empty where none is known. A form is tried only on texts that have one."""
    return next((words for sign, words in forms.NEEDED if sign in pattern), ())


@functools.cache
def _compiled(fields: tuple[str, ...]) -> list[tuple[str, str, re.Pattern, int, tuple[str, ...]]]:
    return [(f, family, re.compile(p, re.ASCII), forms.CONTEXT[f], needed(p)) for f, family, p in forms.ALL if f in fields]


def scan(texts: DataFrame, fields: Sequence[str] = ("date", "time", "price", "venue")) -> DataFrame:
    """Matches of all forms in ``texts`` (id, text): id, field, family, ord, groups g, found, at, size of the text, and the text before and after.

    ``ord`` counts a text's matches form by form. A null text is an empty one, and has none.
    """
    fields = tuple(fields)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms_of = _compiled(fields)
        for x in batches:
            out = []
            for i, t in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True):
                n, low = 0, (t or "").lower()
                for field, family, pattern, reach, words in forms_of if t else ():
                    if words and not any(w in low for w in words):
                        continue
                    for m in pattern.finditer(t):
                        a, b = m.span()
                        out.append((i, field, family, n, list(m.groups()), m[0], a, len(t), t[max(0, a - reach) : a], t[b : b + reach]))
                        n += 1
            columns = list(zip(*out, strict=True)) or [()] * 10
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in _SCAN.split(", ")])

    return spread(texts.select(F.col("id").cast("long").alias("id"), text(F.col("text")).alias("text"))).mapInArrow(find, _SCAN)


def _g(i: int) -> Column:
    return F.get("g", F.lit(i))


def _by_family(field: str, table: dict[str, dict[str, float]], default: float | None = None) -> Column:
    return first_match([(F.col("family") == k, F.lit(v)) for k, v in table[field].items()], F.lit(default))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def _month(x: Column) -> Column:
    return F.array_position(F.array(*(F.lit(m[:3].lower()) for m in forms.MONTHS)), F.lower(F.substring(x, 1, 3))).cast("int")


def _date(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd")


def weekday_ahead(name: Column, as_of: Column, next_: Column) -> Column:
    """'this': the next such day after ``as_of``; 'next': the one of the week after, counted from Sunday."""
    target = F.array_position(F.array(*(F.lit(d.lower()) for d in forms.WEEKDAYS)), F.lower(name)).cast("int") - 1
    ahead = target - (F.dayofweek(as_of) - 1)
    return F.date_add(as_of, F.when(next_, ahead + 7).when(ahead <= 0, ahead + 7).otherwise(ahead))


def weekday_and_number(weekday: Column, day: Column, as_of: Column) -> Column:
    """The first date after ``as_of`` within twelve months that is this weekday and this day of its month."""
    months = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.add_months(F.trunc(as_of, "MM"), i))
    days = F.transform(months, lambda m: F.when(F.day(F.last_day(m)) >= day, F.date_add(m, day - 1)))
    return F.get(F.filter(days, lambda d: (d > as_of) & (F.date_format(d, "EEEE") == F.initcap(weekday))), 0)


def dates(rows: DataFrame, as_of: Column) -> DataFrame:
    """Date matches with date, weekday (where named), ambiguous and confidence; matches that are no date are left out."""
    f, numeric = F.col("family"), F.col("family") == "numeric"
    month = F.when(numeric, _g(0).try_cast("int")).when(f.isin("dayOfWeek", "ordinal"), _month(_g(1))).otherwise(_month(_g(0)))
    day = F.when(f == "dayOfWeek", _g(2).try_cast("int")).when(f == "ordinal", _g(0).try_cast("int")).otherwise(_g(1).try_cast("int"))
    said = F.when(f == "dayOfWeek", _g(3)).otherwise(_g(2)).try_cast("int")
    year = F.when(numeric & (said < 50), said + 2000).when(numeric & (said < 100), said + 1900).otherwise(F.coalesce(said, F.year(as_of)))
    words = F.split(F.lower(_g(0)), r"\s+")
    ahead = weekday_ahead(F.get(words, F.lit(1)), as_of, F.get(words, F.lit(0)) == "next")
    relative = F.when(F.lower(_g(0)).isin("today", "tonight"), as_of).when(F.lower(_g(0)) == "tomorrow", F.date_add(as_of, 1)).otherwise(ahead)
    own = rows.filter(F.col("field") == "date").withColumns({"month": month, "day": day, "year": year})
    date = F.when(f == "relative", relative).when(numeric, F.coalesce(_date(F.col("year"), F.col("month"), F.col("day")), _date(F.col("year"), F.col("day"), F.col("month")))).otherwise(_date(F.col("year"), F.col("month"), F.col("day")))
    own = own.withColumn("date", date).filter("date is not null")
    away = F.datediff("date", as_of)
    stated = said.isNotNull() | f.isin("numeric", "dayOfWeek", "relative")
    sure = _by_family("date", forms.BASE) + F.when(stated, 0.1).otherwise(0.0) + F.when(F.abs(away) <= 365, 0.1).when(F.abs(away) > 730, -0.2).otherwise(0.0) - F.when(away < -1, 0.2).otherwise(0.0)
    weekday = F.when(f == "dayOfWeek", F.lower(_g(0))).when((f == "relative") & (F.size(words) > 1), F.get(words, F.lit(1)))
    return own.withColumns({"weekday": weekday, "ambiguous": F.coalesce(numeric & (F.col("month") != F.col("day")), F.lit(False)), "confidence": clamp(sure), "key": F.col("date").cast("string")}).drop("month", "day", "year")


def hour24(hour: Column, period: Column) -> Column:
    """12 AM is 0, 12 PM is 12; without a period the hour is as it is."""
    return F.when((period == "AM") & (hour == 12), 0).when((period == "PM") & (hour != 12), hour + 12).otherwise(hour)


def infer_period(hour: Column, around: Column) -> Column:
    """AM for 7 to 11 near words of the morning, else PM."""
    return F.when(hour.between(7, 11) & contains_any(F.lower(around), forms.EARLY), "AM").otherwise("PM")


def times(rows: DataFrame) -> DataFrame:
    """Time matches with hour and minute (of a range its start's), end_hour, end_minute, kind (standard, range, doors, show, approximate, contextual) and confidence."""
    f = F.col("family")
    is_range, military = f == "ranges", f == "military"
    period = lambda i: F.upper(F.regexp_replace(_g(i), r"\.", ""))
    number = lambda i: _g(i).try_cast("int")
    minute = F.coalesce(number(1), F.lit(0))
    stated = F.coalesce(period(2), infer_period(number(0), F.lit("")))
    hour = F.when(military, number(0)).when(is_range, hour24(number(0), period(2))).otherwise(hour24(number(0), stated))
    twelve = lambda h, m: h.between(1, 12) & m.between(0, 59)
    end_minute = F.coalesce(number(4), F.lit(0))
    valid = F.when(military, number(0) <= 23).when(is_range, twelve(number(0), minute) & twelve(number(3), end_minute)).otherwise(twelve(number(0), minute))
    kind = first_match([(is_range, F.lit("range")), (f == "casual", F.lit("approximate")), (f.isin("doors", "show", "contextual"), f)], F.lit("standard"))
    sure = _by_family("time", forms.BASE) + F.when(is_range & period(2).isNull(), -0.2).otherwise(0.1)
    sure = sure + F.when(number(0).between(6, 23) | number(0).between(0, 2), 0.1).otherwise(-0.1) + F.when(minute.isin(0, 15, 30, 45), 0.05).otherwise(0.0)
    own = rows.filter((F.col("field") == "time") & valid)
    own = own.withColumns({"hour": hour, "minute": minute, "end_hour": F.when(is_range, hour24(number(3), period(5))), "end_minute": F.when(is_range, end_minute), "kind": kind, "confidence": clamp(sure) * F.when(f == "casual", 0.9).otherwise(1.0)})
    key = F.concat_ws(":", F.coalesce(F.nullif(F.col("hour"), F.lit(0)).cast("string"), F.lit("-")), F.coalesce(F.nullif(F.col("minute"), F.lit(0)).cast("string"), F.lit("-")), "kind")
    return own.withColumn("key", key)


def _reasonable(x: Column) -> Column:
    return x.between(0, 500)


def prices(rows: DataFrame) -> DataFrame:
    """Price matches with least, most (either may be open), free, kind, tier, timing, about (what a price with context is for) and confidence."""
    f = F.col("family")
    amount = lambda i: _g(i).try_cast("double")
    least = F.when(f == "free", 0.0).when(f == "maximum", F.lit(None)).otherwise(amount(0))
    most = F.when(f == "free", 0.0).when(f == "ranges", amount(1)).when(f == "starting", F.lit(None)).otherwise(amount(0))
    kind = F.when(f == "ranges", "range").otherwise(f)
    near = F.lower(F.concat("before", "found", "after"))
    about = F.when(f == "contextual", first_match([(F.contains(near, F.lit(w)), F.lit(w)) for w in forms.PRICE_WORDS], F.lit("general")))
    tier = F.when(f == "tiered", first_match([(F.lower(_g(1)).isin(words), F.lit(t)) for t, words in forms.TIERS.items()], F.lit("other")))
    timing = F.when(f == "timing", first_match([(contains_any(F.lower("found"), words), F.lit(t)) for t, words in forms.TIMING.items()], F.lit("general")))
    own = rows.filter(F.col("field") == "price").withColumns({"least": least, "most": most, "free": f == "free", "kind": kind, "about": about, "tier": tier, "timing": timing})
    own = own.filter((F.col("kind") != "range") | (F.col("least") <= F.col("most")))
    low, high = F.col("least"), F.col("most")
    both = _reasonable(low) & _reasonable(high) & (high > low) & (high - low <= 200)
    sure = _by_family("price", forms.BASE) + F.when(low.isNotNull() & high.isNotNull(), F.when(both, 0.1).otherwise(-0.2)).when(low.isNotNull(), F.when(_reasonable(low), 0.1).otherwise(-0.1)).otherwise(0.0)
    shown = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    return own.withColumns({"confidence": clamp(F.when(f == "free", F.greatest(sure, F.lit(0.9))).otherwise(sure)), "key": F.concat_ws(":", "kind", shown(low), shown(high), shown(F.col("tier")), shown(F.col("timing")))})


def likely_venue(name: Column, before: Column, after: Column) -> Column:
    """Whether words of venues stand around a name, or it names a type of venue."""
    around = F.lower(F.concat(before, F.lit(" "), after))
    placed = F.lower(before).rlike(r"\b(at|@|venue|location)\s*$") | F.lower(after).rlike(r"^\s*(in|at|near|downtown)")
    return contains_any(around, forms.VENUE_WORDS) | contains_any(F.lower(name), forms.VENUE_TYPES) | placed


def venues(rows: DataFrame) -> DataFrame:
    """Venue matches with name, kind (venue, address, potential_venue, location), venue_type, city and confidence."""
    f = F.col("family")
    cleaned = first_match([(f == "venueTypes", clean_name(F.concat(text(_g(0)), _g(1))))], clean_name(_g(0)))
    parts = F.concat_ws(" ", _g(0), _g(1), _g(2))
    own = rows.filter(F.col("field") == "venue").withColumn("_clean", cleaned)
    named = f.isin("atVenue", "venueTypes", "liveAt", "properNouns")
    own = own.filter(~named | valid_name(F.col("_clean"))).filter((f != "properNouns") | likely_venue(F.col("_clean"), F.col("before"), F.col("after")))
    place = F.concat(F.upper(F.substring(_g(2), 1, 1)), F.lower(F.substring(_g(2), 2, 100)))
    name = first_match([(f == "venueTypes", F.concat("_clean", F.lit(" "), place)), (f == "addresses", parts), (f == "locations", F.concat(_g(0), F.lit(", "), _g(1)))], F.col("_clean"))
    kind = first_match([(f == "addresses", F.lit("address")), (f == "locations", F.lit("location")), (f == "properNouns", F.lit("potential_venue"))], F.lit("venue"))
    own = own.withColumns({"name": name, "kind": kind, "venue_type": F.when(f == "venueTypes", F.lower(_g(2))), "city": F.when(f == "locations", _g(0))})
    judged = F.when(f == "venueTypes", F.col("_clean")).otherwise(F.col("name"))
    sure = (_by_family("venue", forms.BASE) + F.when(f.isin("atVenue", "venueTypes", "liveAt"), 0.1).otherwise(0.0)) * name_quality(judged)
    key = F.concat_ws(":", F.trim(F.regexp_replace(F.lower("name"), r"\s+", " ")), "kind")
    return own.withColumns({"confidence": clamp(sure), "key": key}).drop("_clean")


#: Columns that hold what a field's matches say; rows of one field have null in those of the others.
VALUES = {
    "date": "date", "weekday": "string", "ambiguous": "boolean", "hour": "int", "minute": "int", "end_hour": "int", "end_minute": "int", "least": "double", "most": "double", "free": "boolean",
    "about": "string", "tier": "string", "timing": "string", "name": "string", "venue_type": "string", "city": "string", "kind": "string",
}
_COMMON = ["id", "field", "family", "ord", "found", "at", "size", "before", "after", "key", "confidence"]


def _whole(rows: DataFrame) -> DataFrame:
    return rows.select(*_COMMON, *(F.col(c).cast(t).alias(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in VALUES.items()))


def distinct(rows: DataFrame) -> DataFrame:
    """One match per id, field and key, the most confident, of equals the first; with ``rank`` within its field.

    Matches are ranked by confidence, then whole prices first and known venues
    before venues, addresses, locations and names, then by where the first match of the key was.
    """
    key = Window.partitionBy("id", "field", "key")
    best = rows.withColumns({"_r": F.row_number().over(key.orderBy(F.col("confidence").desc(), "ord")), "_first": F.min("ord").over(key)}).filter("_r = 1")
    order = {"known_venue": 3, "venue": 2, "address": 1, "potential_venue": -1}
    tie = F.when(F.col("field") == "price", (F.col("least").isNotNull() & F.col("most").isNotNull()).cast("int")).when(F.col("field") == "venue", first_match([(F.col("kind") == k, F.lit(v)) for k, v in order.items()], F.lit(0))).otherwise(0)
    ranked = Window.partitionBy("id", "field").orderBy(F.col("confidence").desc(), tie.desc(), "_first")
    return best.withColumn("rank", F.row_number().over(ranked)).drop("_r", "_first")


#: Texts whose matches one task sorts.
TASK_TEXTS = 1 << 15


def extract(texts: DataFrame, as_of: Column, fields: Sequence[str] = ("date", "time", "price", "venue")) -> DataFrame:
    """Distinct ranked matches of ``fields`` in ``texts`` (id, text)."""
    every = {"date": lambda r: dates(r, as_of), "time": times, "price": prices, "venue": venues}
    out = functools.reduce(DataFrame.unionByName, [_whole(every[f](scan(texts, [f]))) for f in fields])
    short_methods(texts.sparkSession)
    # All rows of an id together: the windows that follow need no other shuffle. What a task sorts does not grow with the table.
    least = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return distinct(out.repartition(max(least, -(-texts.count() // TASK_TEXTS)), "id"))


@dataclass(frozen=True)
class Context:
    """What is known of the event beforehand: columns over the matches, or null."""

    event_type: Column | None = None
    capacity: Column | None = None
    location: Column | None = None
    recurring: Column | None = None
    accuracy: Column | None = None


def validation(as_of: Column) -> Column:
    """1 and half of each rule's weight where a match passes it, less 0.3 of it where not."""
    away = F.datediff("date", as_of)
    # A start at hour or minute 0 counts as missing, and passes no rule.
    hour = F.when(F.col("kind") == "range", F.col("hour")).otherwise(F.nullif("hour", F.lit(0)))
    minute = F.when(F.col("kind") == "range", F.col("minute")).otherwise(F.nullif("minute", F.lit(0)))
    low = F.coalesce("least", F.lit(0.0))
    high = F.coalesce(F.nullif("most", F.lit(0.0)), low)
    rules = {
        "date": [(away > 0, 0.15), (away.between(0, 365), 0.1), (F.lit(True), 0.2)],
        "time": [(hour.between(6, 23) | hour.between(0, 2), 0.15), (hour.between(0, 23) & minute.between(0, 59), 0.2)],
        "price": [(F.col("free") | ((low >= 0) & (high <= 1000)), 0.15), (F.coalesce(F.col("most") >= F.col("least"), F.lit(True)), 0.1)],
        "venue": [(F.length("name").between(3, 100), 0.1), (F.col("venue_type").isNotNull() | (F.col("kind") == "known_venue"), 0.05)],
    }
    score = lambda checks: sum((F.when(F.coalesce(c, F.lit(False)), w * 0.5).otherwise(-w * 0.3) for c, w in checks), F.lit(1.0))
    return clamp(first_match([(F.col("field") == f, score(checks)) for f, checks in rules.items()], F.lit(1.0)), 0.1, 1.5)


def clarity() -> Column:
    """Less for odd characters and wide spaces in a match, more for a capital at its start."""
    odd = F.when(F.col("found").rlike(r"[^\w\s.,!?:;'\"$%()-]"), 0.8).otherwise(1.0) * F.when(F.col("found").rlike(r"\s{3,}"), 0.9).otherwise(1.0)
    return clamp(odd * F.when(F.trim("found").rlike("^[A-Z]"), 1.1).otherwise(1.0), 0.1, 1.3)


def position() -> Column:
    """More early in a text and near important words, less near its end; 1 at its very start."""
    share = F.col("at") / F.col("size")
    near = contains_any(F.lower(F.concat("before", F.lit(" "), "after")), forms.IMPORTANT)
    score = F.when(share < 0.3, 1.1).when(share > 0.8, 0.9).otherwise(1.0) * F.when(near, 1.2).otherwise(1.0)
    return F.when((F.col("at") == 0) | F.col("at").isNull(), 1.0).otherwise(clamp(score, 0.1, 1.5))


def _matches(pattern: str, x: Column) -> Column:
    return F.coalesce(F.lower(x).rlike(pattern), F.lit(False))


def scored(rows: DataFrame, as_of: Column, context: Context | None = None) -> DataFrame:
    """Matches of ``extract`` with their confidence weighed by field, by the other fields of the text and by context; it may exceed 1."""
    c = context or Context()
    none = lambda x, t: F.lit(None).cast(t) if x is None else x
    event, capacity, location, recurring, accuracy = none(c.event_type, "string"), none(c.capacity, "int"), none(c.location, "string"), none(c.recurring, "boolean"), none(c.accuracy, "double")
    f, first = F.col("field"), F.col("rank") == 1
    weight = first_match([(f == k, _by_family(k, forms.WEIGHTS, 1.0)) for k in forms.WEIGHTS], F.lit(1.0))
    own = clamp(F.when(F.col("confidence") == 0, 0.5).otherwise(F.col("confidence")) * weight * validation(as_of) * clarity() * position())
    hour = F.when(F.col("kind") == "range", F.col("hour")).otherwise(F.nullif("hour", F.lit(0)))
    w = Window.partitionBy("id")
    of_first = lambda field, x: F.max(F.when(first & (f == field), x)).over(w)
    is_doors, is_show = (f == "time") & (F.col("kind") == "doors"), (f == "time") & (F.col("kind") == "show")
    at_rank = lambda k: F.min(F.when(k, F.struct("rank", "hour"))).over(w)
    rows = rows.withColumns({
        "confidence": own, "_hour": hour, "_weekday": of_first("date", F.dayofweek("date")), "_doors": at_rank(is_doors), "_show": at_rank(is_show), "_place": of_first("venue", F.coalesce("venue_type", F.lit(""))),
    })
    by = lambda cond, factor: F.when(F.coalesce(cond, F.lit(False)), factor).otherwise(1.0)
    weekend = F.col("_weekday").isin(1, 7)
    amount = F.coalesce(F.nullif("least", F.lit(0.0)), F.col("most"), F.lit(0.0))
    free = F.coalesce(F.col("free"), F.lit(False))
    is_time, is_price, is_venue = f == "time", f == "price", f == "venue"
    apart = F.col("_doors.hour") < F.col("_show.hour")
    of_pair = (is_doors & (F.col("rank") == F.col("_doors.rank"))) | (is_show & (F.col("rank") == F.col("_show.rank")))
    music, theatre, workshop = _matches("concert|music", event), _matches("theater|play", event), _matches("workshop|class", event)
    priced_place = is_price & first & F.col("_place").isNotNull()
    factors = [
        by(is_time & first & weekend & (F.col("_hour") > 22), 0.9), by(is_time & first & ~weekend & (F.col("_hour") < 18), 1.1),
        by(priced_place & (capacity > 1000) & (amount < 20) & ~free, 0.8), by(priced_place & (capacity < 200) & (amount > 100), 0.7),
        by(priced_place & F.col("_place").isin("museum", "library", "gallery") & free, 1.2), by(priced_place & F.col("_place").isin("club", "bar", "lounge") & (amount > 0), 1.1),
        by(of_pair & apart, 1.2), by(of_pair & ~apart, 0.7),
        F.when(is_time & (F.col("kind") == "range"), F.when((F.col("end_hour") > F.col("hour")) | ((F.col("hour") > 20) & (F.col("end_hour") < 6)), 1.1).otherwise(0.8)).otherwise(1.0),
        by(music & is_time & F.col("_hour").between(19, 23), 1.15), by(music & is_price & ~free & (F.col("least") > 10), 1.1),
        by(theatre & is_time & F.col("_hour").isin(14, 19, 20), 1.2), by(workshop & is_time & F.col("_hour").between(9, 17), 1.1),
        by(is_venue & (F.col("kind") == "known_venue"), 1.3), by(is_venue & (F.lower("city") == F.lower(location)), 1.2), by((f == "date") & F.col("weekday").isNotNull() & recurring, 1.1),
        F.coalesce(0.8 + 0.4 * F.nullif(accuracy, F.lit(0.0)), F.lit(1.0)),
    ]
    total = functools.reduce(lambda a, b: a * b, factors, F.col("confidence"))
    return rows.withColumn("confidence", total).drop("_hour", "_weekday", "_doors", "_show", "_place")


def confident(rows: DataFrame, least: float = 0.6) -> DataFrame:
    return rows.filter(F.col("confidence") >= least)


def best(rows: DataFrame) -> DataFrame:
    """The most confident match of each id and field, of equals the one that ranked first."""
    order = Window.partitionBy("id", "field").orderBy(F.col("confidence").desc(), "rank")
    return rows.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


def alternatives(rows: DataFrame, most: int = 3) -> DataFrame:
    """The first ``most`` matches of each id and field; the chosen one is among them, as matches are not compared with it."""
    return rows.filter(F.col("rank") <= most).select("id", "field", "rank", "found", "confidence")


#: What tells of a badly read text.
POOR = r"[Il1]{3,}|[0O]{3,}|\s{5,}|[^\w\s.,!?:;'\"$%()-]{3,}"


def poor_quality(x: Column) -> Column:
    return text(x).rlike(POOR)


def summary(texts: DataFrame, chosen: DataFrame) -> DataFrame:
    """One row per text (id, text): the chosen values, starts_at, confidence (weighted by field) and issues."""
    names = [c for c in VALUES if c not in ("ambiguous", "about", "city")]
    of = lambda field, c: F.max(F.when(F.col("field") == field, F.col(c)))
    owner = {"date": ["date", "weekday"], "time": ["hour", "minute", "end_hour", "end_minute"], "price": ["least", "most", "free", "tier", "timing"], "venue": ["name", "venue_type"]}
    values = {c: of(f, c) for f, own in owner.items() for c in own if c in names}
    weight = first_match([(F.col("field") == k, F.lit(v)) for k, v in forms.FIELD_WEIGHTS.items()], F.lit(0.25))
    sure = F.try_divide(F.sum(F.col("confidence") * weight), F.sum(weight))
    has = {f"_{k}": F.bool_or(F.col("field") == k) for k in ("date", "time", "venue")}
    one = chosen.groupBy("id").agg(*(v.alias(k) for k, v in values.items()), sure.alias("confidence"), *(v.alias(k) for k, v in has.items()))
    out = texts.select("id", poor_quality(F.col("text")).alias("_poor")).join(one, "id", "left").withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
    lacks = lambda k: ~F.coalesce(F.col(f"_{k}"), F.lit(False))
    issues = F.array_compact(F.array(*(F.when(lacks(k), f"missing_{k}") for k in ("date", "time", "venue")), F.when(F.col("confidence") < 0.7, "low_confidence"), F.when(F.col("_poor"), "poor_ocr_quality")))
    starts = F.try_to_timestamp(F.format_string("%s %02d:%02d", F.col("date").cast("string"), "hour", "minute"), F.lit("yyyy-MM-dd HH:mm"))
    return out.withColumns({"starts_at": F.when(F.col("date").isNotNull() & F.col("hour").isNotNull(), starts), "issues": issues}).drop("_poor", *has)


def parse(texts: DataFrame, as_of: Column, context: Context | None = None, least: float = 0.6) -> DataFrame:
    """Date, time, price and venue of each of ``texts`` (id, text, already cleaned): scan, rules, scoring, choice, in one plan with one shuffle by id for the matches."""
    return summary(texts, best(confident(scored(extract(texts, as_of), as_of, context), least)))


def checks(parsed: DataFrame, as_of: Column) -> DataFrame:
    """id, errors and warnings of the values of ``summary``, and whether it is valid."""
    m = lambda *pairs: F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), t) for c, t in pairs)))
    away, low, high = F.datediff("date", as_of), F.col("least"), F.col("most")
    errors = m((~F.col("hour").between(0, 23), "invalid_hour"), (~F.col("minute").between(0, 59), "invalid_minute"), (low < 0, "negative_price"), ((high != 0) & (high < low), "invalid_price_range"))
    warnings = m((away < -1, "date_in_past"), (away > 365, "date_far_future"), (F.col("hour") < 6, "very_early_time"), (low > 1000, "very_high_price"), (F.length("name") < 3, "very_short_venue_name"), (F.length("name") > 100, "very_long_venue_name"))
    return parsed.select("id", errors.alias("errors"), warnings.alias("warnings"), (F.size(errors) == 0).alias("valid"), "confidence")
