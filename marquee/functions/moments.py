"""Dates and times written in many ways, without a time zone: one value from one text.

``as_of`` takes the place of a clock. Two-digit years below 50 are of this
century. Months are what their names say.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marquee.functions.common import contains_any, first_match, let, matched, text
from marquee.functions.fixes import future_date, next_weekday, relative_week
from marquee.functions.forms import MONTHS, WEEKDAYS

_FULL, _SHORT = "|".join(MONTHS), "|".join(m[:3] for m in MONTHS)
_ANY = "|".join([*MONTHS, *(m[:3] for m in MONTHS), "Sept"])
#: Words near a time that tell of a show or of doors.
SHOW, DOORS = ["show", "performance", "concert", "start", "begins"], ["doors", "gates", "admission", "entry", "open"]


def month_number(name: Column) -> Column:
    return F.nullif(F.array_position(F.array(*(F.lit(m[:3].lower()) for m in MONTHS)), F.lower(F.substring(name, 1, 3))), F.lit(0)).cast("int")


def make_date(year: Column, month: Column, day: Column) -> Column:
    """Null for days that a month lacks."""
    return F.try_to_date(F.format_string("%04d-%02d-%02d", year.try_cast("int"), month.try_cast("int"), day.try_cast("int")), "yyyy-MM-dd")


def flexible_date(x: Column) -> Column:
    """First form that gives a date: month/day/year, month name day year, day month name year, year-month-day."""
    t = F.trim(text(x))
    us, iso = r"(\d{1,2})[/-](\d{1,2})[/-](\d{4})", r"(\d{4})-(\d{1,2})-(\d{1,2})"
    named, day_first = rf"(?i)\b({_ANY})\.?\s+(\d{{1,2}}),?\s+(\d{{4}})", rf"(?i)\b(\d{{1,2}})\s+({_FULL})\s+(\d{{4}})"
    return F.coalesce(
        matched(t, us, 3, lambda m, d, y: make_date(y, m, d)), matched(t, named, 3, lambda m, d, y: make_date(y, month_number(m), d)), matched(t, day_first, 3, lambda d, m, y: make_date(y, month_number(m), d)), matched(t, iso, 3, make_date),
    )



def _hour(hour: Column, period: Column) -> Column:
    return F.when((F.upper(period) == "PM") & (hour != 12), hour + 12).when((F.upper(period) == "AM") & (hour == 12), 0).otherwise(hour)


def flexible_time(x: Column) -> Column:
    """HH:MM:SS of the first form that fits: h:mm am/pm, 24 hours at the end of the text, an hour with am/pm; else null."""
    t = F.trim(text(x))
    clock, whole, alone = r"(?i)(\d{1,2}):(\d{2})\s*(AM|PM)", r"(\d{1,2}):(\d{2})(?::(\d{2}))?$", r"(?i)(\d{1,2})\s*(AM|PM)"
    n = lambda x: x.try_cast("int")
    pad = lambda h, m, s: F.format_string("%02d:%02d:%02d", h, m, s)
    return F.coalesce(
        matched(t, clock, 3, lambda h, m, p: F.when(n(h).isNotNull(), pad(_hour(n(h), p), n(m), F.lit(0)))),
        matched(t, whole, 3, lambda h, m, s: F.when(n(h).between(0, 23) & n(m).between(0, 59), pad(n(h), n(m), F.coalesce(n(s), F.lit(0))))),
        matched(t, alone, 2, lambda h, p: F.when(n(h).isNotNull(), pad(_hour(n(h), p), F.lit(0), F.lit(0)))),
    )


def combined(date: Column, time: Column) -> Column:
    """Timestamp of a date and a time as text; midnight without a time, null without a date."""
    return F.try_to_timestamp(F.concat_ws(" ", flexible_date(date).cast("string"), F.coalesce(flexible_time(time), F.lit("00:00:00"))), F.lit("yyyy-MM-dd HH:mm:ss"))


def clock_of(x: Column) -> Column:
    """HH:MM:SS of the first h:mm[:ss] with or without am/pm, else null."""
    p = r"(?i)(\d{1,2}):(\d{2})(?::(\d{2}))?\s*(AM|PM)?"
    n = lambda x: x.try_cast("int")
    return matched(text(x), p, 4, lambda h, m, s, period: F.when(n(h).isNotNull(), F.format_string("%02d:%02d:%02d", _hour(n(h), F.coalesce(period, F.lit(""))), n(m), F.coalesce(n(s), F.lit(0)))))


def _weekday(name: Column) -> Column:
    return F.array_position(F.array(*(F.lit(d[:3].lower()) for d in WEEKDAYS)), F.lower(F.substring(name, 1, 3))).cast("int") - 1


def natural_date(x: Column, as_of: Column) -> Column:
    """today, tomorrow, yesterday, and this or next week, weekend or weekday; a weekday named later overrules a day named before."""
    t = F.lower(text(x))
    p = r"\b(this|next)\s+(weekend|week|monday|tuesday|wednesday|thursday|friday|saturday|sunday)"
    return let(F.struct(F.regexp_extract(t, p, 1).alias("which"), F.regexp_extract(t, p, 2).alias("what")), lambda g: _named_day(t, g["which"], g["what"], as_of))


def _named_day(t: Column, which: Column, what: Column, as_of: Column) -> Column:
    day = first_match([(what == "weekend", F.when(which == "next", relative_week(as_of, True, "weekend")).otherwise(relative_week(as_of, False, "weekend"))), (what == "week", F.when(which == "next", relative_week(as_of, True, "week")).otherwise(relative_week(as_of, False, "week")))], F.when(which == "next", next_weekday(as_of, _weekday(what), True)).otherwise(next_weekday(as_of, _weekday(what))))
    return first_match([(what != "", day), (F.contains(t, F.lit("today")), as_of), (F.contains(t, F.lit("tomorrow")), F.date_add(as_of, 1)), (F.contains(t, F.lit("yesterday")), F.date_add(as_of, -1))], F.lit(None).cast("date"))


def relative_date(x: Column, as_of: Column) -> Column:
    """The next weekday whose name or first three letters the text has anywhere, 'next' meaning not today."""
    p = r"(this|next)?\s*(monday|tuesday|wednesday|thursday|friday|saturday|sunday|mon|tue|wed|thu|fri|sat|sun)"
    day = lambda which, what: F.when(what != "", F.when(which == "next", next_weekday(as_of, _weekday(what), True)).otherwise(next_weekday(as_of, _weekday(what))))
    return let(F.struct(F.regexp_extract(F.lower(text(x)), p, 1).alias("which"), F.regexp_extract(F.lower(text(x)), p, 2).alias("what")), lambda g: day(g["which"], g["what"]))


def pattern_date(x: Column, as_of: Column) -> Column:
    """First of: year-month-day, month/day/year, month name day year, day month name year, month name day (this year)."""
    t = text(x)
    iso, us = r"(\d{4})-(\d{1,2})-(\d{1,2})", r"(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})"
    named, day_first, short = rf"(?i)\b({_ANY})\s+(\d{{1,2}}),?\s+(\d{{4}})", rf"(?i)\b(\d{{1,2}})\s+({_ANY})\s+(\d{{4}})", rf"(?i)\b({_ANY})\s+(\d{{1,2}})\b"
    return F.coalesce(
        matched(t, iso, 3, make_date), matched(t, us, 3, lambda m, d, y: make_date(y, m, d)), matched(t, named, 3, lambda m, d, y: make_date(y, month_number(m), d)), matched(t, day_first, 3, lambda d, m, y: make_date(y, month_number(m), d)),
        matched(t, short, 2, lambda m, d: make_date(F.year(as_of).cast("string"), month_number(m), d)),
    )


def said_time(x: Column) -> Column:
    """Struct of time, confidence and context of the first h:mm or h am/pm: an hour under 12 is in the evening unless doors open then."""
    t = text(x)
    p = r"(?i)\b(\d{1,2})(?::(\d{2}))?\s*(am|pm|a\.m\.|p\.m\.)|\b(\d{1,2}):(\d{2})\b"

    def told(g: Column) -> Column:
        n = lambda i: F.nullif(g[i], F.lit("")).try_cast("int")
        found, period = g[0], F.lower(g[3])

        def at_hour(around: Column) -> Column:
            context = F.when(contains_any(around, SHOW), "show").when(contains_any(around, DOORS), "doors").otherwise("general")
            return let(F.struct(F.coalesce(n(1), n(4)).alias("hour"), F.coalesce(n(2), n(5), F.lit(0)).alias("minute"), context.alias("context")), whole)

        def whole(w: Column) -> Column:
            hour, minute, context = w["hour"], w["minute"], w["context"]
            evening = period.startswith("p") | ((period == "") & (hour < 12) & (context != "doors"))
            full = F.when(evening & (hour < 12), hour + 12).when(~evening & (hour == 12), 0).otherwise(hour)
            sure = 0.6 + F.when(period != "", 0.2).otherwise(0.0) + F.when(context == "show", 0.15).when(context == "doors", 0.05).otherwise(0.0) + F.when(F.contains(found, F.lit(":")), 0.1).otherwise(0.0)
            return F.when((found != "") & full.between(0, 23) & minute.between(0, 59), F.struct(F.format_string("%02d:%02d:00", full, minute).alias("time"), F.round(F.least(F.lit(0.95), sure), 4).alias("confidence"), context.alias("context")))

        beside = lambda at: F.lower(F.concat(F.substring(t, F.greatest(F.lit(1), at - 20), F.least(F.lit(20), at - 1)), F.lit(" "), F.substring(t, at + F.length(found), F.lit(20))))
        return let(let(F.position(found, t), beside), at_hour)

    return let(F.array(*(F.regexp_extract(t, p, i) for i in range(6))), told)


def parse_moment(x: Column, as_of: Column, default_time: str = "19:00:00", prefer_future: bool = True) -> Column:
    """Struct of date, time, confidence: a day named outright (0.9; weeks 0.8) or a weekday (0.8) decides alone; else a date's form (0.85) with the time said, past dates a year on."""
    week = F.lower(text(x)).rlike(r"\b(this|next)\s+(weekend|week|monday|tuesday|wednesday|thursday|friday|saturday|sunday)")
    make = lambda d, t, c: F.struct(d.alias("date"), t.alias("time"), c.alias("confidence"))
    none = F.lit(None).cast("string")

    def choose(r: Column) -> Column:
        natural, relative, formed, said = r["natural"], r["relative"], r["formed"], r["said"]
        date = F.coalesce(future_date(formed, as_of) if prefer_future else formed, as_of)
        both = F.greatest(F.when(formed.isNotNull(), 0.85).otherwise(0.0), F.coalesce(said["confidence"], F.lit(0.0)))
        return first_match([
            (natural.isNotNull(), make(natural, none, F.when(week, 0.8).otherwise(0.9))), (relative.isNotNull(), make(relative, none, F.lit(0.8))),
            (formed.isNotNull() | said.isNotNull(), make(date, F.coalesce(said["time"], F.lit(default_time)), both)),
        ], make(F.lit(None).cast("date"), none, F.lit(0.0)))

    return let(F.struct(natural_date(x, as_of).alias("natural"), relative_date(x, as_of).alias("relative"), pattern_date(x, as_of).alias("formed"), said_time(x).alias("said")), choose)


def local_moment(x: Column, as_of: Column, default_time: str = "19:00:00") -> Column:
    """Struct of date, startTime, confidence (.4 for each, .2 for both), as wall time: times with am/pm first, hours 7 to 11 without are in the evening."""
    t = text(x)
    marked, plain = r"(?i)\b(\d{1,2})(?::(\d{2}))?\s*(AM|PM)\b", r"\b(\d{1,2}):(\d{2})\b"
    n = lambda x: x.try_cast("int")
    pad = lambda h, m: F.format_string("%02d:%02d:00", h, m)
    evening = lambda h: F.when(h.between(7, 11), h + 12).otherwise(h)
    time = F.coalesce(
        matched(t, marked, 3, lambda h, m, p: F.when(n(h).isNotNull(), pad(_hour(n(h), p), F.coalesce(n(m), F.lit(0))))), matched(t, plain, 2, lambda h, m: F.when(n(h).isNotNull(), pad(evening(n(h)), n(m)))),
    )
    us, named, day_first = r"\b(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})\b", rf"(?i)\b({_ANY})\s+(\d{{1,2}}),?\s*(\d{{4}})\b", rf"(?i)\b(\d{{1,2}})\s+({_ANY})\s*,?\s*(\d{{4}})\b"
    full = lambda y: F.when(y < 50, y + 2000).when(y < 100, y + 1900).otherwise(y)
    spoken = let(F.lower(F.regexp_extract(t, r"(?i)\b(today|tomorrow|yesterday)\b", 1)), lambda word: F.when(word == "today", as_of).when(word == "tomorrow", F.date_add(as_of, 1)))
    date = F.coalesce(
        matched(t, us, 3, lambda m, d, y: make_date(full(n(y)), m, d)), matched(t, named, 3, lambda m, d, y: make_date(y, month_number(m), d)), matched(t, day_first, 3, lambda d, m, y: make_date(y, month_number(m), d)), spoken,
    )

    def both(w: Column) -> Column:
        date, time = w["date"], w["time"]
        sure = F.when(time.isNotNull() & date.isNotNull(), 1.0).when(time.isNotNull() | date.isNotNull(), 0.4).otherwise(0.0)
        return F.struct(date.alias("date"), F.coalesce(time, F.when(date.isNotNull(), default_time)).alias("startTime"), sure.alias("confidence"))

    return let(F.struct(date.alias("date"), time.alias("time")), both)
