"""Venue and address from one text, by five strategies whose surest result counts.

Every step is a column of its own, so that each is computed once. Runs of white
space count as one space.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions.common import contains_any, let, squeeze

#: Words of venues.
KEYWORDS = [
    "Theater", "Theatre", "Cinema", "Amphitheater", "Amphitheatre", "Opera House", "Concert Hall", "Music Hall", "Playhouse",
    "Stadium", "Arena", "Coliseum", "Fieldhouse", "Sports Complex", "Golf Course", "Country Club", "Recreation Center", "Gym",
    "Museum", "Gallery", "Library", "University", "College", "School", "Institute", "Academy", "Convention Center", "Exhibition Hall",
    "Restaurant", "Bar", "Pub", "Café", "Coffee Shop", "Bistro", "Lounge", "Club", "Nightclub", "Hotel", "Resort", "Inn",
    "Hall", "Center", "Centre", "Building", "Plaza", "Square", "Park", "Garden", "Pavilion", "Lodge", "Ballroom", "Auditorium",
    "Church", "Cathedral", "Temple", "Synagogue", "Mosque",
    "Conference Center", "Meeting Room", "Boardroom", "Office", "Headquarters", "Studio", "Workshop", "Warehouse",
]
#: Parts of addresses; they count inside words too.
STREETS = [
    "Street", "St", "Avenue", "Ave", "Boulevard", "Blvd", "Road", "Rd", "Drive", "Dr", "Lane", "Ln", "Way", "Place", "Pl", "Court", "Ct", "Circle", "Cir", "Terrace", "Ter", "Highway", "Hwy", "Route", "Rte",
    "North", "South", "East", "West", "N", "S", "E", "W", "Northeast", "Northwest", "Southeast", "Southwest", "NE", "NW", "SE", "SW",
]
#: Cities in order, and states.
CITIES = [
    "San Francisco", "Los Angeles", "San Diego", "Sacramento", "San Jose", "Oakland", "Berkeley", "Palo Alto", "Mountain View", "Santa Clara", "Fremont", "Hayward", "Sunnyvale", "Santa Monica", "Pasadena",
    "Austin", "Houston", "Dallas", "San Antonio", "Fort Worth", "Round Rock", "Cedar Park", "Georgetown", "Pflugerville", "Kyle",
    "New York", "NYC", "Manhattan", "Brooklyn", "Queens", "Bronx", "Staten Island", "Buffalo", "Rochester", "Syracuse",
]
STATES = ["CA", "TX", "NY", "FL", "IL", "WA"]
#: What names a venue, what goes at its beginning, and a street in a text.
NAMED = r"(?i)\b(?:at|@)\s+([^,]+)(?:,|$)"
PREFIXES = r"(?i)^(the|at|in|on|located|situated|held|hosted|takes place|happening|occurring|featuring)\s+"
STREET = r"(?i)[0-9]+\s+[A-Za-z\s]+(?:Street|St|Avenue|Ave|Boulevard|Blvd|Road|Rd|Drive|Dr|Lane|Ln|Way|Place|Pl)"
DEFAULT_CITY = "San Francisco, CA"


def _texts(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def _any(x: Column, words: list[str]) -> Column:
    """Whether x has one of the words anywhere, in either case."""
    return contains_any(F.lower(x), sorted({w.lower() for w in words}))


def title_case(x: Column) -> Column:
    """Of each word the first letter or digit in upper case and what follows in lower case; what stands before it stays."""
    part = lambda w, i: F.regexp_extract(w, r"^(\W*)(\w?)(.*)$", i)
    return F.array_join(F.transform(F.split(x, " "), lambda w: F.concat(part(w, 1), F.upper(part(w, 2)), F.lower(part(w, 3)))), " ")


def tidy(x: Column) -> Column:
    """A venue's name without one leading small word and a trailing number, in title case."""
    return F.trim(title_case(F.regexp_replace(F.regexp_replace(F.trim(x), PREFIXES, ""), r"\s+[0-9]+\s*[A-Za-z]*\s*$", "")))


def city_in(x: Column) -> Column:
    """The first known city that x has anywhere, else the word before the first letters of a state ("Reno, CA"); null if neither."""

    def found(lower: Column) -> Column:
        known = F.get(F.filter(_texts(CITIES), lambda c: F.contains(lower, F.lower(c))), F.lit(0))

        def before(state: Column) -> Column:
            at = F.instr(lower, F.lower(state))
            word = F.element_at(F.split(F.trim(F.substring(x, F.lit(1), F.greatest(at - 1, F.lit(0)))), " "), -1)
            return let(F.when(at > 0, word), lambda w: F.when(F.length(w) > 2, F.concat(title_case(w), F.lit(", "), state)))

        # Most texts have none of the cities, which one look at all of them tells.
        return F.coalesce(F.when(lower.rlike("|".join(c.lower() for c in CITIES)), known), F.get(F.filter(F.transform(_texts(STATES), before), lambda s: s.isNotNull()), F.lit(0)))

    return let(F.lower(x), found)


def _after_city(x: Column, city: Column) -> Column:
    """Place of the city in x, 0 without one."""
    return F.coalesce(F.instr(F.lower(x), F.lower(city)), F.lit(0))


def formatted(x: Column) -> Column:
    """An address: its parts trimmed, blank ones left out; without a comma one is put before the city."""
    own = F.trim(x)
    at = _after_city(own, city_in(own))
    before = F.trim(F.substring(own, F.lit(1), F.greatest(at - 1, F.lit(0))))
    parts = F.filter(F.transform(F.split(own, ","), lambda p: F.trim(p)), lambda p: p != "")
    return F.when(F.contains(own, F.lit(",")), F.array_join(parts, ", ")).when((at > 0) & (before != ""), F.concat(before, F.lit(", "), F.trim(F.substring(own, at, F.length(own))))).otherwise(own)


def sureness(x: Column) -> Column:
    """In tenths: 1, and 4 for a keyword, 2 for two to six words, 2 for neither number nor street, 1 for title case."""
    words = F.size(F.split(F.trim(x), " "))
    plus = lambda c, n: F.when(c, n).otherwise(0)
    return 1 + plus(_any(x, KEYWORDS), 4) + plus(words.between(2, 6), 2) + plus(~x.rlike("[0-9]") & ~_any(x, STREETS), 2) + plus(x == title_case(x), 1)


def keyword_window(x: Column) -> Column:
    """Struct of tenths and name: of the windows of three words before to two after each keyword the surest, the first of several; null without a keyword."""
    one, two = (sorted({k.lower() for k in KEYWORDS if len(k.split()) == n}) for n in (1, 2))

    def windows(w: Column) -> Column:
        words, lower = w["words"], w["lower"]
        pair = lambda i: F.coalesce(F.concat(F.get(lower, i), F.lit(" "), F.get(lower, i + 1)), F.lit(""))
        size = lambda i: F.when(pair(i).isin(two), 2).when(F.get(lower, i).isin(one), 1)
        hits = F.filter(F.transform(lower, lambda _, i: F.struct(i.alias("i"), size(i).alias("size"))), lambda h: h["size"].isNotNull())

        def window(h: Column) -> Column:
            first = F.greatest(h["i"] - 3, F.lit(0))
            name = F.array_join(F.slice(words, first + 1, F.least(h["i"] + h["size"] + 2, F.size(words)) - first), " ")
            return let(name, lambda n: F.struct(sureness(n).alias("tenths"), (-h["i"]).alias("early"), n.alias("name")))

        return F.array_max(F.transform(hits, window))

    found = let(F.struct(F.split(x, " ").alias("words"), F.split(F.lower(x), " ").alias("lower")), windows)
    return F.when(_any(x, KEYWORDS), found)


def located(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with venue, address, confidence and strategy of the text in ``column``.

    A form that names the venue (0.8), parts between commas (0.7 with a keyword,
    else 0.6), words around a keyword (0.7 of their sureness, if that is over
    0.6), what stands before a city (0.5); of equals the first in this order,
    and if all fail, the whole text as a venue or an address (0.3 or 0.2). An
    address without a comma gets its city, or the default. Null and blank texts
    give empty ones, with confidence 0.
    """
    own = set(rows.columns)
    has = lambda c: F.contains(c, F.lit(","))
    r = rows.withColumn("_t", squeeze(F.col(column)))
    t = F.col("_t")
    r = r.withColumns({"_city": city_in(t), "_named": F.regexp_extract(t, NAMED, 1), "_window": keyword_window(t)})
    city = F.coalesce("_city", F.lit(DEFAULT_CITY))
    # A form that names the venue, and what follows it.
    end = F.length(F.regexp_extract(t, "^(.*?" + NAMED.replace("(?i)", "(?i:") + "))", 1))
    rest = F.trim(F.regexp_replace(F.substring(t, end + 1, F.length(t)), "^,", ""))
    r = r.withColumn("_rest", F.when(F.length(rest) < 5, city).otherwise(rest))
    # Parts between commas.
    facts = F.transform(F.split(t, ","), lambda p: F.struct(F.trim(p).alias("p"), _any(F.trim(p), KEYWORDS).alias("key"), F.trim(p).rlike("[0-9]").alias("number"), (F.trim(p).rlike("[0-9]") & _any(F.trim(p), STREETS)).alias("street"), city_in(F.trim(p)).isNotNull().alias("city")))
    r = r.withColumn("_parts", F.when(has(t), facts))
    first = F.col("_parts")[0]
    at_first = ~first["street"] & ~first["city"] & (first["key"] | (~first["number"] & (F.size(F.split(first["p"], " ")) <= 6)))
    later = F.get(F.filter(F.sequence(F.lit(1), F.size("_parts") - 1), lambda i: F.get("_parts", i)["key"] & ~F.get("_parts", i)["street"] & ~F.get("_parts", i)["city"]), F.lit(0))
    r = r.withColumn("_at", F.when(at_first, 0).otherwise(later))
    place = F.get("_parts", F.col("_at"))
    others = F.array_join(F.transform(F.filter(F.transform("_parts", lambda p, i: F.struct(p["p"].alias("p"), i.alias("i"))), lambda x: x["i"] != F.col("_at")), lambda x: x["p"]), ", ")
    # What stands before a city.
    here = _after_city(t, F.col("_city"))
    r = r.withColumns({"_here": here, "_before": F.trim(F.substring(t, F.lit(1), F.greatest(here - 1, F.lit(0))))})
    before = F.col("_before")
    ends = F.lower(before).rlike(f"({'|'.join(sorted({k.lower() for k in KEYWORDS}))})$")
    near_city = (F.length(before) > 5) & ~(before.rlike("^[0-9]") & _any(before, STREETS)) & (ends | (F.size(F.split(before, " ")) <= 5))
    # Words around a keyword; the address is what is left of the text.
    name = tidy(F.col("_window.name"))
    left = F.trim(F.when((name != "") & (F.instr(t, name) > 0), F.concat(F.substring(t, F.lit(1), F.instr(t, name) - 1), F.substring(t, F.instr(t, name) + F.length(name), F.length(t)))).otherwise(t))
    r = r.withColumn("_left", F.when(F.col("_window.tenths") > 5, left))
    street = F.regexp_extract("_left", STREET, 0)
    behind = F.trim(F.substring("_left", F.instr("_left", street) + F.length(street), F.length("_left")))
    around = F.when(street != "", F.concat(street, F.when(behind != "", F.concat(F.lit(", "), behind)).otherwise(""))).otherwise(F.col("_left"))
    # If nothing else: the whole text.
    address_like = t.rlike("[0-9]") | _any(t, STREETS)
    make = lambda v, a, c, s: F.struct(v.alias("venue"), a.alias("address"), F.round(c.cast("double"), 2).alias("confidence"), F.lit(s).alias("strategy"))
    sure = F.round(F.col("_window.tenths") * 0.07, 2)
    options = F.array(
        F.when(F.col("_named") != "", make(tidy(F.col("_named")), formatted(F.col("_rest")), F.lit(0.8), "pattern")),
        F.when(F.col("_at").isNotNull() & (F.size("_parts") > 1), make(tidy(place["p"]), others, F.when(place["key"], 0.7).otherwise(0.6), "structure")),
        F.when(sure > 0.6, make(name, around, sure, "keyword")),
        F.when(F.col("_here").between(1, 1_000_000_000) & near_city, make(tidy(before), formatted(F.substring(t, F.col("_here"), F.length(t))), F.lit(0.5), "context")),
    )
    keyed = _any(t, KEYWORDS)
    last = F.when(~address_like & keyed, make(tidy(t), city, F.lit(0.3), "fallback")).when(address_like, make(F.lit(""), formatted(t), F.lit(0.3), "fallback")).otherwise(make(tidy(t), city, F.lit(0.2), "fallback"))
    r = r.withColumn("_options", F.array_compact(options))
    best = F.array_max(F.transform("_options", lambda o, i: F.struct(o["confidence"].alias("c"), (-i).alias("i"), o.alias("o"))))["o"]
    r = r.withColumn("_best", F.coalesce(best, last))
    r = r.withColumns({"_venue": F.col("_best.venue"), "_address": F.col("_best.address")}).withColumn("_of", city_in(F.col("_address")))
    a, v, c = F.col("_address"), F.col("_venue"), F.col("_of")
    cut = F.trim(F.when(F.instr(a, c) > 0, F.concat(F.substring(a, F.lit(1), F.instr(a, c) - 1), F.substring(a, F.instr(a, c) + F.length(c), F.length(a)))).otherwise(a))
    whole = F.when((a == "") & (v == ""), "").when(a == "", F.concat(v, F.lit(f", {DEFAULT_CITY}"))).when(has(a), a).when(c.isNull(), F.concat(a, F.lit(f", {DEFAULT_CITY}"))).when(cut == "", c).otherwise(F.concat(cut, F.lit(", "), c))
    blank = t == ""
    out = {"venue": F.when(blank, "").otherwise(tidy(v)), "address": F.when(blank, "").otherwise(whole), "confidence": F.when(blank, 0.0).otherwise(F.col("_best.confidence")), "strategy": F.when(blank, "unknown").otherwise(F.col("_best.strategy"))}
    return r.withColumns(out).select(*[n for n in rows.columns if n not in out], *out) if own & set(out) else r.withColumns(out).select(*rows.columns, *out)
