"""Addresses and locations from one text: venue, street, city, region."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marquee.functions.common import contains_any, first_match, let, squeeze, text
from marquee.functions.places import AUSTIN_CITIES, COPIED_AUSTIN, city_of_text, region

#: States by name, the largest cities in the order in which they are tried, types of venues, ends of addresses.
STATES = {
    "Alabama": "AL", "Alaska": "AK", "Arizona": "AZ", "Arkansas": "AR", "California": "CA", "Colorado": "CO", "Connecticut": "CT", "Delaware": "DE", "Florida": "FL", "Georgia": "GA", "Hawaii": "HI", "Idaho": "ID",
    "Illinois": "IL", "Indiana": "IN", "Iowa": "IA", "Kansas": "KS", "Kentucky": "KY", "Louisiana": "LA", "Maine": "ME", "Maryland": "MD", "Massachusetts": "MA", "Michigan": "MI", "Minnesota": "MN", "Mississippi": "MS",
    "Missouri": "MO", "Montana": "MT", "Nebraska": "NE", "Nevada": "NV", "New Hampshire": "NH", "New Jersey": "NJ", "New Mexico": "NM", "New York": "NY", "North Carolina": "NC", "North Dakota": "ND", "Ohio": "OH",
    "Oklahoma": "OK", "Oregon": "OR", "Pennsylvania": "PA", "Rhode Island": "RI", "South Carolina": "SC", "South Dakota": "SD", "Tennessee": "TN", "Texas": "TX", "Utah": "UT", "Vermont": "VT", "Virginia": "VA",
    "Washington": "WA", "West Virginia": "WV", "Wisconsin": "WI", "Wyoming": "WY",
}
MAJOR_CITIES = [
    "New York", "Los Angeles", "Chicago", "Houston", "Phoenix", "Philadelphia", "San Antonio", "San Diego", "Dallas", "San Jose", "Austin", "Jacksonville", "Fort Worth", "Columbus", "Charlotte", "San Francisco",
    "Indianapolis", "Seattle", "Denver", "Washington", "Boston", "El Paso", "Nashville", "Detroit", "Oklahoma City", "Portland", "Las Vegas", "Memphis", "Louisville", "Baltimore", "Milwaukee", "Albuquerque", "Tucson",
    "Fresno", "Mesa", "Sacramento", "Atlanta", "Kansas City", "Colorado Springs", "Omaha", "Raleigh", "Miami", "Long Beach", "Virginia Beach", "Oakland", "Minneapolis", "Tulsa", "Tampa", "Arlington",
]
ENDS = r"(?i)\b([A-Z]{2}\s?\d{5}(-\d{4})?|California|CA|Texas|TX|San Francisco|Austin)\b"
STREETS = r"(?i)\b(street|st|avenue|ave|boulevard|blvd|road|rd|drive|dr|lane|ln|way|place|pl)\b"


def parts_of(address: Column) -> Column:
    """Parts between commas, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text(address), ","), lambda p: F.trim(p)), lambda p: p != "")


def _before(x: Column, pattern: str) -> Column:
    """What stands before the first match."""
    return F.get(F.split(x, pattern, 2), F.lit(0))


def format_address(address: Column) -> Column:
    """'street, city': parts tidied where there are commas; else the first known city put at the end, else a comma before a state or postal code, else San Francisco added."""
    t = F.trim(text(address))
    city = city_of_text(t)
    at = F.position(F.lower(city), F.lower(t))
    street = F.trim(F.when(at > 0, F.concat(F.substring(t, F.lit(1), at - 1), F.substring(t, at + F.length(city), F.length(t)))).otherwise(t))
    end, head = F.regexp_extract(t, ENDS, 1), F.trim(_before(t, ENDS))
    return first_match([
        (t == "", F.lit("")), (F.contains(t, F.lit(",")), F.array_join(parts_of(t), ", ")), ((city != "") & (street != ""), F.concat(street, F.lit(", "), city)), ((end != "") & (head != ""), F.concat(head, F.lit(", "), end)),
    ], F.concat(t, F.lit(", San Francisco")))


def address_problem(address: Column) -> Column:
    """What is wrong with an address, or null."""
    empty = F.exists(F.split(text(address), ","), lambda p: F.trim(p) == "")
    return first_match([(text(address) == "", F.lit("Address is required and must be a string")), (~F.contains(address, F.lit(",")), F.lit('Address must contain a comma (format: "Street, City")')), (empty, F.lit("Address must have both street and city parts"))], F.lit(None).cast("string"))


def venue_of(location: Column, venue_types: list[str]) -> Column:
    """The venue in a location: without a leading preposition, before the first comma and the first number; if over 50 characters, up to the first type of venue (by the order of ``venue_types``)."""
    v = F.regexp_replace(F.trim(text(location)), r"(?i)^(at\s+|the\s+|in\s+|located\s+at\s+)", "")
    v = F.trim(F.regexp_replace(F.trim(F.substring_index(v, ",", 1)), r"\s+\d+.*$", ""))
    cuts = [(F.contains(F.lower(v), F.lit(t.lower())), F.trim(F.substring(v, F.lit(1), F.position(F.lit(t.lower()), F.lower(v)) + len(t) - 1))) for t in venue_types]
    return F.when(F.length(v) > 50, first_match(cuts, v)).otherwise(v)


def parse_location(location: Column, venue_types: list[str]) -> Column:
    """Struct of venue, address, city and region; an empty text is in the Bay Area."""
    t, city, address = text(location), city_of_text(location), format_address(location)
    return F.struct(venue_of(t, venue_types).alias("venue"), address.alias("address"), F.when(t == "", "").otherwise(city).alias("city"), F.when(t == "", "bayArea").otherwise(region(address, city)).alias("region"))


def looks_like_address(x: Column) -> Column:
    """A street, a number and a state in capitals, and no URL."""
    return F.coalesce(x.rlike(STREETS) & x.rlike(r"\b\d+\b") & ~x.rlike("(?i)^https?://") & x.rlike(r"\b[A-Z]{2}(\s*\d{5})?"), F.lit(False))


def repeat_collection(address: Column, city: Column) -> Column:
    """Where a repeated event goes: by eight Austin cities, else the Bay Area."""
    cities = AUSTIN_CITIES[:COPIED_AUSTIN]
    return F.when(text(city).isin(cities) | contains_any(text(address), cities), "austinEvents").otherwise("bayAreaEvents")


def completed_address(address: Column, venue: Column, city: str = "Austin", state: str = "TX") -> Column:
    """Struct of value, confidence and reason for an address without a comma: a venue's name, a major city split off, a state at the end split off, else null."""
    make = lambda v, n, r: F.struct(v.alias("value"), F.lit(n).alias("confidence"), r.alias("reason"))

    def complete(t: Column) -> Column:
        named = make(F.concat(t, F.lit(f", {city}, {state}")), 60, F.lit("Added city and state to venue name"))
        known = F.array(*(F.struct(F.lit(c).alias("city"), F.lit(c.lower()).alias("lower")) for c in MAJOR_CITIES))
        first = let(F.lower(t), lambda low: F.get(F.filter(known, lambda c: F.position(c["lower"], low) > 1), F.lit(0)))
        split_at = lambda x: F.when(x["at"] > 1, make(F.concat(F.trim(F.substring(t, F.lit(1), x["at"] - 1)), F.lit(", "), F.trim(F.substring(t, x["at"], F.length(t)))), 85, F.concat(F.lit("Identified city: "), x["city"])))
        by_city = let(let(first, lambda c: F.struct(c["city"].alias("city"), F.position(c["lower"], F.lower(t)).alias("at"))), split_at)
        return F.coalesce(F.when((text(venue) != "") & (t == venue), named), by_city, let(F.split(t, r"\s+"), by_state))

    def by_state(words: Column) -> Column:
        n = F.size(words)
        last = F.upper(F.get(words, n - 1)).isin(list(STATES.values())) & (n >= 3)
        return F.when(last, make(F.concat(F.array_join(F.slice(words, F.lit(1), F.greatest(n - 2, F.lit(0))), " "), F.lit(", "), F.get(words, n - 2), F.lit(", "), F.get(words, n - 1)), 80, F.lit("Formatted venue, city, state")))

    return let(squeeze(address), complete)


#: What begins a place's name, and the places at which its address begins.
BEFORE_VENUE = r"(?i)^(at\s+|the\s+|in\s+|located\s+at\s+)"
AFTER_VENUE = r"(?i),?\s+(Austin|San Francisco|Oakland|Berkeley|San Jose|TX|CA|Texas|California|United States).*$"


def venue_of_address(x: Column) -> Column:
    """The venue that an address names: without a leading small word, of "x at y" the y, up to a known city or state or the first number; null for an empty address."""
    bare = F.regexp_replace(x, BEFORE_VENUE, "")
    named = F.regexp_replace(bare, r"(?i)^(.+?)\s+at\s+(.+)$", "$2")
    out = F.trim(F.regexp_replace(F.regexp_replace(named, AFTER_VENUE, ""), r"\s*,?\s*\d+.*$", ""))
    return F.when(text(x) != "", out)
