"""Cities, regions and collections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marquee.functions.common import contains_any, first_match, text

#: Cities in the order in which they are tried.
BAY_CITIES = [
    "San Francisco", "Oakland", "San Jose", "Berkeley", "Palo Alto", "Mountain View", "Redwood City", "San Mateo", "Fremont", "Sunnyvale",
    "Santa Clara", "Hayward", "Richmond", "Daly City", "Alameda", "San Bruno", "Millbrae", "Foster City", "Belmont", "San Carlos",
    "Cupertino", "Los Altos", "Menlo Park", "Union City", "San Rafael", "Petaluma", "Napa", "Vallejo", "Concord", "Walnut Creek",
    "Pleasanton", "Dublin", "Livermore", "Santa Rosa", "Novato",
]
AUSTIN_CITIES = [
    "Austin", "Del Valle", "Round Rock", "Cedar Park", "Buda", "Pflugerville", "Leander", "Lakeway", "Georgetown", "Kyle", "Dripping Springs", "Bee Cave",
    "West Lake Hills", "Rollingwood", "Sunset Valley", "Westlake", "Barton Creek", "Manor", "Elgin", "Hutto", "Taylor", "Liberty Hill", "Jonestown", "Lago Vista",
]
CITY_ALIASES = {
    "sf": "San Francisco", "san fran": "San Francisco", "frisco": "San Francisco", "the city": "San Francisco", "berkeley": "Berkeley", "oakland": "Oakland",
    "san jose": "San Jose", "sj": "San Jose", "palo alto": "Palo Alto", "mountain view": "Mountain View", "mv": "Mountain View", "atx": "Austin",
    "austin tx": "Austin", "round rock": "Round Rock", "cedar park": "Cedar Park",
}
#: How many of the cities above routing knows, and how many the copy jobs exclude.
ROUTED_BAY, ROUTED_AUSTIN, COPIED_AUSTIN = 20, 13, 8


def city_of_text(x: Column) -> Column:
    """First city whose name the text contains, else the first alias's, else empty."""
    lower = F.lower(text(x))
    found = [(F.contains(lower, F.lit(c.lower())), F.lit(c)) for c in BAY_CITIES + AUSTIN_CITIES]
    return first_match(found + [(F.contains(lower, F.lit(a)), F.lit(c)) for a, c in CITY_ALIASES.items()], F.lit(""))


def _place(address: Column, city: Column) -> Column:
    return F.lower(F.concat(text(address), F.lit(" "), text(city)))


def in_bay_area(address: Column, city: Column) -> Column:
    return contains_any(_place(address, city), [c.lower() for c in BAY_CITIES] + ["california", "ca "])


def in_austin(address: Column, city: Column) -> Column:
    return contains_any(_place(address, city), [c.lower() for c in AUSTIN_CITIES] + ["texas", "tx "])


def region(address: Column, city: Column) -> Column:
    """Austin is tried first; unlike ``collection_of``, which tries the Bay Area first."""
    return F.when(in_austin(address, city), "austin").otherwise("bayArea")


def collection_of(address: Column, city: Column) -> Column:
    """Where an event is stored; case-sensitive."""
    has = lambda cities: contains_any(text(city), cities) | contains_any(text(address), cities)
    return F.when(has(BAY_CITIES[:ROUTED_BAY]), "bayAreaEvents").when(has(AUSTIN_CITIES[:ROUTED_AUSTIN]), "austinEvents").otherwise("bayAreaEvents")


def is_austin_event(address: Column, city: Column) -> Column:
    """City among the copy jobs' cities, or address containing one."""
    cities = AUSTIN_CITIES[:COPIED_AUSTIN]
    return text(city).isin(cities) | contains_any(text(address), cities)


def is_bay_area_event(address: Column, city: Column) -> Column:
    return ~is_austin_event(address, city)


def city_of_address(address: Column) -> Column:
    """Last part between commas, or the whole."""
    return F.trim(F.element_at(F.split(text(address), ","), -1))


def ensure_comma(address: Column) -> Column:
    """An address without a comma gets one in the middle of its words, or a placeholder if it has under three words."""
    words = F.split(F.trim(address), r"\s+")
    half = F.ceil(F.size(words) / 2).cast("int")
    halves = F.concat_ws(", ", F.concat_ws(" ", F.slice(words, F.lit(1), half)), F.concat_ws(" ", F.slice(words, half + 1, F.size(words))))
    return F.when(F.contains(address, F.lit(",")), address).when(F.size(words) > 2, halves).otherwise(F.concat(address, F.lit(", Location TBD")))
