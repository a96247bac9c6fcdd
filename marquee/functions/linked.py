"""Events in linked data: one struct from one JSON value, whatever shapes its parts have (text, object, list)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marquee.functions.common import squeeze

#: Types of events.
EVENT_TYPES = [
    "Event", "SocialEvent", "BusinessEvent", "ChildrensEvent", "ComedyEvent", "CourseInstance", "DanceEvent", "DeliveryEvent", "EducationEvent", "ExhibitionEvent", "Festival", "FoodEvent", "LiteraryEvent", "MusicEvent", "PublicationEvent",
    "SaleEvent", "ScreeningEvent", "SportsEvent", "TheaterEvent", "VisualArtsEvent",
]
SURE = 90


def _at(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _kind(v: Column) -> Column:
    return F.coalesce(_at(v, '$["@type"]'), F.lit(""))


def _text(v: Column) -> Column:
    """The value where it is a text itself, not an object or a list."""
    return F.when(F.schema_of_variant(v) == "STRING", _at(v, "$"))


def _list(v: Column) -> Column:
    """A list as it is, anything else as a list of one; null as an empty one."""
    return F.when(v.isNull(), F.array().cast("array<variant>")).otherwise(F.coalesce(_at(v, "$", "array<variant>"), F.array(v)))


def event_of(json: Column) -> Column:
    """The first event of a list, the value itself, or its mainEntity; null if none is an event."""
    first = F.get(F.filter(_at(json, "$", "array<variant>"), lambda v: _kind(v).isin(EVENT_TYPES)), 0)
    main = _at(json, "$.mainEntity", "variant")
    return F.coalesce(first, F.when(_kind(json).isin(EVENT_TYPES), json), F.when(_kind(main).isin(EVENT_TYPES), main))


def location(v: Column) -> Column:
    """Struct of venue, venue_confidence, address, city, state, zip, lat, lng; a text is a venue, less surely."""
    text = _text(v)
    parts = [F.nullif(_at(v, f"$.address.{p}"), F.lit("")) for p in ("streetAddress", "addressLocality", "addressRegion", "postalCode")]
    joined = F.nullif(F.concat_ws(", ", *parts), F.lit(""))
    whole = _text(_at(v, "$.address", "variant"))
    lat, lng = _at(v, "$.geo.latitude", "double"), _at(v, "$.geo.longitude", "double")
    both = (lat != 0) & (lng != 0)
    return F.struct(
        F.coalesce(text, F.nullif(squeeze(_at(v, "$.name")), F.lit(""))).alias("venue"), F.when(text.isNotNull(), SURE - 10).when(_at(v, "$.name").isNotNull(), SURE).alias("venue_confidence"), F.coalesce(F.nullif(squeeze(whole), F.lit("")), joined).alias("address"),
        parts[1].alias("city"), parts[2].alias("state"), parts[3].alias("zip"), F.when(both, lat).alias("lat"), F.when(both, lng).alias("lng"),
    )


def offers(v: Column) -> Column:
    """Struct of least, most, free, sold_out, currency and link over one offer or several; the last currency and link count."""
    every = _list(v)
    numbers = lambda *paths: F.flatten(F.transform(every, lambda o: F.array_compact(F.array(*(_at(o, p, "double") for p in paths)))))
    low, high = numbers("$.lowPrice", "$.price"), numbers("$.highPrice", "$.price")
    least, most = F.array_min(low), F.array_max(high)
    last = lambda path: F.try_element_at(F.filter(F.transform(every, lambda o: F.nullif(_at(o, path), F.lit(""))), lambda x: x.isNotNull()), F.lit(-1))
    sold = F.exists(every, lambda o: F.contains(F.coalesce(_at(o, "$.availability"), F.lit("")), F.lit("SoldOut")))
    return F.struct(least.alias("least"), F.when(most > 0, most).alias("most"), (least == 0).alias("free"), F.when(sold, True).alias("sold_out"), F.when(F.size(every) > 0, F.coalesce(last("$.priceCurrency"), F.lit("USD"))).alias("currency"), last("$.url").alias("link"))


def images(v: Column) -> Column:
    """URLs of a text, an object with url or contentUrl, or a list of such."""
    return F.filter(F.transform(_list(v), lambda i: F.coalesce(_text(i), _at(i, "$.url"), _at(i, "$.contentUrl"))), lambda u: u.isNotNull())


def performers(v: Column) -> Column:
    """Array of struct(name, type, url)."""
    return F.transform(_list(v), lambda p: F.struct(F.coalesce(_text(p), _at(p, "$.name")).alias("name"), _at(p, '$["@type"]').alias("type"), _at(p, "$.url").alias("url")))


def organizer(v: Column) -> Column:
    return F.when(v.isNotNull(), F.struct(F.coalesce(_text(v), _at(v, "$.name")).alias("name"), _at(v, "$.url").alias("url"), _at(v, "$.email").alias("email"), _at(v, "$.telephone").alias("phone")))


def event_fields(event: Column) -> Column:
    """Struct of title, title_confidence (less for a headline), start, end, description, location, offers, images, performers, organizer, status."""
    part = lambda p: _at(event, f"$.{p}", "variant")
    name, headline = F.nullif(_at(event, "$.name"), F.lit("")), F.nullif(_at(event, "$.headline"), F.lit(""))
    return F.struct(
        squeeze(F.coalesce(name, headline)).alias("title"), F.when(name.isNotNull(), SURE).when(headline.isNotNull(), SURE - 5).alias("title_confidence"), _at(event, "$.startDate").alias("start"), _at(event, "$.endDate").alias("end"),
        F.nullif(squeeze(_at(event, "$.description")), F.lit("")).alias("description"), location(part("location")).alias("location"), offers(part("offers")).alias("offers"), images(part("image")).alias("images"), performers(part("performer")).alias("performers"),
        organizer(part("organizer")).alias("organizer"), _at(event, "$.eventStatus").alias("status"),
    )
