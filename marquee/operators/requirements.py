"""What an extracted event must have: checks, defaults and the confidence of what a selector found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions.categories import broad_categories, valid_broad
from marquee.functions.common import messages, squeeze, text
from marquee.functions.places import ensure_comma

REQUIRED = ["title", "date", "address"]
LEAST_CONFIDENCE = 60
#: What stands for a missing field.
DEFAULTS = {"title": "Event Title TBD", "description": "Event details to be announced.", "venue": "Venue TBD", "address": "Address TBD"}


def selector_confidence(selector: Column, field: str, base: Column) -> Column:
    """10 to 100: more for selectors that name the field or are its element, less for the most general ones."""
    plus = lambda c, n: F.when(c, n).otherwise(0)
    has = lambda w: F.contains(selector, F.lit(w))
    named = has(f'[class*="{field}"]') | has(f'[data-testid*="{field}"]')
    meant = has("time") if field == "date" else has("address") if field == "address" else F.lit(False)
    return F.greatest(F.lit(10), F.least(F.lit(100), base + plus(named, 5) + plus(meant, 10) - plus(selector.isin("img", "h1", "p"), 10)))


def low_confidence(confidence: dict[str, Column], least: int = LEAST_CONFIDENCE) -> Column:
    """One message for each required field whose confidence is below ``least``; a missing one counts as 0."""
    sure = {f: F.coalesce(confidence[f], F.lit(0)) for f in REQUIRED}
    return F.array_compact(F.array(*(F.when(c < least, F.format_string(f"{f} confidence too low: %s%%", c.cast("string"))) for f, c in sure.items())))


def check(events: DataFrame) -> DataFrame:
    """Adds errors (required fields that are missing) and warnings (no comma in the address, no categories)."""
    errors = messages([(text(F.col(f)) == "", f"Missing required field: {f}") for f in REQUIRED])
    warnings = messages([((text(F.col("address")) != "") & ~F.contains("address", F.lit(",")), "Address should contain a comma for proper formatting"), (F.coalesce(F.size("categories"), F.lit(0)) <= 0, "No categories assigned - will use intelligent defaults")])
    return events.withColumns({"errors": errors, "warnings": warnings})


def enforce(events: DataFrame) -> DataFrame:
    """Fields as they must be: a comma in the address, valid categories (inferred where there are none), texts for what is missing, flags that are false by default."""
    c = F.col
    words = F.concat_ws(" ", "title", "description", "venue")
    found = F.when(F.coalesce(F.size("categories"), F.lit(0)) <= 0, broad_categories(words)).otherwise(valid_broad(c("categories")))
    out = events.withColumns({"categories": found, "address": F.when(text(c("address")) != "", ensure_comma(c("address")))})
    out = out.withColumns({f: F.coalesce(F.nullif(c(f), F.lit("")), F.lit(d)) for f, d in DEFAULTS.items()})
    return out.withColumns({f: F.coalesce(c(f), F.lit(False)) if f in events.columns else F.lit(False) for f in ("free", "soldOut", "hidden")})


def defaults(events: DataFrame, as_of: Column) -> DataFrame:
    """What can be guessed, with its confidence (columns date_confidence and so on): the coming Saturday at 19:00 (30), a title by the site (25), a venue by the address (20 less), a place after an address without a comma (10 less)."""
    c = F.col
    site = F.get(F.split(F.regexp_replace(F.regexp_extract(text(c("url")), r"^[A-Za-z]+://([^/?#:]*)", 1), "www.", ""), r"\."), F.lit(0))
    no = lambda f: text(c(f)) == ""
    less = lambda x, n: F.greatest(F.lit(0), F.coalesce(x, F.lit(0)) - n)
    by_address = no("venue") & ~no("address")
    bare = ~no("address") & ~F.contains("address", F.lit(","))
    return events.withColumns({
        "date": F.when(no("date"), F.concat(F.next_day(as_of, "SAT").cast("string"), F.lit("T19:00:00"))).otherwise(c("date")), "date_confidence": F.when(no("date"), 30).otherwise(c("date_confidence")),
        "title": F.when(no("title"), F.concat(F.lit("Event at "), site)).otherwise(c("title")), "title_confidence": F.when(no("title"), 25).otherwise(c("title_confidence")),
        "venue": F.when(by_address, F.trim(F.substring_index("address", ",", 1))).otherwise(c("venue")), "venue_confidence": F.when(by_address, less(c("address_confidence"), 20)).otherwise(c("venue_confidence")),
        "address": F.when(bare, F.concat("address", F.lit(", Location TBD"))).otherwise(c("address")), "address_confidence": F.when(bare, less(c("address_confidence"), 10)).otherwise(c("address_confidence")),
    })


def tidy(events: DataFrame) -> DataFrame:
    """Text columns with single spaces; a date without a time takes the column time, which goes; the first image is imageUrl too."""
    out = events.withColumns({f: F.when(F.col(f).isNotNull(), squeeze(F.col(f))) for f, t in events.dtypes if t == "string"})
    if {"date", "time"} <= set(events.columns):
        both = F.try_to_timestamp(F.concat_ws(" ", "date", "time"))
        ok = (text(F.col("date")) != "") & (text(F.col("time")) != "") & ~F.contains("date", F.lit("T")) & both.isNotNull()
        joined = F.date_format(both, "yyyy-MM-dd'T'HH:mm:ss")
        out = out.withColumns({"date": F.when(ok, joined).otherwise(F.col("date")), "time": F.when(~F.coalesce(ok, F.lit(False)), F.col("time"))})
    if "image" in events.columns:
        out = out.withColumns({"imageUrl": F.col("image"), "imageUrls": F.when(F.col("image").isNotNull(), F.array("image"))}).drop("image")
    return out
