"""Events validated and put right: every fix leaves a confidence, and the least of them must reach a minimum.

Where a rule as it stands could only fail (a date's or time's own methods do
not exist), the evident meaning is built: dates become ISO timestamps and times
HH:mm:ss where they can be read.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions import fixes
from marquee.functions.addresses import completed_address
from marquee.functions.common import contains_any, let, round_half_up, squeeze, text
from marquee.functions.moments import flexible_time
from marquee.functions.validators import valid_url
from marquee.operators.events import CATEGORIES
from marquee.session import short_methods

LEAST_CONFIDENCE = 70
_FIX = "struct<field:string,old:string,new:string,reason:string,confidence:int>"
IMAGE_ENDS = [".jpg", ".jpeg", ".png", ".gif", ".webp", ".svg"]


def _fix(field: str, old: Column, new: Column, reason: Column | str, confidence: Column | int) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str | int) else x
    return F.struct(F.lit(field).alias("field"), old.cast("string").alias("old"), new.cast("string").alias("new"), lit(reason).alias("reason"), lit(confidence).cast("int").alias("confidence"))


def _fixes(*pairs: tuple[Column, Column]) -> Column:
    """The fixes whose conditions hold, as generated code: a filter over an array would evaluate all of them one expression at a time."""
    return F.concat(*(F.when(F.coalesce(c, F.lit(False)), F.array(f)).otherwise(F.array()).cast(f"array<{_FIX}>") for c, f in pairs))


def _missing(x: Column) -> Column:
    return text(x) == ""


def fixed_categories(given: Column, words: Column, mapping: Mapping[str, str]) -> Column:
    """Struct of value, fixes and wrong: valid names kept, others mapped, the first two, without repeats; without any, inferred from ``words``, else Music.

    What was mapped, kept and inferred is each computed once (``let``): a struct's
    parts would each repeat all of it, with a walk over the keywords every time.
    """
    trimmed = F.transform(F.coalesce(given, F.array().cast("array<string>")), lambda c: F.trim(c))
    part = lambda old, new, confidence: F.struct(old.alias("old"), new.alias("new"), confidence.cast("int").alias("confidence"))
    valid = lambda c: F.coalesce(c.isin(CATEGORIES), F.lit(False))
    one = lambda c: F.when(valid(c), part(c, c, F.lit(None))).otherwise(let(fixes.map_category(c, mapping), lambda m: part(c, m["category"], m["confidence"])))

    def of(mapped: Column, names: Column, inferred: Column) -> Column:
        guess, sure = F.coalesce(inferred["category"], F.lit("Music")), F.coalesce(inferred["confidence"], F.lit(30)).cast("int")
        none = F.size(names) == 0
        two = F.slice(names, 1, 2)
        value = F.when(none, F.array(guess)).otherwise(F.array_distinct(two))
        joined = F.array_join(given, ",")
        by_map = F.transform(F.filter(mapped, lambda m: m["new"].isNotNull() & ~m["old"].isin(CATEGORIES)), lambda m: _fix("categories", m["old"], m["new"], "mapped", m["confidence"]))
        more = _fixes(
            (none, _fix("categories", joined, guess, F.when(inferred.isNull(), "default").otherwise("inferred"), sure)), (F.size(names) > 2, _fix("categories", joined, F.array_join(two, ","), "limited to 2", 80)),
            (F.size(F.array_distinct(two)) < F.size(two), _fix("categories", F.array_join(two, ","), F.array_join(F.array_distinct(two), ","), "repeats removed", 90)),
        )
        wrong = F.transform(F.filter(mapped, lambda m: m["new"].isNull()), lambda m: m["old"])

        def whole(by_map: Column, more: Column) -> Column:
            # Anything else that changed (white space at the ends) is one fix.
            changed = (F.size(by_map) == 0) & (F.size(more) == 0) & (F.array_join(value, "|") != F.array_join(given, "|"))
            last = _fixes((changed, _fix("categories", joined, F.array_join(value, ","), "cleaned", 85)))
            return F.struct(value.alias("value"), F.concat(by_map, more, last).alias("fixes"), wrong.alias("wrong"))

        return let(by_map, lambda b: let(more, lambda m: whole(b, m)))

    kept = lambda mapped: F.transform(F.filter(mapped, lambda m: m["new"].isNotNull()), lambda m: m["new"])
    inferred = lambda names: F.when(F.size(names) == 0, fixes.infer_category(words, mapping))
    return let(F.transform(trimmed, one), lambda mapped: let(kept(mapped), lambda names: let(inferred(names), lambda i: of(mapped, names, i))))


def validate(events: DataFrame, mapping: Mapping[str, str], as_of: Column, city: str = "Austin", state: str = "TX", least: int = LEAST_CONFIDENCE) -> DataFrame:
    """``events`` with title, description, categories, address, startDate, endDate, startTime, endTime, price, venue put right, and fixes, errors, warnings (arrays), confidence (0 to 100) and valid.

    Columns that ``events`` lacks count as missing. Confidence is the least of
    the fixes', 100 without any; below ``least`` the event is not valid. Each
    step is a projection of its own, so that no fix is computed twice.
    """
    short_methods(events.sparkSession)
    for name, kind in (("title", "string"), ("description", "string"), ("categories", "array<string>"), ("address", "string"), ("startDate", "string"), ("endDate", "string"), ("startTime", "string"), ("endTime", "string"), ("price", "string"), ("url", "string"), ("image", "string"), ("venue", "string")):
        if name not in events.columns:
            events = events.withColumn(name, F.lit(None).cast(kind))
    c = F.col
    title = fixes.fix_title(c("title"), c("venue"))
    out = events.withColumns({"_title": title, "_old": F.struct("title", "description", "address", "price", "venue", "startDate", "endDate", "startTime", "endTime")})
    spaced = lambda x: ~_missing(x) & (squeeze(x) != x)
    long = F.length(squeeze(c("_old.title"))) > 100
    own = _fixes(
        (_missing(c("_old.title")), _fix("title", c("_old.title"), c("_title.value"), "default", 50)), (spaced(c("_old.title")), _fix("title", c("_old.title"), squeeze(c("_old.title")), "white space", 95)),
        (~_missing(c("_old.title")) & long, _fix("title", c("_old.title"), c("_title.value"), "truncated", 80)),
    )
    out = out.withColumns({"title": c("_title.value"), "_fixes": own}).drop("_title")
    default = F.concat(F.lit("Join us at "), F.coalesce(F.nullif(c("venue"), F.lit("")), F.lit("this venue")), F.lit(" for "), c("title"), F.lit("!"))
    description = F.when(_missing(c("description")), default).otherwise(squeeze(c("description")))
    own = _fixes((_missing(c("_old.description")), _fix("description", c("_old.description"), c("description"), "default", 40)), (spaced(c("_old.description")), _fix("description", c("_old.description"), c("description"), "white space", 95)))
    out = out.withColumn("description", description).withColumn("_fixes", F.concat("_fixes", own))
    out = out.withColumn("_c", fixed_categories(c("categories"), F.concat_ws(" ", "title", "description", "venue"), mapping))
    out = out.withColumns({"categories": c("_c.value"), "_fixes": F.concat("_fixes", "_c.fixes"), "_wrong": c("_c.wrong")}).drop("_c")
    clean, tail = squeeze(c("_old.address")), f", {city}, {state}"
    no_comma = ~_missing(c("_old.address")) & ~F.contains(clean, F.lit(","))
    # Only an address without a comma is looked through for cities.
    out = out.withColumn("_a", F.when(no_comma, completed_address(c("address"), c("venue"), city, state)))
    address = F.when(_missing(c("address")), F.concat(F.coalesce(F.nullif(c("venue"), F.lit("")), F.lit("Venue")), F.lit(tail))).when(no_comma, F.coalesce(c("_a.value"), F.concat(clean, F.lit(tail)))).otherwise(clean)
    reason, sure = F.coalesce(c("_a.reason"), F.lit("Added default city and state")), F.coalesce(c("_a.confidence"), F.lit(40))
    own = _fixes((_missing(c("_old.address")), _fix("address", c("_old.address"), c("address"), "default", 30)), (no_comma, _fix("address", c("_old.address"), c("address"), reason, sure)))
    out = out.withColumn("address", address).withColumn("_fixes", F.concat("_fixes", own)).drop("_a")
    errors, warnings = [], []
    iso = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
    tomorrow = F.concat(F.date_add(as_of, 1).cast("string"), F.lit("T19:00:00.000Z"))
    read = lambda x: F.coalesce(F.try_to_timestamp(x), *(F.try_to_timestamp(x, F.lit(f)) for f in ("MM/dd/yyyy", "MM/dd/yyyy HH:mm", "MMMM d, yyyy", "MMM d, yyyy")))
    for name in ("startDate", "endDate"):
        out = out.withColumn("_at", read(c(name)))
        given = ~_missing(c(f"_old.{name}"))
        value = F.when(given & c("_at").isNotNull(), F.date_format("_at", iso)).when(given, c(name))
        if name == "startDate":
            value = F.when(~given, tomorrow).otherwise(value)
        default_fix = [(~given, _fix(name, c(f"_old.{name}"), tomorrow, "default", 30))] if name == "startDate" else []
        own = _fixes(*default_fix, (given & c("_at").isNotNull() & (c(name) != c(f"_old.{name}")), _fix(name, c(f"_old.{name}"), c(name), "ISO format", 90)))
        out = out.withColumn(name, value).withColumns({"_fixes": F.concat("_fixes", own), f"_bad_{name}": given & c("_at").isNull(), f"_past_{name}": given & (F.to_date("_at") < as_of)}).drop("_at")
        errors.append((c(f"_bad_{name}"), F.concat(F.lit("Invalid date format: "), c(f"_old.{name}"))))
        warnings.append((c(f"_past_{name}"), F.lit(f"{name} is in the past")))
    early = (c("endDate") < c("startDate")) & ~c("_bad_startDate") & ~c("_bad_endDate")
    out = out.withColumn("_early", F.coalesce(early, F.lit(False)))
    out = out.withColumn("_fixes", F.concat("_fixes", _fixes((c("_early"), _fix("endDate", c("endDate"), c("startDate"), "not before the start", 70))))).withColumn("endDate", F.when(c("_early"), c("startDate")).otherwise(c("endDate")))
    for name in ("startTime", "endTime"):
        fine = c(name).rlike(r"^([01]?[0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]$")
        out = out.withColumn("_t", F.when(_missing(c(name)) | fine, c(name)).otherwise(flexible_time(c(name))))
        own = _fixes((~_missing(c(name)) & ~fine & c("_t").isNotNull(), _fix(name, c(name), c("_t"), "HH:mm:ss format", 85)))
        out = out.withColumns({"_fixes": F.concat("_fixes", own), f"_bad_{name}": ~_missing(c(name)) & c("_t").isNull()}).withColumn(name, F.coalesce("_t", name)).drop("_t")
        errors.append((c(f"_bad_{name}"), F.concat(F.lit("Invalid time format: "), c(name))))
    out = out.withColumn("_p", fixes.fix_price(c("price")))
    number = F.regexp_extract(text(c("_old.price")), r"[\d.]+", 0).try_cast("double")
    own = _fixes(
        (c("_p.reason") == "number", _fix("price", c("_old.price"), number, "number", 80)), (c("_p.reason") == "free", _fix("price", c("_old.price"), F.lit("0"), "free", 95)), (c("_p.reason") == "none", _fix("price", c("_old.price"), F.lit(None), "none", 50)),
        (c("_p.value") != number, _fix("price", c("_old.price"), c("_p.value"), "rounded", 90)),
    )
    out = out.withColumns({"price": c("_p.value"), "_fixes": F.concat("_fixes", own)}).drop("_p")
    errors += [(~_missing(c("url")) & ~valid_url(c("url")), F.concat(F.lit("Invalid URL format: "), c("url"))), (~_missing(c("image")) & ~valid_url(c("image")), F.concat(F.lit("Invalid image URL format: "), c("image")))]
    warnings += [(valid_url(c("image")) & ~contains_any(F.lower("image"), IMAGE_ENDS), F.lit("URL may not be an image")), (F.size("_wrong") > 0, F.concat(F.lit("Filtered out invalid categories: "), F.array_join("_wrong", ", ")))]
    own = _fixes((_missing(c("_old.venue")), _fix("venue", c("_old.venue"), F.lit("Venue TBD"), "default", 30)), (spaced(c("_old.venue")), _fix("venue", c("_old.venue"), squeeze(c("_old.venue")), "white space", 95)))
    out = out.withColumns({"venue": F.when(_missing(c("venue")), "Venue TBD").otherwise(squeeze(c("venue"))), "fixes": F.concat("_fixes", own)})
    sure = F.coalesce(F.array_min(F.transform("fixes", lambda f: f["confidence"])), F.lit(100))
    out = out.withColumn("confidence", F.least(F.lit(100), sure))
    errors.append((c("confidence") < least, F.format_string(f"Confidence score %d%% below minimum {least}%%", "confidence")))
    said = lambda pairs: F.concat(*(F.when(F.coalesce(k, F.lit(False)) & v.isNotNull(), F.array(v)).otherwise(F.array().cast("array<string>")) for k, v in pairs))
    out = out.withColumns({"errors": said(errors), "warnings": said(warnings)})
    gone = [x for x in out.columns if x.startswith("_") and x not in events.columns]
    return out.withColumn("valid", F.size("errors") == 0).drop(*gone)


def batch_summary(validated: DataFrame) -> DataFrame:
    """Totals of ``validate``: rows, valid, invalid, fixes, errors, warnings and the rounded mean confidence (null without rows)."""
    return validated.agg(
        F.count("*").alias("total"), F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("invalid"), *(F.coalesce(F.sum(F.size(k)), F.lit(0)).alias(f"total_{k}") for k in ("fixes", "errors", "warnings")),
        round_half_up(F.avg("confidence")).alias("average_confidence"),
    )
