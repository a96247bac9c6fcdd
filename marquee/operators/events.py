"""Event collections: validation, routing, copying, repeats, venue statistics, image audits."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.functions.common import contains_any, messages, squeeze, text
from marquee.functions.validators import valid_url

#: Categories of events, and required fields.
CATEGORIES = ["Music", "Festivals", "Food Events", "Sports/Games", "Comedy Shows", "Art Shows", "Bars", "Nightclubs"]
REQUIRED = ["title", "address", "venue", "date", "startTime", "startDateTimestamp", "categories", "free", "soldOutStatus", "createdAt"]


def validate(events: DataFrame) -> DataFrame:
    """Adds errors (array of text, in the order of the checks) and valid. Fields that the table lacks are missing."""
    has = lambda f: f in events.columns
    checks = [(F.col(f).isNull() if has(f) else F.lit(True), f"Missing required field: {f}") for f in REQUIRED]
    if has("address"):
        checks.append(((F.col("address") != "") & ~F.contains("address", F.lit(",")), 'address must contain a comma (format: "Street, City")'))
    checks += [((F.col(f) != "") & ~F.col(f).rlike(r"^\d{2}:\d{2}:\d{2}$"), f"{f} must be in HH:mm:ss format") for f in ("startTime", "endTime") if has(f)]
    errors = messages(checks)
    if has("categories"):
        c = F.col("categories")
        errors = F.concat(errors, messages([(F.size(c) == 0, "at least one category is required"), (F.size(c) > 2, "maximum 2 categories allowed")]))
        wrong = F.filter(c, lambda x: ~x.isin(CATEGORIES))
        errors = F.concat(errors, F.coalesce(F.transform(wrong, lambda x: F.concat(F.lit("invalid category: "), x, F.lit(f". Valid categories: {', '.join(CATEGORIES)}"))), F.array().cast("array<string>")))
    return events.withColumn("errors", errors).withColumn("valid", F.size("errors") == 0)


def categories_problem(c: Column) -> Column:
    """First thing wrong with a list of categories, or null."""
    return F.when(c.isNull() | (F.size(c) == 0), "at least one category is required").when(F.size(c) > 2, "maximum 2 categories allowed").when(~F.forall(c, lambda x: x.isin(CATEGORIES)), "invalid category")


def rename_category(c: Column, old: str = "Art Events", new: str = "Art Shows") -> Column:
    return F.transform(c, lambda x: F.when(x == old, new).otherwise(x))


def existing(candidates: DataFrame, stored: DataFrame) -> DataFrame:
    """Candidates with found_in: the first collection (by ``source_rank`` of ``stored``) with an event of the same title, date and venue, or null."""
    first = stored.groupBy("title", "date", "venue").agg(F.min(F.struct("source_rank", "collection")).alias("_first"))
    first = first.select("title", "date", "venue", F.col("_first.collection").alias("found_in"))
    return candidates.join(first, ["title", "date", "venue"], "left")


def copy_plan(source: DataFrame, target: DataFrame, wanted: Column) -> DataFrame:
    """Rows of ``source`` with status: skipped (not ``wanted``), existing (id in ``target``) or copied. The target's ids are probed in one join."""
    ids = target.select("event_id").distinct().withColumn("_there", F.lit(True))
    status = F.when(~wanted, "skipped").when(F.col("_there"), "existing").otherwise("copied")
    return source.join(ids, "event_id", "left").withColumn("status", status).drop("_there")


def submit(events: DataFrame, stored: DataFrame, route: Column) -> DataFrame:
    """Events that are valid and not stored yet, with the collection they go to (``route``)."""
    checked = validate(events).filter("valid").drop("valid", "errors")
    return checked.join(stored.select("title", "date", "venue").distinct(), ["title", "date", "venue"], "left_anti").withColumn("collection", route)


def add_months_overflowing(day: Column, n: Column) -> Column:
    """The same day n months later; a day that the month lacks runs over into the next (Jan 31 + 1 is Mar 3)."""
    first = F.trunc(F.add_months(F.trunc(day, "MM"), n), "MM")
    return F.date_add(first, F.day(day) - 1)


def repeats(events: DataFrame, day: Column, pattern: Column, count: Column, custom_days: Column) -> DataFrame:
    """One row per event and repetition 1..count: i and repeat_date. Patterns weekly, biweekly, monthly, custom (without days: the base date)."""
    i = F.col("i")
    step = F.when(pattern == "weekly", i * 7).when(pattern == "biweekly", i * 14).when(pattern == "custom", i * F.coalesce(custom_days, F.lit(0))).otherwise(0)
    out = events.filter(count > 0).withColumn("i", F.explode(F.sequence(F.lit(1), count)))
    return out.withColumn("repeat_date", F.when(pattern == "monthly", add_months_overflowing(day, i)).otherwise(F.date_add(day, step.cast("int"))))


def venue_stats(events: DataFrame, most: int = 30) -> DataFrame:
    """The ``most`` venues with the most events: venue, events and the last address in order of ``ord``. Ties go by name."""
    named = events.withColumn("venue", F.trim("venue")).filter("venue <> ''")
    last = F.max(F.when(F.trim("address") != "", F.struct("ord", F.trim("address").alias("a"))))
    return named.groupBy("venue").agg(F.count("*").alias("events"), last.alias("_last")).select("venue", "events", F.col("_last.a").alias("address")).orderBy(F.col("events").desc(), "venue").limit(most)


#: Names of a full image and of a thumbnail.
IMAGE_FILES, THUMBNAIL_FILES = ["event_image.png", "event_image.jpg"], ["event_thumbnail.png", "event_thumbnail.jpg"]


def event_files(listing: DataFrame) -> DataFrame:
    """Per collection and event, from object paths collection/event/file (and size, ord where there): image, thumb, and the sizes seen last. Paths of fewer parts are dropped; the third part is the file."""
    parts = F.split("path", "/")
    column = lambda c: F.col(c) if c in listing.columns else F.lit(None).cast("long")
    files = listing.filter(F.size(parts) >= 3).select(parts[0].alias("collection"), parts[1].alias("event_id"), parts[2].alias("file"), column("size").alias("size"), column("ord").alias("ord"))
    image, thumb = F.col("file").isin(IMAGE_FILES), F.col("file").isin(THUMBNAIL_FILES)
    last = lambda c: F.max_by(F.when(c, F.col("size")), F.when(c, F.col("ord")))
    return files.groupBy("collection", "event_id").agg(F.bool_or(image).alias("image"), F.bool_or(thumb).alias("thumb"), last(image).alias("image_size"), last(thumb).alias("thumbnail_size"), F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"))


def image_audit(listing: DataFrame) -> DataFrame:
    """Per collection: events, with image and thumbnail, either alone, neither, and batches of 500 of those with a thumbnail alone."""
    count = F.count_if
    out = event_files(listing).groupBy("collection").agg(
        F.count("*").alias("events"), count(F.col("image") & F.col("thumb")).alias("both"), count(F.col("image") & ~F.col("thumb")).alias("image_only"), count(~F.col("image") & F.col("thumb")).alias("thumbnail_only"), count(~F.col("image") & ~F.col("thumb")).alias("neither")
    )
    return out.withColumn("batches", F.ceil(F.col("thumbnail_only") / 500))


#: Parts of a collection in the search for its first events.
PARTS = 256


def full_scan(listing: DataFrame, examples: int = 5) -> DataFrame:
    """Per collection: events, with images, with thumbnails, needing thumbnails, their mean image size, and the first ``examples`` of them by ``ord``."""
    need = F.col("image") & ~F.col("thumb")
    # The first of each of many parts of a collection, then the first of those: a collection's events never meet in one task.
    part = Window.partitionBy("collection", F.pmod(F.xxhash64("event_id"), F.lit(PARTS))).orderBy("first_ord", "event_id")
    rank = Window.partitionBy("collection").orderBy("first_ord", "event_id")
    each = event_files(listing)
    first = each.filter(need).select("collection", "event_id", "first_ord", F.row_number().over(part).alias("_p")).filter(F.col("_p") <= examples)
    first = first.withColumn("_r", F.row_number().over(rank)).filter(F.col("_r") <= examples)
    named = first.groupBy("collection").agg(F.array_sort(F.collect_list(F.struct("_r", "event_id"))).alias("_shown"))
    totals = each.groupBy("collection").agg(F.count("*").alias("events"), F.count_if("image").alias("with_images"), F.count_if("thumb").alias("with_thumbnails"), F.count_if(need).alias("needing_thumbnails"), F.avg(F.when(need, F.col("image_size"))).alias("mean_image_size"))
    shown = F.array_join(F.transform("_shown", lambda x: x["event_id"]), ",")
    return totals.join(named, "collection", "left").withColumn("examples", F.coalesce(shown, F.lit(""))).drop("_shown")


def needing_thumbnails(listing: DataFrame) -> DataFrame:
    return event_files(listing).filter("image and not thumb").select("collection", "event_id")


def needing_images(listing: DataFrame, most: int | None = None) -> DataFrame:
    """Events with a thumbnail alone; the ``most`` seen last, where it is given."""
    rows = event_files(listing).filter("thumb and not image").select("collection", "event_id", "last_ord")
    return rows if most is None else rows.orderBy(F.col("last_ord").desc(), "event_id").limit(most)


def first_files(listing: DataFrame, most: int = 50) -> DataFrame:
    """Events among the first ``most`` objects of a listing (in order of ``ord``) with their files."""
    parts = F.split("path", "/")
    rows = listing.orderBy("ord").limit(most).filter(F.size(parts) >= 3)
    return rows.groupBy(parts[1].alias("event_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", parts[2].alias("f")))), lambda x: x["f"]), ",").alias("files"))


def venue_regions(stats: DataFrame) -> DataFrame:
    """``venue_stats`` with in_austin, in_bay_area (a venue may be in both) and elsewhere, by its address."""
    a = F.lower(F.coalesce("address", F.lit("Address not found")))
    austin, bay = contains_any(a, ["austin", ", tx"]), contains_any(a, ["san francisco", "oakland", "berkeley", ", ca"])
    return stats.withColumns({"in_austin": austin, "in_bay_area": bay, "elsewhere": ~austin & ~bay})


def repeat_copies(repeated: DataFrame) -> DataFrame:
    """Rows of ``repeats`` as events of their own: date and start moved to repeat_date, the end as long after as before, original_id, is_repeat; event_id goes."""
    shift = F.datediff("repeat_date", F.to_date("startDateTimestamp"))
    moved = lambda c: F.col(c) + F.make_dt_interval(shift)
    out = repeated.withColumns({"original_id": F.coalesce(F.col("event_id").cast("string"), F.lit("unknown")), "is_repeat": F.lit(True), "date": F.col("repeat_date").cast("string")})
    if "endDateTimestamp" in repeated.columns:
        out = out.withColumn("endDateTimestamp", moved("endDateTimestamp"))
    return out.withColumn("startDateTimestamp", moved("startDateTimestamp")).drop("event_id", "repeat_date")


def specific_dates(x: Column) -> Column:
    """Dates of a comma list; null where one of them is none."""
    days = F.transform(F.split(x, ","), lambda d: F.try_to_date(F.trim(d), "yyyy-MM-dd"))
    return F.when(~F.exists(days, lambda d: d.isNull()), days)


def may_repeat(user: Column, business_user: Column, created_by: Column) -> Column:
    return F.coalesce((business_user == user) | (created_by == user), F.lit(False))


def found_in(ids: DataFrame, stored: DataFrame) -> DataFrame:
    """``ids`` (event_id) with found_in: the first collection by ``source_rank`` of ``stored`` that has the id, or null."""
    first = stored.groupBy("event_id").agg(F.min(F.struct("source_rank", "collection"))["collection"].alias("found_in"))
    return ids.join(first, "event_id", "left")


def refreshed(events: DataFrame, as_of: str) -> DataFrame:
    """Events dated from a day before ``as_of`` on, with refreshed_at."""
    since = F.date_add(F.lit(as_of).cast("date"), -1).cast("string")
    return events.filter(F.col("date") >= since).withColumn("refreshed_at", F.lit(as_of))


def backfilled(events: DataFrame) -> DataFrame:
    """startDateTimestamp from the date where it is missing; free only where it says true or 1."""
    return events.withColumns({"startDateTimestamp": F.coalesce("startDateTimestamp", F.try_to_timestamp("date")), "free": F.coalesce(F.lower(F.col("free").cast("string")).isin("true", "1"), F.lit(False))})


def _given(events: DataFrame, name: str, default: str) -> Column:
    return F.coalesce(F.nullif(F.col(name).cast("string"), F.lit("")), F.lit(default)) if name in events.columns else F.lit(default)


def legacy(events: DataFrame) -> DataFrame:
    """The older form: rawLocation for the address, defaults for what is missing, the category Community where there is none."""
    flag = lambda f: F.coalesce(F.col(f).cast("boolean"), F.lit(False)) if f in events.columns else F.lit(False)
    column = lambda f, t="string": F.col(f) if f in events.columns else F.lit(None).cast(t)
    images = F.coalesce(column("imageUrls", "array<string>"), F.when(F.coalesce(column("imageUrl"), F.lit("")) != "", F.array(column("imageUrl"))), F.array().cast("array<string>"))
    return events.select(
        *(c for c in ("event_id",) if c in events.columns), _given(events, "title", "Event Title TBD").alias("title"), _given(events, "description", "Event details to be announced.").alias("description"), _given(events, "venue", "Venue TBD").alias("venue"),
        _given(events, "address", "Address TBD").alias("rawLocation"), column("date").alias("date"), _given(events, "startTime", "19:00:00").alias("startTime"), column("imageUrl").alias("imageUrl"), images.alias("imageUrls"), flag("free").alias("free"), flag("soldOut").alias("soldOut"),
        F.coalesce(column("categories", "array<string>"), F.array(F.lit("Community"))).alias("categories"),
    )


def form(events: DataFrame) -> DataFrame:
    """What a form shows: empty texts and lists for what is missing, 19:00:00 for the start, flags as booleans, a ticket link from either name."""
    truthy = lambda *names: functools.reduce(lambda a, b: a | b, [F.coalesce(F.col(n).cast("boolean"), F.lit(False)) for n in names if n in events.columns], F.lit(False))
    lists = lambda n: F.coalesce(F.col(n), F.array().cast("array<string>")) if n in events.columns else F.array().cast("array<string>")
    links = [F.nullif(F.col(n), F.lit("")) for n in ("ticketsLink", "ticketUrl") if n in events.columns]
    return events.select(
        *(c for c in ("event_id",) if c in events.columns), *(_given(events, n, "").alias(n) for n in ("title", "venue", "address", "description", "date", "endTime", "imageUrl")), _given(events, "startTime", "19:00:00").alias("startTime"), lists("imageUrls").alias("imageUrls"),
        lists("categories").alias("categories"), truthy("free").alias("free"), truthy("soldOut", "soldOutStatus").alias("soldOut"), F.coalesce(*links, F.lit("")).alias("ticketsLink"),
    )


def compatibility(events: DataFrame) -> DataFrame:
    """Adds errors and warnings on the forms of times, dates and image URLs; the evident forms are tested (two digits each)."""
    c = F.col
    given = lambda f: F.coalesce(c(f), F.lit("")) != ""
    errors = messages([(given(f) & ~c(f).rlike(r"^\d{2}:\d{2}:\d{2}$"), f"{f} must be in HH:MM:SS format") for f in ("startTime", "endTime")] + [(given("date") & ~c("date").rlike(r"^\d{4}-\d{2}-\d{2}$"), "date must be in YYYY-MM-DD format"), (F.contains("startTime", F.lit("Z")), "startTime contains UTC indicator (Z)")])
    warnings = messages([(given("imageUrl") & ~valid_url(c("imageUrl")), "imageUrl may not be a valid URL"), (F.contains("date", F.lit("T")), "date contains time component")])
    return events.withColumns({"errors": errors, "warnings": warnings})


def canonical(events: DataFrame, as_of: str) -> DataFrame:
    """The stored form of an event: defaults for what is missing, city from the address, flags as booleans."""
    get = lambda f: F.col(f).cast("string") if f in events.columns else F.lit(None).cast("string")
    truthy = lambda f: F.coalesce(F.lower(get(f)).isin("true", "1"), F.lit(False))
    default = lambda f, d: F.coalesce(F.nullif(get(f), F.lit("")), F.lit(d))
    parts = F.split(text(get("address")), ",")
    return events.select(
        *(squeeze(get(f)).alias(f) for f in ("title", "description", "venue")), text(get("address")).alias("address"), F.coalesce(F.nullif(get("city"), F.lit("")), F.trim(F.element_at(parts, -1))).alias("city"),
        default("date", as_of).alias("date"), default("startTime", "19:00:00").alias("startTime"), F.nullif(get("endTime"), F.lit("")).alias("endTime"), truthy("free").alias("free"), truthy("soldOutStatus").alias("soldOutStatus"),
    )
