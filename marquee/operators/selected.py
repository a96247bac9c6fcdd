"""Fields of pages by selectors: first valid values, gaps filled, linked scopes and lists of records.

All take elements (see functions.markup), best written once by the caller
(``session.materialise``), as texts and elements are read from it separately.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.functions import markup
from marquee.functions.common import squeeze
from marquee.functions.selectors import matched
from marquee.functions.validators import valid_image_url
from marquee.operators.requirements import selector_confidence

#: Selectors of each field in order, with their confidence. (The last description's isn't stated; it has its neighbour's.)
SEMANTIC: dict[str, list[tuple[str, int]]] = {
    "title": [
        ('h1[class*="event"]', 85), ('h1[class*="title"]', 80), ('[class*="event-title"]', 90), ('[class*="event-name"]', 90), ('[data-testid*="title"]', 85), ('[data-testid*="event-title"]', 90), ("h1", 70), ('h2[class*="event"]', 75),
        (".title h1, .title h2", 75), ("header h1, header h2", 70),
    ],
    "description": [
        ('[class*="event-description"]', 90), ('[class*="description"]', 80), ('[data-testid*="description"]', 85), (".about", 75), (".summary", 65), ('meta[name="description"]', 80), ('[class*="event-details"]', 80), ('[class*="event-info"]', 80),
    ],
    "venue": [
        ('[class*="venue-name"]', 90), ('[class*="venue"]', 85), ('[class*="location-name"]', 88), ('[data-testid*="venue"]', 90), ('[class*="event-location"] h1', 85), ('[class*="event-location"] h2', 80), ('[class*="event-location"] h3', 75),
    ],
    "address": [
        ('[class*="venue-address"]', 90), ('[class*="address"]', 85), ('[class*="location-address"]', 88), ('[data-testid*="address"]', 90), ('[class*="event-location"] p', 75), ("address", 80),
    ],
    "date": [("time[datetime]", 95), ('[class*="event-date"]', 90), ('[class*="date"]', 80), ('[data-testid*="date"]', 90), ('[class*="event-time"]', 85), ('[class*="when"]', 85)],
    "time": [('[class*="event-time"]', 90), ('[class*="start-time"]', 95), ('[class*="time"]', 75), ('[data-testid*="time"]', 90), ("time", 80)],
    "price": [('[class*="price"]', 90), ('[class*="cost"]', 85), ('[class*="ticket-price"]', 95), ('[data-testid*="price"]', 90), ('[class*="admission"]', 80), ('[class*="fee"]', 80)],
    "image": [
        ('[class*="event-image"] img', 95), ('[class*="hero-image"] img', 90), ('[class*="featured-image"] img', 90), ('[class*="main-image"] img', 90), ('[data-testid*="image"] img', 85), ("main img", 70), ("article img", 75), ("header img", 75),
    ],
}
#: Lengths that a field may have.
LENGTHS = {"title": (3, 200), "description": (10, 2000), "venue": (3, 300), "address": (3, 300)}
#: What a field must look like.
SHAPES = {
    "price": r"(?i)[$€£¥₹]|\bfree\b|\b[0-9]+\b", "image": r"(?i)\.(jpg|jpeg|png|webp|gif)(\?|$)|(?-i:image|img)", "date": r"(?i)[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}|[0-9]{1,2}-[0-9]{1,2}|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec",
    "time": r"(?i)[0-9]{1,2}:[0-9]{2}|[0-9]{1,2}\s*(am|pm)",
}
#: Attributes that say a field's value before its text does (dates, times) or instead of it (images).
ATTRIBUTES = {"image": ["src", "data-src", "data-lazy-src"], "date": ["datetime"], "time": ["datetime"]}


def _trim(x: Column) -> Column:
    return F.regexp_replace(x, r"^[\s\x{00A0}]+|[\s\x{00A0}]+$", "")


def valid(field: str, value: Column) -> Column:
    """Whether a field may have a value: never a blank one, and one of the field's length and shape."""
    own = _trim(value)
    ok = own != ""
    if field in LENGTHS:
        ok = ok & F.length(own).between(*LENGTHS[field])
    return ok & own.rlike(SHAPES[field]) if field in SHAPES else ok


def candidates(rows: DataFrame, fields: dict[str, list[tuple[str, int]]] = SEMANTIC) -> DataFrame:
    """page_id, field, rank (of the selector), pre, value and confidence for every element that a selector of a field finds."""
    flat = [(field, rank, css, base) for field, own in fields.items() for rank, (css, base) in enumerate(own)]
    found = matched(rows, [css for _, _, css, _ in flat])
    facts = F.array(*(F.struct(F.lit(f).alias("field"), F.lit(r).alias("rank"), selector_confidence(F.lit(css), f, F.lit(base)).alias("confidence")) for f, r, css, base in flat))
    each = found.select("page_id", "pre", "attrs", "start", "stop", F.explode("hits").alias("hit")).withColumn("fact", F.element_at(facts, F.col("hit") + 1))
    each = markup.texts(rows, each.select("page_id", "pre", "attrs", "start", "stop", "fact.*"))
    value = F
    for field, names in ATTRIBUTES.items():
        stated = [F.nullif(F.col("attrs")[n], F.lit("")) for n in names]
        value = value.when(F.col("field") == field, F.coalesce(*stated, *([] if field == "image" else [F.col("said")])))
    return each.select("page_id", "field", "rank", "pre", "confidence", value.otherwise(F.col("said")).alias("value"))


def selected_fields(rows: DataFrame, fields: dict[str, list[tuple[str, int]]] = SEMANTIC) -> DataFrame:
    """page_id, field, value and confidence: of each field the first valid value, by order of selectors and then by place in the page."""
    ok = F
    for field in fields:
        ok = ok.when(F.col("field") == field, valid(field, F.col("value")))
    found = candidates(rows, fields).filter(ok)
    best = found.groupBy("page_id", "field").agg(F.min_by(F.struct("value", "confidence"), F.struct("rank", "pre")).alias("b"))
    return best.select("page_id", "field", squeeze(F.col("b.value")).alias("value"), "b.confidence")


#: RDFa properties with the field they give; later ones have the last word.
PROPERTIES = [("dc:title", "title"), ("schema:name", "title"), ("schema:description", "description"), ("schema:startDate", "date"), ("schema:location", "venue"), ("schema:image", "imageUrl")]
RDFA_CONFIDENCE = 70


def rdfa(rows: DataFrame) -> DataFrame:
    """page_id, scope, type, field and value of RDFa properties by the nearest element around them that has a type (scope null: none has).

    Of each property the first one of a scope that says something counts, by its
    content or else its text; of two properties for a field the later of
    PROPERTIES.
    """
    scoped = markup.innermost(rows.drop("text"), F.col("attrs")["typeof"].isNotNull(), "scope")
    own = scoped.filter(F.col("attrs")["property"].isin([p for p, _ in PROPERTIES]))
    said = markup.texts(rows, own)
    value = squeeze(F.coalesce(F.nullif(F.col("attrs")["content"], F.lit("")), F.col("said")))
    facts = F.create_map(*(F.lit(x) for i, (p, f) in enumerate(PROPERTIES) for x in (p, f"{i}:{f}")))
    each = said.select("page_id", "scope", "pre", F.split(facts[F.col("attrs")["property"]], ":").alias("fact"), value.alias("value")).filter("value <> ''")
    best = each.groupBy("page_id", "scope", F.col("fact")[1].alias("field")).agg(F.min_by("value", F.struct((-F.col("fact")[0].cast("int")).alias("late"), "pre")).alias("value"))
    types = scoped.filter(F.col("attrs")["typeof"].isNotNull()).select("page_id", F.col("pre").alias("scope"), F.col("attrs")["typeof"].alias("type"))
    return best.join(types, ["page_id", "scope"], "left").select("page_id", "scope", "type", "field", "value")


def rdfa_fields(found: DataFrame) -> DataFrame:
    """page_id, field, value and confidence of a page's RDFa (see rdfa), whichever its scopes: the first one's value."""
    best = found.groupBy("page_id", "field").agg(F.min_by("value", F.coalesce("scope", F.lit(-1))).alias("value"))
    return best.withColumn("confidence", F.lit(RDFA_CONFIDENCE))


#: Itemprops with the field they give.
ITEMPROPS = {"name": "title", "description": "description", "startDate": "date", "endDate": "endDate", "location": "venue", "image": "imageUrl", "offers": "price"}
MICRODATA_CONFIDENCE = 75


def microdata(rows: DataFrame) -> DataFrame:
    """page_id, field, value and confidence of the itemprops of events: in each event the first of a kind, and of several events the last that has one.

    Dates are told by datetime before text, images by src or content alone, a
    place by the first name inside it. An itemprop belongs to the nearest event
    around it.
    """
    event = F.coalesce(F.contains(F.col("attrs")["itemtype"], F.lit("Event")), F.lit(False))
    scoped = markup.innermost(rows.drop("text"), event, "scope").filter("scope is not null and pre > scope")
    prop = F.col("attrs")["itemprop"]
    own = scoped.filter(prop.isin(*ITEMPROPS))
    said = markup.texts(rows, own).withColumn("prop", prop)
    # Names inside a place: the nearest place around each.
    places = markup.innermost(scoped.select("page_id", "pre", "last", "start", "stop", "attrs"), F.coalesce(prop == "location", F.lit(False)), "place")
    names = markup.texts(rows, places.filter((prop == "name") & (F.col("place") < F.col("pre")))).groupBy("page_id", F.col("place").alias("pre")).agg(F.min_by("said", "pre").alias("name"))
    a = lambda n: F.nullif(F.col("attrs")[n], F.lit(""))
    value = F.when(F.col("prop").isin("startDate", "endDate"), F.coalesce(a("datetime"), F.col("said"))).when(F.col("prop") == "image", F.coalesce(a("src"), a("content"))).when(F.col("prop") == "location", F.coalesce(F.nullif("name", F.lit("")), F.col("said"))).otherwise(F.col("said"))
    each = said.join(names, ["page_id", "pre"], "left").select("page_id", "scope", "pre", "prop", squeeze(value).alias("value"))
    first = each.groupBy("page_id", "scope", "prop").agg(F.min_by("value", "pre").alias("value")).filter("value <> ''")
    last = first.groupBy("page_id", "prop").agg(F.max_by("value", "scope").alias("value"))
    fields = F.create_map(*(F.lit(x) for pair in ITEMPROPS.items() for x in pair))
    return last.select("page_id", fields[F.col("prop")].alias("field"), "value", F.lit(MICRODATA_CONFIDENCE).alias("confidence"))


#: Selectors that fill a gap, in order.
FILLS = {
    "title": ["h1", ".event-title"],
    "date": [".event-details-date p:first-child", "time[datetime]", ".date-time", ".event-date"],
    "venue": [".event-details-location p:first-child", ".location-info__address-text p:first-child", ".venue-name"],
    "address": [".event-details-location p:last-child", ".location-info__address-text p:last-child", ".venue-address"],
    "description": [".structured-content-text", ".event-description", ".description"],
    "price": [".ticket-classes ul li", ".event-pricing", ".price-display"],
}
UNTITLED, MOST_DESCRIPTION = "Untitled Event", 500


def first_said(rows: DataFrame, fields: dict[str, list[str]]) -> DataFrame:
    """page_id, field and value: the trimmed text of the first element of each selector, and of those that say something the first selector's.

    Only the first element of a selector is asked; if it is blank the next selector is.
    """
    flat = [(f, r, css) for f, own in fields.items() for r, css in enumerate(own)]
    found = matched(rows, [css for _, _, css in flat]).select("page_id", "pre", "attrs", "start", "stop", F.explode("hits").alias("hit"))
    first = found.groupBy("page_id", "hit").agg(F.min_by(F.struct("pre", "attrs", "start", "stop"), "pre").alias("e")).select("page_id", "hit", "e.*")
    said = markup.texts(rows, first)
    dated = [i for i, (_, _, css) in enumerate(flat) if "[datetime]" in css]
    value = _trim(F.col("said"))
    if dated:
        value = F.when(F.col("hit").isin(dated) & (value == ""), _trim(F.coalesce(F.col("attrs")["datetime"], F.lit("")))).otherwise(value)
    names = F.array(*(F.lit(f) for f, _, _ in flat))
    each = said.select("page_id", "hit", F.element_at(names, F.col("hit") + 1).alias("field"), value.alias("value")).filter("value <> ''")
    return each.groupBy("page_id", "field").agg(F.min_by("value", "hit").alias("value"))


def filled(events: DataFrame, rows: DataFrame) -> DataFrame:
    """``events`` (page_id, title, date, venue, address, description, free) with null or blank fields taken from the page's selectors; what is there stays.

    Without any title a page is an untitled event; descriptions are cut to 500
    characters; free says whether the price's text has "free", "$0" or "0.00"
    ("$10.00" too), null if no price is named.
    """
    wide = first_said(rows, FILLS).groupBy("page_id").pivot("field", list(FILLS)).agg(F.first("value"))
    wide = wide.select("page_id", *(F.col(f).alias(f"_{f}") for f in FILLS))
    own = events.join(wide, "page_id", "left")
    gap = lambda f, other: F.coalesce(F.nullif(F.col(f), F.lit("")), other)
    price = F.lower("_price")
    free = F.contains(price, F.lit("free")) | F.contains(price, F.lit("$0")) | F.contains(price, F.lit("0.00"))
    new = {f: gap(f, F.col(f"_{f}")) for f in ("date", "venue", "address")}
    new |= {"title": gap("title", F.coalesce("_title", F.lit(UNTITLED))), "description": gap("description", F.substring("_description", 1, MOST_DESCRIPTION)), "free": F.coalesce("free", free)}
    return own.withColumns(new).select(*events.columns)


#: What a record's container may be, and its fields' selectors, in order.
CONTAINERS = [".event-item", ".event-listing", ".event-card", ".show-listing", ".concert-item", ".upcoming-event", '[class*="event"]', ".eventListings li"]
RECORD = {
    "title": ["h1", "h2", "h3", ".title", ".name", ".event-name", ".eventName"],
    "date": [".date", ".event-date", ".show-date", "time"],
    "time": [".time", ".event-time", ".show-time"],
}


def records(rows: DataFrame) -> DataFrame:
    """page_id, position (from 1), container, title, date and time of each record of a page's list.

    The first selector of CONTAINERS that finds anything says what containers
    are; the outermost of them are records, so that one inside another is no
    record of its own. A field is said by the first element of a selector in
    the container, unless that is blank; records without a title go.
    """
    found = matched(rows, CONTAINERS).select("page_id", "pre", "last", F.explode("hits").alias("hit"))
    w = Window.partitionBy("page_id")
    chosen = found.withColumn("kind", F.min("hit").over(w)).filter("hit = kind").withColumn("nested", markup.inside(F.lit(True)))
    chosen = chosen.filter("not nested").select("page_id", "pre", F.col("last").alias("until"))
    # Containers don't overlap, so the last one that began before an element is the only one it can lie in.
    flat = [(f, css) for f, own in RECORD.items() for css in own]
    parts = matched(rows, [css for _, css in flat]).select("page_id", "pre", "start", "stop", "hits")
    both = parts.unionByName(chosen.withColumn("container", F.col("pre")), allowMissingColumns=True)
    upto = w.orderBy("pre", F.col("container").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumns({"in": F.last("container", ignorenulls=True).over(upto), "end": F.last("until", ignorenulls=True).over(upto)})
    inner = both.filter("container is null and pre > in and pre <= end").select("page_id", F.col("in").alias("container"), "pre", "start", "stop", F.explode("hits").alias("hit"))
    first = inner.groupBy("page_id", "container", "hit").agg(F.min_by(F.struct("start", "stop"), "pre").alias("e")).select("page_id", "container", "hit", "e.*")
    said = markup.texts(rows, first).withColumn("value", _trim(F.col("said"))).filter("value <> ''")
    names = F.array(*(F.lit(f) for f, _ in flat))
    best = said.groupBy("page_id", "container", F.element_at(names, F.col("hit") + 1).alias("field")).agg(F.min_by("value", "hit").alias("value"))
    wide = best.groupBy("page_id", "container").pivot("field", list(RECORD)).agg(F.first("value")).filter("title is not null")
    return wide.withColumn("position", F.row_number().over(w.orderBy("container"))).select("page_id", "position", "container", "title", "date", "time")


def listing(found: DataFrame, most: int = 10, batch: int = 3, enough: int | None = None) -> DataFrame:
    """The first ``most`` records of each page with the batch they are taken in (from 0) and how many the page has; with ``enough``, batches after the one that reaches that number go."""
    w = Window.partitionBy("page_id")
    out = found.withColumns({"total": F.least(F.max("position").over(w), F.lit(most)), "batch": F.floor((F.col("position") - 1) / batch).cast("int")}).filter(F.col("position") <= most)
    return out if enough is None else out.filter(F.col("batch") * batch < enough)


#: Where pages have an event's images, and what metas name one, in order.
IMAGES = [
    'img[class*="event" i]', 'img[class*="hero" i]', 'img[class*="featured" i]', 'img[class*="main" i]', 'img[class*="primary" i]', 'img[class*="banner" i]', ".event-image img", ".hero-image img", ".featured-image img", ".main-image img",
    ".event-header img", ".event-card img", 'img[alt*="event" i]', 'img[alt*="concert" i]', 'img[alt*="show" i]',
]
IMAGE_METAS = ['meta[property="og:image"]', 'meta[name="twitter:image"]', 'meta[property="twitter:image"]', 'meta[name="image"]']


def page_images(rows: DataFrame) -> DataFrame:
    """page_id, position (from 1) and url of a page's images: by order of IMAGES and place, then the first of each of IMAGE_METAS; each URL once, at its first place."""
    found = matched(rows, [*IMAGES, *IMAGE_METAS]).select("page_id", "pre", "attrs", F.explode("hits").alias("hit"))
    meta = F.col("hit") >= len(IMAGES)
    own = found.filter(~meta).select("page_id", "hit", "pre", F.col("attrs")["src"].alias("url"))
    metas = found.filter(meta).groupBy("page_id", "hit").agg(F.min("pre").alias("pre"), F.min_by(F.col("attrs")["content"], "pre").alias("url"))
    first = own.unionByName(metas).filter(valid_image_url(F.col("url"))).groupBy("page_id", "url").agg(F.min(F.struct("hit", "pre")).alias("at"))
    return first.select("page_id", F.row_number().over(Window.partitionBy("page_id").orderBy("at")).alias("position"), "url")


#: Selectors of titles, and metas that name one, in order; words of lines that are no title.
TITLES, TITLE_METAS = ["h1", ".title", ".event-title", ".show-title", '[class*="title"]'], ['meta[property="og:title"]', 'meta[name="twitter:title"]', 'meta[name="title"]', "title"]
NO_TITLE = ["home", "menu", "search"]


def page_titles(rows: DataFrame) -> DataFrame:
    """page_id, title and strategy of every page: the first element of a selector with over three characters, else a meta's up to a bar or dash, else a line of the body that reads like one, else the default."""
    found = matched(rows, [*TITLES, *TITLE_METAS, "body"]).select("page_id", "pre", "tag", "attrs", "start", "stop", F.explode("hits").alias("hit"))
    first = found.groupBy("page_id", "hit").agg(F.min_by(F.struct("tag", "attrs", "start", "stop"), "pre").alias("e")).select("page_id", "hit", "e.*")
    said = markup.texts(rows, first)
    n, body = len(TITLES), len(TITLES) + len(TITLE_METAS)
    head = F.when(F.col("tag") == "meta", F.col("attrs")["content"]).otherwise(F.col("said"))
    lines = F.transform(F.split("said", "\n"), _trim)
    likely = lambda x: F.length(x).between(11, 99) & ~F.exists(F.array(*map(F.lit, NO_TITLE)), lambda w: F.contains(F.lower(x), w)) & ~x.rlike("^[0-9]") & x.rlike("[A-Za-z]{3,}")
    value = F.when(F.col("hit") < n, F.when(F.length(_trim(F.col("said"))) > 3, _trim(F.col("said")))).when(F.col("hit") < body, F.when(F.length(head) > 3, _trim(F.substring_index(F.substring_index(head, "|", 1), "-", 1)))).otherwise(F.get(F.filter(lines, likely), F.lit(0)))
    told = said.select("page_id", "hit", value.alias("value")).filter("value <> ''").groupBy("page_id").agg(F.min_by(F.struct("hit", "value"), "hit").alias("b"))
    pages = rows.filter(F.col("tag") == markup.PAGE).select("page_id").join(told, "page_id", "left")
    hit = F.col("b.hit")
    return pages.select("page_id", F.coalesce("b.value", F.lit(UNTITLED)).alias("title"), F.when(hit < n, "heading").when(hit < body, "meta").when(hit == body, "line").otherwise("default").alias("strategy"))
