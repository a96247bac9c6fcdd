"""What JSON in pages says, at any depth: images, all events of a page, merged configurations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.functions.common import messages, squeeze
from marquee.functions.images import absolute_url, web_image
from marquee.functions.trees import nodes, overlaid
from marquee.operators.venues import SITE_HOSTS, site_type

#: Keys of images, in order.
IMAGE_KEYS = ["image", "photo", "logo", "thumbnail", "poster", "banner"]


def _at(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _text(v: Column) -> Column:
    """The value where it is a text itself."""
    return F.when(F.schema_of_variant(v) == "STRING", _at(v, "$"))


def _said(v: Column, path: str) -> Column:
    return F.nullif(_at(v, path), F.lit(""))


def json_images(rows: DataFrame, keys: list[str], text: str, base: str) -> DataFrame:
    """``keys``, position (from 1), url, alt and selector of the images in JSON of any depth; ``base`` is the column of the page's URL.

    An image is a text, an object with a url, or one of a list of those, under
    one of IMAGE_KEYS in any object; objects come in reading order, an outer one
    before those inside it. URLs are made absolute, and those that are no web
    image's go.
    """
    bases = [] if base in keys else [base]
    found = nodes(rows, [*keys, *bases], text, ("object",)).select(*keys, *bases, "path", "value")
    named = F.array(*(F.struct(F.lit(i).alias("rank"), F.lit(k).alias("key"), _at(F.col("value"), f"$.{k}", "variant").alias("v")) for i, k in enumerate(IMAGE_KEYS)))
    own = found.select(*keys, *bases, "path", F.inline(named)).filter("v is not null")
    items = _at(F.col("v"), "$", "array<variant>")
    each = own.select(*keys, *bases, "path", "rank", "key", items.isNotNull().alias("listed"), F.posexplode(F.coalesce(items, F.array("v"))).alias("item", "one"))
    plain = _text(F.col("one"))
    url = F.coalesce(plain, _said(F.col("one"), "$.url"))
    selector = F.concat(F.lit("json_ld."), "key", F.when(F.col("listed"), "[]").otherwise(""), F.when(plain.isNotNull(), "").otherwise(".url"))
    alt = F.when(plain.isNotNull(), F.col("key")).otherwise(F.coalesce(_said(F.col("one"), "$.description"), _said(F.col("one"), "$.caption"), "key"))
    images = each.select(*keys, F.struct("path", "rank", "item").alias("at"), absolute_url(url, F.col(base)).alias("url"), alt.alias("alt"), selector.alias("selector")).filter(web_image(F.col("url")))
    return images.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy("at"))).select(*keys, "position", "url", "alt", "selector")


#: Types of events in lists of them, and of a page's own event.
LISTED, OWN = ["Event", "MusicEvent"], ["SocialEvent", "Event", "EventSeries"]
GRAPH = "@graph"


def _types(v: Column) -> Column:
    """Types of an object: one, or a list of them."""
    kind = F.try_variant_get(v, '$["@type"]', "variant")
    return F.when(kind.isNull(), F.array().cast("array<string>")).otherwise(F.coalesce(_at(kind, "$", "array<string>"), F.array(_at(kind, "$"))))


def listed_events(blocks: DataFrame, keys: list[str], text: str) -> DataFrame:
    """All events of blocks of linked data (keys, text): keys, position, title, start_date, start_time, venue, address, description, categories, free, tickets_link.

    Lists in lists and graphs are opened, events inside other things aren't
    taken. What an address lacks is left out.
    """
    at_top = F.forall("names", lambda n: n.isNull() | (n == GRAPH))
    events = nodes(blocks, keys, text, ("object",)).filter(at_top).filter(F.arrays_overlap(_types(F.col("value")), F.array(*map(F.lit, LISTED))))
    v = F.col("value")
    start = F.split(_said(v, "$.startDate"), "T")
    part = lambda p: _said(v, f"$.location.address.{p}")
    address = F.nullif(F.concat_ws(", ", part("streetAddress"), part("addressLocality"), F.nullif(F.concat_ws(" ", part("addressRegion"), part("postalCode")), F.lit(""))), F.lit(""))
    return events.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy("path"))).select(
        *keys, "position", _said(v, "$.name").alias("title"), start[0].alias("start_date"), F.substring(F.get(start, F.lit(1)), 1, 8).alias("start_time"), _said(v, "$.location.name").alias("venue"), F.coalesce(address, _text(_at(v, "$.location.address", "variant"))).alias("address"),
        _said(v, "$.description").alias("description"), F.array(F.lit("Music")).alias("categories"), F.lit(False).alias("free"), _said(v, "$.offers.url").alias("tickets_link"),
    )


def own_event(blocks: DataFrame, page: str, order: str, text: str) -> DataFrame:
    """The event of each page from its blocks (page, order, text): title, start, venue, address, description (500 characters), free, image.

    In a block it is the first event of a list, the block itself, or its
    mainEntity (no series); of several blocks the first that has one counts.
    The first offer says whether it is free (lowPrice before price); without
    offers it isn't, with offers that name no price nobody knows.
    """
    v = F.try_parse_json(text)
    is_one = lambda x, kinds: F.arrays_overlap(_types(x), F.array(*map(F.lit, kinds)))
    items, main = _at(v, "$", "array<variant>"), _at(v, "$.mainEntity", "variant")
    found = blocks.select(page, order, F.coalesce(F.get(F.filter(items, lambda x: is_one(x, OWN)), F.lit(0)), F.when(is_one(v, OWN), v), F.when(is_one(main, OWN[:2]), main)).alias("e")).filter("e is not null")
    first = found.groupBy(page).agg(F.min_by(F.to_json("e"), order).alias("e")).withColumn("e", F.parse_json("e"))
    e = F.col("e")
    offers = _at(e, "$.offers", "variant")
    offer = F.coalesce(F.get(_at(offers, "$", "array<variant>"), F.lit(0)), offers)
    price = F.coalesce(_at(offer, "$.lowPrice", "double"), _at(offer, "$.price", "double"))
    image = _at(e, "$.image", "variant")
    picture = F.coalesce(_text(F.get(_at(image, "$", "array<variant>"), F.lit(0))), _text(image), _said(image, "$.url"))
    parts = [F.trim(_said(e, f"$.location.address.{p}")) for p in ("streetAddress", "addressLocality", "addressRegion", "postalCode")]
    address = F.coalesce(_text(_at(e, "$.location.address", "variant")), F.when(parts[0].isNotNull(), F.concat_ws(", ", *parts)))
    return first.select(page, squeeze(_said(e, "$.name")).alias("title"), _said(e, "$.startDate").alias("start"), F.trim(_said(e, "$.location.name")).alias("venue"), address.alias("address"), F.substring(_said(e, "$.description"), 1, 500).alias("description"), F.when(offers.isNull(), False).otherwise(price == 0).alias("free"), picture.alias("image"))


#: Sections that a configuration must have, and thresholds from 0 to 100.
SECTIONS, THRESHOLDS = ["extraction", "hashApp", "confidence"], ["excellent", "good", "acceptable", "poor"]


def config_errors(config: Column) -> Column:
    """Messages on a configuration (variant): sections that are missing, thresholds that are no number from 0 to 100, timeouts of layers that are no number."""
    number = lambda v: F.when(~F.schema_of_variant(v).isin("STRING", "BOOLEAN", "VOID"), _at(v, "$", "double"))
    part = lambda p: _at(config, f"$.{p}", "variant")
    bad = [(part("confidence").isNotNull() & ~F.coalesce(number(part(f"confidence.{t}")).between(0, 100), F.lit(False)), f"Invalid confidence threshold: {t}") for t in THRESHOLDS]
    layers = F.map_entries(F.coalesce(_at(config, "$.layers", "map<string,variant>"), F.create_map().cast("map<string,variant>")))
    timeout = lambda x: _at(x["value"], "$.timeout", "variant")
    slow = F.filter(layers, lambda x: F.coalesce(timeout(x).isNotNull() & ~F.schema_of_variant(timeout(x)).isin("VOID") & number(timeout(x)).isNull(), F.lit(False)))
    return F.concat(messages([(F.coalesce(_at(config, f"$.{s}"), F.lit("")).isin("", "0", "false"), f"Missing required section: {s}") for s in SECTIONS] + bad), F.array_sort(F.transform(slow, lambda x: F.concat(F.lit("Layer "), x["key"], F.lit(" timeout must be a number")))))


def configurations(defaults: DataFrame, sites: DataFrame) -> DataFrame:
    """Configuration of every site (site, config: JSON) over the defaults (one row, config), with its errors and whether it is valid. A site's text that is no JSON leaves it out."""
    known = sites.filter(F.try_parse_json("config").isNotNull())
    base = F.broadcast(defaults.select(F.col("config").alias("_defaults")).limit(1))
    out = overlaid(known.select("site", "config").join(base, F.lit(True), "left"), ["site"], "_defaults", "config", "config")
    return out.withColumn("_v", F.parse_json("config")).withColumn("errors", config_errors(F.col("_v"))).drop("_v").withColumn("valid", F.size("errors") == 0)


def config_for(urls: DataFrame, configs: DataFrame) -> DataFrame:
    """``urls`` (url: an address or a site's name) with site and config: that of the host's site, else the generic one, else null. A host of no known site is generic."""
    address = F.startswith(F.lower("url"), F.lit("http"))
    own = urls.withColumn("site", F.when(address, site_type(F.col("url"), SITE_HOSTS)).otherwise(F.lower("url")))
    known = configs.select("site", "config")
    generic = known.filter("site = 'generic'").limit(1).select(F.col("config").alias("_generic"), F.lit(1).alias("_one"))
    found = own.join(known, "site", "left").withColumn("_one", F.lit(1)).join(F.broadcast(generic), "_one", "left")
    return found.withColumn("config", F.coalesce("config", "_generic")).drop("_generic", "_one")
