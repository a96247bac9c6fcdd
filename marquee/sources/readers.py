"""Sources: event collections, object listings, venue lists, URL lists, JSON-LD in pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marquee.functions import linked
from marquee.functions.addresses import looks_like_address
from marquee.functions.text import venue_key


def collections(spark: SparkSession, paths: dict[str, str], form: str = "parquet") -> DataFrame:
    """All events of several collections with a collection column; one in the data takes precedence."""
    out = None
    for name, path in paths.items():
        df = spark.read.format(form).load(path)
        own = F.coalesce(F.col("collection"), F.lit(name)) if "collection" in df.columns else F.lit(name)
        df = df.withColumn("collection", own)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def listing_parts(listing: DataFrame) -> DataFrame:
    """Object paths collection/event/file as columns; shorter paths are dropped."""
    p = F.split("path", "/")
    return listing.filter(F.size(p) >= 3).withColumns({"collection": p[0], "event_id": p[1], "file": F.element_at(p, -1)})


def venue_list(files: DataFrame, look_ahead: int = 4) -> DataFrame:
    """Venues from lists of lines 'Name | http...' with an address in the next lines, from (source, content).

    The search ends at the next venue; blank lines count as lines. A later
    venue of the same name replaces an earlier one, and keeps its place.
    """
    lines = files.select("source", F.posexplode(F.split(F.regexp_replace("content", "^\\x{FEFF}", ""), "\n")).alias("ord", "line")).withColumn("line", F.trim(F.regexp_replace("line", "\r", "")))
    name = F.trim(F.regexp_extract("line", r"^([^|]+)\s*\|\s*https?://", 1))
    address = looks_like_address(F.col("line"))
    stop = F.contains("line", F.lit("|")) & F.contains("line", F.lit("http"))
    w = Window.partitionBy("source").orderBy("ord").rowsBetween(1, look_ahead)
    marked = lines.withColumns({"name": name, "what": F.struct(stop.alias("stop"), F.when(address, F.col("line")).alias("address"))})
    ahead = marked.withColumn("ahead", F.collect_list("what").over(w)).filter("name <> ''")
    hit = F.get(F.filter("ahead", lambda x: x["stop"] | x["address"].isNotNull()), 0)
    found = ahead.withColumn("address", F.when(~hit["stop"], hit["address"])).filter("address is not null").withColumn("key", venue_key(F.col("name")))
    # The last one's values, in the place of the first: partial lookups go by place.
    last = found.groupBy("key").agg(F.max(F.struct("source", "ord", "name", "address")).alias("v"), F.min(F.struct("source", "ord")).alias("at"))
    return last.select("key", "v.name", "v.address", "at.source", "at.ord")


def url_list(lines: DataFrame) -> DataFrame:
    """URLs of a list (value), without blank lines and comments."""
    return lines.withColumn("value", F.trim("value")).filter("value <> '' and not startswith(value, '#')")


def json_ld(pages: DataFrame) -> DataFrame:
    """Every script block of linked data in a page: page_id, ord, json (variant). Blocks that are no JSON are skipped."""
    blocks = F.regexp_extract_all("html", F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), 1)
    out = pages.select("page_id", F.posexplode(blocks).alias("ord", "text"))
    return out.withColumn("json", F.try_parse_json("text")).filter("json is not null").drop("text")


def json_ld_events(pages: DataFrame) -> DataFrame:
    """The event of each linked-data block of a page, as the fields of ``linked.event_fields``, with page_id, ord, type and confidence."""
    found = json_ld(pages).withColumn("event", linked.event_of(F.col("json"))).filter("event is not null")
    found = found.withColumn("fields", linked.event_fields(F.col("event")))
    return found.select("page_id", "ord", F.try_variant_get("event", '$["@type"]', "string").alias("type"), "fields.*", F.lit(linked.SURE).alias("confidence"))
