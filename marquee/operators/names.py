"""Names of a dictionary found in texts by joins of word groups, and cut out.

Every run of up to as many words as the longest name has is looked up by one
equi join, so the dictionary may be of any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions.common import squeeze

#: Dates in titles, kinds of venues after "at the", and what a title neither begins nor ends with.
DATES = r"(?i)\s*(\d{1,2}[-/]\d{1,2}[-/]\d{2,4}|\d{4}[-/]\d{1,2}[-/]\d{1,2}|\w+\s+\d{1,2},?\s+\d{4})\s*"
AT_VENUE = r"(?i)\s*(?:at|@)\s*(?:the\s+)?(?:Theatre|Theater|Arena|Center|Amphitheatre|Hall|Club|Stadium|Auditorium|Venue|Palace|Pavilion|Garden|Coliseum|Forum|Dome|Field|Park)\s*"
ENDS = r"^[,\s-]+|[,\s-]+$"


def _plain(word: Column) -> Column:
    """A word for comparing: in lower case, without commas around it and a last full stop."""
    return F.regexp_replace(F.lower(word), r"^,+|[,.]+$", "")


def name_key(name: Column) -> Column:
    return F.array_join(F.transform(F.split(squeeze(name), " "), _plain), " ")


def spans(texts: DataFrame, key: str, column: str, names: DataFrame) -> DataFrame:
    """``key``, start (word, from 0), size and kind of each name (names: name, kind) that stands in a text, overlaps and all."""
    known = names.select(name_key(F.col("name")).alias("_name"), "kind").filter("_name <> ''").distinct()
    longest = known.agg(F.max(F.size(F.split("_name", " ")))).first()[0] or 0
    if not longest:
        return texts.select(key, F.lit(0).alias("start"), F.lit(0).alias("size"), F.lit("").alias("kind")).limit(0)
    words = texts.select(key, F.transform(F.split(squeeze(F.col(column)), " "), _plain).alias("_w"))
    each = words.select(key, "_w", F.explode(F.sequence(F.lit(0), F.size("_w") - 1)).alias("start"))
    each = each.select(key, "start", "_w", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.size("_w") - F.col("start")))).alias("size"))
    grams = each.select(key, "start", "size", F.array_join(F.slice("_w", F.col("start") + 1, F.col("size")), " ").alias("_name"))
    return grams.join(known, "_name").select(key, "start", "size", "kind")


def without_names(titles: DataFrame, key: str, column: str, names: DataFrame) -> DataFrame:
    """``titles`` with ``cleaned``: without quotes around it, names of kind ``place`` (and one of kind ``region`` right after it), dates and kinds of venues.

    Of names that overlap, the one that begins first is cut, and of those the
    longest. What would be left of nothing is the title as it was. A null title
    stays null; ``key`` tells titles apart.
    """
    bare = titles.withColumn("_t", F.trim(F.regexp_replace(F.coalesce(column, F.lit("")), "^[\"']([^\"']+?)[\"']", "$1")))
    found = spans(bare, key, "_t", names).groupBy(key, "start").agg(F.max(F.when(F.col("kind") == "place", F.col("size"))).alias("place"), F.max(F.when(F.col("kind") == "region", F.col("size"))).alias("region"))
    # A title has few names; they are taken from left to right, each from where the one before it ends.
    every = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "place", "region"))).alias("_all"))
    zero = F.struct(F.array().cast("array<int>").alias("cut"), F.lit(0).alias("end"), F.lit(False).alias("placed"))

    def take(state: Column, s: Column) -> Column:
        place = s["place"].isNotNull() & (s["start"] >= state["end"])
        region = ~place & s["region"].isNotNull() & state["placed"] & (s["start"] == state["end"])
        size = F.when(place, s["place"]).when(region, s["region"])
        moved = F.struct(F.concat(state["cut"], F.sequence(s["start"], s["start"] + size - 1)).alias("cut"), (s["start"] + size).alias("end"), place.alias("placed"))
        return F.when(size.isNotNull(), moved).otherwise(state)

    every = every.select(key, F.aggregate("_all", zero, take)["cut"].alias("_cut"))
    out = bare.join(every, key, "left").withColumn("_words", F.split(squeeze(F.col("_t")), " "))
    cut = lambda i: F.array_contains(F.coalesce("_cut", F.array().cast("array<int>")), i)
    # The comma before a name goes with it.
    kept = F.filter(F.transform("_words", lambda w, i: F.when(~cut(i), F.when(cut(i + 1), F.regexp_replace(w, ",+$", "")).otherwise(w))), lambda w: w.isNotNull())
    left = F.regexp_replace(F.regexp_replace(F.array_join(kept, " "), DATES, ""), AT_VENUE, "")
    cleaned = F.regexp_replace(squeeze(left), ENDS, "")
    return out.withColumn("cleaned", F.when(F.col(column).isNotNull(), F.coalesce(F.nullif(cleaned, F.lit("")), F.col(column)))).drop("_t", "_cut", "_words")
