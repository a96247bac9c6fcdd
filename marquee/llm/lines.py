"""Line dedup by site-relative frequency, with DataFrame functions only.

A line is boilerplate on a host if the pages of the host that contain it,
divided by all pages of the host, exceed ``ratio`` (and are ``least_pages`` or
more). A host has at most (lines per page)/ratio such lines, so they fit into
one array per host. Hosts with very many pages get theirs by a broadcast of
bounded size and their pages stay where they are; see ``skew.lookup``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm.skew import lookup

RATIO = 0.2
LEAST_PAGES = 3
RESERVED = {"_host", "_text", "_pages", "_often", "_n", "_kept", "host", "clean_text", "n_lines", "n_dropped"}
_EDGES = r"^[ \t\r\f]+|[ \t\r\f]+$"


def host_of(url: Column) -> Column:
    """Host of an absolute URL in lower case, without port; empty for others."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))


def html_lines(html: Column) -> Column:
    """Text of a page with a line break at each block element."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", "")
    text = F.regexp_replace(text, r"(?i)</?(p|br|div|li|ul|ol|h[1-6]|nav|article|footer|header|section|table|tr|td|th|title|head|body|html)\b[^>]*>", "\n")
    return F.regexp_replace(text, r"<[^>]*>", "")


def _key(line: Column) -> Column:
    """128 bits for a line without the white space at its ends."""
    return F.unhex(F.md5(F.regexp_replace(line, _EDGES, "")))


def drop_boilerplate(docs: DataFrame, host: Column, text: Column, ratio: float = RATIO, least_pages: int = LEAST_PAGES, once: bool = False) -> DataFrame:
    """All columns of ``docs`` and host, clean_text, n_lines and n_dropped.

    Lines are compared without white space at their ends; blank lines are never
    boilerplate. A null host is the empty host, a null text an empty one.
    Repeated rows count as pages of their own, unless ``once`` counts equal texts
    of a host once. An empty table gives no rows. Raises for columns of ``docs``
    with one of the names in RESERVED.
    """
    taken = RESERVED & set(docs.columns)
    if taken:
        raise ValueError(f"reserved names: {sorted(taken)}")
    rows = docs.withColumns({"_host": F.coalesce(host, F.lit("")), "_text": F.coalesce(text, F.lit(""))})
    lines = F.filter(F.split("_text", "\n"), lambda x: F.regexp_replace(x, _EDGES, "") != "")
    # Which of equal texts is counted makes no difference, as only host and lines are read of it.
    pages = rows.select("_host", "_text")
    if once:
        same = rows.groupBy("_host", F.md5("_text").alias("_same")).agg(F.count("*").alias("_rows"))
        counted = same.groupBy("_host").agg(F.count("*").alias("_pages"), F.sum("_rows").alias("_rows"))
    own = pages.select("_host", *([F.md5("_text").alias("_same")] if once else []), F.explode(F.array_distinct(F.transform(lines, _key))).alias("_line"))
    own = own.distinct().drop("_same") if once else own
    counts = own.groupBy("_host", "_line").agg(F.count("*").alias("n")).filter(F.col("n") >= least_pages)
    hosts = counted if once else rows.groupBy("_host").agg(F.count("*").alias("_pages"), F.count("*").alias("_rows"))
    # The table of hosts may be large, so no side is broadcast unless found small.
    often = counts.join(hosts, "_host").filter(F.col("n") > ratio * F.col("_pages")).groupBy("_host").agg(F.collect_set("_line").alias("_often"))
    keyed = hosts.join(often, "_host", "left").withColumn("_often", F.coalesce("_often", F.array().cast("array<binary>")))
    found = lookup(rows, keyed, "_host", "_rows", rows.count())
    split = F.split("_text", "\n")
    kept = F.filter(split, lambda x: ~F.array_contains(F.col("_often"), _key(x)))
    kept = F.when(F.size("_often") == 0, split).otherwise(kept)
    out = found.withColumns({"_n": F.size(split), "_kept": kept})
    return out.select(*docs.columns, F.col("_host").alias("host"), F.array_join("_kept", "\n").alias("clean_text"), F.col("_n").alias("n_lines"), (F.col("_n") - F.size("_kept")).alias("n_dropped"))
