"""What pages say: meta tags, microdata, headings, paragraphs, text.

Tags are read by one Arrow-batched pass of the standard library's parser per
page; all that follows is native. The result is in the long form that
``operators.layers`` merges.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions.common import contains_any
from marquee.session import small_batches

#: Meta names with the field they give and its confidence.
META = {
    "og:title": ("title", 80), "og:description": ("description", 80), "og:image": ("imageUrl", 85), "og:url": ("sourceUrl", 80), "og:site_name": ("siteName", 75), "og:type": ("ogType", 70),
    "event:start_time": ("date", 85), "event:end_time": ("endDate", 85), "event:location:latitude": ("lat", 90), "event:location:longitude": ("lng", 90), "place:location:latitude": ("lat", 85), "place:location:longitude": ("lng", 85),
    "twitter:title": ("title", 75), "twitter:description": ("description", 75), "twitter:image": ("imageUrl", 80), "twitter:image:src": ("imageUrl", 80), "twitter:url": ("sourceUrl", 75), "twitter:site": ("twitterSite", 70),
    "twitter:creator": ("twitterCreator", 70), "title": ("metaTitle", 60), "description": ("description", 65), "keywords": ("keywords", 50), "author": ("author", 60), "robots": ("robots", 40), "canonical": ("canonicalUrl", 70),
}
#: Pages whose rows are held at once.
PAGES = 128
TITLE_CONFIDENCE, MICRODATA_CONFIDENCE = 70, 75
EVENT_WORDS = ["event", "concert", "show", "performance", "festival"]
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_SKIP = {"script", "style", "noscript"}


class _Page(HTMLParser):
    """Collects (kind, name, value) in order: meta, itemprop, h1..h6, p, img, title, and the whole text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[str, str, str]] = []
        self.open: list[tuple[str, str | None, list[str]]] = []
        self.text: list[str] = []
        self.in_event = 0
        self.scopes: list[bool] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "meta" and a.get("content", "").strip():
            self.rows.append(("meta", a.get("property") or a.get("name") or "", a["content"].strip()))
        if tag == "link" and a.get("rel") == "canonical" and a.get("href", "").strip():
            self.rows.append(("meta", "canonical", a["href"].strip()))
        if tag == "img" and a.get("src"):
            self.rows.append(("img", a.get("alt", ""), a["src"]))
        event = "Event" in a.get("itemtype", "")
        prop = a.get("itemprop") if self.in_event else None
        stated = a.get("content") or a.get("datetime") or a.get("href") or a.get("src")
        if prop and stated:
            self.rows.append(("itemprop", prop, stated.strip()))
            prop = None
        if tag not in _VOID:
            self.open.append((tag, prop, []))
            self.scopes.append(event)
            self.in_event += event

    def handle_endtag(self, tag: str) -> None:
        if not any(t == tag for t, _, _ in self.open):
            return
        while self.open:
            name, prop, parts = self.open.pop()
            self.in_event -= self.scopes.pop()
            value = " ".join("".join(parts).split())
            if self.open:
                self.open[-1][2].extend(parts)
            if value and name not in _SKIP:
                if prop:
                    self.rows.append(("itemprop", prop, value))
                if name in ("h1", "h2", "h3", "h4", "h5", "h6", "p", "title"):
                    self.rows.append((name, "", value))
            if name == tag:
                break

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][0] in _SKIP:
            return
        if self.open:
            self.open[-1][2].append(data)
        if not any(t in ("head", "title") for t, _, _ in self.open):
            self.text.append(data)


def page_rows(html: str | None) -> list[tuple[str, str, str]]:
    """(kind, name, value) of a page in order; last its text."""
    page = _Page()
    page.feed(html or "")
    page.close()
    while page.open:
        page.handle_endtag(page.open[-1][0])
    return [*page.rows, ("text", "", " ".join("".join(page.text).split()))]


def elements(pages: DataFrame) -> DataFrame:
    """page_id, ord, kind, name and value of what each page (page_id, html) holds. A null page has an empty text alone.

    A task holds the rows of PAGES pages at a time, whatever the size of the table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in (b.slice(i, PAGES) for b in batches for i in range(0, b.num_rows, PAGES)):
            ids, rows = [], []
            for page, html in zip(x.column(0).to_pylist(), x.column(1), strict=True):
                own = page_rows(html.as_py())
                ids += [page] * len(own)
                rows += [(i, *r) for i, r in enumerate(own)]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(columns[0], pa.int32()), *(pa.array(c, pa.string()) for c in columns[1:])], ["page_id", "ord", "kind", "name", "value"])

    small_batches(pages.sparkSession, PAGES)
    return pages.selectExpr("cast(page_id AS long) AS page_id", "html").mapInArrow(run, "page_id long, ord int, kind string, name string, value string")


def _is_event(x: Column) -> Column:
    return contains_any(F.lower(x), EVENT_WORDS)


def layer_rows(found: DataFrame) -> DataFrame:
    """Rows for ``operators.layers``: microdata as layer 1, meta tags as 2, headings and paragraphs as 5."""
    mapping = F.create_map(*(x for k, (f, c) in META.items() for x in (F.lit(k), F.struct(F.lit(f).alias("field"), F.lit(float(c)).alias("confidence")))))
    k, v, event = F.col("kind"), F.col("value"), _is_event(F.col("value"))
    heading = F.when(k == "h1", 60.0).when(k == "h2", 55.0).otherwise(50.0) + F.when(event, 10.0).otherwise(0.0)
    say = lambda f, c, layer: F.struct(F.lit(layer).alias("layer"), f.alias("field"), c.alias("confidence"))
    what = (
        F.when(k == "meta", F.when(mapping[F.col("name")].isNotNull(), say(mapping[F.col("name")]["field"], mapping[F.col("name")]["confidence"], 2)))
        .when(k == "title", say(F.lit("title"), F.lit(float(TITLE_CONFIDENCE)), 2))
        .when(k == "itemprop", say(F.col("name"), F.lit(float(MICRODATA_CONFIDENCE)), 1))
        .when(k.rlike("^h[1-6]$") & (F.length(v) > 3), say(F.lit("title"), heading, 5))
        .when((k == "p") & F.length(v).between(50, 1000) & (event | (F.length(v) >= 100)), say(F.lit("description"), F.when(event, 55.0).otherwise(45.0), 5))
    )
    rows = found.withColumn("s", what).filter("s is not null").select("page_id", "ord", "s.layer", "s.field", "value", "s.confidence")
    # A layer says one thing about a field: its surest, or first in the page.
    best = rows.groupBy("page_id", "layer", "field").agg(F.max_by(F.struct("value", "confidence"), F.struct("confidence", -F.col("ord"))).alias("b"))
    return best.select("page_id", "layer", "field", F.lit("scalar").alias("kind"), F.array("b.value").alias("value"), "b.confidence")
