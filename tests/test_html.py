from __future__ import annotations

from marquee.functions import html
from marquee.operators import layers
from marquee.plans.pages import page_fields
from tests.conftest import SF

PAGE = """<html><head><title>Site &amp; Co</title><meta property="og:title" content=" Big Night "><meta name="description" content="meta text"><link rel="canonical" href="/c">
<script>var p = "<p>no</p>";</script></head><body><h2>Concert tonight</h2><h1>Top</h1><div itemscope itemtype="http://schema.org/MusicEvent"><span itemprop="name">Inner <b>Name</b></span>
<time itemprop="startDate" datetime="2025-01-01">x</time></div><p itemprop="skip">short</p><img src="a.png" alt="pic"><p>unclosed"""


def test_elements_and_layers(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "page_id long, html string")
    rows = [(r.kind, r.name, r.value) for r in html.elements(pages).orderBy("page_id", "ord").collect() if r.page_id == 1]
    assert ("meta", "og:title", "Big Night") in rows and ("itemprop", "name", "Inner Name") in rows and ("itemprop", "startDate", "2025-01-01") in rows
    assert ("h2", "", "Concert tonight") in rows and ("img", "pic", "a.png") in rows and not any(n == "skip" for _, n, _ in rows)
    assert ("title", "", "Site & Co") in rows and "no" not in rows[-1][2].split() and rows[-1][2].endswith("unclosed")
    merged = {(r.page_id, r.field): r.value for r in layers.merged_values(html.layer_rows(html.elements(pages))).collect()}
    assert merged == {(1, "title"): ["Big Night"], (1, "description"): ["meta text"], (1, "canonicalUrl"): ["/c"], (1, "name"): ["Inner Name"], (1, "startDate"): ["2025-01-01"]}


def test_query(spark):
    rows = page_fields(spark, SF).collect()
    assert {r.page_id for r in rows if r.field == "title"} == set(range(50))


def test_few_pages_are_held_at_once(spark):
    """Whatever the size of a table, a task's batches have the pages of one slice."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, 10_000)
    pages = spark.range(1000).coalesce(1).selectExpr("id AS page_id", "concat('<title>t', id, '</title>') AS html")
    got = html.elements(pages)
    assert int(spark.conf.get(key)) <= html.PAGES
    rows = got.collect()
    assert len(rows) == 2000 and {r.value for r in rows if r.kind == "title"} == {f"t{i}" for i in range(1000)}
    spark.conf.set(key, before)
