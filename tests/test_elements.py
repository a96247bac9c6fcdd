from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from marquee.functions import markup
from marquee.functions.selectors import _condition, matched
from marquee.operators import selected
from marquee.session import materialise

PAGE = """<html><body class="a b"><p>one<p>two <b>bold</p><ul><li>x<li>y<ul><li>z</ul></ul><table><tr><td>1<td>2<tr><th>3</table>
<script>var t = "<p>no</p>";</script><img src='i.png'/><div/>in &amp; out<br></div></p></body><p>after<"""


def table(spark, *pages):
    return materialise(markup.elements(spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")), "elements")


def test_intervals(spark):
    rows = table(spark, PAGE, None, "", "text alone", "<b>" * 3000)
    said = {(r.page_id, r.pre): r for r in markup.texts(rows, rows).collect()}
    one = [said[0, i] for i in range(len([k for k in said if k[0] == 0]))]
    assert [r.tag for r in one] == ["#page", "html", "body", "p", "p", "b", "ul", "li", "li", "ul", "li", "table", "tr", "td", "td", "tr", "th", "script", "img", "div", "br", "p"]
    # A paragraph ends where a block begins, a cell where the next one does; an unknown end tag is none, an open element ends with the one around it.
    assert [(r.pre, r.last, r.parent) for r in one if r.tag in ("p", "b", "ul", "tr", "td")] == [(3, 3, 2), (4, 5, 2), (5, 5, 4), (6, 10, 2), (9, 10, 8), (12, 14, 11), (13, 13, 12), (14, 14, 12), (15, 16, 11), (21, 21, 1)]
    assert [one[i].said for i in (3, 4, 8, 10, 13, 17)] == ["one", "two bold", "yz", "z", "1", ""]
    assert one[19].said == "in & out" and one[19].children == 1 and one[21].said == "after" and one[21].parent == 1
    for a in one:
        for b in one:
            assert (a.pre < b.pre <= a.last) == (b.pre != a.pre and b.start >= a.start and b.stop <= a.stop and a.pre < b.pre and b.depth > a.depth and b.pre <= a.last)
    assert said[1, 0].said == said[2, 0].said == "" and said[3, 0].said == "text alone"
    assert said[4, 1].last == 3000 and said[4, 3000].depth == 3000


def test_selectors(spark):
    html = '<div class="event-location x"><h1 id=t>A</h1><p data-k="v1">B</p><section><p>C</p><p>D</p></section></div><p class="x">E</p><h1 class="main title">F</h1>'
    rows = table(spark, html)
    css = ['[class*="location"] h1', ".x", "div section p:first-child", "section p:last-child", "#t, .title", "[data-k]", '[data-k^="v"]', '[data-k$="2"]', "p.x", '[class="x"]', "div div p", ".titl", "div p", '[class*="LOCATION" i] h1', '[class*="LOCATION"] h1']
    said = {i: [] for i in range(len(css))}
    for r in markup.texts(rows, matched(rows, css)).orderBy("pre").collect():
        for i in r.hits:
            said[i].append(r.said)
    assert [said[i] for i in range(len(css))] == [["A"], ["ABCD", "E"], ["C"], ["D"], ["A", "F"], ["B"], ["B"], [], ["E"], ["E"], [], [], ["B", "C", "D"], ["A"], []]
    for bad in ("p:hover", "a>b", "", "p[x~=y]"):
        with pytest.raises(ValueError):
            _condition(bad)


def test_fields_by_order_of_selectors(spark):
    html = '<h1 class="big">Low place</h1><div class="title">ok</div><div class="event-title">Hi</div><div class="event-title"> The   Name </div><span class="cost">none</span><span class="fee">from $5</span><main><img src="x.txt"><img data-src="y.jpg"></main><time datetime="2025-01-02">soon</time>'
    got = {r.field: (r.value, r.confidence) for r in selected.selected_fields(table(spark, html)).collect()}
    assert got == {"title": ("The Name", 90), "price": ("from $5", 80), "image": ("y.jpg", 70), "date": ("2025-01-02", 100)}
    assert selected.selected_fields(table(spark)).count() == 0


def test_scopes_in_scopes(spark):
    html = '<p property="dc:title">outside</p><div typeof="A"><i property="schema:name">a</i><div typeof="B"><i property="schema:name"> </i><i property="schema:name">b</i></div><i property="dc:title">late a</i><i property="schema:location" content="Hall">x</i></div><div typeof="C" property="schema:description">own scope</div>'
    rows = table(spark, html)
    got = {(r.type, r.field): r.value for r in selected.rdfa(rows).collect()}
    assert got == {(None, "title"): "outside", ("A", "title"): "a", ("A", "venue"): "Hall", ("B", "title"): "b", ("C", "description"): "own scope"}
    assert {r.field: r.value for r in selected.rdfa_fields(selected.rdfa(rows)).collect()} == {"title": "outside", "venue": "Hall", "description": "own scope"}
    near = {r.pre: r.s for r in markup.innermost(rows, F.col("attrs")["typeof"].isNotNull(), "s").collect()}
    assert near == {0: None, 1: None, 2: 2, 3: 2, 4: 4, 5: 4, 6: 4, 7: 2, 8: 2, 9: 9}


def test_microdata_of_several_events(spark):
    html = '<b itemprop="name">none</b><div itemtype="x/Event"><b itemprop="name">One</b><b itemprop="name">no</b><b itemprop="offers">5</b><img itemprop="image" content="c.png"></div><div itemtype="x/MusicEvent"><b itemprop="name">Two</b><i itemprop="location">at <u itemprop="name">Hall</u></i><b itemprop="offers"> </b><time itemprop="endDate" datetime="E">x</time></div>'
    got = {r.field: r.value for r in selected.microdata(table(spark, html)).collect()}
    assert got == {"title": "Two", "venue": "Hall", "price": "5", "imageUrl": "c.png", "endDate": "E"}


def test_gaps_are_filled(spark):
    html = '<h1> </h1><p class="event-title">T</p><div class="event-details-location"><p>V</p><p>mid</p><p>A</p></div><time datetime="D"></time><div class="description">' + "d" * 600 + '</div><div class="event-pricing">$10.00</div>'
    events = spark.createDataFrame([(0, None, "", "own", None, None, None), (1, None, None, None, None, None, None), (2, None, None, None, None, None, True)], "page_id long, title string, date string, venue string, address string, description string, free boolean")
    got = {r.page_id: tuple(r)[1:] for r in selected.filled(events, table(spark, html, "")).collect()}
    assert got[0] == ("T", "D", "own", "A", "d" * 500, True)
    assert got[1] == ("Untitled Event", None, None, None, None, None) and got[2][-1] is True


def test_records_and_listing(spark):
    card = '<div class="event-card"><h2> </h2><h3>{0}</h3><p class="date">d{0}</p><div class="event-card"><h2>inner{0}</h2></div></div>'
    html = "".join(card.format(i) for i in range(8)) + '<div class="event-card"><p class="time">8</p></div><div class="show-listing"><h1>other kind</h1></div>'
    rows = selected.records(table(spark, html, "<p>none</p>", '<div class="my-event"><b class="name">N</b><time>t</time></div>'))
    got = [(r.page_id, r.position, r.title, r.date, r.time) for r in rows.orderBy("page_id", "position").collect()]
    # The first h2 of a container is blank, so the next selector says its title.
    assert got == [(0, i + 1, str(i), f"d{i}", None) for i in range(8)] + [(2, 1, "N", "t", None)]
    cut = selected.listing(rows, most=7, batch=3, enough=5).filter("page_id = 0").orderBy("position").collect()
    assert [(r.position, r.batch, r.total) for r in cut] == [(i, (i - 1) // 3, 7) for i in range(1, 7)]


def test_images_and_titles_of_pages(spark):
    html = '<meta name="image" content="http://x.example/m.png"><meta name="image" content="http://x.example/second.png"><img class="HERO" src="http://x.example/a.jpg"><img alt="a Show" src="http://x.example/b.jpg"><img class="event" src="http://x.example/b.jpg"><img class="event" src="no url"><img class="event">'
    got = [(r.position, r.url) for r in selected.page_images(table(spark, html)).orderBy("position").collect()]
    assert got == [(1, "http://x.example/b.jpg"), (2, "http://x.example/a.jpg"), (3, "http://x.example/m.png")]
    pages = ['<h1>ab</h1><b class="event-title"> Real Title </b>', '<h1>ab</h1><title>Page - Site</title>', '<meta name="title" content="|x long"><body>home page of it\n12 things to do\nshort\n  A line to read  \n</body>', "", None, '<meta property="og:title" content="From | meta">']
    got = {r.page_id: (r.title, r.strategy) for r in selected.page_titles(table(spark, *pages)).collect()}
    assert got == {0: ("Real Title", "heading"), 1: ("Page", "meta"), 2: ("A line to read", "line"), 3: ("Untitled Event", "default"), 4: ("Untitled Event", "default"), 5: ("From", "meta")}
