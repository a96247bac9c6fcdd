"""Queries on linked data, images, kinds of pages, categories and more statistics of quality, each with SQL that works the results out from the columns the texts were made of."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.functions import categories, images, prices, validators
from marquee.operators import images as image_ops
from marquee.operators import quality as q
from marquee.operators import venues
from marquee.plans.derive import pick, pick_sql
from marquee.plans.registry import query
from marquee.session import table
from marquee.sources import readers

#: Linked data by form, over a number n and an amount a.
BLOCKS = [
    '{"@type":"MusicEvent","name":" Night  {n} ","startDate":"2025-01-02","location":"Hall {n}","offers":{"price":"{a}.50","priceCurrency":"EUR"},"image":"http://i.example/{n}.jpg","performer":"Ann"}',
    '[{"@type":"Organization"},{"@type":"Event","headline":"Day {n}","location":{"name":"Room","address":{"streetAddress":"{n} Main St","addressLocality":"Austin","postalCode":"78701"},"geo":{"latitude":30.5,"longitude":"-97.5"}},"offers":[{"lowPrice":{a},"highPrice":"{b}"},{"price":0,"availability":"http://schema.org/SoldOut","url":"http://t.example/{n}"}],"image":[{"url":"u{n}"},{"contentUrl":"c"},{"x":1}],"performer":[{"name":"Bo","@type":"Person"},"Cy"]}]',
    '{"@type":"WebPage","mainEntity":{"@type":"Festival","name":"Fest {n}","location":{"address":"{n} Oak Ave, Oakland"},"organizer":{"name":"Org","email":"o@x.example"}}}',
    '{"@type":"Product","name":"none"}', "{broken",
]


@query(
    "linked_events",
    """WITH o AS (SELECT o_orderkey AS page_id, o_orderkey % 5 AS f, CAST(o_orderkey % 900 AS VARCHAR) AS n, 5 + o_custkey % 90 AS a, 200 + o_custkey % 50 AS b FROM orders)
    SELECT page_id, CASE f WHEN 0 THEN 'MusicEvent' WHEN 1 THEN 'Event' ELSE 'Festival' END AS type, CASE f WHEN 0 THEN 'Night ' WHEN 1 THEN 'Day ' ELSE 'Fest ' END || n AS title, CAST(CASE f WHEN 1 THEN 85 ELSE 90 END AS INT) AS title_confidence,
    CASE f WHEN 0 THEN 'Hall ' || n WHEN 1 THEN 'Room' END AS venue, CAST(CASE f WHEN 0 THEN 80 WHEN 1 THEN 90 END AS INT) AS venue_confidence, CASE f WHEN 1 THEN n || ' Main St, Austin, 78701' WHEN 2 THEN n || ' Oak Ave, Oakland' END AS address, CASE f WHEN 1 THEN -97.5::DOUBLE END AS lng,
    CAST(CASE f WHEN 0 THEN a + 0.5 WHEN 1 THEN 0 END AS DOUBLE) AS least, CAST(CASE f WHEN 0 THEN a + 0.5 WHEN 1 THEN b END AS DOUBLE) AS most, CASE f WHEN 0 THEN false WHEN 1 THEN true END AS free, CASE f WHEN 1 THEN true END AS sold_out, CASE f WHEN 0 THEN 'EUR' WHEN 1 THEN 'USD' END AS currency,
    CASE f WHEN 1 THEN 'http://t.example/' || n END AS link, CASE f WHEN 0 THEN 'http://i.example/' || n || '.jpg' WHEN 1 THEN 'u' || n || ',c' ELSE '' END AS images, CASE f WHEN 0 THEN 'Ann' WHEN 1 THEN 'Bo,Cy' ELSE '' END AS performers, CASE f WHEN 2 THEN 'o@x.example' END AS email FROM o WHERE f < 3""",
)
def linked_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    block = pick(k, BLOCKS)
    for name, value in (("{n}", k % 900), ("{a}", 5 + c % 90), ("{b}", 200 + c % 50)):
        block = F.replace(block, F.lit(name), value.cast("string"))
    pages = table(spark, sf_dir, "orders").select(k.alias("page_id"), F.concat(F.lit('<html><script type="application/ld+json">'), block, F.lit("</script></html>")).alias("html"))
    out = readers.json_ld_events(pages)
    return out.select(
        "page_id", "type", "title", "title_confidence", "location.venue", "location.venue_confidence", "location.address", "location.lng", "offers.least", "offers.most", "offers.free", "offers.sold_out", "offers.currency", "offers.link",
        F.array_join("images", ",").alias("images"), F.array_join(F.transform("performers", lambda p: p["name"]), ",").alias("performers"), F.col("organizer.email").alias("email"),
    )


#: Image URLs by form, over a width and a height.
IMAGES = ["https://cdn.example.com/event-image_{w}x{h}.jpg", "https://a.example.com/{w}x{h}/lineup.png", "https://a.example.com/thumb?w={w}&q=1&h={h}", "https://a.example.com/page", "http://a.example.com/hero/show-{w}x{h}.webp"]
_SIZED = "CASE WHEN f = 3 OR NOT (w > 50 AND w < 5000 AND h > 50 AND h < 5000) THEN 0 ELSE {} END"
_RATIO = "CASE WHEN abs(w / h - 1.0) < 0.05 THEN 100 WHEN abs(w / h - 0.8) < 0.05 THEN 95 WHEN abs(w / h - 0.5625) < 0.05 THEN 90 WHEN abs(w / h - 0.618) < 0.05 THEN 85 WHEN w / h >= 0.7 AND w / h <= 1.3 THEN greatest(60, 80 - abs(w / h - 1.0) * 100) WHEN w / h > 1.3 AND w / h < 2.0 THEN 30 WHEN w / h < 0.5 OR w / h > 2.0 THEN 10 ELSE 40 END"
_SIZE = "CASE WHEN w >= 600 AND h >= 600 THEN CASE WHEN w * h / 1048576 >= 1 THEN 100 WHEN w * h / 1048576 >= 0.5 THEN 90 ELSE 80 END WHEN w * h / 1048576 >= 0.3 THEN 70 ELSE 60 END"
_OCR_SIZE = "CASE WHEN w < 400 OR h < 400 THEN 10 ELSE least(100, 60 + CASE WHEN w >= 800 AND h >= 800 THEN 30 WHEN w >= 600 AND h >= 600 THEN 20 ELSE 0 END + CASE WHEN w / h BETWEEN 0.7 AND 1.4 THEN 10 ELSE 0 END) END"


@query(
    "image_scores",
    f"""WITH t AS (SELECT o_orderkey AS id, o_orderkey % 5 AS f, CAST(100 + o_orderkey % 1400 AS DOUBLE) AS w, CAST(120 + o_custkey % 1300 AS DOUBLE) AS h FROM orders),
    p AS (SELECT *, CASE f WHEN 0 THEN 30 WHEN 2 THEN 0 WHEN 4 THEN 60 ELSE 0 END AS flyer, CASE f WHEN 0 THEN 60 WHEN 1 THEN 55 WHEN 2 THEN 10 WHEN 4 THEN 60 ELSE 40 END AS words, CASE f WHEN 0 THEN 30 WHEN 1 THEN 15 WHEN 2 THEN 5 WHEN 4 THEN 15 END AS quality, CASE f WHEN 0 THEN 20 WHEN 4 THEN 20 ELSE 0 END AS context FROM t),
    s AS (SELECT *, CAST({_SIZED.format('w')} AS INT) AS width, CAST({_SIZED.format('h')} AS INT) AS height FROM p)
    SELECT id, width, height, CAST(flyer AS INT) AS flyer, CAST(CASE WHEN width = 0 THEN floor(words * 0.3 + 8 + 0.5) ELSE floor({_OCR_SIZE} * 0.5 + words * 0.3 + 8 + 0.5) END AS INT) AS ocr_score,
    CAST(CASE WHEN width >= 300 AND height >= 300 THEN floor({_RATIO} * 0.4 + {_SIZE} * 0.25 + flyer * 0.2 + quality * 0.1 + context * 0.05 + 0.5) END AS INT) AS score FROM s""",
)
def image_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    url = F.replace(F.replace(pick(k, IMAGES), F.lit("{w}"), (100 + k % 1400).cast("string")), F.lit("{h}"), (120 + c % 1300).cast("string"))
    t = table(spark, sf_dir, "orders").select(k.alias("id"), url.alias("url")).withColumn("d", images.dimensions(F.col("url")))
    u, w, h = F.col("url"), F.col("d.width"), F.col("d.height")
    title = F.lit("Grand show")
    return t.select("id", w.alias("width"), h.alias("height"), images.flyer_score(u, title).alias("flyer"), images.ocr_score(u, w, h).alias("ocr_score"), images.image_score(u, w, h, title, F.lit("Blue Note")).alias("score"))


@query(
    "ranked_images",
    """WITH t AS (SELECT o_custkey AS event_id, o_orderkey AS ord, CAST(350 + o_orderkey % 700 AS DOUBLE) AS w, CAST(400 + o_orderkey % 500 AS DOUBLE) AS h, o_orderkey % 3 AS f FROM orders),
    s AS (SELECT *, CASE WHEN w < 400 OR h < 400 THEN 10 ELSE least(100, 60 + CASE WHEN w >= 800 AND h >= 800 THEN 30 WHEN w >= 600 AND h >= 600 THEN 20 ELSE 0 END + CASE WHEN w / h BETWEEN 0.7 AND 1.4 THEN 10 ELSE 0 END) END AS d FROM t),
    o AS (SELECT *, CAST(floor(d * 0.5 + CASE f WHEN 0 THEN 60 WHEN 1 THEN 55 ELSE 10 END * 0.3 + 8 + 0.5) AS INT) AS ocr_score FROM s)
    SELECT event_id, ord, ocr_score, CAST(row_number() OVER (PARTITION BY event_id ORDER BY ocr_score DESC, ord) AS INT) AS rank FROM o WHERE ocr_score >= 60""",
)
def ranked_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    t = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("event_id"), k.alias("ord"), pick(k, ["https://a.example.com/poster.jpg", "https://a.example.com/schedule.png", "https://a.example.com/thumb.png"]).alias("url"), (350 + k % 700).cast("int").alias("width"), (400 + k % 500).cast("int").alias("height"))
    return image_ops.readable_images(t).select("event_id", "ord", "ocr_score", "rank")


#: Pages and URLs with what they are, worked out by hand: blocked, kind and host of site, usable image, likely image, absolute form beside http://h.example/a/b.html.
PAGES = [
    ("Access Denied", "", "https://www.eventbrite.com/e/1", True, "eventbrite", "eventbrite", True, False), ("Cloudflare runs a security check", "Hi", "http://tickets.example.com/x", True, "ticketing", "generic", True, False),
    ("eventbrite events: access denied", "", "https://m.facebook.com/events", False, "facebook", "facebook", True, False), ("Book now, captcha and blocked are only words", "", "https://x.example/buy/1", False, "ticketing", "generic", True, False),
    ("fine", "403 Forbidden", "https://vivid-seats.example/img/a.css", True, "ticketing", "generic", False, True), ("We are checking your browser", "", "https://www.yelp.com/pixel.gif", True, "generic", "yelp", False, True), ("Just a concert", "Music", "ftp://cdn.example/a.jpg", False, "generic", "generic", False, True),
]


@query(
    "page_kinds",
    f"""SELECT o_orderkey AS id, {', '.join(f"list_extract([{', '.join(str(p[i]).lower() for p in PAGES)}], CAST(o_orderkey % {len(PAGES)} AS BIGINT) + 1) AS {n}" for i, n in ((3, 'blocked'), (6, 'usable'), (7, 'likely')))},
    {pick_sql('o_orderkey', [p[4] for p in PAGES])} AS kind, {pick_sql('o_orderkey', [p[5] for p in PAGES])} AS host FROM orders""",
)
def page_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    content, title, url = (pick(k, [p[i] for p in PAGES]) for i in range(3))
    return table(spark, sf_dir, "orders").select(
        k.alias("id"), venues.looks_blocked(content, title).alias("blocked"), venues.site_kind(url).alias("kind"), venues.site_type(url, venues.SITE_HOSTS).alias("host"), images.web_image(url).alias("usable"), images.likely_image(url).alias("likely")
    )


#: Image addresses beside http://h.example/a/b.html?x=1 and what they are from there.
BESIDE = [("https://x.example/i.png", "https://x.example/i.png"), ("//c.example/i.png", "http://c.example/i.png"), ("/i.png", "http://h.example/i.png"), ("i.png", "http://h.example/a/i.png"), ("../i.png?w=1", "http://h.example/i.png?w=1"), ("./c/../i.png", "http://h.example/a/i.png"), ("", "")]
#: Texts, whether they describe something, and whether they are a title.
DESCRIBED = [
    ("A long evening of live music and good food for all of you", True, True), ("A LONG EVENING OF LIVE MUSIC AND FOOD", False, True), ("A LONG EVENING OF LIVE MUSIC AND GOOD FOOD FOR ALL", True, True), ("1 2 3 4 5 6 7 8 9 10", False, False),
    ("Come!!! to, the; great - big show (now) here my dear friends", True, True), ("Short", False, True), ("click here for the whole story of our last year", True, False), ("", False, False),
]


@query(
    "text_kinds",
    f"""SELECT o_orderkey AS id, nullif({pick_sql('o_orderkey', [b for _, b in BESIDE])}, '') AS absolute, {', '.join(f"list_extract([{', '.join(str(d[i]).lower() for d in DESCRIBED)}], CAST(o_orderkey % {len(DESCRIBED)} AS BIGINT) + 1) AS {n}" for i, n in ((1, 'descriptive'), (2, 'title')))} FROM orders""",
)
def text_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    x = pick(k, [d for d, *_ in DESCRIBED])
    absolute = images.absolute_url(pick(k, [a for a, _ in BESIDE]), F.lit("http://h.example/a/b.html?x=1"))
    return table(spark, sf_dir, "orders").select(k.alias("id"), absolute.alias("absolute"), validators.descriptive(x).alias("descriptive"), validators.flyer_title(x, ["click here"]).alias("title"))


WORDS = {"Music": ["concert", "band", "live music", "dj"], "Festivals": ["music festival", "outdoor"], "Nightclubs": ["dance floor", "dj set"], "Bars": ["bar"]}
#: Texts with their categories in order, their broad categories, and what they cost: free, the price or the range.
TAGGED = [
    ("Concert with a band at the music festival, free entry", "Festivals,Music", "Music", True, None, None), ("DJ set on the dance floor, concert $10 - $20", "Nightclubs,Music", "Music,Arts & Theater", False, None, "$10 - $20"), ("Band at the bar $15", "Music,Bars", "Music,Nightlife", False, 15.0, None),
    ("Wine and beer tasting, party party", "", "Food & Drink,Nightlife", False, None, None), ("nothing here", "", "Community", False, None, None), ("Outdoor concert, band and dj", "Music,Festivals", "Music", False, None, None),
]


@query(
    "tagged_texts",
    f"""SELECT o_orderkey AS id, {pick_sql('o_orderkey', [t[1] for t in TAGGED])} AS ordered, {pick_sql('o_orderkey', [t[2] for t in TAGGED])} AS broad, o_orderkey % 6 = 0 AS free, CASE WHEN o_orderkey % 6 = 2 THEN 15.0::DOUBLE END AS price, CASE WHEN o_orderkey % 6 = 1 THEN '$10 - $20' END AS price_range,
    CASE o_orderkey % 3 WHEN 0 THEN '#FF717A' WHEN 1 THEN '#FFBA0E' ELSE '#03A4F1' END AS color, CASE o_orderkey % 3 WHEN 0 THEN 'Music' ELSE '' END AS valid_broad FROM orders""",
)
def tagged_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    t = table(spark, sf_dir, "orders").select(k.alias("id"), pick(k, [t[0] for t in TAGGED]).alias("x"), pick(k, ["Music", "Bars", "Other"]).alias("c"))
    x = F.col("x")
    p = prices.page_price(x)
    return t.select(
        "id", F.array_join(categories.reordered(x, WORDS), ",").alias("ordered"), F.array_join(categories.broad_categories(x), ",").alias("broad"), p["free"].alias("free"), p["price"].alias("price"), p["range"].alias("price_range"), categories.color(F.col("c")).alias("color"),
        F.array_join(categories.valid_broad(F.array("c")), ",").alias("valid_broad"),
    )


_RESULTS = "(SELECT l_returnflag AS category, l_linestatus AS field, CAST(CASE WHEN l_linenumber = 7 THEN NULL ELSE 50 + l_partkey % 51 END AS DOUBLE) AS a, CAST((l_suppkey % 100) / 100.0 AS DOUBLE) AS c, CASE WHEN l_linenumber % 3 > 0 THEN l_partkey % 4 > 0 END AS passed, 'test_' || l_shipmode_ AS name FROM (SELECT *, list_extract(['concert', 'food', 'other', 'comedy_sports'], CAST(l_partkey % 4 AS BIGINT) + 1) AS l_shipmode_ FROM lineitem))"


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, p = F.col("l_linenumber"), F.col("l_partkey")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("category"), F.col("l_linestatus").alias("field"), F.when(n != 7, 50 + p % 51).cast("double").alias("accuracy"), ((F.col("l_suppkey") % 100) / 100.0).alias("confidence"), F.when(n % 3 > 0, p % 4 > 0).alias("passed"),
        F.concat(F.lit("test_"), pick(p, ["concert", "food", "other", "comedy_sports"])).alias("name"),
    )


@query(
    "quality_overall",
    f"""SELECT category, field, CAST(floor(1000 * avg(a) + 0.5) AS BIGINT) AS average, count(*) AS n, CAST(count_if(a >= 90) AS BIGINT) AS bin_90, CASE WHEN avg(a) >= 90 THEN 'A' WHEN avg(a) >= 80 THEN 'B' WHEN avg(a) >= 70 THEN 'C' WHEN avg(a) >= 60 THEN 'D' ELSE 'F' END AS grade
    FROM {_RESULTS} WHERE a IS NOT NULL GROUP BY GROUPING SETS ((category), (field), ())""",
)
def quality_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = q.accuracy_overall(_results(spark, sf_dir))
    return out.select("category", "field", F.floor(1000 * F.col("average") + 0.5).alias("average"), "n", F.col("bin_90").cast("long").alias("bin_90"), "grade")


@query(
    "quality_confidence",
    f"""WITH r AS {_RESULTS} SELECT category, CAST(count_if(c >= 0.85) AS BIGINT) AS very_high, CAST(count_if(c < 0.45) AS BIGINT) AS low, CAST(round(1000 * avg(a) FILTER (WHERE c >= 0.8)) AS BIGINT) AS calibration, coalesce(avg(a) FILTER (WHERE c >= 0.8) < 75, false) AS miscalibrated, CAST(round(1000 * avg(c)) AS BIGINT) AS reliability,
    CAST(round(100 * count_if(passed) / count(passed)) AS BIGINT) AS pass_rate, CAST(floor(avg(a) + 0.5) AS BIGINT) AS rounded, CAST(round(100 * count_if(a >= 80) / count(a)) AS BIGINT) AS high, CAST(floor(100 * avg(a) + 0.5) AS BIGINT) AS mean, CAST(floor(100 * stddev_pop(a) + 0.5) AS BIGINT) AS deviation,
    CAST(count(DISTINCT CASE WHEN contains(name, 'concert') THEN 'concert' WHEN contains(name, 'comedy') THEN 'comedy' WHEN contains(name, 'food') THEN 'food' END) AS BIGINT) AS kinds FROM r GROUP BY category""",
)
def quality_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, c = F.col("accuracy"), F.col("confidence")
    report, stats = q.confidence_report(c, a), q.statistics(a)
    r = lambda x, n=1000: F.round(n * x).cast("long")
    return _results(spark, sf_dir).groupBy("category").agg(
        report["very_high"].cast("long").alias("very_high"), report["low"].cast("long").alias("low"), r(report["calibration"]).alias("calibration"), report["miscalibrated"].alias("miscalibrated"), r(q.mean_or_zero(c)).alias("reliability"), r(q.pass_rate(F.col("passed")), 1).alias("pass_rate"),
        q.rounded_mean(a).alias("rounded"), r(q.bands(a)["high"], 1).alias("high"), r(stats["mean"], 100).alias("mean"), r(stats["deviation"], 100).alias("deviation"), F.countDistinct(q.test_kind(F.col("name"))).alias("kinds"),
    )


@query(
    "venue_summary",
    """WITH e AS (SELECT c_nationkey AS venue, CASE WHEN c_custkey % 4 = 0 THEN '' WHEN c_custkey % 4 = 1 THEN 'Blue Note' ELSE 'Elsewhere' END AS name, CASE WHEN c_custkey % 5 = 0 THEN '' WHEN c_custkey % 5 = 1 THEN 'Music' WHEN c_custkey % 5 = 2 THEN 'Comedy' ELSE 'Cars' END AS cat FROM customer),
    s AS (SELECT venue, max(CASE WHEN name = '' THEN 50 WHEN contains(lower(name), 'blue') THEN 100 ELSE 70 END) AS v, max(CASE cat WHEN '' THEN 50 WHEN 'Music' THEN 100 WHEN 'Comedy' THEN 80 ELSE 60 END) AS c, count(*) AS n FROM e GROUP BY venue)
    SELECT venue, CAST(v AS INT) AS venue_quality, CAST(c AS INT) AS category_quality, CAST(floor((v + c) / 2 + 0.5) AS BIGINT) AS overall, CAST(round(1000 * 600.0 / n) AS BIGINT) AS average_us, CAST(50 AS BIGINT) AS success_rate FROM s""",
)
def venue_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    name = F.when(k % 4 == 0, "").when(k % 4 == 1, "Blue Note").otherwise("Elsewhere")
    cat = F.when(k % 5 == 0, "").when(k % 5 == 1, "Music").when(k % 5 == 2, "Comedy").otherwise("Cars")
    e = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("venue"), name.alias("name"), cat.alias("cat"))
    out = q.data_quality(e, ["venue"], {"venue_quality": q.venue_quality(F.col("name"), F.lit("Blue Note")), "category_quality": q.category_quality(F.col("cat"), F.lit("Music"))})
    out = out.join(e.groupBy("venue").agg(F.count("*").alias("n")), "venue")
    p = q.performance(F.col("n"), F.lit(600.0), F.lit(True), F.lit(False))
    return out.select("venue", "venue_quality", "category_quality", "overall", F.round(1000 * p["average_ms"]).cast("long").alias("average_us"), p["success_rate"].cast("long").alias("success_rate"))


@query(
    "extraction_stats",
    """SELECT count(*) AS total, CAST(count_if(s_suppkey % 3 > 0) AS BIGINT) AS venues, CAST(count_if(s_suppkey % 4 > 0) AS BIGINT) AS addresses, CAST(floor(100 * avg(CASE WHEN s_suppkey % 5 = 0 THEN 0 ELSE (s_suppkey % 10) / 10.0 END) + 0.5) AS BIGINT) AS confidence, CAST(floor(100.0 * count_if(s_suppkey % 3 > 0) / count(*) + 0.5) AS BIGINT) AS venue_rate,
    CAST(floor(100.0 * count_if(s_suppkey % 4 > 0) / count(*) + 0.5) AS BIGINT) AS address_rate FROM supplier""",
)
def extraction_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    t = table(spark, sf_dir, "supplier").select(F.when(k % 3 > 0, "v").alias("venue"), F.when(k % 4 > 0, "a").otherwise("").alias("address"), F.when(k % 5 > 0, (k % 10) / 10.0).alias("confidence"))
    out = q.extraction_stats(t)
    return out.select("total", F.col("venues").cast("long").alias("venues"), F.col("addresses").cast("long").alias("addresses"), F.round(100 * F.col("average_confidence")).cast("long").alias("confidence"), "venue_rate", "address_rate")


@query(
    "venue_counts",
    "SELECT 'region' AS key, r_name AS value, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name UNION ALL SELECT 'source', CASE WHEN n_nationkey % 2 = 0 THEN 'list' END, count(*) FROM nation GROUP BY 2",
)
def venue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    rows = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("region"), F.when(F.col("n_nationkey") % 2 == 0, "list").alias("source"))
    return q.counts_by(rows, ["region", "source"])
