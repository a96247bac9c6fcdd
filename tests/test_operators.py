"""Hand-worked cases of operators that no query with SQL reaches."""

from __future__ import annotations

import datetime
import itertools

from pyspark.sql import functions as F

from marquee.functions import categories, images as image_functions, prices, text
from marquee.operators import dedupe, events, images, layers, quality, ranks, requests
from marquee.sources import readers, writers


def test_submit_and_canonical(spark):
    columns = "title string, address string, venue string, date string, startTime string, startDateTimestamp timestamp, categories array<string>, free boolean, soldOutStatus boolean, createdAt timestamp"
    at = datetime.datetime(2025, 1, 1)
    good = ("A", "1 St, Austin", "V", "2025-01-01", "19:00:00", at, ["Music"], False, False, at)
    rows = [good, ("B", *good[1:]), ("C", "no comma", *good[2:]), ("D", *good[1:6], ["Music", "Bars", "Festivals"], *good[7:])]
    stored = spark.createDataFrame([("B", "2025-01-01", "V")], "title string, date string, venue string")
    got = events.submit(spark.createDataFrame(rows, columns), stored, F.lit("austinEvents")).collect()
    assert [(r.title, r.collection) for r in got] == [("A", "austinEvents")]
    got = {r.title: r for r in events.validate(spark.createDataFrame(rows, columns)).collect()}
    assert got["A"].valid and not got["C"].valid and got["D"].errors == ["maximum 2 categories allowed"]
    r = events.canonical(spark.createDataFrame([(" A  b ", "1 St, Austin", "1")], "title string, address string, free string"), "2025-02-03").first()
    assert (r.title, r.city, r.date, r.startTime, r.free, r.soldOutStatus, r.venue) == ("A b", "Austin", "2025-02-03", "19:00:00", True, False, "")


def test_dedupe_scores_and_images(spark):
    rows = spark.createDataFrame([("1", True), ("2", False)], "event_id string, x boolean")
    stored = spark.createDataFrame([("events/1/event_image.jpg",), ("events/2/notes.txt",)], "path string")
    assert {r.event_id: r.has_image for r in dedupe.with_images(rows, stored).collect()} == {"1": True, "2": False}
    c = spark.createDataFrame([(1, 1, "http://a/x_thumb.jpg", 5.0), (1, 2, "http://a/x.jpg?w=1", 9.0), (1, 3, "http://a/y.jpg", 9.0), (2, 1, "http://a/z.jpg", None)], "event_id int, ord int, url string, score double")
    assert {r.event_id: r.url for r in images.best_image(c).collect()} == {1: "http://a/x.jpg?w=1", 2: "http://a/z.jpg"}
    assert sorted(r.ord for r in images.distinct_images(c).filter("event_id = 1").collect()) == [1, 3]
    assert images.first_of_url(c.unionByName(c)).count() == 4 and [r.ord for r in images.positive(c).orderBy("rank").filter("event_id = 1").collect()] == [2, 3, 1]
    sized = c.withColumns({"title": F.lit(""), "venue": F.lit(""), "width": F.lit(900), "height": F.lit(900)}).drop("score")
    assert images.scored_images(sized).count() == 4 and {r.event_id for r in images.best_for_ocr(sized).collect()} <= {1, 2}
    one = spark.range(1).select(image_functions.selector_priority(F.lit("og:image")).alias("a"), image_functions.analysis(F.lit("nothing")).alias("b"), image_functions.analysis(F.lit("http://a/event_large.png")).alias("c")).first()
    assert one.a == 100 and one.b is None and (one.c.extension, one.c.high_res, one.c.priority) == ("png", True, 35)


def test_quality_of_results(spark):
    now = spark.createDataFrame([("speed", 120.0, False), ("share", 80.0, True), ("other", 1.0, True), ("same", 101.0, True)], "metric string, value double, higher_is_better boolean")
    base = spark.createDataFrame([("speed", 100.0), ("share", 60.0), ("same", 100.0)], "metric string, value double")
    assert {r.metric: r.status for r in quality.regressions(now, base).collect()} == {"speed": "regression", "share": "improvement", "other": "new", "same": "stable"}
    seen = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), ("a", 4)], "issue string, ord int")
    assert quality.most_frequent(seen, "issue").first().issue == "b"  # of equals the one first seen last
    r = spark.createDataFrame([(10.0, 1), (15.0, 2), (20.0, 3)], "v double, o int").agg(quality.growth(F.col("v"), F.col("o")).alias("g"), quality.completeness(["v"])["v"].alias("c")).first()
    assert (r.g, r.c) == (100.0, 100.0)
    f = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert [f(quality.leak_risk(F.lit(x))) for x in (60, 30, 5)] == ["HIGH", "MEDIUM", "LOW"] and f(quality.speed_score(F.lit(250.0), 1000.0)) == 75
    assert [f(quality.title_quality(F.lit(x))) for x in ("", "abc", "A fine title", "undefined thing")] == [0, 70, 100, 50]
    assert f(quality.error_class(F.lit("x"), F.lit("timeout"))) == "network" and abs(f(quality.weighted_total({"a": F.lit(80.0), "b": F.lit(0.0)}, {"a": 0.35, "b": 0.2})) - 80) < 1e-9
    empty = spark.createDataFrame([], "passed boolean, x double")
    r = empty.agg(quality.pass_rate(F.col("passed"), 75).alias("p"), quality.mean_or_zero(F.col("x")).alias("m"), quality.rounded_mean(F.col("x")).alias("n")).first()
    assert (r.p, r.m, r.n) == (75, 0, 0)
    assert quality.mean_consistency(spark.createDataFrame([("one", "x")], "input string, d string"), ["d"]).first().consistency == 100
    assert requests.hit_rate(spark.createDataFrame([(True,), (False,), (True,)], "hit boolean")).first().hit_rate == "66.67%" and requests.hit_rate(spark.createDataFrame([], "hit boolean")).first().hit_rate == "0%"


def test_running_totals_over_ranges(spark):
    rows = spark.createDataFrame([(i % 2, (i * 37) % 200, i) for i in range(200)], "k int, v int, i int").repartition(7)
    got = ranks.running(rows, ["k"], "v").collect()
    for k in (0, 1):
        own = sorted(r.v for r in got if r.k == k)
        assert {r.v: r._upto for r in got if r.k == k} == {v: i + 1 for i, v in enumerate(own)} and {r._total for r in got if r.k == k} == {100}
    log = spark.createDataFrame([(1, "a", 1000), (2, "a", 4000), (3, "a", 9_000_000), (4, "b", 5)], "id int, domain string, timestamp long")
    assert {r.id: r.gap_ms for r in requests.waits(log, 2000, 3_600_000).collect()} == {1: None, 2: 3000, 3: 8_996_000, 4: None}
    assert requests.next_proxy(spark.createDataFrame([("slow", 0, 0, 1), ("fast", 0, 5, 2), ("bad", 1, 1, 3)], "p string, failures int, response_time int, ord int")).first().p == "fast"


def test_texts_prices_and_categories(spark):
    f = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert f(text.composite_key(F.lit(" A  B "), F.lit(""), F.lit("c"))) == "a b|c"
    words = {"Music": ["concert"]}
    assert f(categories.smart_categories(F.lit("A concert"), F.lit(""), F.lit(""), words)) == ["Music"] and f(categories.smart_categories(F.lit("x"), F.lit(""), F.lit("The Pub"), words)) == ["Bars"]
    assert f(prices.matched_price(F.lit("from $12.50"), F.lit("from_price"))).price == 12.5 and f(prices.matched_price(F.lit("free"), F.lit("free"))).free and f(prices.matched_price(F.lit("x"), F.lit("dollar"))) is None
    assert f(events.specific_dates(F.lit("2025-01-31, 2025-02-28"))) == [datetime.date(2025, 1, 31), datetime.date(2025, 2, 28)] and f(events.specific_dates(F.lit("2025-01-31, soon"))) is None
    assert f(events.rename_category(F.array(F.lit("Art Events"), F.lit("Bars")))) == ["Art Shows", "Bars"] and f(events.categories_problem(F.array().cast("array<string>"))) == "at least one category is required"


def test_readers_and_writers(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    spark.createDataFrame([(1, None)], "id int, collection string").write.parquet(a)
    spark.createDataFrame([(2,)], "id int").write.parquet(b)
    assert sorted((r.id, r.collection) for r in readers.collections(spark, {"events": a, "austinEvents": b}).collect()) == [(1, "events"), (2, "austinEvents")]
    listing = spark.createDataFrame([("events/1/x.png",), ("events/loose",)], "path string")
    assert [(r.collection, r.event_id, r.file) for r in readers.listing_parts(listing).collect()] == [("events", "1", "x.png")]
    rows = spark.createDataFrame([("a, b", 1, None), ('say "x"', 2, "y")], "s string, n int, t string")
    assert [r.line for r in writers.csv_lines(rows).collect()] == ['"a, b",1,', 'say "x",2,y']
    writers.csv_report(rows.coalesce(1), str(tmp_path / "c"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "c")).collect()) == sorted(["s,n,t", '"a, b",1,', 'say "x",2,y'])
    content = "A | http://x\n1 Main St, Austin, TX\nB | http://y\n2 Oak Ave, Oakland, CA\na | http://z\n9 Elm Rd, Austin, TX\n"
    got = {r.key: (r.name, r.address, r.ord) for r in readers.venue_list(spark.createDataFrame([("list", content)], "source string, content string")).collect()}
    assert got == {"a": ("a", "9 Elm Rd, Austin, TX", 0), "b": ("B", "2 Oak Ave, Oakland, CA", 2)}  # the last one's values in the first one's place


def test_a_mean_of_a_half_in_any_order(spark):
    """26.5, 58/3 and 58/3 weigh 2, 2, 1 and a field of 0 weighs 1: 18.5 exactly, which sums of doubles give or miss by their order."""
    fields = [("title", 26.5), ("date", 58 / 3), ("venue", 58 / 3), ("tags", 0.0)]
    for order in itertools.permutations(fields):
        rows = spark.createDataFrame([(1, *f) for f in order], "page_id long, field string, confidence double").coalesce(1)
        assert layers.overall_confidence(rows).first().overall == 19
