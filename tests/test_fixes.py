from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from marquee.functions import fixes
from marquee.operators import events, layers, requests, validation


def one(spark, value, build):
    return spark.createDataFrame([(value,)], "x string").select(build(F.col("x")).alias("r")).first().r


def test_titles_and_values(spark):
    get = lambda v: tuple(one(spark, v, lambda x: fixes.fix_title(x, F.lit("Hall"))))
    assert get(None) == ("Event at Hall", 50, "default") and get(" a  b ") == ("a b", 95, "white space") and get("ok") == ("ok", 100, "")
    assert get("x" * 101) == ("x" * 97 + "...", 80, "truncated")
    for field, value, want in (("title", "ab", False), ("price", "free", True), ("image", "a.png?x", True), ("date", "5/6", True), ("time", "7 pm", True), ("other", "x", True), ("other", " ", False), ("description", "short", False)):
        assert one(spark, value, lambda x, f=field: fixes.valid_value(F.lit(f), x)) is want, (field, value)


def test_inferred_category(spark):
    mapping = {"music": "Music", "bar": "Bars", "cocktail": "Bars"}
    get = lambda v: one(spark, v, lambda x: fixes.infer_category(x, mapping))
    assert tuple(get("music bar")) == ("Music", 75) and tuple(get("cocktail bar music")) == ("Bars", 90) and get("none") is None and get(None) is None


def test_confidences(spark):
    as_of = F.lit("2025-01-10").cast("date")
    adj = lambda f, v: one(spark, v, lambda x: fixes.adjusted_confidence(F.lit(f), x, F.lit(80.0), as_of))
    assert adj("title", "abc") == 56 and round(adj("date", "2025-02-01")) == 88 and adj("date", "2020-01-01") == 64 and round(adj("address", "a, b")) == 88
    assert one(spark, "Blue Club", lambda x: fixes.flyer_venue_confidence(x, F.lit(60))) == 85
    assert one(spark, "Doors at 7", lambda x: fixes.flyer_time_confidence(F.lit(19), x, F.lit(60))) == 90
    assert one(spark, "12 Oak St", fixes.flyer_address_valid) and not one(spark, "Oak St 12", fixes.flyer_address_valid)
    assert one(spark, "https://cdn.x/concert_hall.webp", lambda x: fixes.image_context_score(x, F.lit("The Hall"))) == 35
    assert one(spark, "https://cdn.x/a.webp", lambda x: fixes.image_quality_score(x, ["cdn."])) == 40


def test_validation_and_repeats(spark):
    df = spark.createDataFrame([("A", "1 St, X", ["Music"], "19:00:00"), ("A", "1 St", ["Music", "Bars", "Odd"], "7pm"), (None, None, [], None)], "title string, address string, categories array<string>, startTime string")
    errors = [r.errors for r in events.validate(df).collect()]
    missing = [e for e in errors[0] if not e.startswith("Missing")]
    assert missing == [] and "address must contain a comma (format: \"Street, City\")" in errors[1] and "maximum 2 categories allowed" in errors[1] and any(e.startswith("invalid category: Odd") for e in errors[1])
    assert "at least one category is required" in errors[2] and "Missing required field: title" in errors[2]
    day = spark.createDataFrame([(datetime.date(2025, 1, 31),)], "d date")
    got = [r.repeat_date for r in events.repeats(day, F.col("d"), F.lit("monthly"), F.lit(2), F.lit(None).cast("int")).orderBy("i").collect()]
    assert got == [datetime.date(2025, 3, 3), datetime.date(2025, 3, 31)]


def test_objects_and_cache(spark):
    rows = spark.createDataFrame([(1, 1, "geo", "object", {"a": "1", "b": "2"}, 90.0), (1, 2, "geo", "object", {"a": "9"}, 50.0)], "page_id long, layer int, field string, kind string, object map<string,string>, confidence double")
    assert layers.merged_objects(rows).first().object == {"a": "9", "b": "2"}
    cache = spark.createDataFrame([("u", "x", 100, 1, 5), ("u", "y", 200, 2, 1), ("v", "z", 50, 3, 0)], "url string, data string, timestamp long, ord long, hits long")
    assert {(r.url, r.data, r.hits) for r in requests.last_write(cache).collect()} == {("u", "y", 0), ("v", "z", 0)}
    assert requests.fresh(cache, 200, 100).count() == 1 and requests.expired(cache, 200, 100).count() == 1
    assert requests.cache_stats(cache.limit(0)).first().hits is None
    proxies = spark.createDataFrame([(1, 3, 5), (2, 1, None), (3, 1, 900)], "ord long, failures long, response_time long")
    assert requests.next_proxy(proxies).first().ord == 3


def test_venues(spark):
    from marquee.operators import venues

    known = venues.known_array(spark.createDataFrame([(1, "The Blue Note", "1 A St, Austin, TX"), (2, "Fillmore", "9 B Ave, San Francisco, CA")], "ord int, name string, address string"))
    get = lambda v, c="": one(spark, v, lambda x: venues.lookup(x, F.lit(c), known))
    assert get("the blue-note") == "1 A St, Austin, TX" and get("Fill") == "9 B Ave, San Francisco, CA" and get("Fill", "Austin") is None and get(None) is None
    near = one(spark, "Filmore", lambda x: venues.near_names(x, known))
    assert [r.name for r in near] == ["Fillmore"]
    better = lambda v: one(spark, v, lambda x: venues.better_address(x, F.lit("Fillmore"), F.lit(""), known))
    assert better("12 Oak St") == "12 Oak St, Austin, TX" and better("downtown") == "9 B Ave, San Francisco, CA"
    assert one(spark, "https://www.songkick.com/x", lambda x: venues.site_type(x, [("songkick", "songkick")])) == "songkick"
    assert one(spark, "Are you a ROBOT?", lambda x: venues.looks_blocked(x, F.lit("")))


def test_located_venues(spark):
    from marquee.operators import locating

    texts = [
        ("Jazz at  The blue note, 1 A St, Austin", ("Blue Note", "1 A St, Austin", 0.8, "pattern")), ("Grand Hall, 5 Oak St, Oakland", ("Grand Hall", "5 Oak St, Oakland", 0.7, "structure")), ("Blue Fox, Oakland", ("Blue Fox", "Oakland", 0.6, "structure")),
        ("big club group", ("Big Club Group", "big club group, San Francisco, CA", 0.63, "keyword")), ("The Owl Kyle", ("Owl", "Kyle", 0.5, "context")), ("12 Oak Ave", ("", "12 Oak Ave, San Francisco, CA", 0.3, "fallback")), ("(foo XYZ", ("(Foo Xyz", "San Francisco, CA", 0.2, "fallback")),
        (None, ("", "", 0.0, "unknown")), (" \t", ("", "", 0.0, "unknown")),
    ]
    rows = spark.createDataFrame([(i, t, 0) for i, (t, _) in enumerate(texts)], "id long, x string, venue int")
    got = {r.id: (r.venue, r.address, r.confidence, r.strategy) for r in locating.located(rows, "x").collect()}
    assert locating.located(rows.limit(0), "x").count() == 0
    bad = [(texts[i][0], got[i], w) for i, (_, w) in enumerate(texts) if got[i] != w]
    assert not bad, bad


def test_keywords_are_walked_once(spark):
    """The plan of an event's categories looks through the keywords once for those given and once for the words, however many fixes take the outcome."""
    rows = spark.createDataFrame([(1, [" concert ", "Music", "zzz"], "a"), (2, ["zzz"], "dance club by the bar"), (3, None, "x"), (4, ["Music", "Bars", "concert"], "x")], "id long, categories array<string>, words string")
    mapping = {"concert": "Music", "bar": "Bars", "dance club": "Nightclubs"}
    out = rows.select("id", validation.fixed_categories(F.col("categories"), F.col("words"), mapping).alias("c")).select("id", "c.value", "c.fixes", "c.wrong")
    assert str(out._jdf.queryExecution().optimizedPlan()).lower().count("contains(") <= 9
    got = {r.id: (r.value, [(f.reason, f.confidence) for f in r.fixes], r.wrong) for r in out.collect()}
    assert got[1] == (["Music"], [("mapped", 95), ("repeats removed", 90)], ["zzz"]) and got[2] == (["Nightclubs"], [("inferred", 90)], ["zzz"])
    assert got[3] == (["Music"], [("default", 30)], []) and got[4] == (["Music", "Bars"], [("mapped", 95), ("limited to 2", 80)], [])
