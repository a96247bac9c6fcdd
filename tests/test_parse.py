from __future__ import annotations

from pyspark.sql import functions as F

from marquee.functions import categories, parse, places, text, venues
from marquee.operators import matches
from marquee.sources import readers

AS_OF = "2025-01-10"


def one(spark, value, build):
    return spark.createDataFrame([(value,)], "x string").select(build(F.col("x")).alias("r")).first().r


def day(s=AS_OF):
    return F.lit(s).cast("date")


def found(spark, texts, fields, rows=None):
    """Distinct ranked matches by text."""
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    out = {t: [] for t in texts}
    for r in sorted(matches.extract(df, day(), fields).collect(), key=lambda r: (r.id, r.rank)):
        out[texts[r.id]].append(r)
    return out


def test_dates(spark):
    want = {
        "Show on January 15, 2025!": [((2025, 1, 15), "fullMonth", 1.0)], "jan 20": [((2025, 1, 20), "abbrMonth", 0.9)], "1/15/25": [((2025, 1, 15), "numeric", 0.9)], "25/12/2025": [((2025, 12, 25), "numeric", 0.9)],
        "3rd of March 2025": [((2025, 3, 3), "ordinal", 1.0)], "tonight": [((2025, 1, 10), "relative", 1.0)], "Tomorrow": [((2025, 1, 11), "relative", 1.0)],
        # Without a year, this year is meant, and being nearer is surer.
        "March 5, 2020": [((2025, 3, 5), "fullMonth", 1.0), ((2020, 3, 5), "fullMonth", 0.6)],
        # 2025-01-10 is a Friday: this Friday is a week on, next Monday counts from Sunday.
        "this friday": [((2025, 1, 17), "relative", 1.0)], "next Monday": [((2025, 1, 13), "relative", 1.0)], "next saturday": [((2025, 1, 18), "relative", 1.0)], "this sunday": [((2025, 1, 12), "relative", 1.0)],
        "Fri Jan 17": [((2025, 1, 17), "dayOfWeek", 1.0)], "Friday 15": [], "February 30, 2025": [], "31/31/25": [], "": [],
    }
    got = found(spark, list(want), ["date"])
    for t, rows in want.items():
        assert [((r.date.year, r.date.month, r.date.day), r.family, round(r.confidence, 4)) for r in got[t]] == rows, t
    got = spark.range(1).select(matches.weekday_and_number(F.lit("thursday"), F.lit(31), day()).alias("a"), matches.weekday_and_number(F.lit("friday"), F.lit(10), day()).alias("b")).first()
    assert (str(got.a), str(got.b)) == ("2025-07-31", "2025-10-10")


def test_times(spark):
    want = {
        "8:30 PM": [(20, 30, "standard", 1.0), (8, 30, "standard", 1.0)], "12am": [(0, 0, "standard", 1.0)], "at 20:15": [(20, 15, "standard", 1.0)], "Doors 7": [(19, 0, "doors", 1.0)],
        "around 9": [(21, 0, "approximate", 0.855)], "2025": [(20, 25, "standard", 1.0)], "7-9PM": [(21, 0, "standard", 1.0), (7, 0, "range", 0.8)], "show at 4": [(16, 0, "show", 0.9)], "13 PM": [], "no time": [],
        "8:00pm - 11:00pm": [(20, 0, "standard", 1.0), (23, 0, "standard", 1.0), (20, 0, "range", 1.0)],
    }
    got = found(spark, list(want), ["time"])
    for t, rows in want.items():
        assert [(r.hour, r.minute, r.kind, round(r.confidence, 4)) for r in got[t]] == rows, t
    assert [r.end_hour for r in got["7-9PM"] if r.kind == "range"] == [21]
    clock = lambda v: one(spark, v, parse.clock_time)
    assert [clock(v) for v in ("7:05 pm", "12:10 AM", "x", None)] == ["19:05:00", "00:10:00", "19:00:00", "19:00:00"]


def test_prices(spark):
    want = {
        "Free entry": [(0, 0, "free", 0.9)], "$25": [(25, 25, "single", 0.7)], "USD 25": [], "15 bucks": [(15, 15, "single", 0.7)], "$20 - $35.50": [(20, 35.5, "range", 0.95), (20, 20, "single", 0.7), (35.5, 35.5, "single", 0.7)],
        "$30-$10": [(30, 30, "single", 0.7), (10, 10, "single", 0.7)], "from $15": [(15, None, "starting", 0.9), (15, 15, "single", 0.7)], "$25+": [(25, None, "starting", 0.9), (25, 25, "single", 0.7)],
        "up to $50": [(None, 50, "maximum", 0.75), (50, 50, "single", 0.7)], "tickets $12": [(12, 12, "single", 0.7), (12, 12, "contextual", 0.65)], "$9 student": [(9, 9, "single", 0.7), (9, 9, "tiered", 0.6)],
        "$9 door": [(9, 9, "single", 0.7), (9, 9, "timing", 0.6)], "VIP $50": [(50, 50, "single", 0.7)], "from $700": [(700, None, "starting", 0.7), (700, 700, "single", 0.7)],
    }
    got = found(spark, list(want), ["price"])
    for t, rows in want.items():
        own = [(r.least, r.most, r.kind, round(r.confidence, 4)) for r in got[t]]
        assert own == rows, (t, own)
    assert got["$9 student"][1].tier == "student" and got["$9 door"][1].timing == "door" and got["tickets $12"][1].about == "ticket"


def test_venues(spark):
    want = {
        "at The Observatory": [("Observatory", "venue", 1.0)], "live at Blue Note Club": None, "123 Main St": [("123 Main St", "address", 0.8)], "in Chicago, IL": None,
        "at Friday": [], "The Grand Theater": None, "nothing": [],
    }
    got = found(spark, list(want), ["venue"])
    for t, rows in want.items():
        if rows is not None:
            own = [(r.name, r.kind, round(r.confidence, 4)) for r in got[t]]
            assert own[: len(rows)] == rows and (rows or not own), (t, own)
    assert ("Grand Theater", "venue", "theater") in [(r.name, r.kind, r.venue_type) for r in got["The Grand Theater"]]
    assert ("Chicago, IL", "location", "Chicago") in [(r.name, r.kind, r.city) for r in got["in Chicago, IL"]]
    quality = lambda v: round(one(spark, v, venues.name_quality), 4)
    assert [quality(v) for v in ("ab", "The Blue Note", "Grand Hall", "x" * 60)] == [0.5, 1.1, 1.4, 0.8]
    assert [one(spark, v, venues.valid_name) for v in ("Blue Note", "the and", "monday club", "12", "$5 club", "x", None)] == [True, False, False, False, False, False, False]


def test_scores(spark):
    """One price, one date: every factor worked out by hand."""
    df = spark.createDataFrame([(1, "xx $20 - $40"), (2, "Doors 7 show 8"), (3, "Doors 9 show 8")], "id long, text string")
    rows = {(r.id, r.kind, r.least): r.confidence for r in matches.scored(matches.extract(df, day(), ["price", "time"]), day()).collect()}
    # 0.95 of the range, weight 1, passes both rules (1 + 0.075 + 0.05), found at 3 of 12 (under 0.3: 1.1), no capital, no words near: above 1.
    assert rows[1, "range", 20.0] == 1.0
    # 0.7 single * 0.9 * 1.125 * 1.1 for $20; $40 starts at 9 of 12.
    assert abs(rows[1, "single", 20.0] - 0.7 * 0.9 * 1.125 * 1.1) < 1e-9 and abs(rows[1, "single", 40.0] - 0.7 * 0.9 * 1.125) < 1e-9
    # Doors at 0: no place factor; capital 1.1; minute 0 counts as missing: 1 + 0.075 - 0.06. Doors before the show: 1.2.
    assert abs(rows[2, "doors", None] - 1.0 * 0.75 * 1.015 * 1.1 * 1.2) < 1e-9
    assert abs(rows[3, "doors", None] - 1.0 * 0.75 * 1.015 * 1.1 * 0.7) < 1e-9


def test_parse_and_checks(spark):
    df = spark.createDataFrame([(1, "Jazz at Blue Note Club January 15, 2025 8:30 PM $20 - $35"), (2, ""), (3, None), (4, "IlI 000 at Grand Hall tomorrow")], "id long, text string")
    got = {r.id: r for r in matches.parse(df, day()).collect()}
    r = got[1]
    assert (str(r.date), r.hour, r.minute, r.least, r.most, str(r.starts_at)) == ("2025-01-15", 20, 30, 20, 35, "2025-01-15 20:30:00") and r.issues == [] and r.confidence > 0.8
    assert got[2].issues == got[3].issues == ["missing_date", "missing_time", "missing_venue", "low_confidence"] and got[2].confidence == 0
    # Three digits are a time of day too.
    assert got[4].issues == ["poor_ocr_quality"] and (str(got[4].date), got[4].hour, got[4].name) == ("2025-01-11", 0, "at Grand Hall")
    checked = {r.id: r for r in matches.checks(matches.parse(df, F.lit("2025-03-01").cast("date")), F.lit("2025-03-01").cast("date")).collect()}
    assert checked[1].valid and checked[1].warnings == ["date_in_past"] and checked[2].warnings == []
    context = matches.Context(event_type=F.lit("concert"), accuracy=F.lit(0.5))
    by = lambda c: {(r.id, r.field): r.confidence for r in matches.best(matches.scored(matches.extract(df, day()), day(), c)).collect()}
    plain, music = by(None), by(context)
    assert abs(music[1, "time"] / plain[1, "time"] - 1.15) < 1e-9 and abs(music[1, "price"] / plain[1, "price"] - 1.1) < 1e-9 and abs(music[1, "date"] - plain[1, "date"]) < 1e-9
    assert matches.parse(df.limit(0), day()).count() == 0


def test_clean_and_correct(spark):
    assert one(spark, "  8 : 30  pm,,music  $ 5 @Hall", parse.basic_clean) == "8:30 pm, , music $5 Hall"
    assert one(spark, "12 Main St. Jan. 5 free 8 pm", parse.normalize) == "12 Main Street January 5 FREE 8 PM"
    # Traps: slashes go, prices with cents break, only the first pair of a time is joined.
    assert [one(spark, v, parse.basic_clean) for v in ("1/15/25", "$25.50", "8:15:30", None)] == ["1 15 25", "$25. 50", "8:15: 30", ""]
    fix = lambda v: one(spark, v, parse.correct_artifacts)
    assert [fix(v) for v in ("D00RS open frida7", "8Il30", "$25l50", "T1CKETS", "AI", "$2O", "1/l5")] == ["DOORS open FRIDAY", "8:30", "$25.50", "TICKETS", "AM", "$20", "1/15"]
    assert [(c.original, c.corrected) for c in one(spark, "D0ORS C0NCERT", parse.corrections)] == [("D0ORS", "DOORS"), ("C0NCERT", "CONCERT")]
    assert one(spark, "The conert,  tikets here", parse.correct_spelling) == "The concert, tickets here"
    q = one(spark, "Friday January 15 at 8:30 PM, $20", parse.quality)
    assert round(q.score, 4) == 1.32 and q.issues == ["ocr_artifacts_detected"]  # 15 at 8: three short words
    q = one(spark, "ab", parse.quality)
    assert round(q.score, 4) == 0.8 and q.issues == ["no_recognizable_patterns", "very_short_text"]
    assert one(spark, "", parse.quality).issues == ["empty_text"]
    p = one(spark, "Come at 8 PM. Free!", parse.key_phrases)
    assert [(x.type, x.phrase) for x in p] == [("time", "8 PM."), ("price", "Free!"), ("venue", "at 8 PM.")]
    r = parse.preprocess(spark.createDataFrame([("D00RS 8 pm",)], "text string"), spelling=True).first()
    assert (r.cleaned, r.normalized, len(r.corrections)) == ("DOORS 8 pm", "DOORS 8 PM", 1)


def test_categories(spark):
    words = {"Music": ["concert", "band", "live"], "Bars": ["bar", "cocktail"], "Art Shows": ["art", "gallery"]}
    get = lambda v: one(spark, v, lambda x: categories.categories(x, words))
    assert get("Live band concert at the bar with cocktail") == ["Music", "Bars"]
    assert get("gallery party") == ["Art Shows"] and get("") == [] and get(None) == []
    assert one(spark, "The Pub", lambda x: categories.fallback(x, F.lit(""))) == "Bars"


def test_texts(spark):
    assert one(spark, "5125550199", text.format_phone) == "(512) 555-0199" and one(spark, "15125550199", text.format_phone) == "+1 (512) 555-0199"
    assert one(spark, " @ The Blue  Note", venues.clean_name) == "Blue Note" and one(spark, "rock 'n roll o'neil", text.capitalized) == "Rock 'n Roll O'neil"
    assert one(spark, "12 Main Oakland CA", places.ensure_comma) == "12 Main, Oakland CA" and one(spark, "Here", places.ensure_comma) == "Here, Location TBD"


def test_sources(spark):
    content = "﻿Blue Note | https://x.example\n\n12 Main St, Austin, TX 78701\nNo Address | http://y.example\nOther | http://z.example\n5 Oak Ave, Oakland, CA\nBlue note | https://w.example\n9 Elm Rd, Austin, TX\n"
    got = {r.key: (r.name, r.address) for r in readers.venue_list(spark.createDataFrame([("list", content)], "source string, content string")).collect()}
    assert got == {"blue note": ("Blue note", "9 Elm Rd, Austin, TX"), "other": ("Other", "5 Oak Ave, Oakland, CA")}
    html = '<script type="application/ld+json">{"@type":"MusicEvent","name":"A","location":{"name":"V","address":{"streetAddress":"1 St"}},"offers":{"price":"5"}}</script><script type="application/ld+json">{bad</script>'
    rows = readers.json_ld_events(spark.createDataFrame([(1, html)], "page_id int, html string")).collect()
    assert [(r.title, r.location.venue, r.location.address, r.offers.least) for r in rows] == [("A", "V", "1 St", 5.0)]
    assert [r.value for r in readers.url_list(spark.createDataFrame([(" http://a ",), ("# x",), ("",)], "value string")).collect()] == ["http://a"]


def test_words_that_a_form_needs(spark):
    """A form is passed over only where it has no match."""
    import random
    import re

    from marquee.functions import forms
    from marquee.operators.matches import needed

    rng = random.Random(5)
    words = sorted({w for _, ws in forms.NEEDED for w in ws}) + "Tickets FREE entry no cost admission at @ in The Hall Austin, TX March 5 5th of May 7:30 pm 7 - 9pm $12 $0.00 $15+ to $20 as low as up to Under day of DOORS open Starting MONDAY this friday 1/2/2020 1-2-20 Live at Blue Note venue: 12 Main Street 5 bucks".split()
    tried = passed = 0
    for _ in range(3000):
        text = rng.choice([" ", "", ": "]).join(rng.choices(words, k=rng.randrange(1, 9)))
        for _, _, p in forms.ALL:
            if re.search(p, text, re.ASCII):
                own = needed(p)
                assert not own or any(w in text.lower() for w in own), (p, text)
                tried += 1
            else:
                passed += bool(needed(p))
    assert tried > 1000 and passed > 1000


def test_tasks_grow_in_number_not_in_size(spark, monkeypatch):
    from pyspark.sql import functions as F

    from marquee.operators import matches

    monkeypatch.setattr(matches, "TASK_TEXTS", 10)
    texts = spark.range(200).select("id", F.lit("March 5, 2020 at 7 PM").alias("text"))
    plan = matches.extract(texts, F.lit("2020-01-01").cast("date"))._jdf.queryExecution().optimizedPlan().toString()
    assert "], 20" in next(line for line in plan.splitlines() if "RepartitionByExpression" in line), plan
