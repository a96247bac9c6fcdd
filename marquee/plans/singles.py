"""Queries on scores and checks of single values: texts come from documents, numbers from orders, line items and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.functions import categories, fixes, images, text, validators
from marquee.operators import dedupe, events, quality, venues
from marquee.plans import derive
from marquee.plans.registry import query
from marquee.session import table

#: (The engines differ on the upper case of ß.)
_PIECE = "substr(replace(coalesce(text, ''), 'ß', 's'), 1 + doc_id % 7, doc_id % 140)"
_YES = lambda c, n: f"CASE WHEN {c} THEN {n} ELSE 0 END"


def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A piece of each document, up to 139 characters."""
    return table(spark, sf_dir, "documents").selectExpr("doc_id AS id", "lang", "source", f"{_PIECE} AS t")


_PIECES = f"(SELECT doc_id AS id, lang, source, {_PIECE} AS t FROM documents)"


@query(
    "text_scores",
    rf"""SELECT id, CAST(CASE WHEN t = '' THEN 0 ELSE 100 - {_YES('length(t) < 5', 30)} - {_YES('length(t) > 100', 20)} - {_YES("contains(t, 'undefined') OR contains(t, 'null')", 50)} END AS INT) AS title_quality,
    array_to_string(list_transform(regexp_extract_all(t, '[ \t\n\x0B\f\r]|[^ \t\n\x0B\f\r]+'), lambda w: upper(w[1]) || w[2:]), '') AS capitalized,
    length(t) BETWEEN 3 AND 80 AND regexp_matches(t, '[a-zA-Z]{{2,}}') AND NOT regexp_matches(lower(t), 'tickets|info|more|details|call|visit|website') AS venue_valid,
    length(t) BETWEEN 8 AND 150 AND regexp_matches(t, '^[0-9]+') AND regexp_matches(t, 'St|Ave|Rd|Road|Blvd|Boulevard|Dr') AS address_valid,
    CAST(greatest(0, least(100, 60 + {_YES("regexp_matches(lower(t), 'theater|theatre|hall|center|club|bar|arena|stadium')", 15)} + {_YES("regexp_matches(t, '^[A-Z]')", 5)} + {_YES("regexp_matches(t, '[A-Z].*[A-Z]')", 5)})) AS INT) AS venue_confidence,
    CASE WHEN regexp_matches(lower(t || ' ' || lang), 'bar|pub|tavern') THEN 'Bars' WHEN contains(lower(t), 'club') AND NOT contains(lower(t), 'comedy') THEN 'Nightclubs' WHEN regexp_matches(lower(t), 'restaurant|cafe|food') THEN 'Food Events' WHEN regexp_matches(lower(t), 'theater|theatre|hall') THEN 'Music'
      WHEN regexp_matches(lower(t), 'gallery|museum') THEN 'Art Shows' ELSE 'Music' END AS fallback FROM {_PIECES}""",
)
def text_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("t")
    return pieces(spark, sf_dir).select(
        "id", quality.title_quality(t).alias("title_quality"), text.capitalized(t).alias("capitalized"), fixes.flyer_venue_valid(t).alias("venue_valid"), fixes.flyer_address_valid(t).alias("address_valid"),
        fixes.flyer_venue_confidence(t, F.lit(60)).alias("venue_confidence"), categories.fallback(t, F.col("lang")).alias("fallback"),
    )


_FOLD = r"trim(regexp_replace(lower({}), '[\s\x{{00A0}}]+', ' ', 'g'))"


@query(
    "title_scores",
    rf"""WITH t AS (SELECT id, t AS f, trim(substr(t, 1 + id % 20, id % 50)) AS t, source FROM {_PIECES})
    SELECT id, CAST(greatest(0, 50 + {_YES("regexp_matches(t, '^[A-Z]')", 5)} + {_YES('length(t) BETWEEN 10 AND 60', 10)} + {_YES(r"regexp_matches(t, '[&]|feat\.|featuring|with|presents')", 5)} + {_YES("strpos(f, t) - 1 < length(f) * 0.2", 10)} - {_YES("regexp_matches(t, '[0-9]{4}')", 5)}
      - {_YES(r"regexp_matches(t, '\$[0-9]')", 10)} - {_YES("len(string_split(t, ' ')) > 12", 10)}) AS INT) AS confidence,
    concat_ws('|', nullif({_FOLD.format('t')}, ''), nullif({_FOLD.format('source')}, ''), nullif({_FOLD.format("substr(f, 1, 5)")}, '')) AS key FROM t WHERE f <> ''""",
)
def title_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pieces(spark, sf_dir).filter("t <> ''").selectExpr("id", "t AS f", "trim(substr(t, 1 + id % 20, id % 50)) AS t", "source")
    return rows.select("id", fixes.flyer_title_confidence(F.col("t"), F.col("f"), F.lit(50)).alias("confidence"), text.composite_key(F.col("t"), F.col("source"), F.substring("f", 1, 5)).alias("key"))


@query(
    "valid_values",
    r"""WITH v AS (SELECT o_orderkey AS id, o_orderkey % 8 AS f, CASE o_orderkey % 5 WHEN 0 THEN o_comment WHEN 1 THEN CAST(o_custkey AS VARCHAR) WHEN 2 THEN ' ' || substr(o_comment, 1, o_orderkey % 12) WHEN 3 THEN o_comment || CASE WHEN o_custkey % 2 = 0 THEN ' at ' || o_custkey % 24 || ':30 for $' || o_custkey ELSE ' pic.JPG?x' END ELSE strftime(o_orderdate, '%Y-%m-%d') END AS v FROM
      (SELECT o_orderkey, o_custkey, o_orderdate, o_orderpriority || ' ' || o_orderstatus || ' ' || o_totalprice AS o_comment FROM orders)), t AS (SELECT id, f, trim(v) AS v FROM v)
    SELECT id, v <> '' AND CASE f WHEN 0 THEN length(v) BETWEEN 3 AND 200 WHEN 1 THEN length(v) BETWEEN 10 AND 2000 WHEN 2 THEN length(v) BETWEEN 3 AND 300 WHEN 3 THEN regexp_matches(v, '(?i)[$€£¥₹]|\bfree\b|\b\d+\b') WHEN 4 THEN regexp_matches(v, '(?i)\.(jpg|jpeg|png|webp|gif)(\?|$)') OR contains(v, 'image') OR contains(v, 'img')
      WHEN 5 THEN regexp_matches(v, '(?i)\d{4}|\d{1,2}/\d{1,2}|\d{1,2}-\d{1,2}|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec') WHEN 6 THEN regexp_matches(v, '(?i)\d{1,2}:\d{2}|\d{1,2}\s*(am|pm)') ELSE true END AS valid FROM t""",
)
def valid_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "o_orderpriority || ' ' || o_orderstatus || ' ' || o_totalprice"
    value = f"CASE o_orderkey % 5 WHEN 0 THEN {said} WHEN 1 THEN CAST(o_custkey AS STRING) WHEN 2 THEN ' ' || substr({said}, 1, o_orderkey % 12) WHEN 3 THEN {said} || CASE WHEN o_custkey % 2 = 0 THEN ' at ' || o_custkey % 24 || ':30 for $' || o_custkey ELSE ' pic.JPG?x' END ELSE date_format(o_orderdate, 'yyyy-MM-dd') END"
    field = derive.pick(F.col("o_orderkey"), ["title", "description", "venue", "price", "image", "date", "time", "other"])
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), fixes.valid_value(field, F.expr(value)).alias("valid"))


@query(
    "adjusted_scores",
    r"""WITH v AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS d, o_custkey AS c, 20 + o_custkey % 90 AS base, o_orderkey % 5 AS f FROM orders), a AS (SELECT *, date_diff('day', DATE '1996-06-01', d) AS days FROM v)
    SELECT id, CAST(greatest(0.0, least(100.0, base * CASE f WHEN 0 THEN CASE WHEN c % 200 < 5 THEN 0.7 WHEN c % 200 > 150 THEN 0.8 ELSE 1.0 END WHEN 1 THEN CASE WHEN days BETWEEN -30 AND 365 THEN 1.1 ELSE 0.8 END WHEN 2 THEN CASE WHEN c % 2 = 0 THEN 1.1 ELSE 1.0 END
      WHEN 3 THEN CASE WHEN c % 3 = 0 THEN 1.05 ELSE 0.9 END ELSE 1.0 END)) AS DECIMAL(9, 4)) AS adjusted, days BETWEEN -30 AND 365 AS near, days > 0 AS upcoming,
    CAST(greatest(0, least(100, 50 + CASE WHEN c % 24 >= 18 OR c % 24 <= 2 THEN 10 WHEN c % 24 BETWEEN 10 AND 16 THEN 5 ELSE 0 END + CASE f WHEN 0 THEN 20 WHEN 1 THEN 15 WHEN 2 THEN 13 WHEN 3 THEN 5 ELSE 0 END)) AS INT) AS time_confidence,
    CAST(greatest(0, least(100, 60 + CASE WHEN c <= 200 THEN 5 ELSE 0 END + CASE WHEN c % 4 = 0 THEN 10 ELSE 0 END + CASE f WHEN 0 THEN 5 WHEN 2 THEN 15 ELSE 0 END)) AS INT) AS price_confidence FROM a""",
)
def adjusted_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c, day, as_of = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderdate").cast("date"), F.lit("1996-06-01").cast("date")
    value = F.when(k % 5 == 0, F.repeat(F.lit("x"), (c % 200).cast("int"))).when(k % 5 == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k % 5 == 2, F.when(c % 2 == 0, "1 A St, B").otherwise("1 A St")).when(k % 5 == 3, F.when(c % 3 == 0, "http://x.example/i.PNG").otherwise("http://x.example/i")).otherwise("other")
    context = derive.pick(k, ["Doors at", "SHOW @", "start at ticket advance", "at", "none"])
    words = derive.pick(k, ["the door", "free entry", "TICKET advance", "plain", ""])
    return table(spark, sf_dir, "orders").select(
        k.alias("id"), fixes.adjusted_confidence(derive.pick(k, ["title", "date", "address", "imageUrl", "x"]), value, 20 + c % 90, as_of).cast("decimal(9,4)").alias("adjusted"), validators.within_range(day, as_of).alias("near"), validators.upcoming(day, as_of).alias("upcoming"),
        fixes.flyer_time_confidence(c % 24, context, F.lit(50)).cast("int").alias("time_confidence"), fixes.flyer_price_confidence(c, c % 4 == 0, words, F.lit(60)).cast("int").alias("price_confidence"),
    )


_URLS = ["http://cdn.example/event/hero_{n}x{n}.jpg", "https://x.example/thumb_{n}.png?w=1", "https://x.example/page/{n}", "https://img.example/{n}_LARGE.webp", "no url {n}", "https://x.example/logo-{n}00x{n}00.GIF?a=b"]
_SELECTORS = ["meta[property=og:image]", ".event-{n} img", ".poster", "#primary", "img", "div.x{n}"]
_URL = f"replace({derive.pick_sql('o_orderkey', _URLS)}, '{{n}}', CAST(o_custkey AS VARCHAR))"
_HIGH, _THUMB = r"_high|_large|_big|_hd|_xl|_original|\d{4,}x\d{4,}", r"_thumb|_small|_mini|_tiny|_xs|thumbnail|thumb|\d{1,3}x\d{1,3}"


@query(
    "url_facts",
    rf"""WITH t AS (SELECT o_orderkey AS id, {_URL} AS u, o_orderkey % 6 AS f FROM orders),
    v AS (SELECT *, regexp_matches(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^\s/?#]+') AND (regexp_matches(u, '(?i)\.(jpg|jpeg|png|gif|webp|svg)(\?.*)?$') OR regexp_matches(u, '(?i)image|img|photo|pic|cdn|media')) AS ok FROM t)
    SELECT id, CASE WHEN ok THEN nullif(lower(regexp_extract(u, '(?i)\.([a-z0-9]+)(?:\?|$)', 1)), '') END AS extension, CASE WHEN ok THEN regexp_matches(u, '(?i){_HIGH}') END AS high_res, CASE WHEN ok THEN regexp_matches(u, '(?i){_THUMB}') END AS thumbnail,
    CASE WHEN ok THEN CAST({_YES(f"regexp_matches(u, '(?i){_HIGH}')", 20)} - {_YES(f"regexp_matches(u, '(?i){_THUMB}')", 30)} + {_YES("regexp_matches(u, '(?i)event|hero|featured|main|primary|banner|poster')", 15)} - {_YES("regexp_matches(u, '(?i)logo|icon|avatar|profile|nav|ad|sponsor')", 25)} + {_YES("regexp_matches(u, '(?i)cdn|cloudfront|amazonaws|imgix|cloudinary')", 5)} AS INT) END AS priority,
    CAST(CASE f WHEN 0 THEN 100 WHEN 1 THEN 80 WHEN 2 THEN 70 WHEN 3 THEN 60 WHEN 4 THEN 10 ELSE 50 END AS INT) AS selector_priority FROM v""",
)
def url_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    put = lambda forms: F.replace(derive.pick(k, forms), F.lit("{n}"), F.col("o_custkey").cast("string"))
    rows = table(spark, sf_dir, "orders").select(k.alias("id"), put(_URLS).alias("u"), put(_SELECTORS).alias("s")).withColumn("a", images.analysis(F.col("u")))
    return rows.select("id", "a.*", images.selector_priority(F.col("s")).alias("selector_priority"))


@query(
    "quality_grades",
    """WITH t AS (SELECT l_orderkey AS id, l_linenumber AS n, CAST(l_quantity AS DOUBLE) AS q, CAST(l_discount * 100 AS DOUBLE) AS d, CAST(l_tax * 1000 AS DOUBLE) AS x FROM lineitem)
    SELECT id, n, CASE WHEN q > 50 THEN 'HIGH' WHEN q > 20 THEN 'MEDIUM' ELSE 'LOW' END AS risk, greatest(0.0, 100 - q / 40 * 100) AS speed,
    CASE WHEN n % 5 = 0 THEN 'network' WHEN n % 5 = 1 AND n % 3 = 0 THEN 'network' WHEN n % 5 = 1 THEN 'parsing' WHEN n % 3 = 0 THEN 'network' WHEN n % 3 = 1 THEN 'parsing' WHEN n % 5 = 2 THEN 'validation' ELSE 'other' END AS class,
    CAST(coalesce((CASE WHEN q <> 0 THEN q * 0.5 ELSE 0 END + CASE WHEN d <> 0 THEN d * 0.3 ELSE 0 END + CASE WHEN x <> 0 THEN x * 0.2 ELSE 0 END) / nullif(CASE WHEN q <> 0 THEN 0.5 ELSE 0 END + CASE WHEN d <> 0 THEN 0.3 ELSE 0 END + CASE WHEN x <> 0 THEN 0.2 ELSE 0 END, 0), 0) AS DECIMAL(12, 4)) AS total FROM t""",
)
def quality_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), n.alias("n"), F.col("l_quantity").cast("double").alias("q"), (F.col("l_discount") * 100).cast("double").alias("d"), (F.col("l_tax") * 1000).cast("double").alias("x"))
    kind, message = derive.pick(F.col("n"), ["network down", "parsing", "validation", "x", "y"]), derive.pick(F.col("n"), ["timeout of it", "cannot parse", "bad"])
    total = quality.weighted_total({"q": F.col("q"), "d": F.col("d"), "x": F.col("x")}, {"q": 0.5, "d": 0.3, "x": 0.2})
    return rows.select("id", "n", quality.leak_risk(F.col("q")).alias("risk"), quality.speed_score(F.col("q"), 40).alias("speed"), quality.error_class(kind, message).alias("class"), total.cast("decimal(12,4)").alias("total"))


_CATS = ["Music", "Bars", "Art Events", "Art Shows", "Films"]


@query(
    "checked_events",
    f"""WITH t AS (SELECT *, list_transform(range(event_id % 4), lambda i: ['Music', 'Bars', 'Art Events', 'Art Shows', 'Films'][1 + (event_id + i) % 5]) AS cats FROM {derive.EVENTS} e),
    c AS (SELECT *, CASE WHEN event_id % 6 = 5 THEN NULL ELSE cats END AS categories FROM t)
    SELECT event_id, (categories IS NOT NULL)::INT AS has_categories, CASE WHEN categories IS NULL OR len(categories) = 0 THEN 'at least one category is required' WHEN len(categories) > 2 THEN 'maximum 2 categories allowed' WHEN len(list_filter(categories, lambda x: x IN ('Films', 'Art Events'))) > 0 THEN 'invalid category' END AS problem,
    array_to_string(list_transform(categories, lambda x: CASE WHEN x = 'Art Events' THEN 'Art Shows' ELSE x END), ',') AS renamed,
    CAST(4 + (categories IS NULL)::INT + (address <> '' AND NOT contains(address, ','))::INT + (startTime <> '' AND NOT regexp_full_match(startTime, '[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}'))::INT + coalesce((len(categories) = 0)::INT, 0) + coalesce((len(categories) > 2)::INT, 0)
      + coalesce(len(list_filter(categories, lambda x: x IN ('Films', 'Art Events'))), 0) AS INT) AS errors FROM c""",
)
def checked_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    cats = F.transform(F.slice(F.array(*(F.lit(i) for i in range(3))), F.lit(1), (k % 4).cast("int")), lambda i: F.get(F.array(*map(F.lit, _CATS)), ((k + i) % 5).cast("int")))
    rows = derive.events(spark, sf_dir).withColumn("categories", F.when(k % 6 != 5, cats))
    checked = events.validate(rows)
    return checked.select("event_id", F.col("categories").isNotNull().cast("int").alias("has_categories"), events.categories_problem(F.col("categories")).alias("problem"), F.array_join(events.rename_category(F.col("categories")), ",").alias("renamed"), F.size("errors").alias("errors"))


@query(
    "canonical_events",
    rf"""SELECT event_id, regexp_replace(regexp_replace(title, '\s+', ' ', 'g'), '^ | $', '', 'g') AS title, CASE WHEN city <> '' THEN city ELSE trim(list_last(string_split(address, ','))) END AS city, CASE WHEN startTime = '' THEN '19:00:00' ELSE startTime END AS startTime,
    CASE WHEN event_id % 5 = 0 THEN '2024-06-01' ELSE date END AS date, event_id % 3 = 0 OR event_id % 7 = 0 AS free, CASE WHEN contains(address, ',') THEN array_to_string(list_filter(list_transform(string_split(address, ','), lambda p: trim(p)), lambda p: p <> ''), ', ')
      ELSE array_to_string(list_filter(list_transform(string_split(address || ', ' || CASE WHEN city = '' THEN 'Austin, TX' ELSE city END, ','), lambda p: trim(p)), lambda p: p <> ''), ', ') END AS tidy, venue || ', ' || CASE WHEN city = '' THEN 'Austin, TX' ELSE city END AS by_default FROM {derive.EVENTS} e""",
)
def canonical_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    rows = derive.events(spark, sf_dir).withColumns({"date": F.when(k % 5 != 0, F.col("date")), "free": F.when(k % 3 == 0, "TRUE").when(k % 7 == 0, "1").otherwise("no")})
    tidy, default = venues.tidy_address(F.col("address"), F.col("city")), venues.default_address(F.col("venue"), F.col("city"))
    # The stored form has no id, so it is taken beside it.
    own = events.canonical(rows.withColumn("description", F.concat_ws("\x01", k.cast("string"), tidy, default)), "2024-06-01")
    part = F.split("description", "\x01")
    return own.select(part[0].cast("long").alias("event_id"), "title", "city", "startTime", "date", "free", part[1].alias("tidy"), part[2].alias("by_default"))


@query(
    "submitted_events",
    f"""WITH c AS (SELECT * FROM {derive.EVENTS} e WHERE (address = '' OR contains(address, ',')) AND (startTime = '' OR regexp_full_match(startTime, '[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}')) AND event_id % 4 BETWEEN 1 AND 2),
    s AS (SELECT DISTINCT title, date, venue FROM {derive.EVENTS} e WHERE event_id % 9 = 0)
    SELECT c.event_id, CASE WHEN c.event_id % 2 = 0 THEN 'austinEvents' ELSE 'bayAreaEvents' END AS collection FROM c WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.title = c.title AND s.date = c.date AND s.venue = c.venue)""",
)
def submitted_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    all_ = derive.events(spark, sf_dir)
    cats = F.slice(F.array(F.lit("Music"), F.lit("Bars"), F.lit("Bars")), F.lit(1), (k % 4).cast("int"))
    whole = all_.withColumns({"categories": cats, "startDateTimestamp": F.lit(0), "free": F.lit(False), "soldOutStatus": F.lit(False), "createdAt": F.lit(0)})
    return events.submit(whole, all_.filter(k % 9 == 0), F.when(k % 2 == 0, "austinEvents").otherwise("bayAreaEvents")).select("event_id", "collection")


@query(
    "event_points",
    f"""SELECT event_id, CAST({_YES("title <> ''", 10)} + {_YES("address <> ''", 10)} + 10 + {_YES("startTime <> ''", 10)} + {_YES("event_id % 3 = 0", 10)} + {_YES("has_image", 20)} + {_YES("event_id % 5 < 2", 15)} + event_id % 17 + 2 * greatest(event_id % 11 - 3, 0) AS BIGINT) AS points FROM {derive.EVENTS} e""",
)
def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    none = F.lit(None).cast("string")
    event = {f: F.col(f) for f in ("title", "address", "venue", "startTime")} | {"categories": F.when(k % 3 == 0, F.array(F.lit("Music"))), "ticketsLink": none, "imageUrl": F.when(F.col("has_image"), "i.jpg"), "businessUserId": F.when(k % 5 == 0, "b"), "createdBy": F.when(k % 5 == 1, "c").otherwise("")}
    return derive.events(spark, sf_dir).select("event_id", dedupe.completeness(event, k % 17, k % 11 - 3).cast("long").alias("points"))


@query(
    "events_with_images",
    f"SELECT event_id, event_id % 4 < 2 AS has_image FROM {derive.EVENTS} e",
)
def events_with_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    path = F.concat(F.lit("events/"), k.cast("string"), F.when(k % 4 == 0, "/event_image.png").when(k % 4 == 1, "/event_image.jpg").when(k % 4 == 2, "/other_image.png").otherwise("/deep/event_image.png"))
    listing = table(spark, sf_dir, "orders").select(F.explode(F.array(path, F.replace(path, F.lit("events/"), F.lit("drafts/")))).alias("path"))
    rows = derive.events(spark, sf_dir).withColumn("event_id", F.col("event_id").cast("string"))
    return dedupe.with_images(rows, listing).select(F.col("event_id").cast("long").alias("event_id"), "has_image")
