"""Queries that parse a derived flyer text for every order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.functions import categories, parse
from marquee.functions.common import first_match, fold
from marquee.operators import matches
from marquee.plans.derive import TITLES, pick, pick_sql
from marquee.plans.registry import query
from marquee.session import materialise, table

AS_OF = "1996-06-15"
CLOCKS = ["7:30 PM", "12:05 am", "19:45", "at 9:00pm", "noon", "", "11:15 AM", "12:30 PM"]
WORDS = {
    "Music": ["concert", "band", "live", "jazz", "dj"], "Bars": ["bar", "cocktail", "pub"], "Art Shows": ["art", "gallery", "museum"], "Comedy Shows": ["comedy", "stand-up"], "Food Events": ["food", "tasting", "wine"],
}
LINES = ["Live band and concert at the bar", "Wine tasting with food", "Art gallery opening", "Comedy night, cocktail bar, pub", "Nothing here", "", "Jazz concert with live dj at the art museum", "Stand-up comedy"]


def flyer() -> Column:
    k = F.col("o_orderkey")
    return F.concat_ws(" ", pick(k, TITLES), F.date_format("o_orderdate", "MMMM d, yyyy"), pick(k, CLOCKS), F.concat(F.lit("$"), F.floor("o_totalprice").cast("string")))


def _flyers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), flyer().alias("text"))


def _as_of() -> Column:
    return F.lit(AS_OF).cast("date")


@query("parse_events")
def parse_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = matches.parse(_flyers(spark, sf_dir), _as_of())
    clock = F.when(F.col("hour").isNotNull(), F.format_string("%02d:%02d:00", "hour", "minute"))
    return out.select("id", "date", clock.alias("time"), "least", "most", "name", F.round("confidence", 4).alias("confidence"), "starts_at", F.array_join("issues", ",").alias("issues"))


@query("parse_checks")
def parse_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors and warnings of what was parsed, and how many matches each text had."""
    texts = _flyers(spark, sf_dir)
    # Both sides of the join below count on the matches, which are found once.
    every = materialise(matches.scored(matches.extract(texts, _as_of()), _as_of()), "scored_matches")
    parsed = matches.summary(texts, matches.best(matches.confident(every)))
    more = matches.alternatives(every).groupBy("id").agg(F.count("*").alias("n_alternatives"))
    checked = matches.checks(parsed, _as_of()).select("id", F.array_join("errors", ",").alias("errors"), F.array_join("warnings", ",").alias("warnings"), "valid")
    return checked.join(more, "id", "left").withColumn("n_alternatives", F.coalesce("n_alternatives", F.lit(0)))


def _ranked_sql(rows: str, values: str, key: str) -> str:
    """SQL of the distinct ranked matches among rows (id, ord, key, confidence and values)."""
    return f"""r AS ({rows}), u AS (SELECT *, row_number() OVER (PARTITION BY id, {key} ORDER BY confidence DESC, ord) AS n, min(ord) OVER (PARTITION BY id, {key}) AS f FROM r)
    SELECT id, {values}, round(confidence, 4) AS confidence, CAST(row_number() OVER (PARTITION BY id ORDER BY confidence DESC, f) AS INT) AS rank FROM u WHERE n = 1"""


#: A text for each order: its date in one of these forms, in Spark's and in DuckDB's notation.
DATE_FORMS = [
    ("'Show on ' || {}", "MMMM d, yyyy", "%B %-d, %Y"), ("{}", "MMM d", "%b %-d"), ("'on ' || {} || '!'", "M/d/yyyy", "%-m/%-d/%Y"), ("{}", "EEEE MMMM d yyyy", "%A %B %-d %Y"),
    ("{}", "d'th of' MMMM, yyyy", "%-dth of %B, %Y"), ("'this friday'", "", ""), ("'tomorrow or next monday'", "", ""), ("'Monday 15'", "", ""), ("{}", "M-d-yy", "%-m-%-d-%y"),
]
_SURE = "greatest(0, least(1, {base} + {stated} + CASE WHEN abs({d} - DATE '1996-06-15') <= 365 THEN 0.1 WHEN abs({d} - DATE '1996-06-15') > 730 THEN -0.2 ELSE 0 END - CASE WHEN {d} - DATE '1996-06-15' < -1 THEN 0.2 ELSE 0 END))"


def _date_row(form: str, order: int, family: str, base: float, stated: bool, d: str) -> str:
    return f"SELECT id, {order} AS ord, {family} AS family, {d} AS date, CAST({_SURE.format(base=base, stated=0.1 if stated else 0.0, d=d)} AS DOUBLE) AS confidence FROM t WHERE form IN ({form})"


_THIS_YEAR = "make_date(1996, month(d), day(d))"
_DATE_SQL = " UNION ALL ".join([
    _date_row("0, 3", 0, "'fullMonth'", 0.9, True, "d"), _date_row("0, 3", 1, "'fullMonth'", 0.9, False, _THIS_YEAR), _date_row("3", 8, "'dayOfWeek'", 0.85, True, "d"),
    _date_row("1", 2, "CASE WHEN month(d) = 5 THEN 'fullMonth' ELSE 'abbrMonth' END", "CASE WHEN month(d) = 5 THEN 0.9 ELSE 0.8 END", False, _THIS_YEAR), _date_row("2, 8", 4, "'numeric'", 0.7, True, "d"), _date_row("4", 9, "'ordinal'", 0.85, True, "d"),
    _date_row("5", 5, "'relative'", 0.95, True, "DATE '1996-06-21'"), _date_row("6", 5, "'relative'", 0.95, True, "DATE '1996-06-16'"), _date_row("6", 6, "'relative'", 0.95, True, "DATE '1996-06-17'"),
])


@query(
    "date_matches",
    f"WITH t AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS d, o_orderkey % {len(DATE_FORMS)} AS form FROM orders), " + _ranked_sql(_DATE_SQL, "family, date", "date"),
)
def date_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    said = first_match([(k % len(DATE_FORMS) == i, F.expr(text.format(f"date_format(o_orderdate, '{shape.replace(chr(39), chr(92) + chr(39))}')"))) for i, (text, shape, _) in enumerate(DATE_FORMS)], F.lit(""))
    texts = table(spark, sf_dir, "orders").select(k.alias("id"), said.alias("text"))
    return matches.extract(texts, _as_of(), ["date"]).select("id", "family", "date", F.round("confidence", 4).alias("confidence"), "rank")


#: Texts by form, over the hour h (1 to 12), the minute m (two digits) and the period p.
TIME_FORMS = ["{h}:{m} {p}", "Doors {h}", "show at {h}:{m}", "around {h}{p}", "{h}-11PM", "2015 hrs", "at {h} {p}", "nothing"]
_FULL = "CASE WHEN p = 'PM' AND h <> 12 THEN h + 12 WHEN p = 'AM' AND h = 12 THEN 0 ELSE h END"
_EVENING = "CASE WHEN h = 12 THEN 12 ELSE h + 12 END"


def _time_row(form: str, order: int, family: str, hour: str, minute: str, kind: str, base: float, stated: float, said: str = "h", factor: float = 1.0) -> str:
    near = f"CASE WHEN {said} BETWEEN 6 AND 23 OR {said} BETWEEN 0 AND 2 THEN 0.1 ELSE -0.1 END"
    even = f"CASE WHEN {minute} IN (0, 15, 30, 45) THEN 0.05 ELSE 0 END"
    return f"SELECT id, {order} AS ord, '{family}' AS family, CAST({hour} AS INT) AS hour, CAST({minute} AS INT) AS minute, '{kind}' AS kind, CAST(greatest(0, least(1, {base} + {stated} + {near} + {even})) * {factor} AS DOUBLE) AS confidence FROM t WHERE form IN ({form})"


_TIME_SQL = " UNION ALL ".join([
    _time_row("0", 0, "standard12", _FULL, "m", "standard", 0.9, 0.1), _time_row("0, 2", 1, "military", "h", "m", "standard", 0.95, 0.1), _time_row("1", 2, "doors", _EVENING, "0", "doors", 0.8, 0.1),
    _time_row("2", 3, "show", _EVENING, "m", "show", 0.85, 0.1), _time_row("3, 6", 0, "standard12", _FULL, "0", "standard", 0.9, 0.1), _time_row("3", 4, "casual", _FULL, "0", "approximate", 0.7, 0.1, factor=0.9),
    _time_row("4", 0, "standard12", "23", "0", "standard", 0.9, 0.1, "11"), _time_row("4", 2, "ranges", "h", "0", "range", 0.85, -0.2), _time_row("5", 1, "military", "20", "15", "standard", 0.95, 0.1, "20"), _time_row("6", 5, "contextual", _FULL, "0", "contextual", 0.75, 0.1),
])


@query(
    "time_matches",
    f"WITH t AS (SELECT o_orderkey AS id, 1 + o_custkey % 12 AS h, (o_custkey % 4) * 15 + CASE WHEN o_custkey % 5 = 0 THEN 1 ELSE 0 END AS m, CASE WHEN o_custkey % 3 = 0 THEN 'AM' ELSE 'PM' END AS p, o_orderkey % {len(TIME_FORMS)} AS form FROM orders), "
    + _ranked_sql(_TIME_SQL, "family, hour, minute, kind", "nullif(hour, 0), nullif(minute, 0), kind"),
)
def time_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    minute = F.format_string("%02d", (c % 4) * 15 + F.when(c % 5 == 0, 1).otherwise(0))
    out = pick(k, TIME_FORMS)
    for name, value in (("{h}", (1 + c % 12).cast("string")), ("{m}", minute), ("{p}", F.when(c % 3 == 0, "AM").otherwise("PM"))):
        out = F.replace(out, F.lit(name), value)
    texts = table(spark, sf_dir, "orders").select(k.alias("id"), out.alias("text"))
    return matches.extract(texts, _as_of(), ["time"]).select("id", "family", "hour", "minute", "kind", F.round("confidence", 4).alias("confidence"), "rank")


#: Texts by form, over two amounts a and b.
PRICE_FORMS = ["Pay ${a}", "Free entry", "${a} - ${b}", "from ${a}", "up to ${a}", "Tickets: ${a}", "${a} student", "${a} advance", "{a} bucks", "USD {a}", "${a} to ${b}", "nothing"]


def _price_row(form: str, order: int, family: str, least: str, most: str, sure: str, tier: str = "NULL", timing: str = "NULL") -> str:
    return f"SELECT id, {order} AS ord, '{family}' AS family, CAST({least} AS DOUBLE) AS least, CAST({most} AS DOUBLE) AS most, CAST({tier} AS VARCHAR) AS tier, CAST({timing} AS VARCHAR) AS timing, CAST({sure} AS DOUBLE) AS confidence FROM t WHERE form IN ({form})"


_PRICE_SQL = " UNION ALL ".join([
    _price_row("1", 0, "free", "0", "0", "0.9"), _price_row("0, 2, 3, 4, 5, 6, 7, 8, 10", 1, "single", "a", "a", "0.7"), _price_row("2, 10", 2, "single", "b", "b", "0.7"),
    _price_row("2, 10", 3, "ranges", "a", "b", "CASE WHEN b > a AND b - a <= 200 AND b <= 500 THEN 0.95 ELSE 0.65 END") + " AND a <= b", _price_row("3", 4, "starting", "a", "NULL", "CASE WHEN a <= 500 THEN 0.9::DOUBLE ELSE 0.8::DOUBLE - 0.1::DOUBLE END"),
    _price_row("4", 5, "maximum", "NULL", "a", "0.75"), _price_row("5", 6, "contextual", "a", "a", "0.65"), _price_row("6", 7, "tiered", "a", "a", "0.6", "'student'"), _price_row("7", 8, "timing", "a", "a", "0.6", "NULL", "'advance'"),
])


@query(
    "price_matches",
    f"""WITH t AS (SELECT o_orderkey AS id, 1 + o_custkey % 700 AS a, 1 + o_orderkey % 450 AS b, o_orderkey % {len(PRICE_FORMS)} AS form FROM orders), r AS ({_PRICE_SQL}),
    u AS (SELECT *, row_number() OVER (PARTITION BY id, family, least, most, tier, timing ORDER BY confidence DESC, ord) AS n FROM r)
    SELECT id, family, least, most, tier, timing, round(confidence, 4) AS confidence, CAST(row_number() OVER (PARTITION BY id ORDER BY confidence DESC, CASE WHEN least IS NOT NULL AND most IS NOT NULL THEN 0 ELSE 1 END, ord) AS INT) AS rank FROM u WHERE n = 1""",
)
def price_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    out = F.replace(F.replace(pick(k, PRICE_FORMS), F.lit("{a}"), (1 + c % 700).cast("string")), F.lit("{b}"), (1 + k % 450).cast("string"))
    texts = table(spark, sf_dir, "orders").select(k.alias("id"), out.alias("text"))
    return matches.extract(texts, _as_of(), ["price"]).select("id", "family", "least", "most", "tier", "timing", F.round("confidence", 4).alias("confidence"), "rank")


#: Texts by form, over a number n and a name s, with the matches they give: family, name, kind and confidence.
VENUE_FORMS = ["meet at Blue {s}", "{n} Oak St", "Grand {s} Hall", "in Chicago, IL", "quiet words", "at the tonight"]


@query(
    "venue_matches",
    f"""WITH t AS (SELECT o_orderkey AS id, 1 + o_orderkey % 9000 AS n, CASE o_custkey % 3 WHEN 0 THEN 'Orchid' WHEN 1 THEN 'Lantern' ELSE 'Harbor' END AS s, o_orderkey % {len(VENUE_FORMS)} AS form FROM orders)
    SELECT id, 'atVenue' AS family, 'Blue ' || s AS name, 'venue' AS kind, CAST(1 AS DOUBLE) AS confidence, 1 AS rank FROM t WHERE form = 0
    UNION ALL SELECT id, 'properNouns', 'Blue ' || s, 'potential_venue', 0.3, 2 FROM t WHERE form = 0
    UNION ALL SELECT id, 'addresses', n || ' Oak St', 'address', 0.8, 1 FROM t WHERE form = 1
    UNION ALL SELECT id, 'venueTypes', 'Grand ' || s || ' Hall', 'venue', CAST(1 AS DOUBLE), 1 FROM t WHERE form = 2
    UNION ALL SELECT id, 'properNouns', 'Grand ' || s || ' Hall', 'potential_venue', 0.42, 2 FROM t WHERE form = 2
    UNION ALL SELECT id, 'locations', 'Chicago, IL', 'location', 0.6, 1 FROM t WHERE form = 3""",
)
def venue_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    name = F.when(c % 3 == 0, "Orchid").when(c % 3 == 1, "Lantern").otherwise("Harbor")
    out = F.replace(F.replace(pick(k, VENUE_FORMS), F.lit("{s}"), name), F.lit("{n}"), (1 + k % 9000).cast("string"))
    texts = table(spark, sf_dir, "orders").select(k.alias("id"), out.alias("text"))
    return matches.extract(texts, _as_of(), ["venue"]).select("id", "family", "name", "kind", F.round("confidence", 4).alias("confidence"), "rank")


#: Texts, and what cleaning, correction, normalisation and spelling make of them, worked out by hand.
MISREAD_TEXTS = [
    ("D00RS open  8 : 30  pm", "DOORS open 8:30 pm", "DOORS open 8:30 PM"), ("Frida7 1/15/25 @ Hall", "FRIDAY 1 15 25 Hall", "FRIDAY 1 15 25 Hall"), ("$ 5 conert, free", "$5 conert, free", "$5 conert, FREE"),
    ("12 Main St.", "12 Main St.", "12 Main Street"), ("", "", ""), ("T1CKETS $2O", "TICKETS $20", "TICKETS $20"),
]


@query(
    "corrected_texts",
    f"""SELECT o_orderkey AS id, {pick_sql('o_orderkey', [c for _, c, _ in MISREAD_TEXTS])} AS cleaned, {pick_sql('o_orderkey', [n for _, _, n in MISREAD_TEXTS])} AS normalized,
    CAST(CASE WHEN o_orderkey % 6 IN (0, 1) THEN 1 ELSE 0 END AS INT) AS n_corrections, o_orderkey % 6 = 4 AS empty FROM orders""",
)
def corrected_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    out = parse.preprocess(table(spark, sf_dir, "orders").select(k.alias("id"), pick(k, [t for t, _, _ in MISREAD_TEXTS]).alias("text")))
    return out.select("id", "cleaned", "normalized", F.size("corrections").alias("n_corrections"), F.array_contains("quality.issues", "empty_text").alias("empty"))


@query(
    "clock_times",
    rf"""WITH t AS (SELECT o_orderkey AS id, {pick_sql('o_orderkey', CLOCKS)} AS x FROM orders), g AS (SELECT id, try_cast(regexp_extract(x, '(?i)(\d{{1,2}}):(\d{{2}})\s*(AM|PM)?', 1) AS INT) AS h, regexp_extract(x, '(?i)(\d{{1,2}}):(\d{{2}})\s*(AM|PM)?', 2) AS m, upper(regexp_extract(x, '(?i)(\d{{1,2}}):(\d{{2}})\s*(AM|PM)?', 3)) AS p FROM t)
    SELECT id, CASE WHEN h IS NULL THEN '19:00:00' ELSE printf('%02d:%s:00', CASE WHEN p = 'PM' AND h <> 12 THEN h + 12 WHEN p = 'AM' AND h = 12 THEN 0 ELSE h END, m) END AS clock FROM g""",
)
def clock_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("id"), parse.clock_time(pick(k, CLOCKS)).alias("clock"))


@query(
    "documents_cleaned",
    r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g'), '[^\x20-\x7E]', '', 'g'))) AS clean_md5, CAST(len(regexp_extract_all(text, '\d+(?:\.\d+)?')) AS INT) AS n_numbers FROM documents""",
)
def documents_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marquee.functions import text

    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.clean_text(F.col("text"))).alias("clean_md5"), F.size(text.extract_numbers(F.col("text"))).alias("n_numbers"))


def _counts_sql() -> str:
    rows = []
    for c, words in WORDS.items():
        n = " + ".join(f"CAST(contains(x, '{w}') AS INT)" for w in words)
        boost = " + ".join(f"CAST(contains(x, '{k}') AND ({' OR '.join(f'contains(x, {chr(39)}{w}{chr(39)})' for w in rules[c])}) AS INT)" for k, rules in categories.CONTEXT.items() if c in rules)
        rows.append(f"SELECT id, '{c}' AS c, {categories.PRIORITY.index(c)} AS r, CASE WHEN {n} > 0 THEN {n}{' + ' + boost if boost else ''} ELSE 0 END AS n FROM t")
    return " UNION ALL ".join(rows)


@query(
    "event_categories",
    f"""WITH t AS (SELECT o_orderkey AS id, lower({pick_sql('o_orderkey', LINES)}) AS x FROM orders), n AS ({_counts_sql()}), o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, r) AS k, max(n) OVER (PARTITION BY id) AS top FROM n WHERE n > 0)
    SELECT t.id, coalesce(string_agg(c, ',' ORDER BY k) FILTER (WHERE k = 1 OR (k = 2 AND n >= 2 AND n >= 0.4 * top)), '') AS categories FROM t LEFT JOIN o ON t.id = o.id GROUP BY t.id""",
)
def event_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("id"), F.array_join(categories.categories(pick(k, LINES), WORDS), ",").alias("categories"))


@query(
    "page_titles",
    r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '\s*\|.*$', '', 'g'), '\s+-\s.*$', '', 'g')) AS title,
    lower(trim(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '[ \t\n\r\f\x{00A0}]+', ' ', 'g'))) AS heading FROM pages""",
)
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marquee.functions import text

    inner = lambda p: F.regexp_extract("html", p, 1)
    return table(spark, sf_dir, "pages").select("page_id", text.page_title(inner(r"(?is)<title>(.*?)</title>")).alias("title"), fold(inner(r"(?is)<h1[^>]*>(.*?)</h1>")).alias("heading"))
