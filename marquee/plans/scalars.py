"""Queries that apply the scalar functions to every order, each with a derived text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.functions import images, places, prices, text, validators
from marquee.functions.common import fold
from marquee.plans.derive import ADDRESSES, CITIES, pick, pick_sql
from marquee.plans.registry import query
from marquee.session import table


TEXTS = [
    '"Call (512) 555-0199  or 512-555-0199 now"', "Mail joe.doe@example.com, ann@mail.example.org", "See https://example.com/a?b=1 and HTTP://x.example.org/", "The  Blue @ Note & Bar", "", "12 events, 3.50 each, 7",
    "A rather long line of plain words that goes on past any limit set for it", "'quoted'", "Tab\there", "The Observatory", "+1 (415) 555 0100 ext 5", "Café del Sol | Home - Site",
]


@query(
    "text_helpers",
    f"""WITH t AS (SELECT o_orderkey AS id, {pick_sql('o_orderkey', TEXTS)} AS x FROM orders),
    c AS (SELECT *, trim(regexp_replace(regexp_replace(x, '\\s+', ' ', 'g'), '[^\\x20-\\x7E]', '', 'g')) AS clean FROM t)
    SELECT id, clean, CASE WHEN length(clean) <= 40 THEN clean WHEN instr(substr(clean, 1, 40), ' ') > 0 AND 40 - instr(reverse(substr(clean, 1, 40)), ' ') > 32
      THEN substr(clean, 1, 40 - instr(reverse(substr(clean, 1, 40)), ' ')) || '...' ELSE substr(clean, 1, 40) || '...' END AS short,
    CAST(len(regexp_extract_all(x, '\\d+(?:\\.\\d+)?')) AS INT) AS n_numbers, array_to_string(regexp_extract_all(x, '(?i)https?://[^\\s<>"{{}}|\\\\^`\\[\\]]+'), ' ') AS urls,
    array_to_string(regexp_extract_all(x, '\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Z|a-z]{{2,}}\\b'), ' ') AS emails,
    array_to_string(list_sort(list_distinct(list_concat(list_concat(regexp_extract_all(x, '\\(\\d{{3}}\\)\\s*\\d{{3}}-\\d{{4}}'), regexp_extract_all(x, '\\d{{3}}[-.\\s]\\d{{3}}[-.\\s]\\d{{4}}')), regexp_extract_all(x, '\\+1[\\s-]?\\(\\d{{3}}\\)[\\s-]?\\d{{3}}[\\s-]?\\d{{4}}')))), ' / ') AS phones,
    regexp_replace(x, '^["'']|["'']$', '', 'g') AS unquoted, lower(trim(regexp_replace(x, '\\s+', ' ', 'g'))) AS folded,
    trim(regexp_replace(regexp_replace(lower(x), '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS venue_key,
    CAST(round(1000 * (1 - levenshtein(clean, 'The Observatory') / greatest(length(clean), 15.0))) AS BIGINT) AS likeness FROM c""".replace("\\\\", "\\"),
)
def text_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), pick(F.col("o_orderkey"), TEXTS).alias("x"))
    x = F.col("x")
    return t.select(
        "id", text.clean_text(x).alias("clean"), text.truncate_text(x, 40).alias("short"), F.size(text.extract_numbers(x)).alias("n_numbers"), F.array_join(text.extract_urls(x), " ").alias("urls"),
        F.array_join(text.extract_emails(x), " ").alias("emails"), F.array_join(F.array_sort(text.extract_phones(x)), " / ").alias("phones"), text.strip_quotes(x).alias("unquoted"), fold(x).alias("folded"), text.venue_key(x).alias("venue_key"),
        F.round(1000 * text.similarity(text.clean_text(x), F.lit("The Observatory"))).cast("long").alias("likeness"),
    )


VALUES = [
    "https://cdn.example.com/a.jpg?x=1", "http://example.org/page", "not a url", "joe@example.com", "a@b", "(512) 555-0199", "1-512-555-0199", "$25", "$25.5", "25.50", "Free entry", "TBD", "19:30:00", "7:05:09", "24:00:00",
    "12 Main Street", "short st", "Somewhere over there", "", "ftp://example.com/photo",
]
_URL = "regexp_matches(x, '^[A-Za-z][A-Za-z0-9+.-]*://[^\\s/?#]+')"


@query(
    "validators",
    f"""WITH t AS (SELECT o_orderkey AS id, {pick_sql('o_orderkey', VALUES)} AS x FROM orders)
    SELECT id, {_URL} AS url, {_URL} AND (regexp_matches(x, '(?i)\\.(jpg|jpeg|png|gif|webp|svg)(\\?.*)?$') OR regexp_matches(x, '(?i)(image|img|photo|pic|cdn|media)')) AS image_url,
    regexp_matches(x, '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$') AS email,
    length(regexp_replace(x, '\\D', '', 'g')) = 10 OR (length(regexp_replace(x, '\\D', '', 'g')) = 11 AND starts_with(regexp_replace(x, '\\D', '', 'g'), '1')) AS phone,
    regexp_matches(x, '^\\$?\\d+(\\.\\d{{2}})?$') OR contains(lower(x), 'free') OR contains(lower(x), 'tbd') AS price,
    length(trim(x)) >= 10 AND regexp_matches(trim(x), '(?i)\\b(street|st|avenue|ave|road|rd|boulevard|blvd|lane|ln|drive|dr|court|ct|place|pl|\\d+)\\b') AS address,
    regexp_matches(x, '^([01]?[0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]$') AS time FROM t""".replace("\\\\", "\\"),
)
def validators_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    t = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), pick(F.col("o_orderkey"), VALUES).alias("x"))
    v = validators
    return t.select("id", v.valid_url(x).alias("url"), v.valid_image_url(x).alias("image_url"), v.valid_email(x).alias("email"), v.valid_phone(x).alias("phone"), v.valid_price(x).alias("price"), v.valid_address(x).alias("address"), v.valid_time(x).alias("time"))


def _any(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


_BAY, _ATX = [c.lower() for c in places.BAY_CITIES], [c.lower() for c in places.AUSTIN_CITIES]
_CASES = " ".join(f"WHEN contains(lower(address), '{c.lower()}') THEN '{c}'" for c in places.BAY_CITIES + places.AUSTIN_CITIES) + " " + " ".join(f"WHEN contains(lower(address), '{a}') THEN '{c}'" for a, c in places.CITY_ALIASES.items())
_IN_AUSTIN = _any("lower(address || ' ' || city)", _ATX + ["texas", "tx "])
_IS_AUSTIN = "(city IN (" + ", ".join(f"'{c}'" for c in places.AUSTIN_CITIES[:8]) + ") OR " + _any("address", places.AUSTIN_CITIES[:8]) + ")"


@query(
    "places",
    f"""WITH t AS (SELECT o_orderkey AS id, {pick_sql('o_orderkey', ADDRESSES)} AS address, {pick_sql('o_orderkey', CITIES)} AS city FROM orders)
    SELECT id, CASE {_CASES} ELSE '' END AS city_found, {_any("lower(address || ' ' || city)", _BAY + ["california", "ca "])} AS bay_area, {_IN_AUSTIN} AS austin,
    CASE WHEN {_IN_AUSTIN} THEN 'austin' ELSE 'bayArea' END AS region,
    CASE WHEN {_any('city', places.BAY_CITIES[:20])} OR {_any('address', places.BAY_CITIES[:20])} THEN 'bayAreaEvents' WHEN {_any('city', places.AUSTIN_CITIES[:13])} OR {_any('address', places.AUSTIN_CITIES[:13])} THEN 'austinEvents' ELSE 'bayAreaEvents' END AS collection,
    {_IS_AUSTIN} AS austin_event, NOT {_IS_AUSTIN} AS bay_event, trim(list_extract(string_split(address, ','), -1)) AS last_part FROM t""",
)
def places_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, c = F.col("address"), F.col("city")
    t = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), pick(F.col("o_orderkey"), ADDRESSES).alias("address"), pick(F.col("o_orderkey"), CITIES).alias("city"))
    return t.select(
        "id", places.city_of_text(a).alias("city_found"), places.in_bay_area(a, c).alias("bay_area"), places.in_austin(a, c).alias("austin"), places.region(a, c).alias("region"), places.collection_of(a, c).alias("collection"),
        places.is_austin_event(a, c).alias("austin_event"), places.is_bay_area_event(a, c).alias("bay_event"), places.city_of_address(a).alias("last_part"),
    )


PRICES = ["$25", "$12.50 - $20", "€30", "£5.5", "¥1200", "Free!", "donation", "about 15", "", "none", "₹99.00", "$0"]


@query(
    "prices",
    f"""WITH t AS (SELECT o_orderkey AS id, {pick_sql('o_orderkey', PRICES)} AS x FROM orders),
    f AS (SELECT *, {_any('lower(x)', prices.FREE_WORDS)} AS free, nullif(regexp_extract(x, '\\$(\\d+(?:\\.\\d{{2}})?)', 1), '') AS a1, nullif(regexp_extract(x, '€(\\d+(?:\\.\\d{{2}})?)', 1), '') AS a2,
      nullif(regexp_extract(x, '£(\\d+(?:\\.\\d{{2}})?)', 1), '') AS a3, nullif(regexp_extract(x, '¥(\\d+)', 1), '') AS a4, nullif(regexp_extract(x, '₹(\\d+(?:\\.\\d{{2}})?)', 1), '') AS a5, nullif(regexp_extract(x, '(\\d+(?:\\.\\d{{2}})?)', 1), '') AS a6 FROM t),
    g AS (SELECT id, CASE WHEN free THEN 0.0 ELSE CAST(coalesce(a1, a2, a3, a4, a5, a6) AS DOUBLE) END AS amount,
      CASE WHEN free OR a1 IS NOT NULL THEN 'USD' WHEN a2 IS NOT NULL THEN 'EUR' WHEN a3 IS NOT NULL THEN 'GBP' WHEN a4 IS NOT NULL THEN 'JPY' WHEN a5 IS NOT NULL THEN 'INR' WHEN a6 IS NOT NULL THEN 'USD' END AS currency FROM f)
    SELECT id, CAST(round(amount * 100) AS BIGINT) AS cents, currency, CASE WHEN amount IS NULL THEN 'Price TBD' WHEN amount = 0 THEN 'Free'
      ELSE CASE currency WHEN 'USD' THEN '$' WHEN 'EUR' THEN '€' WHEN 'GBP' THEN '£' WHEN 'JPY' THEN '¥' ELSE '₹' END || printf('%.2f', amount) END AS shown FROM g""".replace("\\\\", "\\"),
)
def prices_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    t = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), pick(F.col("o_orderkey"), PRICES).alias("x"))
    return t.select("id", F.round(prices.amount(x) * 100).cast("long").alias("cents"), prices.currency(x).alias("currency"), prices.format_price(x).alias("shown"))


URLS = [
    "https://cdn.example.com/event_hero_large.jpg?w=1", "https://example.com/img/logo_thumb.png", "https://example.com/a_150x150.gif", "https://example.com/poster_1200x1600.webp", "https://example.com/page.html", "nothing",
    "https://images.example.com/x", "https://example.com/photo_hd.jpeg",
]


@query(
    "image_urls",
    f"""WITH t AS (SELECT o_orderkey AS id, {pick_sql('o_orderkey', URLS)} AS x, CAST(100 + o_orderkey % 1500 AS INT) AS w, CAST(100 + o_custkey % 1300 AS INT) AS h FROM orders)
    SELECT id, nullif(lower(regexp_extract(x, '(?i)\\.([a-z0-9]+)(?:\\?|$)', 1)), '') AS extension, {' + '.join(f"CAST(CASE WHEN regexp_matches(x, '{p}') THEN {n} ELSE 0 END AS INT)" for p, n in images.PRIORITY)} AS priority,
    regexp_replace(regexp_replace(regexp_replace(x, '(?i)(_thumb|_small|_large|_hd|_xl)', '', 'g'), '(?i)\\d+x\\d+', '', 'g'), '[?&].*$', '', 'g') AS url_key,
    CAST(CASE WHEN w >= 600 AND h >= 600 THEN CASE WHEN w * h / 1048576 >= 1 THEN 100 WHEN w * h / 1048576 >= 0.5 THEN 90 ELSE 80 END WHEN w >= 300 AND h >= 300 THEN CASE WHEN w * h / 1048576 >= 0.3 THEN 70 ELSE 60 END ELSE 20 END AS INT) AS size_score,
    CAST(round(100 * CASE WHEN abs(w / h - 1.0) < 0.05 THEN 100 WHEN abs(w / h - 0.8) < 0.05 THEN 95 WHEN abs(w / h - 0.5625) < 0.05 THEN 90 WHEN abs(w / h - 0.618) < 0.05 THEN 85 WHEN w / h >= 0.7 AND w / h <= 1.3 THEN greatest(60, 80 - abs(w / h - 1.0) * 100)
      WHEN w / h > 1.3 AND w / h < 2.0 THEN 30 WHEN w / h < 0.5 OR w / h > 2.0 THEN 10 ELSE 40 END) AS BIGINT) AS ratio_score FROM t""".replace("\\\\", "\\"),
)
def image_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, w, h = F.col("x"), F.col("w"), F.col("h")
    t = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), pick(F.col("o_orderkey"), URLS).alias("x"), (100 + F.col("o_orderkey") % 1500).cast("int").alias("w"), (100 + F.col("o_custkey") % 1300).cast("int").alias("h"))
    return t.select(
        "id", images.extension(x).alias("extension"), images.url_priority(x).alias("priority"), images.url_key(x).alias("url_key"), images.size_score(w, h).alias("size_score"),
        F.round(100 * images.ratio_score(w / h)).cast("long").alias("ratio_score"),
    )


@query(
    "best_images",
    f"""WITH t AS (SELECT o_custkey AS event_id, o_orderkey AS ord, {pick_sql('o_orderkey', URLS)} AS url FROM orders), s AS (SELECT *, {' + '.join(f"CAST(CASE WHEN regexp_matches(url, '{p}') THEN {n} ELSE 0 END AS INT)" for p, n in images.PRIORITY)} AS priority,
      regexp_replace(regexp_replace(regexp_replace(url, '(?i)(_thumb|_small|_large|_hd|_xl)', '', 'g'), '(?i)\\d+x\\d+', '', 'g'), '[?&].*$', '', 'g') AS k FROM t
      WHERE regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^\\s/?#]+') AND (regexp_matches(url, '(?i)\\.(jpg|jpeg|png|gif|webp|svg)(\\?.*)?$') OR regexp_matches(url, '(?i)(image|img|photo|pic|cdn|media)'))),
    f AS (SELECT *, row_number() OVER (PARTITION BY event_id, k ORDER BY priority DESC, ord) AS r FROM s), g AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY priority DESC, ord) AS rank FROM f WHERE r = 1)
    SELECT event_id, CAST(rank AS INT) AS rank, url, priority FROM g WHERE rank <= 5""".replace("\\\\", "\\"),
)
def best_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marquee.operators import images as ops

    t = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("event_id"), F.col("o_orderkey").alias("ord"), pick(F.col("o_orderkey"), URLS).alias("url"))
    return ops.best_images(t)
