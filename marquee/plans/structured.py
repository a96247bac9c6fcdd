"""Queries on JSON of any depth, made of the orders' numbers by one expression in both engines."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.functions.addresses import venue_of_address
from marquee.operators import structured
from marquee.plans.derive import pick, pick_sql, quoted
from marquee.plans.registry import query
from marquee.session import table


def _filled(template: str, **parts: str) -> str:
    """A template whose <x> are SQL texts."""
    pieces = re.split(r"<(\w+)>", template)
    return " || ".join(quoted(p) if i % 2 == 0 else parts[p] for i, p in enumerate(pieces))


def _pick(key: str, options: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN {key} % {len(options)} = {i} THEN {o}" for i, o in enumerate(options)) + " END"


_K = "CAST(o_orderkey AS STRING)"
LEAVES = [
    '{"image":"/a<k>.jpg","name":"x"}', '{"photo":["b<k>.png",{"url":"http://c.example/<k>.webp","caption":"Cap <k>"},7,{"x":1}]}', '{"logo":{"url":"//d.example/<k>.gif","description":"Desc"},"thumbnail":"http://e.example/pixel.png"}',
    '{"poster":"","banner":"data:image/png;base64,xx","image":null}', '{"image":{"url":"../f<k>.jpg","thumbnail":"t<k>.jpg"}}',
]
WRAPS = ['{"z":<x>,"image":"/w<i>.jpg"}', '[<x>,{"logo":"l<i>.png"},"s"]', '{"b":[<x>],"a":{"banner":"/n<i>.css","photo":["/p<i>.jpg"]}}']


def _side(i: int, part: int) -> str:
    """What stands before or after the text that the i-th wrap goes around."""
    return f"CASE WHEN o_orderkey % 6 >= {i} THEN {_pick(f'(o_custkey + {i})', [_filled(w.split('<x>')[part], i=quoted(str(i))) for w in WRAPS])} ELSE '' END"


#: Documents of one to six levels.
_DEEP = " || ".join([*(_side(i, 0) for i in range(5, 0, -1)), _pick("o_orderkey", [_filled(t, k=_K) for t in LEAVES]), *(_side(i, 1) for i in range(1, 6))])


@query(
    "json_images",
    f"""WITH d AS (SELECT o_orderkey AS id, {_DEEP} AS json FROM orders), t AS (SELECT d.id, t.id AS node, t.value FROM d, json_tree(CAST(d.json AS JSON)) t WHERE t.type = 'OBJECT'),
    k AS (SELECT id, node, rank, key, json_extract(value, '$.' || key) AS v FROM t, (SELECT unnest({structured.IMAGE_KEYS}) AS key, generate_subscripts({structured.IMAGE_KEYS}, 1) AS rank)),
    i AS (SELECT id, node, rank, key, false AS listed, 0 AS item, v AS one FROM k WHERE json_type(v) IN ('VARCHAR', 'OBJECT')
      UNION ALL SELECT k2.id, node, rank, k2.key, true, CAST(e.key AS INT), e.value FROM (SELECT * FROM k WHERE json_type(v) = 'ARRAY') k2(id, node, rank, key, v), json_each(k2.v) e),
    u AS (SELECT *, CASE WHEN json_type(one) = 'VARCHAR' THEN one->>'$' ELSE one->>'$.url' END AS url, CASE WHEN json_type(one) = 'VARCHAR' THEN key ELSE coalesce(one->>'$.description', one->>'$.caption', key) END AS alt,
      'json_ld.' || key || CASE WHEN listed THEN '[]' ELSE '' END || CASE WHEN json_type(one) = 'VARCHAR' THEN '' ELSE '.url' END AS selector FROM i WHERE json_type(one) IN ('VARCHAR', 'OBJECT')),
    a AS (SELECT *, CASE WHEN url LIKE 'http%' THEN url WHEN url LIKE '//%' THEN 'https:' || url WHEN url LIKE '/%' THEN 'https://h.example' || url WHEN url LIKE '../%' THEN 'https://h.example' || substr(url, 3) WHEN url LIKE 'data:%' THEN NULL ELSE 'https://h.example/p/' || url END AS whole FROM u WHERE url <> '')
    SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY node, rank, item) AS INT) AS position, whole AS url, alt, selector FROM a WHERE whole NOT LIKE '%.css' AND whole NOT LIKE '%pixel%'""",
)
def json_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit("https://h.example/p/q").alias("base"), F.expr(_DEEP).alias("json"))
    return structured.json_images(rows, ["id"], "json", "base")


EVENT_FORMS = [
    '{"@type":"MusicEvent","name":"Solo <k>","startDate":"2025-06-<d>T20:00:00-07:00","location":{"name":"Hall","address":{"streetAddress":"<k> Main St","addressLocality":"Austin","addressRegion":"TX","postalCode":"78701"}},"offers":{"url":"http://t.example/<k>","price":"<d>"}}',
    '[{"@type":"Organization","name":"Org"},[{"@type":["Thing","Event"],"name":"Nested <k>","startDate":"2025-06-<d>","location":{"address":{"addressLocality":"Kyle","postalCode":"1<d>"}}},[{"@type":"MusicEvent","name":"Deep <k>","image":["http://i.example/<k>.jpg"]}]],{"@type":"Event","name":"Last <k>","offers":[{"lowPrice":0},{"price":9}],"description":"Text <k>"}]',
    '{"@context":"x","@graph":[{"@type":"Event","name":"Graph <k>","subEvent":{"@type":"Event","name":"inner"}},{"@graph":[{"@type":"MusicEvent","name":"Graph in graph <k>"}]}],"mainEntity":{"@type":"SocialEvent","name":" Main <k> ","location":{"address":"<k> Oak Ave","name":"Room"},"offers":{"availability":"x"},"image":{"url":"http://j.example/<k>.png"}}}',
    '{"@type":"EventSeries","name":"Series <k>","offers":{"price":0.0},"image":"http://s.example/<d>.png"}',
    "no json",
]
_BLOCK = _pick("o_orderkey", [_filled(t, k=_K, d="CAST(10 + o_custkey % 20 AS STRING)") for t in EVENT_FORMS])
_TYPES = "CASE json_type(t.value, '$.\"@type\"') WHEN 'ARRAY' THEN CAST(json_extract(t.value, '$.\"@type\"') AS VARCHAR[]) WHEN 'VARCHAR' THEN [t.value->>'$.\"@type\"'] ELSE [] END"


@query(
    "listed_events",
    f"""WITH d AS (SELECT o_orderkey AS id, TRY_CAST({_BLOCK} AS JSON) AS json FROM orders WHERE o_orderkey % 5 < 4),
    t AS (SELECT d.id, t.id AS node, t.value AS v FROM d, json_tree(d.json) t WHERE t.type = 'OBJECT' AND regexp_matches(t.fullkey, '^\\$(\\[[0-9]+\\]|\\."?@graph"?)*$') AND list_has_any({_TYPES}, ['Event', 'MusicEvent'])),
    a AS (SELECT *, v->>'$.location.address.streetAddress' AS street, v->>'$.location.address.addressLocality' AS town, v->>'$.location.address.addressRegion' AS region, v->>'$.location.address.postalCode' AS zip FROM t)
    SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY node) AS INT) AS position, v->>'$.name' AS title, nullif(split_part(v->>'$.startDate', 'T', 1), '') AS start_date, substr(nullif(split_part(v->>'$.startDate', 'T', 2), ''), 1, 8) AS start_time, v->>'$.location.name' AS venue,
    nullif(concat_ws(', ', street, town, nullif(concat_ws(' ', region, zip), '')), '') AS address, v->>'$.description' AS description, 'Music' AS categories, false AS free, v->>'$.offers.url' AS tickets_link FROM a""",
)
def listed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.expr(_BLOCK).alias("json"))
    return structured.listed_events(blocks, ["id"], "json").withColumn("categories", F.array_join("categories", ","))


@query(
    "own_events",
    """WITH o AS (SELECT o_custkey AS page_id, o_orderkey AS k, 10 + o_custkey % 20 AS d FROM orders WHERE o_orderkey % 5 < 4 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END, o_orderkey) = 1)
    SELECT page_id, CASE k % 5 WHEN 1 THEN 'Last ' || k WHEN 2 THEN 'Main ' || k WHEN 3 THEN 'Series ' || k END AS title, NULL::VARCHAR AS start, CASE k % 5 WHEN 2 THEN 'Room' END AS venue, CASE k % 5 WHEN 2 THEN k || ' Oak Ave' END AS address,
    CASE k % 5 WHEN 1 THEN 'Text ' || k END AS description, CASE k % 5 WHEN 1 THEN true WHEN 3 THEN true END AS free, CASE k % 5 WHEN 2 THEN 'http://j.example/' || k || '.png' WHEN 3 THEN 'http://s.example/' || d || '.png' END AS image FROM o WHERE k % 5 > 0""",
)
def own_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("page_id"), F.col("o_orderkey").alias("ord"), F.expr(_BLOCK).alias("json"))
    return structured.own_event(blocks, "page_id", "ord", "json")


DEFAULTS = '{"extraction":{"timeout":30,"layers":["a","b"],"retry":{"times":3,"wait":{"least":1,"most":9}}},"confidence":{"excellent":90,"good":75,"acceptable":60,"poor":40},"hashApp":{"on":true},"layers":{"1":{"timeout":100}}}'
#: A site's own configuration by remainder, and the merged one.
CONFIGS = [
    ("{}", DEFAULTS, ""),
    ('{"extraction":{"layers":["c<n>"],"retry":{"wait":{"most":<n>}}}}', '{"extraction":{"timeout":30,"layers":["c<n>"],"retry":{"times":3,"wait":{"least":1,"most":<n>}}},"confidence":{"excellent":90,"good":75,"acceptable":60,"poor":40},"hashApp":{"on":true},"layers":{"1":{"timeout":100}}}', ""),
    ('{"extraction":{"retry":{"wait":<n>},"timeout":{"soft":1}},"new":{"a":[{"b":1}]}}', '{"extraction":{"timeout":{"soft":1},"layers":["a","b"],"retry":{"times":3,"wait":<n>}},"confidence":{"excellent":90,"good":75,"acceptable":60,"poor":40},"hashApp":{"on":true},"layers":{"1":{"timeout":100}},"new":{"a":[{"b":1}]}}', ""),
    ('{"hashApp":null,"confidence":{"good":1<n>1,"poor":"x"},"layers":{"1":{"timeout":"s"},"2":{"on":false}}}', '{"extraction":{"timeout":30,"layers":["a","b"],"retry":{"times":3,"wait":{"least":1,"most":9}}},"confidence":{"excellent":90,"good":1<n>1,"acceptable":60,"poor":"x"},"hashApp":null,"layers":{"1":{"timeout":"s"},"2":{"on":false}}}',
     "Missing required section: hashApp|Invalid confidence threshold: good|Invalid confidence threshold: poor|Layer 1 timeout must be a number"),
]


def _config(at: int) -> str:
    return _pick("c_custkey", [_filled(c[at], n="CAST(10 + c_custkey % 50 AS STRING)") for c in CONFIGS])


@query("merged_configs", f"SELECT c_name AS site, {_config(1)} AS config, {_config(2)} AS errors, c_custkey % 4 < 3 AS valid FROM customer WHERE c_custkey % 11 > 0")
def merged_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = table(spark, sf_dir, "customer").select(F.col("c_name").alias("site"), F.when(F.col("c_custkey") % 11 == 0, "{no json").otherwise(F.expr(_config(0))).alias("config"))
    defaults = spark.range(1).select(F.lit(DEFAULTS).alias("config"))
    return structured.configurations(defaults, sites).select("site", "config", F.array_join("errors", "|").alias("errors"), "valid")


HOSTS = ["https://www.eventbrite.com/e/{n}", "http://m.facebook.com/x", "https://do512.com", "songkick", "https://example.org/meetup", "http://venue.timeout.co.uk/a", "YELP", "https://{n}.example/", "fb.me"]
_HOST = f"replace({pick_sql('o_orderkey', HOSTS)}, '{{n}}', CAST(o_custkey AS VARCHAR))"


@query(
    "site_configs",
    f"""WITH t AS (SELECT o_orderkey AS id, o_orderkey % {len(HOSTS)} AS f FROM orders) SELECT id, list_extract(['eventbrite', 'facebook', 'do512', 'songkick', 'generic', 'timeout', 'yelp', 'generic', 'fb.me'], CAST(f AS BIGINT) + 1) AS site,
    CASE f WHEN 0 THEN '{{"c":"a"}}' WHEN 3 THEN '{{"c":"b"}}' WHEN 6 THEN '{{"c":"d"}}' ELSE '{{"c":"g"}}' END AS config FROM t""",
)
def site_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    urls = table(spark, sf_dir, "orders").select(k.alias("id"), F.replace(pick(k, HOSTS), F.lit("{n}"), F.col("o_custkey").cast("string")).alias("url"))
    configs = spark.createDataFrame([("eventbrite", '{"c":"a"}'), ("songkick", '{"c":"b"}'), ("yelp", '{"c":"d"}'), ("generic", '{"c":"g"}')], "site string, config string")
    return structured.config_for(urls, configs).drop("url")


PLACES = ["at the Big Hall {n}, Austin, TX", "The Fillmore, San Francisco CA", "Jazz Night at Blue Note {n} Main", "{n} Main St", "Located at Kyle Barn", "in Texas", "", "Meet at Bar at Oakland Pub, Oakland", "Owl  Room, {n}"]


@query(
    "venues_of_addresses",
    rf"""WITH t AS (SELECT o_orderkey AS id, replace({pick_sql('o_orderkey', PLACES)}, '{{n}}', CAST(o_custkey AS VARCHAR)) AS x FROM orders), b AS (SELECT id, x, regexp_replace(x, '^(at\s+|the\s+|in\s+|located\s+at\s+)', '', 'i') AS y FROM t),
    n AS (SELECT id, x, CASE WHEN regexp_matches(y, '(?i)^.+?\s+at\s+.+$') THEN regexp_extract(y, '(?i)^(.+?)\s+at\s+(.+)$', 2) ELSE y END AS y FROM b)
    SELECT id, CASE WHEN x <> '' THEN trim(regexp_replace(regexp_replace(y, ',?\s+(Austin|San Francisco|Oakland|Berkeley|San Jose|TX|CA|Texas|California|United States).*$', '', 'i'), '\s*,?\s*[0-9]+.*$', '')) END AS venue FROM n""",
)
def venues_of_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    x = F.replace(pick(k, PLACES), F.lit("{n}"), F.col("o_custkey").cast("string"))
    return table(spark, sf_dir, "orders").select(k.alias("id"), venue_of_address(x).alias("venue"))
