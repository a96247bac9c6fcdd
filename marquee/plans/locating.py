"""The query on venues and addresses in one text, with SQL of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.operators import locating
from marquee.plans.derive import quoted
from marquee.plans.registry import query
from marquee.session import table

#: Texts over a number, a city, a keyword and a word of the line items' comments.
FORMS = [
    "Jazz night at the Blue {k}, {n} Main St, {c}", "Held at {w}'s {k}", "The Big {k}, {n} Mill Rd, {c}", "{n} Main St, Big {k}, TX", "{w} {k} {c}", "big {k} group", "the {w} {k} by  moby {n} oak Ave reno", "{k}", "{n} {w} Ave", "{c}", "   ",
    "room about {w} dock", "foo {w}, baz", "{w} @ {k} {n}a,{c}", "at {k},, x, {w}", "Mt {w}, Waco TX", "A bold happy family room, {c}, {k}", "{w} {c}", "My {k} {n} Oak Court {c}", "takes place at in {k} 5, {n} {w} Rd {c}", "hub {k} up {n} Oak Rd", "My Gym, 5",
]
PICKS = {
    "k": ["Hall", "Opera House", "Pub", "Club", "gym", "Coffee Shop", "Library"], "c": ["Austin", "San Jose", "Reno, NY", "Kyle, TX", "Oakland"], "w": ["ship", "Chicago", "bOO", "Rome", "a"],
}


def _pick(key: str, options: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN {key} % {len(options)} = {i} THEN {o}" for i, o in enumerate(options)) + " END"


def _input() -> str:
    """One expression for both engines."""
    out = _pick("o_orderkey", [quoted(f) for f in FORMS])
    for name, options in PICKS.items():
        out = f"replace({out}, '{{{name}}}', {_pick('o_custkey' if name != 'w' else '(o_custkey + o_orderkey)', [quoted(o) for o in options])})"
    return f"replace({out}, '{{n}}', CAST(1 + o_custkey % 990 AS STRING))"


_KEYS, _STREETS = ("|".join(sorted({w.lower() for w in words})) for words in (locating.KEYWORDS, locating.STREETS))
_key = lambda x: f"regexp_matches(lower({x}), '{_KEYS}')"
_street = lambda x: f"regexp_matches(lower({x}), '{_STREETS}')"
_W = "0-9A-Za-z_"


def _title(x: str) -> str:
    return f"array_to_string(list_transform(string_split({x}, ' '), lambda q: regexp_extract(q, '^([^{_W}]*)', 1) || upper(regexp_extract(q, '^[^{_W}]*([{_W}]?)', 1)) || lower(regexp_extract(q, '^[^{_W}]*[{_W}]?(.*)$', 1))), ' ')"


def _tidy(x: str) -> str:
    bare = rf"regexp_replace(regexp_replace(trim({x}), '^(the|at|in|on|located|situated|held|hosted|takes place|happening|occurring|featuring)\s+', '', 'i'), '\s+[0-9]+\s*[A-Za-z]*\s*$', '')"
    return f"trim({_title(bare)})"


def _city(x: str) -> str:
    last = f"list_last(string_split(trim(substr({x}, 1, greatest(instr(lower({x}), lower(s)) - 1, 0))), ' '))"
    return f"coalesce(list_filter({locating.CITIES}, lambda c: contains(lower({x}), lower(c)))[1], list_filter(list_transform({locating.STATES}, lambda s: CASE WHEN instr(lower({x}), lower(s)) > 0 AND length({last}) > 2 THEN {_title(last)} || ', ' || s END), lambda s: s IS NOT NULL)[1])"


def _formatted(x: str, city: str) -> str:
    """An address whose city is in column ``city``."""
    at = f"coalesce(instr(lower(trim({x})), lower({city})), 0)"
    before = f"trim(substr(trim({x}), 1, greatest({at} - 1, 0)))"
    parts = f"array_to_string(list_filter(list_transform(string_split({x}, ','), lambda p: trim(p)), lambda p: p <> ''), ', ')"
    return f"CASE WHEN contains({x}, ',') THEN {parts} WHEN {at} > 0 AND {before} <> '' THEN {before} || ', ' || trim(substr(trim({x}), {at})) ELSE trim({x}) END"


def _without(x: str, part: str) -> str:
    """x with the first occurrence of a part cut out."""
    return f"trim(CASE WHEN {part} <> '' AND instr({x}, {part}) > 0 THEN substr({x}, 1, instr({x}, {part}) - 1) || substr({x}, instr({x}, {part}) + length({part})) ELSE {x} END)"


_ONES, _TWOS = (sorted({k.lower() for k in locating.KEYWORDS if len(k.split()) == n}) for n in (1, 2))
_SURE = f"(1 + CASE WHEN {_key('win')} THEN 4 ELSE 0 END + CASE WHEN len(string_split(win, ' ')) BETWEEN 2 AND 6 THEN 2 ELSE 0 END + CASE WHEN NOT regexp_matches(win, '[0-9]') AND NOT {_street('win')} THEN 2 ELSE 0 END + CASE WHEN win = {_title('win')} THEN 1 ELSE 0 END)"


@query(
    "located_venues",
    rf"""WITH i AS (SELECT o_orderkey AS id, regexp_replace(regexp_replace({_input()}, '\s+', ' ', 'g'), '^ | $', '', 'g') AS t FROM orders),
    a AS (SELECT *, {_city('t')} AS city, regexp_extract(t, '(?i)\b(?:at|@)\s+([^,]+)(?:,|$)', 1) AS named, length(regexp_extract(t, '(?i)^.*?\b(?:at|@)\s+[^,]+(?:,|$)', 0)) AS ends, string_split(t, ' ') AS words FROM i),
    -- words around keywords
    k AS (SELECT id, words, j, CASE WHEN list_contains({_TWOS}, lower(words[j] || ' ' || coalesce(words[j + 1], ''))) THEN 2 WHEN list_contains({_ONES}, lower(words[j])) THEN 1 END AS size FROM (SELECT id, words, unnest(range(1, len(words) + 1)) AS j FROM a)),
    v AS (SELECT id, j, array_to_string(words[greatest(j - 3, 1):least(j + size + 1, len(words))], ' ') AS win FROM k WHERE size IS NOT NULL),
    s AS (SELECT id, win, {_SURE} AS tenths FROM v QUALIFY row_number() OVER (PARTITION BY id ORDER BY {_SURE} DESC, j) = 1),
    s2 AS (SELECT s.id, tenths, {_tidy('win')} AS wname, {_without('t', _tidy('win'))} AS remains FROM s JOIN a ON s.id = a.id),
    s3 AS (SELECT *, regexp_extract(remains, '(?i)[0-9]+\s+[A-Za-z\s]+(?:Street|St|Avenue|Ave|Boulevard|Blvd|Road|Rd|Drive|Dr|Lane|Ln|Way|Place|Pl)', 0) AS road FROM s2),
    s4 AS (SELECT id, tenths, wname, CASE WHEN road = '' THEN remains WHEN trim(substr(remains, instr(remains, road) + length(road))) = '' THEN road ELSE road || ', ' || trim(substr(remains, instr(remains, road) + length(road))) END AS waddress FROM s3),
    -- parts between commas
    p AS (SELECT id, pos, p, {_key('p')} AS keyed, regexp_matches(p, '[0-9]') AS number, regexp_matches(p, '[0-9]') AND {_street('p')} AS street, {_city('p')} IS NOT NULL AS has_city FROM (SELECT id, unnest(list_transform(string_split(t, ','), lambda x: trim(x))) AS p, generate_subscripts(string_split(t, ','), 1) AS pos FROM a WHERE contains(t, ','))),
    q AS (SELECT id, min(pos) FILTER (WHERE NOT street AND NOT has_city AND (keyed OR (pos = 1 AND NOT number AND len(string_split(p, ' ')) <= 6))) AS spot FROM p GROUP BY id),
    q2 AS (SELECT p.id, max(p) FILTER (WHERE pos = spot) AS vpart, bool_or(keyed) FILTER (WHERE pos = spot) AS vkey, string_agg(p, ', ' ORDER BY pos) FILTER (WHERE pos <> spot) AS apart FROM p JOIN q ON p.id = q.id WHERE spot IS NOT NULL GROUP BY p.id),
    b AS (SELECT a.*, CASE WHEN length(trim(regexp_replace(substr(t, ends + 1), '^,', ''))) < 5 THEN coalesce(city, 'San Francisco, CA') ELSE trim(regexp_replace(substr(t, ends + 1), '^,', '')) END AS rest, coalesce(instr(lower(t), lower(city)), 0) AS here,
      vpart, vkey, apart, tenths, wname, waddress FROM a LEFT JOIN q2 ON a.id = q2.id LEFT JOIN s4 ON a.id = s4.id),
    c AS (SELECT *, trim(substr(t, 1, greatest(here - 1, 0))) AS before, CASE WHEN here > 0 THEN substr(t, here) END AS behind, {_city('rest')} AS rcity FROM b),
    d AS (SELECT *, {_city('behind')} AS bcity FROM c),
    f AS (SELECT *, CASE WHEN named <> '' THEN 1 WHEN vpart IS NOT NULL AND vkey THEN 2 WHEN round(tenths * 0.07, 2) > 0.6 THEN 3 WHEN vpart IS NOT NULL THEN 2
      WHEN here > 0 AND length(before) > 5 AND NOT (regexp_matches(before, '^[0-9]') AND {_street('before')}) AND (regexp_matches(lower(before), '({_KEYS})$') OR len(string_split(before, ' ')) <= 5) THEN 4
      WHEN regexp_matches(t, '[0-9]') OR {_street('t')} THEN 5 WHEN {_key('t')} THEN 6 ELSE 7 END AS way FROM d),
    g AS (SELECT id, t, way, CASE way WHEN 1 THEN {_tidy('named')} WHEN 2 THEN {_tidy('vpart')} WHEN 3 THEN wname WHEN 4 THEN {_tidy('before')} WHEN 5 THEN '' ELSE {_tidy('t')} END AS venue,
      CASE way WHEN 1 THEN {_formatted('rest', 'rcity')} WHEN 2 THEN apart WHEN 3 THEN waddress WHEN 4 THEN {_formatted('behind', 'bcity')} WHEN 5 THEN {_formatted('t', 'city')} ELSE coalesce(city, 'San Francisco, CA') END AS address,
      CASE way WHEN 1 THEN 0.8 WHEN 2 THEN CASE WHEN vkey THEN 0.7 ELSE 0.6 END WHEN 3 THEN round(tenths * 0.07, 2) WHEN 4 THEN 0.5 WHEN 7 THEN 0.2 ELSE 0.3 END AS confidence FROM f),
    h AS (SELECT *, {_city('address')} AS acity FROM g),
    z AS (SELECT *, {_without('address', 'acity')} AS cut FROM h)
    SELECT id, CASE WHEN t = '' THEN '' ELSE {_tidy('venue')} END AS venue, CASE WHEN t = '' OR (address = '' AND venue = '') THEN '' WHEN address = '' THEN venue || ', San Francisco, CA' WHEN contains(address, ',') THEN address WHEN acity IS NULL THEN address || ', San Francisco, CA' WHEN cut = '' THEN acity ELSE cut || ', ' || acity END AS address,
    CAST(CASE WHEN t = '' THEN 0 ELSE confidence END AS DOUBLE) AS confidence, CASE WHEN t = '' THEN 'unknown' WHEN way = 1 THEN 'pattern' WHEN way = 2 THEN 'structure' WHEN way = 3 THEN 'keyword' WHEN way = 4 THEN 'context' ELSE 'fallback' END AS strategy FROM z""",
)
def located_venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.expr(_input()).alias("said"))
    return locating.located(rows, "said").drop("said")
