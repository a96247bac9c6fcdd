"""Queries on the elements of pages.

The pages' own markup is plain, so that of some is made richer by the same rule
in Spark and in SQL. The SQL reads the tags by itself: a recursive query walks
over them with a stack, and everything below it compares intervals in pairs.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.functions import markup
from marquee.operators import selected
from marquee.plans.derive import quoted
from marquee.plans.registry import query
from marquee.session import materialise, table

#: What stands in a page's markup, a modulus, and what stands there instead by the page's remainder (None: the same); {k} is the page's number, {d} a day from 10 on.
VARIANTS = [
    ("<article>", 5, [
        None,
        '<article class="event-card big"><time datetime="2025-05-{d}">soon</time><p class="venue-name">Hall {k}</p><div class="event-details-date"><p>May {d}, 2025</p><p>later</p></div>',
        '<article typeof="schema:Event"><span property="schema:name">Name <b>{k}</b></span><meta property="schema:startDate" content="2025-01-{d}"><div typeof="Place"><span property="schema:name">Room {k}</span></div><span property="schema:description"> two  words </span><i property="dc:title">T{k}</i>',
        '<article class="event-location"><h2>House {k}</h2><p>{k} Main St<p class="event-date">May {d}, 2025 <span class="event-time">{d}:30 pm</span></p><img src="/img/{k}.jpg" alt><div class="event-details-location"><p>First {k}</p><p>Last {k}</div>',
        '<article itemscope itemtype="http://schema.org/MusicEvent"><h2 itemprop="name">Show {k}</h2><time itemprop="startDate" datetime="2025-06-{d}T20:00">x</time><div itemprop="location">at <span itemprop="name">Club {k}</span></div><img itemprop="image" src="/i/{k}.png"><div itemscope itemtype="http://schema.org/Event"><b itemprop="name">Inner {k}</b></div>',
    ]),
    ("<ul>", 3, [None, '<ul class="eventListings">', '<ul class="event-list"><li class="event-item"><h3>Item {k}</h3><span class="date">on {d}</span><div class="event-item"><h3>Nested</h3></div><li class="event-item"><span class="time">8:00</span><li class="event-item"><h3> </h3><i class="name">Second</i>']),
    ("<li><a ", 2, [None, '<li><a class="title" ']),
    ('<meta charset="utf-8">', 3, [None, '<meta charset="utf-8"><meta property="og:image" content="http://img.example/{d}.jpg"><meta name="twitter:title" content="Tw {k} | Site - x"><meta name="image" content="http://img.example/x.png">', '<meta name="title" content="ab">']),
    ("<h1>", 4, [None, "<h2>", '<h1> ab </h1><h2 class="Show-Title">', "<h4>\n12 menu\nA fine line {k}\n"]),
    ("<title>", 5, [None, "<title>- ", None, "<title>x|", None]),
    ("<b>", 3, [None, '<img class="Main-Photo" src="http://img.example/{k}.jpg" alt="Concert"><b>', '<div class="event-header"><img src="http://img.example/{d}.jpg" class="HERO"></div><img alt="the SHOW" src="no"><b>']),
    ("<footer>", 4, [None, '<footer class="ticket-price">${k}0.00 &amp; up, ', '<footer class="price-display">All free {k} ', '<footer class="description">']),
]


def _variant(text: str) -> str:
    parts = [quoted(p) if i % 2 == 0 else {"k": "CAST(page_id AS STRING)", "d": "CAST(10 + page_id % 18 AS STRING)"}[p] for i, p in enumerate(re.split(r"\{(\w)\}", text))]
    return " || ".join(parts)


def _rich() -> str:
    """One expression for both engines."""
    out = "html"
    for find, modulus, own in VARIANTS:
        cases = " ".join(f"WHEN page_id % {modulus} = {i} THEN {_variant(t or find)}" for i, t in enumerate(own))
        out = f"replace({out}, {quoted(find)}, CASE {cases} ELSE {quoted(find)} END)"
    return out


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").selectExpr("page_id", f"{_rich()} AS html")


def page_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(markup.elements(pages(spark, sf_dir)), "elements")


_LIST = lambda names: "(" + ", ".join(map(quoted, names)) + ")"


def _last_of(names: list[str]) -> str:
    return f"coalesce(list_max(list_filter(range(1, len(stack) + 1), lambda j: stack[j].tag IN {_LIST(names)})), 0)"


def _ended(tags: list[str], shields: list[str]) -> str:
    return f"CASE WHEN {_last_of(tags)} > {_last_of(shields)} THEN {_last_of(tags)} - 1 ELSE len(stack) END"


_CUT = f"""CASE WHEN kind = 'close' THEN CASE WHEN list_contains(list_transform(stack, lambda s: s.tag), tag) THEN list_max(list_filter(range(1, len(stack) + 1), lambda j: stack[j].tag = tag)) - 1 ELSE len(stack) END
  WHEN kind = 'open' THEN least(CASE WHEN tag IN {_LIST(markup.BLOCKS)} THEN {_ended(["p"], markup.P_SHIELDS)} ELSE len(stack) END,
    CASE {" ".join(f"WHEN tag = {quoted(t)} THEN {_ended(*rule)}" for t, rule in markup.ENDS.items())} ELSE len(stack) END) ELSE len(stack) END"""

#: Elements e (page_id, pre, last, parent, depth, tag, tok, start, stop, child, children, said) of the pages.
ELEMENTS = rf"""RECURSIVE toks AS MATERIALIZED (SELECT page_id, unnest(t) AS tok, generate_subscripts(t, 1) AS i FROM (SELECT page_id,
    regexp_extract_all(regexp_replace(coalesce({_rich()}, ''), '<[^>]*$', ''), '(?s)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>|<![^>]*>|</?[A-Za-z][^>]*>|[^<]+|<') AS t FROM pages)),
k AS MATERIALIZED (SELECT *, CASE WHEN regexp_matches(tok, '^<(script|style)\b') THEN 'raw' WHEN tok LIKE '<!%' THEN 'none' WHEN regexp_matches(tok, '^</[A-Za-z]') THEN 'close' WHEN regexp_matches(tok, '^<[A-Za-z]') THEN 'open' ELSE 'text' END AS kind,
  lower(regexp_extract(tok, '^</?([A-Za-z][^\s/>]*)', 1)) AS tag FROM toks),
walk AS (SELECT page_id, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(i BIGINT, tag VARCHAR)[]) AS stack, CAST([] AS BIGINT[]) AS popped, CAST(NULL AS BIGINT) AS up FROM pages
  UNION ALL SELECT page_id, i, CASE WHEN kind = 'open' AND tag NOT IN {_LIST(markup.VOID)} THEN list_append(stack[1:cut], {{'i': i, 'tag': tag}}) ELSE stack[1:cut] END, list_transform(stack[cut + 1:], lambda s: s.i),
    CASE WHEN kind IN ('open', 'raw') THEN coalesce(stack[cut].i, 0) END
    FROM (SELECT w.page_id, k.i, k.kind, k.tag, w.stack, CAST({_CUT} AS BIGINT) AS cut FROM walk w JOIN k ON w.page_id = k.page_id AND k.i = w.i + 1)),
ends AS (SELECT page_id, unnest(popped) AS o, i AS c FROM walk),
said AS (SELECT page_id, i, CASE WHEN kind = 'text' THEN replace(replace(replace(replace(replace(tok, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>') ELSE '' END AS raw FROM k),
plain AS (SELECT page_id, i, regexp_replace(raw, '&amp;?', '&', 'g') AS t FROM said),
whole AS (SELECT page_id, string_agg(t, '' ORDER BY i) AS page FROM plain GROUP BY page_id),
marks AS (SELECT k.*, sum(CASE WHEN kind IN ('open', 'raw') THEN 1 ELSE 0 END) OVER u AS opens, coalesce(sum(length(t)) OVER u, 0) AS chars, count(*) OVER (PARTITION BY k.page_id) AS n FROM k JOIN plain USING (page_id, i) WINDOW u AS (PARTITION BY k.page_id ORDER BY k.i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
stops AS (SELECT m.*, w.up, CASE WHEN m.kind = 'raw' OR m.tag IN {_LIST(markup.VOID)} THEN m.i ELSE coalesce(ends.c - 1, m.n) END AS final FROM marks m JOIN walk w ON m.page_id = w.page_id AND m.i = w.i LEFT JOIN ends ON m.page_id = ends.page_id AND m.i = ends.o WHERE m.kind IN ('open', 'raw')),
e0 AS (SELECT s.page_id, s.opens AS pre, f.opens AS last, coalesce(p.opens, 0) AS parent, s.tag, s.tok, s.chars AS start, f.chars AS stop FROM stops s JOIN marks f ON s.page_id = f.page_id AND f.i = s.final LEFT JOIN marks p ON p.page_id = s.page_id AND p.i = s.up
  UNION ALL SELECT page_id, 0, coalesce((SELECT max(opens) FROM marks m WHERE m.page_id = pages.page_id), 0), NULL, '#page', '', 0, coalesce((SELECT length(page) FROM whole w WHERE w.page_id = pages.page_id), 0) FROM pages),
e AS MATERIALIZED (SELECT a.*, (SELECT count(*) FROM e0 b WHERE b.page_id = a.page_id AND b.pre < a.pre AND b.last >= a.pre) AS depth, CASE WHEN a.pre = 0 THEN 1 ELSE row_number() OVER (PARTITION BY a.page_id, a.parent ORDER BY a.pre) END AS child,
  (SELECT count(*) FROM e0 b WHERE b.page_id = a.page_id AND b.parent = a.pre) AS children, substr(coalesce(page, ''), CAST(a.start AS BIGINT) + 1, CAST(a.stop - a.start AS BIGINT)) AS said FROM e0 a LEFT JOIN whole USING (page_id))"""


def _attr(t: str, name: str) -> str:
    return rf"CASE WHEN regexp_matches({t}.tok, '\s{name}([\s>]|=)') THEN regexp_extract({t}.tok, '\s{name}=\"([^\"]*)\"', 1) END"


def _is(compound: str, t: str) -> str:
    """A compound selector over row ``t`` of e."""
    out = [f"{t}.tag = '{m[0]}'" for m in [re.match(r"[a-z][a-z0-9]*", compound)] if m] or [f"{t}.pre > 0"]
    out += [rf"regexp_matches({_attr(t, 'class')}, '(^|\s){c}(\s|$)')" for c in re.findall(r"\.([\w-]+)", re.sub(r"\[[^\]]*\]", "", compound))]
    out += [f"{_attr(t, a)} {'ILIKE' if fold else 'LIKE'} {quoted('%' + v + '%' if op else v)}" if v else f"{_attr(t, a)} IS NOT NULL" for a, op, v, fold in re.findall(r'\[([\w-]+)(?:(\*)?="([^"]*)"( i)?)?\]', compound)]
    out += [f"{t}.child = 1"] if ":first-child" in compound else []
    out += [f"{t}.child = (SELECT children FROM e up WHERE up.page_id = {t}.page_id AND up.pre = {t}.parent)"] if ":last-child" in compound else []
    return " AND ".join(out)


def _chain(chain: list[str], t: str = "x") -> str:
    if len(chain) == 1:
        return _is(chain[0], t)
    up = t + "a"
    return f"{_is(chain[-1], t)} AND EXISTS (SELECT 1 FROM e {up} WHERE {up}.page_id = {t}.page_id AND {up}.pre < {t}.pre AND {t}.pre <= {up}.last AND {_chain(chain[:-1], up)})"


def _found(css: str) -> str:
    return " OR ".join(f"({_chain(re.split(chr(32) + r'(?!i])', c.strip()))})" for c in css.split(","))


_PRE = "x.page_id, CAST(x.pre AS INT) AS pre"
_TRIM = r"regexp_replace({}, '^[\s\x{{00A0}}]+|[\s\x{{00A0}}]+$', '', 'g')"
_SQUEEZE = r"regexp_replace(regexp_replace({}, '[\s\x{{00A0}}]+', ' ', 'g'), '^ | $', '', 'g')"
_INTS = ", ".join(f"CAST({c} AS INT) AS {c}" for c in ("pre", "last", "parent", "depth", "start", "stop", "child", "children"))


@query("page_elements", f"WITH {ELEMENTS} SELECT page_id, {_INTS}, tag, {_attr('e', 'class')} AS class, md5(said) AS said FROM e")
def page_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = page_table(spark, sf_dir)
    return markup.texts(rows, rows).select("page_id", "pre", "last", "parent", "depth", "start", "stop", "child", "children", "tag", F.col("attrs")["class"].alias("class"), F.md5("said").alias("said"))


def _sure(field: str, css: str, base: int) -> int:
    more = 5 * (f'[class*="{field}"]' in css or f'[data-testid*="{field}"]' in css) + 10 * ({"date": "time", "address": "address"}.get(field, "\n") in css) - 10 * (css in ("img", "h1", "p"))
    return max(10, min(100, base + more))


def _value(field: str) -> str:
    if field == "image":
        return f"coalesce(nullif({_attr('x', 'src')}, ''), nullif({_attr('x', 'data-src')}, ''), nullif({_attr('x', 'data-lazy-src')}, ''))"
    return f"coalesce(nullif({_attr('x', 'datetime')}, ''), x.said)" if field in ("date", "time") else "x.said"


def _valid(field: str) -> str:
    v = _TRIM.format("value")
    lengths = {"title": (3, 200), "description": (10, 2000), "venue": (3, 300), "address": (3, 300)}
    shapes = {
        "price": r"(?i)[$€£¥₹]|\bfree\b|\b\d+\b", "date": r"(?i)\d{4}|\d{1,2}/\d{1,2}|\d{1,2}-\d{1,2}|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec", "time": r"(?i)\d{1,2}:\d{2}|\d{1,2}\s*(am|pm)",
        "image": r"\.([jJ][pP][gG]|[jJ][pP][eE][gG]|[pP][nN][gG]|[wW][eE][bB][pP]|[gG][iI][fF])(\?|$)|image|img",
    }
    return f"length({v}) BETWEEN {lengths[field][0]} AND {lengths[field][1]}" if field in lengths else f"{v} <> '' AND regexp_matches({v}, {quoted(shapes[field])})"


_CANDIDATES = " UNION ALL ".join(
    f"SELECT page_id, pre, '{field}' AS field, {rank} AS rank, {_sure(field, css, base)} AS confidence, value FROM (SELECT {_PRE}, {_value(field)} AS value FROM e x WHERE {_found(css)}) WHERE {_valid(field)}"
    for field, own in selected.SEMANTIC.items()
    for rank, (css, base) in enumerate(own)
)


@query(
    "selected_fields",
    f"WITH {ELEMENTS}, c AS ({_CANDIDATES}), r AS (SELECT *, row_number() OVER (PARTITION BY page_id, field ORDER BY rank, pre) AS place FROM c) SELECT page_id, field, {_SQUEEZE.format('value')} AS value, CAST(confidence AS INT) AS confidence FROM r WHERE place = 1",
)
def selected_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selected.selected_fields(page_table(spark, sf_dir)).withColumn("confidence", F.col("confidence").cast("int"))


_SCOPE = "(SELECT max(s.pre) FROM e s WHERE s.page_id = x.page_id AND s.pre <= x.pre AND x.pre <= s.last AND {})"
_RDFA = f"""p AS (SELECT {_PRE}, CAST({_SCOPE.format(_attr('s', 'typeof') + ' IS NOT NULL')} AS INT) AS scope, {_attr('x', 'property')} AS property, {_SQUEEZE.format(f"coalesce(nullif({_attr('x', 'content')}, ''), x.said)")} AS value FROM e x WHERE {_attr('x', 'property')} IS NOT NULL),
q AS (SELECT *, CASE property {" ".join(f"WHEN '{p}' THEN '{f}'" for p, f in selected.PROPERTIES)} END AS field, list_position({[p for p, _ in selected.PROPERTIES]}, property) AS late FROM p WHERE value <> ''),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id, scope, field ORDER BY late DESC, pre) AS place FROM q WHERE field IS NOT NULL)"""


@query("rdfa_scopes", f"WITH {ELEMENTS}, {_RDFA} SELECT r.page_id, scope, {_attr('s', 'typeof')} AS type, field, value FROM r LEFT JOIN e s ON s.page_id = r.page_id AND s.pre = r.scope WHERE place = 1")
def rdfa_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selected.rdfa(page_table(spark, sf_dir))


@query("rdfa_fields", f"WITH {ELEMENTS}, {_RDFA}, b AS (SELECT *, row_number() OVER (PARTITION BY page_id, field ORDER BY scope NULLS FIRST) AS best FROM r WHERE place = 1) SELECT page_id, field, value, CAST(70 AS INT) AS confidence FROM b WHERE best = 1")
def rdfa_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selected.rdfa_fields(selected.rdfa(page_table(spark, sf_dir)))


_EVENT_SCOPE = f"(SELECT max(s.pre) FROM e s WHERE s.page_id = x.page_id AND s.pre < x.pre AND x.pre <= s.last AND {_attr('s', 'itemtype')} LIKE '%Event%')"


@query(
    "microdata_fields",
    f"""WITH {ELEMENTS}, p AS (SELECT {_PRE}, {_EVENT_SCOPE} AS scope, {_attr('x', 'itemprop')} AS prop, x.said, nullif({_attr('x', 'datetime')}, '') AS dt, nullif({_attr('x', 'src')}, '') AS src,
    (SELECT said FROM e n WHERE n.page_id = x.page_id AND n.pre > x.pre AND n.pre <= x.last AND {_attr('n', 'itemprop')} = 'name' ORDER BY n.pre LIMIT 1) AS name FROM e x WHERE {_attr('x', 'itemprop')} IS NOT NULL),
    v AS (SELECT *, {_SQUEEZE.format("CASE WHEN prop LIKE '%Date' THEN coalesce(dt, said) WHEN prop = 'image' THEN src WHEN prop = 'location' THEN coalesce(name, said) ELSE said END")} AS value, row_number() OVER (PARTITION BY page_id, scope, prop ORDER BY pre) AS place FROM p WHERE scope IS NOT NULL),
    b AS (SELECT *, row_number() OVER (PARTITION BY page_id, prop ORDER BY scope DESC) AS best FROM v WHERE place = 1 AND value <> '')
    SELECT page_id, CASE prop {" ".join(f"WHEN '{p}' THEN '{f}'" for p, f in selected.ITEMPROPS.items())} END AS field, value, CAST(75 AS INT) AS confidence FROM b WHERE best = 1""",
)
def microdata_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selected.microdata(page_table(spark, sf_dir))


def _firsts(fields: dict[str, list[str]], where: str = "TRUE", key: str = "NULL") -> str:
    """Of each selector the first element (of a page and ``key``), and of those that say something the first selector's."""
    each = " UNION ALL ".join(
        f"SELECT x.page_id, {key} AS holder, '{f}' AS field, {i} AS rank, x.pre, {_TRIM.format('x.said')} AS value, {_attr('x', 'datetime') if '[datetime]' in css else 'NULL'} AS dt FROM e x{', held' if key != 'NULL' else ''} WHERE ({_found(css)}) AND {where}" for f, own in fields.items() for i, css in enumerate(own)
    )
    return f"""a AS ({each}), b AS (SELECT *, row_number() OVER (PARTITION BY page_id, holder, field, rank ORDER BY pre) AS place FROM a), d AS (SELECT *, coalesce(nullif(value, ''), nullif(dt, '')) AS v FROM b WHERE place = 1),
    g AS (SELECT page_id, holder, field, v, row_number() OVER (PARTITION BY page_id, holder, field ORDER BY rank) AS best FROM d WHERE v IS NOT NULL), chosen AS (SELECT * FROM g WHERE best = 1)"""


def _of(field: str) -> str:
    return f"max(v) FILTER (WHERE field = '{field}')"


@query(
    "filled_fields",
    f"""WITH {ELEMENTS}, {_firsts(selected.FILLS)}, w AS (SELECT page_id, {", ".join(f"{_of(f)} AS {f}" for f in selected.FILLS)} FROM chosen GROUP BY page_id)
    SELECT p.page_id, CASE WHEN p.page_id % 3 = 0 THEN 'Known' ELSE coalesce(w.title, 'Untitled Event') END AS title, w.date, CASE WHEN p.page_id % 4 = 1 THEN 'Place' ELSE w.venue END AS venue, w.address, substr(w.description, 1, 500) AS description,
    CASE WHEN p.page_id % 7 = 0 THEN FALSE ELSE lower(price) LIKE '%free%' OR lower(price) LIKE '%$0%' OR lower(price) LIKE '%0.00%' END AS free FROM pages p LEFT JOIN w ON p.page_id = w.page_id""",
)
def filled_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    none = F.lit(None).cast("string")
    events = table(spark, sf_dir, "pages").select("page_id", F.when(k % 3 == 0, "Known").alias("title"), none.alias("date"), F.when(k % 4 == 1, "Place").when(k % 4 == 2, "").alias("venue"), none.alias("address"), none.alias("description"), F.when(k % 7 == 0, False).alias("free"))
    return selected.filled(events, page_table(spark, sf_dir))


_RECORDS = f"""found AS ({" UNION ALL ".join(f"SELECT x.page_id, x.pre, x.last, {i} AS hit FROM e x WHERE {_found(css)}" for i, css in enumerate(selected.CONTAINERS))}),
    least AS (SELECT page_id, min(hit) AS hit FROM found GROUP BY page_id), kind AS (SELECT f.* FROM found f JOIN least l ON f.page_id = l.page_id AND f.hit = l.hit),
    held AS (SELECT page_id AS held_page, pre AS at, last AS until FROM kind k WHERE NOT EXISTS (SELECT 1 FROM kind o WHERE o.page_id = k.page_id AND o.pre < k.pre AND k.pre <= o.last)),
    {_firsts(selected.RECORD, "held.held_page = x.page_id AND x.pre > held.at AND x.pre <= held.until", "held.at")},
    w AS (SELECT page_id, holder, {", ".join(f"{_of(f)} AS {f}" for f in selected.RECORD)} FROM chosen GROUP BY page_id, holder)"""


@query(
    "event_records",
    f"""WITH {ELEMENTS}, {_RECORDS}, t AS (SELECT page_id, CAST(holder AS INT) AS container, title, date, time, CAST(row_number() OVER (PARTITION BY page_id ORDER BY holder) AS INT) AS position FROM w WHERE title IS NOT NULL)
    SELECT *, CAST(least(count(*) OVER (PARTITION BY page_id), 5) AS INT) AS total, CAST((position - 1) // 3 AS INT) AS batch FROM t QUALIFY position <= 5""",
)
def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selected.listing(selected.records(page_table(spark, sf_dir)), most=5)


_SHOWN = " UNION ALL ".join(f"SELECT {_PRE}, {i} AS hit, {_attr('x', 'src' if css in selected.IMAGES else 'content')} AS url FROM e x WHERE {_found(css)}" for i, css in enumerate([*selected.IMAGES, *selected.IMAGE_METAS]))


@query(
    "page_images",
    rf"""WITH {ELEMENTS}, a AS ({_SHOWN}), f AS (SELECT * FROM a QUALIFY hit < {len(selected.IMAGES)} OR row_number() OVER (PARTITION BY page_id, hit ORDER BY pre) = 1),
    u AS (SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY hit, pre) AS again FROM f WHERE url LIKE 'http://%' AND (regexp_matches(url, '(?i)\.(jpg|jpeg|png|gif|webp|svg)(\?.*)?$') OR regexp_matches(url, '(?i)image|img|photo|pic|cdn|media')))
    SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY hit, pre) AS INT) AS position, url FROM u WHERE again = 1""",
)
def page_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selected.page_images(page_table(spark, sf_dir))


_HEADS = " UNION ALL ".join(f"SELECT x.page_id, x.pre, {i} AS hit, {_TRIM.format('x.said')} AS said, {_attr('x', 'content')} AS content FROM e x WHERE {_found(css)}" for i, css in enumerate([*selected.TITLES, *selected.TITLE_METAS, "body"]))
_N, _BODY = len(selected.TITLES), len(selected.TITLES) + len(selected.TITLE_METAS)


@query(
    "universal_titles",
    rf"""WITH {ELEMENTS}, a AS ({_HEADS}), f AS (SELECT *, CASE WHEN hit < {_BODY - 1} THEN content ELSE said END AS head FROM a QUALIFY row_number() OVER (PARTITION BY page_id, hit ORDER BY pre) = 1),
    l AS (SELECT page_id, min(i) AS i FROM (SELECT page_id, unnest(string_split(said, chr(10))) AS line, generate_subscripts(string_split(said, chr(10)), 1) AS i FROM f WHERE hit = {_BODY}) WHERE length(trim(line)) BETWEEN 11 AND 99 AND NOT regexp_matches(lower(line), 'home|menu|search') AND NOT regexp_matches(trim(line), '^[0-9]') AND regexp_matches(line, '[A-Za-z]{{3,}}') GROUP BY page_id),
    v AS (SELECT f.page_id, hit, CASE WHEN hit < {_N} THEN CASE WHEN length(said) > 3 THEN said END WHEN hit < {_BODY} THEN CASE WHEN length(head) > 3 THEN {_TRIM.format("split_part(split_part(head, '|', 1), '-', 1)")} END ELSE trim(string_split(said, chr(10))[l.i]) END AS value FROM f LEFT JOIN l ON f.page_id = l.page_id),
    b AS (SELECT * FROM v WHERE value <> '' QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY hit) = 1)
    SELECT p.page_id, coalesce(value, 'Untitled Event') AS title, CASE WHEN hit < {_N} THEN 'heading' WHEN hit < {_BODY} THEN 'meta' WHEN hit = {_BODY} THEN 'line' ELSE 'default' END AS strategy FROM pages p LEFT JOIN b ON p.page_id = b.page_id""",
)
def universal_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selected.page_titles(page_table(spark, sf_dir))
