"""Queries on names in titles and on times with zones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.functions import zones
from marquee.operators import names
from marquee.plans.derive import pick, pick_sql
from marquee.plans.registry import query
from marquee.session import table

TITLES = ["Jazz Night, {c}", "{c} Open Air {c}, {r}", "\"Show {n}\" {c} {r}", "{c}", "Fest {n} 12/5/2024", "Big Band at the Theatre", "Night in {c}, {r} with Band May 5, 2024", "{r} Blues", "Duo {c}land @ Hall", "United {c} Kings", "", "{c} {c} - "]
CITIES = ["UNITED KINGDOM", "United States", "united", "France", "New France", "Saudi Arabia.", "Peru"]
REGIONS = ["MIDDLE EAST", "Asia", "Africa"]
_TITLE = f"replace(replace(replace({pick_sql('o_orderkey', TITLES)}, '{{c}}', {pick_sql('o_custkey', CITIES)}), '{{r}}', {pick_sql('(o_custkey + o_orderkey)', REGIONS)}), '{{n}}', CAST(o_custkey AS VARCHAR))"
#: Places: the nations and some names that lie in or over others.
MORE = ["United", "New France", "States Arabia"]


@query(
    "titles_without_names",
    rf"""WITH n AS (SELECT string_agg(name, '|' ORDER BY length(name) DESC, name) AS p FROM (SELECT replace(n_name, ' ', '[ ]+') AS name FROM nation UNION SELECT unnest(['United', 'New[ ]+France', 'States[ ]+Arabia']))), r AS (SELECT string_agg(replace(r_name, ' ', '[ ]+'), '|') AS q FROM region),
    t AS (SELECT o_orderkey AS id, {_TITLE} AS title FROM orders), b AS (SELECT *, trim(regexp_replace(title, '^["'']([^"'']+?)["'']', '\1')) AS bare FROM t),
    c AS (SELECT id, title, regexp_replace(' ' || replace(bare, ' ', '  ') || ' ', '(?i),?[ ] *(' || p || ')[.,]*[ ]( *(' || q || ')[.,]*[ ])?', '  ', 'g') AS cut FROM b, n, r),
    s AS (SELECT id, title, trim(regexp_replace(cut, '\s+', ' ', 'g')) AS cut FROM c),
    d AS (SELECT id, title, regexp_replace(regexp_replace(cut, '(?i)\s*(\d{{1,2}}[-/]\d{{1,2}}[-/]\d{{2,4}}|\d{{4}}[-/]\d{{1,2}}[-/]\d{{1,2}}|\w+\s+\d{{1,2}},?\s+\d{{4}})\s*', '', 'g'), '(?i)\s*(?:at|@)\s*(?:the\s+)?(?:Theatre|Hall)\s*', '', 'g') AS cut FROM s)
    SELECT id, coalesce(nullif(regexp_replace(regexp_replace(cut, '\s+', ' ', 'g'), '^[,\s-]+|[,\s-]+$', '', 'g'), ''), title) AS cleaned FROM d""",
)
def titles_without_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    title = F.replace(F.replace(F.replace(pick(k, TITLES), F.lit("{c}"), pick(c, CITIES)), F.lit("{r}"), pick(c + k, REGIONS)), F.lit("{n}"), c.cast("string"))
    more = spark.createDataFrame([(n, "place") for n in MORE], "name string, kind string")
    known = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.lit("place").alias("kind")).unionByName(more).unionByName(table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.lit("region").alias("kind")))
    return names.without_names(table(spark, sf_dir, "orders").select(k.alias("id"), title.alias("title")), "id", "title", known).select("id", "cleaned")


WHEN = ["{h} - {e}pm {z}", "{h}:{m}-{e}:{m} AM {z}", "Friday, May {d}, 2025 at {h}:{m} PM", "jun {d} 2025 {h}:{m}am", "{d}/{d}/2025 {h}:{m} pm", "tonight", "{h}-{e} pm"]


@query(
    "zoned_times",
    f"""WITH t AS (SELECT o_orderkey AS id, o_orderkey % {len(WHEN)} AS f, 1 + o_custkey % 12 AS h, 1 + o_orderkey % 12 AS e, 10 + o_custkey % 50 AS m, 1 + o_custkey % 12 AS d, ['PDT', 'PST', 'EDT', 'EST', 'CDT', 'CST', 'MDT', 'MST'][1 + o_custkey % 8] AS z FROM orders),
    u AS (SELECT *, [7, 8, 4, 5, 5, 6, 6, 7][list_position(['PDT', 'PST', 'EDT', 'EST', 'CDT', 'CST', 'MDT', 'MST'], z)] AS west, h % 12 + CASE WHEN f IN (0, 2, 4) THEN 12 ELSE 0 END AS h24, e % 12 + CASE WHEN f = 0 THEN 12 ELSE 0 END AS e24, CASE WHEN f = 0 THEN 0 ELSE m END AS mm FROM t),
    v AS (SELECT *, CASE WHEN f < 2 THEN TIMESTAMP '2025-03-09 00:00:00' + to_hours(h24 + west) + to_minutes(mm) WHEN f = 2 THEN make_timestamp(2025, 5, d, h24, m, 0) WHEN f = 3 THEN make_timestamp(2025, 6, d, h24, m, 0) WHEN f = 4 THEN make_timestamp(2025, d, d, h24, m, 0) END AS start FROM u)
    SELECT id, strftime(start, '%Y-%m-%d %H:%M') AS start, CASE WHEN f < 2 THEN strftime(TIMESTAMP '2025-03-09 00:00:00' + to_hours(e24 + west + CASE WHEN e24 < h24 THEN 24 ELSE 0 END) + to_minutes(mm), '%Y-%m-%d %H:%M') END AS "end", CASE WHEN f < 5 THEN printf('%02d:%02d:00', h24, mm) END AS start_time, CASE WHEN f < 2 THEN printf('%02d:%02d:00', e24, mm) END AS end_time, CASE WHEN f < 2 THEN z END AS zone FROM v""",
)
def zoned_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    said = pick(k, WHEN)
    for name, value in (("{h}", 1 + c % 12), ("{e}", 1 + k % 12), ("{m}", 10 + c % 50), ("{d}", 1 + c % 12)):
        said = F.replace(said, F.lit(name), value.cast("string"))
    said = F.replace(said, F.lit("{z}"), pick(c, list(zones.OFFSETS)))
    rows = zones.instants(table(spark, sf_dir, "orders").select(k.alias("id"), said.alias("said")), "said", F.lit("2025-03-09").cast("date"))
    stamp = lambda x: F.date_format(x, "yyyy-MM-dd HH:mm")
    return rows.select("id", stamp("start").alias("start"), stamp("end").alias("end"), "start_time", "end_time", "zone")
