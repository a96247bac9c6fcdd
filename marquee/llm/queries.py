"""The queries opN_<name> over whole tables, and DuckDB SQL where SQL can say the same."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm import audit, exact, licenses, lines, lm, mixing, ogg, pieces, sharding, simhash, substring, toxicity, whitening
from marquee.llm.batches import small_batches
from marquee.session import scratch_path, table

QUERIES = {}
ORACLE_SQL: dict[str, str] = {}


def _query(f):
    @functools.wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return f(spark, sf_dir)

    QUERIES[f.__name__] = run
    return run


@_query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(spark, sf_dir, "documents"))


@_query
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "source", "domain", "n_tokens", "posteriors", "rate", "copies")


@_query
def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@_query
def license_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.links(table(spark, sf_dir, "documents"))


@_query
def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.passages(table(spark, sf_dir, "documents"))


@_query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query
def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"))


@_query
def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_scores(table(spark, sf_dir, "documents"))


@_query
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = lines.drop_boilerplate(pages, lines.host_of(F.col("url")), lines.html_lines(F.col("html")))
    return found.select("page_id", "host", "n_lines", "n_dropped", "clean_text")


ORACLE_SQL["op8_line_dedup"] = r"""
WITH t AS (SELECT page_id, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) AS host,
  regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'g'),
    '(?i)</?(p|br|div|li|ul|ol|h[1-6]|nav|article|footer|header|section|table|tr|td|th|title|head|body|html)\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g') AS body FROM pages),
l AS (SELECT page_id, host, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS pos FROM t),
k AS (SELECT *, regexp_replace(line, '^[ \t\r\f]+|[ \t\r\f]+$', '', 'g') AS own FROM l),
h AS (SELECT host, count(*) AS pages FROM t GROUP BY host),
c AS (SELECT host, own, count(DISTINCT page_id) AS n FROM k WHERE own <> '' GROUP BY host, own),
bad AS (SELECT c.host, own FROM c JOIN h ON c.host = h.host WHERE n >= 3 AND n > 0.2 * pages)
SELECT k.page_id, k.host, CAST(count(*) AS INT) AS n_lines, CAST(count(bad.own) AS INT) AS n_dropped,
  coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE bad.own IS NULL), '') AS clean_text
FROM k LEFT JOIN bad ON k.host = bad.host AND k.own = bad.own GROUP BY k.page_id, k.host
"""


@_query
def op9_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.media_columns(table(spark, sf_dir, "documents"))


@_query
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"))


ORACLE_SQL["op10_exact_dedup"] = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
"""


@_query
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE_SQL["op11_filter_audit"] = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM t),
f AS (SELECT part, doc_id, [CASE WHEN len(words) < 50 THEN 1 ELSE 0 END, CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 1 ELSE 0 END,
  CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 1 ELSE 0 END, CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 1 ELSE 0 END, CASE WHEN doc_id > least THEN 1 ELSE 0 END] AS fails FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l ON f.doc_id = l.doc_id GROUP BY part, fails),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e WHERE a.x NOT IN (b.x, c.x, d.x, e.x) AND b.x NOT IN (c.x, d.x, e.x) AND c.x NOT IN (d.x, e.x) AND d.x <> e.x),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS letter, [CASE WHEN instr(filter_order, y) < step THEN 1 ELSE 0 END FOR y IN ['A', 'B', 'C', 'D', 'E']] AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (SELECT part, filter_order, step, letter, n, good, toxic, fails[instr('ABCDE', letter)] AS own, list_dot_product(fails, before) AS earlier, list_sum(fails) AS failed FROM c, s),
g AS (SELECT part, filter_order, step, letter, sum(CASE WHEN earlier = 0 AND own = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN earlier = 0 AND own = 1 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN earlier > 0 AND own = 1 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN own = 1 AND failed = 1 THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN earlier = 0 AND own = 1 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN earlier = 0 AND own = 1 THEN toxic ELSE 0 END) AS toxic_lost FROM r GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM g
"""


@_query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@_query
def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"), scratch_path(spark, "slot_map"))
