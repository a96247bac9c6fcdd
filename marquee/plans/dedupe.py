"""Queries on duplicate events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marquee.operators import dedupe
from marquee.plans.derive import EVENTS, events
from marquee.plans.registry import query

_FOLD = "lower(trim(regexp_replace({}, '\\s+', ' ', 'g')))"
_KEYED = rf"""k AS (SELECT *, CASE WHEN {_FOLD.format('title')} <> '' AND date <> '' THEN concat_ws('|||', {_FOLD.format('title')}, split_part(date, 'T', 1), {_FOLD.format('venue')},
  CASE WHEN regexp_matches(startTime, 'T\d{{2}}:\d{{2}}') THEN regexp_extract(startTime, 'T(\d{{2}}:\d{{2}})', 1) ELSE trim(startTime) END) END AS dup_key FROM {EVENTS})"""
_RANKED = f"""WITH {_KEYED}, r AS (SELECT *, count(*) OVER (PARTITION BY dup_key) AS group_size,
  row_number() OVER (PARTITION BY dup_key ORDER BY has_image DESC, created DESC, ord) AS rank FROM k WHERE dup_key IS NOT NULL)"""


@query("dedupe_ranked", f"{_RANKED} SELECT collection, event_id, dup_key, group_size, CAST(rank AS INT) AS rank, CASE rank WHEN 1 THEN 'KEEP' ELSE 'DELETE' END AS status FROM r WHERE group_size > 1")
def dedupe_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.ranked(events(spark, sf_dir)).select("collection", "event_id", "dup_key", "group_size", "rank", "status")


@query(
    "dedupe_summary",
    f"""WITH {_KEYED}, g AS (SELECT dup_key, count(*) AS n FROM k GROUP BY dup_key) SELECT CAST(sum(n) AS BIGINT) AS total_events,
    CAST(coalesce(sum(n) FILTER (WHERE dup_key IS NULL), 0) AS BIGINT) AS invalid_events, count(*) FILTER (WHERE dup_key IS NOT NULL AND n > 1) AS duplicate_groups,
    CAST(coalesce(sum(n - 1) FILTER (WHERE dup_key IS NOT NULL AND n > 1), 0) AS BIGINT) AS events_to_delete FROM g""",
)
def dedupe_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.summary(events(spark, sf_dir))


@query("dedupe_kept", f"{_RANKED} SELECT collection, event_id FROM {EVENTS} e WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.event_id = e.event_id AND r.collection = e.collection AND rank > 1)")
def dedupe_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.without_deleted(events(spark, sf_dir)).select("collection", "event_id")
