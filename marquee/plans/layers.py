"""Queries on merged layers; parts stand for what layers say."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.operators import layers
from marquee.plans.registry import query
from marquee.session import table

FIELDS = ["title", "date", "venue", "tags"]


def layer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    field = F.get(F.array(*map(F.lit, FIELDS)), (F.floor(k / 6) % 4).cast("int"))
    return table(spark, sf_dir, "part").select(
        F.floor(k / 24).alias("page_id"), (1 + k % 6).cast("int").alias("layer"), field.alias("field"), F.when(field == "tags", "array").otherwise("scalar").alias("kind"),
        F.array("p_brand").alias("value"), (F.col("p_size") % 10 * 10).cast("double").alias("confidence"),
    )


ROWS = """(SELECT CAST(p_partkey // 24 AS BIGINT) AS page_id, CAST(1 + p_partkey % 6 AS INT) AS layer, list_extract(['title', 'date', 'venue', 'tags'], CAST(p_partkey // 6 % 4 AS BIGINT) + 1) AS field, p_brand AS value, CAST(p_size % 10 * 10 AS DOUBLE) AS confidence FROM part)"""


@query(
    "layer_values",
    f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY page_id, field ORDER BY confidence DESC, layer) AS rank FROM {ROWS}), u AS (SELECT page_id, field, value, min(rank) AS rank FROM r GROUP BY ALL)
    SELECT page_id, field, string_agg(value, ',' ORDER BY rank) AS value FROM u WHERE field = 'tags' OR rank = 1 GROUP BY page_id, field""",
)
def layer_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.merged_values(layer_rows(spark, sf_dir)).withColumn("value", F.array_join("value", ","))


@query(
    "layer_confidence",
    f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY page_id, field ORDER BY confidence DESC, layer) AS rank, list_extract([1.0, 0.8, 0.7, 0.6, 0.4, 0.5], layer) AS w FROM {ROWS}),
    f AS (SELECT r.page_id, r.field, coalesce(sum(r.w * r.confidence) FILTER (WHERE r.value = t.value AND r.field <> 'tags') / sum(r.w) FILTER (WHERE r.value = t.value AND r.field <> 'tags'), 0) AS c FROM r JOIN r t ON r.page_id = t.page_id AND r.field = t.field AND t.rank = 1 GROUP BY ALL)
    SELECT page_id, CAST(floor(round(sum(CASE WHEN field IN ('title', 'date', 'address') THEN 2.0 ELSE 1.0 END * c) / sum(CASE WHEN field IN ('title', 'date', 'address') THEN 2.0 ELSE 1.0 END), 9) + 0.5) AS BIGINT) AS overall FROM f GROUP BY page_id""",
)
def layer_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.overall_confidence(layers.field_confidence(layer_rows(spark, sf_dir)))


@query("layer_sources", f"SELECT page_id, field, string_agg(DISTINCT layer, ',' ORDER BY layer) AS layers FROM {ROWS} GROUP BY page_id, field")
def layer_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.sources(layer_rows(spark, sf_dir)).withColumn("layers", F.array_join("layers", ","))
