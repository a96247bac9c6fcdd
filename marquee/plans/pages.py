"""Queries on what pages say."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.functions import html
from marquee.operators import layers
from marquee.plans.registry import query
from marquee.session import table


@query("page_fields")
def page_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged fields of every page, from its tags."""
    rows = html.layer_rows(html.elements(table(spark, sf_dir, "pages")))
    return layers.merged_values(rows).select("page_id", "field", F.array_join("value", ",").alias("value"))
