"""Merging what several layers say about the fields of a page.

Rows: page_id, layer, field, value (array of text), kind (scalar, array or
object), confidence, and for objects a map. Per field the layers are ordered by
confidence, ties by layer; scalars take the first, arrays the union in that
order, and of objects the lowest confidence has the last word on a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of layers 1 to 6, and of fields that count double.
LAYER_WEIGHTS = [1.0, 0.8, 0.7, 0.6, 0.4, 0.5]
KEY_FIELDS = ["title", "date", "address"]


def ranked(rows: DataFrame) -> DataFrame:
    """Rows with their rank within page and field."""
    w = Window.partitionBy("page_id", "field").orderBy(F.col("confidence").desc(), "layer")
    return rows.withColumn("rank", F.row_number().over(w))


def merged_values(rows: DataFrame) -> DataFrame:
    """page_id, field and value: the best layer's, or for arrays the union of all layers in order. A page's layers are six at most."""
    each = rows.groupBy("page_id", "field").agg(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("c"), "layer", "kind", "value"))).alias("all"))
    union = F.array_distinct(F.flatten(F.transform("all", lambda x: x["value"])))
    return each.select("page_id", "field", F.when(F.col("all")[0]["kind"] == "array", union).otherwise(F.col("all")[0]["value"]).alias("value"))


def merged_objects(rows: DataFrame) -> DataFrame:
    """page_id, field and object (map): keys of all layers, each with the value of the layer of lowest confidence that has it."""
    entries = rows.filter("kind = 'object'").select("page_id", "field", "confidence", "layer", F.explode("object").alias("k", "v"))
    last = entries.groupBy("page_id", "field", "k").agg(F.max(F.struct((-F.col("confidence")).alias("c"), "layer", "v")).alias("e"))
    return last.groupBy("page_id", "field").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "e.v")))).alias("object"))


def _weight(layer: Column) -> Column:
    return F.get(F.array(*(F.lit(w) for w in LAYER_WEIGHTS)), layer - 1)


def field_confidence(rows: DataFrame) -> DataFrame:
    """Confidence of each merged field: weighted mean over the layers that say exactly the merged value, 0 if none does."""
    both = rows.join(merged_values(rows).withColumnRenamed("value", "merged"), ["page_id", "field"])
    w = F.when((F.col("value") == F.col("merged")) & (F.col("kind") == "scalar"), _weight(F.col("layer")))
    return both.groupBy("page_id", "field").agg(F.coalesce(F.try_divide(F.sum(w * F.col("confidence")), F.sum(w)), F.lit(0.0)).alias("confidence"))


def overall_confidence(fields: DataFrame) -> DataFrame:
    """Weighted mean over a page's fields, to nine decimals and then rounded half up; title, date and address count double.

    Sums of doubles depend on the order of their rows in the last bits, which
    the nine decimals take off, so that a mean of exactly a half is always rounded up.
    """
    w = F.when(F.col("field").isin(KEY_FIELDS), 2.0).otherwise(1.0)
    mean = F.round(F.sum(w * F.col("confidence")) / F.sum(w), 9)
    return fields.groupBy("page_id").agg(F.floor(mean + 0.5).alias("overall"))


def sources(rows: DataFrame) -> DataFrame:
    """Layers that say something about a field."""
    return rows.groupBy("page_id", "field").agg(F.array_sort(F.collect_set("layer")).alias("layers"))


def kept_by_priority(rows: DataFrame) -> DataFrame:
    """page_id, field, value and confidence after the layers are taken one after another, in order: a value gives way if it is null or empty, or less sure than the next; ties keep the earlier one.

    The outcome depends on the order, as a surer blank takes the place of a
    value and then gives way to anything; so the layers of a field, few by
    nature, are folded in order.
    """
    each = rows.groupBy("page_id", "field").agg(F.array_sort(F.collect_list(F.struct("layer", "value", "confidence"))).alias("all"))
    gives_way = lambda kept, x: (F.coalesce(kept["value"], F.lit("")) == "") | (F.coalesce(kept["confidence"], F.lit(0.0)) < F.coalesce(x["confidence"], F.lit(0.0)))
    kept = F.aggregate(F.slice("all", F.lit(2), F.size("all")), F.col("all")[0], lambda kept, x: F.when(gives_way(kept, x), x).otherwise(kept))
    return each.withColumn("kept", kept).select("page_id", "field", "kept.value", "kept.confidence")
