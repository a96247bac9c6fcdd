"""Choosing among image candidates (event_id, ord, url, score)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquee.functions.images import OCR_SUITABLE, dimensions, image_score, ocr_score, url_key, url_priority
from marquee.functions.validators import valid_image_url


def distinct_images(candidates: DataFrame) -> DataFrame:
    """Of candidates of an event that differ in size or query alone, the first."""
    w = Window.partitionBy("event_id", "_key").orderBy("ord")
    return candidates.withColumn("_key", url_key(F.col("url"))).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_key", "_r")


def best_images(candidates: DataFrame, most: int = 5) -> DataFrame:
    """Valid images of each event by priority, distinct, at most ``most``: event_id, rank, url, priority."""
    scored = candidates.filter(valid_image_url(F.col("url"))).withColumn("priority", url_priority(F.col("url")))
    # The best of those that differ in size alone comes first in its event too, so one shuffle by event serves both ranks.
    order = [F.col("priority").desc(), F.col("ord")]
    first = Window.partitionBy("event_id", "_key").orderBy(*order)
    rank = Window.partitionBy("event_id").orderBy(*order)
    keyed = scored.repartition("event_id").withColumn("_key", url_key(F.col("url"))).withColumn("_r", F.row_number().over(first)).filter("_r = 1")
    return keyed.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= most).select("event_id", "rank", "url", "priority")


def best_image(candidates: DataFrame) -> DataFrame:
    """The best by score, the first of equals; an event's only candidate needs no score."""
    return candidates.groupBy("event_id").agg(F.max_by("url", F.struct(F.coalesce("score", F.lit(-1.0)), -F.col("ord"))).alias("url"))


def first_of_url(candidates: DataFrame) -> DataFrame:
    """Of candidates of an event with the same URL, the first."""
    w = Window.partitionBy("event_id", "url").orderBy("ord")
    return candidates.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def scored_images(candidates: DataFrame, with_ocr: bool = False) -> DataFrame:
    """Images of known and sufficient size (event_id, ord, url, title, venue) with width, height, score, ocr_score, suitable and rank by score.

    Sizes are read from the URL where ``candidates`` has none.
    """
    rows = candidates if "width" in candidates.columns else candidates.withColumn("_d", dimensions(F.col("url"))).withColumns({"width": F.col("_d.width"), "height": F.col("_d.height")}).drop("_d")
    c = F.col
    rows = rows.withColumns({"score": image_score(c("url"), c("width"), c("height"), c("title"), c("venue"), with_ocr), "ocr_score": ocr_score(c("url"), c("width"), c("height"))}).filter("score is not null")
    w = Window.partitionBy("event_id").orderBy(c("score").desc(), "ord")
    return rows.withColumns({"suitable": c("ocr_score") >= OCR_SUITABLE, "rank": F.row_number().over(w)})


def readable_images(candidates: DataFrame, least: int = OCR_SUITABLE) -> DataFrame:
    """Candidates (url, width, height) whose OCR score is ``least`` or more, with ocr_score and rank."""
    w = Window.partitionBy("event_id").orderBy(F.col("ocr_score").desc(), "ord")
    rows = candidates.withColumn("ocr_score", ocr_score(F.col("url"), F.col("width"), F.col("height"))).filter(F.col("ocr_score") >= least)
    return rows.withColumn("rank", F.row_number().over(w))


def best_for_ocr(candidates: DataFrame) -> DataFrame:
    """Of each event's suitable images the best by score."""
    suitable = scored_images(candidates, with_ocr=True).filter("suitable")
    return suitable.groupBy("event_id").agg(F.max_by("url", F.struct("score", -F.col("ord"))).alias("url"))


def positive(candidates: DataFrame) -> DataFrame:
    """Candidates with a score above 0, ranked by it."""
    w = Window.partitionBy("event_id").orderBy(F.col("score").desc(), "ord")
    return candidates.filter("score > 0").withColumn("rank", F.row_number().over(w))
