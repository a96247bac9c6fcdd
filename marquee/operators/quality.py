"""Statistics of result quality: grades, bins, spread, percentiles by rank, trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.operators.ranks import running

#: Lower bounds of grades and of bins.
GRADES = [(90, "A"), (80, "B"), (70, "C"), (60, "D")]
BINS = [90, 80, 70, 60]


def grade(score: Column) -> Column:
    out = F
    for low, name in GRADES:
        out = out.when(score >= low, name)
    return out.otherwise("F")


def bins(x: Column) -> dict[str, Column]:
    """Counts in 90-100, 80-89, 70-79, 60-69 and below."""
    out, above = {}, None
    for low in [*BINS, None]:
        inside = x.isNotNull() if low is None else x >= low
        out[f"bin_{low or 0}"] = F.count_if(inside if above is None else inside & (x < above))
        above = low
    return out


def accuracy(results: DataFrame) -> DataFrame:
    """Average, count, grade and bins of accuracy per category; null accuracies are not counted."""
    a = F.col("accuracy")
    out = results.filter(a.isNotNull()).groupBy("category").agg(F.avg(a).alias("average"), F.count("*").alias("n"), *(c.alias(k) for k, c in bins(a).items()))
    return out.withColumn("grade", grade(F.col("average")))


def correlation(x: Column, y: Column) -> Column:
    """Pearson's, from sums; 0 where either side is constant or there are no rows."""
    n = F.count("*").cast("double")
    top = n * F.sum(x * y) - F.sum(x) * F.sum(y)
    bottom = F.sqrt(F.greatest(F.lit(0.0), n * F.sum(x * x) - F.sum(x) * F.sum(x)) * F.greatest(F.lit(0.0), n * F.sum(y * y) - F.sum(y) * F.sum(y)))
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


def by_rank(rows: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Upper median (place n/2), p95 (place floor(.95n)) and nearest-rank p95 (place ceil(.95n)-1) per group, from counts of values.

    Values are counted first, and the counts are cumulated by ranges of values.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("c"))
    counts = running(counts, keys, value, F.col("c")).withColumnsRenamed({"_upto": "upto", "_total": "n"})
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col(value)))
    n = F.col("n")
    return counts.groupBy(*keys).agg(at(F.floor(n / 2)).alias("upper_median"), at(F.least(F.floor(n * 95 / 100), n - 1)).alias("p95"), at(F.ceil(n * 95 / 100) - 1).alias("p95_nearest"))


def consistency(value: Column) -> Column:
    """100 less the population deviation in percent of the mean, not below 0; 100 for fewer than two values."""
    share = F.try_divide(F.stddev_pop(value) * 100, F.avg(value))
    return F.when(F.count(value) < 2, 100.0).otherwise(F.greatest(F.lit(0.0), 100 - F.coalesce(share, F.lit(0.0))))


def completeness(fields: list[str]) -> dict[str, Column]:
    """Percent of rows in which each field is neither null nor empty; 0 without rows."""
    full = lambda f: F.coalesce(F.col(f).cast("string"), F.lit("")) != ""
    return {f: F.coalesce(F.try_divide(F.count_if(full(f)) * 100.0, F.count("*")), F.lit(0.0)) for f in fields}


def calibration(confidence: Column, acc: Column, least: float = 0.8) -> Column:
    """Average accuracy where confidence is ``least`` or more."""
    return F.avg(F.when(confidence >= least, acc))


def growth(value: Column, order: Column) -> Column:
    """Last less first in percent of the first."""
    first, last = F.min_by(value, order), F.max_by(value, order)
    return F.try_divide((last - first) * 100.0, first)


def error_class(kind: Column, message: Column) -> Column:
    return (
        F.when(F.contains(kind, F.lit("network")) | F.contains(message, F.lit("timeout")), "network")
        .when(F.contains(kind, F.lit("parsing")) | F.contains(message, F.lit("parse")), "parsing")
        .when(F.contains(kind, F.lit("validation")), "validation")
        .otherwise("other")
    )


def title_quality(title: Column) -> Column:
    points = lambda c, n: F.when(c, n).otherwise(0)
    size = F.length(title)
    broken = F.contains(title, F.lit("undefined")) | F.contains(title, F.lit("null"))
    return F.when(F.coalesce(title, F.lit("")) == "", 0).otherwise(100 - points(size < 5, 30) - points(size > 100, 20) - points(broken, 50))


def group_consistency(results: DataFrame, fields: list[str]) -> DataFrame:
    """Inputs of like length (bands of 20 characters) in groups of two or more: n and consistency, the sum over fields of (1 - variance of presence) * 100 / fields."""
    full = lambda f: (F.coalesce(F.col(f).cast("string"), F.lit("")) != "").cast("int")
    banded = results.filter(F.coalesce("input", F.lit("")) != "").withColumn("band", F.floor(F.length("input") / 20) * 20)
    parts = [(1 - F.coalesce(F.var_pop(full(f)), F.lit(0.0))) * (100 / len(fields)) for f in fields]
    return banded.groupBy("band").agg(F.count("*").alias("n"), sum(parts[1:], parts[0]).alias("consistency")).filter("n > 1")


def trend(rows: DataFrame, value: str, order: str, keys: list[str]) -> DataFrame:
    """Mean of the second half less mean of the first, split at n/2 in order."""
    r = running(rows, keys, order)
    first = F.col("_upto") <= F.floor(F.col("_total") / 2)
    return r.groupBy(*keys).agg((F.avg(F.when(~first, F.col(value))) - F.avg(F.when(first, F.col(value)))).alias("trend"))


def leak_risk(growth_percent: Column) -> Column:
    return F.when(growth_percent > 50, "HIGH").when(growth_percent > 20, "MEDIUM").otherwise("LOW")


def speed_score(ms: Column, most_ms: float) -> Column:
    return F.greatest(F.lit(0.0), 100 - ms / most_ms * 100)


def regressions(current: DataFrame, baseline: DataFrame, threshold: float = 10.0) -> DataFrame:
    """Per metric: change in percent of the baseline and status regression, improvement or stable; metrics without a baseline are new. Rows: metric, value, higher_is_better."""
    both = current.join(baseline.select("metric", F.col("value").alias("base")), "metric", "left")
    change = F.try_divide((F.col("value") - F.col("base")) * 100.0, F.col("base"))
    gain = F.when(F.col("higher_is_better"), change).otherwise(-change)
    return both.select("metric", change.alias("change"), F.when(F.col("base").isNull(), "new").when(gain < -threshold, "regression").when(gain > threshold, "improvement").otherwise("stable").alias("status"))


def weighted_total(scores: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted mean of the scores that are there and not zero; 0 without any."""
    there = {k: F.coalesce(c, F.lit(0.0)) != 0 for k, c in scores.items()}
    top = sum((F.when(there[k], scores[k] * weights[k]).otherwise(0.0) for k in scores), F.lit(0.0))
    return F.coalesce(F.try_divide(top, sum((F.when(there[k], weights[k]).otherwise(0.0) for k in scores), F.lit(0.0))), F.lit(0.0))


def address_quality(address: Column, city: str = "austin") -> Column:
    points = lambda c, n: F.when(c, n).otherwise(0)
    return F.when(F.coalesce(address, F.lit("")) == "", 50).otherwise(100 - points(~F.contains(address, F.lit(",")), 30) - points(~F.contains(F.lower(address), F.lit(city)), 20))


def date_quality(date: Column, time: Column, as_of: Column) -> Column:
    day = F.try_to_date(F.substring(date, 1, 10), "yyyy-MM-dd")
    missing = lambda x: F.coalesce(x, F.lit("")) == ""
    return 100 - F.when(missing(date), 50).when(day.isNull(), 40).when(day < as_of, 20).otherwise(0) - F.when(missing(time), 30).otherwise(0)


def compliance(fields: list[Column], address: Column) -> Column:
    """100 less 20 for each missing field and 20 for an address without a comma."""
    missing = sum((F.when(F.coalesce(c.cast("string"), F.lit("")) == "", 20).otherwise(0) for c in fields), F.lit(0))
    return 100 - missing - F.when((F.coalesce(address, F.lit("")) != "") & ~F.contains(address, F.lit(",")), 20).otherwise(0)


def most_frequent(rows: DataFrame, value: str) -> DataFrame:
    """The most frequent value; of equals, the one seen last (by ``ord``)."""
    return rows.groupBy(value).agg(F.count("*").alias("n"), F.min("ord").alias("first")).orderBy(F.col("n").desc(), F.col("first").desc()).limit(1)


def pass_rate(passed: Column, default: float = 0.0) -> Column:
    """Percent of true among those that are not null; ``default`` without any."""
    return F.coalesce(F.try_divide(F.count_if(passed) * 100.0, F.count(passed)), F.lit(default))


def mean_or_zero(x: Column) -> Column:
    return F.coalesce(F.avg(x), F.lit(0.0))


def rounded_mean(x: Column) -> Column:
    """Mean rounded half up, 0 without values."""
    return F.coalesce(F.floor(F.avg(x) + 0.5), F.lit(0))


def bands(x: Column, high: float = 80, low: float = 60) -> dict[str, Column]:
    """Percent of values of ``high`` or more, from ``low`` to below it, and below."""
    share = lambda c: F.try_divide(F.count_if(c) * 100.0, F.count(x))
    return {"high": share(x >= high), "medium": share((x >= low) & (x < high)), "low": share(x < low)}


#: Words of test names, in order.
TEST_KINDS = ["concert", "nightlife", "comedy", "sports", "food"]


def test_kind(name: Column) -> Column:
    """The first kind that a test's name has, or null."""
    return F.coalesce(*(F.when(F.contains(name, F.lit(k)), k) for k in TEST_KINDS))


def statistics(x: Column) -> dict[str, Column]:
    """Mean and population deviation to 2 decimals, least and most; zeros without values."""
    two = lambda c: F.coalesce(F.floor(c * 100 + 0.5) / 100, F.lit(0.0))
    return {"mean": two(F.avg(x)), "deviation": two(F.stddev_pop(x)), "least": F.coalesce(F.min(x), F.lit(0)), "most": F.coalesce(F.max(x), F.lit(0))}


def accuracy_overall(results: DataFrame) -> DataFrame:
    """``accuracy`` by category, by field, and over all (both null), in one pass of grouping sets."""
    a = F.col("accuracy")
    known = results.filter(a.isNotNull())
    out = known.groupingSets([["category"], ["field"], []], "category", "field").agg(F.avg(a).alias("average"), F.count("*").alias("n"), *(c.alias(k) for k, c in bins(a).items()))
    return out.withColumn("grade", grade(F.col("average")))


def confidence_report(confidence: Column, acc: Column, least_pairs: int = 5) -> dict[str, Column]:
    """Counts in four bands (.85, .65, .45), correlation with accuracy for over ``least_pairs`` pairs, average where .8 or more, whether that is a problem (under 75), and reliability."""
    sure = calibration(confidence, acc)
    pairs = F.count_if(confidence.isNotNull() & acc.isNotNull())
    return {
        "very_high": F.count_if(confidence >= 0.85), "high": F.count_if((confidence >= 0.65) & (confidence < 0.85)), "medium": F.count_if((confidence >= 0.45) & (confidence < 0.65)), "low": F.count_if(confidence < 0.45),
        "correlation": F.when(pairs > least_pairs, correlation(confidence, acc)), "calibration": sure, "miscalibrated": F.coalesce(sure < 75, F.lit(False)), "reliability": mean_or_zero(confidence) * 100,
    }


def mean_consistency(results: DataFrame, fields: list[str]) -> DataFrame:
    """Mean of ``group_consistency`` over groups; 100 without any."""
    return group_consistency(results, fields).agg(F.coalesce(F.avg("consistency"), F.lit(100.0)).alias("consistency"), F.count("*").alias("groups"))


def venue_quality(name: Column, expected: Column) -> Column:
    """50 without a name, 70 without the first word of the expected one."""
    first = F.get(F.split(F.lower(expected), " "), F.lit(0))
    return F.when(F.coalesce(name, F.lit("")) == "", 50).when(~F.contains(F.lower(name), first), 70).otherwise(100)


#: Categories that a mapping may give.
MAPPED = ["Music", "Comedy", "Arts & Theater", "Sports", "Food & Drink", "Community", "Business", "Health & Wellness", "Education", "Other"]


def category_quality(category: Column, expected: Column) -> Column:
    return F.when(F.coalesce(category, F.lit("")) == "", 50).when(~category.isin(MAPPED), 60).when(~category.eqNullSafe(expected), 80).otherwise(100)


def data_quality(events: DataFrame, keys: list[str], scores: dict[str, Column]) -> DataFrame:
    """Per group the best score of each dimension over its events, and their rounded mean as overall."""
    best = events.groupBy(*keys).agg(*(F.max(c).alias(k) for k, c in scores.items()))
    return best.withColumn("overall", F.floor(sum((F.col(k) for k in scores), F.lit(0)) / len(scores) + 0.5))


def performance(events: Column, total_ms: Column, multi: Column, single: Column) -> Column:
    """Struct of ms per event and events a second (0 without events) and the success rate of the two ways in percent."""
    some = events > 0
    ok = F.coalesce(multi.cast("int"), F.lit(0)) + F.coalesce(single.cast("int"), F.lit(0))
    return F.struct(F.when(some, total_ms / events).otherwise(0.0).alias("average_ms"), F.when(some, F.try_divide(events, total_ms) * 1000).otherwise(0.0).alias("events_per_second"), (ok / 2 * 100).alias("success_rate"))


def extraction_stats(results: DataFrame) -> DataFrame:
    """Totals of (venue, address, confidence): rows, venues and addresses found with rounded rates, mean confidence to 2 decimals."""
    found = lambda c: F.count_if(F.coalesce(F.col(c), F.lit("")) != "")
    rate = lambda c: F.floor(F.try_divide(found(c) * 100.0, F.count("*")) + 0.5)
    mean = F.floor(F.try_divide(F.sum(F.coalesce("confidence", F.lit(0.0))), F.count("*")) * 100 + 0.5) / 100
    return results.agg(F.count("*").alias("total"), found("venue").alias("venues"), found("address").alias("addresses"), mean.alias("average_confidence"), rate("venue").alias("venue_rate"), rate("address").alias("address_rate"))


def counts_by(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by each of ``keys`` alone, in one pass: key, value, n."""
    out = rows.groupingSets([[k] for k in keys], *keys).agg(F.count("*").alias("n"), F.grouping_id().alias("_g"))
    # Of the bits of the grouping id, that of the key that is kept is 0.
    which = F.coalesce(*(F.when(F.col("_g").bitwiseAND(F.lit(1 << (len(keys) - 1 - i))) == 0, k) for i, k in enumerate(keys)))
    value = F.coalesce(*(F.when(which == k, F.col(k).cast("string")) for k in keys))
    return out.select(which.alias("key"), value.alias("value"), "n")
