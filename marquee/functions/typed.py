"""Typed values in running text: dates, times, prices, phones, mail and street addresses, each form with its confidence (0 to 100)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions.common import first_match, text
from marquee.functions.forms import MONTHS, WEEKDAYS
from marquee.functions.moments import clock_of, flexible_date
from marquee.functions.prices import matched_price
from marquee.functions.text import MAIL_FORM, format_phone

_FULL, _SHORT, _DAY = "|".join(MONTHS), "|".join(m[:3] for m in MONTHS), "|".join(WEEKDAYS)
_STREET = "Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct|Place|Pl"
#: Field, kind, confidence and pattern, in order.
FORMS = [
    ("date", "iso", 95, r"\b\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}"), ("date", "iso_date", 90, r"\b\d{4}-\d{2}-\d{2}\b"), ("date", "us_date", 80, r"\b\d{1,2}/\d{1,2}/\d{4}\b"), ("date", "us_date_dash", 75, r"\b\d{1,2}-\d{1,2}-\d{4}\b"),
    ("date", "verbose", 85, rf"(?i)\b(?:{_FULL})\s+\d{{1,2}},?\s+\d{{4}}\b"), ("date", "abbreviated", 80, rf"(?i)\b(?:{_SHORT})\.?\s+\d{{1,2}},?\s+\d{{4}}\b"), ("date", "day_verbose", 90, rf"(?i)\b(?:{_DAY}),?\s+(?:{_FULL})\s+\d{{1,2}},?\s+\d{{4}}\b"),
    ("time", "12hour", 90, r"(?i)\b\d{1,2}:\d{2}\s*(?:AM|PM)\b"), ("time", "12hour_seconds", 95, r"(?i)\b\d{1,2}:\d{2}:\d{2}\s*(?:AM|PM)\b"), ("time", "24hour", 75, r"\b\d{1,2}:\d{2}\b"), ("time", "24hour_seconds", 80, r"\b\d{1,2}:\d{2}:\d{2}\b"),
    ("time", "verbose_12hour", 85, r"(?i)\bat\s+\d{1,2}:\d{2}\s*(?:AM|PM)\b"), ("time", "oclock", 70, r"(?i)\b\d{1,2}(?::\d{2})?\s*o'clock\b"),
    ("price", "dollar", 90, r"\$\d+(?:\.\d{2})?"), ("price", "euro", 90, r"€\d+(?:\.\d{2})?"), ("price", "pound", 90, r"£\d+(?:\.\d{2})?"), ("price", "free", 95, r"(?i)\b(?:free|no charge|complimentary|gratis)\b"), ("price", "free_dollar", 95, r"\$0(?:\.00)?\b"),
    ("price", "range_dollar", 85, r"\$\d+(?:\.\d{2})?\s*-\s*\$\d+(?:\.\d{2})?"), ("price", "from_price", 80, r"(?i)\bfrom\s+\$\d+(?:\.\d{2})?"),
    ("phone", "us_formatted", 95, r"\b\(\d{3}\)\s*\d{3}-\d{4}\b"), ("phone", "us_dashed", 90, r"\b\d{3}-\d{3}-\d{4}\b"), ("phone", "us_dotted", 85, r"\b\d{3}\.\d{3}\.\d{4}\b"), ("phone", "international", 80, r"\+\d{1,4}\s*\d{3,14}"),
    ("email", "standard", 95, MAIL_FORM),
    ("address", "full_us", 90, rf"(?i)\b\d+\s+[A-Za-z\s]+(?:{_STREET})\.?\s*,?\s*[A-Za-z\s]+,\s*[A-Z]{{2}}\s+\d{{5}}(?:-\d{{4}})?\b"), ("address", "street_only", 75, rf"(?i)\b\d+\s+[A-Za-z\s]+(?:{_STREET})\.?\b"),
]


def typed_values(texts: DataFrame) -> DataFrame:
    """Every match of every form in ``texts`` (id, text): id, field, kind, ord within its form, value and confidence.

    Values are texts: dates as yyyy-MM-dd, times as HH:MM:SS, prices as their
    first number with two decimals, phones in one form. Matches without a value
    are left out.
    """

    def found(field: str, kind: str, sure: int, pattern: str) -> Column:
        hits = F.regexp_extract_all(text(F.col("text")), F.lit(pattern), 0)
        return F.transform(hits, lambda m, i: F.struct(F.lit(field).alias("field"), F.lit(kind).alias("kind"), i.alias("ord"), m.alias("found"), F.lit(sure).alias("confidence")))

    rows = texts.select("id", F.inline(F.concat(*(found(*f) for f in FORMS))))
    price = F.round(matched_price(F.col("found"), F.col("kind"))["price"], 2).cast("decimal(18,2)").cast("string")
    by_field = {"date": flexible_date(F.col("found")).cast("string"), "time": clock_of(F.col("found")), "price": price, "phone": format_phone(F.col("found"))}
    value = first_match([(F.col("field") == f, v) for f, v in by_field.items()], F.col("found"))
    return rows.withColumn("value", value).filter("value is not null").select("id", "field", "kind", "ord", "value", "confidence")
