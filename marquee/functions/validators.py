"""Predicates on single values. A null is never valid.

Fixed values: the patterns, which define what is valid.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _is(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def valid_url(x: Column) -> Column:
    return _is(x.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^\s/?#]+"))


def valid_image_url(x: Column) -> Column:
    """A URL with an image's extension, or that speaks of images or media."""
    return valid_url(x) & _is(x.rlike(r"(?i)\.(jpg|jpeg|png|gif|webp|svg)(\?.*)?$") | x.rlike("(?i)(image|img|photo|pic|cdn|media)"))


def valid_email(x: Column) -> Column:
    return _is(x.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$"))


def valid_phone(x: Column) -> Column:
    digits = F.regexp_replace(x, r"\D", "")
    return _is((F.length(digits) == 10) | ((F.length(digits) == 11) & digits.startswith("1")))


def valid_price(x: Column) -> Column:
    lower = F.lower(x)
    return _is(x.rlike(r"^\$?\d+(\.\d{2})?$") | F.contains(lower, F.lit("free")) | F.contains(lower, F.lit("tbd")))


def valid_address(x: Column) -> Column:
    trimmed = F.trim(x)
    return _is((F.length(trimmed) >= 10) & trimmed.rlike(r"(?i)\b(street|st|avenue|ave|road|rd|boulevard|blvd|lane|ln|drive|dr|court|ct|place|pl|\d+)\b"))


def valid_time(x: Column) -> Column:
    return _is(x.rlike(r"^([01]?[0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]$"))


def within_range(day: Column, as_of: Column, before: int = 30, after: int = 365) -> Column:
    """From ``before`` days ago to ``after`` days ahead, both included."""
    return _is((day >= F.date_sub(as_of, before)) & (day <= F.date_add(as_of, after)))


def upcoming(day: Column, as_of: Column) -> Column:
    return _is(day > as_of)


def descriptive(x: Column) -> Column:
    """Eight words or more, six tenths of it letters, at most three tenths digits, $ and colons, and not under ten words in capitals alone."""
    size = F.greatest(F.length(x), F.lit(1))
    letters = F.length(F.regexp_replace(x, "[^A-Za-z]", "")) / size
    special = F.length(F.regexp_replace(x, r"[^\d$:]", "")) / size
    words = F.size(F.split(x, r"\s+"))
    return _is((words >= 8) & (letters >= 0.6) & (special <= 0.3) & ~((x == F.upper(x)) & (words < 10)))


def flyer_title(x: Column, noise: list[str]) -> Column:
    """3 to 120 characters without a word of ``noise``, three letters in a row, over four tenths of it letters."""
    letters = F.length(F.regexp_replace(x, "[^a-zA-Z]", "")) / F.length(x)
    clean = ~F.exists(F.array(*map(F.lit, noise)), lambda w: F.contains(F.lower(x), w)) if noise else F.lit(True)
    return _is(F.length(x).between(3, 120) & clean & x.rlike("[a-zA-Z]{3,}") & (letters > 0.4))
