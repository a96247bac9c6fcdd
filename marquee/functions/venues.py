"""Names of venues: cleaning, validity, quality."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marquee.functions import forms
from marquee.functions.common import contains_any, text

_MONTHS_DAYS = "|".join(w.lower() for w in [*forms.MONTHS, *forms.WEEKDAYS])
#: What no venue is called.
NO_NAME = rf"^\d+$|^[^\w\s]+$|\b(today|tomorrow|tonight|pm|am)\b|\b({_MONTHS_DAYS})\b|^\$\d+"


def clean_name(x: Column) -> Column:
    """Without a leading @ or &, single-spaced, without a leading 'the'."""
    out = F.regexp_replace(F.trim(text(x)), r"^\s*[@&]\s*", "")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"\s+", " "), r"(?i)^the\s+", ""))


def valid_name(x: Column) -> Column:
    """2 to 100 characters, half of the words or more no small words, no time, price or number alone."""
    words = F.split(F.lower(x), r"\s+")
    real = F.size(F.filter(words, lambda w: ~w.isin(forms.STOP_WORDS)))
    return F.coalesce(F.length(x).between(2, 100) & (real > 0) & (real >= F.size(words) * 0.5) & ~F.lower(x).rlike(NO_NAME), F.lit(False))


def name_quality(x: Column) -> Column:
    """0.1 to 1.5: less for very short and long names, more for types of venues."""
    words = F.filter(F.split(x, r"\s+"), lambda w: w != "")
    n, size = F.size(words), F.length(x)
    plus = lambda c, v: F.when(c, v).otherwise(0.0)
    score = 1.0 - plus(size < 3, 0.3) - plus(size > 50, 0.2) - plus((n == 1) & (F.length(F.get(words, F.lit(0))) < 5), 0.2) - plus(n > 6, 0.1)
    score = score + plus(contains_any(F.lower(x), forms.VENUE_TYPES), 0.2) + plus(x.rlike(r"(?i)^The\s+"), 0.1) + plus(x.rlike(r"(?i)\s+(Hall|Center|Theatre|Theater|Club|Bar)$"), 0.2)
    return F.greatest(F.lit(0.1), F.least(F.lit(1.5), score))
