"""Prices from text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marquee.functions.common import contains_any, text

#: Words for no price, and symbols in the order in which they are tried.
FREE_WORDS = ["free", "no charge", "complimentary", "gratis", "donation"]
CURRENCIES = [("$", "USD"), ("€", "EUR"), ("£", "GBP"), ("¥", "JPY"), ("₹", "INR")]
_AMOUNT = r"(\d+(?:\.\d{2})?)"


def _found(x: Column) -> list[tuple[Column, str]]:
    forms = [("\\" + s if s == "$" else s, c, r"(\d+)" if c == "JPY" else _AMOUNT) for s, c in CURRENCIES]
    return [(F.nullif(F.regexp_extract(text(x), s + form, 1), F.lit("")), c) for s, c, form in forms] + [(F.nullif(F.regexp_extract(text(x), _AMOUNT, 1), F.lit("")), "USD")]


def is_free_text(x: Column) -> Column:
    return contains_any(F.lower(text(x)), FREE_WORDS)


def amount(x: Column) -> Column:
    """0 for a word of no price, else the first amount of the first currency that has one, else the first number, else null."""
    return F.when(is_free_text(x), 0.0).otherwise(F.coalesce(*(a for a, _ in _found(x))).cast("double"))


def currency(x: Column) -> Column:
    out = F.when(is_free_text(x), "USD")
    for a, c in _found(x):
        out = out.when(a.isNotNull(), c)
    return out


def format_price(x: Column) -> Column:
    """'Price TBD', 'Free', or symbol and amount with two decimals."""
    symbol = F.when(F.lit(False), "")
    for s, c in CURRENCIES:
        symbol = symbol.when(currency(x) == c, s)
    return F.when(amount(x).isNull(), "Price TBD").when(amount(x) == 0, "Free").otherwise(F.concat(symbol, F.format_string("%.2f", amount(x))))


#: What says outright that an event is free.
FREE_FORMS = r"(?i)\b(free admission|free entry|free event|no charge)\b|\bfree\s+(?:of\s+charge|admission|entry)\b"


def page_price(x: Column) -> Column:
    """Struct of free, price and range: free only where it is said outright, else the first range '$a - $b', else the first '$a'."""
    t = F.coalesce(x, F.lit(""))
    free, many = t.rlike(FREE_FORMS), F.nullif(F.regexp_extract(t, r"\$[0-9]+(?:\.[0-9]{2})?\s*-\s*\$[0-9]+(?:\.[0-9]{2})?", 0), F.lit(""))
    one = F.regexp_extract(t, r"\$([0-9]+(?:\.[0-9]{2})?)", 1).try_cast("double")
    return F.struct(free.alias("free"), F.when(~free & many.isNull(), one).alias("price"), F.when(~free, many).alias("range"))


def matched_price(value: Column, kind: Column) -> Column:
    """Struct of free and price of a matched text: 0 for the free kinds, else its first number; null without one."""
    number = F.regexp_extract(value, r"[\d.]+", 0).try_cast("double")
    make = lambda f, p: F.struct(f.alias("free"), p.alias("price"))
    return F.when(kind.isin("free", "free_dollar"), make(F.lit(True), F.lit(0.0))).when(number.isNotNull(), make(number == 0, number))
