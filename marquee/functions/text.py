"""Text helpers: cleaning, extraction of numbers, addresses and phones, similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marquee.functions.common import fold, text


def clean_text(x: Column) -> Column:
    """White space as single spaces, other than printable ASCII removed, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text(x), r"\s+", " "), r"[^\x20-\x7E]", ""))


def truncate_text(x: Column, most: int = 500) -> Column:
    """At most ``most`` characters of the cleaned text and '...', cut at the last space if that is beyond four fifths."""
    clean = clean_text(x)
    head = F.substring(clean, 1, most)
    last_space = most - F.instr(F.reverse(head), " ")
    cut = F.when((F.instr(head, " ") > 0) & (last_space > most * 0.8), F.substring(head, F.lit(1), last_space)).otherwise(head)
    return F.when(F.length(clean) <= most, clean).otherwise(F.concat(cut, F.lit("...")))


def extract_numbers(x: Column) -> Column:
    return F.transform(F.regexp_extract_all(text(x), F.lit(r"\d+(?:\.\d+)?"), 0), lambda n: n.cast("double"))


#: Forms of URLs and of mail addresses; the last part of an address may hold a bar.
URL_FORM = r"(?i)https?://[^\s<>\"{}|\\^`\[\]]+"
MAIL_FORM = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"


def extract_urls(x: Column) -> Column:
    return F.regexp_extract_all(text(x), F.lit(URL_FORM), 0)


def extract_emails(x: Column) -> Column:
    return F.regexp_extract_all(text(x), F.lit(MAIL_FORM), 0)


#: Forms of phone numbers, in order.
PHONE_FORMS = [r"\(\d{3}\)\s*\d{3}-\d{4}", r"\d{3}[-.\s]\d{3}[-.\s]\d{4}", r"\+1[\s-]?\(\d{3}\)[\s-]?\d{3}[\s-]?\d{4}"]


def extract_phones(x: Column) -> Column:
    """Distinct phone numbers, form by form."""
    return F.array_distinct(F.concat(*(F.regexp_extract_all(text(x), F.lit(p), 0) for p in PHONE_FORMS)))


def strip_quotes(x: Column) -> Column:
    return F.regexp_replace(x, "^[\"']|[\"']$", "")


def venue_key(x: Column) -> Column:
    """Lower case, other than word characters as single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text(x)), r"[^\w\s]", " "), r"\s+", " "))


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / length of the longer; null if both are empty."""
    return 1 - F.try_divide(F.levenshtein(a, b).cast("double"), F.greatest(F.length(a), F.length(b)))


def composite_key(*parts: Column) -> Column:
    """Folded parts that are not empty, joined by a bar."""
    return F.concat_ws("|", *(F.nullif(fold(p), F.lit("")) for p in parts))


def capitalized(x: Column) -> Column:
    """The first letter of each word in upper case, the rest as it is."""
    return F.array_join(F.transform(F.split(text(x), r"(?<=\s)|(?=\s)"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), "")


def page_title(x: Column) -> Column:
    """Title of a page without the site's name after a bar or a spaced dash."""
    return F.trim(F.regexp_replace(F.regexp_replace(text(x), r"\s*\|.*$", ""), r"\s+-\s.*$", ""))


def format_phone(x: Column) -> Column:
    """(ddd) ddd-dddd for 10 digits, +1 before it for 11 that start with 1, else as given."""
    digits = F.regexp_replace(text(x), r"\D", "")
    shape = lambda d: F.regexp_replace(d, r"^(\d{3})(\d{3})(\d{4})$", r"($1) $2-$3")
    return F.when(F.length(digits) == 10, shape(digits)).when((F.length(digits) == 11) & digits.startswith("1"), F.concat(F.lit("+1 "), shape(F.substring(digits, 2, 10)))).otherwise(x)
