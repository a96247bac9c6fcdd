"""Cleaning, correction and quality of noisy text, and single clock times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions.common import text
from marquee.functions.forms import MONTHS, WEEKDAYS

#: Abbreviations written out.
ABBREVIATIONS = {"St.": "Street", "Ave.": "Avenue", "Rd.": "Road", "Blvd.": "Boulevard", **{m[:3] + ".": m for m in MONTHS if m != "May"}, "Sept.": "September"}
#: The steps of cleaning, in order. Of '/@&+~' and dashes other than '-' nothing is left, and "$25.50" becomes "$25. 50".
CLEANING = [
    (r"\s+", " "), ("^ | $", ""), (r"[^\w\s.,!?:;'\"$%()-]", " "), (r"\s+([.,!?:;])", "$1"), (r"([.,!?:;])\s*", "$1 "), (r"\$\s+(\d)", r"\$$1"), (r"(\d)\s+\$([^$\d])", r"$1\$ $2"),
    (r"(\d+)\s*:\s*(\d+)", "$1:$2"), (r"[.,!?:;]{2,}", "."), (r"\s+", " "), ("^ | $", ""),
]
#: Words that are often misread, and what is meant; weekdays are misread with a 1 or a 7 for their Y.
MISREAD = {
    "TICKETSS": "TICKETS", "TICKE1S": "TICKETS", "ADMISSI0N": "ADMISSION", "D00RS": "DOORS", "D0ORS": "DOORS", "SH0W": "SHOW", "C0NCERT": "CONCERT", "PERP0RMANCE": "PERFORMANCE", "EVEN1": "EVENT", "EVEN7": "EVENT",
    **{d[:-1].upper() + wrong: d.upper() for d in WEEKDAYS for wrong in "71"},
}
#: Forms that are often misread: times, prices, dates, and an I within, before and after capitals.
MISREAD_FORMS = [
    (r"(\d+)([Il1])([Il1])(\d+)", "$1:$4"), (r"\$(\d+)([Il1])(\d+)", r"\$$1.$3"), (r"([Il1])(\d+)([Il1])(\d+)", "$2/$4"), (r"([A-Z])([Il1])([A-Z])", "$1I$3"), (r"\b([Il1])([A-Z]{2,})\b", "I$2"), (r"\b([A-Z]{2,})([Il1])\b", "$1I"),
]
#: Characters put right by what stands around them; a dollar sign before I, l or 1 is lost.
IN_CONTEXT = [
    (r"(\d+)([Il1])([Il1])(\d+)\s*(AM|PM|am|pm)", "$1:$4 $5"), (r"\$([Il1])(\d+)", "$1$2"), (r"\$(\d+)([Il1])", r"\$$1$2"), (r"\$(\d+)([O])(\d*)", r"\$$10$3"), (r"\b([Il1])(/)(\d+)", "1$2$3"), (r"\b(\d+)(/)([Il1])", "$1$21"),
    (r"\bA[Il1]{1,2}\b", "AM"), (r"\bP[Il1]{1,2}\b", "PM"),
]
#: Misspellings.
TYPOS = {
    "concret": "concert", "conert": "concert", "perfomance": "performance", "performace": "performance", "admisson": "admission", "admision": "admission", "tikets": "tickets", "tickts": "tickets", "ticets": "tickets",
    "veune": "venue", "vene": "venue", "locaton": "location", "loction": "location", "staring": "starting", "begining": "beginning", "thearter": "theater", "threatre": "theatre",
}
#: Forms of texts read well and badly, and of missing spaces.
GOOD = [r"\b\d{1,2}:\d{2}\s*(AM|PM|am|pm)\b", rf"\b({'|'.join(MONTHS)})\s+\d{{1,2}}\b", r"\$\d+(?:\.\d{2})?\b", rf"\b({'|'.join(WEEKDAYS)})\b"]
BAD = [r"[Il1O0]{3,}", r"[^\w\s.,!?:;'\"$%()-]{3,}", r"\s{5,}", r"[A-Z]{1}[a-z]{1}[A-Z]{1}[a-z]{1}", r"\b\w{1,2}\b\s+\b\w{1,2}\b\s+\b\w{1,2}\b"]
UNSPACED = [r"[A-Za-z]\d", r"\d[A-Za-z]", r"[A-Z][a-z]+[A-Z]", r"\$\d+[A-Za-z]"]
#: Forms of phrases, by kind.
PHRASES = {
    "time": r"\b\d{1,2}:?\d{0,2}\s*(?:AM|PM|am|pm)\b[^.!?]*[.!?]?", "date": rf"(?i)\b(?:{'|'.join(MONTHS)}|\d{{1,2}}/\d{{1,2}})[^.!?]*[.!?]?", "price": r"(?i)\$\d+[^.!?]*[.!?]?|free[^.!?]*[.!?]?",
    "venue": r"(?i)\b(?:at|@|venue|location)[^.!?]*[.!?]?",
}


def _steps(x: Column, steps: list[tuple[str, str]]) -> Column:
    for pattern, to in steps:
        x = F.regexp_replace(x, pattern, to)
    return x


def basic_clean(x: Column) -> Column:
    """Artefacts out, punctuation and times spaced alike."""
    return _steps(text(x), CLEANING)


def correct_in_context(x: Column) -> Column:
    return _steps(text(x), IN_CONTEXT)


def correct_artifacts(x: Column) -> Column:
    """Words and forms that are often misread put right, then characters by what stands around them."""
    return correct_in_context(_steps(_steps(text(x), [(rf"(?i)\b{wrong}\b", right) for wrong, right in MISREAD.items()]), MISREAD_FORMS))


def corrections(x: Column) -> Column:
    """The misread words that a text has, as struct(original, corrected), in the order of the table."""
    return F.array_compact(F.array(*(F.when(text(x).rlike(rf"(?i)\b{w}\b"), F.struct(F.lit(w).alias("original"), F.lit(r).alias("corrected"))) for w, r in MISREAD.items())))


def normalize(x: Column) -> Column:
    """AM and PM in capitals, FREE, and abbreviations written out."""
    out = _steps(text(x), [(r"(?i)\bam\b", "AM"), (r"(?i)\bpm\b", "PM"), (r"\b(free|Free|FREE)\b", "FREE")])
    return _steps(out, [(rf"(?i)\b{short[:-1]}\.", full) for short, full in ABBREVIATIONS.items()] + [(r"\s+", " "), ("^ | $", "")])


def correct_spelling(x: Column) -> Column:
    """Misspelt words put right, whatever punctuation they carry; words are joined by single spaces."""
    table = F.create_map(*(F.lit(v) for pair in TYPOS.items() for v in pair))
    bare = lambda w: F.lower(F.regexp_replace(w, r"\W", ""))
    fixed = lambda w: F.when(F.contains(F.lower(w), bare(w)), F.concat(F.substring(w, F.lit(1), F.instr(F.lower(w), bare(w)) - 1), table[bare(w)], F.substring(w, F.instr(F.lower(w), bare(w)) + F.length(bare(w)), F.length(w)))).otherwise(w)
    return F.array_join(F.transform(F.split(text(x), r"\s+"), lambda w: F.when(table[bare(w)].isNotNull(), fixed(w)).otherwise(w)), " ")


def quality(x: Column) -> Column:
    """Struct of score and issues of a text: forms read well and badly, missing spaces, length, variety of characters, length of words."""
    t = text(x)
    hits = lambda patterns: sum((t.rlike(p).cast("int") for p in patterns), F.lit(0))
    good, bad, unspaced, size = hits(GOOD), hits(BAD), hits(UNSPACED), F.length(t)
    score = F.greatest(F.lit(0.1), 1.0 + F.least(F.lit(0.3), good * 0.1) - F.least(F.lit(0.4), bad * 0.1) - F.least(F.lit(0.3), unspaced * 0.05))
    variety = F.size(F.array_distinct(F.split(F.lower(t), ""))) / size
    words = F.split(t, r"\s+")
    mean = F.length(F.array_join(words, "")) / F.size(words)
    mixed = t.rlike(r"\d") & t.rlike("[a-zA-Z]") & (F.contains(t, F.lit("$")) | t.rlike(r"\d+:\d+"))
    by = [(size < 10, 0.8), (size > 1000, 0.9), (variety < 0.1, 0.7), (mean < 2, 0.8), (mean > 15, 0.8), (mixed, 1.1)]
    for c, factor in by:
        score = score * F.when(c, factor).otherwise(1.0)
    names = [(good == 0, "no_recognizable_patterns"), (bad > 0, "ocr_artifacts_detected"), (unspaced > 0, "spacing_issues"), (size < 10, "very_short_text"), (size > 1000, "very_long_text"), (variety < 0.1, "low_character_diversity")]
    names += [(mean < 2, "unusually_short_words"), (mean > 15, "unusually_long_words")]
    issues = F.array_compact(F.array(*(F.when(c, n) for c, n in names)))
    empty = F.struct(F.lit(0.0).alias("score"), F.array(F.lit("empty_text")).alias("issues"))
    return F.when(t == "", empty).otherwise(F.struct(score.alias("score"), issues.alias("issues")))


def key_phrases(x: Column) -> Column:
    """Array of struct(type, phrase): phrases of times, dates, prices and venues, trimmed."""

    def found(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(text(x), F.lit(pattern), 0), lambda m: F.struct(F.lit(kind).alias("type"), F.trim(m).alias("phrase")))

    return F.concat(*(found(k, p) for k, p in PHRASES.items()))


def preprocess(rows: DataFrame, column: str = "text", spelling: bool = False) -> DataFrame:
    """Adds cleaned, normalized, quality (struct) and corrections of ``column``; each step is a projection of its own, so no step is computed twice."""
    out = rows.withColumn("_basic", basic_clean(F.col(column)))
    out = out.withColumns({"cleaned": correct_artifacts(F.col("_basic")), "corrections": corrections(F.col("_basic"))}).drop("_basic")
    out = out.withColumn("quality", quality(F.col("cleaned")))
    if spelling:
        out = out.withColumn("cleaned", correct_spelling(F.col("cleaned")))
    return out.withColumn("normalized", normalize(F.col("cleaned")))


def clock_time(x: Column, default: str = "19:00:00") -> Column:
    """First h:mm with an optional AM or PM as HH:mm:00, else the default."""
    part = lambda i: F.regexp_extract(text(x), r"(?i)(\d{1,2}):(\d{2})\s*(AM|PM)?", i)
    hour, period = F.nullif(part(1), F.lit("")).cast("int"), F.upper(part(3))
    full = F.when((period == "PM") & (hour != 12), hour + 12).when((period == "AM") & (hour == 12), 0).otherwise(hour)
    return F.when(hour.isNull(), default).otherwise(F.format_string("%02d:%s:00", full, part(2)))
