"""Semantics shared by all functions: white space, truthiness, rounding, ordered choice.

Everything is a native column expression; no function reads a clock, and
``as_of`` is a parameter where one is needed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def text(x: Column) -> Column:
    """Null as empty."""
    return F.coalesce(x, F.lit(""))


def squeeze(x: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text(x), r"[\s\x{00A0}]+", " "), "^ | $", "")


def fold(x: Column) -> Column:
    """``squeeze`` in lower case."""
    return F.lower(squeeze(x))


def or_else(x: Column, other: Column) -> Column:
    """x unless null or empty (which plain ``coalesce`` would keep)."""
    return F.coalesce(F.nullif(x, F.lit("")), other)


def round_half_up(x: Column) -> Column:
    """floor(x+0.5): -2.5 gives -2."""
    return F.floor(x + 0.5)


def contains_any(x: Column, words: Sequence[str]) -> Column:
    """Whether x contains one of the words; a long list is one pattern, which keeps generated code short enough to be compiled."""
    if len(words) > 3:
        return x.rlike("|".join(rf"\Q{w}\E" for w in words))
    out = F.contains(x, F.lit(words[0]))
    for w in words[1:]:
        out = out | F.contains(x, F.lit(w))
    return out


def first_match(choices: Sequence[tuple[Column, Column]], default: Column) -> Column:
    """Value of the first condition that holds, in order."""
    out = F
    for condition, value in choices:
        out = out.when(condition, value)
    return out.otherwise(default) if choices else default


def messages(checks: Sequence[tuple[Column, str]]) -> Column:
    """Messages of the conditions that hold, in order."""
    return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(m)) for c, m in checks)))


def let(x: Column, use: Callable[[Column], Column]) -> Column:
    """``use(x)`` with x computed once, however often ``use`` takes it: a plan repeats a column's tree wherever it stands."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def matched(x: Column, pattern: str, groups: int, use: Callable[..., Column]) -> Column:
    """``use`` of the groups of the first match in x, each matched once; groups that take no part are null, and all of them without a match."""
    return let(F.array(*(F.nullif(F.regexp_extract(x, pattern, i), F.lit("")) for i in range(1, groups + 1))), lambda g: use(*(g[i] for i in range(groups))))
