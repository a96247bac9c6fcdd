"""Selectors of elements as conditions on the element table.

A selector is a comma-separated list of chains; a chain is tags, classes, ids,
attributes ([a], [a="v"], [a*="v"], [a^="v"], [a$="v"], and with i before the
bracket in either case), :first-child and :last-child, and a space says
"somewhere inside".
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions.markup import PAGE, inside

_PART = re.compile(r"""(?P<tag>^[a-z][a-z0-9]*)|\.(?P<cls>[\w-]+)|\#(?P<id>[\w-]+)|\[(?P<attr>[\w:-]+)(?:(?P<op>[*^$]?=)"(?P<value>[^"]*)"(?P<fold>\s+i)?)?\]|:(?P<edge>first|last)-child""")
_ATTRIBUTE = {"=": lambda a, v: a == v, "*=": F.contains, "^=": F.startswith, "$=": F.endswith}


def _condition(compound: str) -> Column:
    """What one element must be; raises for what this language doesn't have."""
    out, at = F.col("tag") != PAGE, 0
    for m in _PART.finditer(compound):
        if m.start() != at:
            break
        at = m.end()
        if m["tag"]:
            c = F.col("tag") == m["tag"]
        elif m["cls"]:
            c = F.array_contains(F.split(F.col("attrs")["class"], r"\s+"), m["cls"])
        elif m["id"]:
            c = F.col("attrs")["id"] == m["id"]
        elif m["attr"]:
            a = F.lower(F.col("attrs")[m["attr"]]) if m["fold"] else F.col("attrs")[m["attr"]]
            c = _ATTRIBUTE[m["op"]](a, F.lit(m["value"].lower() if m["fold"] else m["value"])) if m["op"] else a.isNotNull()
        else:
            c = F.col("child") == 1 if m["edge"] == "first" else F.col("last_child")
        out = out & c
    if at != len(compound) or not compound:
        raise ValueError(f"no selector: {compound!r}")
    return F.coalesce(out, F.lit(False))


def _chains(selector: str) -> list[tuple[str, ...]]:
    return [tuple(re.split(r"\s+(?![^\[]*\])", c.strip())) for c in re.split(r",(?![^\[]*\])", selector)]


def matched(rows: DataFrame, selectors: Sequence[str]) -> DataFrame:
    """``rows`` (see markup.elements) with ``hits``: the indexes of the selectors that an element matches, in order; rows without one go.

    All selectors share one sort of a page's elements. An element lies inside a
    chain's earlier steps if the furthest end of elements that match them
    reaches it.
    """
    chains = [_chains(s) for s in selectors]
    siblings = any(":last-child" in s for s in selectors)
    if siblings:
        # The last child of a parent is the one whose place is the parent's number of children; the parent's row tells it.
        parents = rows.filter("children > 0").select("page_id", F.col("pre").alias("parent"), F.col("children").alias("_of"))
        rows = rows.join(parents, ["page_id", "parent"], "left").withColumn("last_child", F.col("child") == F.col("_of")).drop("_of")
    prefixes = {c[:i] for own in chains for c in own for i in range(1, len(c))}
    names = {p: f"_in{i}" for i, p in enumerate(sorted(prefixes, key=lambda p: (len(p), p)))}

    def holds(chain: tuple[str, ...]) -> Column:
        here = _condition(chain[-1])
        return here & F.col(names[chain[:-1]]) if len(chain) > 1 else here

    for size in sorted({len(p) for p in prefixes}):
        rows = rows.withColumns({names[p]: inside(holds(p)) for p in names if len(p) == size})
    any_of = lambda own: F.when(sum((holds(c).cast("int") for c in own), F.lit(0)) > 0, F.lit(1))
    hits = F.array_compact(F.array(*(F.when(any_of(own).isNotNull(), F.lit(i)) for i, own in enumerate(chains))))
    return rows.withColumn("hits", hits).filter(F.size("hits") > 0).drop(*names.values(), *(["last_child"] if siblings else []))
