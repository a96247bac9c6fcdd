"""Filter interaction audit: what each of five filters removes in every order of application.

Every document gets a mask of the filters that it fails. Four of them look at
the text alone; the fifth asks whether a smaller doc_id has the same text. For
that the rows are sorted by ranges of (fingerprint, text, doc_id) and each is
compared with its predecessor. A group of equal texts may go over the edge of a
range, or over many, so the groups at the edges of the ranges are merged
afterwards, one row for each. Masks are then counted by part, and as counts by
mask add up, all 120 orders follow from at most 32 counters a part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.session import materialise

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
SYMBOLS = "[#$%&*|]"
_SPACE = r"[\x20\x09-\x0D]+"
_MASKS = 1 << len(FILTERS)
_DUPLICATE = 1 << FILTERS.index("E")
_MARKED = "kind string, pid int, k int, doc_id long, part string, mask int, fp long, text string, least long"


def text_failures(text: Column) -> Column:
    """Mask of the filters A to D that a text fails (bit 0: A).

    A: under 50 words. B: distinct words are under 65 % of all. C: over 5 % of
    the code points are A-Z. D: holds one of #$%&*|. An empty text fails A alone.
    """
    words = F.filter(F.split(text, _SPACE), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = [n < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * n, 100 * capitals > MOST_CAPITALS * F.length(text), text.rlike(SYMBOLS)]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0)).cast("int")


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return pc.fill_null(column, 0).to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False)


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one range, sorted: each with its mask, and the groups of the range's first and last fingerprint.

    A row of the first fingerprint has the number k of its group, as an earlier
    range may hold a smaller id of the same text. Groups are kept only while
    their fingerprint lasts, so memory holds a batch and the texts of one
    fingerprint.
    """
    pid = TaskContext.get().partitionId()
    schema = pa.schema([("kind", pa.string()), ("pid", pa.int32()), ("k", pa.int32()), ("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("fp", pa.int64()), ("text", pa.string()), ("least", pa.int64())])
    first: int | None = None
    now: int | None = None
    groups: list[tuple[str, int | None]] = []
    heads: list[tuple[str, int | None]] = []
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        fp = batch.column("fp").to_numpy()
        text = batch.column("text")
        ids, known = _ids(batch.column("doc_id"))
        same = np.zeros(n, bool)
        same[1:] = (fp[1:] == fp[:-1]) & pc.equal(text.slice(1), text.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        same[0] = bool(groups) and fp[0] == now and text[0].as_py() == groups[-1][0]
        first = int(fp[0]) if first is None else first
        starts = np.flatnonzero(~same)
        owner = np.cumsum(~same) - 1  # -1: the group that was open before
        least = np.where(owner >= 0, ids[starts[np.maximum(owner, 0)]] if len(starts) else 0, 0)
        has = np.where(owner >= 0, known[starts[np.maximum(owner, 0)]] if len(starts) else False, False)
        if groups:
            before = groups[-1][1]
            least[owner < 0], has[owner < 0] = (0 if before is None else before), before is not None
        fails = has & known & (ids > least)
        k = np.zeros(n, np.int32)
        # Groups of the first fingerprint, and those of the one that is open at the end of the batch, are few: they are looked at one by one.
        early = fp == first
        if early.any():
            k[early] = owner[early] + len(heads)
            k[early & (owner < 0)] = len(heads) - 1
        for i in starts[(fp[starts] == first) | (fp[starts] == fp[-1])]:
            if now is None or fp[i] != now:
                now, groups = int(fp[i]), []
            group = (text[int(i)].as_py(), int(ids[i]) if known[i] else None)
            groups.append(group)
            if fp[i] == first:
                heads.append(group)
        mask = batch.column("mask").to_numpy() | np.where(fails, _DUPLICATE, 0).astype(np.int32)
        none = pa.nulls(n, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar("row"), n), pa.repeat(pa.scalar(pid, pa.int32()), n), pa.array(k, mask=~early), batch.column("doc_id"), batch.column("part"), pa.array(mask.astype(np.int32)), none, pa.nulls(n, pa.string()), none], schema=schema)
    edge = [("edge", pid, i, None, None, None, first, t, least) for i, (t, least) in enumerate(heads)]
    edge += [("edge", pid, None, None, None, None, now, t, least) for t, least in groups if now != first]
    if edge:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in edge], schema=schema)


def masks(docs: DataFrame) -> DataFrame:
    """doc_id, part and mask of every row of ``docs`` (doc_id, text, source); the fifth bit says that a smaller doc_id has the same text.

    A null text counts as an empty one and a null source as the part ''. Rows
    of one id and text don't fail for each other. A null id is no smaller or
    larger than any other: its row never fails the fifth filter and makes none
    fail. An empty table has no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), text.alias("text"), F.xxhash64(text).alias("fp"), F.monotonically_increasing_id().alias("number"))
    # Ranges are cut by fingerprint, id and row number, so that copies of one text, and repeated rows too, are dealt over many; texts of one
    # fingerprint need not be told apart for that, and a sample of whole texts never goes to the driver.
    by = [F.col("fp"), F.col("doc_id").asc_nulls_last(), F.col("number")]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *by).sortWithinPartitions("fp", "text", F.col("doc_id").asc_nulls_last())
    marked = materialise(dealt.select("fp", "text", "doc_id", "part", text_failures(F.col("text")).alias("mask")).mapInArrow(_mark, _MARKED), "marked")
    edges = marked.filter("kind = 'edge'")
    least = edges.groupBy("fp", "text").agg(F.min("least").alias("all_least"))
    heads = edges.filter("k is not null").select("pid", "k", "fp", "text").join(least, ["fp", "text"]).select("pid", "k", "all_least")
    own = marked.filter("kind = 'row'").select("doc_id", "part", "mask", "pid", "k")
    late = own.filter("k is not null").join(heads, ["pid", "k"], "left")
    again = F.when(F.col("doc_id") > F.col("all_least"), _DUPLICATE).otherwise(0)
    return own.filter("k is null").select("doc_id", "part", "mask").unionByName(late.select("doc_id", "part", F.col("mask").bitwiseOR(again).cast("int").alias("mask")))


def part_counters(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good and toxic: additive counters of rows (doc_id, part, mask).

    Several labels of an id count as good or toxic if one of them says so; ids
    without labels, and null ids, are neither. Rows of an id are added up before
    they meet its labels, so that a frequent id is a few rows there.
    """
    says = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = failed.groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n")).join(says, "doc_id", "left")
    share = lambda c: F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias(c)
    return rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), share("good"), share("toxic"))


def _total(counter: str, keep) -> Column:
    """Sum of a counter over a part's cells (at most 32) that ``keep`` takes."""
    return F.aggregate(F.filter("cells", lambda c: keep(c["mask"])), F.lit(0).cast("long"), lambda s, c: s + c[counter])


def orders(counters: DataFrame) -> DataFrame:
    """One row for each part, filter order (120) and step (1 to 5), from counters by part and mask.

    kept and removed are after and by this step; redundant fail its filter but
    were removed earlier; unique_fails fail nothing else; good_lost and
    toxic_lost are among the removed; shapley is what its filter removes, summed
    over all orders.
    """
    cells = counters.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    clear = lambda s: F.struct(*(_total(c, lambda m: m.bitwiseAND(s) == 0).alias(c) for c in ("n", "good", "toxic")))
    passing = cells.select(
        "part",
        F.array(*(clear(F.lit(s)) for s in range(_MASKS))).alias("passing"),
        F.array(*(_total("n", lambda m, b=1 << i: m.bitwiseAND(b) != 0) for i in range(len(FILTERS)))).alias("fails"),
        F.array(*(_total("n", lambda m, b=1 << i: m == b) for i in range(len(FILTERS)))).alias("unique"),
    )
    # Orders of n filters: each letter in turn is put into every place of the orders of those before it.
    every = [""]
    for letter in FILTERS:
        every = [o[:i] + letter + o[i:] for o in every for i in range(len(o) + 1)]
    steps = passing.select("*", F.explode(F.split(F.lit(",".join(sorted(every))), ",")).alias("filter_order"))
    steps = steps.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    place = F.instr(F.lit(FILTERS), F.substring("filter_order", F.col("step"), F.lit(1)))
    before = sum((F.when(F.instr("filter_order", x) < F.col("step"), 1 << i).otherwise(0) for i, x in enumerate(FILTERS)), F.lit(0))
    steps = steps.select("*", place.alias("f"), F.pow(F.lit(2), place - 1).cast("int").alias("bit"), before.alias("before"))
    was, now = F.element_at("passing", F.col("before") + 1), F.element_at("passing", F.col("before").bitwiseOR(F.col("bit")) + 1)
    removed = was["n"] - now["n"]
    # |P|! (4 - |P|)! orders have exactly the filters P before a filter.
    weights = F.array(*(F.lit(w) for w in (24, 6, 4, 6, 24)))
    bit = F.col("bit")
    without = F.filter(F.sequence(F.lit(0), F.lit(_MASKS - 1)), lambda p: p.bitwiseAND(bit) == 0)
    shapley = F.aggregate(without, F.lit(0).cast("long"), lambda s, p: s + F.element_at(weights, F.bit_count(p) + 1) * (F.element_at("passing", p + 1)["n"] - F.element_at("passing", p.bitwiseOR(bit) + 1)["n"]))
    return steps.select(
        "part", "filter_order", "step", now["n"].alias("kept"), removed.alias("removed"), (F.element_at("fails", F.col("f")) - removed).alias("redundant"), F.element_at("unique", F.col("f")).alias("unique_fails"),
        (was["good"] - now["good"]).alias("good_lost"), (was["toxic"] - now["toxic"]).alias("toxic_lost"), shapley.alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters over ``docs`` (doc_id, text, source) in all orders, with what is lost by ``labels`` (doc_id, quality, toxic); see masks, part_counters and orders for nulls and ties."""
    return orders(part_counters(masks(docs), labels))
