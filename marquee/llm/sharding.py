"""Shards by fixed virtual slots: records hash into slots, and a stored map says which shard has which slot.

The number of slots never changes, so a record never changes its slot. Only the
map knows of shards: it is made from the bytes of each slot, kept as a table
with a version, and edited when shards are added or grow apart, moving as few
slots as that takes. The map has one row a slot, which bounds what the driver
plans with and what is broadcast, whatever the number of records.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.operators.ranks import running
from marquee.session import materialise

SLOTS, SHARDS = 8192, 24
#: Bytes of a record besides its text.
OVERHEAD = 8


@dataclass(frozen=True)
class SlotMap:
    """Shard and bytes of each slot, by position."""

    version: int
    shards: int
    shard: tuple[int, ...]
    bytes: tuple[int, ...]

    def loads(self) -> list[int]:
        found = [0] * self.shards
        for s, b in zip(self.shard, self.bytes, strict=True):
            found[s] += b
        return found


def plan(sizes: list[int], shards: int = SHARDS) -> SlotMap:
    """Version 1: the largest slots first, each to the shard of fewest bytes, and of those of fewest slots, so that slots without records are dealt out evenly too."""
    shard = [0] * len(sizes)
    heap = [(0, 0, s) for s in range(shards)]
    for slot in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        load, held, s = heapq.heappop(heap)
        shard[slot] = s
        heapq.heappush(heap, (load + sizes[slot], held + 1, s))
    return SlotMap(1, shards, tuple(shard), tuple(sizes))


def grown(old: SlotMap) -> SlotMap:
    """The next version, with one shard more: slots move into that one only, from the fullest shard each time, as long as it stays below its share.

    Of a shard's slots the largest that fits goes; a shard of which none fits
    gives none.
    """
    new, shard, loads = old.shards, list(old.shard), old.loads()
    share, taken = sum(loads) / (new + 1), 0
    held = defaultdict(list)
    for slot in sorted(range(len(shard)), key=lambda i: (old.bytes[i], i)):
        held[shard[slot]].append(slot)
    heap = [(-b, s) for s, b in enumerate(loads)]
    heapq.heapify(heap)
    while heap and taken < share:
        load, s = heapq.heappop(heap)
        spare = min(share - taken, -load - share)
        fits = next((i for i in range(len(held[s]) - 1, -1, -1) if 0 < old.bytes[held[s][i]] <= spare), None)
        if fits is None:
            continue
        slot = held[s].pop(fits)
        shard[slot] = new
        taken += old.bytes[slot]
        heapq.heappush(heap, (load + old.bytes[slot], s))
    return replace(old, version=old.version + 1, shards=new + 1, shard=tuple(shard))


def rebalanced(old: SlotMap, sizes: list[int], tolerance: float = 0.01) -> SlotMap:
    """The next version for new sizes of the slots: slots move from the fullest to the emptiest shard until no shard is further than ``tolerance`` from the mean, or no move brings two shards closer."""
    shard, now = list(old.shard), replace(old, bytes=tuple(sizes))
    loads = now.loads()
    mean = sum(loads) / old.shards
    held = defaultdict(set)
    for slot, s in enumerate(shard):
        held[s].add(slot)
    while True:
        high, low = max(range(old.shards), key=lambda s: (loads[s], -s)), min(range(old.shards), key=lambda s: (loads[s], s))
        gap = loads[high] - loads[low]
        if max(loads[high] - mean, mean - loads[low]) <= tolerance * mean:
            break
        # The slot nearest to half the gap closes it best; one as large as the gap would only swap the two.
        slot = min((i for i in held[high] if 0 < sizes[i] < gap), key=lambda i: (abs(2 * sizes[i] - gap), i), default=None)
        if slot is None:
            break
        held[high].remove(slot)
        held[low].add(slot)
        shard[slot] = low
        loads[high] -= sizes[slot]
        loads[low] += sizes[slot]
    return replace(now, version=old.version + 1, shard=tuple(shard))


def store(spark: SparkSession, slots: SlotMap, path: str) -> None:
    """Add a version of the map to the table at ``path``; a version that is there already is an error."""
    rows = [(i, s, slots.shards, b) for i, (s, b) in enumerate(zip(slots.shard, slots.bytes, strict=True))]
    spark.createDataFrame(rows, "slot int, shard int, shards int, bytes long").coalesce(1).write.mode("error").parquet(f"{path.rstrip('/')}/version={slots.version}")


def load(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
    """A version of the map at ``path``, the latest by default."""
    table = spark.read.parquet(path)
    version = table.agg(F.max("version")).first()[0] if version is None else version
    rows = table.filter(F.col("version") == version).orderBy("slot").collect()
    return SlotMap(version, rows[0].shards, tuple(r.shard for r in rows), tuple(r.bytes for r in rows))


def in_slots(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot and number of every row of ``docs`` (doc_id, text).

    A null text has no bytes. Id and text decide on the slot, so rows of one id
    are spread by their texts; rows equal in both share a slot.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    slot = F.pmod(F.xxhash64("doc_id", text), F.lit(slots)).cast("int")
    return docs.select("doc_id", (F.octet_length(text).cast("long") + OVERHEAD).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), slot.alias("virtual_slot"), F.monotonically_increasing_id().alias("number"))


def slot_bytes(placed: DataFrame, slots: int = SLOTS) -> list[int]:
    """Bytes of each slot, 0 for those without records; at most ``slots`` rows go to the driver."""
    found = [0] * slots
    for r in placed.groupBy("virtual_slot").agg(F.sum("size").alias("bytes")).collect():
        found[r.virtual_slot] = r.bytes
    return found


def shards(docs: DataFrame, path: str, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Shard and place of every row of ``docs`` (doc_id, text), by a map that is made from the slots' bytes and stored at ``path`` as version 1, and with one shard more as version 2.

    doc_id, size (bytes of the text and 8), text_crc32, law (``bytes``: shards
    are of nearly equal size), shard, slot (the row's place in its shard, from 0
    without gaps, by virtual slot and id), grown_shard (null under this law),
    virtual_slot, next_shard (under version 2; rows move into the new shard
    only). Null ids and repeated rows are records like others; no shard gets
    smaller than its records allow, so one record of more than a shard's share
    makes its shard the largest. An empty table gives no rows.
    """
    spark = docs.sparkSession
    placed = materialise(in_slots(docs, slots), "slots")
    first = plan(slot_bytes(placed, slots), shards)
    second = grown(first)
    for version in (first, second):
        store(spark, version, path)
    # One row a slot, whatever the data.
    table = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(first.shard, second.shard, strict=True))], "virtual_slot int, shard int, next_shard int")
    rows = placed.join(F.broadcast(table), "virtual_slot").withColumn("order", F.struct("virtual_slot", "doc_id", "number"))
    return running(rows, ["shard"], "order").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_upto") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "next_shard",
    )
