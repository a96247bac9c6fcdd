"""Exact dedup through an extendible-hash index on shared files.

Map tasks fold their own copies first, so a text that a third of all rows
share sends one entry per task. Owner tasks each process ranges of the key
space in key order: entries of one key are chained and told apart by comparing
bytes, and the distinct texts go into the range's extendible-hash directory,
which doubles when an overfull bucket that already uses all its bits splits.
Directories and buckets are written to the shared folder. A row finds its entry
as in any extendible hashing: the first bits of its key name the owner, the
next ones a slot of the owner's directory, the slot a bucket, and in the bucket
stand the key's chain and in it the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm import flat
from marquee.llm.skew import lookup
from marquee.session import materialise

BUCKET = 64
FOLD_BYTES = 8 << 20
#: Rows that are Python objects at a time.
SLICE = 256
OWNER_ENTRIES = 50_000

#: A row is an entry (bucket to group_size set) or an owner's directory (global_depth, slots and the owner's rows as group_size).
INDEX = "owner long, bucket int, prefix long, local_depth int, key long, chain int, sha binary, keep_id long, group_size long, global_depth int, slots array<int>"


@dataclass
class Bucket:
    depth: int
    prefix: int
    entries: list[tuple] = field(default_factory=list)


class Directory:
    """Extendible hashing on the leading bits of ``bits``-bit keys; equal keys chain in one bucket."""

    def __init__(self, bits: int, capacity: int = BUCKET) -> None:
        self.bits, self.capacity, self.depth = bits, capacity, 0
        self.slots = [Bucket(0, 0)]

    def _slot(self, key: int) -> int:
        return key >> (self.bits - self.depth) if self.depth else 0

    def find(self, key: int) -> list[tuple]:
        return [x for x in self.slots[self._slot(key)].entries if x[0] == key]

    def insert(self, key: int, value: tuple) -> None:
        while True:
            bucket = self.slots[self._slot(key)]
            full = len(bucket.entries) >= self.capacity and bucket.depth < self.bits
            if not full or all(x[0] == key for x in bucket.entries):
                bucket.entries.append((key, value))
                return
            self._split(bucket)

    def _split(self, bucket: Bucket) -> None:
        if bucket.depth == self.depth:
            self.slots = [b for b in self.slots for _ in (0, 1)]
            self.depth += 1
        deeper = bucket.depth + 1
        halves = [Bucket(deeper, bucket.prefix << 1), Bucket(deeper, bucket.prefix << 1 | 1)]
        for x in bucket.entries:
            halves[x[0] >> (self.bits - deeper) & 1].entries.append(x)
        width = 1 << (self.depth - deeper)
        for half in halves:
            self.slots[half.prefix * width : (half.prefix + 1) * width] = [half] * width

    def buckets(self) -> Iterator[Bucket]:
        last = None
        for b in self.slots:
            if b is not last:
                yield b
            last = b


def normalised(text: Column) -> Column:
    """Null as empty; each run of white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for x in batches:
        for at in range(0, x.num_rows, SLICE):
            yield from zip(*(c.to_pylist() for c in x.slice(at, SLICE).columns), strict=True)
        flat.release()


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One entry per distinct text of the task (of each FOLD_BYTES of distinct texts)."""

    def out() -> pa.RecordBatch:
        rows = list(found.items())
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in rows], pa.int64()), pa.array([k[1] for k, _ in rows], pa.string()), pa.array([v[0] for _, v in rows], pa.int64()), pa.array([v[1] for _, v in rows], pa.int64())], ["key", "text", "least", "n"])

    found: dict[tuple, list] = {}
    held = 0
    for doc_id, key, text in _rows(batches):
        known = found.get((key, text))
        if known is None:
            found[key, text] = [doc_id, 1]
            held += len(text)
            if held > FOLD_BYTES:
                yield out()
                found, held = {}, 0
        else:
            known[1] += 1
            if doc_id is not None and (known[0] is None or doc_id < known[0]):
                known[0] = doc_id
    if found:
        yield out()


def _own(owner_bits: int, key_bits: int):
    bits = key_bits - owner_bits

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("owner", pa.int64()), ("bucket", pa.int32()), ("prefix", pa.int64()), ("local_depth", pa.int32()), ("key", pa.int64()), ("chain", pa.int32()), ("sha", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("global_depth", pa.int32()), ("slots", pa.list_(pa.int32()))])
        owner, key, chain, directory = None, None, [], None

        def close_chain() -> None:
            named: dict[bytes, str] = {}
            for i, (text, least, n) in enumerate(chain):
                sha = hashlib.sha256(text.encode()).digest()
                if named.setdefault(sha, text) != text:
                    raise ValueError("two texts of one SHA-256")
                directory.insert((key & ((1 << key_bits) - 1)) & ((1 << bits) - 1), (key, i, sha, least, n))

        def close_owner() -> pa.RecordBatch:
            number = {id(b): i for i, b in enumerate(directory.buckets())}
            rows = [(owner, number[id(b)], b.prefix, b.depth, *value, None, None) for b in directory.buckets() for _, value in b.entries]
            rows.append((owner, *[None] * 6, None, sum(r[8] for r in rows), directory.depth, [number[id(b)] for b in directory.slots]))
            return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for o, k, text, least, n in _rows(batches):
            if (o, k) != (owner, key):
                if chain:
                    close_chain()
                chain, key = [], k
                if o != owner:
                    if directory is not None:
                        yield close_owner()
                    owner, directory = o, Directory(bits)
            for entry in chain:
                if entry[0] == text:  # bytes, not hashes, decide
                    entry[2] += n
                    if least is not None and (entry[1] is None or least < entry[1]):
                        entry[1] = least
                    break
            else:
                chain.append([text, least, n])
        if chain:
            close_chain()
        if directory is not None:
            yield close_owner()

    return own


def build_index(docs: DataFrame, key_bits: int = 64, rows: int | None = None) -> tuple[DataFrame, DataFrame, int]:
    """The index of all distinct normalised texts, written to the shared folder: directories, entries, and the bits that name an owner.

    Directories: owner, global_depth, slots (the number of the bucket that each
    slot leads to) and n, the rows of the owner. Entries: owner, bucket, its
    prefix and local_depth, the key, the place in the key's chain, SHA-256, the
    smallest id and the number of rows. ``key_bits`` below 64 makes keys
    collide (for tests).
    """
    rows = docs.count() if rows is None else rows
    owner_bits = max(0, min(key_bits, max(8, (max(rows, 1) // OWNER_ENTRIES).bit_length())))
    entries = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("text")).select("doc_id", _key("text", key_bits).alias("key"), "text")
    entries = entries.mapInArrow(_fold, "key long, text string, least long, n long")
    dealt = entries.select(_owner(key_bits, owner_bits).alias("owner"), "key", "text", "least", "n").repartition("owner").sortWithinPartitions("owner", "key")
    index = materialise(dealt.mapInArrow(_own(owner_bits, key_bits), INDEX), "extendible_index")
    directories = index.filter("slots is not null").select("owner", "global_depth", "slots", F.col("group_size").alias("n"))
    return directories, index.filter("bucket is not null").drop("global_depth", "slots"), owner_bits


def _key(text: str, key_bits: int) -> Column:
    return F.xxhash64(text) if key_bits == 64 else F.xxhash64(text).bitwiseAND(F.lit((1 << key_bits) - 1))


def _owner(key_bits: int, owner_bits: int) -> Column:
    return F.shiftrightunsigned("key", key_bits - owner_bits) if owner_bits else F.lit(0).cast("long")


def exact_groups(docs: DataFrame, key_bits: int = 64) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of ``docs`` (doc_id, text).

    Texts are equal when identical after each run of white space became one
    space; null counts as empty. The row with the smallest id stays; rows that
    repeat its id and text are marked as kept with it. A null id stays only
    where its group has no other. An empty table gives no rows; other columns
    are not read.
    """
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("text"))
    rows = materialise(text.select("doc_id", _key("text", key_bits).alias("key"), F.unhex(F.sha2("text", 256)).alias("sha")), "text_keys")
    total = rows.count()
    directories, entries, owner_bits = build_index(docs, key_bits, total)
    rows = rows.select(_owner(key_bits, owner_bits).alias("owner"), "doc_id", "key", "sha")
    # The slot is the first global_depth of the bits after the owner's.
    rest = key_bits - owner_bits
    inside = F.shiftrightunsigned(F.shiftleft("key", 64 - rest), 1) if rest else F.lit(0).cast("long")
    slot = F.expr("shiftrightunsigned(_inside, 63 - global_depth)").cast("int")
    at = lookup(rows.withColumn("_inside", inside), directories, "owner", "n", total).select("doc_id", F.struct("owner", F.get("slots", slot).alias("bucket"), "key", "sha").alias("at"))
    # In the bucket, the key's chain has the text; the chain's places have different SHA-256, as its owner made sure.
    held = entries.select(F.struct("owner", "bucket", "key", "sha").alias("at"), "keep_id", "group_size")
    found = lookup(at, held, "at", "group_size", total)
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("at.sha")).alias("text_sha256"))
