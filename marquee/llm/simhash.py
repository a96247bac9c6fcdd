"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming distance, groups.

A fingerprint is cut into ``blocks`` blocks. Two that differ in at most
``distance`` bits agree on at least blocks-distance whole blocks, so every
choice of that many blocks is a key and close pairs meet at one of the keys.
Work is done on distinct fingerprints, so copies cost nothing.

A key that few fingerprints share gives their pairs, which are verified by
Hamming distance. A key that many share would give a number of pairs that
grows with its square; there each fingerprint is filed instead under all values
that differ from it in at most distance/2 of the bits outside the key. Two are
at most ``distance`` apart exactly if they meet under such a value, and few can
meet under one, so no link is lost and nothing is quadratic.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm import flat
from marquee.llm.components import components
from marquee.llm.skew import lookup
from marquee.session import materialise

SEED = 42


def _shingle_hashes(column: pa.Array, shingle: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """XXH64 of all shingles of whole texts, and how many each text has, piece by piece."""
    digest = xxhash.xxh64_intdigest
    for a, b in flat.pieces(column):
        data, offsets = flat.flat(column.slice(a, b - a))
        data = flat.LOWER[data]
        starts, ends, first = flat.word_bounds(data, offsets)
        keep = ~flat.SPACE[data]
        keep[ends] = True
        data[ends] = 0x20
        joined = data[keep].tobytes()  # every word followed by one space
        close = np.cumsum(ends - starts + 1) - 1
        begin = close - (ends - starts)
        words = np.diff(first)
        counts = np.where(words > 0, np.maximum(words - shingle + 1, 1), 0)
        total = int(counts.sum())
        edge = np.concatenate([[0], np.cumsum(counts)])
        own = np.repeat(np.arange(len(words)), counts)
        left = first[:-1][own] + np.arange(total) - edge[:-1][own]
        right = np.minimum(left + shingle, first[1:][own]) - 1
        yield np.fromiter((digest(joined[i:j], SEED) for i, j in zip(begin[left].tolist(), close[right].tolist(), strict=True)), np.uint64, total), counts


def _majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A bit is 1 if set in over half of a text's hashes; 0 without any."""
    bits = np.unpackbits(hashes.byteswap().view(np.uint8)).reshape(-1, 64)
    some = counts > 0
    result = np.zeros(len(counts), np.uint64)
    if len(hashes):
        sums = np.add.reduceat(bits, (np.cumsum(counts) - counts)[some], axis=0, dtype=np.int32)
        result[some] = np.packbits(2 * sums > counts[some][:, None], axis=1).view(np.uint64)[:, 0].byteswap()
    return result


def fingerprints_of(column: pa.Array, shingle: int) -> np.ndarray:
    """Fingerprints (int64) of whole texts."""
    return np.concatenate([np.zeros(0, np.uint64), *(_majority(hashes, counts) for hashes, counts in _shingle_hashes(column, shingle))]).view(np.int64)


def fingerprints(docs: DataFrame, shingle: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and fp of every row. A null text is an empty one; without words all bits are 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array(fingerprints_of(x.column(1), shingle))], ["doc_id", "fp"])
            flat.release()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, fp long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def block_masks(blocks: int, distance: int) -> list[int]:
    """Masks (signed) of all choices of blocks-distance of the blocks."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [_signed(sum(c)) for c in combinations(block, blocks - distance)]


def _flips(mask: int, radius: int) -> list[int]:
    """Values with at most ``radius`` bits set, all outside the mask."""
    free = [i for i in range(64) if not mask >> i & 1]
    return [_signed(sum(1 << i for i in c)) for r in range(radius + 1) for c in combinations(free, r)]


def links(fps: DataFrame, distance: int = 2, blocks: int = 4, few: int | None = None) -> DataFrame:
    """Links (a, b) that join all distinct ``fp`` at most ``distance`` apart; every link is such a pair.

    ``distance`` is even. Up to ``few`` per key all pairs are given, above it enough for the groups to be whole.
    By default ``few`` is the number of values that a fingerprint is filed under above it, so neither way makes
    more rows for a fingerprint than that number.
    """
    if distance % 2:
        raise ValueError("distance must be even")
    masks = block_masks(blocks, distance)
    values = [_flips(m, distance // 2) for m in masks]
    few = min(map(len, values)) if few is None else few
    keyed = fps.select("fp", F.posexplode(F.array(*(F.lit(m) for m in masks))).alias("choice", "mask"))
    keyed = keyed.select("fp", "choice", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    shared = keyed.groupBy("choice", "key").agg(F.count("*").alias("n")).filter("n > 1")
    # Sizes on disk say nothing of ``keyed``, which has a row for each choice; no side of these joins is broadcast by them.
    met = materialise(keyed.join(shared.hint("merge"), ["choice", "key"]), "blocks")
    small = met.filter(F.col("n") <= few).select("choice", "key", "fp")
    pairs = small.select("choice", "key", F.col("fp").alias("a")).join(small.withColumnRenamed("fp", "b").hint("merge"), ["choice", "key"]).filter("a < b")
    pairs = pairs.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance).select("a", "b")
    # Their number follows from blocks and distance alone, tens of thousands at most.
    flips = fps.sparkSession.createDataFrame([(i, v) for i, own in enumerate(values) for v in own], "choice int, flip long")
    near = met.filter(F.col("n") > few).join(F.broadcast(flips), "choice").select("choice", "key", "fp", "flip")
    near = near.groupBy("choice", F.col("fp").bitwiseXOR(F.col("flip")).alias("at")).agg(F.sort_array(F.collect_set("fp")).alias("met")).filter(F.size("met") > 1)
    stars = near.select(F.col("met")[0].alias("a"), F.explode(F.slice(F.col("met"), F.lit(2), F.size("met"))).alias("b"))
    stars = stars.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    return pairs.unionByName(stars).distinct()


def groups(docs: DataFrame, shingle: int = 3, distance: int = 2, blocks: int = 4, few: int | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable) and group_size of every row.

    Fingerprints link at ``distance`` or fewer differing bits. Null and empty
    texts have fingerprint zero, which links like any other. Repeated rows and
    ids each give a row. Null ids never name a group unless it has no other. An
    empty table gives no rows; other columns are not read.
    """
    rows = materialise(fingerprints(docs, shingle), "fingerprints")
    classes = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "classes")
    found = components(links(classes.select("fp"), distance, blocks, few))
    linked = classes.join(found, classes["fp"] == found["node"]).select("fp", "root", "least", "n")
    roots = materialise(linked.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("group_size"), F.count("*").alias("members")), "roots")
    total = roots.agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0]
    named = lookup(linked.select("fp", "root"), roots, "root", "members", total).select("fp", "component_id", "group_size")
    known = classes.join(named, "fp", "left").select("fp", "n", F.coalesce("component_id", "least").alias("component_id"), F.coalesce("group_size", "n").alias("group_size"))
    known = materialise(known, "groups")
    out = lookup(rows.select("doc_id", "fp"), known, "fp", "n", rows.count())
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "group_size")
