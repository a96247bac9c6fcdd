"""Groups of near copies at a similarity of 0.8: SimHash fingerprints of 256 bits, met by pigeonhole blocks of shingles.

Texts that share 0.8 of their shingles differ in some 39 of 256 bits, too many
for blocks of bits: those that such pairs must share are a few bits long, and
say nothing among many texts. So the blocks are cut out of the shingles instead:
a hash deals the distinct shingles of a text into B blocks, a power of two of at
least a quarter of their number N, and every block has a 64-bit SimHash of its
own. Shingles that only one of two texts has are at most (N1+N2)/9, which is
less than B, so in every deal one block at least has none of them, and its
fingerprints are equal. A block may also be empty, and says nothing then; so
BLOCKS blocks are filed, of one deal or, for short texts, of several. Each is
equal and not empty with a chance of 0.4 or more, so one pair in 200,000 is
missed (``miss_chance``), however many texts there are: blocks hold whole
shingles, so they get no less telling as texts get more.

Texts that share a block are compared by Hamming distance of the 256 bits. Up
to FEW in a block all are, beyond that each first with CENTRES of them, chosen
anew in each block, which links most copies. The groups found so far then tell
what is left (``rest_links``): a large block whose texts are in one group is
done; in any other every two texts of different groups are compared, tile by
tile. So no text that shares a block with another is left out, the groups are
those of all pairs, and groups of copies cost no squares. Only blocks of a
passage that many unrelated texts share are compared in full.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm import flat, simhash
from marquee.llm.components import components
from marquee.llm.skew import lookup
from marquee.session import materialise

WORDS = ["fp", "w1", "w2", "w3"]
SIMILARITY, PER_BLOCK, BLOCKS = 0.8, 4, 24
FEW, CENTRES, TILE = 32, 3, 2048
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: What tells one deal of the shingles from another.
_DEALS = flat.mix(np.arange(1, BLOCKS + 1, dtype=np.uint64))
_OTHERS = np.arange(len(WORDS), dtype=np.uint64) * _STEP


def miss_chance(similarity: float = SIMILARITY, blocks: int = BLOCKS) -> float:
    """Chance that two texts share none of their blocks, at the worst (PER_BLOCK shingles in each)."""
    free = math.exp(-PER_BLOCK * 2 * (1 - similarity) / (1 + similarity))
    return (1 - free + math.exp(-PER_BLOCK * 2 / (1 + similarity))) ** blocks


def _block_keys(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the filed blocks of each text, and how many each text has.

    A text is filed by its own number of blocks, and by the next one if a text
    of the least similarity may have that.
    """
    own = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((hashes, own))
    own, hashes = own[order], hashes[order]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (hashes[1:] != hashes[:-1])
    own, hashes = own[new], hashes[new]
    number = np.bincount(own, minlength=len(counts))
    level = lambda n: np.ceil(np.log2(np.maximum(n / PER_BLOCK, 1.0))).astype(np.int64)
    first = level(number)
    deals = lambda at: np.where(at > 0, -(-BLOCKS >> np.maximum(at, 0)), 1)  # noqa: E731  as many as give BLOCKS blocks; one block needs no second
    keys, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for at in (first, np.where(level(number / SIMILARITY) > first, first + 1, -1)):
        for deal in range(int(deals(at).max(initial=1))):
            mine = np.where(deals(at) > deal, at, -1)[own]
            some = np.flatnonzero(mine >= 0)
            dealt = flat.mix(hashes[some] + _DEALS[deal])
            block = (dealt & ((np.uint64(1) << mine[some].astype(np.uint64)) - np.uint64(1))).astype(np.int64)
            some, block = some[block < BLOCKS], block[block < BLOCKS]
            if not len(some):
                continue
            sort = np.lexsort((block, own[some]))
            take, block = some[sort], block[sort]
            place = own[take] * BLOCKS + block
            start = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
            fp = simhash._majority(hashes[take], np.diff(np.concatenate([start, [len(take)]])))
            name = (mine[take[start]] * 64 + deal) * BLOCKS + block[start] + 1
            keys.append(flat.mix(fp ^ flat.mix(name.astype(np.uint64) * _STEP)))
            owners.append(own[take[start]])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(keys)[order].view(np.int64), np.bincount(owner, minlength=len(counts))


def sketches(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """doc_id, fp, w1, w2, w3 (256 bits) and keys (of the filed blocks) of every row of ``docs`` (doc_id, text). A null text is an empty one; without words all bits are 0 and there is no key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            words: list[list[np.ndarray]] = [[np.zeros(0, np.uint64)] for _ in WORDS]
            keys, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for hashes, counts in simhash._shingle_hashes(x.column(1), shingle):
                for i, w in enumerate(words):
                    w.append(simhash._majority(flat.mix(hashes + _OTHERS[i]) if i else hashes, counts))
                own, size = _block_keys(hashes, counts)
                keys.append(own)
                sizes.append(size)
            offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32)
            filed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys)))
            yield pa.RecordBatch.from_arrays([x.column(0), *(pa.array(np.concatenate(w).view(np.int64)) for w in words), filed], ["doc_id", *WORDS, "keys"])
            flat.release()

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return own.mapInArrow(run, f"doc_id long, {', '.join(f'{w} long' for w in WORDS)}, keys array<long>")


def _lookup(rows: DataFrame, keyed: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """skew.lookup without broadcasts by size: tables that repeat few fingerprints are tiny on disk, and not in memory."""
    return lookup(rows, keyed.hint("merge"), key, size, total)


def _apart(a: str, b: str) -> Column:
    return sum((F.bit_count(F.col(f"{a}.{w}").bitwiseXOR(F.col(f"{b}.{w}"))) for w in WORDS), F.lit(0))


def wide_links(classes: DataFrame, distance: int) -> DataFrame:
    """Links (a, b) between classes (cid, the 256 bits, keys) that share a block and are at most ``distance`` bits apart."""
    entries = classes.select(F.struct("cid", *WORDS).alias("e"), F.explode("keys").alias("key"))
    sizes = materialise(entries.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "block_sizes")
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    met = materialise(_lookup(entries, sizes, "key", "n", total).select("key", "n", "e"), "block_entries")
    small = met.filter(F.col("n") <= FEW).select("key", "e")
    pairs = small.select("key", F.col("e").alias("x")).join(small.select("key", F.col("e").alias("y")).hint("merge"), "key").filter("x.cid < y.cid")
    large = met.filter(F.col("n") > FEW)
    # A block has one short row of centres, and another choice of them than other blocks of the same texts, so that a group of copies, which shares many blocks, is compared with many.
    order = F.xxhash64("key", "e.cid")
    centres = large.groupBy("key", F.pmod(order, F.lit(CENTRES)).alias("part")).agg(F.min(F.struct(order.alias("order"), "e")).alias("c"), F.count("*").alias("own"))
    centres = materialise(centres.groupBy("key").agg(F.collect_list("c.e").alias("centres"), F.sum("own").alias("n")), "block_centres")
    wanted = centres.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    stars = _lookup(large.select("key", F.col("e").alias("y")), centres, "key", "n", wanted).select("y", F.explode("centres").alias("x")).filter("x.cid <> y.cid")
    both = pairs.select("x", "y").unionByName(stars.select("x", "y")).filter(_apart("x", "y") <= distance)
    return both.select(F.least("x.cid", "y.cid").alias("a"), F.greatest("x.cid", "y.cid").alias("b")).distinct()


def _unlike(distance: int):
    """Links of a pair of tiles: of two texts of different groups, at most ``distance`` bits apart."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        column = lambda c: table.column(c).to_numpy().astype(np.int64)
        cid, root, tile = column("cid"), column("root"), column("tile")
        bits = np.stack([column(w) for w in WORDS]).view(np.uint64)
        low, high = key[1].as_py(), key[2].as_py()
        x, y = np.flatnonzero(tile == low), np.flatnonzero(tile == high)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for a in range(0, len(x), 64):
            own = x[a : a + 64]
            apart = np.zeros((len(own), len(y)), np.uint16)
            for w in bits:
                apart += np.bitwise_count(w[own][:, None] ^ w[y][None, :])
            i, j = np.nonzero((apart <= distance) & (root[own][:, None] != root[y][None, :]))
            found.append((cid[own][i], cid[y][j]))
        a, b = (np.concatenate(c) for c in zip(*found, strict=True))
        # Of the links between two groups one is enough, as groups are linked already.
        at = np.searchsorted(cid[order := np.argsort(cid)], [a, b])
        ends = root[order][at]
        _, first = np.unique(np.sort(ends, axis=0), axis=1, return_index=True) if len(a) else (None, np.zeros(0, np.int64))
        return pa.table({"a": pa.array(np.minimum(a, b)[first]), "b": pa.array(np.maximum(a, b)[first])})

    return run


def rest_links(classes: DataFrame, groups: DataFrame, distance: int) -> DataFrame:
    """Links (a, b) that join groups (node, root) of ``classes`` (cid, the 256 bits, keys) in blocks of over FEW: all that their centres left out.

    A class without a row in ``groups`` is a group of its own. Blocks of one
    group are left out; the others are cut into tiles of TILE by hash, and
    every two tiles are one group of rows, so a task holds two tiles at most.
    """
    named = classes.join(groups.hint("merge"), classes["cid"] == groups["node"], "left").select("cid", *WORDS, "keys", F.coalesce("root", "cid").alias("root"))
    entries = named.select("cid", "root", *WORDS, F.explode("keys").alias("key"))
    mixed = entries.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("least"), F.max("root").alias("most")).filter((F.col("n") > FEW) & (F.col("least") < F.col("most")))
    mixed = materialise(mixed.select("key", "n", F.ceil(F.col("n") / TILE).cast("int").alias("tiles")), "mixed_blocks")
    total = mixed.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if not total:
        return classes.limit(0).select(F.col("cid").alias("a"), F.col("cid").alias("b"))
    own = _lookup(entries, mixed, "key", "n", total).withColumn("tile", F.pmod(F.xxhash64("cid"), F.col("tiles")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    own = own.select("key", "cid", "root", *WORDS, "tile", other)
    own = own.select("key", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "cid", "root", *WORDS, "tile")
    return own.groupBy("key", "low", "high").applyInArrow(_unlike(distance), "a long, b long").distinct()


def near_groups(docs: DataFrame, shingle: int = 5, distance: int = 4, blocks: int = 8, wide: int = 48) -> DataFrame:
    """doc_id and component_id (smallest doc_id reachable) of every row of ``docs`` (doc_id, text).

    Texts link whose fingerprints differ in at most ``distance`` of their first
    64 bits (all of them, see simhash.links), or in at most ``wide`` of 256 and
    share a block. Null and empty texts are alike, and link to each other.
    Repeated rows and ids each give a row; null ids never name a group unless
    it has no other. An empty table gives no rows; other columns are not read.
    """
    rows = materialise(sketches(docs, shingle).withColumn("kh", F.xxhash64(F.col("keys"))), "sketches")
    alike = [*WORDS, "kh"]
    classes = rows.groupBy(*alike).agg(F.min("doc_id").alias("least"), F.count("*").alias("n"), F.any_value("keys").alias("keys"))
    classes = materialise(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    # Classes of one 64-bit fingerprint are linked as it is; one of them stands for all in the links of fingerprints.
    first = materialise(classes.groupBy("fp").agg(F.min("cid").alias("rep"), F.count("*").alias("members")), "representatives")
    close = simhash.links(first.select("fp"), distance, blocks)
    rep = lambda c: first.select(F.col("fp").alias(c), F.col("rep").alias(f"rep_{c}")).hint("merge")
    edges = close.join(rep("a"), "a").join(rep("b"), "b").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    same = _lookup(classes.select("fp", "cid"), first.filter("members > 1"), "fp", "members", classes.count()).filter("cid <> rep")
    edges = edges.unionByName(same.select(F.col("rep").alias("a"), F.col("cid").alias("b"))).unionByName(wide_links(classes.select("cid", *WORDS, "keys"), wide))
    found = materialise(components(edges), "groups")
    rest = materialise(rest_links(classes.select("cid", *WORDS, "keys"), found, wide), "rest_links")
    if not rest.isEmpty():
        found = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).filter("a <> b").unionByName(rest))
    linked = classes.join(found.hint("merge"), classes["cid"] == found["node"]).select("cid", "root", "least")
    roots = materialise(linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members")), "roots")
    total = roots.agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0]
    named = _lookup(linked.select("cid", "root"), roots, "root", "members", total).select("cid", "component_id")
    known = materialise(classes.join(named.hint("merge"), "cid", "left").select(*alike, "n", F.coalesce("component_id", "least").alias("component_id")), "near_groups")
    known = known.select(F.xxhash64(*alike).alias("at"), F.struct(*alike).alias("k"), "n", "component_id")
    own = rows.select("doc_id", F.xxhash64(*alike).alias("at"), F.struct(*alike).alias("mine"))
    return _lookup(own, known, "at", "n", rows.count()).filter("mine = k").select("doc_id", "component_id")
