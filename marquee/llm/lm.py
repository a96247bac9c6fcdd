"""LM scoring by deleted interpolation.

P(w|v) = l2(b) c(vw)/c(v) + l1(b) c(w)/N + l0(b)/(V+1), where b is the bucket
of the context's frequency c(v). The weights l(b) are learned by expectation
maximisation on held-out counts: of the training texts, one fold is held out,
the rest gives the estimates that the weights mix, and afterwards the weights
are used with the counts of all training texts.

How it is laid out. Texts are dealt into chunks of about ``chunk_bytes`` by a
hash of their id. A chunk sends its distinct words and word pairs, sorted, to
the shards of the key space; a shard adds the counts of all chunks and replies
to each chunk with the totals in the chunk's own order. So what is shuffled is
a few bytes per distinct pair of a chunk, no key gets more than one entry per
chunk however frequent it is, and no table of the corpus has to fit into one
task: chunks and shards grow in number, not in size. There are at most as many
packets as distinct pairs of chunks, which grow with the corpus; below that,
one for each chunk and shard.

Counts are exact up to collisions of 64-bit hashes.

Edge cases: a null or empty text is the end token alone. Repeated rows and
texts count each time. Null ids share a fold, but no chunk: chunks go by id and
text, so that only equal rows are sure to meet in one. An empty table gives
no rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm import flat
from marquee.session import materialise

BOS = np.uint64(0x243F6A8885A308D3)
END = np.uint64(0x13198A2E03707344)
BUCKETS = 24
#: Cells of the grids on which held-out events are counted, in steps of 1/GRID of log10.
GRID, LOWEST = 8, -12

_COUNTS = "chunk long, shard int, kind int, n long, keys binary, trained binary, held binary"
_REPLY = "chunk long, shard int, kind int, n long, trained binary, held binary, tokens long, types long, held_tokens long, held_types long"


def _sequences(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes with an end after each text, the hash before each, and where each text starts."""
    words, counts = [], []
    for a, b in flat.pieces(column):
        data, offsets = flat.flat(column.slice(a, b - a))
        data = flat.LOWER[data]
        starts, ends, first = flat.word_bounds(data, offsets)
        words.append(flat.word_hashes(data, starts, ends))
        counts.append(np.diff(first))
    words = np.concatenate(words) if words else np.zeros(0, np.uint64)
    counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    begins = np.concatenate([[0], np.cumsum(counts + 1)])
    out = np.full(begins[-1], END, np.uint64)
    inside = np.ones(len(out), bool)
    inside[begins[1:] - 1] = False
    out[inside] = words
    before = np.empty_like(out)
    before[1:] = out[:-1]
    before[begins[:-1]] = BOS
    return out, before, begins


def _text(table: pa.Table) -> pa.Array:
    column = table.column("text").combine_chunks()
    return pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column


def _keys(table: pa.Table) -> tuple:
    """The chunk's words and pairs, and their distinct values with the place of each token among them."""
    words, before, begins = _sequences(_text(table))
    pairs = flat.pair_hashes(before, words)
    return words, before, begins, np.unique(words, return_inverse=True), np.unique(pairs, return_inverse=True)


def _edges(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard's range starts in sorted keys."""
    bounds = np.array([(i << 64) // shards for i in range(shards)], np.uint64)
    return np.append(np.searchsorted(keys, bounds), len(keys))


def _count(shards: int):
    def count(key: tuple, table: pa.Table) -> pa.Table:
        _, _, begins, *both = _keys(table)
        fold = np.repeat(table.column("part").to_numpy(), np.diff(begins))
        rows = {k: [] for k in ("chunk", "shard", "kind", "n", "keys", "trained", "held")}
        for kind, (keys, place) in enumerate(both):
            trained = np.bincount(place[fold > 0], minlength=len(keys)).astype(np.uint32)
            held = np.bincount(place[fold == 2], minlength=len(keys)).astype(np.uint32)
            edges = _edges(keys, shards)
            for shard in range(shards):
                a, b = edges[shard : shard + 2]
                if a < b:
                    deltas = np.diff(keys[a:b], prepend=np.uint64(0))
                    for k, v in zip(rows, (key[0].as_py(), shard, kind, b - a, flat.pack(deltas), flat.pack(trained[a:b]), flat.pack(held[a:b])), strict=True):
                        rows[k].append(v)
        return pa.table(rows, schema=pa.schema([("chunk", pa.int64()), ("shard", pa.int32()), ("kind", pa.int32()), ("n", pa.int64()), ("keys", pa.binary()), ("trained", pa.binary()), ("held", pa.binary())]))

    return count


def _total(key: tuple, table: pa.Table) -> pa.Table:
    """Counts of all chunks for a shard, in each chunk's order; a row with chunk -1 holds the shard's sums."""
    shard, out = key[0].as_py(), []
    for kind in (0, 1):
        rows = [r for r in table.to_pylist() if r["kind"] == kind]
        if not rows:
            continue
        keys = np.concatenate([np.cumsum(flat.unpack(r["keys"], r["n"], np.uint64)) for r in rows])
        keys, place = np.unique(keys, return_inverse=True)
        sums = []
        for what in ("trained", "held"):
            each = np.concatenate([flat.unpack(r[what], r["n"], np.uint32) for r in rows])
            sums.append(np.bincount(place, each, len(keys)).astype(np.uint64))
        at = 0
        for r in rows:
            own = place[at : at + r["n"]]
            at += r["n"]
            out.append((r["chunk"], shard, kind, r["n"], flat.pack(sums[0][own]), flat.pack(sums[1][own]), 0, 0, 0, 0))
        if kind == 0:
            rest = sums[0] - sums[1]
            out.append((-1, shard, kind, 0, b"", b"", int(sums[0].sum()), int((sums[0] > 0).sum()), int(rest.sum()), int((rest > 0).sum())))
    schema = pa.schema([("chunk", pa.int64()), ("shard", pa.int32()), ("kind", pa.int32()), ("n", pa.int64()), ("trained", pa.binary()), ("held", pa.binary()), *((k, pa.int64()) for k in ("tokens", "types", "held_tokens", "held_types"))])
    return pa.table([pa.array(x, t.type) for x, t in zip(zip(*out, strict=True), schema, strict=True)] if out else [pa.array([], t.type) for t in schema], schema=schema)


def bucket(counts: np.ndarray) -> np.ndarray:
    """Context-frequency bucket: 0 for an unseen context, then one per power of two."""
    return np.where(counts > 0, np.minimum(1 + np.log2(np.maximum(counts, 1)).astype(np.int64), BUCKETS - 1), 0)


class _Counts:
    """Totals of the corpus for the distinct keys of a chunk."""

    def __init__(self, table: pa.Table, replies: pa.Table) -> None:
        self.words, self.before, self.begins, (self.types, self.type_at), (_, self.pair_at) = _keys(table)
        found: list[list[dict]] = [[], []]
        for r in replies.to_pylist():
            found[r["kind"]].append(r)
        self.of = {}
        for kind, what in enumerate(("word", "pair")):
            for name in ("trained", "held"):
                parts = [flat.unpack(r[name], r["n"], np.uint64) for r in sorted(found[kind], key=lambda r: r["shard"])]
                self.of[what, name] = np.concatenate(parts).astype(np.float64) if parts else np.zeros(0)

    def events(self, rest: bool, starts: tuple[float, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each token: the counts of pair, context and word. rest: without the held-out fold."""
        take = lambda what: self.of[what, "trained"] - (self.of[what, "held"] if rest else 0)
        word = take("word")[self.type_at]
        context = np.empty_like(word)
        context[1:] = word[:-1]
        context[self.begins[:-1]] = starts[rest]
        return take("pair")[self.pair_at], context, word


def _cell(p: np.ndarray) -> np.ndarray:
    """0 for a probability of zero, else the cell of its logarithm."""
    with np.errstate(divide="ignore"):
        logs = np.maximum(np.log10(p), LOWEST)
    return np.where(p > 0, 1 + np.round((logs - LOWEST) * GRID).astype(np.int64), 0)


def _value(cell: np.ndarray) -> np.ndarray:
    return np.where(cell > 0, 10.0 ** ((cell - 1) / GRID + LOWEST), 0)


def _held_events(sums: dict):
    def held(table: pa.Table, replies: pa.Table) -> pa.Table:
        schema = pa.schema([("bucket", pa.int64()), ("p2", pa.int64()), ("p1", pa.int64()), ("n", pa.int64())])
        if not table.num_rows:
            return pa.table([pa.array([], t.type) for t in schema], schema=schema)
        counts = _Counts(table, replies)
        own = np.repeat(table.column("part").to_numpy() == 2, np.diff(counts.begins))
        pair, context, word = (x[own] for x in counts.events(True, sums["starts"]))
        p2 = _cell(np.divide(pair, context, out=np.zeros_like(pair), where=context > 0))
        p1 = _cell(word / max(sums["held_tokens"], 1))
        size = GRID * -LOWEST + 2
        keys, n = np.unique((bucket(context) * size + p2) * size + p1, return_counts=True)
        return pa.table([keys // size // size, keys // size % size, keys % size, n], schema=schema)

    return held


def learn_weights(events: list[tuple[int, int, int, int]], types: int, rounds: int = 60) -> np.ndarray:
    """Expectation maximisation of (l0, l1, l2) per bucket on held-out counts, all buckets at once."""
    weights = np.tile([0.1, 0.4, 0.5], (BUCKETS, 1))
    if events:
        b, p2, p1, n = np.array(events, np.int64).T
        parts = np.stack([np.full(len(b), 1 / (types + 1)), _value(p1), _value(p2)], 1)
        for _ in range(rounds):
            share = weights[b] * parts
            share *= (n / share.sum(1))[:, None]
            for i in range(3):
                sums = np.bincount(b, share[:, i], BUCKETS)
                weights[:, i] = sums + (1e-3 if i else 1e-2)  # a bucket that saw nothing keeps all three
            weights /= weights.sum(1, keepdims=True)
    return weights


def _score(sums: dict, weights: np.ndarray):
    def score(table: pa.Table, replies: pa.Table) -> pa.Table:
        schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
        if not table.num_rows:
            return pa.table([pa.array([], t.type) for t in schema], schema=schema)
        counts = _Counts(table, replies)
        pair, context, word = counts.events(False, sums["starts"])
        add = lambda x: np.add.reduceat(x, counts.begins[:-1])
        own = weights[bucket(context)]
        p = own[:, 0] / (sums["types"] + 1) + own[:, 1] * (word / max(sums["tokens"], 1))
        p += own[:, 2] * np.divide(pair, context, out=np.zeros_like(pair), where=context > 0)
        base = add(np.log10((word + 1) / (sums["tokens"] + sums["types"] + 1)))
        n = table.num_rows
        part = table.column("part").to_numpy()
        return pa.table([table.column("doc_id").combine_chunks(), part == 0, np.diff(counts.begins), add((word > 0).astype(np.int64)), np.full(n, sums["tokens"]), base, add(np.log10(p))], schema=schema)

    return score


def lm_scores(docs: DataFrame, folds: int = 7, test_fold: int = 2, chunk_bytes: int = 12 << 20) -> DataFrame:
    """Score every text of ``docs`` (doc_id, text) with a bigram model by deleted interpolation.

    Texts whose crc32(doc_id) mod ``folds`` is ``test_fold`` are not learned
    from; the fold before it (cyclically) is held out for the weights.
    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score
    (add-one unigrams) and score.
    """
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % folds
    part = F.when(fold == test_fold, 0).when(fold == (test_fold - 1) % folds, 2).otherwise(1).cast("int")
    found = docs.agg(F.sum(F.octet_length("text")).alias("b"), F.sum((part > 0).cast("long")).alias("n"), F.sum((part == 1).cast("long")).alias("r")).first()
    chunks = max(32, -(-int(found.b or 0) // chunk_bytes))
    starts = (float(found.n or 0), float(found.r or 0))
    cut = docs.select("doc_id", "text", part.alias("part"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).alias("chunk"))
    counts = cut.groupBy("chunk").applyInArrow(_count(chunks), _COUNTS)
    replies = materialise(counts.groupBy("shard").applyInArrow(_total, _REPLY), "lm_counts")
    total = replies.filter("chunk = -1").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "types", "held_tokens", "held_types"))).first()
    sums = total.asDict() | {"starts": starts}
    replies = replies.filter("chunk >= 0").select("chunk", "shard", "kind", "n", "trained", "held").groupBy("chunk")
    # A chunk's counts are in the order of all its words, so its other texts come along here.
    events = cut.groupBy("chunk").cogroup(replies).applyInArrow(_held_events(sums), "bucket long, p2 long, p1 long, n long")
    cells = [tuple(r) for r in events.groupBy("bucket", "p2", "p1").agg(F.sum("n").alias("n")).collect()]
    weights = learn_weights(sorted(cells), sums["held_types"])
    return cut.groupBy("chunk").cogroup(replies).applyInArrow(_score(sums, weights), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
