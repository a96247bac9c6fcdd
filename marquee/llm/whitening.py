"""Whitening of vectors by a tall and skinny QR over partitions.

Rows are centred by exact sums. Every partition folds its rows into one
triangular factor R, block by block; a tree merges the factors, a fixed number
at a time, until one is left, whose singular vectors whiten. The covariance is
never formed, so what is small beside the largest components isn't lost in
squares. Memory of a task is a batch and a few d x d factors; the driver
sees d sums and one d x d factor.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.session import materialise

SCALE, OFFSET, COMPONENTS = 64.0, 1_000_000, 32
#: Factors that one task of the tree merges.
FAN_IN = 16
_LONG = (1 << 63) - 1
_DECIMAL = 10**38 - 1


def fit_list(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, int]:
    """id and vector (array of double) of the rows to whiten, and their length.

    Null vectors and those with null, NaN or infinite entries go. Vectors are
    of one length: where several occur, only those of the most frequent one
    (the longer of two) have a place in the space, and the others go too. The
    length is 0 where no row is left. Repeated and null ids are rows of their own.
    """
    own = rows.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    sound = own.filter(F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))))
    most = sound.filter(F.size("vector") > 0).groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    d = most.d if most else 0
    return sound.filter(F.size("vector") == d), d


def _whole(batch: pa.RecordBatch, d: int) -> np.ndarray:
    """Entries of a batch as whole numbers, one row a vector."""
    entries = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    x = np.floor(SCALE * entries)
    if x.size and np.abs(x).max() > 2.0**52:
        raise ValueError("an entry is too large to count exactly: its 64-fold exceeds 2^52")
    return x.astype(np.int64) + OFFSET


def sums(rows: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of vectors and exact sums by dimension; a partition adds its own, d rows go to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * d
        for b in batches:
            n += b.num_rows
            # Halves of 31 bits, so that no sum of a batch can overflow.
            x = _whole(b, d)
            total = [t + (int(h) << 31) + int(low) for t, h, low in zip(total, (x >> 31).sum(0), (x & 0x7FFFFFFF).sum(0), strict=True)]
        if n:
            yield pa.RecordBatch.from_pydict({"pos": pa.array(range(d), pa.int32()), "n": pa.array([n] * d, pa.int64()), "total": pa.array([str(t) for t in total])})

    found = rows.mapInArrow(run, "pos int, n long, total string").groupBy("pos").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).orderBy("pos").collect()
    return (int(found[0].n), [int(r.total) for r in found]) if found else (0, [])


def _centred(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """n*x - S, exact: in 64 bits where that is sure to hold it, else in Python's integers."""
    mean = np.array([t // n for t in total], np.int64)
    rest = np.array([t - n * (t // n) for t in total], np.int64)
    away = x - mean
    if away.size and int(np.abs(away).max()) * n >= _LONG // 2:
        away, rest = away.astype(object), rest.astype(object)
    return n * away - rest


def _rows(away: np.ndarray, n: int) -> np.ndarray:
    """x - S/n in doubles: one rounding of the exact value and one division."""
    return away.astype(np.float64) / n


def merge_tree(parts: DataFrame, merge: Callable[[list[np.ndarray]], np.ndarray], name: str) -> np.ndarray | None:
    """What is left of parts (node int, data array<double>) after merging FAN_IN neighbours at a time; nodes are merged in order."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("node").to_pylist(), table.column("data").combine_chunks(), strict=True), key=lambda r: r[0])
        data = merge([r[1].values.to_numpy() for r in rows])
        return pa.table({"node": pa.array([rows[0][0] // FAN_IN], pa.int32()), "data": pa.array([data], pa.list_(pa.float64()))})

    parts = materialise(parts, name)
    while (left := parts.count()) > 1:
        level = parts.groupBy(F.floor(F.col("node") / FAN_IN).alias("up")).applyInArrow(lambda t: run(t.drop_columns(["up"]) if "up" in t.column_names else t), "node int, data array<double>")
        parts = materialise(level, name)
    return np.array(parts.first().data) if left else None


def _one(data: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"node": pa.array([TaskContext.get().partitionId()], pa.int32()), "data": pa.array([data.ravel()], pa.list_(pa.float64()))})


def factor(rows: DataFrame, d: int, n: int, total: list[int]) -> np.ndarray:
    """R (at most d x d) of the centred rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, d))
        for b in batches:
            r = np.linalg.qr(np.vstack([r, _rows(_centred(_whole(b, d), n, total), n)]), mode="r")
        if len(r):
            yield _one(r)

    found = merge_tree(rows.mapInArrow(run, "node int, data array<double>"), lambda many: np.linalg.qr(np.vstack([m.reshape(-1, d) for m in many]), mode="r").ravel(), "factors")
    return found.reshape(-1, d)


def _moments(w: np.ndarray) -> np.ndarray:
    """Count, means and centred products of rows, in one flat array."""
    mean = w.mean(0)
    away = w - mean
    return np.concatenate([[len(w)], mean, (away.T @ away).ravel()])


def _merged(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    n, step = a[0] + b[0], b[1 : k + 1] - a[1 : k + 1]
    return np.concatenate([[n], a[1 : k + 1] + step * b[0] / n, a[k + 1 :] + b[k + 1 :] + np.outer(step, step).ravel() * a[0] * b[0] / n])


def identity_error(rows: DataFrame, d: int, n: int, total: list[int], weights: np.ndarray) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity; products are centred before they are added."""
    k = weights.shape[1]

    def fold(many: list[np.ndarray]) -> np.ndarray:
        found = many[0]
        for m in many[1:]:
            found = _merged(found, m, k)
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = None
        for b in batches:
            if b.num_rows:
                own = _moments(_rows(_centred(_whole(b, d), n, total), n) @ weights)
                found = own if found is None else _merged(found, own, k)
        if found is not None:
            yield _one(found)

    found = merge_tree(rows.mapInArrow(run, "node int, data array<double>"), fold, "moments")
    return float(np.abs(found[k + 1 :].reshape(k, k) / found[0] - np.eye(k)).max())


def components(r: np.ndarray, n: int, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From the final R: whitening weights (d x k), shares of the trace and singular values of the first k components.

    Components without variance (singular values that are zero but for
    rounding) have no unit scale and are left out. Of either sign the one whose
    largest entry is positive is taken.
    """
    _, s, right = np.linalg.svd(r)
    s = np.concatenate([s, np.zeros(r.shape[1] - len(s))])
    k = int((s[:most] > s[0] * np.finfo(float).eps * max(n, r.shape[1]) ** 0.5 * 8).sum()) if s[0] > 0 else 0
    v = right[:k]
    v = v * np.where(np.take_along_axis(v, np.abs(v).argmax(1)[:, None], 1) < 0, -1.0, 1.0) if k else v
    return v.T / (s[:k] / np.sqrt(n)), s[:k] ** 2 / (s**2).sum() if k else s[:0], s[:k]


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """A row for each vector and component: vec_id, component, n, deviation, whitened, explained, identity_error and deviation_exact.

    ``deviation`` is the squared distance from the mean times n squared, a whole
    number; where it is beyond a long it is null there, and beyond 38 digits in
    deviation_exact too. See fit_list for the vectors that have no rows. Nothing
    has variance where all vectors are equal, or only one is there: then, as for
    an empty table, there are no rows. Other columns of ``rows`` are not read.
    """
    spark = rows.sparkSession
    fit, d = fit_list(rows, key, vector)
    kind = rows.schema[key].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"
    n, total = sums(fit, d) if d else (0, [])
    weights, share, _ = components(factor(fit, d, n, total), n, most) if n else (np.zeros((0, 0)),) * 3
    k = weights.shape[1]
    if not k:
        return spark.createDataFrame([], schema)
    error = identity_error(fit, d, n, total, weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = b.num_rows
            if not m:
                continue
            away = _centred(_whole(b, d), n, total)
            white = _rows(away, n) @ weights
            if away.dtype != object and int(np.abs(away).max()) ** 2 * d < _LONG:
                square = pa.array((away * away).sum(1))
                exact = square.cast(pa.decimal128(38, 0))
            else:
                values = [int(v) for v in (away.astype(object) ** 2).sum(1)]
                square = pa.array([v if v <= _LONG else None for v in values], pa.int64())
                exact = pa.array([v if v <= _DECIMAL else None for v in values], pa.decimal128(38, 0))
            each = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_pydict({
                "vec_id": b.column("id").take(each), "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), "n": pa.repeat(pa.scalar(n, pa.int64()), m * k), "deviation": square.take(each),
                "whitened": pa.array(white.ravel()), "explained": pa.array(np.tile(share, m)), "identity_error": pa.repeat(pa.scalar(error), m * k), "deviation_exact": exact.take(each),
            })

    return fit.mapInArrow(run, schema)
