"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A feature is the presence of a byte n-gram of the lower-cased UTF-8 text. Its
value is the log ratio of the smoothed document frequencies in toxic and other
texts, and a logistic regression is fitted on those values.

The classifier is fitted on the driver on a sample of labelled rows of fixed
size: the ``per_class`` rows of each class that come first in the order of a
hash of their id, without texts of over ``most_bytes``; of rows that repeat an
id one stands for it. So at most 2 * 3,000 texts of 16 KB (98 MB) come to the
driver, however large the corpus is. Scoring reads whole
texts of any length and is map-only; what goes to the tasks is a table of at
most ``features`` hashes and weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm import flat

ORDERS = (4, 5, 6)
THRESHOLD = 0.3
_BINS = 22
_TABLES = np.random.default_rng(7).integers(0, 1 << 32, (max(ORDERS), 256), dtype=np.uint64).astype(np.uint32)


def ngram_hashes(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each order, a 32-bit hash of the n-gram at every place of ``data``."""
    h = np.zeros(len(data), np.uint32)
    for i in range(max(ORDERS)):
        if i >= len(data):
            return
        h = h[: len(data) - i] ^ _TABLES[i][data[i:]]
        if i + 1 in ORDERS:
            yield i + 1, h


def _doc_hashes(text: str) -> np.ndarray:
    """Distinct n-gram hashes of one text and the space after it."""
    data = flat.LOWER[np.frombuffer(text.encode() + b" ", np.uint8)]
    return np.unique(np.concatenate([np.zeros(0, np.uint32), *(h for _, h in ngram_hashes(data))]))


class Model:
    """Hashes in ascending order with their weights, and the intercept."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, intercept: float) -> None:
        self.hashes, self.weights, self.intercept = hashes, weights, intercept
        self.some = np.zeros(1 << _BINS, bool)
        self.some[hashes >> np.uint32(32 - _BINS)] = True

    def logits(self, column: pa.Array) -> np.ndarray:
        out = [np.zeros(0)]
        for a, b in flat.pieces(column):
            data, offsets = flat.flat(column.slice(a, b - a))
            found = []
            for n, h in ngram_hashes(flat.LOWER[data]):
                at = np.flatnonzero(self.some[h >> np.uint32(32 - _BINS)])
                place = np.minimum(np.searchsorted(self.hashes, h[at]), max(len(self.hashes) - 1, 0))
                real = self.hashes[place] == h[at] if len(self.hashes) else np.zeros(0, bool)
                at, place = at[real], place[real]
                doc = np.searchsorted(offsets, at, "right") - 1
                own = at + n <= offsets[doc + 1]  # an n-gram that runs into the next text is none
                found.append(doc[own] * len(self.hashes) + place[own])
            hits = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
            size = max(len(self.hashes), 1)
            out.append(self.intercept + np.bincount(hits // size, self.weights[hits % size] if len(hits) else None, b - a))
        return np.concatenate(out)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _ratios(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    return np.log((pos + 1) / (n_pos + 2)) - np.log((neg + 1) / (n_neg + 2))


def _worth(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """How much a feature tells apart: its ratio, weighted by the difference of its frequencies."""
    return np.abs(_ratios(pos, neg, n_pos, n_neg) * (pos / n_pos - neg / n_neg))


def _threshold(z: np.ndarray, y: np.ndarray) -> float:
    """In the cut with the best F1, a third of the way up: texts like none of the toxic ones are all just below it."""
    order = np.argsort(-z, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(z) + 1) + y.sum())
    best = int(np.argmax(f1))
    low = z[order][best + 1] if best + 1 < len(z) else z[order][best] - 2
    return float(low + (z[order][best] - low) / 3)


def fit(rows: list[tuple[str, int]], features: int = 4000, rounds: int = 200, least_texts: int = 3) -> Model:
    """Fit on (text, label) pairs. With one class alone, every score is the smoothed share of toxic rows."""
    rows = sorted((t or "", int(y)) for t, y in rows)
    y = np.array([label for _, label in rows])
    n_pos, n_neg = int(y.sum()), int(len(y) - y.sum())
    if not n_pos or not n_neg:
        return Model(np.zeros(0, np.uint32), np.zeros(0), float(np.log((n_pos + 0.1) / (n_neg + 1))))
    # First by bins of hashes, which bounds memory; then by the hashes in the best bins.
    counts = np.zeros((2, 1 << _BINS), np.int32)
    for text, label in rows:
        counts[label, np.unique(_doc_hashes(text) >> np.uint32(32 - _BINS))] += 1
    worth = _worth(counts[1], counts[0], n_pos, n_neg)
    bins = np.zeros(1 << _BINS, bool)
    bins[np.argpartition(-worth, 2 * features)[: 2 * features]] = True
    bins &= counts.sum(0) >= least_texts
    own = [h[bins[h >> np.uint32(32 - _BINS)]] for h in (_doc_hashes(text) for text, _ in rows)]
    row = np.repeat(np.arange(len(rows)), [len(h) for h in own])
    hashes, column = np.unique(np.concatenate(own), return_inverse=True)
    pos = np.bincount(column[y[row] == 1], minlength=len(hashes))
    neg = np.bincount(column[y[row] == 0], minlength=len(hashes))
    keep = np.zeros(len(hashes), bool)
    keep[np.argsort(-_worth(pos, neg, n_pos, n_neg), kind="stable")[:features]] = True
    keep &= pos + neg >= least_texts
    ratio = _ratios(pos, neg, n_pos, n_neg)[keep]
    chosen = keep[column]
    row, column = row[chosen], (np.cumsum(keep) - 1)[column[chosen]]
    # Logistic regression on features scaled by their ratio, both classes weighted alike.
    value = ratio[column]
    share = np.where(y == 1, 0.5 / n_pos, 0.5 / n_neg)
    w, b, step_w, step_b = np.zeros(len(ratio)), 0.0, np.zeros(len(ratio)), 0.0
    size = np.bincount(row, value**2, len(rows)).mean() + 1
    for _ in range(rounds):
        z = b + np.bincount(row, w[column] * value, len(rows))
        error = (sigmoid(z) - y) * share
        grad = np.bincount(column, error[row] * value, len(w)) + 1e-4 * w
        step_w = 0.9 * step_w - 4 / size * grad
        step_b = 0.9 * step_b - 4 / size * error.sum()
        w, b = w + step_w, b + step_b
    z = np.bincount(row, w[column] * value, len(rows))
    scale = 8 / max(z[y == 1].mean() - z[y == 0].mean(), 1e-6)
    shift = np.log(THRESHOLD / (1 - THRESHOLD)) - scale * _threshold(z, y)
    return Model(hashes[keep], w * ratio * scale, float(shift))


def fit_tables(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = 3000, most_bytes: int = 1 << 14, folds: int = 4, test_fold: int = 2) -> Model:
    """Fit on labelled rows of ``docs`` outside the test fold; at most ``per_class`` of each class, texts of at most ``most_bytes``.

    An id with several labels counts as toxic if one of them says so. Of
    several texts of one id the one with the smallest hash is taken.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % folds != test_fold))
    known = known.groupBy("doc_id").agg(F.max((F.col(label) > 0).cast("int")).alias("_label"))
    # Ids without a short text are no candidates, so that they take no one's place.
    short = docs.select("doc_id", "text").filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= most_bytes)
    known = known.join(short.select("doc_id"), "doc_id", "left_semi")
    order = (F.xxhash64("doc_id"), "doc_id")
    picked = known.filter("_label = 1").orderBy(*order).limit(per_class).unionByName(known.filter("_label = 0").orderBy(*order).limit(per_class))
    one = F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text")
    texts = short.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "_label").agg(one)
    return fit([(r["text"], r["_label"]) for r in texts.collect()])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` and toxicity (0 to 1), in place of a column of that name. A null text is scored as an empty one."""
    docs = docs.drop("toxicity")
    shared = docs.sparkSession.sparkContext.broadcast((model.hashes, model.weights, model.intercept))
    local: list[Model] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not local:
            local.append(Model(*shared.value))
        for x in batches:
            z = local[0].logits(x.column(x.schema.get_field_index("text")))
            yield pa.RecordBatch.from_arrays([*x.columns, pa.array(sigmoid(z))], [*x.schema.names, "toxicity"])
            flat.release()

    from pyspark.sql.types import DoubleType, StructField, StructType

    schema = StructType([*docs.schema.fields, StructField("toxicity", DoubleType())])
    return docs.mapInArrow(run, schema)


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs`` (doc_id, text), learned from ``labels`` (doc_id, toxic).

    Rows whose crc32(doc_id) mod 4 is 2 are held out from learning. Null and
    empty texts get the score of a text without features; repeated rows each
    give a row; null labels and ids are not learned from. Without labels of
    both classes all scores are one constant. Other columns are not read.
    """
    model = fit_tables(docs, labels)
    out = score(docs.select("doc_id", "text"), model)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"))
