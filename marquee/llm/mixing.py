"""Mixing sources to target weights by soft membership.

A classifier learned from a labelled table gives each word the posterior of the
domains, and a document the mean over its words, so a text in two languages
belongs to two domains. Nonnegative rates of the documents are then fitted by
projected-gradient least squares, so that the expected tokens of each domain,
sum of rate * tokens * posterior, meet the targets.

The gradient of a document is its posteriors times the residual of the domain
totals, which is all that an iteration has to learn from the others: each
iteration sums one short vector over all documents, and a task recomputes its
rates from the residuals so far. Nothing is collected per document.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.llm import flat
from marquee.session import materialise

BITS = 16
#: Columns that ``mix`` adds.
ADDED = ("domain", "n_tokens", "posteriors", "rate", "copies")
MISSED = 1e-3


def _buckets(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hash buckets of all words, and where each text's words start, piece by piece."""
    for a, b in flat.pieces(column):
        data, offsets = flat.flat(column.slice(a, b - a))
        data = flat.LOWER[data]
        starts, ends, first = flat.word_bounds(data, offsets)
        yield (flat.word_hashes(data, starts, ends) >> np.uint64(64 - BITS)).astype(np.int64), first


def fit(rows: list[tuple[str, int]], domains: int) -> np.ndarray:
    """Posterior of the domains for each bucket of words, from (text, domain) pairs; naive Bayes with even priors."""
    counts = np.zeros((domains, 1 << BITS))
    for domain in range(domains):
        texts = pa.array([t or "" for t, d in rows if d == domain], pa.string())
        for words, _ in _buckets(texts):
            counts[domain] += np.bincount(words, minlength=1 << BITS)
    share = (counts + 0.1) / (counts + 0.1).sum(1, keepdims=True)
    return (share / share.sum(0)).T.astype(np.float32)


def posteriors(column: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and mean posteriors of each text; without words all are zero."""
    out, sizes = [np.zeros((0, table.shape[1]))], [np.zeros(0, np.int64)]
    for words, first in _buckets(column):
        n = np.diff(first)
        own = np.repeat(np.arange(len(n)), n)
        sums = np.stack([np.bincount(own, table[words, k], len(n)) for k in range(table.shape[1])], 1)
        out.append(sums / np.maximum(n, 1)[:, None])
        sizes.append(n)
    return np.concatenate(sizes), np.concatenate(out)


def rates_of(posterior: np.ndarray, steps: np.ndarray, least: float) -> np.ndarray:
    """Rates after the given steps, from 1 on."""
    rate = np.ones(len(posterior))
    for step in steps:
        rate = np.maximum(least, rate - posterior @ step)
    return rate


def _matrix(column: pa.Array, domains: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, domains)


def labelled_sample(docs: DataFrame, labelled: DataFrame, domain: str, sample: int = 4000, most_bytes: int = 1 << 14, most_domains: int = 64) -> tuple[list[str], list[tuple[str, int]]]:
    """Domains in order and (text, domain) pairs: ``sample`` pairs at most, dealt evenly to the domains, the first of each by a hash of the id, of at most ``most_bytes`` each (64 MB in all).

    Of rows that repeat an id and a domain, the text with the smallest hash stands for them. Raises for over ``most_domains`` domains.
    """
    from pyspark.sql import Window

    short = docs.filter(F.col(domain).isNotNull() & F.col("doc_id").isNotNull() & (F.coalesce(F.octet_length("text"), F.lit(0)) <= most_bytes))
    sized = short.select("doc_id", F.col(domain).cast("string").alias("_d")).join(labelled.select("doc_id").distinct(), "doc_id", "left_semi").distinct()
    counts = sorted(tuple(r) for r in sized.groupBy("_d").agg(F.count("*").alias("n")).limit(most_domains + 1).collect())
    if len(counts) > most_domains:
        raise ValueError(f"more than {most_domains} domains")
    names = [d for d, _ in counts]
    per_domain = sample // max(len(names), 1)
    # A hash below this bound leaves two to three times the rows wanted of a frequent domain, so ranking never holds more.
    bound = F.create_map(*(F.lit(x) for d, n in counts for x in (d, min(1.0, 2.5 * (per_domain + 50) / n)))) if counts else F.lit(None).cast("map<string,double>")
    unit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30)
    order = Window.partitionBy("_d").orderBy("_unit", "doc_id")
    ranked = sized.withColumn("_unit", unit).filter(F.col("_unit") < bound[F.col("_d")]).withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= per_domain).select("doc_id", "_d")
    one = F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text")
    rows = short.select("doc_id", "text", F.col(domain).cast("string").alias("_d")).join(F.broadcast(ranked), ["doc_id", "_d"]).groupBy("doc_id", "_d").agg(one).collect()
    return names, [(r["text"], names.index(r["_d"])) for r in sorted(rows, key=lambda r: (r["doc_id"], r["_d"]))]


def targets_of(natural: np.ndarray, power: float) -> np.ndarray:
    """Target totals: shares to the power, scaled so that no domain has to shrink."""
    share = natural / max(natural.sum(), 1e-300)
    weight = np.where(share > 0, share**power, 0)
    weight /= max(weight.sum(), 1e-300)
    scale = np.max(share[weight > 0] / weight[weight > 0], initial=1.0)
    return weight * natural.sum() * scale


def fit_rates(rows: DataFrame, domains: int, targets: np.ndarray | None = None, power: float = 0.7, least: float = 0.0, rounds: int = 25, tolerance: float = 1e-6) -> tuple[np.ndarray, float]:
    """Steps of projected gradient for ``rows`` (n_tokens, posteriors), see ``rates_of``, and the residual left, as a share of all target tokens.

    Where bounds on the rates keep targets out of reach, the residual stays; ``mix`` warns of it.
    """

    def sums(steps: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((domains, domains + 2))
            for x in batches:
                p = _matrix(x.column(1), domains)
                weight = p * x.column(0).to_numpy(zero_copy_only=False)[:, None]
                total[:, 0] += weight.T @ rates_of(p, steps, least)
                total[:, 1] += weight.sum(0)
                total[:, 2:] += weight.T @ p
            yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], ["i", "x"])

        found = rows.select("n_tokens", "posteriors").mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
        out = np.zeros(domains * (domains + 2))
        for r in found:
            out[r["i"]] = r["x"]
        return out.reshape(domains, domains + 2)

    steps, left = np.zeros((0, domains)), 0.0
    for step in range(rounds + 1):
        now = sums(steps)
        natural, gram = now[:, 1], now[:, 2:]
        goal = targets_of(natural, power) if targets is None else targets
        residual = now[:, 0] - goal
        left = float(np.abs(residual).max(initial=0) / max(goal.sum(), 1))
        if left <= tolerance or step == rounds:
            break
        # Least squares in the metric of the Gram matrix: without a bound, one step would do.
        steps = np.vstack([steps, np.linalg.solve(gram + 1e-9 * np.trace(gram) * np.eye(domains) + 1e-12 * np.eye(domains), residual)])
    return steps, left


def mix(docs: DataFrame, labelled: DataFrame, domain: str = "lang", targets: dict[str, float] | None = None, power: float = 0.7, least: float = 0.0) -> DataFrame:
    """All columns of ``docs`` and domain, n_tokens, posteriors, rate and copies.

    ``domain``: the column of ``docs`` that is taken as label for the ids in
    ``labelled``. ``targets``: token totals by domain; without them, natural
    totals to ``power``, scaled so that no domain shrinks. ``least``: lower
    bound of rates. domain is the likeliest one (null without words); copies is
    the rate rounded up or down by a hash of the id, so that its mean is the
    rate. Columns of ``docs`` with one of these names give way. A null or empty
    text has no tokens and keeps rate 1, and so have all texts if no row is
    labelled. Rows with a null id or a null ``domain`` label nothing, and are
    rated like any other. Repeated rows each give a row. An empty table gives
    none. Warns if targets are missed by over a thousandth: ``least`` can put
    them out of reach, as rates then only add to the domains that are too large.
    """
    if set(docs.columns) & set(ADDED) - {domain}:
        docs = docs.drop(*(set(ADDED) - {domain}))
    names, sample = labelled_sample(docs, labelled, domain)
    names = names or [""]
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(fit(sample, len(names)))
    k = len(names)
    schema = T.StructType([*docs.schema.fields, T.StructField("n_tokens", T.LongType()), T.StructField("posteriors", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            n, p = posteriors(x.column(x.schema.get_field_index("text")), table.value)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * k, pa.int32()), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([*x.columns, pa.array(n), lists], names=schema.names)
            flat.release()

    light = T.StructType([f for f in schema.fields if f.name in ("n_tokens", "posteriors")])

    def only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in run(batches):
            yield x.select(light.names)

    numbers = materialise(docs.mapInArrow(only, light), "posteriors")
    goal = None if targets is None else np.array([targets.get(d, 0.0) for d in names])
    steps, left = fit_rates(numbers, k, goal, power, least)
    if left > MISSED:
        warnings.warn(f"the targets are missed by up to {left:.2%} of all tokens", stacklevel=2)

    full = T.StructType([*schema.fields, T.StructField("rate", T.DoubleType())])

    def rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in run(batches):
            rate = rates_of(_matrix(x.column(x.num_columns - 1), k), steps, least)
            yield pa.RecordBatch.from_arrays([*x.columns, pa.array(rate)], names=full.names)

    out = docs.mapInArrow(rated, full)
    best = F.when(F.col("n_tokens") > 0, F.get(F.array(*(F.lit(d) for d in names)), (F.array_position("posteriors", F.array_max("posteriors")) - 1).cast("int")))
    unit = F.pmod(F.xxhash64(F.lit("mix"), "doc_id"), F.lit(1 << 30)) / (1 << 30)
    return out.withColumns({"domain": best, "copies": F.floor(F.col("rate") + 1e-9 + unit).cast("int")})
