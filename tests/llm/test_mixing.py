from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from marquee.llm import mixing
from marquee.llm.queries import op2_mixing
from tests.llm.util import SF


def corpus(spark):
    rows = [(i, ("red blue green " if i % 4 else "eins zwei drei ") * (1 + i % 7), "a" if i % 4 else "b") for i in range(200)]
    rows += [(300, "red blue eins zwei", "a"), (301, None, "a"), (302, "", "b"), (303, "red " * 50_000, "a"), (5, rows[5][1], "a"), (None, "red", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("n", F.lit(1))
    return docs, docs.filter("doc_id < 100").select("doc_id")


def test_posteriors_and_targets(spark):
    docs, labelled = corpus(spark)
    out = mixing.mix(docs, labelled, targets={"a": 3000.0, "b": 2500.0}).collect()
    assert len(out) == docs.count()
    got = {r.doc_id: r for r in out}
    assert got[1].domain == "a" and got[4].domain == "b" and got[301].domain is None
    assert got[301].rate == got[302].rate == 1 and 0.4 < got[300].posteriors[0] < 0.6
    total = np.zeros(2)
    for r in out:
        assert r.rate >= 0 and abs(r.copies - r.rate) <= 1
        total += r.rate * r.n_tokens * np.array(r.posteriors)
    assert np.allclose(total, [3000, 2500], rtol=1e-3)


def test_like_plain_projected_gradient():
    rng = np.random.default_rng(13)
    p = rng.dirichlet([1, 1, 1], 50)
    steps = rng.normal(size=(4, 3)) / 3
    want = np.ones(50)
    for s in steps:
        for i in range(50):
            want[i] = max(0.2, want[i] - sum(p[i, j] * s[j] for j in range(3)))
    assert np.allclose(mixing.rates_of(p, steps, 0.2), want)
    table = mixing.fit([("x y", 0), ("z", 1)], 2)
    n, q = mixing.posteriors(pa.array(["X x", "z", "", None]), table)
    assert n.tolist() == [2, 1, 0, 0] and q[0, 0] > 0.9 and q[1, 1] > 0.9 and not q[2:].any()


def test_no_labels_and_empty(spark):
    docs, labelled = corpus(spark)
    assert {r.rate for r in mixing.mix(docs, labelled.limit(0)).collect()} == {1.0}
    assert mixing.mix(docs.limit(0), labelled).count() == 0


def test_table(spark):
    rows = op2_mixing(spark, SF.replace("sf0.001", "sf0.01")).collect()
    natural = np.sum([r.n_tokens * np.array(r.posteriors) for r in rows], 0)
    goal = mixing.targets_of(natural, 0.7)
    total = np.sum([r.rate * r.n_tokens * np.array(r.posteriors) for r in rows], 0)
    assert np.allclose(total, goal, rtol=1e-3) and (goal >= natural - 1e-6).all()


def test_whole_query_like_brute_force(spark):
    """The same classifier and fit in plain Python: posteriors, rates and copies of every document."""
    docs, labelled = corpus(spark)
    out = mixing.mix(docs.withColumn("rate", F.lit("clash")).withColumn("copies", F.lit(0)), labelled, power=0.5).collect()
    words = {}
    for r in docs.filter("doc_id < 100").distinct().collect():
        for w in r.text.split():
            words.setdefault(w, {"a": 0, "b": 0})[r.lang] += 1
    size = {d: sum(c[d] for c in words.values()) + 0.1 * 65536 for d in "ab"}
    share = {w: {d: (c[d] + 0.1) / size[d] for d in "ab"} for w, c in words.items()}
    tokens, own = [], []
    for r in out:
        ws = (r.text or "").split()
        tokens.append(len(ws))
        own.append([float(np.mean([share[w][d] / sum(share[w].values()) for w in ws])) if ws else 0.0 for d in "ab"])
        assert r.n_tokens == len(ws) and np.allclose(r.posteriors, own[-1], atol=1e-6)
    p, n = np.array(own), np.array(tokens)
    natural = p.T @ n
    want = mixing.targets_of(natural, 0.5)
    # Plain projected gradient with small steps, run to the end.
    rate = np.ones(len(n))
    for _ in range(20_000):
        rate = np.maximum(0, rate - 1e-5 * p @ (p.T @ (rate * n) - want))
    assert np.allclose(p.T @ (rate * n), want, rtol=1e-4)
    got = np.array([r.rate for r in out])
    assert np.allclose(p.T @ (got * n), want, rtol=1e-3) and np.allclose(got, rate, atol=0.02)
    assert abs(sum(r.copies for r in out) - got.sum()) < 3 * np.sqrt(len(out)) / 2


def test_sample_does_not_depend_on_order(spark):
    docs, labelled = corpus(spark)
    a = mixing.labelled_sample(docs.repartition(1), labelled, "lang", sample=40)
    b = mixing.labelled_sample(docs.unionByName(docs).repartition(9), labelled.unionByName(labelled), "lang", sample=40)
    assert a == b and len(a[1]) == 40


def test_targets_out_of_reach_are_told(spark):
    docs, labelled = corpus(spark)
    import pytest

    with pytest.warns(UserWarning, match="missed"):
        mixing.mix(docs, labelled, targets={"a": 10.0, "b": 9e6}, least=1.0)
