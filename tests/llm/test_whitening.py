from __future__ import annotations

import math

import numpy as np
import pytest

from marquee.llm import whitening
from marquee.llm.queries import op12_whitening
from marquee.session import table
from tests.llm.util import SF


def check(rows, got, vectors):
    """``got`` against an eigendecomposition of the covariance; vectors: (id, list) of the fit list."""
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for _, v in vectors]
    n, d = len(x), len(x[0])
    total = [sum(r[j] for r in x) for j in range(d)]
    away = np.array([[n * r[j] - total[j] for j in range(d)] for r in x], object)
    c = away.astype(float) / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1], v[:, ::-1]
    k = max(r.component for r in got)
    assert len(got) == n * k
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append(r)
    for (i, _), own, centred in zip(vectors, away, c, strict=True):
        mine = sorted(by[i], key=lambda r: r.component)
        assert [r.component for r in mine] == list(range(1, k + 1))
        assert {r.deviation for r in mine} == {int((own**2).sum())} and {r.n for r in mine} == {n}
        assert all(int(r.deviation_exact) == r.deviation for r in mine)
        for r in mine:
            want = centred @ v[:, r.component - 1] / math.sqrt(e[r.component - 1])
            assert abs(abs(r.whitened) - abs(want)) < 1e-7
            assert math.isclose(r.explained, e[r.component - 1] / e.sum(), rel_tol=1e-9)
    assert {r.identity_error for r in got} and max(r.identity_error for r in got) < 1e-9
    return k


@pytest.mark.parametrize("size", ["sf0.001", "sf0.1"])
def test_query_like_eigenvectors(spark, size):
    sf = SF.replace("sf0.001", size)
    vectors = [(r.vec_id, r.embedding) for r in table(spark, sf, "embeddings").collect()]
    assert check(vectors, op12_whitening(spark, sf).collect(), vectors) == 32


def test_signs_are_one_for_all_rows(spark):
    got = op12_whitening(spark, SF).collect()
    w = np.zeros((500, 32))
    for r in got:
        w[r.vec_id, r.component - 1] = r.whitened
    assert np.abs(w.mean(0)).max() < 1e-12 and np.abs(np.cov(w.T, bias=True) - np.eye(32)).max() < 1e-9


def test_edges(spark):
    rng = np.random.default_rng(1)
    good = [(i, [float(c) for c in rng.normal(size=3) * [9, 3, 1] + 40]) for i in range(30)]
    bad = [(100, None), (101, [1.0, None, 2.0]), (102, [1.0, float("nan"), 2.0]), (103, [float("inf"), 1.0, 2.0]), (104, []), (105, [1.0, 2.0])]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>").selectExpr("*", "1 AS id", "2 AS vector", "3 AS n", "'x' AS node").repartition(7)
    got = whitening.whiten(df).collect()
    assert check(good, got, good) == 3
    assert {r.vec_id for r in got} == set(range(30))
    # A dimension that never changes has no component; repeated rows and null ids are rows.
    flat = [(None, [1.0, float(i), 5.0]) for i in range(4)] + [(1, [1.0, 2.0, 5.0])] * 2
    got = whitening.whiten(spark.createDataFrame(flat, "vec_id long, embedding array<double>")).collect()
    assert len(got) == 6 and {r.component for r in got} == {1} and sum(r.vec_id is None for r in got) == 4
    for rows in ([], bad[:4], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 5):
        out = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
        assert out.collect() == [] and out.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_large_entries_stay_exact(spark):
    """Sums of squares beyond a long are null there, and whole in the decimal column."""
    rows = [(i, [float((-1) ** i * 2**40), float(i)]) for i in range(50)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    x = [[64 * int(c) + 1_000_000 for c in v] for _, v in rows]
    total = [sum(r[j] for r in x) for j in range(2)]
    for r in got:
        want = sum((50 * x[r.vec_id][j] - total[j]) ** 2 for j in range(2))
        assert r.deviation is None and int(r.deviation_exact) == want


def test_tree_of_many_factors(spark):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(900, 5)) * [1e4, 100, 10, 1, 0.5]
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(m)], "vec_id long, embedding array<double>").repartition(300)
    vectors = [(i, list(v)) for i, v in enumerate(m)]
    assert check(vectors, whitening.whiten(df).collect(), vectors) == 5
