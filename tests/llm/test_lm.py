from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import pytest

from marquee.llm import lm
from marquee.llm.queries import op7_lm_scoring
from tests.llm.util import SF, documents


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def fold(d):
    return zlib.crc32(("" if d is None else str(d)).encode()) % 7


def brute(rows, weights=None):
    """Base scores, and scores with weights learned from exact (not gridded) held-out events."""
    seqs = [(d, [*tokens(t), None]) for d, t in rows]
    train = [(d, s) for d, s in seqs if fold(d) != 2]

    def counts(part):
        c = Counter(w for _, s in part for w in s)
        c2 = Counter(p for _, s in part for p in zip(["<s>", *s], s, strict=False))
        return c, c2, len(part)

    c, c2, starts = counts(train)
    n, v = sum(c.values()), len(c)
    ac, ac2, astarts = counts([(d, s) for d, s in train if fold(d) != 1])
    an, av = sum(ac.values()), len(ac)
    events = Counter()
    for d, s in train:
        if fold(d) == 1:
            for u, w in zip(["<s>", *s], s, strict=False):
                cu = astarts if u == "<s>" else ac[u]
                events[int(lm.bucket(cu)), ac2[u, w] / cu if cu else 0, ac[w] / an] += 1
    lam = [[0.1, 0.4, 0.5] for _ in range(lm.BUCKETS)]
    for _ in range(60):
        sums = [[1e-2, 1e-3, 1e-3] for _ in lam]
        for (b, p2, p1), k in events.items():
            parts = [lam[b][0] / (av + 1), lam[b][1] * p1, lam[b][2] * p2]
            for i in range(3):
                sums[b][i] += k * parts[i] / sum(parts)
        lam = [[x / sum(s) for x in s] for s in sums]
    out = {}
    for d, s in seqs:
        score = 0
        for u, w in zip(["<s>", *s], s, strict=False):
            cu = starts if u == "<s>" else c[u]
            lb = lam[int(lm.bucket(cu))]
            score += math.log10(lb[0] / (v + 1) + lb[1] * c[w] / n + lb[2] * (c2[u, w] / cu if cu else 0))
        out[d] = (fold(d) == 2, len(s), sum(c[w] > 0 for w in s), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in s), score)
    return out


def check(got, want):
    assert set(got) == set(want)
    for d, r in got.items():
        w = want[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert r.base_score == pytest.approx(w[4], rel=1e-9)
        assert r.score == pytest.approx(w[5], rel=0.01)


def test_table_like_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in op7_lm_scoring(spark, SF).collect()}
    check(got, brute(rows))
    held = [d for d in got if got[d].held_out]
    assert sum(got[d].score for d in held) > sum(got[d].base_score for d in held)


def test_null_empty_long_repeated(spark):
    rows = [(1, None), (2, ""), (3, "A b a b"), (4, "word " * 50_000), (5, "a b"), (6, "a b"), (7, "the End"), (8, "tHe end Ä ä")]
    check({r.doc_id: r for r in lm.lm_scores(documents(spark, rows)).collect()}, brute(rows))
    twice = lm.lm_scores(documents(spark, [*rows, (5, "a b"), (None, "a b")])).collect()
    assert len(twice) == 10 and len({r.score for r in twice if r.doc_id == 5}) == 1
    assert lm.lm_scores(documents(spark, rows).limit(0)).count() == 0


def test_weights_trust_frequent_contexts_more():
    events = [(1, 0, 80, 50), (1, 97, 80, 1), (10, 90, 60, 50), (10, 0, 60, 1)]
    weights = lm.learn_weights(events, 1000)
    assert weights[10, 2] > weights[1, 2]
    assert abs(weights.sum(1) - 1).max() < 1e-12 and (weights > 0).all()
