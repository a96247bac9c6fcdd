"""What the join of op3 left out before it was whole (finding F2 of round 4)."""

from __future__ import annotations

import math
import random

import pytest

from marquee.llm import licenses
from marquee.llm.queries import license_links
from tests.llm.test_licenses import OWN, header
from tests.llm.util import SF, documents


def brute(text, templates):
    words = "".join(c if c.isalnum() and c.isascii() or ord(c) > 127 else " " for c in (text or "").lower()).split()
    for k, (label, own, must) in enumerate(templates):
        t = own.lower().translate({i: " " for i in range(128) if not chr(i).isalnum()}).split()
        size, need, shares, told = max(16, 1 << (2 * len(t) - 1).bit_length()), math.ceil(0.8 * len(set(t)) - 1e-9), [], False
        for a in range(0, max(1, len(words)), size // 2):
            block = words[a : a + size]
            n = len(set(block) & set(t))
            if n >= need:
                shares.append(n / len(set(t)))
                told |= all(any(f" {p} " in f" {' '.join(block)} " for p in group.split("|")) for group in must)
            if a + size >= len(words):
                break
        if shares:
            yield k, label, len(shares), max(shares), told


@pytest.mark.parametrize("templates", [licenses.TEMPLATES, OWN])
def test_links_like_brute_force(spark, templates):
    """Whole, edited and shuffled templates among other words: those in another order meet the threshold and lack the phrases."""
    rng = random.Random(34)
    filler = [f"w{i}" for i in range(50)] + ["the", "license", "software", "of"]
    rows = [(900, None), (901, ""), (902, header("Lesser ", 3)), (903, "released the license under mit"), (903, "mit"), (None, "under the mit license released")]
    for i in range(90):
        _, text, _ = rng.choice(templates)
        words = text.split()
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = rng.choice(filler)
        if i % 2:
            rng.shuffle(words)
        rows.append((i, " ".join([*rng.choices(filler, k=rng.randrange(300)), *words, *rng.choices(filler, k=rng.randrange(300))])))
    got = sorted((tuple(r) for r in licenses.links(documents(spark, rows), templates=templates).collect()), key=str)
    assert got == sorted(((d, *link) for d, t in rows for link in brute(t, templates)), key=str)
    assert sum(not r[5] for r in got) > 10 and sum(r[5] for r in got) > 10
    assert licenses.links(documents(spark, rows).limit(0)).count() == 0


def test_links_of_the_table(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(map(tuple, license_links(spark, SF).collect())) == sorted((d, *link) for d, t in texts for link in brute(t, licenses.TEMPLATES))
