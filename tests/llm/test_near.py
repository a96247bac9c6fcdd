from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from marquee.llm import near, simhash
from tests.llm.test_simhash import brute_fingerprint
from tests.llm.util import documents


def grams(words):
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def similarity(a, b):
    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y)


def changed(rng, words, least):
    """Words changed, left out or put in one after another, as long as the similarity stays at ``least`` or above."""
    out = list(words)
    for _ in range(60):
        new, i = list(out), rng.randrange(len(out))
        what = rng.randrange(3)
        if what == 0:
            new[i] = f"n{rng.random()}"
        elif what == 1 and len(new) > 6:
            del new[i]
        else:
            new.insert(i, f"m{rng.random()}")
        if similarity(words, new) < least:
            break
        out = new
    return out


def keys_of(texts):
    found = []
    for hashes, counts in simhash._shingle_hashes(pa.array([" ".join(t) for t in texts]), 5):
        keys, sizes = near._block_keys(hashes, counts)
        found += [set(k.tolist()) for k in np.split(keys, np.cumsum(sizes)[:-1])]
    return found


def test_pairs_of_the_least_similarity_share_a_block():
    """Whatever their length, and whatever the number of texts; unrelated texts share none."""
    rng = random.Random(5)
    missed, n, alone = 0, 0, Counter()
    for size in (5, 8, 9, 12, 20, 35, 36, 60, 68, 100, 150, 300, 2000):
        pairs = []
        for _ in range(150):
            one = [f"w{rng.random()}" for _ in range(size)]
            pairs.append((one, changed(rng, one, 0.8)))
        keys = keys_of([t for p in pairs for t in p])
        for i, (a, b) in enumerate(pairs):
            assert similarity(a, b) >= 0.8
            missed += not keys[2 * i] & keys[2 * i + 1]
            n += 1
        alone.update(k for own in keys[::2] for k in own)
    assert missed == 0 and n == 1950
    assert max(alone.values()) == 1
    assert near.miss_chance() < 1e-5


def test_links_at_four_fifths_whatever_the_number(spark):
    """Of pairs at 0.8 to 0.85 nine in ten are linked, which the number of bits decides and not the number of texts; others stay apart."""
    rng = random.Random(6)
    rows, pairs = [], []
    for i in range(200):
        one = [f"w{rng.random()}" for _ in range(rng.choice([30, 80, 200, 600]))]
        two = changed(rng, one, 0.8)
        rows += [(2 * i, " ".join(one)), (2 * i + 1, " ".join(two))]
        pairs.append(similarity(one, two))
    rows += [(1000 + i, " ".join(f"u{rng.random()}" for _ in range(200))) for i in range(200)]
    got = {r.doc_id: r.component_id for r in near.near_groups(documents(spark, rows)).collect()}
    linked = [got[2 * i] == got[2 * i + 1] for i in range(200)]
    assert sum(linked) >= 0.9 * 200, (sum(linked), sum(pairs) / 200)
    assert all(got[i] in (i, i - i % 2) for i, _ in rows if i < 1000) and all(got[i] == i for i, _ in rows if i >= 1000)
    # Each block is long enough to be met by its own pair alone: what is compared grows with the pairs, not with their square.
    s = near.sketches(documents(spark, rows)).select("doc_id", F.explode("keys").alias("key"))
    assert s.groupBy("key").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] == 2


def test_a_large_group_with_copies_of_copies(spark):
    """Copies of one text far from each other: each is compared with enough others that the group stays whole."""
    rng = random.Random(7)
    base = [f"w{i}" for i in range(300)]
    rows = [(0, " ".join(base))] + [(1 + i, " ".join(changed(rng, base, 0.9))) for i in range(300)]
    passage = [f"p{i}" for i in range(60)]
    rows += [(1000 + i, " ".join([*(f"x{rng.random()}" for _ in range(120)), *passage, *(f"y{rng.random()}" for _ in range(120))])) for i in range(200)]
    got = {r.doc_id: r.component_id for r in near.near_groups(documents(spark, rows)).collect()}
    assert sum(got[i] == 0 for i in range(301)) >= 298
    assert all(got[i] == i for i in range(1000, 1200))  # a passage of a fifth of the text links nothing


def test_edges(spark):
    rows = [(1, None), (2, ""), (None, " \n"), (3, "one"), (4, "ONE"), (5, "one two three four"), (6, "word " * 60_000), (7, "word " * 50_000), (3, "other text"), (None, "own text of a null id"), (8, "a b c d e f g h")]
    docs = documents(spark, rows).selectExpr("*", "1 AS keys", "2 AS cid", "3 AS e", "4 AS kh")
    got = sorted((str(r.doc_id), str(r.component_id)) for r in near.near_groups(docs).collect())
    assert got == sorted([("1", "1"), ("2", "1"), ("None", "1"), ("3", "3"), ("4", "3"), ("5", "5"), ("6", "6"), ("7", "6"), ("3", "3"), ("None", "None"), ("8", "8")])
    assert near.near_groups(docs.limit(0)).count() == 0
    s = {r.doc_id: r for r in near.sketches(documents(spark, [(1, "The cat sat on the mat today"), (2, "")])).collect()}
    assert s[1].fp & (2**64 - 1) == brute_fingerprint("The cat sat on the mat today", 5) and s[2].keys == [] and s[2].fp == 0


def test_large_blocks_leave_out_no_pair(spark, monkeypatch):
    """One block of unrelated texts with pairs 48 bits apart, over several tiles: its centres meet few of the pairs, and the rest is compared in full."""
    monkeypatch.setattr(near, "TILE", 64)
    rng = random.Random(8)
    bits = [rng.getrandbits(256) for _ in range(150)]
    bits += [b ^ sum(1 << i for i in rng.sample(range(256), 48 if j % 2 else 49)) for j, b in enumerate(bits[:40])]
    word = lambda b, i: int.from_bytes((b >> 64 * i & (1 << 64) - 1).to_bytes(8, "little"), "little", signed=True)
    rows = [(cid, *(word(b, i) for i in range(4)), [7, 1000 + cid]) for cid, b in enumerate(bits)]
    classes = spark.createDataFrame(rows, "cid long, fp long, w1 long, w2 long, w3 long, keys array<long>")
    want = {(a, b) for b in range(len(bits)) for a in range(b) if (bits[a] ^ bits[b]).bit_count() <= 48}
    assert len(want) == 20
    met = {(r.a, r.b) for r in near.wide_links(classes, 48).collect()}
    assert met < want
    groups = near.components(spark.createDataFrame(sorted(met) or [(0, 0)], "a long, b long"))
    rest = {(r.a, r.b) for r in near.rest_links(classes, groups, 48).collect()}
    assert rest == want - met
    one = spark.createDataFrame([(i, 0) for i in range(len(bits))], "node long, root long")
    assert near.rest_links(classes, one, 48).count() == 0
