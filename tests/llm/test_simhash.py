from __future__ import annotations

import random
import re

import xxhash

from marquee.llm import simhash
from marquee.llm.components import components
from marquee.llm.queries import op1_simhash
from tests.llm.util import SF, documents


def brute_fingerprint(text: str | None, shingle: int) -> int:
    raw = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", raw)
    parts = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] if len(words) >= shingle else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_groups(fps: dict, distance: int | None, near=None) -> dict:
    root = {d: d for d in fps}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if near(fps[a], fps[b]) if near else (fps[a] ^ fps[b]).bit_count() <= distance:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def check(spark, rows, **options):
    docs = documents(spark, rows)
    got = {r.doc_id: r for r in simhash.groups(docs, **options).collect()}
    fps = {d: brute_fingerprint(t, options.get("shingle", 3)) for d, t in rows}
    assert {d: int(r.fingerprint, 16) for d, r in got.items()} == fps
    want = brute_groups(fps, options.get("distance", 2))
    assert {d: r.component_id for d, r in got.items()} == want
    sizes = {}
    for c in want.values():
        sizes[c] = sizes.get(c, 0) + 1
    assert all(r.group_size == sizes[r.component_id] for r in got.values())


def test_fingerprints_and_groups_like_brute_force(spark):
    rng = random.Random(1)
    words = [f"w{i}Ü" for i in range(300)]
    base = [rng.choices(words, k=400) for _ in range(12)]
    rows = [(i, " ".join(b)) for i, b in enumerate(base)]
    for i in range(60):
        b = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            b[rng.randrange(400)] = "new" + str(i)
        rows.append((100 + i, "\t\x0b ".join(b).upper()))
    rows += [(500, None), (501, ""), (502, "  \n"), (503, "One"), (504, "one two"), (505, "a b   c"), (506, "x " * 40000)]
    check(spark, rows)
    check(spark, rows, few=1)  # the way for frequent blocks alone


def test_five_words_four_bits(spark):
    rng = random.Random(2)
    base = rng.choices([f"w{i}" for i in range(200)], k=300)
    rows = []
    for i in range(50):
        b = list(base)
        b[rng.randrange(300)] = f"n{i}"
        rows.append((i, " ".join(b)))
    check(spark, rows, shingle=5, distance=4, blocks=6)
    check(spark, rows, shingle=5, distance=4, blocks=6, few=2)


def test_table_like_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op1_simhash(spark, SF).collect()}
    fps = {d: brute_fingerprint(t, 3) for d, t in rows}
    want = brute_groups(fps, 2)
    assert got == {d: (f"{fps[d]:016x}", want[d]) for d in fps}


def test_repeated_rows_null_ids_empty_table(spark):
    docs = documents(spark, [(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (2, "zz")])
    got = sorted((str(r.doc_id), r.component_id, r.group_size) for r in simhash.groups(docs).collect())
    assert got == [("1", 1, 3), ("1", 1, 3), ("2", 2, 1), ("None", 1, 3)]
    assert simhash.groups(docs.limit(0)).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {100: 100, 101: 100}
    assert components(edges.limit(0)).count() == 0
