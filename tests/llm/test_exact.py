from __future__ import annotations

import hashlib
import random
import re

import duckdb

from marquee.llm import exact
from marquee.llm.queries import ORACLE_SQL, op10_exact_dedup
from tests.llm.util import SF, documents


def brute(rows):
    norm = {}
    for d, t in rows:
        norm.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(d)
    out = []
    for t, ids in norm.items():
        known = [d for d in ids if d is not None]
        keep = min(known) if known else None
        out += [(d, keep, len(ids), d == keep, hashlib.sha256(t.encode()).hexdigest()) for d in ids]
    return sorted(out, key=str)


def test_like_brute_force_with_colliding_keys(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a  b", "a\tb", "a b ", f"t{i % 40}", None, "", "Ü x", "x" * 100_000])) for i in range(300)]
    rows += [(5, "again"), (5, "again"), (None, "lone"), (None, "a b")]
    docs = documents(spark, rows).repartition(5)
    for key_bits in (64, 3, 10):
        got = sorted((tuple(r) for r in exact.exact_groups(docs, key_bits).collect()), key=str)
        assert got == brute(rows)
    assert exact.exact_groups(docs.limit(0)).count() == 0


def test_query_like_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL['op10_exact_dedup']}) ORDER BY doc_id").fetchall()
    got = [tuple(r) for r in op10_exact_dedup(spark, SF).select(*columns).orderBy("doc_id").collect()]
    assert got == want


def test_directory_doubles_and_finds():
    directory = exact.Directory(16, capacity=4)
    keys = random.Random(4).choices(range(1 << 16), k=3000) + [77] * 20
    for i, k in enumerate(keys):
        directory.insert(k, (i,))
    assert len(directory.slots) == 1 << directory.depth > 256
    for k in set(keys):
        assert sorted(v[0] for _, v in directory.find(k)) == [i for i, x in enumerate(keys) if x == k]
    assert sum(len(b.entries) for b in directory.buckets()) == len(keys)
    assert all(len(b.entries) <= 4 or len({x[0] for x in b.entries}) == 1 or b.depth == 16 for b in directory.buckets())


def test_rows_find_their_bucket_through_the_directory(spark):
    docs = documents(spark, [(i, f"text {i}") for i in range(3000)])
    directories, entries, owner_bits = exact.build_index(docs, key_bits=12)
    slots = {r.owner: (r.global_depth, r.slots) for r in directories.collect()}
    rows = entries.collect()
    assert len(rows) == 3000 and owner_bits == 8 and sum(r.n for r in directories.collect()) == 3000
    for r in rows:
        depth, owned = slots[r.owner]
        assert len(owned) == 1 << depth
        inside = r.key & 15
        assert r.key >> 4 == r.owner and owned[inside >> (4 - depth)] == r.bucket and inside >> (4 - r.local_depth) == r.prefix


def test_a_directory_that_forgets_a_bucket_loses_its_rows(spark, monkeypatch):
    """Lookups go through the slots: with wrong slots nothing is found."""
    docs = documents(spark, [(i, f"text {i}") for i in range(50)])
    real = exact.build_index

    def broken(*args):
        directories, entries, bits = real(*args)
        return directories.selectExpr("owner", "global_depth", "transform(slots, x -> -1) AS slots", "n"), entries, bits

    monkeypatch.setattr(exact, "build_index", broken)
    assert exact.exact_groups(docs).count() == 0
