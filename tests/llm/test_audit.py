from __future__ import annotations

import itertools
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from marquee.llm import audit
from marquee.llm.queries import ORACLE_SQL, op11_filter_audit
from tests.llm.util import SF

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_query_like_sql(spark, size):
    sf = SF.replace("sf0.001", size)
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLE_SQL['op11_filter_audit']}) ORDER BY part, filter_order, step").fetchall()
    got = [tuple(r) for r in op11_filter_audit(spark, sf).select(COLUMNS).orderBy("part", "filter_order", "step").collect()]
    assert got == want and len(got) % 600 == 0 and sum(r[4] for r in got) > 0


def brute(rows, labels):
    """Part, order and step by applying the filters to the rows one after another."""
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    facts = []
    for i, (doc, text, source) in enumerate(rows):
        t = text or ""
        w = words(t)
        dup = doc is not None and any(d is not None and d < doc and (u or "") == t for d, u, _ in rows)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": dup}
        facts.append((i, source or "", fails, *(any(v == 1 for v in (x[k] for x in labels if x[0] == doc and doc is not None)) for k in (1, 2))))
    out = {}
    for part in {f[1] for f in facts}:
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = [f for f in facts if f[1] == part]
            for step, letter in enumerate(order, 1):
                gone = [f for f in left if f[2][letter]]
                every = [f for f in facts if f[1] == part and f[2][letter]]
                left = [f for f in left if not f[2][letter]]
                shapley[letter] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), len(every) - len(gone), sum(sum(f[2].values()) == 1 for f in every), sum(f[3] for f in gone), sum(f[4] for f in gone), letter]
        for (p, *_), v in out.items():
            if p == part:
                v[-1] = shapley[v[-1]]
    return out


def test_edges_like_brute_force(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(i, long, "a") for i in range(40)] + [(7, long, "a"), (7, long, "b"), (0, long, None), (None, long, "a"), (None, None, None), (1, "", ""), (2, None, "b"), (3, "ABC # x", "a"), (3, "ABC # x", "a"), (-5, "ABC # x", "c")]
    rows += [(100 + i, "the the " * 40, "a") for i in range(3)] + [(200, "É" * 30_000 + " x" * 50_000, "d"), (201, "\x0b\x1c", "d"), (202, long.upper(), "d")]
    labels = [(0, 1, 0), (0, 0, 1), (3, 0, 1), (5, 1, None), (None, 1, 1), (7, 1, 0), (101, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS mask", "2 AS part", "3 AS k", "4 AS fp").repartition(5)
    got = audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in got.collect()} == brute(rows, labels)
    assert audit.audit(docs.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


def test_groups_over_many_ranges(spark):
    """Copies of three texts fill all ranges; only the smallest id of each doesn't fail, wherever the ranges end."""
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.when(F.col("id") % 3 == 0, "one").when(F.col("id") < 15_000, "two").otherwise("three")).alias("text"), F.lit("s").alias("source"))
        found = audit.masks(docs)
        assert [r.doc_id for r in found.filter(F.col("mask") < 16).orderBy("doc_id").collect()] == [0, 1, 15_001]
        assert found.count() == 20_000
        same = docs.withColumn("doc_id", F.lit(4).cast("long"))
        assert audit.masks(same).filter(F.col("mask") >= 16).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_texts_of_one_fingerprint(spark, monkeypatch):
    """Texts that collide are told apart by themselves, within a range and over its edges."""
    monkeypatch.setattr(audit.F, "xxhash64", lambda c: F.length(c).cast("long"))
    rows = [(i, "abcd"[i % 4] * (1 + i % 2), "s") for i in range(400)]
    got = audit.masks(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert sorted(r.doc_id for r in got.filter("mask < 16").collect()) == [0, 1, 2, 3]
