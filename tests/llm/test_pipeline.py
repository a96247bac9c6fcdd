from __future__ import annotations

import random
import re

import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from marquee.llm import toxicity
from tests.llm.test_simhash import brute_fingerprint, brute_groups
from tests.llm.util import SF


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    toxic = {r.doc_id for r in toxicity.scores(docs, labels).collect() if r.predicted}
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        seen[name] = docs.collect()
        if name != "SentencePiece":
            assert docs.columns == columns
    kept = {r.doc_id for r in seen["toxicity"]}
    assert kept == set(range(200)) - toxic
    assert {r.doc_id for r in seen["line dedup"]} == kept
    assert all(r.n_chars == len(r.text) for r in seen["line dedup"])
    fps = {r.doc_id: brute_fingerprint(r.text, 5) for r in seen["line dedup"]}
    # All pairs within 4 of 64 bits are linked, and of others only pairs within the bits of the wide fingerprints.
    left = {r.doc_id for r in seen["SimHash near-dedup"]}
    exact = brute_groups(fps, 4)
    assert left <= set(exact.values())
    wide = {r.doc_id: brute_wide(r.text) for r in seen["line dedup"]}
    near = brute_groups({d: (fps[d], wide[d]) for d in fps}, None, lambda a, b: (a[0] ^ b[0]).bit_count() <= 4 or (a[1] ^ b[1]).bit_count() <= corpus_pipeline.NEAR_BITS)
    assert set(near.values()) <= left
    ids = [r.doc_id for r in seen["mixing sources"]]
    assert set(ids) == {r.doc_id for r in seen["SimHash near-dedup"]} and len(ids) > len(set(ids))
    assert sorted(r.doc_id for r in seen["SentencePiece"]) == sorted(ids) and all(r.round_trip for r in seen["SentencePiece"])


def brute_wide(text):
    """256 bits from the 5-word shingles: their XXH64 and three mixes of it."""
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))] if words else []
    m64 = (1 << 64) - 1

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & m64
        x = (x ^ x >> 27) * 0x94D049BB133111EB & m64
        return x ^ x >> 31

    out = 0
    for i in range(4):
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        hashes = [mix(h + i * 0x9E3779B97F4A7C15 & m64) if i else h for h in hashes]
        word = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        out |= word << 64 * i
    return out


def similarity(a, b):
    grams = lambda t: {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
    return len(grams(a) & grams(b)) / len(grams(a) | grams(b))


def test_near_copies_of_a_similarity_of_four_fifths(spark):
    """Copies with every 45th to 400th word changed go, other documents stay."""
    rng = random.Random(31)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    rows, pairs = [], []
    for i in range(120):
        one = [word() for _ in range(300)]
        step = [48, 60, 100, 150, 299][i % 5]
        two = [word() if j % step == step - 1 else w for j, w in enumerate(one)]
        rows += [(2 * i, " ".join(one)), (2 * i + 1, " ".join(two))]
        pairs.append((2 * i + 1, similarity(one, two)))
    rows += [(1000 + i, " ".join(word() for _ in range(300))) for i in range(100)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()}
    assert {i for i, _ in rows if i % 2 == 0 or i >= 1000} <= left
    near = [i for i, s in pairs if s >= 0.8]
    assert len(near) == 120 and sum(i not in left for i in near) >= 0.9 * len(near)


def edge_rows(spark):
    """Null, empty and very long texts, null and repeated ids, ties, and columns whose names the stages use themselves."""
    rows = [(1, None, "en", "s"), (2, "", "en", "s"), (3, "word " * 60_000, None, None), (None, "a text of its own", "en", "t"), (4, "same text here for all", "de", "s"), (4, "same text here for all", "de", "s"), (5, "same text here for all", None, "s")]
    docs = spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    clashes = {c: F.lit("x") for c in ("n", "row", "key", "number", "toxicity", "domain", "rate", "copies", "posteriors", "n_tokens", "host", "clean_text", "_text", "_host", "component_id", "fp", "ids")}
    return docs.withColumns(clashes)


def test_edges_of_every_stage(spark):
    docs = edge_rows(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        rows = out.collect()
        if name == "SentencePiece":
            assert len(rows) == 7 and all(r.round_trip for r in rows) and sorted(r.n_pieces for r in rows)[:2] == [0, 0]
        else:
            assert out.columns == docs.columns, name
            assert len(rows) == (4 if name == "SimHash near-dedup" else len(rows)) and len(rows) >= 4, (name, rows)
        assert stage(spark, docs.limit(0), SF).count() == 0, name
    kept = corpus_pipeline.drop_near_copies(spark, docs, SF).collect()
    assert sorted((str(r.doc_id), (r.text or "")[:4]) for r in kept) == [("1", ""), ("3", "word"), ("4", "same"), ("None", "a te")]


def test_lines_of_copies_are_no_boilerplate(spark):
    text = "one line\nanother line\na third"
    rows = [(i, text, "en", "s", len(text)) for i in range(50)] + [(100 + i, f"own {i}\nmenu", "en", "s", 5) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_boilerplate(spark, docs, SF).collect()}
    assert all(got[i] == text for i in range(50)) and all(got[100 + i] == f"own {i}" for i in range(10))


def test_null_and_repeated_ids(spark):
    """Each group of near copies keeps one row, whatever its ids are."""
    text = lambda name, n=40: " ".join(f"{name}{i}" for i in range(n))
    rows = [(None, text("a")), (None, text("b")), (None, text("b")), (5, text("b")), (None, text("c")), (None, text("c")), (7, text("d")), (7, text("e")), (8, text("f")), (9, text("g")), (9, text("f")), (4, text("h")), (4, text("h"))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text[0]) for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()), key=lambda r: r[1])
    assert got == [(None, "a"), (5, "b"), (None, "c"), (7, "d"), (7, "e"), (8, "f"), (9, "g"), (4, "h")]
    assert corpus_pipeline.drop_near_copies(spark, docs.limit(0), SF).count() == 0


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 100 and "ids" in out.columns
