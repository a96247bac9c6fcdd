from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from marquee.llm import toxicity
from marquee.llm.queries import op5_toxicity
from tests.llm.util import SF, documents


def test_held_out_accuracy(spark):
    sf = SF.replace("sf0.001", "sf0.1")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = op5_toxicity(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    test = [r for r in rows if r.held_out and r.doc_id in labels]
    hit = sum(r.predicted and labels[r.doc_id] for r in test)
    assert hit >= 0.8 * sum(labels[r.doc_id] for r in test)
    assert hit >= 0.9 * sum(r.predicted for r in test)


def test_scores_like_one_text_at_a_time():
    rng = random.Random(5)
    texts = [" ".join(rng.choices(["alpha", "beta", "gamma", "Delta", "épsilon"], k=60)) for _ in range(80)]
    rows = [(t + " nastyword", 1) if i % 4 == 0 else (t, 0) for i, t in enumerate(texts)]
    model = toxicity.fit(rows)
    weight = dict(zip(model.hashes.tolist(), model.weights.tolist(), strict=True))
    sample = [t for t, _ in rows] + [None, "", "nastyword", "x", "nastyword " * 20_000]
    got = model.logits(pa.array(sample))
    for t, z in zip(sample, got, strict=True):
        want = model.intercept + sum(weight.get(h, 0) for h in toxicity._doc_hashes(t or "").tolist())
        assert abs(z - want) < 1e-9
    predicted = toxicity.sigmoid(got[: len(rows)]) >= toxicity.THRESHOLD
    assert (predicted == np.array([y for _, y in rows])).all()
    assert got[-1] == model.logits(pa.array(["nastyword nastyword"]))[0]  # presence, not counts


def test_edge_tables(spark):
    docs = documents(spark, [(1, None), (2, ""), (3, "some text"), (3, "some text"), (None, "x")])
    labels = spark.createDataFrame([(1, 0, 1), (3, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.scores(docs, labels).collect()
    assert len(got) == 5 and len({r.score for r in got}) == 1
    assert toxicity.scores(docs, labels.limit(0)).count() == 5
    assert toxicity.scores(docs.limit(0), labels).count() == 0


def test_fit_takes_one_row_of_an_id_in_order(spark):
    """However rows repeat and are dealt, the model is the same, and with it every score."""
    rows = [(i, f"word{i % 7} fine text here {i}" + (" nastyword" if i % 4 == 0 else "")) for i in range(120)]
    labels = spark.createDataFrame([(i, 0, int(i % 4 == 0)) for i in range(120)] * 2, "doc_id long, quality int, toxic int")
    models = []
    for parts in (1, 7):
        docs = documents(spark, rows * 3 + [(0, "another text of the id"), (1, None)]).repartition(parts)
        m = toxicity.fit_tables(docs, labels, per_class=20)
        models.append((m.hashes.tolist(), m.weights.tolist(), m.intercept))
    assert models[0] == models[1] and len(models[0][0]) > 0
    out = toxicity.score(documents(spark, rows).withColumn("toxicity", F.lit("clash")), toxicity.Model(*map(np.array, models[0][:2]), models[0][2]))
    assert out.columns.count("toxicity") == 1 and out.count() == 120
