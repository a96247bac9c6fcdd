"""A corpus pipeline of five stages over ``documents``, each written as Parquet and read again.

All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm import lines, mixing, near, pieces, toxicity
from marquee.llm.batches import small_batches
from marquee.session import materialise, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labelled rows outside its test fold.

    Null and empty texts have no features and stay, as their score is below the
    threshold unless most labelled texts are toxic; null ids are scored like
    any other; repeated rows share their fate; an empty table stays empty.
    """
    small_batches(spark)
    model = toxicity.fit_tables(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select(F.struct(*docs.columns).alias("row"), F.col("text").alias("text")), model)
    return scored.filter(F.col("toxicity") < toxicity.THRESHOLD).select("row.*")


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on over a fifth of a source's documents go; every document stays.

    Documents of one source and text count once, so that the lines of a text
    are no boilerplate for being copied. A null source is a source of its own,
    a null text becomes an empty one; columns besides text and n_chars stay as
    they are; an empty table stays empty.
    """
    own = docs.select(F.struct(*docs.columns).alias("row"), F.col("source").alias("source"), F.col("text").alias("text"))
    found = lines.drop_boilerplate(own, F.col("source"), F.col("text"), once=True)
    new = {"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast("long")}
    return found.select(*(new.get(c, F.col(f"row.{c}")).alias(c) for c in docs.columns))


#: Bits of 256 that the wide fingerprints of a pair may differ in: pairs of a similarity of 0.8 differ in 39 on average, unrelated ones in 128.
NEAR_BITS = 48


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose fingerprints of five-word shingles are linked, one stays: at most 4 of 64 bits apart, or NEAR_BITS of 256 (see near.near_groups).

    It is the one of the smallest id; of several with that id, the one whose
    row is the smallest by hash. A null id is larger than all others, so a
    group without ids keeps one row too. Every group keeps exactly one row.
    Null and empty texts are one group. An empty table stays empty. Columns of
    ``docs`` whose names the stage uses itself are kept as they are.
    """
    small_batches(spark)
    # Rows are told apart by a number and their content, as ids may repeat or be null.
    key = F.xxhash64(*docs.columns)
    rows = materialise(docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("number"), key.alias("key")), "rows")
    found = near.near_groups(rows.select(F.col("number").alias("doc_id"), F.col("row.text").alias("text")), shingle=5, distance=4, blocks=8, wide=NEAR_BITS)
    group = found.select(F.col("doc_id").alias("number"), F.col("component_id").alias("group"))
    order = F.struct(F.col("row.doc_id").isNull().alias("none"), F.col("row.doc_id").alias("id"), "key", "number")
    # Groups grow with the documents, so they are never broadcast, at any size.
    keep = rows.select("number", "key", F.struct(F.col("row.doc_id")).alias("row")).join(group.hint("merge"), "number").groupBy("group").agg(F.min(order).alias("first"))
    keep = materialise(keep.select(F.col("first.number").alias("number")), "kept")
    return rows.join(keep.hint("merge"), "number").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rare domains come up to their shares to the power 0.7: documents repeat by their rates, at least once each.

    Null and empty texts have no tokens and stay once, and so do all texts
    where no row is labelled; null ids and repeated rows are taken like any
    other; an empty table stays empty.
    """
    small_batches(spark)
    own = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", "lang")
    found = mixing.mix(own, table(spark, sf_dir, "labels"), least=1.0)
    return found.select(F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), "copies"))).alias("copy"), "row").select("row.*")


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document, whose ids decode to its text; null and empty texts have none, repeated rows each have theirs."""
    small_batches(spark)
    return pieces.encode(docs, keep=("doc_id", "source", "lang"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_boilerplate),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources", mix_sources),
    ("SentencePiece", to_pieces),
]

#: Classifiers and fingerprints are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs, name.replace(" ", "_"))
    return docs
