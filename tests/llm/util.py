from __future__ import annotations

SF = "/root/testdata/sf0.001"


def documents(spark, rows):
    """doc_id and text, with further columns whose names clash with those the operators use."""
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs.selectExpr("doc_id", "text", "'x' AS key", "1 AS n", "'y' AS sha", "0L AS fp", "'z' AS source", "'en' AS lang", "0L AS n_chars")
