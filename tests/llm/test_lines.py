from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from marquee.llm import lines
from marquee.llm.queries import ORACLE_SQL, op8_line_dedup
from tests.llm.util import SF, documents


def test_query_like_sql(spark):
    sf = SF.replace("sf0.001", "sf0.01")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    columns = ["page_id", "host", "n_lines", "n_dropped", "clean_text"]
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL['op8_line_dedup']}) ORDER BY page_id").fetchall()
    got = [tuple(r) for r in op8_line_dedup(spark, sf).select(*columns).orderBy("page_id").collect()]
    assert got == want
    assert 0 < sum(r[3] for r in got) < sum(r[2] for r in got)


def test_ratio_and_edges(spark):
    rows = [(i, f"  menu \nown {i}\n\n{'half' if i % 5 == 0 else 'other ' + str(i)}\nmenu") for i in range(20)]
    rows += [(30, None), (31, ""), (30, None), (32, "menu"), (33, "x\n" * 50_000)]
    docs = documents(spark, rows)
    out = lines.drop_boilerplate(docs, F.when(F.col("doc_id") < 20, "a").when(F.col("doc_id") < 32, F.lit(None)).otherwise("b"), F.col("text"))
    got = {r.doc_id: r for r in out.collect()}
    for i in range(20):  # "half" is on exactly a fifth of the pages, which does not exceed the ratio
        assert got[i].clean_text == f"own {i}\n\n{'half' if i % 5 == 0 else 'other ' + str(i)}"
        assert (got[i].n_lines, got[i].n_dropped, got[i].host) == (5, 2, "a")
    assert got[30].clean_text == "" and got[31].clean_text == "" and got[30].host == ""
    assert got[32].clean_text == "menu" and got[33].n_dropped == 0
    assert out.count() == len(rows)
    assert lines.drop_boilerplate(docs.limit(0), F.col("source"), F.col("text")).count() == 0


def test_reserved_names(spark):
    docs = documents(spark, [(1, "a")])
    for name in sorted(lines.RESERVED):
        with pytest.raises(ValueError, match="reserved"):
            lines.drop_boilerplate(docs.withColumn(name, F.lit(1)), F.col("source"), F.col("text"))
