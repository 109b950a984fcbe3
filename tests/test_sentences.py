"""Sentences of blank and odd texts, beside the checking SQL."""

import duckdb

from __spark_entry__ import oracle_sql, queries
from tests.compare import check

TEXTS = [
    None, "", " ", " \n ", "﻿", "\u0001", "\u0001A. B", "a\u0001b", "A.\u0001 B", "A. \u0001B", "A.\u0001\u0001", "\u0000", "\u0085", "A. B! C? d. E",
    " A.  B", ". A", "! \nB\r\n \r\nC", "x.　Y \n\nZ", "A long sentence without an end", "É. É. E",
]


def test_odd_texts(spark, tmp_path):
    rows = list(enumerate(TEXTS))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    problem, n, _ = check(spark, con, str(tmp_path), "sentences", queries()["sentences"], oracle_sql()["sentences"])
    assert problem is None, problem
    assert n == len(TEXTS)
