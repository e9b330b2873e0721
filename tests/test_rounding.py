"""Ties of the sixth decimal, against DuckDB."""

import duckdb

from cuelake.plans import fixtures as X
from cuelake.plans import quality_queries


def test_rounded_as_duckdb_rounds(spark):
    values = [k / 640 for k in range(-640, 640)] + [k / 128e4 for k in range(999)] + [0.0640625, 1e15 + 0.3]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(X.rounded("v")).collect()]
    assert got == [duckdb.execute("select round(?::double, 6)", [v]).fetchone()[0] for v in values]


def test_sentiment_of_a_tie(spark, tmp_path):
    """38 the, 15 of and 11 and: a mean of 4.1 / 64 = 0.0640625, whose millionfold is just below a half in double precision. With a few
    hundred documents DuckDB, too, adds in the order of the text."""
    text = " ".join(["the"] * 38 + ["of"] * 15 + ["and"] * 11)
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame([(k, text, "en") for k in range(300)], "doc_id long, text string, lang string").coalesce(1).write.parquet(path)
    query, sql = quality_queries.QUERIES["sentiment_preservation"]
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{path}/*.parquet'")
    want = con.execute(sql)
    columns = [d[0] for d in want.description]
    rows = sorted(want.fetchall())
    assert sorted(tuple(r) for r in query(spark, str(tmp_path)).select(*columns).collect()) == rows and rows[0][columns.index("polarity_a")] == 0.064062
