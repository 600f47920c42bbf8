import duckdb
import pytest

from inkwell.llm import queries
from tests.test_operators import TABLES, plain

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_duckdb(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    want = c.sql(queries.SQL[name])
    assert sorted(want.columns) == sorted(df.columns)
    got = sorted(repr([plain(v) for v in r]) for r in df.collect())
    at = [want.columns.index(x) for x in df.columns]
    assert got == sorted(repr([plain(r[i]) for i in at]) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_other_queries_give_a_row_for_each_document(spark, name):
    rows = queries.QUERIES[name](spark, SF).collect()
    ids = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    if name != "op4_token_counts":
        assert {r.doc_id for r in rows} == ids
        assert name == "op9_packing" or len(rows) == len(ids)
