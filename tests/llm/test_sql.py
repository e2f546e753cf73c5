"""Queries that SQL can express, against it on the smallest tables."""

import duckdb
import pytest

from hazegrid.llm import queries

FOLDER = "/root/testdata/sf0.001"


def plain(frame):
    rows = frame.astype(object).where(frame.notna(), None).values.tolist()
    return [[int(x) if isinstance(x, float) else x for x in r] for r in rows]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    wanted = con.execute(queries.SQL[name]).df().sort_values("doc_id").reset_index(drop=True)
    got = queries.QUERIES[name](spark, FOLDER).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert sorted(got.columns) == sorted(wanted.columns)
    assert plain(got[wanted.columns]) == plain(wanted)
