"""Registered queries of the subpackage: SQL where there is some, and agreement of what needs no model with brute force elsewhere."""

import duckdb
import pytest

import __spark_entry__
from packwright.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    cur = con.execute(ORACLES[name])
    columns = [d[0] for d in cur.description]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, cur.fetchall()))


def test_all_are_registered():
    names = __spark_entry__.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13
    assert "pipeline" in names and set(ORACLES) <= set(__spark_entry__.oracle_sql())
