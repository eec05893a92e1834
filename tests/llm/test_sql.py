"""The registered queries: one for each operator, and those with SQL against it on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from stripline.llm.oracles import ORACLES
from stripline.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{k}" for k in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    r = db.execute(ORACLES[name])
    cols = [c[0] for c in r.description]
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(cols)
    assert sorted(tuple(x) for x in df.select(*cols).collect()) == sorted(r.fetchall())
