"""The operators' DuckDB SQL gives the rows of their queries on the smallest tables."""

import duckdb
import pytest

from codequarry.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in "documents pages benchmark labels".split():
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = c.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == cols
    place = [want.columns.index(x) for x in cols]
    assert sorted(str(tuple(r[x] for x in cols)) for r in df.collect()) == sorted(str(tuple(r[i] for i in place)) for r in want.fetchall())
