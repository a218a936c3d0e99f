"""Queries with SQL, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from skytrail.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, DATA).toPandas(), c.execute(queries.ORACLE_SQL[name]).df()
    cols = sorted(want.columns)
    clean = lambda df: sorted(tuple("-" if pd.isna(v) else str(v) for v in r) for r in df[cols].astype(object).itertuples(index=False))
    assert sorted(got.columns) == cols
    fix = lambda rows: [tuple(v.removesuffix(".0") for v in r) for r in rows]
    assert fix(clean(got)) == fix(clean(want))
