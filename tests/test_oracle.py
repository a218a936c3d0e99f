"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from skytrail.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    names = sorted(df.columns)

    def value(v):
        if pd.isna(v):
            return "-"
        # Whole numbers of a column with nulls come as floats from one side.
        return f"{float(v) + 0.0:.5f}" if isinstance(v, (int, float, np.number)) and not isinstance(v, bool) else str(v)

    return names, sorted(tuple(value(v) for v in r) for r in df[names].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_matches_sql(spark, duck, name):
    got = catalog.get(name)(spark, DATA).toPandas()
    want = duck.execute(catalog.SQL[name]).df()
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_without_sql_gives_rows(spark, name):
    assert catalog.get(name)(spark, DATA).limit(1).count() == 1


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_unknown_name_suggests():
    with pytest.raises(KeyError, match="eval_summary"):
        catalog.get("eval_sumary")
