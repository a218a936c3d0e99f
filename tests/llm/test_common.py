import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from skytrail.llm import common


def test_shared_dir_is_the_session_setting_or_one_of_our_own():
    session = lambda value, master="local[2]": SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: value), sparkContext=SimpleNamespace(applicationId="app", master=master))
    assert common.shared_dir(session("file:///shared/", "spark://host:7077")) == "file:///shared"
    own = common.shared_dir(session(None))
    assert os.path.isdir(own) and common.shared_dir(session(None)) == own
    with pytest.raises(ValueError):
        common.shared_dir(session(None, "spark://host:7077"))


def test_bucketed_rank(spark):
    df = common.stash(spark.range(3000).select(F.expr("id % 3").alias("k"), "id").union(spark.createDataFrame([(0, 0)] * 5, "k long, id long")), "ranks")
    rows = common.bucketed_rank(df, ["k"], F.xxhash64("id"), ["id"], "r", 3005, rows_per_bucket=10).collect()
    for k in range(3):
        assert sorted(r.r for r in rows if r.k == k) == list(range(1005 if k == 0 else 1000))
    order = [r.id for r in sorted((x for x in rows if x.k == 1), key=lambda x: x.r)]
    assert order == [r.id for r in spark.range(3000).filter("id % 3 = 1").orderBy(F.xxhash64("id")).collect()]


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (7, 7), (200, 199)]
    got = {r.id: r.comp for r in common.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got.get(i, 0) == 0 for i in range(41)) and got[101] == got[102] == 100 and got[200] == 199
    assert common.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_broadcast_only_within_the_limit(spark):
    plan = lambda df: df._jdf.queryExecution().logical().toString()
    assert "broadcast" in plan(common.small(spark.range(5), 5)).lower()
    assert "broadcast" not in plan(common.small(spark.range(5), 10**9)).lower()
