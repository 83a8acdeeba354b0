"""What queries move, and that they say the same of odd rows as their SQL."""

from datetime import datetime, timedelta

import duckdb
import pytest

from inkmark.plans import registry
from tests.conftest import plain

MOST = {"resolve_submissions": 200, "apply_chain_reports": 200}


def shuffled(spark):
    """Bytes that tasks have written to shuffles so far."""
    told = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(told.apply(i).totalShuffleWrite() for i in range(told.size()))


@pytest.mark.parametrize("name", sorted(MOST))
def test_hashes_are_not_moved_again_and_again(spark, tmp_path, sf, name):
    before, lines = shuffled(spark), spark.read.parquet(f"{sf}/lineitem.parquet").count()
    registry.QUERIES[name](spark, sf).write.parquet(str(tmp_path / "out"))
    assert 0 < shuffled(spark) - before < MOST[name] * lines


@pytest.mark.parametrize("name", sorted(MOST))
def test_odd_lines(spark, tmp_path, name):
    """Line numbers that are null or beyond a digit, orders without a date, lines without an order, and some of them twice."""
    day = lambda k: datetime(1996, 1, 1) + timedelta(days=k % 5) if k % 13 else None
    orders = [(k, k % 7, "OPF"[k % 3], 1.0, day(k), "1-URGENT") for k in range(200)]
    lines = [(k, k, k % 4, n, 1.0) for k in range(0, 210, 2) for n in (1, 2, 3, 4, 6, 11, 13, None)]
    lines += [(k, k, 5, n, 2.0) for k in range(0, 60, 3) for n in (2, 5, 12)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    for t in ("orders", "lineitem"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.sql(registry.ORACLES[name])
    got = registry.QUERIES[name](spark, str(tmp_path)).select(*want.columns)
    assert plain(tuple(r) for r in got.collect()) == plain(want.fetchall())
