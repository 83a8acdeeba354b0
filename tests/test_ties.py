"""Queries whose result turns on doubles that are equal but for rounding, against their SQL."""

import random

import duckdb
import pytest

from inkmark.operators import metrics as G
from inkmark.plans import registry
from tests.conftest import plain


def compared(spark, tmp_path, name, lineitem):
    """The query's rows and its SQL's, over made line items."""
    lineitem.repartition(3).write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    con.sql("set threads = 1")
    con.sql(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.sql(registry.ORACLES[name])
    got = registry.QUERIES[name](spark, str(tmp_path)).select(*[f"`{c}`" for c in want.columns])
    return plain(tuple(r) for r in got.collect()), plain(want.fetchall())


def test_best_split_takes_the_first_of_equals_whatever_doubles_say(spark):
    """3, 4, 4, 5 parts as well at 3 as at 4: a variance of 16/3, which comes out larger at 4."""
    groups = {1: (3, 4, 4, 5), 2: (1, 1, 2, 3, 3), 3: (2, 2, 4, 5, 7), 4: (6, 6), 5: (1, 1, 9)}
    rows = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "g long, v double")
    assert dict(map(tuple, G.best_split(rows, "g", "v").collect())) == {1: 3, 2: 1, 3: 2, 4: 128, 5: 1}


@pytest.mark.parametrize("most", [4, 30])
def test_best_split_of_small_groups_and_odd_values(spark, tmp_path, most):
    dice = random.Random(most)
    rows = [(g if g % 50 else None, dice.choice([None, 0.5, 1.5, 2.5, -3.0]) if g % 7 == 0 else float(dice.randint(1, 9))) for g in range(400) for _ in range(dice.randint(1, most))]
    got, want = compared(spark, tmp_path, "best_split", spark.createDataFrame(rows + [(9999, None)], "l_suppkey long, l_quantity double"))
    assert got == want


def test_votes_with_means_that_differ_in_their_last_bits_alone(spark, tmp_path):
    """Of two texts with three votes and equal means, the one wins whose sum, in the order of the table, comes out larger."""
    dice = random.Random(3)
    rows = []
    for doc in range(300):
        a = [dice.randint(0, 10) for _ in range(3)]
        b = dice.choice([[x, y, sum(a) - x - y] for x in range(11) for y in range(11) if 0 <= sum(a) - x - y <= 10])
        lines = [(n, x / 100, s) for n, (x, s) in enumerate([(x, 2) for x in a] + [(x, 0) for x in b])]
        rows += [(doc, 1, s, n, 1.0, x, "N") for n, x, s in dice.sample(lines, 6)]
    rows += [(-1, 1, 0, 0, 1.0, None, "N"), (-2, 1, 0, 0, 50.0, 0.1, "N"), (None, 1, 0, 0, 1.0, 0.1, "N"), (-3, 1, 0, 0, None, 0.2, "N")]
    df = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_returnflag string")
    got, want = compared(spark, tmp_path, "vote_readings", df)
    assert got == want
