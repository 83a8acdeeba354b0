"""Near duplicates at every radius and number of bands, clusters of long chains, stored records by their keys."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from inkmark.operators import matching as M


def signatures(n, seed):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(n // 4)]
    rows = []
    for i in range(n):
        x = rng.choice(base)
        for b in rng.sample(range(64), rng.randrange(0, 6)):
            x ^= 1 << b
        rows.append((i, f"{x:016x}"))
    return rows


@pytest.mark.parametrize("radius", range(8))
def test_near_duplicates_are_those_of_brute_force(spark, radius):
    rows = signatures(240, radius)
    classes = {}
    for i, h in rows:
        classes.setdefault(h, []).append(i)
    names = {h: min(ids) for h, ids in classes.items()}
    want = {(names[h], i, 0) for h, ids in classes.items() for i in ids if i != names[h]}
    for h, a in names.items():
        for g, b in names.items():
            d = (int(h, 16) ^ int(g, 16)).bit_count()
            if a < b and d <= radius:
                want.add((a, b, d))
    df = spark.createDataFrame(rows, "id long, h string")
    for n in {M.bands_for(240, radius), 4, *([2] if radius < 6 else [3])}:
        assert {tuple(r) for r in M.near_duplicates(df, radius, n).collect()} == want


def test_wider_bands_for_larger_tables():
    assert M.bands_for(500, 7) == 8 and M.bands_for(100_000, 7) == 4 and M.bands_for(10**8, 7) == 2
    for n in M.BANDS:
        assert sum(w for _, w in M.bands(n)) == 64
    # Ten times the rows: under four fixed bands ten times the candidates of a row; with bands by size a fraction of that.
    cost = lambda rows: sum(M.work(rows, 7, M.bands_for(rows, 7)))
    assert all(cost(10 * n) < 6 * cost(n) for n in (10**4, 10**5, 10**6, 10**7, 10**8)) and cost(10**8) < 12 * cost(10**6)
    assert M.work(10**8, 7, 2)[1] < 300 < 90_000 < M.work(10**8, 7, 4)[1]


def test_near_duplicates_with_two_bands_of_three_flips(spark):
    rng = random.Random(1)
    rows = []
    for i in range(0, 40, 2):
        x = rng.getrandbits(64)
        flips = sum(1 << b for b in rng.sample(range(32), 3)) | sum(1 << (32 + b) for b in rng.sample(range(32), 4))
        rows += [(i, f"{x:016x}"), (i + 1, f"{x ^ flips:016x}")]
    got = {tuple(r) for r in M.near_duplicates(spark.createDataFrame(rows, "id long, h string"), 7, 2).collect()}
    assert got == {(i, i + 1, 7) for i in range(0, 40, 2)}


def rounds(monkeypatch):
    """The names of tables that clusters writes."""
    seen, real = [], M.written

    def spy(df, name):
        out = real(df, name)
        seen.append((name, out[1]))
        return out

    monkeypatch.setattr(M, "written", spy)
    return seen


@pytest.mark.parametrize("partitions", [1, 6])
def test_a_long_chain_takes_few_rounds_and_the_disk_of_the_last(spark, monkeypatch, partitions):
    seen = rounds(monkeypatch)
    chain = spark.range(0, 100_000, 1, partitions).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    out = M.clusters(chain.unionByName(spark.createDataFrame([(200_000, 200_000)], "a long, b long")))
    got = out.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low")).collect()
    assert sorted(map(tuple, got)) == [(0, 100_001, 0), (200_000, 1, 200_000)]
    assert len(seen) <= 6  # edges, the first labels, and at most four rounds; unmerged pairs take seventeen
    assert [Path(p.removeprefix("file://")).exists() for _, p in seen] == [False] * (len(seen) - 1) + [True]


def test_clusters_of_scattered_pairs(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)]
    up = list(range(400))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    want = {i: min(k for k in range(400) if find(k) == find(i)) for p in pairs for i in p}
    for kind in ("long", "string"):
        name = (lambda i: i) if kind == "long" else (lambda i: f"{i:04d}")
        df = spark.createDataFrame([(name(a), name(b)) for a, b in pairs], f"a {kind}, b {kind}").repartition(5)
        assert {r["id"]: r["cluster"] for r in M.clusters(df).collect()} == {name(i): name(c) for i, c in want.items()}
    assert M.clusters(spark.createDataFrame([], "a long, b long")).collect() == []
