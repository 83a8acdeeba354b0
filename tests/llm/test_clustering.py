"""Clusters against plain loops over whole numbers."""

import math
import random
from hashlib import sha256

import numpy as np
import pytest

from inkmark.llm import clustering


def brute(vectors, k, rounds, seed):
    """vectors: (vec_id, whole numbers) -> [(vec_id, cluster, distance)], centroids."""
    order = sorted(vectors, key=lambda x: (sha256(f"{seed}:{'null' if x[0] is None else x[0]}".encode()).hexdigest(), x[1]))
    cents = [list(v) for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        parts = {}
        for _, v in vectors:
            parts.setdefault(near(v)[1], []).append(v)
        for j, vs in parts.items():
            cents[j] = [sum(x) // len(vs) for x in zip(*vs)]
    return [(i, near(v)[1], near(v)[0]) for i, v in vectors], cents


def check(spark, rows, k=5, rounds=3, width=4, partitions=3):
    given = [(i, v and [x if x is None else float(x) for x in v], *more) for i, v, *more in rows]
    df = spark.createDataFrame(given, "vec_id long, embedding array<double>, cluster string, ids int")
    out, clusters = clustering.clustered(df.repartition(partitions), k=k, rounds=rounds, seed=2, width=width)
    whole = lambda x: min(max(math.floor(x * 256), -(2**63)), 2**63 - 1)
    fit = [(r[0], [whole(x) for x in r[1]]) for r in rows if r[1] is not None and len(r[1]) == width and all(x is not None and math.isfinite(x) for x in r[1])]
    want, cents = brute(fit, k, rounds, 2)
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(map(tuple, out.collect()), key=key) == sorted(((i, c, min(d, 2**63 - 1)) for i, c, d in want), key=key)
    got = {r["cluster"]: (r["centroid"], r["cluster_inertia"]) for r in clusters.collect()}
    assert got == {j: (c, min(2**63 - 1, sum(min(d, 2**63 - 1) for _, x, d in want if x == j))) for j, c in enumerate(cents)}


@pytest.mark.parametrize("partitions", [1, 7])
def test_same_as_brute_force(spark, partitions, monkeypatch):
    monkeypatch.setattr(clustering, "BLOCK", 16)
    rng = random.Random(4)
    rows = [(i, [rng.gauss(i % 3, 0.3) for _ in range(4)], "x", 1) for i in range(120)]
    check(spark, rows, partitions=partitions)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.0, 0, 0, 0], "x", 1), (1, [0.0, 0, 0, 0], "x", 1), (None, [0.5, -0.001, 0, 1], "x", 1), (2, None, "x", 1), (3, [1.0], "x", 1), (4, [1.0, 2, None, 4], "x", 1), (5, [1.0, nan, 3, 4], "x", 1), (6, [inf, 1.0, 1, 1], "x", 1), (7, [1.0, 2, 3, 4, 5], "x", 1), (8, [], "x", 1), (9, [0.0, 0, 0, 0], "x", 1)]
    check(spark, rows)
    out, clusters = clustering.clustered(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert out.collect() == [] and clusters.collect() == []


def test_large_components_are_exact(spark):
    rng = random.Random(9)
    rows = [(i, [rng.choice([-1, 1]) * 10.0 ** rng.randrange(0, 30) for _ in range(4)], "x", 1) for i in range(60)]
    check(spark, rows)


def test_tables_hold_the_occurring_values_only():
    grid = np.array([[5, -1], [7, -1], [5, 3]])
    c = clustering.Coded.of(grid)
    t = clustering.tables(c.values, np.array([[5, 0], [6, 3]]))
    assert [x.shape for x in t] == [(2, 2), (2, 2)] and t[0].tolist() == [[0, 1], [4, 1]]
    assert c.distances(np.array([[5, 0], [6, 3]])).tolist() == [[1, 17], [5, 17], [9, 1]]
