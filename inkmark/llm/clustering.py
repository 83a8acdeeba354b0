"""Centroid clustering of integer vectors by scalar lookup tables."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, written

#: Vectors of a block; codes are of 16 bits, as no dimension of a block has more values than vectors.
BLOCK = 4096
#: Beyond components of this size sums of squares may leave 64 bits, and whole numbers of any size are used.
PLAIN = 1 << 26
LONG = (1 << 63) - 1


def integral(vector: Column) -> Column:
    """floor(256 * x) of each component as a long (those beyond a long become the nearest one)."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * 256).cast("long"))


def kept(rows: DataFrame, vec_id: str, vector: str, width: int) -> DataFrame:
    """(vec_id, v) of the vectors with ``width`` components, none of them null or not finite."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    v = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("v")).filter((F.size("v") == width) & F.forall("v", fine))
    return v.select("vec_id", integral(F.col("v")).alias("v"))


def tables(values: list[np.ndarray], centroids: np.ndarray) -> list[np.ndarray]:
    """Of each dimension the squared difference between each occurring value and each centroid's component."""
    return [(v[:, None] - centroids[None, :, k]) ** 2 for k, v in enumerate(values)]


class Coded:
    """A block of vectors as codes: of each component its number among the values that occur in its dimension."""

    def __init__(self, values: list[np.ndarray], codes: np.ndarray):
        self.values, self.codes = values, codes  # codes: dimension by vector

    @classmethod
    def of(cls, grid: np.ndarray) -> Coded:
        pairs = [np.unique(column, return_inverse=True) for column in grid.T]
        return cls([v for v, _ in pairs], np.array([c for _, c in pairs], dtype=np.uint16).reshape(grid.shape[1], len(grid)))

    def distances(self, centroids: np.ndarray) -> np.ndarray:
        """Squared distances, vector by centroid: gathers from the tables, summed over the dimensions."""
        plain = centroids.dtype != object and all(-PLAIN < v[0] and v[-1] < PLAIN for v in self.values)
        if not plain:
            centroids = centroids.astype(object)
        out = np.zeros((self.codes.shape[1], len(centroids)), dtype=np.int64 if plain else object)
        for t, c in zip(tables(self.values if plain else [v.astype(object) for v in self.values], centroids), self.codes):
            out += t[c]
        return out

    def sums(self, cluster: np.ndarray, k: int) -> tuple[np.ndarray, list[list[int]]]:
        """Of each cluster the number of vectors and the exact sum of each component."""
        n = np.bincount(cluster, minlength=k)
        out = []
        for v, c in zip(self.values, self.codes):
            # How often each value occurs in each cluster, times the value.
            often = np.bincount(cluster * len(v) + c, minlength=k * len(v)).reshape(k, len(v))
            small = max(abs(int(v[0])), abs(int(v[-1]))) < 1 << 40
            out.append((often @ v).tolist() if small else [sum(int(a) * int(b) for a, b in zip(row, v)) for row in often])
        return n, out


def coded(vectors: DataFrame) -> DataFrame:
    """Blocks of vectors (ids, values of each dimension, codes as bytes), written once and read by every round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in filter(len, batches):
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            for at in range(0, b.num_rows, BLOCK):
                c = Coded.of(flat[at : at + BLOCK])
                values = pa.array([[v.tolist() for v in c.values]], pa.list_(pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[at : at + BLOCK].to_pylist()], pa.list_(pa.int64())), values, pa.array([c.codes.tobytes()], pa.binary())], names=["ids", "values", "codes"])

    arrow_rows(vectors.sparkSession, BLOCK)
    return written(vectors.mapInArrow(run, "ids array<long>, values array<array<long>>, codes binary"), "cluster-codes")[0]


def _read(b: pa.RecordBatch) -> Iterator[tuple[list[int], Coded]]:
    for ids, values, codes in zip(*(c.to_pylist() for c in b.columns)):
        yield ids, Coded([np.array(v, dtype=np.int64) for v in values], np.frombuffer(codes, dtype=np.uint16).reshape(len(values), len(ids)))


def _nearest(block: Coded, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector, the one of the smaller number of equals, and its squared distance."""
    d = block.distances(centroids)
    best = np.zeros(len(d), dtype=np.int64)
    least = d[:, 0].copy()
    for j in range(1, d.shape[1]):
        less = d[:, j] < least
        best[less], least[less] = j, d[less, j]
    return best, least


def _array(centroids: list[list[int]]) -> np.ndarray:
    small = all(abs(x) < PLAIN for c in centroids for x in c)
    return np.array(centroids, dtype=np.int64 if small else object)


def moved(blocks: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after one round: the floor of the mean of each one's vectors; those without any stay.

    Every task adds up its blocks before it sends one row a cluster, so what is shuffled and what comes to the driver are clusters times
    dimensions, whatever the number of vectors.
    """
    grid, k = _array(centroids), len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, dtype=np.int64), [[0] * k for _ in centroids[0]]
        for b in batches:
            for _, block in _read(b):
                more, sums = block.sums(_nearest(block, grid)[0], k)
                n += more
                total = [[x + y for x, y in zip(a, s)] for a, s in zip(total, sums)]
        some = np.flatnonzero(n)
        of = [[Decimal(total[d][j]) for d in range(len(total))] for j in some]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some], pa.int64()), pa.array(of, pa.list_(pa.decimal128(38, 0)))], names=["cluster", "n", "sums"])

    part = blocks.mapInArrow(run, "cluster int, n long, sums array<decimal(38,0)>")
    width = len(centroids[0])
    added = part.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[d]).alias(f"s{d}") for d in range(width)])
    out = list(centroids)
    for r in added.collect():  # one row a cluster
        out[r["cluster"]] = [int(r[f"s{d}"]) // r["n"] for d in range(width)]
    return out


def assigned(blocks: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """(vec_id, cluster, distance) of every vector; distances beyond a long become the largest one."""
    grid = _array(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, block in _read(b):
                best, least = _nearest(block, grid)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(best, pa.int32()), pa.array([min(int(x), LONG) for x in least], pa.int64())], names=["vec_id", "cluster", "distance"])

    return blocks.mapInArrow(run, "vec_id long, cluster int, distance long")


def seeds(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors with the smallest SHA-256 of ``seed:vec_id``, in that order; equal ids by their components."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    return [list(r["v"]) for r in vectors.select(name.alias("h"), "v").orderBy("h", "v").limit(k).select("v").collect()]


def clustered(rows: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, width: int = 64, vec_id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """k-means over integer vectors: (vec_id, cluster, distance of every kept vector), (cluster, centroid array of its components, cluster_inertia).

    Components become floor(256 * x). Vectors that are null, of another width, or hold null or non-finite components take no part. Every
    round tabulates, for each dimension, the squared differences between the values that occur and the centroids' components; a
    distance is a sum of gathers from these. Distances and means are exact in whole numbers; means round down, ties go to the
    smaller number, and a centroid without vectors stays. Fewer than k vectors make fewer centroids. Repeated rows and ids are vectors each; a
    null id is one too. An empty table gives empty tables. Other columns are ignored. Memory is that of BLOCK vectors and the centroids.
    """
    spark = rows.sparkSession
    vectors = kept(rows, vec_id, vector, width)
    centroids = seeds(vectors, k, seed)
    if not centroids:
        none = spark.createDataFrame([], "cluster int, centroid array<long>, cluster_inertia long")
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), none
    blocks = coded(vectors)
    for _ in range(rounds):
        centroids = moved(blocks, centroids)
    out, _ = written(assigned(blocks, centroids), "cluster-assigned")
    inertia = out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("x"))
    table = spark.createDataFrame(list(enumerate(centroids)), "cluster int, centroid array<long>").coalesce(1)
    long = F.least(F.coalesce("x", F.lit(0).cast("decimal(38,0)")), F.lit(LONG).cast("decimal(38,0)")).cast("long")
    return out, table.join(inertia, "cluster", "left").select("cluster", "centroid", long.alias("cluster_inertia"))


def centroid_digest(centroid: Column) -> Column:
    """SHA-256 of a centroid's components as decimal numbers, joined by commas."""
    return F.sha2(F.array_join(F.transform(centroid, lambda x: x.cast("string")), ","), 256)
