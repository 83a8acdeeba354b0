"""Exact top-k by inner product with MaxScore over shards."""

from __future__ import annotations

import io
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WholeFile, arrow_rows, discard, open_file, shared_dir, written

#: Weights of a shard of candidates, and of a block of queries, at most about so many (rows are dealt by hash).
SHARD, QUERIES = 1 << 20, 1 << 17
#: Shards that one task searches for one block of queries, carrying the thresholds from one to the next.
TOGETHER = 16
#: Candidates of a block, which has score bounds of its own.
BLOCK = 2_048


def quantised(rows: DataFrame, vector: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id and the weights floor(scale * x) as array<long>; rows without id, or with unfit vectors, are left out.

    Unfit: a null vector, or a null or non-finite component. All others take part, however large; a weight that 64 bits don't hold is an
    error, as are scores (``top_k``). Empty vectors are kept; an empty table gives an empty result; repeated rows stay repeated.
    """
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    fit = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    ok = rows.filter(F.col("vec_id").isNotNull() & F.col(vector).isNotNull()).filter(fit)
    whole = lambda c: F.when(F.abs(c) * scale < 2.0**63, F.floor(c * scale)).otherwise(F.raise_error(F.lit("a weight leaves 64 bits")))
    return ok.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: whole(c).cast("long")).alias("w"))


class Shard:
    """The postings of one shard: of each term (a dimension) the candidates with a weight other than 0, in blocks of candidates.

    A term that most candidates of a block have is kept as a column, which is then shorter than a list of places and weights. The bound of a
    term in a block is the most that it adds to a score: q * max or q * min of its weights, and at least 0 where a candidate lacks it.
    """

    def __init__(self, ids: np.ndarray, weights: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, w = ids[order], weights[order]
        self.big = max(int(w.max(initial=0)), -int(w.min(initial=0)))
        self.kind = np.float64 if self.big < 2**53 else np.int64
        self.blocks = []
        for lo in range(0, len(w), BLOCK):
            part = w[lo : lo + BLOCK]
            often = np.count_nonzero(part, axis=0) * 2 > len(part)
            lists = {int(d): (at := np.flatnonzero(part[:, d]), part[at, d]) for d in np.flatnonzero(~often & part.any(axis=0))}
            self.blocks.append((lo, len(part), often, part[:, often].astype(self.kind), np.cumsum(often) - 1, lists, part.max(axis=0, initial=0), part.min(axis=0, initial=0)))

    def search(self, query: np.ndarray, own: int, k: int, best: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """ids and scores of the k best of ``best`` and the candidates but the query's own: score falling, then id rising.

        The threshold is the k-th best score so far. Terms are put in the order of their bounds; the longest head of
        that order whose bounds sum to less than the threshold is non-essential: a candidate on none of the other
        (essential) lists cannot come in. Essential lists are traversed and summed; the non-essential ones are
        probed, from the largest bound on, only for candidates that could still reach the threshold with those that are left.
        Sums are exact: in floating point while below 2^53, else in 64 bits, else in Python's integers.
        """
        most = self.big * sum(abs(int(x)) for x in query)
        kind = np.float64 if most < 2**53 else np.int64 if most < 2**63 else object
        q = query.astype(kind)
        top_i, top_s = best or (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
        top_s = top_s.astype(kind)
        for lo, n, often, columns, place, lists, high, low in self.blocks:
            ids = self.ids[lo : lo + n]
            bound = np.maximum(0, np.maximum(q * high.astype(kind), q * low.astype(kind)))
            order = np.argsort(bound, kind="stable")
            rise = np.cumsum(bound[order])
            full = len(top_s) == k
            cut = int(np.searchsorted(rise, top_s[-1], side="left")) if full else 0
            rest, essential = order[:cut], order[cut:]
            if full and not len(essential) and top_s[-1] > 0:
                continue
            dense = essential[often[essential]]
            score = columns[:, place[dense]].astype(kind, copy=False) @ q[dense] if len(dense) else np.zeros(n, dtype=kind)
            met = np.full(n, bool(len(dense)) or not full or top_s[-1] <= 0)
            for d in essential[~often[essential]].tolist():
                if d in lists:
                    at, w = lists[d]
                    score[at] += w.astype(kind) * q[d]
                    met[at] = True
            near = np.flatnonzero(met & (ids != own))
            for end in range(cut, 0, -8):
                near = near[score[near] + rise[end - 1] >= top_s[-1]]
                if not len(near):
                    break
                some = rest[max(0, end - 8) : end]
                dense = some[often[some]]
                if len(dense):
                    score[near] += columns[np.ix_(near, place[dense])].astype(kind, copy=False) @ q[dense]
                for d in some[~often[some]].tolist():
                    if d in lists:
                        at, w = lists[d]
                        i = np.minimum(np.searchsorted(at, near), len(at) - 1)
                        score[near] += np.where(at[i] == near, w[i], 0).astype(kind) * q[d]
            if full:
                near = near[score[near] >= top_s[-1]]
            if not len(near):
                continue
            s, i = np.concatenate((top_s, score[near])), np.concatenate((top_i, ids[near]))
            if len(s) > 8 * k and kind is not object:
                floor = np.partition(s, -k)[-k]
                s, i = s[s >= floor], i[s >= floor]
            first = np.lexsort((i, -s)) if kind is not object else np.array(sorted(range(len(s)), key=lambda x: (-s[x], i[x])), dtype=int)
            top_s, top_i = s[first[:k]], i[first[:k]]
        if kind is object and any(abs(x) >= 2**63 for x in top_s.tolist()):
            raise ValueError(f"a score of query {own} leaves 64 bits")
        return top_i, top_s.astype(np.int64)


def _grid(w: pd.Series) -> np.ndarray:
    return np.stack(w.to_numpy()).astype(np.int64)


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k candidates of highest inner product, ties to smaller vec_id.

    queries, candidates: vec_id and w as ``quantised`` makes them; a query is not its own candidate (equal vec_id).
    Fewer candidates than k: all of them. Rows that repeat a query's vec_id and vector count once; of different vectors
    with one vec_id the smallest is the query; as candidates, rows that repeat a vec_id each count. Vectors of a
    length other than the query's are not compared. An empty table on either side gives an empty result. Other columns are ignored.

    Candidates are dealt to shards of bounded size by a hash, and each shard is written once, as a file in the shared folder. Queries are dealt to
    blocks; a task reads TOGETHER shards one after the other for one block, and its k best are merged with those of the other tasks. So
    candidates are shuffled once whatever the number of queries.
    """
    spark = candidates.sparkSession
    arrow_rows(spark, 512)
    root = shared_dir(spark, "topk")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    parts = lambda rows, room, name: rows.groupBy("n").agg(F.ceil(F.count(F.lit(1)) * F.greatest(F.col("n"), F.lit(1)) / room).cast("int").alias(name))
    q, q_path = written(queries.groupBy("vec_id").agg(F.min("w").alias("w")).withColumn("n", F.size("w")), "topk-queries")
    c = candidates.select("vec_id", "w", F.size("w").alias("n")).join(q.select("n").distinct(), "n", "left_semi")
    shards = parts(candidates.select(F.size("w").alias("n")), SHARD, "shards")
    sizes, sizes_path = written(shards.join(parts(q, QUERIES, "blocks"), "n").withColumn("groups", F.ceil(F.col("shards") / TOGETHER).cast("int")), "topk-sizes")

    def save(pdf: pd.DataFrame) -> pd.DataFrame:
        data, uri = io.BytesIO(), f"{root}/{uuid.uuid4().hex}.npz"
        np.savez(data, ids=pdf["vec_id"].to_numpy(np.int64), w=_grid(pdf["w"]))
        out = WholeFile(uri)
        out.add(data.getvalue())
        out.done()
        return pd.DataFrame({"n": pdf["n"].iloc[:1], "shard": pdf["shard"].iloc[:1], "file": [uri]})

    dealt = c.join(sizes, "n").select("vec_id", "w", "n", F.pmod(F.xxhash64("vec_id", "w"), F.col("shards")).cast("int").alias("shard"))
    files, files_path = written(dealt.groupBy("n", "shard").applyInPandas(save, "n int, shard int, file string"), "topk-shards")
    tasks = files.groupBy("n", F.floor(F.col("shard") / TOGETHER).cast("int").alias("group")).agg(F.array_sort(F.collect_list("file")).alias("files"))
    asks = q.join(sizes, "n").select("vec_id", "w", "n", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block"), each("groups").alias("group"))
    asks = asks.join(tasks, ["n", "group"])

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, w = pdf["vec_id"].to_numpy(np.int64), _grid(pdf["w"])
        best: list = [None] * len(ids)
        for uri in pdf["files"].iloc[0]:
            fs, path = open_file(uri)
            with fs.open_input_file(path) as f:
                data = np.load(io.BytesIO(f.read()))
            shard = Shard(data["ids"], data["w"])
            best = [shard.search(v, i, k, b) for v, i, b in zip(w, ids.tolist(), best)]
        return pd.DataFrame({"query_id": np.repeat(ids, [len(b[0]) for b in best]), "vec_id": np.concatenate([b[0] for b in best]), "score": np.concatenate([b[1] for b in best])}).astype("int64")

    best, _ = written(asks.groupBy("n", "block", "group").applyInPandas(search, "query_id long, vec_id long, score long"), "topk-best")
    discard(spark, q_path, sizes_path, files_path, root)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
