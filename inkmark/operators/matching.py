"""Presented documents against anchored ones."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkmark.sources.shared import discard, materialised, written

ANCHORED = ("ISSUED", "REVOKED")


def newest_per_key(rows: DataFrame, key: str, at: str, id_col: str) -> DataFrame:
    """The newest row of each key; ties to the larger id."""
    order = Window.partitionBy(key).orderBy(F.desc(at), F.desc(id_col))
    return rows.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def cascade_lookup(presented: DataFrame, records: DataFrame) -> DataFrame:
    """presented (capture_id, file_hash, content_hash, lookup_key, status) -> capture_id, record_id, how.

    By file hash, else by content hash, else the newest of the same lookup key, among anchored records; the last two only for
    captures that were READ. Each later step sees the captures without a match alone.
    """
    r = records.filter(F.col("status").isin(*ANCHORED))
    by_file = presented.join(r.groupBy("file_hash").agg(F.min("record_id").alias("record_id")), "file_hash", "left")
    done = by_file.filter("record_id is not null").select("capture_id", "record_id", F.lit("file").alias("how"))
    left = by_file.filter("record_id is null").drop("record_id")
    read = left.filter("read_status = 'READ'")
    by_content = read.join(r.groupBy("content_hash").agg(F.min("record_id").alias("record_id")), "content_hash", "left")
    newest = newest_per_key(r, "lookup_key", "created_at", "record_id").select("lookup_key", F.col("record_id").alias("id_record"))
    last = by_content.join(newest, "lookup_key", "left")
    how = F.when(F.col("record_id").isNotNull(), "content").when(F.col("id_record").isNotNull(), "identity")
    rest = last.select("capture_id", F.coalesce("record_id", "id_record").alias("record_id"), how.alias("how"))
    unread = left.filter(~F.col("read_status").eqNullSafe("READ")).select("capture_id", F.lit(None).cast(records.schema["record_id"].dataType).alias("record_id"), F.lit(None).cast("string").alias("how"))
    return done.unionByName(rest).unionByName(unread)


def registry_state(records: DataFrame, registry: DataFrame | None) -> DataFrame:
    """Whether each record (record_id, content_hash, status) is registered and revoked; the ledger decides where it is available."""
    if registry is None:
        return records.select("record_id", F.lit(False).alias("chain_checked"), F.col("status").isin(*ANCHORED).alias("registered"), (F.col("status") == "REVOKED").alias("revoked"))
    g = registry.select("content_hash", F.lit(True).alias("_there"), F.col("revoked").alias("_revoked"))
    j = records.join(g, "content_hash", "left")
    checked = F.col("content_hash").isNotNull()
    return j.select("record_id", checked.alias("chain_checked"), F.when(checked, F.coalesce("_there", F.lit(False))).otherwise(F.col("status").isin(*ANCHORED)).alias("registered"), F.when(checked, F.coalesce("_revoked", F.lit(False))).otherwise(F.col("status") == "REVOKED").alias("revoked"))


def latest_revocation(records: DataFrame, events: DataFrame) -> DataFrame:
    """Reason and time of the last revocation event of each record; the record's own where the ledger has none."""
    last = events.groupBy("content_hash").agg(F.max_by(F.struct("reason", "at"), F.struct("block", "log_index")).alias("e"))
    return records.join(last, "content_hash", "left").select("record_id", F.coalesce("e.reason", "revocation_reason").alias("reason"), F.coalesce("e.at", "revoked_at").alias("at"))


def compare_to_anchor(pairs: DataFrame, diffs: DataFrame, confidences: DataFrame, certain: float = 90.0) -> DataFrame:
    """pairs (capture_id, read_status, same_hash) -> status MATCH, MISMATCH or INCONCLUSIVE, uncertain and changed fields.

    Equal hashes match whatever the confidence. A difference is certain if the field was read with ``certain`` or more, or only
    the anchor has it. mismatch_confidence: 1 for MATCH; for MISMATCH the least of the differing fields' / 100; else 0.
    """
    d = diffs.join(confidences, ["capture_id", "field"], "left")
    doubt = F.col("presented").isNotNull() & ~(F.coalesce("confidence", F.lit(-1.0)) >= certain)
    worth = F.coalesce("confidence", F.when(F.col("presented").isNull(), 100.0).otherwise(0.0))
    names = lambda c: F.array_join(F.array_sort(F.collect_list(c)), ",")
    g = d.groupBy("capture_id").agg(names(F.col("field")).alias("changed"), names(F.when(doubt, F.col("field"))).alias("uncertain"), F.min(worth).alias("worth"))
    j = pairs.join(g, "capture_id", "left")
    status = F.when(~F.col("read_status").eqNullSafe("READ"), "INCONCLUSIVE").when(F.col("same_hash"), "MATCH").when(F.coalesce("uncertain", F.lit("")) != "", "INCONCLUSIVE").otherwise("MISMATCH")
    j = j.withColumn("status", status)
    score = F.when(F.col("status") == "MATCH", 1.0).when(F.col("status") == "MISMATCH", F.coalesce(F.col("worth") / 100, F.lit(0.0))).otherwise(0.0)
    blank = lambda c: F.when(F.col("status") == "MATCH", "").otherwise(F.coalesce(c, F.lit("")))
    return j.select("capture_id", "status", blank("changed").alias("changed"), blank("uncertain").alias("uncertain"), score.alias("mismatch_confidence"))


def halves(h):
    """The two 32-bit halves of 16 hexadecimal digits, as longs."""
    return [F.conv(F.substring(h, a, 8), 16, 10).cast("long") for a in (1, 9)]


def hex_distance(a, b):
    """Differing bits of two strings of 16 hexadecimal digits."""
    return sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(halves(a), halves(b), strict=True)), F.lit(0))


def hamming_pairs(anchored: DataFrame, presented: DataFrame, cell: list[str]) -> DataFrame:
    """Bits that differ in each cell of two signature tables (cell columns, h, flat): both flat 0, one flat or missing 64."""
    p = presented.select(*cell, F.col("h").alias("ph"), F.col("flat").alias("pflat"))
    j = anchored.join(p, cell, "left")
    flat, pflat = F.coalesce("flat", F.lit(False)), F.coalesce("pflat", F.lit(False))
    return j.select(*cell, F.when(F.col("ph").isNull(), 64).when(flat & pflat, 0).when(flat | pflat, 64).otherwise(hex_distance(F.col("h"), F.col("ph"))).cast("int").alias("distance"))


#: Numbers of bands that signatures may be cut into.
BANDS = (2, 3, 4, 5, 6, 8)


def bands(n: int) -> list[tuple[int, int]]:
    """(first bit, width) of n bands of a signature of 64 bits."""
    edge = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edge, edge[1:], strict=False)]


def work(rows: int, radius: int, n: int) -> tuple[int, float]:
    """What a signature costs with n bands: the variants that it is asked for by, and the candidates that these meet among so many rows."""
    variants = [sum(comb(w, k) for k in range(radius // n + 1)) for _, w in bands(n)]
    return sum(variants), sum(v * rows / 2**w for v, (_, w) in zip(variants, bands(n), strict=True))


def bands_for(rows: int, radius: int) -> int:
    """The number of bands with which a signature costs least: the more rows, the wider the bands and the more variants of each are asked for."""
    return min(BANDS, key=lambda n: sum(work(rows, radius, n)))


def near_duplicates(signatures: DataFrame, radius: int = 7, n_bands: int | None = None) -> DataFrame:
    """Pairs (a, b, distance), a < b, of signatures (id, h: 16 hexadecimal digits) within radius of at most 7 bits, and membership.

    Ids of one signature form a class, named by its smallest id: each other member is paired with that at distance 0, and pairs of different
    signatures are between their classes' names. So k copies give k - 1 rows, and every pair of ids follows from the two.

    Of n bands one differs in at most radius / n bits. So one side is looked up by its bands, the other by its bands and their variants of so
    many bits, which misses no pair. How many bands there are is chosen by the number of signatures (``bands_for``): eight of 8 bits for
    hundreds, four of 16 bits and one flip for a million, two of 32 bits and three flips from thirty million on, so that the candidates
    of a signature don't grow in step with the table.
    """
    if not 0 <= radius <= 7:
        raise ValueError("radius must be from 0 to 7")
    spark = signatures.sparkSession
    named = materialised(signatures.groupBy("h").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")), "classes")
    members = signatures.join(named.filter("n > 1").select("h", F.col("id").alias("a")), "h").filter(F.col("id") != F.col("a"))
    n_bands = n_bands or bands_for(named.count(), radius)
    cut = bands(n_bands)
    bits = F.conv("h", 16, -10).cast("long")
    parts = F.array(*[F.struct(F.lit(i).alias("band"), F.shiftrightunsigned("x", 64 - at - w).bitwiseAND(F.lit((1 << w) - 1)).alias("bits")) for i, (at, w) in enumerate(cut)])
    s = named.select("id", "h", bits.alias("x")).select("id", "x", F.explode(parts).alias("k")).select("id", "x", "k.band", "k.bits")
    left = s.select(F.col("id").alias("a"), F.col("x").alias("ax"), "band", "bits")
    # The variants of a band are a table of a size that is fixed by its width: eleven thousand rows at most.
    flips = [(i, sum(1 << b for b in on)) for i, (_, w) in enumerate(cut) for k in range(radius // n_bands + 1) for on in combinations(range(w), k)]
    flips = F.broadcast(spark.createDataFrame(flips, "band int, flip long").coalesce(1))
    right = s.join(flips, "band").select(F.col("id").alias("b"), F.col("x").alias("bx"), "band", F.col("bits").bitwiseXOR(F.col("flip")).alias("bits"))
    j = left.join(right, ["band", "bits"]).filter("a < b").withColumn("distance", F.bit_count(F.col("ax").bitwiseXOR(F.col("bx"))).cast("int"))
    pairs = j.filter(F.col("distance") <= radius).select("a", "b", "distance").distinct()
    return pairs.unionByName(members.select("a", F.col("id").alias("b"), F.lit(0).alias("distance")))


#: Pairs whose parts a task finds at once.
PAIRS = 1 << 20


def contracted(pairs: DataFrame) -> DataFrame:
    """Edges (a, b) with the same components as pairs (a, b): of each slice of a partition, every node with the smallest of its part.

    It runs where the pairs are, before anything is moved: a slice of any number of pairs over n nodes leaves n, those of the smallest nodes with themselves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def parts() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            held.clear()
            ends = [t.column(k).to_pandas().to_numpy() for k in range(2)]
            names, at = np.unique(np.concatenate(ends), return_inverse=True)
            u, v = at[: len(ends[0])], at[len(ends[0]) :]
            label = np.arange(len(names))
            while (label[u] != label[v]).any():
                x, y = label[u], label[v]
                np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
                while (label != label[label]).any():
                    label = label[label]
            return pa.RecordBatch.from_arrays([pa.array(names[label], t.column(0).type), pa.array(names, t.column(0).type)], names=["a", "b"])

        n = 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= PAIRS:
                yield parts()
                n = 0
        if held:
            yield parts()

    kind = pairs.schema["a"].dataType.simpleString()
    return pairs.select("a", "b").mapInArrow(run, f"a {kind}, b {kind}")


def clusters(pairs: DataFrame) -> DataFrame:
    """(id, cluster): the smallest id each id of the pairs (a, b) is connected with.

    Pairs are contracted where they lie first; then rounds of taking the smallest label of the neighbours and the label's own label, until none
    changes. Every round is written to the shared folder, so a lost executor costs one round at most, and the one before it is
    deleted.
    """
    spark = pairs.sparkSession
    few, few_path = written(contracted(pairs).distinct(), "edges")
    both = few.unionByName(few.select(F.col("b").alias("a"), F.col("a").alias("b")))
    label, path = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("a"), F.min("b")).alias("cluster")), "labels")
    while True:
        seen = both.join(label.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("cluster").alias("m"))
        step = label.join(seen, "id").select("id", F.least("cluster", "m").alias("l"), F.col("cluster").alias("was"))
        up = step.select(F.col("id").alias("l"), F.col("l").alias("ll"))
        step, step_path = written(step.join(up, "l").select("id", "was", F.least("l", "ll").alias("cluster")), "labels")
        discard(spark, path)
        if step.filter("cluster <> was").isEmpty():
            discard(spark, few_path)
            return step.select("id", "cluster")
        label, path = step.select("id", "cluster"), step_path
