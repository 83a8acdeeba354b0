"""Records laid out by their keys: a bucketed table in which lookups of any kind find them without moving a record."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Questions are thinned out by a Bloom filter of the index's keys before they are moved, where the index is small enough for one to tell.
FILTERED = {
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1GB",
}
# What a key of each kind looks like.
SHAPES = {"uuid": "^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$", "hash": "^[a-f0-9]{64}$", "tx": "^0x[a-f0-9]{64}$"}


@contextmanager
def filtered(spark: SparkSession) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in FILTERED}
    for k, v in FILTERED.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def named(kind: Column | str, key: Column) -> Column:
    """The name of a key in the index: its kind and itself; null without a key."""
    return F.concat(F.lit(kind) if isinstance(kind, str) else kind, F.lit(":"), key)


def write_index(records: DataFrame, keys: list[tuple[str, str]], table: str, carried: list[str], newest: list[str], buckets: int | None = None) -> None:
    """Save records (record_id, others) as a table bucketed by ``lookup``, a row for each key of each kind.

    keys: (kind, column); null keys have no row. A row has first_id, the smallest record_id of the key, and ``last``: record_id and carried of the newest, by
    ``newest`` and then the larger id. Keys are put together before they are moved, so one that a third of all records share is one
    row, too. buckets: at least the shuffle partitions of the sessions that ask (default: this one's), as Spark otherwise moves both sides.
    """
    spark = records.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ways = F.array(*[named(kind, F.col(column)) for kind, column in keys])
    rows = records.select("record_id", *carried, F.explode(ways).alias("lookup"), F.struct(*newest, "record_id").alias("_at")).filter("lookup is not null")
    one = rows.groupBy("lookup").agg(F.min("record_id").alias("first_id"), F.max_by(F.struct("record_id", *carried), "_at").alias("last"))
    one.repartition(buckets, "lookup").write.mode("overwrite").format("parquet").bucketBy(buckets, "lookup").sortBy("lookup").saveAsTable(table)


def found(asks: DataFrame, table: str, how: str = "inner") -> DataFrame:
    """asks (lookup and others) with the index's row of their lookup; only the asks are moved. how: inner, or left, which keeps asks without one."""
    known = asks.filter(F.col("lookup").rlike("^[a-z]+:."))
    return known.join(asks.sparkSession.table(table).hint("merge"), "lookup", how)


def kind_of(raw: Column) -> Column:
    """The kind of a key by its shape, or null."""
    kind = None
    for name, shape in SHAPES.items():
        kind = F.when(raw.rlike(shape), name) if kind is None else kind.when(raw.rlike(shape), name)
    return kind


def bulk_lookup(keys: DataFrame, table: str) -> DataFrame:
    """keys (ask_id, raw) of any kind -> ask_id, record_id (the smallest with that key), outcome found, not_found or bad_parameter, against the index."""
    asked = keys.select("ask_id", "raw", kind_of(F.col("raw")).alias("_kind"))
    hit = found(asked.filter("_kind is not null").select("ask_id", named(F.col("_kind"), F.col("raw")).alias("lookup")), table, "left")
    hit = hit.select("ask_id", F.col("first_id").alias("record_id"), F.when(F.col("first_id").isNull(), "not_found").otherwise("found").alias("outcome"))
    bad = asked.filter("_kind is null").select("ask_id", F.lit(None).cast(hit.schema["record_id"].dataType).alias("record_id"), F.lit("bad_parameter").alias("outcome"))
    return hit.unionByName(bad)


def cascade_lookup(presented: DataFrame, table: str) -> DataFrame:
    """presented (capture_id, file_hash, content_hash, lookup_key, read_status) -> capture_id, record_id, how, against an index of anchored records with
    the kinds file, content and identity.

    All of a capture's keys are asked for at once, and the first kind that answers counts; content and identity of captures that were READ alone.
    """
    read = F.coalesce(F.col("read_status") == "READ", F.lit(False))
    ways = F.array_compact(F.array(
        F.struct(F.lit(1).alias("rank"), F.lit("file").alias("how"), named("file", F.col("file_hash")).alias("lookup")),
        F.when(read, F.struct(F.lit(2).alias("rank"), F.lit("content").alias("how"), named("content", F.col("content_hash")).alias("lookup"))),
        F.when(read, F.struct(F.lit(3).alias("rank"), F.lit("identity").alias("how"), named("identity", F.col("lookup_key")).alias("lookup"))),
    ))
    asks = presented.select("capture_id", F.explode(ways).alias("w")).select("capture_id", "w.rank", "w.how", "w.lookup")
    record = F.when(F.col("how") == "identity", F.col("last.record_id")).otherwise(F.col("first_id"))
    best = found(asks, table).groupBy("capture_id").agg(F.min(F.struct("rank", "how", record.alias("record_id"))).alias("b"))
    return presented.select("capture_id").join(best, "capture_id", "left").select("capture_id", "b.record_id", "b.how")
