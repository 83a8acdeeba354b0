"""Exact deduplication as a stateful stream: keyed state on disk, without expiry, checked against the full bytes."""

from __future__ import annotations

import re
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, lower_ascii, shared_dir, written

STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # No disk is set aside ahead of use: with many partitions that would be most of what the state takes.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    # Stores are closed when their task ends, and share a small bound of native memory on an executor.
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Rows meet the digests of hits behind a Bloom filter of these, so that only texts that may be copies are moved.
BLOOM = {
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1GB",
}
ROW = "doc_id long, t string, digest string, locator string"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def arrive(docs: DataFrame, state: str, name: str) -> str:
    """Store an arrival of docs (doc_id, text): doc_id, normalised text, its digest, and a locator (arrival#row) that no other row has.

    An arrival that is stored whole already isn't stored again.
    """
    path = f"{state}/content/{name}"
    if not exists(docs.sparkSession, f"{path}/_SUCCESS"):
        text = lower_ascii(F.coalesce(F.col("text").cast("string"), F.lit("")))
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("t"))
        rows = rows.select("doc_id", "t", F.sha2("t", 256).alias("digest"), F.concat(F.lit(f"{name}#"), F.monotonically_increasing_id().cast("string")).alias("locator"))
        rows.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return path


def stream_state(spark: SparkSession, path: str, state: str, name: str = "all", files_per_batch: int = 1000) -> str:
    """Fold the arrival files under path that the state has not seen yet; returns the folder of the state updates under this name.

    The state holds one entry a digest for ever: the largest doc_id, its locator and the number of rows. It lives in
    RocksDB on the executors' disks and is checkpointed to the shared folder, so a lost executor or a restart resumes
    from the last commit. Each micro-batch writes the entries that it changed to a folder of its own number, so a
    batch that runs again replaces its own output.
    """
    updates = f"{state}/updates/arrival={name}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{updates}/batch={number}")

    with settings(spark, STATE):
        stream = spark.readStream.schema("doc_id long, digest string, locator string").option("maxFilesPerTrigger", files_per_batch).parquet(path)
        folded = stream.groupBy("digest").agg(F.max(F.struct("doc_id", "locator")).alias("top"), F.count(F.lit(1)).alias("copies"))
        query = folded.writeStream.outputMode("update").option("checkpointLocation", f"{state}/checkpoint").foreachBatch(keep).trigger(availableNow=True).start()
        query.awaitTermination()
    return updates


def latest(spark: SparkSession, updates: str) -> DataFrame:
    """The state after these updates: of each digest the entry with the most copies, as entries only grow."""
    read = spark.read.schema("digest string, top struct<doc_id: long, locator: string>, copies long").parquet(f"{updates}/batch=*")
    return read.groupBy("digest").agg(F.max(F.struct("copies", "top")).alias("s")).select("digest", F.col("s.top.doc_id").alias("keep_id"), F.col("s.top.locator").alias("locator"), F.col("s.copies").alias("group_size"))


def resolve(docs: DataFrame, state: str | None = None, arrival: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs (doc_id long, text string, others ignored).

    Equal texts: identical after lower-casing A-Z; null counts as empty. The row with the largest doc_id stays (a null
    doc_id is smaller than any; if all of a group are null, keep_id is null and the rows are kept). Rows that repeat
    the largest doc_id are all kept. Whole texts count, however long. Empty table: empty result.

    state: a folder that all executors share, in which the state and the texts of earlier arrivals are; docs are then decided beside
    these, and the state is carried on, one arrival at a time. Default: a new one, for docs alone. arrival: the caller's name of docs
    (letters, digits, ``-`` and ``_``). A name that the state has seen isn't counted again, so a job that was lost at any point can be given
    again; it must then hold the same rows, and is decided as it was.

    The stream decides by digest, and tells of the digests of this arrival alone. Every hit is then checked: the row that its digest's locator names is
    fetched, and the full bytes of this arrival's rows are compared with its; only folders that hold such a row are read. Digests
    under which texts differ are remembered, and their rows, of all arrivals, form groups by whole text.
    """
    spark = docs.sparkSession
    state, name = state or shared_dir(spark, "dedup-state"), arrival or uuid.uuid4().hex[:12]
    if not re.fullmatch(r"[A-Za-z0-9_-]+", name):
        raise ValueError("the name of an arrival is of letters, digits, - and _")
    ended = f"{state}/ended/{name}"
    known, ended_before = exists(spark, f"{state}/content/{name}/_SUCCESS"), exists(spark, ended)
    path = arrive(docs, state, name)
    updates = f"{state}/updates/arrival={name}"
    if not ended_before:
        stream_state(spark, f"{state}/content/*", state, name)
        # What a lost run has folded in may stand under the name of the arrival that came after it.
        updates = f"{state}/updates/arrival=*" if known else updates
        spark.range(1).coalesce(1).select(F.lit(updates).alias("updates")).write.mode("overwrite").parquet(ended)
    else:
        updates = spark.read.parquet(ended).first()[0]
    own_rows = spark.read.schema(ROW).parquet(path)
    mine = own_rows.select("digest").distinct() if updates.endswith("*") else None
    now = latest(spark, updates)
    now, _ = written(now if mine is None else now.join(mine, "digest", "left_semi"), "dedup-latest")

    hits = now.filter("group_size > 1").select("digest", F.col("locator").alias("kept"))
    with settings(spark, BLOOM):
        whole, whole_path = written(own_rows.join(hits, "digest"), "dedup-hits")
    stays = whole.filter(F.col("locator") == F.col("kept")).select("digest", F.col("t").alias("kept_t"))
    folders = [r[0] for r in hits.select(F.substring_index("kept", "#", 1).alias("a")).distinct().collect() if r[0] != name]  # names of arrivals
    if folders:
        older = spark.read.schema(ROW).parquet(*[f"{state}/content/{f}" for f in folders])
        stays = stays.unionByName(older.join(hits.withColumnRenamed("kept", "locator"), ["digest", "locator"]).select("digest", F.col("t").alias("kept_t")))
    # Not made distinct here, which would need a hot digest's rows in one task.
    differ = whole.join(stays, "digest").filter(F.col("t") != F.col("kept_t")).select("digest")
    with settings(spark, BLOOM):
        differ.write.mode("overwrite").parquet(f"{state}/apart/{name}")
    discard(spark, whole_path)
    apart = spark.read.schema("digest string").parquet(f"{state}/apart/*").distinct()

    # The rows meet the state as it is stored, so that Spark can split a hot digest.
    out = own_rows.select("doc_id", "digest", "locator").join(now.select("digest", "keep_id", "group_size"), "digest")
    keep, size = F.col("keep_id"), F.col("group_size")
    if not apart.isEmpty():
        every = spark.read.schema(ROW).parquet(f"{state}/content/*").join(apart, "digest")
        groups = every.groupBy("digest", "t").agg(F.max("doc_id").alias("own_keep"), F.count(F.lit(1)).alias("own_size"))
        own, _ = written(own_rows.join(groups, ["digest", "t"]).select("locator", "own_keep", "own_size"), "dedup-apart")
        out = out.join(own, "locator", "left")
        keep = F.when(F.col("own_size").isNotNull(), F.col("own_keep")).otherwise(keep)
        size = F.coalesce("own_size", size)
    return out.select("doc_id", keep.alias("keep_id"), size.alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), F.col("digest").alias("text_sha256"))


#: Dropped rows that are broadcast at most.
SENT = 500_000


def apply_dedup(docs: DataFrame) -> DataFrame:
    """docs without the rows that ``resolve`` drops; rows that repeat a kept doc_id and text all stay. Columns are kept whatever their names."""
    names, spark = [f"c{i}" for i in range(len(docs.columns))], docs.sparkSession
    state = shared_dir(spark, "dedup-state")
    dropped, _ = written(resolve(docs, state).filter(~F.col("kept")).select(F.col("doc_id").alias("drop"), F.col("text_sha256").alias("sha")), "dedup-dropped")
    discard(spark, state)  # the state and the copy of the texts end with the decision
    own = docs.select(*[F.col(c).alias(n) for c, n in zip(docs.columns, names)], F.col("doc_id").cast("long").alias("id"))
    digest = F.sha2(lower_ascii(F.coalesce(F.col(names[docs.columns.index("text")]).cast("string"), F.lit(""))), 256)
    # The join is on the id alone, so that only rows with an id that is dropped are hashed again. Up to SENT dropped rows (some 100 bytes each) are sent to all
    # tasks, so that no document is moved; more are met by a shuffle.
    if dropped.count() <= SENT:
        dropped = F.broadcast(dropped)
    left = own.join(dropped, F.col("id").eqNullSafe(F.col("drop")) & (digest <= F.col("sha")) & (digest >= F.col("sha")), "left_anti")
    return left.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names)])
