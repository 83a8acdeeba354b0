"""Tables of immutable parts under versions, and what writes to them: a sink that never stores a key twice, and claims of which one wins."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from inkmark.operators.lifecycle import STALE_SECONDS


class Moved(RuntimeError):
    """Another writer has committed the version that was to come next."""


@dataclass(frozen=True)
class Snapshot:
    version: int
    parts: tuple[tuple[int, str, str], ...]  # version, batch, folder

    def of(self, batch: str) -> tuple[int, str, str] | None:
        return next((p for p in self.parts if p[1] == batch), None)

    def before(self, version: int) -> Snapshot:
        return Snapshot(version - 1, tuple(p for p in self.parts if p[0] < version))


class VersionedTable:
    """Parquet parts in a shared folder, each added by the commit of one version under the name of its batch.

    A commit is one small file whose rename fails where that version exists, so of two writers that began from one version one wins, and the other
    has to look again. What a writer that lost, or was lost, has written is named by no version and so never read. A store whose
    rename doesn't fail on an existing file (some object stores) is not fit for the log.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), StructType.fromDDL(schema)
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.root}/{name}" if name else self.root)

    def snapshot(self) -> Snapshot:
        log = self._path("log")
        if not self._fs.exists(log):
            return Snapshot(0, ())
        # One row a commit: names, no data.
        rows = self.spark.read.schema("version long, batch string, folder string").json(f"{self.root}/log").collect()
        return Snapshot(max((r["version"] for r in rows), default=0), tuple(sorted((r["version"], r["batch"], r["folder"]) for r in rows)))

    def read(self, at: Snapshot | None = None) -> DataFrame:
        parts = (at or self.snapshot()).parts
        reader = self.spark.read.schema(self.schema)
        return reader.parquet(*[f"{self.root}/{folder}" for _, _, folder in parts]) if parts else self.spark.createDataFrame([], self.schema)

    def commit(self, rows: DataFrame, batch: str, on: Snapshot) -> Snapshot:
        """Write rows as a part and publish it as the version after ``on``; raises Moved, and keeps nothing, if that exists."""
        folder = f"parts/{uuid.uuid4().hex}"
        rows.select(*self.schema.names).write.parquet(f"{self.root}/{folder}")
        version = on.version + 1
        draft, final = self._path(f"drafts/{uuid.uuid4().hex}"), self._path(f"log/{version:012d}.json")
        self._fs.mkdirs(final.getParent())
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps({"version": version, "batch": batch, "folder": folder}).encode()))
        out.close()
        context = self._hadoop.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration())
        never = self.spark.sparkContext._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 0)
        try:
            context.rename(draft, final, never)
        except Exception as e:
            self._fs.delete(draft, False)
            self._fs.delete(self._path(folder), True)
            if "FileAlreadyExists" in str(e):
                raise Moved(f"version {version} is committed") from None
            raise
        return Snapshot(version, (*on.parts, (version, batch, folder)))


def retried(table: VersionedTable, batch: str, rows_on, tries: int):
    """Commit rows_on(snapshot) as a batch; begins again on the newest version when another writer was first. Returns the snapshot that it stands on; a
    batch that is there already isn't written again."""
    for _ in range(tries):
        now = table.snapshot()
        if done := now.of(batch):
            return now.before(done[0])
        try:
            table.commit(rows_on(now), batch, now)
            return now
        except Moved:
            continue
    raise Moved(f"{tries} other writers were first")


def store_absent(table: VersionedTable, rows: DataFrame, key: str, order: list[str], batch: str, tries: int = 20) -> DataFrame:
    """Store the first row (by ``order``) of each key that the table doesn't hold -> rows with already_stored.

    A key is never stored twice nor overwritten: not by later rows of the batch, by a batch that is given again under its name (which also gets
    the same answer), or by a writer that commits meanwhile. Rows without a key aren't stored, and their already_stored is null.
    ``order`` should tell rows of one key apart; rows that are equal in it are stored by their other columns' order.
    """
    rows = rows.withColumn("_n", F.monotonically_increasing_id())
    keyed = rows.filter(F.col(key).isNotNull())
    names = table.schema.names
    rank = F.struct(*order, *[c for c in names if c not in order])

    def fresh(at: Snapshot) -> DataFrame:
        # The smallest row of each key is found before rows are moved, so a key of any number of copies is one row a task.
        first = keyed.groupBy(key).agg(F.min(rank).alias("_r")).select(F.col(key).alias("_key"), "_r")
        return first.join(table.read(at).select(F.col(key).alias("_key")), "_key", "left_anti").select(*[F.col(f"_r.{c}").alias(c) for c in names])

    before = retried(table, batch, fresh, tries)
    kept = fresh(before).select(F.col(key).alias("_key"), rank.alias("_rank"))
    # Of rows that are equal throughout, one is the stored one.
    one = keyed.select(F.col(key).alias("_key"), rank.alias("_rank"), "_n").join(kept, ["_key", "_rank"], "left_semi").groupBy("_key").agg(F.min("_n").alias("_first"))
    told = keyed.join(one, F.col(key) == F.col("_key"), "left").withColumn("already_stored", ~F.coalesce(F.col("_n") == F.col("_first"), F.lit(False))).drop("_n", "_key", "_first")
    return told.unionByName(rows.filter(F.col(key).isNull()).drop("_n").withColumn("already_stored", F.lit(None).cast("boolean")))


def store_stream(stream: DataFrame, table: VersionedTable, key: str, order: list[str], checkpoint: str, name: str):
    """A stream into the table, each micro-batch under its number; one that runs again finds itself written."""
    write = lambda rows, n: store_absent(table, rows, key, order, f"{name}-{n}") and None
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


RECORD = "record_id long, status string, failure_reason string, updated_at timestamp, claimant string, revision long"


def current(records: DataFrame) -> DataFrame:
    """The newest revision of each record."""
    return records.groupBy("record_id").agg(F.max_by(F.struct(*[c for c in records.columns if c != "record_id"]), "revision").alias("_r")).select("record_id", "_r.*")


def claim_retry(table: VersionedTable, asks: DataFrame, batch: str, stale_seconds: int = STALE_SECONDS, tries: int = 20) -> DataFrame:
    """asks (record_id, at, claimant): take over records that FAILED, or are PENDING and silent for more than stale_seconds at ``at``.

    -> record_id, claimant of the claims that won. A record that is claimed is PENDING since ``at``, without a failure reason, at its next revision.
    Of several claims of one record exactly one wins: the first by (at, claimant) in a batch, and of two batches the one that commits first, as the
    other is then decided on the records that it left. A batch that is given again gets its first answer.
    """
    first = asks.filter("record_id is not null and at is not null").groupBy("record_id").agg(F.min(F.struct("at", "claimant")).alias("a"))
    free = (F.col("status") == "FAILED") | ((F.col("status") == "PENDING") & (F.col("updated_at") < F.col("a.at") - F.make_dt_interval(secs=F.lit(stale_seconds))))

    def won(at: Snapshot) -> DataFrame:
        j = current(table.read(at)).drop("claimant").join(first, "record_id").filter(free)
        return j.select("record_id", F.lit("PENDING").alias("status"), F.lit(None).cast("string").alias("failure_reason"), F.col("a.at").alias("updated_at"), "a.claimant", (F.col("revision") + 1).alias("revision"))

    return won(retried(table, batch, won, tries)).select("record_id", "claimant")
