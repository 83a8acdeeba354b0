"""An event log in folders of a day each: what a question can't need isn't read, and what is too old goes by the folder."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class DayLog:
    """Events with a time (timestamp_ntz) as Parquet under day=.../batch=..., sorted by a key within files.

    A batch that is written again replaces its own folders alone. Days are split over files by ranges of the key, so a busy day isn't one task, and
    a question for one key skips the files and row groups whose range doesn't hold it. Rows without a time are in a day of their own, never retained.
    """

    def __init__(self, spark: SparkSession, root: str, schema: StructType, at: str = "created_at", key: str = "document_id"):
        self.spark, self.root, self.at, self.key = spark, root.rstrip("/"), at, key
        self.schema = StructType(schema.fields).add("day", "date").add("batch", "string")

    def append(self, rows: DataFrame, batch: str) -> None:
        rows = rows.withColumn("day", F.to_date(self.at)).withColumn("batch", F.lit(batch))
        rows = rows.select(*self.schema.names).repartitionByRange("day", self.key, self.at).sortWithinPartitions("day", self.key, self.at)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(self.root)

    def stream(self, rows: DataFrame, checkpoint: str, name: str = "feed"):
        """Append a stream, each micro-batch under its number."""
        return rows.writeStream.foreachBatch(lambda b, n: self.append(b, f"{name}-{n}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def read(self, since: str | None = None, before: str | None = None) -> DataFrame:
        """Events with since <= time < before (null: no bound); other days' folders aren't listed for reading."""
        rows = self.spark.read.schema(self.schema).parquet(self.root)
        for text, keep in ((since, lambda c, v: c >= v), (before, lambda c, v: c <= v)):
            if text is not None:
                rows = rows.filter(keep(F.col("day"), F.to_date(F.lit(text).cast("timestamp_ntz"))))
        if since is not None:
            rows = rows.filter(F.col(self.at) >= F.lit(since).cast("timestamp_ntz"))
        if before is not None:
            rows = rows.filter(F.col(self.at) < F.lit(before).cast("timestamp_ntz"))
        return rows.drop("day", "batch")

    def days(self) -> list[dt.date]:
        fs, path = self._fs()
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(dt.date.fromisoformat(n[4:]) for n in names if n.startswith("day=") and not n.endswith("__"))

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def expire(self, as_of: str, days: int) -> list[dt.date]:
        """Delete the days that lie wholly before ``days`` days ago; the day of the limit itself stays, and ``retained`` cuts it."""
        fs, path = self._fs()
        limit = (dt.datetime.fromisoformat(as_of) - dt.timedelta(days=days)).date()
        gone = [d for d in self.days() if d < limit]
        for d in gone:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path, f"day={d.isoformat()}"), True)
        return gone

    def retained(self, as_of: str, days: int) -> DataFrame:
        limit = dt.datetime.fromisoformat(as_of) - dt.timedelta(days=days)
        return self.read(since=limit.isoformat(sep=" "))

    def of(self, key) -> DataFrame:
        """The events of one key."""
        return self.spark.read.schema(self.schema).parquet(self.root).filter(F.col(self.key) == F.lit(key)).drop("day", "batch")
