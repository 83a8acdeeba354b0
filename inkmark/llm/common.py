"""Shared helpers: the shared scratch folder, written intermediate tables, fixed text rules."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a maximal run of characters other than space and U+0009..U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which driver and executors share.

    Where the setting is absent, a local session (tests) gets a temporary folder; any other session is refused,
    because a machine-local folder would not be seen by the executors.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="inkmark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/inkmark/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df as Parquet into the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete intermediate tables that are no longer read."""
    jvm = spark._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def arrow_rows(spark: SparkSession, rows: int) -> None:
    """Bound the rows and bytes of an Arrow batch that goes to Python, so that long texts do not pile up in one batch.

    Spark reads the two settings when a plan runs, which is after this returns, so they are lowered and stay so; smaller ones of the
    session's are left alone.
    """
    batch = "spark.sql.execution.arrow.max{}PerBatch".format
    if not 0 < int(spark.conf.get(batch("Records"))) <= rows:
        spark.conf.set(batch("Records"), str(rows))
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(batch("Bytes"))) > 4 << 20:
        spark.conf.set(batch("Bytes"), str(4 << 20))


def open_file(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


class WholeFile:
    """A file that appears under its name only when it is whole.

    Names hold an id of the attempt: a task that runs again, or twice at once, writes another file, and only the one
    whose rows Spark takes is ever named by them.
    """

    def __init__(self, uri: str):
        self.fs, self.path = open_file(uri)
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.draft = f"{self.path}.{uuid.uuid4().hex}.draft"
        self.stream, self.at = self.fs.open_output_stream(self.draft), 0

    def add(self, data: bytes) -> int:
        """Where data begins."""
        start = self.at
        self.stream.write(data)
        self.at += len(data)
        return start

    def done(self) -> None:
        self.stream.close()
        self.fs.move(self.draft, self.path)


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else.

    ``lower`` does the same work faster, and is equal to it in texts whose only capital letters are A-Z; the others
    (and those with the three code points whose lower case needs care) take the character map.
    """
    plain = ~text.rlike(r"[\p{Lu}\p{Lt}\x{2160}-\x{216F}\x{24B6}-\x{24CF}&&[^A-Z]]")
    return F.when(plain, F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
