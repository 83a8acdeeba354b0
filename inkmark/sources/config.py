"""Ground truth and thresholds from JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REQUIRED = ("cellFar", "regionFar", "wholeFar", "maxLocalisedCells")


def read_thresholds(spark: SparkSession, path: str) -> DataFrame:
    """One row: four numbers that must be there and not be negative, and regionStableMax or null; reading fails otherwise."""
    t = spark.read.schema(", ".join(f"{c} double" for c in (*REQUIRED, "regionStableMax"))).option("multiLine", True).json(path)
    for c in REQUIRED:
        t = t.withColumn(c, F.when(F.col(c) >= 0, F.col(c)).otherwise(F.raise_error(F.lit(f"threshold {c} is missing or negative")).cast("double")))
    return t


MANIFEST = "base struct<fields: map<string,string>>, samples array<struct<file: string, group: string, expectedVerdict: string, tamperedFields: array<struct<field: string, anchored: string, presented: string>>, tamperedRegions: array<struct<region: string>>>>"


def read_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(samples, expected fields, expected regions) of a nested ground-truth file."""
    s = spark.read.schema(MANIFEST).option("multiLine", True).json(path).select(F.explode("samples").alias("s")).select("s.*")
    samples = s.select("file", F.col("group").alias("grp"), F.col("expectedVerdict").alias("expected"))
    fields = s.select("file", F.explode("tamperedFields").alias("f")).select("file", "f.*")
    regions = s.select("file", F.explode("tamperedRegions").alias("r")).select("file", "r.region")
    return samples, fields, regions
