"""Size-tiered compaction of immutable shards under an atomically committed, versioned manifest."""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType


@dataclass(frozen=True)
class Run:
    """One arrival, or one merge of several: the files of a folder that never change."""

    folder: str
    files: list[str]
    bytes: int
    schema: str  # of its files, as JSON


def united(schemas: list[StructType]) -> StructType:
    """All columns, in the order in which they first came; raises where two differ in type, or in the case of their name alone."""
    fields: dict[str, StructField] = {}
    for f in (f for s in schemas for f in s.fields):
        first = fields.setdefault(f.name.lower(), StructField(f.name, f.dataType, True))
        if (first.name, first.dataType) != (f.name, f.dataType):
            raise ValueError(f"column {f.name} {f.dataType.simpleString()} clashes with {first.name} {first.dataType.simpleString()}")
    return StructType(list(fields.values()))


@dataclass(frozen=True)
class Manifest:
    version: int
    runs: list[Run] = field(default_factory=list)

    @property
    def files(self) -> list[str]:
        return [f"{r.folder}/{f}" for r in self.runs for f in r.files]

    @property
    def schema(self) -> StructType:
        return united([StructType.fromJson(json.loads(r.schema)) for r in self.runs])


class ShardStore:
    """A table of immutable Parquet shards.

    base_bytes: runs below it are tier 0; each tier holds runs ``fan_in`` times larger. A tier with ``fan_in`` runs of less than target_bytes is
    merged into one run of files of about target_bytes; a run beyond target_bytes whose files are on average below half of it is merged
    alone, whatever its size; runs of such files are finished, so a byte is written once a tier at most. A manifest version lists
    all live files; it is published by one rename that fails if the version exists, so of two writers one wins and the other
    can retry on the new version. Readers see the old or the new version, never half a merge: shards are removed only when none of the
    last keep_versions versions names them, so a reader has that many commits to finish.

    Rows come back as they were appended: nulls, empty and long texts, ties and repeated rows alike; column names are the user's own but for the
    arrival column, which isn't stored. An empty table adds no run; a store without runs reads as None. Arrivals may differ in columns: the manifest
    knows each run's, reads and merges have those of all, and rows of a run without one have null there. An arrival with a column of another type
    than the store's is refused before anything is written.
    """

    def __init__(self, spark: SparkSession, root: str, base_bytes: int = 16 << 20, target_bytes: int = 256 << 20, fan_in: int = 4, keep_versions: int = 2, codec: str = "zstd"):
        self.spark, self.root, self.base_bytes, self.target_bytes, self.fan_in, self.keep_versions, self.codec = spark, root.rstrip("/"), base_bytes, target_bytes, fan_in, keep_versions, codec
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # Manifests -------------------------------------------------------------------------------------------------

    def versions(self) -> list[int]:
        folder = self._path(f"{self.root}/manifests")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest:
        have = self.versions()
        if version is None and not have:
            return Manifest(0)
        at = self._path(f"{self.root}/manifests/v{version or have[-1]:012d}.json")
        stream = self._fs.open(at)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        raw = json.loads(text)
        return Manifest(raw["version"], [Run(**r) for r in raw["runs"]])

    def commit(self, runs: list[Run], on: Manifest) -> Manifest:
        """Publish the next version after ``on``; raises if another writer has published it."""
        new = Manifest(on.version + 1, runs)
        final = self._path(f"{self.root}/manifests/v{new.version:012d}.json")
        draft = self._path(f"{self.root}/drafts/{uuid.uuid4().hex}.json")
        self._fs.mkdirs(final.getParent())
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps({"version": new.version, "runs": [asdict(r) for r in runs]}).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise RuntimeError(f"manifest version {new.version} was committed by another writer")
        return new

    # Shards ----------------------------------------------------------------------------------------------------

    def _run(self, folder: str, schema: StructType) -> Run | None:
        there = [s for s in self._fs.listStatus(self._path(folder)) if s.getPath().getName().endswith(".parquet") and s.getLen()]
        files = sorted((s.getPath().getName(), s.getLen()) for s in there)
        return Run(folder, [f for f, _ in files], sum(n for _, n in files), schema.json()) if files else None

    def _publish(self, runs: list[Run], on: Manifest, folder: str) -> Manifest:
        """Commit runs; what was written for a commit that another writer has forestalled goes."""
        try:
            return self.commit(runs, on)
        except RuntimeError:
            self._fs.delete(self._path(folder), True)
            raise

    def append(self, df: DataFrame, arrival: str | None = None) -> Manifest:
        """Add df as new shards. With the name of an arrival column, each of its values is a run and a commit."""
        folder = f"{self.root}/shards/{uuid.uuid4().hex[:12]}"
        writer = df.write.option("compression", self.codec)
        m = self.manifest()
        schema = StructType([StructField(f.name, f.dataType, True) for f in df.schema.fields if f.name != arrival])
        united([m.schema, schema])
        if arrival is None:
            writer.parquet(folder)
            run = self._run(folder, schema)
            return self._publish([*m.runs, run], m, folder) if run else m
        writer.partitionBy(arrival).parquet(folder)
        parts = sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(folder)) if s.isDirectory())
        for part in parts:
            if run := self._run(f"{folder}/{part}", schema):
                m = self.compact(self.commit([*m.runs, run], m))
        return m

    def tier(self, run: Run) -> int:
        return 0 if run.bytes < self.base_bytes else 1 + int(math.log(run.bytes / self.base_bytes, self.fan_in))

    def finished(self, run: Run) -> bool:
        return run.bytes >= self.target_bytes and run.bytes / len(run.files) >= self.target_bytes / 2

    def due(self, runs: list[Run]) -> list[Run]:
        """The runs that are to be merged next; none if all is in order."""
        tiers: dict[int, list[Run]] = {}
        for r in runs:
            if self.finished(r):
                continue
            if r.bytes >= self.target_bytes:
                return [r]
            tiers.setdefault(self.tier(r), []).append(r)
        return next((rs[: self.fan_in] for _, rs in sorted(tiers.items()) if len(rs) >= self.fan_in), [])

    def compact(self, m: Manifest | None = None) -> Manifest:
        """Merge while runs are due; one commit a merge."""
        m = m or self.manifest()
        while old := self.due(m.runs):
            folder = f"{self.root}/shards/{uuid.uuid4().hex[:12]}"
            n = max(1, int(sum(r.bytes for r in old) / self.target_bytes))
            part = Manifest(m.version, old)
            self._read(part).coalesce(n).write.option("compression", self.codec).parquet(folder)
            m = self._publish([r for r in m.runs if r not in old] + [self._run(folder, part.schema)], m, folder)
            self.vacuum()
        return m

    def vacuum(self) -> None:
        """Forget versions beyond keep_versions, then delete shards that only they name."""
        have = self.versions()
        kept, gone = have[-self.keep_versions :], have[: -self.keep_versions]
        live = {f for v in kept for f in self.manifest(v).files}
        dead = {f for v in gone for f in self.manifest(v).files} - live
        for f in dead:
            self._fs.delete(self._path(f), False)
        for v in gone:
            self._fs.delete(self._path(f"{self.root}/manifests/v{v:012d}.json"), False)

    def read(self, version: int | None = None) -> DataFrame | None:
        m = self.manifest(version)
        return self._read(m) if m.files else None

    def _read(self, m: Manifest) -> DataFrame:
        return self.spark.read.schema(m.schema).parquet(*m.files)
