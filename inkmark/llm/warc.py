"""WARC archives with a two-level capture index: sorted compressed blocks, and a sparse directory of them."""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import WholeFile, arrow_rows, discard, open_file, shared_dir, written

#: Captures of an index block.
LINES = 512
DATE = "2024-01-01T00:00:00Z"


def surt(url: str | None) -> str:
    """Sort key of a URL: host parts reversed and joined by commas, then ``)`` and path and query; empty for null."""
    if not url:
        return ")/"
    try:
        u = urlsplit(url.strip())
        name, port = (u.hostname or "").rstrip("."), u.port
    except ValueError:
        return ")/" + url
    name = name.removeprefix("www.")
    tail = (u.path or "/") + (f"?{u.query}" if u.query else "")
    return ",".join(reversed(name.split("."))) + (f":{port}" if port not in (None, 80, 443) else "") + ")" + tail


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record as a gzip member; a revisit (refers_to given) has no payload."""
    revisit = refers_to is not None
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page {page_id} {url} {digest}')}>",
        f"WARC-Date: {DATE}",
        f"WARC-Page-ID: {page_id}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: text/html; charset=utf-8",
    ]
    head += [f"WARC-Target-URI: {' '.join(url.split())}"] if url is not None else []
    head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Page-ID: {refers_to}"] if revisit else []
    body = b"" if revisit else payload
    head.append(f"Content-Length: {len(body)}")
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", 3, mtime=0)


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a record; raises ValueError if it is damaged."""
    raw = zlib.decompress(member, wbits=31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    n = int(headers["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("the record's length is wrong")
    return headers, rest[:n]


def write_archives(pages: DataFrame, root: str, min_revisit_bytes: int = 0) -> DataFrame:
    """Write a record per row of pages (page_id, url, html; others are ignored); returns the captures.

    Captures: key (SURT), page_id, file, offset, length. Payload: html in UTF-8, null as empty. Of rows with equal
    payloads of at least min_revisit_bytes bytes, the one with the smallest page_id (null is larger than any) is the
    response, the others revisit it; rows that repeat that page_id are responses too. Equality is that of the whole
    payload's SHA-256. An archive holds one partition of the input; its records are gzip members, read by range.
    """
    spark = pages.sparkSession
    arrow_rows(spark, 256)
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.encode(F.col("html").cast("string"), "UTF-8"), F.lit(b"")).alias("payload"))
    p = p.withColumn("sha", F.sha2("payload", 256))
    groups = p.filter(F.length("payload") >= min_revisit_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("sha", "first")
    p = p.join(groups, "sha", "left").select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{root}/archives/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}.warc.gz"
        out = None
        for b in batches:
            out = out or WholeFile(name)
            rows = []
            for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in b.columns)):
                data = record(page_id, url, payload, digest32(payload), refers_to)
                rows.append((surt(url), page_id, name, out.add(data), len(data)))
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=["key", "page_id", "file", "offset", "length"])
        if out:
            out.done()

    return p.mapInArrow(run, "key string, page_id long, file string, offset long, length long")


def write_index(captures: DataFrame, root: str) -> DataFrame:
    """Write the index of captures; returns one row a part: part, first (key), entries.

    Captures are sorted by key over all parts. A part is a file of gzip-compressed blocks of LINES captures each, one
    JSON line a capture, and beside it the sparse directory: of each block the first key, offset and length.
    """
    arrow_rows(captures.sparkSession, 256)
    n = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = captures.repartitionByRange(n, "key", "page_id").sortWithinPartitions("key", "page_id", "file", "offset").select("key", "page_id", "file", "offset", "length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{root}/index/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}"
        out, lines, directory, entries = None, [], [], 0

        def close() -> None:
            data = gzip.compress("\n".join(json.dumps(x) for x in lines).encode(), 3, mtime=0)
            directory.append([lines[0][0], out.add(data), len(data)])
            lines.clear()

        for b in batches:
            for line in zip(*(c.to_pylist() for c in b.columns)):
                out = out or WholeFile(f"{name}.blocks")
                entries += 1
                lines.append(line)
                if len(lines) == LINES:
                    close()
        if out:
            if lines:
                close()
            out.done()
            side = WholeFile(f"{name}.directory")
            side.add(json.dumps(directory).encode())
            side.done()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([directory[0][0]]), pa.array([entries], pa.int64())], names=["part", "first", "entries"])

    return keyed.mapInArrow(run, "part string, first string, entries long")


class Index:
    """Reader of one part: binary search of the directory, range reads of blocks, the last block kept."""

    def __init__(self, part: str):
        self.fs, path = open_file(part)
        with self.fs.open_input_file(f"{path}.directory") as f:
            self.directory = json.loads(f.read())
        self.firsts = [d[0] for d in self.directory]
        self.file, self.held = self.fs.open_input_file(f"{path}.blocks"), (-1, [])

    def block(self, i: int) -> list[list]:
        if self.held[0] != i:
            _, offset, length = self.directory[i]
            self.held = (i, [json.loads(x) for x in gzip.decompress(self.file.read_at(length, offset)).decode().split("\n")])
        return self.held[1]

    def holding(self, key: str) -> Iterator[int]:
        """The blocks that may hold captures of key. Equal keys may run over several blocks, the first of which may begin below key."""
        i = bisect_right(self.firsts, key) - 1
        while i > 0 and self.firsts[i] == key:
            i -= 1
        for i in range(max(i, 0), len(self.firsts)):
            if self.firsts[i] > key:
                return
            yield i

    def find(self, key: str, i: int) -> list[list]:
        """The captures of key in block i, in order."""
        lines = self.block(i)
        lo, hi = (side([x[0] for x in lines], key) for side in (bisect_left, bisect_right))
        return lines[lo:hi]


def look_up(keys: DataFrame, parts: DataFrame) -> DataFrame:
    """Captures and records of keys (key; one row each) from the index whose parts are given, as ``write_index`` returns them.

    The list of parts (a row each, with the part's first key) is small: as many as the tasks that wrote the index; it is
    refused beyond 100,000. Keys are sorted over tasks, which search the directories; the pairs of key and block that they find are then
    dealt to tasks anew, so that the captures of a hot key (at most LINES to a pair) are read by many. Records are read by
    range from the archives. Returns key, page_id, record_type, refers_to, payload, payload_digest (of what was
    read for a response, from its header for a revisit). Keys without a capture give no row, repeated keys count once.
    """
    spark = keys.sparkSession
    rows = parts.orderBy("part").limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("more than 100,000 index parts")
    names, firsts = [r["part"] for r in rows], [r["first"] for r in rows]
    arrow_rows(spark, 256)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = keys.select("key").distinct().repartitionByRange(n, "key").sortWithinPartitions("key")
    types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string())
    fields = ["key", "page_id", "record_type", "refers_to", "payload", "payload_digest"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[int, Index] = {}
        for b in batches:
            got = []
            for key in b.column(0).to_pylist():
                at = bisect_right(firsts, key) - 1
                while at > 0 and firsts[at] == key:
                    at -= 1
                for i in range(max(at, 0), len(names)):
                    if firsts[i] > key:
                        break
                    if i not in opened:
                        for old in [k for k in opened if k < i - 1]:
                            del opened[old]
                        opened[i] = Index(names[i])
                    got += [(key, names[i], j) for j in opened[i].holding(key)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got) if got else [()] * 3, (pa.string(), pa.string(), pa.int32()))], names=["key", "part", "block"])

    pairs = asked.mapInArrow(search, "key string, part string, block int").repartition(n, "part", "block").sortWithinPartitions("part", "block", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: tuple[str, Index | None] = ("", None)
        archives: dict[str, pa.NativeFile] = {}
        got, held = [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got), types)], names=fields)

        for b in batches:
            for key, part, block in zip(*(c.to_pylist() for c in b.columns)):
                if index[0] != part:
                    index = (part, Index(part))
                for _, page_id, file, offset, length in index[1].find(key, block):
                    if file not in archives:
                        if len(archives) >= 64:
                            archives.pop(next(iter(archives))).close()
                        fs, path = open_file(file)
                        archives[file] = fs.open_input_file(path)
                    headers, payload = parse(archives[file].read_at(length, offset))
                    revisit = headers["WARC-Type"] == "revisit"
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    if not revisit and digest32(payload) != digest:
                        raise ValueError(f"page {page_id}: the payload doesn't have its digest")
                    got.append((key, page_id, "revisit" if revisit else "response", int(headers["WARC-Refers-To-Page-ID"]) if revisit else None, None if revisit else payload, digest))
                    held += len(payload)
                    if held > 4 << 20 or len(got) >= 1024:
                        yield out()
                        got, held = [], 0
        if got:
            yield out()

    return pairs.mapInArrow(run, "key string, page_id long, record_type string, refers_to long, payload binary, payload_digest string")


def store(pages: DataFrame, root: str | None = None, min_revisit_bytes: int = 0) -> tuple[DataFrame, str]:
    """Write archives and index under root (default: the shared folder); returns the index's parts and root."""
    root = root or shared_dir(pages.sparkSession, "warc")
    captures, path = written(write_archives(pages, root, min_revisit_bytes), "warc-captures")
    parts, _ = written(write_index(captures, root), "warc-parts")
    discard(pages.sparkSession, path)
    return parts, root


@F.pandas_udf(StringType())
def surt_key(url: pd.Series) -> pd.Series:
    return url.map(lambda u: surt(u if isinstance(u, str) else None))


def round_trip(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to per row of pages, as read back from the archives.

    Every page's URL key is looked up in the index. The size of a revisit's payload is that of the response it refers to. Empty table:
    empty result; null url: a key of its own.
    """
    parts, _ = store(pages, None, min_revisit_bytes)
    read = look_up(pages.select(surt_key("url").alias("key")), parts)
    read, _ = written(read.select("page_id", F.length("payload").cast("long").alias("n"), "payload_digest", "record_type", "refers_to"), "warc-read")
    sizes = read.filter("record_type = 'response'").groupBy(F.col("page_id").alias("_to"), F.col("payload_digest").alias("_of")).agg(F.max("n").alias("_n"))
    out = read.filter("record_type = 'response'").select("page_id", F.col("n").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    again = read.filter("record_type = 'revisit'").join(sizes, (F.col("refers_to") == F.col("_to")) & (F.col("payload_digest") == F.col("_of")), "left")
    return out.unionByName(again.select("page_id", F.col("_n").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"))
