"""The time-driven jobs as Structured Streaming queries; each has a batch twin that gives the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from inkmark.operators.lifecycle import MOVES, STALE_SECONDS, STATES, STUCK_SECONDS

ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

#: For a stream whose state has a time to live and that shall end when its source is read: else it would look for expired state for ever.
ENDING = {**ROCKSDB, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}


def rate_limit_stream(requests: DataFrame, window: str, allowed: int, late: str = "10 minutes") -> DataFrame:
    """requests (client, ts) -> client, window_start, n, limited per client and tumbling window; later rows than ``late`` are dropped."""
    w = requests.withWatermark("ts", late).groupBy("client", F.window("ts", window).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return w.select("client", F.col("w.start").alias("window_start"), "n", (F.col("n") > allowed).alias("limited"))


class Lifecycle(StatefulProcessor):
    """One document's state: a move is made if the state is one it may leave, and reported as illegal otherwise."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("status", StructType([StructField("status", StringType())]))
        self.edges = set(MOVES)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        moves = pd.concat(list(rows)).sort_values("seq")
        status = self.state.get()[0] if self.state.exists() else "PENDING"
        out = []
        for seq, to in zip(moves["seq"], moves["status"], strict=True):
            legal = (status, to) in self.edges
            status = to if legal else status
            out.append((key[0], int(seq), to, status, legal))
        self.state.update((status,))
        yield pd.DataFrame(out, columns=["record_id", "seq", "asked", "status", "legal"])

    def close(self) -> None:
        pass


def lifecycle_stream(moves: DataFrame) -> DataFrame:
    """moves (record_id long, seq long, status: the state asked for) -> record_id, seq, asked, status (after it), legal.

    State is kept per document without expiry, in RocksDB (set ROCKSDB on the session). Moves of one micro-batch are applied in
    the order of seq, for which a document's moves of that micro-batch are held together: bound it at the source (maxFilesPerTrigger).
    """
    known = moves.filter(F.col("status").isin(*STATES))
    return known.groupBy("record_id").transformWithStateInPandas(Lifecycle(), "record_id long, seq long, asked string, status string, legal boolean", "Append", "none")


#: What a PENDING record's silence leads to, and after how many seconds: it may be taken over, then it fails.
WAITS = (("STALE", STALE_SECONDS), ("FAILED", STUCK_SECONDS))


def silence_stream(changes: DataFrame, waits: tuple[tuple[str, int], ...] = WAITS, late: str = "1 minute") -> DataFrame:
    """changes (record_id long, ts timestamp, seq long, status) -> record_id, event (STALE: may be taken over; FAILED), failure_reason, at.

    A row answers the one before it by (ts, seq), also where it comes in an earlier micro-batch; one that is exactly at the deadline is in
    time. So rows of a record that follow each other within a wait are one session of it, and what is silent is a session's last row: it is told when the
    watermark, ``late`` behind the newest row, has passed its deadline by a millisecond. State is a row for each session that is open. A row that comes
    when its own deadline has passed so is dropped for that wait. Batch twin: ``lifecycle.silences``.
    """
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("event"), F.lit(s).alias("secs"), F.lit(f"{s} seconds").alias("gap")) for name, s in waits]))
    # A session ends when the watermark reaches its end, but a row may still come that is exactly there: hence the millisecond.
    rows = changes.withWatermark("ts", f"{late} 1 millisecond").select("record_id", "ts", "seq", "status", each.alias("w"))
    last = rows.groupBy("record_id", "w.event", "w.secs", F.session_window("ts", F.col("w.gap"))).agg(F.max(F.struct("ts", "seq", "status")).alias("last"))
    why = F.when(F.col("event") == "FAILED", "STUCK_PENDING").alias("failure_reason")
    return last.filter("last.status = 'PENDING'").select("record_id", "event", why, (F.col("last.ts") + F.make_dt_interval(secs=F.col("secs"))).alias("at"))


class FirstSeen(StatefulProcessor):
    """Lets the first row of a key through; of those that come in one micro-batch, the one that is first by ``order``."""

    def __init__(self, order: list[str]):
        self.order = order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("seen", StructType([StructField("seen", StringType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            part = part.sort_values(self.order).head(1)
            first = part if first is None else pd.concat([first, part]).sort_values(self.order).head(1)
        if first is not None and not self.state.exists():
            self.state.update(("y",))
            yield first

    def close(self) -> None:
        pass


def dedup_stream(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key, once. Keys are kept without expiry, in RocksDB (set ROCKSDB on the session), so that no earlier row is read
    again; rows without a key count as one key."""
    return rows.groupBy(key).transformWithStateInPandas(FirstSeen(order), rows.schema, "Append", "none")


def dedup_into(stream: DataFrame, target: str, checkpoint: str, key: str = "sha256", order: tuple[str, ...] = ("ts",)):
    """Append the first row of each key to the Parquet table ``target``.

    A micro-batch writes to a folder of its own number, so one that runs again replaces its own rows.
    """
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{target}/batch-{number:09d}")
    new = dedup_stream(stream, key, list(order))
    return new.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ledger_join_stream(pending: DataFrame, receipts: DataFrame, wait: str = "1 hour") -> DataFrame:
    """pending (record_id, tx, sent_at) with the state of its receipt (tx, state, mined_at) that comes within the wait; those
    without one come out with a null state once the watermark has passed."""
    p, r = pending.withWatermark("sent_at", wait).alias("p"), receipts.withWatermark("mined_at", wait).alias("r")
    near = F.expr(f"p.tx = r.tx and r.mined_at between p.sent_at and p.sent_at + interval {wait}")
    return p.join(r, near, "left").select("p.record_id", "p.tx", "p.sent_at", "r.state")


class Retained(StatefulProcessor):
    """The events of a key that came within the retention, each with a time to live of its own."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.events = handle.getMapState("events", StructType([StructField("id", LongType())]), StructType([StructField("n", LongType())]), self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ids = sorted({int(i) for part in rows for i in part["id"].tolist()})
        had = {k[0] for k in self.events.keys()}
        for i in ids:
            self.events.updateValue((i,), (1,))
        yield pd.DataFrame({"document_id": [key[0]], "newest": [max(ids)], "retained": [len(had | set(ids))]})

    def close(self) -> None:
        pass


def retention_stream(events: DataFrame, seconds: int) -> DataFrame:
    """events (document_id long, id long) -> document_id, newest, retained: after each micro-batch, how many of the document's events are not older
    than ``seconds`` since they came. Older ones leave the state by themselves (set ENDING on the session, or ROCKSDB for a
    stream that goes on)."""
    rows = events.filter("document_id is not null and id is not null")
    return rows.groupBy("document_id").transformWithStateInPandas(Retained(seconds * 1000), "document_id long, newest long, retained long", "Update", "ProcessingTime")


def audit_append(stream: DataFrame, good: str, bad: str, checkpoint: str, actions: tuple[str, ...] = ("ISSUE", "VERIFY", "REVOKE", "LOGIN"), counts: str | None = None):
    """Append audit events; rows that break the contract go to a side table and never stop the feed.

    counts: a folder for the number of good and bad rows of each micro-batch, which are observed while the good ones are written. A batch that
    runs again replaces its rows and its numbers.
    """

    def write(batch: DataFrame, number: int) -> None:
        ok = F.coalesce(F.col("action").isin(*actions) & F.col("outcome").isin("SUCCESS", "FAILED"), F.lit(False))
        seen = Observation()
        told = batch.withColumn("_ok", ok).observe(seen, F.count_if("_ok").alias("good"), F.count_if(~F.col("_ok")).alias("bad"))
        told.filter("_ok").drop("_ok").write.mode("overwrite").parquet(f"{good}/batch={number}")
        batch.filter(~ok).write.mode("overwrite").parquet(f"{bad}/batch={number}")
        if counts:
            n = seen.get
            batch.sparkSession.createDataFrame([(n["good"], n["bad"])], "good long, bad long").coalesce(1).write.mode("overwrite").parquet(f"{counts}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
