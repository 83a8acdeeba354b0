"""Streams give what their batch twins give."""

import os
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from inkmark.operators.lifecycle import MOVES, silences
from inkmark.plans import audit
from inkmark.streaming import jobs

T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def rocksdb(spark):
    for k, v in jobs.ROCKSDB.items():
        spark.conf.set(k, v)
    yield
    for k in jobs.ROCKSDB:
        spark.conf.unset(k)


def stream(spark, df, path, files=2):
    df.repartition(files).write.parquet(str(path))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def ran(df, name, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_lifecycle(spark, tmp_path, rocksdb):
    states = ["STORED", "BLOCKCHAIN_PENDING", "REVOKED", "ISSUED", "FAILED", "PENDING"]
    rows = [(i % 3, i, states[(i * 7 + i // 3) % 6]) for i in range(60)]
    df = spark.createDataFrame(rows, "record_id long, seq long, status string")
    got = ran(jobs.lifecycle_stream(stream(spark, df, tmp_path / "in", 1)), "lifecycle", tmp_path).collect()
    want = {}
    for k, seq, to in rows:
        now = want.get(k, "PENDING")
        want[k] = to if (now, to) in MOVES else now
    last = {}
    for r in sorted(got, key=lambda r: r["seq"]):
        last[r["record_id"]] = r["status"]
    assert last == want and len(got) == 60


def test_rate_limit(spark, tmp_path):
    rows = [(c, T0 + timedelta(seconds=s)) for c in (1, 2) for s in range(0, 120 * c, 10)] + [(9, T0 + timedelta(days=1))]
    df = spark.createDataFrame(rows, "client long, ts timestamp")
    got = ran(jobs.rate_limit_stream(stream(spark, df, tmp_path / "in"), "60 seconds", 5, "2 hours"), "limits", tmp_path)
    twin = audit.limited(df.withColumn("id", F.monotonically_increasing_id()), 60, 5).filter("client <> 9").groupBy("client", "window_start").agg(F.max("n").alias("n"), F.bool_or("limited").alias("limited"))
    assert {(r[0], int(r[1].timestamp()), r[2], r[3]) for r in got.collect()} == {(r["client"], r["window_start"], r["n"], r["limited"]) for r in twin.collect()}


def at(minutes=0, seconds=0):
    return T0 + timedelta(minutes=minutes, seconds=seconds)


def silences_of(spark, batches, tmp_path, name):
    """What the stream tells, one file a trigger in the order of ``batches``, and what its batch twin does."""
    schema = "record_id long, ts timestamp, seq long, status string"
    for k, rows in enumerate(batches):
        f = spark.createDataFrame(rows, schema).coalesce(1)
        f.write.parquet(str(tmp_path / f"{name}-{k}"))
        for part in (tmp_path / f"{name}-{k}").glob("part-*.parquet"):
            (tmp_path / "in").mkdir(exist_ok=True)
            part.rename(tmp_path / "in" / f"{k:03d}.parquet")
            os.utime(tmp_path / "in" / f"{k:03d}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = ran(jobs.silence_stream(source), name, tmp_path)
    rows = spark.createDataFrame([r for b in batches for r in b], schema)
    twin = silences(rows, jobs.WAITS, F.lit(max(r[1] for b in batches for r in b) - timedelta(minutes=1)))
    plain = lambda df: sorted((r["record_id"], r["event"], r["failure_reason"] or "", r["at"]) for r in df.collect())
    return plain(got), plain(twin)


def test_stuck(spark, tmp_path, rocksdb):
    rows = [(1, at(), 1, "PENDING"), (2, at(), 1, "PENDING"), (2, at(5), 2, "STORED"), (4, at(), 1, "PENDING"), (4, at(0, 60), 2, "STORED"), (5, at(), 2, "STORED"), (5, at(), 1, "PENDING"), (6, at(), 1, "PENDING"), (6, at(0, 30), 2, "PENDING"), (3, at(30), 1, "PENDING")]
    got, twin = silences_of(spark, [rows], tmp_path, "stuck")
    assert got == twin == [(1, "FAILED", "STUCK_PENDING", at(10)), (1, "STALE", "", at(1)), (2, "STALE", "", at(1)), (6, "FAILED", "STUCK_PENDING", at(10, 30)), (6, "STALE", "", at(1, 30))]


def test_rows_that_come_out_of_order_are_answered_in_the_order_of_their_time(spark, tmp_path, rocksdb):
    """STORED at 200 s comes before PENDING at 150 s, which is within the watermark; and later rows of any kind."""
    batches = [[(1, at(0, 200), 2, "STORED"), (2, at(0, 200), 1, "PENDING")], [(1, at(0, 150), 1, "PENDING"), (3, at(0, 190), 1, "PENDING")], [(2, at(0, 230), 2, "STORED"), (3, at(0, 190), 2, "STORED")], [(9, at(40), 1, "STORED")]]
    got, twin = silences_of(spark, batches, tmp_path, "order")
    assert got == twin == []
    late = [[(1, at(), 1, "PENDING"), (2, at(), 1, "PENDING")], [(9, at(5), 1, "STORED")], [(1, at(5, 30), 2, "STORED")], [(9, at(30), 2, "STORED")]]
    got, twin = silences_of(spark, late, tmp_path / "b", "late") if (tmp_path / "b").mkdir() is None else None
    assert got == twin == [(1, "STALE", "", at(1)), (2, "FAILED", "STUCK_PENDING", at(10)), (2, "STALE", "", at(1))]


def test_expired_state_is_gone(spark, tmp_path, rocksdb):
    quiet = "spark.sql.streaming.noDataMicroBatches.enabled"
    spark.conf.set(quiet, jobs.ENDING[quiet])
    rows = lambda k: spark.createDataFrame([(7, k)], "document_id long, id long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run(name, seconds):
        s = spark.readStream.schema("document_id long, id long").parquet(str(tmp_path / "in"))
        out = []
        keep = lambda b, _: out.extend(r["retained"] for r in b.collect()) and None
        jobs.retention_stream(s, seconds).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
        return out

    rows(1)
    assert run("short", 3) == run("long", 9999) == [1]
    time.sleep(4)
    rows(2)
    assert run("short", 3) == [1] and run("long", 9999) == [2]
    spark.conf.unset(quiet)


def test_dedup_is_idempotent(spark, tmp_path, rocksdb):
    rows = [(i, f"h{i % 5}", T0 + timedelta(seconds=i)) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, sha256 string, ts timestamp")
    s = stream(spark, df, tmp_path / "in", 3)
    for _ in range(2):
        jobs.dedup_into(s, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out") + "/batch-*").collect()
    assert sorted(r["sha256"] for r in got) == [f"h{i}" for i in range(5)]


def test_dedup_remembers_keys_and_takes_the_first_of_a_batch(spark, tmp_path, rocksdb):
    arrive = lambda rows: spark.createDataFrame(rows, "id long, sha256 string, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda: jobs.dedup_into(spark.readStream.schema("id long, sha256 string, ts timestamp").parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    arrive([(1, "a", T0 + timedelta(seconds=5)), (2, "a", T0), (3, "b", T0)])
    run()
    arrive([(4, "a", T0 - timedelta(days=1)), (5, "c", T0)])
    run()
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out") + "/batch-*").collect()) == [2, 3, 5]


def test_audit_feed(spark, tmp_path):
    df = spark.createDataFrame([(1, "ISSUE", "SUCCESS"), (2, "NOPE", "SUCCESS"), (3, "VERIFY", None)], "id long, action string, outcome string")
    jobs.audit_append(stream(spark, df, tmp_path / "in"), str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "cp")).awaitTermination()
    ids = lambda p: sorted(r["id"] for r in spark.read.schema(df.schema).parquet(f"{tmp_path}/{p}/batch=*").collect())
    assert ids("good") == [1] and ids("bad") == [2, 3]


def test_the_feed_counts_what_it_takes_also_when_a_batch_runs_again(spark, tmp_path):
    import shutil

    df = spark.createDataFrame([(i, "ISSUE" if i % 3 else "NOPE", "SUCCESS") for i in range(30)], "id long, action string, outcome string")
    s = stream(spark, df, tmp_path / "in", 3)
    counts = lambda: sorted(map(tuple, spark.read.parquet(f"{tmp_path}/n").select("batch", "good", "bad").collect()))
    run = lambda: jobs.audit_append(s, f"{tmp_path}/good", f"{tmp_path}/bad", f"{tmp_path}/cp", counts=f"{tmp_path}/n").awaitTermination()
    run()
    first = counts()
    assert sum(n for _, n, _ in first) == 20 and sum(n for *_, n in first) == 10 and len(first) == 3
    shutil.rmtree(tmp_path / "cp")  # all batches run again
    run()
    assert counts() == first and spark.read.parquet(f"{tmp_path}/good").count() == 20


def test_ledger_join(spark, tmp_path):
    p = spark.createDataFrame([(1, "a", T0), (2, "b", T0), (3, "z", T0 + timedelta(hours=9))], "record_id long, tx string, sent_at timestamp")
    r = spark.createDataFrame([("a", "success", T0 + timedelta(minutes=5)), ("z9", "success", T0 + timedelta(hours=9))], "tx string, state string, mined_at timestamp")
    j = jobs.ledger_join_stream(stream(spark, p, tmp_path / "p", 1), stream(spark, r, tmp_path / "r", 1))
    got = {(x["record_id"], x["state"]) for x in ran(j, "joined", tmp_path).collect()}
    assert (1, "success") in got and (2, None) in got and all(x[0] != 3 for x in got)
