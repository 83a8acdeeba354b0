"""Stored tables: keys are stored once, one claim wins, days that aren't asked for aren't read."""

import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from inkmark.operators import matching as M
from inkmark.sources import key_index
from inkmark.sources.event_log import DayLog
from inkmark.sources.shared import materialised, shared_dir
from inkmark.sources.versioned import RECORD, Moved, VersionedTable, claim_retry, current, store_absent, store_stream

T0 = datetime(2024, 1, 1)


def files(spark, *rows):
    return spark.createDataFrame(list(rows), "h string, ref long, more string")


def test_two_runs_of_one_batch_leave_each_key_once(spark):
    t = VersionedTable(spark, shared_dir(spark, "t"), "h string, ref long")
    a = files(spark, ("x", 2, "m"), ("x", 1, "m"), ("y", 3, "m"), (None, 4, "m"), ("x", 1, "m"))
    for _ in range(2):
        told = store_absent(t, a, "h", ["ref"], "a")
        assert sorted((r["h"] or "", r["ref"], str(r["already_stored"])) for r in told.collect()) == [("", 4, "None"), ("x", 1, "False"), ("x", 1, "True"), ("x", 2, "True"), ("y", 3, "False")]
    told = store_absent(t, files(spark, ("x", 0, "m"), ("z", 9, "m")), "h", ["ref"], "b")
    assert sorted((r["h"], r["already_stored"]) for r in told.collect()) == [("x", True), ("z", False)]
    assert sorted(map(tuple, t.read().collect())) == [("x", 1), ("y", 3), ("z", 9)]
    assert store_absent(t, files(spark).limit(0), "h", ["ref"], "none").count() == 0


def test_of_two_writers_one_begins_again(spark):
    t = VersionedTable(spark, shared_dir(spark, "t"), "h string, ref long")
    old = t.snapshot()
    t.commit(files(spark, ("x", 1, "")), "first", old)
    with pytest.raises(Moved):
        t.commit(files(spark, ("x", 2, "")), "second", old)
    real, calls = t.snapshot, []

    def behind():
        calls.append(1)
        return old if len(calls) == 1 else real()  # the first look is before the other's commit

    t.snapshot = behind
    told = store_absent(t, files(spark, ("x", 2, ""), ("y", 2, "")), "h", ["ref"], "second")
    assert len(calls) == 2 and {r["h"]: r["already_stored"] for r in told.collect()} == {"x": True, "y": False}
    t.snapshot = real
    assert sorted(map(tuple, t.read().collect())) == [("x", 1), ("y", 2)]


def test_a_stream_stores_a_key_once(spark, tmp_path):
    t = VersionedTable(spark, shared_dir(spark, "t"), "h string, ref long")
    files(spark, *[(f"k{i % 7}", i, "") for i in range(50)]).repartition(5).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("h string, ref long, more string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for checkpoint in ("a", "b"):  # the second one reads all again, under the same numbers
        store_stream(s, t, "h", ["ref"], str(tmp_path / checkpoint), "feed").awaitTermination()
    assert sorted(r["h"] for r in t.read().collect()) == [f"k{i}" for i in range(7)] and len(t.snapshot().parts) == 5


def records(spark):
    rows = [(1, "FAILED", "CHAIN_REVERTED", T0, None, 0), (2, "PENDING", None, T0 - timedelta(seconds=61), None, 0), (3, "PENDING", None, T0 - timedelta(seconds=60), None, 0), (4, "ISSUED", None, T0 - timedelta(days=9), None, 0)]
    t = VersionedTable(spark, shared_dir(spark, "r"), RECORD)
    t.commit(spark.createDataFrame(rows, RECORD), "load", t.snapshot())
    return t


def asks(spark, who, *ids, at=T0):
    return spark.createDataFrame([(i, at, who) for i in ids], "record_id long, at timestamp, claimant string")


def test_of_two_claims_of_a_record_one_wins(spark):
    t = records(spark)
    both = asks(spark, "b", 1, 2).unionByName(asks(spark, "a", 1, 3, 4, 99))
    assert sorted(map(tuple, claim_retry(t, both, "one").collect())) == [(1, "a"), (2, "b")]
    assert claim_retry(t, asks(spark, "c", 1, 2, 3, 4, at=T0 + timedelta(seconds=59)), "two").collect() == [(3, "c")]
    assert sorted(map(tuple, claim_retry(t, both, "one").collect())) == [(1, "a"), (2, "b")]  # given again
    now = {r["record_id"]: r for r in current(t.read()).collect()}
    assert (now[1]["status"], now[1]["failure_reason"], now[1]["updated_at"], now[1]["revision"]) == ("PENDING", None, T0, 1)
    assert now[4]["status"] == "ISSUED" and now[4]["revision"] == 0


def test_a_claim_that_was_overtaken_is_decided_anew(spark):
    t = records(spark)
    old, real, calls = t.snapshot(), t.snapshot, []
    claim_retry(t, asks(spark, "first", 1), "first")
    t.snapshot = lambda: calls.append(1) or (old if len(calls) == 1 else real())
    assert claim_retry(t, asks(spark, "second", 1, 2), "second").collect() == [(2, "second")]


def log_of(spark, days=20):
    rows = [(i, i % 9, T0 + timedelta(hours=i)) for i in range(24 * days)] + [(10_000, None, None)]
    df = spark.createDataFrame(rows, "id long, document_id long, created_at timestamp_ntz")
    log = DayLog(spark, shared_dir(spark, "log"), df.schema)
    for _ in range(2):
        log.append(df, "one")  # a batch that is given again replaces itself
    return log, df


def test_days_that_are_not_asked_for_are_not_read(spark):
    log, df = log_of(spark)
    part = log.read(since="2024-01-05 07:00:00", before="2024-01-06 03:00:00")
    assert {r["id"] for r in part.collect()} == set(range(4 * 24 + 7, 5 * 24 + 3))
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*day", plan) and re.search(r"PushedFilters: \[[^\]]*created_at", plan)
    read = {f.split("day=")[1][:10] for f in part.inputFiles()}
    assert read <= {"2024-01-05", "2024-01-06"} or len(read) == 21  # inputFiles tells of the relation where it isn't pruned
    scan = part._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    part.count()
    assert log.read().count() == df.count()
    one = log.of(4)
    assert {r["id"] for r in one.collect()} == {i for i in range(480) if i % 9 == 4}
    assert "PushedFilters: [IsNotNull(document_id), EqualTo(document_id,4)]" in one._jdf.queryExecution().executedPlan().toString() and scan is not None


def test_expired_days_go_as_folders(spark):
    log, df = log_of(spark)
    gone = log.expire("2024-01-15 12:00:00", 10)
    assert [d.isoformat() for d in gone] == [f"2024-01-0{k}" for k in range(1, 5)]
    assert log.days()[0].isoformat() == "2024-01-05"
    kept = {r["id"] for r in log.retained("2024-01-15 12:00:00", 10).collect()}
    assert kept == {r["id"] for r in df.filter(F.col("created_at") >= F.lit("2024-01-05 12:00:00").cast("timestamp_ntz")).collect()}
    assert log.expire("2024-01-15 12:00:00", 10) == []


def keyed(spark, name, buckets=8):
    rows = [(i, "ISSUED", T0 + timedelta(hours=i), f"{i % 50:064x}", None if i % 7 == 0 else f"{1000 + i:064x}", f"k{i % 3}") for i in range(300)]
    r = spark.createDataFrame(rows, "record_id long, status string, created_at timestamp, file_hash string, content_hash string, lookup_key string")
    key_index.write_index(r, [("file", "file_hash"), ("hash", "file_hash"), ("content", "content_hash"), ("identity", "lookup_key")], name, ["status"], ["created_at"], buckets)
    return r


def moved(df):
    """What stands below each exchange of a plan, as text."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange" in line], plan


def test_lookups_do_not_move_the_records(spark):
    keyed(spark, "recs_plan")
    plain = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}  # so few questions would be broadcast
    for k, v in plain.items():
        spark.conf.set(k, v)
    try:
        asks = spark.range(40).select(F.concat(F.lit("file:"), F.lpad(F.hex("id"), 64, "0")).alias("lookup"))
        asks = materialised(asks, "asks")
        with key_index.filtered(spark):
            exchanges, plan = moved(key_index.found(asks, "recs_plan"))
    finally:
        for k in plain:
            spark.conf.unset(k)
    assert "SortMergeJoin" in plan and "SelectedBucketsCount: 8 out of 8" in plan
    # What is moved by a key are the questions alone, and of these what the index may hold: a Bloom filter of its keys comes first.
    assert len([x for x in exchanges if "hashpartitioning" in x]) == 1 and "might_contain" in plan
    spark.sql("drop table recs_plan")


def test_lookups_by_key(spark):
    r = keyed(spark, "recs")
    asks = spark.createDataFrame([(1, f"{5:064x}"), (2, f"{77:064x}"), (3, "junk"), (None, f"{6:064x}"), (4, None), (5, "12345678-1234-1234-1234-123456789012")], "ask_id long, raw string")
    got = {r["ask_id"]: (r["record_id"], r["outcome"]) for r in key_index.bulk_lookup(asks, "recs").collect()}
    assert got == {1: (5, "found"), 2: (None, "not_found"), 3: (None, "bad_parameter"), None: (6, "found"), 4: (None, "bad_parameter"), 5: (None, "not_found")}
    rows = [(1, f"{7:064x}", f"{1001:064x}", "k0", "READ"), (2, "x", f"{1001:064x}", "k0", "READ"), (3, "x", "y", "k1", "READ"), (4, "x", f"{1001:064x}", "k1", "UNREADABLE"), (5, None, None, None, None)]
    p = spark.createDataFrame(rows, "capture_id long, file_hash string, content_hash string, lookup_key string, read_status string")
    got = sorted(map(tuple, key_index.cascade_lookup(p, "recs").collect()))
    assert got == [(1, 7, "file"), (2, 1, "content"), (3, 298, "identity"), (4, None, None), (5, None, None)]
    assert got == sorted(map(tuple, M.cascade_lookup(p, r).select("capture_id", "record_id", "how").collect()))
    spark.sql("drop table recs")
