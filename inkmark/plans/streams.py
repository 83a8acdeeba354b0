"""The streaming jobs over the given tables, run until all that is there has been read."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F

from inkmark.operators.lifecycle import silences
from inkmark.sources.event_log import DayLog
from inkmark.sources.shared import shared_dir
from inkmark.streaming import jobs

from .audit import ACT, audit
from .audit import WITH as AUDIT
from .base import query, table
from .ledger import EDGES, LOG, status_log


@contextmanager
def rocksdb(spark, settings=jobs.ROCKSDB):
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def events(spark, d):
    """The events as a stream; the path is a pattern, as a stream takes a plain path for a folder, and it may be one file."""
    return spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/event[s].parquet")


def drained(stream, name: str, mode: str = "append"):
    """All rows that the stream gives for what its sources hold now; a batch that runs again replaces its own rows."""
    spark, path = stream.sparkSession, shared_dir(stream.sparkSession, name)
    write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/out/batch={n}")
    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out/batch=*")


@query("select user_id as client, floor(epoch(ts) / 86400)::bigint * 86400 as window_start, count(*) as n, count(*) > 2 as limited from events group by 1, 2")
def rate_limit_stream(spark, d):
    r = events(spark, d).select(F.col("user_id").alias("client"), F.col("ts").cast("timestamp").alias("ts"))
    out = drained(jobs.rate_limit_stream(r, "1 day", 2), "rate-limit", "update")
    return out.groupBy("client", F.unix_timestamp("window_start").alias("window_start")).agg(F.max("n").alias("n"), F.bool_or("limited").alias("limited"))


@query(f"""with recursive {LOG}, m as (select record_id, seq, status as t, row_number() over (partition by record_id order by seq) as n from lg), ed(a, b) as (values {EDGES}),
 s(record_id, n, status, applied) as (select distinct record_id, 0::bigint, 'PENDING', 0::bigint from m union all
   select s.record_id, m.n, case when ed.a is not null then m.t else s.status end, s.applied + case when ed.a is not null then 1 else 0 end from s join m on m.record_id = s.record_id and m.n = s.n + 1 left join ed on ed.a = s.status and ed.b = m.t)
 select record_id, arg_max(status, n) as status, arg_max(applied, n) as applied from s group by record_id""")
def lifecycle_stream(spark, d):
    with rocksdb(spark):
        out = drained(jobs.lifecycle_stream(status_log(spark, d, events(spark, d))), "lifecycle")
    return out.groupBy("record_id").agg(F.max_by("status", "seq").alias("status"), F.count_if("legal").alias("applied"))


SILENT = """n as (select user_id as record_id, ts, case event_type when 'view' then 'PENDING' end as status, lead(ts) over (partition by user_id order by ts, event_id) as nxt from events),
 w(event, secs, why) as (values ('STALE', 60, null), ('FAILED', 600, 'STUCK_PENDING'))
 select record_id, event, why as failure_reason, ts + secs * interval 1 second as at from n, w where status = 'PENDING' and (nxt is null or nxt > ts + secs * interval 1 second) and ts + secs * interval 1 second < (select max(ts) - interval 60 second from events)"""


def changes(spark, d, rows=None):
    log = status_log(spark, d, rows, "ts")
    return log.withColumn("ts", F.col("ts").cast("timestamp")).select("record_id", "ts", "seq", "status")


@query("with " + SILENT)
def stuck_stream(spark, d):
    """Records whose PENDING was followed by nothing for a minute (they may be taken over) and for ten (they fail)."""
    with rocksdb(spark):
        out = drained(jobs.silence_stream(changes(spark, d, events(spark, d))), "stuck")
    return out.withColumn("at", F.col("at").cast("timestamp_ntz"))


@query("with " + SILENT)
def stuck_timeout(spark, d):
    """The batch twin of ``stuck_stream``."""
    rows = changes(spark, d)
    until = rows.agg((F.max("ts") - F.make_dt_interval(mins=F.lit(1))).alias("u")).first()["u"]
    return silences(rows, jobs.WAITS, F.lit(until)).withColumn("at", F.col("at").cast("timestamp_ntz"))


@query("select user_id as document_id, max(event_id) as newest, count(*) as retained from events group by 1")
def retention_state(spark, d):
    """How many events of each document are in the state of a year's retention when all have come."""
    e = events(spark, d).select(F.col("user_id").alias("document_id"), F.col("event_id").alias("id"))
    with rocksdb(spark, jobs.ENDING):
        out = drained(jobs.retention_stream(e, 365 * 86_400), "retention", "update")
    return out.groupBy("document_id").agg(F.max("newest").alias("newest"), F.max("retained").alias("retained"))


@query(AUDIT + "select id, action, created_at from a where created_at >= timestamp '2024-01-31' - interval 10 day")
def retention_stream(spark, d):
    """The audit log as a stream writes it by days, and without what is older than ten days."""
    e = audit(spark, d, events(spark, d))
    path = shared_dir(spark, "day-log")
    log = DayLog(spark, f"{path}/log", e.schema)
    log.stream(e, f"{path}/checkpoint").awaitTermination()
    log.expire("2024-01-31", 10)
    return log.retained("2024-01-31", 10).select("id", "action", "created_at")


@query("select arg_min(event_id, {'t': ts, 'e': event_id}) as event_id, sha256(user_id || event_type) as sha256 from events group by user_id, event_type")
def dedup_stream(spark, d):
    e = events(spark, d).select("event_id", F.sha2(F.concat(F.col("user_id").cast("string"), "event_type"), 256).alias("sha256"), F.col("ts").cast("timestamp").alias("ts"))
    path = shared_dir(spark, "dedup")
    with rocksdb(spark):
        jobs.dedup_into(e, f"{path}/out", f"{path}/checkpoint", order=("ts", "event_id")).awaitTermination()
    return spark.read.schema(e.schema).parquet(f"{path}/out/batch-*").select("event_id", "sha256")


@query("select p.event_id as record_id, r.event_id as state from (select * from events where event_type = 'purchase') p left join events r on p.user_id = r.user_id and r.event_type = 'click' and r.ts between p.ts and p.ts + interval 1 day")
def ledger_join_stream(spark, d):
    """Pending transactions (purchases) with the receipts (clicks of the same user) that come within a day; those without one stay pending.

    The stream tells of a missing receipt only when the watermark has passed, which the end of the source may not reach; what it hasn't
    answered by then is pending too."""
    at = F.col("ts").cast("timestamp")
    p = events(spark, d).filter("event_type = 'purchase'").select(F.col("event_id").alias("record_id"), F.col("user_id").cast("string").alias("tx"), at.alias("sent_at"))
    r = events(spark, d).filter("event_type = 'click'").select(F.col("user_id").cast("string").alias("tx"), F.col("event_id").alias("state"), at.alias("mined_at"))
    out = drained(jobs.ledger_join_stream(p, r, "1 day"), "ledger-join")
    found = out.filter("state is not null").select("record_id", "state")
    waiting = table(spark, d, "events").filter("event_type = 'purchase'").select(F.col("event_id").alias("record_id")).join(found, "record_id", "left_anti")
    return found.unionByName(waiting.withColumn("state", F.lit(None).cast("long")))


def odd_audit(spark, d):
    e = audit(spark, d, events(spark, d))
    odd = F.col("action") == "REVOKE"
    return e.select("id", F.when(odd, "UNKNOWN").otherwise(F.col("action")).alias("action"), F.when(F.col("document_id") % 10 == 0, F.lit(None)).otherwise(F.col("outcome")).alias("outcome"))


@query(f"select event_id as id, case when {ACT} = 'REVOKE' or user_id % 10 = 0 then 'bad' else 'good' end as side from events")
def audit_feed(spark, d):
    """Audit events to the log, those that break its contract to a side table."""
    e, path = odd_audit(spark, d), shared_dir(spark, "audit")
    jobs.audit_append(e, f"{path}/good", f"{path}/bad", f"{path}/checkpoint").awaitTermination()
    read = lambda s: spark.read.schema(e.schema).parquet(f"{path}/{s}/batch=*").select("id", F.lit(s).alias("side"))
    return read("good").unionByName(read("bad"))


@query(f"select count(*) filter (not b) as good, count(*) filter (b) as bad from (select {ACT} = 'REVOKE' or user_id % 10 = 0 as b from events)")
def audit_counts(spark, d):
    """How many events the feed took and how many it set apart, as it counted them."""
    e, path = odd_audit(spark, d), shared_dir(spark, "audit")
    jobs.audit_append(e, f"{path}/good", f"{path}/bad", f"{path}/checkpoint", counts=f"{path}/counts").awaitTermination()
    return spark.read.schema("good long, bad long").parquet(f"{path}/counts/batch=*").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
