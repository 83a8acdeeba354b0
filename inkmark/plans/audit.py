"""The audit log: events as audit events and requests."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from inkmark.functions.text import mask_ip
from inkmark.sources.event_log import DayLog
from inkmark.sources.shared import shared_dir

from .base import query, table

ACT = "case event_type when 'error' then 'LOGIN' when 'purchase' then 'ISSUE' when 'view' then 'VERIFY' when 'click' then 'VERIFY' else 'REVOKE' end"


def audit(spark, d, rows=None):
    e = F.col("event_type")
    action = F.when(e == "error", "LOGIN").when(e == "purchase", "ISSUE").when(e.isin("view", "click"), "VERIFY").otherwise("REVOKE")
    rows = table(spark, d, "events") if rows is None else rows
    return rows.select(F.col("event_id").alias("id"), action.alias("action"), F.when(e == "error", "FAILED").otherwise("SUCCESS").alias("outcome"), F.col("user_id").alias("document_id"), F.col("ts").cast("timestamp_ntz").alias("created_at"))


WITH = f"with a as (select event_id as id, {ACT} as action, case event_type when 'error' then 'FAILED' else 'SUCCESS' end as outcome, user_id as document_id, ts as created_at from events) "


def retained(events, as_of: str, days=365):
    """Events not older than the days before as_of; days that aren't a whole number of at least 1 count as 365."""
    try:
        days = int(days) if int(days) >= 1 else 365
    except (TypeError, ValueError):
        days = 365
    return events.filter(F.col("created_at") >= F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days)))


@query(WITH + "select id, action, created_at from a where created_at >= timestamp '2024-01-31' - interval 10 day")
def retention_filter(spark, d):
    return retained(audit(spark, d), "2024-01-31", 10).select("id", "action", "created_at")


# What a reader of the audit log may see.
SHOWN = ("action", "outcome", "reason", "actor_name", "document_id", "ip", "created_at")


def audit_view(events):
    """The columns of audit events that a reader may see; addresses are masked, ids of events and actors don't come out."""
    return events.withColumn("ip", mask_ip(F.col("ip"))).select(*[c for c in SHOWN if c in events.columns])


@query(WITH + "select action, outcome, 'user ' || document_id as actor_name, document_id, '10.1.' || document_id % 256 || '.0' as ip, created_at from a")
def reader_view(spark, d):
    u = F.col("document_id")
    e = audit(spark, d).withColumns({"actor_id": u, "actor_name": F.concat(F.lit("user "), u.cast("string")), "ip": F.concat(F.lit("10.1."), (u % 256).cast("string"), F.lit("."), (F.col("id") % 256).cast("string"))})
    return audit_view(e)


def history(events, limit: int = 100):
    """Each document's newest events, at most ``limit`` of them: the report's own bound."""
    newest = Window.partitionBy("document_id").orderBy(F.desc("created_at"), F.desc("id"))
    return events.withColumn("n", F.row_number().over(newest)).filter(F.col("n") <= limit)


@query(WITH + "select document_id, id, action, n from (select *, row_number() over (partition by document_id order by created_at desc, id desc)::int as n from a) where n <= 100")
def document_history(spark, d):
    return history(audit(spark, d)).select("document_id", "id", "action", "n")


def recent(events, action=None, outcome=None, before=None, limit: int = 50):
    """The newest events that fit; limit from 1 to 200."""
    limit = min(max(int(limit), 1), 200)
    for name, value in (("action", action), ("outcome", outcome)):
        events = events if value is None else events.filter(F.col(name) == value)
    events = events if before is None else events.filter(F.col("created_at") < F.lit(before).cast("timestamp_ntz"))
    return events.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


@query(WITH + "select id, action, outcome, document_id, created_at from a where action = 'VERIFY' and created_at < timestamp '2024-01-20' order by created_at desc, id desc limit 200")
def recent_events(spark, d):
    return recent(audit(spark, d), action="VERIFY", before="2024-01-20", limit=500)


def day_log(spark, d):
    """The audit events by days."""
    e = audit(spark, d)
    log = DayLog(spark, shared_dir(spark, "day-log"), e.schema)
    log.append(e, "all")
    return log


@query(WITH + "select id, action, outcome, document_id, created_at from a where action = 'VERIFY' and created_at < timestamp '2024-01-20' order by created_at desc, id desc limit 200")
def recent_events_by_day(spark, d):
    """``recent_events`` on the log, of which the days after the limit aren't read."""
    return recent(day_log(spark, d).read(before="2024-01-20"), action="VERIFY", limit=500)


@query(WITH + "select id, action, created_at from a where document_id = 7 order by created_at desc, id desc limit 100")
def history_by_day(spark, d):
    """The newest 100 events of one document: the log's files are sorted by document, so most row groups aren't read."""
    return day_log(spark, d).of(7).orderBy(F.desc("created_at"), F.desc("id")).limit(100).select("id", "action", "created_at")


def limited(requests, window_seconds: int, allowed: int):
    """requests (client, ts, id) with n, the request's number in its client's window, and limited: beyond what is allowed.

    Windows lie on multiples of their length since the epoch.
    """
    start = F.floor(F.unix_timestamp("ts") / window_seconds) * window_seconds
    order = Window.partitionBy("client", "window_start").orderBy("ts", "id")
    r = requests.withColumn("window_start", start.cast("long"))
    return r.withColumn("n", F.row_number().over(order)).withColumn("limited", F.col("n") > allowed)


@query("with w as (select event_id as id, user_id as client, floor(epoch(ts) / 86400)::bigint * 86400 as window_start, ts from events), n as (select *, row_number() over (partition by client, window_start order by ts, id)::int as n from w) select id, client, window_start, n, n > 2 as limited from n")
def rate_limit(spark, d):
    r = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("client"), "ts")
    return limited(r, 86400, 2).select("id", "client", "window_start", "n", "limited")


def rolled_up(checks):
    """checks (hour_at, component, state) -> hour_at, status: degraded if any component is down (missing and timed out ones are); not
    configured is not down."""
    down = ~F.coalesce(F.col("state").isin("ok", "not_configured"), F.lit(False))
    return checks.groupBy("hour_at").agg(F.when(F.bool_or(down), "degraded").otherwise("ok").alias("status"), F.count_if(down).alias("down"))


@query("""with c as (select date_trunc('hour', ts) as hour_at, case user_id % 4 when 0 then 'ok' when 1 then 'not_configured' when 2 then case when event_type = 'error' then 'timeout' else 'ok' end else case when value > 95 then null else 'ok' end end as state from events)
  select hour_at, case when bool_or(coalesce(state not in ('ok', 'not_configured'), true)) then 'degraded' else 'ok' end as status, count(*) filter (coalesce(state not in ('ok', 'not_configured'), true)) as down from c group by 1""")
def health_rollup(spark, d):
    u = F.col("user_id") % 4
    state = F.when(u == 0, "ok").when(u == 1, "not_configured").when(u == 2, F.when(F.col("event_type") == "error", "timeout").otherwise("ok")).otherwise(F.when(F.col("value") > 95, F.lit(None)).otherwise("ok"))
    return rolled_up(table(spark, d, "events").select(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour_at"), u.alias("component"), state.alias("state")))
