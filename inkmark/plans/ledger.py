"""Lifecycle and ledger: orders as records, line items as ledger events."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from inkmark.operators import lifecycle as L
from inkmark.operators import matching as M
from inkmark.sources.key_index import bulk_lookup as key_lookup
from inkmark.sources.key_index import filtered, write_index
from inkmark.sources.shared import materialised, shared_dir, tidied
from inkmark.sources.versioned import RECORD, VersionedTable, current, store_absent
from inkmark.sources.versioned import claim_retry as claims

from .base import ORACLES, query, table

CONTRACT = "0x" + "ab" * 20
NOW = "2002-01-01 00:00:00"
TX = "'0x' || sha256('tx' || {0})"
# orders as records, in SQL
RECS = f"""r as (select o_orderkey as record_id, o_custkey as issuer, sha256(o_orderkey::varchar) as sha256, case when o_orderkey % 11 <> 0 then sha256('c' || o_orderkey) end as content_hash, '0x' || sha256('tx' || o_orderkey) as tx,
  case when o_orderstatus = 'P' then 'PENDING' when o_orderstatus = 'O' then case o_orderkey % 3 when 0 then 'STORED' when 1 then 'BLOCKCHAIN_PENDING' else 'ISSUED' end else case o_orderkey % 3 when 0 then 'FAILED' when 1 then 'REVOKED' else 'ISSUED' end end as status, o_orderdate as updated_at from orders)"""
WITH = f"with {RECS} "


def records(spark, d):
    k = F.col("o_orderkey")
    s = lambda p: F.sha2(F.concat(F.lit(p), k.cast("string")), 256)
    pick = lambda a, b, c: F.element_at(F.array(F.lit(a), F.lit(b), F.lit(c)), (k % 3 + 1).cast("int"))
    status = F.when(F.col("o_orderstatus") == "P", "PENDING").when(F.col("o_orderstatus") == "O", pick("STORED", "BLOCKCHAIN_PENDING", "ISSUED")).otherwise(pick("FAILED", "REVOKED", "ISSUED"))
    return table(spark, d, "orders").select(
        k.alias("record_id"), F.col("o_custkey").alias("issuer"), s("").alias("sha256"), F.when(k % 11 != 0, s("c")).alias("content_hash"),
        F.concat(F.lit("0x"), s("tx")).alias("tx"), status.alias("status"), F.col("o_orderdate").cast("timestamp_ntz").alias("updated_at"),
    )


ODD = {
    "sha256": (7, "XYZ"), "status": (13, "LOST"), "block_number": (5, "-1"), "lookup_key": (17, "abc"), "contract_address": (19, "0x12"), "chain_id": (23, "0"), "mime_type": (29, "text/html"), "failure_reason": (31, "because"),
    "revocation_tx": (37, "0xzz"), "ocr_check": (41, "MAYBE"), "byte_hash": (43, "00"), "revocation_reason": (47, "r" * 501),
}
RULES = ("record_id", "sha256", "status", "byte_hash", "content_hash", "lookup_key", "ocr_check", "mime_type", "size", "chain_id", "contract_address", "transaction_hash", "block_number", "failure_reason", "revocation_reason", "revocation_tx")
BROKEN = ", ".join(f"case when record_id % {ODD[n][0]} = 0 then '{n}' end" if n in ODD else "case when record_id < 5 then 'size' end" if n == "size" else "null" for n in RULES)


def odd_records(spark, d):
    k = F.col("record_id")
    fit = {"sha256": F.col("sha256"), "status": F.col("status"), "lookup_key": F.col("sha256"), "contract_address": F.lit("0x" + "aB" * 20), "chain_id": F.lit("7"), "mime_type": F.lit("image/png"), "failure_reason": F.lit("WRONG_DATA"), "revocation_tx": F.col("tx")}
    r = records(spark, d).withColumns({n: F.when(k % m == 0, bad).otherwise(fit.get(n, F.lit(None))) for n, (m, bad) in ODD.items()})
    return r.withColumns({"transaction_hash": F.col("tx"), "size": k - 5})


@query(WITH + f"select record_id, concat_ws(',', {BROKEN}) as violations from r")
def validate_records(spark, d):
    return L.validate_records(odd_records(spark, d)).select("record_id", "violations")


@query(WITH + f", v as (select record_id, concat_ws(',', {BROKEN}) as violations from r) select violations <> '' as quarantined, count(*) as n, min(record_id) as first from v group by 1")
def quarantine(spark, d):
    """Records that keep the contract, and those that are set apart."""
    good, bad = L.quarantined(odd_records(spark, d))
    both = good.select("record_id", F.lit(False).alias("quarantined")).unionByName(bad.select("record_id", F.lit(True).alias("quarantined")))
    return both.groupBy("quarantined").agg(F.count(F.lit(1)).alias("n"), F.min("record_id").alias("first"))


# The columns of a record that any reader may see.
SAFE = ("record_id", "sha256", "content_hash", "ocr_check", "mime_type", "size", "status", "failure_reason", "chain_id", "contract_address", "transaction_hash", "block_number", "revocation_reason", "revocation_tx")


def safe_view(rows):
    """The safe columns that rows have; others (lookup keys, owners, stored fields) don't come out."""
    return rows.select(*[c for c in SAFE if c in rows.columns])


@query(WITH + "select record_id, sha256, content_hash, status from r")
def record_view(spark, d):
    return safe_view(records(spark, d))


@query("""with b as (select l_orderkey, l_linenumber, l_partkey, sha256(l_partkey::varchar) as h, row_number() over (partition by l_partkey order by l_orderkey * 100 + l_linenumber, l_suppkey) as n, l_suppkey from lineitem),
 t as (select distinct sha256(p_partkey::varchar) as h from part where p_size % 2 = 0) select h, count(*) as rows, count(*) filter (t.h is null and n = 1) as stored from b left join t using (h) group by h""")
def append_if_absent(spark, d):
    b = table(spark, d, "lineitem").select(F.sha2(F.col("l_partkey").cast("string"), 256).alias("h"), F.struct(F.col("l_orderkey") * 100 + F.col("l_linenumber"), F.col("l_suppkey")).alias("at"))
    t = table(spark, d, "part").filter("p_size % 2 = 0").select(F.sha2(F.col("p_partkey").cast("string"), 256).alias("h"))
    return L.append_if_absent(b, t, "h", "at").groupBy("h").agg(F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("already_stored")).alias("stored"))


@query("""with seed as (select distinct sha256(p_partkey::varchar) as h, -p_partkey as ref from part where p_size % 2 = 0), b as (select sha256(l_partkey::varchar) as h, l_linenumber % 2 as odd, min(l_orderkey * 100 + l_linenumber) as ref from lineitem group by 1, 2)
 select h, coalesce(s.ref, x.ref, y.ref) as ref from seed s full join (select h, ref from b where odd = 1) x using (h) full join (select h, ref from b where odd = 0) y using (h)""")
def append_sink(spark, d):
    """Files as a sink has them after three batches, of which the second came twice: of each key the row that came first."""
    key = lambda c: F.sha2(F.col(c).cast("string"), 256).alias("h")
    ref = (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("ref")
    seed = table(spark, d, "part").filter("p_size % 2 = 0").select(key("p_partkey"), (-F.col("p_partkey")).cast("long").alias("ref"))
    odd, even = (table(spark, d, "lineitem").filter(f"l_linenumber % 2 = {n}").select(key("l_partkey"), ref.cast("long").alias("ref")) for n in (1, 0))
    t = VersionedTable(spark, shared_dir(spark, "files"), "h string, ref long")
    for name, rows in (("seed", seed), ("odd", odd), ("even", even), ("odd", odd)):
        store_absent(t, rows, "h", ["ref"], name)
    return t.read()


@query(WITH + """, free as (select record_id, status from r where status in ('FAILED', 'PENDING')), c as (select record_id, record_id % 3 <> 0 as a, record_id % 3 = 0 and record_id % 2 = 0 as b from free)
 select record_id, case when b then 'B' else 'C' end as claimant, case when a then 2 else 1 end::bigint as revision, 'PENDING' as status,
   timestamp '2002-01-01' + case when b then interval 30 second else interval 75 second end as updated_at from c""")
def claim_retry(spark, d):
    """Stuck and failed records that three workers claim: A at midnight all but every third, B 30 s later the even ones, C 75 s after midnight all.

    What A has is fresh for B and stale for C; what B got is fresh for C.
    """
    t = VersionedTable(spark, shared_dir(spark, "records"), RECORD)
    k = F.col("record_id")
    first = records(spark, d).select("record_id", "status", F.when(F.col("status") == "FAILED", "CHAIN_REVERTED").alias("failure_reason"), F.col("updated_at").cast("timestamp").alias("updated_at"), F.lit(None).cast("string").alias("claimant"), F.lit(0).cast("long").alias("revision"))
    t.commit(first, "load", t.snapshot())
    for name, seconds, which in (("A", 0, k % 3 != 0), ("B", 30, k % 2 == 0), ("C", 75, F.lit(True))):
        at = F.lit(NOW).cast("timestamp") + F.make_dt_interval(secs=F.lit(seconds))
        claims(t, records(spark, d).filter(which).select("record_id", at.alias("at"), F.lit(name).alias("claimant")), f"claims-{name}")
    return current(t.read()).filter("claimant is not null").select("record_id", "claimant", "revision", "status", F.col("updated_at").cast("timestamp_ntz").alias("updated_at"))


LOG = """lg as (select user_id as record_id, event_id as seq, case event_type when 'error' then 'FAILED' when 'purchase' then 'STORED' when 'view' then 'PENDING' when 'click' then 'BLOCKCHAIN_PENDING' else 'ISSUED' end as status from events)"""
EDGES = ", ".join(f"('{a}', '{b}')" for a, b in L.MOVES)


def status_log(spark, d, rows=None, *more):
    e = F.col("event_type")
    s = F.when(e == "error", "FAILED").when(e == "purchase", "STORED").when(e == "view", "PENDING").when(e == "click", "BLOCKCHAIN_PENDING").otherwise("ISSUED")
    rows = table(spark, d, "events") if rows is None else rows
    return rows.select(F.col("user_id").alias("record_id"), F.col("event_id").alias("seq"), s.alias("status"), *more)


@query(f"""with {LOG}, p as (select *, lag(status) over (partition by record_id order by seq) as previous from lg), ed(a, b) as (values {EDGES})
 select record_id, seq, status, previous, case when previous is null then status = 'PENDING' else ed.a is not null end as legal from p left join ed on ed.a = p.previous and ed.b = p.status""")
def transition_audit(spark, d):
    return L.transition_audit(status_log(spark, d))


@query(f"""with recursive {LOG}, m as (select record_id, seq, status as t, row_number() over (partition by record_id order by seq) as n from lg), ed(a, b) as (values {EDGES}),
 s(record_id, n, status, reason, applied) as (select distinct record_id, 0::bigint, 'PENDING', null::varchar, 0 from m union all
   select s.record_id, m.n, case when ed.a is not null then m.t else s.status end, case when ed.a is not null then case when m.t = 'FAILED' then 'E' || m.seq end else s.reason end, s.applied + case when ed.a is not null then 1 else 0 end
   from s join m on m.record_id = s.record_id and m.n = s.n + 1 left join ed on ed.a = s.status and ed.b = m.t)
 select record_id, arg_max(status, n) as status, (max({{'n': n, 'r': reason}})).r as failure_reason, arg_max(applied, n) as applied from s group by record_id""")
def replay_lifecycle(spark, d):
    edges = F.broadcast(spark.createDataFrame(list(L.MOVES), "f string, t string").groupBy("t").agg(F.collect_list("f").alias("from_states")))
    m = status_log(spark, d).join(edges, F.col("status") == F.col("t"), "left")
    m = m.select("record_id", F.col("seq").alias("ts"), "seq", F.coalesce("from_states", F.array().cast("array<string>")).alias("from_states"), F.col("status").alias("to_state"), F.concat(F.lit("E"), F.col("seq").cast("string")).alias("failure_reason"))
    return L.replay_lifecycle(m)


@query(WITH + """, b as (select l_orderkey * 10 + l_linenumber as submission_id, l_suppkey, sha256((case when l_linenumber % 2 = 0 then l_orderkey else l_orderkey + 1000000 end)::varchar) as sha256, case when l_linenumber % 3 = 0 then sha256('c' || l_orderkey) else sha256('n' || l_orderkey || l_linenumber) end as content_hash,
   o_orderdate + interval 30 second * (l_linenumber - 1) as ts from lineitem join orders on o_orderkey = l_orderkey),
 bb as (select submission_id, min(sha256) as sha256, min(content_hash) as content_hash, min(ts) as ts from b group by 1),
 f as (select bb.*, x.status as fs, x.updated_at as fu, y.status as cs, y.updated_at as cu from bb left join r x on x.sha256 = bb.sha256 left join r y on y.content_hash = bb.content_hash),
 k as (select *, case when fs in ('STORED', 'BLOCKCHAIN_PENDING', 'ISSUED', 'REVOKED') then 'duplicate_file' when fs = 'FAILED' or (fs = 'PENDING' and epoch(ts) - epoch(fu) >= 60) then 'retry' when fs is not null then 'in_progress'
   when cs in ('STORED', 'BLOCKCHAIN_PENDING', 'ISSUED', 'REVOKED') then 'duplicate_content' when cs = 'PENDING' and epoch(ts) - epoch(cu) < 60 then 'in_progress' when cs is not null then 'conflict' end as known,
   row_number() over (partition by sha256 order by ts, submission_id) as n1, row_number() over (partition by coalesce(content_hash, sha256) order by ts, submission_id) as n2 from f)
 select submission_id, case when known in ('duplicate_file', 'duplicate_content', 'conflict') then known when n1 > 1 or n2 > 1 then 'in_progress' else coalesce(known, 'new') end as outcome from k""")
def resolve_submissions(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp_ntz").alias("day"))
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    l = table(spark, d, "lineitem").select(k, n).join(o, k == F.col("o_orderkey")).groupBy(k, n).agg(F.min("day").alias("day"))
    with tidied(spark):
        l = materialised(l, "lines")
    s = lambda *c: F.sha2(F.concat(*[x.cast("string") for x in c]), 256)
    b = l.select((k * 10 + n).alias("submission_id"), F.when(n % 2 == 0, s(k)).otherwise(s(k + 1000000)).alias("sha256"), F.when(n % 3 == 0, s(F.lit("c"), k)).otherwise(s(F.lit("n"), k, n)).alias("content_hash"), (F.col("day") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (n - 1) * 30)).alias("ts"))
    # Numbers of one digit tell the lines of an order apart; with others, lines of different orders may make one submission.
    if not l.filter(n.isNull() | ~n.between(0, 9)).isEmpty():
        b = b.groupBy("submission_id").agg(F.min("sha256").alias("sha256"), F.min("content_hash").alias("content_hash"), F.min("ts").alias("ts"))
    return L.resolve_submissions(b, records(spark, d).select("sha256", "content_hash", "status", "updated_at"))


CHAIN = """rc as (select tx, case record_id % 10 when 0 then 'not_found' when 1 then 'reverted' else 'success' end as state, case when record_id % 10 = 2 then '0xother' else '0x' || repeat('AB', 20) end as to_addr from r where record_id % 20 <> 19),
 ca as (select tx, content_hash, case when record_id % 10 = 3 then 'x' else sha256 end as byte_hash, '0xW' || issuer as from_addr from r),
 rg as (select content_hash, sha256 as byte_hash, case when record_id % 10 = 4 then '0xz' else '0xw' || issuer end as issuer, record_id % 10 = 5 as revoked from r where content_hash is not null and record_id % 10 <> 6)"""
CONFIRM = WITH + f", {CHAIN}, " + """cf as (select r.record_id, rc.state is null or rc.state = 'not_found' as nothing, case when rc.state = 'reverted' then 'CHAIN_REVERTED' when lower(rc.to_addr) <> '0x' || repeat('ab', 20) then 'WRONG_CONTRACT'
  when not coalesce(ca.content_hash = r.content_hash and ca.byte_hash = r.sha256 and rg.byte_hash = r.sha256 and not rg.revoked and lower(rg.issuer) = lower(ca.from_addr), false) then 'WRONG_DATA' end as why
  from r left join rc using (tx) left join ca using (tx) left join rg on rg.content_hash = r.content_hash where r.status = 'BLOCKCHAIN_PENDING') """


def chain(spark, d):
    r, k = records(spark, d), F.col("record_id") % 10
    rc = r.filter("record_id % 20 <> 19").select("tx", F.when(k == 0, "not_found").when(k == 1, "reverted").otherwise("success").alias("state"), F.when(k == 2, "0xother").otherwise("0x" + "AB" * 20).alias("to_addr"))
    ca = r.select("tx", "content_hash", F.when(k == 3, "x").otherwise(F.col("sha256")).alias("byte_hash"), F.concat(F.lit("0xW"), F.col("issuer").cast("string")).alias("from_addr"))
    rg = r.filter("content_hash is not null and record_id % 10 <> 6").select("content_hash", F.col("sha256").alias("byte_hash"), F.when(k == 4, "0xz").otherwise(F.concat(F.lit("0xw"), F.col("issuer").cast("string"))).alias("issuer"), (k == 5).alias("revoked"))
    return r, rc, ca, rg


def confirmed(spark, d):
    r, rc, ca, rg = chain(spark, d)
    return L.confirm_issuance(r.filter("status = 'BLOCKCHAIN_PENDING'"), rc, ca, rg, CONTRACT)


@query(CONFIRM + "select record_id, case when nothing then 'pending' when why is not null then 'failed' else 'issued' end as state, case when not nothing then why end as failure_reason from cf")
def confirm_issuance(spark, d):
    return confirmed(spark, d)


@query(WITH + f", {CHAIN}, " + """j as (select r.*, case when record_id % 2 = 0 then r.tx end as done_tx, rc.state as s, rc.to_addr, case when record_id % 9 = 7 then 'q' else r.content_hash end as cc, rg.revoked as rv from r left join rc using (tx) left join (select content_hash, not revoked as revoked from rg) rg on rg.content_hash = r.content_hash where r.status in ('ISSUED', 'REVOKED')),
 st as (select *, case when status = 'REVOKED' and done_tx = tx then 'revoked' when status <> 'ISSUED' or content_hash is null then 'refused' when s is null or s = 'not_found' then 'pending' when s = 'reverted' or lower(to_addr) <> '0x' || repeat('ab', 20) then 'failed' when cc <> content_hash then 'refused' when not coalesce(rv, false) then 'failed' else 'revoked' end as state from j)
 select record_id, state, case when state = 'revoked' and status = 'ISSUED' then substr(repeat('why ', 150), 1, 500) end as reason, case when state = 'revoked' and status = 'ISSUED' then case when record_id % 3 = 0 then updated_at else timestamp '2002-01-01' end end as revoked_at from st""")
def confirm_revocation(spark, d):
    r, rc, _, rg = chain(spark, d)
    r = r.filter(F.col("status").isin("ISSUED", "REVOKED"))
    k = F.col("record_id")
    req = r.select("record_id", "tx", F.lit(NOW).cast("timestamp_ntz").alias("now"))
    rec = r.select("record_id", "content_hash", "status", F.when(k % 2 == 0, F.col("tx")).alias("revocation_tx"))
    calls = r.select("tx", F.when(k % 9 == 7, "q").otherwise(F.col("content_hash")).alias("content_hash"), F.repeat(F.lit("why "), 150).alias("reason"))
    ev = r.filter("record_id % 3 = 0").select("content_hash", "tx", F.col("updated_at").alias("at"))
    return L.confirm_revocation(req, rec, rc, calls, rg.select("content_hash", (~F.col("revoked")).alias("revoked")), ev, CONTRACT)


DRIFT = WITH + f", {CHAIN}, " + """g as (select content_hash, revoked from rg union all select sha256('only' || c_custkey), false from customer), j as (select r.record_id, coalesce(r.content_hash, g.content_hash) as content_hash, r.status, g.content_hash is not null as there, coalesce(g.revoked, false) as revoked from r full join g on g.content_hash = r.content_hash),
 w as (select record_id, content_hash, case when status is null then 'ledger_only' when status in ('ISSUED', 'REVOKED') and not there then 'missing_on_ledger' when status = 'ISSUED' and revoked then 'revoked_on_ledger_only' when status = 'REVOKED' and not revoked then 'revoked_in_record_only'
   when status not in ('ISSUED', 'REVOKED') and there then 'ahead_on_ledger' else 'in_step' end as drift from j) """


def drift_sides(spark, d):
    r, _, _, rg = chain(spark, d)
    only = table(spark, d, "customer").select(F.sha2(F.concat(F.lit("only"), F.col("c_custkey").cast("string")), 256).alias("content_hash"), F.lit(False).alias("revoked"))
    return r, rg.select("content_hash", "revoked").unionByName(only)


@query(DRIFT + "select drift, count(*) as n from w group by 1")
def ledger_drift(spark, d):
    return L.ledger_drift(*drift_sides(spark, d))


@query(DRIFT + "select * from w where drift <> 'in_step'")
def ledger_drift_records(spark, d):
    """The records and ledger rows that are not in step."""
    return L.drifted(*drift_sides(spark, d)).filter("drift <> 'in_step'")


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when l_suppkey in (select s_suppkey from supplier where s_suppkey % 3 <> 0) then 'accepted' else 'rejected' end as outcome from lineitem")
def issuer_gate(spark, d):
    """Anchors by whether their sender is on the allow list."""
    allowed = table(spark, d, "supplier").filter("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return L.issuer_gate(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), allowed, "l_suppkey")


@query("""with q as (select event_id, user_id as wallet, row_number() over (partition by user_id order by event_id) as n from events)
 select event_id, wallet, case when n = 1 and wallet not in (select s_suppkey from supplier where s_suppkey % 3 <> 0) then 'registered' else 'already_registered' end as outcome from q""")
def register_issuers(spark, d):
    """Requests to become an issuer; one that is an issuer, or has asked before, is passed over."""
    there = table(spark, d, "supplier").filter("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("wallet"))
    return L.register_issuers(table(spark, d, "events").select("event_id", F.col("user_id").alias("wallet")), there, "event_id")


@query(WITH + """, rp as (select l_orderkey * 10 + l_linenumber as report_id, l_orderkey as record_id, case when l_linenumber % 4 = 3 then 'failed' else 'pending' end as kind, case when l_linenumber % 5 = 4 then 'bad' else '0x' || sha256('tx' || (case when l_linenumber % 2 = 0 then l_orderkey + 1 else l_orderkey end)) end as tx, case when l_suppkey % 2 = 0 then 'USER_REJECTED' else 'other' end as reason, l_linenumber as ts, l_suppkey, l_partkey from lineitem),
 o as (select * from (select *, row_number() over (partition by report_id order by l_suppkey, l_partkey) as q from rp) where q = 1),
 rr as (select record_id, status, content_hash, case when status in ('BLOCKCHAIN_PENDING', 'ISSUED', 'REVOKED') then tx end as tx from r),
 j as (select o.report_id, o.record_id, o.kind, o.tx, o.reason, x.status, x.content_hash, x.tx as own, w.record_id as owner, row_number() over (partition by o.record_id order by ts, report_id) as n, row_number() over (partition by kind, o.tx order by ts, report_id) as m from o left join rr x on x.record_id = o.record_id left join rr w on w.tx = o.tx),
 k as (select *, case when status is null then 'not_found' when kind = 'pending' and tx = 'bad' then 'bad_parameter' when kind = 'pending' and status in ('BLOCKCHAIN_PENDING', 'ISSUED') and own = tx then 'unchanged' when kind = 'pending' and content_hash is null then 'refused'
   when kind = 'pending' and (owner <> record_id or m > 1) then 'conflict' when n > 1 then 'superseded' when kind = 'pending' and status <> 'STORED' then 'refused' when kind = 'failed' and status not in ('STORED', 'BLOCKCHAIN_PENDING') then 'refused' else 'moved' end as outcome from j)
 select report_id, record_id, outcome, case when outcome = 'moved' then case kind when 'pending' then 'BLOCKCHAIN_PENDING' else 'FAILED' end else status end as status, case when outcome = 'moved' and kind = 'failed' then case reason when 'USER_REJECTED' then 'USER_REJECTED' else 'CLIENT_ERROR' end end as failure_reason from k""")
def apply_chain_reports(spark, d):
    k, n, last = F.col("l_orderkey"), F.col("l_linenumber"), F.lit(2**63 - 1)
    # The first line of a report, nulls last; what is said of it is made after it has moved.
    l = table(spark, d, "lineitem").select((k * 10 + n).alias("report_id"), F.struct(F.coalesce("l_suppkey", last).alias("s"), F.coalesce("l_partkey", last), k, n).alias("x"))
    with tidied(spark):
        l = materialised(l.groupBy("report_id").agg(F.min("x").alias("x")).select("report_id", "x.l_orderkey", "x.l_linenumber", (F.col("x.s") % 2 == 0).alias("even")), "lines")
    tx = F.when(n % 5 == 4, "bad").otherwise(F.concat(F.lit("0x"), F.sha2(F.concat(F.lit("tx"), F.when(n % 2 == 0, k + 1).otherwise(k).cast("string")), 256)))
    rp = l.select("report_id", k.alias("record_id"), F.when(n % 4 == 3, "failed").otherwise("pending").alias("kind"), tx.alias("tx"), F.when(F.col("even"), "USER_REJECTED").otherwise("other").alias("reason"), n.alias("ts"))
    sent = F.col("status").isin("BLOCKCHAIN_PENDING", "ISSUED", "REVOKED")
    return L.apply_chain_reports(rp, records(spark, d).withColumn("tx", F.when(sent, F.col("tx"))))


UUID = "regexp_replace({0}, '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}}).*$', '\\1-\\2-\\3-\\4-\\5')"


@query(WITH + f""", k as (select c_custkey as ask_id, case c_custkey % 5 when 0 then sha256(c_custkey::varchar) when 1 then sha256('c' || c_custkey) when 2 then '0x' || sha256('tx' || c_custkey) when 3 then case when c_custkey % 2 = 0 then 'junk' else {UUID.format("sha256('id' || c_custkey)")} end else sha256('none' || c_custkey) end as raw from customer),
 u as (select record_id, {UUID.format("sha256('id' || record_id)")} as uuid from r)
 select ask_id, coalesce(a.record_id, b.record_id, c.record_id, u.record_id) as record_id, case when raw = 'junk' then 'bad_parameter' when coalesce(a.record_id, b.record_id, c.record_id, u.record_id) is null then 'not_found' else 'found' end as outcome from k left join r a on a.sha256 = raw left join r b on b.content_hash = raw left join r c on c.tx = raw left join u on u.uuid = raw""")
def bulk_lookup(spark, d):
    k = F.col("c_custkey")
    return L.bulk_lookup(table(spark, d, "customer").select(k.alias("ask_id"), asked_key(k).alias("raw")), records(spark, d).withColumn("uuid", uuid_of(F.col("record_id"))))


def uuid_of(c):
    return F.regexp_replace(F.sha2(F.concat(F.lit("id"), c.cast("string")), 256), "^(.{8})(.{4})(.{4})(.{4})(.{12}).*$", "$1-$2-$3-$4-$5")


def asked_key(k):
    s = lambda p: F.sha2(F.concat(F.lit(p), k.cast("string")), 256)
    return F.when(k % 5 == 0, s("")).when(k % 5 == 1, s("c")).when(k % 5 == 2, F.concat(F.lit("0x"), s("tx"))).when(k % 5 == 3, F.when(k % 2 == 0, "junk").otherwise(uuid_of(k))).otherwise(s("none"))


@query(ORACLES["bulk_lookup"])
def bulk_lookup_indexed(spark, d):
    """``bulk_lookup`` against the records laid out by their keys."""
    k = F.col("c_custkey")
    r = records(spark, d).withColumn("uuid", uuid_of(F.col("record_id")))
    name = f"records_{uuid.uuid4().hex[:12]}"
    write_index(r, [("uuid", "uuid"), ("hash", "sha256"), ("hash", "content_hash"), ("tx", "tx")], name, ["status"], ["updated_at"])
    keys = table(spark, d, "customer").select(k.alias("ask_id"), asked_key(k).alias("raw"))
    with filtered(spark):
        out = materialised(key_lookup(keys, name), "found")
    spark.sql(f"drop table {name}")
    return out


@query("""with i as (select s_suppkey as wallet, timestamp '1992-01-01' as block, 0 as idx, true as listed from supplier where s_suppkey % 3 <> 0 union all select s_suppkey, timestamp '1999-01-01', 1, false from supplier where s_suppkey % 5 = 0),
 a as (select l_orderkey, l_suppkey as wallet, l_shipdate as block, l_linenumber + 10 as idx, l_returnflag, row_number() over (partition by l_orderkey, l_suppkey, l_shipdate, l_linenumber order by l_partkey) as q from lineitem),
 a1 as (select l_orderkey, wallet, block, idx from a where q = 1),
 ok as (select a1.*, coalesce((select arg_max(listed, {'b': i.block, 'i': i.idx}) from i where i.wallet = a1.wallet and (i.block < a1.block or (i.block = a1.block and i.idx <= a1.idx))), false) as ok from a1),
 n as (select *, row_number() over (partition by l_orderkey, ok order by block, idx, wallet) as n from ok),
 rv as (select distinct l_orderkey, wallet, block, idx from a where l_returnflag = 'R')
 select l_orderkey, wallet, block, idx, case when not ok then 'NOT_AUTHORISED_ISSUER' when n > 1 then 'ALREADY_ANCHORED' else 'ANCHORED' end as code,
   ok and n = 1 and exists (select 1 from rv where rv.l_orderkey = n.l_orderkey and rv.wallet = n.wallet and (rv.block > n.block or (rv.block = n.block and rv.idx > n.idx))) as revoked from n""")
def replay_registry(spark, d):
    s = table(spark, d, "supplier")
    at = lambda x: F.lit(x).cast("timestamp_ntz").alias("block")
    i = s.filter("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("wallet"), at("1992-01-01"), F.lit(0).alias("idx"), F.lit(True).alias("listed"))
    i = i.unionByName(s.filter("s_suppkey % 5 = 0").select(F.col("s_suppkey").alias("wallet"), at("1999-01-01"), F.lit(1).alias("idx"), F.lit(False).alias("listed")))
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("content_hash"), F.col("l_suppkey").alias("wallet"), F.col("l_shipdate").cast("timestamp_ntz").alias("block"), (F.col("l_linenumber") + 10).alias("idx"), "l_returnflag")
    out = L.replay_registry(i, l.drop("l_returnflag").distinct(), l.filter("l_returnflag = 'R'").drop("l_returnflag"))
    return out.select(F.col("content_hash").cast("long").alias("l_orderkey"), "wallet", "block", "idx", "code", "revoked")


@query(WITH + "select issuer, status, count(*) as n from r group by 1, 2")
def count_by_status(spark, d):
    return records(spark, d).groupBy("issuer", "status").agg(F.count(F.lit(1)).alias("n"))


STUCK = "status in ('PENDING', 'BLOCKCHAIN_PENDING') and updated_at < timestamp '2000-06-01' - interval 600 second"


def stuck(spark, d, seconds: int = L.STUCK_SECONDS):
    limit = F.lit("2000-06-01").cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds))
    return records(spark, d).filter(F.col("status").isin("PENDING", "BLOCKCHAIN_PENDING") & (F.col("updated_at") < limit))


@query(WITH + f"select record_id, status, updated_at from r where {STUCK}")
def find_stuck(spark, d):
    """Records waiting for too long, oldest first."""
    return stuck(spark, d).select("record_id", "status", "updated_at").orderBy("updated_at", "record_id")


RECONCILED = f"w as (select r.record_id, case when r.status = 'PENDING' then 'failed_pending' when r.record_id % 13 = 0 then 'unverified' when nothing then 'still_pending' when why is not null then 'failed' else 'issued' end as outcome from r left join cf using (record_id) where {STUCK})"


@query(CONFIRM + f", {RECONCILED} select outcome, sum(count(*)) over ()::bigint as checked, count(*) as n, bit_xor(('0x' || substr(sha256(record_id::varchar), 1, 15))::bigint) as ids_digest from w group by 1")
def reconcile_report(spark, d):
    """How many stuck records were checked, how many have which outcome, and a digest of their ids that doesn't depend on their order."""
    w = reconciled(spark, d)
    out = w.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.conv(F.substring(F.sha2(F.col("record_id").cast("string"), 256), 1, 15), 16, 10).cast("long")).alias("ids_digest"))
    return out.withColumn("checked", F.sum("n").over(Window.partitionBy(F.lit(1))))  # a row an outcome


@query(CONFIRM + f", {RECONCILED} select record_id, outcome from w")
def reconcile_outcomes(spark, d):
    """Each stuck record and what became of it."""
    return reconciled(spark, d)


def reconciled(spark, d):
    # Every thirteenth has no transaction to ask the ledger for.
    s = stuck(spark, d).select("record_id", "status", F.when(F.col("record_id") % 13 != 0, F.col("tx")).alias("tx")).join(confirmed(spark, d), "record_id", "left")
    o = F.when(F.col("status") == "PENDING", "failed_pending").when(F.col("tx").isNull(), "unverified").when(F.col("state") == "pending", "still_pending").otherwise(F.col("state"))
    return s.select("record_id", o.alias("outcome"))


@query(WITH + "select issuer, arg_max(record_id, {'u': updated_at, 'i': record_id}) as record_id from r group by 1")
def newest_per_key(spark, d):
    return M.newest_per_key(records(spark, d), "issuer", "updated_at", "record_id").select("issuer", "record_id")


@query(WITH + "select record_id, issuer, status from r where issuer in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def owned_rows(spark, d):
    """Rows of the callers in a caller table; those of others look absent."""
    callers = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("issuer"))
    return records(spark, d).join(callers, "issuer", "left_semi").select("record_id", "issuer", "status")


@query(WITH + ", p as (select record_id, status, row_number() over (order by record_id desc) as n from r where record_id < 9000) select record_id, status, case when n = 50 then record_id end as next_cursor from p where n <= 50")
def keyset_page(spark, d):
    """A page of 50 after a cursor, newest first; the last row has the next cursor if there are more."""
    page = records(spark, d).filter("record_id < 9000").select("record_id", "status").orderBy(F.desc("record_id")).limit(51)
    cut = page.agg(F.sort_array(F.collect_list("record_id"), asc=False).alias("ids")).select(F.get("ids", F.lit(49)).alias("last"), (F.size("ids") > 50).alias("more"))
    return page.crossJoin(F.broadcast(cut)).filter(F.col("last").isNull() | (F.col("record_id") >= F.col("last"))).select("record_id", "status", F.when(F.col("more") & (F.col("record_id") == F.col("last")), F.col("last")).alias("next_cursor"))
