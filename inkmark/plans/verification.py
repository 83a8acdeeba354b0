"""Batch verification: customers' records as anchored documents, edited copies of them as presented ones."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from inkmark.operators import matching as M
from inkmark.operators import records as R
from inkmark.operators import verdict as V
from inkmark.sources.key_index import cascade_lookup as key_cascade
from inkmark.sources.key_index import filtered, write_index
from inkmark.sources.shared import materialised

from .base import query, table
from .cleaning import FIELDS, HASH, LOOKUP, REC, canon, field_records
from .visual import ADVICE, cells_and_regions

ADVICE_CTES = ADVICE.removeprefix("with ").rstrip()

K = "doc_id % 10"
SEEN = f"""pre as (select doc_id, "docType", issuer, case when {K} = 4 then 'X' || holder when {K} in (2, 3) then '  ' || lower(holder) else holder end as holder,
  case when {K} in (2, 3) then '-' || "idNumber" when {K} = 6 then "idNumber" || '9' else "idNumber" end as "idNumber", "issuedOn", case when {K} in (5, 7) then '1' || acctbal else acctbal end as acctbal from rec)"""
HEAD = f"""with {REC}, {canon('rec', 'a0')}, {SEEN}, {canon('pre', 'p0')},
 a as (select *, {HASH} as h, {LOOKUP} as lk, sha256('file:' || doc_id) as fh, case when {K} = 8 then 'REVOKED' else 'ISSUED' end as status from a0 where {K} <> 9),
 p as (select *, {HASH} as h, {LOOKUP} as lk, sha256(case when {K} in (0, 1, 8) then 'file:' else 'copy:' end || doc_id) as fh, case when {K} = 1 and doc_id % 3 = 0 then 'UNREADABLE' else 'READ' end as rs from p0),
 nk as (select lk, max(doc_id) as rid from a group by lk),
 hit as (select p.doc_id as capture_id, coalesce(f.doc_id, c.doc_id, n.rid) as record_id, case when f.doc_id is not null then 'file' when c.doc_id is not null then 'content' when n.rid is not null then 'identity' end as how
   from p left join a f on f.fh = p.fh left join a c on c.h = p.h and p.rs = 'READ' left join nk n on n.lk = p.lk and p.rs = 'READ') """
FLAT = f", pf as ({FIELDS.format('p')}), af as ({FIELDS.format('a')}), pp as (select h.capture_id, pf.field, pf.value from hit h join pf on pf.doc_id = h.capture_id where h.record_id is not null), aa as (select h.capture_id, af.field, af.value from hit h join af on af.doc_id = h.record_id), dif as (select coalesce(aa.capture_id, pp.capture_id) as capture_id, coalesce(aa.field, pp.field) as field, aa.value as anchored, pp.value as presented from aa full join pp on aa.capture_id = pp.capture_id and aa.field = pp.field where aa.value is distinct from pp.value) "
COMPARED = FLAT + f""", g as (select capture_id, string_agg(field, ',' order by field) as changed, string_agg(case when presented is not null and (capture_id % 10 = 7) then field end, ',' order by field) as uncertain,
   min(case when capture_id % 10 = 7 then 70.0 else 95.0 end) as worth from dif group by 1),
 st as (select h.capture_id, h.record_id, h.how, p.rs, case when p.rs <> 'READ' then 'INCONCLUSIVE' when p.h = a.h then 'MATCH' when coalesce(g.uncertain, '') <> '' then 'INCONCLUSIVE' else 'MISMATCH' end as status, g.changed, g.uncertain, g.worth, a.fh = p.fh as same_file, a.status as rec_status
   from hit h join p on p.doc_id = h.capture_id left join a on a.doc_id = h.record_id left join g using (capture_id)) """


def edited(records, when):
    """Records with the edits of their presented copies, where ``when`` holds."""
    k = F.when(when, F.col("doc_id") % 10)
    holder = F.when(k == 4, F.concat(F.lit("X"), "holder")).when(k.isin(2, 3), F.concat(F.lit("  "), F.lower("holder"))).otherwise(F.col("holder"))
    number = F.when(k.isin(2, 3), F.concat(F.lit("-"), "idNumber")).when(k == 6, F.concat("idNumber", F.lit("9"))).otherwise(F.col("idNumber"))
    payload = F.when(k.isin(5, 7), F.transform_values("payload", lambda _, v: F.concat(F.lit("1"), v))).otherwise(F.col("payload"))
    return records.withColumns({"holder": holder, "idNumber": number, "payload": payload})


def as_anchored(c):
    return c.select("*", F.col("doc_id").alias("record_id"), F.sha2(F.concat(F.lit("file:"), F.col("doc_id").cast("string")), 256).alias("file_hash"), F.when(F.col("doc_id") % 10 == 8, "REVOKED").otherwise("ISSUED").alias("status"), F.col("doc_id").alias("created_at"))


def as_presented(c):
    k = F.col("doc_id") % 10
    file = F.concat(F.when(k.isin(0, 1, 8), "file:").otherwise("copy:"), F.col("doc_id").cast("string"))
    return c.select("*", F.col("doc_id").alias("capture_id"), F.sha2(file, 256).alias("file_hash"), F.when((k == 1) & (F.col("doc_id") % 3 == 0), "UNREADABLE").otherwise("READ").alias("read_status"))


def hashed(records):
    return R.lookup_key(R.content_hash(R.canonical_records(records)))


def anchored(spark, d):
    return as_anchored(hashed(field_records(spark, d).filter("doc_id % 10 <> 9")))


def presented(spark, d):
    return as_presented(hashed(edited(field_records(spark, d), F.lit(True))))


def both_sides(spark, d):
    """Presented and anchored documents, canonicalised in one pass and written once."""
    r = field_records(spark, d).withColumn("shown", F.explode(F.array(F.lit(True), F.lit(False)))).filter("shown or doc_id % 10 <> 9")
    c = materialised(hashed(edited(r, F.col("shown"))), "documents")
    return as_presented(c.filter("shown").drop("shown")), as_anchored(c.filter("not shown").drop("shown"))


def looked_up(p, a):
    return M.cascade_lookup(p.select("capture_id", "file_hash", "content_hash", "lookup_key", "read_status"), a.select("record_id", "file_hash", "content_hash", "lookup_key", "status", "created_at"))


def matched(spark, d):
    """Presented, anchored, and what the lookup found; each is read several times, so each is written once."""
    p, a = both_sides(spark, d)
    return p, a, materialised(looked_up(p, a), "hits")


@query(HEAD + "select * from hit")
def cascade_lookup(spark, d):
    return looked_up(*both_sides(spark, d))


@query(HEAD + "select * from hit")
def cascade_lookup_indexed(spark, d):
    """``cascade_lookup`` against the anchored records laid out by their keys."""
    a = anchored(spark, d).filter(F.col("status").isin(*M.ANCHORED))
    name = f"anchored_{uuid.uuid4().hex[:12]}"
    write_index(a, [("file", "file_hash"), ("content", "content_hash"), ("identity", "lookup_key")], name, ["status"], ["created_at"])
    with filtered(spark):
        out = materialised(key_cascade(presented(spark, d), name), "hits")
    spark.sql(f"drop table {name}")
    return out


def differences(p, a, hits):
    hits = hits.filter("how is null or how <> 'content'")  # found by their content hash: nothing differs
    a = R.flatten_record(a, "record_id").join(hits.select("capture_id", "record_id"), "record_id").select("capture_id", "field", "value")
    p = R.flatten_record(p, "capture_id").join(hits.filter("record_id is not null").select("capture_id"), "capture_id", "left_semi")
    return R.diff_records(a, p, "capture_id")


@query(HEAD + FLAT + "select * from dif")
def diff_records(spark, d):
    return differences(*matched(spark, d))


def compared(spark, d):
    p, a, hits = matched(spark, d)
    diffs = materialised(differences(p, a, hits), "diffs")
    conf = diffs.select("capture_id", "field", F.when(F.col("capture_id") % 10 == 7, 70.0).otherwise(95.0).alias("confidence"))
    p = p.select("capture_id", "read_status", F.col("content_hash").alias("p_hash"), F.col("file_hash").alias("p_file"))
    a = a.select("record_id", F.col("content_hash").alias("a_hash"), F.col("file_hash").alias("a_file"), "status")
    pairs = hits.join(p, "capture_id").join(a, "record_id", "left").withColumn("same_hash", F.coalesce(F.col("p_hash") == F.col("a_hash"), F.lit(False)))
    return pairs, M.compare_to_anchor(pairs.select("capture_id", "read_status", "same_hash"), diffs, conf)


@query(HEAD + COMPARED + """select capture_id, status, case when status = 'MATCH' then '' else coalesce(changed, '') end as changed, case when status = 'MATCH' then '' else coalesce(uncertain, '') end as uncertain,
  case status when 'MATCH' then 1.0 when 'MISMATCH' then coalesce(worth / 100, 0.0) else 0.0 end::double as mismatch_confidence from st""")
def compare_to_anchor(spark, d):
    return compared(spark, d)[1]


VERDICT = HEAD.replace("with rec as", "with " + ADVICE_CTES + ", rec as", 1) + COMPARED + """, qr as (select doc_id as capture_id, case doc_id % 28 when 0 then h when 7 then sha256('other' || doc_id) when 14 then h else 'junk' end as code, doc_id % 28 = 14 as elsewhere from p where doc_id % 7 = 0),
 q as (select p.doc_id as capture_id, case when qr.code is null then null when qr.code = 'junk' or (p.rs <> 'READ' and not coalesce(st.same_file, false)) then 'UNREADABLE' when qr.elsewhere then 'ELSEWHERE' when qr.code = p.h then 'SAME' else 'DIFFERENT' end as qs from p left join qr on qr.capture_id = p.doc_id left join st on st.capture_id = p.doc_id),
 v as (select st.capture_id, how, case when status = 'MATCH' then '' else coalesce(changed, '') end as changed, case
   when qs = 'ELSEWHERE' then 'QR_MISMATCH/HIGH/CODE_OF_ANOTHER_REGISTRY' when qs = 'DIFFERENT' then 'QR_MISMATCH/HIGH/CODE_OF_ANOTHER_DOCUMENT' when qs = 'UNREADABLE' then 'INCONCLUSIVE/LOW/CODE_UNREADABLE'
   when rs <> 'READ' and not coalesce(same_file, false) then 'INCONCLUSIVE/LOW/DOCUMENT_UNREADABLE' when record_id is null then 'NOT_REGISTERED/HIGH/NO_ANCHOR' when rec_status = 'REVOKED' then 'REVOKED/HIGH/ANCHOR_REVOKED' when same_file then 'AUTHENTIC_ORIGINAL/HIGH/SAME_BYTES'
   when status = 'INCONCLUSIVE' then 'INCONCLUSIVE/LOW/CONTENT_UNREADABLE' when status = 'MISMATCH' and worth >= 90 then 'TAMPERED_CONTENT/HIGH/FIELDS_DIFFER' when status = 'MISMATCH' and worth >= 80 then 'TAMPERED_CONTENT/MEDIUM/FIELDS_DIFFER' when status = 'MISMATCH' then 'INCONCLUSIVE/LOW/CONTENT_UNREADABLE'
   when ad.kind is null then 'INCONCLUSIVE/LOW/LOOKS_NOT_SEEN' when ad.kind = 'LOCALISED' then 'TAMPERED_VISUAL/MEDIUM/REGION_CHANGED' when ad.kind = 'GLOBAL' then 'INCONCLUSIVE/LOW/LOOKS_TOO_DIFFERENT' else 'AUTHENTIC_COPY/MEDIUM/NOTHING_STANDS_OUT' end as vc, ad.unreliable_regions from st join q on q.capture_id = st.capture_id left join ad on ad.capture_id = st.capture_id),
 x as (select capture_id, how, changed, string_split(vc, '/') as vc, unreliable_regions from v),
 w as (select capture_id, how, changed, vc[1] as verdict, vc[2] as confidence, vc[3] as reason, case vc[3] when 'FIELDS_DIFFER' then changed when 'NOTHING_STANDS_OUT' then unreliable_regions else '' end as reason_fields from x) """


def qr_state(code, content_hash, elsewhere, unread):
    """A scanned code against the document in hand: null without a code, UNREADABLE if either can't be read, ELSEWHERE if it is for another registry."""
    unread = unread | (code == "junk")
    return F.when(code.isNotNull(), F.when(unread, "UNREADABLE").when(elsewhere, "ELSEWHERE").when(code == content_hash, "SAME").otherwise("DIFFERENT"))


def decided(spark, d):
    """Bytes, content, codes and looks of each presented document, and the verdict on them."""
    pairs, status = compared(spark, d)
    e = pairs.join(status.withColumnRenamed("status", "content_status"), "capture_id")
    # Visual evidence: the advice on the pictures that there are (one a vector); codes: on every seventh document.
    e = e.join(V.visual_advice(*cells_and_regions(spark, d)).select("capture_id", "advice", "unreliable_regions"), "capture_id", "left")
    k, n = F.col("capture_id") % 28, F.col("capture_id") % 7
    code = F.when(n == 0, F.when(k.isin(0, 14), F.col("p_hash")).when(k == 7, F.sha2(F.concat(F.lit("other"), F.col("capture_id").cast("string")), 256)).otherwise("junk"))
    unread = (F.col("read_status") != "READ") & ~F.coalesce(F.col("p_file") == F.col("a_file"), F.lit(False))
    e = e.withColumn("qr_state", qr_state(code, F.col("p_hash"), k == 14, unread))
    e = e.select("capture_id", "how", "changed", "qr_state", "advice", "unreliable_regions", (F.col("read_status") == "READ").alias("readable"), F.col("record_id").isNotNull().alias("registered"), (F.col("status") == "REVOKED").alias("revoked"), (F.col("p_file") == F.col("a_file")).alias("byte_match"), "content_status", F.col("mismatch_confidence").alias("content_confidence"))
    return V.verdicts(e)


@query(VERDICT + "select * from w")
def verdicts(spark, d):
    """One verdict per presented document, with what it was matched by, the fields that changed, and the reason."""
    return decided(spark, d).select("capture_id", "how", "changed", "verdict", "confidence", "reason", "reason_fields")


@query(VERDICT + """select capture_id, 'VERIFY' as action, case when verdict in ('AUTHENTIC_ORIGINAL', 'AUTHENTIC_COPY') then 'SUCCESS' else 'FAILED' end as outcome,
  case when verdict in ('AUTHENTIC_ORIGINAL', 'AUTHENTIC_COPY') then 'MATCH' when verdict = 'NOT_REGISTERED' then 'NO_MATCH' else verdict end as reason from w""")
def verdict_audit_events(spark, d):
    return V.audit_events(decided(spark, d)).select("capture_id", "action", "outcome", "reason")


@query(HEAD + FLAT + """select capture_id, field, case when capture_id % 2 = 0 then anchored end as anchored, presented, capture_id % 2 <> 0 as anchored_withheld from dif""")
def public_view(spark, d):
    """Differences as a reader sees them: issuers (even captures) see both sides, others only what they presented."""
    issuer = F.col("capture_id") % 2 == 0
    return differences(*matched(spark, d)).select("capture_id", "field", F.when(issuer, F.col("anchored")).alias("anchored"), "presented", (~issuer).alias("anchored_withheld"))


@query(HEAD + """, s as (select doc_id, case when doc_id % 50 = 0 then sha256('bad' || doc_id) else h end as stored, h from a) select doc_id as record_id, stored = h as trustworthy, case when stored = h then '' else 'withheld' end as record_values from s""")
def audit_stored_records(spark, d):
    """Records whose stored hash is not that of the stored fields."""
    a = anchored(spark, d).withColumn("stored", F.when(F.col("record_id") % 50 == 0, F.sha2(F.concat(F.lit("bad"), F.col("record_id").cast("string")), 256)).otherwise(F.col("content_hash")))
    ok = F.col("stored") == F.col("content_hash")
    return a.select("record_id", ok.alias("trustworthy"), F.when(ok, "").otherwise("withheld").alias("record_values"))


LEDGER = "led as (select h as content_hash, status = 'REVOKED' or doc_id % 40 = 4 as revoked from a where doc_id % 20 <> 5)"


def registry(spark, d):
    return anchored(spark, d).filter("doc_id % 20 <> 5").select("content_hash", ((F.col("status") == "REVOKED") | (F.col("doc_id") % 40 == 4)).alias("revoked"))


@query(HEAD + f", {LEDGER} select a.doc_id as record_id, true as chain_checked, led.content_hash is not null as registered, coalesce(led.revoked, false) as revoked from a left join led on led.content_hash = a.h")
def registry_state(spark, d):
    return M.registry_state(anchored(spark, d).select("record_id", "content_hash", "status"), registry(spark, d))


@query(HEAD + """, ev as (select o_custkey as doc_id, o_orderkey, o_orderpriority as reason, o_orderdate as at, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as n from orders where o_orderstatus = 'F')
 select a.doc_id as record_id, coalesce(ev.reason, case when a.status = 'REVOKED' then 'mirror' end) as reason, coalesce(ev.at, case when a.status = 'REVOKED' then timestamp '2000-01-01' end) as at from a left join ev on ev.doc_id = a.doc_id and ev.n = 1""")
def latest_revocation(spark, d):
    a = anchored(spark, d)
    gone = F.col("status") == "REVOKED"
    r = a.select("record_id", "content_hash", F.when(gone, "mirror").alias("revocation_reason"), F.when(gone, F.lit("2000-01-01").cast("timestamp_ntz")).alias("revoked_at"))
    o = table(spark, d, "orders").filter("o_orderstatus = 'F'").join(a.select("record_id", "content_hash"), F.col("o_custkey") == F.col("record_id"))
    ev = o.select("content_hash", F.col("o_orderpriority").alias("reason"), F.col("o_orderdate").cast("timestamp_ntz").alias("at"), F.col("o_orderdate").alias("block"), F.col("o_orderkey").alias("log_index"))
    return M.latest_revocation(r, ev)


@query(HEAD + """, q as (select doc_id as capture_id, case doc_id % 4 when 0 then null when 1 then h when 2 then sha256('other' || doc_id) else 'junk' end as code, doc_id % 8 = 1 as elsewhere from a)
 select p.doc_id as capture_id, case when q.code is null then null when q.code = 'junk' then 'UNREADABLE' when q.elsewhere then 'ELSEWHERE' when q.code = p.h then 'SAME' else 'DIFFERENT' end as qr_state,
   case when q.code is null then null when q.code = 'junk' then 'INCONCLUSIVE' when q.elsewhere or q.code <> p.h then 'QR_MISMATCH' end as verdict from p left join q on q.capture_id = p.doc_id""")
def qr_check(spark, d):
    """Scanned codes against the document in hand; they decide before any other evidence."""
    k = F.col("record_id")
    q = anchored(spark, d).select(k.alias("capture_id"), F.when(k % 4 == 1, F.col("content_hash")).when(k % 4 == 2, F.sha2(F.concat(F.lit("other"), k.cast("string")), 256)).when(k % 4 == 3, "junk").alias("code"), (k % 8 == 1).alias("elsewhere"))
    j = presented(spark, d).select("capture_id", "content_hash").join(q, "capture_id", "left")
    state = qr_state(F.col("code"), F.col("content_hash"), F.col("elsewhere"), F.lit(False))
    out = V.verdicts(j.select("capture_id", state.alias("qr_state")))
    return out.select("capture_id", "qr_state", F.when(F.col("qr_state").isin("UNREADABLE", "ELSEWHERE", "DIFFERENT"), F.col("verdict")).alias("verdict"))


@query(HEAD + FLAT + "select distinct field from (select field from pf union all select field from af)")
def field_universe(spark, d):
    a, p = R.flatten_record(anchored(spark, d), "record_id"), R.flatten_record(presented(spark, d), "capture_id")
    return a.select("field").unionByName(p.select("field")).distinct()


@query("""with o as (select o_custkey, min(o_orderdate) d from orders group by 1) select c_custkey as doc_id, case when o.d is null then 'issuedOn' else '' end || case when o.d is null and c_acctbal < 0 then ',' else '' end || case when c_acctbal < 0 then 'holder' else '' end as missing,
  case when c_custkey % 6 = 0 then 'colour' else '' end as unknown from customer left join o on o_custkey = c_custkey""")
def missing_fields(spark, d):
    """Required fields that are absent or blank, and fields that are not allowed."""
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("d"))
    c = table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    have = F.create_map(F.lit("docType"), F.col("c_mktsegment"), F.lit("issuer"), F.col("c_nationkey").cast("string"), F.lit("holder"), F.when(F.col("c_acctbal") < 0, " ").otherwise(F.col("c_name")), F.lit("idNumber"), F.col("c_custkey").cast("string"), F.lit("issuedOn"), F.col("d").cast("string"), F.when(F.col("c_custkey") % 6 == 0, "colour").otherwise("payload"), F.lit("x"))
    full = F.map_keys(F.map_filter(have, lambda k, v: F.coalesce(F.trim(v), F.lit("")) != ""))
    order = F.array(*[F.lit(x) for x in ("issuedOn", "docType", "issuer", "idNumber", "holder")])
    allowed = F.array(*[F.lit(x) for x in (*R.REQUIRED, "payload")])
    return c.select(F.col("c_custkey").alias("doc_id"), F.array_join(F.array_except(order, full), ",").alias("missing"), F.array_join(F.array_except(F.map_keys(have), allowed), ",").alias("unknown"))
