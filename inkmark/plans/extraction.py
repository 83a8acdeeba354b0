"""Lines to fields: conversations and documents as read lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkmark.operators import extraction as X

from .base import query, table

TRIM = "regexp_replace(regexp_replace({0}, '^\\s+', ''), '\\s+$', '')"
LINES = """ln as (select conv_id, turn, coalesce(role, '') || case when turn % 2 = 0 then ': ' else ' ; ' end || coalesce(text, '') as text from conversations)"""


def lines(spark, d):
    said = lambda c: F.coalesce(c, F.lit(""))
    return table(spark, d, "conversations").select("conv_id", "turn", F.concat(said("role"), F.when(F.col("turn") % 2 == 0, ": ").otherwise(" ; "), said("text")).alias("text"))


@query(f"""with {LINES}, t as (select conv_id, turn, {TRIM.format('text')} as s from ln), p as (select *, regexp_extract(s, '(?s)^([^:;]+)[:;]', 1) as label from t where regexp_matches(s, '(?s)^[^:;]+[:;]'))
  select conv_id, turn, label, trim({TRIM.format('substr(s, length(label) + 2)')}) as value from p""")
def split_labelled_lines(spark, d):
    return X.split_labelled_lines(lines(spark, d)).select("conv_id", "turn", "label", "value")


# A template's labels.
LABELS = ((0, "holder", "Customer", None), (1, "holder", "Name", None), (2, "idNumber", "Register No", "LDDDDDDLL"), (3, "issuedOn", "Date of Issue", None), (4, "payload.dob", "Date of Birth", None), (5, "payload.dob", "DOB", None), (6, "payload.programme", "Programme", None))


def dictionary(spark):
    return spark.createDataFrame([(f, l, o, m) for o, f, l, m in LABELS], "field string, label string, ord int, id_format string")


PRINTED = ("Reg1ster No", "Programne", "Nane", "DOB", "Date of Birth", "Remarks", "Custmer", "Date of Issue")
DICT = ", ".join(f"({o}, '{f}', '{''.join(ch for ch in l.lower() if ch.isalnum())}')" for o, f, l, _ in LABELS)
PRINTED_SQL = f"[{', '.join(repr(p) for p in PRINTED)}][(c_custkey % {len(PRINTED)} + 1)::int]"


@query(f"""with p as (select c_custkey, {PRINTED_SQL} as label from customer), k as (select *, regexp_replace(lower(label), '[^a-z0-9]', '', 'g') as key from p), dt(ord, field, want) as (values {DICT})
  select c_custkey, label, (select arg_min(field, {{'d': levenshtein(key, want), 'o': ord}}) from dt where levenshtein(key, want) <= case when length(want) >= 6 then 1 else 0 end) as field from k""")
def match_labels(spark, d):
    printed = F.element_at(F.array(*[F.lit(p) for p in PRINTED]), (F.col("c_custkey") % len(PRINTED) + 1).cast("int"))
    return X.match_labels(table(spark, d, "customer").select("c_custkey", printed.alias("label")), dictionary(spark))


@query("""with b as (select c_custkey as doc_id, c_name, c_mktsegment from customer)
  select * from (
   select doc_id, 'holder' as field, case when doc_id % 4 <> 1 and (doc_id % 6 <> 0) then c_name end as value, case when doc_id % 6 = 0 then 60.0::double else 92.0 end as confidence, case when doc_id % 4 = 1 then 'ambiguous' when doc_id % 6 = 0 then 'low_confidence' end as problem from b
   union all select doc_id, 'idNumber', 'B' || lpad(doc_id::varchar, 6, '0') || 'CS', 90.0, null from b
   union all select doc_id, 'issuedOn', case when doc_id % 5 <> 0 then '2024-01-01' end, 90.0, case when doc_id % 5 = 0 then 'unreadable' end from b
   union all select doc_id, 'payload.dob', null, null, 'missing' from b
   union all select doc_id, 'payload.programme', c_mktsegment, 80.0, null from b
   union all select doc_id, 'payload.remarks', 'extra', 95.0, null from b where doc_id % 3 = 0)""")
def extract_fields(spark, d):
    k = F.col("c_custkey")
    idn = F.concat(F.lit("B"), F.translate(F.lpad(k.cast("string"), 6, "0"), "0", "O"), F.lit("-C5"))
    rows = [
        (F.lit(True), F.concat(F.lit("Name: "), "c_name"), F.when(k % 6 == 0, 60.0).otherwise(92.0)), (k % 4 == 1, F.lit("Nome; other"), F.lit(99.0)), (k % 4 == 1, F.lit("Name; other"), F.lit(99.0)),
        (F.lit(True), F.concat(F.lit("Register N0 : "), idn), F.lit(90.0)), (F.lit(True), F.concat(F.lit("Date of lssue:"), F.when(k % 5 != 0, " 2024-01-01").otherwise("  ")), F.lit(90.0)),
        (F.lit(True), F.concat(F.lit("Programne:"), "c_mktsegment"), F.lit(80.0)), (k % 3 == 0, F.lit("Remarks: extra"), F.lit(95.0)), (F.lit(True), F.lit("no label here"), F.lit(99.0)),
    ]
    arr = F.array(*[F.struct(F.lit(i).alias("line_no"), F.when(on, t).alias("text"), c.alias("confidence")) for i, (on, t, c) in enumerate(rows) if i != 1])
    l = table(spark, d, "customer").select(k.alias("doc_id"), F.explode(arr).alias("l")).select("doc_id", "l.*").filter("text is not null")
    return X.extract_fields(l, dictionary(spark))


@query("""select page_id, nullif(trim(regexp_extract(html, '<title>([^<]*)', 1)), '') as title, coalesce(nullif(trim(regexp_extract(html, 'xml:lang="([a-z]+)"', 1)), ''), nullif(trim(regexp_extract(html, 'lang="([a-z]+)"', 1)), '')) as lang from pages""")
def extract_by_patterns(spark, d):
    p = table(spark, d, "pages").select("page_id", "html")
    return X.extract_by_patterns(p, {"title": ["<title>([^<]*)"], "lang": ['xml:lang="([a-z]+)"', 'lang="([a-z]+)"']}, "html").select("page_id", "title", "lang")


@query("""with r as (select l_orderkey as doc_id, l_returnflag as field, l_linenumber * 1000000 + l_partkey * 100 + l_suppkey as seq, case when l_quantity > 45 then '' else case l_suppkey % 3 when 0 then 'a b' when 1 then ' A  B' else 'c' end end as text, l_discount as confidence from lineitem),
  t as (select doc_id, field, count(*) as total from r group by 1, 2), g as (select doc_id, field, upper(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as key, count(*) as votes, avg(confidence) as mean, min(seq) as f, arg_min(text, seq) as text from r where text <> '' group by 1, 2, 3),
  w as (select *, row_number() over (partition by doc_id, field order by votes desc, mean desc, f) as n from g)
  select t.doc_id, t.field, coalesce(w.text, '') as text, coalesce(w.votes, 0) as votes, coalesce(w.votes / t.total, 0.0) as agreement, coalesce(least(1.0, w.mean * (0.6 + 0.4 * (w.votes / t.total))), 0.0) as confidence from t left join w on w.doc_id = t.doc_id and w.field = t.field and w.n = 1""")
def vote_readings(spark, d):
    """Readings of lines; means that only their last bits tell apart are summed in the table's order, as the SQL does that reads it in one piece."""
    t = F.when(F.col("l_quantity") > 45, "").otherwise(F.element_at(F.array(F.lit("a b"), F.lit(" A  B"), F.lit("c")), (F.col("l_suppkey") % 3 + 1).cast("int")))
    r = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_returnflag").alias("field"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey") * 100 + F.col("l_suppkey")).alias("seq"), t.alias("text"), F.col("l_discount").alias("confidence"), F.struct("_metadata.file_path", "_metadata.row_index").alias("at"))
    return X.vote_readings(r, "at")


@query("""with c as (select c_custkey as doc_id, case when c_custkey % 3 = 0 then '  ' else c_name end as h, case when c_custkey % 4 = 0 then null else c_mktsegment end as t, case when c_custkey % 5 = 0 then null else c_name end as rh, case when c_custkey % 6 = 0 then null else 'read' end as rt, c_custkey % 7 <> 0 as has from customer),
  e as (select *, case when has then rh end as rh2, case when has then rt end as rt2 from c)
  select doc_id, coalesce(nullif(trim(h), ''), rh2) as holder, coalesce(t, rt2) as "docType", 'entered' as shared, case when has then 'read' end as only_read,
   concat_ws(',', case when trim(h) = '' and rh2 is not null then 'holder' end, case when t is null and rt2 is not null then 'docType' end) as filled, concat_ws(',', case when trim(h) = '' and rh2 is null then 'holder' end, case when t is null and rt2 is null then 'docType' end) as gaps,
   case when (trim(h) = '' and rh2 is null) or (t is null and rt2 is null) then 'refused' else 'ok' end as outcome from e""")
def fill_gaps(spark, d):
    k, c = F.col("c_custkey"), table(spark, d, "customer")
    m = lambda **kv: F.create_map(*[x for a, b in kv.items() for x in (F.lit(a), F.lit(b))])
    entered = c.select(k.alias("doc_id"), F.when(k % 3 == 0, "  ").otherwise(F.col("c_name")).alias("holder"), F.when(k % 4 != 0, F.col("c_mktsegment")).alias("docType"), m(shared="entered").alias("payload"))
    read = c.filter("c_custkey % 7 <> 0").select(k.alias("doc_id"), F.when(k % 5 != 0, F.col("c_name")).alias("holder"), F.when(k % 6 != 0, "read").alias("docType"), m(shared="read", only="read").alias("payload"))
    out = X.fill_gaps(entered, read, ["holder", "docType"])
    return out.select("doc_id", "holder", "docType", F.col("payload")["shared"].alias("shared"), F.col("payload")["only"].alias("only_read"), "filled", "gaps", "outcome")
