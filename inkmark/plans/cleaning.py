"""Normalisation, hashing and scrubbing of columns on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkmark.functions import text as T
from inkmark.operators import records as R

from .base import query, table

# Field records from customers; REC and CANON are the same in SQL.
REC = """rec as (select c_custkey as doc_id, c_mktsegment as "docType", n_name as issuer, c_name as holder, c_custkey::varchar as "idNumber",
  strftime(coalesce(o.d, timestamp '1995-01-01'), '%d-%m-%Y') as "issuedOn", c_acctbal::decimal(12,2)::varchar as acctbal
  from customer join nation on c_nationkey = n_nationkey left join (select o_custkey, min(o_orderdate) as d from orders group by 1) o on o_custkey = c_custkey)"""


def numeric(value: str) -> str:
    return f"case when regexp_matches({value}, '^\\d+(\\.\\d+)?$') then regexp_replace(regexp_replace(regexp_replace({value}, '^0+(\\d)', '\\1'), '(\\.\\d*?)0+$', '\\1'), '\\.$', '') else {value} end"


def canon(source: str, name: str) -> str:
    up = lambda c: f"upper(trim(regexp_replace({c}, '\\s+', ' ', 'g')))"
    return f"""{name} as (select *, '{{"docType":"' || "docType" || '","holder":"' || holder || '","idNumber":"' || "idNumber" || '","issuedOn":"' || "issuedOn" || '","issuer":"' || issuer || '","payload":{{"acctbal":"' || acctbal || '"}}}}' as js from (
  select doc_id, {up('"docType"')} as "docType", {up("issuer")} as issuer, {up("holder")} as holder, regexp_replace({up('"idNumber"')}, '[^A-Z0-9]', '', 'g') as "idNumber",
  strftime(strptime("issuedOn", '%d-%m-%Y'), '%Y-%m-%d') as "issuedOn", {numeric(up("acctbal"))} as acctbal from {source}))"""


HASH = "sha256('inkmark:content:v1' || chr(10) || js)"
LOOKUP = "sha256('inkmark:lookup:v1' || chr(10) || issuer || '|' || \"docType\" || '|' || \"idNumber\")"
BASE = f"with {REC}, {canon('rec', 'c')} "


def field_records(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("d"))
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    day = F.date_format(F.coalesce("d", F.lit("1995-01-01").cast("timestamp")), "dd-MM-yyyy")
    return c.select(
        F.col("c_custkey").alias("doc_id"), F.col("c_mktsegment").alias("docType"), F.col("n_name").alias("issuer"), F.col("c_name").alias("holder"),
        F.col("c_custkey").cast("string").alias("idNumber"), day.alias("issuedOn"), F.create_map(F.lit("acctbal"), F.col("c_acctbal").cast("decimal(12,2)").cast("string")).alias("payload"),
    )


@query(BASE + 'select doc_id, "docType", issuer, holder, "idNumber", "issuedOn", acctbal, \'\' as problems from c')
def canonical_records(spark, d):
    c = R.canonical_records(field_records(spark, d))
    return c.select("doc_id", *R.REQUIRED, F.col("payload")["acctbal"].alias("acctbal"), F.array_join("problems", ",").alias("problems"))


@query(BASE + f"select doc_id, {HASH} as content_hash from c")
def content_hash(spark, d):
    return R.content_hash(R.canonical_records(field_records(spark, d))).select("doc_id", "content_hash")


@query(BASE + f"select doc_id, {LOOKUP} as lookup_key from c")
def lookup_key(spark, d):
    return R.lookup_key(R.canonical_records(field_records(spark, d))).select("doc_id", "lookup_key")


FIELDS = " union all ".join(f"select doc_id, '{f}' as field, \"{f.split('.')[-1]}\" as value from {{0}}" for f in (*R.REQUIRED, "payload.acctbal"))


@query(BASE + FIELDS.format("c"))
def flatten_record(spark, d):
    return R.flatten_record(R.canonical_records(field_records(spark, d)), "doc_id")


@query("select page_id, sha256(html) as byte_hash, octet_length(encode(html))::bigint as size from pages")
def byte_hash(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2(F.col("html"), 256).alias("byte_hash"), F.octet_length("html").cast("long").alias("size"))


MESSY = """v as (select o_orderkey, case o_orderkey % 8 when 0 then strftime(o_orderdate, '%Y/%m/%d') when 1 then strftime(o_orderdate, '%d.%m.%Y') when 2 then strftime(o_orderdate, '%-d %b %Y')
  when 3 then strftime(o_orderdate, '%B %-d, %Y') when 4 then '00' || o_totalprice::decimal(12,2)::varchar || '0' when 5 then '  ' || lower(o_orderpriority) || '   x ' when 6 then '31-02-2024' else o_custkey::varchar || '.000' end as v from orders),
 s as (select o_orderkey, v, upper(trim(regexp_replace(v, '\\s+', ' ', 'g'))) as s from v), t as (select *, replace(s, ',', '') as t from s)"""
# The formats of dates, tried in this order when separators are hyphens and months have three letters.
DATE_FORMATS = ("%Y-%m-%d", "%d-%m-%Y", "%d %b %Y", "%b %d %Y")
DATE = f"try_strptime(regexp_replace(regexp_replace(t, '[/.]', '-', 'g'), '([A-Z]{{3}})[A-Z]*', '\\1', 'g'), {list(DATE_FORMATS)})"


@query(f"with {MESSY} select o_orderkey, case when regexp_matches(s, '^\\d+(\\.\\d+)?$') then {numeric('s')} else coalesce(strftime({DATE}, '%Y-%m-%d'), s) end as value from t")
def normalise_values(spark, d):
    day, k = F.col("o_orderdate"), F.col("o_orderkey") % 8
    shapes = [F.date_format(day, "yyyy/MM/dd"), F.date_format(day, "dd.MM.yyyy"), F.date_format(day, "d MMM yyyy"), F.date_format(day, "MMMM d, yyyy"), F.concat(F.lit("00"), F.col("o_totalprice").cast("decimal(12,2)").cast("string"), F.lit("0")), F.concat(F.lit("  "), F.lower("o_orderpriority"), F.lit("   x ")), F.lit("31-02-2024")]
    v = F.concat(F.col("o_custkey").cast("string"), F.lit(".000"))
    for i, s in reversed(list(enumerate(shapes))):
        v = F.when(k == i, s).otherwise(v)
    return table(spark, d, "orders").select("o_orderkey", T.norm_value(v).alias("value"))


# A document schema of the queries' own.
PARTY = {"PARTY_CARD": {"kind": "text", "issuer": "text", "name": "text", "number": "alnum", "born": "date", "points": "numeric?"}}


@query("""with f as (select c_custkey as doc_id, 'PARTY_CARD' as sc, upper(c_mktsegment) as dt, upper(regexp_replace(n_name, '[^A-Za-z0-9 ]', '', 'g')) as iss, upper(regexp_replace(c_name, '[^A-Za-z0-9 ]', '', 'g')) as h,
    translate(upper('C' || c_custkey::varchar || 'SB'), 'OQDILZSTBG', '0001125786') as idn, case when c_custkey % 5 = 0 then null when c_custkey % 7 = 0 then '' else '19' || lpad((c_custkey % 90 + 10)::varchar, 2, '0') || '-' || lpad((c_custkey % 12 + 1)::varchar, 2, '0') || '-' || lpad((c_custkey % 31 + 1)::varchar, 2, '0') end as dob, c_custkey,
    case when c_custkey % 4 = 0 then '' else regexp_replace(c_acctbal::decimal(12,2)::varchar, '[^0-9]', '', 'g') end as pts
    from customer join nation on c_nationkey = n_nationkey)
  select doc_id, sc as doc_schema, case when dob is null then 'born' else '' end as missing, case when c_custkey % 3 = 0 then 'name' else '' end as low_confidence, case when dob = '' then 'born' else '' end as unparsable,
    coalesce(c_custkey % 3 <> 0 and dob <> '', false) as confident,
    case when dob is not null then '0x' || sha256('4:born=' || length(dob) || ':' || dob || ';6:issuer=' || length(iss) || ':' || iss || ';4:kind=' || length(dt) || ':' || dt || ';4:name=' || length(h) || ':' || h || ';6:number=' || length(idn) || ':' || idn || ';6:points=' || length(pts) || ':' || pts || ';') end as content_hash from f""")
def typed_canonical_hash(spark, d):
    k = F.col("c_custkey")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    dob = F.when(k % 5 == 0, F.lit(" ")).when(k % 7 == 0, F.lit("99-99-1999")).otherwise(F.concat_ws("/", two(k % 31 + 1), two(k % 12 + 1), F.concat(F.lit("19"), two(k % 90 + 10))))
    points = F.when(k % 4 != 0, F.col("c_acctbal").cast("decimal(12,2)").cast("string"))
    values = {"kind": F.col("c_mktsegment"), "issuer": F.concat(F.lower("n_name"), F.lit(".")), "name": F.col("c_name"), "number": F.concat(F.lit("C-"), k.cast("string"), F.lit(" SB")), "born": dob, "points": points}
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    f = c.select(k.alias("doc_id"), F.lit("PARTY_CARD").alias("doc_schema"), F.explode(F.array(*[F.struct(F.lit(n).alias("field"), v.alias("value"), F.when((k % 3 == 0) & F.lit(n == "name"), 0.5).otherwise(0.9).alias("confidence")) for n, v in values.items()])).alias("f"))
    return R.typed_canonical_hash(f.select("doc_id", "doc_schema", "f.*"), R.typed_schema(spark, PARTY))


ID_SQL = "case when c_custkey % 4 = 0 then 'X' || c_custkey else 'B' || replace(replace(lpad(c_custkey::varchar, 6, '0'), '0', 'O'), '5', 's') || '-C5' end"


@query(f"""with i as (select c_custkey, regexp_replace(upper({ID_SQL}), '[^A-Z0-9]', '', 'g') as s from customer)
  select c_custkey, case when length(s) = 9 then translate(substr(s, 1, 1), '012586', 'OIZSBG') || translate(substr(s, 2, 6), 'OQDILZSBG', '000112586') || translate(substr(s, 8, 2), '012586', 'OIZSBG') else s end as id from i""")
def repair_ids(spark, d):
    k = F.col("c_custkey")
    raw = F.when(k % 4 == 0, F.concat(F.lit("X"), k.cast("string"))).otherwise(F.concat(F.lit("B"), F.translate(F.lpad(k.cast("string"), 6, "0"), "05", "Os"), F.lit("-C5")))
    return table(spark, d, "customer").select("c_custkey", T.repair_id(raw, F.lit("LDDDDDDLL")).alias("id"))


# The two tables below are fixed values: the published ones of the Verhoeff check.
@query("""with dg as (select c_custkey, case when c_custkey % 4 = 0 then lpad((c_custkey * 7919)::varchar, 11, '0') else lpad((c_custkey * 7919 + 100000000000)::varchar, 12, '0') end as n, case when c_custkey % 3 = 0 then 0.4::double else 0.9 end as conf from customer),
  t as (select [[0,1,2,3,4,5,6,7,8,9],[1,2,3,4,0,6,7,8,9,5],[2,3,4,0,1,7,8,9,5,6],[3,4,0,1,2,8,9,5,6,7],[4,0,1,2,3,9,5,6,7,8],[5,9,8,7,6,0,4,3,2,1],[6,5,9,8,7,1,0,4,3,2],[7,6,5,9,8,2,1,0,4,3],[8,7,6,5,9,3,2,1,0,4],[9,8,7,6,5,4,3,2,1,0]] as dd,
    [[0,1,2,3,4,5,6,7,8,9],[1,5,7,6,2,8,3,0,9,4],[5,8,0,3,7,9,6,1,4,2],[8,9,1,6,0,4,3,5,2,7],[9,4,5,3,1,2,6,8,7,0],[4,2,8,6,5,7,3,9,0,1],[2,7,9,3,8,0,6,4,1,5],[7,0,4,6,9,1,3,2,5,8]] as pp),
  v as (select *, list_reduce(list_prepend(0, list_transform(range(length(n)), lambda i: pp[i % 8 + 1][substr(reverse(n), (i + 1)::int, 1)::int + 1])), lambda a, x: dd[a + 1][x + 1]) = 0 as valid from dg, t)
  select c_custkey, valid, case when length(n) >= 12 and not valid then least(conf, 0.5) else conf end as confidence from v""")
def checksum_audit(spark, d):
    """Checksums of ids; those of 12 digits or more that fail lower the confidence of the reading."""
    k = F.col("c_custkey")
    n = F.when(k % 4 == 0, F.lpad((k * 7919).cast("string"), 11, "0")).otherwise(F.lpad((k * 7919 + 100000000000).cast("string"), 12, "0"))
    conf = F.when(k % 3 == 0, 0.4).otherwise(0.9)
    return table(spark, d, "customer").select("c_custkey", T.verhoeff_valid(n).alias("valid"), T.capped_confidence(n, conf).alias("confidence"))


IPS_SQL = "case event_id % 5 when 0 then '10.' || user_id || '.7.' || (event_id % 256) when 1 then '::ffff:198.51.100.' || (event_id % 256) when 2 then '2001:db8:' || user_id || ':8d3:1319:8a2e:370:7348' when 3 then '::1' else 'junk' end"


@query(f"""with e as (select event_id, {IPS_SQL} as ip from events), f as (select *, regexp_replace(ip, '^::ffff:', '') as v4 from e)
  select event_id, case when regexp_matches(v4, '^\\d{{1,3}}(\\.\\d{{1,3}}){{3}}$') then regexp_replace(v4, '\\.\\d{{1,3}}$', '.0') when ip = '::1' then ip when contains(ip, ':') then array_to_string(string_split(ip, ':')[1:3], ':') || '::' end as ip from f""")
def mask_ips(spark, d):
    k, u, low = F.col("event_id") % 5, F.col("user_id").cast("string"), (F.col("event_id") % 256).cast("string")
    ip = F.when(k == 0, F.concat(F.lit("10."), u, F.lit(".7."), low)).when(k == 1, F.concat(F.lit("::ffff:198.51.100."), low)).when(k == 2, F.concat(F.lit("2001:db8:"), u, F.lit(":8d3:1319:8a2e:370:7348"))).when(k == 3, "::1").otherwise("junk")
    return table(spark, d, "events").select("event_id", T.mask_ip(ip).alias("ip"))


def _scrub_sql(c: str) -> str:
    for pattern, to in T.SECRETS:
        flag = "gi" if pattern.startswith("(?i)") else "g"
        c = f"regexp_replace({c}, '{pattern.removeprefix('(?i)').replace(chr(39), chr(39) * 2)}', '{to.replace('$1', chr(92) + '1')}', '{flag}')"
    return c


@query(f"select doc_id, {_scrub_sql('text')} as text from documents")
def redact_secrets(spark, d):
    return table(spark, d, "documents").select("doc_id", T.scrub(F.col("text")).alias("text"))


@query("""select c_custkey, c_name as user_name, '[REDACTED]' as user_password, '[REDACTED]' as auth, 'id ' || c_custkey || ' token=[REDACTED]' as trace, '[REDACTED]' as first_token, 'try ' || c_custkey || ' of db://[REDACTED]' as first_note,
  'Error' as error_name, 'no Bearer [REDACTED]' as error_message, 'E' || c_custkey % 5 as error_code, false as has_stack, '[Buffer ' || length(c_name) || ' bytes]' as body, '[REDACTED]' as api_key from customer""")
def redact_records(spark, d):
    """Log records with secrets under their names at any depth, in texts, in errors and in bytes."""
    k = F.col("c_custkey").cast("string")
    text = lambda *x: F.concat(*[y if not isinstance(y, str) else F.lit(y) for y in x])
    log = table(spark, d, "customer").select(
        "c_custkey", F.struct(F.col("c_name").alias("name"), F.lit("hunter2").alias("password")).alias("user"), F.create_map(F.lit("Authorization"), text("Bearer x", k), F.lit("X-Trace"), text("id ", k, " token=abc")).alias("headers"),
        F.array(F.struct(text("t", k).alias("accessToken"), text("try ", k, " of mysql://u:p@h/d").alias("note"))).alias("attempts"),
        F.struct(F.lit("Error").alias("name"), F.lit("no Bearer abc.def").alias("message"), text("E", (F.col("c_custkey") % 5).cast("string")).alias("code"), F.lit("at line 1").alias("stack")).alias("error"),
        F.encode("c_name", "UTF-8").alias("body"), F.lit(7).alias("apiKey"),
    )
    r = T.redact_columns(log)
    return r.select(
        "c_custkey", F.col("user.name").alias("user_name"), F.col("user.password").alias("user_password"), F.col("headers")["Authorization"].alias("auth"), F.col("headers")["X-Trace"].alias("trace"),
        F.col("attempts")[0]["accessToken"].alias("first_token"), F.col("attempts")[0]["note"].alias("first_note"), F.col("error.name").alias("error_name"), F.col("error.message").alias("error_message"), F.col("error.code").alias("error_code"),
        F.lit("stack" in r.schema["error"].dataType.names).alias("has_stack"), "body", F.col("apiKey").alias("api_key"),
    )


@query(r"""with n as (select page_id, regexp_extract(regexp_replace(replace(url, '\', '/'), '/+$', ''), '([^/]*)$', 1) as b from pages),
  c as (select page_id, right(trim(regexp_replace(regexp_replace(regexp_replace(b, '[^A-Za-z0-9._ -]', '_', 'g'), '_{2,}', '_', 'g'), '^[.\s_-]+', '')), 100) as s from n)
  select page_id, case when s = '' then 'document' else s end as name from c""")
def sanitise_names(spark, d):
    return table(spark, d, "pages").select("page_id", T.safe_name(F.col("url")).alias("name"))


@query("""select c_custkey, case when c_custkey % 4 = 0 then 'https://chain-a.example/tx/' when c_custkey % 4 = 1 then 'https://chain-b.example/tx/' end || '0x' || sha256(c_custkey::varchar) as link from customer""")
def link_columns(spark, d):
    """Chain id to explorer link; a chain without an explorer has none."""
    sites = F.broadcast(spark.createDataFrame([(0, "https://chain-a.example"), (1, "https://chain-b.example")], "chain long, site string"))
    c = table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 4).alias("chain"), F.concat(F.lit("0x"), F.sha2(F.col("c_custkey").cast("string"), 256)).alias("tx"))
    return c.join(sites, "chain", "left").select("c_custkey", F.concat("site", F.lit("/tx/"), "tx").alias("link"))


# Error names of the contract and codes of the node with the stable code, and whether to retry; the messages are our own.
CONTRACT_ERRORS = (
    ("NotAuthorisedIssuer", "NOT_AUTHORISED_ISSUER", "The sender may not issue documents."), ("NotIssuingAuthority", "NOT_ISSUING_AUTHORITY", "Only the issuer of a document can revoke it."),
    ("AlreadyAnchored", "ALREADY_ANCHORED", "The document is on the ledger already."), ("NotAnchored", "NOT_ANCHORED", "The document is not on the ledger."), ("AlreadyRevoked", "ALREADY_REVOKED", "The document was revoked before."),
    ("NotAdmin", "NOT_ADMIN", "Only an administrator can do this."), ("ZeroHash", "INVALID_HASH", "A hash is missing."), ("ZeroAddress", "INVALID_ADDRESS", "An address is missing."), ("EmptyName", "INVALID_NAME", "An issuer needs a name."),
)
NODE_ERRORS = (
    ("INSUFFICIENT_FUNDS", "INSUFFICIENT_GAS", "The wallet cannot pay the fee.", False), ("NETWORK_ERROR", "CHAIN_UNAVAILABLE", "The ledger cannot be reached now.", True), ("SERVER_ERROR", "CHAIN_UNAVAILABLE", "The ledger cannot be reached now.", True),
    ("TIMEOUT", "CHAIN_UNAVAILABLE", "The ledger cannot be reached now.", True), ("NONCE_EXPIRED", "TX_CONFLICT", "Another transaction got in between.", True), ("REPLACEMENT_UNDERPRICED", "TX_CONFLICT", "Another transaction got in between.", True),
    ("CALL_EXCEPTION", "CALL_FAILED", "The contract refused the call.", False),
)
UNKNOWN_ERROR = ("CHAIN_ERROR", "The ledger reported an error.")
RAISED = [e[0] for e in CONTRACT_ERRORS] + [e[0] for e in NODE_ERRORS] + ["ODD"]


@query("""with e as (select event_id, (event_id % 17)::int as k from events)
  select event_id, case when k = 0 then 'NOT_AUTHORISED_ISSUER' when k = 1 then 'NOT_ISSUING_AUTHORITY' when k = 2 then 'ALREADY_ANCHORED' when k = 3 then 'NOT_ANCHORED' when k = 4 then 'ALREADY_REVOKED' when k = 5 then 'NOT_ADMIN' when k = 6 then 'INVALID_HASH'
    when k = 7 then 'INVALID_ADDRESS' when k = 8 then 'INVALID_NAME' when k = 9 then 'INSUFFICIENT_GAS' when k in (10, 11, 12) then 'CHAIN_UNAVAILABLE' when k in (13, 14) then 'TX_CONFLICT' when k = 15 then 'CALL_FAILED' else 'CHAIN_ERROR' end as code, k between 10 and 14 as retryable,
    case when k between 10 and 12 then 'The ledger cannot be reached now.' when k in (13, 14) then 'Another transaction got in between.' when k = 16 then 'The ledger reported an error.' when k = 15 then 'The contract refused the call.' when k = 9 then 'The wallet cannot pay the fee.'
     else ['The sender may not issue documents.', 'Only the issuer of a document can revoke it.', 'The document is on the ledger already.', 'The document is not on the ledger.', 'The document was revoked before.', 'Only an administrator can do this.', 'A hash is missing.', 'An address is missing.', 'An issuer needs a name.'][k + 1] end as message from e""")
def translate_errors(spark, d):
    """Raw errors of contract and node to stable codes and messages that tell nothing of the node."""
    contract = F.broadcast(spark.createDataFrame(list(CONTRACT_ERRORS), "raw string, c1 string, m1 string"))
    node = F.broadcast(spark.createDataFrame(list(NODE_ERRORS), "raw string, c2 string, m2 string, again boolean"))
    raw = F.element_at(F.array(*[F.lit(x) for x in RAISED]), (F.col("event_id") % len(RAISED) + 1).cast("int"))
    j = table(spark, d, "events").select("event_id", raw.alias("raw")).join(contract, "raw", "left").join(node, "raw", "left")
    code, message = UNKNOWN_ERROR
    return j.select("event_id", F.coalesce("c1", "c2", F.lit(code)).alias("code"), (F.col("c1").isNull() & F.coalesce("again", F.lit(False))).alias("retryable"), F.coalesce("m1", "m2", F.lit(message)).alias("message"))


@query("""with q as (select c_custkey, case c_custkey % 9 when 0 then '' when 1 then repeat('x', 301) when 2 then 'not json' when 3 then '[1]' when 4 then '{"v":1,"contentHash":"' || sha256(c_custkey::varchar) || '","chainId":7,"contractAddress":"0x' || repeat('aB', 20) || '","more":1}'
    when 5 then '{"v":2,"contentHash":"' || sha256(c_custkey::varchar) || '","chainId":7,"contractAddress":"0x' || repeat('aB', 20) || '"}' when 6 then '{"v":1,"contentHash":"xyz","chainId":7,"contractAddress":"0x' || repeat('aB', 20) || '"}'
    when 7 then '{"v":1,"contentHash":"' || sha256(c_custkey::varchar) || '","chainId":0,"contractAddress":"0x' || repeat('aB', 20) || '"}' else '{"v":1,"contentHash":"' || sha256(c_custkey::varchar) || '","chainId":' || (c_custkey % 2 + 7) || ',"contractAddress":"0x' || repeat('aB', 20) || '"}' end as raw from customer)
  select c_custkey, case c_custkey % 9 when 0 then 'empty' when 1 then 'too_long' when 2 then 'not_a_code' when 3 then 'not_a_code' when 4 then 'unexpected_content' when 5 then 'unknown_version' when 6 then 'invalid_hash' when 7 then 'invalid_chain' end as problem,
    case when c_custkey % 9 = 8 then c_custkey % 2 = 0 end as points_here from q""")
def validate_qr(spark, d):
    k = F.col("c_custkey")
    h, adr = F.sha2(k.cast("string"), 256), F.concat(F.lit("0x"), F.repeat(F.lit("aB"), 20))
    code = lambda v, hh, chain, more="": F.concat(F.lit(f'{{"v":{v},"contentHash":"'), hh, F.lit('","chainId":'), chain, F.lit(',"contractAddress":"'), adr, F.lit(f'"{more}}}'))
    seven = F.lit("7")
    raw = F.when(k % 9 == 0, "").when(k % 9 == 1, F.repeat(F.lit("x"), 301)).when(k % 9 == 2, "not json").when(k % 9 == 3, "[1]").when(k % 9 == 4, code(1, h, seven, ',"more":1')).when(k % 9 == 5, code(2, h, seven)).when(k % 9 == 6, code(1, F.lit("xyz"), seven)).when(k % 9 == 7, code(1, h, F.lit("0"))).otherwise(code(1, h, (k % 2 + 7).cast("string")))
    return validated_qr(table(spark, d, "customer").select("c_custkey", raw.alias("raw")), 7, "0x" + "Ab" * 20).select("c_custkey", "problem", "points_here")


def validated_qr(codes, chain: int, contract: str):
    """codes (raw) with problem (the first rule that fails, or null), content_hash, and whether it points to chain and contract."""
    j = F.from_json("raw", "v string, contentHash string, chainId string, contractAddress string")
    c = codes.withColumn("_j", j).withColumn("_keys", F.array_sort(F.json_object_keys("raw")))
    num = lambda f: F.get_json_object("raw", f"$.{f}")
    problem = (
        F.when(F.coalesce("raw", F.lit("")) == "", "empty")
        .when(F.length("raw") > 300, "too_long")
        .when(F.col("_keys").isNull(), "not_a_code")
        .when(F.col("_keys") != F.array(*[F.lit(x) for x in ("chainId", "contentHash", "contractAddress", "v")]), "unexpected_content")
        .when(~F.coalesce(num("v") == "1", F.lit(False)), "unknown_version")
        .when(~F.coalesce(F.col("_j.contentHash").rlike("^[a-f0-9]{64}$"), F.lit(False)), "invalid_hash")
        .when(~F.coalesce(num("chainId").rlike("^[1-9][0-9]*$"), F.lit(False)), "invalid_chain")
        .when(~F.coalesce(F.col("_j.contractAddress").rlike("^0x[0-9a-fA-F]{40}$"), F.lit(False)), "invalid_address")
    )
    c = c.withColumn("problem", problem)
    ok = F.col("problem").isNull()
    here = (F.col("_j.chainId") == str(chain)) & (F.lower("_j.contractAddress") == contract.lower())
    return c.withColumn("content_hash", F.when(ok, F.col("_j.contentHash"))).withColumn("points_here", F.when(ok, here)).drop("_j", "_keys")


@query("""with b as (select page_id, html, encode(html) as c, case page_id % 4 when 0 then 'application/pdf' when 1 then 'text/html' when 2 then 'image/png' else 'image/jpeg' end as declared, page_id % 3 as m from pages),
  e as (select page_id, declared, case m when 0 then '%PDF-' || html when 1 then html else '%PDF-1.4' end as body from b)
  select page_id, case when declared = 'text/html' then 'unsupported_declared' when octet_length(encode(body)) > 4096 then 'too_large' when not starts_with(body, '%PDF-') then 'unsupported_content' when declared <> 'application/pdf' then 'mismatch' else 'accepted' end as outcome from e""")
def classify_intake(spark, d):
    k = F.col("page_id")
    declared = F.when(k % 4 == 0, "application/pdf").when(k % 4 == 1, "text/html").when(k % 4 == 2, "image/png").otherwise("image/jpeg")
    body = F.when(k % 3 == 0, F.concat(F.lit("%PDF-"), "html")).when(k % 3 == 1, F.col("html")).otherwise("%PDF-1.4")
    return classified(table(spark, d, "pages").select("page_id", declared.alias("declared"), F.encode(body, "UTF-8").alias("content")), 4096).select("page_id", "outcome")


# The first bytes, as hexadecimal digits, of the types that are taken in.
MAGIC = (("application/pdf", "255044462D"), ("image/png", "89504E470D0A1A0A"), ("image/jpeg", "FFD8FF"))


def classified(files, max_bytes: int):
    """files (declared, content) with outcome: the first rule that fails, in order, or accepted."""
    head = F.hex(F.substring("content", 1, 8))
    detected = F.coalesce(*[F.when(head.startswith(m), F.lit(t)) for t, m in MAGIC])
    known = F.col("declared").isin(*[t for t, _ in MAGIC])
    return files.withColumn("outcome", F.when(~F.coalesce(known, F.lit(False)), "unsupported_declared").when(F.length("content") > max_bytes, "too_large").when(detected.isNull(), "unsupported_content").when(detected != F.col("declared"), "mismatch").otherwise("accepted"))


@query("""select o_orderkey, coalesce(c.c_name, 'order ' || o_orderkey) as name, c.c_custkey is not null as real from orders left join customer c on c.c_custkey = o_orderkey""")
def override_source(spark, d):
    """Rows of an override table replace those of the base with the same key."""
    base = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("name"))
    over = table(spark, d, "customer").select(F.col("c_custkey").alias("o_orderkey"), F.col("c_name").alias("_name"))
    j = base.join(over, "o_orderkey", "left")
    return j.select("o_orderkey", F.coalesce("_name", "name").alias("name"), F.col("_name").isNotNull().alias("real"))


@query("""select l_orderkey, l_linenumber, l_partkey, l_suppkey, 'anchor' as call, sha256(l_orderkey::varchar) as content_hash, sha256(l_partkey::varchar) as byte_hash, null::varchar as reason from lineitem where l_returnflag = 'A'
  union all select l_orderkey, l_linenumber, l_partkey, l_suppkey, 'revoke', sha256(l_orderkey::varchar), null, 'returned ' || l_linenumber from lineitem where l_returnflag = 'R'""")
def decode_ledger_calls(spark, d):
    """Raw call data to calls: 4-byte selector, 32-byte words; a text is offset, length, bytes."""
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    text = F.concat(F.lit("returned "), F.col("l_linenumber").cast("string"))
    word = lambda n: F.lpad(F.lower(F.hex(n)), 64, "0")
    h = lambda c: F.sha2(F.col(c).cast("string"), 256)
    data = F.when(F.col("l_returnflag") == "A", F.concat(F.lit("0x11111111"), h("l_orderkey"), h("l_partkey"))).when(F.col("l_returnflag") == "R", F.concat(F.lit("0x22222222"), h("l_orderkey"), word(F.lit(64)), word(F.length(text)), F.rpad(F.lower(F.hex(text)), 64, "0"))).otherwise("0x33333333")
    return decoded_calls(l.withColumn("data", data), "11111111", "22222222").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "call", "content_hash", "byte_hash", "reason")


def decoded_calls(txs, anchor: str, revoke: str):
    """txs (data) with call, content_hash, byte_hash and reason; rows of other selectors are dropped."""
    body, sel = F.substring("data", 11, 2**30), F.lower(F.substring("data", 3, 8))
    word = lambda i: F.substring(body, 64 * i + 1, 64)
    at = F.conv(F.substring(word(1), 49, 16), 16, 10).cast("int") * 2
    n = F.conv(F.substring(body, at + 49, F.lit(16)), 16, 10).cast("int") * 2
    said = F.decode(F.unhex(F.substring(body, at + 65, n)), "UTF-8")
    call = F.when(sel == anchor, "anchor").when(sel == revoke, "revoke")
    return txs.withColumn("call", call).filter("call is not null").withColumn("content_hash", word(0)).withColumn("byte_hash", F.when(F.col("call") == "anchor", word(1))).withColumn("reason", F.when(F.col("call") == "revoke", said))
