"""The record table's states, and its reconciliation with the ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkmark.sources.shared import materialised, tidied

# The states, the moves between them, and the codes of rejected moves.
STATES = ("PENDING", "STORED", "BLOCKCHAIN_PENDING", "ISSUED", "REVOKED", "FAILED")
MOVES = (
    ("PENDING", "STORED"), ("PENDING", "FAILED"), ("STORED", "BLOCKCHAIN_PENDING"), ("STORED", "FAILED"), ("BLOCKCHAIN_PENDING", "ISSUED"),
    ("BLOCKCHAIN_PENDING", "FAILED"), ("ISSUED", "REVOKED"), ("FAILED", "PENDING"), ("PENDING", "PENDING"),
)
FAILURES = ("S3_FAILED", "CHAIN_REVERTED", "WRONG_CONTRACT", "WRONG_DATA", "USER_REJECTED", "CLIENT_ERROR", "STUCK_PENDING")
MIME_TYPES = ("application/pdf", "image/png", "image/jpeg")
CHECKS = ("MATCH", "INCONCLUSIVE", "SKIPPED")
DUPLICATE = ("STORED", "BLOCKCHAIN_PENDING", "ISSUED", "REVOKED")
STALE_SECONDS, STUCK_SECONDS = 60, 600


def validate_records(records: DataFrame) -> DataFrame:
    """The columns of the record contract with violations: the names, joined by commas, of those that break it.

    Columns that the contract doesn't know are dropped; those that a table lacks count as null. sha256, status and record_id must be there.
    """
    c = lambda n: F.col(n) if n in records.columns else F.lit(None).cast("string")
    hashed, chained = "^[a-f0-9]{64}$", "^0x[a-f0-9]{64}$"
    must = {"record_id": c("record_id").isNotNull(), "sha256": c("sha256").rlike(hashed), "status": c("status").isin(*STATES)}
    may = {
        "byte_hash": c("byte_hash").rlike(hashed), "content_hash": c("content_hash").rlike(hashed), "lookup_key": c("lookup_key").rlike(hashed), "ocr_check": c("ocr_check").isin(*CHECKS),
        "mime_type": c("mime_type").isin(*MIME_TYPES), "size": c("size").cast("long") >= 0, "chain_id": c("chain_id").cast("long") >= 1, "contract_address": c("contract_address").rlike("^0x[a-fA-F0-9]{40}$"),
        "transaction_hash": c("transaction_hash").rlike(chained), "block_number": c("block_number").cast("long") >= 0, "failure_reason": c("failure_reason").isin(*FAILURES),
        "revocation_reason": F.length(c("revocation_reason")) <= 500, "revocation_tx": c("revocation_tx").rlike(chained),
    }
    rules = {**{n: F.coalesce(ok, F.lit(False)) for n, ok in must.items()}, **{n: c(n).isNull() | F.coalesce(ok, F.lit(False)) for n, ok in may.items()}}
    bad = F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules.items()])
    return records.select(*[c(n).alias(n) for n in rules], F.array_join(F.array_compact(bad), ",").alias("violations"))


def quarantined(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that keep the contract, rows that break it with their violations); every row is in one of the two."""
    v = validate_records(records)
    return v.filter("violations = ''").drop("violations"), v.filter("violations <> ''")


def issuer_gate(anchors: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    """anchors with outcome: accepted if the sender (key) is on the allow list, else rejected."""
    there = allowed.select(F.col(key).alias("_key")).distinct()
    j = anchors.join(there, F.col(key) == F.col("_key"), "left")
    return j.withColumn("outcome", F.when(F.col("_key").isNotNull(), "accepted").otherwise("rejected")).drop("_key")


def register_issuers(requests: DataFrame, issuers: DataFrame, order: str) -> DataFrame:
    """requests (wallet and others) with outcome: registered for the first request (by ``order``) of a wallet that isn't an issuer, else already_registered."""
    seen = append_if_absent(requests, issuers, "wallet", order)
    return seen.withColumn("outcome", F.when(F.col("already_stored"), "already_registered").otherwise("registered")).drop("already_stored")


def append_if_absent(batch: DataFrame, target: DataFrame, key: str, order: str) -> DataFrame:
    """batch with already_stored: its key is in the target, or came earlier in the batch. Rows that are not are the ones to append."""
    first = Window.partitionBy(key).orderBy(order)
    there = target.select(F.col(key).alias("_key")).distinct().withColumn("_there", F.lit(True))
    b = batch.withColumn("_n", F.row_number().over(first)).join(there, F.col(key) == F.col("_key"), "left")
    return b.withColumn("already_stored", F.coalesce("_there", F.lit(False)) | (F.col("_n") > 1)).drop("_n", "_key", "_there")


def transition_audit(log: DataFrame, key: str = "record_id") -> DataFrame:
    """log (key, seq, status) with previous and legal: the first state is PENDING, every other follows from the one before."""
    edges = log.sparkSession.createDataFrame(list(MOVES), "previous string, status string").withColumn("_edge", F.lit(True))
    l = log.withColumn("previous", F.lag("status").over(Window.partitionBy(key).orderBy("seq")))
    j = l.join(F.broadcast(edges), ["previous", "status"], "left")
    return j.withColumn("legal", F.when(F.col("previous").isNull(), F.col("status") == "PENDING").otherwise(F.coalesce("_edge", F.lit(False)))).drop("_edge")


def replay_lifecycle(moves: DataFrame, key: str = "record_id", start: str = "PENDING") -> DataFrame:
    """moves (key, ts, seq, from_states array, to_state, failure_reason) applied in order, each only if the state is one it may
    leave -> key, status, failure_reason (kept for FAILED only), applied (number of moves)."""
    m = F.array_sort(F.collect_list(F.struct("ts", "seq", "from_states", "to_state", "failure_reason")))
    zero = F.struct(F.lit(start).alias("status"), F.lit(None).cast("string").alias("reason"), F.lit(0).alias("applied"))

    def step(s: Column, e: Column) -> Column:
        moved = F.struct(e["to_state"].alias("status"), F.when(e["to_state"] == "FAILED", e["failure_reason"]).alias("reason"), (s["applied"] + 1).alias("applied"))
        return F.when(F.array_contains(e["from_states"], s["status"]), moved).otherwise(s)

    out = moves.groupBy(key).agg(F.aggregate(m, zero, step).alias("s"))
    return out.select(key, "s.status", F.col("s.reason").alias("failure_reason"), "s.applied")


def silences(changes: DataFrame, waits: tuple[tuple[str, int], ...], until: Column) -> DataFrame:
    """changes (record_id, ts, seq, status) -> record_id, event, failure_reason, at: each wait (name, seconds) that a PENDING row outlasted before ``until``
    without a later row of its record, by (ts, seq); a row exactly at the deadline is in time."""
    later = F.lead("ts").over(Window.partitionBy("record_id").orderBy("ts", "seq"))
    rows = changes.withColumn("_next", later).filter("status = 'PENDING'")
    due = F.explode(F.array(*[F.struct(F.lit(n).alias("event"), (F.col("ts") + F.make_dt_interval(secs=F.lit(s))).alias("at")) for n, s in waits]))
    out = rows.select("record_id", "_next", due.alias("d")).filter((F.col("_next").isNull() | (F.col("_next") > F.col("d.at"))) & (F.col("d.at") < until))
    return out.select("record_id", "d.event", F.when(F.col("d.event") == "FAILED", "STUCK_PENDING").alias("failure_reason"), "d.at")


def _packed(c: Column) -> Column:
    """A hash of 64 hexadecimal digits as its 32 bytes, any other text as its own and 33 more: other texts are other bytes, in half the room."""
    return F.when(c.rlike("^[0-9a-f]{64}$"), F.unhex(c)).otherwise(F.concat(c.cast("binary"), F.lit(bytes(33))))


TX = "^0x[a-f0-9]{64}$"


def _packed_tx(c: Column) -> Column:
    """A transaction of 0x and 64 hexadecimal digits as its 32 bytes, any other text as its own and 33 more."""
    return F.when(c.rlike(TX), F.unhex(F.substring(c, 3, 64))).otherwise(F.concat(c.cast("binary"), F.lit(bytes(33))))


def resolve_submissions(batch: DataFrame, records: DataFrame, stale_seconds: int = STALE_SECONDS) -> DataFrame:
    """batch (submission_id, which tells its rows apart, sha256, content_hash, ts) against records (sha256, content_hash, status, updated_at) -> outcome.

    Same file: duplicate_file in a duplicate state, retry if FAILED or stale, else in_progress. Same content: duplicate_content,
    in_progress if freshly PENDING, else conflict. Neither: new, for the first of the batch; later ones are in_progress.

    Files and contents are decided one after the other, each by one shuffle of its packed hash, which is gone when what it says is written: so the
    batch is read twice, and no row moves with both hashes.
    """
    fresh = F.unix_timestamp("ts") - F.unix_timestamp("r.updated_at") < stale_seconds
    by_file = (
        F.when(F.col("r.status").isin(*DUPLICATE), "duplicate_file")
        .when((F.col("r.status") == "FAILED") | ((F.col("r.status") == "PENDING") & ~fresh), "retry")
        .when(F.col("r.status").isNotNull(), "in_progress")
    )
    by_content = F.when(F.col("r.status").isin(*DUPLICATE), "duplicate_content").when((F.col("r.status") == "PENDING") & fresh, "in_progress").when(F.col("r.status").isNotNull(), "conflict")

    def told(kind: str, key: Column, same: Column, known: Column) -> DataFrame:
        """Of each submission what the newest record of its key says, and whether it is the first of those that are the same."""
        there = records.filter(F.col(kind).isNotNull()).groupBy(_packed(F.col(kind)).alias("_key")).agg(F.max(F.struct("updated_at", "status")).alias("r"))
        rows = batch.select("submission_id", "ts", _packed(same).alias("_same"), key.isNotNull().alias("_asks"))
        first = F.row_number().over(Window.partitionBy("_same").orderBy(F.asc_nulls_last("ts"), F.asc_nulls_last("submission_id"))) == 1
        j = rows.join(there, (F.col("_same") == F.col("_key")) & F.col("_asks"), "left")
        with tidied(batch.sparkSession):
            return materialised(j.select("submission_id", known.alias(f"_{kind}"), first.alias(f"_{kind}_first")), f"by-{kind}")

    sha256, content = F.col("sha256"), F.col("content_hash")
    f = told("sha256", sha256, sha256, by_file)
    c = told("content_hash", content, F.coalesce(content, sha256), by_content).withColumnRenamed("submission_id", "_id")
    j = f.join(c, F.col("submission_id").eqNullSafe(F.col("_id")))
    known = F.coalesce("_sha256", "_content_hash")
    first = F.col("_sha256_first") & F.col("_content_hash_first")
    return j.select("submission_id", F.when(known.isin("duplicate_file", "duplicate_content", "conflict"), known).when(~first, "in_progress").otherwise(F.coalesce(known, F.lit("new"))).alias("outcome"))


def _same(a: str, b: str) -> Column:
    return F.coalesce(F.lower(F.col(a)) == F.lower(F.col(b)), F.lit(False))


def confirm_issuance(pending: DataFrame, receipts: DataFrame, calls: DataFrame, registry: DataFrame, contract: str) -> DataFrame:
    """Each pending record (record_id, tx, content_hash, sha256) -> state pending, failed or issued, and the failure's reason."""
    r = receipts.select("tx", F.col("state").alias("_state"), F.col("to_addr").alias("_to"))
    c = calls.select("tx", F.col("content_hash").alias("_c_content"), F.col("byte_hash").alias("_c_byte"), F.col("from_addr").alias("_from"))
    g = registry.select(F.col("content_hash").alias("_g_content"), F.col("byte_hash").alias("_g_byte"), F.col("issuer").alias("_issuer"), F.col("revoked").alias("_revoked"))
    j = pending.join(r, "tx", "left").join(c, "tx", "left").join(g, F.col("content_hash") == F.col("_g_content"), "left")
    right = (F.col("_c_content") == F.col("content_hash")) & (F.col("_c_byte") == F.col("sha256")) & (F.col("_g_byte") == F.col("sha256")) & ~F.col("_revoked") & _same("_issuer", "_from")
    reason = F.when(F.col("_state") == "reverted", "CHAIN_REVERTED").when(F.lower("_to") != contract.lower(), "WRONG_CONTRACT").when(~F.coalesce(right, F.lit(False)), "WRONG_DATA")
    nothing = F.col("_state").isNull() | (F.col("_state") == "not_found")
    j = j.withColumn("_reason", F.when(~nothing, reason)).withColumn("_nothing", nothing)
    return j.select("record_id", F.when(F.col("_nothing"), "pending").when(F.col("_reason").isNotNull(), "failed").otherwise("issued").alias("state"), F.col("_reason").alias("failure_reason"))


def confirm_revocation(requests: DataFrame, records: DataFrame, receipts: DataFrame, calls: DataFrame, registry: DataFrame, events: DataFrame, contract: str) -> DataFrame:
    """Each request (record_id, tx, now) -> state revoked, pending, failed or refused, with reason (500 characters at most) and time."""
    rec = records.select("record_id", "content_hash", "status", F.col("revocation_tx").alias("_done_tx"))
    r = receipts.select("tx", F.col("state").alias("_state"), F.col("to_addr").alias("_to"))
    c = calls.select("tx", F.col("content_hash").alias("_c_content"), F.col("reason").alias("_c_reason"))
    g = registry.select("content_hash", F.col("revoked").alias("_revoked"))
    e = events.select("content_hash", F.col("tx").alias("_e_tx"), F.col("at").alias("_e_at"))
    j = requests.join(rec, "record_id", "left").join(r, "tx", "left").join(c, "tx", "left").join(g, "content_hash", "left").join(e, "content_hash", "left")
    state = (
        F.when((F.col("status") == "REVOKED") & (F.col("_done_tx") == F.col("tx")), "revoked")
        .when(~F.col("status").eqNullSafe("ISSUED") | F.col("content_hash").isNull(), "refused")
        .when(F.col("_state").isNull() | (F.col("_state") == "not_found"), "pending")
        .when((F.col("_state") == "reverted") | (F.lower("_to") != contract.lower()), "failed")
        .when(~F.col("_c_content").eqNullSafe(F.col("content_hash")), "refused")
        .when(~F.coalesce("_revoked", F.lit(False)), "failed")
        .otherwise("revoked")
    )
    j = j.withColumn("state", state)
    moved = (F.col("state") == "revoked") & (F.col("status") == "ISSUED")
    return j.select("record_id", "state", F.when(moved, F.substring("_c_reason", 1, 500)).alias("reason"), F.when(moved, F.when(F.col("_e_tx") == F.col("tx"), F.col("_e_at")).otherwise(F.col("now"))).alias("revoked_at"))


def drifted(records: DataFrame, registry: DataFrame) -> DataFrame:
    """record_id, content_hash, drift: issued without a ledger row, revoked on one side only, ledger rows without a record (record_id null), in step."""
    g = registry.select("content_hash", F.lit(True).alias("_there"), F.col("revoked").alias("_revoked"))
    r = records.select("record_id", "content_hash", "status")
    j = r.join(g, "content_hash", "full")
    there, revoked = F.coalesce("_there", F.lit(False)), F.coalesce("_revoked", F.lit(False))
    drift = (
        F.when(F.col("status").isNull(), "ledger_only")
        .when(F.col("status").isin("ISSUED", "REVOKED") & ~there, "missing_on_ledger")
        .when((F.col("status") == "ISSUED") & revoked, "revoked_on_ledger_only")
        .when((F.col("status") == "REVOKED") & ~revoked, "revoked_in_record_only")
        .when(~F.col("status").isin("ISSUED", "REVOKED") & there, "ahead_on_ledger")
        .otherwise("in_step")
    )
    return j.select("record_id", "content_hash", drift.alias("drift"))


def ledger_drift(records: DataFrame, registry: DataFrame) -> DataFrame:
    """How many records and ledger rows there are of each class of drift."""
    return drifted(records, registry).groupBy("drift").agg(F.count(F.lit(1)).alias("n"))


def apply_chain_reports(reports: DataFrame, records: DataFrame) -> DataFrame:
    """reports (report_id, record_id, kind pending/failed, tx, reason, ts) -> outcome and the record's new status.

    The first report of a document wins; a transaction belongs to the first document that names it.

    Reports meet their records first and what is known then is written; only pending ones with a well-formed transaction move once more, by its packed hash.
    """
    spark, pending = reports.sparkSession, F.col("kind") == "pending"
    rec = records.select("record_id", "status", F.col("content_hash").isNotNull().alias("_content"), _packed_tx(F.col("tx")).alias("_tx"))
    tx = F.lower("tx")
    r = reports.select("report_id", "record_id", "kind", "ts", "reason", F.when(pending, _packed_tx(tx)).alias("_asked"), (pending & tx.rlike(TX)).alias("_formed"), (pending & ~tx.rlike(TX)).alias("_bad"))
    per_doc = F.row_number().over(Window.partitionBy("record_id").orderBy(F.asc_nulls_last("ts"), F.asc_nulls_last("report_id")))
    before = (
        F.when(F.col("status").isNull(), "not_found")
        .when(F.col("_bad"), "bad_parameter")
        .when(pending & F.col("status").isin("BLOCKCHAIN_PENDING", "ISSUED") & F.col("_tx").eqNullSafe(F.col("_asked")), "unchanged")
        .when(pending & ~F.col("_content"), "refused")
    )
    after = F.when(F.col("_n") > 1, "superseded").when(pending & (F.col("status") != "STORED"), "refused").when(~pending & ~F.col("status").isin("STORED", "BLOCKCHAIN_PENDING"), "refused").otherwise("moved")
    j = r.join(rec, "record_id", "left").withColumn("_n", per_doc)
    claims = F.coalesce("_formed", F.lit(False))
    j = j.select("report_id", "record_id", "kind", "ts", "status", (F.col("reason") == "USER_REJECTED").alias("_user"), F.when(claims, F.col("_asked")).alias("_claim"), before.alias("_before"), after.alias("_after"))
    with tidied(spark):
        j = materialised(j, "reports")
    used = records.filter("tx is not null").select(_packed_tx(F.lower("tx")).alias("_used"), F.col("record_id").alias("_owner"))
    per_tx = F.row_number().over(Window.partitionBy("_claim").orderBy(F.asc_nulls_last("ts"), F.asc_nulls_last("report_id")))
    c = j.filter("_claim is not null").join(used, F.col("_claim") == F.col("_used"), "left").withColumn("_m", per_tx)
    taken = (F.col("_owner").isNotNull() & (F.col("_owner") != F.col("record_id"))) | (F.col("_m") > 1)
    c = c.withColumn("outcome", F.coalesce("_before", F.when(taken, "conflict"), "_after"))
    rest = j.filter("_claim is null").withColumn("outcome", F.coalesce("_before", "_after"))
    kept = ["report_id", "record_id", "kind", "status", "_user", "outcome"]
    j = c.select(*kept).unionByName(rest.select(*kept))
    moved = F.col("outcome") == "moved"
    why = F.when(moved & ~pending, F.when(F.col("_user"), "USER_REJECTED").otherwise("CLIENT_ERROR"))
    return j.select("report_id", "record_id", "outcome", F.when(moved & pending, "BLOCKCHAIN_PENDING").when(moved, "FAILED").otherwise(F.col("status")).alias("status"), why.alias("failure_reason"))


def bulk_lookup(keys: DataFrame, records: DataFrame) -> DataFrame:
    """keys (ask_id, raw) of any kind (uuid, 64 hex digits, 0x and 64) -> record_id and outcome found, not_found or bad_parameter."""
    kind = F.when(F.col("raw").rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), "uuid").when(F.col("raw").rlike("^[a-f0-9]{64}$"), "hash").when(F.col("raw").rlike("^0x[a-f0-9]{64}$"), "tx")
    table = records.select("record_id", F.explode(F.array(
        F.struct(F.lit("uuid").alias("kind"), F.col("uuid").alias("key")), F.struct(F.lit("hash").alias("kind"), F.col("sha256").alias("key")),
        F.struct(F.lit("hash").alias("kind"), F.col("content_hash").alias("key")), F.struct(F.lit("tx").alias("kind"), F.col("tx").alias("key")))).alias("k"))
    table = table.filter("k.key is not null").groupBy("k.kind", "k.key").agg(F.min("record_id").alias("record_id"))
    j = keys.withColumn("_asked", kind).join(table, (F.col("raw") == F.col("key")) & (F.col("_asked") == F.col("kind")), "left")
    return j.select("ask_id", "record_id", F.when(F.col("_asked").isNull(), "bad_parameter").when(F.col("record_id").isNull(), "not_found").otherwise("found").alias("outcome"))


def replay_registry(issuers: DataFrame, anchors: DataFrame, revokes: DataFrame) -> DataFrame:
    """The registry that the ledger's events make: content_hash, wallet, block, revoked, plus rejected anchors with their code.

    issuers (wallet, block, idx, listed), anchors (content_hash, wallet, block, idx), revokes (content_hash, wallet, block, idx).
    An anchor counts if its wallet was listed at that moment and the hash was not anchored before; a revoke counts if it comes
    from the anchoring wallet after the anchor. Removing an issuer keeps its documents valid.
    """
    # The few listings of a wallet become spans of time, so that its anchors, however many, needn't meet in one task.
    later = Window.partitionBy("wallet").orderBy("block", "idx", "listed")
    spans = issuers.withColumn("_end", F.lead(F.struct("block", "idx")).over(later)).filter("listed").select(F.col("wallet").alias("_issuer"), F.struct("block", "idx").alias("_begin"), "_end")
    at = F.struct("block", "idx")
    a = anchors.join(spans, (F.col("wallet") == F.col("_issuer")) & (at >= F.col("_begin")) & (F.col("_end").isNull() | (at < F.col("_end"))), "left")
    a = a.withColumn("ok", F.col("_issuer").isNotNull()).drop("_issuer", "_begin", "_end")
    first = Window.partitionBy("content_hash", "ok").orderBy("block", "idx", "wallet")
    a = a.withColumn("_n", F.row_number().over(first))
    code = F.when(~F.col("ok"), "NOT_AUTHORISED_ISSUER").when(F.col("_n") > 1, "ALREADY_ANCHORED")
    a = a.withColumn("code", code)
    r = revokes.select(F.col("content_hash").alias("_h"), F.col("wallet").alias("_w"), F.col("block").alias("_rb"), F.col("idx").alias("_ri"))
    hit = a.filter("code is null").join(r, (F.col("content_hash") == F.col("_h")) & (F.col("wallet") == F.col("_w")) & (F.struct("_rb", "_ri") > F.struct("block", "idx")))
    hit = hit.select("content_hash").distinct().withColumn("_revoked", F.lit(True))
    out = a.join(hit, "content_hash", "left")
    return out.select("content_hash", "wallet", "block", "idx", F.coalesce("code", F.lit("ANCHORED")).alias("code"), (F.col("code").isNull() & F.coalesce("_revoked", F.lit(False))).alias("revoked"))
