"""Verdicts from byte, content and visual evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Limits of the visual comparison in bits, and how many cells may stand out for a change to be local.
CELL_FAR, REGION_FAR, WHOLE_FAR, MAX_LOCAL_CELLS, REGION_STABLE_MAX = 12, 16, 8, 2, 12


def visual_advice(cells: DataFrame, regions: DataFrame, cell_far: int = CELL_FAR, region_far: int = REGION_FAR, max_cells: int = MAX_LOCAL_CELLS, stable_max: int = REGION_STABLE_MAX) -> DataFrame:
    """cells (capture_id, row, col, distance), regions (capture_id, region, distance, stability) -> one row a capture.

    kind: GLOBAL (more than max_cells cells over the limit), LOCALISED (some cell or judged region over it) or CLOSE. Regions
    whose stability is beyond stable_max are never judged (null is judged). advice: REVIEW, UNCLEAR, CONSISTENT for these.
    """
    far = F.col("distance") > cell_far
    place = F.concat_ws(":", F.col("row").cast("string"), F.col("col").cast("string"))
    c = cells.groupBy("capture_id").agg(F.count_if(far).cast("int").alias("far_cells"), F.array_join(F.array_sort(F.collect_list(F.when(far, place))), ",").alias("diverged"))
    shaky = F.coalesce(F.col("stability") > stable_max, F.lit(False))
    changed = ~shaky & (F.col("distance") > region_far)
    names = lambda w: F.array_join(F.array_sort(F.collect_list(F.when(w, F.col("region")))), ",")
    r = regions.groupBy("capture_id").agg(names(changed).alias("changed_regions"), names(shaky).alias("unreliable_regions"))
    j = c.join(r, "capture_id", "left")
    j = j.withColumn("changed_regions", F.coalesce("changed_regions", F.lit(""))).withColumn("unreliable_regions", F.coalesce("unreliable_regions", F.lit("")))
    kind = F.when(F.col("far_cells") > max_cells, "GLOBAL").when((F.col("far_cells") > 0) | (F.col("changed_regions") != ""), "LOCALISED").otherwise("CLOSE")
    j = j.withColumn("kind", kind)
    advice = F.when(F.col("kind") == "GLOBAL", "UNCLEAR").when(F.col("kind") == "LOCALISED", "REVIEW").otherwise("CONSISTENT")
    return j.select("capture_id", "far_cells", "diverged", "kind", "changed_regions", "unreliable_regions", advice.alias("advice"))


def verdicts(evidence: DataFrame) -> DataFrame:
    """evidence -> verdict, confidence, reason (a code) and reason_fields (the names that the reason is about, or empty), one row a capture.

    Columns read: qr_state (null, UNREADABLE, ELSEWHERE, DIFFERENT, SAME), readable, bytes_only (a kind of file that only its bytes
    can find), registered, revoked, byte_match, content_status (MATCH, MISMATCH, INCONCLUSIVE or null), content_confidence, changed,
    advice (or null), unreliable_regions, distance (or null), far_cells. A column that is missing counts as null.
    """
    read = ("qr_state", "readable", "bytes_only", "registered", "revoked", "byte_match", "content_status", "content_confidence", "changed", "advice", "unreliable_regions", "distance", "far_cells")
    c = {n: (F.col(n) if n in evidence.columns else F.lit(None)) for n in read}
    yes = lambda n: F.coalesce(c[n].cast("boolean"), F.lit(False))
    conf = F.coalesce(c["content_confidence"].cast("double"), F.lit(0.0))
    names = {n: F.coalesce(c[n].cast("string"), F.lit("")) for n in ("changed", "unreliable_regions")}
    out = lambda v, k, why, about=None: F.struct(F.lit(v).alias("verdict"), F.lit(k).alias("confidence"), F.lit(why).alias("reason"), (names[about] if about else F.lit("")).alias("reason_fields"))
    visual = F.coalesce(c["distance"].isNotNull(), F.lit(False)) | c["advice"].isNotNull()
    v = (
        F.when(c["qr_state"] == "ELSEWHERE", out("QR_MISMATCH", "HIGH", "CODE_OF_ANOTHER_REGISTRY"))
        .when(c["qr_state"] == "DIFFERENT", out("QR_MISMATCH", "HIGH", "CODE_OF_ANOTHER_DOCUMENT"))
        .when(c["qr_state"] == "UNREADABLE", out("INCONCLUSIVE", "LOW", "CODE_UNREADABLE"))
        .when(~F.coalesce(c["readable"].cast("boolean"), F.lit(True)) & ~yes("byte_match"), out("INCONCLUSIVE", "LOW", "DOCUMENT_UNREADABLE"))
        .when(~yes("registered") & yes("bytes_only"), out("NOT_REGISTERED", "HIGH", "FILE_NOT_ANCHORED"))
        .when(~yes("registered"), out("NOT_REGISTERED", "HIGH", "NO_ANCHOR"))
        .when(yes("revoked"), out("REVOKED", "HIGH", "ANCHOR_REVOKED"))
        .when(yes("byte_match"), out("AUTHENTIC_ORIGINAL", "HIGH", "SAME_BYTES"))
        .when(c["content_status"].isNull() | (c["content_status"] == "INCONCLUSIVE") | (conf < 0.8), out("INCONCLUSIVE", "LOW", "CONTENT_UNREADABLE"))
        .when((c["content_status"] == "MISMATCH") & (conf >= 0.9), out("TAMPERED_CONTENT", "HIGH", "FIELDS_DIFFER", "changed"))
        .when(c["content_status"] == "MISMATCH", out("TAMPERED_CONTENT", "MEDIUM", "FIELDS_DIFFER", "changed"))
        .when(~visual, out("INCONCLUSIVE", "LOW", "LOOKS_NOT_SEEN"))
        .when(c["advice"] == "REVIEW", out("TAMPERED_VISUAL", "MEDIUM", "REGION_CHANGED"))
        .when(c["advice"] == "UNCLEAR", out("INCONCLUSIVE", "LOW", "LOOKS_TOO_DIFFERENT"))
        .when(c["advice"].isNotNull(), out("AUTHENTIC_COPY", "MEDIUM", "NOTHING_STANDS_OUT", "unreliable_regions"))
        .when((c["distance"] > 10) | (c["far_cells"] > 0), out("TAMPERED_VISUAL", "MEDIUM", "LOOKS_CHANGED"))
        .when(c["distance"] <= 5, out("AUTHENTIC_COPY", "HIGH", "LOOKS_MATCH"))
        .otherwise(out("AUTHENTIC_COPY", "MEDIUM", "LOOKS_MATCH"))
    )
    made = ("verdict", "confidence", "reason", "reason_fields")
    keep = [x for x in evidence.columns if x not in made]
    return evidence.select("*", v.alias("_v")).select(*keep, *[f"_v.{m}" for m in made])


# What each verdict is in the audit log.
AUDIT_OF = (
    ("AUTHENTIC_ORIGINAL", "SUCCESS", "MATCH"), ("AUTHENTIC_COPY", "SUCCESS", "MATCH"), ("NOT_REGISTERED", "FAILED", "NO_MATCH"), ("REVOKED", "FAILED", "REVOKED"),
    ("TAMPERED_CONTENT", "FAILED", "TAMPERED_CONTENT"), ("TAMPERED_VISUAL", "FAILED", "TAMPERED_VISUAL"), ("INCONCLUSIVE", "FAILED", "INCONCLUSIVE"), ("QR_MISMATCH", "FAILED", "QR_MISMATCH"),
)


def audit_events(decided: DataFrame) -> DataFrame:
    """outcome and reason of each verdict; an unknown verdict counts as inconclusive."""
    m = F.broadcast(decided.sparkSession.createDataFrame(list(AUDIT_OF), "verdict string, outcome string, reason string"))
    j = decided.drop("outcome", "reason").join(m, "verdict", "left")
    return j.withColumn("outcome", F.coalesce("outcome", F.lit("FAILED"))).withColumn("reason", F.coalesce("reason", F.lit("INCONCLUSIVE"))).withColumn("action", F.lit("VERIFY"))
