"""Lines of text to fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkmark.functions.text import norm, repair_id
from inkmark.sources.shared import materialised

MIN_CONFIDENCE = 75.0


def label_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def split_labelled_lines(lines: DataFrame) -> DataFrame:
    """lines (text and others) with label and value: what stands before and after the first : or ; that isn't the first character."""
    text = F.trim(F.regexp_replace("text", r"^\s+|\s+$", ""))
    shape = r"(?s)^([^:;]+)[:;](.*)$"
    return lines.filter(text.rlike(shape)).withColumns({"label": F.regexp_extract(text, shape, 1), "value": F.trim(F.regexp_replace(F.regexp_extract(text, shape, 2), r"^\s+|\s+$", ""))})


def match_labels(printed: DataFrame, dictionary: DataFrame, column: str = "label") -> DataFrame:
    """printed with field: the dictionary entry (field, label, ord) nearest to it, or null.

    One slip is forgiven in labels of six characters or more; the nearest wins, then the first entry. The dictionary is a
    template of a few labels, so the comparison with each of them is a broadcast; only distinct printed labels take part.
    """
    want = F.broadcast(dictionary.select(F.col("field").alias("_field"), label_key(F.col("label")).alias("_want"), F.col("ord").alias("_ord")))
    keys = printed.select(label_key(F.col(column)).alias("_key")).filter("_key <> ''").distinct()
    far = F.levenshtein(F.col("_key"), F.col("_want"))
    near = keys.join(want, far <= F.when(F.length("_want") >= 6, 1).otherwise(0)).groupBy("_key").agg(F.min_by("_field", F.struct(far, "_ord")).alias("field"))
    return printed.withColumn("_key", label_key(F.col(column))).join(near, "_key", "left").drop("_key")


def extract_fields(lines: DataFrame, dictionary: DataFrame, min_confidence: float = MIN_CONFIDENCE, strict: bool = True) -> DataFrame:
    """lines (doc_id, line_no, text, confidence: of its weakest word) -> doc_id, field, value, confidence, problem.

    One row per template field of every document and per unknown labelled line (payload.<label>). problem: missing,
    ambiguous (different values), unreadable (no value), low_confidence (template fields only if strict), or null.
    dictionary: field, label, ord, id_format (or null).
    """
    parts = match_labels(split_labelled_lines(lines), dictionary)
    mask = F.broadcast(dictionary.filter("id_format is not null").select("field", "id_format").distinct())
    known = F.col("field").isNotNull()
    named = parts.withColumn("known", known).withColumn("field", F.coalesce("field", F.concat(F.lit("payload."), label_key(F.col("label")))))
    named = named.filter(F.col("known") | ((F.col("field") != "payload.") & (F.col("value") != ""))).join(mask, "field", "left")
    named = named.withColumn("value", F.when(F.col("id_format").isNotNull(), repair_id(F.col("value"), F.col("id_format"))).otherwise(F.col("value")))
    g = named.groupBy("doc_id", "field").agg(F.count_distinct(norm(F.col("value"))).alias("values"), F.min("confidence").alias("confidence"), F.min_by("value", F.struct("confidence", "line_no")).alias("value"), F.first("known").alias("known"))
    slots = lines.select("doc_id").distinct().crossJoin(F.broadcast(dictionary.select("field").distinct()))
    j = slots.join(g.filter("known").drop("known"), ["doc_id", "field"], "left").withColumn("known", F.lit(True)).unionByName(g.filter("not known"))
    weak = F.col("confidence") < min_confidence
    problem = F.when(F.col("values").isNull(), "missing").when(F.col("values") > 1, "ambiguous").when(F.col("value") == "", "unreadable").when(weak & (~F.col("known") | F.lit(strict)), "low_confidence")
    j = j.withColumn("problem", problem)
    return j.select("doc_id", "field", F.when(F.col("problem").isNull(), F.col("value")).alias("value"), "confidence", "problem")


def extract_by_patterns(texts: DataFrame, patterns: dict[str, list[str]], column: str = "text") -> DataFrame:
    """texts with a column per field: the first group of the first of its patterns that finds one."""
    found = lambda ps: F.coalesce(*[F.nullif(F.trim(F.regexp_extract(column, p, 1)), F.lit("")) for p in ps])
    return texts.select("*", *[found(ps).alias(name) for name, ps in patterns.items()])


def vote_readings(readings: DataFrame, order: str = "seq") -> DataFrame:
    """readings (doc_id, field, seq, text, confidence) -> text, votes, agreement, confidence of the winner of each field.

    Readings are grouped by upper-case text with single spaces; most votes win, then the highest mean confidence, then the first. The last bits of a sum
    of doubles depend on the order of its terms, so means that are equal but for these are taken again from the terms in the order of
    ``order``: how rows are dealt to tasks decides nothing. Empty readings, and those without a document or field, count in the total alone.
    """
    ids = ["doc_id", "field", "key"]
    r = readings.withColumn("key", F.when((F.col("text") != "") & F.col("doc_id").isNotNull() & F.col("field").isNotNull(), norm(F.col("text"))))
    g = r.groupBy(*ids).agg(F.count(F.lit(1)).alias("votes"), F.avg("confidence").alias("mean"), F.min("seq").alias("first"), F.min_by("text", "seq").alias("text"))
    # The sum of two doesn't depend on their order. Means that lie close together share a step of one of the two scales. Few are left; if they are
    # few by the size of what is written, they are broadcast.
    steps = F.posexplode(F.array(F.floor(F.col("mean") * 1e9), F.floor(F.col("mean") * 1e9 + 0.5))).alias("scale", "step")
    near = g.filter("key is not null and votes > 2").select(*ids, "votes", steps)
    near = near.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("doc_id", "field", "votes", "scale", "step"))).filter("_n > 1").select(*ids).distinct()
    upto = Window.partitionBy(*ids).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    summed = r.select(*ids, order, "confidence").join(materialised(near, "near-means"), ids).withColumn("_mean", F.sum("confidence").over(upto) / F.count("confidence").over(upto))
    g = g.join(summed.groupBy(*ids).agg(F.max_by("_mean", order).alias("_mean")), ids, "left").withColumn("mean", F.coalesce("_mean", "mean"))
    read = lambda c: F.when(F.col("key").isNotNull(), c)
    best = g.groupBy("doc_id", "field").agg(F.sum("votes").alias("total"), F.max_by(F.struct("text", "votes", "mean"), read(F.struct("votes", "mean", -F.col("first")))).alias("w"))
    agreement = F.coalesce(F.col("w.votes") / F.col("total"), F.lit(0.0))
    return best.select("doc_id", "field", F.coalesce("w.text", F.lit("")).alias("text"), F.coalesce("w.votes", F.lit(0)).alias("votes"), agreement.alias("agreement"), F.coalesce(F.least(F.lit(1.0), F.col("w.mean") * (0.6 + 0.4 * agreement)), F.lit(0.0)).alias("confidence"))


def fill_gaps(entered: DataFrame, read: DataFrame, required: list[str], key: str = "doc_id") -> DataFrame:
    """Entered values win; blank required ones are taken from the reading; filled names the fields taken; outcome is refused if
    gaps remain. Payload maps are merged, entered values first."""
    r = read.select(key, *[F.col(c).alias(f"_r_{c}") for c in required], F.col("payload").alias("_r_payload"))
    j = entered.join(r, key, "left")
    own = {c: F.nullif(F.trim(F.col(c)), F.lit("")) for c in required}
    got = {c: F.nullif(F.trim(F.col(f"_r_{c}")), F.lit("")) for c in required}
    filled = F.array_join(F.array_compact(F.array(*[F.when(own[c].isNull() & got[c].isNotNull(), F.lit(c)) for c in required])), ",")
    gaps = F.array_join(F.array_compact(F.array(*[F.when(F.coalesce(own[c], got[c]).isNull(), F.lit(c)) for c in required])), ",")
    none = F.create_map().cast("map<string,string>")
    payload = F.map_zip_with(F.coalesce("_r_payload", none), F.coalesce("payload", none), lambda k, a, b: F.coalesce(b, a))
    return j.select(key, *[F.coalesce(own[c], got[c]).alias(c) for c in required], payload.alias("payload"), filled.alias("filled"), gaps.alias("gaps"), F.when(gaps == "", "ok").otherwise("refused").alias("outcome"))
