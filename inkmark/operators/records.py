"""Field records: canonical form, hashes, differences. Tables in, tables out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkmark.functions.text import iso_of, month_number, nfkc, norm, norm_id, value_of

REQUIRED = ("docType", "issuer", "holder", "idNumber", "issuedOn")
TAG, LOOKUP_TAG = "inkmark:content:v1\n", "inkmark:lookup:v1\n"


def canonical_records(records: DataFrame, unicode_form: bool = False) -> DataFrame:
    """records: REQUIRED columns and payload (map) -> the same in canonical form, other columns kept; problems (array).

    A row with problems (required fields that are missing or whose date can't be read) has a null payload and no hash.
    unicode_form: apply NFKC first, in Python; leave it off for ASCII tables.
    """
    form = nfkc if unicode_form else (lambda c: c)
    rest = [c for c in records.columns if c not in (*REQUIRED, "payload")]
    own = next(x for x in ("_" * i for i in range(1, 99)) if not any(c.startswith(x) for c in rest))
    n = {c: F.col(f"{own}{c}") for c in (*REQUIRED, "payload", "issued")}
    # Normalised texts are columns first, as everything below reads them several times.
    entries = F.map_entries(F.coalesce("payload", F.create_map().cast("map<string,string>")))
    pairs = F.transform(entries, lambda e: F.struct(F.lower(norm(e["key"])).alias("key"), norm(e["value"]).alias("value")))
    r = records.select(*rest, *[(norm_id if c == "idNumber" else norm)(form(F.col(c).cast("string"))).alias(f"{own}{c}") for c in REQUIRED], pairs.alias(f"{own}payload"))
    filled = F.filter(n["payload"], lambda e: (e["key"] != "") & (F.coalesce(e["value"], F.lit("")) != ""))
    named = F.transform(filled, lambda e: F.struct(e["key"].alias("key"), value_of(e["value"]).alias("value")))
    r = r.withColumn(f"{own}payload", named).withColumn(f"{own}issued", iso_of(n["issuedOn"]))
    missing = F.array_compact(F.array(*[F.when(F.coalesce(n[c], F.lit("")) == "", F.lit(c)) for c in REQUIRED]))
    bad_date = F.when((F.size(missing) == 0) & n["issued"].isNull(), F.array(F.lit("issuedOn"))).otherwise(F.array().cast("array<string>"))
    # The last of two keys that become equal wins.
    last = F.filter(n["payload"], lambda e, i: ~F.exists(F.slice(n["payload"], i + 2, F.size(n["payload"])), lambda o: o["key"] == e["key"])) if unicode_form else n["payload"]
    out = r.select(*rest, *[n[c].alias(c) for c in REQUIRED[:-1]], n["issued"].alias("issuedOn"), F.map_from_entries(F.array_sort(last)).alias("payload"), F.concat(missing, bad_date).alias("problems"))
    return out.withColumn("payload", F.when(F.size("problems") == 0, F.col("payload")))


def content_hash(canonical: DataFrame, tag: str = TAG, name: str = "content_hash") -> DataFrame:
    """SHA-256 of the tag and the record as JSON with sorted keys; null for rows with problems."""
    body = F.to_json(F.struct("docType", "holder", "idNumber", "issuedOn", "issuer", "payload"))
    return canonical.withColumn(name, F.when(F.col("payload").isNotNull(), F.sha2(F.concat(F.lit(tag), body), 256)))


def lookup_key(canonical: DataFrame, tag: str = LOOKUP_TAG, name: str = "lookup_key") -> DataFrame:
    """A hash of issuer, type and id, which stays the same when other fields are altered."""
    return canonical.withColumn(name, F.sha2(F.concat(F.lit(tag), F.concat_ws("|", "issuer", "docType", "idNumber")), 256))


def flatten_record(canonical: DataFrame, key: str) -> DataFrame:
    """(key, field, value) per field; payload fields are named payload.<key>."""
    top = F.map_from_arrays(F.array(*[F.lit(c) for c in REQUIRED]), F.array(*REQUIRED))
    extra = F.transform_keys(F.coalesce("payload", F.create_map().cast("map<string,string>")), lambda k, _: F.concat(F.lit("payload."), k))
    return canonical.select(key, F.explode(F.map_concat(top, extra)).alias("field", "value")).filter(F.col("value").isNotNull())


def diff_records(anchored: DataFrame, presented: DataFrame, key: str) -> DataFrame:
    """(key, field, anchored, presented) for every field that differs between two flat tables; a missing side is null."""
    a, p = anchored.withColumnRenamed("value", "anchored"), presented.withColumnRenamed("value", "presented")
    return a.join(p, [key, "field"], "full").filter(~F.col("anchored").eqNullSafe(F.col("presented"))).select(key, "field", "anchored", "presented")


# Characters that stand for digits in typed ids.
CONFUSED = ("OoQDIli|ZzSsGTBgq", "00001111225567899")


def typed_schema(spark, schemas: dict[str, dict[str, str]]) -> DataFrame:
    """A table of fields from {document schema: {field: type}}; a type that ends in ? is of a field that may be absent."""
    rows = [(doc, f, t.rstrip("?"), not t.endswith("?")) for doc, fields in schemas.items() for f, t in fields.items()]
    return spark.createDataFrame(rows, "doc_schema string, field string, type string, required boolean")


def date_parts(s: Column) -> Column:
    """The three parts of a date: split at ``-/. ``, or eight digits cut after four and six."""
    eight = F.array(F.substring(s, 1, 4), F.substring(s, 5, 2), F.substring(s, 7, 2))
    return F.when(s.rlike(r"^\d{8}$"), eight).otherwise(F.split(s, "[-/. ]"))


def typed_date(parts: Column) -> Column:
    """yyyy-MM-dd of year, month and day (or day, month or its name, and year; or eight digits), of which month and day are in range."""
    first = F.length(parts[0]) == 4
    year, day = F.when(first, parts[0]).otherwise(F.get(parts, F.lit(2))), F.when(first, F.get(parts, F.lit(2))).otherwise(parts[0])
    middle = F.get(parts, F.lit(1))
    month = F.when(middle.rlike(r"^\d{1,2}$"), middle.try_cast("int")).when(~first & middle.rlike("^[A-Z]{3,}$"), month_number(middle).cast("int"))
    real = (F.size(parts) == 3) & year.rlike(r"^\d{4}$") & day.rlike(r"^\d{1,2}$") & month.between(1, 12) & day.try_cast("int").between(1, 31)
    return F.when(real, F.concat_ws("-", year, F.lpad(month.cast("string"), 2, "0"), F.lpad(day, 2, "0")))


def typed_forms(value: Column) -> dict[str, Column]:
    """What the types read of a value: ``base`` (zero-width characters left out, white space made one space, upper case) and ``alnum``."""
    base = F.upper(F.trim(F.regexp_replace(F.regexp_replace(value, r"[\x{200B}-\x{200D}\x{FEFF}]", ""), r"\s+", " ")))
    bare = F.regexp_replace(value, r"[\x{200B}-\x{200D}\x{FEFF}\s\-/.]", "")
    return {"base": base, "alnum": F.regexp_replace(F.upper(F.translate(bare, *CONFUSED)), "[^A-Z0-9]", "")}


def typed_of(base: Column, alnum: Column, parts: Column, kind: Column) -> Column:
    """A value in the form of its type, from its ``typed_forms`` and ``date_parts``: text, alnum, numeric or date; null for a date that can't be read."""
    kept = lambda c, what: F.regexp_replace(c, f"[^{what}]", "")
    text = F.trim(F.regexp_replace(kept(base, "A-Z0-9 "), " +", " "))
    return F.when(kind == "alnum", alnum).when(kind == "numeric", kept(alnum, "0-9")).when(kind == "date", typed_date(parts)).otherwise(text)


def typed_value(value: Column, kind: Column) -> Column:
    forms = typed_forms(value)
    return typed_of(forms["base"], forms["alnum"], date_parts(forms["base"]), kind)


def typed_canonical_hash(fields: DataFrame, schema: DataFrame, min_confidence: float = 0.75) -> DataFrame:
    """fields: doc_id, doc_schema, field, value, confidence -> one row a document with its length-delimited string hashed.

    missing, low_confidence, unparsable: field names, joined by commas in order; a document with missing required fields
    has no hash; confident: nothing is of low confidence or unparsable. Fields outside the schema are left out.
    """
    docs = fields.select("doc_id", "doc_schema").distinct()
    slots = docs.join(F.broadcast(schema), "doc_schema").join(fields.select("doc_id", "field", "value", "confidence"), ["doc_id", "field"], "left")
    # Columns of their own, one on the other, so that no part of the date is spelled out again where it is read.
    s = slots.withColumn("blank", F.col("value").isNull() | (F.trim(F.col("value")) == "")).withColumns(typed_forms(F.col("value")))
    s = s.withColumn("parts", date_parts(F.col("base"))).withColumn("typed", F.when(F.col("blank"), "").otherwise(typed_of(F.col("base"), F.col("alnum"), F.col("parts"), F.col("type"))))
    blank = F.col("blank")
    text = F.coalesce("typed", F.lit(""))
    part = F.concat(F.length("field").cast("string"), F.lit(":"), F.col("field"), F.lit("="), F.length(text).cast("string"), F.lit(":"), text, F.lit(";"))
    names = lambda when: F.array_join(F.array_sort(F.collect_list(F.when(when, F.col("field")))), ",")
    agg = s.groupBy("doc_id", "doc_schema").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("field", part.alias("part")))), lambda x: x["part"]), "").alias("canonical"),
        names(blank & F.col("required")).alias("missing"),
        names(~blank & (F.col("confidence") < min_confidence)).alias("low_confidence"),
        names(F.col("typed").isNull()).alias("unparsable"),
    )
    ok = F.col("missing") == ""
    return agg.select("doc_id", "doc_schema", "missing", "low_confidence", "unparsable", (ok & (F.col("low_confidence") == "") & (F.col("unparsable") == "")).alias("confident"), F.when(ok, F.concat(F.lit("0x"), F.sha2("canonical", 256))).alias("content_hash"))
