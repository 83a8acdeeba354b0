"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, written

#: Weights of the sources in code-point order of their names, repeating.
CYCLE = (5, 2, 1)
#: Key ranges to a doubling of the key. A key is exponential at the rate of its weight, so whatever the weights are, of one weight at most
#: 0.4 % of a source fall in one range, and at most some 4,300 ranges are in use. Their sums, not the documents, are ordered by one task.
RANGES = 64


def uniform(doc_id: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on doc_id and seed alone: 48 bits of an MD5 digest."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f":{seed}")))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(2**48)


def source_targets(sizes: DataFrame, share: float, cap: float, cycle: tuple[int, ...] = CYCLE) -> DataFrame:
    """``sizes(source, source_size)``, one row a source -> the same with ``target``.

    Targets are in proportion to the weights, stop at cap * source_size, and the excess is shared again by weight
    until none is above. The fixed point is target = min(cap * size, weight * level): going through the sources by
    rising cap / weight, the level is what is left over the weights that are left, and the first source whose own
    cap exceeds that level ends the search.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (rank % len(cycle) + 1).cast("int"))
    s = sizes.withColumn("weight", weight).withColumn("limit", F.lit(float(cap)) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), "source")
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    level = (F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    s = s.withColumn("level", level).withColumn("level", F.when(F.col("level") <= F.col("limit") / F.col("weight"), F.col("level")))
    s = s.withColumn("level", F.max("level").over(everything))
    target = F.least(F.col("limit"), F.coalesce(F.col("weight") * F.col("level"), F.col("limit")))
    return s.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: DataFrame | None = None, share: float = 1.5, cap: float = 2.0, seed: int = 0) -> DataFrame:
    """Choose how often each document is taken: adds size, source_size, target, copies and taken.

    docs: doc_id, text, source and any other columns, which are kept (those named like an added column are replaced).
    weights: doc_id and weight > 0 (a document without a row weighs 1; of several rows the mean counts).
    A source's target holds ``floor(target / source_size)`` complete epochs of all its documents. The rest is sampled
    without replacement: documents in falling order of u^(1/weight) (Efraimidis-Spirakis; equivalently rising
    -ln(u)/weight, the key), as long as the middle of the document lies within the rest, so that the sum ends within half a
    document of the budget. Keys come from doc_id and the seed, so reruns agree.
    Whole texts count, however long. Null text: size 0. Null source: a source of its own, last. Empty table: empty result. Rows with equal doc_id have
    equal keys; those that are also of equal size are taken or left together.
    """
    added = {"size", "source_size", "target", "copies", "taken"}
    kept = [c for c in docs.columns if c not in added]
    names = [f"c{i}" for i in range(len(kept))]
    text, doc_id, source = (F.col(names[kept.index(c)]) for c in ("text", "doc_id", "source"))
    d = docs.select(*[F.col(c).alias(n) for c, n in zip(kept, names)])
    d = d.withColumns({"size": F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long"), "source": source, "_u": uniform(doc_id, seed)})
    range_of = lambda w: F.floor(F.log2(-F.log("_u") / w) * RANGES).cast("int")
    light = heavy = 1.0
    if weights is not None:
        w = weights.groupBy(F.col("doc_id").alias("_wid")).agg(F.avg("weight").alias("_w"))
        light, heavy = w.agg(F.least(F.min("_w"), F.lit(1.0)), F.greatest(F.max("_w"), F.lit(1.0))).first()

    def keyed(rows: DataFrame) -> DataFrame:
        if weights is None:
            rows = rows.withColumn("_w", F.lit(1.0))
        else:
            rows = rows.join(w, doc_id == F.col("_wid"), "left").drop("_wid").withColumn("_w", F.coalesce("_w", F.lit(1.0)))
        rows = rows.withColumn("_b", range_of(F.col("_w")))
        place = F.struct((-F.log("_u") / F.col("_w")).alias("k"), F.coalesce(doc_id.cast("long"), F.lit(-(2**63))).alias("id"), F.col("size").alias("n"))
        return rows.withColumn("_place", place).drop("_w")

    # Sums per source and key range come first, so no task sees a hot source's documents together.
    slim, _ = written(keyed(d).select("source", "size", "_b", "_place"), "mix-keys")
    sums = slim.groupBy("source", "_b").agg(F.sum("size").alias("n"))
    sums, _ = written(sums, "mix-sums")
    goal = source_targets(sums.groupBy("source").agg(F.sum("n").alias("source_size")), share, cap)
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(1).cast("long"))
    goal = goal.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")).withColumnRenamed("source", "_gsrc")
    upto = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    edge = sums.withColumn("done", F.sum("n").over(upto)).join(goal, F.col("source").eqNullSafe(F.col("_gsrc"))).filter(F.col("done") > F.col("rest"))
    edge = edge.groupBy("_gsrc", "source_size", "target", "epochs", "rest").agg(F.min(F.struct("_b", (F.col("done") - F.col("n")).alias("before"))).alias("e"))
    edge, _ = written(edge.select(F.col("_gsrc").alias("_esrc"), F.col("e._b").alias("_eb"), F.col("e.before").alias("_before"), F.col("rest").alias("_rest")), "mix-edges")

    # Only the one key range of a source in which its budget ends is ordered document by document.
    inner = Window.partitionBy("source").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    tight = slim.join(edge, F.col("source").eqNullSafe(F.col("_esrc")) & (F.col("_b") == F.col("_eb")))
    tight = tight.withColumn("_pos", F.col("_before") + F.coalesce(F.sum("size").over(inner), F.lit(0)))
    last = tight.filter(F.col("_pos") + F.col("size") / 2 <= F.col("_rest")).groupBy("source").agg(F.max("_place").alias("_last"))
    last = last.withColumnRenamed("source", "_lsrc")
    plan = goal.join(edge.select("_esrc", "_eb"), F.col("_gsrc").eqNullSafe(F.col("_esrc")), "left").join(last, F.col("_gsrc").eqNullSafe(F.col("_lsrc")), "left")
    plan, _ = written(plan.select("_gsrc", "source_size", "target", "epochs", "_eb", "_last"), "mix-plan")

    # Most documents are taken or left whatever their weight is, so only the others' texts move to meet their weights.
    j = d.join(plan, F.col("source").eqNullSafe(F.col("_gsrc")))
    taken = F.coalesce(range_of(F.lit(light)) < F.col("_eb"), F.lit(False))
    left = F.coalesce(F.col("_eb").isNull() | (range_of(F.lit(heavy)) > F.col("_eb")), F.lit(False))
    chosen = (F.col("_b") < F.col("_eb")) | ((F.col("_b") == F.col("_eb")) & (F.col("_place") <= F.col("_last")))
    out = [*names, "size", "source_size", "target", "epochs"]
    sure = j.filter(taken | left).select(*out, taken.cast("int").alias("_more"))
    rest = keyed(j.filter(~(taken | left))).select(*out, F.when(chosen, 1).otherwise(0).alias("_more"))
    j = sure.unionByName(rest)
    copies = F.col("epochs") + F.col("_more")
    return j.select(*[F.col(n).alias(c) for c, n in zip(kept, names)], "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def apply_mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed documents themselves: each row as often as the mix takes it, with the columns of docs."""
    mixed = mix(docs.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(docs.columns)], "doc_id", "text", "source"), **how)
    mixed = mixed.filter("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return mixed.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)])
