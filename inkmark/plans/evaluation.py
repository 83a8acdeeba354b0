"""Evaluation against labels, calibration, and numeric summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkmark.operators import metrics as G

from .base import query, table

JUDGED = "j as (select l.doc_id, l.quality, l.toxic, case when d.n_chars > 300 then 1 else 0 end as guess from labels l join documents d on d.doc_id = l.doc_id)"


@query(f"with {JUDGED} select quality, count(*) filter (guess = 0) as n_0, count(*) filter (guess = 1) as n_1, count(*) filter (quality = guess) as ok, count(*) as total from j group by quality")
def confusion_matrix(spark, d):
    j = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").withColumn("guess", F.when(F.col("n_chars") > 300, 1).otherwise(0))
    return G.confusion_matrix(j, "quality", "guess", [0, 1])


@query("""with o as (select o_orderkey as sample_id, o_orderstatus as v, o_custkey as c from orders)
  select sample_id, v = case when c % 9 = 0 then 'X' else v end as verdict_ok, c % 4 <> 0 or sample_id % 2 = 0 as fields_ok, c % 5 <> 0 as values_ok, c % 3 <> 0 as regions_ok from o""")
def evaluate_samples(spark, d):
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    s = lambda *x: F.array(*[F.lit(v) for v in x])
    o = table(spark, d, "orders")
    expected = o.select(k.alias("sample_id"), F.col("o_orderstatus").alias("verdict"), F.when(k % 2 == 0, s("a", "b")).otherwise(s("a")).alias("fields"), s("r1").alias("regions"), F.create_map(F.lit("a"), F.col("o_orderpriority")).alias("values"))
    actual = o.select(k.alias("sample_id"), F.when(c % 9 == 0, "X").otherwise(F.col("o_orderstatus")).alias("verdict"), F.when(k % 2 == 0, s("b", "a")).when(c % 4 == 0, s("b")).otherwise(s("a")).alias("fields"), F.when(c % 3 == 0, s("r2")).otherwise(s("r1", "r2")).alias("regions"), F.when(c % 5 != 0, F.create_map(F.lit("b"), F.lit("x"), F.lit("a"), F.col("o_orderpriority"))).otherwise(F.create_map(F.lit("a"), F.lit("misread"))).alias("values"))
    return G.evaluate_samples(expected, actual)


CASES = "k as (select case when l_returnflag = 'R' then 'swap' else 'recapture' end as kind, (case when l_returnflag = 'R' then 9 + l_quantity % 14 else l_quantity % 11 end)::int as cell, (case when l_returnflag = 'R' then 14 + l_linenumber * 3 else l_linenumber end)::int as region, (l_quantity % 17)::int as second, (l_linenumber * 4)::int as third from lineitem)"


def cases(spark, d):
    r, q, n = F.col("l_returnflag") == "R", F.col("l_quantity"), F.col("l_linenumber")
    return table(spark, d, "lineitem").select(F.when(r, "swap").otherwise("recapture").alias("kind"), F.when(r, 9 + q % 14).otherwise(q % 11).cast("int").alias("cell"), F.when(r, 14 + n * 3).otherwise(n).cast("int").alias("region"), (q % 17).cast("int").alias("second"), (n * 4).cast("int").alias("third"))


# The limits that are searched.
CELL_FAR, REGION_FAR, MAX_CELLS = (8, 10, 12, 14, 16, 20, 24, 28), (8, 10, 12, 14, 16, 18, 20), (1, 2, 3)


@query(f"""with {CASES}, g as (select a as cell_far, b as region_far, c as max_cells from (select unnest({list(CELL_FAR)}) a), (select unnest({list(REGION_FAR)}) b), (select unnest({list(MAX_CELLS)}) c)),
  f as (select kind, region, region_far, cell_far, max_cells, (cell > cell_far)::int + (second > cell_far)::int + (third > cell_far)::int as far from k, g),
  s as (select cell_far, region_far, max_cells, count(*) filter (kind = 'recapture' and far <= max_cells and (far > 0 or region > region_far)) as false_review, count(*) filter (kind = 'swap' and far <= max_cells and (far > 0 or region > region_far)) as caught from f group by 1, 2, 3)
  select *, row_number() over (order by false_review, caught desc, region_far desc, cell_far desc, max_cells)::int as rank from s""")
def threshold_search(spark, d):
    grid = G.threshold_grid(spark, CELL_FAR, REGION_FAR, MAX_CELLS)
    return G.threshold_search(cases(spark, d).select("kind", F.array("cell", "second", "third").alias("cells"), "region"), grid)


@query(f"with {CASES} select kind, min(cell) as min_cell, max(cell) as max_cell, min(region) as min_region, max(region) as max_region, count(*) filter (cell > 12) as far from k group by kind")
def calibration_summary(spark, d):
    return cases(spark, d).groupBy("kind").agg(F.min("cell").alias("min_cell"), F.max("cell").alias("max_cell"), F.min("region").alias("min_region"), F.max("region").alias("max_region"), F.count_if(F.col("cell") > 12).alias("far"))


@query("""with r as (select case when l_suppkey % 4 = 0 then 'extreme' else 'supported' end as kind, case when l_quantity > 48 then 'INCONCLUSIVE' when l_quantity < 2 then 'FALSE_ALARM' else 'MATCH' end as outcome from lineitem)
  select kind, count(*) filter (outcome = 'MATCH') as matches, count(*) filter (outcome = 'INCONCLUSIVE') as inconclusive, count(*) filter (outcome = 'FALSE_ALARM') as false_alarms, bool_and(outcome <> 'FALSE_ALARM' and (kind = 'extreme' or outcome = 'MATCH')) as pass from r group by kind""")
def robustness_report(spark, d):
    """Outcomes per kind of degradation; a kind passes without a false alarm, and if supported only with matches."""
    q = F.col("l_quantity")
    r = table(spark, d, "lineitem").select(F.when(F.col("l_suppkey") % 4 == 0, "extreme").otherwise("supported").alias("kind"), F.when(q > 48, "INCONCLUSIVE").when(q < 2, "FALSE_ALARM").otherwise("MATCH").alias("outcome"))
    n = lambda v: F.count_if(F.col("outcome") == v)
    return r.groupBy("kind").agg(n("MATCH").alias("matches"), n("INCONCLUSIVE").alias("inconclusive"), n("FALSE_ALARM").alias("false_alarms"), F.bool_and((F.col("outcome") != "FALSE_ALARM") & ((F.col("kind") == "extreme") | (F.col("outcome") == "MATCH"))).alias("pass"))


@query("select l_suppkey, stddev_pop(l_quantity) < 14.2 as flat from lineitem group by l_suppkey")
def flat_filter(spark, d):
    """Groups whose values hardly vary have nothing to hash."""
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg((F.stddev_pop("l_quantity") < 14.2).alias("flat"))


@query("""with h as (select l_suppkey, l_quantity::bigint as v, count(*) as n from lineitem group by 1, 2),
  w as (select *, sum(n) over (partition by l_suppkey order by v) as w0, sum(n * v) over (partition by l_suppkey order by v) as s0, sum(n) over (partition by l_suppkey) as w, sum(n * v) over (partition by l_suppkey) as s from h),
  b as (select l_suppkey, v, case when w > w0 then w0 * (w - w0) * (s0::double / w0 - (s - s0)::double / (w - w0)) * (s0::double / w0 - (s - s0)::double / (w - w0)) end as b from w)
  select l_suppkey, coalesce((select min(v) from b x where x.l_suppkey = y.l_suppkey and x.b >= y.m * (1 - 1e-12) and y.m > 0), 128) as threshold from (select l_suppkey, max(b) as m from b group by 1) y""")
def best_split(spark, d):
    return G.best_split(table(spark, d, "lineitem").select("l_suppkey", F.rint("l_quantity").alias("l_quantity")), "l_suppkey", "l_quantity")


@query("""with h as (select l_suppkey as g, l_quantity as v, count(*) as n from lineitem group by 1, 2),
  c as (select *, sum(n) over (partition by g order by v) as lo, sum(n) over (partition by g order by v desc) as hi, sum(n) over (partition by g) as w from h),
  b as (select g, min(case when lo > 0.01 * w then v end) as low, max(case when hi > 0.01 * w then v end) as high from c group by g)
  select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when high - low < 20 then l_quantity else least(255, greatest(0, floor((l_quantity - low) * 255 / (high - low) + 0.5))) end as stretched from lineitem join b on g = l_suppkey""")
def percentile_stretch(spark, d):
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return G.percentile_stretch(l, "l_suppkey", "l_quantity").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "stretched")


@query("""with c as (select l_suppkey as g, l_partkey % 60 as x, l_orderkey % 60 as y from lineitem where l_quantity < 10),
  xs as (select g, min(x) as x0, max(x) as x1 from (select g, x from c group by 1, 2 having count(*) >= 3) group by g), ys as (select g, min(y) as y0, max(y) as y1 from (select g, y from c group by 1, 2 having count(*) >= 3) group by g),
  j as (select s.g, x0, x1, y0, y1, coalesce(x1 > x0 and y1 > y0, false) as found, floor((x1 - x0 + 1) * 0.02::double + 0.5)::bigint as px, floor((y1 - y0 + 1) * 0.02::double + 0.5)::bigint as py from (select distinct l_suppkey as g from lineitem) s left join xs using (g) left join ys using (g))
  select g as l_suppkey, case when found then greatest(0, x0 - px) else 0 end as x0, case when found then least(59, x1 + px) else 59 end as x1, case when found then greatest(0, y0 - py) else 0 end as y0, case when found then least(59, y1 + py) else 59 end as y1 from j""")
def content_bounds(spark, d):
    c = table(spark, d, "lineitem").select("l_suppkey", (F.col("l_partkey") % 60).alias("x"), (F.col("l_orderkey") % 60).alias("y"), F.col("l_quantity").alias("v"))
    return G.content_bounds(c, "l_suppkey", 60, 60, dark=10, need=3)


@query("""with r as (select user_id, event_id, row_number() over (partition by user_id order by event_id) as pos, value from events), i as (select *, pos - row_number() over (partition by user_id order by pos) as g from r where value > 20)
  select user_id, min(pos)::int as start, max(pos)::int as "end", count(*) as length from i group by user_id, g""")
def value_runs(spark, d):
    from pyspark.sql import Window

    e = table(spark, d, "events").select("user_id", "value", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("pos"))
    return G.value_runs(e, "user_id", "pos", F.col("value") > 20)
