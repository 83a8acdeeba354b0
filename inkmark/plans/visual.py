"""Signatures of embeddings: distances, advice, near duplicates and their clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkmark.operators import matching as M
from inkmark.operators import metrics as G
from inkmark.operators import verdict as V
from inkmark.sources.shared import materialised

from .base import query, table


def _half(v: str, start: int) -> str:
    return f"list_sum(list_transform(range({start}, {start + 32}), lambda i: case when i > 0 and {v}[i + 1] > m then 1::bigint << (31 - (i - {start}))::bigint else 0::bigint end))::bigint"


def sig(source: str, name: str) -> str:
    return f"""{name} as (select id, {_half('x', 0)} as hi, {_half('x', 32)} as lo from (select id, x, list_sort(x[2:64])[32] as m from {source}))"""


ORIGINAL = "e as (select vec_id as id, list_transform(embedding, lambda y: y::double) as x from embeddings)"
TURNED = "f as (select id, list_transform(x, lambda y, i: case when ((i - 1) * 7 + id) % 13 = 0 then -y else y end) as x from e)"
HEX = "lpad(lower(to_hex(hi)), 8, '0') || lpad(lower(to_hex(lo)), 8, '0')"
DIST = "(bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)))::int"
BOTH = f"with {ORIGINAL}, {TURNED}, {sig('e', 's')}, {sig('f', 't')} "
ALL = BOTH + ", u as (select id * 2 as id, hi, lo from s union all select id * 2 + 1, hi, lo from t) "
PAIRS = ALL + f""", cl as (select hi, lo, min(id) as id from u group by 1, 2), pr as (select a.id as a, b.id as b, {DIST} as distance from cl a join cl b on a.id < b.id and bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 7
  union all select cl.id, u.id, 0 from u join cl using (hi, lo) where u.id <> cl.id) """


def union(spark, d):
    """Signatures of the vectors (2 * id) and of their turned copies (2 * id + 1)."""
    e = table(spark, d, "embeddings").select((F.col("vec_id") * 2).alias("id"), F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    turned = e.withColumn("x", F.transform("x", lambda v, i: F.when((i * 7 + F.col("id") / 2) % 13 == 0, -v).otherwise(v)))
    # Written once: later steps use a signature many times, and it would be computed anew in each place.
    return materialised(G.median_signature(e.unionByName(turned.withColumn("id", F.col("id") + 1)), "id", "x"), "signatures")


def one_side(both, turned: bool = False):
    return both.filter(F.col("id") % 2 == int(turned)).select(F.floor(F.col("id") / 2).alias("id"), "h")


def signatures(spark, d, turned: bool = False):
    return one_side(union(spark, d), turned)


@query(BOTH + f"select id as vec_id, {HEX} as h from s")
def median_signature(spark, d):
    return signatures(spark, d).withColumnRenamed("id", "vec_id")


@query(BOTH + f"select id, case when id % 17 = 0 and id % 2 = 0 then 0 when id % 17 = 0 then 64 when b_id is null then 64 else d end as distance from (select a.id, b.id as b_id, {DIST} as d from s a left join (select * from t where id % 5 <> 0) b on a.id = b.id)".replace("case when id % 17 = 0 and id % 2 = 0 then 0 when id % 17 = 0 then 64 when b_id is null then 64", "case when b_id is null then 64 when id % 17 = 0 and id % 2 = 0 then 0 when id % 17 = 0 then 64"))
def hamming_pairs(spark, d):
    """Distances of each signature to its re-capture; every 17th is flat, every fifth re-capture is missing."""
    flat = F.col("id") % 17 == 0
    both = union(spark, d)
    a = one_side(both).withColumn("flat", flat)
    b = one_side(both, True).filter("id % 5 <> 0").withColumn("flat", flat & (F.col("id") % 2 == 0))
    return M.hamming_pairs(a, b, ["id"])


@query(PAIRS + "select * from pr")
def near_duplicates(spark, d):
    return M.near_duplicates(union(spark, d), 7)


@query(PAIRS.replace("with e as", "with recursive e as", 1) + """, ed as (select a, b from pr union all select b, a from pr), r as (select distinct a as id, a as l from ed union select ed.b, r.l from r join ed on ed.a = r.id)
 select id, min(l) as cluster from r group by id""")
def duplicate_clusters(spark, d):
    return M.clusters(M.near_duplicates(union(spark, d), 7))


CELLS = BOTH + """, c as (select a.id as capture_id, k // 4 as row, k % 4 as col, 4 * bit_count(((case when k < 8 then xor(a.hi, b.hi) else xor(a.lo, b.lo) end) >> (28 - 4 * (k % 8))) & 15)::int as distance from s a join t b on a.id = b.id, range(16) r(k)),
 rg as (select a.id as capture_id, n as region, (case when n = 'photo' then bit_count(xor(a.hi, b.hi)) else bit_count(xor(a.lo, b.lo)) end * 4)::int as distance, case when a.id % 4 = 0 then null else (a.id % 20)::int end as stability from s a join t b on a.id = b.id, (values ('photo'), ('seal')) v(n)) """
ADVICE = CELLS + """, ca as (select capture_id, count(*) filter (distance > 12)::int as far_cells, coalesce(string_agg(case when distance > 12 then row || ':' || col end, ',' order by row || ':' || col), '') as diverged from c group by 1),
 ra as (select capture_id, coalesce(string_agg(case when not coalesce(stability > 12, false) and distance > 16 then region end, ',' order by region), '') as changed_regions, coalesce(string_agg(case when stability > 12 then region end, ',' order by region), '') as unreliable_regions from rg group by 1),
 ad as (select *, case when far_cells > 2 then 'GLOBAL' when far_cells > 0 or changed_regions <> '' then 'LOCALISED' else 'CLOSE' end as kind from ca join ra using (capture_id)) """


def cells_and_regions(spark, d):
    """The 64 bits as a grid of 16 cells of 4 bits, and as two regions of 32, with distances scaled to 16 and 128."""
    both = union(spark, d)
    a, b = one_side(both), one_side(both, True).withColumnRenamed("h", "ph")
    j = a.join(b, "id").withColumnRenamed("id", "capture_id")
    digit = lambda c, k: F.conv(F.substring(F.col(c), k + 1, F.lit(1)), 16, 10).cast("long")
    c = j.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(15))))
    c = c.select("capture_id", F.floor(F.col("k") / 4).cast("int").alias("row"), (F.col("k") % 4).alias("col"), (F.bit_count(digit("h", F.col("k")).bitwiseXOR(digit("ph", F.col("k")))) * 4).cast("int").alias("distance"))
    (ah, al), (bh, bl) = M.halves(F.col("h")), M.halves(F.col("ph"))
    part = lambda n, x, y: F.struct(F.lit(n).alias("region"), (F.bit_count(x.bitwiseXOR(y)) * 4).cast("int").alias("distance"))
    r = j.select("capture_id", F.explode(F.array(part("photo", ah, bh), part("seal", al, bl))).alias("r"), F.when(F.col("capture_id") % 4 != 0, (F.col("capture_id") % 20).cast("int")).alias("stability"))
    return c, r.select("capture_id", "r.region", "r.distance", "stability")


@query(ADVICE + "select capture_id, far_cells, diverged, kind, changed_regions, unreliable_regions, case kind when 'GLOBAL' then 'UNCLEAR' when 'LOCALISED' then 'REVIEW' else 'CONSISTENT' end as advice from ad")
def visual_advice(spark, d):
    return V.visual_advice(*cells_and_regions(spark, d))


@query(CELLS + "select capture_id % 10 as doc_id, region, max(case when capture_id % 9 = 0 then 0 else distance end)::int as stability from rg group by 1, 2")
def region_stability(spark, d):
    """How far a region moves at most over re-captures of a document; flat captures count as 0."""
    _, r = cells_and_regions(spark, d)
    return r.groupBy((F.col("capture_id") % 10).alias("doc_id"), "region").agg(F.max(F.when(F.col("capture_id") % 9 == 0, 0).otherwise(F.col("distance"))).cast("int").alias("stability"))
