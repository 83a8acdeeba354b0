"""The operators applied to the given tables with production parameters, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, clustering, exact_dedup, html_extract, langid, merkle, mixing, pii, sharding, simhash, topk, url_filter, warc
from .common import shared_dir, table, written

#: The key of the pseudonyms. In production it comes from a secret store; this one is for the queries and tests.
PSEUDONYM_KEY = "inkmark-demonstration-key"
RANKS = "byte_bpe_50k.tiktoken"


def op1_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, PSEUDONYM_KEY)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs)
    out = langid.predict(docs.select("doc_id", "text").select("doc_id", F.coalesce(langid.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "lang_pred", "score", "bits_per_byte")


def op3_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors.filter("vec_id % 50 = 0"), vectors, 5)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs, words=3, radius=3).select("doc_id", "fingerprint", "component_id")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.resolve(table(spark, sf_dir, "documents").select("doc_id", "text"))


def quality_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1 for documents without a label, from 1 to 2 by mean quality for the others."""
    return table(spark, sf_dir, "labels").filter("quality is not null").select("doc_id", (1 + F.col("quality")).cast("double").alias("weight"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mixing.mix(docs, quality_weights(spark, sf_dir), share=1.5, cap=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"), min_revisit_bytes=0)


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


#: Bytes of text of an arrival, and the fewest arrivals.
ARRIVAL_BYTES, ARRIVALS = 256 << 20, 16


def op9_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive in batches (by a hash of doc_id) of one size, the more the larger the table, are compacted as they come, and are read back."""
    docs = table(spark, sf_dir, "documents")
    store = sharding.ShardStore(spark, shared_dir(spark, "shards"), base_bytes=4 << 20, target_bytes=32 << 20, fan_in=4)
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    arrival = next(c for c in (f"arrival{i}" for i in range(len(docs.columns) + 1)) if c not in docs.columns)
    store.append(docs.withColumn(arrival, F.pmod(F.xxhash64("doc_id"), F.lit(max(ARRIVALS, -(-size // ARRIVAL_BYTES))))), arrival)
    live = store.read()
    live = docs.limit(0) if live is None else live
    return live.select("doc_id", "source", F.octet_length("text").cast("long").alias("text_bytes"), F.sha2(F.col("text"), 256).alias("text_sha256"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    out = bpe.encoded(docs, path, pattern, with_decoded=True, with_text=False)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A witness of every document; of those that 7 divides (by crc32 of doc_id) one character more is claimed than there is."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    forged = F.when(tampered, merkle.leaf_of(F.col("doc_id"), F.col("source"), F.col("lang"), more, F.col("text")))
    m = merkle.manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], tree="lang", order="doc_id", forged=forged)
    m = m.withColumn("folded_root", merkle.folded(F.coalesce("forged", "leaf"), F.col("path")))
    return m.select("doc_id", "leaf", "subroot", "root", merkle.proof(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, clusters = clustering.clustered(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), k=40, rounds=5, seed=2, width=64)
    clusters, _ = written(clusters.select("cluster", "cluster_inertia", clustering.centroid_digest(F.col("centroid")).alias("centroid_sha256")), "cluster-digests")
    inertia = clusters.agg(F.sum("cluster_inertia")).first()[0]
    # One row a cluster: 40 at most.
    return vectors.join(F.broadcast(clusters), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(inertia).cast("long").alias("inertia"), "centroid_sha256")


URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label is that of the document of the same number: bad if its quality is 0 or it is toxic."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("bad"))
    return url_filter.judged(table(spark, sf_dir, "pages").select("page_id", "url"), labels, URL_RULES)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pseudonyms, op2_language, op3_maxscore, op4_simhash, op5_exact_dedup, op6_mixing, op7_warc, op8_main_text, op9_compaction, op10_bpe, op11_merkle, op12_clusters, op13_url_filter)}


_TOPK = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(x::double * 256) as bigint)) as w from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id),
r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id) as rank, vec_id, score from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 5
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_DEDUP = f"""
with d as (select doc_id, {_LOWER} as t from documents),
g as (select t, max(doc_id) as keep_id, count(*) as group_size from d group by t)
select d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id as kept, sha256(d.t) as text_sha256 from d join g on d.t = g.t
"""

_MIX_OF = """
w as (select doc_id, avg(1.0 + quality) as weight from labels where quality is not null group by doc_id),
d as (select x.*, cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) as size,
    pow((cast(('0x' || substr(md5(doc_id::varchar || ':0'), 1, 12)) as bigint) + 0.5) / 281474976710656.0::double, 1 / coalesce(weight, 1.0)) as k
  from {docs} x left join w using (doc_id)),
s as (select source, sum(size)::bigint as source_size from d group by source),
n as (select *, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5.0::double when 1 then 2.0 else 1.0 end as weight, 2.0::double * source_size as lim from s),
a as (select *, (1.5::double * sum(source_size) over () - coalesce(sum(lim) over (o rows between unbounded preceding and 1 preceding), 0)) / sum(weight) over (o rows between current row and unbounded following) as lv
  from n window o as (order by lim / weight, source nulls last)),
b as (select *, max(case when lv <= lim / weight then lv end) over () as level from a),
t as (select source, source_size, least(lim, coalesce(weight * level, lim)) as target from b),
e as (select *, case when source_size > 0 then cast(floor(target / source_size) as bigint) else 1 end as epochs from t),
p as (select d.*, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size as rest,
    coalesce(sum(size) over (partition by d.source order by k desc, d.doc_id, size rows between unbounded preceding and 1 preceding), 0) as pos
  from d join e on d.source is not distinct from e.source),
m as (select *, epochs + case when rest > 0 and pos + size / 2.0 <= rest then 1 else 0 end as copies from p)
"""

_SHARDS = "select doc_id, source, octet_length(encode(text))::bigint as text_bytes, sha256(text) as text_sha256 from documents"

_B32 = " || ".join(f"to_base(('0x' || substr(sha1(p.h), {1 + 10 * i}, 10))::bigint, 32, 8)" for i in range(4))
_WARC = f"""
with p as (select page_id, coalesce(html, '') as h from pages), g as (select h, min(page_id) as f from p group by h)
select page_id, octet_length(encode(p.h))::bigint as payload_bytes, translate(upper({_B32}), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') as payload_digest,
  case when page_id = f then 'response' else 'revisit' end as record_type, case when page_id <> f then f end as refers_to
from p join g on p.h = g.h
"""

# The main text of pages whose article holds headings, paragraphs, line breaks and inline marks only, as the given ones do.
_MAIN_TEXT = r"""
with t as (select page_id, url, array_to_string(list_filter(list_transform(string_split_regex(regexp_extract(coalesce(html, ''), '(?s)<article[^>]*>(.*?)</article>', 1), '</?(?:h[1-6]|p)>'),
  lambda x: trim(regexp_replace(regexp_replace(replace(replace(replace(regexp_replace(regexp_replace(x, '<br */?>', ' ', 'g'), '<[^>]*>', '', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) as text from pages)
select page_id, url, text, length(text)::bigint as n_chars from t
"""

# Bit by bit: the polynomial of CRC-32, over the eight bits of each character of a decimal number.
_CRC32 = "xor(list_reduce(list_prepend(4294967295, range(0, 8 * len({0}))), lambda c, i: xor(case when i % 8 = 0 then xor(c, ascii({0}[i // 8 + 1])) else c end >> 1, (case when i % 8 = 0 then xor(c, ascii({0}[i // 8 + 1])) else c end & 1) * 3988292384)), 4294967295)"
_FRAMED = "case when {0} is null then '-' else octet_length(encode(({0})::varchar)) || ':' || ({0})::varchar end"
_LEAF = "sha256(" + " || ".join(_FRAMED.format(c) for c in ("doc_id", "source", "lang", "{0}", "text")) + ")"
_LEVELS = """{0}(lvl, tree, idx, h, n) as (select 0, tree, idx, h, n from {1} union all
   select lvl + 1, tree, idx // 2, sha256(h || coalesce(nxt, '')), (n + 1) // 2 from (select *, lead(h) over (partition by tree order by idx) as nxt from {0} where n > 1) where idx % 2 = 0)"""
_STEPS = "select a.{2}, {3} as stage, l.lvl, case when s.h is null then 'N' when (a.idx >> l.lvl) % 2 = 1 then 'L' || s.h else 'R' || s.h end as step from {1} a join (select distinct tree, lvl from {0} where n > 1) l using (tree) left join {0} s on s.tree = a.tree and s.lvl = l.lvl and s.idx = xor(a.idx >> l.lvl, 1)"
_MERKLE = f"""
with recursive d as (select doc_id, coalesce('=' || lang, '-') as tree, {_LEAF.format("n_chars")} as h, case when {_CRC32.format("(doc_id::varchar)")} % 7 = 0 then {_LEAF.format("n_chars + 1")} end as forged from documents),
b as (select doc_id, tree, row_number() over (partition by tree order by doc_id) - 1 as idx, h, forged, count(*) over (partition by tree) as n from d), {_LEVELS.format("t", "b")},
r as (select tree, h as subroot from t where n = 1),
rb as (select tree as own, '' as tree, row_number() over (order by tree) - 1 as idx, subroot as h, count(*) over () as n from r), {_LEVELS.format("u", "rb")},
low as ({_STEPS.format("t", "b", "doc_id", 0)}), high as ({_STEPS.format("u", "rb", "own", 1)}),
p as (select doc_id, list(step order by stage, lvl) as steps from (select * from low union all select b.doc_id, stage, lvl, step from high join b on b.tree = high.own) group by doc_id),
f as (select b.doc_id, b.h as leaf, r.subroot, (select h from u where n = 1) as root, coalesce(steps, []) as steps, coalesce(forged, b.h) as begin from b join r using (tree) left join p using (doc_id)),
g as (select *, list_reduce(list_prepend(begin, steps), lambda h, s: sha256(case s[1] when 'L' then s[2:] || h when 'R' then h || s[2:] else h end)) as folded_root from f)
select doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(steps, lambda s: s[2:]), '')) as proof_sha256, folded_root, folded_root = root as verified from g
"""


def _clusters_sql(k: int, rounds: int) -> str:
    parts = [f"""v as materialized (select vec_id, list_transform(embedding, lambda x: cast(floor(x::double * 256) as bigint)) as w from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
 c0 as materialized (select row_number() over (order by sha256('2:' || vec_id)) - 1 as c, w from v qualify c < {k})"""]
    for i in range(rounds + 1):
        parts.append(f"a{i} as materialized (select v.vec_id, min({{'d': list_sum(list_transform(list_zip(v.w, x.w), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint, 'c': x.c}}) as m from v, c{i} x group by v.vec_id)")
        if i < rounds:
            mean = f"(select c, list((s - ((s % n) + n) % n) // n order by i) as w from (select a.m.c as c, i, sum(v.w[i])::bigint as s, count(*) as n from a{i} a join v using (vec_id), range(1, 65) t(i) group by 1, 2) group by c)"
            parts.append(f"c{i + 1} as materialized (select x.c, coalesce(y.w, x.w) as w from c{i} x left join {mean} y on y.c = x.c)")
    return f"""with {", ".join(parts)}
 select vec_id, m.c::int as cluster, m.d as distance, sum(m.d) over (partition by m.c)::bigint as cluster_inertia, sum(m.d) over ()::bigint as inertia, sha256(array_to_string(x.w, ',')) as centroid_sha256 from a{rounds} a join c{rounds} x on x.c = a.m.c"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_maxscore": _TOPK,
        "op5_exact_dedup": _DEDUP,
        "op6_mixing": "with " + _MIX_OF.format(docs="documents") + " select doc_id, size, source_size, target, cast(size * copies as bigint) as taken from m",
        "op7_warc": _WARC,
        "op8_main_text": _MAIN_TEXT,
        "op9_compaction": _SHARDS,
        "op11_merkle": _MERKLE,
        "op12_clusters": _clusters_sql(40, 5),
    }
