"""Registered queries of the training-data operators against SQL or a brute-force version."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from inkmark.llm import bpe, langid, queries, warc
from tests.conftest import plain

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").collect()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, duck, sf, name):
    got, want = queries.queries()[name](spark, sf), duck.sql(queries.oracle_sql()[name])
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    assert plain(tuple(r) for r in got.select(*cols).collect()) == plain(want.select(*cols).fetchall())


def test_every_operator_is_registered():
    assert [int(n[2:].split("_")[0]) for n in queries.queries()] == list(range(1, 14))


def brute_simhash(text, words):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOWER)) if x]
    if not w:
        return 0
    k = min(words, len(w))
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]), 42) for i in range(len(w) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(prints, ids, radius=3):
    fp = np.array(prints, dtype=np.uint64)
    up = list(range(len(fp)))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i in range(len(fp)):
        for j in np.flatnonzero(np.bitwise_count(fp[i] ^ fp[i + 1 :]) <= radius) + i + 1:
            up[find(i)] = find(int(j))
    low = {}
    for i in range(len(fp)):
        low[find(i)] = min(low.get(find(i), 1 << 62), ids[i])
    return [low[find(i)] for i in range(len(fp))]


def test_simhash_is_that_of_brute_force(spark, sf):
    docs = documents(spark, sf)
    prints = [brute_simhash(r["text"], 3) for r in docs]
    want = brute_components(prints, [r["doc_id"] for r in docs])
    got = {tuple(r) for r in queries.op4_simhash(spark, sf).collect()}
    assert got == {(r["doc_id"], f"{p:016x}", c) for r, p, c in zip(docs, prints, want)}


def test_warc_is_that_of_brute_force(spark, sf):
    rows = [(r["page_id"], (r["html"] or "").encode()) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    first = defaultdict(list)
    for i, p in rows:
        first[p].append(i)
    want = {(i, len(p), warc.digest32(p), "response" if i == min(first[p]) else "revisit", None if i == min(first[p]) else min(first[p])) for i, p in rows}
    assert {tuple(r) for r in queries.op7_warc(spark, sf).collect()} == want


def test_ids_are_those_of_the_library(spark, sf):
    enc = bpe.encoding(public_tokenizers.path(queries.RANKS), public_tokenizers.PATTERN)
    want = set()
    for r in documents(spark, sf):
        ids = np.array(enc.encode_ordinary(r["text"] or ""), dtype="<u4")
        want.add((r["doc_id"], len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert {tuple(r) for r in queries.op10_bpe(spark, sf).collect()} == want


def test_language_on_rows_held_out(spark, sf):
    got = queries.op2_language(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(got) > 30 and sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got)


def test_code_lengths_are_exact():
    model = langid.train({"x": b"abracadabra", "y": b"banana bandana"})
    text = b"abra banana zz"

    def bits(sample, t):
        known = len(set(b"abracadabrabanana bandana"))
        total = 0.0
        for i, s in enumerate(t):
            k = min(langid.ORDER, i)
            # the longest suffix of the context that either sample has as a context
            while k and not any(t[i - k : i] in x[: len(x)] and any(x[j : j + k] == t[i - k : i] and j + k < len(x) for j in range(len(x))) for x in (b"abracadabra", b"banana bandana")):
                k -= 1
            while True:
                nexts = [sample[j + k] for j in range(len(sample) - k) if sample[j : j + k] == t[i - k : i]]
                n, d = len(nexts), len(set(nexts))
                c = nexts.count(s)
                if c:
                    total += np.log2((n + d) / c)
                    break
                total += np.log2((n + d) / d) if n else 0
                if k == 0:
                    total += 8
                    break
                k -= 1
        assert known
        return total

    got = model.lengths(np.frombuffer(text, dtype=np.uint8), np.array([0, len(text)]))[0]
    assert np.allclose(got, [bits(b"abracadabra", text), bits(b"banana bandana", text)], rtol=1e-4)


def test_mix_hits_its_targets(spark, sf):
    rows = queries.op6_mixing(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source"), "doc_id").collect()
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
    assert sum({s: v[0]["target"] for s, v in by.items()}.values()) == pytest.approx(1.5 * sum(r["size"] for r in rows))
    for v in by.values():
        assert abs(sum(r["taken"] for r in v) - v[0]["target"]) <= max(r["size"] for r in v) / 2 + 1
        assert v[0]["target"] <= 2 * v[0]["source_size"] + 1e-6
    assert all(r["taken"] <= 2 * r["size"] for r in rows)
    again = queries.op6_mixing(spark, sf).collect()
    assert plain(map(tuple, again)) == plain((r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"]) for r in rows)


def test_pseudonyms_leave_no_valid_value(spark, sf):
    given = {r["doc_id"]: r["text"] for r in documents(spark, sf)}
    changed = 0
    for r in queries.op1_pseudonyms(spark, sf).collect():
        before, after = given[r["doc_id"]], r["text"]
        assert (before == after) == (r["n_private"] == 0)
        if before != after:
            changed += 1
            assert len(before) >= 1 and re.sub(r"[0-9a-zA-Z]", "", before.split("@")[0])[:5] == re.sub(r"[0-9a-zA-Z]", "", after.split("@")[0])[:5]
        for card in re.findall(r"(?<![0-9A-Za-z.])[0-9]{16}(?![0-9A-Za-z])", before or ""):
            luhn = sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(card))) % 10 == 0
            assert (card in after) == (not luhn)
    assert changed


def smallest(edges, ids):
    up = list(range(len(ids)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in edges:
        a, b = find(int(i)), find(int(j))
        if a != b:
            up[b] = a
    low = {}
    for i, d in enumerate(ids):
        low[find(i)] = min(low.get(find(i), 1 << 62), d)
    return set(low.values())


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    cols = docs.columns
    kept = corpus_pipeline.language(spark, docs, sf)
    assert kept.columns == cols and kept.count() == docs.count()  # all of the given texts have letters
    exact = corpus_pipeline.exact(spark, docs, sf)
    rows = docs.collect()
    groups = defaultdict(list)
    for r in rows:
        groups[(r["text"] or "").translate(LOWER)].append(r["doc_id"])
    left = {max(v) for v in groups.values()}
    assert {r["doc_id"] for r in exact.collect()} == left and exact.columns == cols
    near = corpus_pipeline.near(spark, docs, sf)
    # Exactly the texts that hang together by a similarity of 0.8 or more of their five-word shingles lose all but one.
    shingles = [set(zip(*[t[i:] for i in range(min(5, len(t)))])) for t in ((r["text"] or "").translate(LOWER).split() for r in rows)]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if shingles[i] and 5 * len(shingles[i] & shingles[j]) >= 4 * len(shingles[i] | shingles[j])]
    left = {r["doc_id"] for r in near.collect()}
    assert left == smallest(pairs, [r["doc_id"] for r in rows]) and near.columns == cols
    alone = [r["doc_id"] for i, r in enumerate(rows) if shingles[i] and not any(i != j and shingles[i] & shingles[j] for j in range(len(rows)))]
    assert set(alone) <= left and len(alone) > 20
    mixed = corpus_pipeline.mixed(spark, docs, sf)
    taken = {r["doc_id"]: r["taken"] // max(r["size"], 1) for r in queries.op6_mixing(spark, sf).collect()}
    assert {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == {k: v for k, v in taken.items() if v}
    assert mixed.columns == cols


def test_pipeline_runs_through(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.filter(~F.col("round_trip")).isEmpty() and out.count() > 100


def test_pipeline_is_that_of_brute_force(spark, duck, sf):
    """The whole chain: equal texts, similar texts, the mix by SQL over what is left, and the library's ids."""
    rows = documents(spark, sf)
    groups = defaultdict(list)
    for r in rows:
        if re.search(r"[^\W\d_]", r["text"] or ""):
            groups[r["text"].translate(LOWER)].append(r)
    rows = [max(v, key=lambda r: r["doc_id"]) for v in groups.values()]
    sets = [set(zip(*[t[i:] for i in range(min(5, len(t)))])) for t in (r["text"].translate(LOWER).split() for r in rows)]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    left = smallest(pairs, [r["doc_id"] for r in rows])
    duck.sql(f"create or replace temp view kept_docs as select * from documents where doc_id in ({', '.join(map(str, left))})")
    copies = dict(duck.sql("with " + queries._MIX_OF.format(docs="kept_docs") + " select doc_id, copies from m").fetchall())
    enc = bpe.encoding(public_tokenizers.path(queries.RANKS), public_tokenizers.PATTERN)
    want = []
    for r in rows:
        if r["doc_id"] in left:
            ids = np.array(enc.encode_ordinary(r["text"]), dtype="<u4")
            want += [(r["doc_id"], r["source"], len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), True)] * copies[r["doc_id"]]
    got = [tuple(r) for r in corpus_pipeline.run(spark, sf).select("doc_id", "source", "n_tokens", "ids_sha256", "round_trip").collect()]
    assert plain(got) == plain(want) and len(want) > 100
