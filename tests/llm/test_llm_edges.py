"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, per operator."""

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from inkmark.llm import bpe, exact_dedup, html_extract, langid, mixing, pii, sharding, simhash, topk, warc
from inkmark.llm.common import shared_dir
from inkmark.llm.queries import RANKS

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 60_000 + "end"
ODD = [(1, None, "en", "a", None), (2, "", "en", None, 0), (3, LONG, None, "a", 5), (None, "some words here", "en", "b", 1), (None, None, None, None, None), (4, "Same Text Here Now", "en", "b", 2), (4, "Same Text Here Now", "en", "b", 2), (5, "same text here now", "de", "b", 2), (6, " \t\n ", "en", "a", 3), (7, "12345 !!", "en", "a", 3)]
PATH = P.path(RANKS)


# Names that the operators use inside.
CLASHES = "_h fp _gone gone id c0 c1 k0 _sha0 _sha sha drop digest t locator part n node label data bits tiles low component_id _u _w _k _b _place _wid size source_size target copies taken _copy _c0 lang_pred score bits_per_byte _text _row ids n_tokens decoded kept keep_id group_size".split()


def docs(spark, rows=ODD):
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return docs(spark, [])


def test_pseudonyms(spark):
    got = pii.pseudonymise(docs(spark).withColumn("n_private", F.lit("clash")).withColumns({c: F.lit(1) for c in ("_f", "_k", "_new", "found", "kinds", "new", "c0")}), "k").collect()
    assert len(got) == len(ODD) and all(r["n_private"] == 0 for r in got)
    assert [r["text"] for r in got] == [r[1] for r in ODD]
    assert pii.pseudonymise(empty(spark), "k").count() == 0


def test_pseudonyms_are_linked_and_valid(spark):
    texts = ["4111 1111 1111 1111", "x 4111-1111-1111-1111 y", "4111111111111112", "on 2024-02-29", "29.02.2024", "31/02/2024", "10.0.0.1 and 300.1.1.1", "+1 (017) 555-7713", "GB82 WEST 1234 5698 7654 32", "GB83WEST12345698765432", "me@a.example.com", "123-45-6789 000-45-6789", "Ends.4111111111111111 12 and 4111111111111111 5500005555555559."]
    run = lambda key: [r["text"] for r in pii.pseudonymise(docs(spark, [(i, t, None, None, None) for i, t in enumerate(texts)]), key).orderBy("doc_id").collect()]
    a, b = run("k"), run("other")
    assert a[0].replace(" ", "") == a[1][2:-2].replace("-", "") and a[0] != texts[0] and len(a[0]) == 19
    assert [a[i] for i in (2, 5, 9)] == [texts[i] for i in (2, 5, 9)]
    d = a[3][3:].split("-")
    assert a[4] == f"{d[2]}.{d[1]}.{d[0]}" and a[4] != texts[4]
    assert a[6].endswith(" and 300.1.1.1") and a[7].startswith("+1 (") and a[10].endswith("@a.example.com") and a[11].endswith(" 000-45-6789")
    assert all(x != y for x, y, t in zip(a, b, texts) if x != t)
    assert "4111111111111111" not in a[12] and "5500005555555559" not in a[12] and a[12][5:21] == a[12][29:45] == a[0].replace(" ", "") and a[12][21:29] == " 12 and "
    again = pii.pseudonymise(docs(spark, [(0, a[0] + " " + a[8], None, None, None)]), "k").first()
    assert again["n_private"] == 2  # pseudonyms pass the same checks as the values


def test_feistel_is_one_to_one(spark):
    n = spark.range(0, 5000)
    assert n.select(pii.feistel_text(F.lpad(F.col("id").cast("string"), 4, "0"), "k", F.lit("x")).alias("y")).distinct().count() == 5000
    m = n.select(pii.feistel_number(F.col("id"), 50, 100, "k", "x").alias("y"))
    assert m.distinct().count() == 5000 and m.agg(F.min("y"), F.max("y")).first()[:] == (0, 4999)


def test_language(spark):
    train = docs(spark, [(i, f"the cat sat on the mat number {i}", "en", None, 1) for i in range(30)] + [(100 + i, f"der hund lag auf der matte nummer {i}", "de", None, 1) for i in range(30)])
    model = langid.fit(train)
    got = langid.predict(docs(spark).withColumn("score", F.lit("clash")), model).collect()
    by = {(r["doc_id"], r["text"]): r for r in got}
    assert len(got) == len(ODD) and by[(1, None)]["lang_pred"] == by[(2, "")]["lang_pred"] == by[(7, "12345 !!")]["lang_pred"] == "und"
    assert by[(7, "12345 !!")]["score"] == 0 and by[(None, "some words here")]["lang_pred"] in ("en", "de")
    assert langid.predict(docs(spark, [(1, "die matte", None, None, 1)]), model).first()["lang_pred"] == "de"
    assert langid.fit(empty(spark)) is None
    assert {r["lang_pred"] for r in langid.predict(docs(spark), None).collect()} == {"und"}
    assert langid.predict(empty(spark), model).count() == 0


def test_a_model_of_many_languages_has_the_same_lengths():
    rng = np.random.default_rng(2)
    words = [bytes(rng.integers(97, 123, rng.integers(1, 9), dtype=np.uint8)) for _ in range(400)]
    samples = {x: b" ".join(rng.choice(words, 3000)) for x in "abcd"} | {"e": b"z", "f": bytes(rng.integers(0, 256, 5000, dtype=np.uint8))}
    table, apart = langid.train(samples, max_cells=10**9), langid.train(samples, max_cells=300_000)
    assert isinstance(table, langid.PPM) and isinstance(apart, langid.Trees)
    texts = [b" ".join(rng.choice(words, n)) for n in (1, 5, 80, 400)] + [b"", bytes(rng.integers(0, 256, 700, dtype=np.uint8)), b"ab"]
    data, starts = np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum([0, *map(len, texts)])
    assert np.allclose(table.lengths(data, starts), apart.lengths(data, starts), rtol=1e-4)
    held = sum(x.nbytes for t in apart.trees for level in t for x in level)
    assert held <= 16 * (langid.ORDER + 1) * sum(map(len, samples.values()))  # of the samples' size, however many the languages


VECTORS = "vec_id long, embedding array<float>, label int"


def test_top_k(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [-1.0, 0.5], 1), (4, None, 1), (5, [None, 1.0], 1), (6, [float("nan"), 1.0], 1), (7, [float("inf"), 1.0], 1), (None, [1.0, 1.0], 1), (2, [1.0, 0.0], 1), (8, [0.0, 0.0], 1), (50, [-1.0, -1.0], None)]
    v = topk.quantised(spark.createDataFrame(rows, VECTORS))
    got = [tuple(r) for r in topk.top_k(v.filter("vec_id % 50 = 0"), v, 5).orderBy("query_id", "rank").collect()]
    assert got[:5] == [(0, 1, 1, 65536), (0, 2, 2, 65536), (0, 3, 2, 65536), (0, 4, 8, 0), (0, 5, 3, -65536)]
    assert got[5:] == [(50, 1, 3, 32768), (50, 2, 8, 0), (50, 3, 0, -65536), (50, 4, 1, -65536), (50, 5, 2, -65536)]
    assert topk.top_k(v.limit(0), v, 5).count() == 0 and topk.top_k(v.limit(1), v.limit(0), 5).count() == 0


def test_top_k_of_large_and_sparse_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 3000)
    monkeypatch.setattr(topk, "QUERIES", 400)
    monkeypatch.setattr(topk, "TOGETHER", 3)
    monkeypatch.setattr(topk, "BLOCK", 40)
    rng = np.random.default_rng(4)
    dense = rng.normal(size=(300, 16))
    sparse = rng.normal(size=(300, 16)) * (rng.random((300, 16)) < 0.15)
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate((dense, sparse)))]
    rows += [(1000, [6e5, *[0.0] * 15]), (1050, [5e6, 3.0, *[0.0] * 14]), (1051, [-1e7, *[1.0] * 15]), (1100, [2.0**20 + 0.5, *[0.0] * 15]), (1150, [*[0.0] * 15, 1e13]), (2000, [1.0, 2.0]), (2050, [3.0, 1.0])]
    v = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = [tuple(r) for r in topk.top_k(v.filter("vec_id % 50 = 0"), v, 5).orderBy("query_id", "rank").collect()]
    w = {i: [int(np.floor(x * 256)) for x in e] for i, e in rows}
    want = []
    for a in sorted(w):
        if a % 50 == 0:
            s = sorted((-sum(x * y for x, y in zip(w[a], w[b])), b) for b in w if b != a and len(w[b]) == len(w[a]))[:5]
            want += [(a, r, b, -x) for r, (x, b) in enumerate(s, 1)]
    assert got == want
    with pytest.raises(Exception, match="64 bits"):
        over = topk.quantised(spark.createDataFrame([(0, [1e12]), (1, [1e12])], "vec_id long, embedding array<double>"))
        topk.top_k(over, over, 5)


def test_near_duplicates(spark):
    got = simhash.near_duplicates(docs(spark), 3).collect()
    assert len(got) == len(ODD)
    zero = [r for r in got if r["fingerprint"] == "0" * 16]
    assert sorted((r["doc_id"] or 0) for r in zero) == [0, 1, 2, 6] and {r["component_id"] for r in zero} == {1}
    assert {r["component_id"] for r in got if r["doc_id"] in (4, 5)} == {4}
    assert simhash.near_duplicates(empty(spark)).count() == 0
    only = simhash.near_duplicates(docs(spark, [(None, "a b c", None, None, 1)]), 3).collect()
    assert only[0]["component_id"] is None


def test_long_chain_of_links(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(-5, -4)], "u long, v long")
    got = dict(map(tuple, simhash.components(edges).collect()))
    assert len(got) == 203 and all(got[i] == 0 for i in range(201)) and got[-4] == -5
    assert simhash.components(edges.limit(0)).count() == 0


def test_tiles_miss_no_link():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    near = base ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
    u, v = simhash.compare(base, near, 3)
    linked = set(u.tolist()) | set(v.tolist())
    assert all(int(x) in linked for x in base) and all(int(x) in linked for x in near)


def test_exact_dedup(spark):
    got = exact_dedup.resolve(docs(spark).withColumn("keep_id", F.lit("clash"))).collect()
    assert len(got) == len(ODD)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[1][0]["keep_id"] == by[2][0]["keep_id"] == 2 and by[2][0]["group_size"] == 3 and not by[1][0]["kept"]
    assert [r["keep_id"] for r in by[4]] == [5, 5] and by[5][0]["kept"] and by[5][0]["group_size"] == 3
    assert exact_dedup.resolve(empty(spark)).count() == 0
    alone = exact_dedup.resolve(docs(spark, [(None, "x", None, None, 1)])).first()
    assert alone["keep_id"] is None and alone["kept"] and alone["group_size"] == 1


def test_exact_dedup_goes_on_from_its_state(spark, tmp_path):
    arrive = lambda rows: spark.createDataFrame(rows, "doc_id long, digest string, locator string").write.mode("append").parquet(str(tmp_path / "in"))
    state = str(tmp_path / "state")
    arrive([(1, "x", "f1"), (2, "y", "f1")])
    exact_dedup.stream_state(spark, str(tmp_path / "in"), state)
    arrive([(3, "x", "f2")])
    updates = exact_dedup.stream_state(spark, str(tmp_path / "in"), state)
    got = {r["digest"]: (r["keep_id"], r["locator"], r["group_size"]) for r in exact_dedup.latest(spark, updates).collect()}
    assert got == {"x": (3, "f2", 2), "y": (2, "f1", 1)}


def test_exact_dedup_decides_a_later_arrival_beside_the_earlier_ones(spark, tmp_path):
    state = f"file://{tmp_path}/state"
    first = exact_dedup.resolve(docs(spark, [(1, "a", None, None, 1), (9, "B", None, None, 1), (2, None, None, None, 1)]), state)
    assert {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in first.collect()} == {1: (1, 1), 9: (9, 1), 2: (2, 1)}
    later = exact_dedup.resolve(docs(spark, [(3, "A", None, None, 1), (4, "b", None, None, 1), (5, "c", None, None, 1), (5, "c", None, None, 1)]), state).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in later) == [(3, 3, 2, True), (4, 9, 2, False), (5, 5, 2, True), (5, 5, 2, True)]


def test_an_arrival_that_is_given_again_counts_once(spark, tmp_path):
    state = f"file://{tmp_path}/state"
    plain = lambda df: sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in df.collect())
    a = docs(spark, [(1, "x", None, None, 1), (2, "X", None, None, 1), (3, "y", None, None, 1)])
    b = docs(spark, [(4, "x", None, None, 1), (5, "z", None, None, 1)])
    first = plain(exact_dedup.resolve(a, state, "day-1"))
    assert first == [(1, 2, 2, False), (2, 2, 2, True), (3, 3, 1, True)]
    assert plain(exact_dedup.resolve(a, state, "day-1")) == first
    assert plain(exact_dedup.resolve(b, state, "day-2")) == [(4, 4, 3, True), (5, 5, 1, True)]
    assert plain(exact_dedup.resolve(b, state, "day-2")) == [(4, 4, 3, True), (5, 5, 1, True)]
    with pytest.raises(ValueError):
        exact_dedup.resolve(b, state, "a/b")


@pytest.mark.parametrize("lost", ["after the texts", "after the state"])
def test_an_arrival_whose_job_was_lost_is_taken_up(spark, tmp_path, lost):
    state = f"file://{tmp_path}/state"
    a = docs(spark, [(1, "x", None, None, 1), (2, "X", None, None, 1)])
    exact_dedup.arrive(a, state, "day-1")
    if lost == "after the state":
        exact_dedup.stream_state(spark, f"{state}/content/*", state, "another")
    got = exact_dedup.resolve(a, state, "day-1").collect()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"]) for r in got) == [(1, 2, 2), (2, 2, 2)]


def test_a_later_arrival_reads_the_folders_of_its_hits_alone(spark, tmp_path):
    import shutil

    state = f"file://{tmp_path}/state"
    for k, t in enumerate(["a", "b", "c"]):
        exact_dedup.resolve(docs(spark, [(k, t, None, None, 1)]), state, f"n{k}").collect()
    for k in (0, 2):
        shutil.rmtree(tmp_path / "state/content" / f"n{k}")  # only the second is asked for
    assert [tuple(r)[:3] for r in exact_dedup.resolve(docs(spark, [(0, "B", None, None, 1)]), state, "n9").collect()] == [(0, 1, 2)]


def test_exact_dedup_checks_bytes_across_arrivals(spark, tmp_path, monkeypatch):
    real, state = F.sha2, f"file://{tmp_path}/state"
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: F.substring(real(c, n), 1, 0))  # every digest collides
    exact_dedup.resolve(docs(spark, [(1, "a", None, None, 1), (5, "a", None, None, 1)]), state, "n1").collect()
    got = exact_dedup.resolve(docs(spark, [(2, "b", None, None, 1), (3, "A", None, None, 1)]), state, "n2").collect()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"]) for r in got) == [(2, 2, 1), (3, 5, 3)]


def test_exact_dedup_checks_bytes(spark, monkeypatch):
    real = F.sha2
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: F.substring(real(c, n), 1, 0))  # every digest collides
    rows = [(1, "a", None, None, 1), (2, "b", None, None, 1), (3, "A", None, None, 1), (4, "b", None, None, 1), (5, "c", None, None, 1)]
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.resolve(docs(spark, rows)).collect()}
    assert got == {1: (3, 2, False), 2: (4, 2, False), 3: (3, 2, True), 4: (4, 2, True), 5: (5, 1, True)}


def test_lower_ascii(spark):
    from inkmark.llm.common import lower_ascii

    rows = ["ABC xyz", "ÉÀ ABC", "İI", "K Ⅷ Ⓐ", "ǅ", "ẞ ß", ""]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").orderBy("i").select(lower_ascii(F.col("t"))).collect()]
    assert got == [t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for t in rows]


def test_mix_deals_any_weights_evenly(spark):
    for w in (1.0, 2.0, 20_000.0, 1e-6):
        d = spark.range(4000).select(F.col("id").alias("doc_id"))
        b = d.select(F.floor(F.log2(-F.log(mixing.uniform(F.col("doc_id"), 0)) / w) * mixing.RANGES).alias("b")).groupBy("b").count()
        assert b.agg(F.max("count")).first()[0] < 50


def test_mix(spark):
    got = mixing.mix(docs(spark).withColumn("target", F.lit("clash"))).collect()
    assert len(got) == len(ODD) and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert {r["size"] for r in got if not (r["text"] or "").strip()} == {0}
    assert mixing.mix(empty(spark)).count() == 0
    nothing = mixing.mix(docs(spark, [(1, None, None, "a", 1), (2, "", None, None, 1)])).collect()
    assert [(r["target"], r["taken"]) for r in nothing] == [(0.0, 0), (0.0, 0)]
    twice = mixing.apply_mix(docs(spark, [(1, "a b c d", None, "x", 1)]).withColumn("copies", F.lit(7))).collect()
    assert len(twice) in (1, 2) and twice[0]["copies"] == 7


def test_warc(spark):
    rows = [(1, "http://b.example.org/x?q=1", "<p>same</p>"), (2, "https://www.b.example.org/x?q=1", "<p>same</p>"), (3, None, None), (4, "", ""), (5, "not a url\nat all", "é" * 100_000), (5, "not a url\nat all", "é" * 100_000), (None, "http://[bad/", "<p>same</p>")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, refers_to string")
    got = sorted(map(tuple, warc.round_trip(pages).collect()), key=str)
    d = warc.digest32
    same, none, big = d(b"<p>same</p>"), d(b""), d(("é" * 100_000).encode())
    want = [(1, 11, same, "response", None), (2, 11, same, "revisit", 1), (None, 11, same, "revisit", 1), (3, 0, none, "response", None), (4, 0, none, "revisit", 3), (5, 200_000, big, "response", None), (5, 200_000, big, "response", None)]
    assert got == sorted(want, key=str)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_lookup_of_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(warc, "LINES", 16)
    pages = spark.createDataFrame([(i, "http://hot.example.org/" if i % 3 else None, f"<p>{i}</p>") for i in range(600)], "page_id long, url string, html string")
    parts, _ = warc.store(pages)
    got = warc.look_up(spark.createDataFrame([(warc.surt("http://hot.example.org/"),), (")/",), (")/",)], "key string"), parts)
    assert sorted(r["page_id"] for r in got.collect()) == list(range(600))
    assert got.select(F.spark_partition_id()).distinct().count() > 1


def test_warc_lookup(spark):
    rows = [(i, f"http://h{i % 7}.example.org/{i % 50}", f"<p>{i}</p>") for i in range(3000)]
    parts, _ = warc.store(spark.createDataFrame(rows, "page_id long, url string, html string"))
    keys = [warc.surt("http://h3.example.org/10"), warc.surt("http://nowhere.example.org/"), ""]
    got = warc.look_up(spark.createDataFrame([(k,) for k in keys], "key string"), parts).collect()
    assert {r["page_id"] for r in got} == {i for i, u, _ in rows if u == "http://h3.example.org/10"} and len(got) == len({r["page_id"] for r in got})
    assert all(bytes(r["payload"]) == f"<p>{r['page_id']}</p>".encode() for r in got)


def test_reversed_hosts():
    assert warc.surt("https://www.Example.org:8080/a?b") == "org,example:8080)/a?b" and warc.surt("http://example.org") == "org,example)/" and warc.surt(None) == ")/"


def test_main_text(spark):
    shell = "<html><head><title>t</title><style>x</style></head><body><nav>Home</nav>%s<footer>foot</footer></body></html>"
    rows = [(1, None, None), (2, "http://a/", ""), (3, "http://a/", shell % "<article><h1>T &amp; U</h1><p>one\n two<p>three <b>bold</b><br>x<div class='cookie-notice'>c</div><section id=comments>no</section></article>"), (3, "http://a/", "plain"), (None, "http://a/", "<p>a</p><p>a</p>")]
    got = html_extract.main_text(spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")).collect()
    assert len(got) == 5 and {(r["page_id"], r["text"]) for r in got} == {(1, ""), (2, ""), (3, "T & U\none two\nthree bold x"), (3, "plain"), (None, "a\na")}
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_extract.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_shards(spark):
    store = sharding.ShardStore(spark, shared_dir(spark, "t"), base_bytes=2000, target_bytes=1 << 20, fan_in=3)
    assert store.read() is None and store.append(empty(spark)).files is not None
    for i in range(10):
        store.append(docs(spark))
        before = store.manifest()
        after = store.compact()
        assert after.version >= before.version
    assert store.read().count() == 10 * len(ODD) and len(store.manifest().runs) < 9
    store.vacuum()
    assert len(store.versions()) == 2
    assert store.read().exceptAll(docs(spark)).count() == 9 * len(ODD)
    wide = sharding.ShardStore(spark, shared_dir(spark, "t"), base_bytes=1000, target_bytes=100_000, fan_in=3)
    rows = spark.range(20_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("x")).repartition(60)
    wide.append(rows)
    before = wide.manifest().runs[0]
    assert before.bytes > 300_000 and wide.due([before]) == [before]  # larger than any tier, but of small files
    after = wide.compact()
    assert all(r.bytes / len(r.files) >= 50_000 for r in after.runs) and wide.read().count() == 20_000
    now = store.manifest()
    store.commit(now.runs, now)
    with pytest.raises(RuntimeError):
        store.commit(now.runs, now)


def test_arrivals_of_other_columns_keep_them(spark):
    store = sharding.ShardStore(spark, shared_dir(spark, "t"), base_bytes=1 << 20, target_bytes=1 << 22, fan_in=2)
    rows = lambda schema, *r: spark.createDataFrame(list(r), schema)
    store.append(rows("doc_id long, text string", (1, "a")))
    store.append(rows("text string, doc_id long, extra string", ("b", 2, "kept")))
    want = [(1, "a", None), (2, "b", "kept")]
    assert sorted(map(tuple, store.read().collect())) == want
    assert len(store.compact().runs) == 1 and store.read().columns == ["doc_id", "text", "extra"]
    assert sorted(map(tuple, store.read().collect())) == want
    for clash in ("doc_id string", "Text string"):
        with pytest.raises(ValueError):
            store.append(rows(clash, ("x",)))
    store.append(rows("doc_id long, extra string, day int", (3, "c", 7)), "day")
    assert sorted(map(tuple, store.read().collect())) == [*want, (3, None, "c")]


def test_bpe(spark):
    enc = bpe.encoding(PATH, P.PATTERN)
    texts = [None, "", LONG, "a" * 9000 + " b", " " * 9000, "word " * 900 + "x" * 5000 + " yy" * 900, "\n\n  " * 2000 + "don't", "é😀" * 3000, "<|endoftext|>"]
    d = docs(spark, [(1, t, None, None, None) for t in texts] * 2).withColumn("ids", F.lit("clash"))
    got = bpe.decoded(bpe.encoded(d, PATH, P.PATTERN, chunk=2000, overlap=200), PATH, P.PATTERN).collect()
    assert len(got) == 2 * len(texts)
    for r in got:
        ids = [int.from_bytes(r["ids"][i : i + 4], "little") for i in range(0, len(r["ids"]), 4)]
        assert ids == enc.encode_ordinary(r["text"] or "") and r["n_tokens"] == len(ids) and bytes(r["decoded"]) == (r["text"] or "").encode()
    assert bpe.encoded(empty(spark), PATH, P.PATTERN).count() == 0


def test_stages_on_odd_and_empty_tables(spark, sf):
    for name, stage in corpus_pipeline.STAGES:
        odd = docs(spark).withColumns({c: F.lit(c) for c in CLASHES})
        got = stage(spark, odd, sf)
        rows = got.collect()
        if name != "bpe":
            assert got.columns == odd.columns and all(r[c] == c for r in rows for c in CLASHES)
        assert stage(spark, empty(spark), sf).count() == 0
