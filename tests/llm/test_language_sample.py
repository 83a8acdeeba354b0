"""The training sample of a language is full wherever its distinct texts can fill it; the query's rows are those of a plain PPM."""

import functools
import math
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from inkmark.llm import langid, queries

BOUND = 8192


def taken(spark, rows):
    return langid.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), BOUND)


def test_one_very_long_text_takes_nothing_from_the_others(spark):
    rows = [(i, f"text {i:04d} " + "x" * 90, "a") for i in range(1000)] + [(5000, "long " * 400_000, "a")]
    assert len(taken(spark, rows)["a"]) == BOUND


def test_languages_of_few_long_texts_are_learned(spark):
    rows = [(100 * k + i, f"{k} {i} " * 60_000, f"l{k}") for k in range(6) for i in range(10)]
    got = taken(spark, rows)
    assert sorted(got) == [f"l{k}" for k in range(6)] and {len(v) for v in got.values()} == {BOUND}


def test_copies_do_not_shrink_the_sample(spark):
    rows = [(i, "the same text " * 7, "a") for i in range(5000)] + [(9000 + i, f"text {i:04d} " + "y" * 90, "a") for i in range(100)]
    got = taken(spark, rows)["a"]
    assert len(got) == BOUND and got.count(b"the same text " * 7) <= 1


def test_all_of_a_small_language_is_taken_once(spark):
    got = taken(spark, [(i, f"text {i % 3}", "a") for i in range(30)] + [(99, "", "b"), (98, None, "a")])
    assert sorted(got["a"].split(b"\n")) == [b"text 0", b"text 1", b"text 2"] and "b" not in got


def plain_lengths(samples):
    """A function of a text: its bits under each language, from counts of what followed each context, in dictionaries, byte by byte."""
    counts = {lang: [defaultdict(Counter) for _ in range(langid.ORDER + 1)] for lang in samples}
    for lang, s in samples.items():
        for k in range(langid.ORDER + 1):
            for i in range(k, len(s)):
                counts[lang][k][s[i - k : i]][s[i]] += 1
    known = [set().union(*(c[k] for c in counts.values())) for k in range(langid.ORDER + 1)]

    @functools.cache
    def bits(lang, context, byte):
        after = counts[lang][len(context)].get(context)
        if after and byte in after:
            return math.log2((sum(after.values()) + len(after)) / after[byte])
        escape = math.log2((sum(after.values()) + len(after)) / len(after)) if after else 0.0
        return escape + (bits(lang, context[1:], byte) if context else 8.0)

    def of(t):
        out = dict.fromkeys(samples, 0.0)
        for i, byte in enumerate(t):
            k = min(langid.ORDER, i)
            while t[i - k : i] not in known[k]:
                k -= 1
            for lang in samples:
                out[lang] += bits(lang, t[i - k : i], byte)
        return out

    return of


def test_query_is_that_of_a_plain_ppm(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    learned = docs.filter(~langid.held_out(F.col("doc_id"))).select("doc_id", "text", "lang")
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1 for r in learned.collect())
    of = plain_lengths(langid.sample(learned))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in queries.op2_language(spark, sf).collect():
        text = texts[r["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        if text is None or not any(c.isalpha() for c in text):
            assert (r["lang_pred"], r["score"]) == ("und", 0)
            continue
        bits = of(text.encode())
        low = min(bits.values())
        assert r["lang_pred"] == min(k for k, v in bits.items() if v == low)
        assert math.isclose(r["score"], 1 / sum(2 ** max(low - v, -1000) for v in bits.values()), abs_tol=1e-4)
