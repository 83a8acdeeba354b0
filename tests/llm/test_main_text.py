"""Main text: structure, and runs that a host repeats, against brute force."""

import os
import random
import time

import duckdb
import numpy as np
import pytest

from inkmark.llm import html_extract, queries

PAGES = "page_id long, url string, html string"
SITE = "http://a.example.org/"


def texts(spark, htmls, partitions=None, urls=None):
    df = spark.createDataFrame([(i, urls[i] if urls else f"{SITE}{i}", h) for i, h in enumerate(htmls)], PAGES)
    df = df.repartition(partitions) if partitions else df
    return [r["text"] for r in html_extract.main_text(df).orderBy("page_id").collect()]


def brute(streams, need, pages):
    """Of each stream (a list of blocks), which blocks lie in runs of ``need`` tokens, or are shorter wholes, on ``pages`` distinct streams."""
    distinct = set(map(tuple, streams))
    runs, wholes = {}, {}
    for k, s in enumerate(distinct):
        t = " ".join(s).split(" ")
        for i in range(len(t) - need + 1):
            runs.setdefault(tuple(t[i : i + need]), set()).add(k)
        for b in s:
            wholes.setdefault(b, set()).add(k)
    out = []
    for s in streams:
        t, cover, at, gone = " ".join(s).split(" "), set(), 0, []
        for i in range(len(t) - need + 1):
            if len(runs[tuple(t[i : i + need])]) >= pages:
                cover |= set(range(i, i + need))
        for b in s:
            n = len(b.split(" "))
            gone.append(n < need and len(wholes[b]) >= pages or set(range(at, at + n)) <= cover)
            at += n
        out.append(gone)
    return out


@pytest.mark.parametrize("partitions", [1, 4, 12])
def test_pages_without_an_article_are_those_of_brute_force(spark, partitions):
    rng = random.Random(3)
    shared = [" ".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 15))) for _ in range(12)]
    streams = []
    for i in range(300):
        own = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 12))) for _ in range(3)]
        s = rng.sample(shared, 3) + own
        rng.shuffle(s)
        streams.append(s)
    streams += streams[:20]
    got = texts(spark, ["".join(f"<div>{b}</div>" for b in s) for s in streams], partitions)
    gone = brute(streams, html_extract.MIN_TOKENS, html_extract.MIN_PAGES)
    assert got == ["\n".join(b for b, g in zip(s, d) if not g) for s, d in zip(streams, gone)]
    assert any(any(d) and not all(d) for d in gone)


def brute_array(streams, depth):
    """The suffixes of one host's streams, sorted, as (page, place)."""
    return sorted(((k, i) for k, s in enumerate(streams) for i in range(len(s) - depth + 1)), key=lambda x: (streams[x[0]][x[1] : x[1] + depth], x))


@pytest.mark.parametrize("partitions", [1, 5])
def test_the_suffix_array_is_sorted_and_its_intervals_are_the_repeats(spark, partitions):
    rng = random.Random(2)
    words = [[rng.choice("abc") for _ in range(rng.randrange(0, 40))] for _ in range(30)]
    df = spark.createDataFrame([(k, "h", [" ".join(w)] if w else []) for k, w in enumerate(words)], "row long, host string, texts array<string>").filter("size(texts) > 0")
    code = {r["t"]: r["c"] for r in spark.createDataFrame([(c,) for c in "abc"], "t string").selectExpr("t", "xxhash64(t) as c").collect()}
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    array = html_extract.suffix_array(df, 4)
    got = [(r["row"], r["at"]) for r in array.orderBy("host", "key", "row", "at").collect()]
    assert got == brute_array([[code[w] for w in s] for s in words], 4)
    found = html_extract.intervals(array, 4).groupBy("key").sum("pages").collect()
    want = {}
    for k, s in enumerate(words):
        for i in range(len(s) - 3):
            want.setdefault(tuple(code[w] for w in s[i : i + 4]), set()).add(k)
    assert {tuple(r[0]): r[1] for r in found} == {k: len(v) for k, v in want.items()}
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_prefixes_of_neighbours():
    keys = np.array([[1, 2, 3], [1, 2, 4], [1, 2, 4], [2, 2, 4], [2, 2, 4]])
    assert html_extract.prefixes(keys, np.array([False, True, True, True, False])).tolist() == [0, 2, 3, 0, 0]


def test_every_given_page_goes_through_the_array_of_its_host(spark, sf, monkeypatch):
    sf, seen = os.path.join(os.path.dirname(sf), "sf0.01"), {}  # the smallest tables' hosts repeat nothing
    duck = duckdb.connect()
    duck.sql(f"create view pages as select * from '{sf}/pages.parquet'")

    def spied(streams, *args, whole=html_extract.repeated):
        marks = whole(streams, *args).localCheckpoint()
        seen["streams"], seen["marks"] = streams.collect(), {r["row"]: sorted(r["marks"]) for r in marks.collect()}
        return marks

    monkeypatch.setattr(html_extract, "repeated", spied)
    got = {r["page_id"]: r["text"] for r in queries.op8_main_text(spark, sf).collect()}
    pages = {}  # host and stream: its distinct pages
    for url, page in duck.sql("select url, html from pages").fetchall():
        _, texts, kinds = html_extract.sorted_out(page)
        stream = tuple(t for t, k in zip(texts, kinds) if k != html_extract.FRAME)
        pages.setdefault((url.split("://")[1].split("/")[0].lower(), stream), set()).add(tuple(texts))
    assert {(r["host"], tuple(r["texts"])): r["pages"] for r in seen["streams"]} == {k: len(v) for k, v in pages.items()}
    need, on = html_extract.MIN_TOKENS, {}
    for (host, stream), held in pages.items():
        t = " ".join(stream).split(" ")
        for x in {tuple(t[i : i + need]) for i in range(len(t) - need + 1)} | {b for b in stream if len(b.split(" ")) < need}:
            on[host, x] = on.get((host, x), 0) + len(held)
    for r in seen["streams"]:
        t = " ".join(r["texts"]).split(" ")
        want = [i for i in range(len(t) - need + 1) if on[r["host"], tuple(t[i : i + need])] >= 3]
        want += [-1 - i for i, b in enumerate(r["texts"]) if len(b.split(" ")) < need and on[r["host"], b] >= 3]
        assert seen["marks"].get(r["row"], []) == sorted(want)
    assert seen["marks"] and got == dict(duck.sql(f"select page_id, text from ({queries.oracle_sql()['op8_main_text']})").fetchall())


@pytest.mark.parametrize("partitions", [1, 4])
def test_a_notice_in_the_article_goes_where_the_host_repeats_it(spark, partitions):
    page = "<article><p>%s</p><div class=x7>%s</div></article><nav>Home</nav>"
    notice, story = "Get all of our stories in one letter", [f"Story {i} is told here, and it is told at some length" for i in range(4)]
    assert texts(spark, [page % (t, notice) for t in story], partitions) == story
    assert texts(spark, [page % (t, notice) for t in story[:2]], partitions) == [f"{t}\n{notice}" for t in story[:2]]  # the host doesn't show it
    said = [f"{t}\nEach one has another end, which is number {i}" for i, t in enumerate(story)]
    assert texts(spark, [page % tuple(t.split("\n")) for t in said], partitions) == said
    prose = "<article><p>%s</p><p>Get all of our stories in one letter</p></article>"
    assert texts(spark, [prose % t for t in story], partitions) == [f"{t}\n{notice}" for t in story]


def test_copies_of_an_article_without_paragraphs_stay_whole(spark):
    page = "<article><div>One story that was put up many times over</div><div>It has an end that all of its copies have</div>%s</article><div>Page %d of this site</div>"
    whole = "One story that was put up many times over\nIt has an end that all of its copies have"
    assert texts(spark, [page % ("", i) for i in range(5)]) == [whole] * 5
    assert texts(spark, [page % (f"<p>Copy {i}</p>", i) for i in range(5)]) == [f"{whole}\nCopy {i}" for i in range(5)]


def test_what_is_in_doubt_goes_where_the_host_repeats_it(spark):
    page = "<article><p>Story number %d is told here</p><div class=share>%s</div></article>"
    shared = "Tell all of your friends about this story"
    got = texts(spark, [page % (i, shared if i < 5 else "This one is of the story itself, and long") for i in range(6)])
    assert got == [f"Story number {i} is told here" for i in range(5)] + ["Story number 5 is told here\nThis one is of the story itself, and long"]


def test_boilerplate_without_marks_goes(spark):
    page = "<div>Welcome to the site of all things</div><div>%s is told here at length</div><div>Write to us at the usual place</div>"
    got = texts(spark, [page % f"Story {i}" for i in range(5)])
    assert got == [f"Story {i} is told here at length" for i in range(5)]
    alone = texts(spark, [page % f"Story {i}" for i in range(5)], urls=[f"http://h{i}.example.org/" for i in range(5)])
    assert all(t.count("\n") == 2 for t in alone)  # other hosts don't vouch


def test_copies_of_a_page_do_not_erase_it(spark):
    assert texts(spark, ["<div>one story that was put up many times over</div>"] * 6) == ["one story that was put up many times over"] * 6


def test_a_teaser_is_not_the_page(spark):
    page = "<article><p>Read on</p></article><div>This site has a very plain foot</div><div>%s</div>"
    long = [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(4)]
    assert texts(spark, [page % t for t in long]) == [f"Read on\n{t}" for t in long]
    framed = "<article><p>%s</p></article><div>This site has a very plain foot</div><div>short note %d</div>"
    assert texts(spark, [framed % (t, i) for i, t in enumerate(long)]) == long


@pytest.mark.parametrize(
    "page, want",
    [
        ("<article><div style='overflow:hidden'>kept</div><p class='hidden-xs'>kept too</p><p hidden>not</p><p style='display: none'>nor</p><p aria-hidden=true>nor</p></article>", "kept\nkept too"),
        ("<article><p class='social-science'>a</p><p class='search-algorithms'>b</p><p class='alert'>c</p></article>", "a\nb\nc"),
        ("<article><pre><code>x = 1 <span class='token comment'># said</span></code></pre></article>", "x = 1 # said"),
        ("<article><p>text</p></article><article class='comment'>mine</article><article class='related'>more</article>", "text"),
        ("<article><p>a</p><div class='cookie-notice'>c</div><section id=comments>no</section><aside>b</aside></article>", "a"),
        ("<article><header><h1>T</h1></header><p>a</article><div class='ad'>buy</div>", "T\na"),
        ("<p>5 < 6 and <b>bold</b>", "5 < 6 and bold"),
        ("<article><p>one<p class=x'>two</p><a title='a>b'>three</a></article>", "one\ntwo\nthree"),
        ("<main role='main' class='comments'>text</main>", "text"),
        ("<article>&lt;p&gt; &amp;amp; &#233;</article>", "<p> &amp; é"),
        ("<article>cut <b", "cut"),
        ("   ", ""),
        *[(f"<article><p>text</p><div {mark}>beside</div></article>", "text") for mark in ("class=newsletter-signup", "class='cookie-consent'", "class=user-comments", "id=reader-comments", "class=comments-area", "class=related-articles", "class=social-share", "class=ad-label", "class='x top-ad'")],
        ("<article><div class=share>One long story is told</div><p class=social>Another</p><li class=comment>Third</li></article>", "One long story is told\nAnother\nThird"),
        ("<div class='page has-sidebar'><article>a</article></div>", "a"),
        ("<article>two words</article><div>A longer legal line that stands behind it on this page</div>", "two words"),
        ("<ul class=main-nav><li>Home</li></ul><div class=newsletter-signup>Write to us</div><div>the text</div>", "the text"),
    ],
)
def test_structure(spark, page, want):
    text, blocks, kinds = html_extract.sorted_out(page)
    assert (text if text is not None else html_extract.unique_runs(blocks, kinds, [], 6, known=False)) == want


@pytest.mark.parametrize("page", ["<a '" * 20_000, '<a b="' * 20_000, "<" * 80_000, "<!" * 40_000, "<script " * 10_000, "<div>" * 20_000 + "</span>" * 20_000, "<b><div>" * 10_000 + "</b>" * 10_000, "<p><b>" * 15_000, "<i>" * 20_000 + "<p>" * 20_000])
def test_odd_pages_take_little_time(page):
    began = time.time()
    html_extract.sorted_out(page)
    assert time.time() - began < 5
