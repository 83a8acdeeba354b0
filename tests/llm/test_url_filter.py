"""Rules and path templates against plain Python over all URLs at once."""

import random
from collections import Counter, defaultdict

import pytest

from inkmark.llm import queries, url_filter

RULES = queries.URL_RULES


def cut(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    k = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = rest[:k], rest[k:]
    k = min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[:k]


def rule_of(host, path):
    fit = [(len(t), t, a) for a, t in RULES for h, p in [t.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return max(fit)[1:] if fit else (None, None)


def brute(urls, labels):
    """(page_id, host, path, rule, verdict, template) of urls (page_id, url) with labels {page_id: bad}."""
    rows = []
    for i, u in urls:
        host, path = cut(u)
        rule, action = rule_of(host, path)
        bad = (action == "block") if action else labels.get(i)
        rows.append([i, host, path, rule, action, bad, path[1:].split("/", url_filter.DEPTH - 1) if path else [], ""])
    for level in range(url_filter.DEPTH):
        nodes = defaultdict(list)
        for r in rows:
            if len(r[6]) > level:
                nodes[r[1], r[7]].append(r)
        for members in nodes.values():
            often = Counter(r[6][level] for r in members)
            own = {s for s, n in often.items() if n >= url_filter.LEAST and n * url_filter.SHARE >= len(members) and len(s) <= url_filter.LONGEST}
            branch = lambda r: r[6][level] if r[6][level] in own else None  # noqa: B023, E731
            stats = defaultdict(lambda: [0, 0, 0, 0])
            for r in members:
                for k, x in enumerate((1, len(r[6]) == level + 1, r[5] is not None, bool(r[5]))):
                    stats[branch(r)][k] += x
            names = url_filter.merged([(s, *c) for s, c in stats.items()])
            for r in members:
                r[7] += "/" + names[branch(r)]
    tally = defaultdict(lambda: [0, 0])
    for r in rows:
        if r[5] is not None:
            tally[r[1], r[7]][0] += 1
            tally[r[1], r[7]][1] += r[5]
    out = []
    for i, host, path, rule, action, _, _, node in rows:
        n, bad = tally[host, node]
        pure = (bad + url_filter.STRENGTH / 2) / (n + url_filter.STRENGTH) >= url_filter.LIMIT
        out.append((i, host, path, rule, action or ("block" if n and pure else "allow"), node))
    return out


def judged(spark, urls, labels, partitions=4):
    pages = spark.createDataFrame(urls, "page_id long, url string").repartition(partitions)
    known = spark.createDataFrame(list(labels.items()), "page_id long, bad boolean")
    return [tuple(r) for r in url_filter.judged(pages, known, RULES).collect()]


key = lambda r: tuple(str(x) for x in r)


def test_query_is_that_of_brute_force(spark, sf):
    urls = [(r["page_id"], r["url"]) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()]
    labels = {}
    for r in spark.read.parquet(f"{sf}/labels.parquet").collect():
        labels[r["doc_id"]] = labels.get(r["doc_id"], False) or r["quality"] == 0 or r["toxic"] == 1
    got = [tuple(r) for r in queries.op13_url_filter(spark, sf).collect()]
    assert sorted(got, key=key) == sorted(brute(urls, labels), key=key)
    assert {r[3] for r in got} >= {"net/", None}


@pytest.mark.parametrize("partitions", [1, 5])
def test_templates_are_those_of_brute_force(spark, partitions):
    rng, urls, labels = random.Random(8), [], {}
    for i in range(3000):
        host = rng.choice(["a.com", "a.com", "b.com", "shop.b.com", "c.org"])
        section = rng.choice(["news", "blog", "offers", "casino", "tag"])
        tail = rng.choice([f"{rng.randrange(9999)}", f"{rng.randrange(9999)}/", f"{rng.choice('xyz')}/p/{rng.randrange(99)}.html", ""])
        urls.append((i, f"http://{host}/{section}/{tail}"))
        if rng.random() < 0.5:
            labels[i] = rng.random() < (0.99 if section == "casino" else 0.1)
    got = judged(spark, urls, labels, partitions)
    assert sorted(got, key=key) == sorted(brute(urls, labels), key=key)
    blocked = {u for (_, u), r in zip(sorted(urls), sorted(got)) if r[4] == "block"}
    assert len(blocked) > 200 and all("/casino/" in u for u in blocked)
    assert sum("|" in r[5] for r in got) > 300  # branches were merged


def test_odd_urls(spark):
    odd = [None, "", "no scheme", "://", "http://", "HTTP://EXAMPLE.NET/EN/x", "http://example.net/en/x", "http://example.net", "http://net/", "http://xnet/", "x://a.net?q=/en/", "http://Ä.Com/%2A/*/(a|b)", "http://a.com//", "http://a.com/#/x", "a://b://c.net/d",
           "http://org/fr/", "http://www.example.com/de/1?x", "http://example.com/de", "http://a.com/" + "s/" * 5000, "http://a.com/" + "z" * 500_000, "http://a.com/\n/x?\n"]
    urls = list(enumerate(odd)) + [(3, odd[6])] * 2 + [(None, odd[6])]
    assert sorted(judged(spark, urls, {}), key=key) == sorted(brute(urls, {}), key=key)
    assert judged(spark, [], {}) == []
