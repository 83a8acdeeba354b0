"""Near duplicates of the pipeline against the exact similarity of all pairs."""

import random

import numpy as np
import pytest

from inkmark.llm import simhash


def sets(texts):
    out = []
    for t in texts:
        w = t.split()
        k = min(5, len(w))
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    return out


def brute(texts):
    """Of each text the number of the first text of its component."""
    s, up = sets(texts), list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(s[i] & s[j]) >= 4 * len(s[i] | s[j]):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return [find(i) for i in range(len(texts))]


def made(seed):
    """Pairs of a similarity from 0.6 to 0.85 of long texts, texts of 5 to 20 words with words appended, and a group of copies."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(10**6)}"
    texts = []
    for _ in range(60):
        a = [word() for _ in range(200)]
        n = rng.randrange(19, 50)  # words that are the one's own, at the end
        texts += [a, a[: 200 - n // 2] + [word() for _ in range(n // 2)]]
    for n in range(5, 21):
        for more in (1, 2, 3):
            for _ in range(4):
                a = [word() for _ in range(n)]
                texts += [a, a + [word() for _ in range(more)]]
                texts += [[word(), *a], [word(), *a]]
    base = [word() for _ in range(100)]
    for _ in range(80):
        texts.append(base[: 100 - (k := rng.randrange(0, 20))] + [word() for _ in range(k)])
    rng.shuffle(texts)
    return [" ".join(t) for t in texts] + ["", " "]


@pytest.mark.parametrize("block, tile", [(simhash.SET_BLOCK, simhash.TILE_BLOCK), (4000, 30)])
def test_links_are_those_of_the_exact_similarity(spark, monkeypatch, block, tile):
    monkeypatch.setattr(simhash, "SET_BLOCK", block)
    monkeypatch.setattr(simhash, "TILE_BLOCK", tile)
    texts = made(7)
    got = simhash.similar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == dict(enumerate(brute(texts)))


def test_given_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted(docs.select("doc_id", "text").collect())
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    want = {rows[i]["doc_id"] for i in brute([(r["text"] or "").translate(low) for r in rows])}
    assert {r["doc_id"] for r in simhash.apply_near_dedup(docs).collect()} == want


def test_pairs_at_the_limit_share_a_tile():
    """Sets of similarity 0.8: recall of tiles and radius together, at the smallest similarity that counts."""
    rng = np.random.default_rng(5)
    missed = 0
    for k in range(4000):
        n = (5, 10, 50, 250)[k % 4]
        b = rng.integers(0, 2**63, n, dtype=np.uint64)
        a = b[: n * 4 // 5]
        x, y = (np.frombuffer(simhash.spread(s), dtype=np.uint64) for s in (a, b))
        far = int(np.bitwise_count(x ^ y).sum())
        near = far <= (simhash.FEW_RADIUS if len(a) < simhash.FEW else simhash.WIDE_RADIUS)
        missed += not (near and (simhash.tiles_of(a) == simhash.tiles_of(b)).any())
    assert missed <= 2


def test_unlike_texts_seldom_share_a_tile():
    rng = np.random.default_rng(6)
    passage = rng.integers(0, 2**63, 50, dtype=np.uint64)
    tiles = [simhash.tiles_of(np.concatenate((passage, rng.integers(0, 2**63, 150, dtype=np.uint64)))) for _ in range(2000)]
    sizes = np.unique(np.concatenate(tiles), return_counts=True)[1]
    assert (sizes * (sizes - 1) // 2).sum() < 0.01 * 2000 * 1999 / 2  # of the pairs that share a passage of a quarter of each


def test_near_in_tiles_is_that_of_all_pairs():
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**63, (40, 2), dtype=np.uint64)
    bits = base[rng.integers(0, 40, 300)] ^ (np.uint64(1) << rng.integers(0, 60, (300, 2)).astype(np.uint64))
    tile, size, away = rng.integers(0, 6, 300), rng.integers(4, 40, 300).astype(np.uint64), rng.random(300) < 0.3
    got = simhash.near(tile, bits, size, away)
    up = list(range(300))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(300):
        for j in range(i):
            limit = simhash.FEW_RADIUS if min(size[i], size[j]) < simhash.FEW else simhash.WIDE_RADIUS
            if tile[i] == tile[j] and not (away[i] and away[j]) and int(np.bitwise_count(bits[i] ^ bits[j]).sum()) <= limit:
                up[find(i)] = find(j)
    assert all((find(i) == find(j)) == (got[i] == got[j]) for i in range(300) for j in range(i))


def test_word_hashes_are_those_of_single_words(monkeypatch):
    text = b" One two\tTHREE \xc3\xa9t\xc3\xa9\n\x0bx" + b"y" * 9000 + b" " + b"z" * 9000 + b"\r" + b"z" * 8999 + b"a one"
    whole = simhash.word_hashes(text)
    assert [int(h) for h in whole] == [int(simhash.word_hashes(w.lower())[0]) for w in text.split()]
    assert whole[0] == whole[-1] and len(set(whole.tolist())) == len(whole) - 1
    monkeypatch.setattr(simhash, "PIECE", 7)
    assert (simhash.word_hashes(text) == whole).all() and len(simhash.word_hashes(b" \n ")) == len(simhash.word_hashes(b"")) == 0
