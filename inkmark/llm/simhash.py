"""SimHash near-duplicates: fingerprints, exact comparison in tiles, connected components."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_rows, discard, written

RADIUS = 3
#: Rows of one side of a comparison at most; larger tiles are compared block by block.
BLOCK = 16_384
#: The fingerprint is cut in this many segments; a tile holds the fingerprints with equal bit counts in the first
#: ``segments_for(n)`` of them, and tiles are skipped inside a task by the bit counts of all.
SEGMENTS = 4


def fingerprint(text: bytes, words: int) -> int:
    """SimHash of the word shingles of a text (UTF-8): bit i is set if it is in over half of the shingles' hashes."""
    w = text.lower().split()
    if not w:
        return 0
    line = b" ".join(w)
    size = np.fromiter(map(len, w), dtype=np.int64, count=len(w))
    start = np.cumsum(size + 1) - size - 1
    k = min(words, len(w))
    first = start[: len(w) - k + 1]
    last = (start + size)[k - 1 :]
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(line[a:b], 42) for a, b in zip(first.tolist(), last.tolist())], dtype=">u8")
    n = len(hashes)
    count = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 255 * 256):
        bits = np.unpackbits(hashes[at : at + 255 * 256].view(np.uint8).reshape(-1, 8), axis=1)
        full = len(bits) // 255 * 255
        if full:
            count += bits[:full].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        count += bits[full:].sum(axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * count > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row; bytes.lower and bytes.split touch ASCII only."""
    arrow_rows(docs.sparkSession, 512)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", words) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(prints, dtype=np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode("text", "UTF-8").alias("t")).mapInArrow(run, "doc_id long, fp long")


def segments_for(n: int) -> int:
    """Segments in a tile's key: the finer the more rows, so that a row's work in tiles that miss stays bounded."""
    return 2 if n < 2_000_000 else 3 if n < 20_000_000 else 4


def _count(fp: Column, segment: int) -> Column:
    width = 64 // SEGMENTS
    return F.bit_count(F.shiftrightunsigned(fp, 64 - width * (segment + 1)).bitwiseAND(F.lit((1 << width) - 1))).cast("int")


def _merge(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Give the ends of all edges (u, v) and what hangs together with them the smallest label."""
    while True:
        a, b = label[u], label[v]
        low, high = np.minimum(a, b), np.maximum(a, b)
        if not (low < high).any():
            return
        np.minimum.at(label, high, low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


def compare(home: np.ndarray, visitors: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within home, and between home and visitors, as a forest: pairs (fingerprint, smallest of its part).

    Both sides are put in the order of their segments' bit counts, which cuts them into tiles. Bit counts that differ
    by more than the radius in sum cannot belong to fingerprints within it, so such pairs of tiles are skipped; the
    others are compared entry by entry.
    """
    width = 64 // SEGMENTS
    both = np.concatenate((home, visitors))
    counts = np.stack([np.bitwise_count((both >> np.uint64(64 - width * (i + 1))) & np.uint64((1 << width) - 1)) for i in range(SEGMENTS)]).astype(np.int16)
    key = (counts.astype(np.int64) * (width + 1) ** np.arange(SEGMENTS)[:, None]).sum(axis=0)
    side = np.arange(len(both)) >= len(home)
    order = np.lexsort((key, side))
    both, key, counts, n = both[order], key[order], counts[:, order], len(home)
    label = np.arange(len(both))
    cut = lambda k: np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, dtype=int)
    first = np.concatenate((cut(key[:n]), n + cut(key[n:])))
    last = np.append(first[1:], len(both))
    tile = counts[:, first]
    for i in range(int(np.searchsorted(first, n))):
        near = np.flatnonzero(np.abs(tile[:, i:] - tile[:, i : i + 1]).sum(axis=0) <= radius) + i
        rows = np.arange(first[i], last[i])
        cols = np.concatenate([np.arange(first[j], last[j]) for j in near])
        step = max(1, 500_000 // len(cols))
        for at in range(0, len(rows), step):
            r = rows[at : at + step]
            u, v = np.nonzero(np.bitwise_count(both[r][:, None] ^ both[cols][None, :]) <= radius)
            if len(u):
                u, v = r[u], cols[v]
                go = label[u] != label[v]
                _merge(label, u[go], v[go])
    linked = np.flatnonzero(label != np.arange(len(both)))
    return both[linked], both[label[linked]]


def links(prints: DataFrame, radius: int) -> DataFrame:
    """Edges (u, v) between different fingerprints that have the same components as all pairs within radius.

    prints: fp (long), distinct. Tiles are those of equal bit counts in the first segments, and are neighbours if the
    bit counts differ by the radius in sum at most.
    """
    g = segments_for(prints.count())
    tiled = prints.select("fp", F.array(*[_count(F.col("fp"), i) for i in range(g)]).alias("key"))
    steps = [s for s in product(range(-radius, radius + 1), repeat=g) if sum(map(abs, s)) <= radius and s > (0,) * g]

    def forest(pdf: pd.DataFrame) -> pd.DataFrame:
        fp, away = pdf["fp"].to_numpy(np.int64).view(np.uint64), pdf["visits"].to_numpy(bool)
        u, v = compare(fp[~away], fp[away], radius)
        return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    return _dealt(tiled, steps, forest, "u long, v long")


def _dealt(tiled: DataFrame, steps: list[tuple[int, ...]], forest, schema: str) -> DataFrame:
    """What ``forest`` finds in each tile and between it and its neighbours.

    tiled: fp and key (array of int, the tile). Each fingerprint has a home tile, and visits the tiles at ``steps``
    above it; a large tile is cut in blocks, and its blocks visit each other. Rows are dealt by (home block, part of
    the visitors), so a task's group holds BLOCK rows of the home and about 16 * BLOCK visitors at most.
    """
    spark = tiled.sparkSession
    sizes = tiled.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    sizes, sizes_path = written(sizes.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")), "simhash-tiles")
    offsets = F.array(*[F.array(*[F.lit(x) for x in s]) for s in steps])
    near = sizes.select(F.col("key").alias("from"), F.col("n").alias("guests"), F.explode(offsets).alias("step"))
    near = near.select("from", "guests", F.zip_with("from", "step", lambda a, b: a + b).alias("key"))
    near = near.join(sizes.select("key", "blocks"), "key").select("from", "key", "guests", "blocks")
    inside = sizes.filter("blocks > 1").select(F.col("key").alias("from"), "key", F.col("n").alias("guests"), "blocks")
    total = near.unionByName(inside).groupBy("key").agg(F.sum("guests").alias("guests"))
    parts = F.greatest(F.lit(1), F.ceil(F.coalesce("guests", F.lit(0)) / (16 * BLOCK))).cast("int")
    at = sizes.join(total, "key", "left").select("key", "blocks", parts.alias("parts"))
    at, at_path = written(at, "simhash-parts")

    block = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("blocks")).cast("int")
    home = tiled.join(at, "key").select("fp", "key", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("visits"))
    routes = near.unionByName(inside).select("from", "key").join(at, "key").groupBy("from").agg(F.collect_list(F.struct("key", "blocks", "parts")).alias("to"))
    guest = tiled.withColumnRenamed("key", "from").join(routes, "from").select("fp", "from", F.explode("to").alias("to"))
    own = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("to.blocks")).cast("int")
    part = F.pmod(F.xxhash64("fp", F.lit(2)), F.col("to.parts")).cast("int")
    last = F.when(F.col("from") == F.col("to.key"), own - 1).otherwise(F.col("to.blocks") - 1)
    guest = guest.withColumn("last", last).filter("last >= 0").select("fp", F.col("to.key").alias("key"), F.explode(F.sequence(F.lit(0), F.col("last"))).alias("block"), part.alias("part"), F.lit(True).alias("visits"))
    edges, _ = written(home.unionByName(guest).groupBy("key", "block", "part").applyInPandas(forest, schema), "simhash-links")
    discard(spark, sizes_path, at_path)
    return edges


#: Bits of a wide fingerprint, and how many may differ between candidates: texts of similarity 0.8 differ in 19 on average with a
#: standard deviation of 4; of sets under FEW shingles in 24 (four against five) with one of 5.
WIDE_BITS, WIDE_RADIUS = 128, 46
FEW, FEW_RADIUS = 16, 56
#: Candidates: similarity, the number of tiles a set is in, and the smallest hashes that the sets of a tile have in common.
SIMILAR, BANDS, ROWS = 0.8, 20, 4
#: Rows of the tiles that one task compares, and shingles of the sets that one task compares exactly, each set counting as SET_ROW more.
TILE_BLOCK, SET_BLOCK, SET_ROW = 16_384, 1 << 18, 200
_FACTORS = np.frombuffer(hashlib.shake_256(b"inkmark tiles").digest(BANDS * ROWS * 4), dtype=np.uint32) | np.uint32(1)


def _keyed(name: str, n: int) -> np.ndarray:
    """n fixed odd numbers of 64 bits, made from a name."""
    return np.frombuffer(hashlib.shake_256(f"inkmark {name}".encode()).digest(8 * n), dtype=np.uint64) | np.uint64(1)


def _mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


_FOLD = _keyed("bands", ROWS + BANDS)
#: Texts are hashed in pieces of about so many bytes, cut between words.
PIECE = 1 << 20
_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
_BYTE = _keyed("bytes", 256).copy()
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_NEAR, _FAR, _ORDER = _keyed("near", 4096), _keyed("far", 4096).copy(), _keyed("order", 64)
_FAR[0] = 1


def word_hashes(text: bytes) -> np.ndarray:
    """A hash of 64 bits of each word of a text, A-Z as a-z: a sum of keyed bytes, each times keys of its place in the word, mixed."""
    if len(text) > PIECE:
        cut = next((i for i in range(PIECE, len(text)) if _SPACE[text[i]]), len(text))
        parts = [text[:cut]]
        while cut < len(text):
            to = next((i for i in range(cut + PIECE, len(text)) if _SPACE[text[i]]), len(text))
            parts.append(text[cut:to])
            cut = to
        if len(parts) > 1:
            return np.concatenate([word_hashes(x) for x in parts])
    b = np.frombuffer(text, dtype=np.uint8)
    inside = ~_SPACE[b]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False]))))
    size = edge[1::2] - edge[::2]
    if not len(size):
        return np.zeros(0, dtype=np.uint64)
    first = np.cumsum(size) - size
    at = np.arange(int(size.sum())) - np.repeat(first, size)
    z = _BYTE[b[inside]] * _NEAR[at & 4095]
    if size.max() > 4096:
        z *= _FAR[(at >> 12) & 4095] * (at.astype(np.uint64) >> np.uint64(24) | np.uint64(1))
    return _mixed(np.add.reduceat(z, first))


def shingles(text: bytes, words: int) -> np.ndarray:
    """The different hashes of a text's word shingles (fewer words: the whole sequence), in order; ``words`` is at most 64."""
    w = word_hashes(text)
    k = min(words, len(w))
    if not k:
        return w
    out = sum((w[i : len(w) - k + 1 + i] * _ORDER[i] for i in range(1, k)), w[: len(w) - k + 1] * _ORDER[0])
    out = np.sort(_mixed(out))
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def spread(hashes: np.ndarray) -> bytes:
    """A SimHash of WIDE_BITS bits over a set of hashes: each is spread over WIDE_BITS / 64 words by mixing it with the word's number."""
    n = len(hashes)
    count = np.zeros(WIDE_BITS, dtype=np.int64)
    for at in range(0, n, 255 * 64):
        z = hashes[at : at + 255 * 64, None] + np.arange(1, WIDE_BITS // 64 + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
        bits = np.unpackbits(_mixed(z).view(np.uint8), axis=1)
        full = len(bits) // 255 * 255
        if full:
            count += bits[:full].reshape(-1, 255, WIDE_BITS).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        count += bits[full:].sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * count > n).tobytes()


def wide_fingerprint(text: bytes, words: int) -> tuple[bytes, int]:
    """A SimHash of WIDE_BITS bits over the set of a text's word shingles, and the number of shingles in it."""
    hashes = shingles(text, words)
    return spread(hashes), len(hashes)


def tiles_of(hashes: np.ndarray) -> np.ndarray:
    """The BANDS tiles of a set: each is named by the smallest values that ROWS keyed hashes take on the set.

    Two sets of similarity s are in one given tile with probability s ** ROWS, so those of 0.8 miss all of 20 tiles once
    in 38,000 pairs; sets that share one passage of many hardly ever meet. No hashes: no tiles.
    """
    if not len(hashes):
        return np.zeros(0, dtype=np.int64)
    h = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    low = np.full(BANDS * ROWS, 2**32 - 1, dtype=np.uint32)
    for at in range(0, len(h), 2048):
        low = np.minimum(low, (h[at : at + 2048, None] * _FACTORS[None, :]).min(axis=0))
    named = (low.reshape(BANDS, ROWS).astype(np.uint64) * _FOLD[:ROWS]).sum(axis=1, dtype=np.uint64) + _FOLD[ROWS:]
    return ((named ^ (named >> np.uint64(29))) * _FOLD[0]).view(np.int64)


def near(tile: np.ndarray, bits: np.ndarray, size: np.ndarray, away: np.ndarray) -> np.ndarray:
    """Of each row the first row of its part, where rows of one tile are linked if their fingerprints are within the radius.

    bits: a row of 64-bit words each; size: the number of shingles; rows that are away are compared with the others only.
    The rows of a tile are in the order of their bit counts: those whose counts differ by more than the radius are skipped.
    """
    total = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    order = np.lexsort((total, tile))
    tile, bits, total, away = tile[order], bits[order], total[order], away[order]
    reach = np.where(size < FEW, FEW_RADIUS, WIDE_RADIUS)[order]
    most, label = int(reach.max(initial=0)), np.arange(len(tile))
    now, step = np.arange(len(tile)), 0
    while len(now):
        step += 1
        now = now[: np.searchsorted(now, len(tile) - step)]
        now = now[(tile[now + step] == tile[now]) & (total[now + step] - total[now] <= most)]
        u = now[(label[now] != label[now + step]) & ~(away[now] & away[now + step])]
        far = np.bitwise_count(bits[u] ^ bits[u + step]).sum(axis=1, dtype=np.int64)
        u = u[far <= np.maximum(reach[u], reach[u + step])]
        if len(u):
            _merge(label, u, u + step)
    out = np.arange(len(tile))
    out[order] = order[label]
    return out


def confirm(root: np.ndarray, sets: list[np.ndarray], known: np.ndarray, away: np.ndarray) -> np.ndarray:
    """Of each row the first row of its part, where rows of one root are linked if the Jaccard similarity of their sets is SIMILAR.

    known: rows with equal numbers are of one part already. Rows that are away are compared with the others only. The
    comparison is exact (in integers), and leaves out only pairs whose sizes rule it out or that hang together already.
    """
    n = np.array([len(s) for s in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    start = np.cumsum(np.append(0, n))
    label = np.unique(known, return_index=True)[1][np.unique(known, return_inverse=True)[1]]
    mark = np.zeros(len(ids), dtype=bool)
    order = np.argsort(root, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], root[order][1:] != root[order][:-1])))
    for rows in np.split(order, first[1:]):
        for i in rows[~away[rows] & (n[rows] > 0)]:
            j = rows[(away[rows] | (rows > i)) & (label[rows] != label[i]) & (4 * n[rows] <= 5 * n[i]) & (5 * n[rows] >= 4 * n[i])]
            if not len(j):
                continue
            own = ids[start[i] : start[i + 1]]
            mark[own] = True
            shared = np.add.reduceat(mark[np.concatenate([ids[start[k] : start[k + 1]] for k in j])], np.cumsum(n[j]) - n[j], dtype=np.int64)
            mark[own] = False
            j = j[5 * shared >= 4 * (n[i] + n[j] - shared)]
            if len(j):
                _merge(label, np.full(len(j), i), j)
    return label


def linked(rows: DataFrame, block: int, parts_of) -> DataFrame:
    """Edges (u, v) with the components of all links between rows of one label.

    rows: node (binary), label, weight, data (binary); a node has one row in a label. parts_of(label numbers, data, known part numbers,
    away) gives each row the first row of its part. Labels are cut in blocks of about ``block`` weight, small ones share
    a block; blocks are linked inside and with four pivots of their label. Of labels that still fall apart, all rows
    outside the largest part are then compared with all others. So a group of copies costs one pass over its rows,
    and no pair is left out.
    """
    spark = rows.sparkSession
    cut = lambda weight: F.ceil(weight / block).cast("int")
    pick = F.array(*[F.min_by("node", F.xxhash64("node", F.lit(i))) for i in range(4)])
    sizes = rows.groupBy("label").agg(F.sum("weight").alias("weight"), pick.alias("pivots"))
    big, big_path = written(sizes.filter(F.col("weight") > block).select("label", "pivots", cut(F.col("weight")).alias("blocks")), "simhash-big")
    buckets = rows.agg(cut(F.coalesce(F.sum("weight"), F.lit(0)))).first()[0] or 1
    schema = "u binary, v binary"

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        node = pdf["node"].to_numpy()
        got = parts_of(pd.factorize(pdf["label"])[0], pdf["data"].tolist(), pd.factorize(pdf["part"])[0], pdf["away"].to_numpy(bool))
        on = np.flatnonzero(got != np.arange(len(got)))
        return pd.DataFrame({"u": node[on], "v": node[got[on]]})

    cols = ["node", "label", "data", F.col("node").alias("part"), F.lit(False).alias("away")]
    if big.isEmpty():
        discard(spark, big_path)
        dealt = rows.select(*cols, F.pmod(F.xxhash64("label"), F.lit(buckets)).alias("bucket"))
        return written(dealt.groupBy("bucket").applyInPandas(link, schema), "simhash-links")[0]
    bucket = F.when(F.col("blocks").isNull(), F.pmod(F.xxhash64("label"), F.lit(buckets))).otherwise(F.xxhash64("label"))
    own = F.when(F.col("blocks").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("node", F.lit(5)), F.col("blocks"))).cast("int")
    dealt = rows.join(big, "label", "left").select(*cols, bucket.alias("bucket"), own.alias("block"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    pivots = big.select("label", "blocks", F.explode("pivots").alias("node")).distinct().join(rows.select("node", "label", "data"), ["label", "node"])
    pivots = pivots.select(*cols, F.xxhash64("label").alias("bucket"), every("blocks").alias("block"))
    edges, _ = written(dealt.unionByName(pivots).groupBy("bucket", "block").applyInPandas(link, schema), "simhash-links")

    parts = rows.select("node", "label", "weight").join(big.select("label", "blocks"), "label")
    parts = parts.join(components(edges).withColumnRenamed("label", "part"), "node", "left").withColumn("part", F.coalesce("part", "node"))
    parts, parts_path = written(parts, "simhash-parts")
    sizes = parts.groupBy("label", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"))
    rest = sizes.groupBy("label").agg(F.max_by("part", F.struct("n", "part")).alias("main"), F.sum("weight").alias("all"), F.max_by("weight", F.struct("n", "part")).alias("most"), F.count(F.lit(1)).alias("k"))
    rest, rest_path = written(rest.filter("k > 1").select("label", "main", F.greatest(F.lit(1), cut(F.col("all") - F.col("most"))).alias("homes")), "simhash-rest")
    both = parts.join(rest, "label").join(rows.select("node", "label", "data"), ["label", "node"])
    dealt = lambda n: F.pmod(F.xxhash64("node", F.lit(6)), F.col(n)).cast("int")
    home = both.filter("part <> main").select("label", "node", "part", "data", F.lit(False).alias("away"), dealt("homes").alias("home"), every("blocks").alias("block"))
    away = both.select("label", "node", "part", "data", F.lit(True).alias("away"), dealt("blocks").alias("block"), every("homes").alias("home"))
    more, _ = written(home.unionByName(away).groupBy("label", "home", "block").applyInPandas(link, schema), "simhash-links")
    discard(spark, big_path, parts_path, rest_path)
    return edges.unionByName(more)


def _tile_parts(tile: np.ndarray, data: list[bytes], known: np.ndarray, away: np.ndarray) -> np.ndarray:
    grid = np.frombuffer(b"".join(data), dtype=np.uint64).reshape(len(data), -1)
    return near(tile, grid[:, :-1], grid[:, -1], away)


def _set_parts(root: np.ndarray, data: list[bytes], known: np.ndarray, away: np.ndarray) -> np.ndarray:
    return confirm(root, [np.frombuffer(s, dtype=np.uint64) for s in data], known, away)


def similar(docs: DataFrame, words: int = 5) -> DataFrame:
    """doc_id, fp (binary, a digest of the set of shingles) and component_id of every row: near duplicates of a shingle similarity of 0.8 or more.

    Texts with one set of shingles become one node. Nodes are dealt to tiles (``tiles_of``), so that what a node is
    compared with doesn't grow with the corpus; inside a tile, fingerprints of WIDE_BITS within WIDE_RADIUS (FEW_RADIUS
    where a text has under FEW shingles) are linked. The shingles of the texts in the components of these candidates
    are then compared exactly, and only pairs whose Jaccard similarity is SIMILAR or more link. Shingles are equal if their hashes of 64 bits
    are. Null, empty and blank texts link with their like only. component_id: the smallest doc_id that can be reached,
    the row's own included (null doc_ids don't count, and it is null if there are no others). Whole texts are read,
    however long; repeated rows come out as often as they came in; columns other than doc_id and text are ignored; an
    empty table gives an empty result.
    """
    arrow_rows(docs.sparkSession, 512)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [shingles(t.as_buffer().to_pybytes() if t.is_valid else b"", words) for t in b.column(1)]
            bands = [tiles_of(g) for g in got]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, bands)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *bands])))
            bits = pa.array([spread(g) + len(g).to_bytes(8, "little") for g in got], pa.binary())
            node = pa.array([hashlib.blake2b(g.tobytes(), digest_size=16).digest() for g in got], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), node, bits, lists], names=["doc_id", "fp", "bits", "tiles"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode("text", "UTF-8").alias("t")).mapInArrow(run, "doc_id long, fp binary, bits binary, tiles array<long>")
    prints, prints_path = written(rows, "simhash-wide")
    # A node's name begins with its smallest doc_id, so that the smallest name of a component holds the smallest doc_id.
    rank = F.when(F.col("low").isNull(), F.lit("F" * 16)).otherwise(F.lpad(F.hex(F.col("low").bitwiseXOR(F.lit(-(2**63)))), 16, "0"))
    apart = prints.groupBy("fp").agg(F.min("doc_id").alias("low"), F.first(F.struct("bits", "tiles")).alias("d"))
    apart, apart_path = written(apart.select(F.concat(F.unhex(rank), "fp").alias("node"), "fp", "low", "d.bits", "d.tiles"), "simhash-distinct")
    tiles = apart.select("node", F.col("bits").alias("data"), F.explode("tiles").alias("label"))
    shared = tiles.groupBy("label").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("label")
    tiles, tiles_path = written(tiles.join(shared, "label").withColumn("weight", F.lit(1)), "simhash-tiles")
    rough = components(linked(tiles, TILE_BLOCK, _tile_parts))

    wanted, wanted_path = written(rough.join(apart.select("node", "fp", "low"), "node"), "simhash-rough")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted.select("low").distinct(), F.col("doc_id").eqNullSafe(F.col("low")), "left_semi")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [shingles(t.as_buffer().to_pybytes() if t.is_valid else b"", words).tobytes() for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([hashlib.blake2b(g, digest_size=16).digest() for g in got], pa.binary()), pa.array(got, pa.binary())], names=["fp", "data"])

    found = texts.select(F.encode("text", "UTF-8").alias("t")).mapInArrow(read, "fp binary, data binary").dropDuplicates(["fp"])
    sets, sets_path = written(found.join(wanted.select("fp", "node", "label"), "fp").select("node", "label", "data", (F.octet_length("data") / 8 + SET_ROW).alias("weight")), "simhash-sets")
    of = components(linked(sets, SET_BLOCK, _set_parts))
    low = lambda node: F.when(F.hex(F.substring(node, 1, 8)) != "F" * 16, F.conv(F.hex(F.substring(node, 1, 8)), 16, -10).cast("long").bitwiseXOR(F.lit(-(2**63))))
    named = apart.select("fp", "node").join(of, "node", "left").select("fp", low(F.coalesce("label", "node")).alias("component_id"))
    named, _ = written(named, "simhash-named")
    discard(docs.sparkSession, apart_path, tiles_path, wanted_path, sets_path)
    return prints.select("doc_id", "fp").join(named, "fp").select("doc_id", "fp", "component_id")


def _named(prints: DataFrame, apart: DataFrame, edges: DataFrame) -> DataFrame:
    of = components(edges)
    classes = apart.join(of.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("label", "fp").alias("label"))
    classes, _ = written(classes, "simhash-classes")
    named = classes.groupBy("label").agg(F.min("low").alias("component_id"))
    named = classes.join(named, "label").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


#: Groups to which the edges of one node are dealt.
SALTS = 16


def _least(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (u, v) with m, the smallest v of their u; and (u, m), a row for each group of edges of u.

    A node that a third of all edges hang on comes in SALTS groups, each known by its smallest v before rows meet; both
    sides of the join are then dealt anew, so that Spark can split a group that is still large.
    """
    edges = edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    low = edges.groupBy("u", "salt").agg(F.min("v").alias("m")).withColumn("m", F.min("m").over(Window.partitionBy("u")))
    return edges.join(low, ["u", "salt"]), low.select("u", "m")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each node's component, by alternating large-star and small-star steps.

    Every step replaces edges by edges to the smallest neighbour, never making more of them, and is written to the
    shared folder; the number of rounds grows with the logarithm of the longest path. Nodes without an edge don't come out.
    """
    spark = edges.sparkSession
    tidy = lambda e: e.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, path = written(tidy(edges), "components")

    def done() -> bool:
        """Whether every node has one edge, to a node that has none to a smaller one."""
        ends = now.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(now.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or up = 1 and down = 1").isEmpty()

    while not done():
        ways = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near, _ = _least(ways)
        large = tidy(near.filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")))
        large, large_path = written(large, "components")
        near, low = _least(large)
        small = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        small, small_path = written(tidy(small), "components")
        discard(spark, path, large_path)
        now, path = small, small_path
    out = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label"))
    return out.unionByName(now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("label")))


def near_duplicates(docs: DataFrame, words: int = 5, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, fingerprint and component_id for every row of docs (doc_id, text; other columns are ignored).

    Texts are lower-cased in A-Z, cut in words at space and U+0009..U+000D and made into shingles of ``words`` words
    (fewer words: the whole sequence; none, or null: fingerprint zero, which links like any other). Two rows are linked
    if their fingerprints differ in at most ``radius`` bits; component_id is the smallest doc_id that can be reached
    over links, the row's own included (null doc_ids don't count, and it is null if there are no others). Equal
    fingerprints are put together before anything is compared, so groups of copies cost one comparison.
    """
    prints, _ = written(fingerprints(docs, words), "simhash-prints")
    apart, _ = written(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-distinct")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return _named(prints, apart, links(apart.select("fp"), radius)).select("doc_id", "fp", hexed.alias("fingerprint"), "component_id")


def apply_near_dedup(docs: DataFrame, words: int = 5) -> DataFrame:
    """docs with the row of the smallest doc_id of each group of ``similar`` only; all columns are kept, whatever their names.

    Rows that repeat a doc_id that goes all go, and those that repeat one that stays all stay.
    """
    gone = similar(docs, words).filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("gone")).distinct()
    own = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)], F.col("doc_id").cast("long").alias("id"))
    left = own.join(gone, F.col("id").eqNullSafe(F.col("gone")), "left_anti")
    return left.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
