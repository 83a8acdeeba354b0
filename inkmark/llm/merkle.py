"""Merkle manifest of a dataset: witnesses that grow as leaves and, above them, block roots are appended."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, discard, written

#: A task appends the leaves of one aligned block of 2 ** levels at a time; the block's root is a leaf of the tree above.
LEVELS = 12
STEP = "struct<left: boolean, sibling: string>"
PATH = f"array<{STEP}>"


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


class Frontier:
    """A tree over leaves that are appended from left to right, with a witness of each leaf.

    The open subtrees have falling heights. A new leaf opens one of height 0; as long as the last two are equally high, the right one
    completes its left sibling: each is appended to the witnesses of the leaves below the other, and both become one of the next height. So a
    witness holds the siblings up to its leaf's open subtree at any time, and only later completions extend it.
    """

    def __init__(self, witnessed: bool = True):
        self.witnessed = witnessed
        self.open: list[tuple[int, str, int, int]] = []  # height, root, its first leaf, the leaf after its last
        self.sides: list[list[bool | None]] = []  # of each leaf, level by level: whether the sibling is left; None without one
        self.siblings: list[list[str | None]] = []
        self.n = 0

    def append(self, leaf: str) -> None:
        self.open.append((0, leaf, self.n, self.n + 1))
        self.n += 1
        if self.witnessed:
            self.sides.append([])
            self.siblings.append([])
        while len(self.open) > 1 and self.open[-1][0] == self.open[-2][0]:
            self._complete()

    def _extend(self, first: int, end: int, side: bool | None, sibling: str | None) -> None:
        if self.witnessed:
            for k in range(first, end):
                self.sides[k].append(side)
                self.siblings[k].append(sibling)

    def _complete(self) -> None:
        (height, left, a, b), (_, right, _, c) = self.open[-2:]
        self._extend(a, b, False, right)
        self._extend(b, c, True, left)
        self.open[-2:] = [(height + 1, digest(left, right), a, c)]

    def close(self, height: int | None = None) -> str:
        """The root when no leaf comes any more, at a given height or where one node is left: the last subtree rises alone until it has a sibling."""
        while len(self.open) > 1 or height is not None and self.open[0][0] < height:
            h, root, a, b = self.open[-1]
            self._extend(a, b, None, None)
            self.open[-1] = (h + 1, digest(root), a, b)
            while len(self.open) > 1 and self.open[-1][0] == self.open[-2][0]:
                self._complete()
        return self.open[0][1]


def grown(leaves: list[str], height: int | None, witnessed: bool = True) -> tuple[Frontier, str]:
    """The frontier over one block and its root at a height; without one (the only block of its tree), where one node is left."""
    f = Frontier(witnessed)
    for leaf in leaves:
        f.append(leaf)
    return f, f.close(height)


def leaf_of(*values: Column) -> Column:
    """The digest of a row's values, each ``-`` for null, else its bytes in UTF-8, a colon and the value."""
    framed = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.sha2(F.concat(*framed), 256)


def positions(leaves: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """leaves (tree, digest, own) with pos, their place in their tree by ``order`` (columns of own), digest; and (tree, n).

    Rows are sorted by ranges, so a tree of any share of all rows lies in many partitions, and a place is the partition's own count behind
    the sum of those before. Rows that are equal in all of these are dealt by their number, which changes nothing.
    """
    keys = ["tree", *[f"own.{c}" for c in order], "digest", "_row"]
    ranged = leaves.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed, _ = written(ranged.drop("_row").withColumn("at", F.monotonically_increasing_id()), "merkle-sorted")
    part = F.shiftright("at", 33).alias("part")
    starts = placed.groupBy("tree", part).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.withColumn("shift", F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first"))
    sizes = starts.groupBy("tree").agg(F.sum("n").alias("n"))
    rows = placed.withColumn("part", part).join(starts.select("tree", "part", "shift"), ["tree", "part"])
    return rows.select("tree", (F.col("at") + F.col("shift")).alias("pos"), "digest", "own"), sizes


def _blocks(entries: DataFrame, sizes: DataFrame, levels: int) -> tuple[DataFrame, DataFrame]:
    """(tree, block, lone, entries in order) of each aligned block, and its root (tree, pos, digest, lone); both written."""
    own = "own" in entries.columns
    cut = entries.groupBy("tree", F.shiftright("pos", levels).alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", "digest", *(["own"] if own else [])))).alias("e"))
    cut = cut.join(sizes.select("tree", (F.col("n") <= 1 << levels).alias("lone")), "tree")
    part = lambda name: F.transform("e", lambda x: x[name]).alias(name)
    blocks, _ = written(cut.select("tree", "block", "lone", part("pos"), part("digest"), *([part("own")] if own else [])), "merkle-blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tree, block, lone, leaves = (b.column(k) for k in range(4))
            roots = [grown(x, None if y else levels, witnessed=False)[1] for x, y in zip(leaves.to_pylist(), lone.to_pylist())]
            yield pa.RecordBatch.from_arrays([tree, block, pa.array(roots, pa.string()), lone], names=["tree", "pos", "digest", "lone"])

    roots, _ = written(blocks.select("tree", "block", "lone", "digest").mapInArrow(run, "tree string, pos long, digest string, lone boolean"), "merkle-roots")
    return blocks, roots


def _opened(blocks: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """Each entry of the blocks with its path: the witness inside its block, then that of the block; above: tree, block, subroot, root, path."""
    rows = blocks.join(above, ["tree", "block"])
    own = "own" in blocks.columns
    cols = ["tree", "lone", "subroot", "root", F.col("path.left").alias("left"), F.col("path.sibling").alias("sibling"), "pos", "digest", *(["own"] if own else [])]
    kind = f", own {blocks.schema['own'].dataType.elementType.simpleString()}" if own else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                one = b.slice(r, 1)
                tree, lone, subroot, root, left, sibling = (one.column(k)[0].as_py() for k in range(6))
                leaves = one.column(7).flatten()
                f, _ = grown(leaves.to_pylist(), None if lone else levels)
                sides = [s for x in f.sides for s in (*x, *left)]
                siblings = [s for x in f.siblings for s in (*x, *sibling)]
                ends = [0]
                for x in f.sides:
                    ends.append(ends[-1] + len(x) + len(left))
                steps = pa.StructArray.from_arrays([pa.array(sides, pa.bool_()), pa.array(siblings, pa.string())], names=["left", "sibling"])
                same = lambda v: pa.array([v] * f.n, pa.string())  # noqa: E731, B023
                out = [same(tree), one.column(6).flatten(), leaves, same(subroot), same(root), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), steps)]
                names = ["tree", "pos", "digest", "subroot", "root", "path"]
                if own:
                    out, names = [*out, one.column(8).flatten()], [*names, "own"]
                yield pa.RecordBatch.from_arrays(out, names=names)

    return rows.select(*cols).mapInArrow(run, f"tree string, pos long, digest string, subroot string, root string, path {PATH}{kind}")


def forest(leaves: DataFrame, order: list[str], joined: bool, levels: int = LEVELS) -> DataFrame:
    """leaves (tree, digest, own) -> tree, pos, digest, subroot (of its tree), root, path (siblings from the leaf upwards), own.

    joined: the roots of the trees, in the order of their names, are the leaves of one more tree, whose root is ``root``; else root is subroot.
    Block roots are appended to the next level like leaves until each tree is one node; then paths are completed from the top down. Only block
    rows meet the paths from above, so those are never moved for each leaf.
    """
    entries, sizes = positions(leaves, order)
    sizes, _ = written(sizes, "merkle-sizes")
    climbed = []
    while True:
        blocks, roots = _blocks(entries, sizes, levels)
        climbed.append((blocks, roots))
        entries = roots.filter("not lone").select("tree", "pos", "digest")
        if entries.isEmpty():
            break
        sizes = sizes.filter(F.col("n") > 1 << levels).select("tree", F.ceil(F.col("n") / (1 << levels)).alias("n"))

    tops = climbed[0][1].filter("lone")
    for _, roots in climbed[1:]:
        tops = tops.unionByName(roots.filter("lone"))
    tops = tops.select("tree", F.col("digest").alias("subroot"))
    if joined:
        named = tops.select(F.lit("").alias("tree"), F.col("subroot").alias("digest"), F.struct("tree").alias("own"))
        tops = forest(named, ["tree"], False, levels).select("own.tree", F.col("digest").alias("subroot"), "root", "path")
    else:
        tops = tops.select("tree", "subroot", F.col("subroot").alias("root"), F.array().cast(PATH).alias("path"))
    tops, _ = written(tops, "merkle-tops")

    paths = None
    for k, (blocks, roots) in reversed(list(enumerate(climbed))):
        above = roots.filter("lone").select("tree", F.col("pos").alias("block")).join(tops, "tree")
        if paths is not None:
            above = above.unionByName(paths.select("tree", F.col("pos").alias("block"), "subroot", "root", "path"))
        paths = _opened(blocks, above, levels)
        if k:
            paths, _ = written(paths, "merkle-paths")
    return paths


def manifest(docs: DataFrame, columns: list[str], tree: str, order: str, forged: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """A witness of each row of docs -> order, tree (null stays null), position, leaf, forged (a leaf or null), subroot, root, path.

    A leaf is the digest of ``columns``; the rows of one value of ``tree`` ascend by ``order`` and make a tree of their own, the roots of these, null
    first and then by the bytes of the value, make the last one. path: of each level the sibling and whether it is left of the node; a
    node without a sibling is hashed alone. forged: a column expression, whose digest in place of the leaf is carried beside it.

    Rows with equal ``order`` ascend by their leaves, null comes first; rows equal in all columns are leaves each, in either order. Null and
    empty values differ (``-`` and ``0:``). Whole texts are hashed, however long. Other columns are ignored, whatever their names. An empty table gives an
    empty result. A tree of any size lies in many blocks, and no task holds more than a block of 2 ** levels leaves at a time.
    """
    spark = docs.sparkSession
    arrow_rows(spark, 16)
    named = F.coalesce(F.concat(F.lit("="), F.col(tree).cast("string")), F.lit("-"))
    own = F.struct(F.col(order).alias("key"), (F.lit(None).cast("string") if forged is None else forged).alias("forged"))
    leaves, path = written(docs.select(named.alias("tree"), leaf_of(*[F.col(c) for c in columns]).alias("digest"), own.alias("own")), "merkle-leaves")
    out = forest(leaves, ["key"], True, levels)
    discard(spark, path)
    value = F.when(F.col("tree") != "-", F.substring("tree", 2, 1 << 30))
    return out.select(F.col("own.key").alias(order), value.alias(tree), F.col("pos").alias("position"), F.col("digest").alias("leaf"), F.col("own.forged").alias("forged"), "subroot", "root", "path")


def proof(path: Column) -> Column:
    """The digest of a path's siblings from the leaf to the root."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.coalesce(s["sibling"], F.lit(""))), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and a path give."""
    step = lambda h, s: F.sha2(F.when(s["left"], F.concat(s["sibling"], h)).when(~s["left"], F.concat(h, s["sibling"])).otherwise(h), 256)
    return F.aggregate(path, leaf, step)
