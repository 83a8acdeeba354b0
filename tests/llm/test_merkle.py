"""Witnesses against a tree that is built level by level."""

from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from inkmark.llm import merkle

H = lambda *x: sha256("".join(x).encode()).hexdigest()


def tree(leaves):
    """Root, and of each leaf its siblings (None without one) and sides, by whole levels."""
    level, places, out = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        for path, k in zip(out, places):
            path.append((k % 2 == 1, level[k ^ 1]) if k ^ 1 < len(level) else (None, None))
        level = [H(*level[i : i + 2]) for i in range(0, len(level), 2)]
        places = [k // 2 for k in places]
    return level[0], out


@pytest.mark.parametrize("n", [1, 2, 3, 5, 6, 7, 8, 31, 33, 100])
def test_frontier_is_the_tree_of_levels(n):
    leaves = [H(str(i)) for i in range(n)]
    root, paths = tree(leaves)
    f, got = merkle.grown(leaves, None)
    assert got == root
    assert [list(zip(a, b)) for a, b in zip(f.sides, f.siblings)] == paths


def test_witnesses_are_only_extended():
    f, seen = merkle.Frontier(), []
    for i in range(37):
        f.append(H(str(i)))
        now = [list(zip(a, b)) for a, b in zip(f.sides, f.siblings)]
        assert all(new[: len(old)] == old for old, new in zip(seen, now))
        for height, root, a, b in f.open:
            assert root == tree([H(str(k)) for k in range(a, b)])[0] and all(len(now[k]) == height for k in range(a, b))
        seen = now


FIELDS = ["doc_id", "lang", "text"]


def whole(rows):
    """doc_id -> leaf, subroot, root, path, of rows (doc_id, lang, text)."""
    leaf = lambda r: H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in r])
    groups = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))):
        groups.setdefault(r[1], []).append(leaf(r))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    made = {n: tree(groups[n]) for n in names}
    root, above = tree([made[n][0] for n in names])
    return sorted(((leaf, made[n][0], root, tuple(path + above[k])) for k, n in enumerate(names) for leaf, path in zip(groups[n], made[n][1])), key=str)


def paths(got):
    plain = [(r["leaf"], r["subroot"], r["root"], tuple((s["left"], s["sibling"]) for s in r["path"])) for r in got]
    return sorted(plain, key=str)


def run(spark, rows, levels=12, partitions=3):
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(partitions)
    df = df.select("*", F.lit("x").alias("tree"), F.lit(1).alias("pos"), F.lit(2).alias("path"))
    return merkle.manifest(df, FIELDS, tree="lang", order="doc_id", levels=levels)


@pytest.mark.parametrize("levels", [2, 3, 12])
def test_manifest_is_the_tree_of_levels(spark, levels):
    rows = [(i, ["en", "de", None, "", "é", "zz"][min(i % 9, 5)], None if i % 11 == 0 else "w" * (i % 5)) for i in range(150)] + [(900, "one", "lone")]
    got = run(spark, rows, levels).collect()
    assert paths(got) == whole(rows)


def test_null_ids_repeated_rows_and_empty_tables(spark):
    rows = [(None, "en", "a"), (None, None, None), (3, "en", "a"), (3, "en", "a"), (3, "en", "b"), (1, "en", "x" * 3_000_000), (2, "-", ""), (2, "=", None)]
    got = run(spark, rows, 1).collect()
    assert paths(got) == whole(rows)
    assert {r["lang"] for r in got} == {"en", None, "-", "="}
    assert run(spark, []).collect() == []


def test_folding_shows_a_forged_leaf(spark):
    out = run(spark, [(i, "en", f"t{i}") for i in range(21)])
    out = out.select("root", merkle.folded(F.col("leaf"), F.col("path")).alias("same"), merkle.folded(F.sha2("leaf", 256), F.col("path")).alias("other"), merkle.proof(F.col("path")).alias("proof"), "path")
    for r in out.collect():
        assert r["same"] == r["root"] != r["other"] and r["proof"] == H(*[s["sibling"] or "" for s in r["path"]])
