"""The mix with weights far apart, against a plain pass over each source in the order of its keys."""

import math
import random

from inkmark.llm import mixing


def test_weights_far_apart(spark):
    rng = random.Random(3)
    docs = [(i, "w " * rng.randrange(1, 30), rng.choice("abc")) for i in range(1500)]
    weight = {i: rng.choice([0.01, 0.5, 3.0, 500.0]) for i in range(0, 1500, 2)}
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    w = spark.createDataFrame(list(weight.items()), "doc_id long, weight double")
    u = dict(map(tuple, df.select("doc_id", mixing.uniform(df.doc_id, 0).alias("u")).collect()))
    got = mixing.mix(df, w, share=1.2).collect()
    assert len(got) == 1500
    some = 0
    for source in "abc":
        rows = sorted((r for r in got if r["source"] == source), key=lambda r: (-math.log(u[r["doc_id"]]) / weight.get(r["doc_id"], 1.0), r["doc_id"]))
        whole = math.floor(rows[0]["target"] / rows[0]["source_size"])
        rest, at = rows[0]["target"] - whole * rows[0]["source_size"], 0
        for r in rows:
            more = at + r["size"] / 2 <= rest
            assert r["copies"] == whole + more
            some += more
            at += r["size"]
    assert 0 < some < 1500
