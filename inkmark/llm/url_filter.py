"""URL filters: rules by host and path, and beside them a tree of path templates for each host, judged by labelled URLs."""

from __future__ import annotations

import math
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, lower_ascii, written

#: Segments of a path that are told apart; the last of them holds the rest of a longer path.
DEPTH = 8
#: A segment is a branch of its own if it has at least LEAST of its node's URLs and one in SHARE of them, and is not longer than LONGEST; all
#: others are one wildcard. So a node has at most SHARE branches and the wildcard.
LEAST, SHARE, LONGEST = 8, 32, 64
#: Branches with at least SURE labelled URLs each are merged where no share differs beyond Hoeffding's bound at ALPHA.
SURE, ALPHA = 32, 0.05
#: A template is rejected if (bad + STRENGTH / 2) / (labelled + STRENGTH) is LIMIT or more: with nothing but bad ones from twelve on.
STRENGTH, LIMIT = 8, 0.8


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a URL; both empty for null or a text without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    part = lambda p: F.coalesce(F.regexp_extract(rest, p, 1), F.lit(""))
    return lower_ascii(part("^([^/?#]*)")), part("^[^/?#]*([^?#]*)")


def ruled(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its action; null without one.

    rules: (action, host and path, cut at the first slash). A rule fits its host and all below it, if the path starts with the rule's. Of equally
    long ones the first by the alphabet wins.
    """
    rule = action = None
    for what, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, _, start = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{start}")
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        action = F.when(fits, what) if action is None else action.when(fits, what)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, action)


def alike(a: list[int], b: list[int]) -> bool:
    """Whether two branches (urls, ends, labelled, bad) may be one: their shares of URLs that end here and of bad ones among the labelled are as near
    as Hoeffding's bound lets two samples of one kind be."""
    if min(a[2], b[2]) < SURE:
        return False
    near = lambda i, n: abs(a[i] / a[n] - b[i] / b[n]) < math.sqrt(math.log(2 / ALPHA) / 2) * (a[n] ** -0.5 + b[n] ** -0.5)
    return near(1, 0) and near(3, 2)


def merged(branches: list[tuple[str | None, int, int, int, int]]) -> dict[str | None, str]:
    """Names of a node's branches (segment or None for the wildcard, urls, ends, labelled, bad); merged ones share a name.

    In the order of their URLs, each joins the first group whose counts are alike, or begins one. A group is named by its members, percent-encoded,
    so that no literal segment reads like a wildcard or a group.
    """
    groups: list[tuple[list[str], list[int], list[str | None]]] = []
    for segment, *counts in sorted(branches, key=lambda x: (-x[1], x[0] is None, x[0] or "")):
        name = "*" if segment is None else quote(segment, safe="")
        for names, total, members in groups:
            if alike(total, counts):
                names.append(name)
                members.append(segment)
                total[:] = [x + y for x, y in zip(total, counts)]
                break
        else:
            groups.append(([name], list(counts), [segment]))
    return {m: names[0] if len(names) == 1 else f"({'|'.join(sorted(names))})" for names, _, members in groups for m in members}


def _children(rows: DataFrame) -> DataFrame:
    """(host, node, children: map of segment to name, other: the wildcard's name) of each node; rows: host, node, seg, ends, labelled, bad."""
    counts = rows.groupBy("host", "node", "seg").agg(F.count(F.lit(1)).alias("n"), F.sum("ends").alias("ends"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    counts, _ = written(counts, "url-counts")
    numbers = ("n", "ends", "labelled", "bad")
    total = counts.groupBy("host", "node").agg(*[F.sum(c).alias(f"all_{c}") for c in numbers])
    often = counts.filter((F.col("n") >= LEAST) & (F.length("seg") <= LONGEST)).join(total.select("host", "node", "all_n"), ["host", "node"]).filter(F.col("n") * SHARE >= F.col("all_n"))
    own = often.groupBy("host", "node").agg(F.collect_list(F.struct("seg", *numbers)).alias("own"))  # at most SHARE a node
    nodes = total.join(own, ["host", "node"], "left").select("host", "node", "own", *[f"all_{c}" for c in numbers])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            children, other = [], []
            for own, *total in zip(*(c.to_pylist() for c in b.columns[2:])):
                branches = [(x["seg"], *(x[c] for c in numbers)) for x in own or []]
                rest = [t - sum(x[i + 1] for x in branches) for i, t in enumerate(total)]
                names = merged(branches + ([(None, *rest)] if rest[0] else []))
                other.append(names.pop(None, None))
                children.append(list(names.items()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(children, pa.map_(pa.string(), pa.string())), pa.array(other, pa.string())], names=["host", "node", "children", "other"])

    return written(nodes.mapInArrow(run, "host string, node string, children map<string,string>, other string"), "url-nodes")[0]


def templates(urls: DataFrame) -> DataFrame:
    """urls (host, path, bad: null without a label, and others) with template.

    The tree grows level by level: the URLs at a node are counted by their next segment (added up before they are shuffled), frequent segments
    become branches and the others one wildcard, branches that look alike are merged, and the URLs go down to their branch. No task sees a
    node's URLs together, so one host may hold most of them. There are DEPTH levels at most.
    """
    arrow_rows(urls.sparkSession, 4096)
    segments = F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(F.split(F.substring("path", 2, 1 << 30), "/", DEPTH))
    now, _ = written(urls.withColumns({"segments": segments, "node": F.lit("")}), "url-rows")
    done = []
    for level in range(DEPTH + 1):
        ended = F.size("segments") == level
        done.append(now.filter(ended).select(*urls.columns, F.col("node").alias("template")))
        active = now.filter(~ended)
        if active.isEmpty():
            break
        active = active.withColumns({"seg": F.col("segments")[level], "ends": (F.size("segments") == level + 1).cast("int")})
        tree = _children(active.select("host", "node", "seg", "ends", F.col("bad").isNotNull().cast("int").alias("labelled"), F.coalesce(F.col("bad").cast("int"), F.lit(0)).alias("bad")))
        child = F.coalesce(F.element_at("children", F.col("seg")), F.col("other"))
        now, _ = written(active.join(tree, ["host", "node"]).select(*urls.columns, "segments", F.concat("node", F.lit("/"), child).alias("node")), "url-rows")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def judged(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """pages (page_id, url) -> page_id, host, path, rule, verdict (allow or block), template, one row a page.

    rules decide where they fit (``ruled``). The others are judged by their template: those whose labelled URLs are bad with hardly an exception (a
    smoothed share, see STRENGTH) are blocked. A URL is labelled by its rule, else by labels (page_id, bad boolean; of
    several rows one that is bad counts; null ids and labels don't).

    Null urls and texts without ``://`` are of the host without a name and have no path. Repeated rows count, and come out, as often as they came
    in; urls may be of any length; an empty table gives an empty result, and without labels no template is rejected. Other columns are ignored.
    """
    host, path = host_and_path(F.col("url").cast("string"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, action = ruled(F.col("host"), F.col("path"), rules)
    known = labels.filter("page_id is not null and bad is not null").groupBy(F.col("page_id").cast("long").alias("_id")).agg(F.max("bad").alias("_bad"))
    rows = rows.withColumns({"rule": rule, "action": action}).join(known, F.col("page_id") == F.col("_id"), "left")
    rows = rows.select("page_id", "host", "path", "rule", "action", F.when(F.col("action").isNotNull(), F.col("action") == "block").otherwise(F.col("_bad")).alias("bad"))
    rows, _ = written(templates(rows), "url-templates")
    of = rows.filter("bad is not null").groupBy("host", "template").agg(F.count(F.lit(1)).alias("labelled"), F.count_if("bad").alias("bad"))
    rejected = of.filter((F.col("bad") + STRENGTH / 2) / (F.col("labelled") + STRENGTH) >= LIMIT).select("host", "template", F.lit(True).alias("_rejected"))
    j = rows.join(rejected, ["host", "template"], "left")
    return j.select("page_id", "host", "path", "rule", F.coalesce("action", F.when(F.col("_rejected"), "block").otherwise("allow")).alias("verdict"), "template")
