"""Main text of web pages: page structure, and the runs of tokens that a host repeats over its pages."""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, discard, written

#: A run of MIN_TOKENS tokens, or a whole block of fewer, on at least MIN_PAGES distinct pages of a host is boilerplate.
MIN_TOKENS, MIN_PAGES = 6, 3

# Element names by what they do to the text.
SILENT = "script style noscript template svg math iframe object embed canvas audio video map head title textarea select option datalist button"
PERIPHERAL = "nav header footer aside form menu dialog fieldset"
VOID = "area base br col embed hr img input link meta param source track wbr"
INLINE = "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr"
CLOSED_BY_BLOCK = "p"
# Roles, and names in class and id values, of what is beside the article. Names are read in parts, cut at - and _: a part of the first
# list marks its element wherever it stands (but for one after a word that negates it); those of the second with nothing but parts of the last beside them, or each other.
ROLES = "navigation search complementary contentinfo form dialog alertdialog"
BESIDE = "ad ads advert adverts advertisement sponsored breadcrumb breadcrumbs comment comments consent cookie cookies footer nav navbar navigation newsletter pager pagination sidebar signup subscribe"
ALONE = "menu promo related share sharing social"
PARTS = "area article articles banner bar block box button buttons container form icons item items label links list modal notice panel popup post posts section slot stories story thread unit widget wrapper"
NEGATED = "has no non with without"
#: These two say nothing for sure when they stand alone: what the host repeats decides.
DOUBTFUL = "share social"
# Of the same kind, but within an article they may hold its heading.
HEADING = "banner header masthead site-header page-header"
# Elements whose names mark nothing, as they are text themselves.
TEXT = "p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th figcaption"
_SILENT, _PERIPHERAL, _VOID, _INLINE, _ROLES, _HEADING, _BESIDE, _ALONE, _PARTS, _NEGATED, _DOUBTFUL, _TEXT = (
    frozenset(x.split()) for x in (SILENT, PERIPHERAL, VOID, INLINE, ROLES, HEADING, BESIDE, ALONE, PARTS, NEGATED, DOUBTFUL, TEXT)
)

# An attribute's quotes count after its = alone, and what the page's end cuts short is a tag or comment still: no part is read twice.
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|textarea|title|iframe|template)\b[^>]*(?:>|\Z).*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>=]|=\s*+(?:\"[^\"]*+\"|'[^']*+')?)*+)(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class Block:
    text: str
    inside: bool  # in an article or main element
    beside: bool  # in an element that is not part of the article by its name or marks
    doubt: bool = False  # in an element whose name may mean either
    prose: bool = False  # in a paragraph, heading, list item or the like (TEXT)


SURE, PERHAPS, NOT = 2, 1, 0


def _named(value: str) -> int:
    """What one class or id value says of its element."""
    parts = [x for x in re.split("[-_]+", value) if x]
    if any(x in _BESIDE and (k == 0 or parts[k - 1] not in _NEGATED) for k, x in enumerate(parts)):
        return SURE
    if parts and any(x in _ALONE for x in parts) and all(x in _ALONE or x in _PARTS for x in parts):
        return PERHAPS if len(parts) == 1 and parts[0] in _DOUBTFUL else SURE
    return NOT


def _is_beside(name: str, attributes: str, inside: bool) -> int:
    if name in _PERIPHERAL:
        return NOT if name == "header" and inside else SURE
    if name in ("html", "body") or not attributes:
        return NOT
    has = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    if "hidden" in has or has.get("aria-hidden", "").lower() == "true" or _UNSEEN.search(has.get("style", "")):
        return SURE
    if name == "main" or name in _INLINE:
        return NOT
    if has.get("role", "").lower() in _ROLES:
        return SURE
    if name in _TEXT:
        return NOT
    marks = (has.get("class", "") + " " + has.get("id", "")).lower().split()
    return max((SURE if x in _HEADING and not inside else _named(x) for x in marks), default=NOT)


def blocks(page: str) -> list[Block]:
    """The page's text in blocks: character references decoded, white space made one space, empty blocks left out.

    A block ends where a block-level element begins or ends. Text in elements that are never shown is left out.
    An end tag closes the innermost open element of its name, and what is open within it; without one it is ignored.
    An inline end tag doesn't close a block-level element. Time grows with the page's length alone.
    """
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, bool, bool, bool, int]] = []  # name, beside, inside, silent, in doubt, prose, block-level elements up to here
    places: defaultdict[str, list[int]] = defaultdict(list)  # where in the stack a name is
    piece: list[str] = []
    beside = inside = silent = doubt = prose = False

    def flush() -> None:
        if piece:
            text = " ".join(html.unescape("".join(piece)).split())
            piece.clear()
            if text and not silent:
                out.append(Block(text, inside, beside, doubt, prose))

    def close(k: int) -> None:
        while len(stack) > k:
            places[stack.pop()[0]].pop()

    at = 0
    for m in _TAG.finditer(page):
        if m.start() > at and not silent:
            piece.append(page[at : m.start()])
        at = m.end()
        if m[3] is None:
            continue
        name, end = m[3].lower(), m[2] == "/"
        if name == "br":
            piece.append(" ")
            continue
        if name not in _INLINE:
            flush()
        elif name in ("img", "wbr"):
            continue
        if end:
            if places[name]:
                k = places[name][-1]
                if name in _INLINE and stack[-1][6] > stack[k][6]:
                    continue
                close(k)
        elif name in _VOID or name == "svg" and m[4].endswith("/"):
            continue
        else:
            if name not in _INLINE:
                while stack and (stack[-1][0] == CLOSED_BY_BLOCK or stack[-1][0] in _INLINE and places[CLOSED_BY_BLOCK]):
                    close(len(stack) - 1)
            was_beside, was_inside, was_silent, was_doubt, was_prose, level = stack[-1][1:] if stack else (False, False, False, False, False, 0)
            frame = name in ("article", "main")
            mark = _is_beside(name, m[4], was_inside or frame)
            if mark and name in _INLINE:
                flush()
            places[name].append(len(stack))
            stack.append((name, was_beside or mark == SURE, was_inside or frame, was_silent or name in _SILENT and name != "head", was_doubt or mark == PERHAPS, name in _TEXT or was_prose and not frame, level + (name not in _INLINE)))
        new = stack[-1][1:6] if stack else (False, False, False, False, False)
        if new != (beside, inside, silent, doubt, prose):
            flush()
            beside, inside, silent, doubt, prose = new
    if at < len(page) and not silent:
        piece.append(page[at:])
    flush()
    return out


#: What a block is to the decision: boilerplate by its marks, open to what the host repeats, prose of the page's article, there with a doubtful mark, there outside prose.
MARKED, OPEN, FRAME, DOUBT, BARE = 0, 1, 2, 3, 4


def sorted_out(page: str) -> tuple[str | None, list[str], list[int]]:
    """(text, blocks, kinds) of a page: all its blocks, and what the structure makes of each. It decides no page that has a block: text is None, or empty where there is none."""
    cut = blocks(page)
    kinds = [MARKED if b.beside else OPEN if not b.inside else DOUBT if b.doubt else FRAME if b.prose else BARE for b in cut]
    return None if cut else "", [b.text for b in cut], kinds


def uncovered(texts: list[str], kinds: list[int], marks: list[int], min_tokens: int) -> set[int]:
    """Of a stream's blocks those that no mark of their own and nothing the host repeats takes away. A short whole says nothing about an article's bare block."""
    sizes = [t.count(" ") + 1 for t in texts]
    start = np.zeros(sum(sizes) + 1, dtype=np.int64)
    runs = np.array([x for x in marks if x >= 0], dtype=np.int64)
    np.add.at(start, runs, 1)
    np.add.at(start, np.minimum(runs + min_tokens, len(start) - 1), -1)
    covered, whole, at, out = np.cumsum(start[:-1]) > 0, {-1 - x for x in marks if x < 0}, 0, set()
    for n, (k, size) in enumerate(zip(kinds, sizes)):
        if k != MARKED and (n not in whole or k == BARE) and not covered[at : at + size].all():
            out.add(n)
        at += size
    return out


def unique_runs(texts: list[str], kinds: list[int], marks: list[int] | None, min_tokens: int, known: bool = True) -> str:
    """The text of a page: the blocks that its host doesn't repeat, checked against the page's structure.

    marks: where in its stream (the tokens of all blocks but the article's prose) a repeated run begins; -1 - i for the i-th block of the
    stream if it is a repeated whole; None if all blocks without a mark of their own are covered. Blocks in doubt, open or bare that are covered by repeated
    runs go, others stay whole. The check: marked blocks go, an article's prose stays; bare blocks stay as well if the covered ones are more than half of the article's
    tokens (which then is a copy). Where there is an article, what stays beside it counts only if it is longer than the article (which then is a teaser), and the
    host is ``known``, that is, has so many pages that it would show what it repeats.
    """
    sizes = [t.count(" ") + 1 for t in texts]
    stream = [i for i, k in enumerate(kinds) if k != FRAME]
    kept = set() if marks is None else {stream[n] for n in uncovered([texts[i] for i in stream], [kinds[i] for i in stream], marks, min_tokens)}
    frame = {i for i, k in enumerate(kinds) if k == FRAME or i in kept and k in (DOUBT, BARE)}
    covered = {i for i, k in enumerate(kinds) if k == BARE and i not in kept}
    if sum(sizes[i] for i in covered) > sum(sizes[i] for i in frame):
        frame |= covered
    beside = {i for i in kept if kinds[i] == OPEN}
    if frame and (not known or sum(sizes[i] for i in beside) <= sum(sizes[i] for i in frame)):
        beside = set()
    return "\n".join(texts[i] for i in sorted(beside | frame))


def host(url) -> Column:
    """The host of a URL in lower case; empty for null or a URL without one."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def suffix_array(streams: DataFrame, depth: int) -> DataFrame:
    """The suffix array of each host's concatenated streams (row, host, texts, and pages: how many pages have it, else 1) to a depth in tokens: (host, key, row, at, pages), in its order.

    A stream is the tokens of a page, given once however many pages have the same; pages are apart, so a suffix that is shorter than ``depth`` within its page isn't in. Tokens are hashed to
    64 bits, whose order is that of the alphabet. Suffixes are sorted by ranges of (host, key, row), so a host of any share of all pages, and a
    menu that is on each of them, lie in many partitions, one after the other; a page's places of one key lie in one.
    """
    codes = F.transform(F.split(F.array_join("texts", " "), " "), lambda t: F.xxhash64(t))
    n = F.size("codes") - depth
    places = F.transform(F.when(n >= 0, F.sequence(F.lit(0), n)).otherwise(F.array().cast("array<int>")), lambda i: F.struct(F.slice("codes", i + 1, depth).alias("key"), i.alias("at")))
    pages = F.col("pages") if "pages" in streams.columns else F.lit(1)
    rows = streams.select("row", "host", pages.cast("long").alias("pages"), codes.alias("codes")).select("row", "host", "pages", F.explode(places).alias("p")).select("host", "p.key", "row", "p.at", "pages")
    array, _ = written(rows.repartitionByRange("host", "key", "row").sortWithinPartitions("host", "key", "row", "at"), "html-suffixes")
    return array


def prefixes(keys: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Longest common prefixes of neighbours in the array: of each suffix with the one before it, 0 where that is another host's."""
    equal = np.zeros(keys.shape, dtype=bool)
    equal[1:] = keys[1:] == keys[:-1]
    return np.where(same, np.cumprod(equal, axis=1).sum(axis=1), 0)


def intervals(array: DataFrame, depth: int) -> DataFrame:
    """(host, key, pages): the intervals of the array whose neighbours share ``depth`` tokens, and on how many distinct pages each stands.

    Each task goes through its part of the array in order; an interval that goes on in the next part comes in two rows, whose pages are distinct.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in filter(len, batches):
            hosts, rows, weights = b.column(0).to_numpy(zero_copy_only=False), b.column(2).to_numpy(), b.column(4).to_numpy()
            keys = b.column(1).flatten().to_numpy().reshape(b.num_rows, depth)
            if last is not None:
                hosts, keys, rows, weights = np.concatenate(([last[0]], hosts)), np.concatenate((last[1][None], keys)), np.concatenate(([last[2]], rows)), np.concatenate(([0], weights))
            same = np.concatenate(([False], hosts[1:] == hosts[:-1]))
            first = prefixes(keys, same) < depth
            page = first | np.concatenate(([True], rows[1:] != rows[:-1]))
            if last is not None:
                page[0] = False  # it was counted with the batch before
            begin = np.flatnonzero(first)
            pages = np.add.reduceat(np.where(page, weights, 0), begin)
            on = begin[pages > 0]
            last = hosts[-1], keys[-1], rows[-1]
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(on) + 1) * depth, depth), pa.int32()), pa.array(keys[on].reshape(-1)))
            yield pa.RecordBatch.from_arrays([pa.array(hosts[on], pa.string()), flat, pa.array(pages[pages > 0])], names=["host", "key", "pages"])

    # One file after the other would be cut in any case: a part of the array is what one partition was sorted to.
    return array.mapInArrow(run, "host string, key array<long>, pages long")


def repeated(streams: DataFrame, min_tokens: int = MIN_TOKENS, min_pages: int = MIN_PAGES) -> DataFrame:
    """(row, marks) of each stream: where runs of min_tokens tokens begin that at least min_pages distinct pages of its host hold, and blocks of
    fewer tokens that are wholes on so many (as -1 - their number). streams: row, host, texts of distinct streams, pages (how many distinct pages have it).

    The runs are the intervals of the host's suffix array with that common prefix; longer repeated substrings are chains of them, so what they cover is
    covered. Counts are added up before they are shuffled, so neither a hot host nor a menu that is on all its pages meets in one task, and
    all pages of a host count, wherever they lie.
    """
    array = suffix_array(streams, min_tokens)
    runs = intervals(array, min_tokens).groupBy("host", "key").agg(F.sum("pages").alias("pages")).filter(F.col("pages") >= min_pages).select("host", "key")
    runs, _ = written(runs, "html-runs")
    long = array.join(runs, ["host", "key"]).select("row", "at")
    short = F.transform("texts", lambda t, i: F.struct(F.xxhash64("host", t).alias("run"), (-1 - i).alias("at"), F.size(F.split(t, " ")).alias("n")))
    wholes = streams.select("row", "pages", F.explode(F.filter(short, lambda x: x["n"] < min_tokens)).alias("x")).select("row", "pages", "x.run", "x.at")
    often = wholes.select("row", "pages", "run").distinct().groupBy("run").agg(F.sum("pages").alias("pages")).filter(F.col("pages") >= min_pages).select("run")
    often, _ = written(often, "html-wholes")
    return long.unionByName(wholes.join(often, "run").select("row", "at")).groupBy("row").agg(F.collect_list("at").alias("marks"))


def main_text(pages: DataFrame, min_tokens: int = MIN_TOKENS, min_pages: int = MIN_PAGES) -> DataFrame:
    """pages (page_id, url, html; others are ignored) -> page_id, url, text, n_chars (code points), one row a page.

    Null, empty and blank html: empty text; null url: pages of one host without a name; repeated rows come out as often as they
    came in; an empty table gives an empty result; whole pages are read, however long.

    Every page goes the same way. Its blocks, but for its article's prose, are its stream (``sorted_out``). In the suffix array of the token streams of all pages of
    its host, runs are found that stand on several distinct pages (``repeated``): blocks that such runs cover go, unique ones are checked
    against the structure (``unique_runs``). A host with fewer pages than that shows nothing: there an article is the text, and without one all
    open blocks are. The result doesn't depend on the number of partitions or the order of rows.

    Equal streams of a host are one in the array, with the number of their pages. The blocks themselves are moved only if streams that keep something are too many to broadcast.
    """
    spark = pages.sparkSession
    arrow_rows(spark, 256)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, texts, kinds = zip(*map(sorted_out, b.column(2).to_pylist())) if len(b) else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.list_(pa.string())), pa.array(kinds, pa.list_(pa.int32()))], names=["page_id", "url", "texts", "kinds"])

    def uncovers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([bool(uncovered(t, k, m, min_tokens)) for t, k, m in zip(*(b.column(c).to_pylist() for c in ("texts", "kinds", "marks")))], pa.bool_()))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [unique_runs(t, k, m, min_tokens, w) for t, k, m, w in zip(*(c.to_pylist() for c in b.columns[2:]))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string())], names=["page_id", "url", "text"])

    def digest(texts: Column | str, kinds: Column | str) -> Column:  # no block holds a line feed
        return F.unhex(F.sha2(F.concat(F.array_join(kinds, ","), F.lit("\n"), F.array_join(texts, "\n")), 256))

    done = rows.mapInArrow(cut, "page_id long, url string, texts array<string>, kinds array<int>")
    done, _ = written(done.withColumn("row", F.monotonically_increasing_id()).withColumn("host", host(F.col("url"))), "html-blocks")
    stream = F.filter(F.arrays_zip("texts", "kinds"), lambda x: x["kinds"] != FRAME)
    stream = F.transform(stream, lambda x: x["texts"]), F.transform(stream, lambda x: x["kinds"])
    # Pages of a host that are equal in their blocks are one page; streams are named by their smallest row.
    of = done.select("row", "host", stream[0].alias("texts"), stream[1].alias("kinds"), digest("texts", "kinds").alias("page"))
    of = of.withColumn("digest", digest("texts", "kinds"))
    apart = of.groupBy("host", "digest", "page").agg(F.min("row").alias("row")).groupBy("host", "digest").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("pages"))
    apart, apart_path = written(apart, "html-pages")
    streams, streams_path = written(of.select("row", "texts", "kinds").filter(F.size("texts") > 0).join(apart, "row"), "html-streams")
    marks, marks_path = written(repeated(streams, min_tokens, min_pages), "html-marks")
    sizes = apart.groupBy("host").agg((F.sum("pages") >= min_pages).alias("known"))
    asks = streams.join(marks, "row", "left").join(sizes, "host").select("host", "digest", "texts", "kinds", F.coalesce("marks", F.array().cast("array<int>")).alias("marks"), "known")
    kept, _ = written(asks.mapInArrow(uncovers, asks.schema).select("host", "digest", "marks", "known"), "html-kept")
    discard(spark, apart_path, streams_path, marks_path)
    texts = done.withColumn("digest", digest(*stream)).join(kept, ["host", "digest"], "left").select("page_id", "url", "texts", "kinds", "marks", F.coalesce("known", F.lit(True)))
    return texts.mapInArrow(choose, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
