"""Byte-level BPE encoding of overlapping chunks, and decoding."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, written

#: Characters of a chunk, and of the overlap in which neighbouring chunks must agree on a boundary.
CHUNK, OVERLAP = 32_768, 1_024


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """Read once per worker process; path must be readable on every executor (part of the installed package)."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def boundaries(text: str, pattern: str, upto: int | None = None) -> list[int]:
    """Starts of the pre-tokens of text, up to a position."""
    out = []
    for m in regex.compile(pattern).finditer(text):
        if upto is not None and m.start() > upto:
            break
        out.append(m.start())
    return out


@lru_cache(maxsize=2)
def token_bytes(path: str, pattern: str) -> list[bytes]:
    enc = encoding(path, pattern)
    return [enc.decode_single_token_bytes(i) for i in range(enc.n_vocab)]


def encode(text: str, enc: tiktoken.Encoding) -> np.ndarray:
    return np.array(enc.encode_ordinary(text), dtype="<u4")


def decode(ids: bytes, table: list[bytes]) -> bytes:
    """The raw bytes of all ids, joined."""
    return b"".join([table[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])


def tail_boundaries(text: str, pattern: str, start: int) -> list[int]:
    """Starts of pre-tokens from position start on that a longer text would have, too.

    Without the last two: the text's end may have cut the last one short, and a run of white space before it depends
    on the character that follows.
    """
    return [b for b in boundaries(text, pattern)[:-2] if b >= start]


def joins(heads: list[list[int]], tails: list[list[int]]) -> list[int | None]:
    """For each seam the first boundary (from the seam on) on which the chunk before and the chunk after agree.

    A match of the pattern depends on the text from its start on alone, so from a common start on both chunks have the
    same pre-tokens: there they have resynchronised. None where they don't agree within the overlap.
    """
    return [min(set(t) & set(h), default=None) for t, h in zip(tails[:-1], heads[1:], strict=True)]


#: Chunks up to which the table of seams (24 bytes for each) is sent to every task instead of moving the chunks to meet it.
SEAMS = 1_000_000


def _encode_long(long: DataFrame, path: str, pattern: str, chunk: int, overlap: int, with_decoded: bool) -> DataFrame:
    """The rows of long (_row, which is unique, _text, longer than chunk, and others) without _text, with ids, n_tokens and decoded."""
    names = [c for c in long.columns if c not in ("_row", "_text")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, text in zip(b.column(0).to_pylist(), b.column(1)):
                t = text.as_py()
                parts = [t[at : at + chunk + overlap] for at in range(0, len(t), chunk)]
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(parts), pa.int64()), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.string())], names=["_row", "_no", "_text"])

    # Written, as both passes over the chunks read them where they lie.
    chunks, _ = written(long.select("_row", "_text").mapInArrow(cut, "_row long, _no int, _text string").repartition("_row", "_no"), "bpe-chunks")

    def starts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            head = [boundaries(t, pattern, overlap) for t in pdf["_text"]]
            tail = [[b - chunk for b in tail_boundaries(t, pattern, chunk)] for t in pdf["_text"]]
            yield pd.DataFrame({"_row": pdf["_row"], "_no": pdf["_no"], "head": head, "tail": tail})

    def cuts(pdf: pd.DataFrame) -> pd.DataFrame:
        """Where each chunk's own piece begins and ends; -1 where it hangs together with its neighbour."""
        pdf = pdf.sort_values("_no")
        at = [-1 if a is None else a for a in joins(pdf["head"].tolist(), pdf["tail"].tolist())]
        end = [a + chunk if a >= 0 else -1 for a in at]
        return pd.DataFrame({"_row": pdf["_row"], "_no": pdf["_no"], "begin": [0, *at], "end": [*end, chunk]})

    seams = chunks.mapInPandas(starts, "_row long, _no int, head array<int>, tail array<int>").groupBy("_row").applyInPandas(cuts, "_row long, _no int, begin int, end int")
    if chunks.count() <= SEAMS:
        seams = F.broadcast(seams)

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The ids of a piece that is cut on both sides, the text of any other."""
        enc = encoding(path, pattern)
        for pdf in batches:
            ids, texts = [], []
            for text, begin, end in zip(pdf["_text"], pdf["begin"], pdf["end"], strict=True):
                piece = text[max(begin, 0) : end if end >= 0 else chunk]
                whole = begin >= 0 and end >= 0
                ids.append(encode(piece, enc).tobytes() if whole else None)
                texts.append(None if whole else piece)
            yield pd.DataFrame({"_row": pdf["_row"], "_no": pdf["_no"], "ids": ids, "piece": texts, "open": pdf["end"] < 0})

    def together(t: pa.Table) -> pa.Table:
        enc = encoding(path, pattern)
        out, run = [], []
        t = t.take(pa.array(np.argsort(t.column("_no").to_numpy())))
        for ids, piece, goes_on in zip(*(t.column(c).to_pylist()[1:] for c in ("ids", "piece", "open")), strict=True):
            if ids is not None:
                out.append(ids)
                continue
            run.append(piece)
            if not goes_on:
                out.append(encode("".join(run), enc).tobytes())
                run = []
        ids = b"".join(out)
        back = decode(ids, token_bytes(path, pattern)) if with_decoded else None
        made = [pa.array([ids], pa.binary()), pa.array([len(ids) // 4], pa.int64()), pa.array([back], pa.binary())]
        return pa.Table.from_arrays([*t.slice(0, 1).select(names).columns, *made], names=[*names, "ids", "n_tokens", "decoded"])

    done = chunks.join(seams, ["_row", "_no"]).mapInPandas(pieces, "_row long, _no int, ids binary, piece string, open boolean")
    # The row's other columns come to its pieces as one more, before the first: so ids are moved once.
    both = done.unionByName(long.drop("_text").withColumn("_no", F.lit(-1)), allowMissingColumns=True)
    return both.groupBy("_row").applyInArrow(together, long.select(*names).schema.add("ids", "binary").add("n_tokens", "long").add("decoded", "binary"))


def encoded(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP, with_decoded: bool = False, with_text: bool = True) -> DataFrame:
    """docs with ids (binary: little-endian unsigned 32-bit) and n_tokens added; columns of these names are replaced.

    Each match of the pattern is encoded separately, without special tokens; null counts as empty (no ids). Texts up
    to ``chunk`` characters are encoded where they are. Longer ones are cut in chunks that run on for ``overlap``
    characters; chunks are dealt over all tasks and pre-tokenised there. Where two neighbours agree on a boundary
    within their overlap they are cut, and each encodes its own piece; where they don't (a pre-token longer than the
    overlap), the pieces on both sides are encoded as one when the text's ids are put together. Long rows are numbered
    before they are cut, so repeated rows and ids don't matter. An empty table gives an empty result; other columns are kept whatever their names.

    with_decoded: also decode the ids, in the same pass, to the column ``decoded`` (binary). with_text: keep the column text; without it, long texts aren't
    moved beside their chunks.
    """
    arrow_rows(docs.sparkSession, 512)
    added = ["ids", "n_tokens", *(["decoded"] if with_decoded else []), *([] if with_text else ["text"])]
    keep = [c for c in docs.columns if c not in added]
    names = [f"c{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for b in batches:
            ids = [encode(t, enc) for t in b.column(b.num_columns - 1).to_pylist()]
            back = [decode(i.tobytes(), token_bytes(path, pattern)) if with_decoded else None for i in ids]
            columns = [*b.columns[:-1], pa.array([i.tobytes() for i in ids], pa.binary()), pa.array([len(i) for i in ids], pa.int64()), pa.array(back, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[*b.schema.names[:-1], "ids", "n_tokens", "decoded"])

    short = rows.filter(F.length("_text") <= chunk)
    short = short.mapInArrow(whole, rows.drop("_text").schema.add("ids", "binary").add("n_tokens", "long").add("decoded", "binary"))
    long, _ = written(rows.filter(F.length("_text") > chunk).withColumn("_row", F.monotonically_increasing_id()), "bpe-long")
    both = short.unionByName(_encode_long(long, path, pattern, chunk, overlap, with_decoded))
    return both.select(*[F.col(n).alias(c) for c, n in zip(keep, names)], *[a for a in added if a != "text"])


def decoded(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """rows (with ids as ``encoded`` makes them) with ``decoded`` (binary) added: the raw bytes of all ids, joined."""
    arrow_rows(rows.sparkSession, 512)
    keep = [c for c in rows.columns if c != "decoded"]
    names = [f"c{i}" for i in range(len(keep))]
    inner = rows.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], F.col("ids").alias("_ids"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(path, pattern)
        for b in batches:
            out = [decode(x, table) if x is not None else None for x in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.binary())], names=[*b.schema.names[:-1], "decoded"])

    got = inner.mapInArrow(join, inner.drop("_ids").schema.add("decoded", "binary"))
    return got.select(*[F.col(n).alias(c) for c, n in zip(keep, names)], "decoded")
