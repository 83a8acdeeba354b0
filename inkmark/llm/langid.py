"""Language identification by prediction by partial matching (PPM) over bytes, under frozen statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows

#: Bytes of training text per language at most; with it the model's size is bounded whatever the corpus.
SAMPLE_BYTES = 262_144
#: Longest context, in bytes.
ORDER = 3
#: Up to so many code lengths (contexts * symbols * languages) the model is one table; beyond, the trees are kept apart, with the same lengths.
MAX_CELLS = 24_000_000
#: Bytes scored at once.
SLICE = 1 << 18


@dataclass
class PPM:
    """The context trees of all languages over one set of contexts.

    symbol: byte -> symbol (the last one but one stands for bytes never seen in training; the last for "before the text").
    context: [third last, second last, last symbol] -> the longest context in any of the trees.
    bits: [context, symbol, language] -> exact code length, escapes included.
    """

    languages: list[str]
    symbol: np.ndarray
    context: np.ndarray
    bits: np.ndarray

    def lengths(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Code length in bits of each text data[starts[i]:starts[i + 1]] under each language."""
        out = np.zeros((len(starts) - 1, len(self.languages)))
        a, n_sym = self.context.shape[0], self.bits.shape[1]
        outside = a - 1
        flat = self.context.reshape(-1)
        bits = self.bits.reshape(-1, len(self.languages))
        for lo in range(0, len(data), SLICE):
            hi = min(lo + SLICE, len(data))
            back = min(lo, ORDER)
            s = np.full(hi - lo + ORDER, outside, dtype=np.int32)
            s[ORDER - back :] = self.symbol[data[lo - back : hi]]
            s1, s2, s3 = s[2:-1].copy(), s[1:-2].copy(), s[:-3].copy()
            first, last = np.searchsorted(starts, [lo, hi])
            for d, col in ((0, s1), (0, s2), (1, s2), (0, s3), (1, s3), (2, s3)):  # a text's first bytes have no bytes before them
                at = starts[(starts + d >= lo) & (starts + d < hi)] + d - lo
                col[at] = outside
            node = flat[(s3 * a + s2) * a + s1]
            cost = bits[node * n_sym + s[ORDER:]]
            cut = np.unique(np.concatenate(([lo], starts[first:last])))
            cut = cut[cut < hi]
            sums = np.add.reduceat(cost, cut - lo, axis=0, dtype=np.float64)
            owner = np.searchsorted(starts, cut, side="right") - 1
            np.add.at(out, owner, sums)
        return out


@dataclass
class Trees:
    """The context trees of all languages, each by itself: its size is that of the samples, whatever the number of languages.

    trees: of each language and order the contexts with their escapes, and the pairs of context and next byte with their lengths, in order of
    their codes (the bytes before, and the next byte, as one number).
    """

    languages: list[str]
    trees: list[list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]

    def lengths(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Code length in bits of each text data[starts[i]:starts[i + 1]] under each language."""
        out = np.zeros((len(starts) - 1, len(self.languages)))
        for lo in range(0, len(data), SLICE):
            hi = min(lo + SLICE, len(data))
            back = min(lo, ORDER)
            s = np.zeros(hi - lo + ORDER, dtype=np.uint32)
            s[ORDER - back :] = data[lo - back : hi]
            owner = np.searchsorted(starts, np.arange(lo, hi), side="right") - 1
            far = np.arange(lo, hi) - starts[owner]  # bytes of the text before this one
            code = [np.zeros(hi - lo, dtype=np.uint32)]
            for k in range(1, ORDER + 1):
                code.append(code[-1] | s[ORDER - k : len(s) - k] << np.uint32(8 * (k - 1)))
            for at, tree in enumerate(self.trees):
                cost = np.full(hi - lo, 8.0, dtype=np.float32)
                for k, (contexts, escape, pairs, bits) in enumerate(tree):
                    if not len(contexts):
                        continue
                    pair = code[k] << np.uint32(8) | s[ORDER:]
                    i, j = np.searchsorted(pairs, pair), np.searchsorted(contexts, code[k])
                    i, j = np.minimum(i, len(pairs) - 1), np.minimum(j, len(contexts) - 1)
                    here = np.where(pairs[i] == pair, bits[i], cost + np.where(contexts[j] == code[k], escape[j], np.float32(0)))
                    cost = np.where(far >= k, here, cost)
                out[:, at] += np.bincount(owner, weights=cost, minlength=len(out))
        return out


def _trees(samples: dict[str, bytes]) -> Trees:
    languages, trees = sorted(samples), []
    for lang in languages:
        s, tree = np.frombuffer(samples[lang], dtype=np.uint8).astype(np.uint32), []
        for k in range(ORDER + 1):
            n = max(len(s) - k, 0)
            code = np.zeros(n, dtype=np.uint32)
            for j in range(k):
                code = code << np.uint32(8) | s[j : j + n]
            pairs, times = np.unique(code << np.uint32(8) | s[k : k + n], return_counts=True)
            contexts, group = np.unique(pairs >> np.uint32(8), return_inverse=True)
            total, different = np.bincount(group, weights=times, minlength=len(contexts)), np.bincount(group, minlength=len(contexts))
            escape = np.log2((total + different) / different) if len(contexts) else total
            bits = np.log2((total + different)[group] / times) if len(pairs) else times
            tree.append((contexts, escape.astype(np.float32), pairs, bits.astype(np.float32)))
        trees.append(tree)
    return Trees(languages, trees)


def train(samples: dict[str, bytes], max_cells: int = MAX_CELLS) -> PPM | Trees:
    """Count the contexts of up to ORDER bytes in each language's sample and freeze the code lengths.

    A symbol seen c times in a context of n symbols, d of them different, has probability c / (n + d) there; the escape
    to the next shorter context has d / (n + d) (method C, without exclusion). Below the empty context all 256
    bytes are equally likely. A context that a language has not seen costs it nothing and leaves the next shorter one.
    The trees share one set of contexts where that takes max_cells lengths at most (four bytes each). Beyond (many languages) they
    are kept apart, at most 12 bytes for each order and byte of the samples: no context is left out, and code lengths are the same.
    """
    languages = sorted(samples)
    seen = np.zeros(256, dtype=bool)
    for text in samples.values():
        seen[np.frombuffer(text, dtype=np.uint8)] = True
    n_sym = int(seen.sum()) + 1
    symbol = np.full(256, n_sym - 1, dtype=np.int32)
    symbol[seen] = np.arange(n_sym - 1)
    a = n_sym + 1
    grams = {lang: symbol[np.frombuffer(samples[lang], dtype=np.uint8)].astype(np.int64) for lang in languages}

    def code(s: np.ndarray, k: int) -> np.ndarray:
        """Of each position from k on: the k symbols before it as a number, the last symbol in the lowest place."""
        n = len(s) - k
        c = np.zeros(max(n, 0), dtype=np.int64)
        for j in range(k):
            c = c * a + s[j : j + n]
        return c

    # A context of k bytes is kept with all its shorter suffixes, which are contexts of any text that holds it.
    codes = [np.zeros(1, dtype=np.int64)]
    for k in range(1, ORDER + 1):
        codes.append(np.unique(np.concatenate([code(s, k) for s in grams.values()] + [np.zeros(0, dtype=np.int64)])))
    if sum(map(len, codes)) * n_sym * len(languages) > max_cells:
        return _trees(samples)
    base = np.cumsum([0] + [len(c) for c in codes])
    bits = np.zeros((base[-1], n_sym, len(languages)), dtype=np.float32)
    for at, lang in enumerate(languages):
        s = grams[lang]
        lower = np.full((1, n_sym), 8.0)
        for k in range(ORDER + 1):
            seen_code = code(s, k)
            ctx = np.searchsorted(codes[k], seen_code)
            pair, times = np.unique(ctx * n_sym + s[k:], return_counts=True)
            count = np.zeros(len(codes[k]) * n_sym)
            count[pair] = times
            count = count.reshape(-1, n_sym)
            n, d = count.sum(1), (count > 0).sum(1)
            below = lower[np.searchsorted(codes[k - 1], codes[k] % a ** (k - 1))] if k else lower
            with np.errstate(divide="ignore", invalid="ignore"):
                hit = np.log2((n + d)[:, None] / count)
                escape = np.where(n > 0, np.log2((n + d) / d), 0.0)
            lower = np.where(count > 0, hit, escape[:, None] + below)
            bits[base[k] : base[k + 1], :, at] = lower
    context = np.zeros((a, a, a), dtype=np.int32)
    for k in range(1, ORDER + 1):
        c = codes[k]
        ids = base[k] + np.arange(len(c))
        part = [(c // a**j) % a for j in range(k)]  # part[0]: last symbol
        if k == 1:
            context[:, :, part[0]] = ids
        elif k == 2:
            context[:, part[1], part[0]] = ids
        else:
            context[part[2], part[1], part[0]] = ids
    return PPM(languages, symbol, context, bits)


def sample(labelled: DataFrame, bytes_per_language: int = SAMPLE_BYTES) -> dict[str, bytes]:
    """A bounded sample of the rows (doc_id, text, lang): each language's distinct texts in the order of a hash, until the bound is full.

    A language's share of hashes is set from what its rows can give (of one text at most the bound), so that about 1.5
    times the bound is drawn; a language that stays below the bound, as of copies, is drawn again with a larger share,
    up to all of it. The order doesn't depend on the share, so neither does the sample.
    """
    rows = labelled.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    totals = rows.groupBy("lang").agg(F.sum(F.least(F.octet_length("text"), F.lit(bytes_per_language))).alias("n")).filter("n > 0").collect()
    share = {r["lang"]: min(1.0, 1.5 * bytes_per_language / r["n"]) for r in totals}
    rows = rows.select("lang", F.substring("text", 1, bytes_per_language).alias("text")).withColumn("_h", F.pmod(F.xxhash64("text"), F.lit(1 << 40)))
    out: dict[str, bytes] = {}
    while share:
        bound = F.create_map(*[F.lit(x) for k, v in share.items() for x in (k, v * (1 << 40))])
        drawn = rows.filter(F.col("_h") < bound[F.col("lang")]).groupBy("lang", "text").agg(F.min("_h").alias("_h"))
        got = {k: bytearray() for k in share}
        for r in drawn.orderBy("lang", "_h", "text").toLocalIterator():
            part = got[r["lang"]]
            if len(part) < bytes_per_language:
                part += (b"\n" if part else b"") + r["text"].encode()
        for k, v in got.items():
            if len(v) >= bytes_per_language or share[k] >= 1:
                out[k] = bytes(v[:bytes_per_language])
                del share[k]
            else:
                share[k] = min(1.0, share[k] * max(4, min(64, 2 * bytes_per_language // max(len(v), 1))))
    return {k: v for k, v in out.items() if v}


def predict(docs: DataFrame, model: PPM | Trees | None) -> DataFrame:
    """docs with lang_pred, score and bits_per_byte added (columns of these names are replaced).

    lang_pred: the language that codes the whole text in the fewest bits (ties: the first by name); ``und`` with score
    0 if the text is null or empty, has no letter, or no language was learned. score: the share of that language
    when each weighs 2^-bits, from 0 to 1. Long texts are scored in slices that carry the context over. Rows are
    scored where they are, without a shuffle. Only the text decides. Repeated rows come out as often as they came in; an empty
    table gives an empty result; other columns are kept whatever their names.
    """
    spark = docs.sparkSession
    arrow_rows(spark, 512)
    keep = [c for c in docs.columns if c not in ("lang_pred", "score", "bits_per_byte")]
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)], F.when(letters, F.encode("text", "UTF-8")).alias("_text"))
    schema = rows.drop("_text").schema.add("lang_pred", "string").add("score", "double").add("bits_per_byte", "double")
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            text = b.column(b.num_columns - 1)
            known = np.flatnonzero(np.asarray(text.is_valid())) if m else np.zeros(0, dtype=int)
            lang, prob, rate = np.full(len(text), "und", dtype=object), np.zeros(len(text)), np.zeros(len(text))
            if len(known):
                parts = [text[int(i)].as_buffer() for i in known]
                starts = np.cumsum([0] + [x.size for x in parts])
                data = np.frombuffer(b"".join(parts), dtype=np.uint8)
                bits = m.lengths(data, starts)
                best = bits.argmin(1)
                low = bits.min(1)
                lang[known] = np.array(m.languages, dtype=object)[best]
                prob[known] = 1 / np.exp2(np.maximum(low[:, None] - bits, -1000)).sum(1)
                rate[known] = low / np.diff(starts)
            columns = [*b.columns[:-1], pa.array(lang, pa.string()), pa.array(prob), pa.array(rate)]
            yield pa.RecordBatch.from_arrays(columns, names=[*b.schema.names[:-1], "lang_pred", "score", "bits_per_byte"])

    out = rows.mapInArrow(score, schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], "lang_pred", "score", "bits_per_byte")


def held_out(doc_id: Column) -> Column:
    """Rows that the model must not learn from: crc32 of doc_id as text leaves 1 when divided by 3 (null: learned from neither)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def fit(docs: DataFrame) -> PPM | Trees | None:
    got = sample(docs.filter(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    return train(got) if got else None


def apply_langid(docs: DataFrame, min_score: float = 0.5) -> DataFrame:
    """docs whose language is known with at least min_score; null, empty and letterless texts go."""
    cols = [F.col(c).alias(f"k{i}") for i, c in enumerate(docs.columns)]
    scored = predict(docs.select(*cols, "text"), fit(docs))
    return scored.filter((F.col("lang_pred") != "und") & (F.col("score") >= min_score)).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(docs.columns)])
