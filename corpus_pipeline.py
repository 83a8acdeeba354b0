"""A training corpus from documents: language, exact copies, near copies, mix of sources, tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmark.llm import bpe, exact_dedup, langid, mixing, simhash
from inkmark.llm.common import discard, table, written
from inkmark.llm.queries import RANKS, quality_weights


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is known; texts that are null, empty or without a letter, or of no language for sure, go.

    Texts are scored whole, however long. Rows that repeat stay as often as they came if they stay; null ids and sources stay. An empty table, or
    one without a labelled text to learn from, gives no rows. All columns are kept, whatever their names.
    """
    return langid.apply_langid(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal whole texts (but for the case of A-Z; null counts as empty) the row with the largest doc_id.

    Rows that repeat a kept id and text all stay; rows without an id stay only where no copy has one. An empty table stays empty; all columns are kept,
    whatever their names.
    """
    return exact_dedup.apply_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, similarity 0.8, over whole texts) the row with the smallest doc_id.

    Texts without a word are near copies of their like only; rows without an id go as soon as one of them is a near copy of a row with one; rows
    that repeat the id that stays all stay. An empty table stays empty; all columns are kept, whatever their names.
    """
    return simhash.apply_near_dedup(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix of sources takes them, twice at most.

    A null source is a source of its own; a null or empty text has size 0 and comes once; rows that repeat an id and size are taken or left together;
    ties of keys go by id and size. An empty table stays empty; all columns are kept, whatever their names.
    """
    return mixing.apply_mix(docs, weights=quality_weights(spark, sf_dir), share=1.5, cap=2.0)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids_sha256 and whether decoding gives the text back, per row of the mix; the last stage, so other columns end here.

    Null counts as the empty text, with 0 tokens; whole texts are encoded, however long; rows come out as often as they came in; an empty table
    gives an empty result.
    """
    path, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    rows = docs.select("doc_id", "source", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("was"))
    out = bpe.encoded(rows, path, pattern, with_decoded=True, with_text=False)
    return out.select("doc_id", "source", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), (F.sha2("decoded", 256) == F.col("was")).alias("round_trip"))


STAGES = [("language", language), ("exact_dedup", exact), ("near_dedup", near), ("mix", mixed), ("bpe", tokens)]
#: Language models, shingle hashes and BPE are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages from documents, each written and read again; what a stage has read goes when its result is written."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs, path = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(spark, *before)
        before = [path]
    return STAGES[-1][1](spark, docs, sf_dir)
