"""Training-corpus pipeline: five stages over ``documents``.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame.  ``run`` writes each stage's rows as Parquet in the shared
folder and reads them back as the next stage's input, so a lost executor never
sets a later stage back further than that.  All stages but the last return the
columns of ``documents``, whatever they are; the last returns token ids.

Rows are tied to decisions by doc_id and a hash of the text.  Rows equal in both
are collapsed to one by the first stage that decides about copies.
"""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storecast.llm import bytebpe, curriculum, exactdedup, langid, neardup
from storecast.llm.common import (ROW_ID, keep_rows, key_match, on_key, one_row_per_key, saved, scratch,
                                  small, start)

BYTE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

# SQL has no conditional random field, hash signatures or tokenizer.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in which some language prevails; rejected are texts
    without letters (null and empty ones too) and texts whose best language
    holds less than ``langid.MIN_SCORE`` of the words."""
    start(spark)
    model = langid.train(docs, ~langid.held_out(5, 0))
    return langid.accept(docs, model)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the smallest doc_id of texts equal up to blanks."""
    start(spark)
    return keep_rows(docs, exactdedup.exact_dedup(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document (smallest doc_id) of every near-duplicate group."""
    start(spark)
    return keep_rows(docs, saved(neardup.jaccard_join(docs), "near-decisions"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that sources meet their targets: a row per
    pass, range-sorted by training position."""
    start(spark)
    mixed = saved(curriculum.mix(docs), "mixed")
    rows = one_row_per_key(docs, mixed.select("doc_id", "text_key"))
    passes = saved(curriculum.training_order(mixed).select("doc_id", "text_key", F.col("position").alias("__position")),
                   "passes")
    joined = rows.join(small(on_key(passes)), key_match())
    return joined.orderBy("__position", ROW_ID).select(*[F.col(f"`{c}`") for c in docs.columns])


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row: doc_id, n_tokens, ids, and whether decoding the
    ids gives the text's bytes (their SHA-256)."""
    start(spark)
    coded = bytebpe.encode_decode(docs, BYTE_RANKS)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids",
                        F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("ngram_jaccard_join", near_dedup),
          ("curriculum_mix", mix_sources), ("byte_bpe", byte_bpe)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    start(spark)
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
