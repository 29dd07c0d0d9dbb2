"""A corpus pipeline of five stages over ``documents``: language ID, SimHash near-duplicates, personal data, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents.

Rows: a null or empty text, or one without a letter, is rejected by the first stage; null ids are ids of their own; rows that repeat an id are told apart by their
place in the written input; null sources are a source; other columns than those of documents go; empty documents give empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm import byte_bpe, language_id, mixing, pii_bootstrap, simhash_dedup
from leadloom.llm.common import new_path, stash
from leadloom.llm.queries import VOCABULARY, token_digests

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents whose best cosine is lower are rejected, as are those without a letter. Texts that share no trigram with any language have cosines around
#: 1 / sqrt(1024) = 0.03; this is twice as much, and still under those of clean texts of a few words.
MIN_LANGUAGE_SCORE = 0.06


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go; a missing lang is filled in."""
    prototypes = language_id.train(docs.where(~language_id.held_out()))
    found = language_id.predict(docs, prototypes, keep=COLUMNS, text="text")
    kept = found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component one row stays: that with the smallest id, nulls last, and of rows that repeat it any one. Rows are told apart
    by a key that is written with them, so rows of one id with other texts stay or go each by its own."""
    rows = stash(docs.select(*COLUMNS).withColumn("__row", F.monotonically_increasing_id()), "rows")
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("__row").alias("row"))
    found = simhash_dedup.near_duplicates(rows.withColumn("__key", key), id_col="__key")
    losers = stash(found.where("__key.row <> component_id.row").select(F.col("__key.row").alias("__row")), "losers")
    return rows.join(losers, "__row", "left_anti").select(*COLUMNS)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, with the found spans replaced by their kinds; n_chars follows."""
    return pii_bootstrap.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, written in the order of their slots."""
    mixed = mixing.mix(docs, keep=COLUMNS)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return mixed.repartitionByRange(parts, "slot", "block_pos").sortWithinPartitions("slot", "block_pos").select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(VOCABULARY)
    return token_digests(byte_bpe.round_trip(docs, path, public_tokenizers.PATTERN))


STAGES = [
    ("language_id", identify_language),
    ("simhash_dedup", drop_near_duplicates),
    ("pii_bootstrap", redact_personal_data),
    ("mixing", mix_sources),
    ("byte_bpe", tokenize),
]

#: SQL cannot express the language profiles; tests/llm compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
