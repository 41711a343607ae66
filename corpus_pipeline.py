"""A corpus from raw documents to packed sequences.

Each stage applies one operator to all documents its predecessor kept.

Defined results: documents with null or blank text go at the first stage, as
their language can't be told; a text left empty by a later stage stays, as a
document whose one piece is the end id; rows that repeat id and text are one
document to the dedup stages and each get the same lines and bytes, and one of
them stays at near-duplicate removal; rows that repeat an id only are told
apart by text; a null id sorts last; texts are taken whole at any length; other
columns pass through all stages but the last, whatever their names (``n_chars``
follows the text); an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewise.llm import language_id, line_dedup, packing, simhash_dedup, suffix_dedup
from sitewise.llm.common import documents, lean_workers, small_batches, stash


def _sized(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows the text, where documents have it."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without text in a language that can be told go."""
    lean_workers(spark)
    small_batches(spark)
    return language_id.accepted(language_id.identify(docs), docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines similar to an earlier one go."""
    return _sized(line_dedup.with_kept_text(line_dedup.dedup(docs), docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints stays."""
    lean_workers(spark)
    small_batches(spark)
    return simhash_dedup.representatives(docs)


def drop_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of long strings that came before go."""
    lean_workers(spark)
    small_batches(spark)
    return _sized(suffix_dedup.with_kept_text(suffix_dedup.dedup(docs), docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in sequences."""
    lean_workers(spark)
    small_batches(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("simhash_dedup", drop_near_duplicates),
    ("suffix_dedup", drop_repeated_strings),
    ("best_fit_packing", pack),
]

#: SQL can't express the learned model, the fingerprints and the tokenizer; a test has brute-force stages instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
