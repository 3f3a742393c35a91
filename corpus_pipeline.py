"""A corpus in five stages: quality, near-duplicates, repeated strings, source mix, token pieces.

Each stage takes the documents that the one before it kept and all but the last return
the columns of ``documents``; each takes an empty table and extra columns of any names. ``run`` writes each stage's rows to the shared folder, so
a lost executor costs no more than its part of one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meshweave.llm import mixing, quality_qda, sentencepiece_nbest, simhash, suffix_array
from meshweave.llm.common import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; null texts and ids and repeated rows are scored like any other."""
    return quality_qda.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates: the smallest id, nulls last; one of equal rows. Null texts are empty ones."""
    return simhash.keep_first(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of 50 bytes that one with a smaller id has; null ids lose nothing, null texts stay null."""
    return suffix_array.without_repeats(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order: whole ones, so each source is within a document of its target."""
    return mixing.mixed(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The n best segmentations of each text; null texts are empty ones."""
    import public_tokenizers

    return sentencepiece_nbest.encode_nbest(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_strings),
    ("source mix", source_mix),
    ("SentencePiece", pieces),
]

#: SQL can't express these stages; tests hold each one against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
