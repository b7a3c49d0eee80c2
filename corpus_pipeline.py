"""Corpus pipeline: language ID, SimHash near-duplicates, decontamination, mixing, token output.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; what it returns is written as
Parquet and read again as the next one's ``docs``. All but the last return the columns of ``documents``. Stages take
tables as they come: NULLs, empty texts, repeated rows and empty tables have the results that their operators state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from runqc.llm import decontaminate, langid, mixing, simhash, tokens
from runqc.session import written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; those without letters, or that fit no language better than the rest, go."""
    return langid.known_language(docs, docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the least doc_id, of each group linked by fingerprints or by similar sets of five-word shingles."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents repeat, or go, as systematic sampling has it."""
    return mixing.mixed_rows(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token dataset and returns its digest per document, read from the files."""
    return tokens.stored_digests(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mix_sources),
    ("token_output", token_output),
]

#: Text models, fingerprints and token ids are beyond SQL; tests hold each stage against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
