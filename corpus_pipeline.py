"""The training corpus from `documents`: five stages, each written and read again before the next.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept:
language identification, exact and near duplicates, mixing to target weights, packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from framesift.llm.common import write_shared
from framesift.llm.exact_dedup import without_exact_duplicates
from framesift.llm.language_id import with_known_language
from framesift.llm.mixing import drawn, quality_domains
from framesift.llm.packing import pack
from framesift.llm.simhash import without_near_duplicates
from framesift.session import ship_package

#: Target weights of the domains, as multiples of their own shares of the tokens: toxic text is
#: to make up a twentieth of what it does, and the corpus is as large as that leaves it.
MIXTURE = {"high": 1.0, "low": 1.0, "toxic": 0.05}


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents some language was found for."""
    ship_package(spark)
    return with_known_language(docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    ship_package(spark)
    return without_exact_duplicates(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that SimHash links connect."""
    ship_package(spark)
    return without_near_duplicates(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents drawn at rates of at most 1 that come closest to `MIXTURE`, each at most once."""
    ship_package(spark)
    labels = quality_domains(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return drawn(docs, labels, MIXTURE, relative=True)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 1024 tokens, with their tokens."""
    ship_package(spark)
    return pack(docs)


STAGES = [
    ("language_id", languages),
    ("exact_dedup", exact_duplicates),
    ("simhash_dedup", near_duplicates),
    ("mixing", mixture),
    ("packing", packing),
]

#: Tokens and trained models are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_shared(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
