"""The corpus pipeline: quality rules, exact dedup, near-dedup, mixing, encoding.

Each stage calls one operator of ``shoalkv.llm`` over all that the stage before it kept.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shoalkv.llm import bpe, dedup, mixing, near, quality, registry
from shoalkv.llm.common import written

#: Near copies share this much of their five-word shingles, by an estimate that is some 0.01 off.
SIMILARITY = 0.8


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.accepted(docs)


def stage_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest id stays."""
    return dedup.distinct(docs)


def stage_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id. Operator 8 (SimHash, signatures with a bit left out) with several fingerprints, and a check of similarity."""
    return near.survivors(docs, similarity=SIMILARITY)


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Nine tenths of the tokens, dealt by weight; each document once at most, as copies have just gone."""
    return mixing.selected(docs, mixing.documents_mix(percent=90, epochs=1))


def stage_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the bytes that they decode to."""
    return bpe.digests(docs, registry.codec())


STAGES = [("quality", stage_quality), ("exact_dedup", stage_exact), ("near_dedup", stage_near), ("mixing", stage_mix), ("bpe", stage_encode)]

#: No SQL: connected components and BPE aren't SQL expressions. The tests hold each stage, and so run(), against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
