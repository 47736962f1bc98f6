"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, dedup, langid, licenses, lines, lm, mixing, quality, simhash, substrings

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def codec(path: str | None = None) -> bpe.Codec:
    return bpe.Codec(bpe.read_ranks(path or public_tokenizers.path(VOCABULARY)), public_tokenizers.PATTERN)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_documents(spark, sf_dir), codec())


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measure(_documents(spark, sf_dir))


def op2_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup.classes(_documents(spark, sf_dir))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op3_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.evaluate(_documents(spark, sf_dir))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_documents(spark, sf_dir))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.removed(_documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedup(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "host", "n_pages", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(_documents(spark, sf_dir), k=3, bits=2)
    return found.select("doc_id", simhash.hex_of("fp0").alias("fingerprint"), "component_id")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.select(_documents(spark, sf_dir), mixing.documents_mix())


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_bpe, op2_dedup, op3_ppm, op4_licenses, op5_quality, op6_substrings, op7_lines, op8_simhash, op9_mixing, op10_langid)
}

ORACLES: dict[str, str] = {
    "op2_dedup": dedup.CLASSES_SQL,
    "op4_licenses": licenses.scan_sql(),
    "op5_quality": quality.measure_sql(),
    "op6_substrings": substrings.REMOVED_SQL,
    "op7_lines": lines.DEDUP_SQL,
    "op9_mixing": mixing.MIX_SQL,
    "op10_langid": langid.identify_sql(),
}
