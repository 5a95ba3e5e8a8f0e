"""The thin queries of this subpackage and their SQL.  Each reads its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import fingerprint, jaccard, langid, lmscore, ogg, packing, quality, sstable, substring_dedup, transducer


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file; the environment variable ``TOKENIZERS_DIR`` may name another folder."""
    folder = os.environ.get("TOKENIZERS_DIR")
    return os.path.join(folder, name) if folder else str(public_tokenizers.path(name))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(documents(spark, sf_dir))


def op2_sstable_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.token_table(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


def op3_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transducer.encode_decode(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


def op4_hashed_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.scores(documents(spark, sf_dir))


def op5_hyperdimensional_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.report(documents(spark, sf_dir))


def op6_quadratic_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_lsh_forest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(documents(spark, sf_dir))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(documents(spark, sf_dir))


def op10_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.media_report(ogg.with_media(documents(spark, sf_dir)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_scaled_sketch, op2_sstable_shards, op3_bpe_transducer, op4_hashed_maxent, op5_hyperdimensional_langid, op6_quadratic_quality, op7_lsh_forest_join, op8_best_fit_packing, op9_suffix_array_dedup, op10_ogg_media)}


def oracle_sql() -> dict[str, str]:
    return {}
