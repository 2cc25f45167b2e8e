"""The registered queries of the training-data operators; their SQL is in sql.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import ann, binpack, langid, licences, mixing, neardup, packing, pii, quality, sql, suffix
from .common import read


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.cut(read(spark, sf_dir, "documents")).drop("spans")


def op2_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op3_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op4_keyed_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace(read(spark, sf_dir, "documents"), pii.key(spark))


def op5_window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op6_forest_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.join(read(spark, sf_dir, "documents"))


def op7_multiprobe_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read(spark, sf_dir, "embeddings"))


def op8_host_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(read(spark, sf_dir, "documents"), keep=("doc_id",))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(read(spark, sf_dir, "documents")).select("doc_id", *licences.OUTPUTS)


def op10_best_fit_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binpack.matrices(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_suffix_dedup, op2_language_mixture, op3_poisson_mixing, op4_keyed_surrogates, op5_window_packing, op6_forest_jaccard_join, op7_multiprobe_search, op8_host_quality_rules, op9_license_rules, op10_best_fit_matrices)
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return dict(sql.ORACLES)
