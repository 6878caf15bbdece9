"""Queries of this subpackage for __spark_entry__.py: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import bpe, captures, contamination, fingerprints, mixing, quality, rans, suffixes, toxicity, windows
from loomgraph.llm.shared import read


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_spans(read(spark, sf_dir, "documents"))


def op2_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.blocks(read(spark, sf_dir, "documents"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(read(spark, sf_dir, "documents"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.near_groups(read(spark, sf_dir, "documents"))


def op6_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captures.index(read(spark, sf_dir, "pages"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.scores(read(spark, sf_dir, "documents"))


def op8_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(read(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.repeated_spans(read(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.offending(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_token_binary": op2_token_binary,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_quality_rules": op4_quality_rules,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_warc_index": op6_warc_index,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_bpe_encoding": op8_bpe_encoding,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_toxicity": op10_toxicity,
}

ORACLES: dict[str, str] = {
    "op1_suffix_array_dedup": windows.oracle(),
    "op3_benchmark_decontamination": contamination.oracle(),
    "op6_warc_index": captures.oracle(),
    "op9_substring_dedup": windows.oracle(),
}
