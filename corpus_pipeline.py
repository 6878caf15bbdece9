"""Cleaning of a corpus in five stages, each over all that the one before kept.

Each function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
Columns other than doc_id, text, lang and source are carried along whatever their names; an empty table gives no rows;
n_chars, where there is such a column, is that of the text after it was cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import bpe, contamination, fingerprints, quality, suffixes, windows
from loomgraph.llm.shared import read, written
from loomgraph.session import ship


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars, where there is such a column, of the texts as they are now."""
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects the outliers of each language and source, and texts without a word (null and empty ones too); each row,
    with a null doc_id or repeated, is judged by itself."""
    ship(spark)
    return quality.kept(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies: that of the group's least doc_id, and of rows that share this doc_id the
    one of least text (null first).  Rows with a null doc_id all stay; null and empty texts are near copies of each other."""
    ship(spark)
    return fingerprints.kept(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the later copies of repeated passages; documents of which nothing is left go.  Rows that share a doc_id are one
    document: the same words at the same place aren't copies of each other there, and what is cut is cut from each of
    them (near_dedup leaves no such rows).  Rows with a null doc_id, and null or empty texts, stay as they are."""
    ship(spark)
    return _counted(windows.without_later(docs, suffixes.repeated_spans(docs)))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the passages of benchmark items, from every row; of the texts cut, those of which nothing is left go.  Null and
    empty texts, and all if the benchmark is empty, stay as they are."""
    cut = contamination.cleaned(docs, read(spark, sf_dir, "benchmark"))
    return _counted(cut)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds columns `tokens` (ids; none for null and empty texts) and `n_tokens`, in place of ones so named in any case."""
    ship(spark)
    return bpe.encoded(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_dedup),
    ("suffix_array_dedup", suffix_dedup),
    ("benchmark_decontamination", decontamination),
    ("bpe_encoding", bpe_encoding),
]

#: SQL can't express the covariance estimates, fingerprints and tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
