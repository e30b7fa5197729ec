"""The corpus pipeline: quality rules, near duplicates, decontamination, secret scans, packing.

Each stage takes the documents that the one before it kept, written as Parquet and read again,
and returns documents; the last returns the pieces of packed sequences.

Cases: documents without doc_id can't be named in a verdict and stay. Null or empty texts fail
the quality rules' least number of words. Rows that share a doc_id share every verdict: all of
them go or stay. Ties of near duplicates go to the smallest doc_id. Texts of any length are
handled whole, an empty table passes through, and other columns than COLUMNS are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvox.llm.common import stored, table
from corvox.llm.decontaminate import cleaned
from corvox.llm.neardups import deduplicated
from corvox.llm.packing import packed
from corvox.llm.quality import filtered
from corvox.llm.secrets import redacted

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return filtered(docs.select(COLUMNS)).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that with the smallest doc_id."""
    return deduplicated(docs.select(COLUMNS)).select(COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those that the benchmark contaminates."""
    return cleaned(docs.select(COLUMNS), table(spark, sf_dir, "benchmark")).select(COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked."""
    import public_tokenizers as files

    return redacted(docs.select(COLUMNS), files.path("byte_bpe_50k.tiktoken")).select(COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences."""
    import public_tokenizers as files

    return packed(docs, files.path("byte_bpe_50k.json"), files.path("byte_bpe_50k.tiktoken"), files.PATTERN)


STAGES = [("quality_rules", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("secret_scan", secrets), ("packing", packing)]

#: SQL can't express the tokenizer; tests hold each stage against a version written anew.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
