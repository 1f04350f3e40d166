"""Training-corpus pipeline: documents in, packed token pieces out.

STAGES are applied in order; each result is written as Parquet and read back
as the next stage's documents, so a stage is recovered from its input table
and never recomputed from the start.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from odspark.llm import decontam, near_dedup, packing, quality, window_dedup  # noqa: E402
from odspark.llm.staging import ship_package, staged  # noqa: E402


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _with_size(docs: DataFrame) -> DataFrame:
    """The column n_chars follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without their hosts' boilerplate lines."""
    ship_package(spark)
    return _with_size(quality.clean_documents(docs))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id."""
    ship_package(spark)
    return near_dedup.one_of_each(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without word windows that a document with a smaller id has too."""
    ship_package(spark)
    return _with_size(window_dedup.remove_repeats(docs).drop("n_words", "n_removed"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window that matches a benchmark item."""
    items = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    return decontam.clean_documents(docs, items)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their places in the training sequences."""
    ship_package(spark)
    pieces = packing.cut_pieces(docs, _vocabulary("byte_bpe_50k.json"))
    return packing.pack_pieces(pieces).select("doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens",
                                              "sequence_id", "offset")


STAGES = [("quality rules", quality_stage), ("near dedup", near_dedup_stage), ("substring dedup", substring_stage),
          ("decontamination", decontamination_stage), ("packing", packing_stage)]

# Hash bands, shuffles of windows and a tokenizer cannot be written in SQL;
# tests/llm compare the run with a brute-force pipeline.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; the last stage's rows."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
