"""From raw documents to packed training sequences: five stages, each an operator of oddsframe.llm.

Each stage takes all its predecessor kept. The first four return the columns of documents, without the rows they reject; the last
returns the packing, a row for each piece of a document.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from oddsframe.llm import decontaminate, exact_dedup, packing, simhash, toxicity
from oddsframe.llm.common import clear_scratch, delete_table, scratch_mark, shared_folder


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document of the least doc_id stays."""
    return exact_dedup.drop_exact_duplicates(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (five-word shingles, similarity 0.8 or more) the document of the least doc_id stays."""
    return simhash.drop_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are left, packed."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Training, candidate search and packing have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; what a stage returns is written as Parquet and read again by the next. A stage's scratch tables, and the table
    it read, go once its own result is stored."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path, mark = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", scratch_mark()
        stage(spark, docs, sf_dir).write.parquet(path)
        clear_scratch(spark, mark)
        if before:
            delete_table(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
