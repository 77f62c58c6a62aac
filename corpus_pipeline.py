"""The corpus pipeline: documents in, packed training windows out.

Each stage works on all that the one before it kept, and all but the last return the columns of documents. Each handles nulls, empty
texts, repeated rows, empty tables and other columns as the docstring of its operator says; rows with a null doc_id pass every
stage that goes by ids (near duplicates, repeats, decontamination) unchanged."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lexgrove.llm import decontam, jaccard_tree, packing, pfp_dedup, quality_fm
from lexgrove.llm.tables import documents, remove, scratch, table

#: A factorisation machine, signature trees, suffix sorting and dynamic programming aren't expressible in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality_fm.drop_rejected(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (n-gram Jaccard join) the document of the lowest id stays."""
    return jaccard_tree.keep_one(docs)


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a passage that repeats its first occurrence stays; documents that have no word left go."""
    return pfp_dedup.drop_repeats(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item is found go."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training windows with the texts of their pieces."""
    return packing.pack_with_text(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("suffix_dedup", suffix_dedup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each result but the last is written as Parquet, in the shared folder of checkpoints, read again, and removed once the next one is written."""
    folder = f"{scratch(spark)}/pipeline-{uuid.uuid4()}"
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
            if k:
                # The last stage's result is read from the stage before it only.
                remove(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
