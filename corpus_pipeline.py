"""Corpus pipeline: stages over documents, each written as Parquet for the next.

A stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All
but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from sessionlake.llm import decontaminate, language, line_dedup, packing, simhash
from sessionlake.session import staging_root

MIN_LANGUAGE_SCORE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the model learns from documents with a lang."""
    found = language.predict(docs, language.fit(docs), "__lang", "__score")
    known = (F.col("__lang") != language.UNKNOWN) & (F.col("__score") >= MIN_LANGUAGE_SCORE)
    return found.where(known).drop("__lang", "__score")


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines of cross-site boilerplate."""
    return line_dedup.drop_boilerplate(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.keep_one(docs, shingle=3, distance=2)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no telling share of benchmark passages."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in the training sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_deduplication),
    ("SimHash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing),
]

#: SQL cannot express the stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{staging_root(spark)}/pipeline/{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        path = f"{root}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
