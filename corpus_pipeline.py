"""From raw documents to packed training sequences: quality rules, near-dedup, passage dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all documents that its predecessor kept. Between stages the documents are written as Parquet
in the session's shared folder and read again. A stage returns a lazy frame over tables of its own; they are deleted when the next stage
begins, so its result must be stored by then, as ``run`` does.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from specledger.llm.decontaminate import drop_leaks
from specledger.llm.packing import pack_documents
from specledger.llm.quality import filter_quality
from specledger.llm.simhash import near_dedup
from specledger.llm.suffix import dedup_passages
from specledger.session import drop_paths, noting_stages, stage_table

# A passage of 50 words has about 300 bytes; short words make it shorter.
PASSAGE_BYTES = 240


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return filter_quality(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup_passages(docs, PASSAGE_BYTES)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


# Rows of documents that a Python worker is handed at once: with 10,000 (the default) a batch of long texts and its results fill a small executor.
BATCH_ROWS = 1000

# Tables that the last stage of an application made on its way. Its result is stored when the next stage begins, so they can go.
_made: dict[str, list[str]] = {}


def tidy(stage):
    """The stage, after the tables behind the stage before it have been deleted."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        paths = _made.setdefault(spark.sparkContext.applicationId, [])
        drop_paths(spark, paths)
        paths.clear()
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        with noting_stages(paths):
            return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [(stage.__name__, tidy(stage)) for stage in (
    quality_rules, simhash_near_dedup, suffix_array_dedup, benchmark_decontamination, best_fit_packing)]

# Hash functions, components and token ids are not SQL; tests compare the stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage_table(stage(spark, docs, sf_dir), name)
    return docs
