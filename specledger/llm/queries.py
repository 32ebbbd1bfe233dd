"""Queries of the subpackage, by name, and SQL that gives the same rows where SQL can say it."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from specledger.llm import decontaminate, filter_audit, licences, packing, piecewise, quality, sharding, simhash, suffix, urls, warc, whitening, wordpiece

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        # Python workers of a local session find the library where the driver found it.
        path = spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)
        if ROOT not in path.split(os.pathsep):
            spark.sparkContext.environment["PYTHONPATH"] = f"{path}{os.pathsep}{ROOT}"
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ORACLE["op1_warc"] = """
with p as (select page_id, coalesce(html, '') as body from pages),
d as (select page_id, strlen(body) as n, sha256(body) as digest from p),
f as (select digest, min(page_id) as first, count(*) as copies from d where n >= 100 group by digest)
select page_id, n as payload_bytes, d.digest as payload_digest,
  case when copies > 1 and page_id <> first then 'revisit' else 'response' end as record_type,
  case when copies > 1 and page_id <> first then first end as refers_to
from d left join f on f.digest = d.digest"""


@query
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as a deduplicated WARC archive, read back."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("record_id"), "url", F.col("html").alias("payload"))
    return warc.archive_pages(pages).select(
        F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose fingerprints differ in two bits or fewer."""
    return simhash.link_fingerprints(table(spark, sf_dir, "documents"))


@query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and greedy word pieces of every document."""
    return wordpiece.token_counts(table(spark, sf_dir, "documents"))


RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
ORACLE["op4_url_filter"] = urls.oracle(RULES)


@query
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page's URL, by rule or by its host's place in the link graph."""
    return urls.judge_urls(table(spark, sf_dir, "pages"), RULES)


@query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token pieces of all documents and their places in sequences of 1,024 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of near equal bytes; equal texts share a shard."""
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=8).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


ORACLE["op7_licences"] = licences.oracle()


@query
def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best licence notice in every document."""
    return licences.scan_licences(table(spark, sf_dir, "documents"))


@query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    return quality.quality_report(table(spark, sf_dir, "documents"))


@query
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item and the most similar window."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 400-byte strings that start elsewhere as well."""
    return suffix.remove_repeats(table(spark, sf_dir, "documents"))


@query
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding on the first 16 whitened components."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


ORACLE["op12_filter_audit"] = filter_audit.oracle()


@query
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from each language, step by step in all 120 orders."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return filter_audit.audit_filters(filter_audit.document_failures(docs, labels))


@query
def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the piece ids of every document and of the text they decode to."""
    encoded = piecewise.encode_documents(table(spark, sf_dir, "documents"))
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline."""
    return corpus_pipeline.run(spark, sf_dir)
