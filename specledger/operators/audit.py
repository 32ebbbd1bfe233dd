"""Invariants as queries: each must return no rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from specledger.operators.normalize import KEYS


def audit_no_winner(fields: DataFrame, findings: DataFrame) -> DataFrame:
    """Fields with a conflict finding that still have a value."""
    disputed = findings.filter(F.col("status") == "CONFLICT").select(
        "product_id", F.col("field").alias("canonical_field")).distinct()
    return fields.filter(F.col("value_num").isNotNull() | F.col("value_str").isNotNull()).join(
        disputed, KEYS, "left_semi").select(*KEYS, "outcome", "value_num", "value_str")


def audit_missing_null(fields: DataFrame) -> DataFrame:
    """Missing fields that have a value."""
    return fields.filter((F.col("outcome") == "missing") & (
        F.col("value_num").isNotNull() | F.col("value_str").isNotNull())).select(*KEYS, "value_num", "value_str")


def audit_provenance(evidence: DataFrame) -> DataFrame:
    """Table facts without a page, and CSV facts without row or column."""
    table = (F.col("method") == "table") & F.col("page").isNull()
    csv = (F.col("source_type") == "csv") & (F.col("row").isNull() | (F.coalesce(F.col("column"), F.lit("")) == ""))
    return evidence.filter(table | csv).select("product_id", "source_type", "method", "attribute", "source_rank", "pos")


def audit_status_rules(values: DataFrame) -> DataFrame:
    """Four-tier values that break a rule: ``status, value, sources, confidence`` plus key columns.

    Unknown has no value, Verified and Inferred have a source, a confidence lies in 0..1, and there are four statuses.
    """
    unknown = (F.col("status") == "Unknown") & F.col("value").isNotNull()
    unsourced = F.col("status").isin("Verified", "Inferred") & (F.coalesce(F.size("sources"), F.lit(0)) < 1)
    outside = ~F.col("confidence").between(0.0, 1.0)
    other = ~F.coalesce(F.col("status"), F.lit("")).isin("Verified", "Inferred", "Conflicted", "Unknown")
    broken = F.when(unknown, "unknown with a value").when(unsourced, "no source").when(outside, "confidence out of range").when(
        other, "no such status")
    return values.withColumn("broken_rule", broken).filter("broken_rule is not null")


def audit_failed_sources_empty(log: DataFrame, evidence: DataFrame) -> DataFrame:
    """Failed source reads that still have facts."""
    failed = log.filter(F.col("status") == "failed").select("product_id", "source_type").distinct()
    counts = evidence.groupBy("product_id", "source_type").agg(F.count(F.lit(1)).alias("n_facts"))
    return counts.join(failed, ["product_id", "source_type"], "left_semi")


def audit_completeness(manifest: DataFrame, stages: dict[str, DataFrame]) -> DataFrame:
    """Manifest ids that a stage has no output for."""
    out = None
    for name, df in stages.items():
        gone = manifest.select("product_id").distinct().join(df.select("product_id").distinct(), "product_id", "left_anti")
        gone = gone.withColumn("stage", F.lit(name))
        out = gone if out is None else out.unionByName(gone)
    return out


def audit_distribution_sums(distribution: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Tier distributions whose percentages do not add up to 100."""
    return distribution.groupBy("kind").agg(F.round(F.sum("pct"), 4).alias("total_pct")).filter(
        F.abs(F.col("total_pct") - 100.0) > tolerance)
