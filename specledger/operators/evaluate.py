"""Evaluation of an enriched catalog: gold comparison, tiers, conflicts, dictionary and placeholder rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from specledger import dims
from specledger.functions.text import is_placeholder, strip
from specledger.operators.catalog import last_per_part
from specledger.operators.skew import join_spread

# --- fixed values: compared fields by report name (enriched column, gold column) ---
COMPARED = [
    ("MANUFACTURER_NAME", "manufacturer_name", "expected_manufacturer"),
    ("BRAND_NAME", "brand_name", "expected_brand"),
    ("MANUFACTURER_PART_NUMBER", "manufacturer_part_number", "expected_mfr_part_num"),
    ("Product Name", "product_name", "expected_product_name"),
    ("Classpath", "classpath", "expected_classpath"),
]


def percent(part: Column, total: Column) -> Column:
    """Share in percent, two decimals; 0 of nothing is 0."""
    return F.when(total > 0, F.round(part / total * 100.0, 2)).otherwise(0.0)


def exact_match(enriched: DataFrame, gold: DataFrame) -> DataFrame:
    """Each compared field of each gold row that has an input row (the last one with its part number).

    A blank gold classpath counts as a match; gold rows without an input row are skipped.
    """
    names = [c for _, c, _ in COMPARED]
    right = last_per_part(enriched.select("row_id", "mfg_part_num", *names)).select("part_key", *names)
    left = gold.withColumn("part_key", F.nullif(F.lower(strip(F.col("mfg_part_num"))), F.lit(""))).select(
        "row_id", "mfg_part_num", "part_key", *[g for _, _, g in COMPARED])
    rows = join_spread(left, right, ["part_key"], spread=["row_id"], how="inner")
    cells = F.array(*[
        F.struct(F.lit(i).alias("field_no"), F.lit(name).alias("field_name"), F.col(f"{c}.value").alias("pipeline_value"),
                 F.col(g).alias("expected_value"),
                 (F.col(f"{c}.value").eqNullSafe(F.col(g)) | F.lit(name == "Classpath")
                  & (F.coalesce(g, F.lit("")) == "")).alias("is_exact_match"),
                 F.col(f"{c}.status").alias("status_tier"), F.col(f"{c}.confidence").alias("confidence"))
        for i, (name, c, g) in enumerate(COMPARED)])
    return rows.select("row_id", "mfg_part_num", F.inline(cells))


def exact_match_summary(matches: DataFrame) -> DataFrame:
    """Counts and percent per gold row, and overall (null ``row_id``)."""
    hit = F.count_if("is_exact_match")
    n = F.count(F.lit(1))
    return matches.rollup("row_id").agg(
        n.alias("fields_compared"), hit.alias("fields_matched"), percent(hit, n).alias("accuracy_pct"))


def status_distribution(enriched: DataFrame) -> DataFrame:
    """Count and percent of each tier for manufacturer, brand and overall, absent tiers as zero."""
    kinds = {"manufacturer": "manufacturer_name.status", "brand": "brand_name.status", "overall": "overall_trust_status"}
    counts = enriched.agg(F.count(F.lit(1)).alias("total"), *[
        F.count_if(F.col(c) == tier).alias(f"{k}_{tier}") for k, c in kinds.items() for tier in dims.TIERS])
    cells = F.array(*[
        F.struct(F.lit(k).alias("kind"), F.lit(tier).alias("tier"), F.col(f"{k}_{tier}").alias("n"),
                 percent(F.col(f"{k}_{tier}"), F.col("total")).alias("pct"))
        for k in kinds for tier in dims.TIERS])
    return counts.select(F.inline(cells))


def conflict_rate(enriched: DataFrame) -> DataFrame:
    n, total = F.count_if("has_conflicts"), F.count(F.lit(1))
    return enriched.agg(total.alias("total_rows"), n.alias("conflicts"), percent(n, total).alias("conflict_rate_pct"))


def conflict_examples(enriched: DataFrame, n: int = 5) -> DataFrame:
    """First conflicted rows by row id."""
    return enriched.filter("has_conflicts").orderBy("row_id").limit(n).select(
        "row_id", "mfg_part_num", "part_desc", F.col("brand_name.reason").alias("reason"),
        F.col("brand_name.sources").alias("sources"))


def lov_compliance(enriched: DataFrame, signals: DataFrame) -> DataFrame:
    """Share of filled manufacturer and brand values that the dictionary holds (``signals``: one row per signal).

    Values are counted first, so the join to the dictionary moves one row per distinct value.
    """
    cells = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"{k}_name.value").alias("value"))
                      for k in ("manufacturer", "brand")])
    used = enriched.select(F.inline(cells)).filter(F.col("value").isNotNull()).groupBy("kind", "value").agg(
        F.count(F.lit(1)).alias("n"))
    known = signals.select(F.inline(F.array(
        F.struct(F.lit("manufacturer").alias("kind"), F.col("manufacturer").alias("value")),
        F.struct(F.lit("brand").alias("kind"), F.col("brand").alias("value"))))).distinct().withColumn("known", F.lit(True))
    rows = used.join(known, ["kind", "value"], "left")
    hit = F.coalesce(F.sum(F.when(F.col("known"), F.col("n"))), F.lit(0))
    total = F.coalesce(F.sum("n"), F.lit(0))
    return rows.agg(total.cast("long").alias("populated_values"), hit.cast("long").alias("in_dictionary"),
                    percent(hit, total).alias("lov_compliance_pct"))


def placeholder_rate(raw: DataFrame) -> DataFrame:
    """Rows with an empty brand column after cleaning, and rows that really hold a placeholder text.

    ``raw`` has the brand columns as read. The first count includes true blanks, the second does not.
    """
    brands = ["e1_brand", "unilog_brand", "dib_brand"]
    empty = F.lit(False)
    token = F.lit(False)
    for c in brands:
        empty = empty | is_placeholder(F.col(c))
    for c in [*brands, "part_manuf"]:
        token = token | ((F.coalesce(strip(F.col(c)), F.lit("")) != "") & is_placeholder(F.col(c)))
    total = F.count(F.lit(1))
    return raw.agg(
        total.alias("total_rows"), F.count_if(empty).alias("rows_with_null_brand"),
        F.count_if(token).alias("rows_with_placeholder_token"),
        percent(F.count_if(empty), total).alias("null_brand_pct"),
        percent(F.count_if(token), total).alias("placeholder_token_pct"))


def catalog_batch_report(enriched: DataFrame) -> DataFrame:
    """Totals and tier shares of a batch."""
    total = F.count(F.lit(1))
    n = {t: F.count_if(F.col("overall_trust_status") == t) for t in dims.TIERS}
    conflicts = F.count_if("has_conflicts")
    return enriched.agg(
        total.alias("total_records"), conflicts.alias("conflict_count"), percent(conflicts, total).alias("conflict_rate_pct"),
        *[c.alias(t.lower()) for t, c in n.items()], *[percent(c, total).alias(f"{t.lower()}_pct") for t, c in n.items()])


def records_summary(enriched: DataFrame) -> DataFrame:
    """Short row per catalog record."""
    return enriched.select(
        "row_id", "mfg_part_num", "part_desc", F.col("manufacturer_name.value").alias("manufacturer"),
        F.col("brand_name.value").alias("brand"), F.col("overall_trust_status").alias("overall_status"),
        F.col("overall_confidence").alias("confidence"), "has_conflicts")
