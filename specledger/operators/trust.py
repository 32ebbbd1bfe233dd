"""Trust of attributes, claims and products, and the review queue."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from specledger import dims
from specledger.functions.text import evidence_label
from specledger.operators.normalize import KEYS, SUCCESS
from specledger.operators.validate import ORDER

REVIEW = ["product_id", "review_id", "part", "seq", "target_type", "target_name", "severity", "issue_type",
          "description", "validation_rule_id", "recommended_action"]


def _field_findings(findings: DataFrame) -> DataFrame:
    """What the findings say about each product and field; the rule list is bounded by the rules there are."""
    keys = ["product_id", F.col("field").alias("canonical_field")]
    # Places and texts are wanted of failures and warnings alone: the texts of passes and conflicts, which are most, are not even made.
    told = F.col("status").isin("FAIL", "WARNING")
    rows = findings.select(*keys, "status", "rule_id", F.when(told, F.struct(*ORDER)).alias("at"), F.when(told, F.col("explanation")).alias("explanation"))

    def first(status: str, column: str) -> Column:
        return F.min_by(column, F.when(F.col("status") == status, F.col("at")))

    return rows.groupBy(*KEYS).agg(
        F.max(F.col("status") == "CONFLICT").alias("found_conflict"),
        first("FAIL", "rule_id").alias("fail_rule"), first("FAIL", "explanation").alias("fail_text"),
        first("WARNING", "rule_id").alias("warn_rule"), first("WARNING", "explanation").alias("warn_text"),
        F.array_sort(F.collect_set("rule_id")).alias("rule_ids"))


def attribute_trust(fields: DataFrame, findings: DataFrame, inferred: DataFrame | None = None) -> DataFrame:
    """Trust of each field: conflict, failure, warning, present, inferred, missing, in this order.

    ``fields`` holds the full grid. ``inferred`` has ``product_id, field, inferred_value``.
    """
    rows = fields.join(_field_findings(findings), KEYS, "left")
    if inferred is None:
        rows = rows.withColumn("inferred_value", F.lit(None).cast("string")).withColumn("_inferred", F.lit(None).cast("boolean"))
    else:
        guesses = inferred.groupBy("product_id", F.col("field").alias("canonical_field")).agg(
            F.max("inferred_value").alias("inferred_value"), F.lit(True).alias("_inferred"))
        rows = rows.join(guesses, KEYS, "left")
    conflicted = F.col("has_conflict") | F.coalesce("found_conflict", F.lit(False))
    present = (F.col("value_num").isNotNull() | F.col("value_str").isNotNull()) & F.col("outcome").isin(SUCCESS)

    def tier(status: str, publishability: str, validation: str, score: float, reason: Column) -> Column:
        return F.struct(F.lit(status).alias("trust_status"), F.lit(publishability).alias("publishability"),
                        F.lit(validation).alias("validation_status"), F.lit(score).alias("confidence_score"),
                        reason.alias("reason"))

    field = F.col("canonical_field")
    ladder = F.when(conflicted, tier(
        "CONFLICTED", "REVIEW_REQUIRED", "CONFLICT", 0.30,
        F.concat(F.lit("sources disagree on "), field, F.lit("; a person must decide")))
    ).when(F.col("fail_rule").isNotNull(), tier(
        "UNSUPPORTED", "NOT_PUBLISHABLE", "FAIL", 0.10, F.concat(F.lit("failed: "), "fail_text"))
    ).when(F.col("warn_rule").isNotNull(), tier(
        "REVIEW_REQUIRED", "PUBLISHABLE_WITH_WARNING", "WARNING", 0.75, F.concat(F.lit("warning: "), "warn_text"))
    ).when(present, tier(
        "TRUSTED", "PUBLISHABLE", "PASS", 1.0, F.lit("found in source evidence, all checks passed"))
    ).when(F.col("_inferred"), tier(  # named in the answer, if only with a null
        "UNVERIFIED", "PUBLISHABLE_WITH_WARNING", "NOT_CHECKED", 0.70,
        F.concat(F.lit("inferred, not in the sources: "), F.coalesce("inferred_value", F.lit("no value"))))
    ).otherwise(tier("MISSING", "NOT_PUBLISHABLE", "NOT_CHECKED", 0.0, F.lit("in none of the sources")))
    out = rows.withColumn("_t", ladder).withColumn("is_conflicted", conflicted)
    guessed = F.col("_t.trust_status") == "UNVERIFIED"
    label = F.when(F.col("first_ref").isNotNull(), evidence_label(
        F.col("first_ref.source_type"), F.col("first_ref.page"), F.col("first_ref.row"), F.col("first_ref.attribute")))
    return out.select(
        "product_id", "field_pos", F.col("canonical_field").alias("field"), "canonical_unit",
        F.when(guessed, F.lit(None)).otherwise(F.col("value_num")).alias("value_num"),
        F.when(guessed, F.col("inferred_value")).otherwise(F.col("value_str")).alias("value_str"),
        "_t.*", "is_conflicted",
        F.when(guessed, F.array(F.lit("text-model"))).when(F.col("_t.trust_status") == "MISSING",
                                                           F.array().cast("array<string>"))
        .otherwise(F.col("source_types")).alias("source_types"),
        F.when(~guessed & (F.col("_t.trust_status") != "MISSING"), label).alias("first_source"),
        F.coalesce("rule_ids", F.array().cast("array<string>")).alias("rule_ids"),
        "n_refs", "fail_rule", "warn_rule", "fail_text", "warn_text")


def claim_trust(claims: DataFrame, attributes: DataFrame) -> DataFrame:
    """Claims on a conflicted field need review; other source-backed claims are trusted, inferred ones unverified."""
    conflicted = attributes.filter("is_conflicted").select("product_id", "field", F.lit(True).alias("_conflicted"))
    rows = claims.join(conflicted, ["product_id", "field"], "left")
    backed = F.col("claim_type") == "SOURCE_BACKED"
    disputed = backed & F.coalesce("_conflicted", F.lit(False))
    return rows.select(
        "product_id", "claim_type", "claim_no", "claim_text", "category", "field",
        F.when(disputed, "CONFLICTED").when(backed, "TRUSTED").otherwise("UNVERIFIED").alias("trust_status"),
        F.when(disputed, "REVIEW_REQUIRED").when(backed, "PUBLISHABLE").otherwise("PUBLISHABLE_WITH_WARNING")
        .alias("publishability"),
        F.when(disputed, F.lit(0.40)).otherwise(F.col("confidence")).alias("confidence"), "evidence_sources",
        F.when(disputed, F.concat(F.lit("rests on the conflicted field "), "field"))
        .when(backed, "backed by source evidence").otherwise(F.concat(F.lit("inferred: "), F.coalesce(
            "notes", F.lit("no basis given")))).alias("reason"))


def _review(df: DataFrame, part: int, seq: Column, suffix: Column, target_type: str, target: Column, severity: Column | str,
            issue: Column | str, description: Column, rule: Column | None, action: str, items: Column | None = None) -> DataFrame:
    def col(x: Column | str | None) -> Column:
        return (x if isinstance(x, Column) else F.lit(x)).cast("string")

    return df.select(
        "product_id", F.concat(F.lit("REV-"), F.col("product_id"), F.lit("-"), suffix).alias("review_id"),
        F.lit(part).alias("part"), seq.alias("seq"), F.lit(target_type).alias("target_type"),
        target.alias("target_name"), col(severity).alias("severity"), col(issue).alias("issue_type"),
        col(description).alias("description"), col(rule).alias("validation_rule_id"),
        F.lit(action).alias("recommended_action"), (F.lit(1) if items is None else items).cast("long").alias("n_items"))


def _seq(a: Column, b: Column | None = None, c: Column | None = None) -> Column:
    zero = F.lit(0)
    return F.struct(a.cast("long").alias("a"), (zero if b is None else b).cast("long").alias("b"),
                    (zero if c is None else c).cast("long").alias("c"))


def review_items(attributes: DataFrame, findings: DataFrame, claim_results: DataFrame | None = None) -> DataFrame:
    """Everything a person should look at, in order: fields, claims, findings. Ids may repeat (see ``dedupe_reviews``).

    ``n_items`` counts the equal findings that a row stands for.
    """
    field = F.col("field")
    state = F.col("trust_status")
    flagged = attributes.filter(F.col("validation_status").isin("CONFLICT", "FAIL", "WARNING"))
    conflict, fail = state == "CONFLICTED", state == "UNSUPPORTED"
    suffix = F.concat(field, F.when(conflict, "-conflict").when(fail, "-fail").otherwise("-warning"))
    parts = [_review(
        flagged, 0, _seq(F.col("field_pos")), suffix, "attribute", field,
        F.when(conflict | fail, "HIGH").otherwise("MEDIUM"),
        F.when(conflict, "CONFLICT").when(fail, "FAIL").otherwise("WARNING"),
        F.concat(field, F.lit(": "), F.col("reason")),
        F.when(conflict, "CONFLICT_CROSS_SOURCE").when(fail, F.col("fail_rule")).otherwise(F.col("warn_rule")),
        "check against the nameplate or official drawing")]
    if claim_results is not None:
        disputed = claim_results.filter(F.col("trust_status") == "CONFLICTED")
        parts.append(_review(
            disputed, 1, _seq(F.col("claim_no")), F.concat(F.lit("claim-"), F.col("category"), F.lit("-conflict")), "claim",
            F.coalesce("field", "category"), "HIGH", "CONFLICT",
            F.concat(F.lit("claim on a conflicted field: "), F.col("claim_text")), None,
            "do not publish before the conflict is resolved"))
    checks = findings.filter(F.col("status").isin("FAIL", "WARNING"))
    failed = F.col("status") == "FAIL"
    parts.append(_review(
        checks, 2, _seq(*[F.col(c) for c in ORDER]), F.col("rule_id"), "validation", F.coalesce("field", "rule_id"),
        F.when(failed & (F.col("severity") == "CRITICAL"), "CRITICAL").when(failed, "HIGH").otherwise("MEDIUM"),
        F.col("status"), F.concat(F.col("rule_id"), F.lit(": "), F.col("explanation")), F.col("rule_id"),
        "inspect the constraints and correct the data", F.col("n_copies")))
    return reduce(DataFrame.unionByName, parts)


def dedupe_reviews(items: DataFrame) -> DataFrame:
    """First item per review id, with the number of items it stands for."""
    rest = [c for c in REVIEW if c not in ("product_id", "review_id")]
    # The first item wins; equal positions fall back to the text so that the pick never depends on task order.
    order = F.struct("part", "seq", "target_name", "description")
    return items.groupBy("product_id", "review_id").agg(
        F.min_by(F.struct(*rest), order).alias("f"), F.sum("n_items").alias("n_collapsed")
    ).select("product_id", "review_id", "f.*", "n_collapsed")


def availability(normalized_ids: DataFrame, validated_ids: DataFrame, enriched_ids: DataFrame) -> DataFrame:
    """Which stages have output for each product."""
    def flag(df: DataFrame, name: str) -> DataFrame:
        return df.select("product_id").distinct().withColumn(name, F.lit(True))

    out = flag(normalized_ids, "has_normalization").join(
        flag(validated_ids, "has_validation"), "product_id", "full").join(
        flag(enriched_ids, "has_enrichment"), "product_id", "full")
    return out.select("product_id", *[F.coalesce(c, F.lit(False)).alias(c)
                                      for c in ("has_normalization", "has_validation", "has_enrichment")])


def trust_score(attributes: DataFrame, fields: DataFrame | None, summary: DataFrame) -> DataFrame:
    """Weighted completeness, validity and source diversity less a conflict penalty, clamped to 0..1.

    ``fields`` is None when no normalised products exist. ``summary`` has the finding counts per product.
    """
    per = attributes.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("n_fields"), F.count_if(F.col("trust_status") != "MISSING").alias("n_present"),
        F.count_if("is_conflicted").alias("n_conflicted"))
    rows = per.join(summary.select("product_id", "total_findings", "n_pass", "n_warning", "n_not_checked"),
                    "product_id", "left")
    if fields is None:
        rows = rows.withColumn("n_sources", F.lit(None).cast("int"))
    else:
        sources = fields.groupBy("product_id").agg(
            F.size(F.array_distinct(F.flatten(F.collect_list("source_types")))).alias("n_sources"))
        rows = rows.join(sources, "product_id", "left")
    checks = F.col("total_findings") - F.col("n_not_checked")
    validity = F.when(F.coalesce(checks, F.lit(0)) > 0, F.least(
        F.lit(1.0), (F.col("n_pass") + 0.75 * F.col("n_warning")) / checks)).otherwise(F.lit(1.0))
    diversity = F.when(F.col("n_sources").isNull(), 0.50).when(F.col("n_sources") >= 2, 1.0).when(
        F.col("n_sources") == 1, 0.75).otherwise(0.30)
    scored = rows.select(
        "product_id", "n_conflicted", (F.col("n_present") / F.col("n_fields")).alias("completeness"),
        validity.alias("validity"), diversity.alias("diversity"),
        F.least(F.lit(dims.MAX_CONFLICT_PENALTY), F.col("n_conflicted") * dims.CONFLICT_PENALTY).alias("conflict_penalty"))
    raw = (dims.WEIGHT_COMPLETENESS * F.col("completeness") + dims.WEIGHT_VALIDITY * F.col("validity")
           + dims.WEIGHT_DIVERSITY * F.col("diversity") - F.col("conflict_penalty"))
    return scored.withColumn("trust_score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))).withColumn(
        "trust_score_formula", F.format_string(
            f"clamp({dims.WEIGHT_COMPLETENESS}*completeness(%.2f) + {dims.WEIGHT_VALIDITY}*validity(%.2f) + "
            f"{dims.WEIGHT_DIVERSITY}*diversity(%.2f) - penalty(%.2f), 0, 1) = %.4f",
            "completeness", "validity", "diversity", "conflict_penalty", "trust_score"))


def overall_trust(scores: DataFrame, attributes: DataFrame, reviews: DataFrame) -> DataFrame:
    """Product status: conflict, failed check, warning, score, in this order."""
    fields = attributes.filter("is_conflicted").groupBy("product_id").agg(
        F.array_join(F.array_sort(F.collect_list("field")), ", ").alias("conflicted_fields"))
    flags = reviews.groupBy("product_id").agg(
        F.max(F.col("severity").isin("CRITICAL", "HIGH") & (F.col("issue_type") == "FAIL")).alias("has_fail"),
        F.max(F.col("issue_type") == "WARNING").alias("has_warning"),
        F.count(F.lit(1)).alias("review_items_count"))
    rows = scores.join(fields, "product_id", "left").join(flags, "product_id", "left")

    def state(status: str, publishability: str, reason: Column | str) -> Column:
        return F.struct(F.lit(status).alias("overall_trust_status"),
                        F.lit(publishability).alias("overall_publishability"),
                        (reason if isinstance(reason, Column) else F.lit(reason)).alias("summary_reason"))

    ladder = F.when(F.col("n_conflicted") > 0, state("CONFLICTED", "REVIEW_REQUIRED", F.concat(
        F.col("n_conflicted").cast("string"), F.lit(" conflicted field(s): "), F.col("conflicted_fields")))
    ).when(F.coalesce("has_fail", F.lit(False)), state("UNSUPPORTED", "NOT_PUBLISHABLE", "a check failed")
    ).when(F.coalesce("has_warning", F.lit(False)), state(
        "REVIEW_REQUIRED", "PUBLISHABLE_WITH_WARNING", "checks passed with warnings")
    ).when(F.col("trust_score") >= dims.TRUSTED_SCORE, state("TRUSTED", "PUBLISHABLE", "verified without conflicts")
    ).otherwise(state("UNVERIFIED", "PUBLISHABLE_WITH_WARNING", "partly complete"))
    return rows.withColumn("_s", ladder).select(
        *scores.columns, F.coalesce("review_items_count", F.lit(0)).cast("long").alias("review_items_count"), "_s.*")


def publishable_lists(attributes: DataFrame) -> DataFrame:
    """Fields that may be published and fields that may not, in field order (at most one entry per field)."""
    def names(flags: list[str]) -> Column:
        entry = F.when(F.col("publishability").isin(flags), F.struct("field_pos", "field"))
        return F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["field"])

    return attributes.groupBy("product_id").agg(
        names(["PUBLISHABLE", "PUBLISHABLE_WITH_WARNING"]).alias("publishable_attributes"),
        names(["REVIEW_REQUIRED", "NOT_PUBLISHABLE"]).alias("restricted_attributes"))


def unresolved_conflicts(pairs: DataFrame, answered: DataFrame | None = None) -> DataFrame:
    """Conflicts named by the answers where a product has any, else one row per conflict pair."""
    def shown(side: str) -> Column:
        return F.coalesce(F.concat_ws(" ", F.col(f"value_{side}").cast("string"), F.when(
            F.col(f"value_{side}").isNotNull(), F.col(f"unit_{side}"))), F.lit(""))

    def text(side: str) -> Column:
        return F.concat(F.col(f"ref_{side}.source_type"), F.lit(" reports "), F.when(
            F.col(f"value_{side}").isNull(), F.col(f"text_{side}")).otherwise(shown(side)))

    generated = pairs.select(
        "product_id", F.col("canonical_field").alias("field"), F.concat(text("a"), F.lit(", "), text("b")).alias(
            "description"), F.lit("verify against the nameplate or drawing").alias("action_needed"), "n_copies")
    if answered is None:
        return generated
    named = answered.select("product_id", "field", "description", "action_needed", F.lit(1).cast("long").alias("n_copies"))
    ids = named.select("product_id").distinct()
    return named.unionByName(generated.join(ids, "product_id", "left_anti"))


def product_report(products: DataFrame, overall: DataFrame, lists: DataFrame, open_conflicts: DataFrame) -> DataFrame:
    """Summary row per product, as listed in the batch report."""
    n_open = open_conflicts.groupBy("product_id").agg(F.sum("n_copies").cast("long").alias("conflicts_count"))
    return overall.join(products.select("product_id", "manufacturer", "model"), "product_id", "left").join(
        lists, "product_id", "left").join(n_open, "product_id", "left").select(
        "product_id", "manufacturer", "model", "overall_trust_status", "overall_publishability", "trust_score",
        "review_items_count", F.coalesce("conflicts_count", F.lit(0)).cast("long").alias("conflicts_count"),
        F.size("publishable_attributes").alias("publishable_attributes_count"),
        F.size("restricted_attributes").alias("restricted_attributes_count"), "summary_reason")


def batch_trust_report(reports: DataFrame) -> DataFrame:
    """Counts by status and publishability, mean score and review items over all products."""
    status, publishable = F.col("overall_trust_status"), F.col("overall_publishability")
    return reports.agg(
        F.count(F.lit(1)).alias("total_products"),
        F.count_if(status == "TRUSTED").alias("trusted_count"),
        F.count_if(status == "REVIEW_REQUIRED").alias("review_required_count"),
        F.count_if(status == "CONFLICTED").alias("conflicted_count"),
        F.count_if(publishable == "PUBLISHABLE").alias("publishable_count"),
        F.count_if(publishable == "PUBLISHABLE_WITH_WARNING").alias("publishable_with_warning_count"),
        F.count_if(publishable == "NOT_PUBLISHABLE").alias("not_publishable_count"),
        F.round(F.coalesce(F.avg("trust_score"), F.lit(0.0)), 4).alias("avg_trust_score"),
        F.coalesce(F.sum("review_items_count"), F.lit(0)).cast("long").alias("total_review_items"))
