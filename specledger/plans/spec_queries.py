"""Queries of the specification track: normalisation, conflicts, rules, trust."""

from __future__ import annotations

from pyspark.sql import functions as F

from specledger import dims
from specledger.operators import audit, normalize, trust, validate
from specledger.plans import inputs, oracle
from specledger.plans.registry import register
from specledger.sources.stored import collect_sources, split_global

E, N, FL, R, T = oracle.EVIDENCE, oracle.NORMALIZED, oracle.FIELDS, oracle.RULES, oracle.TRUST
FINDING = "product_id, rule_no, field_pos, rule_id, category, status, severity, field, actual_num, actual_unit"
FINDING_COLUMNS = FINDING.split(", ")


def _shown(findings):
    """Findings without their texts; equal ones are counted."""
    return findings.groupBy(*FINDING_COLUMNS).agg(F.sum("n_copies").alias("n_copies"))


# --- mapping and values ---

@register("map_attributes", "SELECT product_id, source_type, source_rank, pos, attribute, canonical_field, kind FROM mapped", E)
def _map_attributes(spark, sf):
    return normalize.map_attributes(inputs.evidence(spark, sf)).select(
        "product_id", "source_type", "source_rank", "pos", "attribute", "canonical_field", "kind")


@register("route_evidence", "SELECT CASE WHEN kind IN ('metadata', 'skip') THEN 'dropped' ELSE kind END AS route, count(*) AS n_facts,"
          " count(DISTINCT attribute) AS n_attributes FROM mapped GROUP BY 1", E)
def _route(spark, sf):
    parts = normalize.route(normalize.map_attributes(inputs.evidence(spark, sf)))
    out = None
    for name, df in parts.items():
        one = df.groupBy(F.lit(name).alias("route")).agg(F.count(F.lit(1)).alias("n_facts"),
                                                         F.countDistinct("attribute").alias("n_attributes"))
        out = one if out is None else out.unionByName(one)
    return out


@register("unmapped_evidence", "SELECT product_id, source_type, attribute, raw_value, value, unit FROM mapped WHERE kind = 'unmapped'", E)
def _unmapped(spark, sf):
    return normalize.unmapped_evidence(normalize.map_attributes(inputs.evidence(spark, sf))).select(
        "product_id", "source_type", "attribute", "raw_value", "value", "unit")


@register("normalize_values", "SELECT product_id, canonical_field, source_type, source_rank, pos, value_num, value_str, canonical_unit,"
          " outcome FROM facts", N)
def _normalize(spark, sf):
    return normalize.normalize(inputs.evidence(spark, sf)).select(
        "product_id", "canonical_field", "source_type", "source_rank", "pos", "value_num", "value_str", "canonical_unit", "outcome")


@register("normalization_issues", "SELECT product_id, canonical_field, attribute AS evidence_attribute, raw_value, unit AS raw_unit, outcome,"
          " source_type, page, \"row\" FROM facts WHERE outcome IN ('parse_error', 'unknown_unit')", N)
def _issues(spark, sf):
    return normalize.normalization_issues(normalize.normalize(inputs.evidence(spark, sf))).select(
        "product_id", "canonical_field", "evidence_attribute", "raw_value", "raw_unit", "outcome", "source_ref.source_type",
        "source_ref.page", "source_ref.row")


@register("field_grid", f"SELECT p.product_id, g.* FROM products p CROSS JOIN (VALUES {oracle._GRID}) g(field_pos, canonical_field, canonical_unit)", E)
def _grid(spark, sf):
    return normalize.field_grid(inputs.products(spark, sf))


@register("manifest_join", "SELECT e.product_id, e.n_facts, coalesce(p.manufacturer, 'Unknown') AS manufacturer, coalesce(p.model, 'Unknown') AS model"
          " FROM (SELECT product_id, count(*) AS n_facts FROM ev GROUP BY 1) e LEFT JOIN products p ON p.product_id = e.product_id", E)
def _manifest(spark, sf):
    ids = inputs.evidence(spark, sf).groupBy("product_id").agg(F.count(F.lit(1)).alias("n_facts"))
    return normalize.manifest_join(ids, inputs.products(spark, sf))


@register("collect_sources", "SELECT product_id, source_type, attribute, raw_value, unit, CAST(count(*) AS BIGINT) AS n_copies FROM (SELECT * FROM ev WHERE"
          " product_id <> 'GLOBAL' UNION ALL SELECT g.* REPLACE (p.product_id AS product_id) FROM products p, ev g WHERE g.product_id = 'GLOBAL')"
          " GROUP BY ALL", E)
def _collect(spark, sf):
    own, shared = split_global(inputs.evidence(spark, sf))
    return collect_sources([own], inputs.products(spark, sf), shared).groupBy(
        "product_id", "source_type", "attribute", "raw_value", "unit").agg(F.sum("n_copies").alias("n_copies"))


# --- conflicts and fields ---

@register("representative", "SELECT product_id, canonical_field, source_type, attribute, raw_value, value_num, value_str, outcome FROM (SELECT *,"
          " row_number() OVER (PARTITION BY product_id, canonical_field ORDER BY source_rank, pos) AS rn FROM own WHERE value_num IS NOT NULL OR"
          " value_str IS NOT NULL) WHERE rn = 1", N)
def _representative(spark, sf):
    return normalize.representative(inputs.track(spark, sf).normalized).select(
        "product_id", "canonical_field", "source_type", "attribute", "raw_value", "value_num", "value_str", "outcome")


@register("cross_source_conflicts", "SELECT product_id, canonical_field, value_a, text_a, value_b, text_b, type_a, type_b, attribute_a, attribute_b, raw_b,"
          " CAST(count(*) AS BIGINT) AS n FROM pairs GROUP BY ALL", FL)
def _conflicts(spark, sf):
    return inputs.track(spark, sf).pairs.groupBy(
        "product_id", "canonical_field", "value_a", "text_a", "value_b", "text_b", F.col("ref_a.source_type").alias("type_a"),
        F.col("ref_b.source_type").alias("type_b"), F.col("ref_a.attribute").alias("attribute_a"),
        F.col("ref_b.attribute").alias("attribute_b"), F.col("ref_b.raw_value").alias("raw_b")).agg(F.sum("n_copies").alias("n"))


@register("assemble_fields", "SELECT product_id, field_pos, canonical_field, canonical_unit, outcome, value_num, value_str, confidence, has_conflict, n_refs,"
          " n_ok, source_types FROM fields", FL)
def _fields(spark, sf):
    return inputs.track(spark, sf).fields.select(
        "product_id", "field_pos", "canonical_field", "canonical_unit", "outcome", "value_num", "value_str", "confidence", "has_conflict", "n_refs",
        "n_ok", F.array_join("source_types", ",").alias("source_types"))


_SUMMARY = (
    "SELECT f.product_id, f.fields_total, f.fields_normalized, f.fields_conflicted, f.fields_missing, f.field_refs, coalesce(u.n, 0) + (SELECT count(*) FROM"
    " mapped WHERE product_id = 'GLOBAL' AND kind = 'unmapped') AS unmapped_evidence, coalesce(i.pe, 0) AS parse_errors, coalesce(i.uu, 0) AS unknown_units"
    " FROM (SELECT product_id, count(*) AS fields_total, count(*) FILTER (outcome IN ('normalized', 'passthrough')) AS fields_normalized,"
    " count(*) FILTER (has_conflict) AS fields_conflicted, count(*) FILTER (outcome = 'missing') AS fields_missing, CAST(sum(n_refs) AS BIGINT) AS field_refs"
    " FROM fields GROUP BY 1) f LEFT JOIN (SELECT product_id, count(*) AS n FROM mapped WHERE kind = 'unmapped' GROUP BY 1) u ON u.product_id = f.product_id"
    " LEFT JOIN (SELECT product_id, count(*) FILTER (outcome = 'parse_error') AS pe, count(*) FILTER (outcome = 'unknown_unit') AS uu FROM collected"
    " GROUP BY 1) i ON i.product_id = f.product_id")


@register("product_summary", _SUMMARY, FL)
def _summary(spark, sf):
    return inputs.track(spark, sf).product_summary.drop("issues")


@register("normalization_report", "SELECT (SELECT count(*) FROM products) AS products_processed, CAST(0 AS BIGINT) AS products_failed, count(*) AS products_succeeded,"
          " CAST(sum(field_refs + unmapped_evidence) AS BIGINT) AS evidence_consumed, CAST(sum(fields_normalized) AS BIGINT) AS fields_normalized,"
          " CAST(sum(fields_conflicted) AS BIGINT) AS fields_conflicted, CAST(sum(fields_missing) AS BIGINT) AS fields_missing,"
          " CAST(sum(unmapped_evidence) AS BIGINT) AS unmapped_attrs, CAST(sum(parse_errors) AS BIGINT) AS parse_errors,"
          f" CAST(sum(unknown_units) AS BIGINT) AS unknown_units FROM ({_SUMMARY})", FL)
def _report(spark, sf):
    return inputs.track(spark, sf).normalization_report


@register("field_sources", "SELECT product_id, canonical_field, concat(source_type, CASE WHEN page IS NOT NULL THEN ':p.' || page WHEN \"row\" IS NOT NULL THEN"
          " ':row.' || \"row\" ELSE '' END, ' (', attribute, ')') AS label, count(*) AS n_facts FROM own GROUP BY ALL", N)
def _sources(spark, sf):
    return normalize.field_sources(inputs.track(spark, sf).normalized).select("product_id", "canonical_field", "label", "n_facts")


# --- rules ---

def _rule(name: str, numbers: list[int], build):
    wanted = ", ".join(str(n) for n in numbers)

    @register(name, f"SELECT {FINDING}, count(*) AS n_copies FROM findings WHERE rule_no IN ({wanted}) GROUP BY ALL", R)
    def _run(spark, sf):
        return _shown(build(inputs.track(spark, sf)))


def _rule_rows(name: str, numbers: list[int], build):
    """Every finding as a row of its own, also the equal ones about the copies of a fact."""
    wanted = ", ".join(str(n) for n in numbers)

    @register(name, f"SELECT {FINDING} FROM findings WHERE rule_no IN ({wanted})", R)
    def _run(spark, sf):
        return validate.one_per_copy(build(inputs.track(spark, sf))).select(*FINDING_COLUMNS)


_rule_rows("rule_canonical_units", [1], lambda t: validate.check_canonical_units(t.fields))
_rule("rule_version", [2], lambda t: validate.check_version(t.products))
_rule("rule_required", [3], lambda t: validate.check_required(t.fields))
_rule("rule_important", [4], lambda t: validate.check_important(t.fields))
_rule_rows("rule_ranges", list(range(5, 12)), lambda t: validate.check_ranges(t.fields, t.disputes, t.normalized, t.global_normalized))
_rule_rows("rule_cross_source", [12], lambda t: validate.check_cross_source(t.disputes))
_rule("rule_torque", [13], lambda t: validate.check_torque(t.product_rows))
_rule("rule_efficiency_floor", [14], lambda t: validate.check_efficiency_floor(t.fields, t.disputes))
_rule("rule_sync_speed", [15], lambda t: validate.check_sync_speed(t.product_rows))
_rule("rule_missing_inventory", [16], lambda t: validate.missing_inventory(t.fields))
_rule_rows("rule_source_pair", [17], lambda t: validate.check_source_pair(t.disputes))
_rule_rows("run_rules", list(range(1, 18)), lambda t: t.findings)


@register("findings_summary", "SELECT * FROM summary", R)
def _findings_summary(spark, sf):
    return inputs.track(spark, sf).summary.drop("by_category")


@register("findings_by_category", "SELECT product_id, category, CAST(count(*) AS BIGINT) AS n FROM findings GROUP BY ALL", R)
def _by_category(spark, sf):
    return inputs.track(spark, sf).summary.select("product_id", F.explode("by_category").alias("category", "n"))


@register("overall_validation_status", "SELECT overall_status, count(*) AS n_products FROM summary GROUP BY 1", R)
def _overall_status(spark, sf):
    rows = inputs.track(spark, sf).findings.groupBy("product_id").agg(validate.overall_validation_status().alias("overall_status"))
    return rows.groupBy("overall_status").agg(F.count(F.lit(1)).alias("n_products"))


@register("batch_validation_report", "SELECT count(*) AS products_processed, count(*) FILTER (overall_status = 'PASS') AS products_passing,"
          " count(*) FILTER (overall_status = 'WARNING') AS products_with_warn, count(*) FILTER (overall_status = 'CONFLICT') AS products_with_conflict,"
          " count(*) FILTER (coalesce(overall_status, 'FAIL') = 'FAIL') AS products_failing, CAST(sum(total_findings) AS BIGINT) AS total_findings, "
          + ", ".join(f"CAST(sum(n_{s.lower()}) AS BIGINT) AS findings_{s.lower()}" for s in dims.FINDING_STATUSES)
          + " FROM products p LEFT JOIN summary s ON s.product_id = p.product_id", R)
def _batch_validation(spark, sf):
    t = inputs.track(spark, sf)
    return validate.batch_validation_report(t.products, t.summary)


@register("category_totals", "SELECT category, count(*) AS n_findings FROM findings GROUP BY 1", R)
def _category_totals(spark, sf):
    return validate.category_totals(inputs.track(spark, sf).findings)


# --- trust ---

@register("attribute_trust", "SELECT product_id, field_pos, field, value_num, value_str, trust_status, publishability, validation_status, confidence_score,"
          " is_conflicted, rule_ids, fail_rule, warn_rule FROM attributes", T)
def _attributes(spark, sf):
    return inputs.track(spark, sf).attributes.select(
        "product_id", "field_pos", "field", "value_num", "value_str", "trust_status", "publishability", "validation_status", "confidence_score",
        "is_conflicted", F.array_join("rule_ids", ",").alias("rule_ids"), "fail_rule", "warn_rule")


@register("review_items", "SELECT product_id, review_id, part, target_type, target_name, severity, issue_type, validation_rule_id, count(*) AS n"
          " FROM review_items GROUP BY ALL", T)
def _review_items(spark, sf):
    return inputs.track(spark, sf).review_items.groupBy(
        "product_id", "review_id", "part", "target_type", "target_name", "severity", "issue_type", "validation_rule_id").agg(
        F.sum("n_items").alias("n"))


@register("dedupe_reviews", "SELECT * FROM reviews", T)
def _reviews(spark, sf):
    return inputs.track(spark, sf).reviews.select(
        "product_id", "review_id", "n_collapsed", "part", "target_type", "target_name", "severity", "issue_type", "validation_rule_id")


@register("trust_score", "SELECT product_id, n_conflicted, round(completeness, 6) AS completeness, round(validity, 6) AS validity,"
          " CAST(diversity AS DOUBLE) AS diversity, round(CAST(conflict_penalty AS DOUBLE), 6) AS conflict_penalty, round(trust_score, 6) AS trust_score FROM scores", T)
def _scores(spark, sf):
    return inputs.track(spark, sf).scores.select(
        "product_id", "n_conflicted", *[F.round(c, 6).alias(c) for c in ("completeness", "validity", "diversity", "conflict_penalty", "trust_score")])


@register("overall_trust", "SELECT product_id, overall_trust_status, overall_publishability, review_items_count FROM overall", T)
def _overall(spark, sf):
    return inputs.track(spark, sf).overall.select("product_id", "overall_trust_status", "overall_publishability", "review_items_count")


@register("publishable_lists", "SELECT product_id, coalesce(string_agg(field, ',' ORDER BY field_pos) FILTER (publishability LIKE 'PUBLISHABLE%'), '') AS publishable,"
          " coalesce(string_agg(field, ',' ORDER BY field_pos) FILTER (publishability NOT LIKE 'PUBLISHABLE%'), '') AS restricted FROM attributes GROUP BY 1", T)
def _lists(spark, sf):
    return trust.publishable_lists(inputs.track(spark, sf).attributes).select(
        "product_id", F.array_join("publishable_attributes", ",").alias("publishable"),
        F.array_join("restricted_attributes", ",").alias("restricted"))


@register("unresolved_conflicts", "SELECT product_id, canonical_field AS field, CAST(count(*) AS BIGINT) AS n FROM pairs GROUP BY ALL", FL)
def _unresolved(spark, sf):
    return trust.unresolved_conflicts(inputs.track(spark, sf).disputes).groupBy("product_id", "field").agg(F.sum("n_copies").alias("n"))


_REPORT = ("SELECT product_id, manufacturer, model, overall_trust_status, overall_publishability, round(trust_score, 6) AS trust_score, review_items_count,"
           " conflicts_count, publishable_attributes_count, restricted_attributes_count FROM report")


@register("product_report", _REPORT, T)
def _product_report(spark, sf):
    return inputs.track(spark, sf).report.drop("summary_reason").withColumn("trust_score", F.round("trust_score", 6))


@register("batch_trust_report", "SELECT count(*) AS total_products, count(*) FILTER (overall_trust_status = 'TRUSTED') AS trusted_count,"
          " count(*) FILTER (overall_trust_status = 'REVIEW_REQUIRED') AS review_required_count, count(*) FILTER (overall_trust_status = 'CONFLICTED') AS conflicted_count,"
          " count(*) FILTER (overall_publishability = 'PUBLISHABLE') AS publishable_count, count(*) FILTER (overall_publishability = 'PUBLISHABLE_WITH_WARNING')"
          " AS publishable_with_warning_count, count(*) FILTER (overall_publishability = 'NOT_PUBLISHABLE') AS not_publishable_count,"
          " round(avg(trust_score), 4) AS avg_trust_score, CAST(sum(review_items_count) AS BIGINT) AS total_review_items FROM report", T)
def _batch_trust(spark, sf):
    return trust.batch_trust_report(inputs.track(spark, sf).report)


_ANSWERED = f"SELECT {inputs.PRODUCT_ID} AS product_id FROM part WHERE {inputs.K} % 5 <> 3"


@register("stage_availability", "SELECT coalesce(n.product_id, v.product_id, e.product_id) AS product_id, n.product_id IS NOT NULL AS has_normalization,"
          " v.product_id IS NOT NULL AS has_validation, e.product_id IS NOT NULL AS has_enrichment FROM (SELECT DISTINCT product_id FROM own) n FULL JOIN"
          f" (SELECT DISTINCT product_id FROM findings) v ON v.product_id = n.product_id FULL JOIN ({_ANSWERED}) e ON e.product_id = coalesce(n.product_id, v.product_id)", R)
def _availability(spark, sf):
    t = inputs.track(spark, sf, True)
    return trust.availability(t.normalized, t.summary, t.parsed.filter("answer is not null"))


# --- audits: all must be empty ---

@register("audit_no_winner", "SELECT f.product_id, f.canonical_field, f.outcome, f.value_num, f.value_str FROM fields f JOIN disputed d ON d.product_id = f.product_id"
          " AND d.canonical_field = f.canonical_field WHERE f.value_num IS NOT NULL OR f.value_str IS NOT NULL", FL)
def _no_winner(spark, sf):
    t = inputs.track(spark, sf)
    return audit.audit_no_winner(t.fields, t.findings)


@register("audit_missing_null", "SELECT product_id, canonical_field, value_num, value_str FROM fields WHERE outcome = 'missing' AND (value_num IS NOT NULL OR"
          " value_str IS NOT NULL)", FL)
def _missing_null(spark, sf):
    return audit.audit_missing_null(inputs.track(spark, sf).fields)


@register("audit_provenance", "SELECT product_id, source_type, method, attribute, source_rank, pos FROM ev WHERE (method = 'table' AND page IS NULL) OR"
          " (source_type = 'csv' AND (\"row\" IS NULL OR coalesce(\"column\", '') = ''))", E)
def _provenance(spark, sf):
    return audit.audit_provenance(inputs.evidence(spark, sf))


@register("audit_completeness", "SELECT product_id, stage FROM (SELECT p.product_id, 'fields' AS stage FROM products p WHERE p.product_id NOT IN (SELECT product_id"
          " FROM fields) UNION ALL SELECT p.product_id, 'poles' FROM products p WHERE p.product_id NOT IN (SELECT product_id FROM mapped WHERE attribute = 'poles')"
          " UNION ALL SELECT p.product_id, 'findings' FROM products p WHERE p.product_id NOT IN (SELECT product_id FROM findings) UNION ALL"
          f" SELECT p.product_id, 'answers' FROM products p WHERE p.product_id NOT IN ({_ANSWERED}))", R)
def _completeness(spark, sf):
    t = inputs.track(spark, sf, True)
    return audit.audit_completeness(t.products, {
        "fields": t.fields, "poles": t.mapped.filter(F.col("attribute") == "poles"), "findings": t.findings, "answers": t.parsed.filter("answer is not null")})


@register("audit_failed_sources", "SELECT product_id, source_type, n_facts FROM (SELECT product_id, source_type, count(*) AS n_facts FROM ev GROUP BY 1, 2)"
          " WHERE source_type = 'web' AND product_id IN (SELECT product_id FROM products WHERE normalization_version = '1.0.0')", E)
def _failed_sources(spark, sf):
    log = inputs.products(spark, sf).select(
        "product_id", F.lit("web").alias("source_type"),
        F.when(F.col("normalization_version") == "1.0.0", "failed").otherwise("success").alias("status"))
    return audit.audit_failed_sources_empty(log, inputs.evidence(spark, sf))
