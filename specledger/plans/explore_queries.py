"""Queries of claims, and of the lists and summaries over stored results."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from specledger import dims
from specledger.operators import claims, explore, trust
from specledger.plans import inputs, oracle
from specledger.plans.inputs import K, POLES, PRODUCT_ID, _text
from specledger.plans.registry import register
from specledger.session import stage_dir

R, T, FL, E = oracle.RULES, oracle.TRUST, oracle.FIELDS, oracle.EVIDENCE

# What the answers made in ``inputs`` contain, said directly.
ANSWERS = {
    "answers": f"SELECT {PRODUCT_ID} AS product_id, {K} AS k, {K} % 5 <> 3 AS ok, {K} % 5 < 3 AS full_answer FROM part",
    "claims": (
        "SELECT product_id, 'SOURCE_BACKED' AS claim_type, 0 AS claim_no, 'current' AS claim_text, 'performance' AS category, 'rated_current' AS field, 'normalized_evidence' AS sources,"
        " 1::DOUBLE AS confidence, CAST(NULL AS VARCHAR) AS notes FROM answers WHERE full_answer UNION ALL SELECT product_id, 'SOURCE_BACKED', 2, 'ip', 'specification', 'ip_rating', 'normalized_evidence',"
        " 0.9::DOUBLE, NULL FROM answers WHERE full_answer UNION ALL SELECT product_id, 'INFERRED', 0, 'use', 'application', NULL, '', 0.85::DOUBLE, 'model inference' FROM answers WHERE full_answer"),
    "inferred": (
        "SELECT product_id, 'frequency' AS field, CASE WHEN k % 2 = 0 THEN '50 Hz' ELSE 'about 60' END AS inferred_value FROM answers WHERE full_answer UNION ALL SELECT product_id, 'poles',"
        " concat(2 + k % 8, '-pole') FROM answers WHERE full_answer"),
    "named": "SELECT product_id, CASE WHEN k % 3 = 0 THEN 'weight' ELSE 'rated_current' END AS field FROM answers WHERE full_answer",
}
RA = {**R, **ANSWERS}
TA = {**RA, **oracle._trust(True), **{k: v for k, v in oracle._REVIEWS.items()}}
TA["claim_results"] = (
    "SELECT c.product_id, c.claim_type, c.claim_no, c.claim_text, c.category, c.field, c.confidence AS given, c.claim_type = 'SOURCE_BACKED' AND coalesce(a.is_conflicted, false) AS disputed"
    " FROM claims c LEFT JOIN attributes a ON a.product_id = c.product_id AND a.field = c.field")
TA["review_items"] += (
    " UNION ALL SELECT product_id, concat('REV-', product_id, '-claim-', category, '-conflict'), 1, claim_no, 0, 'claim', coalesce(field, category), 'HIGH', 'CONFLICT', NULL FROM claim_results WHERE disputed")
# Claim results come after the attributes and before the reviews.
TA = {k: TA[k] for k in [*RA, "by_field", "attributes", "claim_results", *oracle._REVIEWS]}


def _parsed(spark, sf):
    return claims.parse_responses(inputs.responses(spark, sf))


@register("parse_responses", "SELECT product_id, ok, CASE WHEN full_answer THEN concat(' s', k, ' ') WHEN ok THEN 'only text' END AS summary, CASE WHEN full_answer THEN concat(2 + k % 8, '-pole') END AS poles,"
          " CASE WHEN full_answer THEN CAST(3 AS INT) WHEN ok THEN CAST(0 AS INT) END AS n_backed FROM answers", ANSWERS)
def _parse(spark, sf):
    return _parsed(spark, sf).select(
        "product_id", F.col("answer").isNotNull().alias("ok"), "answer.summary", F.try_element_at("answer.inferred_fields", F.lit("poles")).alias("poles"),
        F.size("answer.source_backed_claims").alias("n_backed"))


@register("explode_claims", "SELECT * FROM claims", ANSWERS)
def _claims(spark, sf):
    return claims.explode_claims(_parsed(spark, sf)).withColumn("sources", F.array_join("evidence_sources", ",")).drop("evidence_sources")


@register("inferred_fields", "SELECT * FROM inferred", ANSWERS)
def _inferred(spark, sf):
    return claims.inferred_fields(_parsed(spark, sf))


_MOTORS = {"frequency": f"case when {K} % 3 = 0 then null else cast(50 as double) end", "poles": f"case when {K} % 4 < 2 then null else cast({POLES} as double) end"}


@register("fill_unknown", "SELECT m.product_id, m.field, coalesce(m.v, CASE WHEN filled THEN guess END) AS value_num, CASE WHEN m.v IS NOT NULL THEN 'Verified' WHEN filled THEN 'Inferred' ELSE 'Unknown' END AS status,"
          " CASE WHEN m.v IS NOT NULL THEN 0.8::DOUBLE WHEN filled THEN CASE WHEN m.field = 'poles' THEN 0.95::DOUBLE ELSE 0.9::DOUBLE END END AS confidence FROM (SELECT m.*, i.guess, m.v IS NULL AND i.guess IS NOT NULL AS filled"
          " FROM motors m LEFT JOIN (SELECT product_id, 'frequency' AS field, CASE WHEN k % 2 = 0 THEN 50::DOUBLE ELSE 60::DOUBLE END AS guess FROM answers WHERE full_answer UNION ALL SELECT product_id, 'poles',"
          " CASE WHEN 2 + k % 8 IN (2, 4, 6, 8) THEN CAST(2 + k % 8 AS DOUBLE) END FROM answers WHERE full_answer) i ON i.product_id = m.product_id AND i.field = m.field) m", {
              **ANSWERS, "motors": " UNION ALL ".join(f"SELECT {PRODUCT_ID} AS product_id, '{f}' AS field, {e} AS v FROM part" for f, e in _MOTORS.items())})
def _fill(spark, sf):
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.expr(e).alias("value_num")) for f, e in _MOTORS.items()])
    motors = inputs.table(spark, sf, "part").select(F.expr(PRODUCT_ID).alias("product_id"), F.inline(cells))
    known = F.col("value_num").isNotNull()
    motors = motors.select("*", F.when(known, "Verified").otherwise("Unknown").alias("status"), F.when(known, 0.8).alias("confidence"),
                           F.when(known, F.array(F.lit("pdf"))).alias("sources"))
    return claims.fill_unknown(motors, claims.inferred_fields(_parsed(spark, sf))).drop("sources")


_OPEN = ("SELECT product_id, field, false AS added FROM named UNION ALL SELECT DISTINCT f.product_id, f.field, true FROM findings f JOIN answers a ON a.product_id = f.product_id AND a.ok WHERE f.status = 'CONFLICT'"
         " AND NOT EXISTS (SELECT 1 FROM named n WHERE n.product_id = f.product_id AND n.field = f.field)")


@register("open_conflicts", _OPEN, RA)
def _open(spark, sf):
    return claims.open_conflicts(_parsed(spark, sf), inputs.track(spark, sf).findings).select("product_id", "field", "added")


@register("enrichment_report", "SELECT (SELECT count(*) FROM products) AS products_processed, (SELECT count(*) FROM answers WHERE ok) AS products_enriched, (SELECT count(*) FROM answers WHERE NOT ok) AS products_failed,"
          " (SELECT count(*) FROM claims) AS total_claims_generated, (SELECT count(*) FROM claims WHERE claim_type = 'SOURCE_BACKED') AS source_backed_claims_count, (SELECT count(*) FROM claims WHERE claim_type ="
          f" 'INFERRED') AS inferred_claims_count, (SELECT count(*) FROM ({_OPEN})) AS unresolved_conflicts_count", RA)
def _report(spark, sf):
    parsed = _parsed(spark, sf)
    return claims.enrichment_report(inputs.products(spark, sf), parsed, claims.explode_claims(parsed),
                                    claims.open_conflicts(parsed, inputs.track(spark, sf).findings))


_PAYLOAD_SQL = " UNION ALL ".join([
    "SELECT product_id, 'facts' AS section, canonical_field AS key, coalesce(value_str, canonical_unit) AS text, value_num AS num, CAST(1 AS BIGINT) AS n FROM fields WHERE outcome IN ('normalized', 'passthrough')",
    "SELECT product_id, 'missing', canonical_field, NULL, NULL, 1 FROM fields WHERE outcome = 'missing'",
    "SELECT product_id, 'checks', overall_status, CAST(n_conflict AS VARCHAR), CAST(n_pass AS DOUBLE), n_warning FROM summary",
    "SELECT product_id, 'conflicts', canonical_field, type_b, NULL, count(*) FROM pairs GROUP BY ALL",
    "SELECT product_id, 'unmapped_specifications', attribute, arg_max(coalesce(unit, ''), (source_rank, pos)), arg_max(value, (source_rank, pos)), 1 FROM mapped"
    " WHERE kind = 'unmapped' AND value IS NOT NULL AND product_id <> 'GLOBAL' GROUP BY product_id, attribute",
    "SELECT product_id, 'engineering_findings', rule_id, status, NULL, count(*) FROM findings WHERE rule_no IN (13, 14, 15, 17) GROUP BY ALL"])
_FACTS_LINE = ("verified_specifications map<string,struct<value:string,unit:string>>, missing_fields array<string>,"
               " validation_summary struct<overall_status:string,pass_count:long,conflict_count:long,warning_count:long>")


@register("grounding_payload", _PAYLOAD_SQL, R)
def _payload(spark, sf):
    """The content of the payload, taken out of its JSON again."""
    t = inputs.track(spark, sf)
    lines = claims.grounding_payload(t.products, t.fields, t.unmapped, t.summary, t.findings, t.pairs)
    one = F.lit(1).cast("long").alias("n")

    def part(name, key, text, num, n=one):
        return F.lit(name).alias("section"), key.alias("key"), text.cast("string").alias("text"), num.cast("double").alias("num"), n

    facts = lines.filter("section = 'facts'").select("product_id", F.from_json("payload", _FACTS_LINE).alias("p"))
    value, none = F.col("v.value"), F.lit(None)
    is_text = F.col("k").isin(dims.STRING_FIELDS)
    specs = facts.select("product_id", F.explode("p.verified_specifications").alias("k", "v")).select(
        "product_id", *part("facts", F.col("k"), F.when(is_text, value).otherwise(F.col("v.unit")), F.when(~is_text, value.try_cast("double"))))
    missing = facts.select("product_id", F.explode("p.missing_fields").alias("k")).select("product_id", *part("missing", F.col("k"), none, none))
    c = "p.validation_summary"
    checks = facts.select("product_id", *part("checks", F.col(f"{c}.overall_status"), F.col(f"{c}.conflict_count"), F.col(f"{c}.pass_count"), F.col(f"{c}.warning_count").alias("n")))

    def field(path):
        return F.get_json_object("payload", path)

    named = lines.filter("section = 'unmapped_specifications'").select("product_id", *part(
        "unmapped_specifications", field("$.attribute"), field("$.spec.unit"), field("$.spec.value")))
    counted = lines.filter("section in ('conflicts', 'engineering_findings')").select(
        "product_id", "section", F.when(F.col("section") == "conflicts", field("$.field")).otherwise(F.regexp_extract(field("$.note"), r"^(\w+):", 1)).alias("key"),
        F.when(F.col("section") == "conflicts", F.regexp_extract(field("$.source_b"), r"^(\w+) ", 1)).otherwise(F.regexp_extract(field("$.note"), r"\[(\w+)\]", 1)).alias("text"),
        field("$.copies").cast("long").alias("copies")).groupBy("product_id", "section", "key", "text").agg(F.sum("copies").alias("n")).select(
        "product_id", "section", "key", "text", F.lit(None).cast("double").alias("num"), "n")
    return specs.unionByName(missing).unionByName(checks).unionByName(named).unionByName(counted)


@register("claim_trust", "SELECT product_id, claim_type, claim_no, claim_text, category, field, CASE WHEN disputed THEN 'CONFLICTED' WHEN claim_type = 'SOURCE_BACKED' THEN 'TRUSTED' ELSE 'UNVERIFIED' END AS trust_status,"
          " CASE WHEN disputed THEN 'REVIEW_REQUIRED' WHEN claim_type = 'SOURCE_BACKED' THEN 'PUBLISHABLE' ELSE 'PUBLISHABLE_WITH_WARNING' END AS publishability, CASE WHEN disputed THEN 0.4::DOUBLE ELSE given END AS"
          " confidence FROM claim_results", TA)
def _claim_trust(spark, sf):
    return inputs.track(spark, sf, True).claim_results.drop("evidence_sources", "reason")


@register("attribute_trust_inferred", "SELECT product_id, field, value_num, CASE WHEN trust_status = 'UNVERIFIED' THEN (SELECT i.inferred_value FROM inferred i WHERE i.product_id = a.product_id AND i.field = a.field)"
          " ELSE value_str END AS value_str, trust_status, publishability, validation_status, confidence_score FROM attributes a", TA)
def _attributes(spark, sf):
    return inputs.track(spark, sf, True).attributes.select(
        "product_id", "field", "value_num", "value_str", "trust_status", "publishability", "validation_status", "confidence_score")


@register("review_queue_with_claims", "SELECT * FROM reviews", TA)
def _queue(spark, sf):
    return inputs.track(spark, sf, True).reviews.select(
        "product_id", "review_id", "n_collapsed", "part", "target_type", "target_name", "severity", "issue_type", "validation_rule_id")


# --- product lists ---
_LIST = ("SELECT r.product_id, r.manufacturer, r.model, r.overall_trust_status, r.overall_publishability, round(r.trust_score, 6) AS trust_score, r.review_items_count, r.conflicts_count, "
         + ", ".join(f"max(a.value_num) FILTER (a.field = '{f}') AS {n}" for f, n in explore.LISTED_SPECS.items() if f != "poles")
         + ", CAST(max(a.value_num) FILTER (a.field = 'poles') AS INT) AS poles, max(a.value_str) FILTER (a.field = 'frame_size') AS frame_size FROM report r LEFT JOIN attributes a ON a.product_id ="
         " r.product_id GROUP BY ALL")
LIST = {**T, "listed": _LIST}
_LIST_COLUMNS = ["product_id", "manufacturer", "model", "overall_trust_status", "overall_publishability", "trust_score", "review_items_count", "conflicts_count",
                 *explore.LISTED_SPECS.values(), "frame_size"]


def _products(spark, sf):
    t = inputs.track(spark, sf)
    return explore.product_list(t.report, t.attributes)


def _list_columns(df):
    return df.withColumn("trust_score", F.round("trust_score", 6)).select(*_LIST_COLUMNS)


@register("product_list", "SELECT * FROM listed", LIST)
def _list(spark, sf):
    return _list_columns(_products(spark, sf))


@register("list_products", "SELECT * FROM listed WHERE (contains(lower(product_id), 'gear') OR contains(lower(model), 'gear') OR contains(lower(coalesce(manufacturer, '')), 'gear')) AND overall_trust_status ="
          " 'CONFLICTED' AND overall_publishability = 'REVIEW_REQUIRED'", LIST)
def _list_products(spark, sf):
    return _list_columns(explore.list_products(_products(spark, sf), search="GEAR", status="conflicted", publishability="review_required"))


@register("sort_products", "SELECT * FROM listed WHERE overall_publishability = 'REVIEW_REQUIRED' AND (contains(product_id, '5k') OR contains(lower(model), '5k') OR (rated_power_kw <> 0 AND contains(concat(CASE WHEN"
          " rated_power_kw = floor(rated_power_kw) THEN CAST(CAST(rated_power_kw AS BIGINT) AS VARCHAR) ELSE CAST(rated_power_kw AS VARCHAR) END, 'kw'), '5kw')))", LIST)
def _sort(spark, sf):
    return _list_columns(explore.sort_products(_products(spark, sf), by="power", ascending=False, search="5KW", tab="REVIEW_REQUIRED"))


@register("top_products", "SELECT product_id, round(trust_score, 6) AS trust_score FROM report ORDER BY round(trust_score, 9) DESC, product_id LIMIT 6", T)
def _top(spark, sf):
    order = F.struct((-F.round("trust_score", 9)).alias("s"), F.col("product_id").alias("p"))
    return explore.top_n(inputs.track(spark, sf).report, order.asc(), 6).select("product_id", F.round("trust_score", 6).alias("trust_score"))


@register("publishability_shares", "SELECT overall_publishability, count(*) AS n, round(count(*) / (SELECT count(*) FROM report) * 100, 2) AS share_pct FROM report GROUP BY 1", T)
def _shares(spark, sf):
    return explore.shares(inputs.track(spark, sf).report, "overall_publishability")


@register("score_bands", "SELECT product_id, CAST(floor(trust_score * 100 + 0.5) AS INT) AS score_pct, CASE WHEN floor(trust_score * 100 + 0.5) >= 80 THEN 'high' WHEN floor(trust_score * 100 + 0.5) >= 50 THEN 'medium'"
          " ELSE 'low' END AS band FROM report", T)
def _bands(spark, sf):
    return explore.score_bands(inputs.track(spark, sf).report)


_ZERO = " UNION ALL ".join(
    f"SELECT '{kind}' AS kind, n.name, count(x.{c}) AS n FROM (VALUES {', '.join(f'({oracle.quoted(v)})' for v in names)}) n(name) LEFT JOIN {src} x ON x.{c} = n.name GROUP BY 1, 2"
    for kind, src, c, names in (("trust", "report", "overall_trust_status", dims.TRUST_STATUSES), ("publishability", "report", "overall_publishability", dims.PUBLISHABILITIES),
                                ("severity", "reviews", "severity", dims.SEVERITIES)))


@register("batch_distributions", _ZERO, T)
def _distributions(spark, sf):
    t = inputs.track(spark, sf)
    return explore.batch_distributions(t.report, t.reviews)


@register("product_details", "SELECT r.product_id, r.overall_trust_status, CAST(11 AS BIGINT) AS n_specifications, coalesce(v.n, 0) AS n_reviews, coalesce(c.n, 0) AS n_claims, e.n AS n_evidence FROM report r LEFT JOIN"
          " (SELECT product_id, count(*) AS n FROM reviews GROUP BY 1) v ON v.product_id = r.product_id LEFT JOIN (SELECT product_id, count(*) AS n FROM claims GROUP BY 1) c ON c.product_id = r.product_id"
          " LEFT JOIN (SELECT product_id, count(*) AS n FROM ev GROUP BY 1) e ON e.product_id = r.product_id", {**ANSWERS, **T})
def _details(spark, sf):
    t = inputs.track(spark, sf)
    rows = explore.detail_rows(t.report, t.attributes, t.reviews, claims.explode_claims(_parsed(spark, sf)), t.evidence)
    return rows.select("product_id", "overall_trust_status", "n_specifications", "n_reviews", "n_claims", "n_evidence")


@register("product_details_nested", "SELECT product_id, 'report' AS section, overall_trust_status AS name, NULL AS text, NULL AS num FROM report UNION ALL SELECT product_id, 'specifications', field, trust_status,"
          " confidence_score FROM attributes UNION ALL SELECT product_id, 'reviews', review_id, severity, CAST(n_collapsed AS DOUBLE) FROM reviews UNION ALL"
          " SELECT product_id, 'claims', claim_text, category, confidence FROM claims", {**ANSWERS, **T})
def _nested_details(spark, sf):
    """Every product as one row, taken apart again."""
    t = inputs.track(spark, sf)
    rows = explore.nested_details(t.report, t.attributes, t.reviews, claims.explode_claims(_parsed(spark, sf)))

    def entry(section, name, text=None, num=None):
        return F.struct(F.lit(section).alias("section"), name.alias("name"), F.lit(text).cast("string").alias("text"), F.lit(num).cast("double").alias("num"))

    def section(name, column, text, num):
        return F.transform(name, lambda e: entry(name, e[column], e[text], e[num]))

    # All sections of a row at once: a union of them would gather the products once for each.
    return rows.select("product_id", F.inline(F.concat(
        F.array(entry("report", F.col("report.overall_trust_status"))), section("specifications", "field", "trust_status", "confidence_score"),
        section("reviews", "review_id", "severity", "n_collapsed"), section("claims", "claim_text", "category", "confidence"))))


@register("product_lookup", "SELECT product_id, field, trust_status FROM attributes WHERE product_id = 'P-4P-17'", T)
def _lookup(spark, sf):
    return explore.get_detail(inputs.track(spark, sf).attributes, "product_id", "P-4P-17").select("product_id", "field", "trust_status")


# --- views ---

@register("trust_view", "SELECT product_id, field, trust_status, publishability, confidence_score FROM attributes", T)
def _trust_view(spark, sf):
    return explore.trust_view(inputs.track(spark, sf).attributes).drop("reason")


@register("evidence_view", "SELECT product_id, source_id, source_type, attribute, raw_value, unit, value, method, confidence, page, \"row\", \"column\", url FROM ev", E)
def _evidence_view(spark, sf):
    return explore.evidence_view(inputs.evidence(spark, sf)).drop("section")


@register("evidence_counts", "SELECT product_id, source_type, count(*) AS n_facts FROM ev GROUP BY 1, 2", E)
def _evidence_counts(spark, sf):
    return explore.evidence_counts(inputs.evidence(spark, sf))


@register("enrichment_view", "SELECT a.product_id, CASE WHEN full_answer THEN concat('s', k) ELSE 'only text' END AS summary, coalesce(c.n, 0) AS total_claims FROM answers a LEFT JOIN (SELECT product_id, count(*) AS n"
          " FROM claims GROUP BY 1) c ON c.product_id = a.product_id WHERE ok", ANSWERS)
def _enrichment_view(spark, sf):
    parsed = _parsed(spark, sf)
    return explore.enrichment_view(claims.response_lists(parsed), claims.explode_claims(parsed)).select("product_id", "summary", "total_claims")


@register("evidence_for_attribute", "SELECT product_id, source_type, raw_value, unit FROM ev WHERE lower(attribute) = 'rated_voltage'", E)
def _evidence_for(spark, sf):
    return explore.evidence_for(inputs.evidence(spark, sf), "RATED_VOLTAGE").select("product_id", "source_type", "raw_value", "unit")


@register("filter_specs", "SELECT product_id, field, trust_status FROM attributes WHERE trust_status IN ('UNVERIFIED', 'REVIEW_REQUIRED')", T)
def _filter_specs(spark, sf):
    return explore.filter_specs(inputs.track(spark, sf).attributes, "INFERRED").select("product_id", "field", "trust_status")


@register("spec_conflicts", "SELECT a.product_id, a.field, a.trust_status, coalesce(p.n, 0) AS n_conflicts FROM attributes a LEFT JOIN (SELECT product_id, canonical_field, count(*) AS n FROM pairs GROUP BY 1, 2) p ON"
          " p.product_id = a.product_id AND p.canonical_field = a.field", T)
def _spec_conflicts(spark, sf):
    t = inputs.track(spark, sf)
    return explore.spec_conflicts(t.attributes, trust.unresolved_conflicts(t.disputes)).select("product_id", "field", "trust_status", "n_conflicts")


@register("conflict_sources", "SELECT DISTINCT product_id, canonical_field, source_type, raw_value, value FROM (SELECT product_id, canonical_field, type_a AS source_type, raw_a AS raw_value, value_a AS value FROM pairs"
          " UNION ALL SELECT product_id, canonical_field, type_b, raw_b, value_b FROM pairs)", FL)
def _conflict_sources(spark, sf):
    return explore.conflict_sources(inputs.track(spark, sf).pairs).select("product_id", "canonical_field", "source_type", "raw_value", "value")


@register("field_source_list", "SELECT DISTINCT product_id, canonical_field, source_type, raw_value, value FROM own", oracle.NORMALIZED)
def _field_source_list(spark, sf):
    return explore.field_source_list(inputs.track(spark, sf).normalized).select("product_id", "canonical_field", "source_type", "raw_value", "value")


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@register("coverage_health", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in TABLES))
def _health(spark, sf):
    return explore.coverage_health({t: inputs.table(spark, sf, t) for t in TABLES})


# --- reviews and resolutions ---
_RESOLVED = {"review_id": f"concat('REV-', {PRODUCT_ID}, case {K} % 3 when 0 then '-rated_current-conflict' when 1 then '-rated_speed-fail' else '-none' end)",
             "resolution_note": f"concat('note ', {_text(K)})", "resolved_value": _text(f"{K} % 9"), "resolved_by": "'qa'"}
DONE = {**T, "done": "SELECT " + ", ".join(f"{e} AS {n}" for n, e in _RESOLVED.items()) + " FROM part",
        "with_status": "SELECT r.*, CASE WHEN d.review_id IS NULL THEN 'OPEN' ELSE 'RESOLVED' END AS status, d.resolution_note, d.resolved_value FROM reviews r LEFT JOIN done d ON d.review_id = r.review_id"}
_REVIEW = "product_id, review_id, severity, issue_type, status, resolution_note, resolved_value"


def _with_status(spark, sf):
    done = inputs.table(spark, sf, "part").select(*[F.expr(e).alias(n) for n, e in _RESOLVED.items()])
    return explore.join_resolutions(inputs.track(spark, sf).reviews, done)


@register("join_resolutions", f"SELECT {_REVIEW} FROM with_status", DONE)
def _join_resolutions(spark, sf):
    return _with_status(spark, sf).select(*_REVIEW.split(", "))


@register("list_reviews", f"SELECT {_REVIEW} FROM with_status WHERE severity = 'HIGH' AND issue_type = 'CONFLICT' AND status = 'RESOLVED' AND (contains(lower(review_id), 'current') OR contains(lower(target_name), 'current'))", DONE)
def _list_reviews(spark, sf):
    return explore.list_reviews(_with_status(spark, sf), severity="high", issue_type="conflict", status="resolved", search="Current").select(*_REVIEW.split(", "))


@register("review_counters", "SELECT count(*) AS total, count(*) FILTER (status = 'OPEN') AS open, count(*) FILTER (status = 'RESOLVED') AS resolved, count(*) FILTER (issue_type = 'CONFLICT') AS conflicts,"
          " count(*) FILTER (issue_type = 'WARNING') AS warnings FROM with_status", DONE)
def _counters(spark, sf):
    return explore.review_counters(_with_status(spark, sf))


@register("latest_resolutions", "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def _latest(spark, sf):
    return explore.latest_resolutions(inputs.table(spark, sf, "events"), "user_id", ("ts", "event_id")).select("user_id", "event_id", "event_type", "value")


_LOG = {"review_id": "concat('REV-P-', cast(2 + 2*(user_id % 4) as string), 'P-', cast(user_id as string), '-', event_type)", "selected_source": "event_type",
        "resolved_value": "cast(event_id as string)", "resolution_note": "props", "resolved_by": "'qa'", "resolved_at": "cast(ts as string)", "entry_no": "event_id"}


@register("resolve_review", "SELECT l.review_id, coalesce(min(p.product_id), '') AS product_id, any_value(l.resolved_value) AS resolved_value FROM (SELECT review_id, arg_max(resolved_value, (resolved_at, entry_no)) AS"
          " resolved_value FROM log GROUP BY 1) l LEFT JOIN products p ON contains(l.review_id, p.product_id) GROUP BY 1",
          {"products": oracle.EVIDENCE["products"], "log": "SELECT " + ", ".join(f"{e.replace('cast(ts as string)', 'ts')} AS {n}" for n, e in _LOG.items()) + " FROM events"})
def _resolve(spark, sf):
    """Answers to reviews, added to a stored log in three runs; the last run also answers reviews that were answered before."""
    log = inputs.table(spark, sf, "events").select(*[F.expr(e).alias(n) for n, e in _LOG.items()])
    log = log.withColumn("resolved_at", F.date_format(F.col("resolved_at").cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    path, products = f"{stage_dir(spark)}/resolutions-{uuid.uuid4().hex}", explore.product_index(inputs.products(spark, sf))
    for run in range(3):
        explore.append_resolutions(log.filter(F.col("entry_no") % 3 == run), products, path)
        if run == 1:
            compact = f"{path}-compact"
            explore.compact_resolutions(spark, path, compact)
            path = compact
    return explore.read_resolutions(spark, path).select("review_id", "product_id", "resolved_value")


_SECTIONS = {
    "product": "SELECT product_id, 'product' AS section, canonical_field AS name, outcome AS text, value_num AS num FROM fields",
    "refs": "SELECT product_id, 'refs', attribute, raw_value, value FROM own",
    "conflicts": "SELECT product_id, 'conflicts', canonical_field, text_b, value_b FROM pairs",
    "issues": "SELECT product_id, 'issues', attribute, outcome, NULL FROM own WHERE outcome IN ('parse_error', 'unknown_unit')",
    "unmapped": "SELECT product_id, 'unmapped', attribute, raw_value, value FROM mapped WHERE kind = 'unmapped' AND product_id <> 'GLOBAL'"}
_ENTRY = ("array<struct<field:string,outcome:string,value_num:double,attribute:string,raw_value:string,value:double,text_b:string,value_b:double,n_copies:long,"
          "fact:struct<attribute:string,raw_value:string,value:double>>>")


@register("product_documents", f"SELECT product_id, section, name, text, num, count(*) AS n FROM ({' UNION ALL '.join(_SECTIONS.values())}) GROUP BY ALL", oracle.FIELDS)
def _documents(spark, sf):
    """The documents of all products, written as JSON lines, read back and taken apart."""
    from specledger.sinks.delivery import product_documents, write_products

    t = inputs.track(spark, sf)
    path = f"{stage_dir(spark)}/documents-{uuid.uuid4().hex}"
    write_products(product_documents(t.fields, t.products, t.normalized, t.pairs, t.unmapped), path)
    read = spark.read.schema(f"product_id string, section string, entries {_ENTRY}").json(path).select("product_id", "section", F.explode("entries").alias("e"))
    section = F.col("section")
    name = F.when(section.isin("product", "conflicts"), F.col("e.field")).otherwise(F.coalesce("e.fact.attribute", "e.attribute"))
    text = F.when(section.isin("product", "issues"), F.col("e.outcome")).when(section == "conflicts", F.col("e.text_b")).otherwise(
        F.coalesce("e.fact.raw_value", "e.raw_value"))
    num = F.when(section == "product", F.col("e.value_num")).when(section == "conflicts", F.col("e.value_b")).when(
        section != "issues", F.coalesce("e.fact.value", "e.value"))
    return read.groupBy("product_id", "section", name.alias("name"), text.alias("text"), num.alias("num")).agg(
        F.sum(F.coalesce("e.n_copies", F.lit(1))).cast("long").alias("n"))
