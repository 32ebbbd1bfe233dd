"""The same inputs and results as plain SQL, for checking. Written apart from the operators on purpose:
facts for all products are joined to every product, first facts come from row numbers, rules are one select each."""

from __future__ import annotations

from specledger import dims
from specledger.plans import inputs

NUMBER = r"^([+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)\s*([a-zA-Z%°()./\-]*)$"


def quoted(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def in_list(words) -> str:
    return "(" + ", ".join(quoted(w) for w in words) + ")"


def case(expr: str, table: dict, default: str = "NULL") -> str:
    """CASE over a table of result by key list."""
    arms = " ".join(f"WHEN {expr} IN {in_list(keys)} THEN {quoted(v) if isinstance(v, str) else v}" for v, keys in table.items())
    return f"CASE {arms} ELSE {default} END"


def placeholder(c: str) -> str:
    low = f"lower(trim({c}))"
    return f"({c} IS NULL OR ({low} LIKE '--%' AND {low} LIKE '%--') OR {low} IN {in_list(dims.PLACEHOLDERS)})"


def clean(c: str) -> str:
    return f"CASE WHEN {placeholder(c)} THEN NULL ELSE trim({c}) END"


def fraction(c: str) -> str:
    t = f"trim(replace(replace(trim({c}), '\"', ''), '''', ''))"

    def g(p: str, n: int) -> str:
        return f"try_cast(nullif(regexp_extract({t}, '{p}', {n}), '') AS DOUBLE)"

    compound, simple = r"^(\d+)[\s\-]+(\d+)/(\d+)$", r"^(\d+)/(\d+)$"
    return (f"coalesce(round({g(compound, 1)} + {g(compound, 2)} / nullif({g(compound, 3)}, 0), 6), "
            f"round({g(simple, 1)} / nullif({g(simple, 2)}, 0), 6), "
            f"CASE WHEN regexp_matches({t}, '^[+-]?(\\d+(\\.\\d*)?|\\.\\d+)([eE][+-]?\\d+)?$') THEN try_cast({t} AS DOUBLE) END)")


# --- specification track ---

def _part_facts() -> str:
    selects = []
    for kind, rank, pos, attribute, raw, value, unit in inputs.FACTS:
        pdf = kind == "pdf"
        page = f"CAST(1 + {inputs.K} % 7 AS INT)" if pdf else "CAST(NULL AS INT)"
        row = "CAST(NULL AS BIGINT)" if pdf else inputs.K
        column = "CAST(NULL AS VARCHAR)" if pdf else f"'c_{attribute}'"
        selects.append(
            f"SELECT {inputs.PRODUCT_ID} AS product_id, '{kind}' AS source_type, {rank} AS source_rank,"
            f" CAST({pos} AS BIGINT) AS pos, '{attribute}' AS attribute, {raw} AS raw_value,"
            f" CAST({value} AS DOUBLE) AS value, CAST({unit} AS VARCHAR) AS unit,"
            f" CAST({inputs.CONFIDENCE[kind]} AS DOUBLE) AS confidence, '{'table' if pdf else 'column'}' AS method,"
            f" {page} AS page, {row} AS \"row\", {column} AS \"column\", CAST(NULL AS VARCHAR) AS url,"
            f" '{kind}-1' AS source_id FROM part")
    return "SELECT * FROM (" + " UNION ALL ".join(selects) + ") WHERE raw_value IS NOT NULL"


_WEB = (
    f"SELECT {inputs.PRODUCT_ID.replace(inputs.K, 'l_partkey')} AS product_id, 'web' AS source_type, 2 AS source_rank,"
    " l_orderkey * 10 + l_linenumber AS pos, 'rated_current' AS attribute,"
    " CAST(CAST(l_quantity AS INT) AS VARCHAR) AS raw_value, CAST(NULL AS DOUBLE) AS value, 'A' AS unit,"
    " CAST(0.55 AS DOUBLE) AS confidence, 'html_text' AS method, CAST(NULL AS INT) AS page, CAST(NULL AS BIGINT) AS \"row\","
    " CAST(NULL AS VARCHAR) AS \"column\", concat('http://shop/', CAST(l_orderkey AS VARCHAR)) AS url,"
    " 'web-1' AS source_id FROM lineitem")
_GLOBAL = (
    "SELECT 'GLOBAL' AS product_id, 'pdf' AS source_type, 3 AS source_rank, CAST(r_regionkey AS BIGINT) AS pos,"
    f" {inputs.GLOBAL_FACTS['attribute']} AS attribute, {inputs.GLOBAL_FACTS['raw_value']} AS raw_value,"
    f" CAST(NULL AS DOUBLE) AS value, {inputs.GLOBAL_FACTS['unit']} AS unit, CAST(0.80 AS DOUBLE) AS confidence,"
    " 'text' AS method, r_regionkey + 1 AS page, CAST(NULL AS BIGINT) AS \"row\", CAST(NULL AS VARCHAR) AS \"column\","
    " CAST(NULL AS VARCHAR) AS url, 'pdf-1' AS source_id FROM region")

_FIELD_POS = "CASE canonical_field " + " ".join(
    f"WHEN '{f}' THEN {i}" for i, (f, _) in enumerate(dims.CANONICAL_FIELDS)) + " ELSE 99 END"
_FIELD_UNIT = "CASE canonical_field " + " ".join(
    f"WHEN '{f}' THEN {quoted(u)}" for f, u in dims.CANONICAL_FIELDS if u) + " END"
_GRID = ", ".join(f"({i}, '{f}', {quoted(u)})" for i, (f, u) in enumerate(dims.CANONICAL_FIELDS))


def _factor(table: dict[str, float], token: str = "token") -> str:
    return f"CASE {token} " + " ".join(f"WHEN '{k}' THEN {v!r}::DOUBLE" for k, v in table.items()) + " END"


EVIDENCE = {
    "products": (
        f"SELECT {inputs.PRODUCT_ID} AS product_id, CASE WHEN {inputs.K} % 10 = 3 THEN NULL ELSE p_brand END AS manufacturer,"
        f" p_name AS model, {inputs.K} AS manifest_pos,"
        f" CASE WHEN {inputs.K} % 37 = 0 THEN '1.0.0' ELSE '2.0.0' END AS normalization_version FROM part"),
    "ev": f"{_part_facts()} UNION ALL {_WEB} UNION ALL {_GLOBAL}",
    "mapped": (
        f"SELECT *, CASE WHEN canonical_field IS NOT NULL THEN 'canonical' ELSE coalesce({case('lower(attribute)', {'metadata': dims.METADATA_ATTRIBUTES, 'skip': dims.SKIPPED_ATTRIBUTES})}, 'unmapped') END AS kind"
        f" FROM (SELECT *, {case('lower(attribute)', dims.CANONICAL_ATTRIBUTES)} AS canonical_field FROM ev)"),
}
NORMALIZED = {
    **EVIDENCE,
    "parsed": (
        f"SELECT *, coalesce(value, try_cast(nullif(regexp_extract(trim(raw_value), '{NUMBER}', 1), '') AS DOUBLE)) AS num,"
        f" CASE WHEN value IS NULL THEN coalesce(unit, nullif(regexp_extract(trim(raw_value), '{NUMBER}', 2), ''))"
        " ELSE unit END AS u FROM mapped WHERE kind = 'canonical'"),
    "tokens": f"SELECT *, {case('lower(trim(u))', dims.UNIT_SPELLINGS)} AS token FROM parsed",
    "results": (
        "SELECT *, canonical_field IN ('ip_rating', 'frame_size') AS is_text, CASE"
        f" WHEN canonical_field = 'rated_power' THEN round(num * CASE WHEN coalesce(u, '') = '' THEN 1 ELSE {_factor(dims.POWER_FACTORS)} END, 6)"
        f" WHEN canonical_field = 'weight' THEN round(num * CASE WHEN coalesce(u, '') = '' THEN 1 ELSE {_factor(dims.MASS_FACTORS)} END, 6)"
        " WHEN canonical_field = 'efficiency' AND (u IS NULL OR token IS NOT NULL) THEN round(CASE WHEN token = '%' OR num > 1.5 THEN num ELSE num * 100 END, 6)"
        " WHEN canonical_field = 'power_factor' AND (u IS NULL OR token IS NOT NULL) THEN round(CASE WHEN token = '%' AND num > 1.5 THEN num / 100 ELSE num END, 6)"
        " WHEN canonical_field = 'poles' THEN round(num)"
        " WHEN canonical_field = 'rated_voltage' AND (u IS NULL OR token = 'V') THEN num"
        " WHEN canonical_field = 'rated_current' AND (u IS NULL OR token = 'A') THEN num"
        " WHEN canonical_field = 'frequency' AND (u IS NULL OR token = 'Hz') THEN num"
        " WHEN canonical_field = 'rated_speed' AND (u IS NULL OR token = 'rpm') THEN num END AS v FROM tokens"),
    "norm": (
        "SELECT *, CASE WHEN is_text THEN NULL ELSE v END AS value_num, CASE"
        " WHEN canonical_field = 'ip_rating' THEN coalesce(concat('IP', nullif(regexp_extract(raw_value, '(?i)IP\\s*(\\d{2,3})', 1), '')),"
        " trim(raw_value)) WHEN canonical_field = 'frame_size' THEN nullif(trim(raw_value), '') END AS value_str_raw, CASE"
        " WHEN is_text THEN CASE WHEN canonical_field = 'ip_rating' OR trim(raw_value) <> '' THEN 'passthrough' ELSE 'parse_error' END"
        " WHEN num IS NULL THEN 'parse_error' WHEN v IS NULL THEN 'unknown_unit'"
        f" WHEN u IS NOT DISTINCT FROM {_FIELD_UNIT} THEN 'passthrough' ELSE 'normalized' END AS outcome FROM results"),
    # DuckDB's concat skips nulls, so a bare code or plain text is told apart here.
    "normalized": (
        "SELECT * REPLACE (CASE WHEN value_str_raw = 'IP' AND canonical_field = 'ip_rating' THEN CASE WHEN"
        " regexp_matches(trim(raw_value), '^\\d{2,3}$') THEN concat('IP', trim(raw_value)) ELSE trim(raw_value) END"
        " ELSE value_str_raw END AS value_str_raw) FROM norm"),
    "facts": (
        f"SELECT *, value_str_raw AS value_str, CASE WHEN value_num IS NOT NULL THEN {_FIELD_UNIT} END AS canonical_unit FROM normalized"),
    "own": "SELECT * FROM facts WHERE product_id <> 'GLOBAL'",
    "collected": (
        "SELECT * FROM own UNION ALL SELECT g.* REPLACE (p.product_id AS product_id) FROM products p, facts g WHERE g.product_id = 'GLOBAL'"),
}
FIELDS = {
    **NORMALIZED,
    "ranked": (
        "SELECT *, row_number() OVER (PARTITION BY product_id, canonical_field ORDER BY source_rank, pos) AS rn"
        " FROM collected WHERE value_num IS NOT NULL OR value_str IS NOT NULL"),
    "rep": "SELECT * FROM ranked WHERE rn = 1",
    "pairs": (
        "SELECT b.product_id, b.canonical_field, a.value_num AS value_a, a.value_str AS text_a, b.value_num AS value_b,"
        " b.value_str AS text_b, a.source_type AS type_a, b.source_type AS type_b, a.raw_value AS raw_a, b.raw_value AS raw_b,"
        " a.attribute AS attribute_a, b.attribute AS attribute_b, a.canonical_unit AS unit_a, b.canonical_unit AS unit_b,"
        " b.source_rank, b.pos FROM ranked b JOIN rep a ON a.product_id = b.product_id AND a.canonical_field = b.canonical_field"
        " WHERE b.rn > 1 AND (abs(a.value_num - b.value_num) > 1e-6 OR a.value_str <> b.value_str)"),
    "tally": (
        "SELECT product_id, canonical_field, count(*) AS n_refs, count(*) FILTER (value_num IS NOT NULL OR value_str IS NOT NULL) AS n_ok,"
        " avg(confidence) FILTER (value_num IS NOT NULL OR value_str IS NOT NULL) AS conf,"
        " string_agg(DISTINCT source_type, ',' ORDER BY source_type) AS source_types,"
        " arg_min(value, (abs(value), source_rank, pos)) FILTER (canonical_field = 'rated_power' AND value IS NOT NULL AND unit IN ('kW', 'kw')) AS kw_raw"
        " FROM collected GROUP BY ALL"),
    "disputed": "SELECT DISTINCT product_id, canonical_field FROM pairs",
    "fields": (
        "SELECT p.product_id, g.field_pos, g.canonical_field, g.canonical_unit, CASE WHEN coalesce(t.n_ok, 0) = 0 THEN 'missing'"
        " WHEN d.product_id IS NOT NULL THEN 'conflict' ELSE r.outcome END AS outcome,"
        " CASE WHEN d.product_id IS NULL THEN r.value_num END AS value_num, CASE WHEN d.product_id IS NULL THEN r.value_str END AS value_str,"
        " floor(t.conf * 10000 + 0.5 + 1e-6) / 10000 AS confidence, d.product_id IS NOT NULL AS has_conflict, coalesce(t.n_refs, 0) AS n_refs,"
        " coalesce(t.n_ok, 0) AS n_ok, coalesce(t.source_types, '') AS source_types, t.kw_raw"
        f" FROM products p CROSS JOIN (VALUES {_GRID}) g(field_pos, canonical_field, canonical_unit)"
        " LEFT JOIN tally t ON t.product_id = p.product_id AND t.canonical_field = g.canonical_field"
        " LEFT JOIN rep r ON r.product_id = p.product_id AND r.canonical_field = g.canonical_field"
        " LEFT JOIN disputed d ON d.product_id = p.product_id AND d.canonical_field = g.canonical_field"),
}


def _bad(value: str, low, high, strict) -> str:
    parts = []
    if low is not None:
        parts.append(f"{value} {'<=' if strict else '<'} {low}")
    if high is not None:
        parts.append(f"{value} > {high}")
    return "(" + " OR ".join(parts) + ")"


def _finding(no: int, rule: str, category: str, status: str, severity: str, field: str, num: str, unit: str, source: str) -> str:
    pos = _FIELD_POS.replace("CASE canonical_field", f"CASE {field}")
    return (f"SELECT product_id, {no} AS rule_no, {pos} AS field_pos, '{rule}' AS rule_id, '{category}' AS category, {status} AS status,"
            f" {severity} AS severity, {field} AS field, CAST({num} AS DOUBLE) AS actual_num, {unit} AS actual_unit FROM {source}")


def _range_selects() -> list[str]:
    out = []
    for i, (rule, field, low, high, strict, severity) in enumerate(dims.RANGE_RULES):
        no = 5 + i
        bad = _bad("value_num", low, high, strict)
        bad_v = _bad("v", low, high, strict)
        single = f"fields WHERE canonical_field = '{field}' AND NOT has_conflict"
        out.append(_finding(
            no, rule, "RANGE", f"CASE WHEN value_num IS NULL THEN 'NOT_CHECKED' WHEN {bad} THEN 'FAIL' ELSE 'PASS' END",
            f"CASE WHEN value_num IS NULL THEN 'LOW' WHEN {bad} THEN '{severity}' ELSE 'INFO' END", f"'{field}'", "value_num",
            "CASE WHEN value_num IS NOT NULL THEN canonical_unit END", single))
        out.append(_finding(no, rule, "RANGE", "'FAIL'", f"'{severity}'", f"'{field}'", "v", "u",
                            f"tested WHERE canonical_field = '{field}' AND {bad_v}"))
        out.append(_finding(
            no, rule, "RANGE", "'PASS'", "'INFO'", f"'{field}'", "NULL", "NULL",
            f"fields f WHERE canonical_field = '{field}' AND has_conflict AND NOT EXISTS (SELECT 1 FROM tested t WHERE"
            f" t.product_id = f.product_id AND t.canonical_field = '{field}' AND {bad_v})"))
    return out


_REQ, _IMP = in_list(dims.REQUIRED_FIELDS), in_list(dims.IMPORTANT_FIELDS)
_POLES = "CASE " + " ".join(f"WHEN contains(product_id, '{m}') THEN {n}" for m, n in dims.POLE_MARKS) + " ELSE poles END"
_TORQUE = "(power_kw * 60000 / (2 * pi() * speed_rpm))"
_SYNC = f"(120 * coalesce(frequency, 50) / ({_POLES}))"
RULES = {
    **FIELDS,
    "tested": (
        "SELECT product_id, canonical_field, value_a AS v, unit_a AS u FROM pairs WHERE value_a IS NOT NULL UNION ALL"
        " SELECT product_id, canonical_field, value_b, unit_b FROM pairs WHERE value_b IS NOT NULL UNION ALL"
        " SELECT c.product_id, c.canonical_field, c.value, c.unit FROM collected c JOIN disputed d ON d.product_id = c.product_id"
        " AND d.canonical_field = c.canonical_field WHERE c.value IS NOT NULL"),
    "wide": (
        "SELECT f.product_id, coalesce(max(value_num) FILTER (canonical_field = 'rated_power'), max(kw_raw) FILTER (canonical_field = 'rated_power')) AS power_kw,"
        " max(value_num) FILTER (canonical_field = 'rated_speed') AS speed_rpm, CAST(max(value_num) FILTER (canonical_field = 'poles') AS INT) AS poles,"
        " max(value_num) FILTER (canonical_field = 'frequency') AS frequency, any_value(t.torque_nm) AS torque_nm FROM fields f LEFT JOIN"
        " (SELECT product_id, arg_min(value, (source_rank, pos)) AS torque_nm FROM mapped WHERE attribute = 'full_load_torque_nm'"
        " AND value IS NOT NULL GROUP BY 1) t ON t.product_id = f.product_id GROUP BY f.product_id"),
    "findings": " UNION ALL ".join([
        _finding(1, "SCHEMA_CANONICAL_UNITS", "SCHEMA", "'PASS'", "'INFO'", "canonical_field", "NULL", "NULL",
                 "fields WHERE outcome <> 'missing'"),
        _finding(2, "SCHEMA_NORMALIZATION_VERSION", "SCHEMA", "CASE WHEN normalization_version = '2.0.0' THEN 'PASS' ELSE 'WARNING' END",
                 "CASE WHEN normalization_version = '2.0.0' THEN 'INFO' ELSE 'LOW' END", "'(product)'", "NULL", "NULL", "products"),
        _finding(3, "REQUIRED_FIELD_PRESENCE", "REQUIRED_FIELD", "CASE WHEN outcome = 'missing' THEN 'FAIL' ELSE 'PASS' END",
                 "CASE WHEN outcome = 'missing' THEN 'HIGH' ELSE 'INFO' END", "canonical_field", "NULL", "NULL",
                 f"fields WHERE canonical_field IN {_REQ}"),
        _finding(4, "IMPORTANT_FIELD_PRESENCE", "MISSING_DATA", "CASE WHEN outcome = 'missing' THEN 'WARNING' ELSE 'PASS' END",
                 "CASE WHEN outcome = 'missing' THEN 'MEDIUM' ELSE 'INFO' END", "canonical_field", "NULL", "NULL",
                 f"fields WHERE canonical_field IN {_IMP}"),
        *_range_selects(),
        _finding(12, "CONSISTENCY_CROSS_SOURCE", "CONFLICT", "'CONFLICT'", "'HIGH'", "canonical_field", "NULL", "NULL", "pairs"),
        _finding(13, "ENGINEERING_TORQUE_POWER_RPM", "ENGINEERING",
                 f"CASE WHEN power_kw IS NULL OR speed_rpm IS NULL OR torque_nm IS NULL THEN 'NOT_CHECKED' WHEN speed_rpm <= 0 THEN 'FAIL'"
                 f" WHEN abs(torque_nm - {_TORQUE}) <= 0.15 * {_TORQUE} THEN 'PASS' ELSE 'WARNING' END",
                 f"CASE WHEN power_kw IS NULL OR speed_rpm IS NULL OR torque_nm IS NULL THEN 'LOW' WHEN speed_rpm <= 0 THEN 'HIGH'"
                 f" WHEN abs(torque_nm - {_TORQUE}) <= 0.15 * {_TORQUE} THEN 'INFO' ELSE 'MEDIUM' END",
                 "CASE WHEN power_kw IS NULL THEN 'rated_power' WHEN speed_rpm IS NULL THEN 'rated_speed' WHEN torque_nm IS NULL THEN"
                 " 'full_load_torque_nm' WHEN speed_rpm <= 0 THEN 'rated_speed' ELSE 'full_load_torque_nm' END",
                 "CASE WHEN power_kw IS NOT NULL AND speed_rpm IS NOT NULL AND torque_nm IS NOT NULL THEN CASE WHEN speed_rpm <= 0 THEN speed_rpm ELSE torque_nm END END",
                 "CASE WHEN power_kw IS NOT NULL AND speed_rpm IS NOT NULL AND torque_nm IS NOT NULL THEN CASE WHEN speed_rpm <= 0 THEN 'rpm' ELSE 'Nm' END END",
                 "wide"),
        _finding(14, "ENGINEERING_EFFICIENCY_IE3", "ENGINEERING",
                 "CASE WHEN value_num IS NULL THEN 'NOT_CHECKED' WHEN value_num < 80 THEN 'WARNING' ELSE 'PASS' END",
                 "CASE WHEN value_num IS NULL THEN 'LOW' WHEN value_num < 80 THEN 'MEDIUM' ELSE 'INFO' END", "'efficiency'", "value_num",
                 "CASE WHEN value_num IS NOT NULL THEN '%' END", "fields WHERE canonical_field = 'efficiency' AND NOT has_conflict"),
        _finding(14, "ENGINEERING_EFFICIENCY_IE3", "ENGINEERING", "CASE WHEN v < 80 THEN 'WARNING' ELSE 'PASS' END",
                 "CASE WHEN v < 80 THEN 'MEDIUM' ELSE 'INFO' END", "'efficiency'", "v", "'%'",
                 "(SELECT product_id, unnest([value_a, value_b]) AS v FROM pairs WHERE canonical_field = 'efficiency')"),
        _finding(15, "ENGINEERING_SYNCHRONOUS_SPEED", "ENGINEERING",
                 f"CASE WHEN speed_rpm IS NULL OR ({_POLES}) IS NULL THEN 'NOT_CHECKED' WHEN speed_rpm <= 0 OR speed_rpm >= {_SYNC} THEN 'FAIL'"
                 f" WHEN ({_SYNC} - speed_rpm) / {_SYNC} < 0.001 THEN 'WARNING' ELSE 'PASS' END",
                 f"CASE WHEN speed_rpm IS NULL OR ({_POLES}) IS NULL THEN 'LOW' WHEN speed_rpm <= 0 OR speed_rpm >= {_SYNC} THEN 'HIGH'"
                 f" WHEN ({_SYNC} - speed_rpm) / {_SYNC} < 0.001 THEN 'LOW' ELSE 'INFO' END",
                 f"CASE WHEN speed_rpm IS NOT NULL AND ({_POLES}) IS NULL THEN 'poles' ELSE 'rated_speed' END",
                 f"CASE WHEN ({_POLES}) IS NOT NULL THEN speed_rpm END", f"CASE WHEN ({_POLES}) IS NOT NULL AND speed_rpm IS NOT NULL THEN 'rpm' END",
                 "wide"),
        _finding(16, "MISSING_DATA_INVENTORY", "MISSING_DATA", "'NOT_CHECKED'", "'LOW'", "canonical_field", "NULL", "NULL",
                 f"fields WHERE outcome = 'missing' AND canonical_field NOT IN {_REQ} AND canonical_field NOT IN {_IMP}"),
        _finding(17, "CONFLICT_RATED_CURRENT_PDF_VS_CSV", "CONFLICT", "'CONFLICT'", "'HIGH'", "canonical_field", "NULL", "NULL",
                 "pairs WHERE canonical_field = 'rated_current' AND ((type_a = 'pdf' AND type_b = 'csv') OR (type_a = 'csv' AND type_b = 'pdf'))"),
    ]),
    "summary": (
        "SELECT product_id, count(*) AS total_findings, " + ", ".join(
            f"count(*) FILTER (status = '{s}') AS n_{s.lower()}" for s in dims.FINDING_STATUSES)
        + ", CASE WHEN bool_or(status = 'FAIL') THEN 'FAIL' WHEN bool_or(status = 'CONFLICT') THEN 'CONFLICT' WHEN"
        " bool_or(status = 'WARNING') THEN 'WARNING' ELSE 'PASS' END AS overall_status FROM findings GROUP BY 1"),
}
_LADDER = {
    "trust_status": ["'CONFLICTED'", "'UNSUPPORTED'", "'REVIEW_REQUIRED'", "'TRUSTED'", "'UNVERIFIED'", "'MISSING'"],
    "publishability": ["'REVIEW_REQUIRED'", "'NOT_PUBLISHABLE'", "'PUBLISHABLE_WITH_WARNING'", "'PUBLISHABLE'",
                       "'PUBLISHABLE_WITH_WARNING'", "'NOT_PUBLISHABLE'"],
    "validation_status": ["'CONFLICT'", "'FAIL'", "'WARNING'", "'PASS'", "'NOT_CHECKED'", "'NOT_CHECKED'"],
    "confidence_score": ["0.3::DOUBLE", "0.1::DOUBLE", "0.75::DOUBLE", "1::DOUBLE", "0.7::DOUBLE", "0::DOUBLE"],
}


def _trust(inferred: bool) -> dict[str, str]:
    conditions = ["conflicted", "coalesce(has_fail, false)", "coalesce(has_warn, false)",
                  "outcome IN ('normalized', 'passthrough')", "inferred_value IS NOT NULL" if inferred else "false"]
    columns = ", ".join(
        "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in zip(conditions, values)) + f" ELSE {values[5]} END AS {name}"
        for name, values in _LADDER.items())
    guess = "LEFT JOIN inferred i ON i.product_id = f.product_id AND i.field = f.canonical_field" if inferred else ""
    value = "i.inferred_value" if inferred else "NULL"
    return {
        "by_field": (
            "SELECT product_id, field, bool_or(status = 'CONFLICT') AS has_found, bool_or(status = 'FAIL') AS has_fail,"
            " bool_or(status = 'WARNING') AS has_warn, string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) AS rule_ids,"
            " arg_min(rule_id, (rule_no, field_pos)) FILTER (status = 'FAIL') AS fail_rule,"
            " arg_min(rule_id, (rule_no, field_pos)) FILTER (status = 'WARNING') AS warn_rule FROM findings GROUP BY ALL"),
        "attributes": (
            f"SELECT product_id, field_pos, field, value_num, value_str, conflicted AS is_conflicted, coalesce(rule_ids, '') AS rule_ids,"
            f" fail_rule, warn_rule, n_refs, {columns} FROM (SELECT f.product_id, f.field_pos, f.canonical_field AS field, f.value_num, f.value_str,"
            f" f.outcome, f.n_refs, f.has_conflict OR coalesce(b.has_found, false) AS conflicted, b.has_fail, b.has_warn, b.rule_ids,"
            f" b.fail_rule, b.warn_rule, {value} AS inferred_value FROM fields f LEFT JOIN by_field b ON b.product_id = f.product_id"
            f" AND b.field = f.canonical_field {guess})"),
    }


_REVIEWS = {
    "review_items": (
        "SELECT product_id, concat('REV-', product_id, '-', field, CASE trust_status WHEN 'CONFLICTED' THEN '-conflict' WHEN 'UNSUPPORTED'"
        " THEN '-fail' ELSE '-warning' END) AS review_id, 0 AS part, field_pos AS a, 0 AS b, 'attribute' AS target_type, field AS target_name,"
        " CASE WHEN trust_status = 'REVIEW_REQUIRED' THEN 'MEDIUM' ELSE 'HIGH' END AS severity, CASE trust_status WHEN 'CONFLICTED' THEN 'CONFLICT'"
        " WHEN 'UNSUPPORTED' THEN 'FAIL' ELSE 'WARNING' END AS issue_type, CASE trust_status WHEN 'CONFLICTED' THEN 'CONFLICT_CROSS_SOURCE' WHEN"
        " 'UNSUPPORTED' THEN fail_rule ELSE warn_rule END AS validation_rule_id FROM attributes WHERE validation_status IN ('CONFLICT', 'FAIL', 'WARNING')"
        " UNION ALL SELECT product_id, concat('REV-', product_id, '-', rule_id), 2, rule_no, field_pos, 'validation', field,"
        " CASE WHEN status = 'FAIL' THEN 'HIGH' ELSE 'MEDIUM' END, status, rule_id FROM findings WHERE status IN ('FAIL', 'WARNING')"),
    "reviews": (
        "SELECT product_id, review_id, n_collapsed, part, target_type, target_name, severity, issue_type, validation_rule_id FROM (SELECT *,"
        " row_number() OVER (PARTITION BY review_id ORDER BY part, a, b) AS rn, count(*) OVER (PARTITION BY review_id) AS n_collapsed"
        " FROM review_items) WHERE rn = 1"),
    "scores": (
        "SELECT product_id, n_conflicted, completeness, validity, diversity, penalty AS conflict_penalty,"
        " greatest(0::DOUBLE, least(1::DOUBLE, 0.35::DOUBLE * completeness + 0.35::DOUBLE * validity + 0.3::DOUBLE * diversity - penalty)) AS trust_score FROM ("
        "SELECT a.product_id, a.n_conflicted, a.n_present / a.n AS completeness, CASE WHEN s.total_findings - s.n_not_checked > 0 THEN"
        " least(1, (s.n_pass + 0.75::DOUBLE * s.n_warning) / (s.total_findings - s.n_not_checked)) ELSE 1 END AS validity,"
        " CASE WHEN d.k >= 2 THEN 1::DOUBLE WHEN d.k = 1 THEN 0.75::DOUBLE ELSE 0.3::DOUBLE END AS diversity, least(0.5::DOUBLE, 0.15::DOUBLE * a.n_conflicted) AS penalty FROM"
        " (SELECT product_id, count(*) AS n, count(*) FILTER (trust_status <> 'MISSING') AS n_present, count(*) FILTER (is_conflicted) AS"
        " n_conflicted FROM attributes GROUP BY 1) a LEFT JOIN summary s ON s.product_id = a.product_id LEFT JOIN (SELECT product_id,"
        " count(DISTINCT source_type) AS k FROM collected GROUP BY 1) d ON d.product_id = a.product_id)"),
    "overall": (
        "SELECT s.product_id, s.trust_score, coalesce(r.n, 0) AS review_items_count, CASE WHEN s.n_conflicted > 0 THEN 'CONFLICTED' WHEN"
        " coalesce(r.has_fail, false) THEN 'UNSUPPORTED' WHEN coalesce(r.has_warn, false) THEN 'REVIEW_REQUIRED' WHEN s.trust_score >= 0.8 THEN"
        " 'TRUSTED' ELSE 'UNVERIFIED' END AS overall_trust_status, CASE WHEN s.n_conflicted > 0 THEN 'REVIEW_REQUIRED' WHEN"
        " coalesce(r.has_fail, false) THEN 'NOT_PUBLISHABLE' WHEN coalesce(r.has_warn, false) THEN 'PUBLISHABLE_WITH_WARNING' WHEN s.trust_score >= 0.8"
        " THEN 'PUBLISHABLE' ELSE 'PUBLISHABLE_WITH_WARNING' END AS overall_publishability FROM scores s LEFT JOIN (SELECT product_id,"
        " count(*) AS n, bool_or(severity IN ('CRITICAL', 'HIGH') AND issue_type = 'FAIL') AS has_fail, bool_or(issue_type = 'WARNING') AS has_warn"
        " FROM reviews GROUP BY 1) r ON r.product_id = s.product_id"),
    "report": (
        "SELECT o.*, p.manufacturer, p.model, coalesce(c.n, 0) AS conflicts_count, a.n_pub AS publishable_attributes_count, a.n_res AS"
        " restricted_attributes_count FROM overall o JOIN products p ON p.product_id = o.product_id LEFT JOIN (SELECT product_id, count(*) AS n"
        " FROM pairs GROUP BY 1) c ON c.product_id = o.product_id JOIN (SELECT product_id, CAST(count(*) FILTER (publishability LIKE 'PUBLISHABLE%') AS INT)"
        " AS n_pub, CAST(count(*) FILTER (publishability NOT LIKE 'PUBLISHABLE%') AS INT) AS n_res FROM attributes GROUP BY 1) a ON a.product_id = o.product_id"),
}
TRUST = {**RULES, **_trust(False), **_REVIEWS}


def query(select: str, ctes: dict[str, str] | None = None) -> str:
    if not ctes:
        return select
    # A stage read several times is computed once.
    body = ",\n".join(f"{name} AS MATERIALIZED ({sql})" for name, sql in ctes.items())
    return f"WITH {body}\n{select}"
