"""Catalog inputs and results as plain SQL, for checking."""

from __future__ import annotations

from specledger import dims
from specledger.plans import inputs
from specledger.plans.oracle import case, clean, fraction, in_list, quoted


def _select(columns: dict[str, str], source: str = "part") -> str:
    return "SELECT " + ", ".join(f'{e} AS "{n}"' for n, e in columns.items()) + f" FROM {source}"


_BRANDS = ("e1_brand", "unilog_brand", "dib_brand", "part_manuf")
INPUT = {
    "raw": _select(inputs.CATALOG),
    "rows": "SELECT row_id, mfg_part_num, part_desc, " + ", ".join(f"{clean(c)} AS {c}" for c in _BRANDS) + " FROM raw",
    "dict": _select(inputs.DICTIONARY, f"(SELECT DISTINCT p_brand FROM part WHERE {inputs.BRAND_NO} % 5 <> 0)"),
    "gold": _select(inputs.GOLD),
    "gold_wide": _select({"row_id": inputs.GOLD["row_id"], **inputs.GOLD_WIDE}),
}
GOLD_ATTRS = {
    **INPUT,
    "gold_attrs": "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT row_id, {i} AS ordinal, trim(coalesce(\"ATTRIBUTE_LABEL {i}\", '')) AS label,"
        f" trim(coalesce(\"ATTRIBUTE_VALUE {i}\", '')) AS value, nullif(trim(coalesce(\"ATTRIBUTE_UOM {i}\", '')), '') AS uom FROM gold_wide"
        for i in range(1, 5)) + ") WHERE label <> '' OR value <> ''",
}
_SUPPLIER = r"nullif(trim(regexp_replace(part_manuf, '\s*\([^)]*\)\s*$', '')), '')"
_CANDIDATES = " UNION ALL ".join(
    f"SELECT row_id, {i} AS i, '{name}' AS source, {clean(c)} AS raw_val FROM rows" for i, (name, c) in enumerate(dims.BRAND_SOURCES))
BRANDS = {
    **INPUT,
    "signals": (
        "SELECT row_id, string_agg(DISTINCT b, ', ' ORDER BY b) AS raw_brands, count(DISTINCT b) > 1 AS brand_conflict FROM (SELECT row_id,"
        f" unnest([e1_brand, unilog_brand, dib_brand, CASE WHEN regexp_matches(lower({_SUPPLIER}), '{'|'.join(dims.DISTRIBUTOR_WORDS)}')"
        f" THEN NULL ELSE {_SUPPLIER} END]) AS b FROM rows) GROUP BY row_id"),
    "candidates": f"SELECT * FROM ({_CANDIDATES}) WHERE raw_val IS NOT NULL",
    "hits": (
        "SELECT c.row_id, c.i, c.source, c.raw_val, arg_min(d.signal, d.entry_pos) AS signal, arg_min(d.canonical_manufacturer, d.entry_pos) AS manufacturer,"
        " arg_min(d.canonical_brand, d.entry_pos) AS brand, arg_min(d.trade_name, d.entry_pos) AS trade_name FROM candidates c JOIN dict d ON"
        " lower(d.signal) = lower(c.raw_val) OR (length(d.signal) >= 3 AND contains(lower(c.raw_val), lower(d.signal))) GROUP BY ALL"),
    "resolved": (
        "SELECT r.row_id, CASE WHEN h.n_brands > 1 THEN h.any_maker ELSE h.manufacturer END AS manufacturer, CASE WHEN h.n_brands = 1 THEN h.brand END AS brand,"
        " CASE WHEN h.n_brands = 1 THEN h.trade_name END AS trade_name, CASE WHEN h.row_id IS NULL THEN 'Unknown' WHEN h.n_brands > 1 THEN 'Conflicted' WHEN"
        " h.exact THEN 'Verified' ELSE 'Inferred' END AS status, CASE WHEN h.row_id IS NULL THEN 0::DOUBLE WHEN h.n_brands > 1 THEN 0.4::DOUBLE WHEN h.exact THEN 1::DOUBLE"
        " ELSE 0.85::DOUBLE END AS confidence, coalesce(h.n_brands > 1, false) AS is_conflicted, coalesce(CASE WHEN h.n_brands > 1 THEN h.long_sources ELSE h.sources END, '')"
        " AS sources FROM rows r LEFT JOIN (SELECT row_id, count(DISTINCT brand) AS n_brands, min(manufacturer) AS any_maker, arg_min(manufacturer, i) AS manufacturer,"
        f" arg_min(brand, i) AS brand, arg_min(trade_name, i) AS trade_name, bool_or(source IN {in_list(dims.VERIFYING_SOURCES)}) AS exact,"
        " string_agg(concat(source, '=''', raw_val, ''''), '; ' ORDER BY i) AS sources, string_agg(concat(source, '=''', raw_val, '''->', brand), '; ' ORDER BY i)"
        " AS long_sources FROM hits GROUP BY 1) h ON h.row_id = r.row_id"),
}


def _fields(strict: bool) -> str:
    disputed = "(s.brand_conflict OR v.is_conflicted)"
    conflict = disputed if strict else f"({disputed} AND coalesce(v.manufacturer, '') = '')"
    resolved = f"(NOT {conflict} AND coalesce(v.manufacturer, '') <> '' AND coalesce(v.brand, '') <> '')"
    return (
        f"SELECT r.row_id, CASE WHEN {resolved} THEN v.manufacturer END AS manufacturer, CASE WHEN {resolved} THEN v.brand END AS brand,"
        f" CASE WHEN {resolved} THEN nullif(v.trade_name, '') END AS trade_name, CASE WHEN {conflict} THEN 'Conflicted' WHEN {resolved} THEN v.status ELSE 'Unknown' END"
        f" AS brand_status, CASE WHEN {conflict} THEN 0.4::DOUBLE WHEN {resolved} THEN v.confidence ELSE 0::DOUBLE END AS brand_confidence FROM rows r JOIN signals s ON"
        " s.row_id = r.row_id JOIN resolved v ON v.row_id = r.row_id")


_KEYWORDS = "CASE " + " ".join(
    "WHEN " + " OR ".join(f"contains(lower(part_desc), {quoted(w)})" for w in words) + f" THEN {quoted(name)}"
    for words, name in dims.PRODUCT_KEYWORDS) + " END"


def _attributes(source: str, text: str, key: str) -> str:
    """Pattern families as lists, one row per match, with its place in the result."""
    parts = []
    for f, (label, pattern, unit) in enumerate(dims.ATTRIBUTE_PATTERNS):
        p = "(?i)" + pattern.replace("'", "''").replace("\\\"", '"')
        if unit:
            parts.append(f"SELECT {key}, {f} AS family, n, '{label}' AS label, v AS raw_value, '{unit}' AS raw_uom FROM (SELECT {key},"
                         f" unnest(regexp_extract_all({text}, '{p}', 1)) AS v, generate_subscripts(regexp_extract_all({text}, '{p}', 1), 1) AS n FROM {source})")
        else:
            parts.append(f"SELECT {key}, {f} AS family, n, '{label}' AS label, trim(v) AS raw_value, trim(u) AS raw_uom FROM (SELECT {key},"
                         f" unnest(regexp_extract_all({text}, '{p}', 1)) AS v, unnest(regexp_extract_all({text}, '{p}', 2)) AS u,"
                         f" generate_subscripts(regexp_extract_all({text}, '{p}', 1), 1) AS n FROM {source})"
                         " WHERE NOT regexp_matches(trim(v), '^\\d+$') OR CAST(trim(v) AS BIGINT) < 100")
    return " UNION ALL ".join(parts)


_UOM_KEYS: dict[str, list[str]] = {}
for _alias, _canonical in dims.UOM_ALIASES.items():
    _UOM_KEYS.setdefault(_canonical, []).append(_alias)


def triple(source: str, keep: str) -> str:
    """Normalise ``label, raw_value, raw_uom`` rows."""
    canonical = case("lower(trim(raw_uom))", _UOM_KEYS)
    return (
        f"SELECT {keep}, label, value_num, CASE WHEN value_num IS NULL THEN trim(raw_value) END AS value_str, CASE WHEN coalesce(raw_uom, '') <> '' THEN"
        " coalesce(canonical, trim(raw_uom)) END AS uom, raw_value, raw_uom, CASE WHEN trim(raw_uom) = canonical AND value_num IS NOT NULL THEN 'Verified'"
        " WHEN (canonical IS NOT NULL AND trim(raw_uom) <> canonical) OR value_num IS NOT NULL THEN 'Inferred' ELSE 'Unknown' END AS status,"
        " CASE WHEN trim(raw_uom) = canonical AND value_num IS NOT NULL THEN 1::DOUBLE WHEN (canonical IS NOT NULL AND trim(raw_uom) <> canonical) OR value_num IS NOT NULL"
        f" THEN 0.9::DOUBLE ELSE 0.5::DOUBLE END AS confidence FROM (SELECT *, {fraction('raw_value')} AS value_num, {canonical} AS canonical FROM {source})")


def enriched(strict: bool = False, use_gold: bool = True) -> dict[str, str]:
    """All stages up to the enriched rows."""
    gold_join = (
        "LEFT JOIN (SELECT lower(trim(mfg_part_num)) AS k, arg_max(expected_product_name, row_id) AS gold_name, arg_max(expected_classpath, row_id) AS gold_classpath,"
        " arg_max(expected_long_desc, row_id) AS gold_long, max(row_id) AS gold_row FROM gold WHERE trim(mfg_part_num) <> '' GROUP BY 1) g ON g.k = lower(trim(r.mfg_part_num))"
        if use_gold else "CROSS JOIN (SELECT NULL AS gold_name, NULL AS gold_classpath, NULL AS gold_long, -1 AS gold_row) g")
    return {
        **GOLD_ATTRS, **BRANDS,
        "brand_fields": _fields(strict),
        "found": _attributes("rows", "part_desc", "row_id"),
        "base": f"SELECT r.*, g.gold_name, g.gold_classpath, g.gold_long, g.gold_row FROM rows r {gold_join}",
        "added": (
            "SELECT b.row_id, 9 AS family, CAST(a.ordinal AS BIGINT) AS n, a.label, a.value AS raw_value, a.uom AS raw_uom FROM base b JOIN (SELECT *, row_number() OVER"
            " (PARTITION BY row_id, lower(label) ORDER BY ordinal) AS k FROM gold_attrs) a ON a.row_id = b.gold_row AND a.k = 1 WHERE NOT EXISTS (SELECT 1 FROM found f"
            " WHERE f.row_id = b.row_id AND lower(f.label) = lower(a.label))"),
        "all_attrs": "SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY family, n) AS ordinal FROM (SELECT * FROM found UNION ALL SELECT * FROM added)",
        "attrs": triple("all_attrs", "row_id, ordinal"),
        "named": (
            f"SELECT *, coalesce(nullif(gold_name, ''), {_KEYWORDS}) AS name, CASE WHEN nullif(gold_name, '') IS NOT NULL THEN 'Verified' WHEN {_KEYWORDS} IS NOT NULL"
            " THEN 'Inferred' ELSE 'Unknown' END AS name_status FROM base"),
        "enriched": (
            "SELECT n.row_id, n.mfg_part_num, n.part_desc, n.e1_brand, n.unilog_brand, n.dib_brand, n.part_manuf, f.manufacturer, f.brand, f.trade_name, f.brand_status,"
            " f.brand_confidence, trim(n.mfg_part_num) AS mpn, n.name, n.name_status, nullif(n.gold_classpath, '') AS classpath, nullif(n.gold_long, '') AS long_desc,"
            " concat_ws(' ', f.brand, nullif(trim(n.mfg_part_num), ''), n.name) AS short_desc, CASE WHEN f.brand_status = 'Verified' AND n.name_status = 'Verified' THEN"
            " 'Verified' ELSE 'Inferred' END AS short_status, CASE WHEN f.brand_status = 'Conflicted' THEN 'Conflicted' WHEN f.brand_status = 'Verified' THEN 'Verified'"
            " WHEN f.brand_status = 'Inferred' OR coalesce(a.any_inferred, false) THEN 'Inferred' ELSE 'Unknown' END AS overall_status, coalesce(a.n, 0) AS n_attributes"
            " FROM named n JOIN brand_fields f ON f.row_id = n.row_id LEFT JOIN (SELECT row_id, count(*) AS n, bool_or(status = 'Inferred') AS any_inferred FROM attrs"
            " GROUP BY 1) a ON a.row_id = n.row_id"),
    }
