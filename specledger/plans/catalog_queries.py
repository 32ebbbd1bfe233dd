"""Queries of the catalog track: matching, enrichment, evaluation and export."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from specledger import dims
from specledger.functions import units
from specledger.operators import audit, catalog, evaluate, explore
from specledger.plans import catalog_oracle as co
from specledger.plans import inputs
from specledger.plans.registry import register
from specledger.session import stage_dir
from specledger.sinks import delivery
from specledger.sources.stored import gold_attributes

I, GA, B = co.INPUT, co.GOLD_ATTRS, co.BRANDS
EN = co.enriched()
STRICT = co.enriched(strict=True)
FREE = co.enriched(use_gold=False)


def enriched(spark, sf, gold=True, **options):
    """The enriched catalog of an input folder. Within one session it is stored once and shared between queries."""
    def build():
        return catalog.enrich_catalog(
            inputs.catalog_rows(spark, sf), inputs.dictionary(spark, sf), inputs.gold(spark, sf) if gold else None,
            gold_attributes(inputs.gold_wide(spark, sf), 4) if gold else None, **options)

    return inputs.stored(spark, ("enriched", sf, gold, *sorted(options.items())), build)


# --- sources and dictionaries ---

@register("clean_placeholders", "SELECT * FROM rows", I)
def _rows(spark, sf):
    return inputs.catalog_rows(spark, sf)


@register("gold_attributes", "SELECT * FROM gold_attrs", GA)
def _gold_attributes(spark, sf):
    return gold_attributes(inputs.gold_wide(spark, sf), 4)


@register("distinct_uoms", "SELECT uom, count(*) AS n_used, string_agg(DISTINCT concat('ATTRIBUTE_UOM ', ordinal), ',' ORDER BY concat('ATTRIBUTE_UOM ', ordinal)) AS columns"
          " FROM gold_attrs WHERE uom IS NOT NULL GROUP BY 1", GA)
def _uoms(spark, sf):
    return catalog.distinct_uoms(gold_attributes(inputs.gold_wide(spark, sf), 4)).withColumn("columns", F.array_join("columns", ","))


@register("build_brand_dictionary", "SELECT entry_pos, canonical_manufacturer, canonical_brand, trade_name, signal, bool_or(is_part) AS is_part_number FROM (SELECT"
          " min(g.row_id) OVER (PARTITION BY g.expected_manufacturer, g.expected_brand, g.expected_trade_name) AS entry_pos, g.expected_manufacturer AS"
          " canonical_manufacturer, g.expected_brand AS canonical_brand, g.expected_trade_name AS trade_name, unnest([CASE WHEN g.raw_manuf LIKE '--%' THEN NULL ELSE"
          " trim(g.raw_manuf) END, trim(r.part_manuf), CASE WHEN r.e1_brand LIKE '--%' THEN NULL ELSE r.e1_brand END, CASE WHEN r.unilog_brand LIKE '--%' OR"
          " r.unilog_brand = '-' THEN NULL ELSE r.unilog_brand END, CASE WHEN r.dib_brand LIKE '--%' THEN NULL ELSE r.dib_brand END, g.expected_mfr_part_num]) AS signal,"
          " unnest([false, false, false, false, false, true]) AS is_part FROM gold g LEFT JOIN raw r ON r.mfg_part_num = g.expected_mfr_part_num) WHERE signal IS NOT NULL GROUP BY ALL", I)
def _build(spark, sf):
    gold = inputs.gold(spark, sf).withColumn("mfg_part_num", F.col("expected_mfr_part_num"))
    return catalog.build_brand_dictionary(gold, inputs.catalog_raw(spark, sf)).drop("signal_pos")


@register("last_per_part", "SELECT part_key, arg_max(row_id, row_id) AS row_id, arg_max(part_desc, row_id) AS part_desc FROM (SELECT lower(trim(p_name)) AS part_key,"
          f" {inputs.CATALOG['row_id']} AS row_id, {inputs.CATALOG['part_desc']} AS part_desc FROM part) GROUP BY 1")
def _last(spark, sf):
    rows = inputs.table(spark, sf, "part").select(F.expr(inputs.CATALOG["row_id"]).alias("row_id"), F.col("p_name").alias("mfg_part_num"),
                                                  F.expr(inputs.CATALOG["part_desc"]).alias("part_desc"))
    return catalog.last_per_part(rows).select("part_key", "row_id", "part_desc")


_MATCH = ("SELECT r.row_id, arg_min(d.signal, d.entry_pos) AS matched_signal, arg_min(d.canonical_manufacturer, d.entry_pos) AS manufacturer FROM rows r LEFT JOIN dict d ON"
          " lower(d.signal) = lower(trim(r.{c})) OR (length(d.signal) >= 3 AND contains(lower(trim(r.{c})), lower(d.signal))) GROUP BY r.row_id")


def _matched(spark, sf, column, **options):
    rows = inputs.catalog_rows(spark, sf).select("row_id", column)
    return catalog.match_signal(rows, column, inputs.dictionary(spark, sf), **options).select(
        "row_id", F.col("m.signal").alias("matched_signal"), F.col("m.manufacturer").alias("manufacturer"))


@register("match_signal", _MATCH.format(c="part_manuf"), I)
def _match(spark, sf):
    return _matched(spark, sf, "part_manuf")


@register("match_signal_trigram", _MATCH.format(c="part_desc"), I)
def _match_trigram(spark, sf):
    """The same match by the join used for large dictionaries."""
    return _matched(spark, sf, "part_desc", inline_bytes=0)


# A dictionary with a signal per part, and texts that name other parts.
_MANY = f"concat('Ref-', cast(p_partkey * 7919 % 100003 as string), case when p_partkey % 3 = 0 then ' ' else '' end, case when p_partkey % 5 = 0 then p_name else '' end)"
_NAMING = (f"concat(p_name, ' for REF-', cast((p_partkey * 31 % 50000) * 7919 % 100003 as string), ' and ref-', cast((p_partkey * 17 % 50000) * 7919 % 100003 as string), 'x')")
_MANY_SQL = (f"SELECT r.k AS row_id, arg_min(d.s, d.e) AS matched_signal FROM (SELECT p_partkey AS k, lower({_NAMING}) AS t FROM part) r LEFT JOIN (SELECT p_partkey AS e, {_MANY} AS s FROM part) d"
             " ON contains(r.t, lower(d.s)) GROUP BY r.k")


def _many(spark, sf, **options):
    part = inputs.dealt(inputs.table(spark, sf, "part").select("p_partkey", "p_name"), "p_partkey")
    names = F.lit(None).cast("string")
    entries = part.select(F.col("p_partkey").alias("entry_pos"), F.lit(0).alias("signal_pos"), F.expr(_MANY).alias("signal"), names.alias("canonical_manufacturer"),
                          names.alias("canonical_brand"), names.alias("trade_name"))
    rows = part.select(F.col("p_partkey").alias("row_id"), F.expr(_NAMING).alias("t"))
    return catalog.match_signal(rows, "t", entries, **options).select("row_id", F.col("m.signal").alias("matched_signal"))


@register("match_signal_many", _MANY_SQL)
def _match_many(spark, sf):
    """As many signals as parts, looked up in the tasks."""
    return _many(spark, sf)


@register("match_signal_many_joined", _MANY_SQL)
def _match_many_joined(spark, sf):
    """As many signals as parts, joined with the substrings that may be signals."""
    return _many(spark, sf, inline_bytes=0)


# --- brands ---

@register("brand_signals", "SELECT row_id, coalesce(raw_brands, '') AS raw_brands, brand_conflict FROM signals", B)
def _signals(spark, sf):
    return catalog.brand_signals(inputs.catalog_rows(spark, sf)).select("row_id", F.array_join("raw_brands", ", ").alias("raw_brands"), "brand_conflict")


def _resolution(df):
    return df.select("row_id", *[f"resolution.{c}" for c in ("manufacturer", "brand", "trade_name", "status", "confidence", "is_conflicted")],
                     F.array_join("resolution.sources", "; ").alias("sources"))


@register("resolve_brand", "SELECT * FROM resolved", B)
def _resolve(spark, sf):
    return _resolution(catalog.resolve_brand(inputs.catalog_rows(spark, sf), inputs.dictionary(spark, sf)))


@register("resolve_brand_trigram", "SELECT * FROM resolved", B)
def _resolve_trigram(spark, sf):
    """The same resolution by the join used for large dictionaries."""
    return _resolution(catalog.resolve_brand(inputs.catalog_rows(spark, sf), inputs.dictionary(spark, sf), inline_bytes=0))


def _brand_fields(spark, sf, strict):
    rows = catalog.resolve_brand(catalog.brand_signals(inputs.catalog_rows(spark, sf)), inputs.dictionary(spark, sf))
    return catalog.brand_fields(rows, strict).select(
        "row_id", F.col("manufacturer_name.value").alias("manufacturer"), F.col("brand_name.value").alias("brand"), F.col("trade_name.value").alias("trade_name"),
        F.col("brand_name.status").alias("brand_status"), F.col("brand_name.confidence").alias("brand_confidence"))


@register("brand_fields", "SELECT * FROM brand_fields", EN)
def _fields(spark, sf):
    return _brand_fields(spark, sf, False)


@register("brand_fields_strict", "SELECT * FROM brand_fields", STRICT)
def _fields_strict(spark, sf):
    return _brand_fields(spark, sf, True)


# --- names, attributes, tiers ---

@register("part_number_field", "SELECT row_id, trim(mfg_part_num) AS value, 'Verified' AS status, 1::DOUBLE AS confidence FROM rows", I)
def _part_number(spark, sf):
    return inputs.catalog_rows(spark, sf).withColumn("f", catalog.part_number_field()).select("row_id", "f.value", "f.status", "f.confidence")


@register("product_name", "SELECT row_id, name, name_status FROM named", EN)
def _name(spark, sf):
    return enriched(spark, sf).select("row_id", F.col("product_name.value").alias("name"), F.col("product_name.status").alias("name_status"))


_TRIPLE = "label, value_num, value_str, uom, raw_value, raw_uom, status, confidence"


def _triples(df):
    return df.select("row_id", "ordinal", *_TRIPLE.split(", "))


@register("extract_attributes", f"SELECT row_id, CAST(ordinal AS INT) AS ordinal, {_TRIPLE} FROM attrs", FREE)
def _extract(spark, sf):
    rows = inputs.catalog_rows(spark, sf).select("row_id", catalog.extract_attributes(F.col("part_desc")).alias("attributes"))
    return _triples(catalog.catalog_attributes(rows))


@register("merge_gold_attributes", f"SELECT row_id, CAST(ordinal AS INT) AS ordinal, {_TRIPLE} FROM attrs", EN)
def _merge(spark, sf):
    return _triples(catalog.catalog_attributes(enriched(spark, sf)))


@register("short_description", "SELECT row_id, short_desc, short_status, CASE WHEN short_status = 'Verified' THEN 0.95::DOUBLE ELSE 0.8::DOUBLE END AS confidence FROM enriched", EN)
def _short(spark, sf):
    return enriched(spark, sf).select("row_id", F.col("short_desc.value").alias("short_desc"), F.col("short_desc.status").alias("short_status"),
                                       F.col("short_desc.confidence").alias("confidence"))


@register("gold_fields", "SELECT row_id, classpath, CASE WHEN classpath IS NULL THEN 'Unknown' ELSE 'Verified' END AS classpath_status, long_desc FROM enriched", EN)
def _gold_fields(spark, sf):
    return enriched(spark, sf).select("row_id", F.col("classpath.value").alias("classpath"), F.col("classpath.status").alias("classpath_status"),
                                       F.col("long_desc.value").alias("long_desc"))


@register("overall_tier", "SELECT row_id, overall_status FROM enriched", FREE)
def _tier(spark, sf):
    return enriched(spark, sf, gold=False).select("row_id", F.col("overall_trust_status").alias("overall_status"))


_ENRICHED = ("SELECT row_id, mfg_part_num, manufacturer, brand, trade_name, brand_status, mpn, name, name_status, classpath, long_desc, short_desc,"
             " overall_status, n_attributes FROM enriched")


def _flat(rows):
    return rows.select(
        "row_id", "mfg_part_num", F.col("manufacturer_name.value").alias("manufacturer"), F.col("brand_name.value").alias("brand"),
        F.col("trade_name.value").alias("trade_name"), F.col("brand_name.status").alias("brand_status"),
        F.col("manufacturer_part_number.value").alias("mpn"), F.col("product_name.value").alias("name"), F.col("product_name.status").alias("name_status"),
        F.col("classpath.value").alias("classpath"), F.col("long_desc.value").alias("long_desc"), F.col("short_desc.value").alias("short_desc"),
        F.col("overall_trust_status").alias("overall_status"), F.size("attributes").cast("long").alias("n_attributes"))


@register("enrich_catalog", _ENRICHED, EN)
def _enrich(spark, sf):
    return _flat(enriched(spark, sf))


# --- evaluation ---

_CELLS = " UNION ALL ".join(
    f"SELECT g.row_id, g.mfg_part_num, '{name}' AS field_name, e.{v} AS pipeline_value, g.{x} AS expected_value, "
    + ("coalesce(e.classpath = g.expected_classpath, false) OR g.expected_classpath = ''" if name == "Classpath" else f"e.{v} IS NOT DISTINCT FROM g.{x}")
    + " AS is_exact_match FROM gold g JOIN enriched e ON lower(trim(e.mfg_part_num)) = lower(trim(g.mfg_part_num))"
    for (name, _, x), v in zip(evaluate.COMPARED, ["manufacturer", "brand", "mpn", "name", "classpath"]))
EX = {**FREE, "cells": _CELLS}


@register("exact_match", "SELECT * FROM cells", EX)
def _exact(spark, sf):
    return evaluate.exact_match(enriched(spark, sf, gold=False), inputs.gold(spark, sf)).drop("field_no", "status_tier", "confidence")


@register("exact_match_summary", "SELECT row_id, count(*) AS fields_compared, count(*) FILTER (is_exact_match) AS fields_matched,"
          " round(count(*) FILTER (is_exact_match) / count(*) * 100, 2) AS accuracy_pct FROM cells GROUP BY ROLLUP (row_id)", EX)
def _exact_summary(spark, sf):
    return evaluate.exact_match_summary(evaluate.exact_match(enriched(spark, sf, gold=False), inputs.gold(spark, sf)))


_DISTRIBUTION = (
    "SELECT k.kind, t.tier, count(e.row_id) AS n, round(count(e.row_id) / (SELECT count(*) FROM rows) * 100, 2) AS pct FROM (VALUES ('manufacturer'), ('brand'),"
    f" ('overall')) k(kind) CROSS JOIN (VALUES {', '.join(f'({co.quoted(x)})' for x in dims.TIERS)}) t(tier) LEFT JOIN enriched e ON CASE WHEN k.kind = 'overall' THEN"
    " e.overall_status ELSE e.brand_status END = t.tier GROUP BY 1, 2")


@register("status_distribution", _DISTRIBUTION, EN)
def _distribution(spark, sf):
    return evaluate.status_distribution(enriched(spark, sf))


@register("audit_distribution_sums", f"SELECT kind, round(sum(pct), 4) AS total_pct FROM ({_DISTRIBUTION}) GROUP BY 1 HAVING abs(sum(pct) - 100) > 0.05", EN)
def _sums(spark, sf):
    return audit.audit_distribution_sums(evaluate.status_distribution(enriched(spark, sf)))


@register("conflict_rate", "SELECT count(*) AS total_rows, count(*) FILTER (overall_status = 'Conflicted') AS conflicts, round(count(*) FILTER (overall_status = 'Conflicted')"
          " / count(*) * 100, 2) AS conflict_rate_pct FROM enriched", EN)
def _conflict_rate(spark, sf):
    return evaluate.conflict_rate(enriched(spark, sf))


@register("conflict_examples", "SELECT row_id, mfg_part_num, part_desc FROM enriched WHERE overall_status = 'Conflicted' ORDER BY row_id LIMIT 5", EN)
def _conflict_examples(spark, sf):
    return evaluate.conflict_examples(enriched(spark, sf)).select("row_id", "mfg_part_num", "part_desc")


@register("lov_compliance", "SELECT count(*) AS populated_values, count(*) FILTER (known) AS in_dictionary, round(count(*) FILTER (known) / count(*) * 100, 2) AS lov_compliance_pct"
          " FROM (SELECT manufacturer IN (SELECT canonical_manufacturer FROM dict) AS known FROM enriched WHERE manufacturer IS NOT NULL UNION ALL"
          " SELECT brand IN (SELECT canonical_brand FROM dict) FROM enriched WHERE brand IS NOT NULL)", EN)
def _lov(spark, sf):
    known = catalog.signals(inputs.dictionary(spark, sf))
    return evaluate.lov_compliance(enriched(spark, sf), known)


_NULLS = " OR ".join(f"{co.clean(c)} IS NULL" for c in ("e1_brand", "unilog_brand", "dib_brand"))
_TOKENS = " OR ".join(f"(coalesce(trim({c}), '') <> '' AND {co.clean(c)} IS NULL)" for c in ("e1_brand", "unilog_brand", "dib_brand", "part_manuf"))


@register("placeholder_rate", f"SELECT count(*) AS total_rows, count(*) FILTER ({_NULLS}) AS rows_with_null_brand, count(*) FILTER ({_TOKENS}) AS rows_with_placeholder_token,"
          f" round(count(*) FILTER ({_NULLS}) / count(*) * 100, 2) AS null_brand_pct, round(count(*) FILTER ({_TOKENS}) / count(*) * 100, 2) AS placeholder_token_pct FROM raw", I)
def _placeholder(spark, sf):
    return evaluate.placeholder_rate(inputs.catalog_raw(spark, sf))


@register("catalog_batch_report", "SELECT count(*) AS total_records, count(*) FILTER (overall_status = 'Conflicted') AS conflict_count, round(count(*) FILTER (overall_status ="
          " 'Conflicted') / count(*) * 100, 2) AS conflict_rate_pct, " + ", ".join(f"count(*) FILTER (overall_status = '{x}') AS {x.lower()}, round(count(*) FILTER (overall_status"
          f" = '{x}') / count(*) * 100, 2) AS {x.lower()}_pct" for x in dims.TIERS) + " FROM enriched", EN)
def _batch(spark, sf):
    return evaluate.catalog_batch_report(enriched(spark, sf))


_RECORDS = "SELECT row_id, mfg_part_num, part_desc, manufacturer, brand, overall_status, overall_status = 'Conflicted' AS has_conflicts FROM enriched"


@register("records_summary", _RECORDS, EN)
def _records(spark, sf):
    return evaluate.records_summary(enriched(spark, sf)).drop("confidence")


@register("list_catalog_page", f"SELECT * FROM ({_RECORDS}) WHERE overall_status = 'Verified' AND NOT has_conflicts AND (contains(lower(mfg_part_num), 'ring') OR"
          " contains(lower(part_desc), 'ring') OR contains(lower(brand), 'ring')) ORDER BY row_id LIMIT 20 OFFSET 20", EN)
def _page(spark, sf):
    return explore.list_catalog(evaluate.records_summary(enriched(spark, sf)), page=2, status="verified", has_conflicts=False, search="RING").drop("confidence")


_DEEP = "NOT has_conflicts AND contains(lower(part_desc), 'v')"


@register("catalog_page_deep", f"SELECT * FROM (SELECT * FROM ({_RECORDS}) WHERE {_DEEP}) ORDER BY row_id LIMIT 9 OFFSET (SELECT 9 * CAST(floor(count(*) / 11) AS BIGINT) FROM ({_RECORDS}) WHERE {_DEEP})", EN)
def _deep_page(spark, sf):
    """A page near the end of a long list, found by its stored index."""
    records = explore.filter_catalog(evaluate.records_summary(enriched(spark, sf)), has_conflicts=False, search="v")
    records = records.filter(F.contains(F.lower("part_desc"), F.lit("v")))
    index = inputs.stored(spark, ("page-index", sf), lambda: explore.page_index(records, 500))
    total = index.agg(F.sum("n_rows")).first()[0]
    return explore.page_at(records, index, total // 11 + 1, 9).drop("confidence")


@register("catalog_pages", f"SELECT count(*) AS total, CAST(ceil(count(*) / 20) AS BIGINT) AS total_pages FROM ({_RECORDS}) WHERE contains(lower(part_desc), 'disc') OR contains(lower(brand), 'disc')", EN)
def _pages(spark, sf):
    return explore.catalog_pages(evaluate.records_summary(enriched(spark, sf)), search="disc")


@register("input_row_lookup", "SELECT row_id, mfg_part_num, part_desc FROM rows WHERE row_id = 23 OR lower(trim(mfg_part_num)) = 'mpn41'", I)
def _input_row(spark, sf):
    """An input row by its id, and one by its part number."""
    rows = inputs.catalog_rows(spark, sf).select("row_id", "mfg_part_num", "part_desc")
    by_number = explore.get_detail(catalog.last_per_part(rows), "part_key", "mpn41").select(rows.columns)
    return explore.get_detail(rows, "row_id", 23).unionByName(by_number)


@register("gold_row_lookup", "SELECT row_id, expected_mfr_part_num, expected_brand FROM gold WHERE row_id = 23 OR lower(trim(mfg_part_num)) = 'mpn41'", EN)
def _gold_row(spark, sf):
    """A gold row by its id, and one by its part number."""
    gold = inputs.gold(spark, sf).select("row_id", "mfg_part_num", "expected_mfr_part_num", "expected_brand")
    by_number = explore.get_detail(catalog.last_per_part(gold), "part_key", "mpn41").select(gold.columns)
    return explore.get_detail(gold, "row_id", 23).unionByName(by_number).drop("mfg_part_num")


@register("catalog_detail", f"SELECT * FROM ({_RECORDS}) WHERE row_id = 17", EN)
def _detail(spark, sf):
    return explore.get_detail(evaluate.records_summary(enriched(spark, sf)), "row_id", 17).drop("confidence")


_STATUS = (
    "SELECT row_id, field, status, value, confidence, CASE WHEN status = 'Unknown' AND value IS NOT NULL THEN 'unknown with a value' WHEN status IN ('Verified', 'Inferred')"
    " AND n_sources < 1 THEN 'no source' WHEN confidence NOT BETWEEN 0 AND 1 THEN 'confidence out of range' END AS broken_rule FROM (SELECT row_id, 'classpath' AS field,"
    " CASE WHEN classpath IS NULL THEN 'Unknown' ELSE 'Verified' END AS status, classpath AS value, CASE WHEN classpath IS NULL THEN 0::DOUBLE ELSE 1::DOUBLE END AS confidence,"
    " 0 AS n_sources FROM enriched)")


@register("audit_status_rules", f"SELECT row_id, field, status, value, confidence, broken_rule FROM ({_STATUS}) WHERE broken_rule IS NOT NULL", EN)
def _status_rules(spark, sf):
    """Every enriched field; gold fields carry no source, which the audit must report."""
    names = ("manufacturer_name", "brand_name", "product_name", "classpath", "short_desc")
    cells = F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).alias("f")) for n in names])
    values = enriched(spark, sf).select("row_id", F.inline(cells)).select("row_id", "field", "f.status", "f.value", "f.sources", "f.confidence")
    return audit.audit_status_rules(values).drop("sources")


# --- export ---

HEADERS = ["Mfg_Part_Num", "Part_Desc", "Part_Manuf", "E1_Brand", "MANUFACTURER_NAME", "BRAND_NAME", "TRADE_NAME", "MANUFACTURER_PART_NUMBER", "Product Name", "Classpath",
           "SERIES", "SHORT_DESCRIPTION", "LONG_DESCRIPTION", "UPC", *[f"ATTRIBUTE_{k} {i}" for i in range(1, 7) for k in ("LABEL", "VALUE", "UOM")]]
EXPORT = {
    **EN,
    "delivery": (
        "SELECT mfg_part_num AS \"Mfg_Part_Num\", part_desc AS \"Part_Desc\", coalesce(part_manuf, '') AS \"Part_Manuf\", coalesce(e1_brand, '') AS \"E1_Brand\","
        " coalesce(manufacturer, '') AS \"MANUFACTURER_NAME\", coalesce(brand, '') AS \"BRAND_NAME\", coalesce(trade_name, '') AS \"TRADE_NAME\", mpn AS"
        " \"MANUFACTURER_PART_NUMBER\", coalesce(name, '') AS \"Product Name\", coalesce(classpath, '') AS \"Classpath\", '' AS \"SERIES\", short_desc AS"
        " \"SHORT_DESCRIPTION\", coalesce(long_desc, '') AS \"LONG_DESCRIPTION\", '' AS \"UPC\", " + ", ".join(
            f"coalesce(any_value(CASE WHEN a.ordinal = {i} THEN {e} END), '') AS \"ATTRIBUTE_{k} {i}\"" for i in range(1, 7)
            for k, e in (("LABEL", "label"), ("VALUE", "coalesce(CAST(value_num AS VARCHAR), value_str)"), ("UOM", "uom")))
        + " FROM enriched e LEFT JOIN attrs a ON a.row_id = e.row_id GROUP BY e.row_id, mfg_part_num, part_desc, part_manuf, e1_brand, manufacturer, brand, trade_name, mpn,"
        " name, classpath, short_desc, long_desc"),
}


@register("delivery_format", "SELECT * FROM delivery", EXPORT)
def _delivery(spark, sf):
    return delivery.to_delivery(enriched(spark, sf), HEADERS)


@register("spread_triples", "SELECT row_id, " + ", ".join(f"coalesce(any_value(CASE WHEN ordinal = {i} THEN {e} END), '') AS \"ATTRIBUTE_{k} {i}\"" for i in range(1, 4) for k, e in
          (("LABEL", "label"), ("VALUE", "coalesce(CAST(value_num AS VARCHAR), value_str)"), ("UOM", "uom"))) + " FROM attrs GROUP BY row_id", EN)
def _spread(spark, sf):
    columns = delivery.spread_triples(3)
    return enriched(spark, sf).filter(F.size("attributes") > 0).select("row_id", *[e.alias(n) for n, e in columns.items() if " " in n])


@register("delivery_coverage", "SELECT (SELECT count(*) FROM delivery) AS n_rows, header, n_filled, n_filled = 0 AS is_blank FROM (" + " UNION ALL ".join(
    f"SELECT '{h}' AS header, count(*) FILTER (\"{h}\" <> '') AS n_filled FROM delivery" for h in HEADERS) + ")", EXPORT)
def _coverage(spark, sf):
    return delivery.delivery_coverage(delivery.to_delivery(enriched(spark, sf), HEADERS)).drop("header_no")


@register("catalog_documents", _ENRICHED, EN)
def _documents(spark, sf):
    """One JSON document per row, written, read back and compared by content."""
    rows = enriched(spark, sf)
    path = f"{stage_dir(spark)}/catalog-documents-{uuid.uuid4().hex}"
    delivery.write_products(delivery.catalog_documents(rows), path)
    return _flat(spark.read.schema(rows.schema).json(path))


@register("normalize_uom", "SELECT DISTINCT uom AS raw, coalesce(" + co.case("lower(trim(uom))", co._UOM_KEYS) + ", trim(uom)) AS uom, CASE WHEN "
          + co.case("lower(trim(uom))", co._UOM_KEYS) + " IS NULL THEN 'Unknown' WHEN trim(uom) = " + co.case("lower(trim(uom))", co._UOM_KEYS)
          + " THEN 'Verified' ELSE 'Inferred' END AS status FROM gold_attrs WHERE uom IS NOT NULL", GA)
def _uom(spark, sf):
    rows = gold_attributes(inputs.gold_wide(spark, sf), 4).filter("uom is not null").select(F.col("uom").alias("raw")).distinct()
    return rows.withColumn("u", units.normalize_uom(F.col("raw"))).select("raw", "u.uom", "u.status")
