"""Queries of sources and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from specledger import dims
from specledger.functions import text, units, values
from specledger.operators import catalog
from specledger.plans import catalog_oracle as co
from specledger.plans import inputs, oracle
from specledger.plans.inputs import EFFICIENCY, K, POLES, PRODUCT_ID, SIZE, SPEED, _text
from specledger.plans.registry import register
from specledger.sources import html, stored, tabular

BACK = "\\"
# --- wide rows ---
WIDE = {
    "product_id": f"case when {K} % 41 = 0 then '  ' else {PRODUCT_ID} end",
    "manufacturer": "p_brand",
    "model": "p_name",
    "rated_power_kw": _text(f"{SIZE}/10"),
    "full_load_current_a": f"case when {K} % 3 = 0 then '7.22' else ' 2.34 A ' end",
    "rated_speed_rpm": _text(SPEED),
    "efficiency_percent": f"case when {K} % 5 = 0 then '' else {_text(EFFICIENCY)} end",
    "frame": "'90S'",
    "ip_note": f"case when {K} % 4 = 0 then 'IP56+ sealing described' else null end",
    "paint_note": "p_type",
    "source_location": f"concat('p.', {_text(f'{K} % 9')}, ', row ', {_text(K)})",
}
_MELT_COLUMNS = [c for c in WIDE if c not in dims.IDENTITY_COLUMNS]
_CONTEXT = "left(concat_ws('; ', " + ", ".join(
    f"CASE WHEN trim({c}) <> '' THEN concat('{c}=', {c}) END" for c in WIDE if c != "product_id") + "), 300)"
_MELT = " UNION ALL ".join(
    f"SELECT trim(product_id) AS product_id, \"row\", '{c}' AS \"column\", '{dims.CSV_ALIASES.get(c, c)}' AS attribute, trim({c}) AS raw_value,"
    f" try_cast(nullif(regexp_extract({c}, '([-+]?{BACK}d+{BACK}.?{BACK}d*)', 1), '') AS DOUBLE) AS value,"
    f" CAST({oracle.quoted(dims.CSV_UNITS.get(dims.CSV_ALIASES.get(c, c)))} AS VARCHAR) AS unit, {0.85 if c in dims.CSV_ALIASES else 0.6}::DOUBLE AS confidence,"
    f" {_CONTEXT} AS evidence_text FROM wide WHERE trim(product_id) <> '' AND trim({c}) <> ''" for c in _MELT_COLUMNS)


@register("melt_evidence", f"SELECT * FROM ({_MELT})", {
    "wide": "SELECT " + ", ".join(f"{e} AS {n}" for n, e in WIDE.items()) + f", {K} + 1 AS \"row\" FROM part"})
def _melt(spark, sf):
    wide = inputs.table(spark, sf, "part").select(*[F.expr(e).alias(n) for n, e in WIDE.items()], (F.col(K) + 1).alias("row"))
    return tabular.melt_wide_csv(wide).select("product_id", "row", "column", "attribute", "raw_value", "value", "unit", "confidence", "evidence_text")


# --- extracted tables ---
_FIRST = f"case when {K} % 17 = 0 then 'Output kW' when {K} % 19 = 0 then '1500' else replace({_text(f'{SIZE}/10')}, '.', ',') end"
_GRID_CELLS = [_FIRST, f"concat(' ', {_text(f'{SIZE}*10')}, ' ')", "'90S'", _text(f"{K} % 7"), "''", "null", "'2,5'", "'0.01'"]
_GRID_POLES = f"case when {K} % 3 = 0 then null else {POLES} end"
_MANIFEST_ID = f"concat('MTR-W-', {_text(POLES)}, 'P-', {_text(f'round({SIZE}/10 + 1, 1)')})"


def _cells(spark, sf):
    return inputs.table(spark, sf, "part").select(
        (5 + F.col(K) % 3).cast("int").alias("page"), F.lit(1).alias("table_no"), F.col(K).alias("row_no"),
        F.expr(_GRID_POLES).cast("int").alias("poles"), F.array(*[F.expr(c).cast("string") for c in _GRID_CELLS]).alias("cells"))


def _grid_manifest(spark, sf):
    return inputs.table(spark, sf, "part").select(F.expr(_MANIFEST_ID).alias("product_id"), F.col(K).alias("manifest_pos"))


_GRID = {
    "cells": f"SELECT CAST(5 + {K} % 3 AS INT) AS page, {K} AS row_no, {_GRID_POLES} AS poles, {_FIRST} AS first_cell, "
             + ", ".join(f"trim({c}) AS c{i}" for i, c in enumerate(_GRID_CELLS)) + " FROM part",
    "data": f"SELECT *, CAST(nullif(regexp_extract(replace(first_cell, ',', '.'), '([-+]?{BACK}d+{BACK}.?{BACK}d*)', 1), '') AS DOUBLE) AS power FROM cells",
    "manifest": f"SELECT {_MANIFEST_ID} AS product_id, {K} AS manifest_pos, CAST({POLES} AS INT) AS id_poles, round({SIZE}/10 + 1, 1) AS id_power FROM part",
    "matched": "SELECT d.power, d.poles, arg_min(m.product_id, m.manifest_pos) AS product_id FROM (SELECT DISTINCT power, poles FROM data) d JOIN manifest m ON"
               " abs(d.power - m.id_power) < 0.05 AND (d.poles IS NULL OR d.poles = m.id_poles) GROUP BY ALL",
}
_GRID_SQL = " UNION ALL ".join(
    f"SELECT coalesce(m.product_id, concat('PDF-P', d.page, '-kW', d.first_cell)) AS product_id, d.page, concat('p.', d.page, ', ',"
    f" coalesce(concat(CAST(d.poles AS VARCHAR), '-pole'), 'x'), ' electrical data table') AS section, '{name}' AS attribute, d.c{i} AS raw_value,"
    f" CAST(nullif(regexp_extract(replace(d.c{i}, ',', '.'), '([-+]?{BACK}d+{BACK}.?{BACK}d*)', 1), '') AS DOUBLE) AS value,"
    f" CAST({oracle.quoted(unit)} AS VARCHAR) AS unit FROM data d LEFT JOIN matched m ON m.power = d.power AND m.poles IS NOT DISTINCT FROM d.poles"
    f" WHERE d.power <= 1000 AND coalesce(d.c{i}, '') <> ''"
    for i, (name, unit) in enumerate(dims.GRID_COLUMNS[:len(_GRID_CELLS)])).replace(
    "coalesce(concat(CAST(d.poles AS VARCHAR), '-pole'), 'x')", "CASE WHEN d.poles IS NULL THEN 'unknown-pole' ELSE concat(CAST(d.poles AS VARCHAR), '-pole') END")


@register("grid_to_evidence", _GRID_SQL, _GRID)
def _grid(spark, sf):
    return tabular.grid_to_evidence(_cells(spark, sf), _grid_manifest(spark, sf)).select(
        "product_id", "page", "section", "attribute", "raw_value", "value", "unit")


@register("match_entity", "SELECT d.row_no, d.power, m.product_id FROM data d LEFT JOIN matched m ON m.power = d.power AND m.poles IS NOT DISTINCT FROM d.poles", _GRID)
def _match(spark, sf):
    rows = _cells(spark, sf).select("row_no", "poles", values.first_number(F.get("cells", F.lit(0)), comma_decimal=True).alias("power"),
                                    F.col("row_no").alias("row_key"))
    return tabular.match_entity(rows, _grid_manifest(spark, sf)).select("row_no", "power", "product_id")


_POLE_TEXT = f"concat(p_name, ' ', case {K} % 7 when 0 then 'II pole' when 1 then 'iv poles' when 2 then 'VI pol' when 3 then 'VIII  pole' when 4 then '8 pole' when 5 then '12POLE' else 'polar' end)"


@register("pole_from_text", f"SELECT {K} AS k, CAST(CASE {K} % 7 WHEN 0 THEN 2 WHEN 1 THEN 4 WHEN 2 THEN 6 WHEN 3 THEN 8 WHEN 4 THEN 8 WHEN 5 THEN 12 END AS INT) AS poles FROM part")
def _poles(spark, sf):
    return inputs.table(spark, sf, "part").select(F.col(K).alias("k"), values.pole_from_text(F.expr(_POLE_TEXT)).alias("poles"))


_PAGE_TEXT = "concat(text, case when doc_id % 3 = 0 then concat(chr(10), 'Supply 400 V and 50hz. ') when doc_id % 3 = 1 then ' 50 Hz only' else ' 1400 V ' end)"
_CONSTANT = " UNION ALL ".join(
    f"SELECT page, '{a}' AS attribute, '{v}' AS raw_value, '{u}' AS unit, {float(v)}::DOUBLE AS value, trim(replace(substring(text, greatest(0, pos - 40) + 1,"
    f" least(length(text), pos + length(m) + 40) - greatest(0, pos - 40)), chr(10), ' ')) AS evidence_text FROM (SELECT page, text, m,"
    f" length(string_split_regex(text, '(?i){BACK}b{v}{BACK}s*{u}{BACK}b')[1]) AS pos FROM (SELECT doc_id AS page, {_PAGE_TEXT} AS text,"
    f" regexp_extract({_PAGE_TEXT}, '(?i){BACK}b{v}{BACK}s*{u}{BACK}b') AS m FROM documents) WHERE contains(text, '400') AND contains(text, 'V') AND m <> '')"
    for a, v, u in dims.PAGE_CONSTANTS)


@register("page_constants", f"SELECT * FROM ({_CONSTANT})")
def _constants(spark, sf):
    documents = inputs.dealt(inputs.table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    pages = documents.select(F.col("doc_id").alias("page"), F.expr(_PAGE_TEXT).alias("text"))
    return tabular.page_constants(pages).select(F.col("page").cast("long").alias("page"), "attribute", "raw_value", "unit", "value", "evidence_text")


# --- web pages ---
# Words and numbers of whole documents, as a heavier load than the nine patterns have on pages.
TEXT_PATTERNS = [(r"(\d+(?:\.\d+)?)", "number", None), (r"\s(le|the)\s+[a-z]", "article", "word"), (r"(\d{2,3}(?:\.\d+)?)\s*%", "percent", "%")]


def _text_specs(patterns, key: str, texts: str) -> str:
    parts = []
    for pattern, attribute, unit in patterns:
        p = "(?i)" + pattern
        # Lengths of the pieces between matches and of the matches give the offsets, summed per text by window.
        parts.append(
            f"SELECT {key}, '{attribute}' AS attribute, raw AS raw_value, CAST({oracle.quoted(unit)} AS VARCHAR) AS unit, try_cast(CASE WHEN regexp_matches(raw, '^[0-9.]+$')"
            f" THEN raw END AS DOUBLE) AS value, trim(substring(text, CAST(greatest(0, pos - 60) AS BIGINT) + 1, CAST(least(length(text), pos + length(m) + 60) - greatest(0, pos - 60) AS BIGINT)),"
            f" chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS evidence_text FROM (SELECT {key}, text, m, raw, CAST(sum(length(piece) + length(m)) OVER (PARTITION BY {key} ORDER BY n"
            f" ROWS UNBOUNDED PRECEDING) - length(m) AS BIGINT) AS pos FROM (SELECT {key}, text, unnest(regexp_extract_all(text, '{p}', 0)) AS m, unnest(regexp_extract_all(text, '{p}', 1)) AS raw,"
            f" unnest(string_split_regex(text, '{p}')[1:len(regexp_extract_all(text, '{p}', 0))]) AS piece, generate_subscripts(regexp_extract_all(text, '{p}', 0), 1) AS n FROM {texts}))")
    return " UNION ALL ".join(parts)


@register("text_matches", _text_specs(TEXT_PATTERNS, "doc_id", "documents"))
def _text_matches(spark, sf):
    documents = inputs.dealt(inputs.table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    pages = documents.select(F.col("doc_id").cast("string").alias("product_id"), F.lit("u").alias("url"), "text")
    return html.html_text_specs(pages, TEXT_PATTERNS).select(
        F.col("product_id").cast("long").alias("doc_id"), "attribute", "raw_value", "unit", "value", "evidence_text")


# Each page gets a sentence with all nine kinds of values at the end of its article.
_SPEC_TEXT = (
    "concat('<p>Rated ', cast(page_id % 200 as string), '.5 kW at <b>', cast(1000 + page_id % 500 as string), ' RPM</b>, ', cast(100 + page_id % 300 as string), ' V, ',"
    " cast(50 + 10 * (page_id % 2) as string), 'Hz, ', cast(10 + page_id % 90 as string), '&#37; <i>cos</i> &phi;', case when page_id % 3 = 0 then '=' else ' ' end, ' 0.', cast(10 + page_id % 90 as string),"
    " '; IP', cast(50 + page_id % 9 as string), '&nbsp;, ', cast(page_id % 40 as string), ' kg; ', cast(page_id % 30 as string), '.25 A &#x2013; ', cast(page_id as string), ' kWh</p>')")
_SPEC_HTML = f"replace(html, '</article>', concat({_SPEC_TEXT}, '</article>'))"
_NOISE = ("script", "style", "nav", "footer", "header")


def _strip_sql(html_sql: str) -> dict[str, str]:
    """Page texts by cutting at every ``<``: another way than the tokens of the library, and enough for the given pages."""
    def depth(names) -> str:
        return " + ".join(f"sum(CASE tag WHEN '{n}' THEN 1 WHEN '/{n}' THEN -1 ELSE 0 END) OVER so_far" for n in names)

    text = "replace(replace(replace(replace(replace(replace(replace(t, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&#37;', '%'), '&phi;', 'φ'), '&nbsp;', chr(160)), '&#x2013;', chr(8211))"
    return {
        "pieces": f"SELECT page_id, unnest(string_split(h, '<')) AS piece, generate_subscripts(string_split(h, '<'), 1) AS n FROM (SELECT page_id, coalesce({html_sql}, '') AS h FROM pages)",
        "parted": "SELECT page_id, n, CASE WHEN n = 1 THEN '' ELSE lower(string_split(string_split(piece, '>')[1], ' ')[1]) END AS tag,"
                  " CASE WHEN n = 1 THEN piece WHEN contains(piece, '>') THEN substr(piece, strpos(piece, '>') + 1) ELSE '' END AS t FROM pieces",
        "placed": f"SELECT page_id, n, tag, t, {depth(_NOISE)} AS noise, {depth(('article', 'main'))} AS inside, {depth(('body',))} AS body FROM parted WINDOW so_far AS (PARTITION BY page_id ORDER BY n)",
        "nodes": f"SELECT page_id, n, inside, body, trim(regexp_replace(replace({text}, '&amp;', '&'), '&amp$', '&'), chr(32) || chr(9) || chr(10) || chr(13) || chr(160)) AS t,"
                 " max(inside) OVER (PARTITION BY page_id) AS has_main FROM placed WHERE noise = 0",
        "stripped": "SELECT page_id, coalesce(string_agg(t, ' ' ORDER BY n) FILTER (t <> '' AND CASE WHEN has_main > 0 THEN inside > 0 ELSE body > 0 END), '') AS text FROM nodes GROUP BY page_id"}


@register("html_strip", "SELECT page_id, text, length(text) AS n_chars FROM stripped", _strip_sql("html"))
def _strip(spark, sf):
    return html.html_strip(inputs.dealt(inputs.table(spark, sf, "pages").select("page_id", "html"), "page_id"), ["page_id"]).select(
        "page_id", "text", F.length("text").cast("long").alias("n_chars"))


@register("html_text_specs", _text_specs(dims.SPEC_PATTERNS, "page_id", "stripped"), _strip_sql(_SPEC_HTML))
def _text_spec_query(spark, sf):
    pages = inputs.dealt(inputs.table(spark, sf, "pages"), "page_id")
    texts = html.html_strip(pages.select(F.col("page_id").alias("product_id"), "url", F.expr(_SPEC_HTML).alias("html")))
    return html.html_text_specs(texts).select(F.col("product_id").cast("long").alias("page_id"), "attribute", "raw_value", "unit", "value", "evidence_text")


# A page per part: a navigation block with a table and a nested block, a table with another one in a cell, and two lists.
_POWER, _SPEED, _SHARE, _VOLTS, _HERTZ = f"{SIZE}/10", f"1000 + {K} % 500", f"10 + {K} % 80", f"100 + {K} % 300", f"50 + 10 * ({K} % 2)"
_HTML = (
    f"concat('<html><body><nav><nav></nav><table><tr><td>1 kW</td></tr><tr><td>2 kW</td></tr></table><h3>Menu</h3></nav><h2> Motor <b>', p_name, '</b></h2><table>', case when {K} % 2 = 0 then"
    f" '<thead><tr><th>Power</th><th>Speed</th><th>Note</th></tr></thead>' else '<tr><th>Power</th><th>Speed<th>Note</th></tr>' end, '<tr><td>', {_text(_POWER)}, ' kW</td><td> ', {_text(_SPEED)},"
    f" 'rpm </td><td>', p_type, '</td></tr>', '<tr><td></td><td>n/a<td title=\"a > b\">', {_text(_SHARE)}, ' &#x25;</td></tr><tr><td>Supply<table><tr><th>Mains</th><th>Net</th></tr><tr><td>',"
    f" {_text(_VOLTS)}, ' V</td><td>', {_text(_HERTZ)}, '&nbsp;Hz</td></tr></table></td></tr></table><h3></h3><h3>Supply</h3><header><h4>Skip</h4></header><dl><dt>Net</dt><dd>', {_text(_VOLTS)},"
    f" ' V</dd><dt>Empty<dd> <dt>Grade</dt><dd><i>IP ', {_text(f'50 + {K} % 9')}, '</i></dd><dt>More<dd><dl><dt>Mass</dt><dd>', {_text(_SHARE)}, ' kg</dd></dl></dd></dl></body></html>')")


def _pages(spark, sf):
    return html.html_tokens(inputs.dealt(inputs.table(spark, sf, "part"), K).select(
        F.expr(PRODUCT_ID).alias("product_id"), F.concat(F.lit("http://m/"), F.col(K).cast("string")).alias("url"), F.expr(_HTML).alias("html")))


_SECTION = "left(concat('Motor', p_name), 100)"
# (attribute, raw value, unit, text of the row). The rows of the inner table are rows of the outer one too, and its cells are cells of the row around it.
_TABLE_ROWS = [
    ("rated_power", _text(_POWER), "kW", "first"), ("rated_speed", _text(_SPEED), "rpm", "first"), ("efficiency", _text(_SHARE), "%", f"concat('Speed: n/a | Note: ', {_text(_SHARE)}, ' %')"),
    ("frequency", _text(_HERTZ), "Hz", f"concat('Power: SupplyMainsNet', {_text(_VOLTS)}, ' V', {_text(_HERTZ)}, chr(160), 'Hz | Speed: Mains | Note: Net')"),
    ("rated_voltage", _text(_VOLTS), "V", "outer"), ("frequency", _text(_HERTZ), "Hz", "outer"), ("rated_voltage", _text(_VOLTS), "V", "inner"), ("frequency", _text(_HERTZ), "Hz", "inner")]
_ROW_TEXT = {"first": f"concat('Power: ', {_text(_POWER)}, ' kW | Speed: ', {_text(_SPEED)}, 'rpm | Note: ', p_type)",
             "outer": f"concat('Power: ', {_text(_VOLTS)}, ' V | Speed: ', {_text(_HERTZ)}, chr(160), 'Hz')", "inner": f"concat('Mains: ', {_text(_VOLTS)}, ' V | Net: ', {_text(_HERTZ)}, chr(160), 'Hz')"}


@register("html_table_specs", " UNION ALL ".join(
    f"SELECT {PRODUCT_ID} AS product_id, {_SECTION} AS section, '{a}' AS attribute, {raw} AS raw_value, CAST({raw} AS DOUBLE) AS value, '{unit}' AS unit, {_ROW_TEXT.get(row, row)} AS evidence_text FROM part"
    for a, raw, unit, row in _TABLE_ROWS))
def _table(spark, sf):
    return html.html_table_specs(_pages(spark, sf)).select("product_id", "section", "attribute", "raw_value", "value", "unit", "evidence_text")


@register("html_dl_specs", f"SELECT product_id, 'Supply' AS section, attribute, raw_value, try_cast(raw_value AS DOUBLE) AS value, unit, evidence_text FROM (SELECT {PRODUCT_ID} AS product_id,"
          f" unnest(['rated_voltage', 'ip_rating', 'weight', 'weight', 'weight']) AS attribute, unnest([{_text(_VOLTS)}, concat('IP ', {_text(f'50 + {K} % 9')}), {_text(_SHARE)}, {_text(_SHARE)}, {_text(_SHARE)}]) AS raw_value,"
          f" unnest(['V', NULL, 'kg', 'kg', 'kg']) AS unit, unnest([concat('Net: ', {_text(_VOLTS)}, ' V'), concat('Grade: IP ', {_text(f'50 + {K} % 9')}), concat('More: Mass', {_text(_SHARE)}, ' kg'),"
          f" concat('Mass: ', {_text(_SHARE)}, ' kg'), concat('Mass: ', {_text(_SHARE)}, ' kg')]) AS evidence_text FROM part)")
def _dl(spark, sf):
    return html.html_dl_specs(_pages(spark, sf)).select("product_id", "section", "attribute", "raw_value", "value", "unit", "evidence_text")


# --- extraction summary ---
_LOG_STATUS = "case (k + t) % 5 when 0 then 'failed' when 1 then 'partial' else 'success' end"
_LOG_SQL = " UNION ALL ".join(
    f"SELECT {PRODUCT_ID} AS product_id, '{s}' AS source_type, {_LOG_STATUS.replace('k + t', f'{K} + {i}')} AS status, {SIZE} % 7 AS n_facts FROM part"
    for i, s in enumerate(dims.SOURCE_RANKS))


@register("extraction_summary", "SELECT (SELECT count(*) FROM part) AS products_discovered, " + ", ".join(
    f"count(*) FILTER (source_type = '{s}') AS {s}_attempted, count(*) FILTER (source_type = '{s}' AND ok) AS {s}_succeeded, count(*) FILTER (source_type = '{s}' AND NOT ok)"
    f" AS {s}_failed" for s in dims.SOURCE_RANKS) + ", CAST(sum(n_facts) FILTER (source_type <> 'web') AS BIGINT) AS total_evidence, CAST(sum(n_facts) AS BIGINT) AS total_with_web"
    f" FROM (SELECT *, status = 'success' OR (source_type = 'web' AND status = 'partial') AS ok FROM ({_LOG_SQL}))")
def _summary(spark, sf):
    part = inputs.table(spark, sf, "part")
    rows = F.array(*[F.struct(F.lit(s).alias("source_type"), F.expr(_LOG_STATUS.replace("k + t", f"{K} + {i}")).alias("status"),
                              (F.col(SIZE) % 7).alias("n_facts")) for i, s in enumerate(dims.SOURCE_RANKS)])
    return stored.extraction_summary(part.select(F.expr(PRODUCT_ID).alias("product_id"), F.inline(rows)),
                                     part.select(F.expr(PRODUCT_ID).alias("product_id")))


# --- scalar functions over texts made from every part ---
_RAW = (f"case {K} % 14 when 0 then '84.8%' when 1 then concat({_text(SIZE)}, ' HP') when 2 then '1.1e3' when 3 then '' when 4 then '  ' when 5 then 'abc'"
        f" when 6 then null when 7 then 'ip 56 x' when 8 then {_text(SIZE)} when 9 then concat({_text(f'{K} % 9')}, '-pole') when 10 then ' three phase ' when 11 then '-3.5 kW'"
        f" when 12 then '  90S ' else concat({_text(SIZE)}, ',5 V') end")


def _number_sql(n: int) -> str:
    return f"nullif(regexp_extract(trim(s), '{oracle.NUMBER}', {n}), '')"


@register("parse_values", f"SELECT k, s, try_cast({_number_sql(1)} AS DOUBLE) AS num, {_number_sql(2)} AS unit, {_number_sql(1)} IS NULL AS failed,"
          f" try_cast(nullif(regexp_extract(s, '([-+]?{BACK}d+{BACK}.?{BACK}d*)', 1), '') AS DOUBLE) AS first_number,"
          f" try_cast(nullif(regexp_extract(replace(s, ',', '.'), '([-+]?{BACK}d+{BACK}.?{BACK}d*)', 1), '') AS DOUBLE) AS first_number_comma,"
          f" CASE WHEN s IS NULL THEN NULL WHEN regexp_matches(s, '(?i)IP{BACK}s*{BACK}d{{2,3}}') THEN concat('IP', regexp_extract(s, '(?i)IP{BACK}s*({BACK}d{{2,3}})', 1)) WHEN"
          f" regexp_matches(trim(s), '^{BACK}d{{2,3}}$') THEN concat('IP', trim(s)) ELSE trim(s) END AS ip, nullif(trim(s), '') AS frame,"
          f" try_cast(nullif(regexp_extract(trim(s), '^({BACK}d+)', 1), '') AS INT) AS poles, CASE WHEN regexp_matches(trim(s), '^[+-]?{BACK}d+$') THEN CAST(trim(s) AS INT) WHEN"
          f" regexp_matches(s, '(?i)3|three') THEN 3 END AS phase FROM (SELECT {K} AS k, {_RAW} AS s FROM part)")
def _parse(spark, sf):
    s = F.col("s")
    return inputs.table(spark, sf, "part").select(F.col(K).alias("k"), F.expr(_RAW).alias("s")).withColumn("p", values.parse_numeric(s)).select(
        "k", "s", "p.num", "p.unit", F.col("p.error").isNotNull().alias("failed"), values.first_number(s).alias("first_number"),
        values.first_number(s, True).alias("first_number_comma"), values.parse_ip_rating(s).alias("ip"),
        values.parse_string_field(s)["text"].alias("frame"), values.parse_poles(s).alias("poles"), values.parse_phase(s).alias("phase"))


_UNIT = (f"case {K} % 13 when 0 then 'W' when 1 then ' kw ' when 2 then 'HP' when 3 then 'mW' when 4 then 'BTU' when 5 then null when 6 then '' when 7 then 'lb' when 8 then 'g'"
         f" when 9 then '%' when 10 then 'rpm' when 11 then 'V' else 'Amps' end")
_CONVERT_FIELDS = [f for f, _ in dims.CANONICAL_FIELDS if f not in dims.STRING_FIELDS]


@register("unit_tokens", f"SELECT k, u, {oracle.case('lower(trim(u))', dims.UNIT_SPELLINGS)} AS token, trim(u) <> '' AND {oracle.case('lower(trim(u))', dims.UNIT_SPELLINGS)} IS NULL"
          f" AND u IS NOT NULL AS unknown FROM (SELECT {K} AS k, {_UNIT} AS u FROM part)")
def _tokens(spark, sf):
    u = F.col("u")
    return inputs.table(spark, sf, "part").select(F.col(K).alias("k"), F.expr(_UNIT).alias("u")).select(
        "k", "u", units.unit_token(u).alias("token"), units.unit_error(u).isNotNull().alias("unknown"))


def _convert_sql() -> str:
    power = f"CASE WHEN coalesce(u, '') = '' THEN 1 ELSE {oracle._factor(dims.POWER_FACTORS)} END"
    mass = f"CASE WHEN coalesce(u, '') = '' THEN 1 ELSE {oracle._factor(dims.MASS_FACTORS)} END"
    exprs = {"rated_power": f"round(v * {power}, 6)", "weight": f"round(v * {mass}, 6)", "poles": "CAST(v AS DOUBLE)",
             "efficiency": "CASE WHEN coalesce(u, '') = '' OR token IS NOT NULL THEN CASE WHEN token = '%' OR v > 1.5 THEN v ELSE round(v * 100, 6) END END",
             "power_factor": "CASE WHEN coalesce(u, '') = '' OR token IS NOT NULL THEN CASE WHEN token = '%' AND v > 1.5 THEN round(v / 100, 6) ELSE v END END",
             **{f: f"CASE WHEN u IS NULL OR token = '{t}' THEN v END" for f, t in dims.CANONICAL_FIELDS if t in ("V", "A", "Hz", "rpm")}}
    return " UNION ALL ".join(f"SELECT k, '{f}' AS field, u, CAST({exprs[f]} AS DOUBLE) AS value, CASE WHEN {exprs[f]} IS NOT NULL THEN CAST({oracle.quoted(dims.FIELD_UNITS[f])} AS VARCHAR)"
                              f" END AS unit FROM src" for f in _CONVERT_FIELDS)


@register("convert_units", _convert_sql(), {
    "src": f"SELECT *, {oracle.case('lower(trim(u))', dims.UNIT_SPELLINGS)} AS token FROM (SELECT {K} AS k, {_UNIT} AS u, CAST({SIZE} AS DOUBLE) AS v FROM part)"})
def _convert(spark, sf):
    rows = inputs.table(spark, sf, "part").select(
        F.col(K).alias("k"), F.expr(_UNIT).alias("u"), F.col(SIZE).cast("double").alias("v"),
        F.explode(F.array(*[F.lit(f) for f in _CONVERT_FIELDS])).alias("field"))
    return rows.withColumn("c", units.convert(F.col("field"), F.col("v"), F.col("u"))).select("k", "field", "u", "c.value", "c.unit")


@register("convert_each", f"SELECT k, round(v * CASE WHEN coalesce(u, '') = '' THEN 1 ELSE {oracle._factor(dims.POWER_FACTORS)} END, 6) AS power, round(v * CASE WHEN coalesce(u, '') = ''"
          f" THEN 1 ELSE {oracle._factor(dims.MASS_FACTORS)} END, 6) AS mass, CASE WHEN u IS NULL OR token = 'V' THEN v END AS volt FROM src", {
              "src": f"SELECT *, {oracle.case('lower(trim(u))', dims.UNIT_SPELLINGS)} AS token FROM (SELECT {K} AS k, {_UNIT} AS u, CAST({SIZE} AS DOUBLE) AS v FROM part)"})
def _each(spark, sf):
    v, u = F.col("v"), F.col("u")
    return inputs.table(spark, sf, "part").select(F.col(K).alias("k"), F.expr(_UNIT).alias("u"), F.col(SIZE).cast("double").alias("v")).select(
        "k", units.convert_power(v, u)["value"].alias("power"), units.convert_mass(v, u)["value"].alias("mass"),
        units.passthrough_unit(v, u, "V")["value"].alias("volt"))


_A, _B = f"case when {K} % 7 = 0 then null else cast({K} % 5 as double) end", f"case when {K} % 6 = 0 then null else cast({K} % 3 as double) end"
_UA, _UB = f"case when {K} % 4 = 0 then null else 'kW' end", f"case when {K} % 8 = 0 then null else 'kW' end"


@register("is_equivalent", f"SELECT {K} AS k, CASE WHEN {_A} IS NULL OR {_B} IS NULL THEN {_A} IS NULL AND {_B} IS NULL ELSE {_UA} IS NOT DISTINCT FROM {_UB} AND abs({_A} - {_B}) <= 1e-6 END AS same FROM part")
def _same(spark, sf):
    return inputs.table(spark, sf, "part").select(F.col(K).alias("k"), units.is_equivalent(F.expr(_A), F.expr(_UA), F.expr(_B), F.expr(_UB)).alias("same"))


_FRACTION = f"case {K} % 8 when 0 then concat({_text(f'{SIZE} % 63 + 1')}, '/64') when 1 then '1-1/2' when 2 then ' 7 1/4\" ' when 3 then '3/0' when 4 then concat({_text(SIZE)}, '.5') when 5 then 'x' when 6 then '5d' else concat({_text(SIZE)}, '/3') end"


@register("parse_fractions", f"SELECT k, s, {oracle.fraction('s')} AS value FROM (SELECT {K} AS k, {_FRACTION} AS s FROM part)")
def _fractions(spark, sf):
    return inputs.table(spark, sf, "part").select(F.col(K).alias("k"), F.expr(_FRACTION).alias("s")).withColumn("value", values.parse_fraction(F.col("s")))


@register("supplier_codes", f"SELECT {K} AS k, nullif(trim(regexp_replace({inputs.CATALOG['part_manuf']}, '{BACK}s*{BACK}([^)]*{BACK}){BACK}s*$', '')), '') AS supplier FROM part")
def _supplier(spark, sf):
    return inputs.table(spark, sf, "part").select(F.col(K).alias("k"), text.strip_supplier_code(F.expr(inputs.CATALOG["part_manuf"])).alias("supplier"))


_UOM = f"case {K} % 8 when 0 then 'IN' when 1 then '\"' when 2 then ' V ' when 3 then 'dba' when 4 then 'furlong' when 5 then null when 6 then '-' else 'A' end"


@register("value_unit_status", co.triple(f"(SELECT {K} AS k, 'L' AS label, {_FRACTION} AS raw_value, {_UOM} AS raw_uom FROM part)", "k"))
def _status(spark, sf):
    rows = inputs.table(spark, sf, "part").select(
        F.col(K).alias("k"), units.value_unit_status(F.lit("L"), F.expr(_FRACTION), F.expr(_UOM)).alias("t"))
    return rows.select("k", "t.*").drop("reason")


_LOW, _HIGH = f"case when {K} % 3 = 0 then null else cast({K} % 10 as double) end", f"case when {K} % 2 = 0 then null else cast({SIZE} as double) end"
_STRICT = f"({K} % 5 = 0)"


@register("range_conditions", f"SELECT {K} AS k, coalesce(nullif(concat_ws(' and ', CASE WHEN {_LOW} IS NOT NULL THEN concat(CASE WHEN {_STRICT} THEN '> ' ELSE '>= ' END, CAST({_LOW} AS VARCHAR))"
          f" END, CASE WHEN {_HIGH} IS NOT NULL THEN concat('<= ', CAST({_HIGH} AS VARCHAR)) END), ''), 'any') AS condition FROM part")
def _ranges(spark, sf):
    return inputs.table(spark, sf, "part").select(F.col(K).alias("k"), text.range_condition(F.expr(_LOW), F.expr(_HIGH), F.expr(_STRICT)).alias("condition"))


_PLACE = {"source_type": f"case {K} % 4 when 0 then 'pdf' when 1 then 'CSV' when 2 then 'web' else null end", "page": f"case when {K} % 3 = 0 then null else cast({K} % 3 as int) end",
          "row_no": f"case when {K} % 5 = 0 then null else {K} % 5 end", "column_name": f"case when {K} % 2 = 0 then 'c' else '' end", "url": f"case when {K} % 7 = 0 then '' else 'http://x' end",
          "section": f"case when {K} % 6 = 0 then 's' when {K} % 6 = 1 then '' else null end", "attribute": f"case when {K} % 9 = 0 then '' else 'attr' end"}


@register("source_labels", "SELECT k, CASE WHEN source_type IS NOT NULL THEN concat(source_type, CASE WHEN page IS NOT NULL THEN concat(':p.', page) WHEN row_no IS NOT NULL THEN"
          " concat(':row.', row_no) ELSE '' END, CASE WHEN attribute <> '' THEN concat(' (', attribute, ')') ELSE '' END) END AS label, CASE lower(coalesce(source_type, 'pdf')) WHEN 'pdf' THEN"
          " 'PDF Brochure (Official)' WHEN 'csv' THEN 'Legacy CSV (ERP Database)' ELSE concat(upper(source_type), ' Catalog') END AS source_name, coalesce(nullif(section, ''),"
          " CASE WHEN page <> 0 THEN concat('Page ', page, ' (Table)') END, CASE WHEN row_no <> 0 THEN concat('Row ', row_no, CASE WHEN column_name <> '' THEN concat(' (', column_name, ')')"
          " ELSE '' END) END, nullif(url, '')) AS location FROM (SELECT " + f"{K} AS k, " + ", ".join(f"{e} AS {n}" for n, e in _PLACE.items()) + " FROM part)")
def _labels(spark, sf):
    rows = inputs.table(spark, sf, "part").select(F.col(K).alias("k"), *[F.expr(e).alias(n) for n, e in _PLACE.items()])
    c = F.col
    return rows.select("k", text.evidence_label(c("source_type"), c("page"), c("row_no"), c("attribute")).alias("label"),
                       text.source_display(c("source_type")).alias("source_name"),
                       text.location_text(c("section"), c("page"), c("row_no"), c("column_name"), c("url")).alias("location"))


_STATUS = f"case {K} % 13 when 0 then 'TRUSTED' when 1 then 'verified' when 2 then 'INFERRED' when 3 then 'UNVERIFIED' when 4 then 'Conflicted' when 5 then 'CONFLICT' when 6 then 'REVIEW_REQUIRED' when 7 then 'UNSUPPORTED' when 8 then 'FAIL' when 9 then 'MISSING' when 10 then 'UNKNOWN' when 11 then null else 'other' end"


@register("display_tiers", f"SELECT k, status, {oracle.case('upper(status)', dims.DISPLAY_TIERS, chr(39) + 'Unknown' + chr(39))} AS tier FROM (SELECT {K} AS k, {_STATUS} AS status FROM part)")
def _tiers(spark, sf):
    return inputs.table(spark, sf, "part").select(F.col(K).alias("k"), F.expr(_STATUS).alias("status")).withColumn("tier", text.display_tier(F.col("status")))


@register("scalar_lookup", f"SELECT k, s, CASE WHEN regexp_matches(s, '^[0-9]+/64$') AND CAST(split_part(s, '/', 1) AS INT) % 2 = 1 THEN CAST(split_part(s, '/', 1) AS INT) / 64 END AS result"
          f" FROM (SELECT {K} AS k, {_FRACTION} AS s FROM part)")
def _lookup(spark, sf):
    rows = inputs.table(spark, sf, "part").select(F.col(K).alias("k"), F.expr(_FRACTION).alias("s"))
    return catalog.scalar_lookup(rows, "s", dims.fractions())


@register("placeholders", f"SELECT {K} AS k, {co.clean('s')} AS cleaned, {oracle.placeholder('s')} AS is_placeholder FROM (SELECT *, case {K} % 9 when 0 then ' -- No x -- ' when 1 then 'N/A' when 2 then ' none '"
          f" when 3 then '--' when 4 then null when 5 then '' when 6 then '-x-' else p_name end AS s FROM part)")
def _placeholders(spark, sf):
    s = F.expr(f"case {K} % 9 when 0 then ' -- No x -- ' when 1 then 'N/A' when 2 then ' none ' when 3 then '--' when 4 then null when 5 then '' when 6 then '-x-' else p_name end")
    return inputs.table(spark, sf, "part").select(F.col(K).alias("k"), text.clean_string(s).alias("cleaned"), text.is_placeholder(s).alias("is_placeholder"))
