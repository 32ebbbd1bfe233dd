"""Inputs derived from the driver tables.

Each input is a list of SQL expressions that Spark and the checking engine both read, so both start from the same rows.
What the operators do with the rows is written twice, here with the library and in ``oracle`` as plain SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from specledger.plans.tracks import SpecTrack
from specledger.schema import EVIDENCE, conform
from specledger.session import stage_table, tune

K = "p_partkey"
SIZE = "p_size"
POLES = f"(2 + 2*({K} % 4))"
PRODUCT_ID = f"concat('P-', cast({POLES} as string), 'P-', cast({K} as string))"
SYNC = f"cast(floor(6000/{POLES}) as bigint)"
SPEED = f"(case when {K} % 31 = 0 then -5 else {SYNC} - 10*({K} % 7) end)"
TORQUE = f"round({SIZE}/10*60000/(2*pi()*{SYNC})*(1 + ({K} % 4)/10), 3)"
EFFICIENCY = f"(70 + {SIZE} % 30)"


def _text(expr: str) -> str:
    return f"cast({expr} as string)"


# (source type, rank, position, attribute, raw text, parsed value, unit)
FACTS: list[tuple[str, int, int, str, str, str, str]] = [
    ("pdf", 0, 1, "rated_power",
     f"case when {K} % 13 = 0 then 'n.a.' else {_text(f'{SIZE}*100 + (case when {K} % 5 = 0 then 500 else 0 end)')} end",
     "null", "'W'"),
    ("pdf", 0, 2, "rated_speed", _text(SPEED), f"cast({SPEED} as double)", "'rpm'"),
    ("pdf", 0, 3, "full_load_torque_nm", f"case when {K} % 6 = 5 then null else {_text(TORQUE)} end", TORQUE, "'Nm'"),
    ("pdf", 0, 4, "weight", _text(SIZE), "null", f"case when {K} % 2 = 0 then 'lb' else 'kg' end"),
    ("pdf", 0, 5, "frame_size", f"case when {K} % 17 = 0 then '  ' else concat({_text(f'90 + 10*({K} % 5)')}, 'S') end",
     "null", "null"),
    ("pdf", 0, 6, "sound_dba", _text(f"60 + {K} % 20"), f"cast(60 + {K} % 20 as double)", "'dB(A)'"),
    ("pdf", 0, 7, "Rated_Voltage", f"case when {K} % 23 = 0 then '380' else '400' end", "null",
     f"case when {K} % 19 = 0 then 'kV' else 'V' end"),
    ("pdf", 0, 8, "rated_current", "'2.34'", "cast(2.34 as double)", "'A'"),
    ("pdf", 0, 9, "efficiency_at_100pct_load", _text(f"{EFFICIENCY} + (case when {K} % 7 = 3 then 5 else 0 end)"),
     f"cast({EFFICIENCY} + (case when {K} % 7 = 3 then 5 else 0 end) as double)", "'%'"),
    ("csv", 1, 1, "rated_power_kw", _text(f"{SIZE}/10"), f"cast({SIZE}/10 as double)",
     f"case when {K} % 11 = 0 then 'BTU' else 'kW' end"),
    ("csv", 1, 2, "efficiency",
     f"case when {K} % 29 = 0 then '150' when {K} % 2 = 0 then {_text(f'{EFFICIENCY}/100')} else {_text(EFFICIENCY)} end",
     "null", f"case when {K} % 29 = 0 or {K} % 2 = 1 then '%' else null end"),
    ("csv", 1, 3, "weight_kg", _text(SIZE), "null", "'kg'"),
    ("csv", 1, 4, "frame", f"concat({_text(f'90 + 10*({K} % 5)')}, case when {K} % 9 = 0 then 'L' else 'S' end)", "null",
     "null"),
    ("csv", 1, 5, "ip_rating_note",
     f"case {K} % 4 when 0 then 'ip55 sealed' when 1 then 'IP 56' when 2 then '56' else 'sealed' end", "null", "null"),
    ("csv", 1, 6, "source_location", f"concat('row ', {_text(K)})", f"cast({K} as double)", "null"),
    ("csv", 1, 7, "power_factor", f"case {K} % 3 when 0 then '80' when 1 then '0.8' else '1.2' end", "null",
     f"case when {K} % 3 = 0 then '%' else null end"),
    ("csv", 1, 8, "poles", f"case when {K} % 6 = 0 then '4 poles' else null end", "null", "null"),
    ("csv", 1, 9, "full_load_current_a", f"case when {K} % 3 = 0 then '7.22' else '2.34' end",
     f"case when {K} % 3 = 0 then cast(7.22 as double) else cast(2.34 as double) end", "'A'"),
    ("csv", 1, 10, "current_unit", "'A'", "null", "null"),
    ("csv", 1, 11, "paint_note", "'x'", "null", "null"),
]
# Facts for all products, one per region row.
GLOBAL_FACTS = {
    "attribute": "case r_regionkey when 0 then 'frequency' when 2 then 'site_note' else 'rated_voltage' end",
    "raw_value": "case r_regionkey when 0 then '50' when 2 then r_name when 4 then '0.4' else '400' end",
    "unit": "case r_regionkey when 0 then 'Hz' when 2 then null when 4 then 'kV' else 'V' end",
}
CONFIDENCE = {"pdf": 0.92, "csv": 0.85}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Rows of a table with fewer splits than there are cores, dealt to all cores by a hash of their key.

    Work per row is heavy in both tracks, and a small table is one split. Large tables are left as they are, also those of one file, which is read in splits.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def part_facts(part: DataFrame) -> DataFrame:
    """Facts of two sources for every part."""
    facts = F.array(*[
        F.struct(F.lit(kind).alias("source_type"), F.lit(rank).alias("source_rank"), F.lit(pos).cast("long").alias("pos"),
                 F.lit(attribute).alias("attribute"), F.expr(raw).alias("raw_value"),
                 F.expr(value).cast("double").alias("value"), F.expr(unit).cast("string").alias("unit"),
                 F.lit(CONFIDENCE[kind]).alias("confidence"))
        for kind, rank, pos, attribute, raw, value, unit in FACTS])
    pdf = F.col("source_type") == "pdf"
    return part.select(F.expr(PRODUCT_ID).alias("product_id"), K, F.inline(facts)).filter(
        F.col("raw_value").isNotNull()).select(
        "*", F.when(pdf, (1 + F.col(K) % 7).cast("int")).alias("page"), F.when(~pdf, F.col(K)).alias("row"),
        F.when(~pdf, F.concat(F.lit("c_"), F.col("attribute"))).alias("column"),
        F.when(pdf, "table").otherwise("column").alias("method"), F.concat(F.col("source_type"), F.lit("-1")).alias("source_id"))


def web_facts(lineitem: DataFrame) -> DataFrame:
    """One current per line item of a part, as a third and noisy source."""
    key = PRODUCT_ID.replace(K, "l_partkey")
    return lineitem.select(
        F.expr(key).alias("product_id"), F.lit("web").alias("source_type"), F.lit(2).alias("source_rank"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.lit("rated_current").alias("attribute"),
        F.col("l_quantity").cast("int").cast("string").alias("raw_value"), F.lit("A").alias("unit"),
        F.lit(0.55).alias("confidence"), F.lit("html_text").alias("method"), F.lit("web-1").alias("source_id"),
        F.concat(F.lit("http://shop/"), F.col("l_orderkey").cast("string")).alias("url"))


def global_facts(region: DataFrame) -> DataFrame:
    return region.select(
        F.lit("GLOBAL").alias("product_id"), F.lit("pdf").alias("source_type"), F.lit(3).alias("source_rank"),
        F.col("r_regionkey").cast("long").alias("pos"), *[F.expr(e).alias(n) for n, e in GLOBAL_FACTS.items()],
        F.lit(0.80).alias("confidence"), F.lit("text").alias("method"), F.lit("pdf-1").alias("source_id"),
        (F.col("r_regionkey") + 1).alias("page"))


def evidence(spark: SparkSession, sf_dir: str, with_web: bool = True) -> DataFrame:
    part = dealt(table(spark, sf_dir, "part").select(K, SIZE), K)
    out = conform(part_facts(part), EVIDENCE).unionByName(
        conform(global_facts(table(spark, sf_dir, "region")), EVIDENCE))
    if with_web:
        items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
        out = out.unionByName(conform(web_facts(dealt(items, "l_orderkey")), EVIDENCE))
    return out


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of all parts; some have no manufacturer, some an older version."""
    return table(spark, sf_dir, "part").select(
        F.expr(PRODUCT_ID).alias("product_id"),
        F.expr(f"case when {K} % 10 = 3 then null else p_brand end").alias("manufacturer"),
        F.col("p_name").alias("model"), F.col(K).alias("manifest_pos"),
        F.expr(f"case when {K} % 37 = 0 then '1.0.0' else '2.0.0' end").alias("normalization_version"))


# Answers of a text model: fenced, with prose around, plain, malformed and plain without claims.
_ANSWER = (
    "concat('{{\"summary\": \" s', cast({k} as string), ' \", \"inferred_fields\": {{\"frequency\": \"',"
    " case when {k} % 2 = 0 then '50 Hz' else 'about 60' end, '\", \"poles\": \"', cast(2 + {k} % 8 as string), '-pole\"}},"
    " \"source_backed_claims\": [{{\"claim_text\": \"current\", \"category\": \"performance\", \"field\": \"rated_current\"}},"
    " {{\"category\": \"x\"}}, {{\"claim_text\": \"ip\", \"field\": \"ip_rating\", \"confidence\": 0.9}}],"
    " \"inferred_claims\": [{{\"claim_text\": \"use\"}}], \"unresolved_conflicts\": [{{\"field\": \"',"
    " case when {k} % 3 = 0 then 'weight' else 'rated_current' end, '\", \"description\": \"d\", \"action_needed\": \"a\"}}]}}')"
).format(k=K)
RESPONSE = (
    f"case {K} % 5 when 0 then concat('```json', chr(10), {_ANSWER}, chr(10), '```')"
    f" when 1 then concat('Here it is: ', {_ANSWER}, ' done') when 2 then {_ANSWER}"
    f" when 3 then '{{\"summary\": ' else '{{\"summary\": \"only text\", \"source_backed_claims\": []}}' end"
)


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.expr(PRODUCT_ID).alias("product_id"), F.expr(RESPONSE).alias("response"))


_TRACKS: dict[tuple[str, str, bool], SpecTrack] = {}


def track(spark: SparkSession, sf_dir: str, with_responses: bool = False) -> SpecTrack:
    """The specification track over an input folder. Within one session its stage tables are shared between queries."""
    key = (spark.sparkContext.applicationId, sf_dir, with_responses)
    if key not in _TRACKS:
        if with_responses:
            _TRACKS[key] = track(spark, sf_dir).with_responses(responses(spark, sf_dir))
        else:
            _TRACKS[key] = SpecTrack(evidence(spark, sf_dir), products(spark, sf_dir))
    return _TRACKS[key]


_STORED: dict[tuple, DataFrame] = {}


def stored(spark: SparkSession, key: tuple, build: Callable[[], DataFrame]) -> DataFrame:
    """A table that several queries read, stored by the first of them in a session."""
    key = (spark.sparkContext.applicationId, *key)
    if key not in _STORED:
        _STORED[key] = stage_table(build(), str(key[1]))
    return _STORED[key]


def reset() -> None:
    """Forget shared stage tables, so that the next query builds its own (for timing)."""
    _TRACKS.clear()
    _STORED.clear()


# --- catalog ---
BRAND_NO = "cast(replace(p_brand, 'Brand#', '') as int)"
CATALOG = {
    "row_id": f"{K} + 1",
    "mfg_part_num": f"concat('MPN', {_text(K)})",
    "part_desc": (
        f"concat(p_name, ' ', {_text(f'110 + 10*({SIZE} % 4)')}, 'V ', {_text(SIZE)}, 'A ', {_text(f'1 + {SIZE} % 20')},"
        f" '-1/4IN', case {K} % 7 when 0 then ' DISHWASHER 41DBA' when 1 then ' Sanding belt 5\"x.045\"x7/8\" disc'"
        f" when 2 then ' cut-off disc 150in' when 3 then ' decking 36\" board' when 4 then concat(' for ', p_brand) else '' end)"),
    "e1_brand": f"case when {K} % 3 = 0 then '-- Unbranded --' else p_brand end",
    "unilog_brand": f"case when {K} % 2 = 0 then '-' else '-- No Unilog Brand --' end",
    "dib_brand": f"case when {K} % 6 = 1 then concat('Brand#', {_text(f'1 + {SIZE} % 25')}) else '-- No DIB Brand --' end",
    "part_manuf": f"concat(case when {K} % 2 = 0 then 'General Supply' when {K} % 8 = 3 then 'Acme Works' else p_brand end, ' (', {_text(SIZE)}, ')')",
}
# Brands whose number is a multiple of five are not in the dictionary.
DICTIONARY = {
    "entry_pos": BRAND_NO,
    "signal": "p_brand",
    "canonical_manufacturer": f"concat('Maker ', {_text(BRAND_NO)})",
    "canonical_brand": "concat(p_brand, '(R)')",
    "trade_name": f"case when {BRAND_NO} % 2 = 0 then concat('T', {_text(BRAND_NO)}) else '' end",
}
GOLD = {
    "row_id": f"{K} + 1",
    "mfg_part_num": f"concat('mpn', {_text(K)}, ' ')",
    "expected_mfr_part_num": f"concat('MPN', {_text(K)})",
    "sku": "cast(null as string)",
    "part_number": "cast(null as string)",
    "part_desc": "p_name",
    "raw_manuf": f"case when {K} % 9 = 0 then '--' else concat(p_brand, ' Ltd') end",
    "expected_manufacturer": f"concat('Maker ', {_text(BRAND_NO)}, case when {K} % 50 = 0 then ' x' else '' end)",
    "expected_brand": "concat(p_brand, '(R)')",
    "expected_trade_name": f"case when {BRAND_NO} % 2 = 0 then concat('T', {_text(BRAND_NO)}) else '' end",
    "expected_classpath": f"case when {K} % 4 = 0 then '' else concat('A>', p_type) end",
    "expected_product_name": f"case when {K} % 5 < 2 then '' else p_type end",
    "expected_short_desc": "''",
    "expected_long_desc": f"case when {K} % 3 = 0 then concat('long ', p_name) else '' end",
}
# Wide gold attribute columns 1..4.
GOLD_WIDE = {
    "ATTRIBUTE_LABEL 1": "'Voltage Rating'", "ATTRIBUTE_VALUE 1": "' 120 '", "ATTRIBUTE_UOM 1": "'V'",
    "ATTRIBUTE_LABEL 2": f"case when {K} % 2 = 0 then 'Color' else '' end",
    "ATTRIBUTE_VALUE 2": f"case when {K} % 2 = 0 then 'red' else null end", "ATTRIBUTE_UOM 2": "cast(null as string)",
    "ATTRIBUTE_LABEL 3": "'Length'", "ATTRIBUTE_VALUE 3": f"concat({_text(SIZE)}, '-1/2')",
    "ATTRIBUTE_UOM 3": f"case when {K} % 3 = 0 then 'IN' when {K} % 3 = 1 then 'in' else 'cm' end",
    "ATTRIBUTE_LABEL 4": "'length'", "ATTRIBUTE_VALUE 4": "'9'", "ATTRIBUTE_UOM 4": "'in.'",
}


def catalog_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog rows as read, placeholders still in place."""
    return table(spark, sf_dir, "part").select(*[F.expr(e).alias(n) for n, e in CATALOG.items()])


def catalog_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from specledger.functions.text import clean_string

    raw = dealt(catalog_raw(spark, sf_dir), "row_id")
    return raw.select("row_id", "mfg_part_num", "part_desc", *[
        clean_string(F.col(c)).alias(c) for c in ("e1_brand", "unilog_brand", "dib_brand", "part_manuf")])


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_brand").distinct().filter(f"{BRAND_NO} % 5 <> 0")
    return part.select(*[F.expr(e).alias(n) for n, e in DICTIONARY.items()], F.lit(0).alias("signal_pos"))


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(*[F.expr(e).alias(n) for n, e in GOLD.items()])


def gold_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.expr(GOLD["row_id"]).alias("row_id"),
                                               *[F.expr(e).alias(n) for n, e in GOLD_WIDE.items()])
