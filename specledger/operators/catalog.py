"""Catalog enrichment: brand resolution, attributes from text, names, descriptions and trust tiers.

Rows are enriched independently. With a brand dictionary that fits the tasks the whole enrichment is one map-only pass; only the gold
join moves data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from specledger import dims
from specledger.functions.text import clean_string, literal_map, strip, strip_supplier_code
from specledger.functions.units import number_with_unit, value_unit_statuses
from specledger.operators.once import once
from specledger.operators.signals import INLINE_BYTES, first_signal, match_columns, match_signal, match_texts, signal_index, signals  # noqa: F401
from specledger.operators.skew import join_spread

FIELD_TYPE = "struct<value:string,status:string,confidence:double,sources:array<string>,reason:string>"
def field(value: Column, status: Column | str, confidence: Column | float, sources: Column, reason: Column | str) -> Column:
    """A value with status, confidence, sources and reason."""
    def col(x: Column | str | float, kind: str) -> Column:
        return (x if isinstance(x, Column) else F.lit(x)).cast(kind)

    return F.struct(value.cast("string").alias("value"), col(status, "string").alias("status"),
                    col(confidence, "double").alias("confidence"), sources.cast("array<string>").alias("sources"),
                    col(reason, "string").alias("reason"))


def no_sources() -> Column:
    return F.array().cast("array<string>")


# --- brands ---

def brand_signals(rows: DataFrame) -> DataFrame:
    """Add ``raw_brands`` (distinct brand texts of a row) and ``brand_conflict``.

    The supplier counts as a brand unless it names a distributor.
    """
    supplier = strip_supplier_code(clean_string(F.col("part_manuf")))
    distributor = F.lower(supplier).rlike("|".join(dims.DISTRIBUTOR_WORDS))
    texts = F.array_distinct(F.array_compact(F.array(
        *[clean_string(F.col(c)) for c in ("e1_brand", "unilog_brand", "dib_brand")],
        F.when(~distributor, supplier))))
    return once(rows, {"raw_brands": F.array_sort(texts)}).withColumn("brand_conflict", F.size("raw_brands") > 1)


def _with_matches(rows: DataFrame, dictionary: DataFrame, inline_bytes: int) -> DataFrame:
    """Add ``_matches``: source, raw value and match of each matched column, in priority order."""
    index = signal_index(dictionary, inline_bytes=inline_bytes)
    texts = {f"_t{i}": clean_string(F.col(c)) for i, (_, c) in enumerate(dims.BRAND_SOURCES)}
    out = once(rows, texts)
    if index.inline:
        found = match_columns(out, {f"_m{i}": F.lower(f"_t{i}") for i in range(len(texts))}, index, first_signal)
        matched = "array_compact(array({}))".format(", ".join(
            f"case when _m{i} is not null then struct('{name}' as source, _t{i} as raw_val, _m{i} as m) end" for i, (name, _) in enumerate(dims.BRAND_SOURCES)))
        return once(found, {"_matches": F.expr(matched)}).drop(*texts, *[f"_m{i}" for i in range(len(texts))])
    named = F.array(*[F.struct(F.lit(name).alias("source"), F.col(f"_t{i}").alias("raw_val"))
                      for i, (name, _) in enumerate(dims.BRAND_SOURCES)])
    out = out.withColumn("_texts", F.filter(named, lambda x: x["raw_val"].isNotNull())).drop(*texts)
    # Only texts with a likely signal leave their task; distinct ones are matched once, and the matches come back per row, at most one per column.
    long = out.select("row_id", F.posexplode("_texts").alias("i", "x")).select(
        "row_id", "i", F.col("x.source").alias("source"), F.col("x.raw_val").alias("text"))
    likely, matched = match_texts(long, index, F.lower("text"))
    hits = join_spread(likely, matched.select("text", "m"), ["text"], spread=["row_id", "i"], how="inner", counts=matched.select("text", "n_rows"))
    per_row = hits.groupBy("row_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(
        "i", "source", F.col("text").alias("raw_val"), "m"))), lambda x: F.struct(
            x["source"].alias("source"), x["raw_val"].alias("raw_val"), x["m"].alias("m"))).alias("_matches"))
    # An absent list means no match; its type comes from the matched side.
    kept = out.drop("_texts").join(per_row, "row_id", "left")
    return kept.withColumn("_matches", F.coalesce("_matches", F.array().cast(per_row.schema["_matches"].dataType)))


def resolve_brand(rows: DataFrame, dictionary: DataFrame, inline_bytes: int = INLINE_BYTES) -> DataFrame:
    """Add ``resolution``: manufacturer, brand, trade name, status, confidence, sources and reason.

    Six columns are matched in priority order. More than one distinct brand is a conflict without a brand; otherwise the
    first match stands, verified when a part number, supplier or brand column matched, inferred from other columns.
    """
    found = F.col("_matches")
    matched = once(_with_matches(rows, dictionary, inline_bytes), {
        "_brands": F.array_distinct(F.transform(
            F.filter(found, lambda x: F.coalesce(x["m"]["brand"], F.lit("")) != ""), lambda x: x["m"]["brand"])),
        "_first": F.get(found, F.lit(0))["m"],
        "_exact": F.exists(found, lambda x: x["source"].isin(dims.VERIFYING_SOURCES)),
        "_quoted": F.transform(found, lambda x: F.concat(x["source"], F.lit("='"), x["raw_val"], F.lit("'"))),
    })
    first, brands, exact = F.col("_first"), F.col("_brands"), F.col("_exact")
    conflict, none = F.size(brands) > 1, F.size(found) == 0
    maker = F.array_min(F.filter(F.transform(found, lambda x: x["m"]["manufacturer"]),
                                 lambda b: F.coalesce(b, F.lit("")) != ""))
    arrows = F.transform(F.arrays_zip(F.col("_quoted").alias("q"), found.alias("f")),
                         lambda z: F.concat(z["q"], F.lit("->"), z["f"]["m"]["brand"]))
    reason = F.when(none, "no manufacturer or brand signal").when(
        conflict, F.concat(F.lit("several brands: "), F.array_join(F.array_sort(brands), ", "))).otherwise(
        F.concat(F.lit("dictionary match: "), first["signal"]))
    resolution = F.struct(
        F.when(conflict, maker).otherwise(first["manufacturer"]).alias("manufacturer"),
        F.when(~conflict, first["brand"]).alias("brand"),
        F.when(~conflict, first["trade_name"]).alias("trade_name"),
        F.when(none, "Unknown").when(conflict, "Conflicted").when(exact, "Verified").otherwise("Inferred").alias("status"),
        F.when(none, 0.0).when(conflict, 0.40).when(exact, 1.0).otherwise(0.85).alias("confidence"),
        F.when(conflict, arrows).otherwise(F.col("_quoted")).alias("sources"), reason.alias("reason"),
        conflict.alias("is_conflicted"))
    return once(matched, {"resolution": resolution}).drop("_matches", "_brands", "_first", "_exact", "_quoted")


def brand_fields(rows: DataFrame, strict_conflicts: bool = False) -> DataFrame:
    """Add ``manufacturer_name``, ``brand_name`` and ``trade_name``.

    A conflict between columns stands only when the dictionary gives no manufacturer; ``strict_conflicts`` keeps every
    conflict, also where the dictionary would settle it.
    """
    r = F.col("resolution")
    disputed = F.col("brand_conflict") | r["is_conflicted"]
    conflict = disputed if strict_conflicts else disputed & (F.coalesce(r["manufacturer"], F.lit("")) == "")
    resolved = ~conflict & (F.coalesce(r["manufacturer"], F.lit("")) != "") & (F.coalesce(r["brand"], F.lit("")) != "")

    def given(*columns: tuple[str, str]) -> Column:
        return F.array_compact(F.array(*[
            F.when(clean_string(F.col(c)).isNotNull(), F.concat(F.lit(name + "='"), clean_string(F.col(c)), F.lit("'")))
            for name, c in columns]))

    e1, unilog, dib = ("E1_Brand", "e1_brand"), ("Unilog_Brand", "unilog_brand"), ("DIB_Brand", "dib_brand")
    maker, part = ("Part_Manuf", "part_manuf"), ("Mfg_Part_Num", "mfg_part_num")
    decided = once(rows, {"_state": F.when(conflict, "conflict").when(resolved, "resolved").otherwise("unknown")})
    conflict, resolved = F.col("_state") == "conflict", F.col("_state") == "resolved"
    shared = once(decided, {
        "_sources": F.when(conflict, given(e1, unilog, dib, maker)).when(resolved, r["sources"]).otherwise(
            given(maker, e1, dib, part)),
        "_reason": F.when(conflict, F.concat(F.lit("incompatible brands: "), F.array_join("raw_brands", ", "))).when(
            resolved, r["reason"]).otherwise("not in the dictionary; nothing made up"),
        "_trade": F.when(resolved, F.nullif(r["trade_name"], F.lit("")))})
    status = F.when(conflict, "Conflicted").when(resolved, r["status"]).otherwise("Unknown")
    confidence = F.when(conflict, 0.40).when(resolved, r["confidence"]).otherwise(0.0)
    trade, sources, reason = F.col("_trade"), F.col("_sources"), F.col("_reason")
    return once(shared, {
        "manufacturer_name": field(F.when(resolved, r["manufacturer"]), status, confidence, sources, reason),
        "brand_name": field(F.when(resolved, r["brand"]), status, confidence, sources, reason),
        "trade_name": field(
            trade, F.when(trade.isNotNull(), "Verified").otherwise("Unknown"),
            F.when(trade.isNotNull(), 1.0).otherwise(0.0),
            F.when(trade.isNotNull(), r["sources"]).otherwise(no_sources()),
            F.when(conflict, "brand conflict").when(trade.isNotNull(), "from the dictionary").otherwise("not given")),
    }).drop("_state", "_sources", "_reason", "_trade")


# --- names and attributes ---

def part_number_field() -> Column:
    part = strip(F.col("mfg_part_num"))
    filled = F.coalesce(part, F.lit("")) != ""
    return field(F.when(filled, part), F.when(filled, "Verified").otherwise("Unknown"), F.when(filled, 1.0).otherwise(0.0),
                 F.array(F.concat(F.lit("Mfg_Part_Num='"), F.coalesce("mfg_part_num", F.lit("")), F.lit("'"))),
                 F.when(filled, "part number of the input").otherwise("no part number"))


def keyword_name(text: Column, keywords: Sequence[tuple[Sequence[str], str]] = tuple(dims.PRODUCT_KEYWORDS)) -> Column:
    """Name of the first keyword group found in the text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(None).cast("string")
    for words, name in reversed(list(keywords)):
        hit = F.lit(False)
        for word in words:
            hit = hit | low.contains(word)
        out = F.when(hit, name).otherwise(out)
    return out


def _described() -> Column:
    desc = F.coalesce("part_desc", F.lit(""))
    return F.when(desc != "", F.array(F.concat(F.lit("Part_Desc='"), desc, F.lit("'")))).otherwise(no_sources())


def product_name(gold_name: Column) -> Column:
    """Gold name, else a name from keywords, else unknown."""
    gold = F.nullif(gold_name, F.lit(""))
    guess = keyword_name(F.col("part_desc"))
    return field(
        F.coalesce(gold, guess),
        F.when(gold.isNotNull(), "Verified").when(guess.isNotNull(), "Inferred").otherwise("Unknown"),
        F.when(gold.isNotNull(), 1.0).when(guess.isNotNull(), 0.85).otherwise(0.0), _described(),
        F.when(gold.isNotNull(), "gold value").when(guess.isNotNull(), "keyword in the description")
        .otherwise("no known product word"))


def _family(text: Column, label: str, pattern: str, unit: str | None, fixed_dims: bool) -> Column:
    """Triples of the matches of one pattern.

    A pattern with a unit of its own matches plain numbers only, so all but the number is known beforehand.
    """
    if unit is None and fixed_dims:
        pattern = dims.FIXED_DIMENSION_PATTERN
    values = F.regexp_extract_all(text, F.lit("(?i)" + pattern), F.lit(1))
    if unit is not None:
        return F.transform(values, lambda v: number_with_unit(label, v, unit))
    marks = F.regexp_extract_all(text, F.lit("(?i)" + pattern), F.lit(2))
    pairs = F.transform(F.arrays_zip(values.alias("v"), marks.alias("u")), lambda z: F.struct(
        F.lit(label).alias("label"), strip(z["v"]).alias("raw"),
        F.coalesce(F.nullif(strip(z["u"]), F.lit("")), F.lit('"')).alias("uom")))
    return value_unit_statuses(F.filter(pairs, lambda p: ~p["raw"].rlike(r"^\d+$") | (
        p["raw"].try_cast("double") < dims.MAX_PLAIN_DIMENSION)))


def extract_attributes(text: Column, fixed_dims: bool = False) -> Column:
    """Attribute triples found in a text: voltage, amperage, sound level, dimensions, in this order.

    Whole dimensions of 100 and more are taken for ratings and skipped. ``fixed_dims`` also finds inch marks that no
    word character follows. A null text has no attributes.
    """
    return F.concat(*[_family(F.coalesce(text, F.lit("")), label, pattern, unit, fixed_dims)
                      for label, pattern, unit in dims.ATTRIBUTE_PATTERNS])


def last_per_part(rows: DataFrame, order: str = "row_id") -> DataFrame:
    """Rows by lower-case part number, the last one kept; rows without a number are left out."""
    key = F.lower(strip(F.col("mfg_part_num")))
    rest = [c for c in rows.columns]
    return rows.withColumn("part_key", key).filter(F.coalesce("part_key", F.lit("")) != "").groupBy("part_key").agg(
        F.max_by(F.struct(*rest), order).alias("r")).select("part_key", "r.*")


def join_gold(rows: DataFrame, gold: DataFrame, attributes: DataFrame | None = None) -> DataFrame:
    """Add gold name, classpath, long description and attribute list by part number.

    Gold keeps the last row of a part number. Hot part numbers and rows without one are spread over tasks.
    """
    names = {"expected_product_name": "gold_name", "expected_classpath": "gold_classpath",
             "expected_long_desc": "gold_long_desc"}
    right = last_per_part(gold).select("part_key", F.col("row_id").alias("_gold_row"),
                                       *[F.col(c).alias(n) for c, n in names.items()])
    empty = F.array().cast("array<struct<ordinal:int,label:string,value:string,uom:string>>")
    if attributes is None:
        right = right.withColumn("gold_attributes", empty)
    else:
        # At most MAX_TRIPLES entries per gold row.
        lists = attributes.groupBy(F.col("row_id").alias("_gold_row")).agg(
            F.array_sort(F.collect_list(F.struct("ordinal", "label", "value", "uom"))).alias("gold_attributes"))
        right = right.join(lists, "_gold_row", "left")
    keyed = rows.withColumn("part_key", F.nullif(F.lower(strip(F.col("mfg_part_num"))), F.lit("")))
    return join_spread(keyed, right.drop("_gold_row"), ["part_key"], spread=["row_id"]).drop("part_key")


def merge_gold_attributes(rows: DataFrame, extracted: str = "_extracted", gold: str = "gold_attributes") -> DataFrame:
    """Add ``attributes``: extracted triples, then gold ones whose label has not been seen, each normalised.

    A gold label counts as seen once an earlier gold entry has added it.
    """
    labelled = once(rows, {"_have": F.transform(extracted, lambda a: F.lower(a["label"])),
                           "_labels": F.transform(gold, lambda g: F.lower(g["label"]))})
    # One flag per gold entry: first of its label, and not among the extracted ones.
    new = F.filter(F.arrays_zip(F.col(gold).alias("g"), F.col("_labels").alias("low")), lambda z, i: (
        F.array_position(F.col("_labels"), z["low"]) == i + 1) & ~F.array_contains(F.col("_have"), z["low"]))
    added = F.transform(new, lambda z: F.struct(z["g"]["label"].alias("label"), z["g"]["value"].alias("raw"),
                                                z["g"]["uom"].alias("uom")))
    has_gold = F.coalesce(F.size(gold), F.lit(0)) > 0
    return once(labelled, {"attributes": F.when(has_gold, F.concat(extracted, value_unit_statuses(added))).otherwise(
        F.col(extracted))}).drop("_have", "_labels")


def short_description() -> Column:
    """Brand, part number and product name joined; nothing stands for a missing part."""
    part = F.nullif(strip(F.col("mfg_part_num")), F.lit(""))
    brand, name = F.nullif(F.col("brand_name.value"), F.lit("")), F.nullif(F.col("product_name.value"), F.lit(""))
    text = F.nullif(F.concat_ws(" ", brand, part, name), F.lit(""))
    verified = (F.col("brand_name.status") == "Verified") & (F.col("product_name.status") == "Verified")
    return field(text, F.when(verified, "Verified").when(text.isNotNull(), "Inferred").otherwise("Unknown"),
                 F.when(verified, 0.95).when(text.isNotNull(), 0.80).otherwise(0.0),
                 F.array(F.lit("brand + part number + product name")),
                 F.when(text.isNotNull(), "joined from its parts").otherwise("no parts to join"))


def gold_field(value: Column) -> Column:
    """Gold value, verified, or unknown."""
    text = F.nullif(value, F.lit(""))
    return field(text, F.when(text.isNotNull(), "Verified").otherwise("Unknown"),
                 F.when(text.isNotNull(), 1.0).otherwise(0.0), no_sources(), "")


def overall_tier() -> Column:
    """Struct of status and confidence: conflicted, both verified, any inferred, unknown."""
    maker, brand = F.col("manufacturer_name.status"), F.col("brand_name.status")
    conflict = (maker == "Conflicted") | (brand == "Conflicted")
    verified = (maker == "Verified") & (brand == "Verified")
    inferred = (maker == "Inferred") | (brand == "Inferred") | F.exists("attributes", lambda a: a["status"] == "Inferred")
    return F.struct(
        F.when(conflict, "Conflicted").when(verified, "Verified").when(inferred, "Inferred").otherwise("Unknown")
        .alias("status"),
        F.when(conflict, 0.40).when(verified, 1.0).when(inferred, 0.85).otherwise(0.0).alias("confidence"))


def enrich_catalog(rows: DataFrame, dictionary: DataFrame, gold: DataFrame | None = None,
                   gold_attrs: DataFrame | None = None, strict_conflicts: bool = False, fixed_dims: bool = False,
                   inline_bytes: int = INLINE_BYTES) -> DataFrame:
    """Enriched catalog: one row per input row, all fields with status and provenance.

    Without ``gold`` names come from keywords only, so an evaluation against gold is free of leaks.
    """
    if gold is not None:
        base = join_gold(rows, gold, gold_attrs)
    else:
        base = rows.withColumns({c: F.lit(None).cast("string") for c in ("gold_name", "gold_classpath", "gold_long_desc")})
    branded = brand_fields(resolve_brand(brand_signals(base), dictionary, inline_bytes), strict_conflicts)
    named = once(branded, {
        "manufacturer_part_number": part_number_field(),
        "product_name": product_name(F.col("gold_name")),
        "classpath": gold_field(F.col("gold_classpath")),
        "long_desc": gold_field(F.col("gold_long_desc")),
        "series": field(F.lit(None), "Unknown", 0.0, no_sources(), ""),
        "_extracted": extract_attributes(F.col("part_desc"), fixed_dims),
    })
    merged = merge_gold_attributes(named) if gold is not None else named.withColumnRenamed("_extracted", "attributes")
    full = once(merged, {"short_desc": short_description(), "_tier": overall_tier()})
    conflict = F.col("_tier.status") == "Conflicted"
    return full.select(
        "row_id", "mfg_part_num", "part_desc", "e1_brand", "unilog_brand", "dib_brand", "part_manuf", "raw_brands",
        "brand_conflict", "manufacturer_name", "brand_name", "trade_name", "manufacturer_part_number", "product_name",
        "series", "classpath", "attributes", "short_desc", "long_desc",
        F.col("_tier.status").alias("overall_trust_status"), F.col("_tier.confidence").alias("overall_confidence"),
        conflict.alias("has_conflicts"),
        F.when(conflict, F.array(F.struct(F.lit("brand_name").alias("field"), F.col("brand_name.sources").alias("sources"),
                                          F.col("brand_name.reason").alias("reason")))).otherwise(
            F.array().cast("array<struct<field:string,sources:array<string>,reason:string>>")).alias("unresolved_conflicts"))


def catalog_attributes(enriched: DataFrame) -> DataFrame:
    """Attribute triples as rows, 1-based ordinal."""
    return enriched.select("row_id", F.posexplode("attributes").alias("i", "a")).select(
        "row_id", (F.col("i") + 1).alias("ordinal"), "a.*")


# --- dictionaries from gold data ---

def distinct_uoms(gold_attrs: DataFrame) -> DataFrame:
    """Units used in gold attributes, with their count and the columns they came from."""
    return gold_attrs.filter(F.col("uom").isNotNull()).groupBy("uom").agg(
        F.count(F.lit(1)).alias("n_used"),
        F.array_sort(F.collect_set(F.concat(F.lit("ATTRIBUTE_UOM "), F.col("ordinal").cast("string")))).alias("columns"))


def build_brand_dictionary(gold: DataFrame, rows: DataFrame) -> DataFrame:
    """Brand dictionary from gold rows and the input rows with the same part number.

    ``rows`` hold raw texts. Each distinct (manufacturer, brand, trade name) collects its signals: part number, supplier
    and brand texts that are no placeholder. Entries are in order of the first gold row.
    """
    def kept(c: Column) -> Column:
        text = strip(c)
        return F.when((F.coalesce(text, F.lit("")) != "") & ~text.startswith("--") & (text != "-"), text)

    raw = rows.withColumn("part_key", strip(F.col("mfg_part_num"))).filter(F.coalesce("part_key", F.lit("")) != "")
    inputs = raw.groupBy("part_key").agg(F.max_by(F.struct(
        "part_manuf", "e1_brand", "unilog_brand", "dib_brand"), "row_id").alias("i"))
    keyed = gold.withColumn("part_key", F.nullif(strip(F.col("mfg_part_num")), F.lit("")))
    own = strip(F.col("raw_manuf"))
    joined = keyed.join(inputs, "part_key", "left").select(
        "row_id", "part_key",
        F.coalesce(strip(F.col("expected_manufacturer")), F.lit("")).alias("canonical_manufacturer"),
        F.coalesce(strip(F.col("expected_brand")), F.lit("")).alias("canonical_brand"),
        F.coalesce(strip(F.col("expected_trade_name")), F.lit("")).alias("trade_name"),
        F.array_compact(F.array(
            F.when((F.coalesce(own, F.lit("")) != "") & ~own.startswith("--"), own),
            *[kept(F.col(f"i.{c}")) for c in ("part_manuf", "e1_brand", "unilog_brand", "dib_brand")],
            F.col("part_key"))).alias("signals"))
    key = ["canonical_manufacturer", "canonical_brand", "trade_name"]
    # A brand may have any number of signals, so the dictionary stays one row per signal.
    signal = joined.select(*key, F.explode("signals").alias("signal"), "part_key").groupBy(*key, "signal").agg(
        F.max(F.coalesce(F.col("signal") == F.col("part_key"), F.lit(False))).alias("is_part_number"))
    first = joined.groupBy(*key).agg(F.min("row_id").alias("entry_pos"))
    return join_spread(signal, first, key, spread=["signal"], how="inner").select(
        "entry_pos", F.lit(0).alias("signal_pos"), "signal", "is_part_number", *key)


def scalar_lookup(values: DataFrame, text: str, table: dict[str, str | float]) -> DataFrame:
    """Look up a text column in a small fixed dictionary (units, fractions)."""
    return values.withColumn("result", literal_map(F.lower(strip(F.col(text))), table))
