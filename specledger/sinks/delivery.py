"""Fixed-header export and stored documents."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from specledger import dims
from specledger.operators.normalize import SUCCESS


def delivery_columns() -> dict[str, Column]:
    """Export expression of each header that is not an attribute."""
    def text(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(""))

    return {
        "Mfg_Part_Num": text("mfg_part_num"),
        "Part_Desc": text("part_desc"),
        "Part_Manuf": text("part_manuf"),
        "E1_Brand": text("e1_brand"),
        "Unilog_Brand": text("unilog_brand"),
        "DIB_Brand": text("dib_brand"),
        "MANUFACTURER_NAME": text("manufacturer_name.value"),
        "BRAND_NAME": text("brand_name.value"),
        "TRADE_NAME": text("trade_name.value"),
        "MANUFACTURER_PART_NUMBER": F.coalesce("manufacturer_part_number.value", "mfg_part_num", F.lit("")),
        "Product Name": text("product_name.value"),
        "Classpath": text("classpath.value"),
        "SERIES": text("series.value"),
        "SHORT_DESCRIPTION": text("short_desc.value"),
        "LONG_DESCRIPTION": text("long_desc.value"),
    }


def number_text(value: Column) -> Column:
    """Shortest decimal text with at least one decimal."""
    return value.cast("string")


def spread_triples(n: int = dims.MAX_TRIPLES) -> dict[str, Column]:
    """Export expressions of the first ``n`` attribute triples, under spaced and underscored header names."""
    out = {}
    for i in range(1, n + 1):
        a = F.get(F.col("attributes"), F.lit(i - 1))
        parts = {"LABEL": a["label"], "VALUE": F.coalesce(number_text(a["value_num"]), a["value_str"]), "UOM": a["uom"]}
        for kind, value in parts.items():
            column = F.coalesce(value, F.lit(""))
            out[f"ATTRIBUTE_{kind} {i}"] = column
            out[f"ATTRIBUTE_{kind}_{i}"] = column
    return out


def to_delivery(enriched: DataFrame, headers: Sequence[str], extra: Mapping[str, Column] | None = None) -> DataFrame:
    """One text column per header, in order; a header without a mapping stays empty."""
    known = {**delivery_columns(), **spread_triples(), **(extra or {})}
    names = [h.strip() for h in headers]
    return enriched.select(*[
        (_once(names, h, known) if h in known else F.lit("")).alias(h) for h in names])


def _once(headers: Sequence[str], header: str, known: Mapping[str, Column]) -> Column:
    """An underscored attribute header is used only where the spaced one is absent."""
    spaced = " ".join(header.rsplit("_", 1))
    if header.startswith("ATTRIBUTE_") and " " not in header and spaced in headers:
        return F.lit("")
    return known[header]


def delivery_coverage(delivery: DataFrame) -> DataFrame:
    """Filled cells of each header, in one pass over the export."""
    headers = delivery.columns
    counts = delivery.agg(F.count(F.lit(1)).alias("n_rows"), *[
        F.count_if(F.col(f"`{h}`") != "").alias(f"c{i}") for i, h in enumerate(headers)])
    cells = F.array(*[F.struct(F.lit(i).alias("header_no"), F.lit(h).alias("header"), F.col(f"c{i}").alias("n_filled"))
                      for i, h in enumerate(headers)])
    return counts.select("n_rows", F.inline(cells)).withColumn("is_blank", F.col("n_filled") == 0)


def unmapped_headers(headers: Sequence[str]) -> list[str]:
    """Headers that no expression fills."""
    known = {**delivery_columns(), **spread_triples()}
    return [h for h in headers if h.strip() not in known]


def write_delivery_csv(delivery: DataFrame, path: str, mode: str = "errorifexists") -> None:
    delivery.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').option(
        "emptyValue", "").csv(path)


LINE_ENTRIES = 200
FACT_PLACE = ["source_id", "source_type", "method", "page", "row", "column", "url", "section"]


def _fact_entry(*extra: Column) -> Column:
    return F.struct("attribute", "raw_value", "value", "unit", *extra, *[F.col(f"`{c}`") for c in FACT_PLACE])


def _lines(rows: DataFrame, section: str, entry: Column) -> DataFrame:
    """The entries of a section as lines of at most ``LINE_ENTRIES``: a product with very many facts is many lines, never one row.

    Rows are dealt to lines by their number within their task, so no row has to know how many others its product has.
    """
    dealt = rows.select("product_id", F.floor(F.monotonically_increasing_id() / LINE_ENTRIES).alias("line"), entry.alias("e"))
    gathered = dealt.groupBy("product_id", "line").agg(F.sort_array(F.collect_list("e")).alias("entries"))
    return gathered.select("product_id", F.lit(section).alias("section"), F.to_json(F.struct("product_id", F.lit(section).alias("section"), "entries")).alias("document"))


def product_documents(fields: DataFrame, products: DataFrame, normalized: DataFrame, pairs: DataFrame, unmapped: DataFrame) -> DataFrame:
    """The documents of all products: ``product_id``, ``section``, ``document`` (JSON).

    A product has one line ``product`` with its identity and fields, and lines of bounded size with its ``refs`` (all facts of its fields), ``conflicts``,
    ``issues`` (facts that gave no value) and ``unmapped`` facts.
    """
    entry = F.struct("field_pos", F.col("canonical_field").alias("field"), "canonical_unit", "outcome", "value_num",
                     "value_str", "confidence", "n_refs", "source_types", "note")
    # At most one entry per canonical field.
    nested = fields.groupBy("product_id").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    head = products.select("product_id", "manufacturer", "model").join(nested, "product_id").select(
        "product_id", F.lit("product").alias("section"),
        F.to_json(F.struct("product_id", F.lit("product").alias("section"), "manufacturer", "model", "entries")).alias("document"))
    field = F.col("canonical_field").alias("field")
    side = [F.col(c) for c in ("value_a", "text_a", "unit_a", "value_b", "text_b", "unit_b")]
    refs = _lines(normalized, "refs", F.struct(field, "outcome", "value_num", "value_str", _fact_entry().alias("fact")))
    conflicts = _lines(pairs, "conflicts", F.struct(field, *side, "ref_a", "ref_b", "n_copies"))
    issues = _lines(normalized.filter(~F.col("outcome").isin(SUCCESS)), "issues", F.struct(field, "outcome", _fact_entry().alias("fact")))
    return reduce(DataFrame.unionByName, [head, refs, conflicts, issues, _lines(unmapped, "unmapped", _fact_entry())])


def catalog_documents(enriched: DataFrame) -> DataFrame:
    """One JSON document per catalog row."""
    return enriched.select("row_id", F.to_json(F.struct(*enriched.columns)).alias("document"))


def write_products(documents: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines, one document per line, as many files as there are tasks.

    Names and places repeat from entry to entry, so the files are packed: plain, the documents of all facts are larger than all tables behind them together.
    """
    documents.select(F.col("document").alias("value")).write.mode(mode).option("compression", "gzip").text(path)


def write_report(report: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A one-row batch report as a single JSON line."""
    report.limit(1).write.mode(mode).json(path)
