"""Wide rows, extracted table cells and page text to evidence."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from specledger import dims
from specledger.functions.text import blank_to_null, literal_map, strip
from specledger.functions.values import first_number
from specledger.operators.skew import join_spread
from specledger.schema import EVIDENCE, conform

CONTEXT_LENGTH = 300


def melt_wide_csv(df: DataFrame, source_id: str = "csv", id_col: str = "product_id", row_col: str = "row",
                  aliases: Mapping[str, str] = dims.CSV_ALIASES, units: Mapping[str, str] = dims.CSV_UNITS,
                  identity: Sequence[str] = tuple(dims.IDENTITY_COLUMNS), source_rank: int = 1) -> DataFrame:
    """One fact per filled cell of a wide table.

    Rows without an id and blank cells give nothing; an unknown column keeps its name with a lower confidence.
    ``row_col`` holds the row number.
    """
    columns = [c for c in df.columns if c != row_col]
    text = {c: F.col(f"`{c}`").cast("string") for c in columns}
    context = F.left(F.concat_ws("; ", *[
        F.when(blank_to_null(text[c]).isNotNull(), F.concat(F.lit(c + "="), text[c])) for c in columns if c != id_col
    ]), F.lit(CONTEXT_LENGTH))
    cells = F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(c).alias("column"), F.lit(aliases.get(c, c)).alias("attribute"),
                 blank_to_null(text[c]).alias("raw_value"),
                 F.lit(0.85 if c in aliases else 0.60).alias("confidence"))
        for i, c in enumerate(columns) if c not in identity
    ])
    rows = df.select(strip(text[id_col]).alias("product_id"), F.col(row_col).cast("long").alias("row"),
                     context.alias("evidence_text"), F.explode(cells).alias("c"))
    facts = rows.filter((F.col("product_id") != "") & F.col("c.raw_value").isNotNull()).select(
        "product_id", "row", "evidence_text", F.col("c.column").alias("column"),
        F.col("c.attribute").alias("attribute"), F.col("c.raw_value").alias("raw_value"),
        first_number(F.col("c.raw_value")).alias("value"),
        literal_map(F.col("c.attribute"), units).alias("unit"),
        F.col("c.confidence").alias("confidence"),
        F.lit(source_id).alias("source_id"), F.lit("csv").alias("source_type"), F.lit("column").alias("method"),
        F.lit(source_rank).alias("source_rank"),
        (F.col("row") * len(columns) + F.col("c.i")).alias("pos"),
    )
    return conform(facts, EVIDENCE)


def entity_keys(manifest: DataFrame) -> DataFrame:
    """Power and poles encoded at the end of an id like ``X-Y-4P-1.1``; other ids are left out."""
    parts = F.split(F.col("product_id"), "-")
    return manifest.select(
        "product_id", "manifest_pos",
        F.element_at(parts, -1).try_cast("double").alias("id_power"),
        F.replace(F.try_element_at(parts, F.lit(-2)), F.lit("P"), F.lit("")).try_cast("int").alias("id_poles"),
        F.size(parts).alias("_n"),
    ).filter((F.col("_n") >= 4) & F.col("id_power").isNotNull() & F.col("id_poles").isNotNull()).drop("_n")


def match_entity(rows: DataFrame, manifest: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Add ``product_id``: first manifest id whose power is within the tolerance and whose poles agree, if known.

    Distinct (power, poles) pairs are matched, not rows. Ids are placed in bins two tolerances wide and repeated for
    the neighbour bins, so the range match is an equi-join. ``rows`` has ``power``, ``poles`` and ``row_key``.
    """
    width = 2 * tolerance
    pairs = rows.select("power", "poles").distinct().filter(F.col("power").isNotNull())
    # -1 stands for unknown poles, so both joins below stay on plain keys.
    pairs = pairs.withColumn("_bin", F.floor(F.col("power") / width))
    # Of the ids with one power and number of poles only the first can be a match.
    keys = entity_keys(manifest).groupBy("id_power", "id_poles").agg(F.min(F.struct("manifest_pos", "product_id")).alias("m"))
    ids = keys.select("id_power", "id_poles", "m.*").withColumn(
        "_bin", F.explode(F.array(*[F.floor(F.col("id_power") / width) + d for d in (-1, 0, 1)])))
    hit = (F.abs(F.col("power") - F.col("id_power")) < tolerance) & (
        F.col("poles").isNull() | (F.col("poles") == F.col("id_poles")))
    matched = pairs.join(ids, "_bin").filter(hit).groupBy(
        "power", F.coalesce(F.col("poles"), F.lit(-1)).alias("_poles")
    ).agg(F.min(F.struct("manifest_pos", "product_id"))["product_id"].alias("product_id"))
    keyed = rows.withColumn("_poles", F.coalesce(F.col("poles"), F.lit(-1)))
    return join_spread(keyed, matched, ["power", "_poles"], spread=["row_key"]).drop("_poles")


def grid_to_evidence(cells: DataFrame, manifest: DataFrame | None = None, source_id: str = "pdf",
                     columns: Sequence[tuple[str, str | None]] = tuple(dims.GRID_COLUMNS),
                     key_limit: float = dims.GRID_KEY_LIMIT, source_rank: int = 0) -> DataFrame:
    """Facts from extracted table rows by column position.

    ``cells`` has ``page, table_no, row_no, poles, cells``. A data row has a first cell that reads as a number up to
    ``key_limit``. Rows without a manifest match get an id made of page and first cell.
    """
    first = F.coalesce(strip(F.get(F.col("cells"), F.lit(0))), F.lit(""))
    rows = cells.select(
        "page", "table_no", "row_no", F.col("poles").cast("int").alias("poles"),
        F.transform("cells", lambda c: F.coalesce(strip(c), F.lit(""))).alias("cells"),
        first.alias("first_cell"), first_number(first, comma_decimal=True).alias("power"),
        F.concat_ws(":", "page", "table_no", "row_no").alias("row_key"),
    ).filter(F.col("power") <= key_limit)
    own_id = F.concat(F.lit("PDF-P"), F.col("page").cast("string"), F.lit("-kW"), F.col("first_cell"))
    if manifest is None:
        rows = rows.withColumn("product_id", own_id)
    else:
        rows = match_entity(rows, manifest).withColumn("product_id", F.coalesce(F.col("product_id"), own_id))
    names = F.array(*[F.lit(a) for a, _ in columns])
    units = F.array(*[F.lit(u).cast("string") for _, u in columns])
    context = F.concat_ws(" | ", F.filter(
        F.transform("cells", lambda c, i: F.when(c != "", F.concat(F.lit("col"), i.cast("string"), F.lit("="), c))),
        lambda x: x.isNotNull()))
    poles = F.coalesce(F.concat(F.nullif("poles", F.lit(0)).cast("string"), F.lit("-pole")), F.lit("unknown-pole"))
    facts = rows.select(
        "product_id", "page", "table_no", "row_no",
        F.concat(F.lit("p."), F.col("page").cast("string"), F.lit(", "), poles,
                 F.lit(" electrical data table")).alias("section"),
        F.left(context, F.lit(CONTEXT_LENGTH)).alias("evidence_text"),
        F.posexplode(F.slice("cells", 1, len(columns))).alias("i", "raw_value"),
    ).filter(F.col("raw_value") != "")
    order = ((F.col("page").cast("long") * 1000 + F.col("table_no")) * 1_000_000 + F.col("row_no")) * len(columns) + F.col("i")
    return conform(facts.select(
        "product_id", "page", "section", "evidence_text", "raw_value",
        F.get(names, F.col("i")).alias("attribute"), F.get(units, F.col("i")).alias("unit"),
        first_number(F.col("raw_value"), comma_decimal=True).alias("value"),
        F.lit(source_id).alias("source_id"), F.lit("pdf").alias("source_type"), F.lit("table").alias("method"),
        F.lit(0.92).alias("confidence"), F.lit(source_rank).alias("source_rank"), order.cast("long").alias("pos"),
    ), EVIDENCE)


def page_constants(pages: DataFrame, constants: Sequence[tuple[str, str, str]] = tuple(dims.PAGE_CONSTANTS),
                   gate: Sequence[str] = tuple(dims.PAGE_GATE), source_id: str = "pdf",
                   span: int = 40) -> DataFrame:
    """Facts for ``GLOBAL`` from constants stated in page text (``page, text``), with nearby text.

    Only pages holding every gate word are searched; one fact per page and constant.
    """
    for word in gate:
        pages = pages.filter(F.col("text").contains(word))
    text = F.col("text")
    found = []
    for i, (attribute, value, unit) in enumerate(constants):
        pattern = rf"(?i)\b{re.escape(value)}\s*{re.escape(unit)}\b"
        start = F.regexp_instr(text, F.lit(pattern)) - 1
        begin = F.greatest(F.lit(0), start - span)
        end = F.least(F.length(text), start + F.length(F.regexp_extract(text, pattern, 0)) + span)
        context = F.substring(text, begin + 1, end - begin)
        found.append(F.when(start >= 0, F.struct(
            F.lit(i).alias("i"), F.lit(attribute).alias("attribute"), F.lit(value).alias("raw_value"),
            F.lit(unit).alias("unit"), F.left(strip(F.replace(context, F.lit("\n"), F.lit(" "))),
                                              F.lit(CONTEXT_LENGTH)).alias("evidence_text"))))
    facts = pages.select("page", F.explode(F.array_compact(F.array(*found))).alias("c"))
    return conform(facts.select(
        "page", "c.attribute", "c.raw_value", "c.unit", "c.evidence_text",
        first_number(F.col("c.raw_value")).alias("value"),
        F.lit(dims.GLOBAL_ID).alias("product_id"), F.lit(source_id).alias("source_id"),
        F.lit("pdf").alias("source_type"), F.lit("text").alias("method"), F.lit(0.80).alias("confidence"),
        F.concat(F.lit("p."), F.col("page").cast("string"), F.lit(" page-level text")).alias("section"),
        F.lit(dims.GLOBAL_RANK).alias("source_rank"),
        (F.col("page").cast("long") * len(constants) + F.col("c.i")).alias("pos"),
    ), EVIDENCE)
