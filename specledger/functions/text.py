"""Text helpers: trimming, placeholders, labels and display names."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from specledger import dims

_BLANKS = " \t\r\n\x0b\x0c"


def strip(col: Column) -> Column:
    """Trim every kind of white space at both ends."""
    return F.trim(col, F.lit(_BLANKS))


def blank_to_null(col: Column) -> Column:
    return F.nullif(strip(col), F.lit(""))


def lookup(col: Column, groups: Mapping[str, Sequence[str]]) -> Column:
    """Key to group name for a small fixed table; null for unknown keys."""
    return literal_map(col, {key: name for name, keys in groups.items() for key in keys})


def literal_map(col: Column, table: Mapping[str, str | float | int]) -> Column:
    """Value of a small fixed table by key; null for unknown keys.

    The table is written as one JSON literal, which the optimiser folds to a map before execution: far fewer calls to the
    JVM than one literal per entry.
    """
    kinds = {type(v) for v in table.values()}
    kind = "string" if str in kinds else "double" if float in kinds else "int"
    return F.element_at(F.from_json(F.lit(json.dumps(dict(table))), f"map<string,{kind}>"), col)


def is_placeholder(col: Column, tokens: Sequence[str] = tuple(dims.PLACEHOLDERS)) -> Column:
    """Null, a known token in any case, or anything between double hyphens."""
    known = "|".join(re.escape(t) for t in tokens)
    return col.isNull() | strip(col).rlike(f"(?is)^(?:-{{2,3}}|--.*--|{known})$")


def clean_string(col: Column, tokens: Sequence[str] = tuple(dims.PLACEHOLDERS)) -> Column:
    """Trimmed text, or null for a placeholder."""
    return F.when(~is_placeholder(col, tokens), strip(col))


def strip_supplier_code(col: Column) -> Column:
    """Drop a trailing ``(code)``; null when nothing is left."""
    return blank_to_null(F.regexp_replace(col, r"\s*\([^)]*\)\s*$", ""))


def evidence_label(source_type: Column, page: Column, row: Column, attribute: Column) -> Column:
    """``pdf:p.5 (attr)`` or ``csv:row.3 (attr)``."""
    place = F.when(page.isNotNull(), F.concat(F.lit(":p."), page.cast("string"))).when(
        row.isNotNull(), F.concat(F.lit(":row."), row.cast("string"))).otherwise(F.lit(""))
    name = F.when(F.coalesce(attribute, F.lit("")) != "", F.concat(F.lit(" ("), attribute, F.lit(")"))).otherwise("")
    return F.concat(source_type, place, name)


def source_display(source_type: Column) -> Column:
    kind = F.lower(F.coalesce(source_type, F.lit("pdf")))
    return F.when(kind == "pdf", "PDF Brochure (Official)").when(
        kind == "csv", "Legacy CSV (ERP Database)").otherwise(F.concat(F.upper(kind), F.lit(" Catalog")))


def location_text(section: Column, page: Column, row: Column, column: Column, url: Column) -> Column:
    """First place known for a fact: section, page, row and column, address."""
    in_column = F.when(F.coalesce(column, F.lit("")) != "", F.concat(F.lit(" ("), column, F.lit(")"))).otherwise("")
    return F.coalesce(
        F.nullif(section, F.lit("")),
        F.when(page != 0, F.concat(F.lit("Page "), page.cast("string"), F.lit(" (Table)"))),
        F.when(row != 0, F.concat(F.lit("Row "), row.cast("string"), in_column)),
        F.nullif(url, F.lit("")),
    )


def display_tier(status: Column) -> Column:
    return F.coalesce(lookup(F.upper(F.coalesce(status, F.lit(""))), dims.DISPLAY_TIERS), F.lit("Unknown"))


def range_condition(low: Column, high: Column, strict: Column | None = None) -> Column:
    """``> 0.0 and <= 100.0``, one bound alone, or ``any``."""
    op = F.when(F.coalesce(strict, F.lit(False)), ">").otherwise(">=") if strict is not None else F.lit(">=")
    return F.coalesce(
        F.nullif(F.concat_ws(
            " and ",
            F.when(low.isNotNull(), F.concat(op, F.lit(" "), low.cast("string"))),
            F.when(high.isNotNull(), F.concat(F.lit("<= "), high.cast("string"))),
        ), F.lit("")),
        F.lit("any"),
    )
