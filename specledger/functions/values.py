"""Parsing of raw value text. A value that cannot be read gives an error, never a guess."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

from specledger import dims
from specledger.functions.text import blank_to_null, literal_map, strip

# --- fixed values: patterns of raw values ---
NUMBER_WITH_UNIT = r"^([+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)\s*([a-zA-Z%°()./\-]*)$"
FIRST_NUMBER = r"([-+]?\d+\.?\d*)"
PLAIN_FLOAT = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"


def _group(col: Column, pattern: str, n: int = 1) -> Column:
    """Group ``n`` of the first match, null without a match."""
    return F.nullif(F.regexp_extract(col, pattern, n), F.lit(""))


def first_number(col: Column, comma_decimal: bool = False) -> Column:
    """First number found in the text, or null."""
    text = F.replace(col, F.lit(","), F.lit(".")) if comma_decimal else col
    return _group(text, FIRST_NUMBER).try_cast("double")


def number_of(col: Column) -> Column:
    """Number of ``number [unit]`` text, else null."""
    return _group(strip(col), NUMBER_WITH_UNIT).try_cast("double")


def unit_of(col: Column) -> Column:
    """Unit of ``number [unit]`` text, else null."""
    return _group(strip(col), NUMBER_WITH_UNIT, 2)


def parse_numeric(col: Column) -> Column:
    """Struct of number, unit and error for ``number [unit]`` text."""
    text = strip(col)
    num = number_of(col)
    error = F.when(col.isNull(), "no text").when(text == "", "empty text").when(
        num.isNull(), F.concat(F.lit("not a number: "), col))
    return F.struct(num.alias("num"), unit_of(col).alias("unit"), error.alias("error"))


def parse_ip_rating(col: Column) -> Column:
    """``IP56`` from text holding an IP code or from two or three bare digits; other text stays as it is."""
    text = strip(col)
    code = F.coalesce(_group(text, r"(?i)IP\s*(\d{2,3})"), _group(text, r"^(\d{2,3})$"))
    return F.coalesce(F.concat(F.lit("IP"), code), text)


def parse_frame_size(col: Column) -> Column:
    return blank_to_null(col)


def parse_string_field(col: Column) -> Column:
    """Struct of text and error; blank text is an error."""
    text = blank_to_null(col)
    return F.struct(text.alias("text"), F.when(text.isNull(), "empty text").alias("error"))


def parse_poles(col: Column) -> Column:
    """Leading integer of ``4``, ``4 poles`` or ``4-pole``."""
    return _group(strip(col), r"^(\d+)").try_cast("int")


def parse_phase(col: Column) -> Column:
    """Integer, or 3 for text naming three phases."""
    text = strip(col)
    return F.coalesce(_group(text, r"^([+-]?\d+)$").try_cast("int"), F.when(text.rlike(r"(?i)3|three"), 3))


def pole_from_text(col: Column) -> Column:
    """Pole count from a Roman or plain number before "pole"."""
    out = _group(col, r"(?i)(\d+)\s*pole").try_cast("int")
    for mark, poles in reversed(dims.ROMAN_POLES):
        out = F.when(col.rlike(rf"(?i)\b{mark}\s*pol"), poles).otherwise(out)
    return out


def parse_fraction(col: Column, table: Mapping[str, float] | None = None) -> Column:
    """Inches from ``1/2``, ``1-1/2``, ``7 1/4`` or plain numbers; a zero denominator gives null.

    ``table`` may give other values for known texts; the standard table (see ``dims.fractions``) agrees with the
    quotient to the last of its six places, so it needs no look-up.
    """
    text = strip(F.translate(col, "\"'", ""))
    pattern = r"^(?:(\d+)[\s\-]+)?(\d+)/(\d+)$"
    quotient = _group(text, pattern, 2).try_cast("double") / F.nullif(_group(text, pattern, 3).try_cast("double"), F.lit(0.0))
    whole = F.coalesce(_group(text, pattern, 1).try_cast("double"), F.lit(0.0))
    number = F.when(F.contains(text, F.lit("/")), F.round(whole + quotient, 6)).when(
        text.rlike(PLAIN_FLOAT), text.try_cast("double"))
    return F.coalesce(literal_map(text, table), number) if table else number
