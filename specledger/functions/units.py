"""Unit tokens and conversion to canonical units."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from specledger import dims
from specledger.functions.text import blank_to_null, literal_map, lookup, strip
from specledger.functions.values import parse_fraction

Spellings = Mapping[str, Sequence[str]]


def unit_token(col: Column, spellings: Spellings = dims.UNIT_SPELLINGS) -> Column:
    """Token of a unit spelling; null for blank and for unknown text."""
    return lookup(F.lower(strip(col)), spellings)


def unit_error(col: Column, spellings: Spellings = dims.UNIT_SPELLINGS) -> Column:
    """Error text for a unit that is neither blank nor known."""
    return F.when(blank_to_null(col).isNotNull() & unit_token(col, spellings).isNull(),
                  F.concat(F.lit("unknown unit: "), col))


def _result(value: Column, unit: str | None, error: Column) -> Column:
    return F.struct(
        F.when(error.isNull(), value).alias("value"),
        F.when(error.isNull(), F.lit(unit)).cast("string").alias("unit"),
        error.cast("string").alias("error"),
    )


def _scaled(value: Column, unit: Column, factors: Mapping[str, float], canonical: str) -> Column:
    """Value times the factor of its unit; an absent unit counts as canonical, a blank one does not."""
    token = F.when(F.coalesce(unit, F.lit("")) == "", canonical).otherwise(unit_token(unit))
    factor = literal_map(token, factors)
    error = F.when(factor.isNull(), F.concat(F.lit("no conversion to " + canonical + " from: "), unit))
    return _result(F.round(value * factor, 6), canonical, error)


def convert_power(value: Column, unit: Column) -> Column:
    return _scaled(value, unit, dims.POWER_FACTORS, "kW")


def convert_mass(value: Column, unit: Column) -> Column:
    return _scaled(value, unit, dims.MASS_FACTORS, "kg")


def normalize_efficiency(value: Column, unit: Column) -> Column:
    """Percent: values above the fraction limit, or given in percent, are kept; others are fractions."""
    keep = (F.coalesce(unit_token(unit), F.lit("")) == "%") | (value > dims.FRACTION_LIMIT)
    return _result(F.round(F.when(keep, value).otherwise(value * 100.0), 6), "%", unit_error(unit))


def normalize_power_factor(value: Column, unit: Column) -> Column:
    """Fraction: a value above the fraction limit given in percent is divided by 100."""
    percent = (F.coalesce(unit_token(unit), F.lit("")) == "%") & (value > dims.FRACTION_LIMIT)
    return _result(F.round(F.when(percent, value / 100.0).otherwise(value), 6), None, unit_error(unit))


def passthrough_unit(value: Column, unit: Column, canonical: str) -> Column:
    """No conversion: the unit must be absent or spell the canonical one."""
    bad = unit.isNotNull() & ~F.coalesce(unit_token(unit) == canonical, F.lit(False))
    return _result(value, canonical, F.when(bad, F.concat(F.lit("expected " + canonical + ", got: "), unit)))


def unit_part(unit: Column) -> Column:
    """Token of a unit, or one of the words absent, empty, blank, unknown."""
    text = F.lower(strip(unit))
    return F.when(unit.isNull(), "absent").when(unit == "", "empty").when(text == "", "blank").otherwise(
        F.coalesce(lookup(text, dims.UNIT_SPELLINGS), F.lit("unknown")))


def _factors() -> dict[str, float]:
    """Factor to the canonical unit by ``field:unit part`` for the fields whose unit must be known."""
    out = {}
    for name, canonical in dims.CANONICAL_FIELDS:
        if canonical in ("kW", "kg"):
            table = {**(dims.POWER_FACTORS if canonical == "kW" else dims.MASS_FACTORS), "absent": 1.0, "empty": 1.0}
        elif canonical is not None and canonical != "%":
            table = {canonical: 1.0, "absent": 1.0}
        else:
            continue
        out.update({f"{name}:{part}": factor for part, factor in table.items()})
    return out


def unit_factor(field: Column, part: Column) -> Column:
    """Factor to the canonical unit; null when the unit does not fit the field."""
    return F.when(field.isin("efficiency", "power_factor"), F.when(part != "unknown", 1.0)).when(
        field.isin(dims.INTEGER_FIELDS), 1.0).otherwise(literal_map(F.concat(field, F.lit(":"), part), _factors()))


def canonical_value(field: Column, num: Column, part: Column, factor: Column) -> Column:
    """Value in the canonical unit of the field, given the factor."""
    above = num > dims.FRACTION_LIMIT
    return F.when(field == "efficiency", F.round(F.when((part == "%") | above, num).otherwise(num * 100.0), 6)).when(
        field == "power_factor", F.round(F.when((part == "%") & above, num / 100.0).otherwise(num), 6)).when(
        field.isin(dims.INTEGER_FIELDS), F.bround(num, 0)).when(
        field.isin("rated_power", "weight"), F.round(num * factor, 6)).otherwise(num)


def convert(field: Column, value: Column, unit: Column) -> Column:
    """Struct of value, unit and error in the canonical unit of ``field``."""
    part = unit_part(unit)
    factor = unit_factor(field, part)
    known = factor.isNotNull()
    return F.struct(
        F.when(known, canonical_value(field, value, part, factor)).alias("value"),
        F.when(known, literal_map(field, {f: u for f, u in dims.CANONICAL_FIELDS if u})).alias("unit"),
        F.when(~known, F.concat_ws(" ", F.lit("no conversion for"), field, F.lit("from"), unit)).alias("error"))


def is_equivalent(a: Column, unit_a: Column, b: Column, unit_b: Column,
                  tolerance: float = dims.CONFLICT_TOLERANCE) -> Column:
    """Null equals only null; otherwise units must be equal and values within the tolerance."""
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(
        unit_a.eqNullSafe(unit_b) & (F.abs(a - b) <= tolerance))


def normalize_uom(col: Column, aliases: Mapping[str, str] = dims.UOM_ALIASES) -> Column:
    """Struct of unit and status: canonical text Verified, alias Inferred, other text kept as Unknown.

    A placeholder is never an alias.
    """
    known = {a.lower(): c for a, c in aliases.items() if a.lower() not in dims.PLACEHOLDERS and not (
        a.startswith("--") and a.endswith("--"))}
    text = F.nullif(strip(col), F.lit(""))
    canonical = literal_map(F.lower(text), known)
    status = F.when(canonical.isNull(), "Unknown").when(text == canonical, "Verified").otherwise("Inferred")
    return F.struct(F.coalesce(canonical, F.when(col != "", strip(col))).alias("uom"), status.alias("status"))


def _triple(label: Column, raw_value: Column, raw_uom: Column, number: Column, uom: Column) -> Column:
    verified = (uom["status"] == "Verified") & number.isNotNull()
    inferred = (uom["status"] == "Inferred") | number.isNotNull()
    reason = F.when(verified, F.concat(F.lit("known unit and number: "), uom["uom"])).when(
        inferred, F.concat(F.lit("normalised from: "), raw_value, F.coalesce(raw_uom, F.lit("")))).otherwise(
        F.concat(F.lit("unverified unit or format: "), F.coalesce(raw_uom, F.lit("none"))))
    return F.struct(
        label.alias("label"),
        number.alias("value_num"),
        F.when(number.isNull(), strip(raw_value)).alias("value_str"),
        uom["uom"].alias("uom"),
        raw_value.alias("raw_value"),
        raw_uom.alias("raw_uom"),
        F.when(verified, "Verified").when(inferred, "Inferred").otherwise("Unknown").alias("status"),
        F.when(verified, F.lit(1.0)).when(inferred, F.lit(0.9)).otherwise(F.lit(0.5)).alias("confidence"),
        reason.alias("reason"),
    )


def value_unit_status(label: Column, raw_value: Column, raw_uom: Column,
                      aliases: Mapping[str, str] = dims.UOM_ALIASES) -> Column:
    """An attribute triple: number or text, canonical unit, status, confidence and reason."""
    return _triple(label, raw_value, raw_uom, parse_fraction(raw_value), normalize_uom(raw_uom, aliases))


def number_with_unit(label: str, raw_value: Column, unit: str, aliases: Mapping[str, str] = dims.UOM_ALIASES) -> Column:
    """The triple of a plain number whose unit is fixed, so that its status is known beforehand."""
    canonical = {a.lower(): c for a, c in aliases.items()}.get(unit.strip().lower())
    if canonical is None or canonical != unit:
        return value_unit_status(F.lit(label), raw_value, F.lit(unit), aliases)
    return F.struct(
        F.lit(label).alias("label"), raw_value.try_cast("double").alias("value_num"), F.lit(None).cast("string").alias("value_str"),
        F.lit(unit).alias("uom"), raw_value.alias("raw_value"), F.lit(unit).alias("raw_uom"), F.lit("Verified").alias("status"),
        F.lit(1.0).alias("confidence"), F.lit("known unit and number: " + unit).alias("reason"))


def value_unit_statuses(items: Column, aliases: Mapping[str, str] = dims.UOM_ALIASES) -> Column:
    """Triples of an array of ``label, raw, uom``. Number and unit are parsed once per element."""
    parsed = F.transform(items, lambda a: F.struct(
        a["label"].alias("label"), a["raw"].alias("raw"), a["uom"].alias("uom"),
        parse_fraction(a["raw"]).alias("number"), normalize_uom(a["uom"], aliases).alias("unit")))
    return F.transform(parsed, lambda p: _triple(p["label"], p["raw"], p["uom"], p["number"], p["unit"]))
