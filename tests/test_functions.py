import pytest
from pyspark.sql import functions as F

from specledger import dims
from specledger.functions import text, units, values


@pytest.mark.parametrize("raw, num, unit", [
    ("84.8%", 84.8, "%"), ("1.5 HP", 1.5, "HP"), ("1.1e3", 1100.0, None), ("-0.5", -0.5, None), ("19.5 kg", 19.5, "kg")])
def test_parse_numeric(evaluate, raw, num, unit):
    got = evaluate(lambda: values.parse_numeric(F.col("s")), "s string", raw)
    assert (got["num"], got["unit"], got["error"]) == (num, unit, None)


@pytest.mark.parametrize("raw", ["", "   ", "abc", None, "1.1 kW extra", "5 d 3"])
def test_parse_numeric_fails(evaluate, raw):
    got = evaluate(lambda: values.parse_numeric(F.col("s")), "s string", raw)
    assert got["num"] is None and got["error"]


@pytest.mark.parametrize("raw, want", [
    ("ip56", "IP56"), ("IP 56", "IP56"), ("56", "IP56"), ("IP56+ sealing described", "IP56"), ("sealed", "sealed")])
def test_parse_ip(evaluate, raw, want):
    assert evaluate(lambda: values.parse_ip_rating(F.col("s")), "s string", raw) == want


def test_other_parsers(evaluate):
    assert evaluate(lambda: values.parse_poles(F.col("s")), "s string", "4-pole") == 4
    assert evaluate(lambda: values.parse_poles(F.col("s")), "s string", "four") is None
    assert evaluate(lambda: values.parse_phase(F.col("s")), "s string", "three phase") == 3
    assert evaluate(lambda: values.parse_frame_size(F.col("s")), "s string", "  90S  ") == "90S"
    assert evaluate(lambda: values.first_number(F.col("s")), "s string", "about -3.5 mm") == -3.5
    assert evaluate(lambda: values.first_number(F.col("s"), True), "s string", "1,1") == 1.1
    assert evaluate(lambda: values.pole_from_text(F.col("s")), "s string", "IV pole motors") == 4


@pytest.mark.parametrize("field, value, unit, want", [
    ("rated_power", 1100.0, "W", 1.1), ("rated_power", 1.5, "HP", 1.11855), ("rated_power", 1_100_000.0, "mW", 1.1),
    ("rated_power", 1.1, None, 1.1), ("weight", 19500.0, "g", 19.5), ("weight", 1.0, "lb", 0.453592),
    ("weight", 43.0, "lb", 19.504456), ("efficiency", 0.848, None, 84.8), ("efficiency", 1.0, None, 100.0),
    ("efficiency", 84.8, "%", 84.8), ("power_factor", 80.0, "%", 0.8), ("power_factor", 0.8, None, 0.8),
    ("rated_voltage", 400.0, None, 400.0), ("rated_speed", 1455.0, "r/min", 1455.0), ("poles", 4.5, "x", 4.0)])
def test_convert(evaluate, field, value, unit, want):
    got = evaluate(lambda: units.convert(F.col("f"), F.col("v"), F.col("u")), "f string, v double, u string", field, value, unit)
    assert got["value"] == pytest.approx(want, abs=1e-9) and got["error"] is None


@pytest.mark.parametrize("field, unit", [
    ("rated_power", "BTU"), ("weight", "stone"), ("rated_voltage", "kV"), ("rated_voltage", ""), ("rated_power", "  "),
    ("efficiency", "furlong"), ("rated_current", "V")])
def test_unknown_units(evaluate, field, unit):
    got = evaluate(lambda: units.convert(F.col("f"), F.col("v"), F.col("u")), "f string, v double, u string", field, 1.0, unit)
    assert got["value"] is None and got["error"]


def test_single_conversions_agree_with_convert(spark):
    df = spark.createDataFrame([(u,) for u in ("W", "HP", "kg", "lb", None, "", "  ", "BTU", "V", "%")], "u string")
    v, u = F.lit(3.0), F.col("u")
    for field, fn in {"rated_power": units.convert_power, "weight": units.convert_mass,
                      "efficiency": units.normalize_efficiency, "power_factor": units.normalize_power_factor,
                      "rated_voltage": lambda a, b: units.passthrough_unit(a, b, "V")}.items():
        rows = df.select(fn(v, u)["value"].alias("a"), units.convert(F.lit(field), v, u)["value"].alias("b")).collect()
        assert [r["a"] for r in rows] == [r["b"] for r in rows], field


@pytest.mark.parametrize("a, ua, b, ub, want", [
    (None, None, None, None, True), (1.1, "kW", None, "kW", False), (1.1, "kW", 1.1 + 5e-7, "kW", True),
    (1.1, "kW", 1.2, "kW", False), (1.0, "kW", 1.0, "W", False), (0.5, None, 0.5, None, True)])
def test_equivalence(evaluate, a, ua, b, ub, want):
    c = F.col
    assert evaluate(lambda: units.is_equivalent(c("a"), c("ua"), c("b"), c("ub")), "a double, ua string, b double, ub string",
                    a, ua, b, ub) is want


@pytest.mark.parametrize("raw, want", [
    ("1/2", 0.5), ("7/64", 0.109375), ("1-1/2", 1.5), ("7 1/4", 7.25), ('1/2"', 0.5), ("0.045", 0.045), ("12", 12.0),
    ("3/0", None), ("5d", None), ("x", None), ("", None)])
def test_fractions(evaluate, raw, want):
    assert evaluate(lambda: values.parse_fraction(F.col("s")), "s string", raw) == want


def test_fraction_table_agrees_with_quotients(spark):
    df = spark.createDataFrame(list(dims.fractions().items()), "s string, want double")
    assert len(dims.fractions()) == 63
    assert df.filter(values.parse_fraction(F.col("s")) != F.col("want")).count() == 0


@pytest.mark.parametrize("raw, want", [
    ("-- Unbranded --", None), ("-", None), ("N/A", None), (" none ", None), ("--", None), ("", None), (None, None),
    (" TREX ", "TREX"), ("-x-", "-x-")])
def test_placeholders(evaluate, raw, want):
    assert evaluate(lambda: text.clean_string(F.col("s")), "s string", raw) == want


@pytest.mark.parametrize("uom, want", [("V", ("V", "Verified")), ("IN", ("in", "Inferred")), ('"', ("in", "Inferred")),
                                       ("DBA", ("dBA", "Inferred")), ("furlong", ("furlong", "Unknown")), (None, (None, "Unknown"))])
def test_uom(evaluate, uom, want):
    got = evaluate(lambda: units.normalize_uom(F.col("s")), "s string", uom)
    assert (got["uom"], got["status"]) == want


def test_value_unit_status_ladder(evaluate):
    def status(raw, uom):
        got = evaluate(lambda: units.value_unit_status(F.lit("L"), F.col("r"), F.col("u")), "r string, u string", raw, uom)
        return got["status"], got["confidence"]

    assert status("120", "V") == ("Verified", 1.0)
    assert status("50-1/4", "IN") == ("Inferred", 0.9)
    assert status("abc", "V") == ("Unknown", 0.5)
    assert status("1", None) == ("Inferred", 0.9)


def test_labels(evaluate):
    c = F.col
    assert evaluate(lambda: text.evidence_label(c("t"), c("p"), c("r"), c("a")), "t string, p int, r int, a string", "pdf", 5, None, "attr") == "pdf:p.5 (attr)"
    assert evaluate(lambda: text.evidence_label(c("t"), c("p"), c("r"), c("a")), "t string, p int, r int, a string", "csv", None, 3, "attr") == "csv:row.3 (attr)"
    assert evaluate(lambda: text.range_condition(F.lit(0.0), F.lit(100.0)), "s string", "") == ">= 0.0 and <= 100.0"
    assert evaluate(lambda: text.range_condition(F.lit(0.0), F.lit(None).cast("double"), F.lit(True)), "s string", "") == "> 0.0"
    assert evaluate(lambda: text.display_tier(F.col("s")), "s string", "unverified") == "Inferred"
