"""Dimensions, word lists, thresholds and patterns.

Everything here is data. Operators take these tables as default arguments, so another domain passes its own.
"""

from __future__ import annotations

# --- fixed values: canonical fields and their units, in report order ---
CANONICAL_FIELDS: list[tuple[str, str | None]] = [
    ("rated_power", "kW"),
    ("rated_voltage", "V"),
    ("rated_current", "A"),
    ("frequency", "Hz"),
    ("rated_speed", "rpm"),
    ("poles", None),
    ("efficiency", "%"),
    ("power_factor", None),
    ("weight", "kg"),
    ("ip_rating", None),
    ("frame_size", None),
]
FIELD_UNITS = dict(CANONICAL_FIELDS)
STRING_FIELDS = ["ip_rating", "frame_size"]
INTEGER_FIELDS = ["poles"]

# --- fixed values: evidence attribute names by the canonical field they feed ---
CANONICAL_ATTRIBUTES: dict[str, list[str]] = {
    "rated_power": ["rated_power", "rated_power_kw", "rated_power_hp", "rated_power_raw", "rated_power_w"],
    "rated_voltage": ["rated_voltage", "rated_voltage_v"],
    "rated_current": ["rated_current", "full_load_current", "full_load_current_a"],
    "frequency": ["frequency", "frequency_hz"],
    "rated_speed": ["rated_speed", "rated_speed_rpm"],
    "poles": ["poles", "num_poles", "pole_count"],
    "efficiency": ["efficiency", "efficiency_percent", "efficiency_pct", "efficiency_at_100pct_load"],
    "power_factor": ["power_factor", "power_factor_pct"],
    "weight": ["weight", "weight_kg", "weight_g", "weight_lb"],
    "ip_rating": ["ip_rating", "ip_rating_note", "ingress_protection"],
    "frame_size": ["frame_size", "frame", "frame_designation"],
}
METADATA_ATTRIBUTES = ["rated_power_unit", "rated_current_unit", "current_unit"]
SKIPPED_ATTRIBUTES = ["source_location", "manufacturer", "model"]

# --- fixed values: spellings of each unit token (lower case) ---
UNIT_SPELLINGS: dict[str, list[str]] = {
    "W": ["w", "watt", "watts"],
    "kW": ["kw", "kilowatt", "kilowatts"],
    "mW": ["mw", "milliwatt"],
    "HP": ["hp", "horsepower", "cv"],
    "kg": ["kg", "kilogram", "kilograms"],
    "g": ["g", "gram", "grams"],
    "lb": ["lb", "lbs", "pound", "pounds"],
    "oz": ["oz", "ounce", "ounces"],
    "rpm": ["rpm", "r/min", "rev/min"],
    "V": ["v", "volt", "volts"],
    "A": ["a", "amp", "amps", "ampere", "amperes"],
    "Hz": ["hz", "hertz"],
    "%": ["%", "pct", "percent"],
    "dimensionless": ["pf"],
    "ip_string": ["ip"],
    "frame_string": ["frame"],
}
# --- fixed values: factors to kilowatt and to kilogram ---
POWER_FACTORS = {"W": 1e-3, "kW": 1.0, "mW": 1e-6, "HP": 0.7457}
MASS_FACTORS = {"g": 1e-3, "kg": 1.0, "lb": 0.453592, "oz": 0.0283495}
FRACTION_LIMIT = 1.5
CONFLICT_TOLERANCE = 1e-6
NORMALIZATION_VERSION = "2.0.0"

# --- fixed values: wide CSV columns ---
CSV_ALIASES = {
    "product_id": "product_id",
    "manufacturer": "manufacturer",
    "model": "model",
    "rated_power_kw": "rated_power",
    "rated_power": "rated_power",
    "rated_power_raw": "rated_power_raw",
    "rated_power_unit": "rated_power_unit",
    "full_load_current_a": "rated_current",
    "current_unit": "rated_current_unit",
    "rated_speed_rpm": "rated_speed",
    "efficiency_percent": "efficiency",
    "power_factor": "power_factor",
    "weight_kg": "weight",
    "frame": "frame_size",
    "ip_note": "ip_rating_note",
    "source_location": "source_location",
}
CSV_UNITS = {"rated_power": "kW", "rated_current": "A", "rated_speed": "rpm", "efficiency": "%", "weight": "kg"}
IDENTITY_COLUMNS = ["product_id", "manufacturer", "model"]

# --- fixed values: attribute and unit by column position in an extracted table ---
GRID_COLUMNS: list[tuple[str, str | None]] = [
    ("rated_power", "kW"),
    ("rated_power_hp", "HP"),
    ("frame_size", None),
    ("full_load_torque_nm", "Nm"),
    ("locked_rotor_current_ratio", None),
    ("locked_rotor_torque_ratio", None),
    ("breakdown_torque_ratio", None),
    ("inertia_kgm2", "kgm2"),
    ("locked_rotor_time_hot_s", "s"),
    ("locked_rotor_time_cold_s", "s"),
    ("weight", "kg"),
    ("sound_dba", "dB(A)"),
    ("rated_speed", "rpm"),
    ("efficiency_at_50pct_load", "%"),
    ("efficiency_at_75pct_load", "%"),
    ("efficiency", "%"),
    ("power_factor_at_50pct_load", None),
    ("power_factor_at_75pct_load", None),
    ("power_factor", None),
    ("rated_current", "A"),
]
GRID_KEY_LIMIT = 1000.0
# --- fixed values: constants stated once per page (attribute, text, unit) ---
PAGE_CONSTANTS = [("rated_voltage", "400", "V"), ("frequency", "50", "Hz")]
PAGE_GATE = ["400", "V"]
GLOBAL_ID = "GLOBAL"
SOURCE_RANKS = {"pdf": 0, "csv": 1, "web": 2}
GLOBAL_RANK = 3
ROMAN_POLES = [("II", 2), ("IV", 4), ("VI", 6), ("VIII", 8)]

# --- fixed values: patterns for specification values in text (pattern, attribute, unit) ---
SPEC_PATTERNS: list[tuple[str, str, str | None]] = [
    (r"(\d+(?:\.\d+)?)\s*kW", "rated_power", "kW"),
    (r"(\d+(?:\.\d+)?)\s*A\b", "rated_current", "A"),
    (r"(\d{3,5})\s*rpm", "rated_speed", "rpm"),
    (r"(\d{2,3}(?:\.\d+)?)\s*%", "efficiency", "%"),
    (r"cos\s*[φΦ]\s*=?\s*(0\.\d+)", "power_factor", None),
    (r"(\d{2,4})\s*V\b", "rated_voltage", "V"),
    (r"(\d{2})\s*Hz\b", "frequency", "Hz"),
    (r"\b(IP\s*\d{2})\b", "ip_rating", None),
    (r"(\d+(?:\.\d+)?)\s*kg\b", "weight", "kg"),
]

# --- fixed values: validation rules ---
REQUIRED_FIELDS = ["rated_power", "rated_voltage", "rated_speed"]
IMPORTANT_FIELDS = ["rated_current", "efficiency", "weight"]
# (rule id, field, minimum, maximum, strict minimum, severity of a failure)
RANGE_RULES: list[tuple[str, str, float, float | None, bool, str]] = [
    ("RANGE_RATED_POWER_POSITIVE", "rated_power", 0.0, None, True, "HIGH"),
    ("RANGE_RATED_VOLTAGE_POSITIVE", "rated_voltage", 0.0, None, True, "HIGH"),
    ("RANGE_RATED_CURRENT_POSITIVE", "rated_current", 0.0, None, True, "HIGH"),
    ("RANGE_RATED_SPEED_POSITIVE", "rated_speed", 0.0, None, True, "HIGH"),
    ("RANGE_EFFICIENCY_BOUNDS", "efficiency", 0.0, 100.0, False, "HIGH"),
    ("RANGE_POWER_FACTOR_BOUNDS", "power_factor", 0.0, 1.0, False, "HIGH"),
    ("RANGE_WEIGHT_POSITIVE", "weight", 0.0, None, True, "MEDIUM"),
]
TORQUE_ATTRIBUTE = "full_load_torque_nm"
TORQUE_TOLERANCE = 0.15
EFFICIENCY_FLOOR = 80.0
DEFAULT_FREQUENCY = 50.0
MIN_SLIP = 0.001
# Pole marks looked for in a product id, in this order.
POLE_MARKS = [("2P", 2), ("4P", 4), ("6P", 6), ("8P", 8)]
FINDING_STATUSES = ["PASS", "WARNING", "CONFLICT", "FAIL", "NOT_CHECKED"]
FINDING_CATEGORIES = ["SCHEMA", "REQUIRED_FIELD", "TYPE", "RANGE", "UNIT", "CONSISTENCY", "ENGINEERING",
                      "MISSING_DATA", "CONFLICT"]

# --- fixed values: trust score ---
WEIGHT_COMPLETENESS = 0.35
WEIGHT_VALIDITY = 0.35
WEIGHT_DIVERSITY = 0.30
CONFLICT_PENALTY = 0.15
MAX_CONFLICT_PENALTY = 0.50
TRUSTED_SCORE = 0.80
TRUST_STATUSES = ["TRUSTED", "CONFLICTED", "REVIEW_REQUIRED", "UNVERIFIED", "UNSUPPORTED"]
PUBLISHABILITIES = ["PUBLISHABLE", "PUBLISHABLE_WITH_WARNING", "REVIEW_REQUIRED", "NOT_PUBLISHABLE"]
SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]

# --- fixed values: catalog ---
PLACEHOLDERS = ["-- unbranded --", "-- no unilog brand --", "-- no dib brand --", "-", "commodity - unbranded",
                "none", "null", "n/a", "na", ""]
DISTRIBUTOR_WORDS = ["cooperative", "supply", "distributor", "lumber"]
UOM_ALIASES = {"a": "A", "v": "V", "dba": "dBA", "in": "in", "in.": "in", '"': "in"}
PRODUCT_KEYWORDS: list[tuple[list[str], str]] = [
    (["dishwasher"], "Dishwasher"),
    (["sanding belt"], "Sanding Belt"),
    (["cut off disc", "cut-off disc"], "Cut-Off Disc"),
    (["grinding wheel"], "Grinding Wheel"),
    (["decking"], "Decking"),
]
# (label, pattern, unit given to every match; None takes the unit from group 2)
ATTRIBUTE_PATTERNS: list[tuple[str, str, str | None]] = [
    ("Voltage Rating", r"\b(\d+(?:\.\d+)?)\s*(?:VAC|VDC|V|volts?)\b", "V"),
    ("Amperage Rating", r"\b(\d+(?:\.\d+)?)\s*(?:A|amps?|amperes?)\b", "A"),
    ("Sound Level", r"\b(\d+(?:\.\d+)?)\s*(?:dBA|db)\b", "dBA"),
    ("Dimension / Size", r"\b((?:\d+[\s\-]*)?\d+/\d+|\d+(?:\.\d+)?)\s*(IN|in\.|\"|in)\b", None),
]
# The same without the word boundary around it, so that 36" before a blank and x.045" are found whole.
FIXED_DIMENSION_PATTERN = r"(?<![\d/.])((?:\d+[\s\-]*)?\d+/\d+|\d*\.\d+|\d+)\s*(?:(IN|in\.|in)\b|\")"
MAX_PLAIN_DIMENSION = 100
TIERS = ["Verified", "Inferred", "Conflicted", "Unknown"]
# Columns tried for a dictionary match, in priority order: (report name, input column).
BRAND_SOURCES = [
    ("Mfg_Part_Num", "mfg_part_num"),
    ("Part_Manuf", "part_manuf"),
    ("E1_Brand", "e1_brand"),
    ("DIB_Brand", "dib_brand"),
    ("Unilog_Brand", "unilog_brand"),
    ("Part_Desc", "part_desc"),
]
VERIFYING_SOURCES = ["Mfg_Part_Num", "Part_Manuf", "E1_Brand", "DIB_Brand"]
MAX_TRIPLES = 50

# --- fixed values: display tiers by raw status (any other status is Unknown) ---
DISPLAY_TIERS = {
    "Verified": ["TRUSTED", "VERIFIED"],
    "Inferred": ["INFERRED", "UNVERIFIED"],
    "Conflict": ["CONFLICTED", "CONFLICT"],
    "Review Req.": ["REVIEW_REQUIRED"],
    "Unsupported": ["UNSUPPORTED", "FAIL"],
    "Unknown": ["MISSING", "UNKNOWN"],
}


def fractions(denominator: int = 64) -> dict[str, float]:
    """The inch fractions 1/64 to 63/64 in lowest terms, generated from the rule."""
    from math import gcd

    out = {}
    for n in range(1, denominator):
        g = gcd(n, denominator)
        out[f"{n // g}/{denominator // g}"] = n / denominator
    return out
