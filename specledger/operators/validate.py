"""Validation rules as tables of findings.

Field rules read the assembled fields, conflict rules the conflict pairs, product rules one row per product.
Findings are ordered by ``rule_no, field_pos, item``. A finding about a fact that stands for several equal copies is one row with
their number in ``n_copies``; all counts of findings are sums of it.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from specledger import dims
from specledger.functions.text import literal_map, range_condition
from specledger.operators.normalize import KEYS, fact_key, fact_order
from specledger.operators.skew import join_few

ORDER = ["rule_no", "field_pos", "item"]
FINDING = ["product_id", *ORDER, "rule_id", "category", "status", "severity", "field", "actual_value", "actual_num",
           "actual_unit", "expected_condition", "explanation", "n_copies"]
FIRST_RANGE_NO = 5
FIELD_POS = {f: i for i, (f, _) in enumerate(dims.CANONICAL_FIELDS)}

RULE_NO = {
    "SCHEMA_CANONICAL_UNITS": 1,
    "SCHEMA_NORMALIZATION_VERSION": 2,
    "REQUIRED_FIELD_PRESENCE": 3,
    "IMPORTANT_FIELD_PRESENCE": 4,
    **{rule[0]: FIRST_RANGE_NO + i for i, rule in enumerate(dims.RANGE_RULES)},
    "CONSISTENCY_CROSS_SOURCE": 12,
    "ENGINEERING_TORQUE_POWER_RPM": 13,
    "ENGINEERING_EFFICIENCY_IE3": 14,
    "ENGINEERING_SYNCHRONOUS_SPEED": 15,
    "MISSING_DATA_INVENTORY": 16,
    "CONFLICT_RATED_CURRENT_PDF_VS_CSV": 17,
}
CATEGORY = {
    **{r: "SCHEMA" for r in RULE_NO if r.startswith("SCHEMA")},
    **{r: "RANGE" for r in RULE_NO if r.startswith("RANGE")},
    **{r: "ENGINEERING" for r in RULE_NO if r.startswith("ENGINEERING")},
    **{r: "CONFLICT" for r in RULE_NO if r.startswith("CON")},
    "REQUIRED_FIELD_PRESENCE": "REQUIRED_FIELD",
    "IMPORTANT_FIELD_PRESENCE": "MISSING_DATA",
    "MISSING_DATA_INVENTORY": "MISSING_DATA",
}


def _finding(rule_id: Column | str, status: Column | str, severity: Column | str, field: Column | str,
             text: Column | None = None, num: Column | None = None, unit: Column | str | None = None,
             expected: Column | str | None = None, explanation: Column | str = "",
             item: Column | None = None, copies: Column | None = None) -> Column:
    def col(x: Column | str | None, kind: str = "string") -> Column:
        return (x if isinstance(x, Column) else F.lit(x)).cast(kind)

    return F.struct(
        (F.lit(0) if item is None else item).cast("long").alias("item"), col(rule_id).alias("rule_id"),
        col(status).alias("status"), col(severity).alias("severity"), col(field).alias("field"),
        col(text).alias("actual_value"), col(num, "double").alias("actual_num"), col(unit).alias("actual_unit"),
        col(expected).alias("expected_condition"), col(explanation).alias("explanation"),
        (F.lit(1) if copies is None else copies).cast("long").alias("n_copies"))


def _numbered(rows: DataFrame) -> DataFrame:
    """Add the place and category that rule and field stand for."""
    return rows.withColumns({
        "rule_no": literal_map(F.col("rule_id"), RULE_NO), "category": literal_map(F.col("rule_id"), CATEGORY),
        "field_pos": F.coalesce(literal_map(F.col("field"), FIELD_POS), F.lit(99))}).select(*FINDING)


# Which rows a finding is about, and the finding.
Case = tuple[Column, Column]


def _emit(df: DataFrame, cases: list[Case]) -> DataFrame:
    """One row per finding of each input row.

    Each kind of finding is a filter and a projection of its own, so what a later step leaves out (texts, whole kinds) is not computed.
    """
    rows = [df.filter(where).select("product_id", finding.alias("_f")).select("product_id", "_f.*") for where, finding in cases]
    return _numbered(reduce(DataFrame.unionByName, rows))


def _missing() -> Column:
    return F.col("outcome") == "missing"


def _field() -> Column:
    return F.col("canonical_field")


def _value_text() -> Column:
    return F.coalesce(F.col("value_num").cast("string"), F.col("value_str"))


def _units_rule(expected: dict[str, str]) -> Case:
    want = literal_map(_field(), expected)
    same = F.col("canonical_unit").eqNullSafe(want)
    return (~_missing(), _finding(
        "SCHEMA_CANONICAL_UNITS", F.when(same, "PASS").otherwise("FAIL"),
        F.when(same, "INFO").otherwise("HIGH"), _field(), F.col("canonical_unit"),
        expected=F.concat(F.lit("unit is "), F.coalesce(want, F.lit("none"))),
        explanation=F.concat(F.lit("unit of the field: "), F.coalesce("canonical_unit", F.lit("none")))))


def _presence_rule(rule_id: str, names: list[str], status: str, severity: str) -> Case:
    return (_field().isin(names), _finding(
        rule_id, F.when(_missing(), status).otherwise("PASS"), F.when(_missing(), severity).otherwise("INFO"),
        _field(), _value_text(), expected="at least one usable fact",
        explanation=F.when(_missing(), "no usable fact from any source").otherwise(
            F.concat(F.col("n_refs").cast("string"), F.lit(" facts, outcome "), F.col("outcome")))))


def _required() -> Case:
    return _presence_rule("REQUIRED_FIELD_PRESENCE", dims.REQUIRED_FIELDS, "FAIL", "HIGH")


def _important() -> Case:
    return _presence_rule("IMPORTANT_FIELD_PRESENCE", dims.IMPORTANT_FIELDS, "WARNING", "MEDIUM")


def _inventory() -> Case:
    optional = ~_field().isin(dims.REQUIRED_FIELDS + dims.IMPORTANT_FIELDS)
    return (_missing() & optional, _finding(
        "MISSING_DATA_INVENTORY", "NOT_CHECKED", "LOW", _field(), expected="optional field",
        explanation="optional field without a usable fact"))


class _Range:
    """The range rule of the row's field, read from the rule table."""

    def __init__(self) -> None:
        def column(i: int) -> Column:
            return literal_map(_field(), {r[1]: r[i] for r in dims.RANGE_RULES if r[i] is not None})

        self.rule_id, self.low, self.high, self.severity = column(0), column(2), column(3), column(5)
        self.strict = _field().isin([r[1] for r in dims.RANGE_RULES if r[4]])

    def violated_by(self, value: Column) -> Column:
        """Plain comparisons per field: this is tested on every fact and pair, and look-ups in the rule table cost much more."""
        def outside(low: float | None, high: float | None, strict: bool) -> Column:
            below = None if low is None else value <= low if strict else value < low
            above = None if high is None else value > high
            return F.lit(False) if below is None and above is None else above if below is None else below if above is None else below | above

        return reduce(lambda a, b: a | b, [(_field() == r[1]) & outside(r[2], r[3], r[4]) for r in dims.RANGE_RULES])

    def condition(self, checked: Column | None = None) -> Column:
        return range_condition(self.low, self.high, self.strict if checked is None else self.strict & checked)


_RANGED = [r[1] for r in dims.RANGE_RULES]


def _range_single() -> Case:
    """Missing field, or the single value of a field without conflict."""
    rule, value = _Range(), F.col("value_num")
    bad, absent = rule.violated_by(value), value.isNull()
    return (_field().isin(_RANGED) & ~F.col("has_conflict"), _finding(
        rule.rule_id, F.when(absent, "NOT_CHECKED").when(bad, "FAIL").otherwise("PASS"),
        F.when(absent, "LOW").when(bad, rule.severity).otherwise("INFO"), _field(),
        value.cast("string"), value, F.when(~absent, F.col("canonical_unit")), rule.condition(~absent),
        F.when(absent, "no value").when(bad, "value outside the range").otherwise("value within the range")))


def _efficiency_single() -> Case:
    value = F.col("value_num")
    low = value < dims.EFFICIENCY_FLOOR
    status = F.when(value.isNull(), "NOT_CHECKED").when(low, "WARNING").otherwise("PASS")
    return ((_field() == "efficiency") & ~F.col("has_conflict"), _finding(
        "ENGINEERING_EFFICIENCY_IE3", status,
        F.when(value.isNull(), "LOW").when(low, "MEDIUM").otherwise("INFO"), "efficiency", value.cast("string"), value,
        F.when(value.isNotNull(), "%"), F.when(value.isNotNull(), f">= {dims.EFFICIENCY_FLOOR}%"),
        F.when(value.isNull(), "no efficiency value").when(low, "efficiency below the usual floor")
        .otherwise("plausible efficiency")))


def check_canonical_units(fields: DataFrame, expected: dict[str, str | None] = dims.FIELD_UNITS) -> DataFrame:
    return _emit(fields, [_units_rule({f: u for f, u in expected.items() if u})])


def check_version(products: DataFrame, expected: str = dims.NORMALIZATION_VERSION) -> DataFrame:
    """``products`` has ``product_id`` and ``normalization_version``."""
    version = F.col("normalization_version")
    same = version.eqNullSafe(F.lit(expected))
    return _emit(products, [(F.lit(True), _finding(
        "SCHEMA_NORMALIZATION_VERSION", F.when(same, "PASS").otherwise("WARNING"),
        F.when(same, "INFO").otherwise("LOW"), "(product)", version, expected=f"version is {expected}",
        explanation=F.when(same, "known version").otherwise("other version, review the schema")))])


def check_required(fields: DataFrame) -> DataFrame:
    return _emit(fields, [_required()])


def check_important(fields: DataFrame) -> DataFrame:
    return _emit(fields, [_important()])


def missing_inventory(fields: DataFrame) -> DataFrame:
    return _emit(fields, [_inventory()])


def _sides() -> list[tuple[Column, Column, Column]]:
    """Value, unit and place of both sides of a conflict pair."""
    order = fact_order() * 2
    return [(F.col("value_a"), F.col("unit_a"), order), (F.col("value_b"), F.col("unit_b"), order + 1)]


def _range_disputed() -> Case:
    """A conflicted field none of whose values, in conflict or as parsed, is outside the range."""
    rule = _Range()
    bad = F.lit(False)
    for extreme in ("low_num", "high_num", "raw_low", "raw_high"):
        bad = bad | F.coalesce(rule.violated_by(F.col(extreme)), F.lit(False))
    return (_field().isin(_RANGED) & F.col("has_conflict") & ~bad, _finding(
        rule.rule_id, "PASS", "INFO", _field(), F.lit("(conflicted)"), expected=rule.condition(),
        explanation="conflicted, but every value is within the range"))


def _outside(value: Column, unit: Column, item: Column, copies: Column) -> Column:
    rule = _Range()
    return _finding(rule.rule_id, "FAIL", rule.severity, _field(), value.cast("string"), value, unit, rule.condition(), "value outside the range", item, copies)


def _range_pairs() -> list[Case]:
    """Both values of a pair outside the range."""
    return [(_field().isin(_RANGED) & _Range().violated_by(value), _outside(value, unit, item, F.col("n_copies"))) for value, unit, item in _sides()]


def range_facts(fields: DataFrame, normalized: DataFrame, global_normalized: DataFrame | None = None) -> DataFrame:
    """Parsed values of the facts of conflicted fields that are outside the range. They are filtered before the join, so only violations move."""
    bad = F.col("value").isNotNull() & _field().isin(_RANGED) & _Range().violated_by(F.col("value"))
    item = (F.lit(1 << 61) + fact_order()).alias("item")
    low, high = (F.coalesce(_Range().violated_by(F.col(c)), F.lit(False)) for c in ("raw_low", "raw_high"))
    disputed = fields.filter(F.col("has_conflict") & _field().isin(_RANGED) & (low | high)).select(*KEYS)
    facts = normalized.filter(bad).select(*KEYS, "value", "unit", item, F.lit(1).cast("long").alias("n_copies")).join(disputed, KEYS, "left_semi")
    if global_normalized is not None:
        copies = F.col("n_copies") if "n_copies" in global_normalized.columns else F.lit(1).cast("long")
        shared = global_normalized.filter(bad).select("canonical_field", "value", "unit", item, copies.alias("n_copies"))
        facts = facts.unionByName(join_few(disputed, shared, "canonical_field", "product_id").select(*facts.columns))
    return facts


def _range_found(facts: DataFrame) -> DataFrame:
    return _emit(facts, [(F.lit(True), _outside(F.col("value"), F.col("unit"), F.col("item"), F.col("n_copies")))])


def check_ranges(fields: DataFrame, pairs: DataFrame, normalized: DataFrame,
                 global_normalized: DataFrame | None = None) -> DataFrame:
    """The seven range rules. Of a conflicted field every value of every pair is tested, and the parsed value of every fact."""
    return _emit(fields, [_range_single(), _range_disputed()]).unionByName(_emit(pairs, _range_pairs())).unionByName(
        _range_found(range_facts(fields, normalized, global_normalized)))


def _cross_source() -> Case:
    def side(value: str, text: str, unit: str) -> Column:
        return F.coalesce(F.concat_ws(" ", F.col(value).cast("string"), F.when(F.col(value).isNotNull(), F.col(unit))),
                          F.lit(""))

    a = F.when(F.col("value_a").isNull(), F.col("text_a")).otherwise(side("value_a", "text_a", "unit_a"))
    b = F.when(F.col("value_b").isNull(), F.col("text_b")).otherwise(side("value_b", "text_b", "unit_b"))
    return (F.lit(True), _finding(
        "CONSISTENCY_CROSS_SOURCE", "CONFLICT", "HIGH", _field(), F.concat(a, F.lit(" / "), b),
        expected="all sources agree", item=fact_order(), copies=F.col("n_copies"),
        explanation=F.concat(F.lit("sources disagree: "), F.col("ref_a.source_type"), F.lit(" reports "), a,
                             F.lit(", "), F.col("ref_b.source_type"), F.lit(" reports "), b,
                             F.lit("; no winner picked"))))


def check_cross_source(pairs: DataFrame) -> DataFrame:
    """One finding per conflict pair."""
    return _emit(pairs, [_cross_source()])


def _source_pair(field: str = "rated_current", first: str = "pdf", second: str = "csv",
                 rule_id: str = "CONFLICT_RATED_CURRENT_PDF_VS_CSV") -> Case:
    a, b = F.col("ref_a.source_type"), F.col("ref_b.source_type")
    straight = (a == first) & (b == second)
    turned = (b == first) & (a == second)
    one = F.when(straight, F.col("value_a")).otherwise(F.col("value_b")).cast("string")
    two = F.when(straight, F.col("value_b")).otherwise(F.col("value_a")).cast("string")
    text = F.concat(F.lit(f"{first}: "), F.coalesce(one, F.lit("text")), F.lit(f" / {second}: "),
                    F.coalesce(two, F.lit("text")))
    return ((_field() == field) & (straight | turned), _finding(
        rule_id, "CONFLICT", "HIGH", field, text, expected="both sources report the same value",
        explanation=F.concat(F.lit("named sources disagree, "), text), item=fact_order(), copies=F.col("n_copies")))


def check_source_pair(pairs: DataFrame, field: str = "rated_current", first: str = "pdf", second: str = "csv",
                      rule_id: str = "CONFLICT_RATED_CURRENT_PDF_VS_CSV") -> DataFrame:
    """Conflicts on one field between two named source types, in either order."""
    return _emit(pairs, [_source_pair(field, first, second, rule_id)])


def _efficiency_pairs() -> list[Case]:
    """Both values of a numeric conflict on the efficiency."""
    out = []
    for value, _, item in _sides():
        low = value < dims.EFFICIENCY_FLOOR
        out.append(((_field() == "efficiency") & F.col("value_a").isNotNull(), _finding(
            "ENGINEERING_EFFICIENCY_IE3", F.when(low, "WARNING").otherwise("PASS"),
            F.when(low, "MEDIUM").otherwise("INFO"), "efficiency", value.cast("string"), value, "%",
            f">= {dims.EFFICIENCY_FLOOR}%", F.when(low, "efficiency below the usual floor").otherwise("plausible efficiency"),
            item, F.col("n_copies"))))
    return out


def check_efficiency_floor(fields: DataFrame, pairs: DataFrame) -> DataFrame:
    """Single value, or each value of each conflict pair, against the floor."""
    return _emit(fields, [_efficiency_single()]).unionByName(_emit(pairs, _efficiency_pairs()))


def product_row(fields: DataFrame, unmapped: DataFrame, global_unmapped: DataFrame | None = None,
                torque: str = dims.TORQUE_ATTRIBUTE) -> DataFrame:
    """One row per product: the numbers the engineering rules need, and the first torque fact."""
    def pick(field: str, column: str) -> Column:
        return F.max(F.when(_field() == field, F.col(column)))

    wide = fields.groupBy("product_id").agg(
        F.coalesce(pick("rated_power", "value_num"), pick("rated_power", "kw_raw")).alias("power_kw"),
        pick("rated_speed", "value_num").alias("speed_rpm"), pick("poles", "value_num").alias("poles"),
        pick("frequency", "value_num").alias("frequency"))

    def first_torque(facts: DataFrame, keys: list[str]) -> DataFrame:
        rows = facts.filter((F.col("attribute") == torque) & F.col("value").isNotNull())
        return rows.groupBy(*keys).agg(F.min_by("value", fact_key()).alias("torque_nm"))

    out = wide.join(first_torque(unmapped, ["product_id"]), "product_id", "left")
    if global_unmapped is not None:
        shared = first_torque(global_unmapped, []).scalar()
        out = out.withColumn("torque_nm", F.coalesce(F.col("torque_nm"), shared))
    return out


def _torque_rule() -> Case:
    p, n, t = F.col("power_kw"), F.col("speed_rpm"), F.col("torque_nm")
    expected = p * 60000.0 / (2.0 * math.pi * n)
    absent = F.when(p.isNull(), "rated_power").when(n.isNull(), "rated_speed").when(t.isNull(), dims.TORQUE_ATTRIBUTE)
    stopped = n <= 0
    near = F.abs(t - expected) <= dims.TORQUE_TOLERANCE * expected
    status = F.when(absent.isNotNull(), "NOT_CHECKED").when(stopped, "FAIL").when(near, "PASS").otherwise("WARNING")
    checked = absent.isNull() & ~stopped
    return (F.lit(True), _finding(
        "ENGINEERING_TORQUE_POWER_RPM", status,
        F.when(absent.isNotNull(), "LOW").when(stopped, "HIGH").when(near, "INFO").otherwise("MEDIUM"),
        F.coalesce(absent, F.when(stopped, "rated_speed"), F.lit(dims.TORQUE_ATTRIBUTE)),
        F.when(checked, t).when(absent.isNull(), n).cast("string"), F.when(checked, t).when(absent.isNull(), n),
        F.when(checked, "Nm").when(absent.isNull(), "rpm"),
        F.when(checked, F.format_string("%.3f Nm +- 15%%", expected)).when(absent.isNull(), "> 0"),
        F.when(absent.isNotNull(), F.concat(F.lit("no usable "), absent)).when(stopped, "speed is not positive")
        .otherwise(F.format_string("torque %s Nm, expected %.3f Nm from power and speed", t.cast("string"), expected))))


def pole_count(product_id: Column, poles: Column) -> Column:
    """Poles named in the id (first mark found), else the field."""
    out = poles.cast("int")
    for mark, n in reversed(dims.POLE_MARKS):
        out = F.when(product_id.contains(mark), n).otherwise(out)
    return out


def _sync_rule() -> Case:
    n = F.col("speed_rpm")
    poles = F.nullif(pole_count(F.col("product_id"), F.col("poles")), F.lit(0))
    hertz = F.coalesce(F.col("frequency"), F.lit(dims.DEFAULT_FREQUENCY))
    sync = 120.0 * hertz / poles
    slip = (sync - n) / sync
    absent = F.when(n.isNull(), "rated_speed").when(poles.isNull(), "poles")
    bad = (n <= 0) | (n >= sync)
    tight = slip < dims.MIN_SLIP
    return (F.lit(True), _finding(
        "ENGINEERING_SYNCHRONOUS_SPEED",
        F.when(absent.isNotNull(), "NOT_CHECKED").when(bad, "FAIL").when(tight, "WARNING").otherwise("PASS"),
        F.when(absent.isNotNull(), "LOW").when(bad, "HIGH").when(tight, "LOW").otherwise("INFO"),
        F.coalesce(absent, F.lit("rated_speed")), F.when(absent.isNull(), n.cast("string")),
        F.when(absent.isNull(), n), F.when(absent.isNull(), "rpm"),
        F.when(absent.isNull(), F.format_string("< %.0f rpm", sync)),
        F.when(absent.isNotNull(), F.concat(F.lit("no value for "), absent)).when(
            n <= 0, "speed is not positive").otherwise(
            F.format_string("slip %.2f%% of synchronous speed %.0f rpm", slip * 100, sync))))


def check_torque(rows: DataFrame) -> DataFrame:
    return _emit(rows, [_torque_rule()])


def check_sync_speed(rows: DataFrame) -> DataFrame:
    return _emit(rows, [_sync_rule()])


def run_rules(fields: DataFrame, products: DataFrame, pairs: DataFrame, normalized: DataFrame, unmapped: DataFrame,
              global_normalized: DataFrame | None = None, global_unmapped: DataFrame | None = None,
              rows: DataFrame | None = None, outside: DataFrame | None = None) -> DataFrame:
    """All findings: of fields, products, pairs, product rows, and the facts outside a range of conflicted fields.

    ``rows`` (``product_row``) and ``outside`` (``range_facts``) may be passed when they are known already.
    """
    rows = product_row(fields, unmapped, global_unmapped) if rows is None else rows
    outside = range_facts(fields, normalized, global_normalized) if outside is None else outside
    per_field = _emit(fields, [
        _units_rule({f: u for f, u in dims.CANONICAL_FIELDS if u}), _required(), _important(),
        _range_single(), _range_disputed(), _efficiency_single(), _inventory()])
    per_pair = _emit(pairs, [_cross_source(), *_range_pairs(), *_efficiency_pairs(), _source_pair()])
    per_product = _emit(rows, [_torque_rule(), _sync_rule()])
    parts = [per_field, check_version(products), per_pair, per_product, _range_found(outside)]
    return reduce(DataFrame.unionByName, parts)


COPY_BLOCK = 10_000


def one_per_copy(findings: DataFrame) -> DataFrame:
    """A row for each copy that a finding stands for. Copies are counted out in blocks, so very many of them never lie in one array."""
    n, start = F.col("n_copies"), F.col("_block") * COPY_BLOCK
    blocks = findings.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / COPY_BLOCK))))
    copies = blocks.withColumn("_copy", F.explode(F.sequence(start + 1, F.least(start + COPY_BLOCK, n))))
    return copies.drop("_block", "_copy").withColumn("n_copies", F.lit(1).cast("long"))


STATUS_RANK = {"PASS": 0, "WARNING": 1, "CONFLICT": 2, "FAIL": 3}


def overall_validation_status() -> Column:
    """Worst status of a group of findings; unchecked ones do not count."""
    worst = F.max(F.coalesce(literal_map(F.col("status"), STATUS_RANK), F.lit(0)))
    return F.element_at(F.array(*[F.lit(s) for s in STATUS_RANK]), worst + 1)


def _count(where: Column) -> Column:
    return F.sum(F.when(where, F.col("n_copies")).otherwise(0)).cast("long")


def findings_summary(findings: DataFrame) -> DataFrame:
    """Counts by status and by category per product, with the overall status."""
    by_category = F.create_map(*[
        x for c in dims.FINDING_CATEGORIES for x in (F.lit(c), _count(F.col("category") == c))])
    out = findings.groupBy("product_id").agg(
        F.sum("n_copies").alias("total_findings"),
        *[_count(F.col("status") == s).alias(f"n_{s.lower()}") for s in dims.FINDING_STATUSES],
        by_category.alias("by_category"), overall_validation_status().alias("overall_status"))
    return out.withColumn("by_category", F.map_filter("by_category", lambda k, v: v > 0))


def batch_validation_report(manifest: DataFrame, summary: DataFrame) -> DataFrame:
    """Products by overall status and finding totals; a manifest id without findings counts as failing."""
    rows = manifest.select("product_id").join(summary, "product_id", "left")
    status = F.coalesce("overall_status", F.lit("FAIL"))

    def total(column: str, name: str) -> Column:
        return F.coalesce(F.sum(column), F.lit(0)).cast("long").alias(name)

    return rows.agg(
        F.count(F.lit(1)).alias("products_processed"),
        F.count_if(status == "PASS").alias("products_passing"),
        F.count_if(status == "WARNING").alias("products_with_warn"),
        F.count_if(status == "CONFLICT").alias("products_with_conflict"),
        F.count_if(status == "FAIL").alias("products_failing"),
        total("total_findings", "total_findings"),
        *[total(f"n_{s.lower()}", f"findings_{s.lower()}") for s in dims.FINDING_STATUSES])


def category_totals(findings: DataFrame) -> DataFrame:
    return findings.groupBy("category").agg(F.sum("n_copies").alias("n_findings"))
