import pytest
from pyspark.sql import functions as F

from specledger.operators import audit, claims, explore, normalize, skew, trust, validate
from specledger.plans.tracks import SpecTrack
from specledger.schema import EVIDENCE, conform

PID = "MTR-W22SP-4P-1.1"
FACT = "source_type string, attribute string, raw_value string, value double, unit string, source_rank int, pos long, product_id string, confidence double, page int, row long, `column` string"
DEMO = [
    ("pdf", "rated_power", "1.1", 1.1, "kW", 0, 1, PID, 0.92, 5, None, None),
    ("pdf", "rated_power_hp", "1.5", 1.5, "HP", 0, 2, PID, 0.92, 5, None, None),
    ("pdf", "rated_current", "2.34", 2.34, "A", 0, 3, PID, 0.92, 5, None, None),
    ("csv", "rated_current", "7.22", 7.22, "A", 1, 1, PID, 0.85, None, 1, "full_load_current_a"),
    ("pdf", "rated_speed", "1455", 1455.0, "rpm", 0, 4, PID, 0.92, 5, None, None),
    ("pdf", "weight", "19.5", 19.5, "kg", 0, 5, PID, 0.92, 5, None, None),
    ("csv", "ip_rating_note", "IP56+ sealing described", 56.0, None, 1, 2, PID, 0.85, None, 1, "ip_note"),
    ("pdf", "full_load_torque_nm", "7.22", 7.22, "Nm", 0, 6, PID, 0.92, 5, None, None),
    ("csv", "source_location", "p.5", None, None, 1, 3, PID, 0.85, None, 1, "source_location"),
    ("pdf", "rated_voltage", "400", 400.0, "V", 3, 1, "GLOBAL", 0.8, 4, None, None),
    ("pdf", "rated_voltage", "400", 400.0, "V", 3, 2, "GLOBAL", 0.8, 5, None, None),
]
EMPTY = "MTR-W22SP-6P-9"


def evidence(spark, rows):
    return conform(spark.createDataFrame(rows, FACT), EVIDENCE)


def products(spark, *ids, version="2.0.0"):
    return spark.createDataFrame([(i, "ACME", "W22", version) for i in ids],
                                 "product_id string, manufacturer string, model string, normalization_version string")


@pytest.fixture(scope="module")
def demo(spark, tmp_path_factory):
    answers = spark.createDataFrame([
        (PID, '```json\n{"summary": "s", "inferred_fields": {"frequency": "50 Hz", "poles": 4}, "source_backed_claims": [{"claim_text": "x", "category":'
              ' "performance", "field": "rated_current"}, {"no": 1}], "inferred_claims": [{"claim_text": "y"}], "unresolved_conflicts": [{"field":'
              ' "rated_power", "description": "d"}]}\n```'), (EMPTY, "garbage")], "product_id string, response string")
    return SpecTrack(evidence(spark, DEMO), products(spark, PID, EMPTY), answers, folder=str(tmp_path_factory.mktemp("stages")))


def by_field(df, pid=PID, key="canonical_field"):
    return {r[key]: r for r in df.filter(F.col("product_id") == pid).collect()}


def test_demo_fields(demo):
    f = by_field(demo.fields)
    assert len(f) == 11
    assert f["rated_voltage"]["value_num"] == 400.0 and f["rated_voltage"]["outcome"] == "passthrough" and f["rated_voltage"]["n_refs"] == 2
    assert f["rated_speed"]["value_num"] == 1455.0 and f["weight"]["value_num"] == 19.5
    assert f["ip_rating"]["value_str"] == "IP56"
    for name in ("rated_power", "rated_current"):
        assert f[name]["outcome"] == "conflict" and f[name]["value_num"] is None
    assert {n for n, r in f.items() if r["outcome"] == "missing"} == {"frequency", "poles", "efficiency", "power_factor", "frame_size"}
    assert [r["attribute"] for r in demo.unmapped.collect()] == ["full_load_torque_nm"]


def test_demo_conflicts(demo):
    pairs = {r["canonical_field"]: r for r in demo.pairs.collect()}
    assert (pairs["rated_current"]["value_a"], pairs["rated_current"]["value_b"]) == (2.34, 7.22)
    assert pairs["rated_power"]["value_b"] == 1.11855
    assert pairs["rated_current"]["ref_b"]["column"] == "full_load_current_a"


def test_demo_findings(demo):
    rows = demo.findings.filter(F.col("product_id") == PID).collect()
    status = {(r["rule_id"], r["field"]): r["status"] for r in rows}
    assert status[("ENGINEERING_TORQUE_POWER_RPM", "full_load_torque_nm")] == "PASS"
    assert status[("ENGINEERING_SYNCHRONOUS_SPEED", "rated_speed")] == "PASS"
    assert status[("CONFLICT_RATED_CURRENT_PDF_VS_CSV", "rated_current")] == "CONFLICT"
    assert status[("RANGE_RATED_CURRENT_POSITIVE", "rated_current")] == "PASS"
    assert status[("IMPORTANT_FIELD_PRESENCE", "efficiency")] == "WARNING"
    # Every rule leaves its rows: 6 units + version + 3 + 3 + 7 ranges + 2 conflicts + 3 engineering + 4 optional + named conflict.
    assert len(rows) == 6 + 1 + 3 + 3 + 7 + 2 + 3 + 4 + 1


def test_empty_product_fails_required_fields(demo):
    rows = demo.findings.filter((F.col("product_id") == EMPTY) & (F.col("status") == "FAIL")).collect()
    assert {r["field"] for r in rows} == {"rated_power", "rated_speed"}  # the voltage comes from the facts for all
    summary = {r["product_id"]: r for r in demo.summary.collect()}
    assert summary[EMPTY]["overall_status"] == "FAIL" and summary[PID]["overall_status"] == "CONFLICT"


def test_demo_trust(demo):
    a = by_field(demo.attributes, key="field")
    assert (a["weight"]["trust_status"], a["weight"]["publishability"], a["weight"]["confidence_score"]) == ("TRUSTED", "PUBLISHABLE", 1.0)
    assert (a["rated_current"]["trust_status"], a["rated_current"]["value_num"]) == ("CONFLICTED", None)
    assert (a["frequency"]["trust_status"], a["frequency"]["value_str"], a["frequency"]["confidence_score"]) == ("UNVERIFIED", "50 Hz", 0.70)
    assert a["frame_size"]["trust_status"] == "MISSING" and a["efficiency"]["trust_status"] == "REVIEW_REQUIRED"
    claims_by_type = {r["claim_type"]: r for r in demo.claim_results.collect()}
    assert claims_by_type["SOURCE_BACKED"]["trust_status"] == "CONFLICTED" and claims_by_type["SOURCE_BACKED"]["confidence"] == 0.40
    assert claims_by_type["INFERRED"]["trust_status"] == "UNVERIFIED"
    overall = {r["product_id"]: r for r in demo.report.collect()}
    assert overall[PID]["overall_trust_status"] == "CONFLICTED" and overall[EMPTY]["overall_trust_status"] == "UNSUPPORTED"
    assert overall[PID]["conflicts_count"] == 2  # one named by the answer, one it left out


def test_audits_are_empty(demo):
    assert audit.audit_no_winner(demo.fields, demo.findings).count() == 0
    assert audit.audit_missing_null(demo.fields).count() == 0
    assert audit.audit_provenance(demo.evidence).count() == 0
    assert audit.audit_completeness(demo.products, {"fields": demo.fields, "trust": demo.attributes}).count() == 0


def test_open_conflicts_add_what_the_answer_left_out(demo):
    rows = {r["field"]: r["added"] for r in claims.open_conflicts(demo.parsed, demo.findings).collect()}
    assert rows == {"rated_power": False, "rated_current": True}


def test_malformed_answers_are_errors(spark):
    df = spark.createDataFrame([("a", "prose {\"summary\": \"x\"} more"), ("b", "{\"summary\": "), ("c", "[1]"), ("d", None)], "product_id string, response string")
    got = {r["product_id"]: (r["answer"]["summary"] if r["answer"] else None) for r in claims.parse_responses(df).collect()}
    assert got == {"a": "x", "b": None, "c": None, "d": None}


@pytest.mark.parametrize("power, speed, torque, want", [
    (1.1, 1455.0, 7.22, "PASS"), (1.1, 1455.0, 100.0, "WARNING"), (None, 1455.0, 7.22, "NOT_CHECKED"), (1.1, None, 7.22, "NOT_CHECKED"),
    (1.1, 1455.0, None, "NOT_CHECKED"), (1.1, -5.0, 7.22, "FAIL")])
def test_torque(spark, power, speed, torque, want):
    row = spark.createDataFrame([("X", power, speed, torque)], "product_id string, power_kw double, speed_rpm double, torque_nm double")
    assert validate.check_torque(row).first()["status"] == want


@pytest.mark.parametrize("pid, speed, poles, hertz, want", [
    ("X-4P-1", 1455.0, None, None, "PASS"), ("X-4P-1", 1600.0, None, None, "FAIL"), ("X-4P-1", 1499.9, None, None, "WARNING"),
    ("X", 1455.0, None, None, "NOT_CHECKED"), ("X", 1455.0, 4.0, None, "PASS"), ("X-4P-1", 1700.0, None, 60.0, "PASS"),
    ("X-12P-1", 1455.0, None, None, "PASS"), ("X-4P-1", None, None, None, "NOT_CHECKED"), ("X-4P-1", 0.0, None, None, "FAIL")])
def test_sync_speed(spark, pid, speed, poles, hertz, want):
    row = spark.createDataFrame([(pid, speed, poles, hertz)], "product_id string, speed_rpm double, poles double, frequency double")
    assert validate.check_sync_speed(row).first()["status"] == want


def test_version_rule(spark):
    assert validate.check_version(products(spark, "A", version="1.0.0")).first()["status"] == "WARNING"


@pytest.mark.parametrize("attribute, value, unit, rule, want", [
    ("rated_power", 0.0, "kW", "RANGE_RATED_POWER_POSITIVE", "FAIL"), ("rated_power", -1.0, "kW", "RANGE_RATED_POWER_POSITIVE", "FAIL"),
    ("efficiency", 150.0, "%", "RANGE_EFFICIENCY_BOUNDS", "FAIL"), ("efficiency", 0.0, "%", "RANGE_EFFICIENCY_BOUNDS", "PASS"),
    ("power_factor", 1.2, None, "RANGE_POWER_FACTOR_BOUNDS", "FAIL"), ("weight", 0.0, "kg", "RANGE_WEIGHT_POSITIVE", "FAIL")])
def test_ranges(spark, attribute, value, unit, rule, want):
    facts = evidence(spark, [("pdf", attribute, str(value), value, unit, 0, 1, "A", 0.9, 1, None, None)])
    t = SpecTrack(facts, products(spark, "A"))
    got = validate.check_ranges(t.fields, t.pairs, t.normalized).filter(F.col("rule_id") == rule).collect()
    assert [r["status"] for r in got] == [want]


def _hot(spark):
    """One product with most of the facts, in several values."""
    rows = [("web", "rated_current", str(1 + i % 7), None, "A", 2, i, "HOT", 0.55, None, None, None) for i in range(400)]
    rows += [("web", "rated_current", str(1 + i % 2), None, "A", 2, 0, f"P{i}", 0.55, None, None, None) for i in range(20)]
    rows += [("pdf", "rated_current", "1", None, "A", 0, 0, f"P{i}", 0.9, 1, None, None) for i in range(20)]
    return evidence(spark, rows), products(spark, "HOT", *[f"P{i}" for i in range(20)])


def test_hot_products_are_split_without_changing_results(spark, monkeypatch):
    facts, ids = _hot(spark)
    normalized = normalize.normalize(facts)
    fields = normalize.assemble_fields(normalized, ids)

    def pairs():
        rows = normalize.conflicts(normalized, fields).collect()
        return sorted((r["product_id"], r["value_a"], r["value_b"], r["pos"]) for r in rows)

    whole = pairs()
    assert len([p for p in whole if p[0] == "HOT"]) == 400 - len(range(0, 400, 7))
    original = skew.join_spread
    monkeypatch.setattr(normalize, "join_spread", lambda *a, **k: original(*a, **{**k, "hot_rows": 3}))
    assert pairs() == whole


def test_results_do_not_depend_on_row_order(spark):
    facts, ids = _hot(spark)

    def fields(df):
        rows = normalize.assemble_fields(normalize.normalize(df), ids).collect()
        return sorted((r["product_id"], r["canonical_field"], r["outcome"], r["value_num"] or 0, r["confidence"] or 0, r["n_refs"]) for r in rows)

    base = fields(facts)
    for seed in (1, 2):
        assert fields(facts.orderBy(F.rand(seed)).repartition(5)) == base


def test_global_conflicts_count_copies(spark):
    rows = [("pdf", "rated_voltage", "380", 380.0, "V", 0, 1, "A", 0.9, 1, None, None)]
    rows += [("pdf", "rated_voltage", "400", 400.0, "V", 3, i, "GLOBAL", 0.8, i, None, None) for i in range(1, 4)]
    t = SpecTrack(evidence(spark, rows), products(spark, "A", "B"))
    assert {r["product_id"]: (r["outcome"], r["n_refs"]) for r in t.fields.filter("canonical_field = 'rated_voltage'").collect()} == {
        "A": ("conflict", 4), "B": ("passthrough", 3)}
    assert [(r["product_id"], r["n_copies"]) for r in t.pairs.collect()] == [("A", 3)]
    # Equal copies are one finding with their number.
    found = t.findings.filter("rule_id = 'CONSISTENCY_CROSS_SOURCE'").collect()
    assert [r["n_copies"] for r in found] == [3] and t.summary.filter("product_id = 'A'").first()["n_conflict"] == 3


def test_resolutions(spark):
    columns = "review_id string, product_id string, selected_source string, resolved_value string, resolution_note string, resolved_by string, resolved_at string, entry_no long"
    log = spark.createDataFrame([("REV-A-1-x", "A-1", "pdf", "1", "n", "qa", "2026-01-01", 1)], columns)
    new = spark.createDataFrame([("REV-A-1-x", "", "csv", "2", "n", "qa", "2026-01-02", 2), ("REV-zz", "", "csv", "3", "n", "qa", "2026-01-02", 3),
                                 ("REV-a-12-y", "", "csv", "4", "n", "qa", "2026-01-02", 4)], columns)
    ids = spark.createDataFrame([("A-1",), ("a-12",), ("a-1",)], "product_id string")
    got = {r["review_id"]: (r["product_id"], r["resolved_value"]) for r in explore.resolve_review(log, new, ids).collect()}
    # The first id in order that is contained, upper and lower case told apart.
    assert got == {"REV-A-1-x": ("A-1", "2"), "REV-zz": ("", "3"), "REV-a-12-y": ("a-1", "4")}


def test_dedupe_keeps_the_first(spark, demo):
    items = trust.review_items(demo.attributes, demo.findings, demo.claim_results)
    rows = trust.dedupe_reviews(items.unionByName(items)).collect()
    assert all(r["n_collapsed"] % 2 == 0 for r in rows) and len({r["review_id"] for r in rows}) == len(rows)


def test_first_fact_does_not_depend_on_arrival(spark):
    """Two sources of one type count their facts from one each; the first source comes first, whatever the order of the rows."""
    rows = [("csv", s, "weight", f"{v}", float(v), "kg", 1, pos, "A", 0.8, u) for s, base in (("file-b", 10), ("file-a", 20), ("file-c", 30))
            for pos, u, v in ((1, "x", base), (2, "w", base + 1), (1, "y", base + 2))]
    schema = ("source_type string, source_id string, attribute string, raw_value string, value double, unit string, source_rank int, pos long, product_id string,"
              " confidence double, url string")
    seen = set()
    for seed in range(4):
        import random

        shuffled = random.Random(seed).sample(rows, len(rows))
        facts = normalize.normalize_values(normalize.map_attributes(conform(spark.createDataFrame(shuffled, schema).repartition(1 + seed), EVIDENCE)))
        fields = normalize.assemble_fields(facts, products(spark, "A"))
        row = fields.filter("canonical_field = 'weight'").first()
        first = normalize.representative(facts).first()
        pairs = sorted((r["value_a"], r["value_b"]) for r in normalize.conflicts(facts, fields).collect())
        seen.add((row["rep_num"], row["rep_ref"]["source_id"], row["rep_ref"]["url"], row["first_ref"]["raw_value"], first["value_num"], tuple(pairs)))
    assert seen == {(20.0, "file-a", "x", "20", 20.0, tuple((20.0, v) for v in (10.0, 11.0, 12.0, 21.0, 22.0, 30.0, 31.0, 32.0)))}


def test_disputed_ranges(spark):
    """A conflicted field passes its range only if no value of a pair and no parsed value is outside."""
    rows = []
    for pid, values in {"ok": ((60.0, "%"), (70.0, "%")), "high": ((60.0, "%"), (170.0, "%")), "raw": ((0.6, None), (-0.1, None), (70.0, "%"))}.items():
        rows += [("csv", "efficiency", str(v), v, u, 1, i, pid, 0.8, None, i, "e") for i, (v, u) in enumerate(values)]
    t = SpecTrack(evidence(spark, rows), products(spark, "ok", "high", "raw"))
    found = t.findings.filter("rule_id = 'RANGE_EFFICIENCY_BOUNDS'").groupBy("product_id", "status").agg(F.sum("n_copies").alias("n")).collect()
    assert {(r["product_id"], r["status"]): r["n"] for r in found} == {("ok", "PASS"): 1, ("high", "FAIL"): 2, ("raw", "FAIL"): 2}


@pytest.mark.parametrize("rows", [1, 7, 1000])
def test_join_few_deals_a_hot_key(spark, rows):
    big = spark.createDataFrame([("hot" if i % 4 else f"k{i % 3}", i) for i in range(60)], "k string, i int")
    few = spark.createDataFrame([(k, n) for k in ("hot", "k0", "absent") for n in range(3)], "k string, n int")
    got = skew.join_few(big, few, "k", "i", rows).collect()
    want = {(k, i, n) for k, i in (("hot" if i % 4 else f"k{i % 3}", i) for i in range(60)) if k in ("hot", "k0") for n in range(3)}
    assert len(got) == len(want) and {(r["k"], r["i"], r["n"]) for r in got} == want


def test_inferred_null_is_unverified(spark):
    answers = spark.createDataFrame([("A", '{"inferred_fields": {"poles": null, "frequency": "50"}}')], "product_id string, response string")
    t = SpecTrack(evidence(spark, [(*DEMO[0][:7], "A", *DEMO[0][8:])]), products(spark, "A"), answers)
    state = {r["field"]: r["trust_status"] for r in t.attributes.collect()}
    assert (state["poles"], state["frequency"], state["frame_size"]) == ("UNVERIFIED", "UNVERIFIED", "MISSING")


def test_stored_log_of_resolutions(spark, tmp_path):
    schema = "review_id string, selected_source string, resolved_value string, resolution_note string, resolved_by string, resolved_at string, entry_no long"
    ids = spark.createDataFrame([("P-1",), ("P-2",)], "product_id string")
    path, runs = str(tmp_path / "log"), [[("REV-P-1-x", "a", 1), ("REV-P-2-x", "b", 2)], [("REV-P-1-x", "c", 3)], [("REV-P-1-x", "older", 0), ("REV-none", "d", 4)]]
    for k, run in enumerate(runs):
        new = spark.createDataFrame([(r, "s", v, "n", "qa", f"2024-01-0{n + 1}", n) for r, v, n in run], schema)
        explore.append_resolutions(new, ids, path)
        if k == 1:
            explore.compact_resolutions(spark, path, str(tmp_path / "compact"))
            assert spark.read.parquet(str(tmp_path / "compact")).count() == 2
            path = str(tmp_path / "compact")
    got = {r["review_id"]: (r["product_id"], r["resolved_value"]) for r in explore.read_resolutions(spark, path).collect()}
    assert got == {"REV-P-1-x": ("P-1", "c"), "REV-P-2-x": ("P-2", "b"), "REV-none": ("", "d")}
    assert [r["resolved_value"] for r in explore.read_resolutions(spark, path, "REV-P-2-x").collect()] == ["b"]
    # A second log at the place of another is refused; the first one stays.
    with pytest.raises(Exception):
        explore.compact_resolutions(spark, path, str(tmp_path / "log"))


@pytest.mark.parametrize("width", [1, 10, 1000])
def test_pages_by_index(spark, width):
    ids = [i for i in range(3, 300) if i % 7 and not 100 < i < 140]
    records = spark.createDataFrame([(i,) for i in ids], "row_id long").repartition(3)
    index = explore.page_index(records, width)
    for page in (1, 2, 9, 22, 23, 24, 40):
        assert [r["row_id"] for r in explore.page_at(records, index, page, 10).collect()] == ids[(page - 1) * 10:page * 10]
    assert [r["row_id"] for r in explore.next_page(records, 98, 3).collect()] == [i for i in ids if i > 98][:3]


def test_documents_have_bounded_lines(spark, demo, monkeypatch):
    import json

    from specledger.sinks import delivery

    monkeypatch.setattr(delivery, "LINE_ENTRIES", 2)
    lines = [json.loads(r["document"]) for r in delivery.product_documents(demo.fields, demo.products, demo.normalized, demo.pairs, demo.unmapped).collect()]
    assert all(len(d["entries"]) <= 2 for d in lines if d["section"] != "product") and {d["product_id"] for d in lines} == {PID, EMPTY}
    entries = [(d["section"], e) for d in lines if d["product_id"] == PID for e in d["entries"]]
    assert sum(s == "refs" for s, _ in entries) == demo.normalized.count() and [e["attribute"] for s, e in entries if s == "unmapped"] == ["full_load_torque_nm"]
    assert {e["field"] for s, e in entries if s == "conflicts"} == {"rated_power", "rated_current"}
    conflict = next(e for s, e in entries if s == "conflicts" and e["field"] == "rated_current")
    assert (conflict["value_a"], conflict["value_b"], conflict["ref_a"]["source_type"], conflict["ref_b"]["page"] if "page" in conflict["ref_b"] else None) == (2.34, 7.22, "pdf", None)


def test_documents_are_stored_packed(spark, demo, tmp_path):
    import os

    from specledger.sinks import delivery

    documents = delivery.product_documents(demo.fields, demo.products, demo.normalized, demo.pairs, demo.unmapped).select("document").crossJoin(spark.range(200)).coalesce(1)
    delivery.write_products(documents, path := str(tmp_path / "documents"))
    want = sorted(r["document"] for r in documents.collect())
    assert sorted(r["value"] for r in spark.read.text(path).collect()) == want
    assert sum(os.path.getsize(f"{path}/{f}") for f in os.listdir(path) if f.startswith("part")) < sum(map(len, want)) / 5
