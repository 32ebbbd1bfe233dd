import random
import re

import pytest
from pyspark.sql import functions as F

from specledger.operators import audit, catalog, evaluate, signals
from specledger.sinks import delivery
from specledger.sources.stored import catalog_rows

ROW = "row_id long, mfg_part_num string, part_desc string, e1_brand string, unilog_brand string, dib_brand string, part_manuf string"
ROWS = [
    (1, "PDSH4816AF", "PDSH4816AF Dishwasher SS - Display Only", None, None, None, "Appliance Dealers Cooperative (APPDE)"),
    (2, "XYZ-12345", "Random Industrial Tool", None, None, None, "Unverified Generic Supplier (9999)"),
    (3, "TEST-CONFLICT-01", "Conflicted Brand Item", "TREX", None, "Milwaukee", "Freud Inc (2435)"),
    (4, "GCFG3661AF", 'GCFG3661AF 36" Frigidaire Gas Range SS', None, None, None, "Appliance Dealers Cooperative (APPDE)"),
    (5, "DCB518ASTS06G", 'DCB518ASTS06G Diablo 1/2"x18" - Sanding Belt 6pc', None, None, None, "Freud Inc (2435)"),
    (6, "LEG", "DISHWASHER LEG 5 SST 120V 15A 41DBA 50-1/4IN", "Whirlpool", None, "Frigidaire", "X"),
]
DICTIONARY = [
    (0, ["PDSH4816AF", "FRIGIDAIRE", "Frigidaire"], "Rheem Manufacturing", "FRIGIDAIRE®", ""),
    (1, ["WDTS7024RZ", "Whirlpool", "WHIRLPOOL"], "Whirlpool Corporation", "Whirlpool®", ""),
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, ROW)


@pytest.fixture(scope="module")
def dictionary(spark):
    return spark.createDataFrame(DICTIONARY, "entry_pos long, raw_signals array<string>, canonical_manufacturer string, canonical_brand string, trade_name string")


@pytest.fixture(scope="module")
def enriched(rows, dictionary):
    return {r["row_id"]: r for r in catalog.enrich_catalog(rows, dictionary).collect()}


def test_brand_cases(enriched):
    def brand(i):
        r = enriched[i]
        return r["manufacturer_name"]["value"], r["brand_name"]["value"], r["brand_name"]["status"], r["brand_name"]["confidence"]

    assert brand(1) == ("Rheem Manufacturing", "FRIGIDAIRE®", "Verified", 1.0)
    assert brand(2) == (None, None, "Unknown", 0.0)
    assert brand(3) == (None, None, "Conflicted", 0.40)
    assert brand(4) == ("Rheem Manufacturing", "FRIGIDAIRE®", "Inferred", 0.85)
    # A conflict inside the dictionary ends as Unknown unless conflicts are strict.
    assert brand(6)[2] == "Unknown"
    assert enriched[1]["overall_trust_status"] == "Verified" and enriched[3]["has_conflicts"]
    assert [s for s in enriched[4]["brand_name"]["sources"]] == ["Part_Desc='GCFG3661AF 36\" Frigidaire Gas Range SS'"]


def test_strict_conflicts(rows, dictionary):
    got = {r["row_id"]: r["brand_name"]["status"] for r in catalog.enrich_catalog(rows, dictionary, strict_conflicts=True).collect()}
    assert got[6] == "Conflicted" and got[1] == "Verified"


def test_names_and_descriptions(enriched):
    assert enriched[5]["product_name"]["value"] == "Sanding Belt" and enriched[2]["product_name"]["status"] == "Unknown"
    assert enriched[1]["short_desc"]["value"] == "FRIGIDAIRE® PDSH4816AF Dishwasher"
    assert enriched[2]["short_desc"]["value"] == "XYZ-12345" and enriched[2]["short_desc"]["status"] == "Inferred"


def test_attributes_from_text(enriched):
    got = [(a["label"], a["value_num"], a["uom"], a["status"]) for a in enriched[6]["attributes"]]
    assert got == [("Voltage Rating", 120.0, "V", "Verified"), ("Amperage Rating", 15.0, "A", "Verified"),
                   ("Sound Level", 41.0, "dBA", "Verified"), ("Dimension / Size", 50.25, "in", "Inferred")]
    # An inch mark needs a word character after it, by default.
    assert enriched[4]["attributes"] == []


def test_fixed_dimensions(spark):
    df = spark.createDataFrame([('36" range 150in 5"x.045"x7/8" disc',)], "t string")

    def found(**options):
        return [a["value_num"] for a in df.select(catalog.extract_attributes(F.col("t"), **options).alias("a")).first()["a"]]

    assert found() == [5.0, 45.0]
    assert found(fixed_dims=True) == [36.0, 5.0, 0.045, 0.875]


def test_large_dictionary_path_gives_the_same(rows, dictionary):
    def resolutions(**options):
        return {r["row_id"]: r["resolution"] for r in catalog.resolve_brand(rows, dictionary, **options).collect()}

    assert resolutions() == resolutions(inline_bytes=0)


@pytest.mark.parametrize("n", [0, 10, 300, 20_000])
@pytest.mark.parametrize("inline_bytes", [1 << 30, 0])
def test_signals_agree_with_brute_force(spark, n, inline_bytes):
    rng = random.Random(n)
    alphabet = "abc-" if n < 1000 else "abcdefgh-é"
    words = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 6))) for _ in range(n)]
    texts = ["".join(rng.choice("abcABC- " + alphabet) for _ in range(rng.randint(1, 18))) for _ in range(300)] + [None, "", "--", "ab", "-- abc --"]
    entries = [(i, [w, None, ""], f"m{i}", f"b{i}", "") for i, w in enumerate(words)]
    dictionary = spark.createDataFrame(entries, "entry_pos long, raw_signals array<string>, canonical_manufacturer string, canonical_brand string, trade_name string")
    frame = spark.createDataFrame(list(enumerate(texts + texts[:20])), "low int, t string")
    got = {r["low"]: r["m"]["entry_pos"] if r["m"] else None for r in catalog.match_signal(frame, "t", dictionary, inline_bytes=inline_bytes).collect()}
    assert len(got) == len(texts) + 20
    for i, t in enumerate(texts + texts[:20]):
        low = (t or "").strip().lower()
        low = "" if low in ("-", "--") or (low.startswith("--") and low.endswith("--")) else low
        assert got[i] == next((k for k, w in enumerate(words) if low and (w == low or (len(w) >= 3 and w in low))), None), t


def test_only_likely_texts_leave_their_task(spark):
    words = [f"sig-{i * 7919}" for i in range(5000)]
    dictionary = spark.createDataFrame([(i, w, "m", "b", 0, "") for i, w in enumerate(words)],
                                       "entry_pos long, signal string, canonical_manufacturer string, canonical_brand string, signal_pos int, trade_name string")
    frame = spark.createDataFrame([(f"part sig-{i} of something",) for i in range(20_000)], "text string")
    index = signals.signal_index(dictionary, inline_bytes=0)
    likely, matched = signals.match_texts(frame, index, F.col("text"))
    found = sum(any(f"sig-{i}"[:k] in known for k in range(5, 10)) for known in [set(words)] for i in range(20_000))
    assert matched.count() == found > 0
    # Some substrings pass by chance, but most texts without a signal stay where they are.
    assert found <= likely.count() < found + 0.5 * frame.count()


@pytest.mark.parametrize("inline_bytes, find", [(0, signals.likely_signals), (1 << 30, signals.first_signal)])
def test_dictionary_tables_are_not_in_rows(spark, inline_bytes, find):
    """A row that carries a table of the dictionary is a copy of it per text."""
    dictionary = spark.createDataFrame([(i, f"sig-{i}", "m", "b", 0, "") for i in range(500)],
                                       "entry_pos long, signal string, canonical_manufacturer string, canonical_brand string, signal_pos int, trade_name string")
    frame = spark.createDataFrame([(f"a sig-{i}", f"sig-{i} b") for i in range(0, 1000, 100)], "a string, b string")
    found = signals.match_columns(frame, {"x": F.col("a"), "y": F.col("b")}, signals.signal_index(dictionary, inline_bytes=inline_bytes), find)
    widths = [r["w"] for r in found.filter("x is not null and y is not null").select(F.size(F.array("x", "y")).alias("w")).collect()]
    assert len(widths) == 10
    plan = found.filter("x is not null and y is not null")._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search("_(heads|wholes|probe)", plan)


def test_raw_rows(spark):
    raw = spark.createDataFrame([(1, " A ", None, "-- Unbranded --", "-", " TREX ", "N/A")],
                                "row_id long, Mfg_Part_Num string, Part_Desc string, E1_Brand string, Unilog_Brand string, DIB_Brand string, Part_Manuf string")
    assert tuple(catalog_rows(raw).first()) == (1, "A", "", None, None, "TREX", None)


GOLD = "row_id long, mfg_part_num string, expected_mfr_part_num string, expected_manufacturer string, expected_brand string, expected_product_name string, expected_classpath string, expected_long_desc string"


def test_gold_join_and_evaluation(spark, rows, dictionary):
    gold = spark.createDataFrame([(1, "pdsh4816af", "PDSH4816AF", "Rheem Manufacturing", "FRIGIDAIRE®", "Old", "", ""),
                                  (2, "PDSH4816AF ", "PDSH4816AF", "Rheem Manufacturing", "FRIGIDAIRE®", "Dishwasher X", "A>B", "long"),
                                  (3, "NONE", "NONE", "m", "b", "n", "c", "")], GOLD)
    attrs = spark.createDataFrame([(2, 1, "Color", "red", None), (2, 2, "COLOR", "blue", None), (1, 1, "Old", "1", "in")],
                                  "row_id long, ordinal int, label string, value string, uom string")
    out = catalog.enrich_catalog(rows, dictionary, gold, attrs)
    first = out.filter("row_id = 1").first()
    # The last gold row of a part number wins, and a repeated label is added once.
    assert first["product_name"]["value"] == "Dishwasher X" and first["classpath"]["value"] == "A>B"
    assert [(a["label"], a["value_str"]) for a in first["attributes"]] == [("Color", "red")]
    matches = evaluate.exact_match(out, gold)
    assert matches.count() == 10  # the gold row without an input row is skipped
    total = [r for r in evaluate.exact_match_summary(matches).collect() if r["row_id"] is None][0]
    assert (total["fields_compared"], total["fields_matched"], total["accuracy_pct"]) == (10, 9, 90.0)


def test_distribution_adds_up(rows, dictionary):
    out = catalog.enrich_catalog(rows, dictionary)
    distribution = evaluate.status_distribution(out)
    assert distribution.count() == 12 and audit.audit_distribution_sums(distribution).count() == 0
    lov = evaluate.lov_compliance(out, catalog.signals(dictionary)).first()
    assert lov["populated_values"] == lov["in_dictionary"] == 4 and lov["lov_compliance_pct"] == 100.0


def test_delivery(spark, rows, dictionary, tmp_path):
    headers = ["Mfg_Part_Num", "BRAND_NAME", "UPC", "ATTRIBUTE_LABEL 1", "ATTRIBUTE_VALUE 1", "ATTRIBUTE_UOM_1", "ATTRIBUTE_LABEL_1"]
    out = delivery.to_delivery(catalog.enrich_catalog(rows, dictionary), headers)
    assert out.columns == headers and out.filter(" or ".join(f"`{h}` is null" for h in headers)).count() == 0
    row = out.filter("Mfg_Part_Num = 'LEG'").first()
    assert (row["ATTRIBUTE_LABEL 1"], row["ATTRIBUTE_VALUE 1"], row["ATTRIBUTE_UOM_1"], row["ATTRIBUTE_LABEL_1"]) == ("Voltage Rating", "120.0", "V", "")
    assert delivery.unmapped_headers(headers) == ["UPC"]
    coverage = {r["header"]: r["n_filled"] for r in delivery.delivery_coverage(out).collect()}
    assert coverage["UPC"] == 0 and coverage["Mfg_Part_Num"] == 6
    delivery.write_delivery_csv(out, str(tmp_path / "out"))
    back = spark.read.csv(str(tmp_path / "out"), header=True, escape='"')
    assert back.columns == headers and back.count() == 6


def test_dictionary_from_gold(spark):
    gold = spark.createDataFrame([(1, "A1", "Sup", "M", "B", ""), (2, "A2", "--", "M", "B", ""), (3, "A3", None, "N", "C", "t")],
                                 "row_id long, mfg_part_num string, raw_manuf string, expected_manufacturer string, expected_brand string, expected_trade_name string")
    inputs = spark.createDataFrame([(1, "A1", "x", "-- Unbranded --", "-", "Bx", "Sup (1)")], ROW)
    built = catalog.build_brand_dictionary(gold, inputs)
    got = {(r["entry_pos"], r["signal"]): r["is_part_number"] for r in built.collect()}
    assert got == {(1, "A1"): True, (1, "A2"): True, (1, "Sup"): False, (1, "Bx"): False, (1, "Sup (1)"): False, (3, "A3"): True}
