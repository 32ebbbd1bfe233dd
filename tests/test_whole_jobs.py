"""Queries that must return every row of their job."""

import os

import pytest

import __spark_entry__ as entry
from specledger.operators import validate

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are absent")


@pytest.mark.parametrize("block", [1, 3, 10_000])
def test_one_row_per_copy(spark, monkeypatch, block):
    monkeypatch.setattr(validate, "COPY_BLOCK", block)
    rows = spark.createDataFrame([("A", 1), ("B", 3), ("C", 7)], "product_id string, n_copies long")
    got = sorted(r["product_id"] for r in validate.one_per_copy(rows).collect())
    assert got == ["A"] + ["B"] * 3 + ["C"] * 7


FINDING = ["product_id", "rule_no", "field_pos", "rule_id", "category", "status", "severity", "field", "actual_num", "actual_unit"]


@tables
@pytest.mark.parametrize("name", ["rule_canonical_units", "rule_ranges", "rule_cross_source", "rule_source_pair", "run_rules"])
def test_findings_are_rows(spark, name):
    """One row per finding, not one per group of equal ones."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("region", "part", "lineitem"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    assert df.columns == FINDING
    assert df.count() == len(con.sql(entry.oracle_sql()[name]).fetchall())


@tables
def test_completeness_names_every_stage(spark):
    rows = entry.queries()["audit_completeness"](spark, SF).groupBy("stage").count().collect()
    assert {r["stage"] for r in rows} == {"poles", "answers"}


def test_a_fact_is_shuffled_once(spark):
    """What is kept of a field with one usable fact holds that fact in one place, and the result names it as the first."""
    from pyspark.sql import functions as F

    from specledger.operators import normalize
    from specledger.schema import EVIDENCE, conform

    rows = [("web", "rated_current", "7", "A", 2, 5, "A", 0.5, "http://x"), ("pdf", "rated_current", "n.a.", "A", 0, 1, "B", 0.9, None),
            ("web", "rated_current", "8", "A", 2, 6, "B", 0.5, "http://y")]
    schema = "source_type string, attribute string, raw_value string, unit string, source_rank int, pos long, product_id string, confidence double, url string"
    facts = normalize.normalize(conform(spark.createDataFrame(rows, schema), EVIDENCE))
    kept = facts.withColumn("_key", normalize._narrow_key()).groupBy("product_id").agg(*normalize._field_aggregates(F.lit(1)))
    state = {r["product_id"]: r for r in kept.collect()}
    assert state["A"]["first"] is None and state["A"]["rep"]["key"]["url"] == "http://x" and state["B"]["first"]["raw_value"] == "n.a."
    ids = spark.createDataFrame([("A",), ("B",)], "product_id string")
    fields = {r["product_id"]: r for r in normalize.assemble_fields(facts, ids).filter("canonical_field = 'rated_current'").collect()}
    assert fields["A"]["first_ref"] == fields["A"]["rep_ref"] and fields["A"]["rep_ref"]["product_id"] == "A"
    assert (fields["B"]["first_ref"]["raw_value"], fields["B"]["rep_ref"]["raw_value"], fields["B"]["rep_ref"]["url"]) == ("n.a.", "8", "http://y")


def test_findings_are_not_stored_with_their_texts(spark):
    """Pairs are shuffled for findings without the rest of their provenance, and counts of findings make no texts."""
    from specledger.plans import inputs

    inputs.reset()
    track = inputs.track(spark, SF)
    assert track.disputes.schema["ref_a"].dataType.names == ["source_type"] == track.disputes.schema["ref_b"].dataType.names
    plan = track.summary._jdf.queryExecution().optimizedPlan().toString()
    assert "sources disagree" not in plan and "no usable fact" not in plan
    told = track.attributes.filter("trust_status = 'UNSUPPORTED'").first()
    assert told["fail_text"] and told["reason"] == f"failed: {told['fail_text']}"
    inputs.reset()


def test_a_large_file_is_not_dealt_again(spark, tmp_path):
    """One file with a split per core is read in splits; a small one is dealt to all cores."""
    from specledger.plans import inputs

    cores = spark.sparkContext.defaultParallelism
    spark.range(200_000).selectExpr("id", "cast(rand(1) as string) as t").repartition(1).write.parquet(str(tmp_path / "one"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
        one = spark.read.parquet(str(tmp_path / "one"))
        assert one.rdd.getNumPartitions() >= cores and len(one.inputFiles()) == 1
        assert "RepartitionByExpression" not in inputs.dealt(one, "id")._jdf.queryExecution().analyzed().toString()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    small = spark.range(10).repartition(1)
    small.write.parquet(str(tmp_path / "small"))
    assert cores == 1 or inputs.dealt(spark.read.parquet(str(tmp_path / "small")), "id").rdd.getNumPartitions() == cores


def test_evidence_is_read_once_for_global_facts(spark):
    from specledger.plans import inputs

    inputs.reset()
    track = inputs.track(spark, SF)
    assert "lineitem" not in "".join(track.global_normalized.inputFiles())
    inputs.reset()


def test_hot_keys_are_broadcast_however_large_the_counts(spark):
    """The large side of a spread join is shuffled once, for the join itself."""
    from pyspark.sql import functions as F

    from specledger.operators import skew

    big = spark.range(2000).selectExpr("id % 40 as k", "id as pos")
    small = spark.range(40).selectExpr("id as k", "id * 2 as v")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = skew.join_spread(big, small, ["k"], ["pos"], "inner", counts=big.groupBy("k").agg(F.count(F.lit(1)).alias("n_rows")), hot_rows=20)
        assert out._jdf.queryExecution().sparkPlan().toString().count("SortMergeJoin") == 1
        assert sorted((r["k"], r["pos"], r["v"]) for r in out.collect()) == sorted((i % 40, i, i % 40 * 2) for i in range(2000))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_files_of_stage_tables_are_bounded(spark, monkeypatch):
    from specledger.plans import inputs, tracks

    monkeypatch.setattr(tracks, "FILE_ROWS", 100)
    inputs.reset()
    sizes = inputs.track(spark, SF).normalized.groupBy("_metadata.file_path").count().collect()
    inputs.reset()
    assert len(sizes) > 1 and max(r["count"] for r in sizes) <= 100


@tables
def test_nested_details_are_gathered_once(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("region", "part", "lineitem"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()["product_details_nested"](spark, SF)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Aggregate" in line and "collect_list" in line for line in plan.splitlines()) == 1
    want = con.sql(entry.oracle_sql()["product_details_nested"]).fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in df.collect())
