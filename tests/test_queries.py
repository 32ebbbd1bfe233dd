"""Registered queries against their SQL on the smallest tables."""

import math
import os
import re

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as entry  # noqa: E402

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
          "benchmark", "labels", "conversations"]
ROWS_ONLY: set[str] = set()
LLM = re.compile(r"op\d+_|pipeline$")
CHECKED = ["normalize_values", "assemble_fields", "cross_source_conflicts", "run_rules", "product_report", "batch_trust_report",
           "review_queue_with_claims", "enrich_catalog", "resolve_brand_trigram", "exact_match", "delivery_format", "html_text_specs",
           "html_table_specs", "html_dl_specs", "html_strip", "match_signal_many", "match_signal_many_joined", "read_catalog_csv", "read_gold_csv", "read_evidence_json",
           "delivery_round_trip", "product_documents", "catalog_documents", "grounding_payload", "catalog_page_deep", "grid_to_evidence", "melt_evidence", "resolve_review", "parse_values", "convert_units"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are absent")


def test_every_query_has_sql():
    assert {q for q in set(entry.queries()) - set(entry.oracle_sql()) if not LLM.match(q)} == ROWS_ONLY
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def connection():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    return str(v)


@pytest.mark.parametrize("name", CHECKED)
def test_query(spark, connection, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    relation = connection.sql(entry.oracle_sql()[name])
    place = [relation.columns.index(c) for c in columns]
    assert sorted(relation.columns) == columns
    assert got == sorted(tuple(plain(r[i]) for i in place) for r in relation.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 200
