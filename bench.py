"""Headline queries at ``BENCH_SF_DIR`` on ``local[BENCH_CPUS]``; prints one JSON line.

Catalog queries run whole. The specification track is timed stage by stage: each stage reads the stored tables of the
stages before it, as in a batch run, so the stage times add up to the whole track. A result is written to the no-op sink
unless the stage stores it. Every query runs once untimed on the smallest data first, to load classes.
"""

from __future__ import annotations

import json
import os
import sys
import time

from specledger.plans import catalog_queries, explore_queries, inputs, source_queries, spec_queries  # noqa: F401
from specledger.plans.registry import QUERIES
from specledger.session import build_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
WARM_DIR = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
CPUS = os.environ.get("BENCH_CPUS", "8")
TRACK = ["normalized", "fields", "pairs", "findings", "attributes", "reviews", "report"]
WHOLE = ["enrich_catalog", "overall_tier", "resolve_brand", "extract_attributes", "status_distribution", "exact_match_summary",
         "delivery_format", "melt_evidence", "grid_to_evidence", "html_strip", "html_text_specs", "parse_responses", "latest_resolutions"]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(fn) -> float:
    start = time.perf_counter()
    fn()
    return round(time.perf_counter() - start, 3)


def measure(spark, sf_dir: str) -> dict[str, float]:
    inputs.reset()
    track = inputs.track(spark, sf_dir)
    times = {f"track_{stage}": timed(lambda: getattr(track, stage)) for stage in TRACK}
    times.update({name: timed(lambda: run(QUERIES[name](spark, sf_dir))) for name in WHOLE})
    return times


def main() -> None:
    spark = build_session("bench", f"local[{CPUS}]", **{
        "spark.sql.shuffle.partitions": CPUS, "spark.driver.memory": "12g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        # Recording the call site of every column expression costs more than building the plans.
        "spark.python.sql.dataFrameDebugging.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    if os.path.isdir(WARM_DIR):
        measure(spark, WARM_DIR)
    times = measure(spark, SF_DIR)
    rows = inputs.table(spark, SF_DIR, "part").count()
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"), "catalog_rows": rows,
        "catalog_rows_per_second": round(rows / times["overall_tier"], 1)}))
    sys.stdout.flush()
    spark.stop()


if __name__ == "__main__":
    main()
