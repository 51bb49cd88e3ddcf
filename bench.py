"""Headline timings: one JSON line with wall-clock seconds per query.

``build`` is the whole path from order tables to staging, snapshot and the 16
views; the other keys run against those stored tables, each to its last row.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from tenderlens import catalog

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = [
    "k01_budget_lines", "k07_process_snapshot", "k10_dim_buyer", "k11_dim_supplier",
    "v01_budget_eligible", "v02_competition_eligible", "v03_award_value_eligible", "v04_supplier_award_eligible",
    "v05_budget_award_comparison", "v06_tender_duration_eligible", "v07_award_lag_eligible", "v08_signature_lag_eligible",
    "v09_lifecycle_stage", "v10_contract_implementation_coverage", "v11_entity_benchmark", "v12_metric_population",
    "v13_dq_impact", "v16_award_scale_flag", "q1_1_population_disclosure", "q1_2_overall_concentration",
    "q1_3_top_suppliers", "q1_5_concentration_by_entity", "q1_6_concentration_sensitivity", "q2_6_competition_extremes",
    "q3_2_ratio_percentiles", "q3_5_entity_variance", "q4_2_timing_distribution", "q5_4_kpi_profile",
    "q6_6_lifecycle_funnel", "q7_1_exclusions_by_metric", "q7_2_issue_matrix", "q7_3_issues_across_metrics",
    "c03_referential_integrity", "c09_analytical_views", "c10_business_questions", "r_all_figures",
]


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-tables-"))
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="bench-warehouse-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    spark = session()
    timings: dict[str, float] = {}

    def timed(name, action):
        start = time.perf_counter()
        action()
        timings[name] = round(time.perf_counter() - start, 3)

    ws = catalog.workspace(spark, SF_DIR)
    timed("build", ws.build_all)
    for name in HEADLINE:
        timed(name, lambda: catalog.run(name, spark, SF_DIR).write.format("noop").mode("overwrite").save())
    total = round(sum(timings.values()), 3)
    print(json.dumps({
        "metric": "total wall-clock of the headline queries", "value": total, "unit": "sec", "queries": timings,
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
