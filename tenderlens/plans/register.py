"""Metric population register: candidate and eligible counts of every metric."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Metric id, name, grain, candidate population.
METRICS = [
    ("M-P01", "Total planned budget by entity", "budget line",
     "Budget lines (latest release per ocid x projectID)"),
    ("M-C01 / M-C02", "Median tenderers; single-bidder rate (primary)", "OCID",
     "Snapshot OCIDs with a tender"),
    ("M-C01 (sensitivity)", "Median tenderers, NORMAL + ELEVATED", "OCID",
     "Snapshot OCIDs with a tender"),
    ("M-V01", "Median award value", "OCID (one award)", "Snapshot OCIDs with an award"),
    ("M-S01", "Top-supplier award value concentration", "award x supplier", "M-V01 eligible awards"),
    ("P4-BvA", "Budget-to-award comparison", "OCID", "M-V01 eligible awards"),
    ("M-E01", "Median tender duration (days)", "OCID", "Snapshot OCIDs with a tender"),
    ("M-E02", "Median award lag (days)", "OCID", "Snapshot OCIDs with a tender and an award"),
    ("P5-SIG", "Contract signature lag (days)", "contract", "Snapshot contracts"),
    ("M-E03", "Lifecycle conversion", "OCID", "All OCIDs (no exclusions by spec)"),
    ("M-I01", "Implementation reporting coverage", "contract",
     "Snapshot contracts (no exclusions by spec)"),
    ("ENTITY", "Procuring-entity benchmark", "buyer", "Buyer IDs (test entity excluded)"),
]


def _rows(one_row: DataFrame, side: str, counts: dict[str, object]) -> DataFrame:
    """One aggregate to (metric, side, n) rows: several counts per scan."""
    aggs = [c.alias(f"n{i}") for i, c in enumerate(counts.values())]
    pairs = F.array(
        *[
            F.struct(F.lit(m).alias("metric_id"), F.lit(side).alias("side"), F.col(f"n{i}").alias("n"))
            for i, m in enumerate(counts)
        ]
    )
    return one_row.agg(*aggs).select(F.inline(pairs))


def metric_population(v) -> DataFrame:
    core = v.core
    test = core.rules.test_buyer_id
    n = F.count(F.lit(1))
    snap = core.process_snapshot.filter(F.col("buyer_id") != test)
    lines = core.budget_lines.filter(F.col("buyer_id") != test)
    buyers = core.dim_buyer.filter(F.col("test_entity_flag").isNull())
    tenders, contracts = F.count("tender_id"), F.count("contract_id")
    both = F.count_if(F.col("tender_id").isNotNull() & F.col("award_id").isNotNull())
    parts = [
        _rows(lines, "candidate", {"M-P01": n}),
        _rows(
            snap,
            "candidate",
            {
                "M-C01 / M-C02": tenders,
                "M-C01 (sensitivity)": tenders,
                "M-V01": F.count("award_id"),
                "M-E01": tenders,
                "M-E02": both,
                "P5-SIG": contracts,
                "M-E03": n,
                "M-I01": contracts,
            },
        ),
        _rows(buyers, "candidate", {"ENTITY": n}),
        _rows(v.budget_eligible, "eligible", {"M-P01": n}),
        _rows(
            v.competition_eligible,
            "eligible",
            {"M-C01 / M-C02": F.count_if("in_primary_population"), "M-C01 (sensitivity)": n},
        ),
        _rows(v.supplier_award_eligible, "eligible", {"M-S01": F.count_distinct("award_id")}),
        _rows(v.budget_award_comparison, "eligible", {"P4-BvA": n}),
        _rows(v.tender_duration_eligible, "eligible", {"M-E01": n}),
        _rows(v.award_lag_eligible, "eligible", {"M-E02": n}),
        _rows(v.signature_lag_eligible, "eligible", {"P5-SIG": n}),
        _rows(v.lifecycle_stage, "eligible", {"M-E03": n}),
        _rows(v.contract_implementation_coverage, "eligible", {"M-I01": n}),
        _rows(v.entity_benchmark, "eligible", {"ENTITY": n}),
    ]
    awards = v.award_value_eligible
    parts += [
        _rows(awards, "eligible", {"M-V01": n}),
        _rows(awards, "candidate", {"M-S01": n, "P4-BvA": n}),
    ]
    counts = reduce(DataFrame.unionByName, parts).groupBy("metric_id").agg(
        F.sum(F.when(F.col("side") == "candidate", F.col("n"))).alias("candidate_count"),
        F.sum(F.when(F.col("side") == "eligible", F.col("n"))).alias("eligible_count"),
    )
    spark = core.dim_buyer.sparkSession
    meta = spark.createDataFrame(
        [(i, *m) for i, m in enumerate(METRICS, start=1)],
        "sort_order int, metric_id string, metric_name string, grain string, candidate_population string",
    )
    pct = F.round(F.try_divide(F.col("eligible_count") * 100.0, F.col("candidate_count")), 1)
    return (
        counts.join(F.broadcast(meta), "metric_id")  # 12 fixed rows
        .orderBy("sort_order")
        .select(
            "metric_id", "metric_name", "grain", "candidate_population", "candidate_count",
            "eligible_count", pct.alias("eligible_pct"),
        )
    )


def entries(v, *metric_ids: str, with_name: bool = False) -> DataFrame:
    cols = ["metric_id", "candidate_population", "candidate_count", "eligible_count", "eligible_pct"]
    if with_name:
        cols.insert(1, "metric_name")
    return v.metric_population.filter(F.col("metric_id").isin(*metric_ids)).select(*cols)


def view_counts(v, names: list[str]) -> DataFrame:
    """Row count of every view, as one union of one-row aggregates."""
    each = [
        getattr(v, n).agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(f"vw_{n}").alias("view_name"), "row_count")
        for n in names
    ]
    return reduce(DataFrame.unionByName, each)
