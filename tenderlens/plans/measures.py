"""Measures under filters, read from the views themselves: one row per call, filters apply where a view carries the field.

``cube`` reads the same measures from pre-aggregated cells; this is the other formulation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlens.functions import bands
from tenderlens.operators.concentration import hhi, holder_totals, top_share_with_ties
from tenderlens.operators.order_stats import exact_percentiles
from tenderlens.plans.common import dbl, ratio, rows, union
from tenderlens.plans.questions_entity import KPIS, _gated
from tenderlens.plans.questions_supply import AWARD
from tenderlens.plans.questions_value import BUDGET, RATIO
from tenderlens.plans.views import METHOD_VIEWS, median, method, rate

# Which views carry which filter field.
BUYER_VIEWS = {
    "lifecycle_stage", "budget_eligible", "competition_eligible", "award_value_eligible", "supplier_award_eligible",
    "budget_award_comparison", "tender_duration_eligible", "award_lag_eligible", "signature_lag_eligible",
    "contract_implementation_coverage", "entity_benchmark",
}
FLAG_VIEWS = {"award_value_eligible", "supplier_award_eligible", "budget_award_comparison"}


# Filter field -> the views that carry it, and where they have it.
FIELDS = {
    "buyer": (BUYER_VIEWS, lambda: F.col("buyer_id")),
    "method": (set(METHOD_VIEWS), method),
    "tender_status": ({"competition_eligible"}, lambda: F.col("tender_status")),
    "contract_status": ({"contract_implementation_coverage"}, lambda: F.col("contract_status")),
    "tender_start_year": ({"tender_duration_eligible"}, lambda: F.year("tender_start_date")),
    "award_year": ({"award_lag_eligible"}, lambda: F.year("award_date")),
}


def filtered(v, view: str, filters: dict) -> DataFrame:
    """``filters``: buyer, method, tender_status, contract_status, tender_start_year,
    award_year, scale_flag='exclude'. A filter leaves other views unchanged."""
    df = getattr(v, view)
    for name, value in filters.items():
        if name == "scale_flag":
            if value == "exclude" and view in FLAG_VIEWS:
                df = df.join(v.award_scale_flag.select("award_id"), "award_id", "left_anti")
            continue
        views, column = FIELDS[name]
        if view in views and value is not None:
            df = df.filter(column() == value)
    return df


PRIMARY = "in_primary_population"


def _stage(k) -> Column:
    return F.count_if(F.col("highest_stage_rank") >= k)


# name -> (view, aggregate of the parameters); one scan, one row.
SIMPLE = {
    "processes": ("lifecycle_stage", lambda p: rows()),
    "planning_only_share": ("lifecycle_stage", lambda p: rate(F.col("highest_stage_rank") == 1)),
    "processes_reaching_stage": ("lifecycle_stage", lambda p: _stage(p["stage"])),
    "stage_conversion_rate": ("lifecycle_stage", lambda p: ratio(_stage(p["stage"]), _stage(p["stage"] - 1))),
    "planned_budget": ("budget_eligible", lambda p: F.sum(BUDGET)),
    "budget_lines": ("budget_eligible", lambda p: rows()),
    "award_value": ("award_value_eligible", lambda p: F.sum(AWARD)),
    "eligible_awards": ("award_value_eligible", lambda p: rows()),
    "supplier_awards": ("supplier_award_eligible", lambda p: F.count_distinct("award_id")),
    "suppliers": ("supplier_award_eligible", lambda p: F.count_distinct("supplier_id")),
    "supplier_value": ("supplier_award_eligible", lambda p: F.sum(AWARD)),
    "competition_n_primary": ("competition_eligible", lambda p: F.count_if(PRIMARY)),
    "competition_n_sensitivity": ("competition_eligible", lambda p: rows()),
    "median_tenderers_primary": ("competition_eligible", lambda p: median(F.col("number_of_tenderers"), F.col(PRIMARY))),
    "median_tenderers_sensitivity": ("competition_eligible", lambda p: median(F.col("number_of_tenderers"))),
    "single_bidder_rate_primary": ("competition_eligible", lambda p: rate(F.col("is_single_bidder"), F.col(PRIMARY))),
    "single_bidder_rate_sensitivity": ("competition_eligible", lambda p: rate(F.col("is_single_bidder"))),
    "tenders_in_band": ("competition_eligible", lambda p: F.count_if(
        (bands.participation_band(F.col("number_of_tenderers"), [F.lit(i) for i in range(1, 9)]) == p["band"])
        & (F.col(PRIMARY) if p.get("population", "primary") == "primary" else ~F.col(PRIMARY)))),
    "comparable_processes": ("budget_award_comparison", lambda p: rows()),
    "comparable_budget": ("budget_award_comparison", lambda p: F.sum(BUDGET)),
    "comparable_award": ("budget_award_comparison", lambda p: F.sum(AWARD)),
    "net_variance": ("budget_award_comparison", lambda p: F.sum("variance_amount")),
    "aggregate_ratio": ("budget_award_comparison", lambda p: ratio(F.sum(AWARD), F.sum(BUDGET))),
    "share_within_10pct": ("budget_award_comparison", lambda p: rate(F.col(RATIO).between(0.9, 1.1))),
    "small_budgets": ("budget_award_comparison", lambda p: F.count_if(F.col(BUDGET) < p.get("limit", 100000))),
    "comparable_in_band": ("budget_award_comparison", lambda p: F.count_if(
        bands.ratio_band(F.col(RATIO), [F.lit(i) for i in range(1, 7)]) == p["band"])),
    "tender_duration_n": ("tender_duration_eligible", lambda p: rows()),
    "award_lag_n": ("award_lag_eligible", lambda p: rows()),
    "signature_lag_n": ("signature_lag_eligible", lambda p: rows()),
    "median_tender_duration": ("tender_duration_eligible", lambda p: median(F.col("tender_duration_days"))),
    "median_award_lag": ("award_lag_eligible", lambda p: median(F.col("award_lag_days"))),
    "median_signature_lag": ("signature_lag_eligible", lambda p: median(F.col("signature_lag_days"))),
    "p90_tender_duration": ("tender_duration_eligible", lambda p: F.percentile("tender_duration_days", 0.9)),
    "p90_award_lag": ("award_lag_eligible", lambda p: F.percentile("award_lag_days", 0.9)),
    "p90_signature_lag": ("signature_lag_eligible", lambda p: F.percentile("signature_lag_days", 0.9)),
    "award_lag_over_year_share": ("award_lag_eligible", lambda p: rate(F.col("award_lag_days") > 365)),
    "entities": ("entity_benchmark", lambda p: rows()),
    "entity_processes": ("entity_benchmark", lambda p: F.sum("process_count")),
    "entity_planned_budget": ("entity_benchmark", lambda p: F.sum("planned_budget_total")),
    "entity_award_value": ("entity_benchmark", lambda p: F.sum("award_value_total")),
    "median_entity_single_bidder_rate": ("entity_benchmark", lambda p: median(F.col("single_bidder_rate"), F.col("competition_n") >= p["min_n"])),
    "median_entity_top_supplier_share": ("entity_benchmark", lambda p: median(F.col("top_supplier_value_share"), F.col("award_n") >= p["min_n"])),
    "median_entity_implementation": ("entity_benchmark", lambda p: median(F.col("implementation_coverage_rate"), F.col("contract_n") >= p["min_n"])),
    "entity_kpi": ("entity_benchmark", lambda p: F.max(p["kpi"])),
    "contracts": ("contract_implementation_coverage", lambda p: rows()),
    "contracts_with_implementation": ("contract_implementation_coverage", lambda p: F.count_if("has_implementation")),
    "implementation_coverage_rate": ("contract_implementation_coverage", lambda p: rate(F.col("has_implementation"))),
    "contracts_of_type": ("contract_implementation_coverage", lambda p: F.count_if(bands.implementation_type(
        F.col("transaction_count"), F.col("implementation_milestone_count"), [F.lit(i) for i in range(1, 5)]) == p["band"])),
    "register": ("metric_population", lambda p: F.max(F.when(F.col("metric_id") == p["metric"], F.col(p["column"])))),
    "eligible_share": ("metric_population", lambda p: F.max(F.when(
        F.col("metric_id") == p["metric"], F.col("eligible_count") / F.col("candidate_count")))),
    "impact": ("dq_impact", lambda p: F.max(F.when(
        (F.col("metric_id") == p["metric"]) & (F.col("dq_ref") == p["issue"]), F.col(p["column"])))),
}


def _holders(v, f):
    return holder_totals(filtered(v, "supplier_award_eligible", f), "supplier_id", AWARD)


def _value(df: DataFrame, c: Column) -> DataFrame:
    return df.agg(dbl(c).alias("value"))


def _excluded(v, f, c) -> DataFrame:
    kept = filtered(v, "supplier_award_eligible", f).agg(c).scalar()
    return filtered(v, "award_value_eligible", f).agg(dbl(c - kept).alias("value"))


def _excluded_share(v, f, p):
    kept = filtered(v, "supplier_award_eligible", f).agg(F.sum(AWARD)).scalar()
    return _value(filtered(v, "award_value_eligible", f), ratio(F.sum(AWARD) - kept, F.sum(AWARD)))


def _median_of(view, c):
    return lambda v, f, p: exact_percentiles(filtered(v, view, f), c, {"value": 0.5})


def _entity_values(v, f):
    zero = F.lit(0).cast("decimal(38,4)")
    return filtered(v, "entity_benchmark", f).select(F.coalesce("award_value_total", zero).alias("value"))


# Measures that need more than one aggregate.
COMPOSED = {
    "median_award_value": _median_of("award_value_eligible", AWARD),
    "median_ratio": _median_of("budget_award_comparison", RATIO),
    "top_supplier_share": lambda v, f, p: top_share_with_ties(_holders(v, f), p["n"]).toDF("value"),
    "supplier_hhi": lambda v, f, p: _holders(v, f).agg(hhi(F.col("value")).alias("value")),
    "suppliers_with_one_award": lambda v, f, p: _value(_holders(v, f), F.count_if(F.col("awards") == 1)),
    "excluded_awards": lambda v, f, p: _excluded(v, f, F.count_distinct("award_id")),
    "excluded_value": lambda v, f, p: _excluded(v, f, F.sum(AWARD)),
    "excluded_value_share": _excluded_share,
    "top_entity_share": lambda v, f, p: top_share_with_ties(_entity_values(v, f), p["n"]).toDF("value"),
}


TIMING = {
    "tender_duration": ("tender_duration_eligible", "tender_duration_days"),
    "award_lag": ("award_lag_eligible", "award_lag_days"),
    "signature_lag": ("signature_lag_eligible", "signature_lag_days"),
}


def _timing_in_band(v, f, p):
    view, days = TIMING[p["interval"]]
    six = [F.lit(i) for i in range(1, 7)]
    return _value(filtered(v, view, f), F.count_if(bands.duration_band(F.col(days), six) == p["band"]))


COMPOSED["timing_in_band"] = _timing_in_band


def measure(v, name: str, filters: dict | None = None, **params) -> DataFrame:
    """One row, one ``value`` (double)."""
    filters = filters or {}
    if name in SIMPLE:
        view, agg = SIMPLE[name]
        return _value(filtered(v, view, filters), agg(params))
    return COMPOSED[name](v, filters, params)


def measure_batch(v, calls: dict[str, tuple[str, dict, dict]]) -> DataFrame:
    """(label, value) of many calls. Simple measures of one view under the same
    filters share one scan; the others are one small query each."""
    shared: dict[tuple, dict[str, Column]] = {}
    parts = []
    for label, (name, filters, params) in calls.items():
        if name in SIMPLE:
            view, agg = SIMPLE[name]
            shared.setdefault((view, tuple(sorted(filters.items()))), {})[label] = agg(params)
        elif name == "timing_in_band":
            view, days = TIMING[params["interval"]]
            six = [F.lit(i) for i in range(1, 7)]
            c = F.count_if(bands.duration_band(F.col(days), six) == params["band"])
            shared.setdefault((view, tuple(sorted(filters.items()))), {})[label] = c
        else:
            parts.append(COMPOSED[name](v, filters, params).select(F.lit(label).alias("label"), "value"))
    for (view, filters), columns in shared.items():
        one = filtered(v, view, dict(filters)).agg(*[dbl(c).alias(f"v{i}") for i, c in enumerate(columns.values())])
        cells = [F.struct(F.lit(x).alias("label"), F.col(f"v{i}").alias("value")) for i, x in enumerate(columns)]
        parts.append(one.select(F.inline(F.array(*cells))))
    return union(parts)


def entity_kpis(v, filters: dict | None = None) -> DataFrame:
    """Every entity with its KPIs, blank below the minimum n."""
    e = _gated(v)
    if filters and filters.get("buyer"):
        e = e.filter(F.col("buyer_id") == filters["buyer"])
    return e.select("buyer_id", "buyer_name", "process_count", "award_n", *[F.col(k).cast("double").alias(k) for k in KPIS])
