"""The reconciliation pack: every named figure with its unit and eligible n.

All figures of one view come from one aggregate over that view; slices are
conditional aggregates, so a slice never costs another scan.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlens.functions import bands
from tenderlens.operators.concentration import concentration, holder_totals
from tenderlens.operators.order_stats import exact_percentiles
from tenderlens.plans.common import dbl, ratio, rows, sum_if, union
from tenderlens.plans.questions_supply import AWARD
from tenderlens.plans.questions_value import BUDGET, RATIO
from tenderlens.plans.register import METRICS
from tenderlens.plans.views import median, method, rate

# Page order of the pack.
PAGES = [
    "Executive overview", "Supplier concentration", "Competition", "Budget vs award", "Timing",
    "Entity benchmark", "Implementation & lifecycle", "Data quality & coverage",
]
# Displayed decimal places per unit.
PLACES = {"count": 0, "days": 0, "NGN": 0, "share": 4, "ratio": 4, "index": 1}


@dataclass(frozen=True)
class Slices:
    """The fixed slices of the pack."""

    method_main: str
    method_other: str
    method_third: str
    tender_status: str
    contract_status: str
    buyer: str
    years: tuple[int, int]


# The slices of the published pack.
PUBLISHED_SLICES = Slices(
    "National Competitive Bidding", "Emergency", "Direct Procurement", "active", "pending",
    "NG-BPP-BPP-NOC-231001001", (2020, 2021),
)
ORDER_SLICES = Slices("1-URGENT", "2-HIGH", "5-LOW", "active", "F", "B-3", (1996, 1997))


@dataclass(frozen=True)
class Figure:
    figure_id: str
    page: str
    name: str
    value: Column
    unit: str
    n: Column
    slice: str = "none"


def pack(df: DataFrame, figures: list[Figure]) -> DataFrame:
    one = df.agg(
        *[dbl(f.value).alias(f"v{i}") for i, f in enumerate(figures)],
        *[f.n.cast("bigint").alias(f"n{i}") for i, f in enumerate(figures)],
    )
    return _rows(one, figures)


def _rows(one: DataFrame, figures: list[Figure]) -> DataFrame:
    cells = [
        F.struct(
            F.lit(f.figure_id).alias("figure_id"), F.lit(f.page).alias("page"), F.lit(f.name).alias("figure"),
            F.lit(f.slice).alias("slice"), F.col(f"v{i}").alias("expected_value"), F.lit(f.unit).alias("unit"),
            F.col(f"n{i}").alias("eligible_n"),
        )
        for i, f in enumerate(figures)
    ]
    return one.select(F.inline(F.array(*cells)))


def by_band(df: DataFrame, band: Column, prefix: str, page: str, name: str, n: Column, count=None) -> DataFrame:
    """One count figure per band present."""
    count = rows() if count is None else count
    return df.groupBy(band.alias("b")).agg(count.alias("c")).select(
        F.concat(F.lit(prefix), F.col("b").cast("string")).alias("figure_id"), F.lit(page).alias("page"),
        F.concat(F.lit(name + " band "), F.col("b").cast("string")).alias("figure"), F.lit("none").alias("slice"),
        dbl(F.col("c")).alias("expected_value"), F.lit("count").alias("unit"), n.cast("bigint").alias("eligible_n"),
    )


def _total(df: DataFrame, c: str):
    return df.agg(F.sum(c)).scalar()


def _exact_median(df: DataFrame, c: str) -> Column:
    """Distributed exact median as a scalar: for money and ratios."""
    return exact_percentiles(df, c, {"m": 0.5}).scalar()


def executive(v) -> DataFrame:
    p = PAGES[0]
    aw, sup, ct, lc, comp = (v.award_value_eligible, v.supplier_award_eligible, v.contract_implementation_coverage,
                             v.lifecycle_stage, v.competition_eligible)
    prim = F.col("in_primary_population")
    c = concentration(holder_totals(sup, "supplier_id", AWARD), "supplier_id", [10])
    excluded = 1 - _total(sup, AWARD).cast("double") / dbl(F.sum(AWARD))
    return union([
        pack(lc, [
            Figure("EXE-01", p, "Procurement processes in scope", rows(), "count", rows()),
            Figure("EXE-13", p, "Processes that stop at planning", rate(F.col("highest_stage_rank") == 1), "share", rows()),
        ]),
        pack(v.budget_eligible, [Figure("EXE-02", p, "Planned budget", F.sum(BUDGET), "NGN", rows())]),
        pack(aw, [
            Figure("EXE-03", p, "Awarded value", F.sum(AWARD), "NGN", rows()),
            Figure("EXE-04", p, "Median award value", _exact_median(aw, AWARD), "NGN", rows()),
            Figure("EXE-08", p, "Excluded share of award value", excluded, "share", rows()),
        ]),
        pack(comp, [
            Figure("EXE-05", p, "Single-bidder rate, primary", rate(F.col("is_single_bidder"), prim), "share", F.count_if(prim)),
            Figure("EXE-06", p, "Median tenderers, primary", median(F.col("number_of_tenderers"), prim), "count", F.count_if(prim)),
        ]),
        pack(c, [Figure("EXE-07", p, "Top-10 supplier share", F.max(ratio(F.col("top_10"), F.col("value"))), "share",
                        sup.agg(F.count_distinct("award_id")).scalar())]),
        pack(v.budget_award_comparison, [Figure("EXE-09", p, "Median award-to-budget ratio",
                                                _exact_median(v.budget_award_comparison, RATIO), "ratio", rows())]),
        pack(v.tender_duration_eligible, [Figure("EXE-10", p, "Median tender duration", median(F.col("tender_duration_days")), "days", rows())]),
        pack(v.award_lag_eligible, [Figure("EXE-11", p, "Median award lag", median(F.col("award_lag_days")), "days", rows())]),
        pack(ct, [Figure("EXE-12", p, "Implementation coverage", rate(F.col("has_implementation")), "share", rows())]),
    ])


def suppliers(v, s: Slices) -> DataFrame:
    p, sup, aw = PAGES[1], v.supplier_award_eligible, v.award_value_eligible
    awards = F.count_distinct("award_id")
    n = sup.agg(awards).scalar()
    holders = sup.select("supplier_id").distinct().agg(rows()).scalar()
    top = [1, 5, 10, 20, 100]
    c = concentration(holder_totals(sup, "supplier_id", AWARD), "supplier_id", top)
    g = ["m"]
    by_m = concentration(holder_totals(sup.withColumn("m", method()), "supplier_id", AWARD, g), "supplier_id", [1], groups=g)
    n_by = sup.groupBy(method().alias("m")).agg(awards.alias("n_awards"))
    by_m = by_m.join(n_by, "m")

    def of(m, col):
        return F.max(F.when(F.col("m") == m, col))

    share1 = ratio(F.col("top_1"), F.col("value"))
    kept = sup.agg(awards.alias("n"), F.sum(AWARD).alias("v"))
    gone = F.sum(AWARD) - kept.select("v").scalar()
    hit = (F.col("metric_id") == "M-S01") & (F.col("dq_ref") == "DQ-14")
    dq_n = F.max(F.when(hit, F.col("candidate_records")))
    return union([
        pack(sup, [
            Figure("SUP-01", p, "Eligible awards", awards, "count", awards),
            Figure("SUP-02", p, "Distinct suppliers", holders, "count", awards),
            Figure("SUP-03", p, "Value attributed", F.sum(AWARD), "NGN", awards),
        ]),
        pack(c, [
            *[Figure(f"SUP-{i:02d}", p, f"Top-{k} supplier share", F.max(ratio(F.col(f"top_{k}"), F.col("value"))), "share", n)
              for i, k in enumerate(top, start=4)],
            Figure("SUP-09", p, "Herfindahl index", F.max("hhi"), "index", n),
            Figure("SUP-10", p, "Suppliers with one award", F.max("single_award_holders"), "count", F.max("holders")),
        ]),
        pack(aw, [
            Figure("SUP-11", p, "Awards excluded", rows() - kept.select("n").scalar(), "count", rows()),
            Figure("SUP-12", p, "Value excluded", gone, "NGN", rows()),
            Figure("SUP-13", p, "Share of value excluded", ratio(gone, F.sum(AWARD)), "share", rows()),
        ]),
        pack(v.dq_impact, [
            Figure("SUP-14", p, "Awards excluded (impact view)", F.max(F.when(hit, F.col("records_with_issue"))), "count", dq_n),
            Figure("SUP-15", p, "Value excluded (impact view)", F.max(F.when(hit, F.col("affected_value_ngn"))), "NGN", dq_n),
        ]),
        pack(by_m, [
            Figure("SUP-16", p, "Top-1 share in a method", of(s.method_main, share1), "share", of(s.method_main, F.col("n_awards")), f"method = {s.method_main}"),
            Figure("SUP-17", p, "Top-1 share in a method", of(s.method_other, share1), "share", of(s.method_other, F.col("n_awards")), f"method = {s.method_other}"),
            Figure("SUP-18", p, "Herfindahl index in a method", of(s.method_other, F.col("hhi")), "index", of(s.method_other, F.col("n_awards")), f"method = {s.method_other}"),
        ]),
    ])


def competition(v, s: Slices) -> DataFrame:
    p, comp = PAGES[2], v.competition_eligible
    prim, single, t = F.col("in_primary_population"), F.col("is_single_bidder"), F.col("number_of_tenderers")
    m = F.col("procurement_method_details")

    def cut(cond):
        return prim & cond

    third, main, status = cut(m == s.method_third), cut(m == s.method_main), cut(F.col("tender_status") == s.tender_status)
    all_n = comp.agg(rows()).scalar()
    b = bands.participation_band(t, labels=[F.lit(i) for i in range(1, 9)])
    shown = comp.withColumn("b", b).filter(((F.col("b") < 8) & prim) | ((F.col("b") == 8) & ~prim))
    return union([
        pack(comp, [
            Figure("COM-01", p, "Eligible tenders, primary", F.count_if(prim), "count", F.count_if(prim)),
            Figure("COM-02", p, "Eligible tenders, sensitivity", rows(), "count", rows()),
            Figure("COM-03", p, "Median tenderers, primary", median(t, prim), "count", F.count_if(prim)),
            Figure("COM-04", p, "Median tenderers, sensitivity", median(t), "count", rows()),
            Figure("COM-05", p, "Single-bidder rate, primary", rate(single, prim), "share", F.count_if(prim)),
            Figure("COM-06", p, "Single-bidder rate, sensitivity", rate(single), "share", rows()),
            Figure("COM-07", p, "Single-bidder rate in a method", rate(single, third), "share", F.count_if(third), f"method = {s.method_third}"),
            Figure("COM-08", p, "Single-bidder rate in a method", rate(single, main), "share", F.count_if(main), f"method = {s.method_main}"),
            Figure("COM-09", p, "Single-bidder rate in a status", rate(single, status), "share", F.count_if(status), f"tender_status = {s.tender_status}"),
            Figure("COM-10", p, "Median tenderers in a method", median(t, main), "count", F.count_if(main), f"method = {s.method_main}"),
        ]),
        by_band(shown, F.col("b"), "COM-B", p, "Participation", all_n),
    ])


def budget(v, s: Slices) -> DataFrame:
    p, bva = PAGES[3], v.budget_award_comparison
    m, x = F.col("procurement_method_details"), F.col(RATIO)
    main, other, who = m == s.method_main, m == s.method_other, F.col("buyer_id") == s.buyer
    n = bva.agg(rows()).scalar()
    return union([
        pack(bva, [
            Figure("BVA-01", p, "Comparable processes", rows(), "count", rows()),
            Figure("BVA-02", p, "Budget of comparable processes", F.sum(BUDGET), "NGN", rows()),
            Figure("BVA-03", p, "Award value of comparable processes", F.sum(AWARD), "NGN", rows()),
            Figure("BVA-04", p, "Net difference", F.sum("variance_amount"), "NGN", rows()),
            Figure("BVA-05", p, "Aggregate ratio", ratio(F.sum(AWARD), F.sum(BUDGET)), "ratio", rows()),
            Figure("BVA-06", p, "Median ratio", _exact_median(bva, RATIO), "ratio", rows()),
            Figure("BVA-07", p, "Share within 10% of budget", rate(x.between(0.9, 1.1)), "share", rows()),
            Figure("BVA-08", p, "Aggregate ratio in a method", ratio(sum_if(main, F.col(AWARD)), sum_if(main, F.col(BUDGET))), "ratio", F.count_if(main), f"method = {s.method_main}"),
            Figure("BVA-09", p, "Median ratio in a method", _exact_median(bva.filter(other), RATIO), "ratio", F.count_if(other), f"method = {s.method_other}"),
            Figure("BVA-10", p, "Net difference of a buyer", sum_if(who, F.col("variance_amount")), "NGN", F.count_if(who), f"buyer = {s.buyer}"),
            Figure("BVA-11", p, "Small budgets", F.count_if(F.col(BUDGET) < F.lit(v.rules.small_budget)), "count", rows()),
        ]),
        by_band(bva, bands.ratio_band(x, labels=[F.lit(i) for i in range(1, 7)]), "BVA-B", p, "Ratio", n),
    ])


def timing(v, s: Slices) -> DataFrame:
    p = PAGES[4]
    td, al, sl = v.tender_duration_eligible, v.award_lag_eligible, v.signature_lag_eligible
    d, lag, g = F.col("tender_duration_days"), F.col("award_lag_days"), F.col("signature_lag_days")
    m = F.col("procurement_method_details")
    main, other = m == s.method_main, m == s.method_other

    def year(y):
        return F.year("tender_start_date") == y

    def p90(c):
        return F.percentile(c, 0.9)

    def coverage(metric):
        hit = F.col("metric_id") == metric
        return (F.max(F.when(hit, F.col("eligible_count") / F.col("candidate_count"))), F.max(F.when(hit, F.col("eligible_count"))))

    cov = [(i, mid, *coverage(mid)) for i, mid in ((10, "M-E01"), (11, "M-E02"), (12, "P5-SIG"))]
    parts = [
        pack(td, [
            Figure("TIM-01", p, "Tender duration n", rows(), "count", rows()),
            Figure("TIM-04", p, "Median tender duration", median(d), "days", rows()),
            Figure("TIM-07", p, "P90 tender duration", p90(d), "days", rows()),
            *[Figure(f"TIM-{16 + i}", p, "Median tender duration in a year", median(d, year(y)), "days", F.count_if(year(y)), f"year = {y}")
              for i, y in enumerate(s.years)],
        ]),
        pack(al, [
            Figure("TIM-02", p, "Award lag n", rows(), "count", rows()),
            Figure("TIM-05", p, "Median award lag", median(lag), "days", rows()),
            Figure("TIM-08", p, "P90 award lag", p90(lag), "days", rows()),
            Figure("TIM-13", p, "Award lags over a year", rate(lag > 365), "share", rows()),
            Figure("TIM-14", p, "Median award lag in a method", median(lag, other), "days", F.count_if(other), f"method = {s.method_other}"),
            Figure("TIM-15", p, "Median award lag in a method", median(lag, main), "days", F.count_if(main), f"method = {s.method_main}"),
        ]),
        pack(sl, [
            Figure("TIM-03", p, "Signature lag n", rows(), "count", rows()),
            Figure("TIM-06", p, "Median signature lag", median(g), "days", rows()),
            Figure("TIM-09", p, "P90 signature lag", p90(g), "days", rows()),
        ]),
        pack(v.metric_population, [Figure(f"TIM-{i}", p, f"Coverage of {mid}", val, "share", n) for i, mid, val, n in cov]),
    ]
    six = [F.lit(i) for i in range(1, 7)]
    for k, (df, c) in enumerate(((td, d), (al, lag), (sl, g)), start=1):
        parts.append(by_band(df, bands.duration_band(c, labels=six), f"TIM-D{k}-", p, "Duration", df.agg(rows()).scalar()))
    return union(parts)


def entities(v, s: Slices) -> DataFrame:
    p, eb, r = PAGES[5], v.entity_benchmark, v.rules
    zero = F.lit(0).cast("decimal(38,4)")
    holders = eb.select("buyer_id", F.coalesce("award_value_total", zero).alias("value"), F.lit(1).alias("awards"))
    c = concentration(holders, "buyer_id", [1, 10, 100])
    n = eb.agg(rows()).scalar()
    who = F.col("buyer_id") == s.buyer

    def mine(col):
        return F.max(F.when(who, F.col(col)))

    def gated(kpi, n_col, k):
        ok = F.col(n_col) >= k
        return median(F.col(kpi), ok), F.count_if(ok)

    sb, ts, ic = (gated("single_bidder_rate", "competition_n", r.min_tenders),
                  gated("top_supplier_value_share", "award_n", r.min_awards),
                  gated("implementation_coverage_rate", "contract_n", r.min_contracts))
    at = f"buyer = {s.buyer}"
    return union([
        pack(eb, [
            Figure("ENT-01", p, "Procuring entities", rows(), "count", rows()),
            Figure("ENT-02", p, "Processes across entities", F.sum("process_count"), "count", rows()),
            Figure("ENT-03", p, "Planned budget across entities", F.sum("planned_budget_total"), "NGN", rows()),
            Figure("ENT-04", p, "Awarded value across entities", F.sum("award_value_total"), "NGN", rows()),
            Figure("ENT-08", p, "Median entity single-bidder rate", sb[0], "share", sb[1], f"min n = {r.min_tenders}"),
            Figure("ENT-09", p, "Median entity top-supplier share", ts[0], "share", ts[1], f"min n = {r.min_awards}"),
            Figure("ENT-10", p, "Median entity implementation coverage", ic[0], "share", ic[1], f"min n = {r.min_contracts}"),
            Figure("ENT-11", p, "Single-bidder rate of a buyer", mine("single_bidder_rate"), "share", mine("competition_n"), at),
            Figure("ENT-12", p, "Top-supplier share of a buyer", mine("top_supplier_value_share"), "share", mine("award_n"), at),
            Figure("ENT-13", p, "Implementation coverage of a buyer", mine("implementation_coverage_rate"), "share", mine("contract_n"), at),
            Figure("ENT-14", p, "Tender reach rate of a buyer", mine("tender_reach_rate"), "share", mine("process_count"), at),
            Figure("ENT-15", p, "Median award value of a buyer", mine("median_award_value"), "NGN", mine("award_n"), at),
        ]),
        pack(c, [Figure(f"ENT-{i:02d}", p, f"Top-{k} entity share", F.max(ratio(F.col(f"top_{k}"), F.col("value"))), "share", n)
                 for i, k in ((5, 1), (6, 10), (7, 100))]),
    ])


def implementation(v, s: Slices) -> DataFrame:
    """Zero-count types stay in: every type is a conditional count of one scan."""
    p, ct, lc = PAGES[6], v.contract_implementation_coverage, v.lifecycle_stage
    has, status, who = F.col("has_implementation"), F.col("contract_status") == s.contract_status, F.col("buyer_id") == s.buyer
    kind = bands.implementation_type(F.col("transaction_count"), F.col("implementation_milestone_count"), labels=[F.lit(i) for i in range(1, 5)])
    reach = [F.count_if(F.col("highest_stage_rank") >= k) for k in range(1, 6)]
    return union([
        pack(ct, [
            Figure("IMP-01", p, "Contracts in scope", rows(), "count", rows()),
            Figure("IMP-02", p, "Contracts with implementation data", F.count_if(has), "count", rows()),
            Figure("IMP-03", p, "Coverage rate", rate(has), "share", rows()),
            Figure("IMP-04", p, "Coverage rate in a status", rate(has, status), "share", F.count_if(status), f"contract_status = {s.contract_status}"),
            Figure("IMP-05", p, "Coverage rate of a buyer", rate(has, who), "share", F.count_if(who), f"buyer = {s.buyer}"),
            *[Figure(f"IMP-T{k}", p, f"Implementation data type {k}", F.count_if(kind == k), "count", rows()) for k in range(1, 5)],
        ]),
        pack(lc, [
            *[Figure(f"IMP-S{k}", p, f"Processes reaching stage {k}", reach[k - 1], "count", rows(), f"Stage = {k}") for k in range(1, 6)],
            *[Figure(f"IMP-C{k}", p, f"Conversion from stage {k - 1} to {k}", ratio(reach[k - 1], reach[k - 2]), "share", reach[k - 2], f"Stage = {k}")
              for k in range(2, 6)],
        ]),
    ])


def quality(v) -> DataFrame:
    p, cand, elig = PAGES[7], F.col("candidate_count"), F.col("eligible_count")
    slug = F.rtrim(F.regexp_replace("metric_id", "[^A-Za-z0-9]+", "-"), F.lit("-"))
    kinds = [("C", "Candidate population: ", dbl(cand), "count", cand), ("E", "Eligible population: ", dbl(elig), "count", elig),
             ("P", "Eligible share of candidates: ", ratio(elig, cand), "share", elig)]
    cells = F.array(*[
        F.struct(
            F.concat(F.lit(f"DQ-{k}-"), slug).alias("figure_id"), F.lit(p).alias("page"),
            F.concat(F.lit(name), F.col("metric_id")).alias("figure"), F.lit("none").alias("slice"),
            val.alias("expected_value"), F.lit(unit).alias("unit"), n.cast("bigint").alias("eligible_n"),
        )
        for k, name, val, unit, n in kinds
    ])

    def cell(i, metric, ref, column, unit):
        hit = (F.col("metric_id") == metric) & (F.col("dq_ref") == ref)
        return Figure(f"DQ-X{i}", p, f"{metric} / {ref}: {column}", F.max(F.when(hit, F.col(column))), unit,
                      F.max(F.when(hit, F.col("candidate_records"))), f"metric = {metric}, issue = {ref}")

    n, value = "records_with_issue", "affected_value_ngn"
    return union([
        v.metric_population.select(F.inline(cells)),
        pack(v.dq_impact, [
            cell(1, "M-P01", "DQ-06", n, "count"), cell(2, "M-P01", "DQ-06", value, "NGN"), cell(3, "M-V01", "DQ-07", n, "count"),
            cell(4, "M-V01", "DQ-20", n, "count"), cell(5, "M-E02", "DATE-ORDER", n, "count"), cell(6, "M-E01", "ALL", n, "count"),
            cell(7, "M-S01", "DQ-13", n, "count"),
        ]),
    ])


FAMILIES = {
    "r1_executive": lambda v, s: executive(v),
    "r2_suppliers": suppliers,
    "r3_competition": competition,
    "r4_budget": budget,
    "r5_timing": timing,
    "r6_entities": entities,
    "r7_implementation": implementation,
    "r8_quality": lambda v, s: quality(v),
}


def measure_calls(s: Slices) -> dict[str, tuple[str, dict, dict]]:
    """Every figure as a call of ``measures.measure``: (name, filters, parameters)."""
    main, other, third, who = ({"method": s.method_main}, {"method": s.method_other}, {"method": s.method_third},
                               {"buyer": s.buyer})
    calls: dict[str, tuple] = {}

    def plain(prefix: str, numbered: dict[int, str]):
        for i, name in numbered.items():
            calls[f"{prefix}-{i:02d}"] = (name, {}, {})

    plain("EXE", {1: "processes", 2: "planned_budget", 3: "award_value", 4: "median_award_value",
                  5: "single_bidder_rate_primary", 6: "median_tenderers_primary", 8: "excluded_value_share",
                  9: "median_ratio", 10: "median_tender_duration", 11: "median_award_lag",
                  12: "implementation_coverage_rate", 13: "planning_only_share"})
    calls["EXE-07"] = ("top_supplier_share", {}, {"n": 10})
    plain("SUP", {1: "supplier_awards", 2: "suppliers", 3: "supplier_value", 9: "supplier_hhi",
                  10: "suppliers_with_one_award", 11: "excluded_awards", 12: "excluded_value", 13: "excluded_value_share"})
    for i, n in enumerate((1, 5, 10, 20, 100), start=4):
        calls[f"SUP-{i:02d}"] = ("top_supplier_share", {}, {"n": n})
    calls["SUP-16"], calls["SUP-17"] = ("top_supplier_share", main, {"n": 1}), ("top_supplier_share", other, {"n": 1})
    calls["SUP-18"] = ("supplier_hhi", other, {})
    plain("COM", {1: "competition_n_primary", 2: "competition_n_sensitivity", 3: "median_tenderers_primary",
                  4: "median_tenderers_sensitivity", 5: "single_bidder_rate_primary", 6: "single_bidder_rate_sensitivity"})
    calls["COM-07"], calls["COM-08"] = ("single_bidder_rate_primary", third, {}), ("single_bidder_rate_primary", main, {})
    calls["COM-09"] = ("single_bidder_rate_primary", {"tender_status": s.tender_status}, {})
    calls["COM-10"] = ("median_tenderers_primary", main, {})
    for b in range(1, 9):
        calls[f"COM-B{b}"] = ("tenders_in_band", {}, {"band": b, "population": "primary" if b < 8 else "sensitivity only"})
    plain("BVA", {1: "comparable_processes", 2: "comparable_budget", 3: "comparable_award", 4: "net_variance",
                  5: "aggregate_ratio", 6: "median_ratio", 7: "share_within_10pct", 11: "small_budgets"})
    calls["BVA-08"], calls["BVA-09"], calls["BVA-10"] = ("aggregate_ratio", main, {}), ("median_ratio", other, {}), ("net_variance", who, {})
    for b in range(1, 7):
        calls[f"BVA-B{b}"] = ("comparable_in_band", {}, {"band": b})
    plain("TIM", {1: "tender_duration_n", 2: "award_lag_n", 3: "signature_lag_n", 4: "median_tender_duration",
                  5: "median_award_lag", 6: "median_signature_lag", 7: "p90_tender_duration", 8: "p90_award_lag",
                  9: "p90_signature_lag", 13: "award_lag_over_year_share"})
    for i, metric in ((10, "M-E01"), (11, "M-E02"), (12, "P5-SIG")):
        calls[f"TIM-{i}"] = ("eligible_share", {}, {"metric": metric})
    calls["TIM-14"], calls["TIM-15"] = ("median_award_lag", other, {}), ("median_award_lag", main, {})
    for i, y in enumerate(s.years, start=16):
        calls[f"TIM-{i}"] = ("median_tender_duration", {"tender_start_year": y}, {})
    for k, kind in enumerate(("tender_duration", "award_lag", "signature_lag"), start=1):
        for b in range(1, 7):
            calls[f"TIM-D{k}-{b}"] = ("timing_in_band", {}, {"interval": kind, "band": b})
    plain("ENT", {1: "entities", 2: "entity_processes", 3: "entity_planned_budget", 4: "entity_award_value"})
    for i, n in ((5, 1), (6, 10), (7, 100)):
        calls[f"ENT-{i:02d}"] = ("top_entity_share", {}, {"n": n})
    for i, (name, k) in enumerate((("median_entity_single_bidder_rate", 30), ("median_entity_top_supplier_share", 10),
                                   ("median_entity_implementation", 20)), start=8):
        calls[f"ENT-{i:02d}"] = (name, {}, {"min_n": k})
    for i, kpi in enumerate(("single_bidder_rate", "top_supplier_value_share", "implementation_coverage_rate",
                             "tender_reach_rate", "median_award_value"), start=11):
        calls[f"ENT-{i}"] = ("entity_kpi", who, {"kpi": kpi})
    plain("IMP", {1: "contracts", 2: "contracts_with_implementation", 3: "implementation_coverage_rate"})
    calls["IMP-04"] = ("implementation_coverage_rate", {"contract_status": s.contract_status}, {})
    calls["IMP-05"] = ("implementation_coverage_rate", who, {})
    for k in range(1, 6):
        calls[f"IMP-S{k}"] = ("processes_reaching_stage", {}, {"stage": k})
    for k in range(2, 6):
        calls[f"IMP-C{k}"] = ("stage_conversion_rate", {}, {"stage": k})
    for k in range(1, 5):
        calls[f"IMP-T{k}"] = ("contracts_of_type", {}, {"band": k})
    for metric in (m[0] for m in METRICS):
        slug = re.sub("[^A-Za-z0-9]+", "-", metric).rstrip("-")
        calls[f"DQ-C-{slug}"] = ("register", {}, {"metric": metric, "column": "candidate_count"})
        calls[f"DQ-E-{slug}"] = ("register", {}, {"metric": metric, "column": "eligible_count"})
        calls[f"DQ-P-{slug}"] = ("eligible_share", {}, {"metric": metric})
    cells = (("M-P01", "DQ-06", "records_with_issue"), ("M-P01", "DQ-06", "affected_value_ngn"),
             ("M-V01", "DQ-07", "records_with_issue"), ("M-V01", "DQ-20", "records_with_issue"),
             ("M-E02", "DATE-ORDER", "records_with_issue"), ("M-E01", "ALL", "records_with_issue"),
             ("M-S01", "DQ-13", "records_with_issue"))
    for i, (metric, ref, column) in enumerate(cells, start=1):
        calls[f"DQ-X{i}"] = ("impact", {}, {"metric": metric, "issue": ref, "column": column})
    for i, column in ((14, "records_with_issue"), (15, "affected_value_ngn")):
        calls[f"SUP-{i}"] = ("impact", {}, {"metric": "M-S01", "issue": "DQ-14", "column": column})
    return calls


def all_figures(v, s: Slices) -> DataFrame:
    """Every figure in page order, with the measure it corresponds to."""
    names = F.create_map(*[F.lit(x) for fid, call in measure_calls(s).items() for x in (fid, call[0])])
    every = union([f(v, s) for f in FAMILIES.values()]).withColumn("measure", names[F.col("figure_id")])
    place = F.array_position(F.array(*[F.lit(x) for x in PAGES]), F.col("page"))
    return every.orderBy(place, "figure_id")
