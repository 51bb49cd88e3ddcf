"""Questions 5, 6 and 7: entity benchmarking, reporting coverage, data-quality impact."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenderlens.functions import bands
from tenderlens.functions.flags import materiality, small_n_note
from tenderlens.operators.order_stats import (
    exact_percentiles,
    ntile,
    percent_rank,
    top_rows,
    with_position,
)
from tenderlens.plans import register
from tenderlens.plans.common import mark, money, pct, ratio, rows, sum_if, with_totals
from tenderlens.plans.questions_supply import AWARD, _entities, _unit
from tenderlens.plans.views import median, rate
from tenderlens.rules import STATUS_NOT_STATED

TOP_N = [1, 5, 10, 20, 50, 100]


# ------------------------------------------------------------------ question 5
def minimum_n(v) -> DataFrame:
    """The analytic parameters next to how many entities each one leaves in."""
    r, e = v.rules, v.entity_benchmark
    params = [
        ("single_bidder_rate / median_tenderers (competition_n)", r.min_tenders, "competition_n"),
        ("top_supplier_value_share (award_n)", r.min_awards, "award_n"),
        ("implementation_coverage_rate (contract_n)", r.min_contracts, "contract_n"),
        ("tender_reach_rate (process_count)", r.min_processes, "process_count"),
    ]
    left = e.agg(*[F.count_if(F.col(c) >= k).alias(c) for _, k, c in params])
    return left.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(kpi).alias("kpi"), F.lit(k).alias("min_n"), F.col(c).alias("entities_compared"))
                    for kpi, k, c in params
                ]
            )
        )
    )


def entity_population(v) -> DataFrame:
    r = v.rules
    return v.entity_benchmark.agg(
        rows().alias("entities"),
        F.sum("process_count").alias("processes_in_scope"),
        F.count("budget_line_n").alias("entities_with_budget_lines"),
        F.count("competition_n").alias("entities_with_competition_data"),
        F.count_if(F.col("competition_n") >= r.min_tenders).alias("entities_competition_n_30_plus"),
        F.count("award_n").alias("entities_with_awards"),
        F.count_if(F.col("award_n") >= r.min_awards).alias("entities_award_n_10_plus"),
        F.count("contract_n").alias("entities_with_contracts"),
        F.count_if(F.col("contract_n") >= r.min_contracts).alias("entities_contract_n_20_plus"),
        money(F.sum("award_value_total"), r, 1).alias(_unit(v, "total_award_value")),
        money(F.sum("planned_budget_total"), r, 1).alias(_unit(v, "total_planned_budget")),
    )


def _filled(v) -> DataFrame:
    zero = F.lit(0).cast("decimal(38,4)")
    return v.entity_benchmark.withColumns(
        {
            "award_value": F.coalesce("award_value_total", zero),
            "budget": F.coalesce("planned_budget_total", zero),
            "awards": F.coalesce("award_n", F.lit(0)),
        }
    )


def top_share_grid(df: DataFrame, measures: dict[str, str], key: str, grid=TOP_N) -> DataFrame:
    """Share of each measure held by its N largest rows, for every N of a small
    grid. Each measure needs only its largest max(N) rows (distributed top-k)."""
    total = df.agg(*[F.sum(c).alias(c) for c in measures])
    out = None
    for c, name in measures.items():
        best = top_rows(df.select(key, c), [(c, "desc"), (key, "asc")], max(grid))
        one = best.agg(*[sum_if(F.col("position") <= n, F.col(c)).alias(f"n{n}") for n in grid])
        cells = F.array(*[F.struct(F.lit(n).alias("largest_entities"), F.col(f"n{n}").alias("part")) for n in grid])
        part = one.select(F.inline(cells)).withColumn("whole", total.select(c).scalar()).select(
            "largest_entities", pct(F.col("part"), F.col("whole"), 1).alias(name)
        )
        out = part if out is None else out.join(part, "largest_entities")
    return out


def activity_share(v) -> DataFrame:
    measures = {
        "award_value": "pct_of_award_value",
        "process_count": "pct_of_processes",
        "budget": "pct_of_planned_budget",
    }
    return top_share_grid(_filled(v), measures, "buyer_id")


def top_entities(v, n: int = 15) -> DataFrame:
    e = with_position(
        _filled(v), [("award_value", "desc"), ("buyer_id", "asc")], "rank_award_value", rank_keys=1,
        running={"award_value": "cum"},
    )
    for c, name in (("process_count", "rank_processes"), ("awards", "rank_awards"), ("budget", "rank_budget")):
        e = with_position(e, [(c, "desc")], name)
    return e.filter(F.col("rank_award_value") <= n).select(
        "rank_award_value", "buyer_id", "buyer_name",
        money(F.col("award_value_total"), v.rules, 1).alias(_unit(v, "award_value")),
        pct(F.col("cum"), F.col("cum_total"), 1).alias("cumulative_share_of_award_value_pct"),
        "award_n", "process_count",
        money(F.col("planned_budget_total"), v.rules, 1).alias(_unit(v, "planned_budget")),
        "rank_processes", "rank_awards", "rank_budget",
    )


KPIS = {
    "reach": ("tender_reach_rate", "process_count", "min_processes"),
    "tenderers": ("median_tenderers", "competition_n", "min_tenders"),
    "single_bidder": ("single_bidder_rate", "competition_n", "min_tenders"),
    "top_supplier": ("top_supplier_value_share", "award_n", "min_awards"),
    "implementation": ("implementation_coverage_rate", "contract_n", "min_contracts"),
}


def _gated(v) -> DataFrame:
    """Each KPI blank below its own minimum n."""
    return _filled(v).withColumns(
        {k: F.when(F.col(n) >= getattr(v.rules, m), F.col(c)) for k, (c, n, m) in KPIS.items()}
    )


def kpi_positions(df: DataFrame, kpis) -> DataFrame:
    """percent_rank of each KPI among the entities that have one, blanks kept
    apart: all KPIs are ranked in one pass over (kpi, value) rows."""
    cells = F.array(*[F.struct(F.lit(k).alias("kpi"), F.col(k).cast("double").alias("x")) for k in kpis])
    long = df.select("buyer_id", F.inline(cells)).filter(F.col("x").isNotNull())
    r = with_position(long, [("x", "asc")], "_r", groups=["kpi"], count_as="_n")
    place = F.round(percent_rank(F.col("_r"), F.col("_n")) * 100, 0)
    return r.groupBy("buyer_id").agg(*[F.max(F.when(F.col("kpi") == k, place)).alias(f"{k}_pctile") for k in kpis])


def kpi_profile(v, n: int = 15) -> DataFrame:
    e = with_position(_gated(v), [("award_value", "desc")], "rank_award_value")
    top = e.filter(F.col("rank_award_value") <= n)
    e = top.join(kpi_positions(_gated(v), KPIS), "buyer_id", "left")
    return e.select(
        "rank_award_value", "buyer_name",
        F.round(F.col("reach") * 100, 1).alias("tender_reach_pct"), "reach_pctile",
        "competition_n",
        F.col("tenderers").alias("median_tenderers"), "tenderers_pctile",
        F.round(F.col("single_bidder") * 100, 1).alias("single_bidder_pct"), "single_bidder_pctile",
        "award_n",
        F.round(F.col("top_supplier") * 100, 1).alias("top_supplier_share_pct"), "top_supplier_pctile",
        "contract_n",
        F.round(F.col("implementation") * 100, 1).alias("implementation_coverage_pct"), "implementation_pctile",
    )


def kpi_spread(v) -> DataFrame:
    labels = {
        "reach": "tender reach rate",
        "tenderers": "median tenderers",
        "single_bidder": "single-bidder rate",
        "top_supplier": "top-supplier value share",
        "implementation": "implementation coverage rate",
    }
    probs = {"p10": 0.1, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9}
    cells = F.array(
        *[F.struct(F.lit(t).alias("kpi"), F.col(k).cast("double").alias("value")) for k, t in labels.items()]
    )
    long = _gated(v).select(F.inline(cells)).filter(F.col("value").isNotNull())
    n = long.groupBy("kpi").agg(rows().alias("entities_compared"))
    q = exact_percentiles(long, "value", probs, ["kpi"])
    return n.join(q, "kpi").select("kpi", "entities_compared", *[F.round(p, 3).alias(p) for p in probs])


def kpi_by_quartile(v) -> DataFrame:
    r = v.rules
    e = v.entity_benchmark.filter(F.col("award_value_total").isNotNull())
    e = with_position(
        e, [("award_value_total", "desc"), ("buyer_id", "asc")], "_row", kind="row_number", count_as="_n"
    ).withColumn("value_quartile", ntile(F.col("_row"), F.col("_n"), 4))
    comp, cont = F.col("competition_n") >= r.min_tenders, F.col("contract_n") >= r.min_contracts
    t = e.groupBy("value_quartile").agg(
        rows().alias("entities"),
        F.sum("award_value_total").alias("value"),
        F.count_if(comp).alias("entities_with_competition_n"),
        F.round(median(F.col("single_bidder_rate"), comp) * 100, 1).alias("median_single_bidder_pct"),
        F.count_if(cont).alias("entities_with_contract_n"),
        F.round(median(F.col("implementation_coverage_rate"), cont) * 100, 1).alias("median_implementation_coverage_pct"),
    )
    t = with_totals(t, whole=F.sum("value"))
    fewest = F.least("entities_with_competition_n", "entities_with_contract_n")
    return t.select(
        "value_quartile", "entities",
        money(F.col("value"), r, 1).alias(_unit(v, "award_value")),
        pct(F.col("value"), F.col("whole"), 1).alias("pct_of_award_value"),
        "entities_with_competition_n", "median_single_bidder_pct", "entities_with_contract_n",
        "median_implementation_coverage_pct",
        small_n_note(fewest, r.small_kpi_entities, "fewer than 10 entities in a KPI: read with caution").alias(
            "reliability_note"
        ),
    )


def _entity_scenarios(v) -> DataFrame:
    marked = mark(_entities(v.award_value_eligible), v.award_scale_flag, "award_id", "is_flagged")
    flagged, zero = F.col("is_flagged"), F.lit(0).cast("decimal(38,4)")
    return marked.groupBy("buyer_id").agg(
        F.max("buyer_name").alias("buyer_name"),
        F.sum(AWARD).alias("pub"),
        F.coalesce(sum_if(~flagged, F.col(AWARD)), zero).alias("wo"),
        F.count_if(flagged).alias("flagged_awards"),
    )


def top_share_sensitivity(v) -> DataFrame:
    e = _entity_scenarios(v)
    grid = top_share_grid(
        e, {"pub": "pct_of_award_value_published", "wo": "pct_of_award_value_without_flagged"}, "buyer_id"
    )
    whole = e.agg(F.sum("pub").alias("pub"), F.sum("wo").alias("wo"))
    names = {"pub": "total_award_value_published", "wo": "total_award_value_without_flagged"}
    return grid.withColumns({_unit(v, n): whole.select(money(F.col(c), v.rules, 1)).scalar() for c, n in names.items()})


def top_entities_without_flagged(v, n: int = 10) -> DataFrame:
    e = with_position(
        _entity_scenarios(v), [("pub", "desc"), ("buyer_id", "asc")], "rank_published", kind="row_number"
    )
    e = with_position(e, [("wo", "desc"), ("buyer_id", "asc")], "rank_without", kind="row_number")
    return e.filter(F.col("rank_without") <= n).select(
        "rank_without", "rank_published", "buyer_id", "buyer_name",
        money(F.col("pub"), v.rules, 1).alias(_unit(v, "award_value_published")),
        "flagged_awards",
        money(F.col("wo"), v.rules, 1).alias(_unit(v, "award_value_without_flagged")),
    )


# ------------------------------------------------------------------ question 6

def coverage_headline(v) -> DataFrame:
    has = F.col("has_implementation")
    t = v.contract_implementation_coverage.agg(
        rows().alias("eligible_contracts"),
        F.count_if(has).alias("contracts_with_implementation_data"),
        F.count_if(~has).alias("contracts_without_implementation_data"),
    )
    share = pct(F.col("contracts_with_implementation_data"), F.col("eligible_contracts"), 2)
    return t.withColumn("coverage_rate_pct_m_i01", share)


def implementation_types(v) -> DataFrame:
    tx, ms = F.col("transaction_count"), F.col("implementation_milestone_count")
    t = v.contract_implementation_coverage.groupBy(
        bands.implementation_type(tx, ms).alias("implementation_data_type")
    ).agg(rows().alias("contracts"), F.sum(tx).alias("transactions"), F.sum(ms).alias("implementation_milestones"))
    t = with_totals(t, whole=F.sum("contracts"))
    return t.select(
        "implementation_data_type", "contracts", pct(F.col("contracts"), F.col("whole"), 2).alias("pct_of_contracts"),
        "transactions", "implementation_milestones",
    )


def coverage_by_status(v) -> DataFrame:
    status = F.coalesce("contract_status", F.lit(STATUS_NOT_STATED)).alias("contract_status")
    t = v.contract_implementation_coverage.groupBy(status).agg(
        rows().alias("contracts"), F.count_if("has_implementation").alias("with_implementation_data")
    )
    return t.withColumns(
        {
            "coverage_rate_pct": pct(F.col("with_implementation_data"), F.col("contracts"), 2),
            "reliability_note": small_n_note(F.col("contracts"), v.rules.small_n),
        }
    )


def _coverage_by_entity(v) -> DataFrame:
    return _entities(v.contract_implementation_coverage).groupBy("buyer_id").agg(
        F.max("buyer_name").alias("buyer_name"),
        rows().alias("contracts"),
        F.count_if("has_implementation").alias("with_implementation_data"),
        rate(F.col("has_implementation")).alias("coverage"),
    ).filter(F.col("contracts") >= v.rules.min_contracts)


def coverage_bands(v) -> DataFrame:
    t = _coverage_by_entity(v).groupBy(bands.coverage_band(F.col("coverage")).alias("entity_coverage_band")).agg(
        rows().alias("entities"), F.sum("contracts").alias("contracts_held")
    )
    t = with_totals(t, all_e=F.sum("entities"), all_c=F.sum("contracts_held"))
    return t.select(
        "entity_coverage_band", "entities",
        pct(F.col("entities"), F.col("all_e"), 1).alias("pct_of_entities"),
        "contracts_held",
        pct(F.col("contracts_held"), F.col("all_c"), 1).alias("pct_of_contracts"),
        F.lit(v.rules.min_contracts).alias("min_contracts_threshold"),
    )


def lowest_coverage(v, n: int = 15) -> DataFrame:
    e = with_position(
        _coverage_by_entity(v), [("coverage", "asc"), ("contracts", "desc")], "rank_lowest_coverage",
        count_as="entities_in_comparison",
    )
    e = with_position(e, [("coverage", "asc")], "_asc").filter(F.col("rank_lowest_coverage") <= n)
    place = percent_rank(F.col("_asc"), F.col("entities_in_comparison"))
    return e.select(
        "rank_lowest_coverage", "buyer_id", "buyer_name", "contracts", "with_implementation_data",
        F.round(F.col("coverage") * 100, 1).alias("coverage_rate_pct"),
        F.round(place * 100, 0).alias("percentile_among_entities"),
        "entities_in_comparison",
    )


def lifecycle_funnel(v) -> DataFrame:
    per = v.lifecycle_stage.groupBy("highest_stage_rank", "highest_stage").agg(rows().alias("here"))
    # At most five rows from here on.
    w = Window.partitionBy(F.lit(0)).orderBy("highest_stage_rank")
    beyond = w.rowsBetween(0, Window.unboundedFollowing)
    f = per.withColumn("reached", F.sum("here").over(beyond))
    return f.select(
        F.col("highest_stage_rank").alias("stage_order"),
        F.col("highest_stage").alias("stage"),
        F.col("here").alias("ocids_whose_last_published_stage_is_this"),
        F.col("reached").alias("ocids_reaching_stage_or_beyond"),
        pct(F.col("reached"), F.max("reached").over(Window.partitionBy(F.lit(0))), 2).alias("pct_of_all_ocids"),
        pct(F.col("reached"), F.lag("reached").over(w), 2).alias("conversion_from_previous_stage_pct"),
    )


# ------------------------------------------------------------------ question 7
CAUSES = ["EXCLUDES", "EXCLUDES_FROM_PRIMARY"]


def exclusions_by_metric(v) -> DataFrame:
    whole, other = F.col("dq_ref") == "ALL", F.col("dq_ref") == "OTHER"
    cause = F.col("impact_type").isin(CAUSES)
    zero = F.lit(0)
    t = v.dq_impact.filter(whole | other | cause).groupBy("metric_order", "metric_id", "metric_name").agg(
        F.max(F.when(whole, F.col("candidate_records"))).alias("candidate_records"),
        F.max(F.when(whole, F.col("eligible_records"))).alias("eligible_records"),
        F.max(F.when(whole, F.col("records_with_issue"))).alias("excluded_records"),
        F.coalesce(sum_if(cause, F.col("records_lost_only_to_issue")), zero).alias("lost_to_one_dq_issue_only"),
        F.coalesce(F.max(F.when(other, F.col("records_lost_only_to_issue"))), zero).alias("lost_to_non_dq_rule_only"),
    ).filter(F.col("candidate_records").isNotNull())
    gone = F.col("candidate_records") - F.col("eligible_records")
    rest = F.col("excluded_records") - F.col("lost_to_one_dq_issue_only") - F.col("lost_to_non_dq_rule_only")
    return t.withColumns(
        {
            "eligible_pct": pct(F.col("eligible_records"), F.col("candidate_records"), 1),
            "lost_to_two_or_more_reasons": rest,
            "reconciles_candidate_minus_eligible": F.when(gone == F.col("excluded_records"), "yes").otherwise("NO"),
        }
    )


def _graded(v) -> DataFrame:
    """Issue rows with their value base: for an exclusion the candidate value
    (eligible plus everything excluded), for a disclosure the eligible value."""
    w = Window.partitionBy("metric_id")  # a few dozen rows in all
    lost = F.max(F.when(F.col("dq_ref") == "ALL", F.col("affected_value_ngn"))).over(w)
    base = F.col("eligible_value_ngn") + F.when(
        F.col("impact_type") == "DISCLOSED", F.lit(0)
    ).otherwise(F.coalesce(lost, F.lit(0)))
    raw = ratio(F.col("affected_value_ngn"), F.col("base")) * 100
    return v.dq_impact.withColumn("base", base).filter(~F.col("dq_ref").isin("ALL", "OTHER")).withColumn(
        "value_pct", raw
    )


def issue_matrix(v) -> DataFrame:
    g = _graded(v).withColumn("value_pct_of_candidate", F.round("value_pct", 1))
    driver = F.greatest("pct_of_candidate", F.coalesce("value_pct_of_candidate", F.lit(0.0)))
    w = Window.partitionBy("metric_id").orderBy(F.col("records_with_issue").desc())
    return g.select(
        "metric_id", "dq_ref", "dq_issue", "impact_type", "treatment", "candidate_records", "records_with_issue",
        "pct_of_candidate", "records_lost_only_to_issue",
        money(F.col("affected_value_ngn"), v.rules, 1).alias(_unit(v, "affected_value")),
        "value_pct_of_candidate",
        materiality(driver, v.rules).alias("materiality"),
        F.rank().over(w).alias("rank_within_metric"),
        "note",
    )


def issues_across_metrics(v) -> DataFrame:
    driver = F.greatest("pct_of_candidate", F.coalesce("value_pct", F.lit(0.0)))
    g = _graded(v).withColumn("driver", driver).withColumn("level", materiality(F.col("driver"), v.rules))
    text = F.concat(
        "metric_id", F.lit(" ("), "level", F.lit(", "), F.round("driver", 1).cast("decimal(10,1)").cast("string"),
        F.lit("% of records or value)"),
    )
    t = g.withColumn("text", text).groupBy("dq_ref").agg(
        F.max("dq_issue").alias("dq_issue"),
        F.max("treatment").alias("treatment"),
        rows().alias("metrics_touched"),
        F.count_if(F.col("level") == "HIGH").alias("metrics_high"),
        F.count_if(F.col("level") == "MODERATE").alias("metrics_moderate"),
        # At most one entry per metric.
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("metric_order", "text"))), lambda x: x["text"]
            ),
            "; ",
        ).alias("metrics_affected"),
    )
    w = Window.partitionBy(F.lit(0)).orderBy(F.col("metrics_high").desc(), F.col("metrics_moderate").desc())
    return t.withColumn("issue_rank", F.rank().over(w))


RESULT_SETS = {
    "q5_0_minimum_n": minimum_n,
    "q5_1_entity_population": entity_population,
    "q5_1b_register": lambda v: register.entries(v, "ENTITY"),
    "q5_2_activity_share": activity_share,
    "q5_3_top_entities": top_entities,
    "q5_4_kpi_profile": kpi_profile,
    "q5_5_kpi_spread": kpi_spread,
    "q5_6_kpi_by_quartile": kpi_by_quartile,
    "q5_7_top_share_sensitivity": top_share_sensitivity,
    "q5_7b_top_entities_without_flagged": top_entities_without_flagged,
    "q6_1_coverage_headline": coverage_headline,
    "q6_1b_register": lambda v: register.entries(v, "M-I01", "M-E03"),
    "q6_2_implementation_types": implementation_types,
    "q6_3_coverage_by_status": coverage_by_status,
    "q6_4_coverage_bands": coverage_bands,
    "q6_5_lowest_coverage": lowest_coverage,
    "q6_6_lifecycle_funnel": lifecycle_funnel,
    "q7_1_exclusions_by_metric": exclusions_by_metric,
    "q7_2_issue_matrix": issue_matrix,
    "q7_3_issues_across_metrics": issues_across_metrics,
}
