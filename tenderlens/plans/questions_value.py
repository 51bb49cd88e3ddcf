"""Questions 3 and 4: budget against award, and cycle timing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenderlens.functions import bands
from tenderlens.functions.flags import small_n_note
from tenderlens.operators.order_stats import exact_percentiles, ntile, top_rows, with_position
from tenderlens.plans import register
from tenderlens.plans.common import mark, money, pct, ratio, rows, sum_if, union, with_totals
from tenderlens.plans.questions_supply import AWARD, _entities, _unit, cumulative_bands, scenarios
from tenderlens.plans.views import median, method, rate
from tenderlens.rules import SMALL_N_NOTE

BUDGET = "budget_amount"
RATIO = "award_to_budget_ratio"
SPREAD = {"p01": 0.01, "p10": 0.1, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9, "p99": 0.99}


def median_ratio(df: DataFrame, groups=(), places: int = 4) -> DataFrame:
    """The ratio is a money quotient with an unbounded domain: distributed exact median."""
    return exact_percentiles(df, RATIO, {"_m": 0.5}, groups).select(
        *groups, F.round("_m", places).alias("median_ratio")
    )


def _totals():
    return [
        rows().alias("n"),
        F.sum(BUDGET).alias("budget"),
        F.sum(AWARD).alias("award"),
        F.sum("variance_amount").alias("variance"),
    ]


# ------------------------------------------------------------------ question 3
def budget_headline(v) -> DataFrame:
    bva = v.budget_award_comparison
    cand = v.award_value_eligible.agg(rows()).scalar()
    med = median_ratio(bva).scalar()
    t = bva.agg(*_totals()).withColumns({"cand": cand, "med": med})
    r = v.rules
    return t.select(
        F.col("cand").alias("candidate_awards"),
        F.col("n").alias("eligible_ocids"),
        pct(F.col("n"), F.col("cand"), 1).alias("eligible_pct_of_candidate"),
        (F.col("cand") - F.col("n")).alias("excluded_ocids"),
        money(F.col("budget"), r, 1).alias(_unit(v, "total_budget")),
        money(F.col("award"), r, 1).alias(_unit(v, "total_award")),
        money(F.col("variance"), r, 1).alias(_unit(v, "net_variance")),
        F.round(ratio(F.col("award"), F.col("budget")), 4).alias("aggregate_award_to_budget_ratio"),
        F.col("med").alias("median_ratio"),
    )


def ratio_percentiles(v) -> DataFrame:
    bva = v.budget_award_comparison
    q = exact_percentiles(bva, RATIO, SPREAD)
    ends = bva.agg(rows().alias("n"), F.min(RATIO).alias("lo"), F.max(RATIO).alias("hi"))
    return q.select(
        ends.select("n").scalar().alias("eligible_ocids"),
        ends.select("lo").scalar().alias("min_ratio"),
        *[F.round(p, 4).alias(p) for p in SPREAD],
        ends.select("hi").scalar().alias("max_ratio"),
    )


def ratio_bands(v) -> DataFrame:
    b = v.budget_award_comparison.groupBy(bands.ratio_band(F.col(RATIO)).alias("ratio_band")).agg(*_totals())
    b = with_totals(b, all_n=F.sum("n"), all_award=F.sum("award"))
    return b.select(
        "ratio_band",
        F.col("n").alias("ocids"),
        pct(F.col("n"), F.col("all_n"), 2).alias("pct_of_ocids"),
        money(F.col("budget"), v.rules, 2).alias(_unit(v, "budget")),
        money(F.col("award"), v.rules, 2).alias(_unit(v, "award")),
        pct(F.col("award"), F.col("all_award"), 2).alias("pct_of_award_value"),
    )


def variance_by_method(v, source=None) -> DataFrame:
    g = "procurement_method"
    bva = (v.budget_award_comparison if source is None else source).withColumn(g, method())
    r, x = v.rules, F.col(RATIO)
    t = bva.groupBy(g).agg(*_totals(), F.count_if(x > 1.1).alias("above"), F.count_if(x < 0.9).alias("below"))
    return t.join(median_ratio(bva, [g]), g).select(
        g,
        F.col("n").alias("eligible_ocids"),
        money(F.col("budget"), r, 2).alias(_unit(v, "budget")),
        money(F.col("award"), r, 2).alias(_unit(v, "award")),
        money(F.col("variance"), r, 2).alias(_unit(v, "net_variance")),
        F.round(ratio(F.col("award"), F.col("budget")), 4).alias("aggregate_ratio"),
        "median_ratio",
        pct(F.col("above"), F.col("n"), 1).alias("pct_award_above_110pct_of_budget"),
        pct(F.col("below"), F.col("n"), 1).alias("pct_award_below_90pct_of_budget"),
        small_n_note(F.col("n"), r.min_method_ocids).alias("reliability_note"),
    )


def _entity_totals(v, source=None) -> DataFrame:
    bva = _entities(v.budget_award_comparison if source is None else source)
    aligned = F.col(RATIO).between(0.9, 1.1)
    t = bva.groupBy("buyer_id").agg(
        F.max("buyer_name").alias("buyer_name"), *_totals(), rate(aligned).alias("aligned")
    ).filter(F.col("n") >= v.rules.min_entity_ocids)
    return t.join(exact_percentiles(bva, RATIO, {"med": 0.5}, ["buyer_id"]), "buyer_id")


def entity_variance(v, n: int = 15, source=None) -> DataFrame:
    r = v.rules
    e = _entity_totals(v, source).withColumn("abs_variance", F.abs("variance"))
    e = with_position(
        e, [("abs_variance", "desc"), ("buyer_id", "asc")], "rank_by_abs_variance", rank_keys=1,
        running={"abs_variance": "cum"}, count_as="entities_in_comparison",
    ).filter(F.col("rank_by_abs_variance") <= n)
    return e.select(
        "rank_by_abs_variance", "buyer_id", "buyer_name",
        F.col("n").alias("eligible_ocids"),
        money(F.col("budget"), r, 2).alias(_unit(v, "budget")),
        money(F.col("award"), r, 2).alias(_unit(v, "award")),
        money(F.col("variance"), r, 2).alias(_unit(v, "net_variance")),
        F.round(ratio(F.col("award"), F.col("budget")), 4).alias("aggregate_ratio"),
        F.round("med", 4).alias("median_ratio"),
        pct(F.col("cum"), F.col("cum_total"), 1).alias("cumulative_share_of_abs_variance_pct"),
        "entities_in_comparison",
    )


def entity_departure(v, n: int = 15) -> DataFrame:
    e = _entity_totals(v).withColumn("departure", F.abs(F.col("med") - 1))
    e = with_position(e, [("departure", "desc")], "rank_by_median_departure", count_as="entities_in_comparison")
    e = with_position(e, [("aligned", "asc"), ("buyer_id", "asc")], "_row", kind="row_number")
    return e.filter(F.col("rank_by_median_departure") <= n).select(
        "rank_by_median_departure", "buyer_id", "buyer_name",
        F.col("n").alias("eligible_ocids"),
        F.round("med", 4).alias("median_ratio"),
        F.round(F.col("aligned") * 100, 1).alias("pct_ocids_within_10pct_of_budget"),
        ntile(F.col("_row"), F.col("entities_in_comparison"), 4).alias("alignment_quartile"),
        "entities_in_comparison",
    )


def budget_reuse(v) -> DataFrame:
    per = v.budget_award_comparison.groupBy("budget_project_id").agg(
        rows().alias("n"), F.sum(BUDGET).alias("summed"), F.max(BUDGET).alias("once")
    )
    t = per.agg(
        rows().alias("ids"), F.count_if(F.col("n") > 1).alias("shared"), F.sum("summed").alias("summed"),
        F.sum("once").alias("once"),
    )
    clean = "no budget line is repeated across OCIDs: totals are not inflated by sharing"
    shared = "some budget lines are repeated across OCIDs: totals overstate budget"
    return t.select(
        F.col("ids").alias("budget_project_ids"),
        F.col("shared").alias("ids_used_by_several_ocids"),
        money(F.col("summed"), v.rules, 1).alias(_unit(v, "summed_budget")),
        money(F.col("once"), v.rules, 1).alias(_unit(v, "budget_counted_once")),
        F.when(F.col("summed") == F.col("once"), clean).otherwise(shared).alias("reading"),
    )


def placeholder_budgets(v) -> DataFrame:
    """Every count from one scan."""
    r = v.rules
    small = F.col(BUDGET) < F.lit(r.small_budget)
    huge = F.col(RATIO) >= r.huge_ratio
    return v.budget_award_comparison.agg(
        rows().alias("comparable_ocids"),
        F.count_if(small).alias("ocids_with_budget_under_100k"),
        F.min(F.when(small, F.col(BUDGET))).alias("smallest_budget_ngn"),
        F.max(F.when(small, F.col(RATIO))).alias("largest_ratio_among_them"),
        F.count_if(small & huge).alias("of_which_ratio_1m_or_more"),
        F.count_if(huge).alias("all_ocids_with_ratio_1m_or_more"),
        F.count_if(huge & ~small).alias("ratio_1m_or_more_with_budget_100k_plus"),
    )


def _band_by_entity(v, band: DataFrame, n: int = 5) -> DataFrame:
    per = band.groupBy("buyer_id").agg(
        F.max("buyer_name").alias("buyer_name"), rows().alias("n"), F.sum(AWARD).alias("award")
    )
    whole = band.agg(rows().alias("n"), F.sum(AWARD).alias("award"))
    top = top_rows(per, [("award", "desc"), ("buyer_id", "asc")], n).join(median_ratio(band, ["buyer_id"], 1), "buyer_id")
    w = Window.partitionBy(F.lit(0)).orderBy(F.col("award").desc())  # n rows
    all_n, all_award = whole.select("n").scalar(), whole.select("award").scalar()
    return top.withColumns({"all_n": all_n, "all_award": all_award}).select(
        F.rank().over(w).alias("rank_in_band"),
        "buyer_id", "buyer_name",
        F.col("n").alias("ocids_above_10x"),
        money(F.col("award"), v.rules, 1).alias(_unit(v, "award")),
        pct(F.col("award"), F.col("all_award"), 1).alias("pct_of_band_value"),
        "median_ratio",
        F.col("all_n").alias("band_ocids"),
        money(F.col("all_award"), v.rules, 1).alias(_unit(v, "band_award")),
    )


def above_ten_by_entity(v) -> DataFrame:
    return _band_by_entity(v, v.budget_award_comparison.filter(F.col(RATIO) > 10))


def above_ten_without_flagged(v) -> DataFrame:
    band = v.budget_award_comparison.filter(F.col(RATIO) > 10)
    return _band_by_entity(v, band.join(v.award_scale_flag.select("award_id"), "award_id", "left_anti"))


def unit_test(v) -> DataFrame:
    near, over = F.col(RATIO).between(900, 1100), F.col(RATIO) > 10
    t = v.budget_award_comparison.agg(
        F.count_if(near).alias("ocids_with_ratio_900_to_1100"),
        F.count_if(near & (F.col(BUDGET) >= F.lit(v.rules.small_budget))).alias("of_which_budget_100k_plus"),
        F.count_if(over).alias("ocids_above_10x"),
    )
    share = pct(F.col("ocids_with_ratio_900_to_1100"), F.nullif("ocids_above_10x", F.lit(0)), 1)
    mostly = F.col("ratio_900_to_1100_pct_of_above_10x") >= 50
    reading = F.when(mostly, "most of the above-10x OCIDs lie near 1,000").otherwise("they do not lie near 1,000")
    return t.withColumn("ratio_900_to_1100_pct_of_above_10x", share).withColumn("reading", reading)


def budget_sensitivity(v) -> DataFrame:
    marked = mark(v.budget_award_comparison, v.award_scale_flag, "award_id", "is_flagged")
    s = scenarios(marked, "1  as published (RS1, RS3)")
    over = F.col(RATIO) > 10
    t = s.groupBy("scenario").agg(
        *_totals(), F.count_if(over).alias("over_n"), sum_if(over, F.col(AWARD)).alias("over_award")
    ).join(median_ratio(s, ["scenario"]), "scenario")
    r = v.rules
    flagged = marked.filter("is_flagged").agg(rows()).scalar()
    return t.select(
        "scenario",
        F.col("n").alias("comparable_ocids"),
        flagged.alias("flagged_ocids_in_comparison"),
        money(F.col("budget"), r, 1).alias(_unit(v, "total_budget")),
        money(F.col("award"), r, 1).alias(_unit(v, "total_award")),
        F.round(ratio(F.col("award"), F.col("budget")), 4).alias("aggregate_award_to_budget_ratio"),
        "median_ratio",
        F.col("over_n").alias("ocids_above_10x"),
        money(F.col("over_award"), r, 1).alias(_unit(v, "above_10x_award")),
        pct(F.col("over_award"), F.col("award"), 2).alias("above_10x_pct_of_award_value"),
    )


def flag_footprint(v) -> DataFrame:
    f = mark(v.award_scale_flag, v.budget_award_comparison, "award_id", "compared")
    base = v.award_value_eligible.agg(F.sum(AWARD)).scalar()
    t = f.agg(
        rows().alias("flagged_awards"),
        F.count_if("dropped_decimal_test").alias("dropped_decimal"),
        F.count_if("sibling_lot_test").alias("sibling_lot"),
        F.sum(AWARD).alias("value"),
        F.count_if("compared").alias("in_budget_comparison"),
        F.count_distinct("buyer_id").alias("entities"),
    ).withColumn("base", base)
    return t.select(
        "flagged_awards", "dropped_decimal", "sibling_lot",
        money(F.col("value"), v.rules, 1).alias(_unit(v, "flagged_value")),
        pct(F.col("value"), F.col("base"), 1).alias("pct_of_m_v01_award_value"),
        "in_budget_comparison", "entities",
    )


def ratio_near_groups(v) -> DataFrame:
    award = F.col(AWARD)
    return v.budget_award_comparison.groupBy(bands.ratio_near(F.col(RATIO)).alias("ratio_group")).agg(
        rows().alias("ocids"),
        F.count_if(award == F.floor(award)).alias("whole_unit_awards"),
        money(F.sum(AWARD), v.rules, 1).alias(_unit(v, "award")),
        F.count_distinct("buyer_id").alias("entities"),
    )


# ------------------------------------------------------------------ question 4
DAYS = [
    ("M-E01 tender open duration", "tender_duration_eligible", "tender_duration_days"),
    ("M-E02 award lag", "award_lag_eligible", "award_lag_days"),
    ("P5-SIG signature lag", "signature_lag_eligible", "signature_lag_days"),
]
HEADLINES = [
    "M-E01 tender open duration (days)",
    "M-E02 award lag, tender start to award (days)",
    "P5-SIG signature lag, award to signing (days)",
]


def intervals(v, labels=None) -> DataFrame:
    labels = labels or [m for m, _, _ in DAYS]
    return union(
        [
            getattr(v, view).select(F.lit(label).alias("measure"), F.col(c).alias("days"))
            for label, (_, view, c) in zip(labels, DAYS)
        ]
    )


def timing_medians(v) -> DataFrame:
    return intervals(v, HEADLINES).groupBy("measure").agg(
        rows().alias("eligible_n"), median(F.col("days")).alias("median_days")
    )


def timing_distribution(v) -> DataFrame:
    probs = {"p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9, "p99": 0.99}
    days = F.col("days")
    t = intervals(v).groupBy("measure").agg(
        rows().alias("eligible_n"), F.min(days).alias("min_days"),
        F.percentile(days, F.array(*[F.lit(p) for p in probs.values()])).alias("q"),
        F.max(days).alias("max_days"), F.round(F.avg(days), 1).alias("mean_days"),
        F.count_if(days == 0).alias("same_day"), F.count_if(days > 365).alias("over_1_year"),
    )
    return t.select(
        "measure", "eligible_n", "min_days", *[F.round(F.col("q")[i], 6).alias(p) for i, p in enumerate(probs)], "max_days",
        "mean_days", "same_day", "over_1_year", pct(F.col("over_1_year"), F.col("eligible_n"), 2).alias("over_1_year_pct"),
    )


def duration_bands(v) -> DataFrame:
    b = intervals(v).groupBy("measure", bands.duration_band(F.col("days")).alias("duration_band")).agg(
        rows().alias("processes")
    )
    return cumulative_bands(b, "duration_band", "processes", ("measure",)).select(
        "measure", "duration_band", "processes",
        pct(F.col("processes"), F.col("_total"), 2).alias("pct_of_measure"),
        pct(F.col("_upto"), F.col("_total"), 2).alias("cumulative_pct"),
    )


def timing_by_method(v) -> DataFrame:
    g = "procurement_method"

    def one(df, days, n, med):
        return df.groupBy(method().alias(g)).agg(rows().alias(n), median(F.col(days)).alias(med))

    d = one(v.tender_duration_eligible, "tender_duration_days", "dn", "median_tender_duration_days")
    lag = one(v.award_lag_eligible, "award_lag_days", "ln", "median_award_lag_days")
    dn, ln = F.coalesce("dn", F.lit(0)), F.coalesce("ln", F.lit(0))
    note = "small n in at least one measure: read with caution"
    return d.join(lag, g, "full").select(
        g, dn.alias("tender_duration_n"), "median_tender_duration_days", ln.alias("award_lag_n"),
        "median_award_lag_days", small_n_note(F.least(dn, ln), v.rules.small_n, note).alias("reliability_note"),
    )


def _by_year(v, df: DataFrame, day: str, days: str, name: str) -> DataFrame:
    """Year-on-year change only where the previous calendar year is present."""
    t = df.groupBy(F.year(day).alias(name)).agg(rows().alias("eligible_n"), median(F.col(days)).alias("median_days"))
    prev = t.select((F.col(name) + 1).alias(name), F.col("median_days").alias("_prev"))
    return t.join(prev, name, "left").select(
        name, "eligible_n", "median_days",
        (F.col("median_days") - F.col("_prev")).alias("change_vs_previous_year_days"),
        small_n_note(F.col("eligible_n"), v.rules.small_n, SMALL_N_NOTE).alias("reliability_note"),
    )


def duration_by_year(v) -> DataFrame:
    return _by_year(v, v.tender_duration_eligible, "tender_start_date", "tender_duration_days", "tender_start_year")


def lag_by_year(v) -> DataFrame:
    return _by_year(v, v.award_lag_eligible, "award_date", "award_lag_days", "award_year")


RESULT_SETS = {
    "q3_1_budget_headline": budget_headline,
    "q3_1b_register": lambda v: register.entries(v, "P4-BvA"),
    "q3_2_ratio_percentiles": ratio_percentiles,
    "q3_3_ratio_bands": ratio_bands,
    "q3_4_variance_by_method": variance_by_method,
    "q3_5_entity_variance": entity_variance,
    "q3_6_entity_departure": entity_departure,
    "q3_7_budget_reuse": budget_reuse,
    "q3_8_placeholder_budgets": placeholder_budgets,
    "q3_9_above_ten_by_entity": above_ten_by_entity,
    "q3_10_unit_test": unit_test,
    "q3_11_budget_sensitivity": budget_sensitivity,
    "q3_11a_flag_footprint": flag_footprint,
    "q3_11b_above_ten_without_flagged": above_ten_without_flagged,
    "q3_12_ratio_near_groups": ratio_near_groups,
    "q4_1_timing_medians": timing_medians,
    "q4_1b_register": lambda v: register.entries(v, "M-E01", "M-E02", "P5-SIG", with_name=True),
    "q4_2_timing_distribution": timing_distribution,
    "q4_3_duration_bands": duration_bands,
    "q4_4_timing_by_method": timing_by_method,
    "q4_5_duration_by_year": duration_by_year,
    "q4_6_lag_by_year": lag_by_year,
}
