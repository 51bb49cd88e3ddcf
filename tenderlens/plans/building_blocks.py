"""The vocabulary the views and result sets are composed of, one small query each.

Every block runs over the whole tables of a workspace.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenderlens.functions import bands, flags
from tenderlens.operators.bands_join import pairs_apart
from tenderlens.operators.concentration import concentration, hhi, holder_totals, top_share_with_ties
from tenderlens.operators.order_stats import depth_to_share, exact_percentiles, ntile, percent_rank, top_rows, with_position
from tenderlens.plans.check_suites import DATE_COLUMNS, MONEY_COLUMNS
from tenderlens.plans.common import mark, pct, ratio, rows, sum_if, union, with_totals
from tenderlens.plans.export import minor_units
from tenderlens.plans.profile import multiplicity, profiler_date_class, raw_dates, study_date_class, threshold_counts
from tenderlens.plans.questions_supply import AWARD, cumulative_bands
from tenderlens.plans.questions_value import RATIO, intervals
from tenderlens.plans.views import method, rate

N = "number_of_tenderers"


# ------------------------------------------------------------------ flags
def date_flags(ws) -> DataFrame:
    days = union([getattr(ws.stg, t).select(F.lit(c).alias("field"), F.col(c).alias("day")) for t, c in DATE_COLUMNS])
    return days.groupBy("field", flags.date_flag(F.col("day"), ws.rules).alias("flag")).agg(rows().alias("n"))


def zero_flags(ws) -> DataFrame:
    money = union([getattr(ws.stg, t).select(F.lit(c).alias("field"), F.col(c).alias("x")) for t, c, _ in MONEY_COLUMNS])
    return money.groupBy("field", flags.zero_flag(F.col("x")).alias("flag")).agg(rows().alias("n"))


def extreme_flags(ws) -> DataFrame:
    r, stg = ws.rules, ws.stg
    both = union(
        [
            stg.planning.select(F.lit("budget").alias("field"), flags.extreme_flag(F.col("budget_amount"), r.extreme_budget).alias("flag")),
            stg.awards.select(F.lit("award").alias("field"), flags.extreme_flag(F.col(AWARD), r.extreme_award).alias("flag")),
        ]
    )
    return both.groupBy("field", "flag").agg(rows().alias("n"))


def incomplete_ids(ws) -> DataFrame:
    c = ws.core
    return union(
        [
            c.stg.parties.filter("supplier_id_flag IS NOT NULL").agg(rows().alias("n")).select(F.lit("supplier party").alias("kind"), "n"),
            c.dim_supplier.filter("supplier_id_flag IS NOT NULL").agg(rows().alias("n")).select(F.lit("supplier").alias("kind"), "n"),
            c.dim_buyer.filter("buyer_id_flag IS NOT NULL").agg(rows().alias("n")).select(F.lit("buyer").alias("kind"), "n"),
        ]
    )


def bands_everywhere(ws) -> DataFrame:
    v = ws.v
    ct = v.contract_implementation_coverage
    cover = ct.filter("buyer_id_flag IS NULL").groupBy("buyer_id").agg(rate(F.col("has_implementation")).alias("r"))
    parts = {
        "participation": (v.competition_eligible, bands.participation_band(F.col(N))),
        "ratio": (v.budget_award_comparison, bands.ratio_band(F.col(RATIO))),
        "duration": (intervals(v), bands.duration_band(F.col("days"))),
        "coverage": (cover, bands.coverage_band(F.col("r"))),
        "implementation": (ct, bands.implementation_type(F.col("transaction_count"), F.col("implementation_milestone_count"))),
        "stage": (v.lifecycle_stage, F.col("highest_stage")),
        "ratio_near": (v.budget_award_comparison, bands.ratio_near(F.col(RATIO))),
    }
    return union(
        [df.groupBy(b.alias("band")).agg(rows().alias("n")).select(F.lit(k).alias("family"), "band", "n") for k, (df, b) in parts.items()]
    )


def materiality_levels(ws) -> DataFrame:
    level = flags.materiality(F.greatest("pct_of_candidate", F.lit(0.0)), ws.rules)
    return ws.v.dq_impact.groupBy(level.alias("level")).agg(rows().alias("n"))


FLAGS = {
    "f01_date_flags": date_flags,
    "f02_extreme_flags": extreme_flags,
    "f03_zero_flags": zero_flags,
    "f04_count_class": lambda ws: ws.stg.tender.groupBy(flags.count_class(F.col(N), ws.rules).alias("count_class")).agg(rows().alias("n")),
    "f05_incomplete_ids": incomplete_ids,
    "f06_test_entity": lambda ws: ws.stg.releases.groupBy(flags.test_entity_flag(F.col("buyer_id"), ws.rules).alias("flag")).agg(rows().alias("n")),
    "f07_standard_names": lambda ws: ws.stg.award_suppliers.select(
        "award_id", "supplier_seq", flags.standard_name(F.col("supplier_name_raw")).alias("name")),
    "f08_strict_trim": lambda ws: ws.stg.award_suppliers.groupBy(flags.strict_trim(F.col("supplier_name_raw")).alias("name")).agg(rows().alias("n")),
    "f09_sequence_key": lambda ws: ws.stg.releases.select("release_id", flags.sequence_key(F.col("release_id")).alias("release_seq")),
    "f10_multi_project": lambda ws: ws.core.process_snapshot.groupBy(
        flags.multi_project_flag(F.col("budget_line_count")).alias("flag")).agg(rows().alias("n")),
    "f11_test_like_names": lambda ws: ws.core.dim_buyer.select(
        "buyer_id", flags.looks_like_test([F.col("buyer_id"), F.col("buyer_name_raw")], ws.rules).alias("test_like")),
    "f12_buyer_labels": lambda ws: ws.core.dim_buyer.select("buyer_id", flags.buyer_code(F.col("buyer_id"), ws.rules).alias("code")),
    "f13_profiler_date_classes": lambda ws: raw_dates(ws.releases).groupBy(
        profiler_date_class(F.col("text")).alias("date_class")).agg(rows().alias("n")),
    "f14_study_date_classes": lambda ws: raw_dates(ws.releases).groupBy(
        "field", study_date_class(F.col("text"), ws.rules).alias("date_class")).agg(rows().alias("n")),
    "f15_bands": bands_everywhere,
    "f16_small_n_notes": lambda ws: ws.v.entity_benchmark.select("buyer_id", flags.small_n_note(F.col("award_n"), 40).alias("note")),
    "f17_materiality": materiality_levels,
}


# ------------------------------------------------------------------ joins
def _award_buyer(ws):
    return ws.stg.awards.select("release_id", "award_id", AWARD)


def full_outer(ws) -> DataFrame:
    d = ws.v.tender_duration_eligible.groupBy(method().alias("m")).agg(rows().alias("a"))
    x = ws.v.award_value_eligible.groupBy(method().alias("m")).agg(rows().alias("b"))
    return d.join(x, "m", "full").select(F.col("m").alias("method"), F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))


def theta_grid(ws) -> DataFrame:
    """Per N of a small grid, the value of the N largest suppliers."""
    totals = holder_totals(ws.v.supplier_award_eligible, "supplier_id", AWARD)
    best = top_rows(totals, [("value", "desc"), ("supplier_id", "asc")], 20)
    grid = F.array(*[F.lit(n) for n in (1, 5, 10, 20)])
    return best.withColumn("n", F.explode(grid)).filter(F.col("position") <= F.col("n")).groupBy("n").agg(F.sum("value").alias("value"))


def stage_self_join(ws) -> DataFrame:
    per = ws.v.lifecycle_stage.groupBy("highest_stage_rank").agg(rows().alias("n"))
    prev = per.select((F.col("highest_stage_rank") + 1).alias("highest_stage_rank"), F.col("n").alias("previous"))
    return per.join(prev, "highest_stage_rank").select("highest_stage_rank", "n", "previous")


def not_the_latest(ws) -> DataFrame:
    """Awards with a later award release in their process."""
    last = ws.stg.awards.groupBy("ocid").agg(F.max("release_seq").alias("last"))
    return ws.stg.awards.select("ocid", "award_id", "release_seq").join(last, "ocid").filter(
        F.col("release_seq") < F.col("last")).select("ocid", "award_id")


def sibling_pairs(ws) -> DataFrame:
    """Every pair of awards of one supplier from one buyer of which one is many times the other."""
    own = ws.v.supplier_award_eligible.filter(F.col("buyer_id_flag").isNull())
    found = pairs_apart(own, ["supplier_id", "buyer_id"], "award_id", AWARD, ws.rules.sibling_factor)
    return found.withColumnsRenamed({"other_award_id": "sibling_award_id", f"other_{AWARD}": "sibling_award_value"})


JOINS = {
    "j01_inner": lambda ws: _award_buyer(ws).join(ws.stg.tender.select("release_id", "tender_id"), "release_id").select("award_id", "tender_id"),
    "j02_left": lambda ws: ws.stg.awards.select("award_id").join(
        ws.stg.contracts.select("award_id", "contract_id"), "award_id", "left"),
    "j03_left_composite": lambda ws: ws.stg.awards.select("release_id", "award_id").join(
        ws.stg.contracts.select("release_id", "award_id", "status"), ["release_id", "award_id"], "left"),
    "j04_left_with_predicate": lambda ws: ws.core.process_snapshot.alias("s").join(
        ws.core.budget_lines.alias("b"), (F.col("s.ocid") == F.col("b.ocid")) & (F.col("s.budget_line_count") == 1), "left"
    ).select("s.ocid", "s.budget_line_count", "b.budget_project_id"),
    "j05_full_outer": full_outer,
    "j06_one_row_pair": lambda ws: ws.v.award_value_eligible.agg(rows().alias("candidates")).withColumn(
        "eligible", ws.v.supplier_award_eligible.agg(rows()).scalar()),
    "j07_parameter": lambda ws: ws.v.entity_benchmark.filter(F.col("award_n") >= ws.rules.min_awards).select("buyer_id", "award_n"),
    "j08_grid_theta": theta_grid,
    "j09_unnest": lambda ws: ws.stg.releases.select("release_id", F.explode("tag").alias("t")).groupBy("t").agg(rows().alias("n")),
    "j10_semi": lambda ws: ws.stg.releases.join(ws.stg.awards.select("release_id"), "release_id", "left_semi").select("release_id", "ocid"),
    "j11_marker": lambda ws: mark(ws.v.award_value_eligible, ws.v.award_scale_flag, "award_id", "is_flagged").select("award_id", "is_flagged"),
    "j12_anti": lambda ws: ws.stg.tender.join(ws.stg.awards.select("release_id"), "release_id", "left_anti").select("release_id", "tender_id"),
    "j13_not_in": lambda ws: ws.stg.releases.select("buyer_id").distinct().join(
        ws.v.dim_buyer.select("buyer_id").filter("buyer_id IS NOT NULL"), "buyer_id", "left_anti"),
    "j14_left_is_null": lambda ws: ws.stg.awards.select("award_id").join(
        ws.stg.contracts.select("award_id", "contract_id"), "award_id", "left").filter("contract_id IS NULL").select("award_id"),
    "j15_siblings": sibling_pairs,
    "j16_previous_stage": stage_self_join,
    "j17_later_exists": not_the_latest,
    "j18_scalar_subquery": lambda ws: ws.v.award_scale_flag.select(
        "award_id", pct(F.col(AWARD), ws.v.award_value_eligible.agg(F.sum(AWARD)).scalar(), 6).alias("pct_of_all")),
    "j19_mismatch": lambda ws: ws.stg.awards.select("release_id", AWARD).join(
        ws.stg.tender.select("release_id", "tender_value_amount"), "release_id").filter(
        F.col(AWARD) != F.col("tender_value_amount")).agg(rows().alias("mismatches"), F.count_distinct("release_id").alias("releases")),
    "j20_two_hops": lambda ws: ws.stg.transactions.select("contract_id", "transaction_id").join(
        ws.stg.contracts.select("contract_id", "release_id"), "contract_id").join(
        ws.stg.releases.select("release_id", "buyer_id"), "release_id").groupBy("buyer_id").agg(rows().alias("transactions")),
}


# ------------------------------------------------------------------ aggregates
def describe_tenderers(ws) -> DataFrame:
    x = F.col(N)
    t = ws.stg.tender.select(x)
    stats = t.agg(rows().alias("n"), F.min(x).alias("minimum"), F.max(x).alias("maximum"), F.round(F.avg(x), 4).alias("mean"))
    # One-row answers meet as scalar subqueries.
    parts = (
        exact_percentiles(t, N, {"q1": 0.25, "q3": 0.75, "p95": 0.95}, exclusive=True), exact_percentiles(t, N, {"median": 0.5})
    )
    for i, p in enumerate(parts):
        stats = stats.withColumn(f"_{i}", p.select(F.struct(*p.columns).alias("s")).scalar())
    return stats.select(
        "n", "minimum", "maximum", "mean",
        *[F.round(f"_{i}.{c}", 4).alias(c) for i, p in enumerate(parts) for c in p.columns])


def presence(ws) -> DataFrame:
    t = ws.stg.tender
    cols = [c for c in t.columns if c not in ("release_id", "ocid", "release_seq")]
    one = t.agg(*[F.count(c).alias(c) for c in cols])
    return one.unpivot([], cols, "field", "present")


AGGREGATES = {
    "a01_basic": lambda ws: ws.v.award_value_eligible.groupBy("buyer_id").agg(
        rows().alias("n"), F.count("procurement_method_details").alias("with_method"), F.sum(AWARD).alias("total"),
        F.min(AWARD).alias("lowest"), F.max(AWARD).alias("highest")),
    "a02_count_distinct": lambda ws: ws.v.supplier_award_eligible.groupBy("buyer_id").agg(F.count_distinct("supplier_id").alias("suppliers")),
    "a03_count_distinct_row": lambda ws: ws.stg.planning.agg(
        F.count_distinct(F.struct("ocid", "budget_project_id")).alias("pairs_with_null"),
        F.count_distinct("ocid", "budget_project_id").alias("pairs_without_null")),
    "a04_filtered": lambda ws: ws.v.lifecycle_stage.agg(
        rows().alias("n"), F.count_if(F.col("highest_stage_rank") >= 3).alias("awarded"),
        sum_if(F.col("highest_stage_rank") >= 3, F.col("release_count")).alias("releases_of_awarded")),
    "a05_percentiles": lambda ws: exact_percentiles(
        ws.v.award_value_eligible, AWARD, {"p01": 0.01, "p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p99": 0.99}, ["buyer_id"]
    ).select("buyer_id", *[F.round(p, 4).alias(p) for p in ("p01", "p10", "p25", "p50", "p75", "p90", "p99")]),
    "a06_rates": lambda ws: ws.v.competition_eligible.groupBy("buyer_id").agg(
        F.round(rate(F.col("is_single_bidder")), 6).alias("single"),
        F.round(rate(F.col("is_single_bidder"), F.col("in_primary_population")), 6).alias("single_primary")),
    "a07_bool": lambda ws: ws.v.contract_implementation_coverage.groupBy("buyer_id").agg(
        F.bool_or("has_implementation").alias("any_reported"), F.bool_and("has_implementation").alias("all_reported")),
    "a08_distinct_sorted_array": lambda ws: ws.stg.awards.groupBy("ocid").agg(F.array_sort(F.collect_set("status")).alias("statuses")),
    "a09_latest_value": lambda ws: ws.stg.awards.groupBy("ocid").agg(F.max_by("award_id", "release_seq").alias("latest_award")),
    "a10_ordered_text": lambda ws: ws.v.dq_impact.withColumn(
        "part", F.concat("dq_ref", F.lit(" ("), F.col("records_with_issue").cast("string"), F.lit(")"))).groupBy("metric_id").agg(
        F.expr("listagg(part, '; ') WITHIN GROUP (ORDER BY records_with_issue DESC, dq_ref)").alias("issues")),
    "a11_two_levels": lambda ws: holder_totals(ws.v.supplier_award_eligible, "supplier_id", AWARD, ["buyer_id"]).groupBy("buyer_id").agg(
        rows().alias("suppliers"), F.max("value").alias("largest"), F.sum("value").alias("total")),
    "a12_having": lambda ws: ws.stg.releases.groupBy("ocid").agg(rows().alias("n")).filter("n > 12"),
    "a13_weighted_gap": lambda ws: ws.v.competition_eligible.groupBy(method().alias("method")).agg(
        rate(F.col("is_single_bidder")).alias("r")).select(
        "method", F.round(F.col("r") - ws.v.competition_eligible.agg(rate(F.col("is_single_bidder"))).scalar(), 6).alias("gap")),
    "a14_hhi": lambda ws: holder_totals(ws.v.supplier_award_eligible, "supplier_id", AWARD, ["buyer_id"]).groupBy("buyer_id").agg(
        F.round(hhi(F.col("value")), 4).alias("hhi")),
    "a15_top_share": lambda ws: concentration(
        holder_totals(ws.v.supplier_award_eligible, "supplier_id", AWARD), "supplier_id", [10]).select(
        F.round(ratio(F.col("top_10"), F.col("value")), 6).alias("strict")).withColumn(
        "with_ties", F.round(top_share_with_ties(holder_totals(ws.v.supplier_award_eligible, "supplier_id", AWARD), 10).scalar(), 6)),
    "a16_depth_to_share": lambda ws: depth_to_share(
        holder_totals(ws.v.supplier_award_eligible, "supplier_id", AWARD, ["buyer_id"]), "value",
        {"to_50": "0.5", "to_80": "0.8"}, ["buyer_id"]),
    "a17_conditional_pivot": lambda ws: ws.v.dq_impact.groupBy("metric_id").agg(
        F.max(F.when(F.col("dq_ref") == "ALL", F.col("records_with_issue"))).alias("all_reasons"),
        F.max(F.when(F.col("dq_ref") == "OTHER", F.col("records_with_issue"))).alias("other_rule")),
    "a18_frequency": lambda ws: ws.stg.releases.groupBy(F.array_join(F.array_sort("tag"), ",").alias("tags")).agg(rows().alias("n")),
    "a19_describe": describe_tenderers,
    "a20_thresholds": lambda ws: threshold_counts(
        ws, {"tenderers": [4, 8, 11], "budget": [100000, 300000, 495000], "award": [100000, 300000, 600000]}),
    "a21_presence": presence,
    "a22_multiplicity": lambda ws: multiplicity(ws.stg.award_suppliers, "supplier_id", "supplier_name_raw"),
}


# ------------------------------------------------------------------ windows
def _holders(ws):
    return holder_totals(ws.v.supplier_award_eligible, "supplier_id", AWARD)


def year_gap_change(ws) -> DataFrame:
    per = ws.v.award_lag_eligible.groupBy(F.year("award_date").alias("year")).agg(rows().alias("n"))
    w = Window.partitionBy(F.lit(0)).orderBy("year")  # one row per year
    gap = F.col("year") - F.lag("year").over(w)
    return per.withColumn("change", F.when(gap == 1, F.col("n") - F.lag("n").over(w)))


def second_largest(ws) -> DataFrame:
    w = Window.partitionBy("supplier_id").orderBy(F.col(AWARD).desc(), "award_id")
    two = ws.v.supplier_award_eligible.withColumn("rn", F.row_number().over(w)).filter("rn <= 2")
    return two.withColumn("second", F.lead(AWARD).over(w)).filter("rn = 1").select("supplier_id", F.col(AWARD).alias("first"), "second")


def partition_shares(ws) -> DataFrame:
    """Share of each holder in its group: the group totals are a second small
    aggregate, so no window ever buffers a whole group."""
    t = holder_totals(ws.v.supplier_award_eligible, "supplier_id", AWARD, ["buyer_id"])
    whole = t.groupBy("buyer_id").agg(F.sum("value").alias("total"))
    return t.join(whole, "buyer_id").select("buyer_id", "supplier_id", pct(F.col("value"), F.col("total"), 4).alias("share_pct"))


WINDOWS = {
    "w01_row_number": lambda ws: with_position(
        _holders(ws), [("value", "desc"), ("supplier_id", "asc")], "position", kind="row_number", split_ties=True).select("supplier_id", "position"),
    "w02_rank": lambda ws: with_position(
        ws.v.entity_benchmark.select("buyer_id", "award_n", "process_count"), [("award_n", "desc"), ("process_count", "desc")], "r"),
    "w03_percent_rank": lambda ws: with_position(
        ws.v.entity_benchmark.filter("single_bidder_rate IS NOT NULL").select("buyer_id", "single_bidder_rate"),
        [("single_bidder_rate", "asc")], "_r", count_as="_n").select(
        "buyer_id", F.round(percent_rank(F.col("_r"), F.col("_n")), 6).alias("place")),
    "w04_ntile": lambda ws: with_position(
        _holders(ws), [("value", "asc"), ("supplier_id", "asc")], "_place", kind="row_number", count_as="_n", split_ties=True).select(
        "supplier_id", ntile(F.col("_place"), F.col("_n"), 4).alias("quartile")),
    "w05_gap_aware_lag": year_gap_change,
    "w06_lead": second_largest,
    "w07_running_share": lambda ws: with_position(
        _holders(ws), [("value", "desc"), ("supplier_id", "asc")], "position", kind="row_number", running={"value": "cum"}, split_ties=True).select(
        "supplier_id", "cum", pct(F.col("cum"), F.col("cum_total"), 4).alias("cumulative_pct")),
    "w08_partition_totals": partition_shares,
    "w09_over_aggregate": lambda ws: cumulative_bands(
        ws.v.competition_eligible.groupBy(bands.participation_band(F.col(N)).alias("band")).agg(rows().alias("n")), "band", "n"
    ).select("band", "n", pct(F.col("_upto"), F.col("_total"), 4).alias("cumulative_pct")),
    "w10_filtered_window": lambda ws: ws.v.dq_impact.select(
        "metric_id", "dq_ref", F.max(F.when(F.col("dq_ref") == "ALL", F.col("records_with_issue"))).over(
            Window.partitionBy("metric_id")).alias("excluded")),
    "w11_entities_compared": lambda ws: with_totals(
        ws.v.entity_benchmark.filter(F.col("award_n") >= 30).select("buyer_id", "award_n"), entities_in_comparison=rows()),
    "w12_competition_rank": lambda ws: with_position(
        ws.v.entity_benchmark.select("buyer_id", "contract_n").filter("contract_n IS NOT NULL"), [("contract_n", "desc")], "place"),
}


# ------------------------------------------------------------------ order, top-k, sets
def both_ends(ws) -> DataFrame:
    e = ws.v.entity_benchmark.select("buyer_id", "award_value_total").filter("award_value_total IS NOT NULL")
    hi = top_rows(e, [("award_value_total", "desc"), ("buyer_id", "asc")], 3).withColumn("side", F.lit("highest"))
    lo = top_rows(e, [("award_value_total", "asc"), ("buyer_id", "asc")], 3).withColumn("side", F.lit("lowest"))
    return hi.unionByName(lo)


def symmetric_difference(ws) -> DataFrame:
    a = ws.stg.tender.select("ocid").distinct()
    b = ws.stg.awards.select("ocid").distinct()
    one = union([
        a.join(b, "ocid", "left_anti").select(F.lit("tender only").alias("side")),
        b.join(a, "ocid", "left_anti").select(F.lit("award only").alias("side")),
    ])
    return one.groupBy("side").agg(rows().alias("n"))


ORDERS_AND_SETS = {
    "t01_order_by": lambda ws: ws.v.metric_population.orderBy(F.col("candidate_count").desc(), "metric_id").select("metric_id", "candidate_count"),
    "t02_limit": lambda ws: _holders(ws).orderBy(F.col("value").desc(), "supplier_id").limit(7).select("supplier_id", "value"),
    "t03_top_with_ties": lambda ws: with_position(_holders(ws), [("awards", "desc")], "place").filter("place <= 5").select("supplier_id", "awards", "place"),
    "t04_both_ends": both_ends,
    "t05_cutoff_ties": lambda ws: with_position(
        ws.v.competition_eligible.groupBy("buyer_id").agg(rows().alias("n")), [("n", "desc")], "place").filter("place <= 10"),
    "t06_signed_extremes": lambda ws: top_rows(
        ws.v.budget_award_comparison.groupBy("buyer_id").agg(F.sum("variance_amount").alias("net")).withColumn(
            "side", F.when(F.col("net") > 0, "above").otherwise("below")).withColumn("size", F.abs("net")),
        [("size", "desc"), ("buyer_id", "asc")], 4, ["side"]).select("side", "buyer_id", "net", "position"),
    "t07_custom_order": lambda ws: ws.v.lifecycle_stage.groupBy("highest_stage").agg(rows().alias("n")).withColumn(
        "place", F.array_position(F.array(*[F.lit(s) for s in reversed(bands.STAGES)]), F.col("highest_stage"))).orderBy("place"),
    "t08_most_repeated": lambda ws: ws.stg.releases.groupBy("ocid").agg(rows().alias("n")).orderBy(F.col("n").desc(), "ocid").limit(10),
    "u01_union_all": lambda ws: intervals(ws.v).groupBy("measure").agg(rows().alias("n"), F.sum("days").alias("days")),
    "u02_union_distinct": lambda ws: ws.stg.parties.filter(F.array_contains("roles", "supplier")).select(
        F.col("party_id").alias("supplier_id")).union(ws.stg.award_suppliers.select("supplier_id")).distinct(),
    "u03_distinct": lambda ws: ws.stg.award_suppliers.select("award_id", "supplier_id").distinct(),
    "u04_distinct_on": lambda ws: top_rows(
        ws.stg.tender.select("ocid", "tender_id", "release_seq"), [("release_seq", "desc")], 1, ["ocid"]).select("ocid", "tender_id"),
    "u05_symmetric_difference": symmetric_difference,
    "u06_intersection": lambda ws: ws.stg.tender.filter("tenderer_count_flag <> 'NORMAL'").select("ocid").intersect(
        ws.stg.awards.filter("award_monetary_flag IS NOT NULL").select("ocid")),
}


# ------------------------------------------------------------------ scalar functions
SCALARS = {
    "x01_round": lambda ws: ws.v.budget_award_comparison.select("award_id", F.round(RATIO, 2).alias("r2"), F.round(RATIO, 0).alias("r0")),
    "x02_null_functions": lambda ws: ws.v.entity_benchmark.select(
        "buyer_id", F.coalesce("award_n", F.lit(0)).alias("award_n"), F.nullif("distinct_supplier_n", "award_n").alias("fewer_suppliers"),
        F.greatest("award_n", "contract_n").alias("most"), F.least("award_n", "contract_n").alias("fewest")),
    "x03_case": lambda ws: ws.v.lifecycle_stage.select("ocid", F.when(F.col("highest_stage_rank") >= 4, F.when(
        F.col("release_count") > 10, "late, many").otherwise("late, few")).otherwise("early").alias("kind")),
    "x04_distinct_from": lambda ws: ws.stg.awards.select("award_id", (~F.col("status").eqNullSafe("active")).alias("not_active")),
    "x05_between_in": lambda ws: ws.v.competition_eligible.select(
        "ocid", F.col(N).between(2, 5).alias("two_to_five"), F.col("tender_status").isin("active", "planned").alias("open_status"),
        F.lit("B-3").isin(F.col("buyer_id"), F.col("tender_id")).alias("any_b3")),
    "x06_arithmetic": lambda ws: ws.v.budget_award_comparison.select(
        "award_id", F.abs("variance_amount").alias("size"), F.round(F.pow(F.col(RATIO), 2), 4).alias("squared"),
        F.floor(AWARD).cast("bigint").alias("whole"), (F.col(AWARD) % 1).alias("fraction")),
    "x07_dates": lambda ws: ws.stg.contracts.select(
        "contract_id", F.datediff("period_end_date", "period_start_date").alias("days"), F.year("date_signed").alias("year")),
    "x08_date_literals": lambda ws: ws.stg.awards.groupBy(
        (F.col("award_date") >= F.lit("1998-01-01").cast("date")).alias("since_1998")).agg(rows().alias("n")),
    "x09_trim": lambda ws: ws.stg.award_suppliers.select(
        "award_id", "supplier_seq", F.trim("supplier_name_raw").alias("spaces"), F.btrim("supplier_name_raw", F.lit(flags.STRIP_CHARS)).alias("strict")),
    "x10_regexp_replace": lambda ws: ws.v.metric_population.select(
        "metric_id", F.regexp_replace("metric_id", "[^A-Za-z0-9]+", "-").alias("slug")),
    "x11_regexp_match": lambda ws: ws.core.dim_supplier.select("supplier_id", F.col("supplier_name").rlike(r"(?i)\bsupplier 1\d*\b").alias("starts_with_1")),
    "x12_concat": lambda ws: ws.core.dim_buyer.select(
        "buyer_id", F.concat("buyer_id", F.lit(" / "), "buyer_name").alias("joined"), F.concat_ws(" ", "buyer_id", "buyer_name").alias("spaced"),
        F.rtrim(F.concat("buyer_id", F.lit("--")), F.lit("-")).alias("right_trimmed")),
    "x13_casts": lambda ws: ws.stg.releases.select(
        "release_id", F.col("release_id").cast("bigint").alias("as_integer"), F.col("release_seq").cast("string").alias("as_text")),
    "x14_array_predicates": lambda ws: ws.stg.releases.select(
        "release_id", F.array_contains("tag", "award").alias("has_award"),
        F.arrays_overlap("tag", F.array(F.lit("contract"), F.lit("implementation"))).alias("contract_or_later")),
    "x15_array_functions": lambda ws: ws.stg.releases.select(
        "release_id", F.size("tag").alias("n_tags"), F.array_remove("tag", "planning").alias("without_planning"), F.element_at("tag", 1).alias("first_tag")),
    "x16_boolean_parity": lambda ws: ws.stg.tender.agg(F.count_if(
        F.col("tender_start_date").isNull() != F.col("tender_start_date_flag").isNull()).alias("mismatches"), rows().alias("n")),
    "x17_safe_division": lambda ws: ws.core.process_snapshot.select(
        "ocid", F.round(F.try_divide(F.col("release_count"), F.col("budget_line_count") - 1), 6).alias("per_extra_line")),
    "x18_units": lambda ws: ws.v.award_value_eligible.select(
        "award_id", minor_units(F.col(AWARD)).alias("minor"), F.round(F.col(AWARD).cast("double") / ws.rules.unit, 2).alias("shown")),
    "x19_nested_access": lambda ws: ws.releases.select(
        "id", F.col("planning.budget.amount.currency").alias("currency"), F.col("tender.tenderPeriod.endDate").alias("tender_end"),
        F.get("awards", F.lit(0))["value"]["amount"].alias("first_award")),
}

BLOCKS = {**FLAGS, **JOINS, **AGGREGATES, **WINDOWS, **ORDERS_AND_SETS, **SCALARS}
