"""Data-quality impact: the exclusion attribution of every metric, with disclosures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderlens.operators.attribution import Population, exclusion_attribution

# Display order, name and grain of each metric.
METRIC_META = [
    ("ALL", 0, "All OCID-level metrics (process snapshot)", "OCID"),
    ("M-P01", 1, "Total planned budget by entity", "budget line"),
    ("M-C01 / M-C02", 2, "Median tenderers; single-bidder rate (primary)", "OCID"),
    ("M-V01", 3, "Median award value", "OCID (one award)"),
    ("M-S01", 4, "Top-supplier award value concentration", "award"),
    ("P4-BvA", 5, "Budget-to-award comparison", "OCID"),
    ("M-E01", 6, "Median tender duration (days)", "OCID"),
    ("M-E02", 7, "Median award lag (days)", "OCID"),
    ("P5-SIG", 8, "Contract signature lag (days)", "contract"),
    ("M-E03", 9, "Lifecycle conversion", "OCID"),
    ("M-I01", 10, "Implementation reporting coverage", "contract"),
    ("ENTITY", 11, "Procuring-entity benchmark", "buyer"),
]
# Issue code, issue, treatment; notes are this library's own words.
ISSUE_META = [
    ("DQ-01", "Repeated OCIDs (multi-release processes)", "RETAIN",
     "Kept: the snapshot takes each section from its latest release, so nothing is counted twice."),
    ("DQ-02", "Planning-only processes", "RETAIN",
     "Kept: later-stage metrics describe only the processes that got further."),
    ("DQ-04", "Elevated tenderer count", "FLAG",
     "Left out of the primary result, kept in the sensitivity population."),
    ("DQ-05", "Anomalous tenderer count", "EXCLUDE_FROM_METRIC",
     "Left out of both competition populations."),
    ("DQ-06", "Extreme budget", "EXCLUDE_FROM_METRIC", "One such value would dominate any total."),
    ("DQ-07", "Extreme award value", "EXCLUDE_FROM_METRIC", "One such value would dominate any total."),
    ("DQ-08", "Placeholder date", "EXCLUDE_FROM_METRIC", "Left out of the timing metric that needs the date."),
    ("DQ-09", "Future or impossible date", "EXCLUDE_FROM_METRIC",
     "Left out of the timing metric that needs the date."),
    ("DQ-11", "Implementation transaction dates absent", "RETAIN",
     "Transactions show presence only; payment timing is not measurable."),
    ("DQ-12", "Implementation transaction value semantics unclear", "RETAIN",
     "Transaction values are never summed."),
    ("DQ-13", "Supplier ID with several name variants", "RETAIN",
     "Never merged: concentration is a lower bound."),
    ("DQ-14", "Incomplete supplier ID", "EXCLUDE_FROM_METRIC",
     "The supplier cannot be identified; state this with every concentration figure."),
    ("DQ-16", "Zero monetary value", "EXCLUDE_FROM_METRIC", "Zero is unusable, not a real amount."),
    ("DQ-18", "Release with no parties array", "EXCLUDE_FROM_METRIC", "The buyer cannot be confirmed."),
    ("DQ-19", "Incomplete buyer ID", "EXCLUDE_FROM_METRIC",
     "Left out of per-entity measures, kept in overall counts."),
    ("DQ-20", "Portal test entity", "EXCLUDE_FROM_METRIC",
     "Removed before each candidate population is defined."),
    ("C-06", "Several unrelated budget lines on one OCID", "EXCLUDE_FROM_METRIC",
     "No rule says which line the award answers."),
    ("DATE-ORDER", "Date chronology conflict (end before start)", "EXCLUDE_FROM_METRIC",
     "Negative durations are left out, not corrected."),
    ("OTHER", "Other eligibility rule (status, missing value, missing date, no budget line)",
     "EXCLUDE_FROM_METRIC", "Not a numbered issue; missing values are never imputed."),
]
ALL_REASONS = "All exclusion reasons combined (candidate minus eligible)"


def _date_issues(first: str, second: str, first_day: str, second_day: str) -> dict:
    a, b = F.col(first), F.col(second)
    late = ["FUTURE", "IMPOSSIBLE"]
    return {
        "DQ-08": (a == "PLACEHOLDER") | (b == "PLACEHOLDER"),
        "DQ-09": a.isin(late) | b.isin(late),
        "DATE-ORDER": (a == "VALID") & (b == "VALID") & (F.col(second_day) < F.col(first_day)),
    }


def populations(v) -> list[Population]:
    core = v.core
    stg, r = core.stg, core.rules
    known = F.col("buyer_id").isNotNull()
    is_test = F.col("buyer_id") == r.test_buyer_id
    snap = core.process_snapshot.filter(known)
    yes = F.lit(True)
    tender = stg.tender.select(
        "ocid", F.col("release_id").alias("tender_release_id"), F.col("status").alias("tender_status"),
        "tenderer_count_flag", "tender_start_date", "tender_end_date", "tender_start_date_flag",
        "tender_end_date_flag", yes.alias("has_tender"),
    )
    award = stg.awards.select(
        "ocid", "award_id", F.col("status").alias("award_status"), "award_value_amount", "award_value_flag",
        "award_monetary_flag", "award_date", "award_date_flag", yes.alias("has_award"),
    )
    contract = stg.contracts.select("ocid", "contract_id", "date_signed", "date_signed_flag", yes.alias("has_contract"))
    # One row per process with its picked sections: five metrics read it at once.
    process = (
        snap.join(tender, ["ocid", "tender_release_id"], "left")
        .join(award, ["ocid", "award_id"], "left")
        .join(contract, ["ocid", "contract_id"], "left")
    )
    with_tender, with_award = F.col("has_tender").isNotNull(), F.col("has_award").isNotNull()

    complete = F.col("supplier_id") != r.bare_supplier_id
    suppliers = stg.award_suppliers.groupBy("award_id").agg(
        F.bool_or(complete).alias("has_complete"), F.bool_or(~complete).alias("has_bare")
    )
    no_complete = ~F.coalesce("has_complete", F.lit(False))
    has_bare = F.coalesce("has_bare", F.lit(False))

    single = F.col("budget_line_count") == 1
    extreme, zero = F.col("budget_amount_flag").isNotNull(), F.col("budget_monetary_flag").isNotNull()
    counts = core.process_snapshot.select("ocid", "budget_line_count")
    one_line = core.budget_lines.select("ocid", "budget_amount", "budget_amount_flag", "budget_monetary_flag").join(
        counts.filter(single).select("ocid"), "ocid", "left_semi"
    )
    # One row per eligible award with its suppliers and its only budget line: two metrics.
    awarded = (
        v.award_value_eligible.select("ocid", "award_id", "award_value_amount")
        .join(suppliers, "award_id", "left")
        .join(counts, "ocid")
        .join(one_line, "ocid", "left")
    )
    unusable = F.col("budget_amount").isNull() | (F.col("budget_amount") <= 0)
    amount = F.col("award_value_amount")

    def missing(first, second):
        return F.col(first).isNull() | F.col(second).isNull()

    return [
        Population(
            "M-P01", core.budget_lines.filter(known),
            {"DQ-06": extreme, "DQ-16": zero, "DQ-18": F.col("party_flag").isNotNull(),
             "DQ-19": F.col("buyer_id") == r.bare_buyer_id},
            F.col("budget_amount").isNull() | (F.col("budget_amount") < 0), is_test, F.col("budget_amount"),
        ),
        Population(
            "M-C01 / M-C02", process,
            {"DQ-04": F.col("tenderer_count_flag") == "ELEVATED",
             "DQ-05": F.col("tenderer_count_flag") == "ANOMALOUS"},
            F.col("tender_status").isNull(), is_test, present=with_tender,
        ),
        Population(
            "M-V01", process,
            {"DQ-07": F.col("award_value_flag").isNotNull(), "DQ-16": F.col("award_monetary_flag").isNotNull()},
            ~F.col("award_status").eqNullSafe("active"), is_test, amount, present=with_award,
        ),
        Population(
            "M-S01", awarded, {"DQ-14": no_complete & has_bare}, no_complete & ~has_bare, value=amount,
        ),
        Population(
            "P4-BvA", awarded,
            {"C-06": F.col("budget_line_count") > 1, "DQ-06": single & extreme, "DQ-16": single & zero},
            (F.col("budget_line_count") == 0) | (single & unusable & ~extreme & ~zero), value=amount,
        ),
        Population(
            "M-E01", process,
            _date_issues("tender_start_date_flag", "tender_end_date_flag", "tender_start_date", "tender_end_date"),
            missing("tender_start_date_flag", "tender_end_date_flag"), is_test, present=with_tender,
        ),
        Population(
            "M-E02", process,
            _date_issues("tender_start_date_flag", "award_date_flag", "tender_start_date", "award_date"),
            missing("tender_start_date_flag", "award_date_flag"), is_test, present=with_tender & with_award,
        ),
        Population(
            "P5-SIG", process,
            _date_issues("award_date_flag", "date_signed_flag", "award_date", "date_signed"),
            missing("award_date_flag", "date_signed_flag"), is_test, present=F.col("has_contract").isNotNull(),
        ),
        Population("ENTITY", core.dim_buyer, {"DQ-19": F.col("buyer_id_flag").isNotNull()}, pre_exclude=is_test),
    ]


def eligible_side(v) -> DataFrame:
    """Eligible counts and values read from the views: the independent side."""
    n = F.count(F.lit(1))
    award = F.sum("award_value_amount")

    def row(metric, df, count=n, value=None):
        total = F.max(F.lit(None)) if value is None else value
        return df.agg(
            count.alias("eligible_records"), total.cast("decimal(38,4)").alias("eligible_value")
        ).select(F.lit(metric).alias("metric_id"), "eligible_records", "eligible_value")

    parts = [
        row("M-P01", v.budget_eligible, value=F.sum("budget_amount")),
        row("M-C01 / M-C02", v.competition_eligible, F.count_if("in_primary_population")),
        row("M-V01", v.award_value_eligible, value=award),
        row("M-S01", v.supplier_award_eligible, F.count_distinct("award_id"), award),
        row("P4-BvA", v.budget_award_comparison, value=award),
        row("M-E01", v.tender_duration_eligible),
        row("M-E02", v.award_lag_eligible),
        row("P5-SIG", v.signature_lag_eligible),
        row("ENTITY", v.entity_benchmark),
    ]
    return reduce(DataFrame.unionByName, parts)


def disclosures(v) -> DataFrame:
    """Issues that are kept but limit the reading of a metric."""
    core = v.core
    snap = core.process_snapshot.filter(F.col("buyer_id") != core.rules.test_buyer_id)
    variants = F.col("name_variant_count") > 1
    award = F.col("award_value_amount")
    n = F.count(F.lit(1))

    def row(metric, refs, df, hit, affected=None, value=None):
        nothing = F.max(F.lit(None)).cast("decimal(38,4)")
        one = df.agg(
            n.alias("candidate_records"),
            F.count_if(hit).alias("records_with_issue"),
            (nothing if affected is None else affected.cast("decimal(38,4)")).alias("affected_value"),
            (nothing if value is None else value.cast("decimal(38,4)")).alias("eligible_value"),
        )
        return one.select(
            F.lit(metric).alias("metric_id"),
            F.explode(F.array(*[F.lit(x) for x in refs])).alias("dq_ref"),
            F.lit("DISCLOSED").alias("impact_type"),
            "candidate_records",
            F.col("candidate_records").alias("eligible_records"),
            "records_with_issue",
            F.lit(None).cast("bigint").alias("records_lost_only_to_issue"),
            "affected_value",
            "eligible_value",
        )

    parts = [
        row("ALL", ["DQ-01"], snap, F.col("release_count") > 1),
        row("M-E03", ["DQ-02"], v.lifecycle_stage, F.col("highest_stage_rank") == 1),
        row("M-S01", ["DQ-13"], v.supplier_award_eligible, variants,
            F.sum(F.when(variants, award)), F.sum(award)),
        row("M-I01", ["DQ-11", "DQ-12"], v.contract_implementation_coverage, F.col("transaction_count") > 0),
    ]
    return reduce(DataFrame.unionByName, parts)


def dq_impact(v) -> DataFrame:
    ref = F.col("dq_ref")
    impact = (
        F.when(ref == "ALL", "SUMMARY_ALL").when(ref == "OTHER", "SUMMARY_OTHER")
        .when(ref == "PRE", "PRE_EXCLUDED").when(ref == "DQ-04", "EXCLUDES_FROM_PRIMARY").otherwise("EXCLUDES")
    )
    attributed = exclusion_attribution(populations(v)).join(eligible_side(v), "metric_id").select(
        "metric_id",
        F.when(ref == "PRE", "DQ-20").otherwise(ref).alias("dq_ref"),
        impact.alias("impact_type"),
        "candidate_records",
        "eligible_records",
        "records_with_issue",
        "records_lost_only_to_issue",
        F.col("affected_value").cast("decimal(38,4)").alias("affected_value"),
        "eligible_value",
    )
    spark = v.core.dim_buyer.sparkSession
    meta = spark.createDataFrame(METRIC_META, "metric_id string, metric_order int, metric_name string, grain string")
    issue = spark.createDataFrame(ISSUE_META, "dq_ref string, dq_issue string, treatment string, note string")
    pct = F.round(F.try_divide(F.col("records_with_issue") * 100.0, F.col("candidate_records")), 2)
    return (
        attributed.unionByName(disclosures(v))
        .join(F.broadcast(meta), "metric_id")  # fixed rows
        .join(F.broadcast(issue), "dq_ref", "left")  # fixed rows
        .select(
            "metric_order", "metric_id", "metric_name", "grain", "dq_ref",
            F.when(ref == "ALL", ALL_REASONS).otherwise(F.col("dq_issue")).alias("dq_issue"),
            "treatment", "impact_type", "candidate_records", "eligible_records", "records_with_issue",
            "records_lost_only_to_issue", pct.alias("pct_of_candidate"),
            F.col("affected_value").alias("affected_value_ngn"),
            F.col("eligible_value").alias("eligible_value_ngn"),
            "note",
        )
    )
