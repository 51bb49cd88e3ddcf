"""Eligibility views: one public operator per metric population.

Each takes the ``Core`` tables and returns a lazy DataFrame. Joins to the two
dimensions carry no hint: Catalyst and AQE broadcast them while they are under
the size threshold and fall back to a (skew-split) shuffle join beyond it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderlens.functions import bands, flags
from tenderlens.model import Core
from tenderlens.operators.order_stats import exact_percentiles, top_rows
from tenderlens.plans.core import without_test
from tenderlens.rules import METHOD_NOT_STATED

_WHO = ["buyer_id", "buyer_name", "buyer_id_flag"]


def exclude_test(df: DataFrame, core: Core) -> DataFrame:
    """Attach the buyer's name and flag; drop the test entity before any population."""
    return without_test(df, core.dim_buyer, core.rules)


def _has(section: str):
    return F.col(section).isNotNull()


def budget_eligible(core: Core) -> DataFrame:
    lines = core.budget_lines.filter(
        (F.col("budget_amount") >= 0)
        & F.col("budget_amount_flag").isNull()
        & F.col("budget_monetary_flag").isNull()
        & F.col("party_flag").isNull()
    )
    flagged = core.process_snapshot.select("ocid", "multi_project_flag")
    return (
        exclude_test(lines, core)
        .filter(F.col("buyer_id_flag").isNull())
        .join(flagged, "ocid")
        .select(
            "ocid", "budget_project_id", "release_id", "buyer_id", "buyer_name", "budget_amount",
            "budget_currency", "budget_description", "budget_project", "multi_project_flag",
        )
    )


def _competing():
    return _has("tender_id") & F.col("tender_status").isNotNull() & F.col("tenderer_count_flag").isin("NORMAL", "ELEVATED")


def _valued():
    return (
        _has("award_id") & (F.col("award_status") == "active")
        & F.col("award_value_flag").isNull() & F.col("award_monetary_flag").isNull()
    )


def competition_eligible(core: Core) -> DataFrame:
    return core.process_sections.filter(_competing()).select(
        "ocid", "tender_release_id", "tender_id", *_WHO, "procurement_method_details", "tender_status",
        "number_of_tenderers", "tenderer_count_flag",
        (F.col("tenderer_count_flag") == "NORMAL").alias("in_primary_population"),
        (F.col("number_of_tenderers") == 1).alias("is_single_bidder"),
    )


def award_value_eligible(core: Core) -> DataFrame:
    return core.process_sections.filter(_valued()).select(
        "ocid", "award_id", "award_release_id", *_WHO, "procurement_method_details", "award_value_amount",
        "award_value_currency", "award_date", "award_date_flag",
    )


def distinct_award_suppliers(core: Core) -> DataFrame:
    """Repeated supplier entries collapsed, with the number of distinct
    suppliers. Both steps hash on the award, after a map-side reduce."""
    pairs = core.stg.award_suppliers.select("award_id", "supplier_id").distinct()
    per_award = pairs.groupBy("award_id").agg(F.count(F.lit(1)).alias("distinct_supplier_count"))
    return pairs.join(per_award, "award_id")


def supplier_award_eligible(core: Core, awards: DataFrame | None = None) -> DataFrame:
    awards = awards if awards is not None else award_value_eligible(core)
    suppliers = core.dim_supplier.filter(F.col("supplier_id_flag").isNull()).select(
        "supplier_id", "supplier_name", "name_variant_count"
    )
    return (
        awards.join(distinct_award_suppliers(core), "award_id")
        .join(suppliers, "supplier_id")
        .select(
            "ocid", "award_id", *_WHO, "procurement_method_details", "supplier_id", "supplier_name",
            "name_variant_count", "distinct_supplier_count", "award_value_amount",
        )
    )


def budget_award_comparison(core: Core, awards: DataFrame | None = None) -> DataFrame:
    awards = awards if awards is not None else award_value_eligible(core)
    single = core.process_snapshot.filter("budget_line_count = 1").select("ocid")
    budgets = core.budget_lines.filter(
        (F.col("budget_amount") > 0)
        & F.col("budget_amount_flag").isNull()
        & F.col("budget_monetary_flag").isNull()
    ).select("ocid", "budget_project_id", "budget_amount")
    ratio = F.col("award_value_amount").cast("double") / F.col("budget_amount").cast("double")
    return awards.join(single, "ocid", "left_semi").join(budgets, "ocid").select(
        "ocid", "award_id", *_WHO, "procurement_method_details", "budget_project_id", "budget_amount",
        "award_value_amount",
        (F.col("award_value_amount") - F.col("budget_amount")).cast("decimal(30,4)").alias("variance_amount"),
        F.round(ratio, 4).alias("award_to_budget_ratio"),
    )


def tender_duration_eligible(core: Core) -> DataFrame:
    return core.process_sections.filter(
        (F.col("tender_start_date_flag") == "VALID")
        & (F.col("tender_end_date_flag") == "VALID")
        & (F.col("tender_end_date") >= F.col("tender_start_date"))
    ).select(
        "ocid", "tender_release_id", *_WHO, "procurement_method_details", "tender_start_date",
        "tender_end_date", F.datediff("tender_end_date", "tender_start_date").alias("tender_duration_days"),
    )


def award_lag_eligible(core: Core) -> DataFrame:
    return core.process_sections.filter(
        _has("tender_release_id") & _has("award_id")
        & (F.col("tender_start_date_flag") == "VALID")
        & (F.col("award_date_flag") == "VALID")
        & (F.col("award_date") >= F.col("tender_start_date"))
        & (F.col("awards_in_release") == 1)
    ).select(
        "ocid", "award_id", *_WHO, "procurement_method_details", "award_status", "tender_start_date",
        "award_date", F.datediff("award_date", "tender_start_date").alias("award_lag_days"),
    )


def signature_lag_eligible(core: Core) -> DataFrame:
    return core.process_sections.filter(
        _has("contract_id")
        & (F.col("award_date_flag") == "VALID")
        & (F.col("date_signed_flag") == "VALID")
        & (F.col("date_signed") >= F.col("award_date"))
    ).select(
        "ocid", "contract_id", *_WHO, "award_date", "date_signed",
        F.datediff("date_signed", "award_date").alias("signature_lag_days"),
    )


def lifecycle_stage(core: Core) -> DataFrame:
    rank = bands.stage_rank(F.col("tags_observed"))
    return core.process_sections.select(
        "ocid", *_WHO, "release_count", "tags_observed", rank.alias("highest_stage_rank"),
        bands.stage_name(rank).alias("highest_stage"),
    )


def contract_implementation_coverage(core: Core) -> DataFrame:
    return core.process_sections.filter(_has("contract_id")).select(
        "ocid", "contract_id", "contract_release_id", *_WHO, "contract_status", "has_implementation",
        "transaction_count", "implementation_milestone_count",
    )


def rate(condition, where=None):
    """Mean of a 0/1 condition as a double, optionally over some rows only."""
    x = condition.cast("int")
    return F.avg(x if where is None else F.when(where, x))


def median(c, where=None):
    """Exact median by the built-in aggregate: for columns with a bounded domain
    (day counts, tenderer counts) or at entity grain."""
    return F.percentile(c if where is None else F.when(where, c), 0.5)


def entity_benchmark(core: Core, v) -> DataFrame:
    """One row per complete, non-test buyer; NULL means no eligible record.

    What comes from a process's own sections is one aggregate over the stored
    sections, each measure under the condition of its population; budget lines,
    suppliers and the exact median are reduced to the buyer apart.
    """
    def complete(df):
        return df.filter(F.col("buyer_id_flag").isNull())

    def known(n, of):
        return F.when(of > 0, n)

    stage = bands.stage_rank(F.col("tags_observed"))
    tendered, awarded, contracted = (F.coalesce(c, F.lit(False)) for c in (_competing(), _valued(), _has("contract_id")))
    primary = tendered & (F.col("tenderer_count_flag") == "NORMAL")
    amount, one = F.when(awarded, F.col("award_value_amount")), F.lit(1)
    proc = complete(core.process_sections).groupBy("buyer_id").agg(
        F.count(one).alias("process_count"),
        F.count_if(stage >= 2).alias("processes_reaching_tender"),
        F.count_if(stage >= 3).alias("processes_reaching_award"),
        known(F.count_if(primary), F.count_if(tendered)).alias("competition_n"),
        median(F.col("number_of_tenderers"), primary).alias("median_tenderers"),
        F.round(rate(F.col("number_of_tenderers") == 1, primary), 4).alias("single_bidder_rate"),
        known(F.count_if(awarded), F.count_if(awarded)).alias("award_n"), F.sum(amount).alias("award_value_total"),
        known(F.count_if(contracted), F.count_if(contracted)).alias("contract_n"),
        F.round(rate(F.col("has_implementation"), contracted), 4).alias("implementation_coverage_rate"),
    )
    budget = v.budget_eligible.groupBy("buyer_id").agg(
        F.count(one).alias("budget_line_n"), F.sum("budget_amount").alias("planned_budget_total")
    )
    awards = complete(v.award_value_eligible)
    award_median = exact_percentiles(awards, "award_value_amount", {"m": 0.5}, ["buyer_id"]).select(
        "buyer_id", F.round("m", 2).alias("median_award_value")
    )
    by_supplier = complete(v.supplier_award_eligible).groupBy("buyer_id", "supplier_id").agg(
        F.sum("award_value_amount").alias("value")
    )
    shares = by_supplier.groupBy("buyer_id").agg(
        F.count(F.lit(1)).alias("distinct_supplier_n"),
        F.round(F.try_divide(F.max("value").cast("double"), F.sum("value").cast("double")), 4).alias(
            "top_supplier_value_share"
        ),
    )
    names = core.dim_buyer.filter(
        F.col("buyer_id_flag").isNull() & F.col("test_entity_flag").isNull()
    ).select("buyer_id", "buyer_name")
    parts = [budget, award_median, shares]
    wide = reduce(lambda a, b: a.join(b, "buyer_id", "left"), parts, names.join(proc, "buyer_id"))
    return wide.select(
        "buyer_id", "buyer_name", "process_count", "processes_reaching_tender",
        F.round(F.col("processes_reaching_tender") / F.col("process_count"), 4).alias("tender_reach_rate"),
        "processes_reaching_award", "budget_line_n", "planned_budget_total", "competition_n",
        "median_tenderers", "single_bidder_rate", "award_n", "award_value_total", "median_award_value",
        "distinct_supplier_n", "top_supplier_value_share", "contract_n", "implementation_coverage_rate",
    )


def dim_buyer_view(core: Core) -> DataFrame:
    code = flags.buyer_code(F.col("buyer_id"), core.rules)
    return core.dim_buyer.filter(
        F.col("buyer_id_flag").isNull() & F.col("test_entity_flag").isNull()
    ).select(
        "buyer_id", "buyer_name", code.alias("buyer_code"),
        F.concat("buyer_name", F.lit(" ("), code, F.lit(")")).alias("buyer_label"),
    )


def method(c="procurement_method_details"):
    return F.coalesce(F.col(c), F.lit(METHOD_NOT_STATED))


METHOD_VIEWS = [
    "competition_eligible", "award_value_eligible", "supplier_award_eligible",
    "budget_award_comparison", "tender_duration_eligible", "award_lag_eligible",
]


def dim_procurement_method(v) -> DataFrame:
    """Distinct per view first (a handful of rows each), then across views."""
    each = [getattr(v, n).select(method().alias("procurement_method")).distinct() for n in METHOD_VIEWS]
    return reduce(DataFrame.unionByName, each).distinct().select(
        "procurement_method", (F.col("procurement_method") == METHOD_NOT_STATED).alias("is_not_stated")
    )


def award_scale_flag(core: Core, v) -> DataFrame:
    """Awards inconsistent with their own process record. The largest *other*
    award of the same supplier and buyer needs only the two largest awards of
    each (supplier, buyer): a grouped top-2, pruned on the map side, instead
    of a self-join that is quadratic in the group."""
    r = core.rules
    award = F.col("award_value_amount")
    pair = ["supplier_id", "buyer_id"]
    lots = v.supplier_award_eligible.filter(F.col("buyer_id_flag").isNull()).select(
        "award_id", *pair, "award_value_amount"
    )
    two = top_rows(lots, [("award_value_amount", "desc"), ("award_id", "asc")], 2, pair)
    ends = two.groupBy(*pair).agg(
        *[
            F.max(F.when(F.col("position") == i, F.struct("award_id", "award_value_amount"))).alias(f"p{i}")
            for i in (1, 2)
        ]
    ).filter(F.col("p2").isNotNull())
    other = F.when(F.col("award_id") == F.col("p1.award_id"), F.col("p2")).otherwise(F.col("p1"))
    siblings = lots.join(ends, pair).select(
        "award_id", "supplier_id", other["award_id"].alias("sibling_award_id"),
        other["award_value_amount"].alias("sibling_award_value"),
    )
    largest = [("sibling_award_value", "desc"), ("sibling_award_id", "asc")]
    siblings = top_rows(siblings, largest, 1, ["award_id"]).drop("position")
    bva = v.budget_award_comparison.select("award_id", "budget_project_id", "budget_amount")
    ratio = award.cast("double") / F.col("budget_amount").cast("double")
    whole = award == F.floor(award)
    in_band = (award >= F.col("budget_amount") * r.ratio_low) & (award <= F.col("budget_amount") * r.ratio_high)
    false = F.lit(False)
    tested = (
        v.award_value_eligible.select(
            "ocid", "award_id", "buyer_id", "buyer_name", "procurement_method_details", "award_value_amount"
        )
        .join(bva, "award_id", "left")
        .join(siblings, "award_id", "left")
        .withColumns(
            {
                "dropped_decimal_test": F.coalesce(whole & in_band, false),
                "sibling_lot_test": F.coalesce(award >= F.col("sibling_award_value") * r.sibling_factor, false),
                "award_to_budget_ratio": F.round(ratio, 4),
                "ratio_to_sibling": F.round(
                    F.try_divide(award.cast("double"), F.col("sibling_award_value").cast("double")), 1
                ),
            }
        )
    )
    dropped, lot = F.col("dropped_decimal_test"), F.col("sibling_lot_test")
    reason = F.concat_ws("+", F.when(dropped, "DROPPED_DECIMAL"), F.when(lot, "SIBLING_LOT"))
    return tested.filter(dropped | lot).select(
        "ocid", "award_id", "buyer_id", "buyer_name", "procurement_method_details", "supplier_id",
        "award_value_amount", F.lit("POSSIBLE_SCALE_ERROR").alias("scale_flag"), reason.alias("flag_reason"),
        "dropped_decimal_test", "sibling_lot_test", "budget_project_id", "budget_amount",
        "award_to_budget_ratio", "sibling_award_id", "sibling_award_value", "ratio_to_sibling",
    )
