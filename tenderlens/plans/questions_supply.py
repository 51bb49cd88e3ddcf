"""Questions 1 and 2: supplier concentration and competition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenderlens.functions import bands
from tenderlens.functions.flags import small_n_note
from tenderlens.operators.concentration import concentration, hhi, holder_totals
from tenderlens.operators.order_stats import (
    exact_percentiles,
    ntile,
    percent_rank,
    top_rows,
    with_position,
)
from tenderlens.plans import register
from tenderlens.plans.common import mark, money, pct, ratio, rows, sum_if
from tenderlens.plans.views import median, method, rate

AWARD = "award_value_amount"
DEPTHS = {"suppliers_to_reach_50_pct": "0.5", "suppliers_to_reach_80_pct": "0.8"}
# Scenario labels.
WITHOUT = "2  without DQ-21 flagged awards"


def _unit(v, name: str) -> str:
    return f"{name}_{v.rules.unit_label}"


def _entities(df: DataFrame) -> DataFrame:
    return df.filter(F.col("buyer_id_flag").isNull())


def scenarios(marked: DataFrame, published: str) -> DataFrame:
    """Each row once per scenario it belongs to: one scan, no second read."""
    both = F.array(F.lit(published), F.lit(WITHOUT))
    labels = F.when(F.col("is_flagged"), F.array(F.lit(published))).otherwise(both)
    return marked.withColumn("scenario", F.explode(labels))


# ------------------------------------------------------------------ question 1
def population_disclosure(v, awards=None, suppliers=None) -> DataFrame:
    awards = v.award_value_eligible if awards is None else awards
    suppliers = v.supplier_award_eligible if suppliers is None else suppliers
    cand = awards.agg(rows().alias("n"), F.sum(AWARD).alias("value"))
    # One distinct count per aggregate: two would expand every row.
    holders = suppliers.select("supplier_id").distinct().agg(rows()).scalar()
    kept = suppliers.agg(F.count_distinct("award_id").alias("eligible_awards"), F.sum(AWARD).alias("value"))
    return disclosed(v, cand, kept, holders)


def disclosed(v, cand: DataFrame, kept: DataFrame, holders: Column) -> DataFrame:
    """Candidates (n, value) and eligible awards (eligible_awards, value), one row each, as the disclosure."""
    e = kept.withColumns(
        {"distinct_suppliers": holders, "cand_n": cand.select("n").scalar(), "cand_value": cand.select("value").scalar()}
    )
    left_out = F.col("cand_value") - F.col("value")
    return e.select(
        F.lit("M-S01").alias("metric"),
        F.col("cand_n").alias("candidate_awards"),
        "eligible_awards",
        pct(F.col("eligible_awards"), F.col("cand_n"), 1).alias("eligible_pct_of_candidate"),
        "distinct_suppliers",
        money(F.col("value"), v.rules, 1).alias(_unit(v, "eligible_value")),
        (F.col("cand_n") - F.col("eligible_awards")).alias("excluded_awards_bare_supplier_id"),
        money(left_out, v.rules, 1).alias(_unit(v, "excluded_value")),
        pct(left_out, F.col("cand_value"), 1).alias("excluded_pct_of_candidate_value"),
    )


def with_disclosure(d: DataFrame) -> DataFrame:
    """The sentence to show beside the figures."""
    text = F.concat(
        F.col("excluded_awards_bare_supplier_id").cast("string"), F.lit(" awards ("),
        F.col("excluded_pct_of_candidate_value").cast("decimal(10,1)").cast("string"),
        F.lit("% of value) have no usable supplier ID and are not included."))
    return d.withColumn("disclosure", text)


def overall_concentration(v) -> DataFrame:
    top = [1, 5, 10, 20, 100]
    c = concentration(v.supplier_totals, "supplier_id", top, DEPTHS)
    return c.select(
        F.col("holders").alias("suppliers"),
        F.col("awards").alias("awards_in_scope"),
        money(F.col("value"), v.rules, 1).alias(_unit(v, "value_in_scope")),
        *[pct(F.col(f"top_{n}"), F.col("value"), 2).alias(f"top_{n}_share_pct") for n in top],
        F.round("hhi", 1).alias("herfindahl_index_0_to_10000"),
        *DEPTHS,
        F.col("single_award_holders").alias("suppliers_with_one_award"),
    )


def top_suppliers(v, n: int = 20, source=None) -> DataFrame:
    """The n largest suppliers, every one tied with the n-th included. Totals carry
    ids and values only; names and entities are looked up for the few that remain."""
    totals = v.supplier_totals if source is None else holder_totals(source, "supplier_id", AWARD)
    return largest_suppliers(v, totals, v.supplier_award_eligible if source is None else source, n)


def largest_suppliers(v, totals: DataFrame, source: DataFrame, n: int) -> DataFrame:
    """``totals`` per supplier (awards, value); ``source`` tells names and entities."""
    cut = totals.orderBy(F.col("value").desc()).limit(n).agg(F.min("value")).scalar()
    total = totals.agg(F.sum("value")).scalar()
    w = Window.partitionBy("_all").orderBy(F.col("value").desc())
    upto = Window.partitionBy("_all").orderBy(F.col("value").desc(), "supplier_id").rowsBetween(Window.unboundedPreceding, 0)
    best = totals.filter(F.col("value") >= cut).withColumn("_all", F.lit(0)).select(
        "supplier_id", "awards", "value", F.rank().over(w).cast("bigint").alias("value_rank"),
        F.sum("value").over(upto).alias("cum"), total.alias("total"),
    )
    about = source.join(best.select("supplier_id"), "supplier_id", "left_semi").groupBy("supplier_id").agg(
        F.max("supplier_name").alias("supplier_name"),
        F.max("name_variant_count").alias("name_variant_count"),
        F.count_distinct("buyer_id").alias("procuring_entities"),
    )
    note = F.when(F.col("name_variant_count") > 1, "several name variants (DQ-13): share may be understated")
    return best.join(about, "supplier_id").select(
        "value_rank", "supplier_id", "supplier_name", "awards", "procuring_entities",
        money(F.col("value"), v.rules, 2).alias(_unit(v, "value")),
        pct(F.col("value"), F.col("total"), 2).alias("share_pct"),
        pct(F.col("cum"), F.col("total"), 2).alias("cumulative_share_pct"),
        note.otherwise("single name").alias("identity_note"),
    )


def concentration_by_method(v, n: int = 5, source=None) -> DataFrame:
    source = v.supplier_award_eligible if source is None else source
    g = ["procurement_method"]
    totals = holder_totals(source.withColumn(g[0], method()), "supplier_id", AWARD, g)
    return method_concentration(v, concentration(totals, "supplier_id", [1, n], groups=g), n)


def method_concentration(v, c: DataFrame, n: int) -> DataFrame:
    return c.select(
        "procurement_method",
        F.col("awards").alias("eligible_awards"),
        F.col("holders").alias("suppliers"),
        money(F.col("value"), v.rules, 2).alias(_unit(v, "value")),
        pct(F.col("top_1"), F.col("value"), 1).alias("top_1_share_pct"),
        pct(F.col(f"top_{n}"), F.col("value"), 1).alias(f"top_{n}_share_pct"),
        F.round("hhi", 0).alias("herfindahl_index"),
        small_n_note(F.col("awards"), v.rules.small_n).alias("reliability_note"),
    )


def _entity_concentration(v) -> DataFrame:
    src = _entities(v.supplier_award_eligible)
    names = src.groupBy("buyer_id").agg(F.max("buyer_name").alias("buyer_name"))
    c = concentration(holder_totals(src, "supplier_id", AWARD, ["buyer_id"]), "supplier_id", [1, 3], groups=["buyer_id"])
    return c.filter(F.col("awards") >= v.rules.min_awards).join(names, "buyer_id").withColumns(
        {"top_1_share": ratio(F.col("top_1"), F.col("value")), "top_3_share": ratio(F.col("top_3"), F.col("value"))}
    )


def concentration_by_entity(v, n: int = 15) -> DataFrame:
    e = with_position(
        _entity_concentration(v), [("top_1_share", "desc"), ("value", "desc")], "concentration_rank",
        count_as="entities_in_comparison",
    )
    e = with_position(e, [("top_1_share", "asc")], "_asc").filter(F.col("concentration_rank") <= n)
    place = percent_rank(F.col("_asc"), F.col("entities_in_comparison"))
    return e.select(
        "concentration_rank", "buyer_id", "buyer_name",
        F.col("awards").alias("eligible_awards"),
        F.col("holders").alias("suppliers"),
        money(F.col("value"), v.rules, 2).alias(_unit(v, "value")),
        F.round(F.col("top_1_share") * 100, 1).alias("top_1_supplier_share_pct"),
        F.round(F.col("top_3_share") * 100, 1).alias("top_3_suppliers_share_pct"),
        F.round("hhi", 0).alias("herfindahl_index"),
        F.round(place * 100, 0).alias("percentile_among_entities"),
        "entities_in_comparison",
    )


def entity_concentration_spread(v) -> DataFrame:
    totals = holder_totals(_entities(v.supplier_award_eligible), "supplier_id", AWARD, ["buyer_id"])
    share = totals.groupBy("buyer_id").agg(
        F.sum("awards").alias("awards"), ratio(F.max("value"), F.sum("value")).alias("share")
    ).filter(F.col("awards") >= v.rules.min_awards)
    names = {"p25_top_1_share_pct": 0.25, "median_top_1_share_pct": 0.5, "p75_top_1_share_pct": 0.75}
    q = exact_percentiles(share, "share", names)
    n = share.agg(rows().alias("n"), F.count_if(F.col("share") >= 0.5).alias("half"))
    return q.select(
        n.select("n").scalar().alias("entities_in_comparison"),
        F.lit(v.rules.min_awards).alias("min_awards_threshold"),
        *[F.round(F.col(name) * 100, 1).alias(name) for name in names],
        n.select("half").scalar().alias("entities_where_one_supplier_holds_half"),
    )


def _marked_suppliers(v) -> DataFrame:
    return mark(v.supplier_award_eligible, v.award_scale_flag, "award_id", "is_flagged")


def concentration_sensitivity(v) -> DataFrame:
    marked = _marked_suppliers(v)
    g = ["scenario"]
    totals = scenarios(marked, "1  as published (RS2)").groupBy(*g, "supplier_id").agg(
        F.max("supplier_name").alias("supplier_name"), rows().alias("awards"), F.sum(AWARD).alias("value")
    )
    top = [1, 5, 10, 100]
    c = concentration(totals, "supplier_id", top, groups=g)
    lead = top_rows(totals, [("value", "desc"), ("supplier_id", "asc")], 1, g).select(
        *g, F.col("supplier_name").alias("largest_supplier")
    )
    flagged = marked.filter("is_flagged").agg(rows()).scalar()
    return c.join(lead, g).select(
        "scenario",
        F.col("awards").alias("awards_in_scope"),
        flagged.alias("flagged_awards_in_m_s01"),
        money(F.col("value"), v.rules, 1).alias(_unit(v, "value_in_scope")),
        *[pct(F.col(f"top_{n}"), F.col("value"), 2).alias(f"top_{n}_share_pct") for n in top],
        F.round("hhi", 1).alias("herfindahl_index_0_to_10000"),
        "largest_supplier",
        money(F.col("top_1"), v.rules, 2).alias(_unit(v, "largest_supplier_value")),
    )


def method_sensitivity(v) -> DataFrame:
    flagged = F.col("is_flagged")
    per = _marked_suppliers(v).groupBy(method().alias("procurement_method"), "supplier_id").agg(
        F.sum(AWARD).alias("pub"), sum_if(~flagged, F.col(AWARD)).alias("wo"), F.count_if(flagged).alias("flagged_awards")
    )
    out = per.groupBy("procurement_method").agg(
        F.sum("flagged_awards").alias("flagged_awards"),
        *[F.sum(c).alias(f"sum_{c}") for c in ("pub", "wo")],
        *[F.max(c).alias(f"max_{c}") for c in ("pub", "wo")],
        *[hhi(F.col(c)).alias(f"hhi_{c}") for c in ("pub", "wo")],
    )
    return out.select(
        "procurement_method", "flagged_awards",
        money(F.col("sum_pub"), v.rules, 2).alias(_unit(v, "value_published")),
        money(F.coalesce("sum_wo", F.lit(0)), v.rules, 2).alias(_unit(v, "value_without_flagged")),
        pct(F.col("max_pub"), F.col("sum_pub"), 1).alias("top_1_share_pct_published"),
        pct(F.col("max_wo"), F.col("sum_wo"), 1).alias("top_1_share_pct_without_flagged"),
        F.round("hhi_pub", 0).alias("herfindahl_published"),
        F.round(F.coalesce("hhi_wo", F.lit(0.0)), 0).alias("herfindahl_without_flagged"),
    )


# ------------------------------------------------------------------ question 2
N = "number_of_tenderers"


def _primary(df: DataFrame) -> DataFrame:
    return df.filter("in_primary_population")


def competition_headline(v) -> DataFrame:
    """Both populations from one scan: a primary tender counts once in each."""
    both = F.array(F.lit(f"primary (NORMAL, 1-{v.rules.normal_max})"), F.lit("sensitivity (NORMAL + ELEVATED)"))
    labels = F.when(F.col("in_primary_population"), both).otherwise(F.slice(both, 2, 1))
    return v.competition_eligible.withColumn("population", F.explode(labels)).groupBy("population").agg(
        rows().alias("eligible_tenders"),
        median(F.col(N)).alias("median_tenderers_m_c01"),
        F.round(rate(F.col("is_single_bidder")) * 100, 2).alias("single_bidder_rate_pct_m_c02"),
        F.round(F.avg(N), 2).alias("mean_tenderers"),
        F.max(N).alias("max_tenderers"),
    )


def participation_bands(v) -> DataFrame:
    primary = F.col("in_primary_population")
    banded = v.competition_eligible.groupBy(bands.participation_band(F.col(N)).alias("participation_band")).agg(
        F.count_if(primary).alias("primary_tenders"), F.count_if(~primary).alias("sensitivity_only_tenders")
    )
    # At most eight rows from here on.
    return cumulative_bands(banded, "participation_band", "primary_tenders").select(
        "participation_band", "primary_tenders",
        pct(F.col("primary_tenders"), F.col("_total"), 2).alias("pct_of_primary"),
        pct(F.col("_upto"), F.col("_total"), 2).alias("cumulative_pct_of_primary"),
        "sensitivity_only_tenders",
    )


def cumulative_bands(banded: DataFrame, band: str, n: str, groups: tuple = ()) -> DataFrame:
    """Running and total count over a fixed, small set of bands."""
    part = list(groups) or [F.lit(0)]
    w = Window.partitionBy(*part)
    upto = w.orderBy(band).rowsBetween(Window.unboundedPreceding, 0)
    return banded.withColumns({"_upto": F.sum(n).over(upto), "_total": F.sum(n).over(w)})


def tenderer_percentiles(v) -> DataFrame:
    probs = {"p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9, "p99": 0.99}
    q = F.percentile(N, F.array(*[F.lit(p) for p in probs.values()]))
    return _primary(v.competition_eligible).agg(
        rows().alias("eligible_tenders"), F.min(N).alias("min_tenderers"), q.alias("q"), F.max(N).alias("max_tenderers")
    ).select(
        "eligible_tenders", "min_tenderers", *[F.round(F.col("q")[i], 6).alias(p) for i, p in enumerate(probs)], "max_tenderers"
    )


def competition_by_method(v) -> DataFrame:
    src = _primary(v.competition_eligible)
    single = F.col("is_single_bidder")
    overall = src.agg(rate(single)).scalar()
    return src.groupBy(method().alias("procurement_method")).agg(
        rows().alias("eligible_tenders"),
        median(F.col(N)).alias("median_tenderers"),
        rate(single).alias("_single"),
        rate(F.col(N) >= 6).alias("_six"),
    ).select(
        "procurement_method", "eligible_tenders", "median_tenderers",
        F.round(F.col("_single") * 100, 1).alias("single_bidder_rate_pct"),
        F.round(F.col("_six") * 100, 1).alias("six_plus_tenderers_pct"),
        F.round(F.col("_single") * 100 - overall * 100, 1).alias("single_bidder_gap_vs_overall_pts"),
        small_n_note(F.col("eligible_tenders"), v.rules.small_n).alias("reliability_note"),
    )


def competition_by_status(v) -> DataFrame:
    primary = F.col("in_primary_population")
    return v.competition_eligible.groupBy("tender_status").agg(
        F.count_if(primary).alias("primary_tenders"),
        median(F.col(N), primary).alias("median_tenderers"),
        F.round(rate(F.col("is_single_bidder"), primary) * 100, 1).alias("single_bidder_rate_pct"),
    ).withColumn("reliability_note", small_n_note(F.col("primary_tenders"), v.rules.small_n))


def competition_extremes(v, n: int = 10) -> DataFrame:
    entity = _entities(_primary(v.competition_eligible)).groupBy("buyer_id").agg(
        F.max("buyer_name").alias("buyer_name"),
        rows().alias("eligible_tenders"),
        median(F.col(N)).alias("median_tenderers"),
        rate(F.col("is_single_bidder")).alias("single"),
    ).filter(F.col("eligible_tenders") >= v.rules.min_tenders)
    e = with_position(entity, [("single", "desc"), ("eligible_tenders", "desc")], "highest", count_as="n")
    e = with_position(e, [("single", "asc"), ("eligible_tenders", "desc")], "lowest")
    e = with_position(e, [("single", "asc"), ("buyer_id", "asc")], "_row", kind="row_number")
    side = F.array(
        F.struct(F.lit("highest single-bidder rate").alias("ranking"), F.col("highest").alias("rank_in_group")),
        F.struct(F.lit("lowest single-bidder rate").alias("ranking"), F.col("lowest").alias("rank_in_group")),
    )
    return e.withColumn("s", F.explode(side)).filter(F.col("s.rank_in_group") <= n).select(
        "s.ranking", "s.rank_in_group", "buyer_id", "buyer_name", "eligible_tenders", "median_tenderers",
        F.round(F.col("single") * 100, 1).alias("single_bidder_rate_pct"),
        ntile(F.col("_row"), F.col("n"), 4).alias("single_bidder_quartile"),
        F.col("n").alias("entities_in_comparison"),
    )


RESULT_SETS = {
    "q1_1_population_disclosure": population_disclosure,
    "q1_1b_register": lambda v: register.entries(v, "M-S01"),
    "q1_2_overall_concentration": overall_concentration,
    "q1_3_top_suppliers": top_suppliers,
    "q1_4_concentration_by_method": concentration_by_method,
    "q1_5_concentration_by_entity": concentration_by_entity,
    "q1_5b_entity_concentration_spread": entity_concentration_spread,
    "q1_6_concentration_sensitivity": concentration_sensitivity,
    "q1_6b_method_sensitivity": method_sensitivity,
    "q2_1_competition_headline": competition_headline,
    "q2_1b_register": lambda v: register.entries(v, "M-C01 / M-C02", "M-C01 (sensitivity)"),
    "q2_2_participation_bands": participation_bands,
    "q2_3_tenderer_percentiles": tenderer_percentiles,
    "q2_4_competition_by_method": competition_by_method,
    "q2_5_competition_by_status": competition_by_status,
    "q2_6_competition_extremes": competition_extremes,
}
