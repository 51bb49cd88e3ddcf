"""The business-question result sets."""

from __future__ import annotations

from oracle.prelude import with_tables
from oracle.views import REG_META

NS = "'(method not stated)'"
SMALL = "'small n: read with caution'"


def k(x: str, places: int) -> str:
    return f"round(({x})::DOUBLE / 1000, {places})"


def pct(a: str, b: str, places: int) -> str:
    return f"round(100 * ({a})::DOUBLE / nullif(({b})::DOUBLE, 0), {places})"


def entries(*ids: str, name: bool = False) -> str:
    listed = ", ".join(f"'{i}'" for i in ids)
    extra = "m.metric_name, " if name else ""
    return f"""SELECT m.metric_id, {extra}m.candidate_population, cand AS candidate_count, elig AS eligible_count,
      round(100.0 * elig / cand::DOUBLE, 1) AS eligible_pct FROM reg JOIN {REG_META} USING (metric_id) WHERE m.metric_id IN ({listed})"""


def ranked_totals(src: str, grp: str | None, holder: str = "supplier_id") -> str:
    """(grp, holder, n, v, rn, tot, cum) per holder."""
    g = f"{grp} AS g" if grp else "1 AS g"
    return f"""(SELECT *, row_number() OVER (PARTITION BY g ORDER BY v DESC, {holder}) AS rn,
        rank() OVER (PARTITION BY g ORDER BY v DESC) AS rk, sum(v) OVER (PARTITION BY g) AS tot,
        sum(v) OVER (PARTITION BY g ORDER BY v DESC, {holder}) AS cum
      FROM (SELECT {g}, {holder}, count(*) AS n, sum(value) AS v FROM {src} GROUP BY 1, 2))"""


HHI = "sum((v::DOUBLE / tot::DOUBLE) ** 2) * 10000"
FLAGGED = "(award_id IN (SELECT award_id FROM asf))"
SCEN = "(SELECT '1  as published ({p})' AS scenario, * FROM {t} UNION ALL SELECT '2  without DQ-21 flagged awards', * FROM {t} WHERE award_id NOT IN (SELECT award_id FROM asf))"
RB = """CASE WHEN ratio < 0.5 THEN '1  award below half of budget (<0.5)' WHEN ratio < 0.9 THEN '2  award 50-90% of budget'
 WHEN ratio <= 1.1 THEN '3  award within 10% of budget (0.9-1.1)' WHEN ratio <= 1.5 THEN '4  award 110-150% of budget'
 WHEN ratio <= 10 THEN '5  award 1.5x-10x budget' ELSE '6  award above 10x budget (check units / budget entry)' END"""
PB = """CASE WHEN number_of_tenderers <= 1 THEN '1  single bidder' WHEN number_of_tenderers <= 2 THEN '2  two tenderers'
 WHEN number_of_tenderers <= 5 THEN '3  3-5 tenderers' WHEN number_of_tenderers <= 10 THEN '4  6-10 tenderers'
 WHEN number_of_tenderers <= 20 THEN '5  11-20 tenderers' ELSE 'beyond' END"""
DB = """CASE WHEN days <= 7 THEN '1  up to 7 days' WHEN days <= 30 THEN '2  8-30 days' WHEN days <= 90 THEN '3  31-90 days'
 WHEN days <= 180 THEN '4  91-180 days' WHEN days <= 365 THEN '5  181-365 days' ELSE '6  over 1 year' END"""
IV = """(SELECT 'M-E01 tender open duration' AS measure, days FROM tde UNION ALL SELECT 'M-E02 award lag', days FROM ale
 UNION ALL SELECT 'P5-SIG signature lag', days FROM sle)"""


def q(x: str, p: float) -> str:
    return f"quantile_cont(({x})::DOUBLE, {p})"


def entity_totals(extra: str = "") -> str:
    return f"""(SELECT buyer_id, max(buyer_name) AS buyer_name, count(*) AS n, sum(budget) AS budget, sum(value) AS award, sum(variance) AS variance,
      {q('ratio', 0.5)} AS med, avg((ratio BETWEEN 0.9 AND 1.1)::INT) AS aligned, count(*) OVER () AS ents
      FROM bva WHERE buyer_id <> 'B-' GROUP BY buyer_id HAVING count(*) >= 10)"""


def band_entity(where: str) -> str:
    return f"""SELECT rank() OVER (ORDER BY award DESC) AS rank_in_band, buyer_id, buyer_name, n AS ocids_above_10x, {k('award', 1)} AS award_k,
      {pct('award', 'tot', 1)} AS pct_of_band_value, round(med::DECIMAL(38,8), 1)::DOUBLE AS median_ratio, alln::BIGINT AS band_ocids, {k('tot', 1)} AS band_award_k
      FROM (SELECT buyer_id, max(buyer_name) AS buyer_name, count(*) AS n, sum(value) AS award, {q('ratio', 0.5)} AS med,
              sum(sum(value)) OVER () AS tot, sum(count(*)) OVER () AS alln FROM bva WHERE ratio > 10 AND {where} GROUP BY buyer_id)
      QUALIFY row_number() OVER (ORDER BY award DESC, buyer_id) <= 5"""


def by_year(table: str, day: str, name: str) -> str:
    return f"""SELECT y.{name}, y.n AS eligible_n, y.med AS median_days, y.med - p.med AS change_vs_previous_year_days,
      CASE WHEN y.n < 30 THEN {SMALL} ELSE '' END AS reliability_note
      FROM (SELECT year({day}) AS {name}, count(*) AS n, {q('days', 0.5)} AS med FROM {table} GROUP BY 1) y
      LEFT JOIN (SELECT year({day}) AS {name}, {q('days', 0.5)} AS med FROM {table} GROUP BY 1) p ON p.{name} = y.{name} - 1"""


EBF = """(SELECT *, coalesce(award_value_total, 0) AS av, coalesce(planned_budget_total, 0) AS pb, coalesce(award_n, 0) AS an FROM eb)"""
GRID = "(SELECT unnest([1, 5, 10, 20, 50, 100]) AS g)"


def ebgrid(col: str) -> str:
    return f"(SELECT sum(x) FROM (SELECT {col} AS x FROM {EBF} ORDER BY {col} DESC, buyer_id LIMIT g))"


KPI = {
    "reach": "CASE WHEN process_count >= 30 THEN tender_reach_rate END",
    "tenderers": "CASE WHEN competition_n >= 30 THEN median_tenderers END",
    "single_bidder": "CASE WHEN competition_n >= 30 THEN single_bidder_rate END",
    "top_supplier": "CASE WHEN award_n >= 10 THEN top_supplier_value_share END",
    "implementation": "CASE WHEN contract_n >= 20 THEN implementation_coverage_rate END",
}
KB = "(SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in KPI.items()) + f" FROM {EBF})"


def pctile(c: str) -> str:
    return f"CASE WHEN {c} IS NOT NULL THEN round(100 * percent_rank() OVER (PARTITION BY {c} IS NULL ORDER BY {c}), 0) END"


SPREAD_LABELS = {
    "reach": "tender reach rate",
    "tenderers": "median tenderers",
    "single_bidder": "single-bidder rate",
    "top_supplier": "top-supplier value share",
    "implementation": "implementation coverage rate",
}
ENTSC = f"""(SELECT buyer_id, max(buyer_name) AS buyer_name, sum(value) AS pub, coalesce(sum(value) FILTER (NOT {FLAGGED}), 0) AS wo,
  count(*) FILTER {FLAGGED} AS flagged FROM awv WHERE buyer_id <> 'B-' GROUP BY buyer_id)""".replace(
    f"FILTER {FLAGGED}", f"FILTER (WHERE {FLAGGED})"
)


def scgrid(col: str) -> str:
    return f"(SELECT sum(x) FROM (SELECT {col} AS x FROM {ENTSC} ORDER BY {col} DESC, buyer_id LIMIT g))"


COV = """(SELECT buyer_id, max(buyer_name) AS buyer_name, count(*) AS n, count(*) FILTER (has_implementation) AS w, avg(has_implementation::INT) AS rate
  FROM cic WHERE buyer_id <> 'B-' GROUP BY buyer_id HAVING count(*) >= 20)"""

SQL = {
    "q1_1_population_disclosure": f"""SELECT 'M-S01' AS metric, cn AS candidate_awards, en AS eligible_awards, {pct('en', 'cn', 1)} AS eligible_pct_of_candidate,
      ds AS distinct_suppliers, {k('ev', 1)} AS eligible_value_k, cn - en AS excluded_awards_bare_supplier_id, {k('cv - ev', 1)} AS excluded_value_k,
      {pct('cv - ev', 'cv', 1)} AS excluded_pct_of_candidate_value
      FROM (SELECT count(*) AS cn, sum(value) AS cv FROM awv), (SELECT count(DISTINCT award_id) AS en, count(DISTINCT supplier_id) AS ds, sum(value) AS ev FROM sav)""",
    "q1_1b_register": entries("M-S01"),
    "q1_2_overall_concentration": f"""SELECT count(*) AS suppliers, sum(n)::BIGINT AS awards_in_scope, {k('sum(v)', 1)} AS value_in_scope_k,
      {", ".join(f"{pct(f'sum(v) FILTER (rn <= {n})', 'sum(v)', 2)} AS top_{n}_share_pct" for n in (1, 5, 10, 20, 100))},
      round({HHI}, 1) AS herfindahl_index_0_to_10000, min(rn) FILTER (cum::DOUBLE / tot::DOUBLE >= 0.5) AS suppliers_to_reach_50_pct,
      min(rn) FILTER (cum::DOUBLE / tot::DOUBLE >= 0.8) AS suppliers_to_reach_80_pct, count(*) FILTER (n = 1) AS suppliers_with_one_award
      FROM {ranked_totals('sav', None)}""",
    "q1_3_top_suppliers": f"""SELECT rk AS value_rank, t.supplier_id, u.supplier_name, n AS awards,
      (SELECT count(DISTINCT buyer_id) FROM sav s WHERE s.supplier_id = t.supplier_id) AS procuring_entities, {k('v', 2)} AS value_k,
      {pct('v', 'tot', 2)} AS share_pct, {pct('cum', 'tot', 2)} AS cumulative_share_pct,
      CASE WHEN u.name_variant_count > 1 THEN 'several name variants (DQ-13): share may be understated' ELSE 'single name' END AS identity_note
      FROM {ranked_totals('sav', None)} t JOIN sup u ON u.supplier_id = t.supplier_id WHERE rk <= 20""",
    "q1_4_concentration_by_method": f"""SELECT g AS procurement_method, sum(n)::BIGINT AS eligible_awards, count(*) AS suppliers, {k('sum(v)', 2)} AS value_k,
      {pct('sum(v) FILTER (rn <= 1)', 'sum(v)', 1)} AS top_1_share_pct, {pct('sum(v) FILTER (rn <= 5)', 'sum(v)', 1)} AS top_5_share_pct,
      round({HHI}, 0) AS herfindahl_index, CASE WHEN sum(n) < 30 THEN {SMALL} ELSE '' END AS reliability_note
      FROM {ranked_totals('sav', f'coalesce(method, {NS})')} GROUP BY g""",
    "q1_5_concentration_by_entity": f"""SELECT * FROM (SELECT rank() OVER (ORDER BY t1 DESC, val DESC) AS concentration_rank, buyer_id, buyer_name, n AS eligible_awards,
      c AS suppliers, {k('val', 2)} AS value_k, round(100 * t1, 1) AS top_1_supplier_share_pct, round(100 * t3, 1) AS top_3_suppliers_share_pct,
      round(h, 0) AS herfindahl_index, round(100 * percent_rank() OVER (ORDER BY t1), 0) AS percentile_among_entities, count(*) OVER () AS entities_in_comparison
      FROM (SELECT g AS buyer_id, (SELECT max(buyer_name) FROM sav s WHERE s.buyer_id = g) AS buyer_name, sum(n)::BIGINT AS n, count(*) AS c, sum(v) AS val,
              (sum(v) FILTER (rn <= 1))::DOUBLE / sum(v)::DOUBLE AS t1, (sum(v) FILTER (rn <= 3))::DOUBLE / sum(v)::DOUBLE AS t3, {HHI} AS h
            FROM {ranked_totals("(SELECT * FROM sav WHERE buyer_id <> 'B-')", 'buyer_id')} GROUP BY g HAVING sum(n) >= 10)) WHERE concentration_rank <= 15""",
    "q1_5b_entity_concentration_spread": f"""SELECT count(*) AS entities_in_comparison, 10::BIGINT AS min_awards_threshold, round(100 * {q('t1', 0.25)}, 1) AS p25_top_1_share_pct,
      round(100 * {q('t1', 0.5)}, 1) AS median_top_1_share_pct, round(100 * {q('t1', 0.75)}, 1) AS p75_top_1_share_pct,
      count(*) FILTER (t1 >= 0.5) AS entities_where_one_supplier_holds_half
      FROM (SELECT buyer_id, max(v)::DOUBLE / sum(v)::DOUBLE AS t1 FROM (SELECT buyer_id, supplier_id, count(*) AS n, sum(value) AS v FROM sav WHERE buyer_id <> 'B-' GROUP BY 1, 2)
            GROUP BY buyer_id HAVING sum(n) >= 10)""",
    "q1_6_concentration_sensitivity": f"""SELECT g AS scenario, sum(n)::BIGINT AS awards_in_scope, (SELECT count(*) FROM sav WHERE {FLAGGED}) AS flagged_awards_in_m_s01,
      {k('sum(v)', 1)} AS value_in_scope_k, {", ".join(f"{pct(f'sum(v) FILTER (rn <= {n})', 'sum(v)', 2)} AS top_{n}_share_pct" for n in (1, 5, 10, 100))},
      round({HHI}, 1) AS herfindahl_index_0_to_10000, (SELECT supplier_name FROM sup WHERE sup.supplier_id = any_value(t.supplier_id) FILTER (rn = 1)) AS largest_supplier,
      {k('max(v)', 2)} AS largest_supplier_value_k FROM {ranked_totals(SCEN.format(t='sav', p='RS2'), 'scenario')} t GROUP BY g""",
    "q1_6b_method_sensitivity": f"""SELECT m AS procurement_method, sum(f)::BIGINT AS flagged_awards, {k('sum(p)', 2)} AS value_published_k,
      {k('coalesce(sum(w), 0)', 2)} AS value_without_flagged_k, {pct('max(p)', 'sum(p)', 1)} AS top_1_share_pct_published,
      {pct('max(w)', 'sum(w)', 1)} AS top_1_share_pct_without_flagged,
      round(sum((p::DOUBLE / tp::DOUBLE) ** 2) * 10000, 0) AS herfindahl_published,
      round(coalesce(sum((w::DOUBLE / tw::DOUBLE) ** 2), 0) * 10000, 0) AS herfindahl_without_flagged
      FROM (SELECT *, sum(p) OVER (PARTITION BY m) AS tp, sum(w) OVER (PARTITION BY m) AS tw FROM
        (SELECT coalesce(method, {NS}) AS m, supplier_id, sum(value) AS p, sum(value) FILTER (NOT {FLAGGED}) AS w, count(*) FILTER (WHERE {FLAGGED}) AS f FROM sav GROUP BY 1, 2))
      GROUP BY m""",
    "q2_1_competition_headline": f"""SELECT pop AS population, count(*) AS eligible_tenders, {q('n', 0.5)} AS median_tenderers_m_c01,
      round(100 * avg((n = 1)::INT), 2) AS single_bidder_rate_pct_m_c02, round(avg(n), 2) AS mean_tenderers, max(n)::BIGINT AS max_tenderers
      FROM (SELECT 'primary (NORMAL, 1-8)' AS pop, number_of_tenderers AS n FROM competition WHERE prim
            UNION ALL SELECT 'sensitivity (NORMAL + ELEVATED)', number_of_tenderers FROM competition) GROUP BY pop""",
    "q2_1b_register": entries("M-C01 / M-C02", "M-C01 (sensitivity)"),
    "q2_2_participation_bands": f"""SELECT b AS participation_band, p AS primary_tenders, {pct('p', 'sum(p) OVER ()', 2)} AS pct_of_primary,
      {pct('sum(p) OVER (ORDER BY b)', 'sum(p) OVER ()', 2)} AS cumulative_pct_of_primary, x AS sensitivity_only_tenders
      FROM (SELECT {PB} AS b, count(*) FILTER (prim) AS p, count(*) FILTER (NOT prim) AS x FROM competition GROUP BY 1)""",
    "q2_3_tenderer_percentiles": f"""SELECT count(*) AS eligible_tenders, min(number_of_tenderers)::BIGINT AS min_tenderers,
      {", ".join(f"round({q('number_of_tenderers', p)}, 6) AS {n}" for n, p in (('p25', .25), ('median', .5), ('p75', .75), ('p90', .9), ('p99', .99)))},
      max(number_of_tenderers)::BIGINT AS max_tenderers FROM competition WHERE prim""",
    "q2_4_competition_by_method": f"""SELECT coalesce(method, {NS}) AS procurement_method, count(*) AS eligible_tenders, {q('number_of_tenderers', 0.5)} AS median_tenderers,
      round(100 * avg(single::INT), 1) AS single_bidder_rate_pct, round(100 * avg((number_of_tenderers >= 6)::INT), 1) AS six_plus_tenderers_pct,
      round(100 * avg(single::INT) - 100 * (SELECT avg(single::INT) FROM competition WHERE prim), 1) AS single_bidder_gap_vs_overall_pts,
      CASE WHEN count(*) < 30 THEN {SMALL} ELSE '' END AS reliability_note FROM competition WHERE prim GROUP BY 1""",
    "q2_5_competition_by_status": f"""SELECT tender_status, count(*) FILTER (prim) AS primary_tenders, quantile_cont(number_of_tenderers::DOUBLE, 0.5) FILTER (prim) AS median_tenderers,
      round(100 * avg(single::INT) FILTER (prim), 1) AS single_bidder_rate_pct, CASE WHEN count(*) FILTER (prim) < 30 THEN {SMALL} ELSE '' END AS reliability_note
      FROM competition GROUP BY 1""",
    "q2_6_competition_extremes": f"""SELECT * FROM (WITH e AS (SELECT buyer_id, max(buyer_name) AS buyer_name, count(*) AS n, {q('number_of_tenderers', 0.5)} AS med, avg(single::INT) AS r
        FROM competition WHERE prim AND buyer_id <> 'B-' GROUP BY buyer_id HAVING count(*) >= 30),
      s AS (SELECT *, rank() OVER (ORDER BY r DESC, n DESC) AS hi, rank() OVER (ORDER BY r, n DESC) AS lo, ntile(4) OVER (ORDER BY r, buyer_id) AS quart, count(*) OVER () AS c FROM e)
      SELECT x.ranking, x.rnk AS rank_in_group, buyer_id, buyer_name, n AS eligible_tenders, med AS median_tenderers, round(100 * r, 1) AS single_bidder_rate_pct,
        quart AS single_bidder_quartile, c AS entities_in_comparison
      FROM (SELECT 'highest single-bidder rate' AS ranking, hi AS rnk, * FROM s UNION ALL SELECT 'lowest single-bidder rate', lo, * FROM s) x WHERE rnk <= 10)""",
    "q3_1_budget_headline": f"""SELECT (SELECT count(*) FROM awv) AS candidate_awards, count(*) AS eligible_ocids, {pct('count(*)', '(SELECT count(*) FROM awv)', 1)} AS eligible_pct_of_candidate,
      (SELECT count(*) FROM awv) - count(*) AS excluded_ocids, {k('sum(budget)', 1)} AS total_budget_k, {k('sum(value)', 1)} AS total_award_k, {k('sum(variance)', 1)} AS net_variance_k,
      round(sum(value)::DOUBLE / sum(budget)::DOUBLE, 4) AS aggregate_award_to_budget_ratio, round({q('ratio', 0.5)}::DECIMAL(38,8), 4)::DOUBLE AS median_ratio FROM bva""",
    "q3_1b_register": entries("P4-BvA"),
    "q3_2_ratio_percentiles": f"""SELECT count(*) AS eligible_ocids, min(ratio) AS min_ratio,
      {", ".join(f"round({q('ratio', p)}::DECIMAL(38,8), 4)::DOUBLE AS {n}" for n, p in (('p01', .01), ('p10', .1), ('p25', .25), ('median', .5), ('p75', .75), ('p90', .9), ('p99', .99)))},
      max(ratio) AS max_ratio FROM bva""",
    "q3_3_ratio_bands": f"""SELECT {RB} AS ratio_band, count(*) AS ocids, {pct('count(*)', 'sum(count(*)) OVER ()', 2)} AS pct_of_ocids, {k('sum(budget)', 2)} AS budget_k,
      {k('sum(value)', 2)} AS award_k, {pct('sum(value)', 'sum(sum(value)) OVER ()', 2)} AS pct_of_award_value FROM bva GROUP BY 1""",
    "q3_4_variance_by_method": f"""SELECT coalesce(method, {NS}) AS procurement_method, count(*) AS eligible_ocids, {k('sum(budget)', 2)} AS budget_k, {k('sum(value)', 2)} AS award_k,
      {k('sum(variance)', 2)} AS net_variance_k, round(sum(value)::DOUBLE / sum(budget)::DOUBLE, 4) AS aggregate_ratio, round({q('ratio', 0.5)}::DECIMAL(38,8), 4)::DOUBLE AS median_ratio,
      {pct('count(*) FILTER (ratio > 1.1)', 'count(*)', 1)} AS pct_award_above_110pct_of_budget, {pct('count(*) FILTER (ratio < 0.9)', 'count(*)', 1)} AS pct_award_below_90pct_of_budget,
      CASE WHEN count(*) < 30 THEN {SMALL} ELSE '' END AS reliability_note FROM bva GROUP BY 1""",
    "q3_5_entity_variance": f"""SELECT * FROM (SELECT rank() OVER (ORDER BY abs(variance) DESC) AS rank_by_abs_variance, buyer_id, buyer_name, n AS eligible_ocids, {k('budget', 2)} AS budget_k,
      {k('award', 2)} AS award_k, {k('variance', 2)} AS net_variance_k, round(award::DOUBLE / budget::DOUBLE, 4) AS aggregate_ratio, round(med::DECIMAL(38,8), 4)::DOUBLE AS median_ratio,
      {pct('sum(abs(variance)) OVER (ORDER BY abs(variance) DESC, buyer_id)', 'sum(abs(variance)) OVER ()', 1)} AS cumulative_share_of_abs_variance_pct, ents AS entities_in_comparison
      FROM {entity_totals()}) WHERE rank_by_abs_variance <= 15""",
    "q3_6_entity_departure": f"""SELECT * FROM (SELECT rank() OVER (ORDER BY abs(med - 1) DESC) AS rank_by_median_departure, buyer_id, buyer_name, n AS eligible_ocids, round(med::DECIMAL(38,8), 4)::DOUBLE AS median_ratio,
      round(100 * aligned, 1) AS pct_ocids_within_10pct_of_budget, ntile(4) OVER (ORDER BY aligned, buyer_id) AS alignment_quartile, ents AS entities_in_comparison
      FROM {entity_totals()}) WHERE rank_by_median_departure <= 15""",
    "q3_7_budget_reuse": f"""SELECT count(*) AS budget_project_ids, count(*) FILTER (n > 1) AS ids_used_by_several_ocids, {k('sum(s)', 1)} AS summed_budget_k, {k('sum(m)', 1)} AS budget_counted_once_k,
      CASE WHEN sum(s) = sum(m) THEN 'no budget line is repeated across OCIDs: totals are not inflated by sharing' ELSE 'some budget lines are repeated across OCIDs: totals overstate budget' END AS reading
      FROM (SELECT budget_project_id, count(*) AS n, sum(budget) AS s, max(budget) AS m FROM bva GROUP BY 1)""",
    "q3_8_placeholder_budgets": """SELECT (SELECT count(*) FROM bva) AS comparable_ocids, count(*) AS ocids_with_budget_under_100k, min(budget)::DOUBLE AS smallest_budget_ngn,
      max(ratio) AS largest_ratio_among_them, count(*) FILTER (ratio >= 20) AS of_which_ratio_1m_or_more, (SELECT count(*) FROM bva WHERE ratio >= 20) AS all_ocids_with_ratio_1m_or_more,
      (SELECT count(*) FROM bva WHERE ratio >= 20 AND budget >= 100000) AS ratio_1m_or_more_with_budget_100k_plus FROM bva WHERE budget < 100000""",
    "q3_9_above_ten_by_entity": band_entity("true"),
    "q3_10_unit_test": f"""SELECT count(*) FILTER (ratio BETWEEN 900 AND 1100) AS ocids_with_ratio_900_to_1100, count(*) FILTER (ratio BETWEEN 900 AND 1100 AND budget >= 100000) AS of_which_budget_100k_plus,
      count(*) FILTER (ratio > 10) AS ocids_above_10x, {pct('count(*) FILTER (ratio BETWEEN 900 AND 1100)', 'count(*) FILTER (ratio > 10)', 1)} AS ratio_900_to_1100_pct_of_above_10x,
      if(coalesce(ratio_900_to_1100_pct_of_above_10x, 0) >= 50, 'most of the above-10x OCIDs lie near 1,000', 'they do not lie near 1,000') AS reading FROM bva""",
    "q3_11_budget_sensitivity": f"""SELECT scenario, count(*) AS comparable_ocids, (SELECT count(*) FROM bva WHERE {FLAGGED}) AS flagged_ocids_in_comparison, {k('sum(budget)', 1)} AS total_budget_k,
      {k('sum(value)', 1)} AS total_award_k, round(sum(value)::DOUBLE / sum(budget)::DOUBLE, 4) AS aggregate_award_to_budget_ratio, round({q('ratio', 0.5)}::DECIMAL(38,8), 4)::DOUBLE AS median_ratio,
      count(*) FILTER (ratio > 10) AS ocids_above_10x, {k('sum(value) FILTER (ratio > 10)', 1)} AS above_10x_award_k, {pct('sum(value) FILTER (ratio > 10)', 'sum(value)', 2)} AS above_10x_pct_of_award_value
      FROM {SCEN.format(t='bva', p='RS1, RS3')} GROUP BY scenario""",
    "q3_11a_flag_footprint": f"""SELECT count(*) AS flagged_awards, count(*) FILTER (dd) AS dropped_decimal, count(*) FILTER (sl) AS sibling_lot, {k('sum(value)', 1)} AS flagged_value_k,
      {pct('sum(value)', '(SELECT sum(value) FROM awv)', 1)} AS pct_of_m_v01_award_value, count(*) FILTER (award_id IN (SELECT award_id FROM bva)) AS in_budget_comparison,
      count(DISTINCT buyer_id) AS entities FROM asf""",
    "q3_11b_above_ten_without_flagged": band_entity("award_id NOT IN (SELECT award_id FROM asf)"),
    "q3_12_ratio_near_groups": f"""SELECT CASE WHEN ratio BETWEEN 90 AND 110 THEN 'ratio 90 to 110' WHEN ratio BETWEEN 900 AND 1100 THEN 'ratio 900 to 1,100' WHEN ratio > 10 THEN 'other ratio above 10'
      ELSE 'ratio 10 or below' END AS ratio_group, count(*) AS ocids, count(*) FILTER (value = floor(value)) AS whole_unit_awards, {k('sum(value)', 1)} AS award_k,
      count(DISTINCT buyer_id) AS entities FROM bva GROUP BY 1""",
    "q4_1_timing_medians": f"""SELECT 'M-E01 tender open duration (days)' AS measure, count(*) AS eligible_n, {q('days', 0.5)} AS median_days FROM tde
      UNION ALL SELECT 'M-E02 award lag, tender start to award (days)', count(*), {q('days', 0.5)} FROM ale
      UNION ALL SELECT 'P5-SIG signature lag, award to signing (days)', count(*), {q('days', 0.5)} FROM sle""",
    "q4_1b_register": entries("M-E01", "M-E02", "P5-SIG", name=True),
    "q4_2_timing_distribution": f"""SELECT measure, count(*) AS eligible_n, min(days)::BIGINT AS min_days,
      {", ".join(f"round({q('days', p)}, 6) AS {n}" for n, p in (('p25', .25), ('median', .5), ('p75', .75), ('p90', .9), ('p99', .99)))},
      max(days)::BIGINT AS max_days, round(avg(days), 1) AS mean_days, count(*) FILTER (days = 0) AS same_day, count(*) FILTER (days > 365) AS over_1_year,
      {pct('count(*) FILTER (days > 365)', 'count(*)', 2)} AS over_1_year_pct FROM {IV} GROUP BY measure""",
    "q4_3_duration_bands": f"""SELECT measure, b AS duration_band, n AS processes, {pct('n', 'sum(n) OVER (PARTITION BY measure)', 2)} AS pct_of_measure,
      {pct('sum(n) OVER (PARTITION BY measure ORDER BY b)', 'sum(n) OVER (PARTITION BY measure)', 2)} AS cumulative_pct
      FROM (SELECT measure, {DB} AS b, count(*) AS n FROM {IV} GROUP BY 1, 2)""",
    "q4_4_timing_by_method": f"""SELECT m AS procurement_method, count(d) AS tender_duration_n, {q('d', 0.5)} AS median_tender_duration_days, count(l) AS award_lag_n,
      {q('l', 0.5)} AS median_award_lag_days, CASE WHEN least(count(d), count(l)) < 30 THEN 'small n in at least one measure: read with caution' ELSE '' END AS reliability_note
      FROM (SELECT coalesce(method, {NS}) AS m, days AS d, NULL::INT AS l FROM tde UNION ALL SELECT coalesce(method, {NS}), NULL, days FROM ale) GROUP BY m""",
    "q4_5_duration_by_year": by_year("tde", "tender_start_date", "tender_start_year"),
    "q4_6_lag_by_year": by_year("ale", "award_date", "award_year"),
    "q5_0_minimum_n": """SELECT 'single_bidder_rate / median_tenderers (competition_n)' AS kpi, 30::BIGINT AS min_n, (SELECT count(*) FROM eb WHERE competition_n >= 30) AS entities_compared
      UNION ALL SELECT 'top_supplier_value_share (award_n)', 10, (SELECT count(*) FROM eb WHERE award_n >= 10)
      UNION ALL SELECT 'implementation_coverage_rate (contract_n)', 20, (SELECT count(*) FROM eb WHERE contract_n >= 20)
      UNION ALL SELECT 'tender_reach_rate (process_count)', 30, (SELECT count(*) FROM eb WHERE process_count >= 30)""",
    "q5_1_entity_population": f"""SELECT count(*) AS entities, sum(process_count)::BIGINT AS processes_in_scope, count(budget_line_n) AS entities_with_budget_lines,
      count(competition_n) AS entities_with_competition_data, count(*) FILTER (competition_n >= 30) AS entities_competition_n_30_plus, count(award_n) AS entities_with_awards,
      count(*) FILTER (award_n >= 10) AS entities_award_n_10_plus, count(contract_n) AS entities_with_contracts, count(*) FILTER (contract_n >= 20) AS entities_contract_n_20_plus,
      {k('sum(award_value_total)', 1)} AS total_award_value_k, {k('sum(planned_budget_total)', 1)} AS total_planned_budget_k FROM eb""",
    "q5_1b_register": entries("ENTITY"),
    "q5_2_activity_share": "SELECT g::BIGINT AS largest_entities, "
    + ", ".join(
        f"round(100 * sum({c}) FILTER (rank_{c} <= g)::DOUBLE / sum({c})::DOUBLE, 1) AS {n}"
        for c, n in (("av", "pct_of_award_value"), ("process_count", "pct_of_processes"), ("pb", "pct_of_planned_budget"))
    )
    + f""" FROM (SELECT *, {", ".join(f"row_number() OVER (ORDER BY {c} DESC, buyer_id) AS rank_{c}" for c in ("av", "process_count", "pb"))} FROM {EBF}), {GRID} GROUP BY g""",
    "q5_3_top_entities": f"""SELECT * FROM (SELECT rank() OVER (ORDER BY av DESC) AS rank_award_value, buyer_id, buyer_name, {k('award_value_total', 1)} AS award_value_k,
      {pct('sum(av) OVER (ORDER BY av DESC, buyer_id)', 'sum(av) OVER ()', 1)} AS cumulative_share_of_award_value_pct, award_n, process_count, {k('planned_budget_total', 1)} AS planned_budget_k,
      rank() OVER (ORDER BY process_count DESC) AS rank_processes, rank() OVER (ORDER BY an DESC) AS rank_awards, rank() OVER (ORDER BY pb DESC) AS rank_budget FROM {EBF})
      WHERE rank_award_value <= 15""",
    "q5_4_kpi_profile": f"""SELECT * FROM (SELECT rank() OVER (ORDER BY av DESC) AS rank_award_value, buyer_name, round(100 * reach, 1) AS tender_reach_pct, {pctile('reach')} AS reach_pctile,
      competition_n, tenderers AS median_tenderers, {pctile('tenderers')} AS tenderers_pctile, round(100 * single_bidder, 1) AS single_bidder_pct, {pctile('single_bidder')} AS single_bidder_pctile,
      award_n, round(100 * top_supplier, 1) AS top_supplier_share_pct, {pctile('top_supplier')} AS top_supplier_pctile, contract_n,
      round(100 * implementation, 1) AS implementation_coverage_pct, {pctile('implementation')} AS implementation_pctile FROM {KB}) WHERE rank_award_value <= 15""",
    "q5_5_kpi_spread": " UNION ALL ".join(
        f"SELECT '{label}' AS kpi, count({c}) AS entities_compared, "
        + ", ".join(f"round({q(c, p)}, 3) AS {n}" for n, p in (("p10", 0.1), ("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p90", 0.9)))
        + f" FROM {KB} HAVING count({c}) > 0"
        for c, label in SPREAD_LABELS.items()
    ),
    "q5_6_kpi_by_quartile": f"""SELECT qt AS value_quartile, count(*) AS entities, {k('sum(award_value_total)', 1)} AS award_value_k,
      {pct('sum(award_value_total)', 'sum(sum(award_value_total)) OVER ()', 1)} AS pct_of_award_value, count(*) FILTER (competition_n >= 30) AS entities_with_competition_n,
      round(100 * quantile_cont(single_bidder_rate, 0.5) FILTER (competition_n >= 30), 1) AS median_single_bidder_pct, count(*) FILTER (contract_n >= 20) AS entities_with_contract_n,
      round(100 * quantile_cont(implementation_coverage_rate, 0.5) FILTER (contract_n >= 20), 1) AS median_implementation_coverage_pct,
      CASE WHEN least(count(*) FILTER (competition_n >= 30), count(*) FILTER (contract_n >= 20)) < 10 THEN 'fewer than 10 entities in a KPI: read with caution' ELSE '' END AS reliability_note
      FROM (SELECT *, ntile(4) OVER (ORDER BY award_value_total DESC, buyer_id) AS qt FROM eb WHERE award_value_total IS NOT NULL) GROUP BY qt""",
    "q5_7_top_share_sensitivity": f"""SELECT g::BIGINT AS largest_entities, {pct('sum(pub) FILTER (rp <= g)', 'sum(pub)', 1)} AS pct_of_award_value_published,
      {pct('sum(wo) FILTER (rw <= g)', 'sum(wo)', 1)} AS pct_of_award_value_without_flagged, {k('sum(pub)', 1)} AS total_award_value_published_k,
      {k('sum(wo)', 1)} AS total_award_value_without_flagged_k
      FROM (SELECT *, row_number() OVER (ORDER BY pub DESC, buyer_id) AS rp, row_number() OVER (ORDER BY wo DESC, buyer_id) AS rw FROM {ENTSC}), {GRID} GROUP BY g""",
    "q5_7b_top_entities_without_flagged": f"""SELECT * FROM (SELECT row_number() OVER (ORDER BY wo DESC, buyer_id) AS rank_without, row_number() OVER (ORDER BY pub DESC, buyer_id) AS rank_published,
      buyer_id, buyer_name, {k('pub', 1)} AS award_value_published_k, flagged AS flagged_awards, {k('wo', 1)} AS award_value_without_flagged_k FROM {ENTSC}) WHERE rank_without <= 10""",
    "q6_1_coverage_headline": f"""SELECT count(*) AS eligible_contracts, count(*) FILTER (has_implementation) AS contracts_with_implementation_data,
      {pct('count(*) FILTER (has_implementation)', 'count(*)', 2)} AS coverage_rate_pct_m_i01, count(*) FILTER (NOT has_implementation) AS contracts_without_implementation_data FROM cic""",
    "q6_1b_register": entries("M-I01", "M-E03"),
    "q6_2_implementation_types": f"""SELECT CASE WHEN tx > 0 AND ms > 0 THEN '1  transactions and milestones' WHEN ms > 0 THEN '2  milestones only' WHEN tx > 0 THEN '3  transactions only'
      ELSE '4  no implementation data' END AS implementation_data_type, count(*) AS contracts, {pct('count(*)', 'sum(count(*)) OVER ()', 2)} AS pct_of_contracts,
      sum(tx)::BIGINT AS transactions, sum(ms)::BIGINT AS implementation_milestones FROM cic GROUP BY 1""",
    "q6_3_coverage_by_status": f"""SELECT coalesce(contract_status, '(status not stated)') AS contract_status, count(*) AS contracts, count(*) FILTER (has_implementation) AS with_implementation_data,
      {pct('count(*) FILTER (has_implementation)', 'count(*)', 2)} AS coverage_rate_pct, CASE WHEN count(*) < 30 THEN {SMALL} ELSE '' END AS reliability_note FROM cic GROUP BY 1""",
    "q6_4_coverage_bands": f"""SELECT CASE WHEN rate = 1 THEN '1  full coverage (100%)' WHEN rate >= 0.9 THEN '2  90% to under 100%' WHEN rate >= 0.5 THEN '3  50% to under 90%'
      WHEN rate > 0 THEN '4  under 50%' ELSE '5  none reported (0%)' END AS entity_coverage_band, count(*) AS entities, {pct('count(*)', 'sum(count(*)) OVER ()', 1)} AS pct_of_entities,
      sum(n)::BIGINT AS contracts_held, {pct('sum(n)', 'sum(sum(n)) OVER ()', 1)} AS pct_of_contracts, 20::BIGINT AS min_contracts_threshold FROM {COV} GROUP BY 1""",
    "q6_5_lowest_coverage": f"""SELECT * FROM (SELECT rank() OVER (ORDER BY rate, n DESC) AS rank_lowest_coverage, buyer_id, buyer_name, n AS contracts, w AS with_implementation_data,
      round(100 * rate, 1) AS coverage_rate_pct, round(100 * percent_rank() OVER (ORDER BY rate), 0) AS percentile_among_entities, count(*) OVER () AS entities_in_comparison FROM {COV})
      WHERE rank_lowest_coverage <= 15""",
    "q6_6_lifecycle_funnel": f"""SELECT s::BIGINT AS stage_order, (['planning','tender','award','contract','implementation'])[s] AS stage, n AS ocids_whose_last_published_stage_is_this,
      r AS ocids_reaching_stage_or_beyond, {pct('r', '(SELECT count(*) FROM ps)', 2)} AS pct_of_all_ocids, {pct('r', 'lag(r) OVER (ORDER BY s)', 2)} AS conversion_from_previous_stage_pct
      FROM (SELECT stage AS s, count(*) AS n, (SELECT count(*) FROM ps q WHERE q.stage >= ps.stage) AS r FROM ps GROUP BY stage)""",
}


def sql() -> dict[str, str]:
    return {name: with_tables(body) for name, body in SQL.items()}
