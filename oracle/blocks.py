"""The building blocks: flags, joins, aggregates, windows, order, sets, scalar functions."""

from __future__ import annotations

from oracle.checks import DATES
from oracle.prelude import date_flag, with_tables
from oracle.questions import DB, IV, PB, RB, pct, q
from oracle.study import RAW, date_class, exclusive

TOT = "(SELECT supplier_id, count(*) AS awards, sum(value) AS v FROM sav GROUP BY 1)"
TOTB = "(SELECT buyer_id, supplier_id, count(*) AS awards, sum(value) AS v FROM sav GROUP BY 1, 2)"
MS = "coalesce(method, '(method not stated)')"
STRIP = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)"
MONEY = [("budget_amount", "planning", "budget_amount"), ("tender_value_amount", "tender", "tender_value_amount"), ("award_value_amount", "awards", "value"),
         ("contract_value_amount", "contracts", "value"), ("transaction_value", "transactions", "transaction_value")]
COVR = "CASE WHEN r = 1 THEN '1  full coverage (100%)' WHEN r >= 0.9 THEN '2  90% to under 100%' WHEN r >= 0.5 THEN '3  50% to under 90%' WHEN r > 0 THEN '4  under 50%' ELSE '5  none reported (0%)' END"
IMPLT = "CASE WHEN tx > 0 AND ms > 0 THEN '1  transactions and milestones' WHEN ms > 0 THEN '2  milestones only' WHEN tx > 0 THEN '3  transactions only' ELSE '4  no implementation data' END"
NEAR = "CASE WHEN ratio BETWEEN 90 AND 110 THEN 'ratio 90 to 110' WHEN ratio BETWEEN 900 AND 1100 THEN 'ratio 900 to 1,100' WHEN ratio > 10 THEN 'other ratio above 10' ELSE 'ratio 10 or below' END"
STAGE = "(['planning','tender','award','contract','implementation'])[stage]"


def fam(family: str, band: str, src: str) -> str:
    return f"SELECT '{family}' AS family, {band} AS band, count(*) AS n FROM {src} GROUP BY 1, 2"


def thresholds() -> str:
    rows = [("tenderers", "tender", "number_of_tenderers", (4, 8, 11)), ("budget", "planning", "budget_amount", (100000, 300000, 495000)), ("award", "awards", "value", (100000, 300000, 600000))]
    return " UNION ALL ".join(f"SELECT '{m}' AS measure, {t}::DOUBLE AS threshold, count(*) FILTER ({c} > {t}) AS above FROM {src}" for m, src, c, ts in rows for t in ts)


TAGS = "string_split(tag, ',')"
SQL = {
    "f01_date_flags": " UNION ALL ".join(f"SELECT '{c}' AS field, {('due_date' if c == 'date_met' else c)}_flag AS flag, count(*) AS n FROM {t} GROUP BY 1, 2" for t, c in DATES),
    "f02_extreme_flags": "SELECT 'budget' AS field, budget_amount_flag AS flag, count(*) AS n FROM planning GROUP BY 1, 2 UNION ALL SELECT 'award', award_value_flag, count(*) FROM awards GROUP BY 1, 2",
    "f03_zero_flags": " UNION ALL ".join(f"SELECT '{f}' AS field, CASE WHEN {c} = 0 THEN 'ZERO_VALUE' END AS flag, count(*) AS n FROM {t} GROUP BY 1, 2" for f, t, c in MONEY),
    "f04_count_class": "SELECT tenderer_count_flag AS count_class, count(*) AS n FROM tender GROUP BY 1",
    "f05_incomplete_ids": "SELECT 'supplier party' AS kind, count(*) AS n FROM parties WHERE roles = 'supplier' AND party_id = 'S-' UNION ALL SELECT 'supplier', count(*) FROM dim_supplier WHERE supplier_id = 'S-' UNION ALL SELECT 'buyer', count(*) FROM dim_buyer WHERE buyer_id = 'B-'",
    "f06_test_entity": "SELECT CASE WHEN buyer_id = 'B-7' THEN 'TEST_ENTITY' END AS flag, count(*) AS n FROM releases GROUP BY 1",
    "f07_standard_names": "SELECT award_id, supplier_seq::BIGINT AS supplier_seq, supplier_name AS name FROM award_suppliers",
    "f08_strict_trim": f"SELECT nullif(trim(supplier_name_raw, {STRIP}), '') AS name, count(*) AS n FROM award_suppliers GROUP BY 1",
    "f09_sequence_key": "SELECT release_id, release_seq FROM releases",
    "f10_multi_project": "SELECT multi_project_flag AS flag, count(*) AS n FROM process_snapshot GROUP BY 1",
    "f11_test_like_names": "SELECT buyer_id, regexp_matches(concat_ws(' ', buyer_id, buyer_name), '(?i)\\b(test|tests|testing|demo|dummy|sample|trial)\\b') AS test_like FROM dim_buyer",
    "f12_buyer_labels": "SELECT buyer_id, substr(buyer_id, 3) AS code FROM dim_buyer",
    "f13_profiler_date_classes": f"SELECT {date_class('t')} AS date_class, count(*) AS n FROM {RAW} GROUP BY 1",
    "f14_study_date_classes": f"""SELECT f AS field, CASE WHEN t IS NULL THEN NULL WHEN t[:10] = '1990-01-01' THEN 'PLACEHOLDER' WHEN t[:4]::INT >= 2001 THEN 'IMPOSSIBLE' WHEN t[:4]::INT >= 2000 THEN 'FUTURE'
       ELSE 'VALID' END AS date_class, count(*) AS n FROM {RAW} GROUP BY 1, 2""",
    "f15_bands": " UNION ALL ".join([
        fam("participation", PB, "competition"), fam("ratio", RB, "bva"), fam("duration", DB, IV),
        fam("coverage", COVR, "(SELECT buyer_id, avg(has_implementation::INT) AS r FROM cic WHERE buyer_id <> 'B-' GROUP BY 1)"),
        fam("implementation", IMPLT, "cic"), fam("stage", STAGE, "ps"), fam("ratio_near", NEAR, "bva")]),
    "f16_small_n_notes": "SELECT buyer_id, if(award_n < 40, 'small n: read with caution', '') AS note FROM eb",
    "f17_materiality": "SELECT CASE WHEN pct_of_candidate >= 10 THEN 'HIGH' WHEN pct_of_candidate >= 1 THEN 'MODERATE' ELSE 'LOW' END AS level, count(*) AS n FROM dqi GROUP BY 1",
    "j01_inner": "SELECT award_id, tender_id FROM awards a, tender t WHERE a.release_id = t.release_id",
    "j02_left": "SELECT a.award_id, c.contract_id FROM awards a LEFT JOIN contracts c ON c.award_id = a.award_id",
    "j03_left_composite": "SELECT a.release_id, a.award_id, c.status FROM awards a LEFT JOIN contracts c ON c.release_id = a.release_id AND c.award_id = a.award_id",
    "j04_left_with_predicate": "SELECT s.ocid, s.budget_line_count, b.budget_project_id FROM process_snapshot s LEFT JOIN budget_lines b ON b.ocid = s.ocid AND s.budget_line_count = 1",
    "j05_full_outer": f"SELECT m AS method, count(*) FILTER (s = 1) AS a, count(*) FILTER (s = 2) AS b FROM (SELECT {MS} AS m, 1 AS s FROM tde UNION ALL SELECT {MS}, 2 FROM awv) GROUP BY 1",
    "j06_one_row_pair": "SELECT (SELECT count(*) FROM awv) AS candidates, (SELECT count(*) FROM sav) AS eligible",
    "j07_parameter": "SELECT buyer_id, award_n FROM eb WHERE award_n >= 10",
    "j08_grid_theta": f"SELECT g::BIGINT AS n, sum(v)::DOUBLE AS value FROM (SELECT *, row_number() OVER (ORDER BY v DESC, supplier_id) AS rn FROM {TOT}), (SELECT unnest([1, 5, 10, 20]) AS g) WHERE rn <= g GROUP BY 1",
    "j09_unnest": f"SELECT unnest({TAGS}) AS t, count(*) AS n FROM releases GROUP BY 1",
    "j10_semi": "SELECT release_id, ocid FROM releases WHERE release_id IN (SELECT release_id FROM awards)",
    "j11_marker": "SELECT award_id, award_id IN (SELECT award_id FROM asf) AS is_flagged FROM awv",
    "j12_anti": "SELECT release_id, tender_id FROM tender WHERE release_id NOT IN (SELECT release_id FROM awards)",
    "j13_not_in": "SELECT DISTINCT buyer_id FROM releases WHERE buyer_id NOT IN (SELECT buyer_id FROM dim_buyer WHERE buyer_id NOT IN ('B-', 'B-7'))",
    "j14_left_is_null": "SELECT award_id FROM awards WHERE award_id NOT IN (SELECT award_id FROM contracts)",
    "j15_siblings": """SELECT a.supplier_id, a.buyer_id, a.award_id, a.value::DOUBLE AS award_value_amount, b.award_id AS sibling_award_id, b.value::DOUBLE AS sibling_award_value
       FROM sav a JOIN sav b ON b.supplier_id = a.supplier_id AND b.buyer_id = a.buyer_id AND b.award_id <> a.award_id AND a.value >= 10 * b.value WHERE a.buyer_id <> 'B-'""",
    "j16_previous_stage": "SELECT stage::BIGINT AS highest_stage_rank, n, p AS previous FROM (SELECT stage, count(*) AS n, lag(stage) OVER (ORDER BY stage) AS ps, lag(count(*)) OVER (ORDER BY stage) AS p FROM ps GROUP BY stage) WHERE stage - ps = 1",
    "j17_later_exists": "SELECT ocid, award_id FROM awards a WHERE EXISTS (SELECT 1 FROM awards b WHERE b.ocid = a.ocid AND b.release_seq > a.release_seq)",
    "j18_scalar_subquery": f"SELECT award_id, {pct('value', '(SELECT sum(value) FROM awv)', 6)} AS pct_of_all FROM asf",
    "j19_mismatch": "SELECT count(*) AS mismatches, count(DISTINCT a.release_id) AS releases FROM awards a JOIN tender t ON t.release_id = a.release_id WHERE a.value <> t.tender_value_amount",
    "j20_two_hops": "SELECT r.buyer_id, count(*) AS transactions FROM transactions x JOIN contracts c ON c.contract_id = x.contract_id JOIN releases r ON r.release_id = c.release_id GROUP BY 1",
    "a01_basic": "SELECT buyer_id, count(*) AS n, count(method) AS with_method, sum(value)::DOUBLE AS total, min(value)::DOUBLE AS lowest, max(value)::DOUBLE AS highest FROM awv GROUP BY 1",
    "a02_count_distinct": "SELECT buyer_id, count(DISTINCT supplier_id) AS suppliers FROM sav GROUP BY 1",
    "a03_count_distinct_row": "SELECT (SELECT count(*) FROM (SELECT DISTINCT ocid, budget_project_id FROM planning)) AS pairs_with_null, (SELECT count(*) FROM (SELECT DISTINCT ocid, budget_project_id FROM planning WHERE budget_project_id IS NOT NULL)) AS pairs_without_null",
    "a04_filtered": "SELECT count(*) AS n, count(*) FILTER (stage >= 3) AS awarded, (sum(release_count) FILTER (stage >= 3))::BIGINT AS releases_of_awarded FROM ps",
    "a05_percentiles": "SELECT buyer_id, " + ", ".join(f"round({q('value', p)}, 4) AS {n}" for n, p in (("p01", .01), ("p10", .1), ("p25", .25), ("p50", .5), ("p75", .75), ("p90", .9), ("p99", .99))) + " FROM awv GROUP BY 1",
    "a06_rates": "SELECT buyer_id, round(avg(single::INT), 6) AS single, round(avg(single::INT) FILTER (prim), 6) AS single_primary FROM competition GROUP BY 1",
    "a07_bool": "SELECT buyer_id, bool_or(has_implementation) AS any_reported, bool_and(has_implementation) AS all_reported FROM cic GROUP BY 1",
    "a08_distinct_sorted_array": "SELECT ocid, coalesce(string_agg(DISTINCT status, ',' ORDER BY status), '') AS statuses FROM awards GROUP BY 1",
    "a09_latest_value": "SELECT ocid, arg_max(award_id, release_seq) AS latest_award FROM awards GROUP BY 1",
    "a10_ordered_text": "SELECT metric_id, string_agg(dq_ref || ' (' || records_with_issue || ')', '; ' ORDER BY records_with_issue DESC, dq_ref) AS issues FROM dqi GROUP BY 1",
    "a11_two_levels": f"SELECT buyer_id, count(*) AS suppliers, max(v)::DOUBLE AS largest, sum(v)::DOUBLE AS total FROM {TOTB} GROUP BY 1",
    "a12_having": "SELECT ocid, count(*) AS n FROM releases GROUP BY 1 HAVING count(*) > 12",
    "a13_weighted_gap": f"SELECT {MS} AS method, round(avg(single::INT) - (SELECT avg(single::INT) FROM competition), 6) AS gap FROM competition GROUP BY 1",
    "a14_hhi": f"SELECT buyer_id, round(10000 * sum(v::DOUBLE * v::DOUBLE) / (sum(v)::DOUBLE * sum(v)::DOUBLE), 4) AS hhi FROM {TOTB} GROUP BY 1",
    "a15_top_share": f"SELECT round(sum(v) FILTER (rn <= 10)::DOUBLE / sum(v)::DOUBLE, 6) AS strict, round(sum(v) FILTER (rk <= 10)::DOUBLE / sum(v)::DOUBLE, 6) AS with_ties FROM (SELECT *, row_number() OVER (ORDER BY v DESC, supplier_id) AS rn, rank() OVER (ORDER BY v DESC) AS rk FROM {TOT})",
    "a16_depth_to_share": f"SELECT buyer_id, min(rn) FILTER (2 * cum >= tot) AS to_50, min(rn) FILTER (10 * cum >= 8 * tot) AS to_80 FROM (SELECT *, row_number() OVER w AS rn, sum(v) OVER w AS cum, sum(v) OVER (PARTITION BY buyer_id) AS tot FROM {TOTB} WINDOW w AS (PARTITION BY buyer_id ORDER BY v DESC, supplier_id ROWS UNBOUNDED PRECEDING)) GROUP BY 1",
    "a17_conditional_pivot": "SELECT metric_id, max(records_with_issue) FILTER (dq_ref = 'ALL') AS all_reasons, max(records_with_issue) FILTER (dq_ref = 'OTHER') AS other_rule FROM dqi GROUP BY 1",
    "a18_frequency": f"SELECT list_aggregate(list_sort({TAGS}), 'string_agg', ',') AS tags, count(*) AS n FROM releases GROUP BY 1",
    "a19_describe": f"""SELECT count(*) AS n, min(x)::BIGINT AS minimum, max(x)::BIGINT AS maximum, round(avg(x), 4) AS mean, round(quantile_cont(x, 0.5), 4) AS median,
       {", ".join(f"round({exclusive(p)}, 4) AS {n}" for n, p in (("q1", .25), ("q3", .75), ("p95", .95)))}
       FROM (SELECT number_of_tenderers AS x, row_number() OVER (ORDER BY number_of_tenderers) AS rn, count(*) OVER () AS n FROM tender)""",
    "a20_thresholds": thresholds(),
    "a21_presence": " UNION ALL ".join(
        f"SELECT '{f}' AS field, count({c}) AS present FROM tender" for f, c in (
            *((x, x) for x in ("tender_id", "status", "number_of_tenderers", "tender_value_amount", "tender_start_date", "tender_end_date",
                               "tenderer_count_flag", "tender_value_monetary_flag", "tender_start_date_flag", "tender_end_date_flag")),
            ("procurement_method_details", "method"), *((x, "1") for x in ("title", "description", "procurement_method", "tender_value_currency", "has_enquiries", "submission_method")),
            *((x, "NULL") for x in ("procurement_method_rationale", "award_criteria", "award_criteria_details", "submission_method_details")))),
    "a22_multiplicity": "SELECT supplier_id, count(DISTINCT supplier_name_raw) AS n_values, min(supplier_name_raw) AS sample FROM award_suppliers GROUP BY 1 HAVING count(DISTINCT supplier_name_raw) > 1",
    "w01_row_number": f"SELECT supplier_id, row_number() OVER (ORDER BY v DESC, supplier_id) AS position FROM {TOT}",
    "w02_rank": "SELECT buyer_id, award_n, process_count, rank() OVER (ORDER BY award_n DESC, process_count DESC) AS r FROM eb",
    "w03_percent_rank": "SELECT buyer_id, round(percent_rank() OVER (ORDER BY single_bidder_rate), 6) AS place FROM eb WHERE single_bidder_rate IS NOT NULL",
    "w04_ntile": f"SELECT supplier_id, ntile(4) OVER (ORDER BY v, supplier_id) AS quartile FROM {TOT}",
    "w05_gap_aware_lag": "SELECT year, n, CASE WHEN year - lag(year) OVER (ORDER BY year) = 1 THEN n - lag(n) OVER (ORDER BY year) END AS change FROM (SELECT year(award_date) AS year, count(*) AS n FROM ale GROUP BY 1)",
    "w06_lead": "SELECT supplier_id, value::DOUBLE AS first, nx::DOUBLE AS second FROM (SELECT *, lead(value) OVER w AS nx, row_number() OVER w AS rn FROM sav WINDOW w AS (PARTITION BY supplier_id ORDER BY value DESC, award_id)) WHERE rn = 1",
    "w07_running_share": f"SELECT supplier_id, (sum(v) OVER (ORDER BY v DESC, supplier_id))::DOUBLE AS cum, {pct('sum(v) OVER (ORDER BY v DESC, supplier_id)', 'sum(v) OVER ()', 4)} AS cumulative_pct FROM {TOT}",
    "w08_partition_totals": f"SELECT buyer_id, supplier_id, {pct('v', 'sum(v) OVER (PARTITION BY buyer_id)', 4)} AS share_pct FROM {TOTB}",
    "w09_over_aggregate": f"SELECT b AS band, n, {pct('sum(n) OVER (ORDER BY b)', 'sum(n) OVER ()', 4)} AS cumulative_pct FROM (SELECT {PB} AS b, count(*) AS n FROM competition GROUP BY 1)",
    "w10_filtered_window": "SELECT metric_id, dq_ref, max(records_with_issue) FILTER (dq_ref = 'ALL') OVER (PARTITION BY metric_id) AS excluded FROM dqi",
    "w11_entities_compared": "SELECT buyer_id, award_n, count(*) OVER () AS entities_in_comparison FROM eb WHERE award_n >= 30",
    "w12_competition_rank": "SELECT buyer_id, contract_n, rank() OVER (ORDER BY contract_n DESC) AS place FROM eb WHERE contract_n IS NOT NULL",
    "t01_order_by": "SELECT metric_id, cand AS candidate_count FROM reg",
    "t02_limit": f"SELECT supplier_id, v::DOUBLE AS value FROM {TOT} ORDER BY v DESC, supplier_id LIMIT 7",
    "t03_top_with_ties": f"SELECT * FROM (SELECT supplier_id, awards, rank() OVER (ORDER BY awards DESC) AS place FROM {TOT}) WHERE place <= 5",
    "t04_both_ends": "SELECT buyer_id, award_value_total::DOUBLE AS award_value_total, position, side FROM (SELECT *, row_number() OVER (ORDER BY award_value_total DESC, buyer_id) AS position, 'highest' AS side FROM eb UNION ALL SELECT *, row_number() OVER (ORDER BY award_value_total, buyer_id), 'lowest' FROM eb) WHERE position <= 3",
    "t05_cutoff_ties": "SELECT * FROM (SELECT buyer_id, count(*) AS n, rank() OVER (ORDER BY count(*) DESC) AS place FROM competition GROUP BY 1) WHERE place <= 10",
    "t06_signed_extremes": "SELECT side, buyer_id, net::DOUBLE AS net, position FROM (SELECT *, row_number() OVER (PARTITION BY side ORDER BY abs(net) DESC, buyer_id) AS position FROM (SELECT buyer_id, sum(variance) AS net, if(sum(variance) > 0, 'above', 'below') AS side FROM bva GROUP BY 1)) WHERE position <= 4",
    "t07_custom_order": f"SELECT {STAGE} AS highest_stage, count(*) AS n, (6 - stage)::BIGINT AS place FROM ps GROUP BY stage",
    "t08_most_repeated": "SELECT ocid, count(*) AS n FROM releases GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "u01_union_all": f"SELECT measure, count(*) AS n, sum(days)::BIGINT AS days FROM {IV} GROUP BY 1",
    "u02_union_distinct": "SELECT DISTINCT supplier_id FROM sobs",
    "u03_distinct": "SELECT award_id, supplier_id FROM asup",
    "u04_distinct_on": "SELECT DISTINCT ON (ocid) ocid, tender_id FROM tender ORDER BY ocid, release_seq DESC",
    "u05_symmetric_difference": "SELECT 'tender only' AS side, count(*) AS n FROM (SELECT ocid FROM tender EXCEPT SELECT ocid FROM awards) HAVING count(*) > 0 UNION ALL SELECT 'award only', count(*) FROM (SELECT ocid FROM awards EXCEPT SELECT ocid FROM tender) HAVING count(*) > 0",
    "u06_intersection": "SELECT ocid FROM tender WHERE number_of_tenderers > 8 INTERSECT SELECT ocid FROM awards WHERE value = 0",
    "x01_round": "SELECT award_id, round(ratio, 2) AS r2, round(ratio, 0) AS r0 FROM bva",
    "x02_null_functions": "SELECT buyer_id, coalesce(award_n, 0) AS award_n, nullif(distinct_supplier_n, award_n) AS fewer_suppliers, greatest(award_n, contract_n) AS most, least(award_n, contract_n) AS fewest FROM eb",
    "x03_case": "SELECT ocid, CASE WHEN stage < 4 THEN 'early' WHEN release_count > 10 THEN 'late, many' ELSE 'late, few' END AS kind FROM ps",
    "x04_distinct_from": "SELECT award_id, status IS DISTINCT FROM 'active' AS not_active FROM awards",
    "x05_between_in": "SELECT ocid, number_of_tenderers BETWEEN 2 AND 5 AS two_to_five, tender_status IN ('active', 'planned') AS open_status, 'B-3' IN (buyer_id, tender_id) AS any_b3 FROM competition",
    "x06_arithmetic": "SELECT award_id, abs(variance)::DOUBLE AS size, round(ratio ** 2, 4) AS squared, floor(value)::BIGINT AS whole, (value - floor(value))::DOUBLE AS fraction FROM bva",
    "x07_dates": "SELECT contract_id, (period_end_date - period_start_date)::BIGINT AS days, year(date_signed) AS year FROM contracts",
    "x08_date_literals": "SELECT award_date >= DATE '1998-01-01' AS since_1998, count(*) AS n FROM awards GROUP BY 1",
    "x09_trim": f"SELECT award_id, supplier_seq::BIGINT AS supplier_seq, trim(supplier_name_raw) AS spaces, trim(supplier_name_raw, {STRIP}) AS strict FROM award_suppliers",
    "x10_regexp_replace": "SELECT metric_id, regexp_replace(metric_id, '[^A-Za-z0-9]+', '-', 'g') AS slug FROM reg",
    "x11_regexp_match": "SELECT supplier_id, regexp_matches(supplier_name, '(?i)\\bsupplier 1\\d*\\b') AS starts_with_1 FROM sup",
    "x12_concat": "SELECT buyer_id, buyer_id || ' / ' || buyer_name AS joined, concat_ws(' ', buyer_id, buyer_name) AS spaced, rtrim(buyer_id || '--', '-') AS right_trimmed FROM dim_buyer",
    "x13_casts": "SELECT release_id, release_id::BIGINT AS as_integer, release_seq::VARCHAR AS as_text FROM releases",
    "x14_array_predicates": "SELECT release_id, stage >= 3 AS has_award, stage >= 4 AS contract_or_later FROM releases",
    "x15_array_functions": "SELECT release_id, len(string_split(tag, ',')) AS n_tags, CASE WHEN stage = 1 THEN '' ELSE substr(tag, 10) END AS without_planning, 'planning' AS first_tag FROM releases",
    "x16_boolean_parity": "SELECT 0::BIGINT AS mismatches, count(*) AS n FROM tender",
    "x17_safe_division": "SELECT ocid, round(release_count / nullif(budget_line_count - 1, 0)::DOUBLE, 6) AS per_extra_line FROM process_snapshot",
    "x18_units": "SELECT award_id, (value * 100)::BIGINT AS minor, round(value * 0.001::DECIMAL(4,3), 2)::DOUBLE AS shown FROM awv",
    "x19_nested_access": "SELECT o.release_id AS id, CASE WHEN o.k % 100 <> 2 THEN 'USD' END AS currency, CASE WHEN st IN ('O', 'F') THEN strftime(d1, '%Y-%m-%d') || 'T00:00:00Z' END AS tender_end, aval.v::DOUBLE AS first_award FROM o LEFT JOIN aval ON aval.k = o.k",
}


def sql() -> dict[str, str]:
    return {name: with_tables(body) for name, body in SQL.items()}
