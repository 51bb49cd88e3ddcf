"""Tables, dimensions and eligibility views."""

from __future__ import annotations

from oracle.prelude import with_tables

M = "method AS procurement_method_details"
WHO = "buyer_id, buyer_name, buyer_id_flag"

REG_META = """(SELECT * FROM (VALUES
 ('M-P01','Total planned budget by entity','budget line','Budget lines (latest release per ocid x projectID)'),
 ('M-C01 / M-C02','Median tenderers; single-bidder rate (primary)','OCID','Snapshot OCIDs with a tender'),
 ('M-C01 (sensitivity)','Median tenderers, NORMAL + ELEVATED','OCID','Snapshot OCIDs with a tender'),
 ('M-V01','Median award value','OCID (one award)','Snapshot OCIDs with an award'),
 ('M-S01','Top-supplier award value concentration','award x supplier','M-V01 eligible awards'),
 ('P4-BvA','Budget-to-award comparison','OCID','M-V01 eligible awards'),
 ('M-E01','Median tender duration (days)','OCID','Snapshot OCIDs with a tender'),
 ('M-E02','Median award lag (days)','OCID','Snapshot OCIDs with a tender and an award'),
 ('P5-SIG','Contract signature lag (days)','contract','Snapshot contracts'),
 ('M-E03','Lifecycle conversion','OCID','All OCIDs (no exclusions by spec)'),
 ('M-I01','Implementation reporting coverage','contract','Snapshot contracts (no exclusions by spec)'),
 ('ENTITY','Procuring-entity benchmark','buyer','Buyer IDs (test entity excluded)')
) m(metric_id, metric_name, grain, candidate_population)) m"""
REGISTER = f"""SELECT m.metric_id, m.metric_name, m.grain, m.candidate_population, cand AS candidate_count,
 elig AS eligible_count, round(100.0 * elig / nullif(cand, 0)::DOUBLE, 1) AS eligible_pct FROM reg JOIN {REG_META} USING (metric_id)"""


BUDGET_TEXT = """'Budget of order ' || release_id AS budget_description, CASE WHEN budget_project_id IS NOT NULL THEN 'Programme ' || ocid END AS budget_project"""
SQL = {
    # staging
    "s02_releases": "SELECT release_id, release_seq, ocid, release_date, tag, 'tender' AS initiation_type, 'en' AS language, buyer_id, buyer_name, party_flag FROM releases",
    "s03_planning": f"SELECT release_id, ocid, release_seq, buyer_id, party_flag, budget_id, budget_project_id, budget_amount::DOUBLE AS budget_amount, budget_currency, budget_amount_flag, budget_monetary_flag, {BUDGET_TEXT} FROM planning",
    "s04_tender": """SELECT release_id, ocid, release_seq, tender_id, 'Tender ' || release_id AS title, 'Goods and services of order ' || release_id AS description, 'open' AS procurement_method,
      NULL::VARCHAR AS procurement_method_rationale, 'USD' AS tender_value_currency, NULL::VARCHAR AS award_criteria, NULL::VARCHAR AS award_criteria_details, 'written' AS submission_method,
      NULL::VARCHAR AS submission_method_details, status, method AS procurement_method_details, number_of_tenderers, tender_value_amount::DOUBLE AS tender_value_amount,
      tender_start_date, tender_end_date, (release_seq % 6 = 0) AS has_enquiries, tenderer_count_flag, tender_value_monetary_flag, tender_start_date_flag, tender_end_date_flag FROM tender""",
    "s05_awards": "SELECT award_id, release_id, ocid, release_seq, 'Award ' || release_id AS title, NULL::VARCHAR AS description, status, award_date, value::DOUBLE AS award_value_amount, 'USD' AS award_value_currency, award_value_flag, award_monetary_flag, award_date_flag FROM awards",
    "s06_award_suppliers": "SELECT award_id, ocid, release_seq, supplier_seq::BIGINT AS supplier_seq, supplier_id, supplier_name, supplier_name_raw FROM award_suppliers",
    "s07_contracts": """SELECT contract_id, release_id, ocid, release_seq, award_id, 'Contract ' || release_id AS title, NULL::VARCHAR AS description, 'USD' AS contract_value_currency, status, value::DOUBLE AS contract_value_amount, date_signed, period_start_date, period_end_date,
      has_implementation, contract_monetary_flag, date_signed_flag, period_start_date_flag, period_end_date_flag FROM contracts""",
    "s08_transactions": "SELECT contract_id, transaction_id, transaction_value::DOUBLE AS transaction_value, payer_id, payer_name, payee_id, payee_name, 'USD' AS transaction_currency, CASE WHEN transaction_value = 0 THEN 'ZERO_VALUE' END AS transaction_monetary_flag FROM transactions",
    "s09_milestones": "SELECT contract_id, milestone_source, milestone_id, NULL::VARCHAR AS title, NULL::VARCHAR AS description, NULL::VARCHAR AS code, due_date, due_date AS date_met, CASE WHEN milestone_source = 'IMPLEMENTATION' THEN 'met' END AS status, due_date_flag, due_date_flag AS date_met_flag FROM milestones",
    "s10_parties": """SELECT release_id, ocid, release_seq, party_id, party_name_raw, trim(regexp_replace(party_name_raw, '\\s+', ' ', 'g')) AS party_name, party_id AS identifier_id, 'ORDERS' AS identifier_scheme, roles,
      CASE WHEN roles = 'supplier' AND party_id = 'S-' THEN 'INCOMPLETE' END AS supplier_id_flag FROM parties""",
    # snapshot and dimensions
    "k01_budget_lines": f"SELECT ocid, budget_project_id, release_id, release_seq, buyer_id, party_flag, budget_amount::DOUBLE AS budget_amount, budget_currency, budget_amount_flag, budget_monetary_flag, {BUDGET_TEXT} FROM budget_lines",
    "k02_release_facts": "SELECT ocid, release_count, latest_release_id, buyer_id, tags AS tags_observed FROM snap",
    "k03_tags_per_process": "SELECT ocid, tags AS tags_observed FROM snap",
    "k04_latest_tender": "SELECT ocid, tender_release_id, tender_id FROM process_snapshot WHERE tender_id IS NOT NULL",
    "k05_latest_award": "SELECT ocid, award_release_id, award_id FROM process_snapshot WHERE award_id IS NOT NULL",
    "k06_award_contract": "SELECT a.award_id, a.release_id, c.contract_id FROM awards a LEFT JOIN contracts c ON c.release_id = a.release_id AND c.award_id = a.award_id",
    "k07_process_snapshot": """SELECT ocid, release_count, latest_release_id, buyer_id, tags AS tags_observed, tender_release_id, tender_id, award_release_id, award_id, contract_id,
      budget_line_count, multi_project_flag FROM process_snapshot""",
    "k08_latest_award_by_max": """SELECT ocid, award_id, release_id FROM awards a WHERE NOT EXISTS
      (SELECT 1 FROM awards b WHERE b.ocid = a.ocid AND b.release_seq > a.release_seq)""",
    "k09_latest_line_by_row_number": """SELECT ocid, budget_project_id, release_id FROM planning WHERE budget_project_id IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY ocid, budget_project_id ORDER BY release_seq DESC) = 1""",
    "k10_dim_buyer": "SELECT buyer_id, buyer_name, buyer_name AS buyer_name_raw, release_count, buyer_id_flag, test_entity_flag FROM dim_buyer",
    "k11_dim_supplier": "SELECT supplier_id, supplier_name, supplier_name_raw, name_variant_count, in_supplier_parties, in_award_suppliers, supplier_id_flag FROM sup",
    # views
    "v01_budget_eligible": f"SELECT ocid, budget_project_id, release_id, buyer_id, buyer_name, budget_amount::DOUBLE AS budget_amount, budget_currency, multi_project_flag, {BUDGET_TEXT} FROM budget_eligible",
    "v02_competition_eligible": f"SELECT ocid, tender_release_id, tender_id, {WHO}, {M}, tender_status, number_of_tenderers, tenderer_count_flag, prim AS in_primary_population, single AS is_single_bidder FROM competition",
    "v03_award_value_eligible": f"SELECT ocid, award_id, award_release_id, {WHO}, {M}, value::DOUBLE AS award_value_amount, 'USD' AS award_value_currency, award_date, award_date_flag FROM awv",
    "v04_supplier_award_eligible": f"SELECT ocid, award_id, {WHO}, {M}, supplier_id, supplier_name, name_variant_count, distinct_supplier_count, value::DOUBLE AS award_value_amount FROM sav",
    "v05_budget_award_comparison": f"SELECT ocid, award_id, {WHO}, {M}, budget_project_id, budget::DOUBLE AS budget_amount, value::DOUBLE AS award_value_amount, variance::DOUBLE AS variance_amount, ratio AS award_to_budget_ratio FROM bva",
    "v06_tender_duration_eligible": f"SELECT ocid, tender_release_id, {WHO}, {M}, tender_start_date, tender_end_date, days::BIGINT AS tender_duration_days FROM tde",
    "v07_award_lag_eligible": f"SELECT ocid, award_id, {WHO}, {M}, award_status, tender_start_date, award_date, days::BIGINT AS award_lag_days FROM ale",
    "v08_signature_lag_eligible": f"SELECT ocid, contract_id, {WHO}, award_date, date_signed, days::BIGINT AS signature_lag_days FROM sle",
    "v09_lifecycle_stage": f"""SELECT ocid, {WHO}, release_count, tags AS tags_observed, stage::BIGINT AS highest_stage_rank,
      (['planning','tender','award','contract','implementation'])[stage] AS highest_stage FROM ps""",
    "v10_contract_implementation_coverage": f"SELECT ocid, contract_id, contract_release_id, {WHO}, contract_status, has_implementation, tx AS transaction_count, ms AS implementation_milestone_count FROM cic",
    "v11_entity_benchmark": """SELECT buyer_id, buyer_name, process_count, processes_reaching_tender, tender_reach_rate, processes_reaching_award, budget_line_n,
      planned_budget_total::DOUBLE AS planned_budget_total, competition_n, median_tenderers, single_bidder_rate, award_n, award_value_total::DOUBLE AS award_value_total,
      median_award_value, distinct_supplier_n, top_supplier_value_share, contract_n, implementation_coverage_rate FROM eb""",
    "v12_metric_population": REGISTER,
    "v14_dim_buyer": "SELECT buyer_id, buyer_name, replace(buyer_id, 'B-', '') AS buyer_code, buyer_name || ' (' || replace(buyer_id, 'B-', '') || ')' AS buyer_label FROM dim_buyer WHERE buyer_id NOT IN ('B-', 'B-7')",
    "v15_dim_procurement_method": """SELECT coalesce(method, '(method not stated)') AS procurement_method, method IS NULL AS is_not_stated FROM
      (SELECT method FROM competition UNION SELECT method FROM awv UNION SELECT method FROM sav UNION SELECT method FROM bva UNION SELECT method FROM tde UNION SELECT method FROM ale)""",
    "v16_award_scale_flag": f"""SELECT ocid, award_id, buyer_id, buyer_name, {M}, supplier_id, value::DOUBLE AS award_value_amount, 'POSSIBLE_SCALE_ERROR' AS scale_flag,
      CASE WHEN dd AND sl THEN 'DROPPED_DECIMAL+SIBLING_LOT' WHEN dd THEN 'DROPPED_DECIMAL' ELSE 'SIBLING_LOT' END AS flag_reason, dd AS dropped_decimal_test,
      sl AS sibling_lot_test, budget_project_id, budget::DOUBLE AS budget_amount, ratio AS award_to_budget_ratio, sibling_award_id,
      sibling_award_value::DOUBLE AS sibling_award_value, ratio_to_sibling FROM asf""",
    "v17_exclude_test": "SELECT ocid, buyer_id, buyer_name FROM ps",
}


def sql() -> dict[str, str]:
    return {k: with_tables(q) for k, q in SQL.items()}


