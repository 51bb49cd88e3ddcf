"""Snapshot studies and profiles."""

from __future__ import annotations

from oracle.prelude import with_tables

B = "(SELECT r.release_id, r.ocid, r.release_seq, r.tag, r.stage, p.budget_project_id AS prj, p.budget_amount AS amt FROM releases r JOIN planning p ON p.release_id = r.release_id)"
RV = f"""(SELECT x.ocid, x.r0.v AS "R0", x.r1.v AS "R1", x.r2.v AS "R2", y.r3 AS "R3" FROM
  (SELECT ocid, arg_max({{'v': amt}}, (stage, release_id)) AS r0, arg_max({{'v': amt}}, (stage, release_seq)) AS r1,
     arg_max({{'v': amt}}, release_seq) AS r2 FROM {B} GROUP BY ocid) x
  JOIN (SELECT ocid, coalesce(sum(a.v), 0) AS r3 FROM (SELECT ocid, prj, arg_max({{'v': amt}}, release_seq) AS a FROM {B} GROUP BY 1, 2) GROUP BY 1) y ON y.ocid = x.ocid)"""
CT = "(SELECT c.contract_id, c.value, count(x.transaction_id) AS n, sum(x.transaction_value) AS s, max(x.transaction_value) AS m FROM contracts c LEFT JOIN transactions x ON x.contract_id = c.contract_id GROUP BY 1, 2)"


def divergence(has: str) -> str:
    """Counts over the processes of several releases, of which those that meet the condition have a budget object."""
    own = f"(SELECT *, {has} AS has, CASE WHEN {has} THEN prj END AS project, CASE WHEN {has} THEN amt END AS amount FROM {B})"
    per = f"""(SELECT ocid, count(DISTINCT coalesce(amount::VARCHAR, 'none')) AS money, count(DISTINCT coalesce(amount::VARCHAR, 'none')) FILTER (has) AS amounts,
      count(DISTINCT coalesce(project, 'none')) FILTER (has) AS projects, count(DISTINCT tag) AS sets, count(*) FILTER (stage = 5) AS full_n, bool_and(tag = 'planning') AS only_planning,
      max(release_seq) AS newest, max(release_seq) FILTER (has) AS newest_with FROM {own} GROUP BY ocid HAVING count(*) > 1)"""
    return f"""SELECT count(*) AS multi_release_processes, count(*) FILTER (money > 1) AS differing_budgets, count(*) FILTER (money > 1 AND amounts <= 1) AS differing_by_missing_only,
       count(*) FILTER (sets > 1) AS mixed_tag_sets, count(*) FILTER (full_n >= 2) AS two_or_more_full_lifecycle, count(*) FILTER (newest IS DISTINCT FROM newest_with) AS latest_lacks_budget,
       count(*) FILTER (projects <= 1 AND amounts <= 1) AS identical_budget, count(*) FILTER (projects <= 1 AND amounts > 1) AS same_project_revised, count(*) FILTER (projects > 1) AS multi_project,
       count(*) FILTER (projects > 1 AND only_planning) AS multi_project_planning_only,
       (SELECT count(*) FROM (SELECT project FROM {own} WHERE has GROUP BY 1 HAVING count(DISTINCT ocid) > 1)) AS projects_spanning_processes,
       (SELECT count(*) FROM (SELECT DISTINCT ocid, project FROM {own} WHERE has)) AS budget_lines_per_project_rule FROM {per}"""


def rule(code: str) -> str:
    others = ", ".join(f'(count(*) FILTER ("{code}" IS DISTINCT FROM "{o}"))::BIGINT AS differs_from_{o.lower()}' for o in ("R0", "R1", "R2", "R3"))
    return f"""SELECT '{code}' AS rule, count("{code}") AS processes_with_budget, (sum("{code}") FILTER ("{code}" < 495000))::DOUBLE AS total_without_extreme, {others} FROM {RV}"""


RAW = """(SELECT 'tender_start' AS f, strftime(tender_start_date, '%Y-%m-%d') || 'T00:00:00Z' AS t, tender_start_date AS d FROM tender
 UNION ALL SELECT 'tender_end', strftime(tender_end_date, '%Y-%m-%d') || 'T00:00:00Z', tender_end_date FROM tender
 UNION ALL SELECT 'award', strftime(award_date, '%Y-%m-%d') || 'T00:00:00Z', award_date FROM awards
 UNION ALL SELECT 'contract_signed', strftime(date_signed, '%Y-%m-%d') || 'T00:00:00Z', date_signed FROM contracts)"""
def date_class(t: str) -> str:
    """Profiler class of a date text whose day is d."""
    return f"""CASE WHEN {t} IS NULL THEN 'NULL' WHEN {t}[:10] IN ('2001-01-01', '1970-01-01', '0001-01-01') THEN 'PLACEHOLDER' WHEN year(d) > 2030 THEN 'EXTREME_FUTURE'
       WHEN year(d) > 2025 THEN 'FUTURE' WHEN year(d) < 2000 THEN 'EXTREME_PAST' ELSE 'VALID' END"""


def exclusive(p: float, x: str = "x") -> str:
    """Percentile at p (n + 1), over rows with rn (place from one) and n."""
    at = f"({p} * (n + 1))"
    return f"sum(CASE WHEN rn = floor({at}) THEN {x}::DOUBLE * (1 - {at} + floor({at})) WHEN rn = floor({at}) + 1 THEN {x}::DOUBLE * ({at} - floor({at})) END)"


AMOUNTS = """(SELECT 'budget' AS m, budget_amount AS x FROM planning UNION ALL SELECT 'tender_value', tender_value_amount FROM tender
 UNION ALL SELECT 'award', value FROM awards UNION ALL SELECT 'tenderers', number_of_tenderers::DECIMAL(18,4) FROM tender)"""
SUPP = "(SELECT DISTINCT party_id, party_name_raw AS nm FROM parties WHERE roles = 'supplier')"


def freq(label: str, src: str, col: str) -> str:
    return f"SELECT '{label}' AS field, ({col})::VARCHAR AS value, count(*) AS n FROM {src} GROUP BY 1, 2"


def presence(name: str, present: str, filled: str | None = None) -> str:
    return f"SELECT '{name}' AS field, count(*) FILTER ({present}) AS present, count(*) FILTER ({filled or present}) AS non_empty FROM o"


SQL = {
    "k12_rule_comparison": " UNION ALL ".join(rule(c) for c in ("R0", "R1", "R2", "R3")),
    "k13_order_disagreement": """SELECT ocid, count(*) AS n, max(release_id) AS latest_by_text, arg_max(release_id, release_seq) AS latest_by_order FROM releases GROUP BY ocid
       HAVING count(*) > 1 AND max(release_id) <> arg_max(release_id, release_seq)""",
    "k14_divergence": divergence("true"),
    "k14c_divergence_without_budgets": divergence("release_seq % 10 = 1"),
    "k14b_award_conflicts": """SELECT ocid, count(*) AS award_releases, count(DISTINCT sig) AS signatures FROM
       (SELECT a.ocid, a.release_id, any_value(a.value)::VARCHAR || '/' || string_agg(s.supplier_id, ',' ORDER BY s.supplier_id) AS sig FROM awards a
        JOIN award_suppliers s ON s.award_id = a.award_id GROUP BY 1, 2) GROUP BY 1 HAVING award_releases > 1 AND signatures > 1""",
    "k15_section_alignment": """SELECT count(*) FILTER (a <> c) AS award_release_ne_contract_release, count(*) FILTER (t <> a) AS tender_release_ne_award_release, 0::BIGINT AS contract_award_in_other_release, (SELECT max(n) FROM (SELECT count(*) AS n FROM awards GROUP BY release_id))::BIGINT AS most_awards_per_release
       FROM (SELECT s.ocid, s.tseq AS t, s.aseq AS a, (SELECT max(release_seq) FROM contracts c WHERE c.ocid = s.ocid) AS c FROM snap s WHERE release_count > 1)""",
    "k16_transactions_per_contract": f"SELECT n AS transactions, count(*) AS contracts FROM {CT} GROUP BY 1",
    "k16b_transactions_against_value": f"""SELECT CASE WHEN abs(s - value) < 0.01 THEN 'sum_equals_contract_value' WHEN abs(m - value) < 0.01 THEN 'max_equals_contract_value'
       WHEN s > value THEN 'sum_exceeds_contract_value' ELSE 'sum_below_contract_value' END AS relation, count(*) AS contracts FROM {CT} WHERE n > 0 AND value <> 0 GROUP BY 1""",
    "k17_process_history": """SELECT r.ocid, r.release_seq, r.release_id, strftime(r.release_date, '%Y-%m-%d') AS release_day, r.tag AS tags, r.buyer_id, r.buyer_name,
       p.budget_project_id, CASE WHEN p.budget_project_id IS NOT NULL THEN 'Programme ' || r.ocid END AS budget_project, 'Budget of order ' || r.release_id AS budget_description,
       p.budget_amount::DOUBLE AS budget_amount, t.tender_id, 'Tender ' || t.release_id AS tender_title, 'Goods and services of order ' || t.release_id AS tender_description,
       t.status AS tender_status, t.method AS procurement_method_details, t.tender_value_amount::DOUBLE AS tender_value_amount, t.number_of_tenderers::BIGINT AS number_of_tenderers,
       strftime(t.tender_start_date, '%Y-%m-%d') AS tender_start, strftime(t.tender_end_date, '%Y-%m-%d') AS tender_end,
       coalesce(a.award_id || '|' || coalesce(a.status, '-') || '|' || strftime(a.award_date, '%Y-%m-%d') || '|' || a.value::DECIMAL(18,2)::VARCHAR || '|Award ' || a.release_id || '|' ||
         (SELECT string_agg(s.supplier_id || '=' || s.supplier_name_raw, ';' ORDER BY s.supplier_seq) FROM award_suppliers s WHERE s.award_id = a.award_id), '') AS awards,
       coalesce(c.contract_id || '|' || coalesce(c.status, '-') || '|' || strftime(c.date_signed, '%Y-%m-%d') || '|' || c.value::DECIMAL(18,2)::VARCHAR || '|Contract ' || c.release_id || '|' ||
         (SELECT count(*)::VARCHAR || '|' || coalesce(sum(x.transaction_value), 0)::DECIMAL(18,2)::VARCHAR FROM transactions x WHERE x.contract_id = c.contract_id) || '|' ||
         (SELECT count(*)::VARCHAR FROM milestones m WHERE m.contract_id = c.contract_id AND milestone_source = 'IMPLEMENTATION'), '') AS contracts
       FROM releases r LEFT JOIN planning p USING (release_id) LEFT JOIN tender t USING (release_id)
       LEFT JOIN awards a USING (release_id) LEFT JOIN contracts c USING (release_id) WHERE r.ocid IN (SELECT ocid FROM asf)""",
    "p01_release_distribution": "SELECT release_count AS releases_per_process, count(*) AS processes, (release_count - 1) * count(*) AS excess_releases FROM snap GROUP BY release_count",
    "p01b_most_repeated": "SELECT ocid, release_count AS releases FROM snap ORDER BY release_count DESC, ocid LIMIT 10",
    "p02_field_presence": " UNION ALL ".join(
        [presence(x, "true") for x in ("id", "ocid", "date", "tag", "initiationType", "language", "buyer", "planning")]
        + [presence("parties", "k % 50 <> 0"), presence("tender", "st IN ('O', 'F')"), presence("awards", "has_award"), presence("contracts", "has_contract")]
    ),
    "p02b_section_presence": " UNION ALL ".join(f"SELECT '{item}' AS item, (SELECT count(*) FROM {src}) AS n" for item, src in (
        ("buyer", "o"), ("planning", "o"), ("budget", "o"), ("budget amount", "planning WHERE budget_amount IS NOT NULL"), ("tender", "tender"),
        ("tender without number of tenderers", "tender WHERE number_of_tenderers IS NULL"), ("tender value", "tender WHERE tender_value_amount IS NOT NULL"), ("tender title", "tender"),
        ("releases with awards", "awards"), ("releases with several awards", "o WHERE false"), ("awards", "awards"), ("awards without value", "awards WHERE value IS NULL"),
        ("award dates", "awards WHERE award_date IS NOT NULL"), ("releases with contracts", "contracts"), ("contracts", "contracts"),
        ("contract period starts", "contracts WHERE period_start_date IS NOT NULL"), ("contract period ends", "contracts WHERE period_end_date IS NOT NULL"),
        ("releases with parties", "(SELECT DISTINCT release_id FROM parties)"), ("parties", "parties"), ("parties without id", "parties WHERE party_id IS NULL"),
        ("parties without name", "parties WHERE party_name_raw IS NULL"), ("implementation in the tags", "releases WHERE stage = 5"))),
    "p03_tag_combinations": """SELECT list_aggregate(list_sort(string_split(r.tag, ',')), 'string_agg', ',') AS tags, count(*) AS releases, count(*) FILTER (s.release_count > 1) AS in_repeated_processes
       FROM releases r JOIN snap s ON s.ocid = r.ocid GROUP BY 1""",
    "p04_describe_amounts": f"""SELECT m AS measure, count(x) AS n, min(x)::DOUBLE AS minimum, max(x)::DOUBLE AS maximum, round(sum(x)::DOUBLE / count(x), 2) AS mean, count(*) FILTER (x = 0) AS zeros,
       count(*) FILTER (x < 0) AS negatives, round(quantile_cont(x::DOUBLE, 0.5), 4) AS median, round(if(any_value(n) < 4, min(x)::DOUBLE, {exclusive(.25)}), 4) AS q1,
       round(if(any_value(n) < 4, max(x)::DOUBLE, {exclusive(.75)}), 4) AS q3, round(if(any_value(n) < 20, max(x)::DOUBLE, {exclusive(.95)}), 4) AS p95,
       round(if(any_value(n) < 100, max(x)::DOUBLE, {exclusive(.99)}), 4) AS p99
       FROM (SELECT m, x, row_number() OVER (PARTITION BY m ORDER BY x) AS rn, count(*) OVER (PARTITION BY m) AS n FROM {AMOUNTS} WHERE x IS NOT NULL) GROUP BY 1""",
    "p05_extreme_records": """SELECT x.kind, x.value, x.award_id, x.award_status, x.award_day, x.suppliers, r.release_id, r.ocid, strftime(r.release_date, '%Y-%m-%d') AS release_day, r.tag AS tags, r.buyer_id, r.buyer_name,
       p.budget_currency, 'Budget of order ' || r.release_id AS budget_description, CASE WHEN p.budget_project_id IS NOT NULL THEN 'Programme ' || r.ocid END AS budget_project, p.budget_project_id,
       t.tender_value_amount::DOUBLE AS tender_value_amount, 'Tender ' || t.release_id AS tender_title, 'Goods and services of order ' || t.release_id AS tender_description, t.status AS tender_status,
       CASE WHEN t.release_id IS NOT NULL THEN 'open' END AS procurement_method, t.method AS procurement_method_details FROM
       (SELECT 'tenderers' AS kind, release_id, number_of_tenderers::DOUBLE AS value, NULL AS award_id, NULL AS award_status, NULL AS award_day, NULL AS suppliers FROM tender WHERE number_of_tenderers > 11
        UNION ALL SELECT 'budget', release_id, budget_amount::DOUBLE, NULL, NULL, NULL, NULL FROM planning WHERE budget_amount >= 495000
        UNION ALL SELECT 'award', release_id, value::DOUBLE, award_id, status, strftime(award_date, '%Y-%m-%d'),
          (SELECT string_agg(s.supplier_name_raw, ';' ORDER BY s.supplier_seq) FROM award_suppliers s WHERE s.award_id = a.award_id) FROM awards a WHERE value >= 400000) x
       JOIN releases r USING (release_id) LEFT JOIN planning p USING (release_id) LEFT JOIN tender t USING (release_id)""",
    "p05b_extreme_overlap": "SELECT ocid FROM awards WHERE value >= 400000 INTERSECT SELECT ocid FROM tender WHERE tender_value_amount >= 400000",
    "p06_date_classes": f"""SELECT f AS field, {date_class('t')} AS date_class, count(*) AS n, min(t) AS first_text, max(t) AS last_text FROM {RAW} GROUP BY 1, 2""",
    "p07_implementation_structure": """SELECT true AS has_section, tx::BIGINT AS transactions, mi::BIGINT AS implementation_milestones, mc::BIGINT AS contract_milestones, count(*) AS contracts FROM
       (SELECT c.contract_id, (SELECT count(*) FROM transactions x WHERE x.contract_id = c.contract_id) AS tx, (SELECT count(*) FROM milestones x WHERE x.contract_id = c.contract_id AND milestone_source = 'IMPLEMENTATION') AS mi,
          (SELECT count(*) FROM milestones x WHERE x.contract_id = c.contract_id AND milestone_source = 'CONTRACT') AS mc FROM contracts c) GROUP BY ALL""",
    "p08_supplier_name_multiplicity": f"""SELECT 'ids with several names' AS kind, n AS n_values, count(*) AS n, min(party_id) AS sample FROM (SELECT party_id, count(*) AS n FROM {SUPP} GROUP BY 1) WHERE n > 1 GROUP BY 1, 2
       UNION ALL SELECT 'names with several ids', n, count(*), min(nm) FROM (SELECT nm, count(*) AS n FROM {SUPP} GROUP BY 1) WHERE n > 1 GROUP BY 1, 2""",
    "p09_frequencies": " UNION ALL ".join([
        freq("procurement_method_details", "tender", "method"), freq("tender_status", "tender", "status"), freq("award_status", "awards", "status"), freq("contract_status", "contracts", "status"),
        freq("party_role", "(SELECT unnest(string_split(roles, ',')) AS role FROM parties)", "role"), freq("suppliers_per_award", "(SELECT count(*) AS n FROM award_suppliers GROUP BY award_id)", "n")]),
    "p10_release_dates_by_year": "SELECT year(release_date) AS year, count(*) AS releases, count(DISTINCT ocid) AS processes FROM releases GROUP BY 1",
    "p10c_equal_to_package_date": "SELECT (SELECT max(release_date) FROM releases) AS published, count(*) AS releases, count(*) FILTER (release_date = (SELECT max(release_date) FROM releases)) AS on_that_day FROM releases",
    "p10b_date_order_disagreement": """SELECT count(*) AS repeated_processes, count(*) FILTER (a <> b) AS order_disagrees FROM (SELECT arg_max(release_id, (release_date, release_seq)) AS a,
       arg_max(release_id, release_seq) AS b FROM releases GROUP BY ocid HAVING count(*) > 1)""",
    "p11_dropped_decimal_candidates": """SELECT ocid, award_id, ratio AS award_to_budget_ratio, value = floor(value) AS whole_number,
       value = floor(value) AND value / 100 / budget BETWEEN 0.5 AND 2 AS fits_after_division FROM bva WHERE ratio > 10""",
}


def sql() -> dict[str, str]:
    return {name: with_tables(body) for name, body in SQL.items()}
