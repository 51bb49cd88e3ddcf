"""Exclusion attribution: candidates with their tripped rules, then the matrix built row by row."""

from __future__ import annotations

from oracle.labels import ALL_REASONS, ISSUE_META, METRIC_META
from oracle.prelude import CTES, with_tables

T_IDS = "s.buyer_id = 'B-7'"


def issues(**rules: str) -> str:
    cases = ", ".join(f"CASE WHEN {c} THEN '{ref.replace('_', '-')}' END" for ref, c in rules.items())
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


def dates(f1: str, f2: str, d1: str, d2: str) -> str:
    late = "('FUTURE', 'IMPOSSIBLE')"
    return issues(
        DQ_08=f"{f1} = 'PLACEHOLDER' OR {f2} = 'PLACEHOLDER'",
        DQ_09=f"{f1} IN {late} OR {f2} IN {late}",
        DATE_ORDER=f"{f1} = 'VALID' AND {f2} = 'VALID' AND {d2} < {d1}",
    )


NOVAL = "NULL::DECIMAL(18,4)"
SNAP_T = "process_snapshot s JOIN tender t ON t.release_id = s.tender_release_id"
REC = f"""
SELECT 'M-P01' AS m, s.budget_amount AS val, {issues(DQ_06='s.budget_amount >= 495000', DQ_16='s.budget_amount = 0', DQ_18='s.party_flag IS NOT NULL', DQ_19="s.buyer_id = 'B-'")} AS iss,
  s.budget_amount IS NULL AS oth, {T_IDS} AS test FROM budget_lines s WHERE s.buyer_id IS NOT NULL
UNION ALL SELECT 'M-C01 / M-C02', {NOVAL}, {issues(DQ_04="t.tenderer_count_flag = 'ELEVATED'", DQ_05="t.tenderer_count_flag = 'ANOMALOUS'")}, t.status IS NULL, {T_IDS} FROM {SNAP_T}
UNION ALL SELECT 'M-V01', a.value, {issues(DQ_07='a.value >= 600000', DQ_16='a.value = 0')}, coalesce(a.status, '') <> 'active', {T_IDS} FROM process_snapshot s JOIN awards a ON a.award_id = s.award_id
UNION ALL SELECT 'M-S01', w.value, {issues(DQ_14="w.award_id NOT IN (SELECT award_id FROM asup WHERE supplier_id <> 'S-') AND w.award_id IN (SELECT award_id FROM asup)")},
  w.award_id NOT IN (SELECT award_id FROM asup), false FROM awv w
UNION ALL SELECT 'P4-BvA', w.value, {issues(C_06='w.budget_line_count > 1', DQ_06='b.budget_amount >= 495000', DQ_16='b.budget_amount = 0')},
  w.budget_line_count = 0 OR (w.budget_line_count = 1 AND b.budget_amount IS NULL), false FROM awv w LEFT JOIN budget_lines b ON b.ocid = w.ocid AND w.budget_line_count = 1
UNION ALL SELECT 'M-E01', {NOVAL}, {dates('t.tender_start_date_flag', 't.tender_end_date_flag', 't.tender_start_date', 't.tender_end_date')},
  t.tender_start_date IS NULL OR t.tender_end_date IS NULL, {T_IDS} FROM {SNAP_T}
UNION ALL SELECT 'M-E02', {NOVAL}, {dates('t.tender_start_date_flag', 'a.award_date_flag', 't.tender_start_date', 'a.award_date')},
  t.tender_start_date IS NULL OR a.award_date IS NULL, {T_IDS} FROM {SNAP_T} JOIN awards a ON a.award_id = s.award_id
UNION ALL SELECT 'P5-SIG', {NOVAL}, {dates('a.award_date_flag', 'c.date_signed_flag', 'a.award_date', 'c.date_signed')},
  a.award_date IS NULL OR c.date_signed IS NULL, {T_IDS} FROM process_snapshot s JOIN contracts c ON c.contract_id = s.contract_id LEFT JOIN awards a ON a.award_id = s.award_id
UNION ALL SELECT 'ENTITY', {NOVAL}, {issues(DQ_19="s.buyer_id = 'B-'")}, false, {T_IDS} FROM dim_buyer s"""

ELIG = """
SELECT 'M-P01' AS m, count(*) AS n, sum(budget_amount)::DOUBLE AS v FROM budget_eligible
UNION ALL SELECT 'M-C01 / M-C02', count(*), NULL FROM competition WHERE prim
UNION ALL SELECT 'M-V01', count(*), sum(value)::DOUBLE FROM awv
UNION ALL SELECT 'M-S01', count(DISTINCT award_id), sum(value)::DOUBLE FROM sav
UNION ALL SELECT 'P4-BvA', count(*), sum(value)::DOUBLE FROM bva
UNION ALL SELECT 'M-E01', count(*), NULL FROM tde
UNION ALL SELECT 'M-E02', count(*), NULL FROM ale
UNION ALL SELECT 'P5-SIG', count(*), NULL FROM sle
UNION ALL SELECT 'ENTITY', count(*), NULL FROM eb"""

DISC = """
SELECT 'ALL' AS m, 'DQ-01' AS ref, count(*) AS c, count(*) FILTER (release_count > 1) AS n, NULL::DOUBLE AS av, NULL::DOUBLE AS ev FROM ps
UNION ALL SELECT 'M-E03', 'DQ-02', count(*), count(*) FILTER (stage = 1), NULL, NULL FROM ps
UNION ALL SELECT 'M-S01', 'DQ-13', count(*), count(*) FILTER (name_variant_count > 1), (sum(value) FILTER (name_variant_count > 1))::DOUBLE, sum(value)::DOUBLE FROM sav
UNION ALL SELECT 'M-I01', unnest(['DQ-11', 'DQ-12']), count(*), count(*) FILTER (tx > 0), NULL, NULL FROM cic"""

IMP = """
SELECT t.m, h.ref, h.kind, t.c, e.n AS e, h.n, h.lost, h.av::DOUBLE AS av, e.v AS ev FROM
 (SELECT m, ref, CASE WHEN ref = 'DQ-04' THEN 'EXCLUDES_FROM_PRIMARY' ELSE 'EXCLUDES' END AS kind, count(*) AS n,
         count(*) FILTER (len(iss) = 1 AND NOT oth) AS lost, sum(val) AS av
    FROM (SELECT *, unnest(iss) AS ref FROM rec WHERE NOT test) GROUP BY 1, 2
  UNION ALL SELECT m, 'OTHER', 'SUMMARY_OTHER', count(*), count(*) FILTER (len(iss) = 0), sum(val) FROM rec WHERE NOT test AND oth GROUP BY 1
  UNION ALL SELECT m, 'ALL', 'SUMMARY_ALL', count(*) FILTER (oth OR len(iss) > 0), NULL, sum(val) FILTER (oth OR len(iss) > 0) FROM rec WHERE NOT test GROUP BY 1
  UNION ALL SELECT m, 'DQ-20', 'PRE_EXCLUDED', count(*), NULL, sum(val) FROM rec WHERE test GROUP BY 1) h
 JOIN (SELECT m, count(*) AS c FROM rec WHERE NOT test GROUP BY 1) t ON t.m = h.m JOIN elig e ON e.m = h.m
UNION ALL SELECT m, ref, 'DISCLOSED', c, c, n, NULL, av, ev FROM disc"""


def text(x) -> str:
    return "'" + str(x).replace("'", "''") + "'"


META = "(VALUES " + ", ".join(f"({text(a)}, {b}, {text(c)}, {text(d)})" for a, b, c, d in METRIC_META) + ") mm(m, ord, name, grain)"
ISSUE = "(VALUES " + ", ".join(f"({', '.join(text(x) for x in row)})" for row in ISSUE_META) + ") ii(ref, dq_issue, treatment, note)"

CTES += [
    ("rec", REC),
    ("elig", ELIG),
    ("disc", DISC),
    ("imp", IMP),
    (
        "dqi",
        f"""SELECT mm.ord AS metric_order, imp.m AS metric_id, mm.name AS metric_name, mm.grain, imp.ref AS dq_ref,
           CASE WHEN imp.ref = 'ALL' THEN {text(ALL_REASONS)} ELSE ii.dq_issue END AS dq_issue, ii.treatment, imp.kind AS impact_type,
           imp.c AS candidate_records, imp.e AS eligible_records, imp.n AS records_with_issue, imp.lost AS records_lost_only_to_issue,
           round(100.0 * imp.n / nullif(imp.c, 0)::DOUBLE, 2) AS pct_of_candidate, imp.av AS affected_value_ngn, imp.ev AS eligible_value_ngn, ii.note
         FROM imp JOIN {META} ON mm.m = imp.m LEFT JOIN {ISSUE} ON ii.ref = imp.ref""",
    ),
    (
        "graded",
        """SELECT *, 100 * affected_value_ngn / (eligible_value_ngn + CASE WHEN impact_type = 'DISCLOSED' THEN 0 ELSE coalesce(
             max(CASE WHEN dq_ref = 'ALL' THEN affected_value_ngn END) OVER (PARTITION BY metric_id), 0) END) AS vp FROM dqi""",
    ),
]

LEVEL = "CASE WHEN {x} >= 10 THEN 'HIGH' WHEN {x} >= 1 THEN 'MODERATE' ELSE 'LOW' END"
DQI_COLS = """metric_order::BIGINT AS metric_order, metric_id, metric_name, grain, dq_ref, dq_issue, treatment, impact_type, candidate_records, eligible_records,
 records_with_issue, records_lost_only_to_issue, pct_of_candidate, affected_value_ngn, eligible_value_ngn, note"""

SQL = {
    "d01_candidate_records": "SELECT m AS metric_id, val::DOUBLE AS val, array_to_string(iss, ',') AS issues, oth AS other_reason, test AS is_pre FROM rec",
    "d02_pre_exclusion": "SELECT m AS metric_id, count(*) AS test_records, sum(val)::DOUBLE AS test_value FROM rec WHERE test GROUP BY 1",
    "d03_issue_hits": "SELECT m AS metric_id, ref AS dq_ref, n AS records_with_issue, lost AS records_lost_only_to_issue, av AS affected_value FROM imp WHERE kind LIKE 'EXCLUDES%'",
    "d04_metric_totals": "SELECT m AS metric_id, ref AS dq_ref, c AS candidate_records, n AS records_with_issue, lost AS records_lost_only_to_issue, av AS affected_value FROM imp WHERE kind LIKE 'SUMMARY%'",
    "d05_eligible_side": "SELECT m AS metric_id, n AS eligible_records, v AS eligible_value FROM elig",
    "d06_disclosures": "SELECT m AS metric_id, ref AS dq_ref, c AS candidate_records, n AS records_with_issue, av AS affected_value, ev AS eligible_value FROM disc",
    "d08_invariants": """SELECT metric_id, max(candidate_records) FILTER (dq_ref = 'ALL') - max(eligible_records) FILTER (dq_ref = 'ALL') AS candidate_minus_eligible,
       max(records_with_issue) FILTER (dq_ref = 'ALL') AS excluded,
       (coalesce(sum(records_lost_only_to_issue), 0))::BIGINT AS single_cause, true AS reconciles
       FROM dqi WHERE impact_type NOT IN ('DISCLOSED', 'PRE_EXCLUDED') GROUP BY metric_id""",
    "d07_dq_impact": f"SELECT {DQI_COLS} FROM dqi",
    "v13_dq_impact": f"SELECT {DQI_COLS} FROM dqi",
    "q7_1_exclusions_by_metric": """SELECT metric_order::BIGINT AS metric_order, metric_id, metric_name, c AS candidate_records, e AS eligible_records, round(100 * e / c::DOUBLE, 1) AS eligible_pct, x AS excluded_records,
       one::BIGINT AS lost_to_one_dq_issue_only, oth::BIGINT AS lost_to_non_dq_rule_only, (x - one - oth)::BIGINT AS lost_to_two_or_more_reasons, if(c - e = x, 'yes', 'NO') AS reconciles_candidate_minus_eligible
       FROM (SELECT metric_order, metric_id, metric_name, max(candidate_records) AS c, max(eligible_records) AS e, max(records_with_issue) FILTER (dq_ref = 'ALL') AS x,
          coalesce(sum(records_lost_only_to_issue) FILTER (impact_type LIKE 'EXCLUDES%'), 0) AS one, coalesce(sum(records_lost_only_to_issue) FILTER (dq_ref = 'OTHER'), 0) AS oth
          FROM dqi WHERE impact_type NOT IN ('DISCLOSED', 'PRE_EXCLUDED') GROUP BY 1, 2, 3)""",
    "q7_2_issue_matrix": f"""SELECT metric_id, dq_ref, dq_issue, impact_type, treatment, candidate_records, records_with_issue, pct_of_candidate, records_lost_only_to_issue,
       round(affected_value_ngn / 1000, 1) AS affected_value_k, round(vp, 1) AS value_pct_of_candidate, {LEVEL.format(x='greatest(pct_of_candidate, coalesce(round(vp, 1), 0))')} AS materiality,
       rank() OVER (PARTITION BY metric_id ORDER BY records_with_issue DESC) AS rank_within_metric, note FROM graded WHERE dq_ref NOT IN ('ALL', 'OTHER')""",
    "q7_3_issues_across_metrics": f"""SELECT rank() OVER (ORDER BY h DESC, mo DESC) AS issue_rank, dq_ref, dq_issue, treatment, t AS metrics_touched, h AS metrics_high, mo AS metrics_moderate, metrics_affected
       FROM (SELECT dq_ref, max(dq_issue) AS dq_issue, max(treatment) AS treatment, count(*) AS t, count(*) FILTER (lv = 'HIGH') AS h, count(*) FILTER (lv = 'MODERATE') AS mo,
          string_agg(metric_id || ' (' || lv || ', ' || round(x, 1)::DECIMAL(10,1)::VARCHAR || '% of records or value)', '; ' ORDER BY metric_order) AS metrics_affected
          FROM (SELECT *, {LEVEL.format(x='x')} AS lv FROM (SELECT *, greatest(pct_of_candidate, coalesce(vp, 0)) AS x FROM graded WHERE dq_ref NOT IN ('ALL', 'OTHER'))) GROUP BY dq_ref)""",
}


def sql() -> dict[str, str]:
    return {name: with_tables(body) for name, body in SQL.items()}
