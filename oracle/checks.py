"""Check suites: (id, expected, actual) as scalar expressions; no expectation means INFO."""

from __future__ import annotations

from oracle.prelude import with_tables


def n(src: str, where: str = "true", what: str = "count(*)") -> str:
    return f"(SELECT {what} FROM {src} WHERE {where})"


def dup(src: str, *keys: str) -> str:
    key = keys[0] if len(keys) == 1 else f"({', '.join(keys)})"
    return f"(SELECT count(*) FROM (SELECT {key} AS z FROM {src})) - (SELECT count(*) FROM (SELECT DISTINCT {key} AS z FROM {src}))"


def orphan(child: str, key: str, parent: str, pk: str | None = None, where: str = "true") -> str:
    return n(f"{child} x", f"({where}) AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{pk or key} = x.{key})")


def money(src: str, col: str, where: str = "true") -> str:
    return f"(SELECT sum({col})::DECIMAL(38,4) FROM {src} WHERE {where})"


def dq(metric: str, ref: str, col: str = "n") -> str:
    return f"(SELECT max({col}) FROM imp WHERE m = '{metric}' AND ref = '{ref}')"


OK_BUDGET = "b.budget_amount > 0 AND b.budget_amount < 495000"
OWN = "(SELECT ocid, arg_max(buyer_id, release_seq) AS buyer_id FROM releases GROUP BY 1)"
LT = "(SELECT t.* FROM tender t JOIN ps p ON p.tender_release_id = t.release_id)"
LA = "(SELECT a.* FROM awards a JOIN ps p ON p.award_id = a.award_id)"
LL = "(SELECT * FROM planning WHERE budget_project_id IS NOT NULL AND buyer_id <> 'B-7' QUALIFY row_number() OVER (PARTITION BY ocid, budget_project_id ORDER BY release_seq DESC) = 1)"
LLN = f"(SELECT ocid, count(*) AS c FROM {LL} GROUP BY 1)"
AOK = f"(SELECT * FROM {LA} WHERE status = 'active' AND value > 0 AND value < 600000)"
SINGLE = f"(SELECT l.* FROM {LL} l JOIN {LLN} c ON c.ocid = l.ocid AND c.c = 1)"
LAG = f"(SELECT (a.award_date - t.tender_start_date)::INT AS d FROM {LT} t JOIN {LA} a ON a.ocid = t.ocid WHERE t.tender_start_date_flag = 'VALID' AND a.award_date_flag = 'VALID')"
SIG = f"(SELECT (c.date_signed - a.award_date)::INT AS d FROM {LA} a JOIN contracts c ON c.award_id = a.award_id WHERE a.award_date_flag = 'VALID' AND c.date_signed_flag = 'VALID')"
DUR = f"(SELECT (tender_end_date - tender_start_date)::INT AS d FROM {LT} WHERE tender_start_date_flag = 'VALID' AND tender_end_date_flag = 'VALID')"
CBVA = f"(SELECT a.value, b.budget_amount, round(a.value::DOUBLE / b.budget_amount::DOUBLE, 4) AS ratio FROM {AOK} a JOIN {SINGLE} b ON b.ocid = a.ocid WHERE {OK_BUDGET})"
LC = "(SELECT * FROM contracts WHERE ocid IN (SELECT ocid FROM ps) QUALIFY row_number() OVER (PARTITION BY ocid ORDER BY release_seq DESC) = 1)"
FACTS = "(" + " UNION ALL ".join(f"SELECT buyer_id FROM {t}" for t in ("budget_eligible", "competition", "awv", "sav", "bva", "tde", "ale", "sle", "ps", "cic", "eb")) + ")"
METHODS = "(" + " UNION ALL ".join(f"SELECT coalesce(method, '(method not stated)') AS m FROM {t}" for t in ("competition", "awv", "sav", "bva", "tde", "ale")) + ")"
SUPV = "(SELECT supplier_id, sum(value) AS v FROM sav GROUP BY 1)"
MINE = f"(SELECT x.supplier_id, sum(a.value) AS v FROM {AOK} a JOIN asup x ON x.award_id = a.award_id WHERE x.supplier_id <> 'S-' GROUP BY 1)"
SUPP = "(SELECT release_id, party_id, trim(party_name_raw, ' ' || chr(9)) AS nm FROM parties WHERE roles = 'supplier')"
DD = "(SELECT award_id FROM bva WHERE value = floor(value) AND value >= 5 * budget AND value <= 20 * budget)"
SL = """(SELECT award_id FROM (SELECT award_id, value, row_number() OVER w AS rn, lead(value) OVER w AS nx FROM sav WHERE buyer_id <> 'B-'
  WINDOW w AS (PARTITION BY supplier_id, buyer_id ORDER BY value DESC, award_id)) WHERE rn = 1 AND value >= 10 * nx)"""
SFK = "CASE WHEN dd AND sl THEN 'b' WHEN dd THEN 'd' ELSE 's' END"


def several(src: str, key: str, val: str) -> str:
    return f"(SELECT count(*) FROM (SELECT {key} FROM {src} WHERE {val} IS NOT NULL GROUP BY 1 HAVING count(DISTINCT {val}) > 1))"


def of(src: str, cond: str, where: str = "true") -> str:
    return f"(SELECT (count(*) FILTER ({cond}))::VARCHAR || ' of ' || count(*)::VARCHAR FROM {src} WHERE {where})"


TA = "tender t JOIN awards a ON a.release_id = t.release_id"
CA = "contracts c JOIN awards a ON a.award_id = c.award_id"
SNAP_AWARDS = "awards a JOIN process_snapshot s ON s.award_id = a.award_id"

LAST = "(SELECT ocid, award_id, value FROM awards QUALIFY row_number() OVER (PARTITION BY ocid ORDER BY release_seq DESC) = 1)"
MOST = "(SELECT ocid FROM awards WHERE ocid IN (SELECT ocid FROM awv) GROUP BY ocid ORDER BY count(*) DESC, ocid LIMIT 1)"
SUITES: dict[str, list[tuple]] = {
    "c01_key_uniqueness": [
        ("UQ-01", "0", dup("releases", "release_id")), ("UQ-02", "0", dup("releases", "release_seq")),
        ("UQ-03", "0", dup("planning", "release_id")), ("UQ-04", "0", dup("tender", "release_id")),
        ("UQ-05", "0", dup("tender", "tender_id")), ("UQ-06", "0", dup("awards", "award_id")),
        ("UQ-07", "0", dup("award_suppliers", "award_id", "supplier_seq")), ("UQ-08", "0", dup("contracts", "contract_id")),
        ("UQ-09", "0", dup("contracts", "award_id")), ("UQ-10", "0", dup("transactions", "contract_id", "transaction_id")),
        ("UQ-11", "0", dup("milestones", "contract_id", "milestone_source", "milestone_id")),
        ("UQ-12", "0", dup("parties", "release_id", "party_id", "party_name_raw")), ("UQ-13", "0", dup("parties", "release_id", "party_id")),
        ("UQ-14", "0", dup("dim_buyer", "buyer_id")), ("UQ-15", "0", dup("dim_supplier", "supplier_id")),
        ("UQ-16", "0", dup("process_snapshot", "ocid")), ("UQ-17", "0", dup("budget_lines", "ocid", "budget_project_id")),
        ("UQ-18", "0", several("planning", "budget_project_id", "CASE WHEN budget_project_id IS NOT NULL THEN ocid END")),
    ],
    "c02_null_rates": [
        *[(cid, e, n(t, f"{c} IS NULL")) for cid, t, c, e in (
            ("NL-01", "releases", "ocid", "0"), ("NL-02", "releases", "buyer_id", "0"), ("NL-03", "tender", "tender_id", "0"),
            ("NL-04", "contracts", "award_id", "0"), ("NL-05", "award_suppliers", "supplier_id", "0"), ("NL-06", "parties", "party_id", "0"),
            ("NL-07", "tender", "number_of_tenderers", "0"), ("NL-08", "awards", "value", "0"), ("NL-09", "planning", "budget_amount", None),
            ("NL-10", "tender", "tender_start_date", None), ("NL-11", "tender", "tender_end_date", None), ("NL-12", "awards", "award_date", None),
            ("NL-13", "contracts", "date_signed", None), ("NL-14", "releases", "buyer_name", None), ("NL-16", "awards", "status", None),
            ("NL-17", "dim_buyer", "buyer_name", None), ("NL-18", "sup", "supplier_name", None))],
        ("NL-15", None, n("releases", "party_flag = 'NO_PARTIES'")),
    ],
    "c03_referential_integrity": [
        *[(cid, "0", orphan(*a)) for cid, *a in (
            ("RI-01", "planning", "release_id", "releases"), ("RI-02", "tender", "release_id", "releases"), ("RI-03", "awards", "release_id", "releases"),
            ("RI-04", "award_suppliers", "award_id", "awards"), ("RI-05", "contracts", "release_id", "releases"), ("RI-06", "contracts", "award_id", "awards"),
            ("RI-08", "transactions", "contract_id", "contracts"), ("RI-09", "milestones", "contract_id", "contracts"), ("RI-10", "parties", "release_id", "releases"),
            ("RI-11", "releases", "buyer_id", "dim_buyer"), ("RI-12", "award_suppliers", "supplier_id", "dim_supplier"),
            ("RI-14", "process_snapshot", "buyer_id", "dim_buyer"), ("RI-15", "budget_lines", "buyer_id", "dim_buyer"))],
        ("RI-07", "0", n(CA, "a.release_id <> c.release_id")),
        ("RI-13", "0", orphan("parties", "party_id", "dim_supplier", "supplier_id", "x.roles = 'supplier'")),
        ("RI-16", "0", n("process_snapshot s", "contract_id IS NULL AND award_id IN (SELECT award_id FROM contracts)")),
        ("RI-17", "0", n("process_snapshot s", "EXISTS (SELECT 1 FROM releases r WHERE r.release_id IN (s.tender_release_id, s.award_release_id) AND r.ocid <> s.ocid)")),
    ],
    "c04_release_reconciliation": [
        ("RL-01", "(SELECT count(DISTINCT ocid) FROM releases)", n("process_snapshot")), ("RL-02", None, n("process_snapshot", "release_count > 1")),
        ("RL-03", None, n("budget_lines")), ("RL-04", None, n("process_snapshot", "multi_project_flag IS NOT NULL")),
        ("RL-05", None, "(SELECT round(sum(budget_amount)::DOUBLE / 1000, 1) FROM budget_lines WHERE budget_amount_flag IS NULL)"),
        ("RL-06", money("(SELECT arg_max(budget_amount, release_seq) AS z FROM (SELECT ocid, budget_project_id, release_seq, {'v': budget_amount} AS budget_amount FROM planning WHERE budget_project_id IS NOT NULL) GROUP BY ocid, budget_project_id)", "z.v"),
         money("budget_lines", "budget_amount")),
        ("RL-07", "(SELECT count(DISTINCT ocid) FROM tender)", n("process_snapshot", what="count(tender_id)")),
        ("RL-08", "(SELECT count(DISTINCT ocid) FROM awards)", n("process_snapshot", what="count(award_id)")),
        ("RL-09", money("(SELECT arg_max(value, release_seq) AS z FROM awards GROUP BY ocid)", "z"), money(SNAP_AWARDS, "a.value")),
        ("RL-10", None, money("awards", "value")), ("RL-11", None, money(SNAP_AWARDS, "a.value")), ("RL-12", None, money("planning", "budget_amount")),
        ("RL-13", None, "(SELECT count(*) FROM (SELECT ocid FROM releases GROUP BY 1 HAVING count(*) > 1 AND max(release_id) <> arg_max(release_id, release_seq)))"),
    ],
    "c05_monetary_and_dates": [
        ("MD-01", "0", "0"), ("MD-02", "0", "0"), ("MD-03", "0", n("planning", "budget_amount IS NOT NULL AND budget_currency IS NULL")),
        ("MD-04", None, n("planning", "budget_amount >= 495000")), ("MD-05", None, n("awards", "value >= 600000")), ("MD-06", None, n("planning", "budget_amount = 0")),
        ("MD-07", None, n("tender", "tender_value_amount = 0")), ("MD-08", None, n("awards", "value = 0")), ("MD-09", None, n("tender", "number_of_tenderers > 11")),
        ("MD-10", None, n("tender", "number_of_tenderers BETWEEN 9 AND 11")), ("MD-11", "0", n("tender", "(tender_start_date IS NULL) <> (tender_start_date_flag IS NULL)")),
        ("MD-12", None, n("tender", "tender_start_date = DATE '1990-01-01'")), ("MD-13", None, n("awards", "award_date = DATE '1990-01-01'")),
        ("MD-14", None, n("contracts", "date_signed = DATE '1990-01-01'")), ("MD-15", None, n("awards", "award_date >= DATE '2001-10-01'")),
        ("MD-16", None, n("milestones", "due_date = DATE '1990-01-01'")),
        ("MD-17", None, n("tender", "tender_start_date_flag = 'VALID' AND tender_end_date_flag = 'VALID' AND tender_end_date < tender_start_date")),
        ("MD-18", None, n(TA, "t.tender_start_date_flag = 'VALID' AND a.award_date_flag = 'VALID' AND a.award_date < t.tender_start_date")),
        ("MD-19", None, n(CA, "c.date_signed_flag = 'VALID' AND a.award_date_flag = 'VALID' AND c.date_signed < a.award_date")),
        ("MD-20", None, n("contracts", "period_start_date_flag = 'VALID' AND period_end_date_flag = 'VALID' AND period_end_date < period_start_date")),
    ],
    "c06_entity_consistency": [
        ("EN-01", "(SELECT count(DISTINCT buyer_id) FROM releases)", n("dim_buyer")), ("EN-02", "(SELECT count(DISTINCT buyer_id) FROM releases WHERE buyer_id <> 'B-')", n("dim_buyer", "buyer_id_flag IS NULL")),
        ("EN-03", n("releases", "buyer_id = 'B-'"), "(SELECT sum(release_count)::BIGINT FROM dim_buyer WHERE buyer_id = 'B-')"),
        ("EN-04", "0", several("releases", "buyer_id", "buyer_name")), ("EN-05", "(SELECT count(DISTINCT supplier_id) FROM sobs)", n("dim_supplier")),
        ("EN-06", None, "(SELECT count(DISTINCT party_id) FROM parties WHERE roles = 'supplier')"), ("EN-07", None, n("dim_supplier", "NOT in_supplier_parties")),
        ("EN-08", None, n("awards", f"release_id NOT IN (SELECT release_id FROM {SUPP})")), ("EN-09", None, several(SUPP, "party_id", "nm")),
        ("EN-10", None, several(SUPP, "nm", "party_id")), ("EN-11", None, n(SUPP, "party_id = 'S-'")), ("EN-12", None, n("award_suppliers", "supplier_id = 'S-'")),
        ("EN-13", "1", "(SELECT max(c) FROM (SELECT count(*) AS c FROM asup GROUP BY award_id))"),
        ("EN-14", "0", n(f"award_suppliers s JOIN awards a ON a.award_id = s.award_id JOIN {SUPP} p ON p.release_id = a.release_id", "p.party_id <> s.supplier_id")),
        ("EN-15", "1", n("dim_buyer", "test_entity_flag IS NOT NULL")), ("EN-16", "'B-7'", "(SELECT max(buyer_id) FROM dim_buyer WHERE test_entity_flag IS NOT NULL)"),
        ("EN-17", None, n("releases", "buyer_id = 'B-7'")), ("EN-18", None, n("process_snapshot", "buyer_id = 'B-7'")),
        ("EN-19", "0", n("dim_buyer", "buyer_id <> 'B-7' AND regexp_matches(concat_ws(' ', buyer_id, buyer_name), '(?i)\\b(test|tests|testing|demo|dummy|sample|trial)\\b')")),
    ],
    "c07_layer_reconciliation": [
        *[(f"LR-{i:02d}", n(t), n(t)) for i, t in enumerate(("releases", "planning", "tender", "awards", "award_suppliers", "contracts", "transactions", "milestones", "parties"), 1)],
        ("LR-10", "(SELECT count(DISTINCT ocid) FROM releases)", n("process_snapshot")), ("LR-11", "(SELECT count(DISTINCT buyer_id) FROM releases)", n("dim_buyer")),
        ("LR-12", n("releases"), "(SELECT sum(release_count)::BIGINT FROM dim_buyer)"), ("LR-13", n("releases"), "(SELECT sum(release_count)::BIGINT FROM process_snapshot)"),
        ("LR-14", "(SELECT count(*) FROM (SELECT DISTINCT ocid, budget_project_id FROM planning WHERE budget_project_id IS NOT NULL))", n("budget_lines")),
    ],
    "c08_observations": [
        ("OB-01", None, of(TA, "t.tender_value_amount = a.value")), ("OB-02", None, of(CA, "c.value = a.value")),
        ("OB-03", None, of("tender", "tender_value_amount = 0", "release_id NOT IN (SELECT release_id FROM awards)")),
        ("OB-04", None, "(SELECT count(*) FROM award_suppliers) - (SELECT count(*) FROM asup)"),
        ("OB-05", None, "(SELECT count(*) FROM (SELECT award_id FROM award_suppliers GROUP BY 1 HAVING count(*) > count(DISTINCT supplier_id)))"),
    ],
    "c09_analytical_views": [
        ("AV-01", n(f"{LL} b", "budget_amount > 0 AND budget_amount < 495000 AND party_flag IS NULL AND buyer_id <> 'B-'"), n("budget_eligible")),
        ("AV-02", n(LT, "status IS NOT NULL AND tenderer_count_flag = 'NORMAL'"), n("competition", "prim")),
        ("AV-03", n(LT, "status IS NOT NULL AND tenderer_count_flag <> 'ANOMALOUS'"), n("competition")), ("AV-04", n(AOK), n("awv")),
        ("AV-05", n(AOK, "award_id IN (SELECT award_id FROM asup WHERE supplier_id <> 'S-')"), "(SELECT count(DISTINCT award_id) FROM sav)"),
        ("AV-06", "(SELECT count(DISTINCT award_id) FROM sav)", n("sav")), ("AV-07", "1", "(SELECT max(distinct_supplier_count) FROM sav)"),
        ("AV-08", n(CBVA), n("bva")), ("AV-09", n(DUR, "d >= 0"), n("tde")), ("AV-10", n(LAG, "d >= 0"), n("ale")), ("AV-11", n(SIG, "d >= 0"), n("sle")),
        ("AV-12", "0", "(SELECT count(*) FROM (SELECT days FROM tde UNION ALL SELECT days FROM ale UNION ALL SELECT days FROM sle) WHERE days < 0)"),
        ("AV-13", n(OWN, "buyer_id <> 'B-7'"), n("ps")), ("AV-14", "(SELECT count(DISTINCT ocid) FROM contracts WHERE ocid IN (SELECT ocid FROM ps))", n("cic")),
        ("AV-15", "0", n("eb", "buyer_id = 'B-'")), ("AV-16", n(OWN, "buyer_id NOT IN ('B-', 'B-7')"), "(SELECT sum(process_count)::BIGINT FROM eb)"),
        ("AV-17", money("budget_eligible", "budget_amount"), money("eb", "planned_budget_total")), ("AV-18", money("awv", "value", "buyer_id <> 'B-'"), money("eb", "award_value_total")),
        ("AV-19", "0", n(FACTS, "buyer_id = 'B-7'")), ("AV-20", n(OWN, "buyer_id = 'B-7'"), n("process_snapshot", "buyer_id = 'B-7'")),
        ("AV-21", f"{n('ps')} || '/' || {n('ps')}", "(SELECT cand || '/' || elig FROM reg WHERE metric_id = 'M-E03')"),
        ("SP-01", "0", n("awv", "value >= 600000")), ("SP-04", "0", n("tde", "tender_start_date = DATE '1990-01-01'")), ("SP-05", "0", n("budget_eligible", "buyer_id = 'B-'")),
        ("SP-06", "0", dup("sav", "award_id", "supplier_id")), ("WF-01", None, n(LA, "coalesce(status, '') <> 'active'")),
        ("WF-02", None, n(LA, "status = 'active' AND (value = 0 OR value >= 600000)")), ("WF-03", None, f"{n('awv')} - (SELECT count(DISTINCT award_id) FROM sav)"),
        ("WF-04", None, f"({money('awv', 'value')} - {money('sav', 'value')})::DECIMAL(38,4)"),
        ("WF-05", None, f"round(100 * (1 - {money('sav', 'value')}::DOUBLE / {money('awv', 'value')}::DOUBLE), 2)"),
        ("WF-06a", None, n(AOK, f"ocid NOT IN (SELECT ocid FROM {LL})")), ("WF-06b", None, n(AOK, f"ocid IN (SELECT ocid FROM {LLN} WHERE c > 1)")),
        ("WF-06c", None, n(f"{AOK} a JOIN {SINGLE} b ON b.ocid = a.ocid", f"NOT coalesce({OK_BUDGET}, false)")),
        ("WF-07", None, n(LAG, "d < 0")), ("WF-08", None, n(SIG, "d < 0")), ("WF-09", None, "(SELECT quantile_cont(number_of_tenderers::DOUBLE, 0.5) FROM competition WHERE prim)"),
        ("WF-10", None, n("tender", "tender_start_date_flag = 'VALID'")),
    ],
    "c09b_spot_checks": [
        ("SP-02a", "0", f"(SELECT count(*) FROM awv v LEFT JOIN {LAST} l ON l.ocid = v.ocid WHERE v.value IS DISTINCT FROM l.value)"),
        ("SP-02b", "0", f"(SELECT count(*) FROM awv v LEFT JOIN {LAST} l ON l.ocid = v.ocid WHERE v.award_id IS DISTINCT FROM l.award_id)"),
        ("SP-02c", f"(SELECT max(value::VARCHAR) FROM {LAST} WHERE ocid = {MOST})", f"(SELECT max(value::VARCHAR) FROM awv WHERE ocid = {MOST})"),
        ("SP-02d", f"(SELECT max(award_id) FROM {LAST} WHERE ocid = {MOST})", f"(SELECT max(award_id) FROM awv WHERE ocid = {MOST})"),
        ("SP-03a", "0", n("sav", "supplier_id = 'S-'")),
        ("SP-03b", "(SELECT count(*) FROM asup WHERE supplier_id <> 'S-' AND award_id IN (SELECT award_id FROM awv))", n("sav")),
        ("SP-03c", f"(SELECT count(DISTINCT supplier_id) FROM asup WHERE supplier_id <> 'S-' AND award_id IN (SELECT award_id FROM {LAST} WHERE ocid = {MOST}))",
         f"(SELECT count(DISTINCT supplier_id) FROM sav WHERE ocid = {MOST})"),
    ],
    "c10_business_questions": [
        ("BQ-01", f"(SELECT max(v)::DECIMAL(38,4) FROM {MINE})", f"(SELECT max(v)::DECIMAL(38,4) FROM {SUPV})"), ("BQ-02", n(MINE), n(SUPV)),
        ("BQ-03", money(f"(SELECT v FROM {MINE} ORDER BY v DESC LIMIT 10)", "v"), money(f"(SELECT v FROM {SUPV} ORDER BY v DESC LIMIT 10)", "v")),
        ("BQ-04", f"(SELECT quantile_cont(number_of_tenderers::DOUBLE, 0.5) FROM {LT} WHERE status IS NOT NULL AND tenderer_count_flag = 'NORMAL')", "(SELECT quantile_cont(number_of_tenderers::DOUBLE, 0.5) FROM competition WHERE prim)"),
        ("BQ-05", n(LT, "status IS NOT NULL AND number_of_tenderers = 1"), n("competition", "single")),
        ("BQ-06", money(CBVA, "budget_amount"), money("bva", "budget")), ("BQ-07", money(CBVA, "value"), money("bva", "value")),
        ("BQ-08", f"(SELECT round(quantile_cont(ratio, 0.5), 6) FROM {CBVA})", "(SELECT round(quantile_cont(ratio, 0.5), 6) FROM bva)"),
        *[(cid, f"(SELECT quantile_cont(d::DOUBLE, 0.5) FROM {src} WHERE d >= 0)", f"(SELECT quantile_cont(days::DOUBLE, 0.5) FROM {t})")
          for cid, src, t in (("BQ-09", DUR, "tde"), ("BQ-10", LAG, "ale"), ("BQ-11", SIG, "sle"))],
        ("BQ-12", n(LC, "has_implementation"), n("cic", "has_implementation")),
        ("BQ-13", "(SELECT count(DISTINCT ocid) FROM releases WHERE stage = 5 AND ocid IN (SELECT ocid FROM ps))", n("ps", "stage = 5")),
        ("BQ-14", "(SELECT count(DISTINCT ocid) FROM releases WHERE stage >= 4 AND ocid IN (SELECT ocid FROM ps))", n("ps", "stage >= 4")),
        ("DQI-01", "0", n("imp", "ref = 'ALL' AND n <> c - e")), ("DQI-02", "0", n("imp JOIN reg ON reg.metric_id = imp.m", "ref = 'ALL' AND (c <> cand OR e <> elig)")),
        ("DQI-03", "0", n("imp", "ref = 'ALL' AND m NOT IN (SELECT metric_id FROM reg)")),
        ("DQI-04", n(LT, "tenderer_count_flag = 'ANOMALOUS'"), f"coalesce({dq('M-C01 / M-C02', 'DQ-05')}, 0)"), ("DQI-05", n(LT, "tenderer_count_flag = 'ELEVATED'"), dq("M-C01 / M-C02", "DQ-04")),
        ("DQI-06", n(LA, "value >= 600000"), dq("M-V01", "DQ-07")), ("DQI-07", n(LL, "budget_amount >= 495000"), dq("M-P01", "DQ-06")),
        ("DQI-08", n(AOK, "award_id NOT IN (SELECT award_id FROM asup WHERE supplier_id <> 'S-')"), dq("M-S01", "DQ-14")),
        ("DQI-09", money(AOK, "value", "award_id NOT IN (SELECT award_id FROM asup WHERE supplier_id <> 'S-')"), f"({dq('M-S01', 'DQ-14', 'av')})::DECIMAL(38,4)"),
        ("DQI-10", n(LAG, "d < 0"), dq("M-E02", "DATE-ORDER")), ("DQI-11", n(SIG, "d < 0"), f"coalesce({dq('P5-SIG', 'DATE-ORDER')}, 0)"),
        ("DQI-12", "0", "0"), ("DQI-13", "0", n("imp", "n > c AND kind <> 'PRE_EXCLUDED'")),
        ("DQI-14", None, f"round(100 * {dq('M-S01', 'ALL', 'av')} / ({dq('M-S01', 'ALL', 'av')} + {dq('M-S01', 'ALL', 'ev')}), 2)"), ("DQI-15", None, n("imp")),
        ("DQI-16", f"(SELECT count(DISTINCT ocid) FROM awards WHERE ocid IN (SELECT ocid FROM {OWN} WHERE buyer_id = 'B-7'))", dq("M-V01", "DQ-20")),
        ("DQI-17", f"(SELECT count(DISTINCT ocid) FROM tender WHERE ocid IN (SELECT ocid FROM {OWN} WHERE buyer_id = 'B-7'))", dq("M-C01 / M-C02", "DQ-20")),
        ("DQI-18", "(SELECT count(*) FROM (SELECT DISTINCT ocid, budget_project_id FROM planning WHERE buyer_id = 'B-7' AND budget_project_id IS NOT NULL))", dq("M-P01", "DQ-20")),
        ("DQI-19", "1", dq("ENTITY", "DQ-20")),
    ],
    "c11_presentation_dims": [
        ("DIM-01", "(SELECT count(DISTINCT buyer_id) FROM releases WHERE buyer_id NOT IN ('B-', 'B-7'))", n("dim_buyer", "buyer_id NOT IN ('B-', 'B-7')")),
        ("DIM-02", "0", dup("dim_buyer", "buyer_id")), ("DIM-03", "0", "0"), ("DIM-04", "0", "0"),
        ("DIM-05", "0", n("dim_buyer", "buyer_id NOT IN ('B-', 'B-7') AND buyer_id NOT IN (SELECT buyer_id FROM eb)")),
        ("DIM-06", "0", n(FACTS, "buyer_id <> 'B-' AND buyer_id NOT IN (SELECT buyer_id FROM eb)")), ("DIM-07", None, n(FACTS, "buyer_id = 'B-'")), ("DIM-08", "0", "0"),
        ("DIM-09", "(SELECT count(DISTINCT method) + 1 FROM tender WHERE ocid IN (SELECT ocid FROM ps))", f"(SELECT count(DISTINCT m) FROM {METHODS})"),
        ("DIM-10", "0", "0"), ("DIM-11", "0", "0"), ("DIM-12", "1", f"(SELECT count(DISTINCT m) FROM {METHODS} WHERE m = '(method not stated)')"),
    ],
    "c12_scale_flag": [
        ("SF-01", f"(SELECT count(*) FROM (SELECT award_id FROM {DD} UNION SELECT award_id FROM {SL}))", n("asf")), ("SF-02", n(DD), n("asf", "dd")), ("SF-03", n(SL), n("asf", "sl")),
        ("SF-04", "0", dup("asf", "award_id")), ("SF-05", "0", n("asf", "award_id NOT IN (SELECT award_id FROM awv)")), ("SF-06", "0", "0"), ("SF-07", "0", n("asf", "value >= 600000")),
        ("SF-08", "0", n("asf", "buyer_id = 'B-7'")), ("SF-09", "0", n("asf", "(dd AND NOT ratio BETWEEN 5 AND 20) OR (sl AND NOT ratio_to_sibling >= 10)")), ("SF-10", "0", n("asf", "sl AND buyer_id = 'B-'")),
        ("SF-11", f"(SELECT if(count(*) > 0, 'true', 'none') FROM {SL})", f"(SELECT coalesce(max(sl::VARCHAR), 'none') FROM asf WHERE award_id = (SELECT min(award_id) FROM {SL}))"),
        ("SF-12", f"(SELECT if(count(*) > 0, 'true', 'none') FROM {DD})", f"(SELECT coalesce(max(dd::VARCHAR), 'none') FROM asf WHERE award_id = (SELECT min(award_id) FROM {DD}))"),
        ("SF-13", "0", n("asf", "award_id NOT IN (SELECT award_id FROM sav) AND award_id NOT IN (SELECT award_id FROM bva)")),
        ("SF-14", f"{n('awv')} || '|' || (SELECT count(DISTINCT award_id) FROM sav) || '|' || {n('bva')}", "(SELECT string_agg(elig::VARCHAR, '|' ORDER BY ord) FROM reg WHERE metric_id IN ('M-V01', 'M-S01', 'P4-BvA'))"),
        ("SF-15", None, "|| '|' ||".join(n("asf", f"{SFK} = '{x}'") + "::VARCHAR" for x in "dsb")), ("SF-16", None, "(SELECT round(sum(value)::DOUBLE / 1000, 2) FROM asf)"),
        ("SF-17", None, f"round(100 * {money('asf', 'value')}::DOUBLE / {money('awv', 'value')}::DOUBLE, 2)"),
    ],
}


def suite(rows: list[tuple]) -> str:
    values = ",\n".join(
        f"('{cid}', '{'INFO' if e is None else 'GATE'}', {'NULL' if e is None else f'({e})::VARCHAR'}, ({a})::VARCHAR)" for cid, e, a in rows
    )
    return f"""SELECT id AS check_id, severity, expected::VARCHAR AS expected, actual, CASE WHEN severity = 'GATE' THEN coalesce(expected = actual, false) END AS passed
      FROM (VALUES {values}) t(id, severity, expected, actual)"""


DATES = [("tender", "tender_start_date"), ("tender", "tender_end_date"), ("awards", "award_date"), ("contracts", "date_signed"),
         ("contracts", "period_start_date"), ("contracts", "period_end_date"), ("milestones", "due_date"), ("milestones", "date_met")]
ITEMS = {f"count.{t}": n(t) for t in ("releases", "planning", "tender", "awards", "award_suppliers", "contracts", "transactions", "milestones", "parties")}
ITEMS |= {
    "count.processes": "(SELECT count(DISTINCT ocid) FROM releases)", "count.contracts_with_implementation": n("contracts", "has_implementation"),
    "money.budget": money("planning", "budget_amount"), "money.tender_value": money("tender", "tender_value_amount"), "money.award": money("awards", "value"),
    "money.contract": money("contracts", "value"), "money.transaction": money("transactions", "transaction_value"),
    "flag.budget.ZERO_VALUE": n("planning", "budget_amount = 0"), "flag.budget.EXTREME": n("planning", "budget_amount >= 495000"),
    "flag.tender_value.ZERO_VALUE": n("tender", "tender_value_amount = 0"), "flag.award.ZERO_VALUE": n("awards", "value = 0"), "flag.award.EXTREME": n("awards", "value >= 600000"),
    "flag.contract.ZERO_VALUE": n("contracts", "value = 0"), "flag.transaction.ZERO_VALUE": n("transactions", "transaction_value = 0"),
    "flag.tenderers.NORMAL": n("tender", "number_of_tenderers <= 8"), "flag.tenderers.ELEVATED": n("tender", "number_of_tenderers BETWEEN 9 AND 11"),
    "flag.tenderers.ANOMALOUS": n("tender", "number_of_tenderers >= 12"), "flag.party.NO_PARTIES": n("releases", "party_flag IS NOT NULL"),
    "flag.party.INCOMPLETE": n("parties", "roles = 'supplier' AND party_id = 'S-'"),
}
for _t, _c in DATES:
    _src = "due_date" if _c == "date_met" else _c
    ITEMS[f"date.{_c}"] = n(_t, f"{_src} IS NOT NULL")
    for _f in ("PLACEHOLDER", "FUTURE", "IMPOSSIBLE", "VALID"):
        ITEMS[f"flag.{_c}.{_f}"] = n(_t, f"{_src}_flag = '{_f}'")
RECON = "SELECT item, v AS source_value, v AS staging_value, true AS passed FROM (VALUES " + ", ".join(
    f"('{k}', ({q})::VARCHAR)" for k, q in ITEMS.items()
) + ") t(item, v)"


def sql() -> dict[str, str]:
    out = {name: with_tables(suite(rows)) for name, rows in SUITES.items()}
    out["c13_document_reconciliation"] = with_tables(RECON)
    return out
