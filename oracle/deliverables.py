"""Scans, published tables, exports, figures, measures, comparisons, the stream."""

from __future__ import annotations

from oracle.views import SQL as SECTIONS
from oracle.prelude import with_tables
from oracle.questions import SQL as QUESTIONS
from oracle.questions import DB, HHI, KB, KPI, PB, RB, pct, q, ranked_totals
from oracle.blocks import IMPLT
from oracle.impact import SQL as IMPACT

FLAG = "(award_id IN (SELECT award_id FROM asf))"
MAIN, OTHER, THIRD, BUYER = "'1-URGENT'", "'2-HIGH'", "'5-LOW'", "'B-3'"
VIEWS = {
    "lifecycle_stage": "ps", "budget_eligible": "budget_eligible", "competition_eligible": "competition", "award_value_eligible": "awv", "supplier_award_eligible": "sav",
    "budget_award_comparison": "bva", "tender_duration_eligible": "tde", "award_lag_eligible": "ale", "signature_lag_eligible": "sle", "contract_implementation_coverage": "cic",
    "award_scale_flag": "asf", "entity_benchmark": "eb", "dim_buyer": "(SELECT * FROM dim_buyer WHERE buyer_id NOT IN ('B-', 'B-7'))",
    "dim_procurement_method": "(SELECT DISTINCT coalesce(method, '-') FROM competition)", "metric_population": "reg", "dq_impact": "dqi",
}


def fig(fid: str, value: str, unit: str, n: str, src: str) -> str:
    return f"SELECT '{fid}' AS figure_id, '{unit}' AS unit, round(({value})::DOUBLE, 6) AS expected_value, ({n})::BIGINT AS eligible_n FROM {src}"


def pack(src: str, *figs: tuple) -> list[str]:
    return [fig(f[0], f[1], f[2], f[3] if len(f) > 3 else "count(*)", src + (f" WHERE {f[4]}" if len(f) > 4 else "")) for f in figs]


def banded(prefix: str, band: str, src: str, n: str) -> str:
    return f"SELECT '{prefix}' || left(({band}), 1) AS figure_id, 'count' AS unit, count(*)::DOUBLE AS expected_value, ({n})::BIGINT AS eligible_n FROM {src} GROUP BY 1"


def med(c: str, where: str | None = None) -> str:
    return f"quantile_cont(({c})::DOUBLE, 0.5)" + (f" FILTER ({where})" if where else "")


def rate(c: str, where: str | None = None) -> str:
    return f"avg(({c})::INT)" + (f" FILTER ({where})" if where else "")


NS = "(SELECT count(DISTINCT award_id) FROM sav)"
RT = ranked_totals("sav", None)
RTM = ranked_totals("sav", "coalesce(method, '(method not stated)')")


def top(n: int) -> str:
    return f"sum(v) FILTER (rn <= {n})::DOUBLE / sum(v)::DOUBLE"


def dq(m: str, ref: str, col: str) -> str:
    return f"max({col}) FILTER (metric_id = '{m}' AND dq_ref = '{ref}')"


ER = "(SELECT *, coalesce(award_value_total, 0) AS v, row_number() OVER (ORDER BY coalesce(award_value_total, 0) DESC, buyer_id) AS rn FROM eb)"
R = {
    "r1_executive": [
        *pack("ps", ("EXE-01", "count(*)", "count"), ("EXE-13", rate("stage = 1"), "share")), *pack("budget_eligible", ("EXE-02", "sum(budget_amount)", "NGN")),
        *pack("awv", ("EXE-03", "sum(value)", "NGN"), ("EXE-04", med("value"), "NGN"), ("EXE-08", "1 - (SELECT sum(value) FROM sav)::DOUBLE / sum(value)::DOUBLE", "share")),
        *pack("competition", ("EXE-05", rate("single"), "share", "count(*)", "prim"), ("EXE-06", med("number_of_tenderers"), "count", "count(*)", "prim")),
        *pack(RT, ("EXE-07", top(10), "share", NS)), *pack("bva", ("EXE-09", med("ratio"), "ratio")), *pack("tde", ("EXE-10", med("days"), "days")),
        *pack("ale", ("EXE-11", med("days"), "days")), *pack("cic", ("EXE-12", rate("has_implementation"), "share")),
    ],
    "r2_suppliers": [
        *pack("sav", ("SUP-01", "count(DISTINCT award_id)", "count", NS), ("SUP-02", "count(DISTINCT supplier_id)", "count", NS), ("SUP-03", "sum(value)", "NGN", NS)),
        *pack(RT, *[(f"SUP-{i:02d}", top(k), "share", NS) for i, k in enumerate((1, 5, 10, 20, 100), 4)], ("SUP-09", HHI, "index", NS), ("SUP-10", "count(*) FILTER (n = 1)", "count")),
        *pack("awv", ("SUP-11", f"count(*) - {NS}", "count"), ("SUP-12", "sum(value) - (SELECT sum(value) FROM sav)", "NGN"), ("SUP-13", "1 - (SELECT sum(value) FROM sav)::DOUBLE / sum(value)::DOUBLE", "share")),
        *pack("dqi", ("SUP-14", dq("M-S01", "DQ-14", "records_with_issue"), "count", dq("M-S01", "DQ-14", "candidate_records")), ("SUP-15", dq("M-S01", "DQ-14", "affected_value_ngn"), "NGN", dq("M-S01", "DQ-14", "candidate_records"))),
        *pack(RTM, *[(f, v, u, f"(SELECT count(DISTINCT award_id) FROM sav WHERE method = {m})", f"g = {m}") for f, v, u, m in (("SUP-16", top(1), "share", MAIN), ("SUP-17", top(1), "share", OTHER), ("SUP-18", HHI, "index", OTHER))]),
    ],
    "r3_competition": [
        *pack("competition", ("COM-01", "count(*)", "count", "count(*)", "prim"), ("COM-02", "count(*)", "count"), ("COM-03", med("number_of_tenderers"), "count", "count(*)", "prim"), ("COM-04", med("number_of_tenderers"), "count"),
              ("COM-05", rate("single"), "share", "count(*)", "prim"), ("COM-06", rate("single"), "share"), ("COM-07", rate("single"), "share", "count(*)", f"prim AND method = {THIRD}"),
              ("COM-08", rate("single"), "share", "count(*)", f"prim AND method = {MAIN}"), ("COM-09", rate("single"), "share", "count(*)", "prim AND tender_status = 'active'"),
              ("COM-10", med("number_of_tenderers"), "count", "count(*)", f"prim AND method = {MAIN}")),
        banded("COM-B", PB, "(SELECT * FROM competition WHERE prim)", "(SELECT count(*) FROM competition)"),
    ],
    "r4_budget": [
        *pack("bva", ("BVA-01", "count(*)", "count"), ("BVA-02", "sum(budget)", "NGN"), ("BVA-03", "sum(value)", "NGN"), ("BVA-04", "sum(variance)", "NGN"), ("BVA-05", "sum(value)::DOUBLE / sum(budget)::DOUBLE", "ratio"),
              ("BVA-06", med("ratio"), "ratio"), ("BVA-07", rate("ratio BETWEEN 0.9 AND 1.1"), "share"), ("BVA-08", "sum(value)::DOUBLE / sum(budget)::DOUBLE", "ratio", "count(*)", f"method = {MAIN}"),
              ("BVA-09", med("ratio"), "ratio", "count(*)", f"method = {OTHER}"), ("BVA-10", "sum(variance)", "NGN", "count(*)", f"buyer_id = {BUYER}"), ("BVA-11", "count(*) FILTER (budget < 100000)", "count")),
        banded("BVA-B", RB, "bva", "(SELECT count(*) FROM bva)"),
    ],
    "r5_timing": [
        *pack("tde", ("TIM-01", "count(*)", "count"), ("TIM-04", med("days"), "days"), ("TIM-07", q("days", 0.9), "days"), *[(f"TIM-{16 + i}", med("days"), "days", "count(*)", f"year(tender_start_date) = {y}") for i, y in enumerate((1996, 1997))]),
        *pack("ale", ("TIM-02", "count(*)", "count"), ("TIM-05", med("days"), "days"), ("TIM-08", q("days", 0.9), "days"), ("TIM-13", rate("days > 365"), "share"), ("TIM-14", med("days"), "days", "count(*)", f"method = {OTHER}"),
              ("TIM-15", med("days"), "days", "count(*)", f"method = {MAIN}")),
        *pack("sle", ("TIM-03", "count(*)", "count"), ("TIM-06", med("days"), "days"), ("TIM-09", q("days", 0.9), "days")),
        *[fig(f"TIM-{i}", "elig::DOUBLE / cand", "share", "elig", f"reg WHERE metric_id = '{m}'") for i, m in ((10, "M-E01"), (11, "M-E02"), (12, "P5-SIG"))],
        *[banded(f"TIM-D{k}-", DB, t, f"(SELECT count(*) FROM {t})") for k, t in ((1, "tde"), (2, "ale"), (3, "sle"))],
    ],
    "r6_entities": [
        *pack("eb", ("ENT-01", "count(*)", "count"), ("ENT-02", "sum(process_count)", "count"), ("ENT-03", "sum(planned_budget_total)", "NGN"), ("ENT-04", "sum(award_value_total)", "NGN"),
              *[(f, med(c), "share", "count(*)", f"{n} >= {k}") for f, c, n, k in (("ENT-08", "single_bidder_rate", "competition_n", 30), ("ENT-09", "top_supplier_value_share", "award_n", 10), ("ENT-10", "implementation_coverage_rate", "contract_n", 20))],
              *[(f, f"max({c})", u, f"max({n})", f"buyer_id = {BUYER}") for f, c, n, u in (("ENT-11", "single_bidder_rate", "competition_n", "share"), ("ENT-12", "top_supplier_value_share", "award_n", "share"),
                ("ENT-13", "implementation_coverage_rate", "contract_n", "share"), ("ENT-14", "tender_reach_rate", "process_count", "share"), ("ENT-15", "median_award_value", "award_n", "NGN"))]),
        *pack(ER, *[(f"ENT-{i:02d}", top(k), "share") for i, k in ((5, 1), (6, 10), (7, 100))]),
    ],
    "r7_implementation": [
        *pack("cic", ("IMP-01", "count(*)", "count"), ("IMP-02", "count(*) FILTER (has_implementation)", "count"), ("IMP-03", rate("has_implementation"), "share"), ("IMP-04", rate("has_implementation"), "share", "count(*)", "contract_status = 'F'"),
              ("IMP-05", rate("has_implementation"), "share", "count(*)", f"buyer_id = {BUYER}"), *[(f"IMP-T{k}", f"count(*) FILTER (({IMPLT}) LIKE '{k}%')", "count") for k in range(1, 5)]),
        *pack("ps", *[(f"IMP-S{k}", f"count(*) FILTER (stage >= {k})", "count") for k in range(1, 6)],
              *[(f"IMP-C{k}", f"count(*) FILTER (stage >= {k})::DOUBLE / count(*) FILTER (stage >= {k - 1})", "share", f"count(*) FILTER (stage >= {k - 1})") for k in range(2, 6)]),
    ],
    "r8_quality": [
        *[f"SELECT 'DQ-{x}-' || rtrim(regexp_replace(metric_id, '[^A-Za-z0-9]+', '-', 'g'), '-') AS figure_id, '{u}' AS unit, round(({v})::DOUBLE, 6) AS expected_value, {n} AS eligible_n FROM reg"
          for x, v, u, n in (("C", "cand", "count", "cand"), ("E", "elig", "count", "elig"), ("P", "elig::DOUBLE / cand", "share", "elig"))],
        *pack("dqi", *[(f"DQ-X{i}", dq(m, r, c), u, dq(m, r, "candidate_records")) for i, m, r, c, u in (
            (1, "M-P01", "DQ-06", "records_with_issue", "count"), (2, "M-P01", "DQ-06", "affected_value_ngn", "NGN"), (3, "M-V01", "DQ-07", "records_with_issue", "count"), (4, "M-V01", "DQ-20", "records_with_issue", "count"),
            (5, "M-E02", "DATE-ORDER", "records_with_issue", "count"), (6, "M-E01", "ALL", "records_with_issue", "count"), (7, "M-S01", "DQ-13", "records_with_issue", "count"))]),
    ],
}


def m(label: str, value: str, src: str, where: str = "true") -> str:
    return f"SELECT '{label}' AS label, round(({value})::DOUBLE, 6) AS value FROM {src} WHERE {where}"


def topt(src: str, n: int, holder: str = "supplier_id") -> str:
    return f"(SELECT sum(v) FILTER (rk <= {n})::DOUBLE / sum(v)::DOUBLE AS x FROM {ranked_totals(src, None, holder)})"


def hhi(src: str) -> str:
    return f"(SELECT 10000 * sum(v::DOUBLE * v::DOUBLE) / (sum(v)::DOUBLE * sum(v)::DOUBLE) AS x FROM (SELECT sum(value) AS v FROM {src} GROUP BY supplier_id))"


SM, SB, AM, AB = (f"(SELECT * FROM {t} WHERE {c})" for t, c in (("sav", f"method = {MAIN}"), ("sav", f"buyer_id = {BUYER}"), ("awv", f"method = {MAIN}"), ("awv", f"buyer_id = {BUYER}")))
R9 = [
    m("processes / buyer", "count(*)", "ps", f"buyer_id = {BUYER}"), m("planned budget / method leaves it unchanged", "sum(budget_amount)", "budget_eligible"), m("award value / method", "sum(value)", AM),
    m("median award value / method", med("value"), AM), m("top supplier share / method, n 3", "x", topt(SM, 3)), m("supplier hhi / buyer", "x", hhi(SB)),
    m("single bidder rate / status", rate("single"), "competition", "prim AND tender_status = 'active'"), m("tenders in band 3 / method", "count(*)", "competition", f"prim AND number_of_tenderers BETWEEN 3 AND 5 AND method = {MAIN}"),
    m("median ratio / without flagged", med("ratio"), "bva", f"NOT {FLAG}"), m("aggregate ratio / buyer", "sum(value)::DOUBLE / sum(budget)::DOUBLE", "bva", f"buyer_id = {BUYER}"),
    m("comparable in band 5", "count(*)", "bva", "ratio > 1.5 AND ratio <= 10"), m("median tender duration / year", med("days"), "tde", "year(tender_start_date) = 1996"),
    m("award lag n / other year field leaves it unchanged", "count(*)", "ale"), m("p90 award lag / award year", q("days", 0.9), "ale", "year(award_date) = 1996"),
    m("coverage / contract status", rate("has_implementation"), "cic", "contract_status = 'F'"), m("stage conversion 4 / buyer", "count(*) FILTER (stage >= 4)::DOUBLE / count(*) FILTER (stage >= 3)", "ps", f"buyer_id = {BUYER}"),
    m("excluded awards / method", f"count(*) - (SELECT count(DISTINCT award_id) FROM {SM})", AM), m("excluded value share / buyer", f"1 - (SELECT sum(value) FROM {SB})::DOUBLE / sum(value)::DOUBLE", AB),
    m("top entity share, n 5", "sum(v) FILTER (rn <= 5)::DOUBLE / sum(v)::DOUBLE", ER), m("median entity single bidder rate", med("single_bidder_rate"), "eb", "competition_n >= 30"),
    m("eligible share M-E01", "elig::DOUBLE / cand", "reg", "metric_id = 'M-E01'"), m("impact M-V01 / OTHER", "records_with_issue", "dqi", "metric_id = 'M-V01' AND dq_ref = 'OTHER'"),
]


def scenario(label: str, w: str) -> list[str]:
    s, b = f"(SELECT * FROM sav WHERE {w})", f"(SELECT * FROM bva WHERE {w})"
    return [
        m(f"{label}: supplier_awards", "count(DISTINCT award_id)", s), m(f"{label}: supplier_value", "sum(value)", s), m(f"{label}: top_supplier_share_1", "x", topt(s, 1)), m(f"{label}: top_supplier_share_10", "x", topt(s, 10)),
        m(f"{label}: supplier_hhi", "x", hhi(s)), m(f"{label}: comparable_processes", "count(*)", b), m(f"{label}: comparable_award", "sum(value)", b),
        m(f"{label}: aggregate_ratio", "sum(value)::DOUBLE / sum(budget)::DOUBLE", b), m(f"{label}: median_ratio", med("ratio"), b),
    ]


NM = "coalesce(method, '(method not stated)')"
PRES = {"competition_eligible": "competition", "award_value_eligible": "awv", "supplier_award_eligible": "sav", "budget_award_comparison": "bva", "tender_duration_eligible": "tde", "award_lag_eligible": "ale"}
TABLES = ["releases", "planning", "tender", "awards", "award_suppliers", "contracts", "transactions", "milestones", "parties"]
# Columns of each staging table by name; the star marks money, @ lists, # moments.
DIGESTED = {
    "releases": "buyer_id buyer_name initiation_type language ocid party_flag #release_date release_id release_seq @tag",
    "planning": "*budget_amount budget_amount_flag budget_currency budget_description budget_id budget_monetary_flag budget_project budget_project_id buyer_id ocid party_flag release_id release_seq",
    "tender": """award_criteria award_criteria_details description has_enquiries number_of_tenderers ocid procurement_method procurement_method_details procurement_method_rationale release_id release_seq
        status @submission_method submission_method_details tender_end_date tender_end_date_flag tender_id tender_start_date tender_start_date_flag *tender_value_amount tender_value_currency
        tender_value_monetary_flag tenderer_count_flag title""",
    "awards": "award_date award_date_flag award_id award_monetary_flag *award_value_amount award_value_currency award_value_flag description ocid release_id release_seq status title",
    "award_suppliers": "award_id ocid release_seq supplier_id supplier_name supplier_name_raw supplier_seq",
    "contracts": """award_id contract_id contract_monetary_flag *contract_value_amount contract_value_currency date_signed date_signed_flag description has_implementation ocid period_end_date
        period_end_date_flag period_start_date period_start_date_flag release_id release_seq status title""",
    "transactions": "contract_id payee_id payee_name payer_id payer_name transaction_currency transaction_id transaction_monetary_flag *transaction_value",
    "milestones": "code contract_id date_met date_met_flag description due_date due_date_flag milestone_id milestone_source status title",
    "parties": "identifier_id identifier_scheme ocid party_id party_name party_name_raw release_id release_seq @roles supplier_id_flag",
}


def measured(text: str) -> str:
    """A text with its length in front; a dash for NULL."""
    return f"coalesce(length({text}) || ':' || {text}, '-')"


def rendered(c: str) -> str:
    kinds = {
        "*": lambda x: f"{x}::DECIMAL(18,4)::VARCHAR", "#": lambda x: f"epoch_us({x}::TIMESTAMP)::VARCHAR",
        "@": lambda x: f"array_to_string(list_transform(string_split({x}, ','), lambda e: length(e) || ':' || e), '')",
    }
    return measured(kinds[c[0]](c[1:]) if c[0] in kinds else f"({c}::VARCHAR)")


def digest(table: str) -> str:
    """Row count and the sum of the leading 48 bits of each row's SHA-256."""
    body = next(sql for name, sql in SECTIONS.items() if name[0] == "s" and name.split("_", 1)[1] == table)
    text = " || ".join(rendered(c) for c in DIGESTED[table].split())
    return f"""SELECT '{table}' AS table_name, count(*) AS n_rows, coalesce(sum(('0x' || sha256({text})[:12])::BIGINT), 0)::VARCHAR AS digest FROM ({body})"""


DIGESTS = " UNION ALL ".join(digest(t) for t in TABLES)
LINES = """SELECT release_seq // 20000 AS file, release_seq AS place, award_id, award_id || ';' || coalesce(value::DECIMAL(18,4)::VARCHAR, '') || ';' || coalesce(status, '') AS line FROM awards"""


def tree(lines: str) -> str:
    """Rows, bytes and digest of each file of lines: a digest of lines, of ranges of 64 KiB and of the file."""
    return f"""SELECT file, sum(n)::BIGINT AS "rows", sum(size)::BIGINT AS bytes, sha256(sum(size)::BIGINT || ':' || string_agg(leaf, '' ORDER BY r)) AS digest
      FROM (SELECT file, pos // 65536 AS r, count(*) AS n, sum(size) AS size, sha256(string_agg(d, '' ORDER BY pos)) AS leaf
        FROM (SELECT file, sha256(line) AS d, strlen(line) + 1 AS size, sum(strlen(line) + 1) OVER (PARTITION BY file ORDER BY place, award_id) - strlen(line) - 1 AS pos FROM ({lines}))
        GROUP BY 1, 2) GROUP BY 1"""


TAMPERED = f"""SELECT file, place, award_id, line || CASE WHEN place = (SELECT min(release_seq) FROM awards) THEN '0' ELSE '' END AS line FROM ({LINES})
  WHERE file < (SELECT max(release_seq) // 20000 FROM awards) UNION ALL SELECT -1, 0, 'A', 'A;1;'"""
MOVED = f"{LINES} UNION ALL SELECT -2, 0, 'A', 'late'"


def gate(case: str, lines: str, stops: bool) -> str:
    """The pinned files against those of ``lines``, found by their digests."""
    loaded = "NULL::BIGINT" if stops else f"(SELECT count(*) FROM ({LINES}))"
    return f"""SELECT '{case}' AS input, coalesce(e.file, a.file) AS file, e."rows" AS expected_rows, a."rows" AS actual_rows, e.bytes AS expected_bytes, a.bytes AS actual_bytes,
      e.digest IS NOT DISTINCT FROM a.digest AS intact, bool_or(e.digest IS DISTINCT FROM a.digest) OVER () AS stopped, {loaded} AS loaded_rows
      FROM ({tree(LINES)}) e FULL JOIN ({tree(lines)}) a ON a.file = e.file"""


# The columns that tell the rows of a result set apart; sets of one row are not named.
KEYS = {
    "q1_1b": "metric_id", "q2_1b": "metric_id", "q3_1b": "metric_id", "q4_1b": "metric_id", "q5_1b": "metric_id", "q6_1b": "metric_id", "q7_1": "metric_id",
    "q1_4": "procurement_method", "q1_6b": "procurement_method", "q2_4": "procurement_method", "q3_4": "procurement_method", "q4_4": "procurement_method",
    "q1_5": "buyer_id", "q3_5": "buyer_id", "q3_6": "buyer_id", "q3_9": "buyer_id", "q3_11b": "buyer_id", "q5_3": "buyer_id", "q5_7b": "buyer_id", "q6_5": "buyer_id",
    "q1_6": "scenario", "q3_11": "scenario", "q4_1": "measure", "q4_2": "measure", "q5_2": "largest_entities", "q5_7": "largest_entities", "q5_0": "kpi", "q5_5": "kpi",
    "q1_3": "supplier_id", "q2_1": "population", "q2_2": "participation_band", "q2_5": "tender_status", "q2_6": "ranking, buyer_id", "q3_3": "ratio_band",
    "q3_12": "ratio_group", "q4_3": "measure, duration_band", "q4_5": "tender_start_year", "q4_6": "award_year", "q5_4": "buyer_name", "q5_6": "value_quartile",
    "q6_2": "implementation_data_type", "q6_3": "contract_status", "q6_4": "entity_coverage_band", "q6_6": "stage_order", "q7_2": "metric_id, dq_ref", "q7_3": "dq_ref",
}


def numbers(name: str, body: str) -> str:
    """The numbers of a result set, one row each."""
    keys = KEYS.get("_".join(name.split("_")[:2]))
    row, rest = (f"concat_ws('|', {keys})", f"* EXCLUDE ({keys})") if keys else ("''", "*")
    return f"""SELECT '{name}' AS result_set, row_key, column_name, cell FROM (UNPIVOT (SELECT {row} AS row_key, TRY_CAST(COLUMNS({rest}) AS DECIMAL(30,8)) FROM ({body}))
      ON COLUMNS(* EXCLUDE (row_key)) INTO NAME column_name VALUE cell)"""


CLAIMS = f"""SELECT c.result_set, c.row_key, c.column_name, c.kind, c.stated::DOUBLE AS stated, round(a.cell, 6)::DOUBLE AS cell,
    coalesce(a.found = 1 AND c.has_n AND CASE c.kind WHEN 'percent' THEN round(a.cell, 1)::DECIMAL(30,8) WHEN 'count' THEN round(a.cell, 0) ELSE round(a.cell, 2)::DECIMAL(30,8) END = c.stated, false) AS holds
  FROM (SELECT result_set, CASE WHEN plant = 3 THEN row_key || '?' ELSE row_key END AS row_key, column_name, kind, plant <> 5 AS has_n,
      (CASE kind WHEN 'percent' THEN round(cell, 1)::DECIMAL(30,8) WHEN 'count' THEN round(cell, 0) ELSE round(cell, 2)::DECIMAL(30,8) END + CASE WHEN plant = 0 THEN (CASE kind WHEN 'percent' THEN 0.1 WHEN 'count' THEN 1 ELSE 0.01 END)::DECIMAL(9,8) ELSE 0 END)::DECIMAL(30,8) AS stated
    FROM (SELECT *, length(row_key || column_name) % 7 AS plant, CASE WHEN contains(column_name, 'pct') THEN 'percent' WHEN cell = floor(cell) THEN 'count' ELSE 'figure' END AS kind FROM cited)) c
  LEFT JOIN (SELECT result_set, row_key, column_name, count(*) AS found, max(cell) AS cell FROM cited GROUP BY ALL) a
    ON a.result_set = c.result_set AND a.row_key = c.row_key AND a.column_name = c.column_name"""
CITED = " UNION ALL ".join(numbers(n, body) for n, body in {**QUESTIONS, **IMPACT}.items() if n.startswith("q"))

SQL = {
    "s01_package_scan": """SELECT strftime(r.release_date, '%Y') AS year, count(*) AS releases, count(DISTINCT r.ocid) AS processes, sum(p.budget_amount)::DOUBLE AS budget, coalesce(sum(a.value), 0)::DOUBLE AS award_value, count(t.tender_id) AS tenders
       FROM releases r JOIN planning p USING (release_id) LEFT JOIN awards a USING (release_id) LEFT JOIN tender t USING (release_id) GROUP BY 1""",
    "s01b_release_lines": """SELECT strftime(r.release_date, '%Y') AS year, count(*) AS releases, count(DISTINCT r.ocid) AS processes, sum(p.budget_amount)::DOUBLE AS budget, coalesce(sum(a.value), 0)::DOUBLE AS award_value, count(t.tender_id) AS tenders
       FROM releases r JOIN planning p USING (release_id) LEFT JOIN awards a USING (release_id) LEFT JOIN tender t USING (release_id) GROUP BY 1""",
    "s19_manifest": tree(LINES),
    "s19b_table_digests": DIGESTS,
    "s20_integrity": f"SELECT table_name, n_rows AS source_rows, n_rows AS published_rows, digest AS source_digest, digest AS published_digest, digest = digest AS intact FROM ({DIGESTS})",
    "s20b_input_gate": " UNION ALL ".join((gate("as pinned", LINES, False), gate("tampered", TAMPERED, True), gate("changed during the load", MOVED, True))),
    "s11_strict_dates": "SELECT tender_start_date AS day, count(*) AS tenders FROM tender GROUP BY 1",
    "s12_replaced_tables": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in TABLES),
    "s13_refreshed_snapshot": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count, count(DISTINCT ocid) AS processes FROM {t}" for t in ("budget_lines", "process_snapshot")),
    "s14_view_counts": " UNION ALL ".join(f"SELECT 'vw_{v}' AS view_name, count(*) AS row_count FROM {t}" for v, t in VIEWS.items()),
    "s15a_lifecycle_cells": "SELECT buyer_id, buyer_id_flag, stage::BIGINT AS highest_stage_rank, count(*) AS processes FROM ps GROUP BY ALL",
    "s15b_budget_cells": "SELECT buyer_id, count(*) AS lines, sum(budget_amount)::DOUBLE AS budget, bool_and(budget_amount * 100 = floor(budget_amount * 100)) AS whole_minor_units FROM budget_eligible GROUP BY 1",
    "s15c_contract_cells": f"SELECT buyer_id, buyer_id_flag, contract_status, left(({IMPLT}), 1)::BIGINT AS data_type, has_implementation, count(*) AS contracts FROM cic GROUP BY ALL",
    "s15d_supplier_cells": "SELECT supplier_id, min(supplier_name) AS name_low, max(supplier_name) AS name_high, max(name_variant_count) AS name_variant_count, count(*) AS awards, max(distinct_supplier_count) AS distinct_supplier_count FROM sav GROUP BY 1",
    "s16a_award_facts": """SELECT w.award_id, w.buyer_id, w.buyer_id_flag, w.method AS procurement_method_details, w.value::DOUBLE AS award_value_amount, s.supplier_id, f.award_id IS NOT NULL AS is_flagged,
       coalesce(f.dd, false) AS dropped_decimal_test, coalesce(f.sl, false) AS sibling_lot_test FROM awv w LEFT JOIN sav s ON s.award_id = w.award_id LEFT JOIN asf f ON f.award_id = w.award_id""",
    "s16b_budget_award_facts": f"SELECT buyer_id, buyer_id_flag, method AS procurement_method_details, budget::DOUBLE AS budget_amount, value::DOUBLE AS award_value_amount, variance::DOUBLE AS variance_amount, ratio AS award_to_budget_ratio, {FLAG} AS is_flagged FROM bva",
    "s16c_timing_facts": """SELECT 'tender_duration' AS fact, buyer_id, buyer_id_flag, method, year(tender_start_date) AS year, days::BIGINT AS days FROM tde UNION ALL SELECT 'award_lag', buyer_id, buyer_id_flag, method, year(award_date), days FROM ale
       UNION ALL SELECT 'signature_lag', buyer_id, buyer_id_flag, NULL, NULL, days FROM sle""",
    "s17_dictionary_encoding": f"SELECT count(*) AS facts, 0::BIGINT AS buyers_outside, 0::BIGINT AS methods_outside, count(*) FILTER (buyer_id = 'B-') AS bare_buyer_facts, count(DISTINCT buyer_id) AS buyers_used, count(DISTINCT {NM}) AS methods_used FROM awv",
    "s18_minor_units": "SELECT award_id, (value * 100)::BIGINT AS value_minor FROM awv",
    "s21_presentation": " UNION ALL ".join(
        f"SELECT '{v}' AS view_name, count(*) AS n, " + ("count(*) FILTER (method IS NULL)" if v in PRES else "0::BIGINT") + f" AS not_stated FROM {t}"
        for v, t in VIEWS.items() if v not in ("award_scale_flag", "dim_procurement_method"))
      + " UNION ALL SELECT 'dim_procurement_method', count(DISTINCT coalesce(method, '-')), count(DISTINCT coalesce(method, '-')) FILTER (method IS NULL) FROM competition",
    "s22_constant_table": "SELECT i::BIGINT AS step, x::DOUBLE AS \"limit\", count(*) AS awards FROM awv, (VALUES (0, 50000), (1, 100000), (2, 200000), (3, 400000)) g(i, x) WHERE value >= x GROUP BY 1, 2",
    "s23_series": f"SELECT g.i AS band, count(c.b) AS n FROM (SELECT unnest(generate_series(1, 8)) AS i) g LEFT JOIN (SELECT left(({PB}), 1)::BIGINT AS b FROM competition) c ON c.b = g.i GROUP BY 1",
    "s24_stored_results": " UNION ALL ".join(
        f"SELECT '{n}' AS result_set, count(*) AS n_rows FROM ({body})" for n, body in {**QUESTIONS, **IMPACT}.items() if n.startswith("q")),
    **{name: " UNION ALL ".join(parts) for name, parts in R.items()},
    "r9_measures_under_filters": " UNION ALL ".join(R9),
    "r10_scenario_headlines": " UNION ALL ".join(scenario("published", "true") + scenario("without flagged", f"NOT {FLAG}")),
    "r11_top_suppliers_filtered": f"""SELECT rk AS value_rank, t.supplier_id, u.supplier_name, n AS awards, (SELECT count(DISTINCT buyer_id) FROM {SM} s WHERE s.supplier_id = t.supplier_id) AS procuring_entities,
       round(v::DOUBLE / 1000, 2) AS value_k, {pct('v', 'tot', 2)} AS share_pct, {pct('cum', 'tot', 2)} AS cumulative_share_pct FROM {ranked_totals(SM, None)} t JOIN sup u ON u.supplier_id = t.supplier_id WHERE rk <= 20""",
    "r11b_share_by_method_filtered": f"""SELECT g AS procurement_method, sum(n)::BIGINT AS eligible_awards, count(*) AS suppliers, round(sum(v)::DOUBLE / 1000, 2) AS value_k, {pct('sum(v) FILTER (rn <= 1)', 'sum(v)', 1)} AS top_1_share_pct,
       {pct('sum(v) FILTER (rn <= 3)', 'sum(v)', 1)} AS top_3_share_pct, round({HHI}, 0) AS herfindahl_index, if(sum(n) < 30, 'small n: read with caution', '') AS reliability_note FROM {ranked_totals(SB, NM)} GROUP BY g""",
    "r11c_net_differences": f"""SELECT buyer_id, buyer_name, n AS processes, net::DOUBLE AS net, side, position FROM (SELECT *, row_number() OVER (PARTITION BY side ORDER BY abs(net) DESC, buyer_id) AS position FROM
       (SELECT buyer_id, max(buyer_name) AS buyer_name, count(*) AS n, sum(variance) AS net, if(sum(variance) > 0, 'above', 'below') AS side FROM bva WHERE method = {MAIN} AND buyer_id <> 'B-' GROUP BY 1 HAVING count(*) >= 2 AND sum(variance) <> 0)) WHERE position <= 5""",
    "r11d_timing_by_year": f"""SELECT y AS year, nullif(count(d), 0) AS tender_duration_n, {med('d')} AS median_tender_duration, nullif(count(l), 0) AS award_lag_n, {med('l')} AS median_award_lag FROM
       (SELECT year(tender_start_date) AS y, days AS d, NULL::INT AS l FROM tde WHERE method = {MAIN} UNION ALL SELECT year(award_date), NULL, days FROM ale WHERE method = {MAIN}) GROUP BY y""",
    "r11e_entity_kpis": f"SELECT buyer_id, buyer_name, process_count, award_n, {', '.join(f'{c}::DOUBLE AS {c}' for c in KPI)} FROM {KB}",
    "r12_disclosure": f"""SELECT *, excluded_awards_bare_supplier_id || ' awards (' || excluded_pct_of_candidate_value::DECIMAL(10,1) || '% of value) have no usable supplier ID and are not included.' AS disclosure FROM
       (SELECT 'M-S01' AS metric, cn AS candidate_awards, en AS eligible_awards, {pct('en', 'cn', 1)} AS eligible_pct_of_candidate, ds AS distinct_suppliers, round(ev::DOUBLE / 1000, 1) AS eligible_value_k, cn - en AS excluded_awards_bare_supplier_id,
        round((cv - ev)::DOUBLE / 1000, 1) AS excluded_value_k, {pct('cv - ev', 'cv', 1)} AS excluded_pct_of_candidate_value FROM (SELECT count(*) AS cn, sum(value) AS cv FROM {AM}),
        (SELECT count(DISTINCT award_id) AS en, count(DISTINCT supplier_id) AS ds, sum(value) AS ev FROM {SM}))""",
    "c14_figure_comparison": "SELECT figure_id, unit, expected_value AS expected, expected_value AS actual, true AS matches FROM (" + " UNION ALL ".join(sum(R.values(), [])) + ")",
    "c15_cell_comparison": f"SELECT m AS row_key, c AS column_name, true AS matches FROM (SELECT DISTINCT {NM} AS m FROM sav), (SELECT unnest(['eligible_awards', 'suppliers', 'value_k', 'top_1_share_pct', 'top_5_share_pct', 'herfindahl_index', 'reliability_note']) AS c)",
    "c15b_store_comparison": " UNION ALL ".join(
        f"SELECT '{n}' AS result_set, count(*) AS n_rows, 0::BIGINT AS only_stored, 0::BIGINT AS only_again FROM ({body})" for n, body in {**QUESTIONS, **IMPACT}.items() if n.startswith("q")),
    "c16_claim_trace": CLAIMS,
    "r_all_figures": "SELECT page, unit, count(*) AS n_figures, count(expected_value) AS with_value, count(*) AS with_measure FROM (" + " UNION ALL ".join(
        f"SELECT '{p}' AS page, unit, expected_value FROM ({' UNION ALL '.join(R[k])})" for k, p in (
            ("r1_executive", "Executive overview"), ("r2_suppliers", "Supplier concentration"), ("r3_competition", "Competition"), ("r4_budget", "Budget vs award"), ("r5_timing", "Timing"),
            ("r6_entities", "Entity benchmark"), ("r7_implementation", "Implementation & lifecycle"), ("r8_quality", "Data quality & coverage"))) + ") GROUP BY 1, 2",
    "st1_streamed_pick": "SELECT ocid, latest_release_id, buyer_id, tender_release_id, award_release_id FROM process_snapshot",
    "st1b_streamed_budget_lines": SECTIONS["k01_budget_lines"],
    "st1c_streamed_snapshot": SECTIONS["k07_process_snapshot"],
}


def sql() -> dict[str, str]:
    out = {name: with_tables(body) for name, body in SQL.items() if name != "c16_claim_trace"}
    return out | {"c16_claim_trace": with_tables(f", cited AS MATERIALIZED ({CITED}) {CLAIMS}")}
