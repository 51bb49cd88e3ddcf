"""Common table expressions that rebuild every table and view from the driver's
parquet views, written for DuckDB and independently of the Spark plans: filters
and ``arg_max`` on the order tables instead of nested documents and explodes."""

from __future__ import annotations

CTES: list[tuple[str, str]] = [
    (
        "li",
        """SELECT l_orderkey AS k, l_suppkey AS sk, l_extendedprice::DECIMAL(18,4) AS price,
                  l_returnflag AS rf, l_linestatus AS ls, l_shipdate::DATE AS ship FROM lineitem""",
    ),
    (
        "ol",
        """SELECT k, count(*) AS n_lines, sum(price) AS total, min(ship) AS d0, max(ship) AS d1 FROM li GROUP BY k""",
    ),
    (
        "lead",
        """SELECT k, sk, ls FROM li
           QUALIFY row_number() OVER (PARTITION BY k ORDER BY price DESC, sk DESC, ls DESC) = 1""",
    ),
    (
        "o",
        """SELECT o_orderkey AS k, o_orderkey::VARCHAR AS release_id, o_orderkey AS release_seq,
                  'P' || o_custkey::VARCHAR AS ocid, o_orderstatus AS st, o_orderpriority AS pr,
                  o_totalprice::DECIMAL(18,4) AS tp, o_orderdate::DATE AS od,
                  CASE WHEN o_custkey % 97 = 0 THEN 'B-' ELSE 'B-' || c_nationkey::VARCHAR END AS buyer_id,
                  CASE WHEN o_custkey % 97 <> 0 THEN n_name END AS buyer_name,
                  CASE WHEN o_orderkey % 50 = 0 THEN 'NO_PARTIES' END AS party_flag,
                  n_lines, total, d0, d1, lead.sk AS sk, lead.ls AS lead_ls,
                  (o_orderstatus = 'F' AND n_lines IS NOT NULL) AS has_award,
                  (o_orderstatus = 'F' AND n_lines IS NOT NULL AND o_custkey % 5 <> 0) AS has_contract
           FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey
                LEFT JOIN ol ON ol.k = o_orderkey LEFT JOIN lead ON lead.k = o_orderkey""",
    ),
    ("impl", "SELECT DISTINCT li.k FROM li JOIN o ON o.k = li.k WHERE o.has_contract AND rf IN ('R', 'A')"),
    (
        "releases",
        """SELECT release_id, release_seq, ocid, od AS release_date, buyer_id, buyer_name, party_flag,
                  'planning' || CASE WHEN st IN ('O', 'F') THEN ',tender' ELSE '' END
                    || CASE WHEN has_award THEN ',award' ELSE '' END
                    || CASE WHEN has_contract THEN ',contract' ELSE '' END
                    || CASE WHEN impl.k IS NOT NULL THEN ',implementation' ELSE '' END AS tag,
                  CASE WHEN impl.k IS NOT NULL THEN 5 WHEN has_contract THEN 4 WHEN has_award THEN 3
                       WHEN st IN ('O', 'F') THEN 2 ELSE 1 END AS stage
           FROM o LEFT JOIN impl ON impl.k = o.k""",
    ),
    (
        "planning",
        """SELECT *, CASE WHEN budget_amount >= 495000 THEN 'EXTREME' END AS budget_amount_flag,
                  CASE WHEN budget_amount = 0 THEN 'ZERO_VALUE' END AS budget_monetary_flag
           FROM (SELECT release_id, release_seq, ocid, buyer_id, party_flag, 'G' || release_id AS budget_id,
                        CASE WHEN k % 40 <> 0 THEN 'L' || ocid || '-' || (k % 10 = 0)::INT::VARCHAR END AS budget_project_id,
                        CASE WHEN k % 100 = 1 THEN 0::DECIMAL(18,4) WHEN k % 100 <> 2 THEN tp END AS budget_amount,
                        CASE WHEN k % 100 <> 2 THEN 'USD' END AS budget_currency FROM o)""",
    ),
    (
        "aval",
        """SELECT k, CASE WHEN k % 60 = 0 THEN 0::DECIMAL(18,4) WHEN k % 3 = 0 THEN floor(total)::DECIMAL(18,4)
                        ELSE total::DECIMAL(18,4) END AS v
           FROM o WHERE has_award""",
    ),
]

_DATE_FLAG = """CASE WHEN {d} IS NULL THEN NULL WHEN {d} = DATE '1990-01-01' THEN 'PLACEHOLDER'
    WHEN {d} < DATE '2001-01-01' THEN 'VALID' WHEN {d} < DATE '2001-10-01' THEN 'FUTURE' ELSE 'IMPOSSIBLE' END"""


def date_flag(column: str) -> str:
    return _DATE_FLAG.format(d=column)


CTES += [
    (
        "tender",
        f"""SELECT *, CASE WHEN number_of_tenderers <= 8 THEN 'NORMAL' WHEN number_of_tenderers <= 11 THEN 'ELEVATED'
                        ELSE 'ANOMALOUS' END AS tenderer_count_flag,
                  CASE WHEN tender_value_amount = 0 THEN 'ZERO_VALUE' END AS tender_value_monetary_flag,
                  {date_flag('tender_start_date')} AS tender_start_date_flag,
                  {date_flag('tender_end_date')} AS tender_end_date_flag
           FROM (SELECT o.release_id, o.release_seq, o.ocid, 'T' || o.release_id AS tender_id,
                        CASE WHEN o.k % 30 = 0 THEN NULL WHEN st = 'F' THEN 'complete' ELSE 'active' END AS status,
                        nullif(pr, '4-NOT SPECIFIED') AS method, coalesce(n_lines, 1) AS number_of_tenderers,
                        coalesce(aval.v, tp) AS tender_value_amount,
                        CASE WHEN o.k % 4 = 0 THEN NULL WHEN o.k % 45 = 0 THEN DATE '1990-01-01' ELSE od END AS tender_start_date,
                        d1 AS tender_end_date
                 FROM o LEFT JOIN aval ON aval.k = o.k WHERE st IN ('O', 'F'))""",
    ),
    (
        "awards",
        f"""SELECT *, CASE WHEN value >= 600000 THEN 'EXTREME' END AS award_value_flag,
                  CASE WHEN value = 0 THEN 'ZERO_VALUE' END AS award_monetary_flag,
                  {date_flag('award_date')} AS award_date_flag
           FROM (SELECT 'A' || release_id AS award_id, release_id, release_seq, ocid, d0 AS award_date, aval.v AS value,
                        CASE WHEN o.k % 7 = 0 THEN 'cancelled' WHEN o.k % 7 <> 1 THEN 'active' END AS status
                 FROM o JOIN aval ON aval.k = o.k)""",
    ),
    (
        "award_suppliers",
        """SELECT 'A' || release_id AS award_id, ocid, release_seq, g.i::INT AS supplier_seq,
                  CASE WHEN sk % 10 = 0 THEN 'S-' ELSE 'S' || sk::VARCHAR END AS supplier_id,
                  'Supplier ' || sk::VARCHAR AS supplier_name,
                  CASE WHEN k % 9 = 0 THEN 'Supplier  ' || sk::VARCHAR || chr(9) ELSE 'Supplier ' || sk::VARCHAR END AS supplier_name_raw
           FROM o, (SELECT unnest([1, 2, 3]) AS i) g WHERE has_award AND (g.i = 1 OR k % 25 = 0)""",
    ),
    (
        "contracts",
        f"""SELECT *, {date_flag('date_signed')} AS date_signed_flag, {date_flag('period_start_date')} AS period_start_date_flag,
                  {date_flag('period_end_date')} AS period_end_date_flag,
                  CASE WHEN value = 0 THEN 'ZERO_VALUE' END AS contract_monetary_flag
           FROM (SELECT 'C' || o.release_id AS contract_id, o.release_id, o.release_seq, o.ocid, 'A' || o.release_id AS award_id,
                        lead_ls AS status, aval.v AS value, d1 AS date_signed,
                        CASE WHEN o.k % 2 = 0 THEN d0 END AS period_start_date, d1 AS period_end_date,
                        impl.k IS NOT NULL AS has_implementation
                 FROM o JOIN aval ON aval.k = o.k LEFT JOIN impl ON impl.k = o.k WHERE has_contract)""",
    ),
    (
        "transactions",
        """SELECT 'C' || o.release_id AS contract_id, 'X' || o.release_id || '-' || ls AS transaction_id,
                  sum(price) AS transaction_value, any_value(buyer_id) AS payer_id,
                  any_value(CASE WHEN o.sk % 10 = 0 THEN 'S-' ELSE 'S' || o.sk::VARCHAR END) AS payee_id,
                  any_value(buyer_name) AS payer_name,
                  any_value('Supplier ' || CASE WHEN o.k % 9 = 0 THEN ' ' || o.sk::VARCHAR || chr(9) ELSE o.sk::VARCHAR END) AS payee_name
           FROM li JOIN o ON o.k = li.k WHERE has_contract AND rf = 'R' GROUP BY o.release_id, ls""",
    ),
    (
        "milestones",
        f"""SELECT *, {date_flag('due_date')} AS due_date_flag FROM (
             SELECT 'C' || o.release_id AS contract_id,
                  CASE WHEN rf = 'N' THEN 'CONTRACT' ELSE 'IMPLEMENTATION' END AS milestone_source,
                  CASE WHEN rf = 'N' THEN 'N' ELSE 'M' END || o.release_id || '-' || ls AS milestone_id,
                  CASE WHEN rf = 'A' THEN min(ship) END AS due_date
             FROM li JOIN o ON o.k = li.k WHERE has_contract AND rf IN ('N', 'A') GROUP BY o.release_id, rf, ls)""",
    ),
    (
        "parties",
        """SELECT release_id, ocid, release_seq, buyer_id AS party_id, buyer_name AS party_name_raw,
                  'buyer,procuringEntity' AS roles FROM o WHERE party_flag IS NULL
           UNION ALL
           SELECT o.release_id, o.ocid, o.release_seq, s.supplier_id, s.supplier_name_raw, 'supplier'
           FROM o JOIN award_suppliers s ON s.award_id = 'A' || o.release_id AND s.supplier_seq = 1
           WHERE party_flag IS NULL AND k % 11 <> 0""",
    ),
    (
        "dim_buyer",
        """SELECT r.buyer_id, first(n.buyer_name) AS buyer_name, count(*) AS release_count,
                  CASE WHEN r.buyer_id = 'B-' THEN 'INCOMPLETE' END AS buyer_id_flag,
                  CASE WHEN r.buyer_id = 'B-7' THEN 'TEST_ENTITY' END AS test_entity_flag
           FROM releases r LEFT JOIN (
               SELECT buyer_id, buyer_name FROM releases WHERE buyer_name IS NOT NULL GROUP BY 1, 2
               QUALIFY row_number() OVER (PARTITION BY buyer_id ORDER BY count(*) DESC, max(release_seq) DESC) = 1) n
             ON n.buyer_id = r.buyer_id
           WHERE r.buyer_id IS NOT NULL GROUP BY r.buyer_id""",
    ),
    (
        "sobs",
        """SELECT supplier_id, raw, release_seq, src, nullif(trim(raw, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)), '') AS name
           FROM (SELECT party_id AS supplier_id, party_name_raw AS raw, release_seq, 'P' AS src FROM parties WHERE roles = 'supplier'
                 UNION ALL SELECT supplier_id, supplier_name_raw, release_seq, 'A' FROM award_suppliers)""",
    ),
    (
        "dim_supplier",
        """SELECT supplier_id, count(DISTINCT name) AS name_variant_count, bool_or(src = 'P') AS in_supplier_parties,
                  bool_or(src = 'A') AS in_award_suppliers,
                  (SELECT arg_max(s2.raw, (s2.release_seq, s2.raw)) FROM sobs s2 WHERE s2.supplier_id = s.supplier_id AND s2.name =
                     (SELECT name FROM sobs s3 WHERE s3.supplier_id = s.supplier_id AND name IS NOT NULL GROUP BY name
                      ORDER BY count(*) DESC, max(release_seq) DESC, name DESC LIMIT 1)) AS supplier_name_raw,
                  CASE WHEN supplier_id = 'S-' THEN 'INCOMPLETE' END AS supplier_id_flag
           FROM sobs s GROUP BY supplier_id""",
    ),
    (
        "sup",
        """SELECT *, trim(regexp_replace(supplier_name_raw, '\\s+', ' ', 'g')) AS supplier_name FROM dim_supplier""",
    ),
    (
        "budget_lines",
        """SELECT p.* FROM planning p WHERE budget_project_id IS NOT NULL AND release_seq =
             (SELECT max(q.release_seq) FROM planning q WHERE q.ocid = p.ocid AND q.budget_project_id = p.budget_project_id)""",
    ),
    (
        "snap",
        """SELECT r.ocid, count(*) AS release_count, arg_max(r.release_id, r.release_seq) AS latest_release_id,
                  arg_max(r.buyer_id, r.release_seq) AS buyer_id, max(stage) AS stage,
                  max(t.release_seq) AS tseq, max(a.release_seq) AS aseq,
                  concat_ws(',', CASE WHEN max(a.release_seq) IS NOT NULL THEN 'award' END, CASE WHEN max(stage) >= 4 THEN 'contract' END,
                    CASE WHEN max(stage) = 5 THEN 'implementation' END, 'planning',
                    CASE WHEN max(t.release_seq) IS NOT NULL THEN 'tender' END) AS tags
           FROM releases r LEFT JOIN tender t ON t.release_id = r.release_id LEFT JOIN awards a ON a.release_id = r.release_id
           GROUP BY r.ocid""",
    ),
    ("lc", "SELECT ocid, count(*) AS n FROM budget_lines GROUP BY ocid"),
    (
        "process_snapshot",
        """SELECT s.ocid, s.release_count, s.latest_release_id, s.buyer_id, s.stage, s.tags,
                  s.tseq::VARCHAR AS tender_release_id, 'T' || s.tseq::VARCHAR AS tender_id,
                  s.aseq::VARCHAR AS award_release_id, 'A' || s.aseq::VARCHAR AS award_id, c.contract_id,
                  coalesce(lc.n, 0) AS budget_line_count, CASE WHEN lc.n > 1 THEN 'MULTI_PROJECT' END AS multi_project_flag
           FROM snap s LEFT JOIN contracts c ON c.release_seq = s.aseq LEFT JOIN lc ON lc.ocid = s.ocid""",
    ),
    (
        "ps",
        """SELECT s.*, d.buyer_name, d.buyer_id_flag FROM process_snapshot s JOIN dim_buyer d ON d.buyer_id = s.buyer_id
           WHERE s.buyer_id <> 'B-7'""",
    ),
    (
        "budget_eligible",
        """SELECT b.ocid, b.budget_project_id, b.release_id, b.buyer_id, d.buyer_name, b.budget_amount, b.budget_currency,
                  CASE WHEN lc.n > 1 THEN 'MULTI_PROJECT' END AS multi_project_flag
           FROM budget_lines b JOIN dim_buyer d ON d.buyer_id = b.buyer_id JOIN lc ON lc.ocid = b.ocid
           WHERE b.budget_amount > 0 AND b.budget_amount < 495000 AND b.party_flag IS NULL AND b.buyer_id NOT IN ('B-', 'B-7')""",
    ),
    (
        "competition",
        """SELECT p.ocid, p.buyer_id, p.buyer_name, p.buyer_id_flag, p.tender_release_id, p.tender_id, t.method,
                  t.status AS tender_status, t.number_of_tenderers, t.tenderer_count_flag,
                  t.number_of_tenderers <= 8 AS prim, t.number_of_tenderers = 1 AS single
           FROM ps p JOIN tender t ON t.release_id = p.tender_release_id
           WHERE t.status IS NOT NULL AND t.number_of_tenderers <= 11""",
    ),
    (
        "awv",
        """SELECT p.ocid, p.award_id, p.award_release_id, p.buyer_id, p.buyer_name, p.buyer_id_flag, t.method,
                  a.value, a.award_date, a.award_date_flag, p.budget_line_count
           FROM ps p JOIN awards a ON a.award_id = p.award_id LEFT JOIN tender t ON t.release_id = p.tender_release_id
           WHERE a.status = 'active' AND a.value > 0 AND a.value < 600000""",
    ),
    ("asup", "SELECT DISTINCT award_id, supplier_id FROM award_suppliers"),
    (
        "sav",
        """SELECT w.*, x.supplier_id, u.supplier_name, u.name_variant_count,
                  count(*) OVER (PARTITION BY w.award_id) AS distinct_supplier_count
           FROM awv w JOIN asup x ON x.award_id = w.award_id JOIN sup u ON u.supplier_id = x.supplier_id
           WHERE x.supplier_id <> 'S-'""",
    ),
    (
        "bva",
        """SELECT w.*, b.budget_project_id, b.budget_amount AS budget, w.value - b.budget_amount AS variance,
                  round(w.value::DOUBLE / b.budget_amount::DOUBLE, 4) AS ratio
           FROM awv w JOIN budget_lines b ON b.ocid = w.ocid
           WHERE w.budget_line_count = 1 AND b.budget_amount > 0 AND b.budget_amount < 495000""",
    ),
    (
        "tde",
        """SELECT p.ocid, p.tender_release_id, p.buyer_id, p.buyer_name, p.buyer_id_flag, t.method, t.tender_start_date, t.tender_end_date,
                  (t.tender_end_date - t.tender_start_date)::INT AS days
           FROM ps p JOIN tender t ON t.release_id = p.tender_release_id
           WHERE t.tender_start_date_flag = 'VALID' AND t.tender_end_date_flag = 'VALID' AND t.tender_end_date >= t.tender_start_date""",
    ),
    (
        "ale",
        """SELECT p.ocid, p.award_id, p.buyer_id, p.buyer_name, p.buyer_id_flag, t.method, a.status AS award_status, t.tender_start_date,
                  a.award_date, (a.award_date - t.tender_start_date)::INT AS days
           FROM ps p JOIN tender t ON t.release_id = p.tender_release_id JOIN awards a ON a.award_id = p.award_id
           WHERE t.tender_start_date_flag = 'VALID' AND a.award_date_flag = 'VALID' AND a.award_date >= t.tender_start_date""",
    ),
    (
        "sle",
        """SELECT p.ocid, p.contract_id, p.buyer_id, p.buyer_name, p.buyer_id_flag, a.award_date, c.date_signed,
                  (c.date_signed - a.award_date)::INT AS days
           FROM ps p JOIN awards a ON a.award_id = p.award_id JOIN contracts c ON c.contract_id = p.contract_id
           WHERE a.award_date_flag = 'VALID' AND c.date_signed_flag = 'VALID' AND c.date_signed >= a.award_date""",
    ),
    (
        "cic",
        """SELECT p.ocid, p.contract_id, c.release_id AS contract_release_id, p.buyer_id, p.buyer_name, p.buyer_id_flag,
                  c.status AS contract_status, c.has_implementation,
                  (SELECT count(*) FROM transactions x WHERE x.contract_id = c.contract_id) AS tx,
                  (SELECT count(*) FROM milestones m WHERE m.contract_id = c.contract_id AND m.milestone_source = 'IMPLEMENTATION') AS ms
           FROM ps p JOIN contracts c ON c.contract_id = p.contract_id""",
    ),
    (
        "eb",
        """SELECT d.buyer_id, d.buyer_name, p.process_count, p.processes_reaching_tender,
                  round(p.processes_reaching_tender::DOUBLE / p.process_count, 4) AS tender_reach_rate, p.processes_reaching_award,
                  b.budget_line_n, b.planned_budget_total, c.competition_n, c.median_tenderers, c.single_bidder_rate,
                  a.award_n, a.award_value_total, a.median_award_value, k.distinct_supplier_n, k.top_supplier_value_share,
                  i.contract_n, i.implementation_coverage_rate
           FROM dim_buyer d
           JOIN (SELECT buyer_id, count(*) AS process_count, count(*) FILTER (stage >= 2) AS processes_reaching_tender,
                        count(*) FILTER (stage >= 3) AS processes_reaching_award FROM ps GROUP BY 1) p ON p.buyer_id = d.buyer_id
           LEFT JOIN (SELECT buyer_id, count(*) AS budget_line_n, sum(budget_amount) AS planned_budget_total
                      FROM budget_eligible GROUP BY 1) b ON b.buyer_id = d.buyer_id
           LEFT JOIN (SELECT buyer_id, count(*) FILTER (prim) AS competition_n,
                             quantile_cont(number_of_tenderers::DOUBLE, 0.5) FILTER (prim) AS median_tenderers,
                             round(avg(single::INT) FILTER (prim), 4) AS single_bidder_rate FROM competition GROUP BY 1) c ON c.buyer_id = d.buyer_id
           LEFT JOIN (SELECT buyer_id, count(*) AS award_n, sum(value) AS award_value_total,
                             round(quantile_cont(value::DOUBLE, 0.5)::DECIMAL(38,6), 2)::DOUBLE AS median_award_value FROM awv GROUP BY 1) a ON a.buyer_id = d.buyer_id
           LEFT JOIN (SELECT buyer_id, count(*) AS distinct_supplier_n, round(max(v)::DOUBLE / sum(v)::DOUBLE, 4) AS top_supplier_value_share
                      FROM (SELECT buyer_id, supplier_id, sum(value) AS v FROM sav GROUP BY 1, 2) GROUP BY 1) k ON k.buyer_id = d.buyer_id
           LEFT JOIN (SELECT buyer_id, count(*) AS contract_n, round(avg(has_implementation::INT), 4) AS implementation_coverage_rate
                      FROM cic GROUP BY 1) i ON i.buyer_id = d.buyer_id
           WHERE d.buyer_id NOT IN ('B-', 'B-7')""",
    ),
    (
        "pairs",
        """SELECT a.award_id, a.supplier_id, b.award_id AS sibling_award_id, b.value AS sibling_award_value
           FROM sav a JOIN sav b ON b.supplier_id = a.supplier_id AND b.buyer_id = a.buyer_id AND b.award_id <> a.award_id
           WHERE a.buyer_id <> 'B-'
           QUALIFY row_number() OVER (PARTITION BY a.award_id ORDER BY b.value DESC, b.award_id) = 1""",
    ),
    (
        "asf",
        """SELECT w.ocid, w.award_id, w.buyer_id, w.buyer_name, w.method, q.supplier_id, w.value, b.budget_project_id, b.budget, b.ratio,
                  q.sibling_award_id, q.sibling_award_value, round(w.value::DOUBLE / q.sibling_award_value::DOUBLE, 1) AS ratio_to_sibling,
                  coalesce(w.value = floor(w.value) AND w.value >= 5 * b.budget AND w.value <= 20 * b.budget, false) AS dd,
                  coalesce(w.value >= 10 * q.sibling_award_value, false) AS sl
           FROM awv w LEFT JOIN bva b ON b.award_id = w.award_id LEFT JOIN pairs q ON q.award_id = w.award_id
           WHERE dd OR sl""",
    ),
    (
        "reg",
        """SELECT * FROM (VALUES
             (1, 'M-P01', (SELECT count(*) FROM budget_lines WHERE buyer_id <> 'B-7'), (SELECT count(*) FROM budget_eligible)),
             (2, 'M-C01 / M-C02', (SELECT count(tender_id) FROM ps), (SELECT count(*) FROM competition WHERE prim)),
             (3, 'M-C01 (sensitivity)', (SELECT count(tender_id) FROM ps), (SELECT count(*) FROM competition)),
             (4, 'M-V01', (SELECT count(award_id) FROM ps), (SELECT count(*) FROM awv)),
             (5, 'M-S01', (SELECT count(*) FROM awv), (SELECT count(DISTINCT award_id) FROM sav)),
             (6, 'P4-BvA', (SELECT count(*) FROM awv), (SELECT count(*) FROM bva)),
             (7, 'M-E01', (SELECT count(tender_id) FROM ps), (SELECT count(*) FROM tde)),
             (8, 'M-E02', (SELECT count(*) FROM ps WHERE tender_id IS NOT NULL AND award_id IS NOT NULL), (SELECT count(*) FROM ale)),
             (9, 'P5-SIG', (SELECT count(contract_id) FROM ps), (SELECT count(*) FROM sle)),
             (10, 'M-E03', (SELECT count(*) FROM ps), (SELECT count(*) FROM ps)),
             (11, 'M-I01', (SELECT count(contract_id) FROM ps), (SELECT count(*) FROM cic)),
             (12, 'ENTITY', (SELECT count(*) FROM dim_buyer WHERE buyer_id <> 'B-7'), (SELECT count(*) FROM eb))
           ) t(ord, metric_id, cand, elig)""",
    ),
]


def with_tables(select: str) -> str:
    head = ",\n".join(f"{name} AS ({body})" for name, body in CTES)
    return f"WITH {head}\n{select}"
