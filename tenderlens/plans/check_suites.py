"""The validation suites: keys, nulls, references, reconciliation, validity,
entities, layers, observations, views, questions, dimensions, scale flag."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenderlens.functions import flags
from tenderlens.operators.latest import latest_by_max
from tenderlens.operators.checks import Check, count, orphans, probe, repeats, suite
from tenderlens.operators.latest import latest_by_max, latest_per_key, text_order_disagrees
from tenderlens.operators.order_stats import exact_percentiles
from tenderlens.plans.common import rows, sum_if, union
from tenderlens.plans.core import supplier_observations
from tenderlens.plans.views import METHOD_VIEWS, median, method
from tenderlens.sources.package import source_profile, source_totals

MONEY_COLUMNS = [
    ("planning", "budget_amount", "budget_currency"),
    ("tender", "tender_value_amount", "tender_value_currency"),
    ("awards", "award_value_amount", "award_value_currency"),
    ("contracts", "contract_value_amount", "contract_value_currency"),
    ("transactions", "transaction_value", "transaction_currency"),
]
DATE_COLUMNS = [
    ("tender", "tender_start_date"),
    ("tender", "tender_end_date"),
    ("awards", "award_date"),
    ("contracts", "date_signed"),
    ("contracts", "period_start_date"),
    ("contracts", "period_end_date"),
    ("milestones", "due_date"),
    ("milestones", "date_met"),
]
FACT_VIEWS = [
    "budget_eligible", "competition_eligible", "award_value_eligible", "supplier_award_eligible",
    "budget_award_comparison", "tender_duration_eligible", "award_lag_eligible", "signature_lag_eligible",
    "lifecycle_stage", "contract_implementation_coverage", "entity_benchmark",
]


def _tables(ws) -> dict[str, DataFrame]:
    c = ws.core
    return {
        **c.stg.tables(),
        "dim_buyer": c.dim_buyer,
        "dim_supplier": c.dim_supplier,
        "budget_lines": c.budget_lines,
        "process_snapshot": c.process_snapshot,
    }


def _pin(expected: dict | None, check_id: str):
    return (expected or {}).get(check_id)


def _money(c):
    return c.cast("decimal(38,4)")


# ------------------------------------------------------------------ 1 keys
KEYS = [
    ("UQ-01", "releases", ["release_id"]),
    ("UQ-02", "releases", ["release_seq"]),
    ("UQ-03", "planning", ["release_id"]),
    ("UQ-04", "tender", ["release_id"]),
    ("UQ-05", "tender", ["tender_id"]),
    ("UQ-06", "awards", ["award_id"]),
    ("UQ-07", "award_suppliers", ["award_id", "supplier_seq"]),
    ("UQ-08", "contracts", ["contract_id"]),
    ("UQ-09", "contracts", ["award_id"]),
    ("UQ-10", "transactions", ["contract_id", "transaction_id"]),
    ("UQ-11", "milestones", ["contract_id", "milestone_source", "milestone_id"]),
    ("UQ-12", "parties", ["release_id", "party_id", "party_name_raw"]),
    ("UQ-13", "parties", ["release_id", "party_id"]),
    ("UQ-14", "dim_buyer", ["buyer_id"]),
    ("UQ-15", "dim_supplier", ["supplier_id"]),
    ("UQ-16", "process_snapshot", ["ocid"]),
    ("UQ-17", "budget_lines", ["ocid", "budget_project_id"]),
]


def key_uniqueness(ws) -> DataFrame:
    t = _tables(ws)
    probes = [
        probe(t[name], [Check(cid, f"{name} ({', '.join(keys)})", repeats(keys), "0")]) for cid, name, keys in KEYS
    ]
    spans = t["planning"].filter(F.col("budget_project_id").isNotNull()).groupBy("budget_project_id").agg(
        F.count_distinct("ocid").alias("n")
    ).filter("n > 1")
    probes.append(probe(spans, [Check("UQ-18", "budget project never spans several processes", rows(), "0")]))
    return suite("Key uniqueness", probes)


# ------------------------------------------------------------------ 2 nulls
NULLS = [
    ("releases", [("NL-01", "ocid", "0"), ("NL-02", "buyer_id", "0"), ("NL-14", "buyer_name", None)]),
    ("tender", [("NL-03", "tender_id", "0"), ("NL-07", "number_of_tenderers", "0"),
                ("NL-10", "tender_start_date", None), ("NL-11", "tender_end_date", None)]),
    ("contracts", [("NL-04", "award_id", "0"), ("NL-13", "date_signed", None)]),
    ("award_suppliers", [("NL-05", "supplier_id", "0")]),
    ("parties", [("NL-06", "party_id", "0")]),
    ("awards", [("NL-08", "award_value_amount", "0"), ("NL-12", "award_date", None), ("NL-16", "status", None)]),
    ("planning", [("NL-09", "budget_amount", None)]),
    ("dim_buyer", [("NL-17", "buyer_name", None)]),
    ("dim_supplier", [("NL-18", "supplier_name", None)]),
]


def null_rates(ws, expected: dict | None = None) -> DataFrame:
    t = _tables(ws)
    probes = [
        probe(
            t[name],
            [Check(cid, f"{name}.{c} NULL", F.count_if(F.col(c).isNull()), _pin(expected, cid) or default)
             for cid, c, default in checks],
        )
        for name, checks in NULLS
    ]
    no_parties = F.count_if(F.col("party_flag") == "NO_PARTIES")
    probes.append(probe(t["releases"], [Check("NL-15", "releases without parties", no_parties, _pin(expected, "NL-15"))]))
    return suite("Null rates", probes)


# ------------------------------------------------------------------ 3 references
REFERENCES = [
    ("RI-01", "planning", "release_id", "releases", None),
    ("RI-02", "tender", "release_id", "releases", None),
    ("RI-03", "awards", "release_id", "releases", None),
    ("RI-04", "award_suppliers", "award_id", "awards", None),
    ("RI-05", "contracts", "release_id", "releases", None),
    ("RI-06", "contracts", "award_id", "awards", None),
    ("RI-08", "transactions", "contract_id", "contracts", None),
    ("RI-09", "milestones", "contract_id", "contracts", None),
    ("RI-10", "parties", "release_id", "releases", None),
    ("RI-11", "releases", "buyer_id", "dim_buyer", None),
    ("RI-12", "award_suppliers", "supplier_id", "dim_supplier", None),
    ("RI-14", "process_snapshot", "buyer_id", "dim_buyer", None),
    ("RI-15", "budget_lines", "buyer_id", "dim_buyer", None),
]


def referential_integrity(ws) -> DataFrame:
    t = _tables(ws)
    probes = [
        probe(orphans(t[child], key, t[parent], pk), [Check(cid, f"{child}.{key} -> {parent}", rows(), "0")])
        for cid, child, key, parent, pk in REFERENCES
    ]
    award_release = t["awards"].select("award_id", F.col("release_id").alias("award_release"))
    moved = t["contracts"].join(award_release, "award_id").filter(F.col("award_release") != F.col("release_id"))
    probes.append(probe(moved, [Check("RI-07", "contract and its award share a release", rows(), "0")]))
    party = t["parties"].filter(F.array_contains("roles", "supplier"))
    probes.append(
        probe(orphans(party, "party_id", t["dim_supplier"], "supplier_id"),
              [Check("RI-13", "supplier-role parties -> dim_supplier", rows(), "0")])
    )
    snap = t["process_snapshot"]
    unlinked = snap.filter(F.col("contract_id").isNull() & F.col("award_id").isNotNull()).join(
        t["contracts"].select("award_id"), "award_id", "left_semi"
    )
    probes.append(probe(unlinked, [Check("RI-16", "snapshot award carries its contract", rows(), "0")]))
    picks = union(
        [
            snap.filter(F.col(c).isNotNull()).select("ocid", F.col(c).alias("release_id"))
            for c in ("tender_release_id", "award_release_id")
        ]
    )
    foreign = picks.join(t["releases"].select("release_id", "ocid"), ["release_id", "ocid"], "left_anti")
    probes.append(probe(foreign.select("ocid").distinct(), [Check("RI-17", "picked releases belong to the process", rows(), "0")]))
    return suite("Referential integrity", probes)


# ------------------------------------------------------------------ 4 release reconciliation
def release_reconciliation(ws, expected: dict | None = None) -> DataFrame:
    t = _tables(ws)
    stg, snap, lines = ws.stg, t["process_snapshot"], t["budget_lines"]
    with_project = stg.planning.filter(F.col("budget_project_id").isNotNull())
    alt_budget = latest_by_max(with_project, ["ocid", "budget_project_id"], "release_seq")
    alt_award = latest_by_max(stg.awards, ["ocid"], "release_seq")
    picked = snap.select("award_id").join(stg.awards.select("award_id", "award_value_amount"), "award_id")
    award, budget = _money(F.sum("award_value_amount")), _money(F.sum("budget_amount"))

    def processes(df):
        return df.agg(F.count_distinct("ocid")).scalar()

    multi = F.col("multi_project_flag") == "MULTI_PROJECT"
    not_extreme = sum_if(F.col("budget_amount_flag").isNull(), F.col("budget_amount"))
    unit = F.round(not_extreme.cast("double") / ws.rules.unit, 1)
    disagree = text_order_disagrees(stg.releases, "ocid", "release_id", "release_seq")
    probes = [
        probe(snap, [
            Check("RL-01", "snapshot rows = processes in staging", rows(), processes(stg.releases)),
            Check("RL-02", "multi-release processes", F.count_if(F.col("release_count") > 1), _pin(expected, "RL-02")),
            Check("RL-04", "processes flagged MULTI_PROJECT", F.count_if(multi), _pin(expected, "RL-04")),
            Check("RL-07", "processes with a tender", F.count("tender_id"), processes(stg.tender)),
            Check("RL-08", "processes with an award", F.count("award_id"), processes(stg.awards)),
        ]),
        probe(lines, [
            Check("RL-03", "budget lines", rows(), _pin(expected, "RL-03")),
            Check("RL-05", "budget total without extreme lines", unit, _pin(expected, "RL-05")),
            Check("RL-06", "budget total = independent formulation", budget, alt_budget.agg(budget).scalar()),
        ]),
        probe(picked, [
            Check("RL-09", "snapshot award total = independent formulation", award, alt_award.agg(award).scalar()),
            Check("RL-11", "award value, one award per process", award),
        ]),
        probe(stg.awards, [Check("RL-10", "award value over all releases (double counts)", award)]),
        probe(stg.planning, [Check("RL-12", "budget over all releases (double counts)", budget)]),
        probe(disagree, [Check("RL-13", "processes where text order picks another release", rows(), _pin(expected, "RL-13"))]),
    ]
    return suite("Release reconciliation", probes)


# ------------------------------------------------------------------ 5 money and dates
def monetary_and_dates(ws, expected: dict | None = None) -> DataFrame:
    stg, r = ws.stg, ws.rules
    money = union(
        [
            getattr(stg, tbl).select(F.lit(tbl).alias("t"), F.col(a).alias("amount"), F.col(c).alias("currency"))
            for tbl, a, c in MONEY_COLUMNS
        ]
    )
    amount, currency = F.col("amount"), F.col("currency")
    needs = F.col("t").isin("planning", "awards")
    dates = union(
        [
            getattr(stg, tbl).select(F.col(c).alias("day"), F.col(f"{c}_flag").alias("flag"))
            for tbl, c in DATE_COLUMNS
        ]
    )

    def flagged(cid, name, column, value):
        return Check(cid, name, F.count_if(F.col(column) == value), _pin(expected, cid))

    def both_valid(a, b, first, second):
        return (F.col(a) == "VALID") & (F.col(b) == "VALID") & (F.col(second) < F.col(first))

    pairs = stg.awards.join(stg.tender.select("release_id", "tender_start_date", "tender_start_date_flag"), "release_id")
    signed = stg.contracts.select("award_id", "date_signed", "date_signed_flag").join(
        stg.awards.select("award_id", "award_date", "award_date_flag"), "award_id"
    )
    probes = [
        probe(money, [
            Check("MD-01", "negative amounts", F.count_if(amount < 0), "0"),
            Check("MD-02", "foreign currency codes", F.count_if(currency != r.currency), "0"),
            Check("MD-03", "amount without currency", F.count_if(needs & amount.isNotNull() & currency.isNull()), "0"),
        ]),
        probe(stg.planning, [
            flagged("MD-04", "extreme budgets", "budget_amount_flag", "EXTREME"),
            flagged("MD-06", "zero budgets", "budget_monetary_flag", "ZERO_VALUE"),
        ]),
        probe(stg.awards, [
            flagged("MD-05", "extreme awards", "award_value_flag", "EXTREME"),
            flagged("MD-08", "zero awards", "award_monetary_flag", "ZERO_VALUE"),
            flagged("MD-13", "placeholder award dates", "award_date_flag", "PLACEHOLDER"),
            flagged("MD-15", "impossible award dates", "award_date_flag", "IMPOSSIBLE"),
        ]),
        probe(stg.tender, [
            flagged("MD-07", "zero tender values", "tender_value_monetary_flag", "ZERO_VALUE"),
            flagged("MD-09", "anomalous tenderer counts", "tenderer_count_flag", "ANOMALOUS"),
            flagged("MD-10", "elevated tenderer counts", "tenderer_count_flag", "ELEVATED"),
            flagged("MD-12", "placeholder tender starts", "tender_start_date_flag", "PLACEHOLDER"),
            Check("MD-17", "tender end before start", F.count_if(
                both_valid("tender_start_date_flag", "tender_end_date_flag", "tender_start_date", "tender_end_date"))),
        ]),
        probe(dates, [Check("MD-11", "date and flag NULL together",
                            F.count_if(F.col("day").isNull() != F.col("flag").isNull()), "0")]),
        probe(stg.contracts, [
            flagged("MD-14", "placeholder signature dates", "date_signed_flag", "PLACEHOLDER"),
            Check("MD-20", "contract period ends before it starts", F.count_if(
                both_valid("period_start_date_flag", "period_end_date_flag", "period_start_date", "period_end_date"))),
        ]),
        probe(stg.milestones, [flagged("MD-16", "placeholder milestone due dates", "due_date_flag", "PLACEHOLDER")]),
        probe(pairs, [Check("MD-18", "award before tender start", F.count_if(
            both_valid("tender_start_date_flag", "award_date_flag", "tender_start_date", "award_date")))]),
        probe(signed, [Check("MD-19", "signed before award", F.count_if(
            both_valid("award_date_flag", "date_signed_flag", "award_date", "date_signed")))]),
    ]
    return suite("Monetary and date validity", probes)


# ------------------------------------------------------------------ 6 entities
def entity_consistency(ws, expected: dict | None = None) -> DataFrame:
    stg, core, r = ws.stg, ws.core, ws.rules
    party = stg.parties.filter(F.array_contains("roles", "supplier")).select(
        "release_id", "party_id", flags.strict_trim(F.col("party_name_raw")).alias("name"), "supplier_id_flag"
    )
    named = party.filter(F.col("name").isNotNull()).select("party_id", "name").distinct()

    def several(df, key):
        return df.groupBy(key).agg(rows().alias("n")).filter("n > 1")

    buyer_names = stg.releases.filter(F.col("buyer_name").isNotNull()).select("buyer_id", "buyer_name").distinct()
    ids = supplier_observations(stg.parties, stg.award_suppliers).agg(F.count_distinct("supplier_id")).scalar()
    per_award = stg.award_suppliers.select("award_id", "supplier_id").distinct().groupBy("award_id").agg(rows().alias("n"))
    linked = stg.award_suppliers.join(stg.awards.select("award_id", "release_id"), "award_id").join(
        party.select("release_id", "party_id"), "release_id"
    )
    incomplete = F.col("buyer_id_flag") == "INCOMPLETE"
    test = F.col("test_entity_flag") == "TEST_ENTITY"
    complete = F.col("buyer_id") != r.bare_buyer_id
    buyers = stg.releases.agg(F.count_distinct("buyer_id")).scalar()
    complete_buyers = stg.releases.filter(complete).agg(F.count_distinct("buyer_id")).scalar()
    bare_releases = stg.releases.agg(F.count_if(~complete)).scalar()
    suspicious = flags.looks_like_test([F.col("buyer_id"), F.col("buyer_name_raw")], r)
    pin = lambda cid: _pin(expected, cid)
    probes = [
        probe(core.dim_buyer, [
            Check("EN-01", "dim_buyer rows = distinct buyer ids", rows(), buyers),
            Check("EN-02", "complete buyer ids", F.count_if(F.col("buyer_id_flag").isNull()), complete_buyers),
            Check("EN-03", "releases of the bare buyer id", sum_if(incomplete, F.col("release_count")), bare_releases),
            Check("EN-15", "buyers flagged as test entity", F.count_if(test), "1"),
            Check("EN-16", "the flagged buyer is the configured one", F.max(F.when(test, F.col("buyer_id"))), r.test_buyer_id),
            Check("EN-19", "other buyers with a test-like whole word", F.count_if(
                F.col("test_entity_flag").isNull() & suspicious), "0"),
        ]),
        probe(several(buyer_names, "buyer_id"), [Check("EN-04", "buyer ids with several names", rows(), "0")]),
        probe(core.dim_supplier, [
            Check("EN-05", "dim_supplier rows = distinct supplier ids", rows(), ids),
            Check("EN-06", "suppliers seen as party", F.count_if("in_supplier_parties"), pin("EN-06")),
            Check("EN-07", "suppliers seen only on awards", F.count_if(~F.col("in_supplier_parties"))),
        ]),
        probe(stg.awards.join(party.select("release_id"), "release_id", "left_anti"),
              [Check("EN-08", "awards without a supplier party", rows())]),
        probe(several(named, "party_id"), [Check("EN-09", "supplier ids with several names", rows(), pin("EN-09"))]),
        probe(several(named, "name"), [Check("EN-10", "supplier names with several ids", rows(), pin("EN-10"))]),
        probe(party, [Check("EN-11", "supplier parties with the bare id", F.count_if(
            F.col("supplier_id_flag") == "INCOMPLETE"), pin("EN-11"))]),
        probe(stg.award_suppliers, [Check("EN-12", "award suppliers with the bare id", F.count_if(
            F.col("supplier_id") == r.bare_supplier_id))]),
        probe(per_award, [Check("EN-13", "most distinct suppliers on an award", F.max("n"), "1")]),
        probe(linked, [Check("EN-14", "award supplier differs from supplier party", F.count_if(
            F.col("party_id") != F.col("supplier_id")), "0")]),
        probe(stg.releases, [Check("EN-17", "releases of the test entity kept", F.count_if(
            F.col("buyer_id") == r.test_buyer_id), pin("EN-17"))]),
        probe(core.process_snapshot, [Check("EN-18", "processes of the test entity kept", F.count_if(
            F.col("buyer_id") == r.test_buyer_id), pin("EN-18"))]),
    ]
    return suite("Entity consistency", probes)


# ------------------------------------------------------------------ 7 layers
def layer_reconciliation(ws) -> DataFrame:
    """Counts taken from the nested documents against staging and core."""
    t = _tables(ws)
    raw = source_totals(ws.releases, ws.rules)
    names = ["releases", "planning", "tender", "awards", "award_suppliers", "contracts", "transactions",
             "milestones", "parties"]

    def source(item):
        return raw.select(item.replace(".", "__")).scalar()

    probes = [
        probe(t[n], [Check(f"LR-{i:02d}", f"documents = {n}", rows(), source(f"count.{n}"))])
        for i, n in enumerate(names, start=1)
    ]
    pairs = t["planning"].filter(F.col("budget_project_id").isNotNull()).select("ocid", "budget_project_id").distinct()
    probes += [
        probe(t["process_snapshot"], [
            Check("LR-10", "document processes = snapshot", rows(), source("count.processes")),
            Check("LR-13", "releases = sum of snapshot release counts", F.sum("release_count"), count(t["releases"])),
        ]),
        probe(t["dim_buyer"], [
            Check("LR-11", "distinct buyer ids = dim_buyer", rows(),
                  t["releases"].agg(F.count_distinct("buyer_id")).scalar()),
            Check("LR-12", "releases = sum of dim_buyer release counts", F.sum("release_count"), count(t["releases"])),
        ]),
        probe(t["budget_lines"], [Check("LR-14", "distinct (process, project) = budget lines", rows(), count(pairs))]),
    ]
    return suite("Layer reconciliation", probes)


# ------------------------------------------------------------------ 8 observations
def observations(ws) -> DataFrame:
    stg = ws.stg

    def of(part):
        return F.concat(part.cast("string"), F.lit(" of "), rows().cast("string"))

    awards = stg.awards.select("release_id", "award_id", "award_value_amount")
    same_release = stg.tender.select("release_id", "tender_value_amount").join(awards, "release_id")
    contracts = stg.contracts.select("award_id", "contract_value_amount").join(awards, "award_id")
    lonely = stg.tender.join(awards, "release_id", "left_anti")
    per_award = stg.award_suppliers.groupBy("award_id", "supplier_id").agg(rows().alias("n"))
    repeated = per_award.groupBy("award_id").agg(F.sum("n").alias("n"), rows().alias("d")).filter("n > d")
    award = F.col("award_value_amount")
    probes = [
        probe(same_release, [Check("OB-01", "tender value = award value", of(F.count_if(F.col("tender_value_amount") == award)))]),
        probe(contracts, [Check("OB-02", "contract value = award value", of(F.count_if(F.col("contract_value_amount") == award)))]),
        probe(lonely, [Check("OB-03", "tenders without award at value zero", of(F.count_if(F.col("tender_value_amount") == 0)))]),
        probe(per_award, [Check("OB-04", "repeated supplier entries", F.sum("n") - rows())]),
        probe(repeated, [Check("OB-05", "awards with repeated supplier entries", rows())]),
    ]
    return suite("Observations", probes)


# ------------------------------------------------------------------ 9 views
def _independent(ws) -> dict[str, DataFrame]:
    """The populations again, from staging, by another formulation. The four
    base recounts feed dozens of checks, so each is written once."""
    stg, r = ws.stg, ws.rules
    owner = ws.table(
        "recount_owner",
        lambda: latest_by_max(stg.releases.select("ocid", "buyer_id", "release_seq"), ["ocid"], "release_seq").drop("release_seq"),
    )
    non_test = owner.filter(F.col("buyer_id") != r.test_buyer_id)
    keep = non_test.select("ocid")

    def newest(name):
        section = getattr(stg, name)
        return ws.table(
            f"recount_{name}", lambda: latest_by_max(section, ["ocid"], "release_seq").join(keep, "ocid", "left_semi")
        )

    award = newest("awards")
    line = ws.table(
        "recount_line",
        lambda: latest_by_max(
            stg.planning.filter(F.col("budget_project_id").isNotNull() & (F.col("buyer_id") != r.test_buyer_id)),
            ["ocid", "budget_project_id"], "release_seq",
        ),
    )
    usable = (F.col("status") == "active") & F.col("award_value_flag").isNull() & F.col("award_monetary_flag").isNull()
    per = line.groupBy("ocid").agg(rows().alias("n_lines"))
    return {
        "owner": owner,
        "non_test": non_test,
        "tender": newest("tender"),
        "award": award,
        "line": line,
        "award_ok": award.filter(usable),
        "per": per,
        "single": line.join(per.filter("n_lines = 1"), "ocid"),
    }


def _valid(*cols):
    out = F.lit(True)
    for c in cols:
        out = out & (F.col(c) == "VALID")
    return out


def analytical_views(ws) -> DataFrame:
    v, stg, r, i = ws.v, ws.stg, ws.rules, _independent(ws)
    ok_budget = F.col("budget_amount_flag").isNull() & F.col("budget_monetary_flag").isNull()
    status = F.col("status").isNotNull()
    m_p01 = i["line"].filter((F.col("budget_amount") >= 0) & ok_budget & F.col("party_flag").isNull()
                             & (F.col("buyer_id") != r.bare_buyer_id))
    primary = i["tender"].filter(status & (F.col("tenderer_count_flag") == "NORMAL"))
    wider = i["tender"].filter(status & F.col("tenderer_count_flag").isin("NORMAL", "ELEVATED"))
    complete = stg.award_suppliers.filter(F.col("supplier_id") != r.bare_supplier_id).select("award_id")
    m_s01 = i["award_ok"].join(complete, "award_id", "left_semi")
    bva = i["award_ok"].select("ocid").join(i["single"], "ocid").filter((F.col("budget_amount") > 0) & ok_budget)
    start = i["tender"].select("ocid", "tender_start_date", "tender_start_date_flag", "tender_end_date",
                               "tender_end_date_flag")
    dur = start.filter(_valid("tender_start_date_flag", "tender_end_date_flag")
                       & (F.col("tender_end_date") >= F.col("tender_start_date")))
    both = start.join(i["award"].select("ocid", "award_id", "award_date", "award_date_flag"), "ocid").filter(
        _valid("tender_start_date_flag", "award_date_flag"))
    lag = both.filter(F.col("award_date") >= F.col("tender_start_date"))
    signed = i["award"].select("award_id", "award_date", "award_date_flag").join(
        stg.contracts.select("award_id", "date_signed", "date_signed_flag"), "award_id"
    ).filter(_valid("award_date_flag", "date_signed_flag"))
    sig = signed.filter(F.col("date_signed") >= F.col("award_date"))
    with_contract = stg.contracts.select("ocid").distinct().join(i["non_test"].select("ocid"), "ocid", "left_semi")
    entities = i["non_test"].filter(F.col("buyer_id") != r.bare_buyer_id)
    days = union([
        v.tender_duration_eligible.select(F.col("tender_duration_days").alias("d"), F.col("tender_start_date").alias("a"),
                                          F.col("tender_end_date").alias("b")),
        v.award_lag_eligible.select("award_lag_days", "tender_start_date", "award_date").toDF("d", "a", "b"),
        v.signature_lag_eligible.select("signature_lag_days", "award_date", "date_signed").toDF("d", "a", "b"),
    ])
    facts = union([getattr(v, n).select("buyer_id") for n in FACT_VIEWS])
    placeholder = F.lit(r.placeholder_date).cast("date")
    award, complete_buyer = "award_value_amount", F.col("buyer_id_flag").isNull()
    m_e03 = v.metric_population.filter("metric_id = 'M-E03'")
    reg = F.concat(F.max("candidate_count").cast("string"), F.lit("/"), F.max("eligible_count").cast("string"))
    nt = count(i["non_test"]).cast("string")
    total_v, total_s = _money(F.sum(award)), v.supplier_award_eligible.agg(_money(F.sum(award))).scalar()
    no_line = i["award_ok"].select("ocid").join(i["per"], "ocid", "left")
    bad_single = i["award_ok"].select("ocid").join(i["single"], "ocid").filter(
        ~F.coalesce((F.col("budget_amount") > 0) & ok_budget, F.lit(False)))
    big = F.count_if(F.col(award) >= F.lit(r.extreme_award))
    probes = [
        probe(v.budget_eligible, [
            Check("AV-01", "M-P01 = recount", rows(), count(m_p01)),
            Check("SP-05", "bare buyer in the budget view", F.count_if(F.col("buyer_id") == r.bare_buyer_id), "0"),
        ]),
        probe(v.competition_eligible, [
            Check("AV-02", "M-C01 primary = recount", F.count_if("in_primary_population"), count(primary)),
            Check("AV-03", "M-C01 sensitivity = recount", rows(), count(wider)),
            Check("WF-09", "median tenderers, primary", median(F.col("number_of_tenderers"), F.col("in_primary_population"))),
        ]),
        probe(v.award_value_eligible, [
            Check("AV-04", "M-V01 = recount", rows(), count(i["award_ok"])),
            Check("SP-01", "extreme awards in M-V01", big, "0"),
        ]),
        probe(v.supplier_award_eligible, [
            Check("AV-05", "M-S01 awards = recount", F.count_distinct("award_id"), count(m_s01)),
            Check("AV-06", "M-S01 one row per award", rows(), v.supplier_award_eligible.agg(F.count_distinct("award_id")).scalar()),
            Check("AV-07", "M-S01 most suppliers per award", F.max("distinct_supplier_count"), "1"),
        ]),
        probe(v.supplier_award_eligible, [Check("SP-06", "award and supplier repeated", repeats(["award_id", "supplier_id"]), "0")]),
        probe(v.budget_award_comparison, [Check("AV-08", "budget to award = recount", rows(), count(bva))]),
        probe(v.tender_duration_eligible, [Check("AV-09", "M-E01 = recount", rows(), count(dur))]),
        probe(v.award_lag_eligible, [Check("AV-10", "M-E02 = recount", rows(), count(lag))]),
        probe(v.signature_lag_eligible, [Check("AV-11", "signature lag = recount", rows(), count(sig))]),
        probe(days, [
            Check("AV-12", "negative durations", F.count_if(F.col("d") < 0), "0"),
            Check("SP-04", "placeholder dates in a timing view", F.count_if((F.col("a") == placeholder) | (F.col("b") == placeholder)), "0"),
        ]),
        probe(v.lifecycle_stage, [Check("AV-13", "M-E03 = processes without the test entity", rows(), count(i["non_test"]))]),
        probe(v.contract_implementation_coverage, [Check("AV-14", "M-I01 = processes with a contract", rows(), count(with_contract))]),
        probe(v.entity_benchmark, [
            Check("AV-15", "incomplete buyers in the benchmark", F.count_if(F.col("buyer_id") == r.bare_buyer_id), "0"),
            Check("AV-16", "benchmark processes = recount", F.sum("process_count"), count(entities)),
            Check("AV-17", "benchmark budget = M-P01 total", _money(F.sum("planned_budget_total")),
                  v.budget_eligible.agg(_money(F.sum("budget_amount"))).scalar()),
            Check("AV-18", "benchmark award value = M-V01 total", _money(F.sum("award_value_total")),
                  v.award_value_eligible.filter(complete_buyer).agg(_money(F.sum(award))).scalar()),
        ]),
        probe(facts, [Check("AV-19", "test entity in any view", F.count_if(F.col("buyer_id") == r.test_buyer_id), "0")]),
        probe(ws.core.process_snapshot, [Check("AV-20", "test entity kept in the snapshot", F.count_if(
            F.col("buyer_id") == r.test_buyer_id), i["owner"].agg(F.count_if(F.col("buyer_id") == r.test_buyer_id)).scalar())]),
        probe(m_e03, [Check("AV-21", "register M-E03 = processes without the test entity", reg, F.concat(nt, F.lit("/"), nt))]),
        probe(i["award"], [
            Check("WF-01", "M-V01 excluded: status", F.count_if(~F.col("status").eqNullSafe("active"))),
            Check("WF-02", "M-V01 excluded: extreme or zero", F.count_if(
                (F.col("status") == "active") & (F.col("award_value_flag").isNotNull() | F.col("award_monetary_flag").isNotNull()))),
        ]),
        probe(v.award_value_eligible, [
            Check("WF-03", "M-S01 excluded awards", rows() - v.supplier_award_eligible.agg(F.count_distinct("award_id")).scalar()),
            Check("WF-04", "M-S01 excluded value", _money(total_v - total_s)),
            Check("WF-05", "M-S01 excluded share, %", F.round((1 - total_s.cast("double") / total_v.cast("double")) * 100, 2)),
        ]),
        probe(no_line, [
            Check("WF-06a", "budget to award excluded: no line", F.count_if(F.col("n_lines").isNull())),
            Check("WF-06b", "budget to award excluded: several lines", F.count_if(F.col("n_lines") > 1)),
        ]),
        probe(bad_single, [Check("WF-06c", "budget to award excluded: unusable line", rows())]),
        probe(both, [Check("WF-07", "M-E02 excluded: award before start", F.count_if(F.col("award_date") < F.col("tender_start_date")))]),
        probe(signed, [Check("WF-08", "signature lag excluded: signed before award", F.count_if(F.col("date_signed") < F.col("award_date")))]),
        probe(stg.tender, [Check("WF-10", "tender releases with a valid start", F.count_if(F.col("tender_start_date_flag") == "VALID"))]),
    ]
    return suite("Analytical views", probes)


def spot_checks(ws, records: list[tuple]) -> DataFrame:
    """Named records: (check id, view, key column, key, column, expected or None)."""
    by_view: dict[str, list[tuple]] = {}
    for record in records:
        by_view.setdefault(record[1], []).append(record)
    probes = []
    for view, wanted in by_view.items():
        checks = [
            Check(cid, f"{view}: {column} of {key}", F.max(F.when(F.col(key_column) == key, F.col(column).cast("string"))), expected)
            for cid, _, key_column, key, column, expected in wanted
        ]
        probes.append(probe(getattr(ws.v, view), checks))
    return suite("Spot checks", probes)


def record_checks(ws) -> DataFrame:
    """The corrections and suppliers that views show, against the staged releases, over all records and for the
    process that was corrected most often."""
    v, stg, r = ws.v, ws.stg, ws.rules
    award = "award_value_amount"
    last = latest_by_max(stg.awards.select("ocid", "award_id", "release_seq", award), ["ocid"], "release_seq")
    shown = v.award_value_eligible.select("ocid", F.col("award_id").alias("shown_id"), F.col(award).alias("shown"))
    both = shown.join(last, "ocid", "left")
    corrections = stg.awards.groupBy("ocid").agg(rows().alias("n")).join(shown.select("ocid"), "ocid", "left_semi")
    most = corrections.agg(F.min_by("ocid", F.struct(-F.col("n"), "ocid"))).scalar()
    chosen = last.filter(F.col("ocid") == most)
    suppliers = v.supplier_award_eligible
    named = stg.award_suppliers.filter(F.col("supplier_id") != r.bare_supplier_id).join(chosen.select("award_id"), "award_id", "left_semi")
    per_award = stg.award_suppliers.filter(F.col("supplier_id") != r.bare_supplier_id).select("award_id", "supplier_id").distinct()
    counted = suppliers.select("award_id").distinct().join(per_award, "award_id")
    probes = [
        probe(both, [
            Check("SP-02a", "award values that are not those of the latest correction", F.count_if(~F.col("shown").eqNullSafe(F.col(award))), "0"),
            Check("SP-02b", "awards shown that are not the latest of their process", F.count_if(~F.col("shown_id").eqNullSafe(F.col("award_id"))), "0"),
        ]),
        probe(shown.filter(F.col("ocid") == most), [
            Check("SP-02c", "value of the process corrected most often", F.max(F.col("shown").cast("string")),
                  chosen.agg(F.max(F.col(award).cast("string"))).scalar()),
            Check("SP-02d", "award of the process corrected most often", F.max("shown_id"), chosen.agg(F.max("award_id")).scalar()),
        ]),
        probe(suppliers, [
            Check("SP-03a", "awards under the placeholder supplier", F.count_if(F.col("supplier_id") == r.bare_supplier_id), "0"),
            Check("SP-03b", "award and supplier pairs", rows(), counted.agg(rows()).scalar()),
        ]),
        probe(suppliers.filter(F.col("ocid") == most), [
            Check("SP-03c", "suppliers of the process corrected most often", F.count_distinct("supplier_id"),
                  named.agg(F.count_distinct("supplier_id")).scalar()),
        ]),
    ]
    return suite("Spot checks", probes)


# ------------------------------------------------------------------ 10 questions
def business_questions(ws) -> DataFrame:
    v, stg, r, i = ws.v, ws.stg, ws.rules, _independent(ws)
    award = "award_value_amount"
    complete = stg.award_suppliers.filter(F.col("supplier_id") != r.bare_supplier_id).select("award_id", "supplier_id").distinct()
    mine = i["award_ok"].join(complete, "award_id").groupBy("supplier_id").agg(F.sum(award).alias("v"))
    view = v.supplier_award_eligible.groupBy("supplier_id").agg(F.sum(award).alias("v"))

    def ten(df):
        return df.orderBy(F.col("v").desc()).limit(10)

    ok_budget = (F.col("budget_amount") > 0) & F.col("budget_amount_flag").isNull() & F.col("budget_monetary_flag").isNull()
    bva = i["award_ok"].select("ocid", award).join(i["single"].filter(ok_budget).select("ocid", "budget_amount"), "ocid").withColumn(
        "ratio", F.round(F.col(award).cast("double") / F.col("budget_amount").cast("double"), 4))
    primary = i["tender"].filter(F.col("status").isNotNull() & (F.col("tenderer_count_flag") == "NORMAL"))
    start = i["tender"].select("ocid", "tender_start_date", "tender_start_date_flag", "tender_end_date", "tender_end_date_flag")
    dur = start.filter(_valid("tender_start_date_flag", "tender_end_date_flag")).select(
        F.datediff("tender_end_date", "tender_start_date").alias("d")).filter("d >= 0")
    lag_all = start.join(i["award"].select("ocid", "award_date", "award_date_flag"), "ocid").filter(
        _valid("tender_start_date_flag", "award_date_flag")).select(F.datediff("award_date", "tender_start_date").alias("d"))
    sig_all = i["award"].select("award_id", "award_date", "award_date_flag").join(
        stg.contracts.select("award_id", "date_signed", "date_signed_flag"), "award_id"
    ).filter(_valid("award_date_flag", "date_signed_flag")).select(F.datediff("date_signed", "award_date").alias("d"))
    contract = latest_per_key(stg.contracts, ["ocid"], ["release_seq"]).join(i["non_test"].select("ocid"), "ocid", "left_semi")
    reported = union([
        stg.transactions.select("contract_id"),
        stg.milestones.filter("milestone_source = 'IMPLEMENTATION'").select("contract_id"),
    ])
    with_impl = contract.join(reported, "contract_id", "left_semi")

    def tagged(*tags):
        hit = F.arrays_overlap("tag", F.array(*[F.lit(t) for t in tags]))
        return stg.releases.filter(hit).select("ocid").distinct().join(i["non_test"].select("ocid"), "ocid", "left_semi")

    dq = v.dq_impact
    whole = F.col("dq_ref") == "ALL"
    reg = v.metric_population.select("metric_id", "candidate_count", "eligible_count")
    summary = dq.filter(whole)
    in_reg = summary.join(reg, "metric_id")

    def hit(metric, ref, column="records_with_issue"):
        return F.max(F.when((F.col("metric_id") == metric) & (F.col("dq_ref") == ref), F.col(column)))

    no_supplier = i["award_ok"].join(complete.select("award_id"), "award_id", "left_anti")
    test_owner = i["owner"].filter(F.col("buyer_id") == r.test_buyer_id).select("ocid")

    def of_test(section):
        return section.select("ocid").distinct().join(test_owner, "ocid", "left_semi")

    test_lines = stg.planning.filter((F.col("buyer_id") == r.test_buyer_id) & F.col("budget_project_id").isNotNull()).select(
        "ocid", "budget_project_id").distinct()
    cause = F.col("impact_type").startswith("EXCLUDES") | (F.col("dq_ref") == "OTHER")
    single = dq.groupBy("metric_id").agg(
        F.coalesce(sum_if(cause, F.col("records_lost_only_to_issue")), F.lit(0)).alias("single"),
        F.max(F.when(whole, F.col("records_with_issue"))).alias("excluded"),
    ).filter(F.col("single") > F.col("excluded"))

    def med(df, c="d"):
        return df.agg(F.percentile(c, 0.5)).scalar()

    def ratio_median(df, c):
        return exact_percentiles(df, c, {"m": 0.5}).scalar()

    probes = [
        probe(view, [
            Check("BQ-01", "largest supplier value", _money(F.max("v")), mine.agg(_money(F.max("v"))).scalar()),
            Check("BQ-02", "suppliers in scope", rows(), count(mine)),
        ]),
        probe(ten(view), [Check("BQ-03", "value of the ten largest suppliers", _money(F.sum("v")), ten(mine).agg(_money(F.sum("v"))).scalar())]),
        probe(v.competition_eligible, [
            Check("BQ-04", "median tenderers", median(F.col("number_of_tenderers"), F.col("in_primary_population")), med(primary, "number_of_tenderers")),
            Check("BQ-05", "single-bidder tenders", F.count_if(F.col("in_primary_population") & F.col("is_single_bidder")),
                  primary.agg(F.count_if(F.col("number_of_tenderers") == 1)).scalar()),
        ]),
        probe(v.budget_award_comparison, [
            Check("BQ-06", "budget of comparable processes", _money(F.sum("budget_amount")), bva.agg(_money(F.sum("budget_amount"))).scalar()),
            Check("BQ-07", "award value of comparable processes", _money(F.sum(award)), bva.agg(_money(F.sum(award))).scalar()),
        ]),
        probe(exact_percentiles(v.budget_award_comparison, "award_to_budget_ratio", {"m": 0.5}), [
            Check("BQ-08", "median award-to-budget ratio", F.round(F.max("m"), 6), F.round(ratio_median(bva, "ratio"), 6))]),
        probe(v.tender_duration_eligible, [Check("BQ-09", "median tender duration", F.percentile("tender_duration_days", 0.5), med(dur))]),
        probe(v.award_lag_eligible, [Check("BQ-10", "median award lag", F.percentile("award_lag_days", 0.5), med(lag_all.filter("d >= 0")))]),
        probe(v.signature_lag_eligible, [Check("BQ-11", "median signature lag", F.percentile("signature_lag_days", 0.5), med(sig_all.filter("d >= 0")))]),
        probe(v.contract_implementation_coverage, [Check("BQ-12", "contracts with implementation data", F.count_if("has_implementation"), count(with_impl))]),
        probe(v.lifecycle_stage, [
            Check("BQ-13", "processes at stage 5", F.count_if(F.col("highest_stage_rank") == 5), count(tagged("implementation"))),
            Check("BQ-14", "processes at stage 4 or 5", F.count_if(F.col("highest_stage_rank") >= 4), count(tagged("contract", "implementation"))),
        ]),
        probe(summary, [Check("DQI-01", "excluded = candidate - eligible", F.count_if(
            F.col("records_with_issue") != F.col("candidate_records") - F.col("eligible_records")), "0")]),
        probe(in_reg, [Check("DQI-02", "counts equal the register", F.count_if(
            (F.col("candidate_records") != F.col("candidate_count")) | (F.col("eligible_records") != F.col("eligible_count"))), "0")]),
        probe(summary.join(reg, "metric_id", "left_anti"), [Check("DQI-03", "metrics missing from the register", rows(), "0")]),
        probe(dq, [
            Check("DQI-04", "DQ-05 recount", F.coalesce(hit("M-C01 / M-C02", "DQ-05"), F.lit(0)),
                  i["tender"].agg(F.count_if(F.col("tenderer_count_flag") == "ANOMALOUS")).scalar()),
            Check("DQI-05", "DQ-04 recount", hit("M-C01 / M-C02", "DQ-04"), i["tender"].agg(F.count_if(F.col("tenderer_count_flag") == "ELEVATED")).scalar()),
            Check("DQI-06", "DQ-07 recount", hit("M-V01", "DQ-07"), i["award"].agg(F.count("award_value_flag")).scalar()),
            Check("DQI-07", "DQ-06 recount", hit("M-P01", "DQ-06"), i["line"].agg(F.count("budget_amount_flag")).scalar()),
            Check("DQI-08", "DQ-14 recount", hit("M-S01", "DQ-14"), count(no_supplier)),
            Check("DQI-09", "DQ-14 value", _money(hit("M-S01", "DQ-14", "affected_value_ngn")), no_supplier.agg(_money(F.sum(award))).scalar()),
            Check("DQI-10", "M-E02 date order", hit("M-E02", "DATE-ORDER"), count(lag_all.filter("d < 0"))),
            Check("DQI-11", "P5-SIG date order", F.coalesce(hit("P5-SIG", "DATE-ORDER"), F.lit(0)), count(sig_all.filter("d < 0"))),
            Check("DQI-13", "records never exceed candidates", F.count_if((F.col("records_with_issue") > F.col("candidate_records"))
                                                                          & (F.col("impact_type") != "PRE_EXCLUDED")), "0"),
            Check("DQI-14", "M-S01 excluded share, %", F.round(
                hit("M-S01", "ALL", "affected_value_ngn").cast("double") * 100
                / (hit("M-S01", "ALL", "affected_value_ngn") + hit("M-S01", "ALL", "eligible_value_ngn")).cast("double"), 2)),
            Check("DQI-15", "rows of the impact view", rows()),
            Check("DQI-16", "test-entity awards removed", hit("M-V01", "DQ-20"), count(of_test(stg.awards))),
            Check("DQI-17", "test-entity tenders removed", hit("M-C01 / M-C02", "DQ-20"), count(of_test(stg.tender))),
            Check("DQI-18", "test-entity budget lines removed", hit("M-P01", "DQ-20"), count(test_lines)),
            Check("DQI-19", "test-entity buyer ids removed", hit("ENTITY", "DQ-20"), "1"),
        ]),
        probe(single, [Check("DQI-12", "single-cause losses never exceed exclusions", rows(), "0")]),
    ]
    return suite("Business questions", probes)


# ------------------------------------------------------------------ 11 presentation dimensions
def presentation_dims(ws) -> DataFrame:
    v, stg, r = ws.v, ws.stg, ws.rules
    reserved = [r.bare_buyer_id, r.test_buyer_id]
    buyers, bench, methods = v.dim_buyer, v.entity_benchmark, v.dim_procurement_method
    stg_buyers = stg.releases.filter(F.col("buyer_id").isNotNull() & ~F.col("buyer_id").isin(reserved)).select("buyer_id").distinct()
    facts = union([getattr(v, n).select("buyer_id") for n in FACT_VIEWS])
    used = union([getattr(v, n).select(method().alias("procurement_method")) for n in METHOD_VIEWS])
    owner = _independent(ws)["non_test"].select("ocid")
    stg_methods = stg.tender.join(owner, "ocid", "left_semi").filter(F.col("procurement_method_details").isNotNull()).select(
        "procurement_method_details").distinct()
    one_sided = union([
        buyers.select("buyer_id").join(bench.select("buyer_id"), "buyer_id", "left_anti"),
        bench.select("buyer_id").join(buyers.select("buyer_id"), "buyer_id", "left_anti"),
    ])
    unknown = facts.filter(F.col("buyer_id") != r.bare_buyer_id).join(buyers.select("buyer_id"), "buyer_id", "left_anti")
    label, key = F.col("buyer_label"), F.col("procurement_method")
    probes = [
        probe(buyers, [
            Check("DIM-01", "buyers = distinct staging buyers", rows(), count(stg_buyers)),
            Check("DIM-02", "repeated buyer ids", repeats(["buyer_id"]), "0"),
            Check("DIM-03", "missing or repeated labels", repeats(["buyer_label"]) + F.count_if(label.isNull()), "0"),
            Check("DIM-04", "reserved buyers present", F.count_if(F.col("buyer_id").isin(reserved)), "0"),
        ]),
        probe(one_sided, [Check("DIM-05", "buyers in one of dimension and benchmark only", rows(), "0")]),
        probe(unknown, [Check("DIM-06", "fact rows with an unknown buyer", rows(), "0")]),
        probe(facts, [Check("DIM-07", "fact rows of the bare buyer", F.count_if(F.col("buyer_id") == r.bare_buyer_id))]),
        probe(methods, [
            Check("DIM-08", "missing or repeated methods", repeats(["procurement_method"]) + F.count_if(key.isNull()), "0"),
            Check("DIM-09", "methods = staging methods + not stated", rows(), count(stg_methods) + 1),
            Check("DIM-12", "members marked as not stated", F.count_if("is_not_stated"), "1"),
        ]),
        probe(used.join(methods.select("procurement_method"), "procurement_method", "left_anti"),
              [Check("DIM-10", "fact rows with an unknown method", rows(), "0")]),
        probe(methods.join(used.distinct(), "procurement_method", "left_anti"),
              [Check("DIM-11", "methods used by no fact row", rows(), "0")]),
    ]
    return suite("Presentation dimensions", probes)


# ------------------------------------------------------------------ 12 scale flag
def scale_flag(ws) -> DataFrame:
    """Recount by multiplication and by ``lead`` over the two largest awards."""
    v, r = ws.v, ws.rules
    flag, aw = v.award_scale_flag, v.award_value_eligible
    a, b = F.col("award_value_amount"), F.col("budget_amount")
    dd = v.budget_award_comparison.filter((a % 1 == 0) & (a >= b * r.ratio_low) & (a <= b * r.ratio_high)).select("award_id")
    w = Window.partitionBy("supplier_id", "buyer_id").orderBy(a.desc(), "award_id")
    lots = v.supplier_award_eligible.filter(F.col("buyer_id_flag").isNull())
    two = lots.withColumn("rn", F.row_number().over(w)).filter("rn <= 2").withColumn("next", F.lead("award_value_amount").over(w))
    sl = two.filter((F.col("rn") == 1) & (a >= F.col("next") * r.sibling_factor)).select("award_id")
    either = dd.union(sl).distinct()
    reasons = ["DROPPED_DECIMAL", "SIBLING_LOT", "DROPPED_DECIMAL+SIBLING_LOT"]
    d, s = F.col("dropped_decimal_test"), F.col("sibling_lot_test")
    claim = (d & ~((a % 1 == 0) & F.col("award_to_budget_ratio").between(r.ratio_low, r.ratio_high))) | (
        s & ~(F.col("ratio_to_sibling") >= r.sibling_factor)) | ~(d | s)
    pop = v.metric_population
    counts = F.concat_ws("|", *[F.max(F.when(F.col("metric_id") == m, F.col("eligible_count"))).cast("string")
                                for m in ("M-V01", "M-S01", "P4-BvA")])
    eligible = F.concat_ws("|", count(aw).cast("string"),
                           v.supplier_award_eligible.agg(F.count_distinct("award_id")).scalar().cast("string"),
                           count(v.budget_award_comparison).cast("string"))
    split = F.concat_ws("|", *[F.count_if(F.col("flag_reason") == x).cast("string") for x in reasons])
    total = aw.agg(F.sum("award_value_amount")).scalar()
    untestable = aw.select("award_id").join(v.supplier_award_eligible.select("award_id"), "award_id", "left_anti").join(
        v.budget_award_comparison.select("award_id"), "award_id", "left_anti")

    def spot(check_id, name, recount, column):
        first = recount.agg(F.min("award_id").alias("award_id"))
        found = F.coalesce(F.max(F.col(column).cast("string")), F.lit("none"))
        some = recount.agg(F.when(rows() > 0, "true").otherwise("none")).scalar()
        return probe(flag.join(first, "award_id"), [Check(check_id, name, found, some)])

    extreme = flag.join(ws.stg.awards.filter(F.col("award_value_flag") == "EXTREME").select("award_id"), "award_id", "left_semi")
    probes = [
        probe(flag, [
            Check("SF-01", "flagged = recount", rows(), count(either)),
            Check("SF-02", "dropped decimal = recount", F.count_if(d), count(dd)),
            Check("SF-03", "sibling lot = recount", F.count_if(s), count(sl)),
            Check("SF-04", "repeated award ids", repeats(["award_id"]), "0"),
            Check("SF-06", "unknown flag or reason", F.count_if(
                ~F.col("scale_flag").eqNullSafe("POSSIBLE_SCALE_ERROR") | ~F.col("flag_reason").isin(reasons)), "0"),
            Check("SF-08", "test-entity awards flagged", F.count_if(F.col("buyer_id") == r.test_buyer_id), "0"),
            Check("SF-09", "rows that fail the test they claim", F.count_if(F.coalesce(claim, F.lit(False))), "0"),
            Check("SF-10", "sibling lots of the bare buyer", F.count_if(s & (F.col("buyer_id") == r.bare_buyer_id)), "0"),
            Check("SF-15", "split by reason", split),
            Check("SF-16", "flagged value", F.round(F.sum(a).cast("double") / r.unit, 2)),
            Check("SF-17", "flagged share, %", F.round(F.sum(a).cast("double") * 100 / total.cast("double"), 2)),
        ]),
        probe(flag.join(aw.select("award_id"), "award_id", "left_anti"), [Check("SF-05", "flagged outside M-V01", rows(), "0")]),
        probe(extreme, [Check("SF-07", "flagged and extreme", rows(), "0")]),
        probe(pop, [Check("SF-14", "eligible populations unchanged", counts, eligible)]),
        spot("SF-11", "first recounted sibling lot is flagged as one", sl, "sibling_lot_test"),
        spot("SF-12", "first recounted dropped decimal is flagged as one", dd, "dropped_decimal_test"),
        probe(flag.join(untestable, "award_id", "left_semi"), [
            Check("SF-13", "awards without budget line and usable supplier are not flagged", rows(), "0")]),
    ]
    return suite("Award scale flag", probes)


# ------------------------------------------------------------------ 13 documents against staging
def document_reconciliation(ws) -> DataFrame:
    """The nested documents, profiled without explodes, against the flat tables."""
    stg = ws.stg
    parts = []

    def add(df, items):
        one = df.agg(*[c.cast("string").alias(f"x{i}") for i, c in enumerate(items.values())])
        cells = [F.struct(F.lit(k).alias("item"), F.col(f"x{i}").alias("staging_value")) for i, k in enumerate(items)]
        parts.append(one.select(F.inline(F.array(*cells))))

    def is_(column, value):
        return F.count_if(F.col(column) == value)

    for name, df in stg.tables().items():
        add(df, {f"count.{name}": rows()})
    add(stg.releases, {"count.processes": F.count_distinct("ocid"), "flag.party.NO_PARTIES": F.count("party_flag")})
    labels = {"planning": "budget", "tender": "tender_value", "awards": "award", "contracts": "contract",
              "transactions": "transaction"}
    monetary = {"planning": "budget_monetary_flag", "tender": "tender_value_monetary_flag",
                "awards": "award_monetary_flag", "contracts": "contract_monetary_flag",
                "transactions": "transaction_monetary_flag"}
    for table, c, _ in MONEY_COLUMNS:
        zero = F.lit(0).cast("decimal(38,4)")
        add(getattr(stg, table), {
            f"money.{labels[table]}": F.coalesce(F.sum(c), zero).cast("decimal(38,4)"),
            f"flag.{labels[table]}.ZERO_VALUE": is_(monetary[table], "ZERO_VALUE"),
        })
    add(stg.planning, {"flag.budget.EXTREME": is_("budget_amount_flag", "EXTREME")})
    add(stg.awards, {"flag.award.EXTREME": is_("award_value_flag", "EXTREME")})
    add(stg.contracts, {"count.contracts_with_implementation": F.count_if("has_implementation")})
    add(stg.parties, {"flag.party.INCOMPLETE": is_("supplier_id_flag", "INCOMPLETE")})
    add(stg.tender, {f"flag.tenderers.{x}": is_("tenderer_count_flag", x) for x in ("NORMAL", "ELEVATED", "ANOMALOUS")})
    for table, c in DATE_COLUMNS:
        add(getattr(stg, table), {
            f"date.{c}": F.count(c),
            **{f"flag.{c}.{x}": is_(f"{c}_flag", x) for x in ("PLACEHOLDER", "FUTURE", "IMPOSSIBLE", "VALID")},
        })
    raw = source_profile(ws.releases, ws.rules)
    return raw.join(union(parts), "item", "full").select(
        "item", "source_value", "staging_value", F.col("source_value").eqNullSafe(F.col("staging_value")).alias("passed")
    )


SUITES = {
    "c01_key_uniqueness": key_uniqueness,
    "c02_null_rates": null_rates,
    "c03_referential_integrity": referential_integrity,
    "c04_release_reconciliation": release_reconciliation,
    "c05_monetary_and_dates": monetary_and_dates,
    "c06_entity_consistency": entity_consistency,
    "c07_layer_reconciliation": layer_reconciliation,
    "c08_observations": observations,
    "c09_analytical_views": analytical_views,
    "c09b_spot_checks": record_checks,
    "c10_business_questions": business_questions,
    "c11_presentation_dims": presentation_dims,
    "c12_scale_flag": scale_flag,
}
