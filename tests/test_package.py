"""Hand-made release package: every flag and edge, worked out by hand."""

import datetime
import json
from decimal import Decimal

import pytest

from tenderlens.plans import core as core_plan
from tenderlens.plans.check_suites import document_reconciliation, spot_checks
from tenderlens.plans.workspace import Views, Workspace
from tenderlens.rules import Rules
from tenderlens.sources import package

R = Rules()
DAY = "T00:00:00Z"
TEST = R.test_buyer_id


def money(x):
    return {"amount": x, "currency": "NGN"}


def release(rid, ocid, tags, buyer="NG-BPP-BPP-NOC-1", **sections):
    out = {
        "id": str(rid), "ocid": ocid, "date": "2024-01-01" + DAY, "tag": tags, "language": "en",
        "buyer": {"id": buyer, "name": None if buyer == R.bare_buyer_id else f"Buyer  {buyer[-1]} "},
        "parties": [{"id": buyer, "name": "x", "roles": ["buyer"]}],
    }
    out.update(sections)
    return out


def planning(project, amount):
    return {"budget": {"id": "b", "projectID": project, "amount": money(amount)}}


def tender(rid, n, start="2020-01-10", end="2020-01-20", status="complete", method="Open"):
    return {
        "id": f"T{rid}", "status": status, "procurementMethodDetails": method, "numberOfTenderers": n, "value": money(1),
        "tenderPeriod": {"startDate": start and start + DAY, "endDate": end and end + DAY},
    }


def award(rid, amount, supplier="NG-BPP-5", status="active", date="2020-02-01", repeat=1, name="Acme\t"):
    return {
        "id": f"A{rid}", "status": status, "date": date and date + DAY, "value": money(amount),
        "suppliers": [{"id": supplier, "name": name}] * repeat,
    }


def contract(rid, signed="2020-02-11", tx=0, impl=0, plain=0):
    return {
        "id": f"C{rid}", "awardID": f"A{rid}", "status": "active", "value": money(1), "dateSigned": signed and signed + DAY,
        "milestones": [{"id": f"p{i}"} for i in range(plain)],
        "implementation": {
            "transactions": [{"id": f"x{i}", "value": money(0), "payer": {"id": "p"}} for i in range(tx)],
            "milestones": [{"id": f"m{i}", "dueDate": "2001-01-01" + DAY} for i in range(impl)],
        },
    }


RELEASES = [
    # text order of the ids ("9" > "10") disagrees with integer order; the later release has no budget amount
    release(9, "P1", ["planning"], planning=planning("L1", 100)),
    release(10, "P1", ["planning", "tender"], planning={"budget": {"id": "b"}}, tender=tender(10, 1)),
    # two budget projects, four significant decimals
    release(11, "P2", ["planning"], planning=planning("L2", 22566000.0061)),
    release(12, "P2", ["planning", "tender", "award"], planning=planning("L3", 50), tender=tender(12, 100),
            awards=[award(12, 5000, repeat=5)]),
    # budget zero / extreme / missing, tenderers 101, 1000, 1001
    release(13, "P3", ["planning", "tender"], planning=planning("L4", 0), tender=tender(13, 101)),
    release(14, "P4", ["planning", "tender"], planning=planning("L5", 1e12), tender=tender(14, 1000, "2001-01-01")),
    release(15, "P5", ["planning", "tender"], planning=planning("L6", None), tender=tender(15, 1001, "2026-01-01", "2050-12-31")),
    # dates out of order, impossible year, missing
    release(16, "P6", ["planning", "tender"], tender=tender(16, 2, "2020-02-01", "2020-01-01", status=None)),
    release(17, "P7", ["planning", "tender", "award"], tender=tender(17, 3, None, "2922-01-01"),
            awards=[award(17, 7, date="2922-05-05", status=None)]),
    # award statuses, bare supplier, contract with transactions only / milestones only / both / neither
    release(18, "P8", ["planning", "tender", "award", "contract", "implementation"], planning=planning("L8", 100),
            tender=tender(18, 4), awards=[award(18, 10000)], contracts=[contract(18, tx=1)]),
    release(19, "P9", ["planning", "tender", "award", "contract", "implementation"], planning=planning("L9", 100),
            tender=tender(19, 4, method=None), awards=[award(19, 20000, supplier=R.bare_supplier_id, name="Nobody")],
            contracts=[contract(19, impl=2, signed="2020-01-31")]),
    release(20, "P10", ["planning", "tender", "award", "contract"], planning=planning("L10", 100), tender=tender(20, 4),
            awards=[award(20, 5000.5, name="ACME")], contracts=[contract(20, plain=1)]),
    release(21, "P11", ["planning", "tender", "award", "contract"], tender=tender(21, 4), awards=[award(21, 0)],
            contracts=[contract(21, tx=1, impl=1)]),
    release(22, "P12", ["planning", "award"], awards=[award(22, 3, status="cancelled")]),
    # sibling: 500 x the other award of the same supplier and buyer
    release(23, "P13", ["award"], awards=[award(23, 20, supplier="NG-BPP-77", name="Sib ")]),
    release(24, "P14", ["award"], awards=[award(24, 10000, supplier="NG-BPP-77", name="Sib")]),
    # bare buyer, test buyer, no parties, no tags
    release(25, "P15", ["planning"], buyer=R.bare_buyer_id, planning=planning("L15", 10)),
    release(26, "P16", ["planning", "tender", "award"], buyer=TEST, planning=planning("L16", 10), tender=tender(26, 1),
            awards=[award(26, 10)]),
    release(27, "P17", ["planning"], planning=planning("L17", 10), parties=None),
    release(28, "P18", []),
]


@pytest.fixture(scope="module")
def path(tmp_path_factory):
    p = tmp_path_factory.mktemp("package") / "package.json"
    p.write_text(json.dumps({"uri": "u", "version": "1.1", "releases": RELEASES}))
    return str(p)


@pytest.fixture(scope="module")
def ws(spark, path):
    return Workspace(spark, lambda: package.read_package(spark, path), R)


def by(df, key, *cols):
    return {r[key]: tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.collect()}


def test_counts(ws):
    n = {k: d.count() for k, d in ws.stg.tables().items()}
    assert n["releases"] == n["planning"] == len(RELEASES)
    assert n["tender"] == 12 and n["awards"] == 10 and n["award_suppliers"] == 14
    assert n["contracts"] == 4 and n["transactions"] == 2 and n["milestones"] == 4


def test_exact_decimals_and_flags(ws):
    p = by(ws.stg.planning, "release_id", "budget_amount", "budget_amount_flag", "budget_monetary_flag", "party_flag")
    assert p["11"][0] == Decimal("22566000.0061")
    assert p["13"][2] == "ZERO_VALUE" and p["14"][1] == "EXTREME" and p["15"][:3] == (None, None, None)
    assert p["27"][3] == "NO_PARTIES" and p["25"][3] is None
    t = by(ws.stg.tender, "release_id", "tenderer_count_flag", "tender_start_date_flag", "tender_end_date_flag")
    assert t["12"][0] == "NORMAL" and t["13"][0] == "ELEVATED" and t["14"] == ("ELEVATED", "PLACEHOLDER", "VALID")
    assert t["15"] == ("ANOMALOUS", "FUTURE", "FUTURE") and t["17"] == ("NORMAL", None, "IMPOSSIBLE")
    a = by(ws.stg.awards, "award_id", "award_date", "award_date_flag", "award_monetary_flag")
    assert a["A17"][:2] == (datetime.date(2922, 5, 5), "IMPOSSIBLE") and a["A21"][2] == "ZERO_VALUE"


def test_contract_implementation(ws):
    has = by(ws.stg.contracts, "contract_id", "has_implementation")
    assert has == {"C18": True, "C19": True, "C20": False, "C21": True}
    cover = by(ws.v.contract_implementation_coverage, "contract_id", "transaction_count", "implementation_milestone_count")
    assert cover == {"C18": (1, 0), "C19": (0, 2), "C20": (0, 0), "C21": (1, 1)}


def test_dimensions(ws):
    b = by(ws.core.dim_buyer, "buyer_id", "buyer_name", "release_count", "buyer_id_flag", "test_entity_flag")
    assert b[R.bare_buyer_id] == (None, 1, "INCOMPLETE", None)
    assert b[TEST][3] == "TEST_ENTITY" and b["NG-BPP-BPP-NOC-1"][0] == "Buyer 1"
    s = by(ws.core.dim_supplier, "supplier_id", "supplier_name", "name_variant_count", "in_supplier_parties")
    assert s["NG-BPP-5"] == ("Acme", 2, False)  # seen on awards only; two spellings, tab trimmed
    assert s["NG-BPP-77"][1] == 1  # the no-break space is trimmed


def test_snapshot(ws):
    s = by(ws.core.process_snapshot, "ocid", "latest_release_id", "tender_id", "award_id", "contract_id", "budget_line_count")
    assert "P18" not in s  # no tags
    assert s["P1"] == ("10", "T10", None, None, 1)
    assert s["P2"] == ("12", "T12", "A12", None, 2)
    assert s["P8"] == ("18", "T18", "A18", "C18", 1)
    lines = by(ws.core.budget_lines, "budget_project_id", "release_id", "budget_amount")
    assert lines["L1"] == ("9", Decimal("100.0000"))


def test_eligibility(ws):
    v = ws.v
    assert set(by(v.budget_eligible, "budget_project_id", "ocid")) == {"L1", "L2", "L3", "L8", "L9", "L10"}
    comp = by(v.competition_eligible, "ocid", "in_primary_population", "is_single_bidder")
    assert comp["P1"] == (True, True) and comp["P3"] == (False, False) and comp["P4"] == (False, False)
    assert "P5" not in comp and "P6" not in comp and "P16" not in comp
    assert set(by(v.award_value_eligible, "ocid", "award_id")) == {"P2", "P8", "P9", "P10", "P13", "P14"}
    sup = by(v.supplier_award_eligible, "award_id", "distinct_supplier_count")
    assert sup == {"A12": 1, "A18": 1, "A20": 1, "A23": 1, "A24": 1}
    ratio = by(v.budget_award_comparison, "ocid", "award_to_budget_ratio")
    assert ratio == {"P8": 100.0, "P9": 200.0, "P10": 50.005}
    assert by(v.tender_duration_eligible, "ocid", "tender_duration_days")["P1"] == 10
    lag = by(v.signature_lag_eligible, "contract_id", "signature_lag_days")
    assert lag["C18"] == 10 and "C19" not in lag


def test_scale_flag(ws):
    f = by(ws.v.award_scale_flag, "award_id", "flag_reason", "ratio_to_sibling")
    assert f["A18"][0] == "DROPPED_DECIMAL"  # whole, 100 x budget
    assert f["A19"][0] == "DROPPED_DECIMAL"  # whole, 200 x budget
    assert "A20" not in f  # fractional amount
    assert f["A24"] == ("SIBLING_LOT", 500.0)


def test_spot_checks(ws):
    spots = [
        ("SP-02", "award_value_eligible", "ocid", "P2", "award_value_amount", "5000.0000"),
        ("SP-03", "supplier_award_eligible", "ocid", "P8", "supplier_name", "Acme"),
        ("SF-11", "award_scale_flag", "award_id", "A24", "flag_reason", "SIBLING_LOT"),
        ("SF-13", "award_scale_flag", "award_id", "A20", "flag_reason", None),
        ("bad", "award_scale_flag", "award_id", "A24", "flag_reason", "DROPPED_DECIMAL"),
    ]
    got = by(spot_checks(ws, spots), "check_id", "passed", "actual")
    assert got["SP-02"] == (True, "5000.0000") and got["SP-03"] == (True, "Acme") and got["SF-11"][0]
    assert got["SF-13"] == (None, None) and got["bad"] == (False, "SIBLING_LOT")


def test_attribution_reconciles(ws):
    for r in ws.v.dq_impact.filter("dq_ref = 'ALL'").collect():
        assert r["records_with_issue"] == r["candidate_records"] - r["eligible_records"], r["metric_id"]


def test_documents_equal_staging(ws):
    bad = [r for r in document_reconciliation(ws).collect() if not r["passed"]]
    assert bad == []


def test_lazy_views_equal_stored_views(ws):
    lazy = Views(ws.core)
    for name in ("supplier_award_eligible", "entity_benchmark", "award_scale_flag"):
        stored, live = getattr(ws.v, name), getattr(lazy, name)
        assert stored.exceptAll(live.select(stored.columns)).isEmpty()


@pytest.mark.parametrize(
    ("bad", "message"),
    [
        (release(90, "X", ["tender"], tender={**tender(90, 1), "tenderPeriod": {"startDate": "2020-01-01T10:00:00Z"}}), "unexpected date format"),
        (release(91, "X", ["tender"], tender=tender(91, 0)), "number of tenderers"),
        (release(92, "X", ["tender"], tender=tender(92, None)), "number of tenderers"),
        (release("9x", "X", ["planning"]), "CAST_INVALID_INPUT"),
    ],
)
def test_bad_input_stops_the_load(spark, tmp_path, bad, message):
    p = tmp_path / "bad.json"
    p.write_text(json.dumps({"releases": [bad]}))
    stg = package.flatten(package.read_package(spark, str(p), 2), R)
    table = stg.tender if bad["tag"] == ["tender"] else stg.releases
    with pytest.raises(Exception, match=message):
        table.write.parquet(str(tmp_path / "out"))


def test_modal_name_rule(spark):
    rel = spark.createDataFrame(
        [("B", "old", 1), ("B", "old", 2), ("B", "new", 3), ("C", "x", 4), ("C", "y", 5), ("D", None, 6)],
        "buyer_id string, buyer_name string, release_seq long",
    )
    names = by(core_plan.build_dim_buyer(rel, R), "buyer_id", "buyer_name")
    assert names == {"B": "old", "C": "y", "D": None}
