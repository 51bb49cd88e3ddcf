"""Measures read from cells equal the same measures read from the views."""

import math

import pytest

from tenderlens.plans import cube, figures, measures

S = figures.ORDER_SLICES
FILTERS = [{"method": S.method_main, "award_year": S.years[0]}, {"buyer": S.buyer, "scale_flag": "exclude"}, {"buyer": "nobody"}]
PARAMETERS = {
    "processes_reaching_stage": {"stage": 3}, "stage_conversion_rate": {"stage": 4}, "tenders_in_band": {"band": 3, "population": "sensitivity"},
    "comparable_in_band": {"band": 3}, "contracts_of_type": {"band": 3}, "timing_in_band": {"interval": "award_lag", "band": 4},
    "top_supplier_share": {"n": 3}, "top_entity_share": {"n": 2}, "entity_kpi": {"kpi": "single_bidder_rate"},
    **dict.fromkeys(("median_entity_single_bidder_rate", "median_entity_top_supplier_share", "median_entity_implementation"), {"min_n": 5}),
    "register": {"metric": "M-S01", "column": "eligible_count"}, "eligible_share": {"metric": "M-E01"},
    "impact": {"metric": "M-V01", "issue": "OTHER", "column": "records_with_issue"},
}


def same(a, b):
    return a is None and b is None or None not in (a, b) and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)


def test_every_measure_is_known():
    assert set(cube.MEASURES) == set(measures.SIMPLE) | set(measures.COMPOSED)


@pytest.mark.parametrize("filters", FILTERS, ids=str)
def test_against_the_views(workspace, filters):
    calls = {name: (name, filters, PARAMETERS.get(name, {})) for name in cube.MEASURES}
    from_cells = {r["label"]: r["value"] for r in cube.measure_table(workspace.v, calls).collect()}
    from_views = {r["label"]: r["value"] for r in measures.measure_batch(workspace.v, calls).collect()}
    wrong = {n: (from_cells.get(n), from_views.get(n)) for n in calls if not same(from_cells.get(n), from_views.get(n))}
    assert set(from_cells) == set(calls) and not wrong


def test_calls_read_the_cube_once_and_no_view(workspace):
    names = ["processes", "planning_only_share", "stage_conversion_rate"]
    calls = {f"{n}/{b}": (n, {"buyer": b}, PARAMETERS.get(n, {})) for n in names for b in ("B-1", "B-2", "B-3")}
    plan = cube.measure_table(workspace.v, calls)
    assert plan.inputFiles() and all("vw_cube_stages" in f for f in plan.inputFiles())
    assert plan._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
