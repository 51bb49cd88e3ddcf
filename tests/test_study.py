"""Snapshot studies and profiler rules on a hand-made set of documents, worked out by hand."""

import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tenderlens.operators import order_stats
from tenderlens.plans import profile, study
from tenderlens.plans.workspace import Workspace
from tenderlens.rules import Rules
from tenderlens.sources import package, sinks

R = Rules(profile_extreme_value=Decimal(1000), extreme_budget=Decimal(5000), elevated_max=20)


def doc(rid, ocid, tags, budget="none", **more):
    out = {"id": str(rid), "ocid": ocid, "date": "2024-01-01T00:00:00Z", "tag": tags, "buyer": {"id": "b", "name": "B"},
           "parties": [{"id": "b", "roles": ["buyer"]}]}
    if budget != "none":
        project, amount = budget
        out["planning"] = {"budget": {"id": "x", "projectID": project, "amount": {"amount": amount, "currency": "NGN"}}}
    return out | more


def award(aid, amount, *suppliers):
    return {"id": aid, "status": "active", "date": "2020-01-01T00:00:00Z", "value": {"amount": amount, "currency": "NGN"},
            "suppliers": [{"id": s, "name": s.upper()} for s in suppliers]}


def tender(amount, n=3):
    return {"id": "t", "status": "complete", "numberOfTenderers": n, "value": {"amount": amount, "currency": "NGN"}}


DOCS = [
    # the latest budget object has no amount; a project comes back without one
    doc(9, "P1", ["planning"], ("L1", 100)),
    doc(10, "P1", ["planning"], ("L1", None)),
    # a missing project is a project of its own
    doc(11, "P2", ["planning"], ("L2", 50)),
    doc(12, "P2", ["planning", "tender"], (None, 7), tender=tender(10)),
    # the latest release has no budget object at all
    doc(13, "P3", ["planning"], ("L2", 5)),
    doc(14, "P3", ["tender"], tender=tender(2000)),
    # two awards and two suppliers per release: only the first award's value and suppliers count
    doc(15, "P4", ["award"], awards=[award("A", 5, "s2", "s1"), award("B", 9, "s3")]),
    doc(16, "P4", ["award"], awards=[award("A", 5, "s1", "s2"), award("B", 8, "s4")]),
    doc(17, "P5", ["award"], awards=[award("C", 5, "s1", "s2")]),
    doc(18, "P5", ["award"], awards=[award("C", 5, "s1", "s3")]),
    # extreme tender value and award in one process, the award alone in another
    doc(19, "P6", ["award"], tender=tender(1000, 21), awards=[award("D", 1000, "s1")]),
    doc(20, "P7", ["award"], tender=tender(999), awards=[award("E", 1500, "s1")]),
]


@pytest.fixture(scope="module")
def ws(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("docs") / "p.json"
    path.write_text(json.dumps({"uri": "u", "publishedDate": "2024-01-01T00:00:00Z", "releases": DOCS}))
    return Workspace(spark, lambda: package.read_package(spark, str(path)), R)


def test_rules_pick_budgets(ws):
    got = {r["ocid"]: (r["R2"], r["R3"]) for r in study.rule_values(ws).collect()}
    assert got["P1"] == (None, 0) and got["P2"] == (7, 57) and got["P3"] == (5, 5) and got["P4"] == (None, None)


def test_divergence(ws):
    r = study.divergence(ws).first()
    assert r["multi_release_processes"] == 5
    assert r["differing_budgets"] == 3 and r["differing_by_missing_only"] == 1  # P3: one side has none
    assert r["latest_lacks_budget"] == 3  # P3, P4, P5
    assert (r["multi_project"], r["same_project_revised"], r["identical_budget"]) == (1, 1, 3)
    assert r["multi_project_planning_only"] == 0 and r["projects_spanning_processes"] == 1  # L2
    assert r["budget_lines_per_project_rule"] == 4


def test_award_conflicts_compare_the_whole_first_award(ws):
    assert [(r["ocid"], r["award_releases"], r["signatures"]) for r in study.award_conflicts(ws).collect()] == [("P5", 2, 2)]
    assert study.section_alignment(ws).first()["most_awards_per_release"] == 2


def test_extremes(ws):
    kinds = sorted((r["kind"], r["ocid"], r["suppliers"]) for r in profile.extreme_records(ws).collect())
    assert kinds == [("award", "P6", "S1"), ("award", "P7", "S1"), ("tenderers", "P6", None)]
    assert [r["ocid"] for r in profile.extreme_overlap(ws).collect()] == ["P6"]


def test_history_does_not_fan_out(ws):
    one = ws.spark.createDataFrame([("P4",)], "ocid string")
    rows = study.process_history(ws, one).collect()
    assert [r["release_id"] for r in rows] == ["15", "16"]
    assert rows[0]["awards"] == "A|active|2020-01-01|5.00|-|s2=S2;s1=S1 / B|active|2020-01-01|9.00|-|s3=S3"


def test_date_classes(spark):
    texts = [None, "", "0001-01-01T00:00:00Z", "1900-01-01", "2001-01-01T00:00:00Z", "1970-01-01", "2020-02-30", "x", "2031-01-01",
             "2026-05-05", "2025-12-31", "1999-12-31"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r[0] for r in df.select(profile.profiler_date_class(F.col("text"))).collect()]
    assert got == ["NULL", "UNPARSEABLE", "PLACEHOLDER", "EXTREME_PAST", "PLACEHOLDER", "PLACEHOLDER", "UNPARSEABLE", "UNPARSEABLE",
                   "EXTREME_FUTURE", "FUTURE", "VALID", "EXTREME_PAST"]
    got = [r[0] for r in df.select(profile.study_date_class(F.col("text"), Rules())).collect()]
    assert got == [None, None, "VALID", "VALID", "PLACEHOLDER", "VALID", "VALID", "UNPARSEABLE", "FUTURE", "FUTURE", "VALID", "VALID"]
    late = spark.createDataFrame([("2051-99-99",), ("2050-01-01",)], "text string")
    assert [r[0] for r in late.select(profile.study_date_class(F.col("text"), Rules())).collect()] == ["IMPOSSIBLE", "FUTURE"]


def test_exclusive_quantiles_of_a_small_sample(spark):
    from statistics import quantiles

    values = [3, 1, 4, 1, 5, 9, 2, 6]
    df = spark.createDataFrame([(x,) for x in values], "x long")
    got = order_stats.exact_percentiles(df, "x", {"a": 0.25, "b": 0.5, "c": 0.75}, exclusive=True).first()
    assert [got["a"], got["b"], got["c"]] == pytest.approx(quantiles(values, n=4))


def test_depth_counts_negative_values_in_the_total(spark):
    df = spark.sql("SELECT CAST(x AS DECIMAL(30,4)) AS v FROM VALUES (100), (60), (-40), (0), (NULL) t(x)")
    assert order_stats.depth_to_share(df, "v", {"most": "0.8"}).first()["most"] == 1


def test_package_files_round_trip(ws, tmp_path):
    path = str(tmp_path / "packages")
    package.write_packages(ws.releases, path, "2024-01-01T00:00:00Z", per_package=5)
    again = package.read_package(ws.spark, path)
    assert len(again.inputFiles()) > 1
    assert sorted(r["id"] for r in again.collect()) == sorted(d["id"] for d in DOCS)
    assert [r[0] for r in package.published_dates(ws.spark, path).collect()] == ["2024-01-01T00:00:00Z"]
    a = sinks.table_digest(package.flatten_awards(again, R), "awards").first()
    assert a == sinks.table_digest(ws.stg.awards, "awards").first()
    changed = ws.stg.awards.withColumn("status", F.when(F.col("award_id") == "A", "x").otherwise(F.col("status")))
    assert sinks.table_digest(changed, "awards").first()["digest"] != a["digest"]


def test_a_reader_survives_a_refresh(ws):
    held = ws.core.process_snapshot
    before = held.count()
    new = ws.refresh_snapshot().process_snapshot
    assert held.count() == new.count() == before
    assert new.inputFiles() != held.inputFiles()
    assert ws.spark.read.parquet(f"{ws.root}/refreshes").count() == 1
    assert ws.v.lifecycle_stage.count() > 0


def test_the_load_is_gated_on_the_pinned_input(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "p.json").write_text(json.dumps({"uri": "u", "releases": DOCS}))
    pinned = spark.createDataFrame(sinks.file_manifest(spark, str(source), "*").collect())
    Workspace(spark, lambda: package.read_package(spark, str(source)), R).build_all(pinned, str(source))
    (source / "p.json").write_text(json.dumps({"uri": "u", "releases": DOCS[:3]}))
    with pytest.raises(ValueError, match="differ"):
        Workspace(spark, lambda: package.read_package(spark, str(source)), R).build_all(pinned, str(source))


def test_workspace_closes(spark, ws):
    other = Workspace(spark, lambda: ws.releases, R)
    other.stg
    root = other.root
    other.close()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(f"{root}/awards")


def test_stored_cells_keep_nulls(spark, tmp_path):
    root = str(tmp_path / "sets")
    sinks.store_result_sets({"a": spark.sql("SELECT 1 AS x, CAST(NULL AS STRING) AS y")}, root)
    assert json.loads(spark.read.parquet(root).first()["row_json"]) == {"x": 1, "y": None}


