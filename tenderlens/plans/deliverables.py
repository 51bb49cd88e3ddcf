"""Queries over the deliverables: scans, published tables, exports, figures, comparisons, stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderlens.functions import bands, flags
from tenderlens.operators.checks import cells, compare_cells, compare_figures, numeric_cells, trace_claims
from tenderlens.plans import (
    cube,
    export,
    figures,
    incremental,
    measures,
    questions_entity,
    questions_supply,
    questions_value,
    register,
)
from tenderlens.plans.common import rows, union
from tenderlens.plans.questions_supply import AWARD
from tenderlens.rules import METHOD_NOT_STATED
from tenderlens.sources import files, package, sinks

SLICES = figures.ORDER_SLICES


# ------------------------------------------------------------------ sources and sinks
def _json_lines(ws) -> str:
    """The release documents as JSON lines, written once."""
    path = f"{ws.root}/release_lines"
    if "json_path" not in ws.__dict__:
        ws.releases.write.mode("overwrite").option("ignoreNullFields", True).json(path)
        ws.json_path = path
    return path


def packages(ws) -> str:
    """The release documents as package files, written once; published on the day of the newest release.
    They are made from the workspace's rows on the way to the files, not stored before."""
    path = f"{ws.root}/packages"
    if "package_path" not in ws.__dict__:
        package.write_packages(ws.rows, path, ws.documents.agg(F.max("date")).scalar(), document=ws.document)
        ws.package_path = path
    return path


def _by_year(r: DataFrame) -> DataFrame:
    awards = F.transform("awards", lambda a: a["value"]["amount"])
    total = F.aggregate(
        F.coalesce(awards, F.array().cast("array<decimal(30,4)>")), F.lit(0).cast("decimal(30,4)"),
        lambda acc, x: (acc + F.coalesce(x, F.lit(0))).cast("decimal(30,4)"))
    return r.groupBy(F.substring("date", 1, 4).alias("year")).agg(
        rows().alias("releases"), F.count_distinct("ocid").alias("processes"),
        F.sum("planning.budget.amount.amount").alias("budget"), F.sum(total).alias("award_value"),
        F.count("tender").alias("tenders"))


def package_scan(ws) -> DataFrame:
    """Read package files with the explicit schema, each by as many tasks as its size asks for; exact decimals survive the text."""
    return _by_year(package.read_package_split(ws.spark, packages(ws), "part-*"))


def line_scan(ws) -> DataFrame:
    return _by_year(package.read_release_lines(ws.spark, _json_lines(ws)))


def equal_to_package_date(ws) -> DataFrame:
    """Releases dated on the publication day that the packages state."""
    published = package.published_dates(ws.spark, packages(ws)).select(F.to_date(F.substring("published", 1, 10)).alias("published"))
    days = ws.stg.releases.select(flags.utc_day(F.col("release_date")).alias("day"))
    n = days.agg(rows()).scalar()
    per_day = days.groupBy("day").agg(rows().alias("on_day"))
    return published.join(per_day, F.col("day") == F.col("published"), "left").groupBy("published").agg(
        F.coalesce(F.sum("on_day"), F.lit(0)).alias("on_that_day")).withColumn("releases", n)


def strict_dates(ws) -> DataFrame:
    t = ws.releases.filter(F.col("tender").isNotNull())
    day = flags.strict_date(F.col("tender.tenderPeriod.startDate"), "tender start")
    return t.select(day.alias("day")).groupBy("day").agg(rows().alias("tenders"))


def _published(ws) -> str:
    root = f"{ws.root}/published"
    if "published" not in ws.__dict__:
        sinks.replace_tables(ws.stg.tables(), root)
        sinks.replace_tables(ws.stg.tables(), root)  # replacing an existing set
        ws.published = root
    return root


def replaced_tables(ws) -> DataFrame:
    root = _published(ws)
    return union(
        [
            sinks.read_current(ws.spark, root, n).agg(rows().alias("row_count")).select(F.lit(n).alias("table_name"), "row_count")
            for n in ws.stg.tables()
        ]
    )


def refreshed_snapshot(ws) -> DataFrame:
    core = ws.refresh_snapshot()
    return union(
        [
            df.agg(rows().alias("row_count"), F.count_distinct("ocid").alias("processes")).select(
                F.lit(n).alias("table_name"), "row_count", "processes")
            for n, df in (("budget_lines", core.budget_lines), ("process_snapshot", core.process_snapshot))
        ]
    )


def view_counts(ws) -> DataFrame:
    from tenderlens.plans.workspace import VIEW_NAMES

    return register.view_counts(ws.v, VIEW_NAMES)


def table_manifest(ws) -> DataFrame:
    """Rows and content digest of every published table."""
    root = _published(ws)
    return union([sinks.table_digest(sinks.read_current(ws.spark, root, n), n) for n in ws.stg.tables()])


# Release numbers of one export file; bytes of one range of its digest tree.
FILE_RELEASES, FILE_RANGE = 20000, 64 << 10


def award_lines(ws) -> DataFrame:
    """(file, place, award_id, line): the staged awards as text lines, in files of bounded size and stable content."""
    blank = F.lit("")
    return ws.stg.awards.select(
        F.floor(F.col("release_seq") / FILE_RELEASES).cast("bigint").alias("file"), F.col("release_seq").alias("place"), "award_id",
        F.concat_ws(";", "award_id", F.coalesce(F.col(AWARD).cast("string"), blank), F.coalesce("status", blank)).alias("line"))


def _exported(ws) -> str:
    if "award_files" not in ws.__dict__:
        ws.award_files = sinks.write_lines(award_lines(ws), f"{ws.root}/award_files", order=("place", "award_id"))
    return ws.award_files


def _by_number(manifest: DataFrame) -> DataFrame:
    """Files by the number in their folder; the rest of a name is the writer's."""
    return manifest.withColumn("file", F.regexp_extract("file", r"file=(-?[0-9]+)/", 1).cast("bigint"))


def _numbered(ws, path: str) -> DataFrame:
    return _by_number(sinks.file_manifest(ws.spark, path, "part-*", FILE_RANGE))


def file_manifest(ws) -> DataFrame:
    """Rows, bytes and digest of every file of the award export."""
    return _numbered(ws, _exported(ws))


def _tampered(ws) -> str:
    """The export with three faults: the first line of the first file longer, the last file missing, a file too many."""
    if "tampered_files" not in ws.__dict__:
        lines = award_lines(ws)
        ends = lines.agg(F.min(F.struct("file", "place", "award_id")).alias("first"), F.max("file").alias("last"))
        first = ends.select("first").scalar()
        changed = F.when(F.struct("file", "place", "award_id") == first, F.concat("line", F.lit("0"))).otherwise(F.col("line"))
        kept = lines.withColumn("line", changed).filter(F.col("file") < ends.select("last").scalar())
        extra = ws.spark.range(1).select(
            F.lit(-1).cast("bigint").alias("file"), F.lit(0).cast("bigint").alias("place"), F.lit("A").alias("award_id"), F.lit("A;1;").alias("line"))
        ws.tampered_files = sinks.write_lines(kept.unionByName(extra), f"{ws.root}/award_files_tampered", order=("place", "award_id"))
    return ws.tampered_files


def input_gate(ws) -> DataFrame:
    """The gate before and after a load, over three inputs: as pinned, tampered with, and changed while it is read."""
    pinned = ws.table("award_manifest", lambda: sinks.file_manifest(ws.spark, _exported(ws), "part-*", FILE_RANGE))
    moving = f"{ws.root}/award_files_moving"
    if "moving_files" not in ws.__dict__:
        ws.moving_files = sinks.write_lines(award_lines(ws), moving, order=("place", "award_id"))

    def manifest_of(path: str):
        return lambda: _numbered(ws, path)

    def read(path: str):
        return ws.spark.read.option("recursiveFileLookup", True).text(path).agg(rows()).first()[0]

    def read_and_change() -> int:
        n = read(moving)
        late = ws.spark.createDataFrame([(-2, 0, "A", "late")], "file bigint, place bigint, award_id string, line string")
        if not files.exists(ws.spark, f"{moving}/late"):
            sinks.write_lines(late, f"{moving}/late")
        return n

    cases = {
        "as pinned": (_exported(ws), lambda: read(_exported(ws))),
        "tampered": (_tampered(ws), lambda: read(_tampered(ws))),
        "changed during the load": (moving, read_and_change),
    }
    parts = []
    for case, (path, load) in cases.items():
        expected, stopped, loaded = _by_number(pinned), False, None
        try:
            loaded = sinks.gated(expected, manifest_of(path), load)
        except sinks.ChangedInput:
            stopped = True
        found = sinks.verify_manifest(expected, _numbered(ws, path))
        parts.append(found.select(
            F.lit(case).alias("input"), "*", F.lit(stopped).alias("stopped"), F.lit(loaded).cast("bigint").alias("loaded_rows")))
    return union(parts)


def integrity(ws) -> DataFrame:
    """Every published table against the same table flattened from the source documents again, with both digests."""
    again = package.flatten(ws.releases, ws.rules).tables()
    source = union([sinks.table_digest(df, n) for n, df in again.items()])
    expected = source.withColumnsRenamed({"n_rows": "source_rows", "digest": "source_digest"})
    return expected.join(table_manifest(ws), "table_name", "full").select(
        "table_name", "source_rows", F.col("n_rows").alias("published_rows"), "source_digest", F.col("digest").alias("published_digest"),
        (F.col("source_digest").eqNullSafe(F.col("digest")) & F.col("source_rows").eqNullSafe(F.col("n_rows"))).alias("intact"),
    )


def presented_counts(ws) -> DataFrame:
    """Rows of each reporting projection, and how many carry the not-stated label."""
    parts = []
    for view in export.PRESENTED:
        df = export.presented(ws.v, view)
        label = F.col("procurement_method") == METHOD_NOT_STATED if "procurement_method" in df.columns else F.lit(False)
        parts.append(df.agg(rows().alias("n"), F.count_if(label).alias("not_stated")).select(
            F.lit(view).alias("view_name"), "n", "not_stated"))
    return union(parts)


def constant_table_join(ws) -> DataFrame:
    """A fixed grid of thresholds next to how many awards pass each."""
    grid = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(float(x)).alias("limit")) for i, x in enumerate((50e3, 100e3, 200e3, 400e3))])
    return ws.v.award_value_eligible.select(F.col(AWARD).cast("double").alias("x"), F.inline(grid)).filter(
        F.col("x") >= F.col("limit")).groupBy("step", "limit").agg(rows().alias("awards"))


def series_with_zeros(ws) -> DataFrame:
    """Every band 1 to 8 appears, empty ones with zero."""
    b = bands.participation_band(F.col("number_of_tenderers"), [F.lit(i) for i in range(1, 9)])
    counted = ws.v.competition_eligible.groupBy(b.cast("bigint").alias("band")).agg(rows().alias("n"))
    series = ws.spark.range(1, 9).withColumnRenamed("id", "band")
    return series.join(counted, "band", "left").select("band", F.coalesce("n", F.lit(0)).alias("n"))


STORED = {
    "concentration_by_method": ["procurement_method"],
    "competition_by_method": ["procurement_method"],
    "competition_headline": ["population"],
    "competition_by_status": ["tender_status"],
}


def long_results(ws) -> DataFrame:
    """Named result sets as one long table of cells."""
    return union([cells(getattr(questions_supply, n)(ws.v), n, keys) for n, keys in STORED.items()])


RESULT_SETS = {**questions_supply.RESULT_SETS, **questions_value.RESULT_SETS, **questions_entity.RESULT_SETS}


def stored_results(ws) -> DataFrame:
    """Run every result set, store its rows, and count what was stored; an empty set counts 0."""
    root = f"{ws.root}/result_sets"
    if "result_sets" not in ws.__dict__:
        ws.result_sets = sinks.store_result_sets({n: f(ws.v) for n, f in RESULT_SETS.items()}, root)
    stored = ws.spark.read.parquet(root).groupBy("result_set").agg(rows().alias("n"))
    names = ws.spark.createDataFrame([(n,) for n in RESULT_SETS], "result_set string")
    return names.join(stored, "result_set", "left").select("result_set", F.coalesce("n", F.lit(0)).alias("n_rows"))


SOURCES = {
    "s01_package_scan": package_scan,
    "s01b_release_lines": line_scan,
    "s11_strict_dates": strict_dates,
    "s12_replaced_tables": replaced_tables,
    "s13_refreshed_snapshot": refreshed_snapshot,
    "s14_view_counts": view_counts,
    "s15a_lifecycle_cells": lambda ws: export.lifecycle_cells(ws.v),
    "s15b_budget_cells": lambda ws: export.budget_cells(ws.v),
    "s15c_contract_cells": lambda ws: export.contract_cells(ws.v),
    "s15d_supplier_cells": lambda ws: export.supplier_cells(ws.v),
    "s16a_award_facts": lambda ws: export.award_facts(ws.v),
    "s16b_budget_award_facts": lambda ws: export.budget_award_facts(ws.v),
    "s16c_timing_facts": lambda ws: export.timing_facts(ws.v),
    "s17_dictionary_encoding": lambda ws: export.encoding_guard(ws.v),
    "s18_minor_units": lambda ws: export.award_minor_units(ws.v),
    "s19_manifest": file_manifest,
    "s19b_table_digests": table_manifest,
    "s20_integrity": integrity,
    "s20b_input_gate": input_gate,
    "s21_presentation": presented_counts,
    "s22_constant_table": constant_table_join,
    "s23_series": series_with_zeros,
    "s24_stored_results": stored_results,
}


# ------------------------------------------------------------------ figures and measures
def _family(name):
    def run(ws) -> DataFrame:
        return figures.FAMILIES[name](ws.v, SLICES).select(
            "figure_id", "unit", F.round("expected_value", 6).alias("expected_value"), "eligible_n")

    return run


def measures_under_filters(ws) -> DataFrame:
    m, b = SLICES.method_main, SLICES.buyer
    y = SLICES.years[0]
    calls = [
        ("processes / buyer", "processes", {"buyer": b}, {}),
        ("planned budget / method leaves it unchanged", "planned_budget", {"method": m}, {}),
        ("award value / method", "award_value", {"method": m}, {}),
        ("median award value / method", "median_award_value", {"method": m}, {}),
        ("top supplier share / method, n 3", "top_supplier_share", {"method": m}, {"n": 3}),
        ("supplier hhi / buyer", "supplier_hhi", {"buyer": b}, {}),
        ("single bidder rate / status", "single_bidder_rate_primary", {"tender_status": SLICES.tender_status}, {}),
        ("tenders in band 3 / method", "tenders_in_band", {"method": m}, {"band": 3}),
        ("median ratio / without flagged", "median_ratio", {"scale_flag": "exclude"}, {}),
        ("aggregate ratio / buyer", "aggregate_ratio", {"buyer": b}, {}),
        ("comparable in band 5", "comparable_in_band", {}, {"band": 5}),
        ("median tender duration / year", "median_tender_duration", {"tender_start_year": y}, {}),
        ("award lag n / other year field leaves it unchanged", "award_lag_n", {"tender_start_year": y}, {}),
        ("p90 award lag / award year", "p90_award_lag", {"award_year": y}, {}),
        ("coverage / contract status", "implementation_coverage_rate", {"contract_status": SLICES.contract_status}, {}),
        ("stage conversion 4 / buyer", "stage_conversion_rate", {"buyer": b}, {"stage": 4}),
        ("excluded awards / method", "excluded_awards", {"method": m}, {}),
        ("excluded value share / buyer", "excluded_value_share", {"buyer": b}, {}),
        ("top entity share, n 5", "top_entity_share", {}, {"n": 5}),
        ("median entity single bidder rate", "median_entity_single_bidder_rate", {}, {"min_n": 30}),
        ("eligible share M-E01", "eligible_share", {}, {"metric": "M-E01"}),
        ("impact M-V01 / OTHER", "impact", {}, {"metric": "M-V01", "issue": "OTHER", "column": "records_with_issue"}),
    ]
    found = cube.measure_table(ws.v, {label: call for label, *call in calls})
    return found.select("label", F.round("value", 6).alias("value"))


HEADLINES = [
    ("supplier_awards", {}), ("supplier_value", {}), ("top_supplier_share", {"n": 1}), ("top_supplier_share", {"n": 10}),
    ("supplier_hhi", {}), ("comparable_processes", {}), ("comparable_award", {}), ("aggregate_ratio", {}), ("median_ratio", {}),
]


def scenario_headlines(ws) -> DataFrame:
    """The scenario figures by filter instead of by marker: a second implementation."""
    calls = {}
    for scenario, f in (("published", {}), ("without flagged", {"scale_flag": "exclude"})):
        for name, p in HEADLINES:
            calls[f"{scenario}: {name}" + "".join(f"_{x}" for x in p.values())] = (name, f, p)
    return cube.measure_table(ws.v, calls).select("label", F.round("value", 6).alias("value"))


MEASURES = {
    **{name: _family(name) for name in figures.FAMILIES},
    "r9_measures_under_filters": measures_under_filters,
    "r10_scenario_headlines": scenario_headlines,
    "r11_top_suppliers_filtered": lambda ws: cube.top_suppliers(ws.v, {"method": SLICES.method_main}, 20).drop("identity_note"),
    "r11b_share_by_method_filtered": lambda ws: cube.share_by_method(ws.v, {"buyer": SLICES.buyer}, 3),
    "r11c_net_differences": lambda ws: cube.net_differences(ws.v, {"method": SLICES.method_main}, 5, 2),
    "r11d_timing_by_year": lambda ws: cube.timing_by_year(ws.v, {"method": SLICES.method_main}),
    "r11e_entity_kpis": lambda ws: measures.entity_kpis(ws.v),
    "r12_disclosure": lambda ws: cube.disclosure(ws.v, {"method": SLICES.method_main}),
}

def figure_pack(ws) -> DataFrame:
    return ws.table("figure_pack", lambda: figures.all_figures(ws.v, SLICES))


def figure_comparison(ws) -> DataFrame:
    """The whole pack against the measures: two implementations of every figure."""
    e = figure_pack(ws)
    again = measures.measure_batch(ws.v, figures.measure_calls(SLICES))
    a = again.withColumnsRenamed({"label": "figure_id", "value": "expected_value"}).join(
        e.select("figure_id", "unit"), "figure_id")
    return compare_figures(e, a, "figure_id", "expected_value", figures.PLACES).select(
        "figure_id", "unit", F.round("expected", 6).alias("expected"), F.round("actual", 6).alias("actual"), "matches")


def cell_comparison(ws) -> DataFrame:
    """A result set against the same table recomputed through the filter path."""
    name, keys = "concentration_by_method", ["procurement_method"]
    stored = ws.table("result_cells", lambda: long_results(ws)).filter(F.col("result_set") == name)
    again = cells(cube.share_by_method(ws.v, {}, 5), name, keys)
    return compare_cells(stored, again).select("row_key", "column_name", "matches")


def store_comparison(ws) -> DataFrame:
    """Every stored result set against the same set worked out again: rows on one side only, with their multiplicity."""
    stored_results(ws)
    again = f"{ws.root}/result_sets_again"
    if "result_sets_again" not in ws.__dict__:
        ws.result_sets_again = sinks.store_result_sets({n: f(ws.v) for n, f in RESULT_SETS.items()}, again)

    def side(root, sign):
        return ws.spark.read.parquet(root).select("result_set", "row_json", F.lit(sign).alias("s"), F.lit(int(sign > 0)).alias("n"))

    both = side(f"{ws.root}/result_sets", 1).unionByName(side(again, -1))
    per = both.groupBy("result_set", "row_json").agg(F.sum("s").alias("d"), F.sum("n").alias("n"))
    found = per.groupBy("result_set").agg(
        F.sum("n").alias("n_rows"), F.sum(F.greatest("d", F.lit(0))).alias("only_stored"), F.sum(F.greatest(-F.col("d"), F.lit(0))).alias("only_again"))
    names = ws.spark.createDataFrame([(n,) for n in RESULT_SETS], "result_set string")
    return names.join(found, "result_set", "left").select(
        "result_set", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_rows", "only_stored", "only_again")])


# The columns that tell the rows of a result set apart; a set that is not named has one row.
ROW_KEYS = {
    **dict.fromkeys(("q1_1b_register", "q2_1b_register", "q3_1b_register", "q4_1b_register", "q5_1b_register", "q6_1b_register"), ["metric_id"]),
    **dict.fromkeys(("q1_4_concentration_by_method", "q1_6b_method_sensitivity", "q2_4_competition_by_method", "q3_4_variance_by_method",
                     "q4_4_timing_by_method"), ["procurement_method"]),
    **dict.fromkeys(("q1_5_concentration_by_entity", "q3_5_entity_variance", "q3_6_entity_departure", "q3_9_above_ten_by_entity",
                     "q3_11b_above_ten_without_flagged", "q5_3_top_entities", "q5_7b_top_entities_without_flagged", "q6_5_lowest_coverage"), ["buyer_id"]),
    **dict.fromkeys(("q1_6_concentration_sensitivity", "q3_11_budget_sensitivity"), ["scenario"]),
    **dict.fromkeys(("q4_1_timing_medians", "q4_2_timing_distribution"), ["measure"]),
    **dict.fromkeys(("q5_2_activity_share", "q5_7_top_share_sensitivity"), ["largest_entities"]),
    **dict.fromkeys(("q5_0_minimum_n", "q5_5_kpi_spread"), ["kpi"]),
    "q1_3_top_suppliers": ["supplier_id"], "q2_1_competition_headline": ["population"], "q2_2_participation_bands": ["participation_band"],
    "q2_5_competition_by_status": ["tender_status"], "q2_6_competition_extremes": ["ranking", "buyer_id"], "q3_3_ratio_bands": ["ratio_band"],
    "q3_12_ratio_near_groups": ["ratio_group"], "q4_3_duration_bands": ["measure", "duration_band"], "q4_5_duration_by_year": ["tender_start_year"],
    "q4_6_lag_by_year": ["award_year"], "q5_4_kpi_profile": ["buyer_name"], "q5_6_kpi_by_quartile": ["value_quartile"],
    "q6_2_implementation_types": ["implementation_data_type"], "q6_3_coverage_by_status": ["contract_status"],
    "q6_4_coverage_bands": ["entity_coverage_band"], "q6_6_lifecycle_funnel": ["stage_order"],
    "q7_1_exclusions_by_metric": ["metric_id"], "q7_2_issue_matrix": ["metric_id", "dq_ref"], "q7_3_issues_across_metrics": ["dq_ref"],
}


def result_cells(ws) -> DataFrame:
    """The numbers of every stored result set as (result_set, row_key, column_name, cell) rows."""
    stored_results(ws)
    keys = F.create_map(*[x for n, ks in ROW_KEYS.items() for x in (F.lit(n), F.array(*[F.lit(k) for k in ks]))])
    return ws.table("numeric_cells", lambda: numeric_cells(ws.spark.read.parquet(f"{ws.root}/result_sets"), keys))


def stated_claims(ws) -> DataFrame:
    """A claim for every number of every set: percentages to one place, counts to none, other figures to two.

    Of each seven kinds of place one is planted wrong: one step too high (0), a row that does not exist
    (3), no number of records (5).
    """
    percent = F.contains("column_name", F.lit("pct"))
    whole = F.col("cell") == F.floor("cell")
    plant = F.length(F.concat("row_key", "column_name")) % 7
    step = F.when(percent, F.lit("0.1")).when(whole, F.lit("1")).otherwise(F.lit("0.01")).cast("decimal(9,8)")
    up = F.floor((F.abs("cell") / step).cast("decimal(38,8)") + F.lit("0.5").cast("decimal(2,1)"))
    stated = (F.signum(F.col("cell").cast("double")).cast("int") * up * step + F.when(plant == 0, step).otherwise(0)).cast("decimal(38,8)")
    return result_cells(ws).select(
        "result_set", F.when(plant == 3, F.concat("row_key", F.lit("?"))).otherwise(F.col("row_key")).alias("row_key"), "column_name",
        F.when(percent, "percent").when(whole, "count").otherwise("figure").alias("kind"),
        F.when(percent, 1).when(whole, 0).otherwise(2).alias("places"), stated.alias("stated"),
        F.when(plant != 5, 1).alias("eligible_n"))


def claim_trace(ws) -> DataFrame:
    """The claims on every result set, traced to the cells they cite."""
    return trace_claims(stated_claims(ws), result_cells(ws)).select(
        "result_set", "row_key", "column_name", "kind", "stated", F.round("cell", 6).alias("cell"), "holds")


COMPARISONS = {
    "c14_figure_comparison": figure_comparison,
    "c15_cell_comparison": cell_comparison,
    "c15b_store_comparison": store_comparison,
    "c16_claim_trace": claim_trace,
    "r_all_figures": lambda ws: figure_pack(ws).groupBy("page", "unit").agg(
        rows().alias("n_figures"), F.count("expected_value").alias("with_value"), F.count("measure").alias("with_measure")),
    "p10c_equal_to_package_date": equal_to_package_date,
    "st1_streamed_pick": lambda ws: incremental.streamed_snapshot(ws).select(
        "ocid", "latest_release_id", "buyer_id", "tender_release_id", "award_release_id"),
    "st1c_streamed_snapshot": incremental.streamed_snapshot,
    "st1b_streamed_budget_lines": incremental.streamed_budget_lines,
}

DELIVERABLES = {**SOURCES, **MEASURES, **COMPARISONS}
