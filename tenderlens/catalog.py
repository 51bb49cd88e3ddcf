"""Every named query: key to ``f(workspace) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderlens.operators.latest import latest_by_max, latest_per_key
from tenderlens.functions import flags
from tenderlens.operators.attribution import candidate_records, exclusion_attribution
from tenderlens.plans import (
    building_blocks,
    check_suites,
    core,
    deliverables,
    impact,
    profile,
    questions_entity,
    questions_supply,
    questions_value,
    study,
    views,
)
from tenderlens.plans.workspace import VIEW_NAMES, DerivedWorkspace, Workspace
from tenderlens.sources import package
from tenderlens.sources.order_releases import ORDER_RULES, order_documents, order_rows

Query = Callable[[Workspace], DataFrame]


def present(df: DataFrame) -> DataFrame:
    """Plain result types: decimals as double, integers as bigint, arrays as text."""

    def plain(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            return c.cast("double").alias(f.name)
        if isinstance(f.dataType, (T.IntegerType, T.ShortType)):
            return c.cast("bigint").alias(f.name)
        if isinstance(f.dataType, T.ArrayType):
            return F.array_join(c, ",").alias(f.name)
        if isinstance(f.dataType, T.TimestampType):
            return flags.utc_day(c).alias(f.name)
        return c

    return df.select(*[plain(f) for f in df.schema.fields])


def _section(name: str) -> Query:
    """The flatten operator itself, over the stored release documents."""
    flat = getattr(package, f"flatten_{name}")
    takes_rules = flat.__code__.co_argcount == 2

    def run(ws: Workspace) -> DataFrame:
        return flat(ws.releases, ws.rules) if takes_rules else flat(ws.releases)

    return run


STAGING: dict[str, Query] = {
    f"s{i:02d}_{name}": _section(name)
    for i, name in enumerate(
        ("releases", "planning", "tender", "awards", "award_suppliers", "contracts", "transactions", "milestones", "parties"), 2
    )
}

CORE: dict[str, Query] = {
    "k01_budget_lines": lambda ws: core.build_budget_lines(ws.stg.planning),
    "k02_release_facts": lambda ws: core.release_facts(ws.stg.releases),
    "k03_tags_per_process": lambda ws: core.release_facts(ws.stg.releases).select("ocid", "tags_observed"),
    "k04_latest_tender": lambda ws: core.pick_latest(ws.stg.tender, "tender", "tender_id"),
    "k05_latest_award": lambda ws: core.pick_latest(ws.stg.awards, "award", "award_id"),
    "k06_award_contract": lambda ws: ws.stg.awards.select("award_id", "release_id").join(
        ws.stg.contracts.select("release_id", "award_id", "contract_id"), ["release_id", "award_id"], "left"
    ),
    "k07_process_snapshot": lambda ws: core.build_process_snapshot(ws.stg, ws.core.budget_lines),
    "k08_latest_award_by_max": lambda ws: latest_by_max(
        ws.stg.awards.select("ocid", "award_id", "release_id", "release_seq"), ["ocid"], "release_seq"
    ).drop("release_seq"),
    "k09_latest_line_by_row_number": lambda ws: latest_per_key(
        ws.stg.planning.filter(F.col("budget_project_id").isNotNull()), ["ocid", "budget_project_id"], ["release_seq"]
    ).select("ocid", "budget_project_id", "release_id"),
    "k10_dim_buyer": lambda ws: core.build_dim_buyer(ws.stg.releases, ws.rules),
    "k11_dim_supplier": lambda ws: core.build_dim_supplier(ws.stg.parties, ws.stg.award_suppliers, ws.rules),
}


def _view(name: str) -> Query:
    return lambda ws: ws.v.plan(name)


VIEWS: dict[str, Query] = {
    "v01_budget_eligible": _view("budget_eligible"),
    "v02_competition_eligible": _view("competition_eligible"),
    "v03_award_value_eligible": _view("award_value_eligible"),
    "v04_supplier_award_eligible": _view("supplier_award_eligible"),
    "v05_budget_award_comparison": _view("budget_award_comparison"),
    "v06_tender_duration_eligible": _view("tender_duration_eligible"),
    "v07_award_lag_eligible": _view("award_lag_eligible"),
    "v08_signature_lag_eligible": _view("signature_lag_eligible"),
    "v09_lifecycle_stage": _view("lifecycle_stage"),
    "v10_contract_implementation_coverage": _view("contract_implementation_coverage"),
    "v11_entity_benchmark": _view("entity_benchmark"),
    "v12_metric_population": _view("metric_population"),
    "v13_dq_impact": _view("dq_impact"),
    "v14_dim_buyer": _view("dim_buyer"),
    "v15_dim_procurement_method": _view("dim_procurement_method"),
    "v16_award_scale_flag": _view("award_scale_flag"),
    "v17_exclude_test": lambda ws: views.exclude_test(ws.core.process_snapshot, ws.core).select(
        "ocid", "buyer_id", "buyer_name"
    ),
}


def _attributed(ws: Workspace) -> DataFrame:
    return exclusion_attribution(impact.populations(ws.v))


def _invariants(ws: Workspace) -> DataFrame:
    """Excluded = candidate - eligible, and single-cause losses never exceed it."""
    whole = F.col("dq_ref") == "ALL"
    kept = ws.v.dq_impact.filter(~F.col("impact_type").isin("DISCLOSED", "PRE_EXCLUDED"))
    t = kept.groupBy("metric_id").agg(
        F.max(F.when(whole, F.col("candidate_records") - F.col("eligible_records"))).alias("candidate_minus_eligible"),
        F.max(F.when(whole, F.col("records_with_issue"))).alias("excluded"),
        F.coalesce(F.sum("records_lost_only_to_issue"), F.lit(0)).alias("single_cause"),
    )
    ok = (F.col("excluded") == F.col("candidate_minus_eligible")) & (F.col("single_cause") <= F.col("excluded"))
    return t.withColumn("reconciles", ok)


ATTRIBUTION: dict[str, Query] = {
    "d01_candidate_records": lambda ws: candidate_records(impact.populations(ws.v)),
    "d02_pre_exclusion": lambda ws: _attributed(ws).filter("dq_ref = 'PRE'").select(
        "metric_id", F.col("records_with_issue").alias("test_records"), F.col("affected_value").alias("test_value")
    ),
    "d03_issue_hits": lambda ws: _attributed(ws).filter(~F.col("dq_ref").isin("ALL", "OTHER", "PRE")).drop(
        "candidate_records"
    ),
    "d04_metric_totals": lambda ws: _attributed(ws).filter(F.col("dq_ref").isin("ALL", "OTHER")),
    "d05_eligible_side": lambda ws: impact.eligible_side(ws.v),
    "d06_disclosures": lambda ws: impact.disclosures(ws.v).select(
        "metric_id", "dq_ref", "candidate_records", "records_with_issue", "affected_value", "eligible_value"
    ),
    "d07_dq_impact": lambda ws: impact.dq_impact(ws.v),
    "d08_invariants": _invariants,
}


CHECKS: dict[str, Query] = {
    **{
        name: (lambda ws, f=f: f(ws).drop("check_group", "check_name"))
        for name, f in check_suites.SUITES.items()
    },
    "c13_document_reconciliation": check_suites.document_reconciliation,
}


def _on_views(table: dict) -> dict[str, Query]:
    return {k: (lambda ws, f=f: f(ws.v)) for k, f in table.items()}


QUESTIONS: dict[str, Query] = {
    **_on_views(questions_supply.RESULT_SETS),
    **_on_views(questions_value.RESULT_SETS),
    **_on_views(questions_entity.RESULT_SETS),
}

QUERIES: dict[str, Query] = {
    **STAGING, **CORE, **VIEWS, **ATTRIBUTION, **QUESTIONS, **CHECKS, **study.STUDIES, **profile.PROFILES,
    **building_blocks.BLOCKS,
    **deliverables.DELIVERABLES,
}

_WORKSPACES: dict[tuple[str, str], Workspace] = {}


def workspace(spark: SparkSession, sf_dir: str) -> Workspace:
    """One workspace per application and input folder; its tables are built on first use.

    They answer for the input as it was then; call ``refresh`` after it has changed.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _WORKSPACES:
        _WORKSPACES[key] = DerivedWorkspace(spark, lambda: order_rows(spark, sf_dir), order_documents, ORDER_RULES)
    return _WORKSPACES[key]


def refresh(spark: SparkSession, sf_dir: str) -> None:
    """Forget and remove the tables built from this folder: the next query reads it anew."""
    ws = _WORKSPACES.pop((spark.sparkContext.applicationId, sf_dir), None)
    if ws:
        ws.close()


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return present(QUERIES[name](workspace(spark, sf_dir)))


__all__ = ["QUERIES", "VIEW_NAMES", "present", "refresh", "run", "workspace"]
