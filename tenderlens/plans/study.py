"""Snapshot-rule studies: which rule picks which budget, and how repeated releases diverge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlens.functions import flags
from tenderlens.operators.latest import text_order_disagrees
from tenderlens.plans.common import rows
from tenderlens.plans.core import pick_latest

# Rule code and description.
SNAPSHOT_RULES = {
    "R0": "most tags, ties by text order of the id",
    "R1": "most tags, ties by integer order",
    "R2": "latest release that has a budget",
    "R3": "latest budget per project, summed",
}
# Fixed value: the tags of a release that covers the whole life of a process, in text order.
FULL_LIFECYCLE = ("award", "contract", "implementation", "planning", "tender")


def _budgeted(ws) -> DataFrame:
    """Every release with its tags and budget; ``has`` tells whether it has a budget object, whatever its amount."""
    return ws.releases.select(
        F.col("id").alias("release_id"), "ocid", flags.sequence_key(F.col("id")).alias("release_seq"), "tag",
        F.col("planning.budget").isNotNull().alias("has"),
        F.col("planning.budget.projectID").alias("project"),
        F.col("planning.budget.amount").alias("money"),
        F.col("planning.budget.amount.amount").alias("amount"),
    )


def _latest_per_project(b: DataFrame) -> DataFrame:
    """The latest budget of each project of a process; a missing project is a project, a later NULL replaces an amount."""
    return b.filter("has").groupBy("ocid", "project").agg(
        F.max_by(F.struct("amount"), "release_seq").alias("last")
    ).select("ocid", "project", F.col("last.amount").alias("amount"))


def rule_values(ws) -> DataFrame:
    """One row per process with the budget each rule would use."""
    b = _budgeted(ws)
    n, amount = F.size("tag"), F.struct(F.col("amount").alias("a"))
    whole = b.groupBy("ocid").agg(
        F.max_by(amount, F.struct(n.alias("n"), F.col("release_id").alias("id"))).alias("R0"),
        F.max_by(amount, F.struct(n.alias("n"), F.col("release_seq").alias("id"))).alias("R1"),
        F.max_by(amount, F.when(F.col("has"), F.col("release_seq"))).alias("R2"),
    )
    summed = _latest_per_project(b).groupBy("ocid").agg(F.coalesce(F.sum("amount"), F.lit(0)).alias("R3"))
    return whole.join(summed, "ocid", "left").select(
        "ocid", F.col("R0.a").alias("R0"), F.col("R1.a").alias("R1"), F.col("R2.a").alias("R2"), "R3"
    )


def rule_comparison(ws) -> DataFrame:
    """Per rule: processes with a budget, total without extremes, and how many
    processes differ from each other rule (NULL-safe)."""
    codes = list(SNAPSHOT_RULES)
    money = "decimal(38,4)"
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("rule"),
                F.col(c).cast(money).alias("amount"),
                *[(~F.col(c).eqNullSafe(F.col(o))).cast("int").alias(f"d_{o}") for o in codes],
            )
            for c in codes
        ]
    )
    long = rule_values(ws).select(F.inline(cells))
    limit = F.lit(ws.rules.extreme_budget)
    return long.groupBy("rule").agg(
        F.count("amount").alias("processes_with_budget"),
        F.sum(F.when(F.col("amount") < limit, F.col("amount"))).alias("total_without_extreme"),
        *[F.sum(f"d_{o}").alias(f"differs_from_{o.lower()}") for o in codes],
    )


def order_disagreement(ws) -> DataFrame:
    return text_order_disagrees(ws.stg.releases, "ocid", "release_id", "release_seq")


def _several(value, where=None) -> Column:
    """More than one distinct value, NULL counted as a value, from hash aggregates of fixed width."""
    h = F.xxhash64(value)
    h = h if where is None else F.when(where, h)
    return F.coalesce(F.min(h) != F.max(h), F.lit(False))


def _sparsely_budgeted(ws) -> DataFrame:
    """The releases as if nine in ten had no budget object, by their number."""
    kept = F.col("release_seq") % 10 == 1
    blank = {c: F.when(kept, F.col(c)) for c in ("project", "money", "amount")}
    return _budgeted(ws).withColumns({"has": F.col("has") & kept, **blank})


def divergence(ws, budgeted=_budgeted) -> DataFrame:
    """What changes between the releases of one process; one aggregate per process, then counts."""
    b = budgeted(ws)
    has = F.col("has")
    money = F.coalesce(F.to_json("money"), F.lit(""))
    tags = F.array_join(F.array_sort("tag"), ",")
    full, planning = ",".join(FULL_LIFECYCLE), "planning"
    per = b.groupBy("ocid").agg(
        rows().alias("n"),
        _several(money).alias("differing"),
        _several(F.coalesce(F.col("amount").cast("string"), F.lit("")), has).alias("amounts"),
        _several(F.coalesce("project", F.lit("")), has).alias("projects"),
        _several(tags).alias("tag_sets"),
        F.count_if(tags == full).alias("full"),
        F.bool_and(tags == planning).alias("planning_only"),
        F.max("release_seq").alias("last"),
        F.max(F.when(has, F.col("release_seq"))).alias("last_with"),
    ).filter("n > 1")
    spans = b.filter(has).groupBy("project").agg(
        F.min(F.xxhash64("ocid")).alias("a"), F.max(F.xxhash64("ocid")).alias("b")
    ).agg(F.count_if(F.col("a") != F.col("b"))).scalar()
    lines = _latest_per_project(b).agg(rows()).scalar()
    pattern = F.when(F.col("projects"), "MULTI_PROJECT").when(F.col("amounts"), "SAME_PROJECT_REVISED").otherwise("IDENTICAL_BUDGET")
    per = per.withColumn("pattern", pattern)
    out = per.agg(
        rows().alias("multi_release_processes"),
        F.count_if("differing").alias("differing_budgets"),
        F.count_if(F.col("differing") & ~F.col("amounts")).alias("differing_by_missing_only"),
        F.count_if("tag_sets").alias("mixed_tag_sets"),
        F.count_if(F.col("full") >= 2).alias("two_or_more_full_lifecycle"),
        F.count_if(~F.col("last").eqNullSafe(F.col("last_with"))).alias("latest_lacks_budget"),
        *[F.count_if(F.col("pattern") == p).alias(p.lower()) for p in
          ("IDENTICAL_BUDGET", "SAME_PROJECT_REVISED", "MULTI_PROJECT")],
        F.count_if((F.col("pattern") == "MULTI_PROJECT") & F.col("planning_only")).alias("multi_project_planning_only"),
    )
    return out.withColumns({"projects_spanning_processes": spans, "budget_lines_per_project_rule": lines})


def award_conflicts(ws) -> DataFrame:
    """Processes whose releases disagree on their first award: its value or its whole list of suppliers."""
    first = F.get("awards", F.lit(0))
    suppliers = F.array_sort(F.transform(first["suppliers"], lambda s: F.coalesce(s["id"], F.lit(""))))
    sig = F.struct(
        first["value"]["amount"].alias("value"), F.coalesce(suppliers, F.array().cast("array<string>")).alias("suppliers")
    )
    signed = ws.releases.filter(F.size("awards") > 0).select("ocid", F.to_json(sig).alias("sig"))
    return (
        signed.groupBy("ocid", "sig").agg(rows().alias("n"))
        .groupBy("ocid").agg(F.sum("n").alias("award_releases"), rows().alias("signatures"))
        .filter((F.col("award_releases") > 1) & (F.col("signatures") > 1))
    )


def section_alignment(ws) -> DataFrame:
    """Do the latest tender, award and contract of a process come from one release?"""
    stg = ws.stg
    t = pick_latest(stg.tender, "tender", "tender_id")
    a = pick_latest(stg.awards, "award", "award_id")
    c = pick_latest(stg.contracts, "contract", "contract_id")
    multi = stg.releases.groupBy("ocid").agg(rows().alias("n")).filter("n > 1").select("ocid")
    j = multi.join(t, "ocid", "left").join(a, "ocid", "left").join(c, "ocid", "left")
    ar, cr, tr = F.col("award_release_id"), F.col("contract_release_id"), F.col("tender_release_id")
    elsewhere = stg.contracts.select("release_id", "award_id").join(
        stg.awards.select("release_id", "award_id"), ["release_id", "award_id"], "left_anti"
    ).agg(rows()).scalar()
    return j.agg(
        F.count_if(ar != cr).alias("award_release_ne_contract_release"),
        F.count_if(tr != ar).alias("tender_release_ne_award_release"),
    ).withColumns({
        "contract_award_in_other_release": elsewhere,
        "most_awards_per_release": ws.releases.agg(F.max(F.coalesce(F.size("awards"), F.lit(0))).cast("bigint")).scalar(),
    })


def _per_contract(ws) -> DataFrame:
    tx = ws.stg.transactions.groupBy("contract_id").agg(
        rows().alias("n"), F.sum("transaction_value").alias("s"), F.max("transaction_value").alias("m")
    )
    return ws.stg.contracts.select("contract_id", "contract_value_amount").join(tx, "contract_id", "left")


def transactions_per_contract(ws) -> DataFrame:
    return _per_contract(ws).groupBy(F.coalesce("n", F.lit(0)).alias("transactions")).agg(rows().alias("contracts"))


def transactions_against_value(ws) -> DataFrame:
    v, near = F.col("contract_value_amount"), F.lit(0.01)
    s, m = F.col("s"), F.col("m")
    kind = (
        F.when(F.abs(s - v) < near, "sum_equals_contract_value")
        .when(F.abs(m - v) < near, "max_equals_contract_value")
        .when(s > v, "sum_exceeds_contract_value")
        .otherwise("sum_below_contract_value")
    )
    known = F.col("n").isNotNull() & v.isNotNull() & (v != 0)
    return _per_contract(ws).filter(known).groupBy(kind.alias("relation")).agg(rows().alias("contracts"))


def process_history(ws, processes: DataFrame) -> DataFrame:
    """One row per release of the given processes (a DataFrame of ``ocid``), every section as it stands in the release.

    Awards, contracts and their transactions stay nested, so nothing fans out.
    """
    rel = ws.releases.join(processes.select("ocid").distinct(), "ocid", "left_semi")
    none = F.array()
    awards = F.transform(F.coalesce("awards", none), lambda a: F.concat_ws(
        "|", a["id"], F.coalesce(a["status"], F.lit("-")), F.substring(F.coalesce(a["date"], F.lit("-")), 1, 10),
        F.coalesce(a["value"]["amount"].cast("decimal(30,2)").cast("string"), F.lit("-")), F.coalesce(a["title"], F.lit("-")),
        F.array_join(F.transform(F.coalesce(a["suppliers"], none), lambda s: F.concat_ws("=", s["id"], s["name"])), ";"),
    ))
    contracts = F.transform(F.coalesce("contracts", none), lambda c: F.concat_ws(
        "|", c["id"], F.coalesce(c["status"], F.lit("-")), F.substring(F.coalesce(c["dateSigned"], F.lit("-")), 1, 10),
        F.coalesce(c["value"]["amount"].cast("decimal(30,2)").cast("string"), F.lit("-")), F.coalesce(c["title"], F.lit("-")),
        F.size(F.coalesce(c["implementation"]["transactions"], none)).cast("string"),
        F.aggregate(
            F.coalesce(c["implementation"]["transactions"], none), F.lit(0).cast("decimal(30,2)"),
            lambda t, x: (t + F.coalesce(x["value"]["amount"], F.lit(0))).cast("decimal(30,2)"),
        ).cast("string"),
        F.size(F.coalesce(c["implementation"]["milestones"], none)).cast("string"),
    ))
    return rel.select(
        "ocid", flags.sequence_key(F.col("id")).alias("release_seq"), F.col("id").alias("release_id"),
        F.substring("date", 1, 10).alias("release_day"), F.array_join("tag", ",").alias("tags"),
        F.col("buyer.id").alias("buyer_id"), F.col("buyer.name").alias("buyer_name"),
        F.col("planning.budget.projectID").alias("budget_project_id"), F.col("planning.budget.project").alias("budget_project"),
        F.col("planning.budget.description").alias("budget_description"),
        F.col("planning.budget.amount.amount").alias("budget_amount"),
        F.col("tender.id").alias("tender_id"), F.col("tender.title").alias("tender_title"),
        F.col("tender.description").alias("tender_description"), F.col("tender.status").alias("tender_status"),
        F.col("tender.procurementMethodDetails").alias("procurement_method_details"),
        F.col("tender.value.amount").alias("tender_value_amount"), F.col("tender.numberOfTenderers").alias("number_of_tenderers"),
        F.substring("tender.tenderPeriod.startDate", 1, 10).alias("tender_start"),
        F.substring("tender.tenderPeriod.endDate", 1, 10).alias("tender_end"),
        F.array_join(awards, " / ").alias("awards"), F.array_join(contracts, " / ").alias("contracts"),
    ).orderBy("ocid", "release_seq")


def flagged_history(ws) -> DataFrame:
    return process_history(ws, ws.v.award_scale_flag.select("ocid"))


STUDIES = {
    "k12_rule_comparison": rule_comparison,
    "k13_order_disagreement": order_disagreement,
    "k14_divergence": divergence,
    "k14c_divergence_without_budgets": lambda ws: divergence(ws, _sparsely_budgeted),
    "k14b_award_conflicts": award_conflicts,
    "k15_section_alignment": section_alignment,
    "k16_transactions_per_contract": transactions_per_contract,
    "k16b_transactions_against_value": transactions_against_value,
    "k17_process_history": flagged_history,
}
