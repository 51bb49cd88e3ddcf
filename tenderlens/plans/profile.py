"""Profiling of the release documents and the staging tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlens.functions import flags
from tenderlens.model import RELEASE_FIELDS
from tenderlens.operators.order_stats import exact_percentiles
from tenderlens.plans.common import rows, union
from tenderlens.rules import Rules

# Day texts that stand for no date, and the years of the profiler's classes.
PLACEHOLDER_DAYS = ("2001-01-01", "1970-01-01", "0001-01-01")
LAST_PAST_YEAR, LAST_PRESENT_YEAR, LAST_FUTURE_YEAR = 1999, 2025, 2030


def profiler_date_class(text: Column) -> Column:
    """Class of a raw date text; an empty text cannot be parsed, only NULL is missing."""
    year = F.year(F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"))
    return (
        F.when(text.isNull(), "NULL")
        .when(F.substring(text, 1, 10).isin(*PLACEHOLDER_DAYS), "PLACEHOLDER")
        .when(year.isNull(), "UNPARSEABLE")
        .when(year > LAST_FUTURE_YEAR, "EXTREME_FUTURE")
        .when(year > LAST_PRESENT_YEAR, "FUTURE")
        .when(year <= LAST_PAST_YEAR, "EXTREME_PAST")
        .otherwise("VALID")
    )


def study_date_class(text: Column, r: Rules) -> Column:
    """Class by the leading year alone; a text without one cannot be parsed, NULL and empty have no class."""
    leading = F.substring(text, 1, 4).try_cast("int")
    return (
        F.when(text.isNull() | (text == ""), F.lit(None).cast("string"))
        .when(leading.isNull(), "UNPARSEABLE")
        .when(F.startswith(text, F.lit(r.placeholder_date)), "PLACEHOLDER")
        .when(leading >= r.study_impossible_year, "IMPOSSIBLE")
        .when(leading >= r.study_future_year, "FUTURE")
        .otherwise("VALID")
    )


def raw_dates(releases: DataFrame) -> DataFrame:
    """(field, text) of every date in the documents, in one pass."""
    a = F.transform(F.coalesce("awards.date", F.array().cast("array<string>")), lambda x: F.struct(F.lit("award").alias("field"), x.alias("text")))
    s = F.transform(F.coalesce("contracts.dateSigned", F.array().cast("array<string>")), lambda x: F.struct(F.lit("contract_signed").alias("field"), x.alias("text")))

    def period(name, label):
        return F.when(
            F.col("tender").isNotNull(),
            F.array(F.struct(F.lit(label).alias("field"), F.col(f"tender.tenderPeriod.{name}").alias("text"))),
        ).otherwise(F.array().cast("array<struct<field:string,text:string>>"))

    kind = "array<struct<field:string,text:string>>"
    every = F.concat(period("startDate", "tender_start").cast(kind), period("endDate", "tender_end").cast(kind), a.cast(kind), s.cast(kind))
    return releases.select(F.inline(every))


def date_classes(ws) -> DataFrame:
    c = profiler_date_class(F.col("text"))
    return raw_dates(ws.releases).groupBy("field", c.alias("date_class")).agg(
        rows().alias("n"), F.min("text").alias("first_text"), F.max("text").alias("last_text")
    )


def release_distribution(ws) -> DataFrame:
    """How many processes have how many releases, and the releases in excess of one."""
    per = ws.stg.releases.groupBy("ocid").agg(rows().alias("releases_per_process"))
    return per.groupBy("releases_per_process").agg(rows().alias("processes")).withColumn(
        "excess_releases", (F.col("releases_per_process") - 1) * F.col("processes")
    )


def most_repeated(ws, n: int = 10) -> DataFrame:
    per = ws.stg.releases.groupBy("ocid").agg(rows().alias("releases"))
    return per.orderBy(F.col("releases").desc(), "ocid").limit(n)


def field_presence(ws) -> DataFrame:
    """Present and non-empty counts of every top-level field, one scan."""
    def filled(name, kind):
        c = F.col(name)
        if kind.startswith("array"):
            return c.isNotNull() & (F.size(c) > 0)
        if kind == "string":
            return c.isNotNull() & (c != "")
        return c.isNotNull()

    aggs = []
    for name, kind in RELEASE_FIELDS.items():
        aggs += [F.count(name).alias(f"p_{name}"), F.count_if(F.coalesce(filled(name, kind), F.lit(False))).alias(f"f_{name}")]
    cells = F.array(
        *[F.struct(F.lit(x).alias("field"), F.col(f"p_{x}").alias("present"), F.col(f"f_{x}").alias("non_empty")) for x in RELEASE_FIELDS]
    )
    return ws.releases.agg(*aggs).select(F.inline(cells))


def section_presence(ws) -> DataFrame:
    """Which sections and inner fields the documents have, one scan, no explode."""
    none = F.array()

    def of(array, test=None):
        items = F.coalesce(array, none)
        return F.size(items if test is None else F.filter(items, test))

    def total(c):
        return F.coalesce(F.sum(c), F.lit(0)).cast("bigint")

    def present(path):
        return F.count(F.col(path))

    awards, contracts, parties = F.col("awards"), F.col("contracts"), F.col("parties")
    tender = F.col("tender")
    items = {
        "buyer": present("buyer"), "planning": present("planning"), "budget": present("planning.budget"),
        "budget amount": present("planning.budget.amount.amount"), "tender": present("tender"),
        "tender without number of tenderers": F.count_if(tender.isNotNull() & tender["numberOfTenderers"].isNull()),
        "tender value": present("tender.value.amount"),
        "tender title": F.count_if(F.coalesce(tender["title"] != "", F.lit(False))),
        "releases with awards": F.count_if(of(awards) > 0), "releases with several awards": F.count_if(of(awards) > 1),
        "awards": total(of(awards)), "awards without value": total(of(awards, lambda a: a["value"]["amount"].isNull())),
        "award dates": total(of(awards, lambda a: F.coalesce(a["date"] != "", F.lit(False)))),
        "releases with contracts": F.count_if(of(contracts) > 0), "contracts": total(of(contracts)),
        "contract period starts": total(of(contracts, lambda c: F.coalesce(c["period"]["startDate"] != "", F.lit(False)))),
        "contract period ends": total(of(contracts, lambda c: F.coalesce(c["period"]["endDate"] != "", F.lit(False)))),
        "releases with parties": F.count_if(of(parties) > 0), "parties": total(of(parties)),
        "parties without id": total(of(parties, lambda p: p["id"].isNull())),
        "parties without name": total(of(parties, lambda p: p["name"].isNull())),
        "implementation in the tags": F.count_if(F.array_contains(F.coalesce("tag", none), "implementation")),
    }
    one = ws.releases.agg(*[c.alias(f"x{i}") for i, c in enumerate(items.values())])
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("item"), F.col(f"x{i}").alias("n")) for i, n in enumerate(items)])))


def tag_combinations(ws) -> DataFrame:
    """Tag sets over all releases, and within processes that repeat."""
    tags = F.array_join(F.array_sort("tag"), ",").alias("tags")
    n = ws.stg.releases.groupBy("ocid").agg(rows().alias("n"))
    return ws.stg.releases.join(n, "ocid").groupBy(tags).agg(
        rows().alias("releases"), F.count_if(F.col("n") > 1).alias("in_repeated_processes")
    )


def describe_amounts(ws) -> DataFrame:
    """Count, range, mean, zeros, negatives and exact percentiles per measure.

    All but the median are exclusive; a sample too small for one has its end instead.
    """
    stg = ws.stg
    long = union(
        [
            stg.planning.select(F.lit("budget").alias("measure"), F.col("budget_amount").alias("x")),
            stg.tender.select(F.lit("tender_value").alias("measure"), F.col("tender_value_amount").alias("x")),
            stg.awards.select(F.lit("award").alias("measure"), F.col("award_value_amount").alias("x")),
            stg.tender.select(F.lit("tenderers").alias("measure"), F.col("number_of_tenderers").cast("decimal(30,4)").alias("x")),
        ]
    ).filter(F.col("x").isNotNull())
    x = F.col("x")
    stats = long.groupBy("measure").agg(
        rows().alias("n"), F.min(x).alias("minimum"), F.max(x).alias("maximum"),
        F.round(F.sum(x).cast("double") / F.count(x), 2).alias("mean"),
        F.count_if(x == 0).alias("zeros"), F.count_if(x < 0).alias("negatives"),
    )
    outer = exact_percentiles(long, "x", {"q1": 0.25, "q3": 0.75, "p95": 0.95, "p99": 0.99}, ["measure"], exclusive=True)
    middle = exact_percentiles(long, "x", {"median": 0.5}, ["measure"])
    low, high = F.col("minimum").cast("double"), F.col("maximum").cast("double")
    ends = {"q1": (4, low), "q3": (4, high), "p95": (20, high), "p99": (100, high)}
    return stats.join(outer, "measure").join(middle, "measure").select(
        *stats.columns, F.round("median", 4).alias("median"),
        *[F.round(F.when(F.col("n") < least, end).otherwise(F.col(c)), 4).alias(c) for c, (least, end) in ends.items()],
    )


def threshold_counts(ws, thresholds: dict[str, list]) -> DataFrame:
    stg = ws.stg
    source = {
        "tenderers": (stg.tender, "number_of_tenderers"),
        "budget": (stg.planning, "budget_amount"),
        "award": (stg.awards, "award_value_amount"),
    }
    parts = []
    for measure, limits in thresholds.items():
        df, c = source[measure]
        one = df.agg(*[F.count_if(F.col(c) > x).alias(f"t{i}") for i, x in enumerate(limits)])
        cells = [
            F.struct(F.lit(measure).alias("measure"), F.lit(float(x)).alias("threshold"), F.col(f"t{i}").alias("above"))
            for i, x in enumerate(limits)
        ]
        parts.append(one.select(F.inline(F.array(*cells))))
    return union(parts)


def extreme_records(ws) -> DataFrame:
    """Extreme tenders, budgets and awards with what their release says around them, in one pass over the documents."""
    r = ws.rules
    none = F.array()
    budget, tender = F.col("planning.budget"), F.col("tender")

    def record(kind, value, award=None):
        text = F.lit(None).cast("string")
        a = award
        return F.struct(
            F.lit(kind).alias("kind"), value.cast("double").alias("value"),
            (text if a is None else a["id"]).alias("award_id"), (text if a is None else a["status"]).alias("award_status"),
            (text if a is None else F.substring(a["date"], 1, 10)).alias("award_day"),
            (text if a is None else F.array_join(F.transform(F.coalesce(a["suppliers"], none), lambda x: x["name"]), ";")).alias("suppliers"),
        )

    found = F.concat(
        F.when(tender["numberOfTenderers"] > r.elevated_max, F.array(record("tenderers", tender["numberOfTenderers"]))).otherwise(none),
        F.when(budget["amount"]["amount"] >= r.extreme_budget, F.array(record("budget", budget["amount"]["amount"]))).otherwise(none),
        F.transform(
            F.filter(F.coalesce("awards", none), lambda a: a["value"]["amount"] >= r.profile_extreme_value),
            lambda a: record("award", a["value"]["amount"], a),
        ),
    )
    context = ws.releases.select(
        F.col("id").alias("release_id"), "ocid", F.substring("date", 1, 10).alias("release_day"),
        F.array_join("tag", ",").alias("tags"), F.col("buyer.id").alias("buyer_id"), F.col("buyer.name").alias("buyer_name"),
        budget["amount"]["currency"].alias("budget_currency"), budget["description"].alias("budget_description"),
        budget["project"].alias("budget_project"), budget["projectID"].alias("budget_project_id"),
        tender["value"]["amount"].alias("tender_value_amount"), tender["title"].alias("tender_title"),
        tender["description"].alias("tender_description"), tender["status"].alias("tender_status"),
        tender["procurementMethod"].alias("procurement_method"),
        tender["procurementMethodDetails"].alias("procurement_method_details"), found.alias("found"),
    )
    return context.select("*", F.inline("found")).drop("found")


def extreme_overlap(ws) -> DataFrame:
    """Processes with both an extreme tender value and an extreme award."""
    limit = F.lit(ws.rules.profile_extreme_value)
    a = ws.stg.awards.filter(F.col("award_value_amount") >= limit).select("ocid").distinct()
    t = ws.stg.tender.filter(F.col("tender_value_amount") >= limit).select("ocid").distinct()
    return a.join(t, "ocid", "left_semi")


def implementation_structure(ws) -> DataFrame:
    """Contracts by number of transactions and milestones, from the documents."""
    c = ws.releases.select(F.explode("contracts").alias("c"))

    def n(path):
        return F.size(F.coalesce(F.col(path), F.array()))

    counts = c.select(
        F.col("c.implementation").isNotNull().alias("has_section"),
        n("c.implementation.transactions").alias("transactions"),
        n("c.implementation.milestones").alias("implementation_milestones"),
        n("c.milestones").alias("contract_milestones"),
    )
    keys = ["has_section", "transactions", "implementation_milestones", "contract_milestones"]
    return counts.groupBy(*keys).agg(rows().alias("contracts"))


def multiplicity(pairs: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with more than one distinct value."""
    p = pairs.select(key, value).filter(F.col(value).isNotNull()).distinct()
    return p.groupBy(key).agg(rows().alias("n_values"), F.min(value).alias("sample")).filter("n_values > 1")


def supplier_name_multiplicity(ws) -> DataFrame:
    party = ws.stg.parties.filter(F.array_contains("roles", "supplier")).select("party_id", "party_name_raw")
    def side(kind, key, value):
        return multiplicity(party, key, value).select(F.lit(kind).alias("kind"), "n_values", F.col(key).alias("key"))

    both = side("ids with several names", "party_id", "party_name_raw").unionByName(
        side("names with several ids", "party_name_raw", "party_id"))
    return both.groupBy("kind", "n_values").agg(rows().alias("n"), F.min("key").alias("sample"))


def frequencies(ws) -> DataFrame:
    """Value frequencies of methods, statuses, roles, releases and suppliers per award."""
    stg = ws.stg

    def freq(df, label, c):
        return df.groupBy(c.cast("string").alias("value")).agg(rows().alias("n")).select(F.lit(label).alias("field"), "value", "n")

    per_award = stg.award_suppliers.groupBy("award_id").agg(rows().alias("n"))
    return union(
        [
            freq(stg.tender, "procurement_method_details", F.col("procurement_method_details")),
            freq(stg.tender, "tender_status", F.col("status")),
            freq(stg.awards, "award_status", F.col("status")),
            freq(stg.contracts, "contract_status", F.col("status")),
            freq(stg.parties.select(F.explode("roles").alias("role")), "party_role", F.col("role")),
            freq(per_award, "suppliers_per_award", F.col("n")),
        ]
    )


def release_dates_by_year(ws) -> DataFrame:
    return ws.stg.releases.groupBy(F.year(flags.utc_day(F.col("release_date"))).alias("year")).agg(
        rows().alias("releases"), F.count_distinct("ocid").alias("processes")
    )


def date_order_disagreement(ws) -> DataFrame:
    """Processes whose newest publication date is not on the release with the greatest id."""
    per = ws.stg.releases.groupBy("ocid").agg(
        rows().alias("n"),
        F.max_by("release_id", F.struct("release_date", "release_seq")).alias("by_date"),
        F.max_by("release_id", "release_seq").alias("by_id"),
    ).filter("n > 1")
    return per.agg(rows().alias("repeated_processes"), F.count_if(F.col("by_date") != F.col("by_id")).alias("order_disagrees"))


def dropped_decimal_candidates(ws) -> DataFrame:
    """Awards above 10 x budget: does a whole-number award fit the budget once divided by 100? Decimals throughout."""
    b = ws.v.budget_award_comparison.filter(F.col("award_to_budget_ratio") > 10)
    award, budget = F.col("award_value_amount"), F.col("budget_amount")
    whole = award % 1 == 0
    near = (award >= budget * 50) & (award <= budget * 200)
    return b.select("ocid", "award_id", "award_to_budget_ratio", whole.alias("whole_number"), (whole & near).alias("fits_after_division"))


PROFILES = {
    "p01_release_distribution": release_distribution,
    "p01b_most_repeated": most_repeated,
    "p02_field_presence": field_presence,
    "p02b_section_presence": section_presence,
    "p03_tag_combinations": tag_combinations,
    "p04_describe_amounts": describe_amounts,
    "p05_extreme_records": extreme_records,
    "p05b_extreme_overlap": extreme_overlap,
    "p06_date_classes": date_classes,
    "p07_implementation_structure": implementation_structure,
    "p08_supplier_name_multiplicity": supplier_name_multiplicity,
    "p09_frequencies": frequencies,
    "p10_release_dates_by_year": release_dates_by_year,
    "p10b_date_order_disagreement": date_order_disagreement,
    "p11_dropped_decimal_candidates": dropped_decimal_candidates,
}
