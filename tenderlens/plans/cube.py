"""Measures of any slice, read from cubes instead of the views.

Each view that carries filter fields is reduced once to cells: one row per
combination of its fields and of the values a measure needs, with the number of
rows and their sums. Cells add up, so counts, sums and rates of a slice are sums
over its cells, and the cells of a value are an exact histogram from which any slice's
median is read. A cube is stored like a view; after that no call reads the view again, and
the calls on one cube share one scan of it, whatever their filters.

An award lies in one cell of fields (they are its own), so distinct awards add up too.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenderlens.functions import bands
from tenderlens.operators.concentration import concentration, hhi, top_shares_with_ties
from tenderlens.operators.order_stats import exact_percentiles
from tenderlens.plans import questions_supply
from tenderlens.plans.common import dbl, mark, ratio, rows, union
from tenderlens.plans.measures import FIELDS, FLAG_VIEWS, PRIMARY, SIMPLE
from tenderlens.plans.questions_supply import AWARD
from tenderlens.plans.questions_value import BUDGET, RATIO


@dataclass(frozen=True)
class Cube:
    """A view's cells: ``keys`` beside its filter fields; ``sums``, ``greatest`` and ``distinct`` per cell."""

    view: str
    keys: tuple = ()
    sums: tuple = ()
    greatest: tuple = ()
    distinct: dict = field(default_factory=dict)

    def fields(self) -> dict[str, Column]:
        return {name: column() for name, (views, column) in FIELDS.items() if self.view in views}


CUBES = {
    "stages": Cube("lifecycle_stage", ("highest_stage_rank",)),
    "budgets": Cube("budget_eligible", sums=(BUDGET,)),
    "awards": Cube("award_value_eligible", (AWARD,), (AWARD,)),
    "holders": Cube("supplier_award_eligible", ("supplier_id",), (AWARD,), ("supplier_name", "name_variant_count")),
    "supplied": Cube("supplier_award_eligible", sums=(AWARD,), distinct={"award_id": "awards"}),
    "bidders": Cube("competition_eligible", ("number_of_tenderers", "is_single_bidder", PRIMARY)),
    "compared": Cube("budget_award_comparison", (RATIO,), (BUDGET, AWARD, "variance_amount"), ("buyer_name", "buyer_id_flag")),
    "compared_budgets": Cube("budget_award_comparison", (BUDGET,)),
    "durations": Cube("tender_duration_eligible", ("tender_duration_days",)),
    "lags": Cube("award_lag_eligible", ("award_lag_days",)),
    "signatures": Cube("signature_lag_eligible", ("signature_lag_days",)),
    "contracts": Cube("contract_implementation_coverage", ("has_implementation", "transaction_count", "implementation_milestone_count")),
}


def cells(v, name: str) -> DataFrame:
    """The stored cells of a cube: f_<field> columns, keys, n, and sums named as their columns."""

    def build() -> DataFrame:
        cube = CUBES[name]
        df = getattr(v, cube.view)
        if cube.view in FLAG_VIEWS:
            df = mark(df, v.award_scale_flag, "award_id", "f_scale_flag")
        df = df.withColumns({f"f_{f}": c for f, c in cube.fields().items()})
        by = [c for c in df.columns if c.startswith("f_")]
        return df.groupBy(*by, *[F.col(k).alias(f"k_{k}") for k in cube.keys]).agg(
            rows().alias("n"), *[F.sum(c).alias(c) for c in cube.sums], *[F.max(c).alias(c) for c in cube.greatest],
            *[F.count_distinct(c).alias(alias) for c, alias in cube.distinct.items()],
        )

    return v._keep(f"cube_{name}", build)


def in_slice(df: DataFrame, filters: dict) -> Column:
    """Whether a cell belongs to the slice; a filter on a field that the cells do not carry leaves them all."""
    out = F.lit(True)
    for name, value in filters.items():
        column = f"f_{name}"
        if column not in df.columns or value is None or (name == "scale_flag" and value != "exclude"):
            continue
        out = out & (~F.col(column) if name == "scale_flag" else F.coalesce(F.col(column) == value, F.lit(False)))
    return out


# ------------------------------------------------------------------ one aggregate per measure
class _On:
    """Aggregates over the cells of a slice, with the names of the row-level ones."""

    def __init__(self, here: Column):
        self.here = here

    def _when(self, c: Column, where: Column | None = None) -> Column:
        return F.when(self.here if where is None else self.here & F.coalesce(where, F.lit(False)), c)

    def count(self, where: Column | None = None) -> Column:
        return F.coalesce(F.sum(self._when(F.col("n"), where)), F.lit(0))

    def sum(self, c: str) -> Column:
        return F.sum(self._when(F.col(c)))

    def rate(self, condition: Column, where: Column | None = None) -> Column:
        known = condition.isNotNull() if where is None else where & condition.isNotNull()
        return F.try_divide(dbl(self.count(condition if where is None else where & condition)), dbl(self.count(known)))

    def percentile(self, c: Column, p: float, where: Column | None = None) -> Column:
        """Of a column with a bounded domain: the cells are its histogram."""
        return F.percentile(self._when(c, where), p, F.col("n"))


def key(name: str) -> Column:
    return F.col(f"k_{name}")


def _reaching(on: _On, k) -> Column:
    return on.count(key("highest_stage_rank") >= k)


def _primary() -> Column:
    return key(PRIMARY)


def _tenderers() -> Column:
    return key("number_of_tenderers")


DAYS = {"durations": "tender_duration_days", "lags": "award_lag_days", "signatures": "signature_lag_days"}
TIMED = {"durations": "tender_duration", "lags": "award_lag", "signatures": "signature_lag"}


def _numbers(n: int) -> list[Column]:
    """Bands by number instead of by label."""
    return [F.lit(i) for i in range(1, n + 1)]


# name -> (cube, aggregate of the slice and the parameters)
Aggregate = Callable[[_On, dict], Column]
READ: dict[str, tuple[str, Aggregate]] = {
    "processes": ("stages", lambda on, p: on.count()),
    "planning_only_share": ("stages", lambda on, p: on.rate(key("highest_stage_rank") == 1)),
    "processes_reaching_stage": ("stages", lambda on, p: _reaching(on, p["stage"])),
    "stage_conversion_rate": ("stages", lambda on, p: ratio(_reaching(on, p["stage"]), _reaching(on, p["stage"] - 1))),
    "planned_budget": ("budgets", lambda on, p: on.sum(BUDGET)),
    "budget_lines": ("budgets", lambda on, p: on.count()),
    "award_value": ("awards", lambda on, p: on.sum(AWARD)),
    "eligible_awards": ("awards", lambda on, p: on.count()),
    "supplier_awards": ("supplied", lambda on, p: F.coalesce(on.sum("awards"), F.lit(0))),
    "supplier_value": ("supplied", lambda on, p: on.sum(AWARD)),
    "competition_n_primary": ("bidders", lambda on, p: on.count(_primary())),
    "competition_n_sensitivity": ("bidders", lambda on, p: on.count()),
    "median_tenderers_primary": ("bidders", lambda on, p: on.percentile(_tenderers(), 0.5, _primary())),
    "median_tenderers_sensitivity": ("bidders", lambda on, p: on.percentile(_tenderers(), 0.5)),
    "single_bidder_rate_primary": ("bidders", lambda on, p: on.rate(key("is_single_bidder"), _primary())),
    "single_bidder_rate_sensitivity": ("bidders", lambda on, p: on.rate(key("is_single_bidder"))),
    "tenders_in_band": ("bidders", lambda on, p: on.count(
        (bands.participation_band(_tenderers(), _numbers(8)) == p["band"]) & (_primary() if p.get("population", "primary") == "primary" else ~_primary()))),
    "comparable_processes": ("compared", lambda on, p: on.count()),
    "comparable_budget": ("compared", lambda on, p: on.sum(BUDGET)),
    "comparable_award": ("compared", lambda on, p: on.sum(AWARD)),
    "net_variance": ("compared", lambda on, p: on.sum("variance_amount")),
    "aggregate_ratio": ("compared", lambda on, p: ratio(on.sum(AWARD), on.sum(BUDGET))),
    "share_within_10pct": ("compared", lambda on, p: on.rate(key(RATIO).between(0.9, 1.1))),
    "small_budgets": ("compared_budgets", lambda on, p: on.count(key(BUDGET) < p.get("limit", 100000))),
    "comparable_in_band": ("compared", lambda on, p: on.count(bands.ratio_band(key(RATIO), _numbers(6)) == p["band"])),
    "award_lag_over_year_share": ("lags", lambda on, p: on.rate(key("award_lag_days") > 365)),
    **{f"{TIMED[c]}_n": (c, lambda on, p: on.count()) for c in DAYS},
    **{f"median_{TIMED[c]}": (c, lambda on, p, d=d: on.percentile(key(d), 0.5)) for c, d in DAYS.items()},
    **{f"p90_{TIMED[c]}": (c, lambda on, p, d=d: on.percentile(key(d), 0.9)) for c, d in DAYS.items()},
    "contracts": ("contracts", lambda on, p: on.count()),
    "contracts_with_implementation": ("contracts", lambda on, p: on.count(key("has_implementation"))),
    "implementation_coverage_rate": ("contracts", lambda on, p: on.rate(key("has_implementation"))),
    "contracts_of_type": ("contracts", lambda on, p: on.count(
        bands.implementation_type(key("transaction_count"), key("implementation_milestone_count"), _numbers(4)) == p["band"])),
}


def _timing_in_band(p: dict) -> tuple[str, Aggregate]:
    cube = next(c for c, name in TIMED.items() if name == p["interval"])
    return cube, lambda on, p: on.count(bands.duration_band(key(DAYS[cube]), _numbers(6)) == p["band"])


# Measures of whole distributions: name -> (cube, key). Exact, whatever the domain.
MEDIANS = {"median_award_value": ("awards", AWARD), "median_ratio": ("compared", RATIO)}
# Measures of the totals of each supplier in the slice.
OF_HOLDERS = ("suppliers", "supplier_hhi", "suppliers_with_one_award", "top_supplier_share")
# Differences of two cubes in the same slice: name -> (minuend, subtrahend, as a share of the minuend).
DIFFERENCES = {
    "excluded_awards": ("eligible_awards", "supplier_awards", False),
    "excluded_value": ("award_value", "supplier_value", False),
    "excluded_value_share": ("award_value", "supplier_value", True),
}
# Views that are reduced to entities or metrics already are their own cubes.
OF_ENTITIES = [name for name, (view, _) in SIMPLE.items() if view in ("entity_benchmark", "metric_population", "dq_impact")]

MEASURES = [*READ, "timing_in_band", *MEDIANS, *OF_HOLDERS, *DIFFERENCES, *OF_ENTITIES, "top_entity_share"]
Calls = dict[str, tuple[str, dict, dict]]


def _sliced(df: DataFrame, calls: Calls) -> DataFrame:
    """Each cell once for every call whose slice it is in: one scan for all of them."""
    hits = [F.when(in_slice(df, f), F.lit(label)) for label, (_, f, _) in calls.items()]
    return df.withColumn("label", F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())))


def _aggregated(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    one = df.agg(*[dbl(c).alias(f"v{i}") for i, c in enumerate(columns.values())])
    pairs = [F.struct(F.lit(x).alias("label"), F.col(f"v{i}").alias("value")) for i, x in enumerate(columns)]
    return one.select(F.inline(F.array(*pairs)))


def _of_holders(v, calls: Calls) -> DataFrame:
    totals = _sliced(cells(v, "holders"), calls).groupBy("label", F.col("k_supplier_id").alias("supplier_id")).agg(
        F.sum("n").alias("awards"), F.sum(AWARD).alias("value"))
    each = totals.groupBy("label").agg(
        dbl(rows()).alias("suppliers"), hhi(F.col("value")).alias("supplier_hhi"),
        dbl(F.count_if(F.col("awards") == 1)).alias("suppliers_with_one_award"))
    kinds = F.create_map(*[F.lit(x) for label, (name, _, _) in calls.items() for x in (label, name)])
    chosen = F.coalesce(*[F.when(kinds[F.col("label")] == c, F.col(c)) for c in OF_HOLDERS[:3]])
    out = each.select("label", chosen.alias("value"))
    tops = {label: p["n"] for label, (name, _, p) in calls.items() if name == "top_supplier_share"}
    if not tops:
        return out
    out = out.filter(~F.col("label").isin(*tops))
    return out.unionByName(top_shares_with_ties(totals.filter(F.col("label").isin(*tops)), "label", tops))


def _labelled(df: DataFrame, calls: Calls) -> DataFrame:
    """A row for every call: an empty slice has no cells and gives null, or 0 where a count is asked for."""
    zero = [label for label, (name, _, _) in calls.items() if name in ("suppliers", "suppliers_with_one_award")]
    every = F.explode(F.array(*[F.lit(x) for x in calls])).alias("label")
    names = df.sparkSession.range(1).select(every)
    value = F.when(F.col("value").isNull() & F.col("label").isin(*zero), F.lit(0.0)).otherwise(F.col("value"))
    return names.join(df, "label", "left").select("label", value.alias("value"))


def measure_table(v, calls: Calls) -> DataFrame:
    """(label, value) of many calls label -> (measure, filters, parameters)."""
    by_cube: dict[str, dict[str, Column]] = {}
    later: dict[str, Calls] = {}
    differences: dict[str, tuple[str, str, bool]] = {}
    for label, (name, filters, p) in list(calls.items()):
        if name in DIFFERENCES:
            whole, part, share = DIFFERENCES[name]
            differences[label] = (f"{label}\x1fwhole", f"{label}\x1fpart", share)
            asked = {differences[label][0]: (whole, filters, p), differences[label][1]: (part, filters, p)}
        else:
            asked = {label: (name, filters, p)}
        for tag, (one, f, q) in asked.items():
            if one in READ or one == "timing_in_band":
                cube, aggregate = READ[one] if one in READ else _timing_in_band(q)
                by_cube.setdefault(cube, {})[tag] = aggregate(_On(in_slice(cells(v, cube), f)), q)
            elif one in MEDIANS:
                later.setdefault(one, {})[tag] = (one, f, q)
            elif one in OF_HOLDERS:
                later.setdefault("holders", {})[tag] = (one, f, q)
            else:
                later.setdefault("entities", {})[tag] = (one, f, q)
    parts = [_aggregated(cells(v, cube), columns) for cube, columns in by_cube.items()]
    for kind, asked in later.items():
        if kind == "holders":
            parts.append(_labelled(_of_holders(v, asked), asked))
        elif kind == "entities":
            parts += _of_entities(v, asked)
        else:
            cube, value = MEDIANS[kind]
            found = exact_percentiles(_sliced(cells(v, cube), asked), f"k_{value}", {"value": 0.5}, ["label"], weight="n")
            parts.append(_labelled(found, asked))
    out = union(parts)
    if not differences:
        return out
    # The two sides meet by their label; a call on its own keeps its value.
    sides = F.split("label", "\x1f", -1)
    both = out.groupBy(sides[0].alias("label")).agg(*[
        F.max(F.when(F.coalesce(F.get(sides, F.lit(1)), F.lit("")) == side, F.col("value"))).alias(side or "own") for side in ("", "whole", "part")])
    shares = [label for label, (_, _, share) in differences.items() if share]
    rest = F.col("whole") - F.col("part")
    value = F.when(F.col("label").isin(*shares), F.try_divide(rest, F.col("whole"))).when(
        F.col("label").isin(*differences), rest).otherwise(F.col("own"))
    return both.select("label", value.alias("value"))


def _of_entities(v, calls: Calls) -> list[DataFrame]:
    parts, shared = [], {}
    tops: dict = {}
    for label, (name, f, p) in calls.items():
        if name == "top_entity_share":
            tops[label] = (name, f, p)
            continue
        view, aggregate = SIMPLE[name]
        slice_ = tuple(sorted(f.items())) if view == "entity_benchmark" else ()
        shared.setdefault((view, slice_), {})[label] = aggregate(p)
    for (view, f), columns in shared.items():
        df = getattr(v, view)
        parts.append(_aggregated(df.filter(F.col("buyer_id") == dict(f)["buyer"]) if dict(f).get("buyer") else df, columns))
    if tops:
        zero = F.lit(0).cast("decimal(38,4)")
        e = v.entity_benchmark.select(F.col("buyer_id").alias("f_buyer"), F.coalesce("award_value_total", zero).alias("value"))
        found = top_shares_with_ties(_sliced(e, tops), "label", {label: p["n"] for label, (_, _, p) in tops.items()})
        parts.append(_labelled(found, tops))
    return parts


def measure(v, name: str, filters: dict | None = None, **params) -> DataFrame:
    """One row, one ``value`` (double)."""
    return measure_table(v, {"_": (name, filters or {}, params)}).select("value")


# ------------------------------------------------------------------ tables under filters
def _slice(v, cube: str, filters: dict) -> DataFrame:
    df = cells(v, cube)
    return df.filter(in_slice(df, filters))


def _holder_cells(v, filters: dict) -> DataFrame:
    return _slice(v, "holders", filters).withColumnsRenamed(
        {"k_supplier_id": "supplier_id", "f_buyer": "buyer_id", "f_method": "procurement_method"})


def _holder_totals(df: DataFrame, *groups: str) -> DataFrame:
    return df.groupBy(*groups, "supplier_id").agg(F.sum("n").alias("awards"), F.sum(AWARD).alias("value"))


def top_suppliers(v, filters: dict, n: int = 20) -> DataFrame:
    own = _holder_cells(v, filters)
    return questions_supply.largest_suppliers(v, _holder_totals(own), own, n)


def share_by_method(v, filters: dict, n: int = 5) -> DataFrame:
    g = ["procurement_method"]
    c = concentration(_holder_totals(_holder_cells(v, filters), *g), "supplier_id", [1, n], groups=g)
    return questions_supply.method_concentration(v, c, n)


def net_differences(v, filters: dict, n: int = 5, min_n: int = 10) -> DataFrame:
    """The largest positive and the largest negative net differences of entities."""
    own = _slice(v, "compared", filters).filter(F.col("buyer_id_flag").isNull())
    e = own.groupBy(F.col("f_buyer").alias("buyer_id")).agg(
        F.max("buyer_name").alias("buyer_name"), F.sum("n").alias("processes"), F.sum("variance_amount").alias("net"),
    ).filter((F.col("processes") >= min_n) & (F.col("net") != 0))
    side = F.when(F.col("net") > 0, "above").otherwise("below")
    w = Window.partitionBy("side").orderBy(F.abs("net").desc(), "buyer_id")
    return e.withColumn("side", side).withColumn("position", F.row_number().over(w)).filter(F.col("position") <= n)


def timing_by_year(v, filters: dict) -> DataFrame:
    def by_year(cube: str, year: str) -> DataFrame:
        name = TIMED[cube]
        return _slice(v, cube, filters).groupBy(F.col(f"f_{year}").alias("year")).agg(
            F.sum("n").alias(f"{name}_n"), F.percentile(key(DAYS[cube]), 0.5, F.col("n")).alias(f"median_{name}"))

    return by_year("durations", "tender_start_year").join(by_year("lags", "award_year"), "year", "full")


def disclosure(v, filters: dict) -> DataFrame:
    """Excluded awards and value under a filter, with the sentence to show beside them."""
    cand = _slice(v, "awards", filters).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum(AWARD).alias("value"))
    kept = _slice(v, "supplied", filters).agg(F.coalesce(F.sum("awards"), F.lit(0)).alias("eligible_awards"), F.sum(AWARD).alias("value"))
    holders = _holder_cells(v, filters).select("supplier_id").distinct().agg(rows()).scalar()
    return questions_supply.with_disclosure(questions_supply.disclosed(v, cand, kept, holders))


__all__ = ["CUBES", "MEASURES", "cells", "disclosure", "measure", "measure_table", "net_differences", "share_by_method",
           "timing_by_year", "top_suppliers"]
