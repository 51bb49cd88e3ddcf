"""Concentration of a value over its holders: top-N shares, Herfindahl index, depth to share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlens.operators.order_stats import depth_to_share, top_rows


def holder_totals(df: DataFrame, holder: str, value: str, groups: tuple | list = ()) -> DataFrame:
    return df.groupBy(*groups, holder).agg(
        F.count(F.lit(1)).alias("awards"), F.sum(value).alias("value")
    )


def hhi(value: Column) -> Column:
    """Herfindahl index 0 to 10,000 as one aggregate (no per-row share needed)."""
    x = value.cast("double")
    return F.try_divide(F.sum(x * x) * 10000, F.sum(x) * F.sum(x))


def _join(left: DataFrame, right: DataFrame, groups) -> DataFrame:
    if groups:
        return left.join(right, list(groups), "left")
    # Both sides are one-row aggregates: the right one is read as one scalar subquery.
    row = right.select(F.struct(*right.columns).alias("_r")).scalar()
    return left.withColumn("_r", row).select(*left.columns, *[F.col(f"_r.{c}").alias(c) for c in right.columns])


def concentration(
    totals: DataFrame,
    holder: str,
    top: list[int],
    depths: dict[str, str] | None = None,
    groups: tuple | list = (),
    value: str = "value",
) -> DataFrame:
    """Per group: holders, awards, value, hhi, holders with one award, value of
    the strict top-N (ties broken by id), and optional depths."""
    agg = (totals.groupBy(*groups) if groups else totals.groupBy()).agg(
        F.count(F.lit(1)).alias("holders"),
        F.sum("awards").alias("awards"),
        F.sum(value).alias("value"),
        F.count(F.when(F.col("awards") == 1, 1)).alias("single_award_holders"),
        hhi(F.col(value)).alias("hhi"),
    )
    best = top_rows(totals, [(value, "desc"), (holder, "asc")], max(top), groups)
    tops = (best.groupBy(*groups) if groups else best.groupBy()).agg(
        *[F.sum(F.when(F.col("position") <= n, F.col(value))).alias(f"top_{n}") for n in top]
    )
    out = _join(agg, tops, groups)
    if depths:
        out = _join(out, depth_to_share(totals, value, depths, groups), groups)
    return out


def top_share_with_ties(totals: DataFrame, n: int, value: str = "value") -> DataFrame:
    """Share of the n largest values, every value tied with the n-th included."""
    v = F.col(value)
    cut = totals.orderBy(v.desc()).limit(n).agg(F.min(value)).scalar()
    return totals.agg(
        F.try_divide(
            F.sum(F.when(v >= cut, v)).cast("double"), F.sum(v).cast("double")
        ).alias("share")
    )


def top_shares_with_ties(totals: DataFrame, label: str, tops: dict[str, int], value: str = "value") -> DataFrame:
    """(label, value): for each label its own n, as ``top_share_with_ties``. Each task ships the largest n rows of a label."""
    n = F.create_map(*[F.lit(x) for item in tops.items() for x in item])[F.col(label)]
    best = top_rows(totals.select(label, value), [(value, "desc")], max(tops.values()), [label])
    cut = best.filter(F.col("position") <= n).groupBy(label).agg(F.min(value).alias("_cut"))
    v = F.col(value)
    return totals.join(cut, label).groupBy(label).agg(
        F.try_divide(F.sum(F.when(v >= F.col("_cut"), v)).cast("double"), F.sum(v).cast("double")).alias("value")
    )


def share_pct(part: Column, whole: Column, places: int) -> Column:
    return F.round(F.try_divide(part.cast("double") * 100, whole.cast("double")), places)
