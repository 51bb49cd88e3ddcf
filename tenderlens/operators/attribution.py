"""Exclusion attribution: which rule removed which candidate, reconciling exactly.

Every candidate carries the array of issues it trips. One explode and one
small-output aggregate give all counts of all metrics in a single scan:
``ALL`` (every candidate), one row per issue, ``OTHER`` and ``PRE`` (records
removed before the candidate population is defined).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Population:
    """Candidates of one metric and the predicates that exclude them.

    Populations given the same ``candidates`` object share its scan and joins;
    ``present`` says which of its rows are candidates of this metric.
    """

    metric_id: str
    candidates: DataFrame
    issues: dict[str, Column]
    other: Column = field(default_factory=lambda: F.lit(False))
    pre_exclude: Column = field(default_factory=lambda: F.lit(False))
    value: Column | None = None
    present: Column = field(default_factory=lambda: F.lit(True))


def candidate_records(populations: list[Population]) -> DataFrame:
    money = "decimal(30,4)"

    def record(p: Population) -> Column:
        tripped = F.array_compact(F.array(*[F.when(c, F.lit(ref)) for ref, c in p.issues.items()]))
        value = p.value if p.value is not None else F.lit(None)
        row = F.struct(
            F.lit(p.metric_id).alias("metric_id"),
            value.cast(money).alias("val"),
            tripped.cast("array<string>").alias("issues"),
            F.coalesce(p.other, F.lit(False)).alias("other_reason"),
            F.coalesce(p.pre_exclude, F.lit(False)).alias("is_pre"),
        )
        return F.when(p.present, row)

    by_frame: dict[int, list[Population]] = {}
    for p in populations:
        by_frame.setdefault(id(p.candidates), []).append(p)
    parts = [
        same[0].candidates.select(F.inline(F.array_compact(F.array(*[record(p) for p in same]))))
        for same in by_frame.values()
    ]
    return reduce(DataFrame.unionByName, parts)


def exclusion_attribution(populations: list[Population]) -> DataFrame:
    """(metric_id, dq_ref, candidate_records, records_with_issue,
    records_lost_only_to_issue, affected_value) with dq_ref in issue codes,
    ``OTHER``, ``ALL`` and ``PRE``."""
    rec = candidate_records(populations)
    n = F.size("issues")
    refs = F.when(F.col("is_pre"), F.array(F.lit("PRE"))).otherwise(
        F.concat(
            F.array(F.lit("ALL")),
            F.col("issues"),
            F.when(F.col("other_reason"), F.array(F.lit("OTHER"))).otherwise(F.array().cast("array<string>")),
        )
    )
    other, excluded = F.col("other_reason"), (n > 0) | F.col("other_reason")
    tagged = rec.select(
        "metric_id",
        "val",
        excluded.alias("excluded"),
        ((n == 1) & ~other).alias("only_issue"),
        ((n == 0) & other).alias("only_other"),
        F.explode(refs).alias("dq_ref"),
    )
    val, is_all = F.col("val"), F.col("dq_ref") == "ALL"
    counted = tagged.groupBy("metric_id", "dq_ref").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.when(is_all, F.col("excluded")).otherwise(True)).alias("hit"),
        F.count_if("only_issue").alias("only_issue"),
        F.count_if("only_other").alias("only_other"),
        F.sum(F.when(~is_all | F.col("excluded"), val)).alias("affected_value"),
    )
    # At most (metrics x issues) rows from here on.
    w = Window.partitionBy("metric_id")
    return counted.select(
        "metric_id",
        "dq_ref",
        F.max(F.when(is_all, F.col("n"))).over(w).alias("candidate_records"),
        F.col("hit").alias("records_with_issue"),
        F.when(F.col("dq_ref") == "OTHER", F.col("only_other"))
        .when(~F.col("dq_ref").isin("ALL", "PRE"), F.col("only_issue"))
        .alias("records_lost_only_to_issue"),
        "affected_value",
    )
