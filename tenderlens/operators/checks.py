"""Assertion rows: expected against actual, as one DataFrame per suite.

A probe is one aggregate over one table; it may feed many checks, so a suite
scans each table once. A check with a known expectation is a GATE, one
without is INFO (``passed`` is NULL).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlens.plans.common import union


@dataclass(frozen=True)
class Check:
    check_id: str
    name: str
    actual: Column
    expected: Column | str | None = None
    severity: str | None = None


def text(c: Column) -> Column:
    return c.cast("string")


def probe(df: DataFrame, checks: list[Check]) -> DataFrame:
    """``actual`` columns are aggregates over ``df``; ``expected`` is a text,
    an aggregate over ``df``, or a scalar subquery over another table."""
    one = df.agg(*[text(c.actual).alias(f"a{i}") for i, c in enumerate(checks)])
    expected = {
        f"e{i}": F.lit(c.expected).cast("string") if c.expected is None or isinstance(c.expected, str) else text(c.expected)
        for i, c in enumerate(checks)
    }
    rows = [
        F.struct(
            F.lit(c.check_id).alias("check_id"),
            F.lit(c.name).alias("check_name"),
            F.lit(c.severity or ("GATE" if c.expected is not None else "INFO")).alias("severity"),
            F.col(f"e{i}").alias("expected"),
            F.col(f"a{i}").alias("actual"),
        )
        for i, c in enumerate(checks)
    ]
    return one.withColumns(expected).select(F.inline(F.array(*rows)))


def suite(group: str, probes: list[DataFrame]) -> DataFrame:
    passed = F.when(F.col("severity") == "GATE", F.coalesce(F.col("expected") == F.col("actual"), F.lit(False)))
    return union(probes).select(
        "check_id", F.lit(group).alias("check_group"), "check_name", "severity", "expected", "actual",
        passed.alias("passed"),
    )


def failures(checks: DataFrame) -> DataFrame:
    """GATE rows that are not true: a run with any of these must stop."""
    return checks.filter((F.col("severity") == "GATE") & ~F.coalesce("passed", F.lit(False)))


def count(df: DataFrame) -> Column:
    return df.agg(F.count(F.lit(1))).scalar()


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str | None = None) -> DataFrame:
    keys = parent.select(F.col(parent_key or key).alias(key))
    return child.select(key).join(keys, key, "left_anti")


def repeats(keys: list[str]) -> Column:
    """Rows minus distinct keys; a composite key counts NULL parts as values."""
    key = F.col(keys[0]) if len(keys) == 1 else F.struct(*keys)
    return F.count(F.lit(1)) - F.count_distinct(key)


def compare_figures(expected: DataFrame, actual: DataFrame, key: str, value: str, places: dict[str, int]) -> DataFrame:
    """Full outer comparison; each unit has its own displayed precision."""
    unit = F.coalesce(F.col("e.unit"), F.col("a.unit"))
    to = F.create_map(*[F.lit(x) for kv in places.items() for x in kv])[unit]

    def shown(c):
        scale = F.pow(F.lit(10.0), to)
        return F.round(c.cast("double") * scale) / scale

    e, a = F.col(f"e.{value}"), F.col(f"a.{value}")
    joined = expected.alias("e").join(actual.alias("a"), F.col(f"e.{key}") == F.col(f"a.{key}"), "full")
    same = F.when(to.isNull(), e.cast("double") == a.cast("double")).otherwise(F.abs(shown(e) - shown(a)) < 1e-6)
    return joined.select(
        F.coalesce(F.col(f"e.{key}"), F.col(f"a.{key}")).alias(key),
        unit.alias("unit"),
        e.cast("double").alias("expected"),
        a.cast("double").alias("actual"),
        (F.coalesce(same, F.lit(False)) | (e.isNull() & a.isNull())).alias("matches"),
    )


def cells(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """A result set as (set, row, column, value) rows."""
    rest = [c for c in df.columns if c not in keys]
    row = F.concat_ws("|", *[F.col(c).cast("string") for c in keys]) if keys else F.lit("")
    return df.select(row.alias("row_key"), *[F.col(c).cast("string").alias(c) for c in rest]).unpivot(
        ["row_key"], rest, "column_name", "value"
    ).withColumn("result_set", F.lit(name))


def compare_cells(left: DataFrame, right: DataFrame) -> DataFrame:
    on = ["result_set", "row_key", "column_name"]
    j = left.withColumnRenamed("value", "left_value").join(right.withColumnRenamed("value", "right_value"), on, "full")
    return j.withColumn("matches", F.col("left_value").eqNullSafe(F.col("right_value")))


def numeric_cells(stored: DataFrame, keys: Column) -> DataFrame:
    """The numbers of stored sets (result_set, row_json) as (result_set, row_key, column_name, cell) rows.

    ``keys`` is a map from a set to the columns that tell its rows apart; other text is left out.
    """
    own = F.coalesce(keys[F.col("result_set")], F.array().cast("array<string>"))
    rows = stored.select("result_set", F.from_json("row_json", "map<string,string>").alias("row"), own.alias("keys"))
    row_key = F.array_join(F.transform("keys", lambda k: F.col("row")[k]), "|")
    long = rows.select("result_set", "keys", row_key.alias("row_key"), F.explode("row").alias("column_name", "value"))
    return long.filter(~F.array_contains("keys", F.col("column_name"))).select(
        "result_set", "row_key", "column_name", F.col("value").try_cast("decimal(38,8)").alias("cell")).filter(F.col("cell").isNotNull())


def trace_claims(claims: DataFrame, cells_: DataFrame) -> DataFrame:
    """Each claim (result_set, row_key, column_name, places, stated, eligible_n) against the one cell it cites.

    A claim holds if its selector finds exactly one cell, the stated figure is that cell rounded
    half up to the stated places (the cell lies in the rounding interval of the figure, in decimals), and it
    says how many records it rests on.
    """
    on = ["result_set", "row_key", "column_name"]
    found = cells_.groupBy(*on).agg(F.count(F.lit(1)).alias("_found"), F.max("cell").alias("cell"))
    step = F.create_map(*[x for p in range(9) for x in (F.lit(p), F.lit(f"1E-{p}").cast("decimal(9,8)"))])[F.col("places").cast("int")]
    off = (F.abs("cell") - F.abs("stated")).cast("decimal(38,8)")
    inside = (off * 2 >= -step) & (off * 2 < step) & ((F.signum("cell") == F.signum("stated")) | (F.col("stated") == 0))
    holds = (F.col("_found") == 1) & inside & (F.col("eligible_n") > 0)
    return claims.join(found, on, "left").withColumn("holds", F.coalesce(holds, F.lit(False))).drop("_found")
