"""Small column helpers shared by the result sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlens.rules import Rules



def rows() -> Column:
    return F.count(F.lit(1))


def dbl(c: Column) -> Column:
    return c.cast("double")


def pct(part: Column, whole: Column, places: int) -> Column:
    return F.round(F.try_divide(dbl(part) * 100, dbl(whole)), places)


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(dbl(a), dbl(b))


def money(c: Column, r: Rules, places: int) -> Column:
    return F.round(dbl(c) / r.unit, places)


def sum_if(where: Column, c: Column) -> Column:
    return F.sum(F.when(where, c))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def with_totals(df: DataFrame, **totals: Column) -> DataFrame:
    """Attach whole-table aggregates as scalar subqueries: no join, no one-task window."""
    one = df.agg(*[c.alias(n) for n, c in totals.items()])
    return df.withColumns({n: one.select(n).scalar() for n in totals})


def mark(df: DataFrame, keys: DataFrame, key: str, name: str) -> DataFrame:
    """Existence marker: every row is kept, ``name`` says whether its key occurs in ``keys``."""
    known = keys.select(key).distinct().withColumn("_hit", F.lit(True))
    return df.join(known, key, "left").withColumn(name, F.col("_hit").isNotNull()).drop("_hit")
