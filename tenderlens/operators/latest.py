"""Latest-per-key, modal value, and the independent formulations used to cross-check them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the greatest ``order`` per key. ``row_number() = 1`` is
    planned with a window group limit, so each map task ships at most one row
    per key: a hot key never reaches the shuffle whole."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def latest_by_max(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Cross-check: rows whose order value equals the key's maximum (no later row exists)."""
    latest = df.groupBy(*keys).agg(F.max(order).alias("_latest"))
    cond = [F.col(f"d.{k}").eqNullSafe(F.col(f"m.{k}")) for k in keys]
    joined = df.alias("d").join(latest.alias("m"), cond)
    return joined.filter(F.col(f"d.{order}") == F.col("m._latest")).select("d.*")


def modal_value(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Most frequent non-null value per key; ties go to the latest."""
    freq = df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(
        F.count(F.lit(1)).alias("n"), F.max(order).alias("latest")
    )
    return freq.groupBy(key).agg(F.max_by(value, F.struct("n", "latest", value)).alias(value))


def text_order_disagrees(df: DataFrame, key: str, identifier: str, order: str) -> DataFrame:
    """Keys with several rows where the greatest text id is not the latest id."""
    return (
        df.groupBy(key)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.max(identifier).alias("latest_by_text"),
            F.max_by(identifier, order).alias("latest_by_order"),
        )
        .filter((F.col("n") > 1) & (F.col("latest_by_text") != F.col("latest_by_order")))
    )
