"""Inequality join within a group: pairs whose values differ by a factor, without a nested loop."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows of one octave that a single task should compare with.
CHUNK = 50_000


def pairs_apart(df: DataFrame, groups: list[str], key: str, value: str, factor: float) -> DataFrame:
    """(groups, key, value, other_key, other_value): pairs of rows of a group with value >= factor x other_value.

    A band join on octaves. floor(log2) of the two values can differ by no less than
    that of the factor, so a row is joined by equality with the octaves of its group that lie
    at least so far below its own; the inequality decides what is left. All but the nearest two of
    these octaves hold matches only, so the work follows the result. An octave of many
    rows is dealt in chunks, each met by its own copy of the larger rows, so one group
    that holds a third of all rows is many tasks.

    ``factor`` is above one. Groups, keys and values that are null, and values that are
    not positive, have no pairs; a row has none with its own key. Equal keys are different rows.
    """
    if factor <= 1:
        raise ValueError("the factor must exceed one")
    rows = df.select(*groups, key, value).filter((F.col(value) > 0) & F.col(key).isNotNull())
    for g in groups:
        rows = rows.filter(F.col(g).isNotNull())
    rows = rows.withColumn("_o", F.floor(F.log2(F.col(value).cast("double"))).cast("int"))
    octaves = rows.groupBy(*groups, "_o").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("_n"))
    held = octaves.groupBy(*groups).agg(F.collect_list(F.struct("_o", "_n")).alias("_held"))  # some hundred octaves at most
    # One less than the factor's octave: the logarithm of a double may land on either side of a power of two.
    step = math.floor(math.log2(factor)) - 1
    below = F.filter("_held", lambda h: h["_o"] <= F.col("_o") - step)
    cells = F.flatten(F.transform(below, lambda h: F.transform(
        F.sequence(F.lit(0), h["_n"] - 1), lambda c: F.struct(h["_o"].alias("_o"), c.alias("_c")))))
    larger = rows.join(held, groups).select(*groups, key, value, F.explode(cells).alias("_cell")).select(
        *groups, key, value, F.col("_cell._o").alias("_o"), F.col("_cell._c").alias("_c"))
    chunks = octaves.filter("_n > 1")
    smaller = rows.join(chunks, [*groups, "_o"], "left").select(
        *groups, F.col(key).alias(f"other_{key}"), F.col(value).alias(f"other_{value}"), "_o",
        F.pmod(F.xxhash64(key, value), F.coalesce("_n", F.lit(1))).cast("int").alias("_c"))
    far = (F.col(value) >= F.col(f"other_{value}") * factor) & (F.col(key) != F.col(f"other_{key}"))
    return larger.join(smaller, [*groups, "_o", "_c"]).filter(far).drop("_o", "_c")
