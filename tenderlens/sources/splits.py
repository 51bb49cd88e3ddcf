"""Text files cut into records by many tasks, and running sums across the cuts.

Spark's text reader gives every task a share of a file. What a record means may
depend on all that lies in front of it in the file (its offset, how deep it is
nested), so sums run in two steps: inside each share, and over the shares, of which a
file has few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F


def records(spark: SparkSession, path: str, pattern: str = "*", separator: str = "\n", of: Column | None = None) -> DataFrame:
    """(file, bytes, block, nth, value, length): what lies between separators.

    ``block`` is where the share of the file begins that a task reads, ``nth`` ascends
    with the place in it, ``length`` counts bytes, ``bytes`` are the file's. ``of`` is a condition on
    ``_metadata``: files that do not meet it are not opened.
    """
    text = spark.read.option("lineSep", separator).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).text(path)
    return (text if of is None else text.filter(of)).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth"),
        "value", F.octet_length("value").cast("bigint").alias("length"),
    )


IN_FRONT = (Window.unboundedPreceding, -1)


def in_block() -> WindowSpec:
    """A block's records in order; a block is some hundred megabytes of one file."""
    return Window.partitionBy("file", "block").orderBy("nth")


def over_blocks() -> WindowSpec:
    return Window.partitionBy("file").orderBy("block")


def sum_in_front(c: Column | str, window: WindowSpec) -> Column:
    return F.coalesce(F.sum(c).over(window.rowsBetween(*IN_FRONT)), F.lit(0))


def last_in_front(c: Column | str, window: WindowSpec) -> Column:
    return F.last(c, ignorenulls=True).over(window.rowsBetween(*IN_FRONT))
