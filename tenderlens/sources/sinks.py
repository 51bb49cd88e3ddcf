"""Table sets written to shared storage, file manifests and integrity gates."""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderlens.sources import splits



def replace_tables(tables: dict[str, DataFrame], root: str) -> str:
    """Replace a whole set of tables in one step.

    Every table is written to a new run folder; the set becomes current only
    when one row is appended to the run log, after the last write succeeded.
    A failed or killed run leaves the previous set current.
    """
    spark = next(iter(tables.values())).sparkSession
    run = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{root}/run={run}/{name}")
    log = spark.createDataFrame([(time.time_ns(), run)], "published_at bigint, run string")
    log.coalesce(1).write.mode("append").parquet(f"{root}/_runs")
    return run


def current_run(spark: SparkSession, root: str) -> str:
    latest = spark.read.parquet(f"{root}/_runs").agg(F.max_by("run", "published_at").alias("run"))
    return latest.first()["run"]


def read_current(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/run={current_run(spark, root)}/{name}")


def store_result_sets(result_sets: dict[str, DataFrame], root: str) -> str:
    """Each named result set as JSON rows in its own partition; a few jobs at a time."""

    def one(item: tuple[str, DataFrame]) -> None:
        name, df = item
        df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("row_json")).write.mode("overwrite").parquet(
            f"{root}/result_set={name}"
        )

    with ThreadPoolExecutor(max_workers=4) as pool:
        list(pool.map(one, result_sets.items()))
    return root


RANGE_BYTES = 4 << 20


def write_lines(lines: DataFrame, path: str, file: str = "file", order: tuple = ("place",)) -> str:
    """Text files of stable content: column ``line`` of the rows of a ``file`` in order, in the folder file=<value>."""
    n = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = lines.repartition(n, file).sortWithinPartitions(file, *order).select(F.col(file).alias("file"), "line")
    ordered.write.partitionBy("file").option("lineSep", "\n").text(path)
    return path


def file_manifest(spark: SparkSession, path: str, pattern: str = "*", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(file, rows, bytes, digest) of every file under ``path``; file is its path below it.

    The digest is a tree, so a file of any size is read by many tasks and no content
    is shuffled: SHA-256 of each record (what lies between line feeds), of each range's record digests in
    order, and of the file's length and range digests in order. A range holds the records that begin in
    ``range_bytes`` of the file, so how Spark splits the file does not matter. ``rows`` counts
    records. Compressed text is read as its content. Spark's readers skip empty files, so these are in no manifest.
    """
    records = splits.records(spark, path, pattern).select(
        "file", "bytes", "block", "nth", (F.col("length") + 1).alias("size"), F.sha2(F.col("value").cast("binary"), 256).alias("digest"))
    blocks = records.groupBy("file", "block").agg(F.sum("size").alias("size"))
    before = blocks.select("file", "block", splits.sum_in_front("size", splits.over_blocks()).alias("_before"))
    placed = records.join(before, ["file", "block"]).withColumn("at", F.col("_before") + splits.sum_in_front("size", splits.in_block()))

    def whole(parts: str, place: str, text: str) -> Column:
        ordered = F.array_sort(F.collect_list(F.struct(place, text)))
        return F.array_join(F.transform(ordered, lambda x: x[text]), "").alias(parts)

    ranges = placed.groupBy("file", F.floor(F.col("at") / range_bytes).alias("r")).agg(
        F.count(F.lit(1)).alias("rows"), F.max("bytes").alias("bytes"), whole("parts", "at", "digest")).withColumn("digest", F.sha2("parts", 256))
    trees = ranges.groupBy("file").agg(F.sum("rows").alias("rows"), F.max("bytes").alias("bytes"), whole("parts", "r", "digest"))
    # Paths are URL-encoded, a plus sign is not.
    plain = F.url_decode(F.replace("file", F.lit("+"), F.lit("%2B")))
    root = F.lit(re.sub(r"^[a-z0-9]+:/*", "/", path.rstrip("/")) + "/")
    below = F.call_function("substring_index", F.regexp_replace(plain, "^[a-z0-9]+:/*", "/"), root, F.lit(-1))
    content = F.concat_ws(":", F.col("bytes").cast("string"), "parts")
    return trees.select(below.alias("file"), "rows", "bytes", F.sha2(content, 256).alias("digest"))


def _rendered(df: DataFrame, name: str) -> Column:
    """A column as exact text with its length in front, so no two rows read alike: timestamps in microseconds,
    arrays element by element; NULL has a mark of its own."""
    kind, c = df.schema[name].dataType, F.col(f"`{name}`")

    def measured(x: Column) -> Column:
        return F.coalesce(F.concat(F.length(x).cast("string"), F.lit(":"), x), F.lit("-"))

    if isinstance(kind, T.ArrayType):
        c = F.array_join(F.transform(c, lambda x: measured(x.cast("string"))), "")
    elif isinstance(kind, T.TimestampType):
        c = F.unix_micros(c)
    return measured(c.cast("string"))


def table_digest(df: DataFrame, name: str) -> DataFrame:
    """Rows and content digest of a table, whatever the order of its rows and files.

    Each row is hashed as the text of its columns by name; the digest is the sum
    of the leading 48 bits, one small aggregate per task.
    """
    text = F.concat(*[_rendered(df, c) for c in sorted(df.columns)])
    part = F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("decimal(20,0)")
    total = F.coalesce(F.sum(part), F.lit(0)).cast("decimal(38,0)").cast("string")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), total.alias("digest")).select(
        F.lit(name).alias("table_name"), "n_rows", "digest"
    )


def verify_manifest(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Files missing on either side, or different, come out with ``intact`` false."""
    j = expected.alias("e").join(actual.alias("a"), "file", "full")
    same = [F.col(f"e.{c}").eqNullSafe(F.col(f"a.{c}")) for c in ("rows", "bytes", "digest")]
    return j.select(
        "file", *[F.col(f"{side}.{c}").alias(f"{name}_{c}") for c in ("rows", "bytes") for side, name in (("e", "expected"), ("a", "actual"))],
        (same[0] & same[1] & same[2]).alias("intact"))


class ChangedInput(ValueError):
    """The input is not what its manifest says."""


def require_intact(expected: DataFrame, actual: DataFrame) -> None:
    """Integrity gate: stop when any file differs, is missing or is too many."""
    wrong = verify_manifest(expected, actual).filter("NOT intact")
    if few := [r["file"] for r in wrong.select(F.col("file").cast("string").alias("file")).limit(5).collect()]:
        raise ChangedInput(f"input files differ from the pinned manifest: {', '.join(map(str, few))} ...")


def gated(expected: DataFrame, actual: Callable[[], DataFrame], load: Callable[[], Any]) -> Any:
    """What ``load`` returns, if the input equals the manifest before it and still does after it."""
    require_intact(expected, actual())
    loaded = load()
    require_intact(expected, actual())
    return loaded
