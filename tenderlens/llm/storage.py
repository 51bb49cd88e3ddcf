"""Where intermediate tables go, and how texts are dealt into bounded blocks."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlens.plans.workspace import shared_folder


FILE_ROWS = 1 << 18
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def prepare(spark: SparkSession) -> None:
    """What the Python workers of these operators need of a session.

    They find this package where the driver found it; that serves local sessions
    and shared installations, whatever the working directory; elsewhere submit
    the package with ``--py-files``.  Rows hold whole texts, so a session that
    has Spark's default of 10,000 rows per Arrow batch gets 1,000: that bounds
    the memory of the batch in the executor and in the worker.
    """
    if spark.conf.get(BATCH_ROWS) == "10000":
        spark.conf.set(BATCH_ROWS, "1000")
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    given = spark.sparkContext.environment
    paths = [p for p in given.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        given["PYTHONPATH"] = os.pathsep.join([root, *paths])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` once below the shared checkpoint folder and read it back.

    This cuts the lineage: a lost executor repeats tasks of one step only.
    ``rows`` says how many short rows come at most. Few go to as many files as they fill, not
    to one for each shuffle partition: on a local disk Hadoop starts a process for every file.
    """
    spark = df.sparkSession
    if rows is not None:
        files = max(1, -(-rows // FILE_ROWS))
        if files < int(spark.conf.get("spark.sql.shuffle.partitions")):
            df = df.repartition(files)
    path = f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of all texts: one scan, one number."""
    return docs.agg(F.sum(F.octet_length(F.col(text).cast("string")).cast("bigint"))).first()[0] or 0


def block_count(n_bytes: int, block_bytes: int) -> int:
    return max(1, -(-n_bytes // block_bytes))


def block_of(blocks: int, *columns: str) -> Column:
    """A block number from the row's own content: the same on every attempt."""
    return F.pmod(F.xxhash64(*columns), F.lit(blocks))
