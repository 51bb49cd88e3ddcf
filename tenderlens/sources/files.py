"""Existence and removal of folders in any store that Spark reads."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    store, where = _at(spark, path)
    return store.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    store, where = _at(spark, path)
    store.delete(where, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of the entries of a folder; none if there is no such folder."""
    store, where = _at(spark, path)
    if not store.exists(where):
        return []
    return sorted(s.getPath().getName() for s in store.listStatus(where))


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files below a folder; none if there is no such folder."""
    store, where = _at(spark, path)
    return store.getContentSummary(where).getLength() if store.exists(where) else 0
