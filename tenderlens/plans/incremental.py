"""The latest-per-key tables kept by a stream of release documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderlens.plans import core
from tenderlens.sources import package
from tenderlens.streaming.incremental import LatestTable, maintain


def release_tables(spark, root: str, rules) -> dict:
    """The tables from which the snapshot is assembled.

    ``release_ids`` is keyed by the id of the release, so one that arrives again, in
    the same batch or a later one, still counts once.
    """
    def table(name, keys, order=("release_seq",)):
        return LatestTable(spark, f"{root}/{name}", keys, list(order))

    return {
        "releases": (
            table("releases", ["ocid"]),
            lambda d: package.flatten_releases(d).select("ocid", "release_id", "release_seq", "buyer_id"),
        ),
        "release_ids": (
            table("release_ids", ["ocid", "release_id"]),
            lambda d: package.flatten_releases(d).select("ocid", "release_id", "release_seq", "buyer_id", "tag"),
        ),
        "budget_lines": (
            table("budget_lines", ["ocid", "budget_project_id"]),
            lambda d: package.flatten_planning(d, rules).filter(F.col("budget_project_id").isNotNull()).drop("budget_id"),
        ),
        "tender": (
            table("tender", ["ocid"], ("release_seq", "tender_id")),
            lambda d: package.flatten_tender(d, rules).select("ocid", "release_id", "release_seq", "tender_id"),
        ),
        "awards": (
            table("awards", ["ocid"], ("release_seq", "award_id")),
            lambda d: package.flatten_awards(d, rules).select("ocid", "release_id", "release_seq", "award_id"),
        ),
        "contracts": (
            table("contracts", ["release_id", "award_id", "contract_id"]),
            lambda d: package.flatten_contracts(d, rules).select("ocid", "release_id", "release_seq", "award_id", "contract_id"),
        ),
    }


@dataclass(frozen=True)
class _Sections:
    releases: DataFrame
    tender: DataFrame
    awards: DataFrame
    contracts: DataFrame


def stream_snapshot(ws, files_per_batch: int = 2) -> dict[str, DataFrame]:
    """Replay the stored release documents as a stream, a few files per micro-batch."""
    spark, root = ws.spark, f"{ws.root}/stream"
    documents = ws.releases
    folder = documents.inputFiles()[0].rsplit("/", 1)[0]
    tables = release_tables(spark, root, ws.rules)
    stream = (
        spark.readStream.schema(documents.schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )
    maintain(stream, tables, f"{root}/_checkpoint", compact_every=2).awaitTermination()
    return {name: t.read() for name, (t, _) in tables.items()}


def _streamed(ws) -> dict[str, DataFrame]:
    if "stream" not in ws.__dict__:
        ws.stream = stream_snapshot(ws)
    return ws.stream


def streamed_snapshot(ws) -> DataFrame:
    """The whole process snapshot, assembled from the stream-kept tables by the batch plan."""
    t = _streamed(ws)
    sections = _Sections(t["release_ids"], t["tender"], t["awards"], t["contracts"])
    return core.build_process_snapshot(sections, t["budget_lines"])


def streamed_budget_lines(ws) -> DataFrame:
    return core.build_budget_lines(_streamed(ws)["budget_lines"].withColumn("budget_id", F.lit(None)))
