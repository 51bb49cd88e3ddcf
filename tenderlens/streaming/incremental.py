"""Incremental latest-per-key tables from a stream of releases.

A micro-batch is reduced to its own latest rows and appended as one small
folder: the cost of a batch follows the batch, not the table. Readers take the
latest row per key over the base and the batches after it. The base is cut into
parts by key hash, each in a folder of its own; a compaction folds batches into
the parts they touch and leaves the others where they are, so what it writes
follows the batches as well. The stream compacts when the batches have grown to the
size of the base, so all compactions of a load together write a few times what came in,
however many batches it had. Order is always the integer sequence, so a late
release never wins and a replayed batch rewrites the same folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tenderlens.operators.latest import latest_per_key
from tenderlens.sources import files


@dataclass(frozen=True)
class _Version:
    """What one published state consists of: the last batch it covers, how many parts there can be, and the folders of those that are there."""

    number: int
    upto: int
    n_parts: int
    parts: dict[int, str]


class LatestTable:
    """Latest row per key, kept as a base in parts plus one folder per micro-batch.

    ``parts`` bounds what one changed key makes a compaction rewrite: 1/parts of the
    base. Choose it so that a part is some hundred megabytes, and the number of parts
    far above the keys of a batch where batches are small. A table that was kept with
    another number of parts still reads right, and its parts change over as they are touched.
    """

    def __init__(self, spark: SparkSession, root: str, keys: list[str], order: list[str], parts: int = 64):
        self.spark, self.root, self.keys, self.order = spark, root.rstrip("/"), keys, order
        self.parts = parts

    def _stored(self, name: str) -> DataFrame | None:
        path = f"{self.root}/{name}"
        return self.spark.read.parquet(path) if files.exists(self.spark, path) else None

    def _published(self) -> list[int]:
        """Numbers of the published versions, the newest last; a row that was not written whole is none."""
        names = files.children(self.spark, f"{self.root}/log")
        return sorted(int(n.split("=")[1]) for n in names if files.exists(self.spark, f"{self.root}/log/{n}/_SUCCESS"))

    def _version(self) -> _Version:
        found = self._published()
        if not found:
            return _Version(-1, -1, self.parts, {})
        row = self.spark.read.parquet(f"{self.root}/log/version={found[-1]}").first()
        return _Version(found[-1], row["upto"], row["n_parts"], dict(row["parts"]))

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        """Store one micro-batch; running it again gives the same table."""
        rows = latest_per_key(batch, self.keys, self.order)
        rows.write.mode("overwrite").parquet(f"{self.root}/batches/batch_id={batch_id}")

    def _with_part(self, df: DataFrame, n_parts: int) -> DataFrame:
        return df.withColumn("_part", F.pmod(F.xxhash64(*self.keys), F.lit(n_parts)).cast("int"))

    def _folders(self, folders: list[str]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.root}/{f}" for f in folders])

    def _batches(self, after: int, upto: int | None = None) -> DataFrame | None:
        batches = self._stored("batches")
        if batches is None:
            return None
        batches = batches.filter(F.col("batch_id") > after)
        return (batches if upto is None else batches.filter(F.col("batch_id") <= upto)).drop("batch_id")

    def read(self) -> DataFrame | None:
        now = self._version()
        found = [self._folders(sorted(set(now.parts.values())))] if now.parts else []
        batches = self._batches(now.upto)
        found += [] if batches is None else [batches]
        if not found:
            return None
        return latest_per_key(found[0].unionByName(found[1]) if len(found) == 2 else found[0], self.keys, self.order)

    def due(self) -> bool:
        """Whether the batches since the last compaction hold as much as the base: folding them
        earlier would rewrite the same base over and over, as keys touch every part."""
        now = self._version()
        base = sum(files.stored_bytes(self.spark, f"{self.root}/{f}") for f in set(now.parts.values()))
        waiting = 0
        for folder in files.children(self.spark, f"{self.root}/batches"):
            number = folder.removeprefix("batch_id=")
            if number.isdigit() and int(number) > now.upto:
                waiting += files.stored_bytes(self.spark, f"{self.root}/batches/{folder}")
        return waiting >= base

    def compact(self, upto: int) -> None:
        """Fold everything up to batch ``upto`` into the parts it touches; the new
        parts become current when their row is in the log, after the write succeeded."""
        now = self._version()
        rows = self._batches(now.upto, upto)
        if upto <= now.upto or rows is None:
            return
        rows = self._with_part(rows, now.n_parts)
        touched = sorted(r["_part"] for r in rows.select("_part").distinct().collect())  # numbers below n_parts
        parts = dict(now.parts)
        if touched:
            held = sorted({now.parts[p] for p in touched if p in now.parts})
            if held:
                rows = rows.unionByName(self._with_part(self._folders(held), now.n_parts))
            fold = f"fold-{uuid.uuid4().hex}"
            latest = latest_per_key(rows, self.keys, self.order)
            latest.repartition(len(touched), "_part").write.partitionBy("_part").parquet(f"{self.root}/{fold}")
            parts |= {p: f"{fold}/_part={p}" for p in touched}
        number = now.number + 1
        entry = self.spark.createDataFrame([(upto, now.n_parts, parts)], "upto bigint, n_parts int, parts map<int,string>")
        entry.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/log/version={number}")
        self._prune(now, parts)

    def _prune(self, before: _Version, parts: dict[int, str]) -> None:
        """Drop what neither this version nor the one before it has: readers may be one compaction behind, not two."""
        for folder in files.children(self.spark, f"{self.root}/batches"):
            number = folder.removeprefix("batch_id=")
            if number.isdigit() and int(number) <= before.upto:
                files.remove(self.spark, f"{self.root}/batches/{folder}")
        for number in self._published():
            if number < before.number:
                files.remove(self.spark, f"{self.root}/log/version={number}")
        keep = {*parts.values(), *before.parts.values()}
        for fold in files.children(self.spark, self.root):
            if fold.startswith("fold-"):
                held = [c for c in files.children(self.spark, f"{self.root}/{fold}") if c.startswith("_part=")]
                gone = [c for c in held if f"{fold}/{c}" not in keep]
                for c in [None] if len(gone) == len(held) else gone:
                    files.remove(self.spark, f"{self.root}/{fold}" + (f"/{c}" if c else ""))


def maintain(
    stream: DataFrame,
    tables: dict[str, tuple[LatestTable, Callable[[DataFrame], DataFrame]]],
    checkpoint: str,
    compact_every: int = 50,
) -> StreamingQuery:
    """Run one stream into several latest-per-key tables. ``tables`` maps a
    name to (table, how to get its rows from a batch of the stream). The tables of
    a batch are independent jobs, a few at a time. Every ``compact_every`` batches a
    table whose batches have grown to the size of its base is compacted."""

    def each(batch: DataFrame, batch_id: int) -> None:
        def keep(entry: tuple[LatestTable, Callable[[DataFrame], DataFrame]]) -> None:
            table, rows = entry
            table.merge(rows(batch), batch_id)
            if batch_id and batch_id % compact_every == 0 and table.due():
                table.compact(batch_id)

        batch.persist()
        try:
            with ThreadPoolExecutor(max_workers=4) as pool:
                list(pool.map(keep, tables.values()))
        finally:
            batch.unpersist()

    return (
        stream.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
