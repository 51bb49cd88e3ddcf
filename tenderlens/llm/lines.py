"""Line dedup against levelled sorted runs of line hashes.

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends, A-Z
lower-cased.  Keys of at least ``MIN_CHARS`` code points keep their lines in one
document only, the one with the smallest id.  Documents come in batches of ascending ids.
``LineRuns`` holds what earlier batches have: runs of distinct keys, each bucketed
and sorted by the key's 128-bit hash.  A batch aggregates its keys to their
smallest document, merge-anti-joins every run, and adds what is left as a new run of
level 0; ``fan`` runs of a level are compacted into one of the next.  A line stays
if its key and document are in the batch's own new run.

Only hashes and positions move for that: 16 bytes a key, pre-aggregated before
the shuffle, so a line that is in every document is one row a task.  The
decision on each line is a join on key and document, so such a line is no hot key
there either.  Texts are shuffled once, to meet their dropped positions.  All of it is
DataFrame functions.

Defined results: a null text is one empty line.  A null id counts as the
largest one, 2^63 - 1.  Rows of the same id are one document for the choice of the
keeper; each is returned, and equal rows lose the same lines.  All lines of the keeper
stay, its repeats included.  A text whose lines all go is empty.  An empty table gives
no rows; extra columns are not read.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlens.llm.storage import stored
from tenderlens.plans.workspace import shared_folder

MIN_CHARS, BATCHES, FAN = 10, 8, 4
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["h", "g"]


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACES)), UPPER, LOWER)


class LineRuns:
    """Runs of distinct (h, g, first), disjoint in their keys, by level.

    Runs are bucketed by the session's number of shuffle partitions, so an aggregate by
    key meets them without another shuffle.
    """

    def __init__(self, spark: SparkSession, fan: int = FAN):
        self.spark, self.fan = spark, fan
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def _write(self, keys: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        keys.write.format("parquet").option("path", f"{shared_folder(self.spark)}/llm/{name}").bucketBy(
            self.buckets, *KEY
        ).sortBy(*KEY).saveAsTable(name)
        return name

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def unseen(self, keys: DataFrame) -> DataFrame:
        """The keys that no run has: one merge join for each run, on the same partitioning."""
        return reduce(
            lambda left, name: left.join(self.spark.table(name).select(*KEY).hint("merge"), KEY, "left_anti"), self.runs(), keys
        )

    def add(self, keys: DataFrame) -> DataFrame:
        """Writes the keys (h, g, first) that are new as a run, and returns them."""
        name = self._write(self.unseen(keys))
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(name)
        # Read by path: a join on more than the buckets' key is to be dealt by all of it.
        own = self.spark.read.schema(keys.schema).parquet(f"{shared_folder(self.spark)}/llm/{name}")
        self._compact()
        return own

    def _compact(self) -> None:
        for level in range(len(self.levels)):
            full = self.levels[level]
            if len(full) < self.fan:
                return
            merged = reduce(DataFrame.unionByName, [self.spark.table(n) for n in full]).repartition(self.buckets, *KEY)
            name = self._write(merged)
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(name)
            self.levels[level] = []
            self._forget(full)

    def _forget(self, names: list[str]) -> None:
        for name in names:  # external tables: the files stay below the checkpoint folder
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def close(self) -> None:
        self._forget(self.runs())
        self.levels = []


def _rows(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc_id, d, print, lines): d orders the documents; d and print tell different rows apart."""
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return docs.select(
        F.col(f"`{doc}`").alias("doc_id"), F.coalesce(F.col(f"`{doc}`").cast("bigint"), F.lit(2**63 - 1)).alias("d"),
        F.xxhash64(whole).alias("print"), F.split(whole, "\n", -1).alias("lines"),
    )


def batch_edges(docs: DataFrame, batches: int, doc: str = "doc_id") -> list[int]:
    """Ids that cut the documents into batches of about equal size; where they lie changes no result."""
    d = F.coalesce(F.col(f"`{doc}`").cast("bigint"), F.lit(2**63 - 1))
    share = [i / batches for i in range(1, batches)]
    found = docs.select(d.alias("d")).agg(F.percentile_approx("d", share, 10000)).first()[0] if share else None
    return sorted(set(found or []))


def dropped_positions(rows: DataFrame, edges: list[int], min_chars: int, fan: int) -> DataFrame:
    """(d, print, pos) of every line that goes; ``rows`` as of ``_rows``."""
    spark = rows.sparkSession
    lines = rows.select("d", "print", F.posexplode("lines").alias("pos", "line")).withColumn("key", line_key(F.col("line")))
    lines = lines.where(F.length("key") >= min_chars).select(
        F.xxhash64("key").alias("h"), F.xxhash64(F.lit(1), "key").alias("g"), "d", "print", "pos",
        reduce(lambda a, e: a + (F.col("d") > e).cast("int"), edges, F.lit(0)).alias("batch"),
    )
    path = f"{shared_folder(spark)}/llm/lines-{uuid.uuid4().hex}"
    lines.write.partitionBy("batch").parquet(path)
    lines = spark.read.schema(lines.schema).parquet(path)
    runs, gone = LineRuns(spark, fan), []
    for b in range(len(edges) + 1):
        part = lines.where(F.col("batch") == b)
        own = runs.add(part.groupBy(*KEY).agg(F.min("d").alias("first"))).withColumnRenamed("first", "d")
        gone.append(stored(part.join(own, [*KEY, "d"], "left_anti").select("d", "print", "pos"), f"lines-gone-{b}"))
    runs.close()
    return reduce(DataFrame.unionByName, gone)


def without_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, batches: int = BATCHES, fan: int = FAN,
                           doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept): every row's text without the lines that another document keeps."""
    rows = _rows(docs, doc, text)
    gone = dropped_positions(rows, batch_edges(docs, batches, doc), min_chars, fan)
    gone = gone.groupBy("d", "print").agg(F.collect_set("pos").alias("gone"))  # of one text's lines
    out = rows.join(gone, ["d", "print"], "left")
    n = F.size("lines")
    # Both steps are linear in the lines; "lines" comes out of the join, so it is split once a row.
    left = F.array_except(F.sequence(F.lit(0), n - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.transform(left, lambda i: F.col("lines")[i]))
    return out.select(
        "doc_id", n.cast("bigint").alias("n_lines"), F.greatest(F.size("gone"), F.lit(0)).cast("bigint").alias("n_dropped"),
        F.array_join(kept, "\n").alias("kept"),
    )


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
