"""The compactions of a stream, taken together, write a few times what came in."""

from pyspark.sql import functions as F

from tenderlens.streaming import incremental
from tenderlens.streaming.incremental import LatestTable, maintain


def test_compactions_write_a_few_times_the_input(spark, tmp_path, monkeypatch):
    source = str(tmp_path / "in")
    spark.range(1600).select(F.col("id").alias("key"), F.col("id").alias("seq")).repartition(16).write.parquet(source)
    folds = []
    compact = LatestTable.compact
    monkeypatch.setattr(incremental.LatestTable, "compact", lambda self, upto: (folds.append(upto), compact(self, upto)))
    table = LatestTable(spark, str(tmp_path / "t"), ["key"], ["seq"], parts=4)
    stream = spark.readStream.schema("key long, seq long").option("maxFilesPerTrigger", 1).parquet(source)
    maintain(stream, {"t": (table, lambda d: d)}, str(tmp_path / "checkpoint"), compact_every=2).awaitTermination()
    # Sixteen batches: the base doubles from fold to fold instead of being rewritten every second batch.
    assert 1 <= len(folds) <= 5
    assert table.read().count() == 1600
