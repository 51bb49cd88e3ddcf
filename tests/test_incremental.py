"""The stream-kept tables equal the batch result; late and replayed batches change nothing."""

import json
import uuid

from tenderlens.operators.latest import latest_per_key
from tenderlens.plans.incremental import release_tables
from tenderlens.rules import Rules
from tenderlens.sources import package
from tenderlens.streaming.incremental import LatestTable, maintain

SCHEMA = "k string, seq long, v string"


def state(table):
    return sorted((r["k"], r["seq"], r["v"]) for r in table.read().collect())


def test_late_replay_and_compaction(spark, tmp_path):
    t = LatestTable(spark, str(tmp_path / "t"), ["k"], ["seq"])
    assert t.read() is None
    batches = [
        [("a", 5, "a5"), ("a", 2, "a2"), ("b", 1, "b1")],
        [("a", 4, "late"), ("b", 9, "b9"), ("c", 1, "c1")],
        [("c", 3, "c3"), ("b", 8, "late")],
    ]
    frames = [spark.createDataFrame(b, SCHEMA) for b in batches]
    for i, f in enumerate(frames):
        t.merge(f, i)
        t.merge(f, i)  # replay
        seen = spark.createDataFrame([r for b in batches[: i + 1] for r in b], SCHEMA)
        expect = sorted((r["k"], r["seq"], r["v"]) for r in latest_per_key(seen, ["k"], ["seq"]).collect())
        assert state(t) == expect
        if i == 1:
            t.compact(1)
            t.compact(1)
            assert state(t) == expect
    t.merge(frames[0], 0)  # a replay behind the base
    assert state(t) == [("a", 5, "a5"), ("b", 9, "b9"), ("c", 3, "c3")]


def test_stream_of_documents_restarts(spark, tmp_path):
    source, root = tmp_path / "in", str(tmp_path / "tables")
    source.mkdir()

    def drop(*releases):
        (source / f"{uuid.uuid4().hex}.json").write_text("\n".join(json.dumps(r) for r in releases))

    def doc(rid, ocid, buyer, project=None):
        return {"id": str(rid), "ocid": ocid, "tag": ["planning"], "buyer": {"id": buyer},
                "planning": {"budget": {"projectID": project, "amount": {"amount": rid}}}}

    def run():
        from tenderlens.model import RELEASE_SCHEMA

        tables = release_tables(spark, root, Rules())
        stream = spark.readStream.schema(RELEASE_SCHEMA).option("maxFilesPerTrigger", 1).json(str(source))
        maintain(stream, tables, str(tmp_path / "checkpoint"), compact_every=2).awaitTermination()
        return tables

    drop(doc(9, "P", "b9", "L"), doc(10, "P", "b10"))
    drop(doc(3, "Q", "b3", "M"))
    run()
    drop(doc(2, "P", "late", "L"), doc(4, "Q", "b4", "M"))
    tables = run()
    latest = {r["ocid"]: (r["release_id"], r["buyer_id"]) for r in tables["releases"][0].read().collect()}
    assert latest == {"P": ("10", "b10"), "Q": ("4", "b4")}
    lines = {r["budget_project_id"]: r["release_id"] for r in tables["budget_lines"][0].read().collect()}
    assert lines == {"L": "9", "M": "4"}
    every = package.read_release_lines(spark, str(source))
    assert every.count() == 5


def _bytes(folder):
    return sum(f.stat().st_size for f in folder.rglob("*.parquet"))


def test_a_fold_writes_what_its_batch_touches(spark, tmp_path):
    root = tmp_path / "t"
    t = LatestTable(spark, str(root), ["k"], ["seq"], parts=32)
    first = spark.range(40000).selectExpr("cast(id as string) as k", "1L as seq", "sha2(cast(id as string), 256) as v")
    t.merge(first, 0)
    t.compact(0)
    (base,) = [f for f in root.iterdir() if f.name.startswith("fold-")]
    whole, parts = _bytes(base), {p.name for p in base.iterdir() if p.name.startswith("_part=")}
    assert len(parts) == 32
    t.merge(spark.createDataFrame([("5", 2, "new"), ("17", 0, "late"), ("x", 1, "more")], SCHEMA), 1)
    t.compact(1)
    (fold,) = [f for f in root.iterdir() if f.name.startswith("fold-") and f != base]
    assert _bytes(fold) < 0.15 * whole
    assert len([p for p in fold.iterdir() if p.name.startswith("_part=")]) <= 3
    rows = {r["k"]: (r["seq"], r["v"]) for r in t.read().collect()}
    assert len(rows) == 40001 and rows["5"] == (2, "new") and rows["17"][0] == 1 and rows["x"] == (1, "more")
    # Another number of parts is not taken up; what no version of the last two has is removed.
    t = LatestTable(spark, str(root), ["k"], ["seq"], parts=5)
    for i in (2, 3):
        t.merge(spark.createDataFrame([("5", i + 1, "newer")], SCHEMA), i)
        t.compact(i)
    assert {r["k"]: r["seq"] for r in t.read().collect()}["5"] == 4 and t.read().count() == 40001
    left = [p.name for f in root.iterdir() if f.name.startswith("fold-") for p in f.iterdir() if p.name.startswith("_part=")]
    assert len(left) == 32 + 1 and len(list((root / "log").iterdir())) == 2


def test_a_fold_that_was_not_published_changes_nothing(spark, tmp_path):
    t = LatestTable(spark, str(tmp_path / "t"), ["k"], ["seq"])
    t.merge(spark.createDataFrame([("a", 1, "a1")], SCHEMA), 0)
    t.compact(0)
    t.merge(spark.createDataFrame([("a", 2, "a2")], SCHEMA), 1)
    broken = tmp_path / "t" / "log" / "version=1"
    broken.mkdir()  # begun, not whole
    (tmp_path / "t" / "fold-lost").mkdir()
    assert state(t) == [("a", 2, "a2")]
    t.compact(1)
    assert state(t) == [("a", 2, "a2")] and not (tmp_path / "t" / "fold-lost").exists()
