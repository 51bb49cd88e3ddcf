"""Packages and manifests read in shares: nothing is lost at the cuts, wherever they lie."""

import gzip
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from tenderlens.sources import package, sinks


@pytest.fixture
def small_shares(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield lambda n: [spark.conf.set(k, v) for k, v in (("spark.sql.files.maxPartitionBytes", n), ("spark.sql.files.openCostInBytes", 0))]
    for k, v in kept.items():
        spark.conf.set(k, v)


def release(i, rnd):
    odd = rnd.choice(['a "quoted" {brace}', "back\\slash", "{", "}", "[{", ']}, {"id":', "line\nfeed", "ünï ", "", '\\"', '{"id": "x"}'])
    return {"ocid": f"P{i % 7}", "id": str(i), "date": "2020-01-01T00:00:00Z", "tag": ["planning", "{tag}"],
            "buyer": {"id": "B-1", "name": odd},
            "planning": {"budget": {"id": odd, "projectID": None, "amount": {"amount": i + 0.25, "currency": "USD"}}},
            "awards": [{"id": f"A{i}", "title": odd, "value": {"amount": 1.5}, "suppliers": [{"id": "S", "name": odd}]}] * (i % 3)}


@pytest.mark.parametrize("indent, share", [(None, 64), (None, 1000), (2, 333), (0, 10_000_000)])
def test_one_package_by_many_tasks(spark, tmp_path, small_shares, indent, share):
    rnd = random.Random(share)
    source = tmp_path / "in"
    source.mkdir()
    for f in range(2):
        body = {"uri": "u{", "extensions": ["a", "{b"], "publisher": {"name": "p}", "x": {"y": [{"z": 1}]}}, "links": [{"id": "no release"}],
                "releases": [release(f * 100 + i, rnd) for i in range(40)], "publishedDate": "2020", "others": [{"id": "neither"}, {"id": {"a": []}}]}
        (source / f"p{f}.json").write_text(json.dumps(body, indent=indent, ensure_ascii=bool(f)))
    (source / "empty.json").write_text(json.dumps({"uri": "u", "releases": []}))
    small_shares(share)
    got = package.read_package_split(spark, str(source))
    whole = package.read_package(spark, str(source))
    assert got.schema == whole.schema
    assert sorted(map(str, got.collect())) == sorted(map(str, whole.collect()))
    assert got.count() == 80
    if share < 2000:
        assert spark.read.option("lineSep", "{").text(str(source)).rdd.getNumPartitions() > 20


@pytest.mark.parametrize("share", [300, 10_000_000])
def test_gzip_packages_are_read(spark, tmp_path, small_shares, share):
    """The bytes of a gzip file were taken for the bytes of its text; one above the share goes by pieces, in one task."""
    rnd = random.Random(share)
    for f, n in enumerate((1, 60, 0)):
        text = json.dumps({"uri": "u{", "releases": [release(f * 100 + i, rnd) for i in range(n)], "others": [{"id": "neither"}]}, ensure_ascii=False)
        (tmp_path / f"p{f}.json.gz").write_bytes(gzip.compress(text.encode()))
    (tmp_path / "plain.json").write_text("\ufeff" + json.dumps({"releases": [release(900, rnd)], "uri": "u"}))
    small_shares(share)
    got, whole = (read(spark, str(tmp_path)).collect() for read in (package.read_package_split, package.read_package))
    assert sorted(map(str, got)) == sorted(map(str, whole)) and len(got) == 62


def test_text_of_a_package_that_a_task_holds_is_not_moved(spark, tmp_path, small_shares):
    """All text was shuffled twice, in pieces; now only that of the files which are cut."""
    for f in range(3):
        (tmp_path / f"p{f}.json").write_text(json.dumps({"uri": "u", "releases": [release(f * 100 + i, random.Random(f)) for i in range(5 + 40 * f)]}))
    sizes = sorted(p.stat().st_size for p in tmp_path.iterdir())
    for share, cut in ((10_000_000, 0), (sizes[0], 2)):
        small_shares(share)
        df = package.read_package_split(spark, str(tmp_path))
        assert len(df.collect()) == 5 + 45 + 85
        assert _files_with_moved_text(df) == cut


def _files_with_moved_text(df) -> int:
    """Files read by the scans below an exchange of the plan that ran, not counting subqueries."""
    def scans(node, moved):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return scans(node.executedPlan(), moved)
        if "QueryStage" in name:
            return scans(node.plan(), moved)
        if name.startswith("Scan text"):
            return [int(node.metrics().apply("numFiles").value())] if moved else []
        moved = moved or "Exchange" in name
        return [n for i in range(node.children().size()) for n in scans(node.children().apply(i), moved)]

    return max(scans(df._jdf.queryExecution().executedPlan(), False), default=0)


@pytest.mark.parametrize("cut, message", [("text", "brackets do not close"), ("file", "Unexpected end of input stream")])
def test_a_gzip_package_cut_short_stops(spark, tmp_path, cut, message):
    text = json.dumps({"uri": "u", "releases": [release(i, random.Random(i)) for i in range(30)]}).encode()
    (tmp_path / "p.json.gz").write_bytes(gzip.compress(text[:-2]) if cut == "text" else gzip.compress(text)[:-20])
    with pytest.raises(Exception, match=message):
        package.read_package_split(spark, str(tmp_path)).collect()


def test_a_package_cut_short_stops(spark, tmp_path):
    text = json.dumps({"uri": "u", "releases": [release(i, random.Random(i)) for i in range(3)]})
    (tmp_path / "p.json").write_text(text[:-2])
    with pytest.raises(Exception, match="brackets do not close"):
        package.read_package_split(spark, str(tmp_path)).collect()


def tree(data: bytes, size: int) -> str:
    """The digest tree of one file in plain Python."""
    records = data.split(b"\n")
    if records[-1] == b"":
        records.pop()
    at, ranges = 0, {}
    for r in records:
        ranges.setdefault(at // size, []).append(hashlib.sha256(r).hexdigest())
        at += len(r) + 1
    leaves = "".join(hashlib.sha256("".join(v).encode()).hexdigest() for _, v in sorted(ranges.items()))
    return len(records), len(data), hashlib.sha256(f"{len(data)}:{leaves}".encode()).hexdigest()


@pytest.mark.parametrize("share", [50, 10_000_000])
def test_manifest_is_the_same_for_every_split(spark, tmp_path, small_shares, share):
    rnd = random.Random(1)
    files = {
        "a b+c%20.txt": b"\n".join(bytes(rnd.choices(range(256), k=rnd.randrange(60))) for _ in range(300)),
        "sub/lines.txt": b"".join(b"line %d\n" % i for i in range(500)), "empty": b"", "one": b"\n", "none": b"no end of line",
    }
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    small_shares(share)
    got = {r["file"]: (r["rows"], r["bytes"], r["digest"]) for r in sinks.file_manifest(spark, str(tmp_path), range_bytes=256).collect()}
    assert got == {name: tree(data, 256) for name, data in files.items() if data}


def test_the_gate_names_what_differs(spark, tmp_path):
    (tmp_path / "x").write_text("1\n2\n")
    (tmp_path / "y").write_text("3\n")
    pinned = spark.createDataFrame(sinks.file_manifest(spark, str(tmp_path)).collect())
    again = lambda: sinks.file_manifest(spark, str(tmp_path))
    assert sinks.gated(pinned, again, lambda: 7) == 7
    with pytest.raises(sinks.ChangedInput, match="z"):
        sinks.gated(pinned, again, lambda: (tmp_path / "z").write_text("late"))
    (tmp_path / "x").write_text("2\n1\n")
    found = {r["file"]: r["intact"] for r in sinks.verify_manifest(pinned, again()).collect()}
    assert found == {"x": False, "y": True, "z": False}
    called = []
    with pytest.raises(sinks.ChangedInput):
        sinks.gated(pinned, again, lambda: called.append(1))
    assert not called


def test_the_digest_sees_the_time_of_day_and_the_cut_between_columns(spark):
    def digest(sql):
        return sinks.table_digest(spark.sql(sql), "t").first()["digest"]

    assert digest("SELECT timestamp'2020-01-01 10:00:00' AS t") != digest("SELECT timestamp'2020-01-01 11:00:00' AS t")
    assert digest("SELECT 'a|b' AS x, 'c' AS y") != digest("SELECT 'a' AS x, 'b|c' AS y")
    assert digest("SELECT array('a,b') AS x") != digest("SELECT array('a', 'b') AS x")
    assert digest("SELECT CAST(NULL AS STRING) AS x") != digest("SELECT '-' AS x")
    assert digest("SELECT CAST(1.00001 AS DECIMAL(20,5)) AS x") != digest("SELECT CAST(1.00002 AS DECIMAL(20,5)) AS x")
    assert spark.range(3).select(F.lit(1)).count() == 3
