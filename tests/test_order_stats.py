"""Distributed order statistics against brute force, with ties and hot values."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenderlens.operators import order_stats as o
from tenderlens.operators.concentration import concentration, top_share_with_ties


def rows(seed, n=3000):
    """A third of the rows share one value and one group."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        if i % 3 == 0:
            out.append((i, "hot", 7.0))
        else:
            x = rnd.choice([0.0, -rnd.expovariate(0.01), rnd.lognormvariate(3, 3), float(rnd.randint(1, 40))])
            out.append((i, rnd.choice(["hot", "a", "b"]), x))
    return out


@pytest.fixture(scope="module", params=[1, 2])
def data(request, spark):
    raw = rows(request.param)
    return raw, spark.createDataFrame(raw, "id long, g string, x double").repartition(6)


def test_percentiles(data):
    raw, df = data
    probs = {"p0": 0.0, "p01": 0.01, "p25": 0.25, "p50": 0.5, "p90": 0.9, "p100": 1.0}
    got = o.exact_percentiles(df, "x", probs).first()
    for name, p in probs.items():
        assert got[name] == pytest.approx(np.quantile([x for _, _, x in raw], p), abs=1e-9)
    for r in o.exact_percentiles(df, "x", probs, ["g"]).collect():
        mine = [x for _, g, x in raw if g == r["g"]]
        for name, p in probs.items():
            assert r[name] == pytest.approx(np.quantile(mine, p), abs=1e-9)


def test_percentiles_ignore_null_and_single_value(spark):
    df = spark.createDataFrame([("a", None), ("a", 5.0), ("b", None)], "g string, x double")
    got = o.exact_percentiles(df, "x", {"m": 0.5}, ["g"]).collect()
    assert [(r["g"], r["m"]) for r in got] == [("a", 5.0)]


@pytest.mark.parametrize("direction", ["asc", "desc"])
def test_rank_and_row_number(data, direction):
    raw, df = data
    sign = -1 if direction == "desc" else 1
    got = o.with_position(df, [("x", direction)], "r", count_as="n")
    got = o.with_position(got, [("x", direction), ("id", "asc")], "k", kind="row_number").collect()
    ordered = sorted(raw, key=lambda r: (sign * r[2], r[0]))
    position = {r[0]: i + 1 for i, r in enumerate(ordered)}
    values = sorted(sign * r[2] for r in raw)
    first = {}
    for i, v in enumerate(values):
        first.setdefault(v, i + 1)
    for r in got:
        assert r["n"] == len(raw)
        assert r["k"] == position[r["id"]]
        assert r["r"] == first[sign * r["x"]]


def test_running_total_and_ntile(data):
    raw, df = data
    positive = [r for r in raw if r[2] > 0]
    src = df.filter("x > 0")
    got = o.with_position(src, [("x", "desc"), ("id", "asc")], "k", kind="row_number", running={"x": "cum"}, count_as="n")
    got = got.withColumn("tile", o.ntile(F.col("k"), F.col("n"), 4)).collect()
    ordered = sorted(positive, key=lambda r: (-r[2], r[0]))
    cum, expect = 0.0, {}
    n = len(ordered)
    sizes = [n // 4 + (1 if i < n % 4 else 0) for i in range(4)]
    tiles = [t + 1 for t, s in enumerate(sizes) for _ in range(s)]
    for i, r in enumerate(ordered):
        cum += r[2]
        expect[r[0]] = (cum, tiles[i])
    for r in got:
        assert r["cum"] == pytest.approx(expect[r["id"]][0], rel=1e-9)
        assert r["tile"] == expect[r["id"]][1]
        assert r["cum_total"] == pytest.approx(cum, rel=1e-9)


def test_concentration_and_depth(spark):
    rnd = random.Random(5)
    raw = [("m" if i % 3 == 0 else "n", f"s{i}", 1, rnd.choice([10, 10, 10, 500, rnd.randint(1, 9000)])) for i in range(900)]
    df = spark.createDataFrame(raw, "g string, h string, awards long, v long").selectExpr(
        "g", "h", "awards", "cast(v as decimal(30,4)) as value"
    )
    depths = {"half": "0.5", "most": "0.8"}
    for groups in ([], ["g"]):
        for r in concentration(df, "h", [1, 10], depths, groups).collect():
            mine = sorted((v for g, _, _, v in raw if not groups or g == r["g"]), reverse=True)
            total, cum = sum(mine), np.cumsum(mine)
            assert r["holders"] == len(mine)
            assert float(r["top_10"]) == sum(mine[:10])
            assert r["hhi"] == pytest.approx(1e4 * sum((v / total) ** 2 for v in mine))
            assert r["half"] == int(np.argmax(cum * 2 >= total)) + 1
            assert r["most"] == int(np.argmax(cum * 10 >= total * 8)) + 1


def test_depth_is_exact_on_decimal_multiples(spark):
    df = spark.sql("SELECT CAST(0.1 AS DECIMAL(30,4)) AS v FROM range(22)")
    got = o.depth_to_share(df, "v", {"half": "0.5", "all": "1.0", "most": "0.8"}).first()
    assert (got["half"], got["all"], got["most"]) == (11, 22, 18)


def test_top_share_includes_ties(spark):
    df = spark.createDataFrame([(5,), (5,), (3,), (3,), (3,), (1,)], "value long")
    assert top_share_with_ties(df, 3).first()["share"] == pytest.approx(19 / 20)


def test_bucket_is_monotone(spark):
    rnd = random.Random(3)
    xs = sorted([0.0, -1e15, 1e15, 1e-9] + [rnd.lognormvariate(0, 12) * rnd.choice([-1, 1]) for _ in range(2000)])
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    buckets = [r["b"] for r in df.select("i", o.value_bucket(F.col("x")).alias("b")).orderBy("i").collect()]
    assert buckets == sorted(buckets)


@pytest.fixture
def small_ranges(monkeypatch):
    monkeypatch.setattr(o, "_RANGE_ROWS", 16)
    monkeypatch.setattr(o, "_CHUNK", 8)


@pytest.mark.parametrize("direction", ["asc", "desc"])
def test_a_third_of_the_rows_tied_is_no_hot_task(spark, small_ranges, direction):
    rnd = random.Random(9)
    n = 30000
    raw = [(i, 7.0 if i % 3 == 0 else rnd.lognormvariate(3, 2), rnd.choice("abc") + str(i * 7919 % n), "hot" if i % 4 else "cold") for i in range(n)]
    raw += [(n, 7.0, None, "hot")]
    df = spark.createDataFrame(raw, "id long, x double, name string, g string").repartition(5)
    order = [("x", direction), ("name", "desc")]
    tied = sum(r[1] == 7.0 for r in raw)
    largest = o._with_ranges(df, order, []).groupBy("_b", "_r").count().agg(F.max("count")).first()[0]
    assert largest < 0.01 * tied
    sign = -1 if direction == "desc" else 1
    for groups in ([], ["g"]):
        got = o.with_position(df, order, "k", groups, kind="row_number", running={"x": "cum"}, count_as="n", split_ties=True).collect()
        ordered = sorted(sorted(raw, key=lambda r: (r[2] is not None, r[2] or ""), reverse=True), key=lambda r: sign * r[1])
        expect, upto = {}, {}
        for r in ordered:
            g = r[3] if groups else None
            k, cum = upto.get(g, (0, 0.0))
            upto[g] = k + 1, cum + r[1]
            expect[r[0]] = upto[g]
        assert {r["id"]: r["k"] for r in got} == {i: k for i, (k, _) in expect.items()}
        for r in got:
            assert r["cum"] == pytest.approx(expect[r["id"]][1], rel=1e-9)
            assert r["n"] == upto[r["g"] if groups else None][0]


@pytest.mark.parametrize("split", [False, True])
def test_rank_with_a_running_sum_over_cut_ties(spark, small_ranges, split):
    raw = [(i, float(i % 3)) for i in range(900)]
    df = spark.createDataFrame(raw, "id long, x double")
    got = o.with_position(df, [("x", "desc"), ("id", "asc")], "r", running={"x": "cum"}, rank_keys=1, count_as="n", split_ties=split).collect()
    ordered = sorted(raw, key=lambda r: (-r[1], r[0]))
    cum = dict(zip([r[0] for r in ordered], np.cumsum([r[1] for r in ordered])))
    assert all(r["r"] == 1 + sum(x > r["x"] for _, x in raw) and r["cum"] == cum[r["id"]] and r["n"] == 900 for r in got)


def test_equal_rows_get_different_places(spark, small_ranges):
    df = spark.createDataFrame([(1.0,)] * 500 + [(2.0,)], "x double")
    assert sorted(r["k"] for r in o.with_position(df, [("x", "asc")], "k", kind="row_number", split_ties=True).collect()) == list(range(1, 502))
