"""Pairs of a group that lie apart by a factor, against all pairs."""

import random

import pytest

from tenderlens.operators import bands_join


@pytest.mark.parametrize("factor", [1.5, 2, 8, 10])
def test_against_all_pairs(spark, factor, monkeypatch):
    monkeypatch.setattr(bands_join, "CHUNK", 7)
    rnd = random.Random(int(factor * 10))
    raw = [(rnd.choice(["hot", "hot", "a", "b", None]), i, float(rnd.choice([1, 2, 4, 8, 16, 1024, rnd.lognormvariate(3, 3)]))) for i in range(300)]
    raw += [("a", 900, 0.0), ("a", 901, -5.0), ("a", 902, None), ("a", None, 3.0), ("hot", 5, 1e9)]
    df = spark.createDataFrame(raw, "g string, id long, v double")
    got = sorted((r.g, r.id, r.v, r.other_id, r.other_v) for r in bands_join.pairs_apart(df, ["g"], "id", "v", factor).collect())
    good = [r for r in raw if r[0] is not None and r[1] is not None and r[2] and r[2] > 0]
    assert got == sorted((a[0], a[1], a[2], b[1], b[2]) for a in good for b in good if a[0] == b[0] and a[1] != b[1] and a[2] >= factor * b[2])


def test_no_nested_loop_and_a_factor_above_one(spark):
    df = spark.createDataFrame([("g", 1, 5.0)], "g string, id long, v double")
    plan = bands_join.pairs_apart(df, ["g"], "id", "v", 10)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    with pytest.raises(ValueError):
        bands_join.pairs_apart(df, ["g"], "id", "v", 1)
