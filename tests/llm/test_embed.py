import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_DIR
from tenderlens.llm import embed
from tenderlens.llm.storage import table


def usable(label, v):
    return label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)


def brute(rows, cosine):
    n = len(rows)
    parent, links = list(range(n)), [0] * n

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    groups = {}
    for i, (_, label, v) in enumerate(rows):
        if usable(label, v):
            groups.setdefault((label, len(v)), []).append(i)
    for members in groups.values():
        x = np.array([rows[i][2] for i in members], float)
        norm = np.sqrt((x * x).sum(1))
        close = (x @ x.T) / norm[:, None] / norm >= cosine
        for a, b in np.argwhere(np.triu(close, 1)):
            i, j = members[a], members[b]
            links[i] += 1
            links[j] += 1
            p, q = find(i), find(j)
            parent[max(p, q)] = min(p, q)
    lowest = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            lowest[find(i)] = min(lowest.get(find(i), r[0]), r[0])
    return sorted([(r[0], links[i], lowest.get(find(i)), r[0] == lowest.get(find(i))) for i, r in enumerate(rows)], key=str)


def got(df):
    return sorted([(r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect()], key=str)


@pytest.mark.parametrize("size", [1, 2, 3, 9, 64])
def test_against_all_pairs(spark, size, monkeypatch):
    monkeypatch.setattr(embed, "CHUNK", 20)
    rng = np.random.default_rng(size)
    rows = []
    for i in range(260):
        base = rng.standard_normal(size) if i % 4 == 0 else np.array(rows[int(rng.integers(i // 2, i))][2]) if i % 9 else np.ones(size)
        v = base + rng.standard_normal(size) * rng.choice([0, 0.02, 0.1, 0.3]) * np.linalg.norm(base) / math.sqrt(size)
        rows.append((i, int(rng.integers(2)), [float(np.float32(x)) for x in v]))
    rows += [(900, None, [1.0] * size), (901, 0, None), (902, 0, []), (903, 0, [0.0] * size), (904, 0, [None] * size),
             (905, 0, [float("nan")] * size), (906, 0, [float("inf")] * size), (907, 0, [1.0] * (size + 1)), (5, 0, [1.0] * size),
             (5, 0, [1.0] * size)]
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>").withColumn("key", F.lit(1)).withColumn("size", F.lit(2))
    assert got(embed.near_duplicates(df)) == brute(rows, embed.COSINE)


def test_whole_table(spark):
    vectors = table(spark, SF_DIR, "embeddings")
    rows = [(r.vec_id, r.label, r.embedding) for r in vectors.collect()]
    assert got(embed.near_duplicates(vectors)) == brute(rows, embed.COSINE)


def test_empty(spark):
    assert embed.near_duplicates(spark.createDataFrame([], "vec_id bigint, label int, embedding array<float>")).count() == 0
