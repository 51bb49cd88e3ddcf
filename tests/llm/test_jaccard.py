import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_DIR
from tenderlens.llm import graph, jaccard, storage
from tenderlens.llm.storage import table

LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i: i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute(rows, rule):
    sets = [shingles(t, rule.words) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            both = len(a & b)
            if a and b and rule.den * both >= rule.num * (len(a) + len(b) - both):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    members = {}
    for i in range(len(rows)):
        members.setdefault(find(i), []).append(rows[i][0])
    lowest = {k: min((d for d in v if d is not None), default=None) for k, v in members.items()}
    return sorted(((d, len(s), lowest[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def mine(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def near_copies(seed, n):
    """Texts of a few bases with random edits around the threshold, shared passages, copies."""
    rng = np.random.default_rng(seed)
    word = lambda: "w%d" % rng.integers(3000)
    passage = [word() for _ in range(40)]
    out = []
    for base in range(4):
        text = [word() for _ in range(int(rng.integers(20, 200)))]
        for _ in range(n):
            t = list(text)
            for _ in range(int(rng.integers(0, max(2, len(t) // 15)))):
                t[rng.integers(len(t))] = word()
            out.append(" ".join(t))
    out += [" ".join(passage + [word() for _ in range(60)]) for _ in range(n)]
    out += ["A b", "a B", "a", "a b c d e f", None, "", "\n", out[0], out[1].upper(), " ".join(passage * 2000)]
    return [(int(i), t) for i, t in enumerate(rng.permutation(np.array(out, object)))]


@pytest.mark.parametrize("rule", [jaccard.Rule(), jaccard.Rule(5, 80, 100)])
def test_against_all_pairs(spark, rule, monkeypatch):
    monkeypatch.setattr(jaccard, "MEMBERS", 16)
    monkeypatch.setattr(jaccard, "TASK_SHINGLES", 4000)
    rows = near_copies(rule.words, 60) + [(7, "repeated id with another text"), (None, "a b c d e f"), (None, "no id at all here")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("sid", F.lit(1)).withColumn("n", F.lit(1))
    want = brute(rows, rule)
    assert len({c for _, _, c in want}) < len(rows) - 60
    assert mine(jaccard.join_components(docs, rule, block_bytes=4000)) == want


def test_whole_table(spark):
    rule = jaccard.Rule()
    docs = table(spark, SF_DIR, "documents")
    assert mine(jaccard.join_components(docs, rule, 1 << 16)) == brute([(r.doc_id, r.text) for r in docs.collect()], rule)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert jaccard.join_components(docs).count() == 0


def test_components(spark):
    rng = np.random.default_rng(3)
    for n, m in ((50, 30), (400, 390), (60, 500)):
        a, b = rng.integers(0, n, m), rng.integers(0, n, m)
        want = graph.local_roots(n, a, b)
        df = spark.createDataFrame(list(zip(a.tolist(), b.tolist())), "a bigint, b bigint")
        got = {r.node: r.root for r in graph.components(df).collect()}
        assert all(got.get(i, i) == want[i] for i in range(n))
    path = spark.createDataFrame([(i, i + 1) for i in range(200)], "a bigint, b bigint")
    assert {r.root for r in graph.components(path).collect()} == {0}


def test_small_components_go_to_few_files(spark, monkeypatch, tmp_path):
    """A file costs a process on a local disk: not one for each shuffle partition of a small table."""
    monkeypatch.setattr(storage, "shared_folder", lambda _: str(tmp_path))
    ways = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in ways}
    try:
        for k, v in ways.items():
            spark.conf.set(k, v)
        path = spark.createDataFrame([(i, i + 1) for i in range(200)], "a bigint, b bigint")
        assert {r.root for r in graph.components(path).collect()} == {0}
        monkeypatch.setattr(storage, "FILE_ROWS", 50)
        graph.components(path, "more")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    files = lambda name: [len(list(d.glob("*.parquet"))) for d in tmp_path.glob(f"llm/{name}-*")]
    assert set(files("components")) == {1}
    assert 1 < max(files("more")) <= 8
