import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_DIR
from tenderlens.llm import mixing
from tenderlens.llm.storage import table


def corpus(spark, seed=0, n=900):
    rng = np.random.default_rng(seed)
    share = [0.4, 0.3, 0.1, 0.1, 0.06, 0.04]
    rows = [(i, "w " * int(rng.integers(0, 40)), ["a", "b", "c", None, "e", "f"][rng.choice(6, p=share)]) for i in range(n)]
    rows += [(n, None, "a"), (n + 1, "", "only empty"), (5, rows[5][1], rows[5][2])]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string"), rows


def hashes(spark, ids, turn):
    df = spark.createDataFrame([(i,) for i in ids], "doc_id bigint")
    return {r.doc_id: r.h for r in df.select("doc_id", mixing._order(F.col("doc_id"), F.lit(turn)).alias("h")).collect()}


def brute(spark, rows, a, amount):
    """Copies of each document by a plain running sum in hash order."""
    tokens = {}
    for i, t, s in rows:
        tokens.setdefault(s, []).append((i, len((t or "").split())))
    total = sum(n for v in tokens.values() for _, n in v)
    share = {s: sum(n for _, n in v) / total for s, v in tokens.items()}
    z = sum(p**a for p in share.values() if p)
    out = {}
    for s, v in tokens.items():
        size = sum(n for _, n in v)
        if not size:
            out |= {(i, s): 1 for i, _ in v}
            continue
        wanted = math.floor(share[s] ** a / z * amount + 1e-6)
        passes, left = divmod(wanted, size)
        h = hashes(spark, [i for i, _ in v], passes)
        chosen, used = set(), 0
        for value in sorted({h[i] for i, _ in v}):
            group = [(i, n) for i, n in v if h[i] == value]
            used += sum(n for _, n in group)
            if used > left:
                break
            chosen |= {i for i, _ in group}
        out |= {(i, s): passes + (i in chosen and left > 0) for i, _ in v}
    return out


@pytest.mark.parametrize("how", [{"repeats": 2.0}, {"entropy": 1.5, "repeats": None}, {"repeats": 3.0, "budget": 9000.0},
                                 {"entropy": 0.3, "repeats": None, "budget": 4000.0}])
def test_against_a_running_sum(spark, how):
    docs, rows = corpus(spark)
    docs = docs.withColumn("mix_pass", F.lit("clash")).withColumn("passes", F.lit(1))
    tokens = mixing.token_table(docs)
    sources = mixing.plan(tokens, **{"entropy": None, "budget": None, **how}).collect()
    total = sum(r.tokens for r in sources)
    weight = {r.source: r.weight for r in sources}
    assert abs(sum(weight.values()) - 1) < 1e-9
    real = {s: w for s, w in weight.items() if w}
    if "entropy" in how:
        assert abs(-sum(w * math.log(w) for w in real.values()) - how["entropy"]) < 1e-4
    p = {r.source: r.tokens / total for r in sources}
    a = (math.log(real["a"]) - math.log(real["f"])) / (math.log(p["a"]) - math.log(p["f"]))
    amount = how.get("budget") or max(p[s] / w for s, w in real.items()) * total
    if how.get("repeats"):
        assert max(w * amount / (p[s] * total) for s, w in real.items()) <= how["repeats"] + 1e-6
    got = {}
    for r in mixing.mixture(docs, **{"entropy": None, "budget": None, **how}).collect():
        got[r.doc_id, r.source] = got.get((r.doc_id, r.source), 0) + 1
    want = brute(spark, rows, a, amount)
    repeated = (rows[5][0], rows[5][2])
    assert got.pop(repeated, 0) == 2 * want.pop(repeated)
    assert got == {k: n for k, n in want.items() if n}


def test_whole_table(spark):
    docs = table(spark, SF_DIR, "documents")
    rows = mixing.mixture(docs).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.select("doc_id").collect()}  # everything is read once at least
    assert max(r.mix_pass for r in rows) <= 1 and len(rows) > docs.count()
    assert all(0 <= r.mix_block < 4096 for r in rows)


def test_edges(spark):
    docs, _ = corpus(spark)
    assert mixing.mixture(docs.limit(0)).count() == 0
    assert mixing.mixture(docs.where("text is null or text = ''")).count() > 0
    one = docs.where("source = 'a'")
    assert mixing.mixture(one).count() == one.count()
