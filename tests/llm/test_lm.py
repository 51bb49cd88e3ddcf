import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_DIR
from tenderlens.llm import lm
from tenderlens.llm.storage import table

LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), None]


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def brute(rows, order, mass):
    counts = [Counter() for _ in range(order + 1)]
    for i, text in rows:
        if not held(i):
            t = words(text)
            for k in range(1, order + 1):
                counts[k].update(tuple(t[a: a + k]) for a in range(len(t) - k + 1))
    n, v = sum(counts[1].values()), len(counts[1])

    def p(gram):
        if len(gram) == 1:
            return (counts[1][gram] + 1) / (n + v + 1)
        k = len(gram)
        return (counts[k][gram] + mass * p(gram[1:])) / (counts[k - 1][gram[:-1]] + mass)

    out = []
    for i, text in rows:
        t = words(text)
        base = sum(math.log10((counts[1][(w,)] + 1) / (n + v + 1)) for w in t)
        score = sum(math.log10(p(tuple(t[max(0, a - order + 1): a + 1]))) for a in range(len(t)))
        out.append((i, held(i), len(t), sum(counts[1][(w,)] > 0 for w in t), n, round(base, 6), round(score, 6)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6))
                   for r in df.collect()), key=str)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_small(spark, order):
    rng = np.random.default_rng(order)
    rows = [(int(i), " ".join("abcdeF"[c] for c in rng.integers(0, 6, rng.integers(0, 300)))) for i in range(40)]
    rows += [(1, "a\tB a"), (1, "a\tB a"), (None, "a b"), (50, None), (51, ""), (52, "zz " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("block", F.lit("x")).withColumn("held", F.lit(0))
    assert got(lm.score(docs, order=order, mass=5.0, block_bytes=1000)) == brute(rows, order, 5.0)
    assert lm.score(docs.limit(0)).count() == 0


def test_whole_table_beats_the_base_on_held_out(spark):
    docs = table(spark, SF_DIR, "documents")
    result = lm.score(docs, block_bytes=1 << 16)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    mine = got(result)
    assert mine == brute(rows, lm.ORDER, lm.MASS)
    unseen = [r for r in mine if r[1]]
    assert sum(r[6] for r in unseen) > sum(r[5] for r in unseen)
