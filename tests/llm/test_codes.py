import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_DIR
from tenderlens.llm import codes
from tenderlens.llm.storage import table


def brute(rows, parts=4, entries=256, rounds=4):
    """All distances, in Python integers and numpy's whole numbers."""
    kept = [r for r in rows if r[2] is not None and all(x is not None and math.isfinite(x) for x in r[2])]
    fits = [r for r in kept if r[2] and len(r[2]) % parts == 0]
    fits.sort(key=lambda r: (r[0] is None, r[0] or 0, [math.floor(1024 * x) for x in r[2]]))
    size = len(fits[0][2]) if fits else 0
    fits = [r for r in fits if len(r[2]) == size]
    q = np.array([[math.floor(1024 * x) for x in r[2]] for r in fits], np.int64).reshape(len(fits), -1)
    xs = np.split(q, parts, axis=1) if fits else []
    books = [x[:entries].copy() for x in xs]
    near = lambda x, b: ((x[:, None, :] - b[None]) ** 2).sum(2)
    for _ in range(rounds):
        for p, x in enumerate(xs):
            code = near(x, books[p]).argmin(1)
            for e in range(len(books[p])):
                if (code == e).any():
                    books[p][e] = x[code == e].sum(0) // (code == e).sum()
    digest = hashlib.sha256(",".join(str(v) for b in books for v in b.reshape(-1).tolist()).encode()).hexdigest()
    d = [near(x, b) for x, b in zip(xs, books)]
    out = [(r[0], r[1], "".join(f"{int(m[i].argmin()):02x}" for m in d), int(sum(m[i].min() for m in d))) for i, r in enumerate(fits)]
    lost = [(r[0], r[1], None, None) for r in kept if len(r[2]) != size or not size]
    total = {}
    for _, label, _, e in out:
        total[label] = total.get(label, 0) + e
    return sorted([(i, c, e, total.get(label), digest) for i, label, c, e in out + lost], key=str)


def got(df):
    return sorted([(r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect()], key=str)


def frame(spark, rows):
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>")
    return df.withColumns({"q": F.lit("x"), "codes": F.lit(1), "entry": F.lit(2), "error": F.lit(3)})


@pytest.mark.parametrize("entries, spread", [(256, 0.02), (20, 0.02), (7, 1.0)])
def test_against_all_distances(spark, entries, spread, monkeypatch):
    monkeypatch.setattr(codes, "BLOCK_ROWS", 100)
    rng = np.random.default_rng(entries)
    middle = rng.standard_normal((12, 16))
    rows = [(i, int(rng.integers(3)) or None, [float(np.float32(x)) for x in middle[i % 12] + spread * rng.standard_normal(16)])
            for i in range(400)]
    rows += [(i, 5, rows[3][2]) for i in range(500, 530)] + [(3, 5, rows[9][2]), (3, 5, rows[9][2]), (None, 5, rows[11][2])]
    rows += [(900, 1, None), (901, 1, [None] * 16), (902, 1, [float("nan")] * 16), (903, 1, [float("-inf")] * 16),
             (904, 1, []), (905, 9, [1.0] * 12), (906, 1, [1.0] * 15)]
    assert got(codes.compress(frame(spark, rows), entries=entries)) == brute(rows, entries=entries)


def test_components_out_of_range_keep_their_row(spark):
    rows = [(0, 1, [1e30] * 8), (1, 1, [0.5] * 8), (2, 1, [100000.0] * 8), (3, 1, [-0.0001] * 8)]
    found = {r[0]: r for r in got(codes.compress(frame(spark, rows)))}
    assert found[0][1:4] == (None, None, 0) and found[3][1] == "02020202" and found[2][1] == "01010101"


def test_few_and_no_rows(spark):
    one = [(4, None, [0.25, -0.25, 0.0, 1.0])]
    assert got(codes.compress(frame(spark, one))) == brute(one)
    assert codes.compress(frame(spark, [])).count() == 0
    lost = [(1, 2, []), (2, 2, None)]
    assert [r[:4] for r in got(codes.compress(frame(spark, lost)))] == [(1, None, None, None)]


def test_balls_skip_work():
    rng = np.random.default_rng(1)
    middle = 40000 * rng.standard_normal((64, 4))
    x = np.floor(np.repeat(middle, 50, 0) + 100 * rng.standard_normal((3200, 4))).astype(np.int64)
    book = codes.Book(np.floor(middle + 50).astype(np.int64))
    right, d = book.nearest(x)
    held = right.copy()
    held[::40] = (held[::40] + 1) % 64
    code, best, work = book.moved(x, held)
    assert (code == right).all() and (best == d).all()
    assert work < 0.05 * 64 * len(x)


def test_ties_go_to_the_lower_index():
    book = codes.Book(np.array([[4], [0], [4], [8], [0]], np.int64))
    x = np.array([[2], [4], [6], [0]], np.int64)
    for held in range(5):
        code, best, _ = book.moved(x, np.full(4, held))
        assert code.tolist() == [0, 0, 0, 1] and best.tolist() == [4, 0, 4, 0]


def test_whole_table(spark):
    vectors = table(spark, SF_DIR, "embeddings")
    rows = [(r.vec_id, r.label, r.embedding) for r in vectors.collect()]
    assert got(codes.compress(vectors)) == brute(rows)
