import random

import pytest
from pyspark.sql import functions as F

from tenderlens.llm import lines

SPACES = " \t\n\x0b\x0c\r"


def brute(rows, min_chars=10):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(SPACES))
    rank = lambda d: 2**63 - 1 if d is None else d
    first = {}
    for d, text in rows:
        for line in (text or "").split("\n"):
            first[key(line)] = min(first.get(key(line), rank(d)), rank(d))
    out = []
    for d, text in rows:
        all_ = (text or "").split("\n")
        kept = [x for x in all_ if len(key(x)) < min_chars or first[key(x)] == rank(d)]
        out.append((d, len(all_), len(all_) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def got(df):
    return sorted([(r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in df.collect()], key=str)


def frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return df.withColumns({c: F.lit("x") for c in ("d", "print", "lines", "h", "g", "pos", "batch", "gone")})


POOL = ["Common line of words", " common LINE of words\t", "ünïcödé läng", "ÜNÏCÖDÉ LÄNG", "123456789", "1234567890", "", "  ", "\r",
        "\x0b1234567890\x0c", " 1234567890", " 1234567890", "short"]


@pytest.mark.parametrize("batches, fan", [(5, 2), (12, 3)])
def test_against_brute_force(spark, batches, fan):
    rng = random.Random(batches)
    rows = [(i * 3, "\n".join(rng.choice([*POOL, f"line number {rng.randrange(90)}"]) for _ in range(rng.randrange(12)))) for i in range(150)]
    rng.shuffle(rows)
    rows += [(9, rows[0][1]), (9, rows[0][1]), (9, None), (None, "line number 3\nnobody else has this"), (None, rows[1][1]),
             (400, ""), (401, "\n"), (402, None), (-5, "line number 7")]
    assert got(lines.without_repeated_lines(frame(spark, rows), batches=batches, fan=fan)) == brute(rows)


def test_one_line_in_a_third_of_all_rows_and_a_long_text(spark):
    long = "\n".join(f"this is line {i % 30000} of many" for i in range(60000))
    rows = [(i, "the very same line everywhere\nown line " + "x" * i) for i in range(300)] + [(1000, long), (1001, long), (999, "this is line 5 of many")]
    assert got(lines.without_repeated_lines(frame(spark, rows))) == brute(rows)


def test_runs_are_disjoint_and_compacted(spark):
    runs = lines.LineRuns(spark, fan=2)
    seen = set()
    for b in range(7):
        keys = spark.range(b * 5, b * 5 + 10).select(F.col("id").alias("h"), F.col("id").alias("g"), F.lit(b).alias("first"))
        new = {r.h for r in runs.add(keys).collect()}
        assert new == set(range(b * 5, b * 5 + 10)) - seen
        seen |= new
        assert sum(map(len, runs.levels)) <= 3
    assert sorted(r.h for n in runs.runs() for r in spark.table(n).collect()) == sorted(seen)
    plan = runs.unseen(spark.range(9).selectExpr("id h", "id g", "1 first").groupBy("h", "g").agg(F.min("first").alias("first")))
    text = plan._jdf.queryExecution().executedPlan().toString()
    # One shuffle, that of the batch's own keys: runs are merged where they lie.
    assert text.count("SortMergeJoin") == len(runs.runs()) and text.count("Exchange hashpartitioning") == 1
    runs.close()
    assert runs.runs() == []


def test_no_python_and_no_rows(spark):
    df = lines.digests(lines.without_repeated_lines(frame(spark, [(1, "a"), (2, "b")])))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    assert lines.without_repeated_lines(frame(spark, [])).count() == 0
