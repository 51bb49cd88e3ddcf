import re
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import SF_DIR
from tenderlens.llm import quality, textscan
from tenderlens.llm.storage import table

WORD = r"[^\x20\x09-\x0D]+"


def counts(text):
    words = re.findall(WORD, text or "")
    windows = [tuple(words[i: i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if re.search(WORD, line):
            again += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), again, len(covered))


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n\t#\r\x0b%", max_size=60)), min_size=1, max_size=5))
def test_counts(texts):
    found = quality.text_counts(textscan.scan(pa.array(texts, pa.string()), lower=False))
    assert list(zip(*(found[n].tolist() for n in NAMES))) == [counts(t) for t in texts]


def test_whole_table_and_accuracy(spark):
    sf = SF_DIR.replace("sf0.001", "sf0.01")
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2
    model = quality.train(docs, labels.where(fold == 0))
    got = quality.judge(docs, model).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(got) == len(texts)
    for r in got:
        n = counts(texts[r.doc_id])
        assert tuple(r[x] for x in NAMES) == n
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert not (r.kept and r.base_failed)
    verdict = {r.doc_id: r for r in got}
    held = [r for r in labels.where(fold == 1).collect() if not verdict[r.doc_id].base_failed]
    assert np.mean([verdict[r.doc_id].kept == (r.quality == 1) for r in held]) > 0.93


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "a"), (2, ""), (3, "word " * 70_000)], "doc_id bigint, text string")
    docs = docs.withColumn("score", F.lit("x")).withColumn("_id", F.lit(1))
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert quality.train(docs, none) is None
    got = quality.judge(docs, None).collect()
    assert len(got) == 5 and all(r.base_failed and not r.kept for r in got)
    assert quality.judge(docs.limit(0), None).count() == 0
    odd = spark.createDataFrame([(1, None), (None, 1), (3, 1), (3, 0)], "doc_id bigint, quality int")
    assert quality.train(docs, odd) is None


def test_sample_size():
    assert quality.SAMPLE == 3000


def test_one_row_for_each_sampled_id(spark, monkeypatch):
    rows = [(1, f"good words number {k}") for k in range(200)] + [(2, "bad # text"), (3, "other good words"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 0)], "doc_id bigint, quality int")
    sizes = []
    monkeypatch.setattr(quality, "fit", lambda shares, good, *rest: sizes.append(len(good)))
    quality.train(docs, labels)
    assert sizes == [4]
