"""The pipeline's stages against plain versions, each on its own input."""

import hashlib

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from conftest import SF_DIR
from tenderlens.llm import jaccard, langid, quality
from tenderlens.llm.storage import stored, table
from test_jaccard import brute
from test_quality import counts

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_stages(spark):
    docs = table(spark, SF_DIR, "documents")
    inputs = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        inputs.append(stored(stage(spark, inputs[-1], SF_DIR), f"test-{k}"))
        if k < 4:
            assert inputs[-1].dtypes == docs.dtypes
    rows = [{r.doc_id: r for r in x.collect()} for x in inputs[:5]]

    judged = quality.judge(docs, quality.train(docs, table(spark, SF_DIR, "labels"))).where("kept").collect()
    assert set(rows[1]) == {r.doc_id for r in judged}
    for i, r in rows[0].items():
        n = counts(r.text)
        if n[0] < 50 or 100 * n[4] > 50 * n[0]:
            assert i not in rows[1]

    named = langid.identify(inputs[1], langid.train(inputs[1])).collect()
    assert set(rows[2]) == {r.doc_id for r in named if r.score >= 0.35}
    assert len(rows[2]) >= 0.99 * len(rows[1])

    want = brute([(r.doc_id, r.text) for r in rows[2].values()], jaccard.Rule(5, 80, 100))
    assert set(rows[3]) == {d for d, _, c in want if d == c}

    assert set(rows[4]) == set(rows[3])
    last = inputs[5].collect()
    assert len(last) == inputs[4].count()
    for r in last:
        ids = LIBRARY.encode(rows[4][r.doc_id].text, add_special_tokens=False).ids
        assert list(r.ids) == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_empty_and_odd_rows(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    odd = spark.createDataFrame([(1, None, None, None, None), (None, "", "en", "s", 0), (2, "a b c", "en", None, 5), (2, "a b c", "en", None, 5)], none.schema)
    for docs in (none, odd):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs, SF_DIR).collect()
    kept = corpus_pipeline.near_duplicates(spark, odd, SF_DIR).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "2", "None"]


def test_near_duplicates_by_row(spark):
    def words(k):
        return " ".join(f"t{k}w{i}" for i in range(60))

    rows = [
        (1, words(1), "a"), (1, words(2), "a"),  # two texts of one id: both stay
        (2, words(1) + " more", "b"), (2, words(3), "b"),  # one of them is a near copy of id 1
        (3, words(4), "d"), (3, words(4), "c"),  # the same row twice
        (None, words(5), "e"), (None, words(5) + " more", "f"), (None, words(1), "g"), (None, words(6), "h"),
    ]
    docs = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = sorted((str(r.doc_id), r.text.split()[0], r.source) for r in corpus_pipeline.near_duplicates(spark, docs, SF_DIR).collect())
    five = [r for r in got if r[1] == "t5w0"]
    assert len(five) == 1 and five[0][0] == "None"
    assert [r for r in got if r[1] != "t5w0"] == [
        ("1", "t1w0", "a"), ("1", "t2w0", "a"), ("2", "t3w0", "b"), ("3", "t4w0", "c"), ("None", "t6w0", "h")]


def test_near_duplicates_keep_extra_columns(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame(
        [(1, text, "mine", {"a": 1}), (2, text + " more", "b", None), (3, "other words entirely", "c", {}), (3, "other words entirely", "a", {"x": 2})],
        "doc_id bigint, text string, _key string, extra map<string,int>")
    got = corpus_pipeline.near_duplicates(spark, docs, SF_DIR)
    assert got.dtypes == docs.dtypes
    assert sorted((r.doc_id, r["_key"], r.extra) for r in got.collect()) == [(1, "mine", {"a": 1}), (3, "a", {"x": 2})]
