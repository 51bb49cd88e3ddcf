import zlib

import numpy as np
from pyspark.sql import functions as F

from conftest import SF_DIR
from tenderlens.llm import langid
from tenderlens.llm.storage import table


def test_gradients():
    rng = np.random.default_rng(0)
    net = langid.Network.new(["a", "b", "c"], rng, 5)
    for d in (net.forward, net.backward):
        d.table, d.gates, d.candidate = (w.astype(float) for w in (d.table, d.gates, d.candidate))
    net.out, net.bias = net.out.astype(float), net.bias.astype(float)
    rows = rng.integers(0, 256, (9, 4)).astype(np.int16)
    rows[6:, 1] = langid.PAD
    label = np.array([0, 1, 2, 1])
    _, slopes = net.step(rows, label)
    for w, g in zip(net.weights(), slopes):
        for _ in range(5):
            at = (int(rows[0, rng.integers(4)]), int(rng.integers(w.shape[1]))) if len(w) == 257 else tuple(rng.integers(s) for s in w.shape)
            w[at] += 1e-4
            up = net.step(rows, label)[0]
            w[at] -= 2e-4
            down = net.step(rows, label)[0]
            w[at] += 1e-4
            assert abs((up - down) / 2e-4 - g[at]) < 1e-4


def test_held_out_accuracy(spark):
    docs = table(spark, SF_DIR.replace("sf0.001", "sf0.01"), "documents")
    got = langid.identify(docs, langid.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_edges(spark):
    rows = [(1, None, "en"), (2, "", "de"), (3, "123 %%", "en"), (None, "the and of", None), (5, "ein " * 30_000, "de"), (5, "ñ", "es")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("score", F.lit(0)).withColumn("_text", F.lit(0))
    assert {r.lang_pred for r in langid.identify(docs, None).collect()} == {"und"}
    got = langid.identify(docs, langid.train(docs)).collect()
    by = {(r.doc_id, r.lang_pred == "und") for r in got}
    assert {(1, True), (2, True), (3, True), (None, False), (5, False)} == by
    assert langid.identify(docs.limit(0), None).count() == 0
    assert langid.train(docs.limit(0)) is None


def test_one_row_for_each_sampled_id(spark, monkeypatch):
    ids = [r.id for r in spark.range(100).where(~langid.held_out(F.col("id"))).limit(2).collect()]
    rows = [(ids[0], f"some words number {k} " + "abc " * 400, "en") for k in range(200)] + [(ids[1], "andere worte", "de")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    seen = []
    monkeypatch.setattr(langid, "fit", lambda values, label, languages: seen.append((len(label), languages)))
    langid.train(docs)
    assert seen[0][1] == ["de", "en"] and seen[0][0] <= 2 * langid.PER_DOC


def test_a_rare_language_is_drawn(spark):
    rows = [(i, "xx" if i == 777 else "en" if i % 2 else "de") for i in range(3000)] + [(5, "en")] * 500
    got = {r._id for r in langid._drawn(spark.createDataFrame(rows, "_id bigint, lang string"), 90).collect()}
    assert 777 in got and len(got) == 61
    many = [(i, f"l{i % 300}") for i in range(6000)]
    assert len(langid._drawn(spark.createDataFrame(many, "_id bigint, lang string"), 90).collect()) == 300 * langid.LEAST


def test_more_languages_than_a_batch_has_rows():
    languages = [f"l{k}" for k in range(300)]
    values = np.full((600, langid.WINDOW), langid.PAD, np.int16)
    values[:, :8] = np.random.default_rng(0).integers(97, 123, (600, 8))
    net = langid.fit(values, np.arange(600) % 300, languages, steps=3)
    start = langid.Network.new(languages, np.random.default_rng(3))
    assert (net.bias != start.bias).sum() == 300
