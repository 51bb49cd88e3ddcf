import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tenderlens.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
CODEC = bpe.Codec(bpe.read_vocabulary(PATH))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_same_as_the_library(text):
    expected = LIBRARY.encode(text, add_special_tokens=False).ids
    assert CODEC.encode(text).tolist() == expected
    assert CODEC.decode(np.array(expected, np.int32)) == LIBRARY.decode(expected, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["a<|endoftext|>b", "<|endoftext|>", "  \n  x", "x" * 5000, "\x1c\x85 　 1²3", "aaaa" * 40])
def test_edges(text):
    assert CODEC.encode(text).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_broken_utf8_decodes_as_the_library_does():
    ids = LIBRARY.encode("日本é", add_special_tokens=False).ids
    for cut in range(len(ids)):
        part = ids[cut:] + ids[:1]
        assert CODEC.decode(np.array(part, np.int32)) == LIBRARY.decode(part, skip_special_tokens=False)


def test_rows(spark):
    long = "word " * 60_000
    rows = [(1, "Hello world"), (2, None), (3, ""), (None, "x"), (1, "Hello world"), (4, long)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("ids", F.lit("clash")).withColumn("_id", F.lit(0))
    got = bpe.digests(bpe.decode(bpe.encode(docs, PATH), PATH)).collect()
    assert sorted(map(str, got)) == sorted(map(str, bpe.digests(bpe.round_trip(docs, PATH)).collect()))
    want = []
    for i, t in rows:
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert bpe.digests(bpe.decode(bpe.encode(docs.limit(0), PATH), PATH)).count() == 0
    assert bpe.round_trip(docs.limit(0), PATH).count() == 0
