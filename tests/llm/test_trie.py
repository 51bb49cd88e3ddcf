import hashlib
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tenderlens.llm import trie


def rebuilt(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in convs.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:]
    return out


def brute(convs):
    members = {}
    for c, seq in convs.items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
    out = []
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        kids = lambda q: sum(len(r) == len(q) + 1 and r[: len(q)] == q for r in below)
        ends = sorted(c for c in m if len(convs[c]) == len(p))
        out.append((
            min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids(p), sum(kids(q) == 0 for q in below),
            sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def got(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted([tuple(r[c] for c in names) for r in df.collect()], key=str)


def frame(spark, rows):
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    return df.withColumns({c: F.lit("x") for c in ("codes", "chars", "place", "h", "g", "base", "head", "n", "first", "key")})


def sample(n, seed):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "bb", "ccc", "", "ü" * 4]))
            for c in range(n) for t in range(rng.randrange(1, 7))]


@pytest.mark.parametrize("shard", [3, 100_000])
def test_against_brute_force(spark, shard, monkeypatch):
    monkeypatch.setattr(trie, "SHARD_TURNS", shard)
    monkeypatch.setattr(trie, "LEAST_SHARD_TURNS", shard)
    monkeypatch.setattr(trie, "PACKED", 10)
    rows = [r for r in sample(330, shard) if r[0] != 200]
    rows += [(5, None, "user", "first"), (5, None, None, None), (6, 0, None, "tie"), (6, 0, None, "tie"), (7, 1, "user", None),
             (None, 1, "user", "nobody"), (-7, 0, "user", "below"), (1000, 0, "user", "alone"), (1001, 0, "user", "too short")]
    assert got(trie.prefix_nodes(trie.forked(trie.encoded(frame(spark, rows))))) == brute(rebuilt(rows))


def test_one_sequence_in_a_third_of_all_conversations(spark, monkeypatch):
    monkeypatch.setattr(trie, "SHARD_TURNS", 20)
    monkeypatch.setattr(trie, "LEAST_SHARD_TURNS", 20)
    rows = [(c, t, "user", f"same {t}") for c in range(200, 260) for t in range(4)] + sample(100, 1)
    assert got(trie.prefix_nodes(trie.forked(trie.encoded(frame(spark, rows))))) == brute(rebuilt(rows))


def test_long_conversations_and_texts(spark):
    rows = [(c, t, "user", "z" * 200_000 if t == 50 else str(t)) for c in (0, 1, 2) for t in range(150 + c)]
    assert got(trie.prefix_nodes(trie.forked(trie.encoded(frame(spark, rows))))) == brute(rebuilt(rows))


def test_a_very_long_conversation_is_no_recursion():
    n = 30_000
    found = trie.shard_nodes([(list(range(n)), [1] * n, 2, 0, None)])
    assert len(found) == n + 1 and found[0][5] == 2


def test_the_tree_is_balanced():
    rows = [([c], [1], 1, c, None) for c in range(4096)]
    tree, _ = trie.build(rows)
    assert tree.compared < 12 * 4096


def test_no_rows(spark):
    assert got(trie.prefix_nodes(trie.forked(trie.encoded(frame(spark, []))))) == []
    assert got(trie.prefix_nodes(trie.forked(trie.encoded(frame(spark, [(None, 1, "user", "x")]))))) == []
