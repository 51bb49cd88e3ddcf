"""Language-model scoring with a weighted backoff automaton.

Counts of k-grams (k = 1 .. order) over all training documents are Dirichlet-
smoothed towards the next shorter context:

    P(w)      = (c(w) + 1) / (N + V + 1)
    P(w | u)  = (c(u w) + m P(w | u')) / (c(u) + m)        u' = u without its first token

The model is an automaton: a state for each context seen in training, an arc
(state, word) for each seen k-gram with its log10 probability, and a failure arc
from each state to the next shorter one with weight log10(m / (c(u) + m)).  The
root has an arc for every word, unknown ones included.  A text is one
left-to-right traversal that carries the state: it follows failure arcs until
an arc with the next word exists, and adds up the weights.

The whole automaton may be of any size, so no task holds it.  Documents are
dealt into blocks of bounded size; each block gets the counts of its own
k-grams (``blockcounts``) and builds the part of the automaton that its texts can
reach.  Scores equal those of the whole automaton.  Tokens are 64-bit hashes
of the lower-cased words; a state depends on the last ``order - 1`` tokens only, so
long texts are traversed as segments that start ``order - 1`` tokens early.

Defined results: a null text is empty; an empty text has one token, its end.
A null id counts as the empty text in the split.  Repeated rows count and are
scored each.  Extra columns are not read; an empty table gives no rows; without
training documents N and V are 0 and every token has probability 1.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlens.llm import blockcounts, textscan
from tenderlens.llm.storage import block_count, block_of, text_bytes

ORDER, MASS = 2, 300.0
SEGMENT = 64
SLICE_BYTES = 1 << 19
END = np.uint64(0x5851F42D4C957F2D)  # the end of a text; no word is empty, so no word's bytes stand for it


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


@dataclass
class Tokens:
    hash: np.ndarray
    doc: np.ndarray
    first: np.ndarray  # index of each text's first token


def tokens(texts: pa.ChunkedArray | pa.Array) -> Tokens:
    """Words of every text, each text followed by its end."""
    hashes, counts = [], []
    for words in textscan.scan_parts(texts, SLICE_BYTES):
        count = np.diff(words.first) + 1
        out = np.full(count.sum(), END, np.uint64)
        ends = np.cumsum(count) - 1
        is_word = np.ones(len(out), bool)
        is_word[ends] = False
        out[is_word] = words.hash
        hashes.append(out)
        counts.append(count)
    if not counts:
        return Tokens(np.empty(0, np.uint64), np.empty(0, np.int64), np.zeros(1, np.int64))
    count = np.concatenate(counts)
    return Tokens(np.concatenate(hashes), np.repeat(np.arange(len(count)), count), np.concatenate([[0], np.cumsum(count)]))


def grams(t: Tokens, order: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For k = 1 .. order: distinct k-grams, the place of each token's k-gram among them (-1: none), one last token of each."""
    out, h = [], t.hash
    at = np.arange(len(h))
    for k in range(1, order + 1):
        if k > 1:
            h = h.copy()
            h[1:] = textscan.mix(previous[:-1] * np.uint64(0xD6E8FEB86659FD93) + t.hash[1:])
            at = np.flatnonzero(np.arange(len(t.hash)) - t.first[t.doc] >= k - 1)
        distinct, inverse = np.unique(h[at], return_inverse=True)
        place = np.full(len(t.hash), -1, np.int32)
        place[at] = inverse
        last = np.empty(len(distinct), np.int64)
        last[inverse] = at
        out.append((distinct, place, last))
        previous = h
    return out


@dataclass
class Automaton:
    """States are numbered; arcs are sorted keys ``state * words + word``."""

    words: int
    key: np.ndarray
    weight: np.ndarray
    target: np.ndarray
    fail_weight: np.ndarray  # by state; the root has none
    fail_target: np.ndarray

    def advance(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of many traversals: log10 probability and next state of each."""
        total = np.zeros(len(state))
        after = np.empty(len(state), np.int64)
        open_, state = np.arange(len(state)), state.copy()
        while len(open_):
            wanted = state[open_] * self.words + word[open_]
            arc = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
            there = self.key[arc] == wanted
            done = open_[there]
            total[done] += self.weight[arc[there]]
            after[done] = self.target[arc[there]]
            open_ = open_[~there]
            total[open_] += self.fail_weight[state[open_]]
            state[open_] = self.fail_target[state[open_]]
        return total, after


def automaton(levels: list, counts: list[np.ndarray], n: int, v: int, mass: float) -> Automaton:
    """The automaton over the k-grams of ``levels`` with their training counts."""
    order, words = len(levels), max(1, len(levels[0][0]))
    base = np.concatenate([[1], 1 + np.cumsum([len(x[0]) for x in levels[:-1]])]).astype(np.int64)  # first state of a level
    states = int(base[order - 1]) if order > 1 else 1
    fail_weight, fail_target = np.zeros(states), np.zeros(states, np.int64)
    probability = (counts[0] + 1) / (n + v + 1)
    known = counts[0] > 0
    to = np.where(known, base[0] + np.arange(words), 0) if order > 1 and len(known) else np.zeros(len(known), np.int64)
    keys, weights, targets = [np.arange(len(known))], [np.log10(probability)], [to]
    for k in range(1, order):
        gram, place, last = levels[k]
        context = levels[k - 1][1][last - 1]
        lower_place = levels[k - 1][1][last]
        own = counts[k - 1]
        size = len(levels[k - 1][0])
        fail_weight[base[k - 1]: base[k - 1] + size] = np.log10(mass / (own + mass))
        if k > 1:
            fail_target[base[k - 1]: base[k - 1] + size] = base[k - 2] + levels[k - 2][1][levels[k - 1][2]]
        probability = (counts[k] + mass * probability[lower_place]) / (own[context] + mass)
        seen = np.flatnonzero(counts[k] > 0)
        keys.append((base[k - 1] + context[seen]) * words + levels[0][1][last[seen]])
        weights.append(np.log10(probability[seen]))
        targets.append(base[k] + seen if k < order - 1 else base[k - 1] + lower_place[seen])
    key = np.concatenate(keys)
    rank = np.argsort(key)
    return Automaton(words, key[rank], np.concatenate(weights)[rank], np.concatenate(targets)[rank], fail_weight, fail_target)


def traverse(machine: Automaton, word: np.ndarray, t: Tokens, order: int) -> np.ndarray:
    """Log10 probability of every text: all segments of all texts advance together, token by token."""
    length = np.diff(t.first)
    pieces = -(-length // SEGMENT)
    doc = np.repeat(np.arange(len(length)), pieces)
    start = t.first[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * SEGMENT
    end = np.minimum(start + SEGMENT, t.first[doc + 1])
    at = np.maximum(start - (order - 1), t.first[doc])
    state = np.zeros(len(doc), np.int64)
    score = np.zeros(len(doc))
    alive = np.arange(len(doc))
    while len(alive):
        weight, state[alive] = machine.advance(state[alive], word[at[alive]])
        score[alive] += np.where(at[alive] >= start[alive], weight, 0.0)
        at[alive] += 1
        alive = alive[at[alive] < end[alive]]
    return np.bincount(doc, weights=score, minlength=len(length))


def score(docs: DataFrame, order: int = ORDER, mass: float = MASS, block_bytes: int = blockcounts.BLOCK_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document."""
    rows = docs.select(F.col("doc_id").alias("_id"), F.col("text").cast("string").alias("_text"))
    n_bytes = text_bytes(rows, "_text")
    blocks, bits = block_count(n_bytes, block_bytes), blockcounts.part_bits(n_bytes, block_bytes)
    dealt = rows.select(
        block_of(blocks, "_id", "_text").alias("block"), "_id", held_out(F.col("_id")).alias("held"), "_text"
    ).repartition(blocks, "block")
    id_type = rows.schema["_id"].dataType.simpleString()

    def kinds_of(table: pa.Table) -> list:
        t = tokens(table["_text"])
        learnt = ~table["held"].to_numpy()
        kinds = []
        for distinct, place, _ in grams(t, order):
            counts = np.bincount(place[learnt[t.doc] & (place >= 0)], minlength=len(distinct))
            kinds.append((distinct, counts))
        return kinds

    answers = blockcounts.counted(dealt, kinds_of, bits, everywhere=True)

    def judge(group: tuple, texts: pa.Table, told: pa.Table) -> pa.Table:
        t = tokens(texts["_text"])
        levels = grams(t, order)
        counts = blockcounts.totals_of([x[0] for x in levels], told, bits)
        first_kind = told["part"].to_numpy() < (1 << bits)
        n = int(told["part_total"].to_numpy()[first_kind].sum())
        v = int(told["part_distinct"].to_numpy()[first_kind].sum())
        machine = automaton(levels, counts, n, v, mass)
        docs_ = len(t.first) - 1
        own = counts[0][levels[0][1]]
        return pa.table({
            "doc_id": texts["_id"],
            "held_out": texts["held"],
            "n_tokens": pa.array(np.diff(t.first), pa.int64()),
            "n_known": pa.array(np.bincount(t.doc, weights=own > 0, minlength=docs_).astype(np.int64)),
            "train_tokens": pa.array(np.full(docs_, n), pa.int64()),
            "base_score": pa.array(np.bincount(t.doc, weights=np.log10((own + 1) / (n + v + 1)), minlength=docs_)),
            "score": pa.array(traverse(machine, levels[0][1], t, order)),
        })

    schema = (
        f"doc_id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, "
        "score double"
    )
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(judge, schema)
