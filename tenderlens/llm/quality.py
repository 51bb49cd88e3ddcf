"""Quality rules: base rules on counts, then a calibrated n-gram classifier.

Base rules per text (words ``[^\\x20\\x09-\\x0D]+``, case kept): a text fails
with fewer than 50 words, or when more than half of its words lie in three-word
windows that occur twice or more in it.

The classifier is a logistic regression over hashed word n-grams (1 and 2) and
character n-grams (1, 3 and 5 UTF-8 bytes); the features of a kind are their
shares among all of that kind in the text, so the length of a text does not matter.
It is trained on a bounded sample of labelled documents (``SAMPLE`` rows, the
lowest hashes of the document id, one text of each id), with every class weighted equally, and
calibrated by Platt scaling on a fifth of the sample that training leaves out.
Features are made in tasks; the driver sees at most SAMPLE x 2 x BUCKETS
numbers.  Scoring is one pass over the texts without a shuffle.

Defined results: a null text has no words and fails.  Empty tables give no
rows; without labels of both classes the verdict is that of the base rules.
Labels that are null are ignored; several labels of a document are averaged,
a tie counts as good.  Repeated rows are judged each; extra columns are kept out
of the way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderlens.llm import textscan

SAMPLE = 3000
BUCKETS = 1 << 15  # for words and for characters each
KEEP_FROM = 0.3
MIN_WORDS = 50
SLICE_BYTES = 1 << 19

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def text_counts(words: textscan.Words) -> dict[str, np.ndarray]:
    """The five counts of each text."""
    data, offsets, n = words.data, words.offsets, words.n_texts
    count = np.bincount(words.doc, minlength=n)
    running = np.concatenate([[0], np.cumsum(~textscan.is_space(data) & ((data & 0xC0) != 0x80))])
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
    return {
        "n_words": count,
        "word_chars": running[offsets[1:]] - running[offsets[:-1]],
        "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]],
        "n_dup_lines": _duplicate_lines(words),
        "n_repeat_words": _repeated_words(words),
    }


def _again(keys: np.ndarray) -> np.ndarray:
    """True for every key that occurs twice or more."""
    order = np.argsort(keys)
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(keys), bool)
    twice[1:] |= same
    twice[:-1] |= same
    out = np.empty(len(keys), bool)
    out[order] = twice
    return out


def _repeated_words(words: textscan.Words) -> np.ndarray:
    h, doc, at = textscan.windows_at(words, 3)
    repeated = at[_again(textscan.within(h, doc))]
    covered = np.zeros(len(words.hash), bool)
    for i in range(3):
        covered[repeated + i] = True
    return np.bincount(words.doc[covered], minlength=words.n_texts)


def _duplicate_lines(words: textscan.Words) -> np.ndarray:
    data, offsets = words.data, words.offsets
    breaks = np.flatnonzero(data == 10)
    start = np.union1d(offsets[:-1], breaks + 1)
    start = start[start < len(data)]
    doc = np.searchsorted(offsets, start, side="right") - 1
    end = np.append(start[1:] - 1, len(data))
    end = np.where(np.append(doc[1:] != doc[:-1], True), offsets[doc + 1], end)
    # A text that ends in a line break has no further line with a word; its last line ends at the break.
    closed = (end > start) & (data[np.maximum(end - 1, 0)] == 10)
    end = np.where(closed, end - 1, end)
    with_word = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
    start, end, doc = start[with_word], end[with_word], doc[with_word]
    keys = textscan.within(textscan.span_hashes(data, start, end), doc)
    _, firsts = np.unique(keys, return_index=True)
    later = np.ones(len(keys), bool)
    later[firsts] = False
    return np.bincount(doc[later], minlength=words.n_texts)


def features(words: textscan.Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bucket, text index) of every n-gram: words first, then characters."""
    kinds = []
    mask = np.uint64(BUCKETS - 1)
    one = (words.hash & mask, words.doc)
    h, doc = textscan.windows(words, 2)
    kinds.append((np.concatenate([one[0], h & mask]).astype(np.int64), np.concatenate([one[1], doc])))
    data, offsets = words.data, words.offsets
    of = np.repeat(np.arange(words.n_texts), np.diff(offsets))
    buckets, docs = [], []
    for size in (1, 3, 5):
        n = len(data) - size + 1
        if n <= 0:
            continue
        h = np.zeros(n, np.uint32)
        for i in range(size):
            h = h * np.uint32(0x01000193) + data[i: i + n]
        h = (h * np.uint32(0x9E3779B1) + np.uint32(size)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
        own = of[:n] == of[size - 1:]
        buckets.append(h[own].astype(np.int64) + BUCKETS)
        docs.append(of[:n][own])
    kinds.append((np.concatenate(buckets), np.concatenate(docs)) if buckets else (np.empty(0, np.int64),) * 2)
    return kinds


def share_rows(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sparse feature row of each text: buckets and shares."""
    words = textscan.scan(texts, lower=False)
    n, width = words.n_texts, 2 * BUCKETS
    cells, shares = [], []
    for bucket, doc in features(words):
        cell, count = np.unique(doc * width + bucket, return_counts=True)
        total = np.maximum(1, np.bincount(doc, minlength=n))
        cells.append(cell)
        shares.append(count / total[cell // width])
    cell, share = np.concatenate(cells), np.concatenate(shares)
    order = np.argsort(cell)
    cell, share = cell[order], share[order]
    cuts = np.searchsorted(cell // width, np.arange(n + 1))
    return [(cell[a:b] % width, share[a:b]) for a, b in zip(cuts, cuts[1:])]


@dataclass
class Model:
    weight: np.ndarray  # float32, 2 * BUCKETS
    bias: float
    slope: float  # of the calibration
    shift: float

    def probability(self, words: textscan.Words) -> np.ndarray:
        n = words.n_texts
        score = np.full(n, self.bias)
        for bucket, doc in features(words):
            total = np.maximum(1, np.bincount(doc, minlength=n))
            score += np.bincount(doc, weights=self.weight[bucket], minlength=n) / total
        return 1 / (1 + np.exp(-np.clip(self.slope * score + self.shift, -50, 50)))


@dataclass
class Rows:
    """Sparse feature rows in flat arrays: 8 bytes per entry."""

    cells: np.ndarray  # int32
    shares: np.ndarray  # float32
    cuts: np.ndarray

    def __len__(self) -> int:
        return len(self.cuts) - 1

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cells, shares and the place of the row of each entry, for a few rows."""
        spans = [slice(self.cuts[i], self.cuts[i + 1]) for i in which]
        lengths = self.cuts[which + 1] - self.cuts[which]
        return (np.concatenate([self.cells[x] for x in spans]), np.concatenate([self.shares[x] for x in spans]),
                np.repeat(np.arange(len(which)), lengths))


def fit(rows: Rows, good: np.ndarray, held: np.ndarray, order: np.ndarray, epochs: int = 12, batch: int = 200) -> Model | None:
    """Logistic regression by Adam over batches, in ``order``, of the rows not held; Platt scaling on those held."""
    train = order[~held[order]]
    if len(np.unique(good[train])) < 2:
        return None
    scale = 30.0
    bad_share = 1 - good[train].mean()
    each = np.where(good, 0.5 / (1 - bad_share), 0.5 / bad_share)
    weight, bias = np.zeros(2 * BUCKETS), 0.0
    mean, square = np.zeros(2 * BUCKETS + 1), np.zeros(2 * BUCKETS + 1)
    step = 0
    for _ in range(epochs):
        for a in range(0, len(train), batch):
            step += 1
            which = train[a: a + batch]
            cells, shares, owner = rows.take(which)
            value = shares * scale
            score = np.bincount(owner, weights=weight[cells] * value, minlength=len(which)) + bias
            off = (1 / (1 + np.exp(-np.clip(score, -50, 50))) - good[which]) * each[which] / len(which)
            slope = np.bincount(cells, weights=value * off[owner], minlength=2 * BUCKETS) + 1e-5 * weight
            slope = np.append(slope, off.sum())
            mean = 0.9 * mean + 0.1 * slope
            square = 0.99 * square + 0.01 * slope**2
            move = 0.05 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
            weight -= move[:-1]
            bias -= move[-1]
    weight *= scale
    test = np.flatnonzero(held)
    a, b = 1.0, 0.0
    if len(np.unique(good[test])) == 2:
        cells, shares, owner = rows.take(test)
        raw = np.bincount(owner, weights=weight[cells] * shares, minlength=len(test)) + bias
        a, b = platt(raw, good[test])
    return Model(weight.astype(np.float32), float(bias), a, b)


def platt(score: np.ndarray, good: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of a sigmoid on the scores, by Newton steps on smoothed targets."""
    n1, n0 = good.sum(), (~good).sum()
    target = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * score + b, -50, 50)))
        w = np.maximum(p * (1 - p), 1e-9)
        slope = np.array([((p - target) * score).sum() + 1e-3 * (a - 1), (p - target).sum()])
        curve = np.array([[(w * score**2).sum() + 1e-3, (w * score).sum()], [(w * score).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(curve, slope)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(max(a, 1e-3)), float(b)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Model from a bounded sample of labelled documents, chosen by the hash of their id."""
    judged = labels.select(F.col("doc_id").alias("_key"), F.col("quality").cast("double").alias("quality"))
    judged = judged.where("_key is not null and quality is not null").groupBy("_key").agg(F.avg("quality").alias("mean"))
    judged = judged.withColumn("place", F.xxhash64("_key")).orderBy("place", "_key").limit(sample)
    # The sample has at most ``sample`` rows: a proven bound for the broadcast.
    texts = docs.select(F.col("doc_id").alias("_id"), F.col("text").cast("string").alias("_text"))
    chosen = texts.join(F.broadcast(judged), F.col("_id") == F.col("_key"))
    # One row for each id, however often it occurs; a few tasks make the features.
    first = F.min_by("_text", F.struct(F.col("_text").isNull(), F.xxhash64("_text")))
    chosen = chosen.groupBy("place", "mean", "_key").agg(first.alias("_text")).select("place", "mean", "_text").repartition(32, "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textscan.slices(batch, 2, SLICE_BYTES):
                rows = share_rows(part.column(2))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([r[0].astype(np.int32) for r in rows], pa.list_(pa.int32())),
                     pa.array([r[1].astype(np.float32) for r in rows], pa.list_(pa.float32()))],
                    names=["place", "mean", "cells", "shares"],
                )

    seen = chosen.mapInArrow(run, "place bigint, mean double, cells array<int>, shares array<float>").toArrow()
    if seen.num_rows == 0:
        return None
    place = seen["place"].to_numpy()
    order = np.argsort(place, kind="stable")
    lengths = pc.list_value_length(seen["cells"]).to_numpy()
    cells, shares = (np.concatenate([c.flatten().to_numpy() for c in seen[n].chunks]) for n in ("cells", "shares"))
    good = seen["mean"].to_numpy() >= 0.5
    del seen
    rows = Rows(cells, shares, np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]))
    return fit(rows, good, place % 5 == 0, order)


def judge(docs: DataFrame, model: Model | None, keep_from: float = KEEP_FROM) -> DataFrame:
    """(doc_id, five counts, score, base_failed, kept) of every document."""
    rows = docs.select(F.col("doc_id").alias("_id"), F.col("text").cast("string").alias("_text"))
    id_type = rows.schema["_id"].dataType.simpleString()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textscan.slices(batch, 1, SLICE_BYTES):
                words = textscan.scan(part.column(1), lower=False)
                counts = text_counts(words)
                score = model.probability(words) if model else np.ones(words.n_texts)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(counts[n].astype(np.int64)) for n in names), pa.array(score)],
                    names=["_id", *names, "score"],
                )

    schema = f"_id {id_type}, " + ", ".join(f"{n} bigint" for n in names) + ", score double"
    out = rows.mapInArrow(run, schema)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.col("score") >= keep_from)
    ).withColumnRenamed("_id", "doc_id")


def keep(docs: DataFrame, model: Model | None, keep_from: float = KEEP_FROM) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns, in one pass."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textscan.slices(batch, at, SLICE_BYTES):
                words = textscan.scan(part.column(at), lower=False)
                counts = text_counts(words)
                kept = (counts["n_words"] >= MIN_WORDS) & (100 * counts["n_repeat_words"] <= 50 * counts["n_words"])
                if model:
                    kept &= model.probability(words) >= keep_from
                yield part.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)
