"""Language identification by a bidirectional gated recurrent network over bytes.

A text is cut into windows of ``WINDOW`` bytes (A-Z lower-cased).  One GRU reads a
window forwards, one backwards; at every byte the two states together give a
probability for each language (a label per position).  The probability of a
document is the mean over all its positions, so whole texts count, whatever
their length.

Training is backpropagation through time in numpy on the driver, on windows
from a bounded sample of labelled documents (``SAMPLE`` documents, the same
number for each language and ``LEAST`` at least, the lowest hashes of the id, at most ``PER_DOC`` windows of each, spread evenly).  The sample
leaves the tasks as windows, never as whole texts.  Scoring is one pass over
the texts without a shuffle; windows of many texts advance together as rows of
one matrix.

Defined results: null texts and texts without a letter are ``und`` with score
0.  Languages that tie go to the first in sorted order.  Null labels are not
learnt from; without any label everything is ``und``.  Empty tables give no rows;
repeated rows are judged each; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenderlens.llm import textscan

WINDOW, HIDDEN = 64, 8
SAMPLE, PER_DOC, LEAST = 3000, 4, 8
BATCH, STEPS = 256, 400
ROWS_AT_ONCE = 4096
SLICE_BYTES = 1 << 19
PAD = 256


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True for the documents that are not learnt from."""
    return F.coalesce(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0, F.lit(False))


def windows_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of WINDOW byte values (PAD behind the end of a text) and the text of each row."""
    length = np.diff(offsets)
    n = -(-length // WINDOW)
    doc = np.repeat(np.arange(len(length)), n)
    order = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    start = offsets[:-1][doc] + order * WINDOW
    at = start[:, None] + np.arange(WINDOW)
    inside = at < offsets[1:][doc][:, None]
    values = np.full(at.shape, PAD, np.int16)
    values[inside] = data[at[inside]]
    return values, doc


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


@dataclass
class Direction:
    """One GRU: input table by byte (gates z, r and the candidate), recurrent weights."""

    table: np.ndarray  # 257 x 3H
    gates: np.ndarray  # H x 2H
    candidate: np.ndarray  # H x H

    def states(self, rows: np.ndarray, keep: list | None = None) -> list[np.ndarray]:
        """State after each position of ``rows`` (positions x batch); ``keep`` gets what BPTT needs."""
        size = self.candidate.shape[0]
        h = np.zeros((rows.shape[1], size), np.float32)
        out = []
        for x in rows:
            fed = self.table[x]
            zr = _sigmoid(fed[:, : 2 * size] + h @ self.gates)
            z, r = zr[:, :size], zr[:, size:]
            reset = r * h
            new = np.tanh(fed[:, 2 * size:] + reset @ self.candidate)
            before, h = h, new + z * (h - new)
            if keep is not None:
                keep.append((x, z, r, reset, new, before))
            out.append(h)
        return out

    def gradients(self, keep: list, above: list[np.ndarray]) -> list[np.ndarray]:
        """Gradients of (table, gates, candidate), given those of each state, backwards through time."""
        size = self.candidate.shape[0]
        d_table, d_gates, d_candidate = (np.zeros_like(w) for w in (self.table, self.gates, self.candidate))
        back = np.zeros_like(above[0])
        for (x, z, r, reset, new, before), from_above in zip(reversed(keep), reversed(above)):
            d_h = back + from_above
            d_new = d_h * (1 - z) * (1 - new**2)
            d_reset = d_new @ self.candidate.T
            d_z = d_h * (before - new) * z * (1 - z)
            d_r = d_reset * before * r * (1 - r)
            d_zr = np.concatenate([d_z, d_r], 1)
            d_candidate += reset.T @ d_new
            d_gates += before.T @ d_zr
            fed = np.concatenate([d_zr, d_new], 1)
            np.add.at(d_table, x, fed)
            back = d_h * z + d_reset * r + d_zr @ self.gates.T
        return [d_table, d_gates, d_candidate]


@dataclass
class Network:
    languages: list[str]
    forward: Direction
    backward: Direction
    out: np.ndarray  # 2H x languages
    bias: np.ndarray

    @classmethod
    def new(cls, languages: list[str], rng: np.random.Generator, size: int = HIDDEN) -> Network:
        def direction():
            table = (rng.standard_normal((257, 3 * size)) * 0.3).astype(np.float32)
            return Direction(table, (rng.standard_normal((size, 2 * size)) * 0.3).astype(np.float32),
                             (rng.standard_normal((size, size)) * 0.3).astype(np.float32))

        net = cls(languages, direction(), direction(),
                  (rng.standard_normal((2 * size, len(languages))) * 0.3).astype(np.float32),
                  np.zeros(len(languages), np.float32))
        net.hold()
        return net

    def hold(self) -> None:
        """Padding keeps the state: its update gate stays shut."""
        size = self.backward.candidate.shape[0]
        for d in (self.forward, self.backward):
            d.table[PAD] = 0
            d.table[PAD, :size] = 40

    def weights(self) -> list[np.ndarray]:
        return [self.forward.table, self.forward.gates, self.forward.candidate,
                self.backward.table, self.backward.gates, self.backward.candidate, self.out, self.bias]

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        """Positions x batch x languages."""
        size = self.backward.candidate.shape[0]
        left = self.forward.states(rows)
        right = self.backward.states(rows[::-1])[::-1]
        out = np.empty((*rows.shape, len(self.languages)), np.float32)
        for t in range(len(rows)):
            scores = left[t] @ self.out[:size] + right[t] @ self.out[size:] + self.bias
            np.exp(np.minimum(scores, 60), out=scores)
            out[t] = scores / scores.sum(1, keepdims=True)
        return out

    def step(self, rows: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Loss over all positions and the gradients of ``weights()``."""
        size = self.backward.candidate.shape[0]
        kept_l, kept_r = [], []
        left = self.forward.states(rows, kept_l)
        right = self.backward.states(rows[::-1], kept_r)[::-1]
        real = rows != PAD
        share = 1 / max(1, real.sum())
        d_out, d_bias = np.zeros_like(self.out), np.zeros_like(self.bias)
        up_l, up_r, loss = [], [], 0.0
        lines = np.arange(rows.shape[1])
        for t in range(len(rows)):
            both = np.concatenate([left[t], right[t]], 1)
            scores = both @ self.out + self.bias
            scores -= scores.max(1, keepdims=True)
            p = np.exp(scores)
            p /= p.sum(1, keepdims=True)
            loss -= float((np.log(p[lines, label] + 1e-9) * real[t]).sum()) * share
            p[lines, label] -= 1
            p *= (real[t] * share)[:, None]
            d_out += both.T @ p
            d_bias += p.sum(0)
            down = p @ self.out.T
            up_l.append(down[:, :size])
            up_r.append(down[:, size:])
        return loss, [*self.forward.gradients(kept_l, up_l), *self.backward.gradients(kept_r, up_r[::-1]), d_out, d_bias]

    def pooled(self, values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        """Mean of the position probabilities of each text."""
        total, positions = np.zeros((n, len(self.languages))), np.zeros(n)
        for a in range(0, len(values), ROWS_AT_ONCE):
            rows = np.ascontiguousarray(values[a: a + ROWS_AT_ONCE].T)
            real = rows != PAD
            p = self.probabilities(rows)
            if not real.all():
                p *= real[:, :, None]
            by_window, of = p.sum(0, dtype=np.float64), doc[a: a + ROWS_AT_ONCE]
            for k in range(len(self.languages)):
                total[:, k] += np.bincount(of, weights=by_window[:, k], minlength=n)
            positions += np.bincount(of, weights=real.sum(0), minlength=n)
        return total / np.maximum(positions, 1)[:, None]


def fit(values: np.ndarray, label: np.ndarray, languages: list[str], steps: int = STEPS, seed: int = 3) -> Network:
    """Adam over batches in which every language has the same share."""
    rng = np.random.default_rng(seed)
    net = Network.new(languages, rng)
    weights = net.weights()
    mean, square = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    members = [np.flatnonzero(label == k) for k in range(len(languages))]
    for step in range(1, steps + 1):
        # Languages take turns, so any number of them has the same share over some steps.
        turns = np.bincount((np.arange(BATCH) + step * BATCH) % len(members), minlength=len(members))
        pick = np.concatenate([rng.choice(m, n) for m, n in zip(members, turns) if n])
        _, slopes = net.step(np.ascontiguousarray(values[pick].T), label[pick])
        norm = np.sqrt(sum(float((g**2).sum()) for g in slopes))
        rate = 0.02 * min(1.0, step / 20) * (1 - 0.9 * step / steps)
        for w, g, m, s in zip(weights, slopes, mean, square):
            g = g / max(1.0, norm)
            m += 0.1 * (g - m)
            s += 0.01 * (g**2 - s)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
        net.hold()
    return net


def _drawn(known: DataFrame, sample: int) -> DataFrame:
    """(_id): the lowest hashes of the different ids of each language, the same number for all of them."""
    whole = 1 << 40
    ids = known.distinct().withColumn("place", F.pmod(F.xxhash64("_id"), F.lit(whole)))
    sizes = ids.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    quota = max(LEAST, sample // max(1, sizes.agg(F.count(F.lit(1))).first()[0]))
    # Some eight times the quota's places are low enough to be looked at, so a window is small whatever the language's size.
    low = ids.join(sizes, "lang").where(F.col("place") < F.least(F.lit(1.0), F.lit(8.0 * quota + 64) / F.col("n")) * whole)
    w = Window.partitionBy("lang").orderBy("place", "_id")
    return low.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= quota).select("_id").distinct()


def train(docs: DataFrame, sample: int = SAMPLE) -> Network | None:
    """Network from the documents that are not held out."""
    known = docs.select(
        F.col("doc_id").alias("_id"), F.col("text").cast("string").alias("_text"), F.col("lang").cast("string").alias("lang")
    ).where(F.col("_text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("_id")))
    chosen = _drawn(known.select("_id", "lang"), sample)
    # At most ``sample`` ids, or ``LEAST`` for each language: a proven bound for the broadcast.
    # One row for each id, however often it occurs; a few tasks make the windows.
    first = F.min_by(F.struct("lang", "_text"), F.struct(F.xxhash64("_text", "lang"), "lang"))
    texts = known.join(F.broadcast(chosen), "_id", "left_semi").groupBy("_id").agg(first.alias("one"))
    texts = texts.select(F.xxhash64("_id").alias("place"), "one.lang", "one._text").repartition(32, "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textscan.slices(batch, 2, SLICE_BYTES):
                data, offsets = textscan.buffer_of(part.column(2))
                values, doc = windows_of(textscan.lowered(data), offsets)
                first = np.searchsorted(doc, np.arange(part.num_rows + 1))
                taken = []
                for a, b in zip(first, first[1:]):
                    taken.append(values[np.unique(np.linspace(a, b - 1, PER_DOC).astype(int))] if b > a else values[:0])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([t.ravel() for t in taken], pa.list_(pa.int16()))],
                    names=["place", "lang", "rows"],
                )

    seen = texts.mapInArrow(run, "place bigint, lang string, rows array<smallint>").toArrow()
    seen = seen.sort_by([("place", "ascending"), ("lang", "ascending")])
    names = seen["lang"].to_pylist()
    values = [np.asarray(r.values).reshape(-1, WINDOW) for r in seen["rows"]]
    languages = sorted({n for n, v in zip(names, values) if len(v)})
    if not languages:
        return None
    label = np.concatenate([np.full(len(v), languages.index(n)) for n, v in zip(names, values) if len(v)])
    return fit(np.concatenate([v for v in values if len(v)]), label, languages)


def _has_letter(data: np.ndarray, offsets: np.ndarray, texts: pa.Array) -> np.ndarray:
    ascii_letter = np.concatenate([[0], np.cumsum((data >= 97) & (data <= 122))])
    out = ascii_letter[offsets[1:]] > ascii_letter[offsets[:-1]]
    for i in np.flatnonzero(~out & (np.diff(offsets) > 0)):
        out[i] = any(c.isalpha() for c in texts[int(i)].as_py())
    return out


def _labelled(texts: pa.Array, network: Network | None) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    n = len(texts)
    if network is None:
        return ["und"] * n, np.zeros(n)
    data, offsets = textscan.buffer_of(texts)
    data = textscan.lowered(data)
    lettered = _has_letter(data, offsets, texts)
    pooled = network.pooled(*windows_of(data, offsets), n)
    lang = [network.languages[k] if ok else "und" for k, ok in zip(pooled.argmax(1), lettered)]
    return lang, np.where(lettered, np.clip(pooled.max(1), 0, 1), 0.0)


def identify(docs: DataFrame, network: Network | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document."""
    rows = docs.select(F.col("doc_id").alias("_id"), F.col("text").cast("string").alias("_text"))
    id_type = rows.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textscan.slices(batch, 1, SLICE_BYTES):
                lang, score = _labelled(part.column(1), network)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                    names=["_id", "lang_pred", "score"],
                )

    out = rows.mapInArrow(run, f"_id {id_type}, lang_pred string, score double")
    return out.select(F.col("_id").alias("doc_id"), held_out(F.col("_id")).alias("held_out"), "lang_pred", "score")


def keep(docs: DataFrame, network: Network | None, least: float = 0.35) -> DataFrame:
    """The rows of ``docs`` with a letter and a language of at least this probability, with all their columns."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textscan.slices(batch, at, SLICE_BYTES):
                _, score = _labelled(part.column(at), network)
                yield part.filter(pa.array(score >= least))

    return docs.mapInArrow(run, docs.schema) if network else docs.limit(0)
