"""Words of many texts at once: one byte buffer, numpy offsets, 64-bit word hashes.

A word is ``[^\\x20\\x09-\\x0D]+``.  The six white-space bytes never occur inside a
multi-byte UTF-8 character, so scanning bytes is scanning characters.  Nothing
here loops over words in Python; a batch of texts costs a fixed number of numpy
passes over its bytes.

Words are identified by a 64-bit hash (a polynomial over random byte values,
mixed afterwards).  Two different words meet with probability 2**-64 per pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class _Cache:
    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_Cache.up) < n:
        size = 1 << (n - 1).bit_length()
        _Cache.up, _Cache.down = _powers(_BASE, size), _powers(_BASE_INVERSE, size)
    return _Cache.up[:n], _Cache.down[:n]


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z; other bytes as they are."""
    return _LOWER[data]


def slices(batch: pa.RecordBatch, column: int, size: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``size`` bytes of text each; a longer text is a part of its own."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(lengths, dtype=np.int64) // size
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row and n + 1 offsets; a null text has no bytes."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset: texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    if len(texts) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    return whole[offsets[0]: offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    data: np.ndarray  # bytes, lower-cased when asked
    offsets: np.ndarray  # of the texts, n + 1
    start: np.ndarray  # of each word, in bytes of ``data``
    end: np.ndarray
    doc: np.ndarray  # index of the word's text
    hash: np.ndarray  # uint64

    @property
    def first(self) -> np.ndarray:
        """Index of each text's first word, and the number of words at the end."""
        return np.searchsorted(self.doc, np.arange(len(self.offsets)))

    @property
    def n_texts(self) -> int:
        return len(self.offsets) - 1


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text index of every word; a word ends where its text ends."""
    inside = ~_SPACE[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    begins[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    doc = np.searchsorted(offsets, start, side="right") - 1
    return start, end, doc


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, equal for equal bytes wherever they stand."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def scan(texts: pa.Array, lower: bool = True) -> Words:
    data, offsets = buffer_of(texts)
    if lower:
        data = lowered(data)
    start, end, doc = spans(data, offsets)
    return Words(data, offsets, start, end, doc, span_hashes(data, start, end))


def within(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hashes that are equal only inside one text."""
    return mix(h + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def is_space(data: np.ndarray) -> np.ndarray:
    return _SPACE[data]


def windows(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text index of every run of ``size`` words that lies in one text."""
    return windows_at(words, size)[:2]


def windows_at(words: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``windows``, and the place of each run's first word."""
    n = len(words.hash) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    h = np.zeros(n, np.uint64)
    for i in range(size):
        h = h * np.uint64(0xD6E8FEB86659FD93) + words.hash[i: i + n]
    at = np.flatnonzero(words.doc[:n] == words.doc[size - 1:])
    return mix(h[at]), words.doc[at], at


def shingle_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted by (text, hash), and n + 1 offsets.

    A text with fewer words than ``size`` has its whole word sequence as one
    shingle; a text without words has none.
    """
    h, doc = windows(words, size)
    first = words.first
    count = np.diff(first)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for i in range(size - 1):
            more = count[short] > i
            extra[more] = extra[more] * np.uint64(0xD6E8FEB86659FD93) + words.hash[first[short[more]] + i]
        extra = mix(extra + count[short].astype(np.uint64))
        h, doc = np.concatenate([h, extra]), np.concatenate([doc, short])
        order = np.argsort(doc, kind="stable")
        h, doc = h[order], doc[order]
    cuts = np.searchsorted(doc, np.arange(words.n_texts + 1))
    sets = [_distinct(h[a:b]) for a, b in zip(cuts, cuts[1:])]
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets], dtype=np.int64)])
    return (np.concatenate(sets) if sets else h), offsets


def _distinct(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    if len(h) > 1:
        keep = np.ones(len(h), bool)
        keep[1:] = h[1:] != h[:-1]
        h = h[keep]
    return h


def scan_parts(texts: pa.ChunkedArray | pa.Array, size: int, lower: bool = True) -> Iterator[Words]:
    """``scan`` over about ``size`` bytes of text at a time."""
    for chunk in texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts]:
        batch = pa.RecordBatch.from_arrays([chunk], names=["text"])
        for part in slices(batch, 0, size):
            yield scan(part.column(0), lower)
