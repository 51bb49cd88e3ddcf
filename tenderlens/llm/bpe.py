"""Byte-level BPE encoding and decoding.

A text is split into pieces by the vocabulary's pattern.  Within a piece the
symbols form a doubly linked list; a priority queue holds the merge ranks of
adjacent pairs.  The lowest rank merges first, the leftmost among equals; an
entry whose symbols have changed since it was queued is stale and skipped.
Decoding concatenates the byte strings of the vocabulary.

Pieces repeat, so each Python worker remembers the ids of recent pieces in a
dictionary of bounded size.  The vocabulary has a fixed size (50,257 entries);
it is read on the driver from the given path and sent to the tasks once.

Defined results: a null or empty text has no ids and decodes to the empty
text.  Texts of any length are encoded whole.  Repeated rows give repeated
rows.  Extra columns of the input are not read; an empty table gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlens.llm import textscan

# Fixed value: the split pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

REMEMBERED_PIECES = 150_000  # in each of two generations
OUT_BYTES = 2 << 20


def byte_alphabet() -> dict[str, int]:
    """Character that stands for each byte in the vocabulary file: printable ones for themselves."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def read_vocabulary(path: str) -> dict:
    """Plain parts of a tokenizer file: token bytes by id, merge pairs in rank order, added tokens."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    to_byte = byte_alphabet()
    vocab: dict[str, int] = spec["model"]["vocab"]
    added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    as_bytes = {
        i: t.encode() if t in added or any(c not in to_byte for c in t) else bytes(to_byte[c] for c in t)
        for t, i in vocab.items()
    }
    as_bytes |= {i: t.encode() for t, i in added.items()}
    merges = []
    for m in spec["model"]["merges"]:
        left, right = m.split(" ") if isinstance(m, str) else m
        merges.append((vocab[left], vocab[right], vocab[left + right]))
    single = [vocab[c] for c, _ in sorted(to_byte.items(), key=lambda x: x[1])]
    return {"bytes": as_bytes, "merges": merges, "single": single, "added": added}


class Codec(dict):
    """Piece to the bytes of its int32 ids; unseen pieces are merged on demand.

    When the dictionary is full it becomes the older generation, from which a
    piece in use comes back; the rest of the generation before is forgotten.
    """

    def __init__(self, vocabulary: dict):
        super().__init__()
        self.older: dict[str, bytes] = {}
        self.single = vocabulary["single"]
        self.rank = {(a << 20) | b: (rank, new) for rank, (a, b, new) in enumerate(vocabulary["merges"])}
        self.token = vocabulary["bytes"]
        self.added = vocabulary["added"]
        self.split = regex.compile(PATTERN)
        longest_first = sorted(self.added, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if self.added else None

    def __missing__(self, piece: str) -> bytes:
        out = self.older.pop(piece, None)
        if out is None:
            out = np.array(self.merge(piece.encode()), np.int32).tobytes()
        if len(self) >= REMEMBERED_PIECES:
            self.older = dict(self)
            self.clear()
        self[piece] = out
        return out

    def merge(self, piece: bytes) -> list[int]:
        single, rank = self.single, self.rank
        symbol = [single[b] for b in piece]
        n = len(symbol)
        if n < 2:
            return symbol
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = []
        for i in range(n - 1):
            found = rank.get((symbol[i] << 20) | symbol[i + 1])
            if found:
                queue.append((found[0], i, symbol[i], symbol[i + 1], found[1]))
        heapify(queue)
        while queue:
            _, i, left, right, new = heappop(queue)
            j = after[i]
            if symbol[i] != left or j >= n or symbol[j] != right:
                continue  # stale: one of the two has been merged since
            symbol[i], symbol[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                found = rank.get((new << 20) | symbol[k])
                if found:
                    heappush(queue, (found[0], i, new, symbol[k], found[1]))
            h = before[i]
            if h >= 0:
                found = rank.get((symbol[h] << 20) | new)
                if found:
                    heappush(queue, (found[0], h, symbol[h], new, found[1]))
        out, i = [], 0
        while i < n:
            out.append(symbol[i])
            i = after[i]
        return out

    def encode(self, text: str) -> np.ndarray:
        pieces = self.__getitem__
        if self.special is None or not any(t in text for t in self.added):
            return np.frombuffer(b"".join(map(pieces, self.split.findall(text))), np.int32)
        parts = []
        for part in self.special.split(text):
            if part in self.added:
                parts.append(np.array([self.added[part]], np.int32).tobytes())
            else:
                parts.extend(map(pieces, self.split.findall(part)))
        return np.frombuffer(b"".join(parts), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.token.__getitem__, ids.tolist())).decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}


def _codec(shared) -> Codec:
    """One codec per worker and vocabulary."""
    if shared.id not in _CODECS:
        _CODECS.clear()
        _CODECS[shared.id] = Codec(shared.value)
    return _CODECS[shared.id]


class _Shared:
    """The vocabulary as a broadcast variable with an id that tasks can compare."""

    def __init__(self, spark: SparkSession, vocabulary: dict):
        self.variable = spark.sparkContext.broadcast(vocabulary)
        self.id = f"{spark.sparkContext.applicationId}-{self.variable._jbroadcast.id()}"

    @property
    def value(self) -> dict:
        return self.variable.value


def _encoded(codec: Codec, texts: pa.Array) -> tuple[list[np.ndarray], pa.ListArray]:
    ids = [codec.encode(t or "") for t in texts.to_pylist()]
    ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
    values = pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32), pa.int32())
    return ids, pa.ListArray.from_arrays(pa.array(ends), values)


def _over_texts(docs: DataFrame, vocabulary_path: str, id_col: str, text_col: str, more: str, make) -> DataFrame:
    """One pass over (id, text): ``make`` gives the columns behind the id for a part of a batch."""
    shared = _Shared(docs.sparkSession, read_vocabulary(vocabulary_path))
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            for part in textscan.slices(batch, 1, OUT_BYTES):
                columns = make(codec, part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), *columns.values()], names=["_id", *columns])
        pa.default_memory_pool().release_unused()

    id_type = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"_id {id_type}, {more}").withColumnRenamed("_id", id_col)


def encode(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, ``ids`` array of int): the token ids of each whole text."""
    return _over_texts(
        docs, vocabulary_path, id_col, text_col, "ids array<int>", lambda codec, texts: {"ids": _encoded(codec, texts)[1]}
    )


def round_trip(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, ``ids``, ``decoded``): ``encode`` and ``decode`` in one pass, with one Python worker per task."""

    def both(codec: Codec, texts: pa.Array) -> dict:
        ids, lists = _encoded(codec, texts)
        return {"ids": lists, "decoded": pa.array([codec.decode(i) for i in ids], pa.string())}

    return _over_texts(docs, vocabulary_path, id_col, text_col, "ids array<int>, decoded string", both)


def decode(encoded: DataFrame, vocabulary_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Adds ``decoded``: the text of the ids; broken UTF-8 becomes the replacement character."""
    spark = encoded.sparkSession
    shared = _Shared(spark, read_vocabulary(vocabulary_path))
    rows = encoded.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{ids_col}`").cast("array<int>").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            lists = batch.column(1)
            size = max(1, min(batch.num_rows, (1 << 19) * batch.num_rows // max(1, len(lists.flatten()))))
            for a in range(0, batch.num_rows, size):
                part = batch.slice(a, size)
                texts = [
                    codec.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else "" for x in part.column(1)
                ]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string())], names=["_id", "ids", "decoded"]
                )

    id_type = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"_id {id_type}, ids array<int>, decoded string").withColumnRenamed("_id", id_col)


def digests(decoded: DataFrame, id_col: str = "doc_id", extra: tuple = ()) -> DataFrame:
    """Per document: number of ids and digests of the ids and of the decoded text."""
    return decoded.select(
        id_col,
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        *extra,
    )
