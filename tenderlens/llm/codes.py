"""Vector code compression: a product quantiser trained by ball k-means, in whole numbers.

A component x becomes floor(scale * x); a vector is cut into equal consecutive
parts, and every part position has a codebook.  A round assigns each part to the
nearest entry of its codebook and moves every entry to the floor of its parts'
mean.  Assigning works on balls: within a block of vectors an entry and the parts
it held so far form a ball.  Another entry is a neighbour only if half its distance from
the ball's entry is within the ball's radius.  A part nearer to its entry than half the distance
of the nearest neighbour lies in the stable core and keeps its entry unseen.
The rest lie in annular rings between the half distances of the neighbours in
order; a part in ring k is compared with the first k neighbours only.

Squared distances are integers, so bounds and ties (to the lower index) are
exact and the result does not depend on how rows are dealt.  Each round is one
pass over a written table (quantised vector and current codes); it also emits
each task's sums per entry, so the driver sees parts x entries rows at most.

Defined results: rows whose vector is null or holds null or non-finite
components are dropped.  The length is that of the usable vector with the
smallest id; vectors of another length, of a length that the parts do not divide, or
with components beyond ``limit`` keep their row with a null code and error and
train nothing.  A missing id sorts last, repeated ids by vector.  With fewer
vectors than entries the codebooks are shorter.  Missing labels count as equal; a label's
error is null if it does not fit a long.  An empty table gives no rows; extra columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlens.llm.storage import stored

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
BLOCK_ROWS = 16384


def limit(width: int) -> int:
    """Largest component for which four parts' squared distances fit a long."""
    return int((2**60 / (4 * width)) ** 0.5)


class Book:
    """A codebook with its entries' half distances, each row in ascending order."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.square = (entries * entries).sum(1)
        apart = self.square[:, None] - 2 * (entries @ entries.T) + self.square[None, :]
        # A part at squared distance d can be as near to another entry only if apart <= 4 d.
        quarter = (apart + 3) >> 2
        self.order = np.argsort(quarter, axis=1, kind="stable")
        self.quarter = np.take_along_axis(quarter, self.order, 1)

    def distances(self, x: np.ndarray, some: np.ndarray) -> np.ndarray:
        """Squared distances to some entries; in floating point only where that is exact."""
        top = max(int(np.abs(x).max(initial=0)), int(np.abs(self.entries).max(initial=0)))
        kind = np.float64 if 4 * x.shape[1] * top * top < 2**53 else np.int64
        a, b = x.astype(kind), self.entries[some].astype(kind)
        return (a * a).sum(1)[:, None] - 2 * (a @ b.T) + self.square[some].astype(kind)[None, :]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = self.distances(x, np.arange(len(self.entries)))
        code = d.argmin(1)
        return code, d[np.arange(len(x)), code].astype(np.int64)

    def moved(self, x: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Nearest entries, squared distances, and how many distances were worked out, from the entries held so far."""
        away = x - self.entries[held]
        own = (away * away).sum(1)
        code, best, work = held.copy(), own.copy(), len(x)
        by_entry = np.argsort(held, kind="stable")
        starts = np.searchsorted(held[by_entry], np.arange(len(self.entries) + 1))
        for entry in np.flatnonzero(np.diff(starts)):
            ball = by_entry[starts[entry]: starts[entry + 1]]
            neighbours = np.searchsorted(self.quarter[entry], own[ball].max(), side="right")
            if neighbours == 1:
                continue
            reach = np.searchsorted(self.quarter[entry][:neighbours], own[ball], side="right")
            # Rings whose number of neighbours has the same power of two are compared together.
            ring = np.ceil(np.log2(reach)).astype(int)
            for r in np.unique(ring[reach > 1]):
                rows = ball[(ring == r) & (reach > 1)]
                some = np.sort(self.order[entry][: min(1 << r, neighbours)])
                d = self.distances(x[rows], some)
                least = d.argmin(1)
                code[rows], best[rows] = some[least], d[np.arange(len(rows)), least].astype(np.int64)
                work += d.size
        return code, best, work


def _quantised(vectors: DataFrame, parts: int, scale: int, vector: str) -> DataFrame:
    """(vec_id, label, q, usable) of every row that is kept."""
    v = F.col(f"`{vector}`")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.where(v.isNotNull() & F.coalesce(finite, F.lit(False)))
    n = F.size(v)
    most = F.sqrt(F.lit(2.0**60) / (4 * F.greatest(F.floor(n / parts), F.lit(1))))
    inside = F.forall(v, lambda x: F.abs(F.floor(x.cast("double") * scale).cast("double")) < F.floor(most))
    usable = (n > 0) & (n % parts == 0) & inside
    q = F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("int"))
    return kept.select("vec_id", "label", F.when(usable, q).alias("q"))


def _first_books(q: DataFrame, parts: int, entries: int) -> list[np.ndarray]:
    """Codebooks of the smallest ids; bounded by ``entries`` vectors."""
    usable = q.where("q is not null").select("vec_id", "q")
    order = [F.col("vec_id").asc_nulls_last(), F.col("q")]
    first = usable.orderBy(*order).limit(1).collect()
    if not first:
        return []
    rows = usable.where(F.size("q") == len(first[0].q)).orderBy(*order).limit(entries).collect()
    return np.split(np.array([r.q for r in rows], np.int64), parts, axis=1)


def _sums(x: np.ndarray, code: np.ndarray, into: np.ndarray, count: np.ndarray) -> None:
    order = np.argsort(code, kind="stable")
    found, starts = np.unique(code[order], return_index=True)
    into[found] += np.add.reduceat(x[order], starts, axis=0)
    count[found] += np.bincount(code, minlength=len(count))[found]


def _assigned(rows: DataFrame, books: list[np.ndarray], name: str) -> DataFrame:
    """The rows with their codes and errors, and after them each task's sums: one written table."""
    held = "codes" in rows.columns
    source = rows.select("vec_id", "label", "q", *(["codes"] if held else []))
    types = {c: source.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    schema = (
        f"vec_id {types['vec_id']}, label {types['label']}, q array<int>, codes binary, error bigint, "
        "part int, entry int, sums array<bigint>, n bigint"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = [Book(b) for b in books]
        sums, counts = [np.zeros_like(b) for b in books], [np.zeros(len(b), np.int64) for b in books]
        kinds = None

        def block(table: pa.Table) -> pa.RecordBatch:
            table = table.combine_chunks()
            n = len(table)
            q = table.column("q").chunk(0)
            x = np.split(q.flatten().to_numpy().astype(np.int64).reshape(n, -1), len(books), axis=1)
            if held:
                before = np.frombuffer(b"".join(table.column("codes").to_pylist()), np.uint8).reshape(n, -1).astype(np.int64)
            codes, error = np.empty((n, len(books)), np.uint8), np.zeros(n, np.int64)
            for p, book in enumerate(ready):
                code, d = book.moved(x[p], before[:, p])[:2] if held else book.nearest(x[p])
                codes[:, p] = code
                error += d
                _sums(x[p], code, sums[p], counts[p])
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(len(books)), n, [None, pa.py_buffer(codes.tobytes())])
            nothing = [pa.nulls(n, t) for t in (pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.int64())]
            return pa.RecordBatch.from_arrays(
                [table.column("vec_id").chunk(0), table.column("label").chunk(0), q, packed.cast(pa.binary()), pa.array(error), *nothing],
                names=["vec_id", "label", "q", "codes", "error", "part", "entry", "sums", "n"],
            )

        waiting, size = [], 0
        for batch in batches:
            kinds = [batch.schema.field(i).type for i in range(3)]
            for a in range(0, len(batch), BLOCK_ROWS):
                piece = batch.slice(a, BLOCK_ROWS)
                waiting.append(piece)
                size += len(piece)
                if size >= BLOCK_ROWS:
                    yield block(pa.Table.from_batches(waiting))
                    waiting, size = [], 0
        if size:
            yield block(pa.Table.from_batches(waiting))
        if kinds:
            some = [(p, e) for p in range(len(books)) for e in np.flatnonzero(counts[p])]
            n = len(some)
            yield pa.RecordBatch.from_arrays(
                [*(pa.nulls(n, k) for k in kinds), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()),
                 pa.array([p for p, _ in some], pa.int32()), pa.array([int(e) for _, e in some], pa.int32()),
                 pa.array([sums[p][e].tolist() for p, e in some], pa.list_(pa.int64())),
                 pa.array([int(counts[p][e]) for p, e in some], pa.int64())],
                names=["vec_id", "label", "q", "codes", "error", "part", "entry", "sums", "n"],
            )

    return stored(source.mapInArrow(run, schema), name)


def _moved_entries(assigned: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Entries at the floor of their parts' mean; unused ones stay.  Reads the tasks' sums, some columns of the table."""
    width = books[0].shape[1]
    totals = assigned.where("entry is not null").groupBy("part", "entry").agg(
        F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)]
    )
    out = [b.copy() for b in books]
    for r in totals.collect():  # parts x entries rows at most
        out[r.part][r.entry] = [r[f"s{i}"] // r.n for i in range(width)]
    return out


def digest(books: list[np.ndarray]) -> str:
    flat = (str(v) for b in books for v in b.reshape(-1).tolist())
    return hashlib.sha256(",".join(flat).encode()).hexdigest()


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
          vector: str = "embedding") -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, q, codes, error) of every kept row, and the codebooks (entries x part width each)."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has one byte for each part")
    q = _quantised(vectors, parts, scale, vector)
    books = _first_books(q, parts, entries)
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("codes", "binary"), ("error", "bigint"))]
    if not books:
        return q.select("vec_id", "label", "q", *nothing), []
    size = parts * books[0].shape[1]
    fits = F.coalesce(F.size("q") == size, F.lit(False)) & F.col("q").isNotNull()
    rows = q.where(fits)
    for k in range(rounds):
        rows = _assigned(rows, books, f"codes-{k}")
        books = _moved_entries(rows, books)
        rows = rows.where("entry is null")
    rows = _assigned(rows, books, f"codes-{rounds}").where("entry is null")
    others = q.where(~fits).select("vec_id", "label", "q", *nothing)
    return rows.select("vec_id", "label", "q", "codes", "error").unionByName(others), books


def code_string(codes: Column) -> Column:
    return F.lower(F.hex(codes))


def compress(vectors: DataFrame, **options) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every kept row."""
    rows, books = train(vectors, **options)
    per_label = rows.groupBy("label").agg(F.try_sum("error").alias("label_error")).withColumnRenamed("label", "_of")
    out = rows.join(per_label, F.col("label").eqNullSafe(F.col("_of")), "left")
    return out.select(
        "vec_id", code_string(F.col("codes")).alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")
    )
