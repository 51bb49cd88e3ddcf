"""Embedding near-duplicates: a subspace pigeonhole join.

Unit vectors x, y with cosine >= c have squared distance <= 2 - 2c.  Vectors are
rotated by a fixed random orthonormal matrix and cut into ``BLOCKS`` blocks of
few dimensions; by the pigeonhole principle at least one block has a squared
distance of at most its share (in proportion to its dimensions) of that budget.
Each block is a range join: a grid over its first two dimensions with cells
twice as wide as the block's radius.  A vector is at home in one cell per block and
visits the neighbouring cells (one half of them, so a pair meets once) that lie
within the radius.  In a cell, pairs within the block's budget are candidates; a pair
counts in the first block in which it is one, and its cosine is then computed
from the original components in double precision.

Equal vectors of a label are one class with a number of copies.  A cell with many
vectors is dealt into chunks of ``CHUNK``, and every pair of chunks is a task.
Tasks return counts and components, never the pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, or whose label is null, link with nothing.  Vectors of different
lengths do not link.  Repeated rows are copies of each other.  Extra columns
are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderlens.llm import graph
from tenderlens.llm.storage import stored

BLOCKS, CHUNK = 8, 2048
COSINE = 0.93
SLACK = 1e-9
PAIRS_AT_ONCE = 1 << 15


@lru_cache(maxsize=8)
def rotation(size: int) -> np.ndarray:
    """A fixed orthonormal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(size).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def blocks_of(size: int) -> list[slice]:
    edges = np.linspace(0, size, min(BLOCKS, size) + 1).astype(int)
    return [slice(int(a), int(b)) for a, b in zip(edges, edges[1:])]


def budgets(size: int, cosine: float) -> np.ndarray:
    """Squared distance allowed in each block, in proportion to its dimensions."""
    return (2 - 2 * cosine + SLACK) * np.array([b.stop - b.start for b in blocks_of(size)]) / size


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))


def placements(vectors: np.ndarray, cosine: float) -> list[tuple[np.ndarray, int, np.ndarray, np.ndarray, bool]]:
    """(row indexes, block, cell x, cell y, at home) for every block and kind of place."""
    size = vectors.shape[1]
    turned = _unit(vectors) @ rotation(size)
    out = []
    rows = np.arange(len(vectors))
    for j, (block, budget) in enumerate(zip(blocks_of(size), budgets(size, cosine))):
        radius = np.sqrt(budget) + SLACK
        plane = turned[:, block][:, :2]
        if plane.shape[1] < 2:
            plane = np.concatenate([plane, np.zeros((len(plane), 1))], 1)
        cell = np.floor(plane / (2 * radius)).astype(np.int64)
        low = plane - cell * 2 * radius  # distance to the lower edges
        high = 2 * radius - low
        out.append((rows, j, cell[:, 0], cell[:, 1], True))
        x, y = high[:, 0], high[:, 1]
        for dx, dy, far in ((1, 0, x), (0, 1, y), (1, 1, np.hypot(x, y)), (1, -1, np.hypot(x, low[:, 1]))):
            near = np.flatnonzero(far <= radius + SLACK)
            out.append((near, j, cell[near, 0] + dx, cell[near, 1] + dy, False))
    return out


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def placed(classes: DataFrame, cosine: float) -> DataFrame:
    """(label, size, block, x, y, home, key, copies, embedding): every place of every class."""
    vector = classes.schema["embedding"].dataType.simpleString()
    label = classes.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(1).to_numpy()
            for size in np.unique(sizes):
                own = np.flatnonzero(sizes == size)
                for a in range(0, len(own), 2048):
                    part = batch.take(pa.array(own[a: a + 2048]))
                    for rows, j, x, y, home in placements(_matrix(part.column(4)), cosine):
                        taken = part.take(pa.array(rows))
                        n = len(rows)
                        yield pa.RecordBatch.from_arrays(
                            [taken.column(0), taken.column(1), pa.array(np.full(n, j), pa.int32()), pa.array(x), pa.array(y),
                             pa.array(np.full(n, home)), taken.column(2), taken.column(3), taken.column(4)],
                            names=["label", "size", "block", "x", "y", "home", "key", "copies", "embedding"],
                        )

    schema = (
        f"label {label}, size int, block int, x bigint, y bigint, home boolean, key bigint, copies bigint, embedding {vector}"
    )
    return classes.select("label", "size", "key", "copies", "embedding").mapInArrow(run, schema)


def dealt(places: DataFrame) -> DataFrame:
    """Adds i, j and role: the task of each row within its cell.

    Homes are chunks 0 .. H-1, visitors chunks 0 .. V-1.  Task (i, i) has home
    chunk i (role 0) and visitor chunk 0; task (i, j) with j < H the home chunks i
    (role 0) and j; task (i, H + v) home chunk i and visitor chunk v.
    """
    cell = ["label", "size", "block", "x", "y"]
    chunks = lambda n: F.greatest(F.ceil(n / CHUNK), F.lit(1)).cast("int")
    load = places.groupBy(*cell).agg(
        chunks(F.count_if("home")).alias("H"), chunks(F.count_if(~F.col("home"))).alias("V")
    ).where("H > 1 or V > 1")
    rows = places.join(load, cell, "left").withColumns({"H": F.coalesce("H", F.lit(1)), "V": F.coalesce("V", F.lit(1))})
    rows = rows.withColumn("c", F.pmod(F.xxhash64("key"), F.when(F.col("home"), F.col("H")).otherwise(F.col("V"))).cast("int"))
    task = lambda i, j, role: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(role).alias("role"))
    c, h, v = F.col("c"), F.col("H"), F.col("V")
    homes = F.sequence(F.lit(0), h - 1)
    with_homes = F.transform(homes, lambda k: F.when(k < c, task(k, c, 1)).otherwise(task(c, k, 0)))
    with_visitors = F.when(v > 1, F.transform(F.sequence(F.lit(1), F.greatest(v - 1, F.lit(1))), lambda k: task(c, h + k, 0)))
    visits = F.transform(homes, lambda k: task(k, F.when(c == 0, k).otherwise(h + c), 2))
    tasks = F.when(
        F.col("home"), F.concat(with_homes, F.coalesce(with_visitors, F.array().cast("array<struct<i:int,j:int,role:int>>")))
    ).otherwise(visits)
    rows = rows.withColumn("task", F.explode(tasks)).select(
        *cell, "task.i", "task.j", "task.role", "key", "copies", "embedding"
    )
    # Dealt by task: a partitioning by cell alone would keep all tasks of a full cell together.
    return rows.repartition(*cell, "i", "j")


def candidates(left: np.ndarray, right: np.ndarray, block: slice, budget: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within the block's budget, with slack for single precision; ``confirmed`` decides exactly."""
    a, b = left[:, block].astype(np.float32), right[:, block].astype(np.float32)
    distance = -2 * a @ b.T
    distance += (a * a).sum(1)[:, None]
    distance += (b * b).sum(1)[None, :]
    return np.nonzero(distance <= budget + 1e-5)


def confirmed(vectors: np.ndarray, turned: np.ndarray, a: np.ndarray, b: np.ndarray, j: int, cosine: float) -> np.ndarray:
    """Of the candidate pairs of block j: those that no earlier block has and whose cosine suffices.

    Distances are summed component by component in a fixed order, so every task
    that meets a pair decides alike.
    """
    size = vectors.shape[1]
    norm = np.sqrt((vectors * vectors).sum(1))
    parts, allowed = blocks_of(size), budgets(size, cosine)
    out = []
    for s in range(0, len(a), PAIRS_AT_ONCE):
        p, q = a[s: s + PAIRS_AT_ONCE], b[s: s + PAIRS_AT_ONCE]
        ok = np.ones(len(p), bool)
        for k in range(j + 1):
            d = np.zeros(len(p))
            for column in range(parts[k].start, parts[k].stop):
                d += (turned[p, column] - turned[q, column]) ** 2
            ok &= (d <= allowed[k]) if k == j else (d > allowed[k])
        p, q = p[ok], q[ok]
        found = np.zeros(len(ok), bool)
        found[ok] = (vectors[p] * vectors[q]).sum(1) / (norm[p] * norm[q]) >= cosine
        out.append(found)
    return np.concatenate(out) if out else np.zeros(0, bool)


def _task(group: tuple, table: pa.Table, cosine: float) -> pa.Table:
    _, size, j, _, _, i_, j_ = (g.as_py() for g in group)
    role, key, copies = table["role"].to_numpy(), table["key"].to_numpy(), table["copies"].to_numpy()
    vectors = np.concatenate([_matrix(c) for c in table["embedding"].chunks]) if len(key) else np.zeros((0, size))
    home, other = np.flatnonzero(role == 0), np.flatnonzero(role != 0)
    # Rows rotate one by one, so a vector has the same rotated components in every task.
    unit, turn = _unit(vectors), rotation(size)
    turned = np.stack([(unit * turn[:, k]).sum(1) for k in range(size)], 1) if len(key) else vectors
    block, budget = blocks_of(size)[j], budgets(size, cosine)[j]
    a, b = np.empty(0, np.int64), np.empty(0, np.int64)
    if len(home) and len(other):
        p, q = candidates(turned[home], turned[other], block, budget)
        a, b = home[p], other[q]
    if i_ == j_ and len(home) > 1:
        p, q = candidates(turned[home], turned[home], block, budget)
        upper = p < q
        a, b = np.concatenate([a, home[p[upper]]]), np.concatenate([b, home[q[upper]]])
    ok = confirmed(vectors, turned, a, b, j, cosine)
    a, b = a[ok], b[ok]
    n = len(key)
    links = np.bincount(a, weights=copies[b], minlength=n) + np.bincount(b, weights=copies[a], minlength=n)
    root = graph.local_roots(n, a, b)
    some = np.flatnonzero(links > 0)
    return pa.table({
        "key": pa.array(key[some], pa.int64()), "links": pa.array(links[some].astype(np.int64)),
        "other": pa.array(key[root[some]], pa.int64()),
    })


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector; links hold within a label."""
    rows = vectors.select("vec_id", "label", "embedding")
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    usable = F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(whole & some, F.lit(False))
    rows = rows.withColumn("key", F.when(usable, F.xxhash64("label", "embedding")))
    classes = stored(
        rows.where("key is not null").groupBy("key").agg(
            F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("lowest"), F.first("label").alias("label"),
            F.first("embedding").alias("embedding"),
        ).withColumn("size", F.size("embedding")), "embed-classes",
    )
    found = stored(
        dealt(placed(classes, cosine)).groupBy("label", "size", "block", "x", "y", "i", "j").applyInArrow(
            lambda group, table: _task(group, table, cosine), "key bigint, links bigint, other bigint"
        ), "embed-links",
    )
    roots = graph.components(found.select(F.col("key").alias("a"), F.col("other").alias("b")), "embed-components")
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    rooted = classes.select("key", "copies", "lowest").join(links, "key", "left").join(
        roots.withColumnRenamed("node", "key"), "key", "left"
    ).select(
        "key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "lowest",
        F.coalesce("root", "key").alias("root"),
    )
    # Written first: the join with it then reads two plain shuffles and can split a large component.
    lowest = stored(rooted.groupBy("root").agg(F.min("lowest").alias("component_id")), "embed-lowest")
    named = rooted.join(lowest, "root").select("key", "n_links", "component_id")
    out = rows.select("vec_id", "key").join(named, "key", "left")
    component = F.coalesce("component_id", "vec_id").cast("bigint")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
