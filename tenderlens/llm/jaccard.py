"""N-gram Jaccard join with a token-group matrix.

Sets are the distinct word shingles of a text (64-bit hashes).  Two sets link
when intersection / union >= ``num`` / ``den``, in whole numbers.  Steps:

1. Every block of texts learns how many documents hold each of its shingles
   (``blockcounts``).  These frequencies only order shingles, rarest first.
2. A set that links with any other set shares at least ``OVERLAP`` of its first
   ``size - ceil(t * size) + OVERLAP`` shingles in that order with it.  Shingles of a
   single document cannot be shared, so a set with fewer than ``OVERLAP`` shared
   ones in front links with nothing: most texts end here.
3. Equal sets are one class.  The remaining classes are partitioned into groups
   of similar sets: by the smallest hash among the more widely held half of
   their shingles, large groups split into bounded chunks.  The matrix (shingle, group) stores the union of the front
   shingles of each group.
4. A query set meets the matrix; the number of its front shingles in a group's
   union bounds its overlap with every member.  Only groups that reach the
   bound, and whose sizes fit, are opened.
5. An opened group and its queries meet in bounded tasks, which count exact
   intersections and return the components among their sets, not the pairs.
6. Components over all tasks give each document its component.

No candidate is dropped: every step keeps all sets that can link.

Defined results: null texts and texts without words have the empty set and
link with nothing; a text with fewer words than a shingle has its whole word
sequence as one shingle.  Repeated rows are equal sets.  Rows with a null id link
like others; a component's id is its smallest id that is not null.  Extra
columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderlens.llm import blockcounts, graph, textscan
from tenderlens.llm.storage import block_count, block_of, stored, text_bytes

OVERLAP = 4
MEMBERS, TASK_SHINGLES = 512, 1 << 20
SLICE_BYTES = 1 << 19


@dataclass(frozen=True)
class Rule:
    """Shingles of ``words`` words; link from num / den on."""

    words: int = 3
    num: int = 90
    den: int = 100

    def least(self, size):
        """Overlap that a set of this size needs with any partner."""
        return -(-self.num * size // self.den)

    def links(self, both, size_a, size_b):
        return self.den * both >= self.num * (size_a + size_b - both)


def _sets(texts, words: int) -> tuple[np.ndarray, np.ndarray]:
    sets, sizes = [], [np.zeros(1, np.int64)]
    for part in textscan.scan_parts(texts, SLICE_BYTES):
        values, cuts = textscan.shingle_sets(part, words)
        sets.append(values)
        sizes.append(np.diff(cuts))
    return (np.concatenate(sets) if sets else np.empty(0, np.uint64)), np.cumsum(np.concatenate(sizes))


def described(docs: DataFrame, rule: Rule, block_bytes: int = blockcounts.BLOCK_BYTES) -> DataFrame:
    """One row per document: (doc_id, n, sid, and for possible partners low, front, shingles).

    ``sid`` is a hash of the whole set.  ``low`` is the smallest hash among its more
    widely held half (edits of one copy are not in it, so similar sets agree),
    ``front`` the shared shingles among its rarest.  Of equal sets in a block one row
    carries them.
    """
    rows = docs.select(F.col("doc_id").alias("_id"), F.col("text").cast("string").alias("_text"))
    n_bytes = text_bytes(rows, "_text")
    blocks, bits = block_count(n_bytes, block_bytes), blockcounts.part_bits(n_bytes, block_bytes)
    dealt = rows.select(block_of(blocks, "_id", "_text").alias("block"), "_id", "_text").repartition(blocks, "block")
    id_type = rows.schema["_id"].dataType.simpleString()

    def kinds_of(table: pa.Table) -> list:
        values, _ = _sets(table["_text"], rule.words)
        return [np.unique(values, return_counts=True)]

    answers = blockcounts.counted(dealt, kinds_of, bits, narrow=True)

    def describe(group: tuple, texts: pa.Table, told: pa.Table) -> pa.Table:
        values, cuts = _sets(texts["_text"], rule.words)
        distinct, place = np.unique(values, return_inverse=True)
        held_by = blockcounts.totals_of([distinct], told, bits)[0][place]
        n = np.diff(cuts)
        sid, low, front, shingles = [], [], [], []
        seen = set()
        for a, b in zip(cuts, cuts[1:]):
            size = int(b - a)
            own = values[a:b]
            key = int(textscan.mix(own ^ np.uint64(size)).sum(dtype=np.uint64).view(np.int64)) if size else None
            sid.append(key)
            shared = None
            if size and key not in seen:
                need = rule.least(size)
                take = min(size, size - need + OVERLAP)
                order = np.lexsort((own, held_by[a:b]))[:take]
                order = order[held_by[a:b][order] > 1]
                if len(order) >= min(OVERLAP, need):
                    shared = own[order].view(np.int64)
                    seen.add(key)
            front.append(shared)
            if shared is not None:
                held = held_by[a:b]
                low.append(int(own[held >= np.median(held)][:1].view(np.int64)[0]))
            else:
                low.append(None)
            shingles.append(own.view(np.int64) if shared is not None else None)
        return pa.table({
            "doc_id": texts["_id"], "n": pa.array(n, pa.int64()), "sid": pa.array(sid, pa.int64()),
            "low": pa.array(low, pa.int64()), "front": pa.array(front, pa.list_(pa.int64())),
            "shingles": pa.array(shingles, pa.list_(pa.int64())),
        })

    schema = f"doc_id {id_type}, n bigint, sid bigint, low bigint, front array<bigint>, shingles array<bigint>"
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(describe, schema)


def grouped(classes: DataFrame) -> DataFrame:
    """Adds ``gid``: classes with the same ``low``, in chunks of bounded members and shingles."""
    sizes = classes.groupBy("low").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("total"))
    chunks = F.greatest(F.ceil(F.col("members") / MEMBERS), F.ceil(F.col("total") / TASK_SHINGLES), F.lit(1)).cast("bigint")
    sizes = sizes.where(chunks > 1).select("low", chunks.alias("chunks"))
    part = F.pmod(F.xxhash64("sid"), F.coalesce("chunks", F.lit(1)))
    return classes.join(sizes, "low", "left").select("sid", "n", "front", F.xxhash64("low", part).alias("gid"))


def opened(sets: DataFrame, rule: Rule) -> DataFrame:
    """(sid, gid): queries and the other groups whose bound they reach, each pair of groups in one direction."""
    matrix = sets.select("gid", "n", F.explode("front").alias("shingle")).groupBy("shingle", "gid").agg(
        F.min("n").alias("least"), F.max("n").alias("most")
    ).select("shingle", F.col("gid").alias("group"), "least", "most")
    queries = sets.select("sid", "gid", "n", F.explode("front").alias("shingle"))
    fits = (F.col("den") * F.col("most") >= F.col("num") * F.col("n")) & (
        F.col("den") * F.col("n") >= F.col("num") * F.col("least")
    )
    hits = queries.join(matrix, "shingle").where(F.col("group") < F.col("gid"))
    hits = hits.withColumns({"num": F.lit(rule.num), "den": F.lit(rule.den)}).where(fits)
    counts = hits.groupBy("sid", "n", "group").agg(F.count(F.lit(1)).alias("shared"))
    need = F.least(F.lit(OVERLAP), F.ceil(F.col("n") * rule.num / F.lit(rule.den)))
    return counts.where(F.col("shared") >= need).select("sid", F.col("group").alias("gid"), "n")


def overlaps(queries: list[np.ndarray], members: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Exact intersection sizes of all queries with all members, over the shingles that both sides hold."""
    q_all, m_all = np.concatenate(queries), np.concatenate(members)
    common = np.intersect1d(q_all, m_all)
    out = np.zeros((len(queries), len(members)), np.float32)
    if not len(common):
        return out

    def cells(values, sets):
        at = np.minimum(np.searchsorted(common, values), len(common) - 1)
        there = common[at] == values
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(at[there], kind="stable")
        return row[there][order], at[there][order]

    (q_row, q_col), (m_row, m_col) = cells(q_all, queries), cells(m_all, members)
    for a in range(0, len(common), width):
        left, right = np.zeros((len(queries), width), np.float32), np.zeros((len(members), width), np.float32)
        s, e = np.searchsorted(q_col, [a, a + width])
        left[q_row[s:e], q_col[s:e] - a] = 1
        s, e = np.searchsorted(m_col, [a, a + width])
        right[m_row[s:e], m_col[s:e] - a] = 1
        out += left @ right.T
    return out


def linked(sets: DataFrame, full: DataFrame, rule: Rule) -> DataFrame:
    """Edges (a, b) that connect the classes as their links do."""
    pairs = stored(opened(sets, rule), "jaccard-opened")
    load = pairs.groupBy("gid").agg(F.count(F.lit(1)).alias("queries"), F.sum("n").alias("total"))
    chunks = F.greatest(F.ceil(F.col("queries") / MEMBERS), F.ceil(F.col("total") / TASK_SHINGLES)).cast("bigint")
    load = load.select("gid", chunks.alias("chunks"))
    # A group meets itself once (task 0) and each chunk of its queries (tasks 1, 2, ...).
    member = sets.select("sid", "gid").join(load, "gid", "left").select(
        "sid", "gid", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("chunks", F.lit(0)))).alias("task"),
        F.lit(False).alias("asks"),
    )
    size = sets.groupBy("gid").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("gid")
    alone = member.where("task = 0").join(size, "gid", "left_semi").unionByName(member.where("task > 0"))
    query = pairs.join(load, "gid").select(
        "sid", "gid", (F.pmod(F.xxhash64("sid"), "chunks") + 1).alias("task"), F.lit(True).alias("asks")
    )
    work = alone.unionByName(query).join(full, "sid").select(
        F.xxhash64("gid", "task").alias("place"), "gid", "task", "asks", "sid", "shingles"
    )

    def verify(group: tuple, table: pa.Table) -> pa.Table:
        asks = table["asks"].to_numpy()
        sid = table["sid"].to_numpy()
        values = [x.values.to_numpy().view(np.uint64) for x in table["shingles"]]
        members = np.flatnonzero(~asks)
        queries = np.flatnonzero(asks) if group[1].as_py() else members
        if not len(members) or not len(queries):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        n = np.array([len(v) for v in values], np.int64)
        both = overlaps([values[i] for i in queries], [values[i] for i in members]).astype(np.int64)
        q, m = np.nonzero(rule.links(both, n[queries][:, None], n[members][None, :]))
        root = graph.local_roots(len(sid), queries[q], members[m])
        held = np.flatnonzero(root != np.arange(len(sid)))
        return pa.table({"a": pa.array(sid[held], pa.int64()), "b": pa.array(sid[root[held]], pa.int64())})

    return work.groupBy("gid", "task").applyInArrow(verify, "a bigint, b bigint")


def join_components(docs: DataFrame, rule: Rule = Rule(), block_bytes: int = blockcounts.BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_shingles, set_id, component_id): one row per document; set_id marks equal sets."""
    rows = stored(described(docs, rule, block_bytes), "jaccard-sets")
    possible = rows.where("front is not null").select("sid", "n", "low", "front", "shingles").dropDuplicates(["sid"])
    sets = stored(grouped(possible.drop("shingles")), "jaccard-groups")
    full = possible.select("sid", "shingles")
    roots = graph.components(stored(linked(sets, full, rule), "jaccard-edges"), "jaccard-components")
    classes = rows.where("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("first"))
    rooted = classes.join(roots.withColumnRenamed("node", "sid"), "sid", "left").select(
        "sid", "first", F.coalesce("root", "sid").alias("root")
    )
    # Written first: the join with it then reads two plain shuffles and can split a large component.
    lowest = stored(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "jaccard-lowest", rows.count())
    named = rooted.join(lowest, "root").select("sid", "component_id")
    return rows.join(named, "sid", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("sid").alias("set_id"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
    )
