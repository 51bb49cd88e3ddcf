"""Conversation prefix trie: ternary search trees over turn codes, one for each range shard.

A turn's role and text become a code (dictionary encoding); a conversation is
its array of codes.  Equal conversations are one sequence with its number of
members.  Sequences are dealt into shards by ranges of their codes, so a prefix is in
neighbouring shards only.  A shard inserts its sequences, the median first, into a ternary
search tree: every tree node is the next code after its parent's prefix, with a lower and a higher sibling
and a way down.  One pass from the last node to the first accumulates members, leaves and
savings of every subtree, without recursion.

A node that other shards may have as well is a prefix of the shard's first or last
sequence.  Those boundary nodes leave the shard as partial sums under the digest of
their prefix and are merged: members and closed children add up, and subtree sums go up their
own tree by pointer doubling, in as many rounds as the logarithm of its depth.  All other nodes are final.

``ends_sha256`` is streamed: members in order of (sequence, id) are packed into strings by range, and
each sequence's strings go through one digest, whatever their number.

Defined results: turns are ordered by turn (null first), then role, then text;
repeated rows are separate turns.  A null role or text is empty.  Rows without a conversation
id belong to no conversation.  A rebuilt conversation without turns is a member of the root
only.  Without conversations there is no node. The remainder of
a negative id is negative, as in SQL.  Extra columns are not read.  Turns are told apart
by 128 bits of hash, prefixes by 128 bits of digest.  A conversation is one row of 16
bytes a turn, and a shard holds ``SHARD_TURNS`` turns or one conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlens.llm.storage import stored

SHARD_TURNS = 250_000
LEAST_SHARD_TURNS = 2_000
PACKED = 1 << 16
NOBODY = hashlib.sha256(b"").hexdigest()


def encoded(conversations: DataFrame) -> DataFrame:
    """(conv_id, codes, chars) of every conversation: its turns' codes and code points in order."""
    whole = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", whole("role").alias("role"), whole("text").alias("text")
    )
    order = ["conv_id", "turn", "role", "text"]
    # The row's place in the whole order, so a conversation of any length is sorted by many tasks.
    turns = stored(
        rows.repartitionByRange(*order).sortWithinPartitions(*order).select(
            "conv_id", F.monotonically_increasing_id().alias("place"), F.length("text").alias("chars"),
            F.xxhash64("role", "text").alias("h"), F.xxhash64(F.lit(1), "role", "text").alias("g"),
        ), "trie-turns",
    )
    dictionary = stored(turns.groupBy("h", "g").agg(F.min("place").alias("code")), "trie-dictionary")
    coded = turns.join(dictionary, ["h", "g"]).select("conv_id", F.struct("place", "code", "chars").alias("t"))
    one = coded.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return one.select("conv_id", F.col("t.code").alias("codes"), F.col("t.chars").alias("chars"))


def forked(convs: DataFrame, family: int = 100, most: int = 5) -> DataFrame:
    """Every conversation c with its first h turns replaced by those of c - c % family; h = crc32(c) % (most + 1)."""
    heads = convs.where(F.col("conv_id") % family == 0).select(
        F.col("conv_id").alias("base"), F.slice("codes", 1, most).alias("head"), F.slice("chars", 1, most).alias("head_chars")
    )
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("int")
    both = convs.withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % family}).join(heads, "base", "left")

    def joined(head: str, own: str) -> Column:
        empty = F.array().cast(both.schema[own].dataType)
        return F.concat(F.slice(F.coalesce(head, empty), F.lit(1), F.col("h")), F.slice(own, F.col("h") + 1, F.size(own)))

    return both.select("conv_id", joined("head", "codes").alias("codes"), joined("head_chars", "chars").alias("chars"))


def _member_digests(convs: DataFrame, sequences: DataFrame) -> DataFrame:
    """(first, ends): the digest of the ids of each sequence that several conversations have."""
    shared = sequences.where("n > 1").select("codes", "first")
    members = convs.join(shared, "codes").select("first", "conv_id")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: tuple[list, list, list] = ([], [], [])
        now, start, ids, size = None, None, [], 0

        def flush() -> None:
            if ids:
                for column, value in zip(done, (now, start, ",".join(ids))):
                    column.append(value)

        for batch in batches:
            for first, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if first != now or size > PACKED:
                    flush()
                    now, start, ids, size = first, conv, [], 0
                ids.append(str(conv))
                size += len(ids[-1]) + 1
            yield _record(done)
            done = ([], [], [])
        flush()
        yield _record(done)

    def _record(done: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(done[0], pa.int64()), pa.array(done[1], pa.int64()), pa.array(done[2], pa.string())], names=["first", "start", "ids"]
        )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        for batch in batches:
            names, ends = [], []
            for first, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if first != now:
                    if now is not None:
                        names.append(now)
                        ends.append(sha.hexdigest())
                    now, sha = first, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(ends, pa.string())], names=["first", "ends"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([sha.hexdigest()])], names=["first", "ends"])

    packed = members.repartitionByRange("first", "conv_id").sortWithinPartitions("first", "conv_id").mapInArrow(
        pack, "first bigint, start bigint, ids string"
    )
    return packed.repartition("first").sortWithinPartitions("first", "start").mapInArrow(digest, "first bigint, ends string")


class Tree:
    """A ternary search tree; node 0 is the textless prefix."""

    def __init__(self):
        self.code, self.low, self.high, self.down = [0], [-1], [-1], [-1]
        self.parent, self.depth, self.chars = [-1], [0], [0]
        self.members, self.first, self.ends = [0], [None], [None]
        self.compared = 0

    def _new(self, code: int, parent: int, chars: int) -> int:
        for column, value in (
            (self.code, code), (self.low, -1), (self.high, -1), (self.down, -1), (self.parent, parent),
            (self.depth, self.depth[parent] + 1), (self.chars, chars), (self.members, 0), (self.first, None), (self.ends, None),
        ):
            column.append(value)
        return len(self.code) - 1

    def insert(self, codes: list[int], chars: list[int]) -> int:
        """The node of a sequence, made where it is missing."""
        code, at = self.code, 0
        for c, k in zip(codes, chars):
            t = self.down[at]
            if t < 0:
                t = self.down[at] = self._new(c, at, k)
            while code[t] != c:
                self.compared += 1
                side = self.low if c < code[t] else self.high
                if side[t] < 0:
                    side[t] = self._new(c, at, k)
                t = side[t]
            at = t
        return at

    def path(self, node: int) -> list[int]:
        out = [node]
        while out[-1]:
            out.append(self.parent[out[-1]])
        return out


def build(rows: list[tuple]) -> tuple[Tree, list[int]]:
    """The tree of distinct sequences (codes, chars, n, first, ends) in ascending order, and each one's node."""
    tree, nodes = Tree(), [0] * len(rows)
    halves = [(0, len(rows))]
    while halves:
        a, b = halves.pop()
        if a < b:
            middle = (a + b) // 2
            codes, chars, n, first, ends = rows[middle]
            node = nodes[middle] = tree.insert(codes, chars)
            tree.members[node], tree.first[node], tree.ends[node] = n, first, ends
            halves += [(a, middle), (middle + 1, b)]
    return tree, nodes


SHARD = (
    "key binary, parent_key binary, conv_id bigint, depth int, parent bigint, n bigint, chars bigint, children bigint, "
    "leaves bigint, saved bigint, ends string"
)


def shard_nodes(rows: list[tuple]) -> list[tuple]:
    """Rows of ``SHARD``: closed nodes (no key) with final values, boundary nodes with what their closed children add."""
    tree, nodes = build(rows)
    count = len(tree.code)
    members, first, parent, chars = tree.members, tree.first, tree.parent, tree.chars
    opened = {*tree.path(nodes[0]), *tree.path(nodes[-1])}
    keys: dict[int, bytes] = {}
    for node in sorted(opened):  # parents come before their children
        above = keys[parent[node]] + tree.code[node].to_bytes(8, "big", signed=True) if node else b""
        keys[node] = hashlib.blake2b(above, digest_size=16).digest()
    children, leaves, saved = [0] * count, [0] * count, [0] * count
    for node in range(count - 1, -1, -1):  # children come after their parents
        closed = node not in opened
        if closed:
            leaves[node] += children[node] == 0
            saved[node] += (members[node] - 1) * chars[node]
        if node:
            up = parent[node]
            members[up] += members[node]
            first[up] = first[node] if first[up] is None else min(first[up], first[node])
            if closed:
                children[up] += 1
                leaves[up] += leaves[node]
                saved[up] += saved[node]
    return [
        (
            keys.get(node), keys.get(parent[node]) if node else None, first[node], tree.depth[node],
            None if not node or parent[node] in opened else first[parent[node]],
            members[node], chars[node], children[node], leaves[node], saved[node], tree.ends[node],
        )
        for node in range(count)
    ]


def _shards(sequences: DataFrame) -> DataFrame:
    spark = sequences.sparkSession
    turns = sequences.agg(F.sum(F.size("codes") + 1)).first()[0] or 0
    few = min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // LEAST_SHARD_TURNS))
    shards = max(1, few, -(-turns // SHARD_TURNS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            rows += zip(*(c.to_pylist() for c in batch.columns))
        if rows:
            found = shard_nodes(rows)
            kinds = [pa.binary(), pa.binary(), pa.int64(), pa.int32(), *[pa.int64()] * 6, pa.string()]
            names = [c.split()[0] for c in SHARD.split(", ")]
            for a in range(0, len(found), 10_000):
                columns = zip(*found[a: a + 10_000])
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    dealt = sequences.select("codes", "chars", "n", "first", "ends").repartitionByRange(shards, "codes").sortWithinPartitions("codes")
    return stored(dealt.mapInArrow(run, SHARD), "trie-shards")


def _merged(shards: DataFrame) -> DataFrame:
    """(key, parent_key, conv_id, depth, n, children, leaves, saved, ends) of the boundary nodes: some for each shard."""
    parts = shards.where("key is not null").groupBy("key").agg(
        F.max("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.sum("n").alias("n"),
        F.max("chars").alias("chars"), F.sum("children").alias("children"), F.sum("leaves").alias("leaves"),
        F.sum("saved").alias("saved"), F.max("ends").alias("ends"),
    )
    nodes = stored(parts, "trie-boundary")
    below = nodes.where("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(F.count(F.lit(1)).alias("more"))
    nodes = nodes.join(below, "key", "left").withColumn("children", F.col("children") + F.coalesce("more", F.lit(0)))
    nodes = stored(nodes.withColumns({
        "leaves": F.col("leaves") + (F.col("children") == 0).cast("bigint"), "saved": F.col("saved") + (F.col("n") - 1) * F.col("chars"),
        "up": F.col("parent_key"),
    }).drop("more"), "trie-boundary-0")
    deepest, reach = nodes.agg(F.max("depth")).first()[0] or 0, 1
    while reach <= deepest:  # sums of all within reach so far; the pointer goes as far up
        add = nodes.where("up is not null").groupBy(F.col("up").alias("key")).agg(
            F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")
        )
        far = nodes.select(F.col("key").alias("up"), F.col("up").alias("further"))
        zero = F.lit(0)
        nodes = stored(
            nodes.join(add, "key", "left").join(far, "up", "left").withColumns({
                "leaves": F.col("leaves") + F.coalesce("more_leaves", zero), "saved": F.col("saved") + F.coalesce("more_saved", zero),
                "up": F.col("further"),
            }).drop("more_leaves", "more_saved", "further"), f"trie-boundary-{reach}",
        )
        reach *= 2
    return nodes


def prefix_nodes(convs: DataFrame) -> DataFrame:
    """One row per distinct prefix of (conv_id, codes, chars): see the module."""
    convs = stored(convs, "trie-conversations")
    sequences = stored(
        convs.groupBy("codes", "chars").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("first")), "trie-sequences"
    )
    alone = F.when(F.col("n") == 1, F.sha2(F.col("first").cast("string").cast("binary"), 256))
    listed = sequences.join(_member_digests(convs, sequences), "first", "left").withColumn("ends", F.coalesce("ends", alone))
    shards = _shards(stored(listed, "trie-listed"))
    merged = _merged(shards)
    names = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above"))
    columns = ["conv_id", "depth", "parent", "n", "children", "leaves", "saved", "ends", "parent_key"]
    every = shards.where("key is null").select(*columns).unionByName(
        merged.withColumn("parent", F.lit(None).cast("bigint")).select(*columns)
    )
    long = lambda c, name: F.col(c).cast("bigint").alias(name)
    return every.join(names, "parent_key", "left").select(
        "conv_id", long("depth", "depth"), F.coalesce("parent", "above").alias("parent_conv_id"), long("n", "n_convs"),
        long("children", "n_children"), long("leaves", "n_leaves"), long("saved", "saved_tokens"),
        F.coalesce("ends", F.lit(NOBODY)).alias("ends_sha256"),
    )
