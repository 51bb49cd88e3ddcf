"""Counts of very many keys over the whole corpus, returned to where they are needed.

Documents are dealt into blocks of a bounded number of bytes.  A block asks
once for each of its distinct 64-bit keys: the sorted keys are cut into ranges
(parts), so one row is (part, block, array of keys, array of weights).  A part
adds up the weights of equal keys over all blocks and answers every row with an
array of totals in the order of its keys.  A key that a third of all documents
hold is one element per block, so no part or block is hot.

Per element a question costs 8 bytes (4 where ``narrow``) and its weight and its
answer 1 byte each before compression: counts below 127 are bytes, the few
others follow in a second array.  That keeps the shuffle a small multiple of
the text.  Both sides are plain groups of rows that Spark shuffles, spills
and repeats after a lost executor.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

BLOCK_BYTES = 8 << 20


def part_bits(n_bytes: int, part_bytes: int = BLOCK_BYTES) -> int:
    """Parts are a power of two; each holds the keys of about ``part_bytes`` of text at most."""
    return max(0, (max(1, n_bytes) // part_bytes).bit_length())


def _cuts(keys: np.ndarray, bits: int) -> np.ndarray:
    """Offsets of the parts in sorted keys."""
    if bits == 0:
        return np.array([0, len(keys)])
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def _small(counts: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Lists of counts as lists of bytes, and the counts from 127 on in a second list."""
    large = counts >= 127
    before = np.concatenate([[0], np.cumsum(large)])[offsets].astype(np.int32)
    return (
        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.minimum(counts, 127).astype(np.int8))),
        pa.ListArray.from_arrays(pa.array(before), pa.array(np.minimum(counts[large], 2**31 - 1).astype(np.int32))),
    )


def _whole(small: np.ndarray, large: np.ndarray) -> np.ndarray:
    """The counts again, of one row or of many in a row."""
    out = small.astype(np.int64)
    out[small == 127] = large
    return out


def questions(block: int, kinds: list[tuple[np.ndarray, np.ndarray]], bits: int, narrow: bool, everywhere: bool) -> pa.Table:
    """Rows (part, block, keys, small, large); ``kinds`` are (sorted distinct uint64 keys, weights).

    ``everywhere`` also asks the parts of the first kind in which the block has no key.
    """
    parts, starts, ends, base, all_keys, all_weights = [], [], [], 0, [], []
    for kind, (keys, weights) in enumerate(kinds):
        cuts = _cuts(keys, bits)
        for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if b > a or (everywhere and kind == 0):
                parts.append((kind << bits) + p)
                starts.append(base + a)
                ends.append(base + b)
        base += len(keys)
        all_keys.append(_narrowed(keys, bits) if narrow else keys.view(np.int64))
        all_weights.append(weights.astype(np.int64))
    offsets = np.array([*starts, ends[-1]] if ends else [0], np.int32)
    keys_ = np.concatenate(all_keys) if all_keys else np.empty(0, np.int64)
    small, large = _small(np.concatenate(all_weights) if all_weights else np.empty(0, np.int64), offsets)
    return pa.table({
        "part": pa.array(parts, pa.int64()),
        "block": pa.array(np.full(len(parts), block), pa.int64()),
        "keys": pa.ListArray.from_arrays(offsets, pa.array(keys_)),
        "small": small,
        "large": large,
    })


def _narrowed(keys: np.ndarray, bits: int) -> np.ndarray:
    """The 32 bits that follow those of the part."""
    return ((keys >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)


def _answer(table: pa.Table) -> pa.Table:
    keys = _flat(table["keys"])
    weights = _whole(_flat(table["small"]), _flat(table["large"]))
    lengths = pc.list_value_length(table["keys"]).to_numpy()
    distinct, place = np.unique(keys, return_inverse=True)
    totals = np.bincount(place, weights=weights, minlength=len(distinct)).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    n = len(lengths)
    small, large = _small(totals[place], offsets)
    return pa.table({
        "block": table["block"],
        "part": table["part"],
        "small": small,
        "large": large,
        "part_total": pa.array(np.full(n, totals.sum()), pa.int64()),
        "part_distinct": pa.array(np.full(n, (totals > 0).sum()), pa.int64()),
    })


def _flat(column: pa.ChunkedArray) -> np.ndarray:
    chunks = [c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]
    return np.concatenate(chunks) if chunks else np.empty(0, np.int64)


def counted(blocks: DataFrame, kinds_of: Callable[[pa.Table], list], bits: int, narrow: bool = False,
            everywhere: bool = False) -> DataFrame:
    """Answers (block, part, small, large, part_total, part_distinct) to the questions of every block."""
    key = "int" if narrow else "bigint"

    def ask(group: tuple, table: pa.Table) -> pa.Table:
        return questions(group[0].as_py(), kinds_of(table), bits, narrow, everywhere)

    asked = blocks.groupBy("block").applyInArrow(ask, f"part bigint, block bigint, keys array<{key}>, small array<tinyint>, large array<int>")
    return asked.groupBy("part").applyInArrow(
        _answer, "block bigint, part bigint, small array<tinyint>, large array<int>, part_total bigint, part_distinct bigint"
    )


def totals_of(kinds: list[np.ndarray], answers: pa.Table, bits: int) -> list[np.ndarray]:
    """Totals aligned with the sorted distinct keys of each kind, from the answers to one block."""
    parts = answers["part"].to_numpy()
    order = np.argsort(parts)
    rows = {int(parts[i]): i for i in order}
    small, large = (pa.concat_arrays(answers[c].chunks) if answers[c].num_chunks else [] for c in ("small", "large"))
    out = []
    for kind, keys in enumerate(kinds):
        found = np.zeros(len(keys), np.int64)
        cuts = _cuts(keys, bits)
        for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if b > a:
                row = rows[(kind << bits) + p]
                found[a:b] = _whole(small[row].values.to_numpy(), large[row].values.to_numpy())
        out.append(found)
    return out
